"""Removal of bytes covered by repeated strings of a fixed length, through suffix arrays.

Documents are cut into pieces by minimizers; pieces whose minimizer occurs once hold no repeat. Before anything is
sorted, equal pieces collapse to one row with two of their places, so a group of copies of any size costs two.
Both representatives, and every single piece that shares its minimizer with others, are cut into blocks by distance
from the minimizer. The windows of a block share a core, the stretch that all of them cover, and only blocks with
equal cores can hold equal windows; so a block is contracted to the bytes left of the core, one symbol for the
core, and the bytes right of it. Shards of contracted blocks are sorted into suffix arrays by Larsson-Sadakane
refinement; Kasai's common prefixes show the windows that stand twice in the shard. A core in more than
``shard_blocks`` blocks is spread over several shards, whose sorted runs of distinct windows are then merged across
shards by binary search, routed by a hash of the window. Only windows that a suffix array or the merge shows twice
are removed, at every place of the piece that holds them.

Defined cases: a null or empty text has no bytes and nothing removed. Texts shorter than a window stay whole. Every
row is a document of its own: rows that repeat an id, with equal texts or others, count as several, and rows
without an id take part like any other. Of equal windows none is preferred: all go. An empty table gives an empty
result; other columns are ignored. Texts are read whole; matches never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.llm.common import materialize, release, table
from scholium.llm.suffixes import common_prefixes, suffix_array
from scholium.llm.windows import RANGES, blocks, covered, cut, keyed, mix, ranges, structs, with_lists

LENGTH, SEED, STEP = 400, 160, 32
#: Blocks of one core in a shard; more are spread over several shards and merged.
SHARD_BLOCKS = 256
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def pieces(base: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """Pieces of all ``keyed`` rows: first window, windows, place of the minimizer, and the two hashes that name it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "t", "start", "n", "place", "h", "d"]
        for batch in batches:
            ids, hashes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for at in range(0, batch.num_rows, 1000):
                texts = [np.frombuffer(_raw(t.as_py()), np.uint8) for t in batch.column(2).slice(at, 1000)]
                for block in blocks([len(t) for t in texts], length):
                    values = _BYTES[np.concatenate([texts[d][a:b] for d, a, b in block])]
                    p = cut(values, block, length, seed)
                    columns = map(_signed, (p.start, p.windows, p.place, p.anchor, p.digest))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at + p.owner]), pa.array(hashes[at + p.owner]), *columns], names=names)

    return base.select("doc", "t", "text").mapInArrow(run, "doc long, t long, start long, n long, place long, h long, d long")


_BLOCKS = "key long, core long, h long, d long, low long, first long, left binary, right binary, need boolean"


def _blocks(length: int, step: int):
    """Blocks of the wanted pieces: windows by ``step`` distances from the minimizer, contracted around the core.

    ``first`` is the piece's window at which the core begins, and the windows of the block run from ``len(left)``
    down to ``low`` bytes left of it. Rows that repeat both id and text are read once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _BLOCKS.split(", ")]
        kinds = [*[pa.int64()] * 6, pa.binary(), pa.binary(), pa.bool_()]
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            rows: list[tuple] = []
            ends, fields = structs(batch.column(3), ("at", "n", "place", "h", "d", "need"))
            fields = [f.tolist() for f in fields]
            for row, (doc, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if (doc, t) not in seen:
                    raw = _raw(batch.column(2)[row].as_py())
                    for at, n, place, h, d, need in zip(*(f[ends[row] : ends[row + 1]] for f in fields)):
                        nearest, furthest = place - n + 1, place
                        for k in range(nearest // step, furthest // step + 1):
                            low, high = max(nearest - k * step, 0), min(furthest - k * step, step - 1)
                            begin = at + place - k * step  # where the core begins
                            end = begin - (step - 1) + length
                            core = xxhash.xxh3_128_intdigest(raw[begin:end], seed=k)
                            rows.append(
                                (
                                    (core >> 64) - (1 << 63), (core & ((1 << 64) - 1)) - (1 << 63), h, d, low, begin - at,
                                    raw[begin - high : begin], raw[end : end + step - 1 - low], need,
                                )
                            )
                seen.add((doc, t))
                if len(rows) >= 20_000 or row == batch.num_rows - 1:
                    columns = list(zip(*rows)) or [()] * len(names)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)
                    rows = []

    return run


class Shard:
    """Contracted blocks as one symbol sequence: each block's left bytes, core, right bytes, and an end of its own."""

    def __init__(self, cores: np.ndarray, lefts: list[bytes], rights: list[bytes], step: int):
        left, right = (np.fromiter(map(len, x), np.int64, len(x)) for x in (lefts, rights))
        sizes = left + right + 2
        self.starts = np.cumsum(sizes) - sizes
        self.left, self.step = left, step
        n = int(sizes.sum())
        symbols = np.empty(n, np.int64)
        core_at, end_at = self.starts + left, self.starts + sizes - 1
        plain = np.ones(n, bool)
        plain[core_at] = plain[end_at] = False
        both = b"".join(x for pair in zip(lefts, rights) for x in pair)
        symbols[plain] = np.frombuffer(both, np.uint8)
        symbols[core_at] = 256 + cores
        symbols[end_at] = 256 + len(lefts) + np.arange(len(lefts))
        self.symbols = symbols
        order, ranks = suffix_array(symbols)
        common = common_prefixes(symbols, order, ranks)
        near = np.maximum(common, np.append(common[1:], 0))
        self.order, self.ranks, self.common, self.near = order, ranks, common, near

    def windows(self, lows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(block, suffix) of every window: a suffix that starts left of the core or on it."""
        counts = self.left - lows + 1
        block = np.repeat(np.arange(len(counts)), counts)
        offset = np.arange(len(block)) - np.repeat(np.cumsum(counts) - counts, counts)
        return block, self.starts[block] + offset

    def repeated(self, suffixes: np.ndarray) -> np.ndarray:
        return self.near[self.ranks[suffixes]] >= self.step


def _groups(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Whole (key, core, shard) groups of sorted rows, together of some ``limit`` rows."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < limit:
            continue
        whole = pa.Table.from_batches(held)
        names = [whole.column(i).to_numpy() for i in range(3)]
        differs = np.flatnonzero(np.any([x != x[-1] for x in names], axis=0))
        if len(differs):
            end = int(differs[-1]) + 1
            yield whole.slice(0, end)
            held = whole.slice(end).combine_chunks().to_batches()
            rows = whole.num_rows - end
    if rows:
        yield pa.Table.from_batches(held)


_FOUND = "h long, d long, s long, e long, w1 long, w2 long, shard int"


def _search(step: int, limit: int):
    """Suffix arrays of the shards: repeated windows, and the distinct others of shards that share their core.

    A row with shard 0 is a run of a piece's windows found repeated. Other rows are a distinct window of a split
    core, by its hash, for the merge; their piece is null where the window needs no verdict.
    """

    names = ["h", "d", "s", "e", "w1", "w2", "shard"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, limit):
            key, core, part = (rows.column(i).to_numpy() for i in range(3))
            h, d, low, first = (rows.column(n).to_numpy() for n in ("h", "d", "low", "first"))
            need = rows.column("need").to_numpy()
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (core[1:] != core[:-1]) | (part[1:] != part[:-1])))
            lefts, rights = rows.column("left").to_pylist(), rows.column("right").to_pylist()
            shard = Shard(np.cumsum(new) - 1, lefts, rights, step)
            block, suffix = shard.windows(low)
            again = shard.repeated(suffix)
            start = first[block] - (shard.left[block] - (suffix - shard.starts[block]))
            mine = np.flatnonzero(again & need[block])
            if len(mine):
                head = np.concatenate(([True], (np.diff(mine) > 1) | (np.diff(block[mine]) > 0)))
                heads, tails = mine[head], mine[np.append(head[1:], True)]
                none = np.zeros(len(heads), np.int64)
                columns = [h[block[heads]], d[block[heads]], start[heads], start[tails] + 1, none, none, none.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)
            split = np.flatnonzero(part[block] > 0)
            if not len(split):
                continue
            # one of each group of equal windows, in sorted order
            split = split[np.argsort(shard.ranks[suffix[split]])]
            ranks = shard.ranks[suffix[split]]
            between = np.minimum.reduceat(shard.common[: ranks[-1] + 1], ranks[:-1] + 1) if len(ranks) > 1 else ranks[:0]
            chosen = split[np.concatenate(([True], between < step))]
            digests = []
            for b, s in zip(block[chosen].tolist(), suffix[chosen].tolist()):
                skip = s - int(shard.starts[b])
                own = len(lefts[b]) - skip
                name = f"{key[b]},{core[b]},{own},".encode()
                digests.append(xxhash.xxh3_128_digest(name + lefts[b][skip:] + rights[b][: step - 1 - own]))
            hashes = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            wants = need[block[chosen]] & ~again[chosen]
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array(x[block[chosen]], mask=~wants) for x in (h, d)), pa.array(start[chosen]), pa.array(start[chosen] + 1),
                    pa.array(hashes[:, 0].copy()), pa.array(hashes[:, 1].copy()), pa.array(part[block[chosen]].astype(np.int32)),
                ],
                names=names,
            )

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of one shard that another shard holds, by binary search in the merged run of their hashes."""

    def emit(rows: pa.Table) -> pa.RecordBatch:
        keys = np.rec.fromarrays([rows.column("w1").to_numpy(), rows.column("w2").to_numpy()])
        merged = np.sort(keys)  # a shard holds a window once, so a second copy is another shard's
        hit = pa.array(np.searchsorted(merged, keys, "right") - np.searchsorted(merged, keys, "left") > 1)
        columns = [rows.column(n).combine_chunks().filter(hit) for n in ("h", "d", "s", "e")]
        return pa.RecordBatch.from_arrays(columns, names=["h", "d", "s", "e"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            whole = pa.Table.from_batches(held).combine_chunks()
            w1 = whole.column("w1").to_numpy()
            end = int(np.searchsorted(w1, w1[-1]))  # rows come sorted by w1
            if end:
                yield emit(whole.slice(0, end).combine_chunks())
                held = whole.slice(end).combine_chunks().to_batches()
    if held:
        yield emit(pa.Table.from_batches(held).combine_chunks())


def _finish(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        kinds = [*[pa.int64()] * 3, pa.string()]
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1), batch.column(2)):
                raw, (starts, ends) = _raw(text.as_py()), ranges(spans)
                kept, removed, runs = raw, 0, 0
                if len(starts):
                    gone = covered(len(raw), starts, ends, length)
                    removed, runs = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                rows.append((len(raw), removed, runs, hashlib.sha256(kept).hexdigest()))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return run


def repeated_windows(cand: DataFrame, base: DataFrame, length: int, step: int, shard_blocks: int) -> DataFrame:
    """(h, d, s, e): runs of windows of each distinct piece that suffix arrays or their merge show to stand twice."""
    place = F.struct("doc", "t", "start", "n", "place")
    distinct = materialize(
        cand.groupBy("h", "d").agg(F.count("*").alias("c"), F.min(place).alias("one"), F.max(place).alias("two")), "suffix-distinct"
    )

    def wanted(one: str, need: bool) -> DataFrame:
        w = F.struct(F.col(f"{one}.start").alias("at"), f"{one}.n", f"{one}.place", "h", "d", F.lit(need).alias("need"))
        return distinct.filter("true" if need else "c > 1").select(f"{one}.doc", f"{one}.t", w.alias("w"))

    lists = wanted("one", True).union(wanted("two", False)).groupBy("doc", "t").agg(F.collect_list("w").alias("wanted"))
    texts = with_lists(base, lists, "inner").select("doc", "t", "text", "wanted")
    listed = materialize(texts.mapInArrow(_blocks(length, step), _BLOCKS), "suffix-blocks")
    release(base.sparkSession, distinct)
    cores = materialize(listed.groupBy("key", "core").count().filter("count > 1"), "suffix-cores")
    shards = F.ceil(F.col("count") / F.lit(shard_blocks)).cast("int")
    part = F.when(shards > 1, 1 + F.pmod(F.xxhash64("h", "d", "first"), shards).cast("int")).otherwise(F.lit(0))
    rows = listed.join(cores, ["key", "core"]).select("key", "core", part.alias("part"), "h", "d", "low", "first", "left", "right", "need")
    found = materialize(
        rows.repartition("key", "core", "part").sortWithinPartitions("key", "core", "part").mapInArrow(_search(step, 1 << 12), _FOUND),
        "suffix-found",
    )
    release(base.sparkSession, listed, cores)
    merged = (
        found.filter("shard > 0").select("h", "d", "s", "e", "w1", "w2")
        .repartition("w1").sortWithinPartitions("w1").mapInArrow(_merge, "h long, d long, s long, e long").filter("h is not null")
    )
    return found.filter("shard = 0").select("h", "d", "s", "e").union(merged)


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, seed: int = SEED, step: int = STEP, shard_blocks: int = SHARD_BLOCKS
) -> DataFrame:
    """Bytes, bytes and runs removed, and the digest of the kept bytes of each document."""
    spark, base = docs.sparkSession, keyed(docs)
    all_pieces = materialize(pieces(base, length, seed), "suffix-pieces")
    shared = materialize(all_pieces.groupBy("h").count().filter("count > 1").select("h"), "suffix-shared")
    cand = materialize(all_pieces.join(shared, "h", "left_semi"), "suffix-candidates")
    release(spark, all_pieces, shared)
    # a piece has length - seed + 1 windows at most, so its list is short
    found = repeated_windows(cand.select("doc", "t", "start", "n", "place", "h", "d"), base, length, step, shard_blocks)
    per_piece = materialize(found.groupBy("h", "d").agg(F.collect_list(F.struct("s", "e")).alias("r")), "suffix-ranges")
    moved = F.transform("r", lambda x: F.struct((x["s"] + F.col("start")).alias("s"), (x["e"] + F.col("start")).alias("e")))
    spans = cand.select("doc", "t", "start", "h", "d").join(per_piece, ["h", "d"]).select("doc", "t", moved.alias("r"))
    lists = spans.groupBy("doc", "t").agg(F.flatten(F.collect_list("r")).cast(RANGES).alias("spans"))
    last = with_lists(base, lists).select("doc_id", "text", "spans")
    return last.mapInArrow(_finish(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


#: Every byte and window one by one: names of 1, 2, 4, ... bytes double, and 400 = 256 + 128 + 16.
ORACLE = r"""WITH g AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS bs FROM documents),
per AS (SELECT doc_id, unnest(range(1, len(bs) + 1)) AS p, unnest(bs) AS b FROM g),
w2 AS (SELECT doc_id, p, b || lead(b, 1) OVER w AS x FROM per WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
w4 AS (SELECT doc_id, p, x || lead(x, 2) OVER w AS x FROM w2 WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
w8 AS (SELECT doc_id, p, x || lead(x, 4) OVER w AS x FROM w4 WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
w16 AS (SELECT doc_id, p, x || lead(x, 8) OVER w AS x FROM w8 WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
w32 AS (SELECT doc_id, p, lead(x, 384) OVER w AS x16, md5(x || lead(x, 16) OVER w) AS x FROM w16 WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
w64 AS (SELECT doc_id, p, x16, md5(x || lead(x, 32) OVER w) AS x FROM w32 WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
w128 AS (SELECT doc_id, p, x16, md5(x || lead(x, 64) OVER w) AS x FROM w64 WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
k AS (SELECT doc_id, p AS i, md5(x || lead(x, 128) OVER w || lead(x, 256) OVER w || x16) AS win FROM w128 WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
f AS (SELECT win FROM k WHERE win IS NOT NULL GROUP BY win HAVING count(*) > 1),
hit AS (SELECT doc_id, i, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -400) AS step FROM k SEMI JOIN f USING (win)),
gone AS (SELECT doc_id, unnest(range(i + 400 - least(step, 400), i + 400)) AS p FROM hit),
marked AS (SELECT per.doc_id, per.p, b, gone.p IS NOT NULL AS out FROM per LEFT JOIN gone ON per.doc_id = gone.doc_id AND per.p = gone.p),
kept AS (SELECT doc_id, count(*) FILTER (out) AS n_removed, count(*) FILTER (out AND NOT before) AS n_spans, string_agg(b, '' ORDER BY p) FILTER (NOT out) AS rest
  FROM (SELECT *, coalesce(lag(out) OVER (PARTITION BY doc_id ORDER BY p), false) AS before FROM marked) GROUP BY 1)
SELECT doc_id, len(bs)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(rest, ''))) AS kept_sha256
FROM g LEFT JOIN kept USING (doc_id)"""
