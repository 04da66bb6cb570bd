"""Repeated word passages through a compacted De Bruijn graph.

Windows of ``length`` words are the graph's k-mers and its edges; the nodes lie between consecutive ones. An edge
is named by its source coordinate, the first place (smallest document) where its words stand. Edges that only ever
stand in one document hold no repeat and leave at once: their minimizers are not shared.

Compaction has two levels. Within a document, consecutive k-mers under one minimizer are one run, keyed by two
hashes of all their words, so equal runs of any documents meet at once. Runs that share a minimizer and differ are
opened into their k-mers, whose own first places cut them anew into runs with continuous source coordinates. Across
documents, a run points to its predecessor where no occurrence of either enters, leaves, begins or ends between
them, and joins double the pointers until every run knows the head of its unbranched path. A path has one source
coordinate and one length, and both decide what goes: an occurrence of the path's head in a later document removes
the whole path there. Source coordinates then verify each such span: the words at the source place and the words
removed must have equal digests, else the span is not removed.

Hot passages need no special care: equal runs collapse in a pre-aggregated group-by, and no pairs are made.

Defined cases: a null, empty or white-space text has no words and nothing removed, and its kept text is empty.
A text shorter than a window stays whole. Rows that repeat an id stand in one document's place: they are not
compared with each other, whether their texts are equal or not. No id is smaller than a missing one, nor a missing
one smaller than any, so a row without an id stays whole. Of equal passages those of the smallest id stay. An empty
table gives an empty result; other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from scholium.llm.common import materialize, release, table
from scholium.llm.windows import BLOCK, Prefixes, blocks, covered, cut, keyed, structs, with_lists

WORDS, SEED = 50, 12


class _Hashes(dict):
    """Hashes of words seen, bounded."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < 500_000:
            self[word] = value
        return value


_HASHES = _Hashes()


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _values(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def pieces(base: DataFrame, length: int = WORDS, seed: int = SEED) -> DataFrame:
    """Runs of k-mers of every ``keyed`` row with an id: where they start, their k-mers, and hashes of the minimizer and of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "t", "start", "n", "h", "d"]
        for batch in batches:
            ids, hashes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            texts = batch.column(2)
            for at in range(0, batch.num_rows, 1000):
                words = [split(t.as_py()) for t in texts.slice(at, 1000)]
                for block in blocks([len(w) for w in words], length):
                    values = np.concatenate([_values(words[d][a:b]) for d, a, b in block])
                    p = cut(values, block, length, seed)
                    columns = map(_signed, (p.start, p.windows, p.anchor, p.digest))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at + p.owner]), pa.array(hashes[at + p.owner]), *columns], names=names)

    rows = base.filter("doc_id is not null").select("doc", "t", "text")
    return rows.mapInArrow(run, "doc long, t long, start long, n long, h long, d long")


_KMERS = "w1 long, w2 long, h long, d long, off long, doc long, t long, pos long, last long"


def _kmers(length: int):
    """The k-mers of each wanted run, at its source. Rows that repeat both id and text are read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _KMERS.split(", ")]
        seen: set[tuple[int, int]] = set()

        def emit(parts: list[tuple[int, int, int, list[bytes], np.ndarray]], runs: dict[str, np.ndarray]) -> pa.RecordBatch:
            """All k-mers of parts (id, hash, first word, words, runs) of documents, side by side."""
            sizes = np.array([len(words) for *_, words, _ in parts])
            values = _values(list(chain.from_iterable(words for *_, words, _ in parts)))
            chosen = np.concatenate([mine for *_, mine in parts])
            part = np.repeat(np.arange(len(parts)), [len(mine) for *_, mine in parts])
            counts = runs["n"][chosen]
            own, part = np.repeat(chosen, counts), np.repeat(part, counts)
            off = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
            pos = runs["at"][own] + off
            flat = pos + (np.cumsum(sizes) - sizes - np.array([lo for _, _, lo, _, _ in parts]))[part]
            hashes = [_signed(Prefixes(values, k).runs(length)[flat]) for k in (0, 1)]
            places = [pa.array(np.array([p[x] for p in parts], np.int64)[part]) for x in (0, 1)]
            named = [pa.array(runs[x][own]) for x in ("h", "d")]
            return pa.RecordBatch.from_arrays([*hashes, *named, pa.array(off), *places, pa.array(pos), pa.array(runs["last"][own])], names=names)

        for batch in batches:
            fields = ("at", "n", "h", "d", "last")
            ends, columns = structs(batch.column(3), fields)
            runs, parts, size = dict(zip(fields, columns)), [], 0
            for row, (doc, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if (doc, t) in seen:
                    continue
                seen.add((doc, t))
                words = split(batch.column(2)[row].as_py())
                at = runs["at"][ends[row] : ends[row + 1]]
                for lo in range(0, len(words), BLOCK):  # a longer document runs over several parts
                    mine = ends[row] + np.flatnonzero((at >= lo) & (at < lo + BLOCK))
                    if len(mine):
                        parts.append((doc, t, lo, words[lo : lo + BLOCK + 2 * length], mine))
                        size += len(parts[-1][3])
                    if size >= BLOCK:
                        yield emit(parts, runs)
                        parts, size = [], 0
            if parts:
                yield emit(parts, runs)

    return run


def repeated_runs(cand: DataFrame, base: DataFrame, length: int) -> DataFrame:
    """(h, d, off, n, src, st, at): runs of repeated k-mers of each distinct run, with continuous source coordinates."""
    spark = base.sparkSession
    distinct = cand.groupBy("h", "d").agg(F.min(F.struct("doc", "t", "start")).alias("source"), F.max("doc").alias("last"), F.first("n").alias("n"))
    edges = materialize(
        distinct.select("h", "d", "n", "last", F.col("source.doc").alias("src"), F.col("source.t").alias("st"), F.col("source.start").alias("at")),
        "debruijn-edges",
    )
    several = materialize(edges.groupBy("h").count().filter("count > 1").select("h"), "debruijn-several")
    single = edges.join(several, "h", "left_anti").filter("last > src").select("h", "d", F.lit(0).cast("long").alias("off"), "n", "src", "st", "at")
    lists = (
        edges.join(several, "h", "left_semi")
        .groupBy(F.col("src").alias("doc"), F.col("st").alias("t")).agg(F.collect_list(F.struct("at", "n", "h", "d", "last")).alias("wanted"))
    )
    texts = with_lists(base, lists, "inner").select("doc", "t", "text", "wanted")
    kmers = materialize(texts.mapInArrow(_kmers(length), _KMERS), "debruijn-kmers")
    firsts = (
        kmers.groupBy("w1", "w2").agg(F.min(F.struct("doc", "t", "pos")).alias("source"), F.max("last").alias("last"))
        .filter("last > source.doc").select("w1", "w2", "source")
    )
    placed = kmers.join(materialize(firsts, "debruijn-firsts"), ["w1", "w2"]).select("h", "d", "off", "source.*")
    # k-mers in a row whose sources are in a row: a run has length - seed + 1 k-mers at most
    shift = F.col("pos") - F.col("off")
    order = Window.partitionBy("h", "d", "doc", "t", shift).orderBy("off")
    opened = placed.withColumn("island", F.col("off") - F.row_number().over(order)).groupBy("h", "d", "doc", "t", shift.alias("shift"), "island").agg(
        F.min("off").alias("off"), F.count("*").alias("n")
    )
    opened = opened.select("h", "d", "off", "n", F.col("doc").alias("src"), F.col("t").alias("st"), (F.col("shift") + F.col("off")).alias("at"))
    runs = materialize(single.union(opened), "debruijn-runs")
    release(spark, edges, several, kmers)
    return runs


_RUN = ["src", "st", "at", "n"]


def compact(occurrences: DataFrame) -> DataFrame:
    """(src, st, head, total): paths of runs in source coordinates, and (head, n) of the run that begins each.

    ``occurrences`` is (doc, t, start, src, st, at, n). Of two runs the second continues the first where its source
    coordinates do; they are one path if every occurrence of either stands beside one of the other.
    """
    order = Window.partitionBy("doc", "t").orderBy("start", "src", "st", "at", "n")

    def beside(name: str, step) -> F.Column:
        return step(name).over(order)

    def joined(step, after: bool):
        first_end = F.col("start") + F.col("n") if after else beside("start", step) + beside("n", step)
        second_start = beside("start", step) if after else F.col("start")
        first_at = F.col("at") + F.col("n") if after else beside("at", step) + beside("n", step)
        second_at = beside("at", step) if after else F.col("at")
        same = (beside("src", step) == F.col("src")) & (beside("st", step) == F.col("st"))
        return F.when(same & (first_end == second_start) & (first_at == second_at), beside("n", step))

    seen = occurrences.select("*", joined(F.lead, True).alias("next"), joined(F.lag, False).alias("prev"))
    ends = seen.groupBy(*_RUN).agg(
        F.count("*").alias("c"), *(f(x).alias(f"{x}_{f.__name__}") for x in ("next", "prev") for f in (F.count, F.min, F.max))
    )

    def settled(x: str) -> F.Column:
        always = (F.col(f"{x}_count") == F.col("c")) & (F.col(f"{x}_min") == F.col(f"{x}_max"))
        return F.when(always, F.col(f"{x}_min")).alias(x)

    ends = materialize(ends.select(*_RUN, settled("next"), settled("prev")), "debruijn-ends")
    before = ends.filter("next is not null").select(
        "src", "st", F.col("at").alias("head"), F.col("n").alias("head_n"), (F.col("at") + F.col("n")).alias("at"), F.col("next").alias("n")
    )
    links = ends.filter("prev is not null").select(*_RUN, "prev").join(before, _RUN).filter("head_n = prev").select(*_RUN, "head", "head_n")
    heads = materialize(
        ends.join(links, _RUN, "left").select(*_RUN, F.coalesce("head", "at").alias("head"), F.coalesce("head_n", "n").alias("head_n")),
        "debruijn-heads",
    )
    release(ends.sparkSession, ends)
    moved = None
    while True:
        total = heads.agg(F.sum((F.col("at") - F.col("head")).cast("decimal(38, 0)"))).first()[0]
        if total == moved or not total:
            break
        moved = total
        jump = heads.select(
            "src", "st", F.col("at").alias("head"), F.col("n").alias("head_n"), F.col("head").alias("further"), F.col("head_n").alias("further_n")
        )
        further = heads.join(jump, ["src", "st", "head", "head_n"])
        now = further.select(*_RUN, F.col("further").alias("head"), F.col("further_n").alias("head_n"))
        old, heads = heads, materialize(now, "debruijn-heads")
        release(heads.sparkSession, old)
    return heads.groupBy("src", "st", "head", "head_n").agg(F.sum("n").alias("total"))


_STRETCH = "struct<s:long,n:long,src:long,st:long,at:long>"


def _finish(length: int):
    """Removal, and a digest of the words of each listed stretch: removed spans, and sources of spans elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, fields = (pa.int64(), pa.int64(), pa.string()), ("s", "n", "src", "st", "at")
        for batch in batches:
            ends, columns = structs(batch.column(4), fields)
            firsts, lasts = columns[0], columns[0] + columns[1] + length - 1  # of each stretch, in words
            doc, t = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            row_of = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            removed = (columns[2] != doc[row_of]) | (columns[3] != t[row_of])
            rows, digests = [], []
            for row, text in enumerate(batch.column(3)):
                words = kept = split(text.as_py())
                a, b = ends[row], ends[row + 1]
                if a < b:
                    joined = b" ".join(words)
                    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
                    begins = np.concatenate(([0], stops))[firsts[a:b]].tolist()
                    digests += [
                        hashlib.blake2b(joined[x:y], digest_size=16).digest() for x, y in zip(begins, (stops[lasts[a:b] - 1] - 1).tolist())
                    ]
                    gone = removed[a:b]
                    if gone.any():
                        out = covered(len(words), firsts[a:b][gone], (lasts[a:b] - length + 1)[gone], length)
                        kept = list(compress(words, (~out).tolist()))
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            checks = pa.StructArray.from_arrays([*map(pa.array, columns), pa.array(digests, pa.binary())], names=[*fields, "digest"])
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), checks)
            results = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), *results, listed],
                names=["doc", "t", "doc_id", "n_words", "n_removed", "kept_sha256", "checks"],
            )

    return run


def remove_repeats(docs: DataFrame, length: int = WORDS, seed: int = SEED) -> DataFrame:
    """Words, words removed and the digest of the kept words of each document.

    A word goes when a window over it also starts in a document of smaller id.
    """
    spark, base = docs.sparkSession, keyed(docs)
    all_pieces = materialize(pieces(base, length, seed), "debruijn-pieces")
    shared = all_pieces.groupBy("h").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a < b").select("h")
    shared = materialize(shared, "debruijn-shared")
    cand = materialize(all_pieces.join(shared, "h", "left_semi"), "debruijn-candidates")
    release(spark, all_pieces, shared)
    runs = repeated_runs(cand, base, length)
    placed = cand.select("doc", "t", "start", "h", "d").join(runs, ["h", "d"])
    occurrences = materialize(
        # rows that repeat id and text stand once
        placed.select("doc", "t", (F.col("start") + F.col("off")).alias("start"), "src", "st", "at", "n").repartition("doc", "t").distinct(),
        "debruijn-occurrences",
    )
    release(spark, cand, runs)
    paths = materialize(compact(occurrences), "debruijn-paths")
    heads = paths.select("src", "st", F.col("head").alias("at"), F.col("head_n").alias("n"), "total")
    later = occurrences.filter("doc > src").join(heads, _RUN).select("doc", "t", F.struct(F.col("start").alias("s"), F.col("total").alias("n"), "src", "st", "at").alias("x"))
    sources = paths.select(F.col("src").alias("doc"), F.col("st").alias("t"), F.struct(F.col("head").alias("s"), F.col("total").alias("n"), "src", "st", F.col("head").alias("at")).alias("x"))
    stretches = materialize(later.union(sources), "debruijn-stretches")
    release(spark, occurrences, paths)

    def finished(rows: DataFrame, stretches: DataFrame) -> DataFrame:
        lists = stretches.groupBy("doc", "t").agg(F.collect_list("x").cast(f"array<{_STRETCH}>").alias("listed"))
        schema = "doc long, t long, doc_id long, n_words long, n_removed long, kept_sha256 string, checks array<struct<s:long,n:long,src:long,st:long,at:long,digest:binary>>"
        return with_lists(rows, lists).select("doc", "t", "doc_id", "text", "listed").mapInArrow(_finish(length), schema)

    passed = materialize(finished(base, stretches), "debruijn-passed")
    checks = passed.select("doc", "t", F.explode("checks").alias("x")).select("doc", "t", "x.*").distinct()
    own = (F.col("doc") == F.col("src")) & (F.col("t") == F.col("st"))
    truth = checks.filter(own).select("src", "st", "at", "n", F.col("digest").alias("said"))
    wrong = checks.filter(~own).join(truth, _RUN, "left").filter("said is null or said <> digest").select("doc", "t", "s", *_RUN)
    wrong = materialize(wrong, "debruijn-wrong")
    result = passed.select("doc_id", "n_words", "n_removed", "kept_sha256", "doc", "t")
    if not wrong.isEmpty():  # spans that their source does not confirm are not removed
        bad = wrong.select("doc", "t").distinct()
        held = stretches.select("doc", "t", "x.*").join(wrong, ["doc", "t", "s", *_RUN], "left_anti").select("doc", "t", F.struct("s", "n", "src", "st", "at").alias("x"))
        again = finished(base.join(bad, ["doc", "t"], "left_semi"), held).select(*result.columns)
        result = result.join(bad, ["doc", "t"], "left_anti").select(*result.columns).union(again)
    return result.select("doc_id", "n_words", "n_removed", "kept_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


#: Every word and window one by one.
ORACLE = r"""WITH g AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 48, 1))) AS i FROM g)),
f AS (SELECT win, min(doc_id) AS first FROM k GROUP BY win),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM k JOIN f USING (win) WHERE first < doc_id),
per AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM g),
kept AS (SELECT per.doc_id, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY per.p) FILTER (gone.p IS NULL) AS rest
  FROM per LEFT JOIN gone ON per.doc_id = gone.doc_id AND per.p = gone.p GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM g LEFT JOIN kept USING (doc_id)"""
