"""SimHash near-duplicates found by pigeonring filtering.

A fingerprint's 64 bits are eight 8-bit segments on a ring. If two fingerprints differ in at most three bits,
then some segment starts a chain whose running total of differences stays within the proportional budget
floor(3 * l / 8) for every length l: 0, 0, 1, 1, 1, 2, 2, 3. The first two segments of that chain are equal and
at most one of the next three differs, so a pair meets under one of 8 x 3 keys of four equal segments (32 bits).
Within a key the chain budgets are tested before the full Hamming distance.

Rows with equal fingerprints collapse to one class first, so a hot group of copies is one row. The fingerprint is
the class's name in links and components; the ids of a component are looked up at the end. A key's bucket gives links that connect it rather than all its pairs: each fingerprint is compared with those not yet reached.
Buckets over ``bucket_limit`` are split again: the bits not yet known to be equal are cut in four groups, of which
three differing bits leave one equal. Each level is a table of its own and keeps a quarter fewer open bits, so it
ends at four open bits and 16 members at most.

Defined cases: a null, empty or white-space text has fingerprint zero and is linked like any other. Every row has
a fingerprint of its own, also where rows repeat an id. A row without an id links like any other, and the smallest
id reachable names its component; where there is none, the component's name is null. An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.llm.common import materialize, table
from scholium.llm.components import components
from scholium.llm.windows import keyed, mix

SEGMENTS, BITS, RADIUS, SHINGLE, SEED = 8, 8, 3, 3, 42
BUDGETS = np.array([RADIUS * n // SEGMENTS for n in range(1, SEGMENTS + 1)], dtype=np.uint8)
#: (first segment, skipped segment): the chain's first two segments and two of its next three.
KEYS = [(i, s) for i in range(SEGMENTS) for s in (2, 3, 4)]
#: Open bits of a bucket by level: 32, 24, 18, 13, 9, 6, 4.
LEVELS = 6
#: Members of a bucket that one task compares; larger buckets are split.
BUCKET = 1 << 12
#: Classes with more than this part of all rows are joined apart.
HOT = 200
_POPCOUNT = np.array([bin(x).count("1") for x in range(256)], dtype=np.uint8)


def fingerprint(text: str | None) -> int:
    """SimHash over 3-word shingles of the text with A-Z lower-cased, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - SHINGLE + 1].tolist()
    digest = xxhash.xxh64_intdigest
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], dtype=np.uint64)
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        block = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py()) for t in batch.column(2)], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints)], names=["doc_id", "t", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, t, fp): the 64 bits in a signed long; ``t`` is a hash of id and text, which tells rows of one id apart."""
    return keyed(docs).select("doc_id", "t", "text").mapInArrow(_fingerprints, "doc_id long, t long, fp long")


def _segment(i: int):
    return F.shiftrightunsigned("fp", BITS * (i % SEGMENTS)).bitwiseAND(F.lit(255))


def _keys(classes: DataFrame) -> DataFrame:
    keys = []
    for n, (i, skip) in enumerate(KEYS):
        held = [i, i + 1, *(i + s for s in (2, 3, 4) if s != skip)]
        key = F.lit(n).cast("long")
        mask = 0
        for s in held:
            key = F.shiftleft(key, BITS).bitwiseOR(_segment(s))
            mask |= 255 << (BITS * (s % SEGMENTS))
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(key.alias("key"), F.lit(signed).cast("long").alias("held")))
    return classes.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.key", "k.held", "fp")


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row under four finer keys, one for each group of its open bits; ``held`` marks the equal bits."""
    for batch in batches:
        key, held, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        fp = fp.view(np.uint64)
        for mask in np.unique(held):
            rows = held == mask
            open_bits = [b for b in range(64) if not (int(mask) >> b) & 1]
            for n, group in enumerate(np.array_split(open_bits, RADIUS + 1)):
                part = sum(1 << int(b) for b in group)
                new = mix(key[rows].view(np.uint64) ^ mix((fp[rows] & np.uint64(part)) + np.uint64(n + 1)))
                more = np.full(len(new), mask, np.int64) | np.array([part], np.uint64).view(np.int64)
                columns = [new.view(np.int64), more, fp[rows].view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "held", "fp"])


def _near(one: np.uint64, rest: np.ndarray) -> np.ndarray:
    """Which of ``rest`` pass the pigeonring chains and lie within the radius of ``one``."""
    each = _POPCOUNT[(rest ^ one).view(np.uint8).reshape(-1, 8)]
    ring = np.concatenate([each, each], axis=1)
    passed = np.zeros(len(rest), bool)
    for i in range(SEGMENTS):
        passed |= (np.cumsum(ring[:, i : i + SEGMENTS], axis=1, dtype=np.uint8) <= BUDGETS).all(axis=1)
    passed[passed] = each[passed].sum(axis=1) <= RADIUS
    return passed


def _pair_near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    each = _POPCOUNT[(a ^ b).view(np.uint8).reshape(-1, 8)]
    ring = np.concatenate([each, each], axis=1)
    passed = np.zeros(len(a), bool)
    for i in range(SEGMENTS):
        passed |= (np.cumsum(ring[:, i : i + SEGMENTS], axis=1, dtype=np.uint8) <= BUDGETS).all(axis=1)
    return passed & (each.sum(axis=1) <= RADIUS)


def bucket_links(fps: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that connect exactly what the pairs within the radius connect: a search over unreached members."""
    names = fps.view(np.int64)
    us: list[int] = []
    vs: list[int] = []
    left = np.arange(len(fps))
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            found = _near(fps[at], fps[left])
            reached, left = left[found], left[~found]
            us += [int(names[at])] * len(reached)
            vs += names[reached].tolist()
            frontier += reached.tolist()
    return us, vs


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each key; rows come sorted by key, and a key may run over several batches."""
    held: list[np.ndarray] = []

    def emit(rows: np.ndarray) -> pa.RecordBatch:
        keys, fps = rows[0], rows[1].view(np.uint64)
        cuts = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
        sizes = ends - starts
        two = starts[sizes == 2]
        near = _pair_near(fps[two], fps[two + 1])
        us, vs = rows[1][two[near]].tolist(), rows[1][two[near] + 1].tolist()
        for a, b in zip(starts[sizes > 2], ends[sizes > 2]):
            more = bucket_links(fps[a:b])
            us += more[0]
            vs += more[1]
        return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.array([batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)])
        last = int(np.searchsorted(rows[0], rows[0, -1]))  # the last key may go on in the next batch
        if last:
            yield emit(np.concatenate([*held, rows[:, :last]], axis=1))
            held = []
        held.append(rows[:, last:])
    if held:
        yield emit(np.concatenate(held, axis=1))


def links(classes: DataFrame, bucket_limit: int = BUCKET) -> DataFrame:
    """(u, v) between fingerprints that connect the classes ``(fp)`` within the radius."""
    keyed = _keys(classes)
    parts = []
    for _ in range(LEVELS):
        sizes = materialize(
            keyed.groupBy("key").count().filter(F.col("count") > bucket_limit).select("key"), "simhash-hot"
        )
        if sizes.isEmpty():
            break
        parts.append(keyed.join(sizes, "key", "left_anti"))
        hot = keyed.join(sizes, "key", "left_semi").select("key", "held", "fp")
        keyed = materialize(hot.mapInArrow(_split, "key long, held long, fp long"), "simhash-split")
    parts.append(keyed)
    found = None
    for part in parts:
        sorted_part = part.select("key", "fp").repartition("key").sortWithinPartitions("key")
        one = sorted_part.mapInArrow(_links, "u long, v long")
        found = one if found is None else found.union(one)
    return found.distinct()


def near_duplicates(docs: DataFrame, bucket_limit: int = BUCKET) -> DataFrame:
    """One row per document: fingerprint, the component it belongs to, and its class's smallest id."""
    prints = materialize(fingerprints(docs), "simhash-fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")), "simhash-classes")
    found = components(links(classes, bucket_limit))
    linked = classes.join(found, classes["fp"] == found["node"]).select("component", "fp", "rep")
    named = linked.join(linked.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("fp", "component_id")
    labelled = classes.join(named.withColumn("linked", F.lit(True)), "fp", "left").select(
        "fp", "rows", "rep", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("rep")).alias("component_id")
    )
    labelled = materialize(labelled, "simhash-labelled")
    # a class with more than 1 / HOT of all rows would land in one task; there are fewer than HOT of them
    total = classes.agg(F.sum("rows")).first()[0] or 0
    hot = F.broadcast(labelled.filter(F.col("rows") * HOT > total))
    cold = prints.join(hot.select("fp"), "fp", "left_anti").join(labelled, "fp")
    return cold.unionByName(prints.join(hot, "fp")).select(
        "doc_id", "t", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "rep"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that name their component: one of each group of near-duplicates, columns unchanged.

    Rows that repeat an id and a text are one document and stay or go together; rows of one id with other texts are
    told apart. Rows without an id stay.
    """
    dropped = near_duplicates(docs).filter("doc_id <> component_id").select("doc_id", "t").distinct()
    text = F.coalesce(docs["text"], F.lit(""))
    here = (docs["doc_id"] == dropped["doc_id"]) & (F.xxhash64(docs["doc_id"], text) == dropped["t"])
    return docs.join(dropped, here, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
