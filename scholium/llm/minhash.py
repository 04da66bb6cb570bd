"""MinHash near-duplicates through an inverted join of signature coordinates.

A text is its set of distinct 2-word shingles, and texts of 80 % common shingles are linked. Texts of one set are one class.
A class's signature has 64 coordinates, and two classes collide in a coordinate with the probability of their
similarity, so at 0.8 they have 32 collisions or more but for 2 in 10^8 pairs. That is the match threshold.

Classes are posted under each coordinate-value pair. A pair that only one class has is no posting, and classes with fewer
than 32 shared ones have no partner. Prefix: with the coordinates ordered from the rarest, two classes of 32 collisions
meet under one of the first 33 of 64, so only those are posted, fewer by the ones that nobody shares. Merging: a list
of few members counts the collisions of all its pairs; a longer one at first only those with one member, the one whose
coordinates are the most shared. Skip: what is confirmed connects members, and long lists whose members are connected are
skipped. In those that still hold several components, members without enough shared coordinates in the list go, and
collisions are counted between members of different components, in order of size; what reaches the threshold is confirmed
there, so that a link merges two components at once and no more links than members come out. Lists over ``LIST``
members are cut in blocks, and pairs of blocks are tasks, so no list lands in one task. Every pair above the threshold is
confirmed on the full sets before it links; sets are formed only for classes of such pairs and of such long lists.

Defined cases: a null text, or one without words, has no shingles, is linked with nothing and keeps its own id; with one
word, the word is the set. Shingles are compared by 64-bit hashes, sets by 128 bits of theirs. Every row has a line, also
where rows repeat an id. A row without an id links like any other, and the smallest id reachable names its
component; where there is none, the component is null. Very long texts count whole, a few thousand shingles at a time.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.llm.common import materialize, release, table
from scholium.llm.components import components
from scholium.llm.windows import keyed, mix

SHINGLE, COORDINATES, MATCHES, PERCENT = 2, 64, 32, 80
#: Members of a posting list that one task compares; longer lists are cut in blocks.
LIST = 1 << 10
#: Members of a list that compares all its pairs at once.
SHORT = 32
#: Pairs of members compared at once within a task.
_AT_ONCE = 1 << 13
_RANDOM = np.random.default_rng(20)
_FACTORS = _RANDOM.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDENDS = _RANDOM.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_FIRST = _RANDOM.integers(0, 1 << 63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < SHINGLE:
        return hashes
    return np.unique(mix(hashes[:-1] * _FIRST + mix(hashes[1:])))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value of each coordinate's hash function over the set."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        values = hashes[at : at + 512, None] * _FACTORS
        values += _ADDENDS
        np.minimum(least, values.min(axis=0), out=least)
    return least


def short_digests(signs: np.ndarray) -> bytes:
    """16 bits of each coordinate: equal coordinates stay equal."""
    return (mix(signs) >> np.uint64(48)).astype(np.uint16).tobytes()


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests, signs, short = [], [], [], []
        for text in batch.column(3):
            found = shingles(text.as_py())
            sign = signature(found) if len(found) else None
            sizes.append(len(found))
            digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
            signs.append(None if sign is None else sign.view(np.int64))
            short.append(None if sign is None else short_digests(sign))
        made = [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signs, pa.list_(pa.int64())), pa.array(short, pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=["doc", "t", "doc_id", "n", "digest", "sig", "short"])


def signatures(docs: DataFrame) -> DataFrame:
    """(doc, t, doc_id, n, digest, sig, short) of each row; without shingles, digest and signature are null."""
    return keyed(docs).mapInArrow(_signed, "doc long, t long, doc_id long, n long, digest binary, sig array<long>, short binary")


def _shared(tokens: DataFrame, matches: int) -> DataFrame:
    """(c, held): of classes with enough coordinate values that others have too, those values, rarest first."""
    often = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    held = tokens.join(often, "token").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("held"))
    return held.filter(F.size("held") >= matches)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingles(t.as_py()).view(np.int64) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["c", "hashes"])


def _sets_of(wanted: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(c, hashes) of the classes ``wanted(c)``, as a table; each set is formed from one text of its class."""
    own = wanted.distinct().join(classes, "c").select("c", F.col("place.doc").alias("doc"), F.col("place.t").alias("t"))
    texts = keyed(docs).join(own.hint("shuffle_hash"), ["doc", "t"]).select("c", "text").dropDuplicates(["c"])
    return materialize(texts.mapInArrow(_sets, "c long, hashes array<long>"), "minhash-sets")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose full sets are similar enough, as a table."""
    sets = _sets_of(pairs.select(F.explode(F.array("u", "v")).alias("c")), classes, docs)
    full = [sets.select(F.col("c").alias(s), F.col("hashes").alias(f"h_{s}")) for s in "uv"]
    both = pairs.join(full[0], "u").join(full[1], "v").withColumn("common", F.size(F.array_intersect("h_u", "h_v")))
    union = F.size("h_u") + F.size("h_v") - F.col("common")
    links = materialize(both.filter(100 * F.col("common") >= percent * union).select("u", "v"), "minhash-links")
    release(pairs.sparkSession, sets)
    return links


def _enough(signs: np.ndarray, matches: int) -> np.ndarray:
    """Members with ``matches`` coordinates that another member has too."""
    order = np.argsort(signs, axis=0, kind="stable")
    in_order = np.take_along_axis(signs, order, axis=0)
    same = np.zeros(signs.shape, bool)
    equal = in_order[1:] == in_order[:-1]
    same[1:] |= equal
    same[:-1] |= equal
    back = np.empty_like(same)
    np.put_along_axis(back, order, same, axis=0)
    return back.sum(axis=1) >= matches


def _near(i: int, ends: np.ndarray, component: np.ndarray, signs: np.ndarray, matches: int) -> np.ndarray:
    """Later members, in order of size, of another component than member ``i`` and with enough collisions."""
    rest = np.flatnonzero(component[i + 1 : ends[i]] != component[i]) + i + 1
    parts = [rest[at : at + _AT_ONCE] for at in range(0, len(rest), _AT_ONCE)]
    return np.concatenate([p[(signs[p] == signs[i]).sum(axis=1) >= matches] for p in parts]) if parts else rest


def list_pairs(names: np.ndarray, sizes: np.ndarray, signs: np.ndarray, matches: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a short list's members with enough collisions and sizes that allow the similarity."""
    order = np.argsort(sizes, kind="stable")
    names, sizes, signs = names[order], sizes[order], signs[order]
    ends, apart = np.searchsorted(sizes, 100 * sizes // percent, side="right"), np.arange(len(names))
    right = [_near(i, ends, apart, signs, matches) for i in range(len(names))]
    u, v = names[np.repeat(apart, [len(r) for r in right])], names[np.concatenate(right)]
    return np.minimum(u, v), np.maximum(u, v)


def list_links(
    names: np.ndarray, component: np.ndarray, sizes: np.ndarray, signs: np.ndarray, sets: list[np.ndarray], matches: int, percent: int
) -> tuple[np.ndarray, np.ndarray]:
    """Links between components of a long list that connect what all its links connect."""
    kept = np.arange(len(names))
    while len(kept):
        enough = _enough(signs[kept], matches)
        if enough.all():
            break
        kept = kept[enough]
    kept = kept[np.argsort(sizes[kept], kind="stable")]
    names, component, sizes, signs, sets = names[kept], component[kept].copy(), sizes[kept], signs[kept], [sets[i] for i in kept]
    ends = np.searchsorted(sizes, 100 * sizes // percent, side="right")
    # where each shingle stands: members in the order of the shingles
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    us, vs = [], []
    for i in range(len(names)):
        near = _near(i, ends, component, signs, matches)
        if not len(near):
            continue
        if len(near) < 16:
            common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in near])
        else:  # merge the lists of the member's shingles
            a, b = np.searchsorted(flat, sets[i], side="left"), np.searchsorted(flat, sets[i], side="right")
            steps = np.arange((b - a).sum()) - np.repeat(np.cumsum(b - a) - (b - a), b - a)
            common = np.bincount(owner[np.repeat(a, b - a) + steps], minlength=len(names))[near]
        linked = near[100 * common >= percent * (sizes[i] + sizes[near] - common)]
        for j in linked:
            if component[j] != component[i]:
                us.append(names[i])
                vs.append(names[j])
                component[component == component[j]] = component[i]
    u, v = np.array(us, np.int64), np.array(vs, np.int64)
    return np.minimum(u, v), np.maximum(u, v)


def star_pairs(names: np.ndarray, score: np.ndarray, sizes: np.ndarray, signs: np.ndarray, matches: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a list's members with the one of the highest score."""
    top = int(np.lexsort((-names, score))[-1])
    near = (signs == signs[top]).sum(axis=1) >= matches
    near &= 100 * np.minimum(sizes, sizes[top]) >= percent * np.maximum(sizes, sizes[top])
    near[top] = False
    return np.minimum(names[near], names[top]), np.maximum(names[near], names[top])


def _by_list(matches: int, percent: int, short: int, first: bool):
    """Pairs to confirm of each list at first, when ``group`` is the members' score; later, when it is their component,
    links."""

    def one(part: slice, names: np.ndarray, group: np.ndarray, sizes: np.ndarray, signs: np.ndarray, sets: pa.Array | None):
        own = names[part], sizes[part], signs[part]
        if not first:
            held = [sets[i].values.to_numpy().view(np.uint64) for i in range(part.start, part.stop)]
            return list_links(own[0], group[part], own[1], own[2], held, matches, percent)
        if part.stop - part.start <= short:
            return list_pairs(*own, matches, percent)
        return star_pairs(own[0], group[part], own[1], own[2], matches, percent)

    def emit(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        lists, names, group, sizes = (rows.column(i).to_numpy() for i in range(4))
        signs = np.frombuffer(b"".join(rows.column(4).to_pylist()), np.uint16).reshape(-1, COORDINATES)
        sets = None if first else rows.column(5).combine_chunks()
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(lists)) + 1, [len(lists)]))
        lengths = np.diff(cuts)
        found = [(names[:0], names[:0])]
        if first:
            a = cuts[:-1][lengths == 2]  # most lists are pairs
            near = ((signs[a] == signs[a + 1]).sum(axis=1) >= matches) & (100 * np.minimum(sizes[a], sizes[a + 1]) >= percent * np.maximum(sizes[a], sizes[a + 1]))
            found.append((np.minimum(names[a], names[a + 1])[near], np.maximum(names[a], names[a + 1])[near]))
        for i in np.flatnonzero(lengths > 1 + first):
            found.append(one(slice(int(cuts[i]), int(cuts[i + 1])), names, group, sizes, signs, sets))
        u, v = (pa.array(np.concatenate([f[i] for f in found]), pa.int64()) for i in range(2))
        return pa.RecordBatch.from_arrays([u, v], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by list, and a list may run over several batches."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(0).to_numpy()
            last = int(np.searchsorted(lists, lists[-1]))
            if last or (held and held[0].column(0)[0].as_py() != lists[0]):
                yield emit(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield emit(pa.Table.from_batches(held))

    return run


def _pairs(rows: DataFrame, members: DataFrame, matches: int, percent: int, limit: int, first: bool) -> DataFrame:
    """Pairs of ``rows(token, m, c, group)``, the lists' members, with what ``members`` holds of each; lists over
    ``limit`` go in blocks.

    A cell is a list, or two blocks of one. At first each block is a cell; members of one block meet there.
    """
    blocks = F.ceil(F.col("m") / limit).cast("int")
    own = F.pmod(F.xxhash64("c", F.lit(7)), blocks).cast("int")
    other = own if first else F.explode(F.sequence(F.lit(0), blocks - 1))
    cells = rows.select("token", "c", "group", own.alias("own"), other.alias("other"))
    cell = F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other")).alias("list")
    cells = cells.select(cell, "c", "group").join(members, "c").select("list", "c", "group", *(c for c in members.columns if c != "c"))
    return cells.repartition("list").sortWithinPartitions("list").mapInArrow(_by_list(matches, percent, min(SHORT, limit), first), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, matches: int = MATCHES, percent: int = PERCENT, limit: int = LIST) -> DataFrame:
    """One row per document: size of its set, the component it belongs to, and its class's smallest id."""
    spark = docs.sparkSession
    signed = materialize(signatures(docs), "minhash-signatures")
    grouped = signed.filter("n > 0").groupBy("digest").agg(
        F.min("doc_id").alias("id"), F.min(F.struct("doc", "t")).alias("place"), F.first("n").alias("n"), F.first("sig").alias("sig"),
        F.first("short").alias("short"),
    )
    classes = materialize(grouped.withColumn("c", F.monotonically_increasing_id()), "minhash-classes")
    release(spark)
    tokens = classes.select("c", F.posexplode("sig").alias("at", "least")).select("c", F.xxhash64("at", "least").alias("token"))
    once = materialize(_shared(tokens, matches), "minhash-shared")
    release(spark)
    # what others share is counted again among those that are left
    shared = materialize(_shared(once.select("c", F.explode("held.token").alias("token")), matches), "minhash-shared")
    release(spark, once)
    prefix = F.slice("held", 1, F.size("held") - (matches - 1))
    score = F.aggregate("held", F.lit(0).cast("long"), lambda s, x: s + x["df"])
    posted = shared.select("c", score.alias("group"), F.explode(prefix).alias("h")).select("h.token", "c", "group")
    lists = posted.groupBy("token").agg(F.count("*").alias("m")).filter("m > 1")
    posted = materialize(posted.join(lists, "token"), "minhash-postings")
    members = classes.select("c", "n", "short")
    pairs = materialize(_pairs(posted, members, matches, percent, limit, True), "minhash-pairs")
    release(spark, shared)
    one = confirmed(pairs, classes, docs, percent)
    labels = materialize(components(one), "minhash-labels")
    named = posted.filter(F.col("m") > min(SHORT, limit)).join(labels, posted["c"] == labels["node"], "left")
    named = named.select("token", "m", "c", F.coalesce("component", "c").alias("group"))
    mixed = named.groupBy("token").agg(F.min("group").alias("a"), F.max("group").alias("b")).filter("a <> b")
    long = materialize(named.join(mixed.select("token"), "token"), "minhash-long")
    sets = _sets_of(long.select("c"), classes, docs)
    two = materialize(_pairs(long, members.join(sets, "c"), matches, percent, limit, False), "minhash-links")
    release(spark, posted, long, sets)
    found = materialize(components(one.union(two)), "minhash-components")
    named = classes.join(found, classes["c"] == found["node"], "left").select("digest", "id", F.coalesce("component", "c").alias("component"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    labelled = materialize(named.join(least, "component").select("digest", F.col("id").alias("rep"), "component_id"), "minhash-labelled")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return signed.select("doc_id", "n", "digest").join(labelled, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"), "rep"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
sets AS (
  SELECT rid, doc_id, list_sort(list_distinct(CASE WHEN len(ws) < 2 THEN ws
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END)) AS s FROM w),
classes AS (SELECT s, len(s) AS n, min(rid) AS c, min(doc_id) AS id FROM sets WHERE len(s) > 0 GROUP BY s),
x AS (SELECT c, n, unnest(s) AS sh FROM classes),
l AS (
  SELECT a.c AS u, b.c AS v FROM x AS a JOIN x AS b ON a.sh = b.sh AND a.c <> b.c AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT c AS a, c AS b FROM classes UNION SELECT r.a, l.v FROM r JOIN l ON l.u = r.b),
k AS (SELECT r.a AS c, min(classes.id) AS component_id FROM r JOIN classes ON classes.c = r.b GROUP BY r.a)
SELECT doc_id, len(sets.s) AS n_shingles, CASE WHEN len(sets.s) = 0 THEN doc_id ELSE component_id END AS component_id,
  doc_id IS NOT DISTINCT FROM CASE WHEN len(sets.s) = 0 THEN doc_id ELSE component_id END AS kept
FROM sets LEFT JOIN classes ON classes.s = sets.s LEFT JOIN k ON k.c = classes.c
"""
