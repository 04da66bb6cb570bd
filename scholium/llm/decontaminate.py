"""Benchmark decontamination by edit distance, through CGK embedding and bit-sampling LSH.

A document holds a benchmark item when some stretch of its words is within ``floor((1 - similarity) * n)`` word
edits of the item's n words. The CGK random walk embeds items, and item-sized windows at every place of a document
that can hold one, each in the same way, so that few edits become few differing places. Repeated samples of places
are hashed; windows and items that meet in a bucket are the candidates, and exact edit distance against the document
verifies them. With the default numbers of walks, samples and places the tests measure a recall of 0.99 and more at
the largest allowed distance.

Which places can hold an item is decided without loss and without regard to which item it is: an edit touches one
word and two word pairs at most, so a window must hold at least n - k words and n - 1 - 2k word pairs that occur in
the items at all. Items are embedded in classes of like length, so a long item widens its own class only.

The items are a stated query set: they are taken in blocks of bounded size, each sent to every task. Where there are
several blocks, each one's matches are written before the next one is read, so the driver holds one block at a time.

Defined cases: a null, empty or white-space text matches nothing, and such an item is matched by nothing. Repeated
items are each reported, and so is an item without an id, under a null; rows that repeat an id are searched row by
row. Of a document's stretches with equally few edits the first counts. An empty table on either side gives an empty
result; other columns are ignored. Texts are searched whole. A-Z count as a-z.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.llm.common import id_text, materialize, table
from scholium.llm.windows import mix

SIMILARITY, WALKS, REPEATS, SAMPLES = 0.8, 4, 24, 3
#: Longest against shortest item of a class; places of the walk per word of the shortest; symbols embedded at a time.
SPREAD, STRIDE, GRID = 1.15, 1.6, 1 << 21
BLOCK_BYTES = 16_000_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def search(item: Sequence[int], text: Sequence[int]) -> tuple[int, int]:
    """(fewest edits, end) over all stretches of ``text`` against the whole item; Myers' bit vectors.

    Of equal distances the first end counts.
    """
    n = len(item)
    full, top = (1 << n) - 1, 1 << (n - 1)
    masks: dict[int, int] = defaultdict(int)
    for i, w in enumerate(item):
        masks[w] |= 1 << i
    plus, minus, score = full, 0, n
    best, end = n, 0
    for j, w in enumerate(text):
        eq = masks.get(w, 0)
        x = eq | minus
        diagonal = (((x & plus) + plus) ^ plus) | x
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up <<= 1
        plus = ((down << 1) | (full & ~(diagonal | up))) & full
        minus = up & diagonal & full
        if score < best:
            best, end = score, j + 1
    return best, end


def embed(windows: np.ndarray, walk: int, steps: int) -> np.ndarray:
    """The first ``steps`` places of the CGK embedding of rows of symbols (0 pads).

    At step j a row puts out its current symbol and moves on if a random function of j and that symbol says so.
    """
    rows, n = windows.shape
    padded = np.concatenate([windows, np.zeros((rows, 1), windows.dtype)], axis=1)
    out = np.zeros((rows, steps), windows.dtype)
    at = np.zeros(rows, np.int64)
    every = np.arange(rows)
    for j in range(steps):
        symbol = padded[every, at]
        out[:, j] = symbol
        step = mix(symbol * _FACTOR + np.uint64(j * 1_000_003 + walk * 7_368_787 + 1)) & np.uint64(1)
        at = np.minimum(at + step.astype(np.int64), n)
    return out


class LengthClass:
    """Items of like length: what a window must hold, and the buckets of the items' samples."""

    def __init__(self, which: list[int], symbols: list[list[int]], budget: np.ndarray):
        sizes = [len(symbols[i]) for i in which]
        self.size = max(sizes)
        self.reach = max(n + int(budget[i]) for i, n in zip(which, sizes))
        self.words = min(n - int(budget[i]) for i, n in zip(which, sizes))
        self.pairs = min(n - 1 - 2 * int(budget[i]) for i, n in zip(which, sizes))
        # the walk moves on at every other step, so it stays inside the shortest item
        self.steps = max(1, int(STRIDE * min(sizes)))
        drawn = np.random.default_rng([42, self.steps]).random((WALKS, REPEATS, SAMPLES))
        self.places = (drawn * self.steps).astype(np.int64)
        grid = np.zeros((len(which), self.size), np.uint64)
        for row, i in enumerate(which):
            grid[row, : sizes[row]] = symbols[i]
        keys = self.keys(grid)
        order = np.argsort(keys, axis=None, kind="stable")
        self.buckets = keys.ravel()[order]
        self.members = np.repeat(np.array(which, np.int64), WALKS * REPEATS)[order]

    def keys(self, windows: np.ndarray) -> np.ndarray:
        """Bucket of each window in each sample."""
        out = []
        for walk in range(WALKS):
            embedded = embed(windows, walk, self.steps)
            for n, places in enumerate(self.places[walk]):
                key = np.full(len(windows), walk * REPEATS + n + 1, np.uint64)
                for place in places:
                    key = mix(key * _FACTOR + embedded[:, place])
                out.append(key)
        return np.stack(out, axis=1)

    def starts(self, symbols: np.ndarray, known: np.ndarray, hits: np.ndarray) -> np.ndarray:
        """Places whose window holds enough of the items' words (``known``, running) and word pairs (``hits``)."""
        n, need = len(symbols), self.pairs
        if need <= 0:
            places = np.arange(n)
        else:
            first, last = hits[: len(hits) - need + 1], hits[need - 1 :]
            near = last - first <= self.reach - 2
            # a window holds these pairs if it begins at the first one or before, and ends behind the last one
            low, high = np.maximum(last[near] - (self.reach - 2), 0), first[near]
            if not len(low):
                return low
            low[1:] = np.maximum(low[1:], high[:-1] + 1)
            counts = np.maximum(high - low + 1, 0)
            places = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        return places[known[np.minimum(places + self.reach, n)] - known[places] >= self.words]

    def candidates(self, symbols: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(start, item) of windows and items that share a bucket."""
        padded = np.concatenate([symbols, np.zeros(self.size, symbols.dtype)])
        rows = max(1, GRID // (self.size + self.steps))
        for at in range(0, len(starts), rows):
            own = starts[at : at + rows]
            keys = self.keys(padded[own[:, None] + np.arange(self.size)]).ravel()
            lo = np.searchsorted(self.buckets, keys)
            met = np.flatnonzero(self.buckets[np.minimum(lo, len(self.buckets) - 1)] == keys)
            lo, hi = lo[met], np.searchsorted(self.buckets, keys[met], "right")
            counts = hi - lo
            entry = np.repeat(lo - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            pairs = np.unique(np.stack([np.repeat(own[met // (WALKS * REPEATS)], counts), self.members[entry]]), axis=1)
            yield pairs[0], pairs[1]


class Items:
    """A block of items: vocabulary, word pairs, and length classes with their buckets."""

    def __init__(self, rows: Sequence[tuple[int | None, str | None]], similarity: float = SIMILARITY):
        words = [(i, split(t)) for i, t in rows]
        words = [(i, w) for i, w in words if w]
        self.ids = [i for i, _ in words]
        self.vocabulary = {w: n + 1 for n, w in enumerate(dict.fromkeys(w for _, ws in words for w in ws))}
        self.symbols = [[self.vocabulary[w] for w in ws] for _, ws in words]
        self.lengths = np.array([len(s) for s in self.symbols], np.int64)
        self.budget = np.floor((1 - similarity) * self.lengths + 1e-9).astype(np.int64)
        pairs = [self._pairs(np.array(s, np.uint64)) for s in self.symbols if len(s) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.uint64)
        self.classes: list[LengthClass] = []
        now: list[int] = []
        for i in [*np.argsort(self.lengths, kind="stable").tolist(), None]:
            if now and (i is None or self.lengths[i] > SPREAD * self.lengths[now[0]]):
                self.classes.append(LengthClass(now, self.symbols, self.budget))
                now = []
            if i is not None:
                now.append(i)

    @staticmethod
    def _pairs(symbols: np.ndarray) -> np.ndarray:
        return mix(symbols[:-1] * _FACTOR + symbols[1:])

    def candidates(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, item) of windows and items that share a bucket, in order of item and start."""
        known = np.concatenate(([0], np.cumsum(symbols > 0)))
        both = np.flatnonzero((symbols[:-1] > 0) & (symbols[1:] > 0))
        if len(self.pairs):
            pairs = mix(symbols[both] * _FACTOR + symbols[both + 1])
            place = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
            hits = both[self.pairs[place] == pairs]
        else:
            hits = both[:0]
        found = [pair for c in self.classes for pair in c.candidates(symbols, c.starts(symbols, known, hits))]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts, items = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((starts, items))
        return starts[order], items[order]


def matches(items: Items, texts: Sequence[str | None], block: int = 1_000_000) -> Iterator[tuple[int, int, int, int, int]]:
    """(index of text, index of item, start word, end word, edits) of each pair's best stretch."""
    if not items.ids:
        return
    get = items.vocabulary.get
    at = 0
    while at < len(texts):
        flat: list[int] = []
        begins: list[int] = []
        first = at
        while at < len(texts) and (len(flat) < block or at == first):
            begins.append(len(flat))
            flat += [get(w, 0) for w in split(texts[at])]
            flat.append(0)
            at += 1
        starts, which = items.candidates(np.array(flat, np.uint64))
        bounds = np.array([*begins, len(flat)])
        doc = np.searchsorted(bounds, starts, "right") - 1
        # candidates of one item that lie close together in a text are verified in one go
        apart = (np.diff(which) > 0) | (np.diff(doc) > 0) | (np.diff(starts) > items.lengths[which[1:]])
        heads = np.flatnonzero(np.concatenate(([True], apart))) if len(starts) else starts
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(starts)]):
            d, i = int(doc[a]), int(which[a])
            n, k = int(items.lengths[i]), int(items.budget[i])
            lo, hi = max(int(starts[a]) - k, begins[d]), min(int(starts[b - 1]) + n + k, int(bounds[d + 1]) - 1)
            if hi - lo < n - k:
                continue
            region = flat[lo:hi]
            edits, end = search(items.symbols[i], region)
            if edits > k:
                continue
            # the same search backwards from the end gives the start
            back = search(items.symbols[i][::-1], region[:end][::-1])[1]
            found = (edits, lo + end - back - begins[d], lo + end - begins[d])
            key = (first + d, i)
            if key not in best or found < best[key]:
                best[key] = found
        for (d, i), (edits, start, end) in sorted(best.items()):
            yield d, i, start, end, edits


def _blocks(benchmark: DataFrame, similarity: float, id_col: str) -> Iterator[tuple[Items, bool]]:
    """The query set in blocks of some ``BLOCK_BYTES``, and whether there are several."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = 1 + size // BLOCK_BYTES
    for b in range(count):
        own = rows.filter("text is not null").filter(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == b).collect()
        yield Items([(r["id"], r["text"]) for r in sorted(own, key=lambda r: (r["id"] is None, r["id"] or 0, r["text"]))], similarity), count > 1


def contamination(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, id_col: str = "item_id") -> DataFrame:
    """(doc_id, item_id, start_word, end_word, edits, similarity): each document's best stretch for each item."""
    schema = "doc_id long, item_id long, start_word long, end_word long, edits long, similarity double"

    def searched(items: Items) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = list(matches(items, batch.column(1).to_pylist()))
                docs_, which, starts, ends, edits = (np.array(c, np.int64) for c in (zip(*rows) if rows else [()] * 5))
                near = 1 - edits / items.lengths[which] if rows else np.zeros(0)
                ids = pa.array([items.ids[i] for i in which.tolist()], pa.int64())
                columns = [batch.column(0).take(pa.array(docs_)), ids, *map(pa.array, (starts, ends, edits, near))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "start_word", "end_word", "edits", "similarity"])

        return id_text(docs).mapInArrow(run, schema)

    out = None
    for items, several in _blocks(benchmark, similarity, id_col):
        found = materialize(searched(items), "decontaminate-found") if several else searched(items)
        out = found if out is None else out.union(found)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, id_col: str = "item_id") -> DataFrame:
    """``docs`` without the rows that hold an item, columns unchanged; no row is shuffled."""
    at = docs.columns.index("text")

    def cleaned(docs: DataFrame, items: Items) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for d, *_ in matches(items, batch.column(at).to_pylist()):
                    keep[d] = False
                yield batch.filter(pa.array(keep))

        return docs.mapInArrow(run, docs.schema)

    for items, several in _blocks(benchmark, similarity, id_col):
        docs = materialize(cleaned(docs, items), "decontaminate-kept", "zstd") if several else cleaned(docs, items)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
