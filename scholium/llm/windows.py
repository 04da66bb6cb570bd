"""Fixed-length windows of token sequences, cut where their minimizers change.

Every window of ``length`` tokens belongs to one minimizer: the least-hashed ``seed``-token run inside it, the
leftmost of equal ones. Windows in a row with the same minimizer form a piece. Both depend on the window's own
tokens only, so equal windows of any two documents lie in pieces with equal minimizers: candidates for repeats
meet by one hash for some (length - seed) / 2 windows, and windows under a minimizer that occurs once have no
equal. All steps run over flat arrays of many documents at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.llm.common import id_text

_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_PLACE_BITS = np.uint64(24)
_PLACES = np.uint64((1 << 24) - 1)
#: Tokens in one flat block at most; a longer document runs over several, which overlap by a window less one.
BLOCK = 1 << 19


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64."""
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n + 1, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Prefixes:
    """Prefix sums of a block from which the hash of any stretch follows."""

    def __init__(self, values: np.ndarray, base: int = 0):
        self.n = len(values)
        size = 1 << max(16, int(self.n).bit_length())
        forward, self.back = _powers(_BASES[base], size)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(values * forward[: self.n], out=self.sums[1:])

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))

    def runs(self, length: int) -> np.ndarray:
        """Hashes of all stretches of one length."""
        n = max(0, self.n - length + 1)
        return mix((self.sums[length : length + n] - self.sums[:n]) * self.back[:n])


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` keys in a row, by running minima within blocks from both ends."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    grid = padded.reshape(-1, width)
    fore = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], fore[width - 1 : width - 1 + n])


@dataclass
class Pieces:
    """Parallel arrays: owner (index of the document in the block), first window, number of windows, place
    of the minimizer after the first window's start, its hash, and a hash of all the piece's tokens."""

    owner: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    place: np.ndarray
    anchor: np.ndarray
    digest: np.ndarray


def blocks(lengths: Sequence[int], length: int, block: int = BLOCK) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (document, from, to) of at most ``block`` tokens; pieces of a long document overlap."""
    now: list[tuple[int, int, int]] = []
    size = 0
    for doc, n in enumerate(lengths):
        at = 0
        while n - at >= length:
            room = block - size
            if n - at > room and size:
                yield now
                now, size = [], 0
                continue
            to = min(n, at + block)
            now.append((doc, at, to))
            size += to - at
            if to == n:
                break
            at = to - length + 1
    if now:
        yield now


def cut(values: np.ndarray, parts: Sequence[tuple[int, int, int]], length: int, seed: int) -> Pieces:
    """Pieces of the documents' parts, whose values lie one after another in ``values``."""
    sizes = np.array([to - at for _, at, to in parts], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    first = Prefixes(values)
    seeds = first.runs(seed)
    keys = (seeds & ~_PLACES) | np.arange(len(seeds), dtype=np.uint64)
    least = (sliding_min(keys, length - seed + 1) & _PLACES).astype(np.int64)
    part_of = np.repeat(np.arange(len(parts)), sizes)[: len(least)]
    valid = np.arange(len(least)) + length <= ends[part_of]
    places = np.flatnonzero(valid)
    if not len(places):
        none = np.zeros(0, np.int64)
        return Pieces(none, none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    chosen = least[places]
    new = np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (part_of[places[1:]] != part_of[places[:-1]])))
    heads = np.flatnonzero(new)
    windows = np.diff(np.append(heads, len(places)))
    begin = places[heads]
    end = begin + windows + length - 1
    own = part_of[begin]
    docs, offsets = np.array([d for d, _, _ in parts]), np.array([a for _, a, _ in parts])
    return Pieces(
        docs[own], begin - starts[own] + offsets[own], windows, chosen[heads] - begin, seeds[chosen[heads]],
        first.stretch(begin, end),
    )


def covered(n: int, starts: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Which of ``n`` tokens lie in a window that starts in one of the ranges [start, end)."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, ends + length - 1, -1)
    return np.cumsum(edges[:-1]) > 0


RANGES = "array<struct<s:long,e:long>>"


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, t, doc_id, text): ``doc`` is the id, 0 where it is null, and ``t`` a hash of id and text.

    Together they name a row's content, so rows that repeat an id with other texts stay apart, and rows without
    an id spread over all tasks.
    """
    base = id_text(docs)
    return base.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc"), F.xxhash64("doc_id", "text").alias("t"), "doc_id", "text")


def ranges(cell: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    if not cell.is_valid:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = cell.values
    return both.field(0).to_numpy(zero_copy_only=False), both.field(1).to_numpy(zero_copy_only=False)


def structs(lists: pa.Array, names: Sequence[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of lists of structs: where each row's entries begin in the flat arrays (and end, at the next), and the fields."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    flat = lists.flatten()
    return np.concatenate(([0], ends)), [flat.field(n).to_numpy(zero_copy_only=False) for n in names]


def with_lists(base: DataFrame, lists: DataFrame, how: str = "left") -> DataFrame:
    """Rows of ``keyed`` with what is listed for them by (doc, t); the texts are shuffled once, by content."""
    return base.join(lists.hint("shuffle_hash"), ["doc", "t"], how)
