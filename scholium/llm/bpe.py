"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The symbols of many distinct words lie in one flat array. Each pair of neighbours has the rank of its merge,
found by binary search over the sorted pair keys; in every round each word merges its lowest-ranked pair, and
only the pairs next to a merge are looked up again. Encoded words are kept in a bounded cache per worker.

Defined cases: a null or empty text has no tokens and decodes to the empty text. The strings of special tokens
inside a text become those tokens, as the library does by default. Repeated rows and ids are encoded row by
row; an empty table gives an empty result; other columns are ignored. Texts are encoded whole, word by word.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from scholium.llm.common import id_text, table

#: The white space of the pre-tokenizer, and its pattern with that class spelled out.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
#: Runs that the pattern never joins across: cached as one unit.
_UNITS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
_NONE = np.int64(1 << 40)


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or 256 onwards."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + n) for n, b in enumerate(rest)}


class Bpe:
    """A tokenizer file's vocabulary and merges as arrays."""

    def __init__(self, path: str, cache_limit: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        chars = byte_characters()
        back = {c: b for b, c in chars.items()}
        self.byte_ids = np.array([vocab[chars[b]] for b in range(256)], np.int64)
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = (left << 32) | right
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks, self.made = keys[order], order.astype(np.int64), made
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token_bytes = {
            i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t, i in vocab.items()
        } | {i: t.encode() for t, i in self.special.items()}
        self._shown = {i: str(i) for i in self.token_bytes}
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self._pieces = regex.compile(PIECES)
        self._cache: dict[str, tuple[str, int, bytes]] = {
            t: (str(i), 1, self.token_bytes[i]) for t, i in self.special.items()
        }
        self._always = dict(self._cache)
        self._limit = cache_limit

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NONE)

    def encode_words(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, number of ids of each word), by rounds of merges over all words at once."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        out_ids, out_words = [], []
        owner = np.repeat(np.arange(len(words)), sizes)
        if not len(ids):
            return ids, sizes
        inner = owner[:-1] == owner[1:]
        ranks = np.full(len(ids), _NONE)
        at = np.flatnonzero(inner)
        ranks[at] = self._ranks(ids[at], ids[at + 1])
        while len(ids):
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            lengths = np.diff(np.append(starts, len(ids)))
            lowest = np.minimum.reduceat(ranks, starts)
            active = np.repeat(lowest < _NONE, lengths)
            if not active.all():  # finished words leave the arrays
                out_ids.append(ids[~active])
                out_words.append(owner[~active])
                ids, owner, ranks = ids[active], owner[active], ranks[active]
                lengths, lowest = lengths[lowest < _NONE], lowest[lowest < _NONE]
                if not len(ids):
                    break
            hit = ranks == np.repeat(lowest, lengths)
            places = np.flatnonzero(hit)
            close = np.concatenate(([False], np.diff(places) == 1))
            if close.any():  # in a run of one symbol every other pair merges, from the left
                run = np.maximum.accumulate(np.where(close, 0, np.arange(len(places))))
                places = places[(np.arange(len(places)) - run) % 2 == 0]
            ids[places] = self.made[ranks[places]]
            stay = np.ones(len(ids), bool)
            stay[places + 1] = False
            new_place = np.cumsum(stay) - 1
            ids, owner, ranks = ids[stay], owner[stay], ranks[stay]
            touched = new_place[places]
            touched = np.concatenate((touched, touched[touched > 0] - 1))
            ranks[touched] = _NONE
            touched = touched[touched + 1 < len(ids)]
            touched = touched[owner[touched] == owner[touched + 1]]
            ranks[touched] = self._ranks(ids[touched], ids[touched + 1])
        all_words = np.concatenate(out_words)
        order = np.argsort(all_words, kind="stable")
        return np.concatenate(out_ids)[order], np.bincount(all_words, minlength=len(words))

    def _learn(self, units: Iterable[str]) -> None:
        """Encode units that the cache lacks."""
        units = list(units)
        pieces = list(map(self._pieces.findall, units))
        flat = list(dict.fromkeys(chain.from_iterable(pieces)))
        ids, counts = self.encode_words([p.encode("utf-8", "surrogatepass") for p in flat])
        listed, ends = ids.tolist(), np.cumsum(counts).tolist()
        shown, raw = list(map(self._shown.__getitem__, listed)), list(map(self.token_bytes.__getitem__, listed))
        encoded, start = {}, 0
        for piece, end in zip(flat, ends):
            encoded[piece] = (",".join(shown[start:end]), end - start, b"".join(raw[start:end]))
            start = end
        for unit, parts in zip(units, pieces):
            if len(parts) == 1:
                self._cache[unit] = encoded[unit]
            else:
                own = [encoded[p] for p in parts]
                self._cache[unit] = (
                    ",".join([o[0] for o in own]), sum([o[1] for o in own]), b"".join([o[2] for o in own])
                )

    def _split(self, text: str) -> list[str]:
        if self._special is None or not self._special.search(text):
            return _UNITS.findall(text)
        return [u for p in self._special.split(text) for u in ([p] if p in self.special else _UNITS.findall(p))]

    def round_trip(self, texts: Sequence[str]) -> Iterator[tuple[str, int, bytes]]:
        """For each text its ids joined by commas, their number, and the bytes that they decode to."""
        block, size = [], 0
        for n, text in enumerate(texts):
            block.append(self._split(text))
            size += len(text)
            if size < 4_000_000 and n < len(texts) - 1:
                continue
            if len(self._cache) > self._limit:
                self._cache = dict(self._always)
            missing = set(chain.from_iterable(block)) - self._cache.keys()
            if missing:
                self._learn(missing)
            cache = self._cache
            for units in block:
                found = [cache[u] for u in units]
                yield ",".join([f[0] for f in found]), sum([f[1] for f in found]), b"".join([f[2] for f in found])
            block, size = [], 0

    def encode(self, text: str) -> list[int]:
        joined = next(self.round_trip([text]))[0]
        return [int(i) for i in joined.split(",")] if joined else []

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(self.token_bytes[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_decode(docs: DataFrame, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Token count and digests of ids and decoded text; with ``keep_ids`` also the ids and the decoded text."""
    path = path or default_path()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, decoded string" if keep_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                counts, ids, texts, kept_ids, kept_texts = [], [], [], [], []
                for joined, n, raw in bpe.round_trip(part.column(1).to_pylist()):
                    decoded = raw.decode("utf-8", "replace")
                    counts.append(n)
                    ids.append(hashlib.sha256(joined.encode()).hexdigest())
                    texts.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                    if keep_ids:
                        kept_ids.append(np.array(joined.split(",") if joined else [], np.int32))
                        kept_texts.append(decoded)
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns += [pa.array(kept_ids, pa.list_(pa.int32())), pa.array(kept_texts, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return id_text(docs).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))
