"""Rows that repeat an id with other texts, rows without an id, and spans that their source does not confirm."""

from __future__ import annotations

import hashlib

from scholium.llm import debruijn, suffix_dedup

PASSAGE = " ".join(f"p{i}" for i in range(120))
OTHER = " ".join(f"q{i}" for i in range(130))
FRONT = " ".join(PASSAGE.split()[:112])
ROWS = [(1, PASSAGE), (2, "short"), (2, f"{OTHER} {PASSAGE} end"), (2, FRONT), (None, OTHER), (3, f"x {OTHER}")]


def test_each_row_is_judged_on_its_own_text(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in suffix_dedup.remove_repeats(docs).collect()}
    both = len(f"{OTHER} {PASSAGE}") - 1  # the space between the two stands in neither
    assert got == {
        (1, len(PASSAGE)): len(PASSAGE), (2, 5): 0, (2, both + 5): both, (2, len(FRONT)): len(FRONT), (None, len(OTHER)): len(OTHER),
        (3, len(OTHER) + 2): len(OTHER),
    }
    words = {(r["doc_id"], r["n_words"]): (r["n_removed"], r["kept_sha256"]) for r in debruijn.remove_repeats(docs).collect()}
    assert words == {
        (1, 120): (0, hashlib.sha256(PASSAGE.encode()).hexdigest()),
        (2, 1): (0, hashlib.sha256(b"short").hexdigest()),
        (2, 251): (120, hashlib.sha256(f"{OTHER} end".encode()).hexdigest()),
        (2, 112): (112, hashlib.sha256(b"").hexdigest()),
        (None, 130): (0, hashlib.sha256(OTHER.encode()).hexdigest()),
        (3, 131): (130, hashlib.sha256(b"x").hexdigest()),
    }


def test_spans_that_their_source_does_not_confirm_stay(spark, monkeypatch):
    """All words hash alike, so every run seems to repeat; the words at the source decide."""
    monkeypatch.setattr(debruijn, "_values", lambda words: __import__("numpy").ones(len(words), "uint64"))
    one, two = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    docs = spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in debruijn.remove_repeats(docs).collect()}
    assert got[1] == got[2] == 0
