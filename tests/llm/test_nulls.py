"""Rows without an id, nulls in every other column, and ids that repeat, through every operator."""

from __future__ import annotations

import pytest

from scholium.llm import bpe, debruijn, decontaminate, html_text, licenses, pii, quality, simhash, suffix_dedup, tokens

LONG = " ".join(f"word{i}" for i in range(120))
ROWS = [(None, LONG, None), (None, None, None), (1, LONG, None), (2, LONG, "x"), (2, LONG, "x"), (3, None, None)]
OPERATORS = {
    "pii": pii.detect, "licenses": licenses.scan, "bpe": bpe.encode_decode, "tokens": tokens.token_counts,
    "quality": quality.quality, "simhash": simhash.near_duplicates, "words": debruijn.remove_repeats,
    "bytes": suffix_dedup.remove_repeats,
}


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string")


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_every_row_comes_back(docs, name):
    got = OPERATORS[name](docs).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "2", "2", "3", "None", "None"]


def test_repeats_of_rows_without_an_id(docs):
    removed = {(r["doc_id"], r["n_removed"]) for r in debruijn.remove_repeats(docs).collect()}
    assert removed == {(None, 0), (1, 0), (2, 120), (3, 0)}
    gone = {(r["doc_id"], r["n_removed"]) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert gone == {(None, 0), (None, len(LONG)), (1, len(LONG)), (2, len(LONG)), (3, 0)}
    assert {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()} >= {(1, 1), (2, 1), (3, 3)}


def test_filters_keep_the_columns(spark, docs):
    bench = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    for kept in (quality.keep_good(docs), simhash.keep_one(docs), decontaminate.keep_clean(docs, bench), pii.redact(docs)):
        assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in decontaminate.keep_clean(docs, bench).collect()) == ["1", "2", "2", "3", "None", "None"]
    assert decontaminate.contamination(docs, bench).count() == 0


def test_pages_with_nulls(spark):
    pages = spark.createDataFrame([(None, None, None), (1, None, "<article><p>text of it</article>"), (1, None, "<article><p>text of it</article>")], "page_id long, url string, html string")
    assert sorted(r["text"] for r in html_text.main_text(pages).collect()) == ["", "text of it", "text of it"]
