"""Several writers of one token cache, a cache that goes, and rows of one id with other texts."""

from __future__ import annotations

import shutil
from concurrent.futures import ThreadPoolExecutor

import pytest

from scholium.llm import simhash, tokens
from scholium.llm.bpe import default_path


def test_three_writers_at_once(spark, tmp_path):
    texts = [None, "", *(f"text {i} of some words, {i * i}" for i in range(400))]
    cache, count = str(tmp_path / "cache"), tokens.counter(default_path())
    want = sorted((i, count([t or ""])[0]) for i, t in enumerate(texts))

    def run(part):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts) if i % 4 != part], "doc_id long, text string")
        return sorted((r["doc_id"], r["n_tokens"]) for r in tokens.token_counts(df, cache).collect())

    with ThreadPoolExecutor(3) as pool:
        for part, got in enumerate(pool.map(run, range(3))):
            assert got == [w for w in want if w[0] % 4 != part]
    before = tokens.appends(spark, cache)
    assert 1 <= len(before) <= 3
    everything = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_tokens"]) for r in tokens.token_counts(everything, cache).collect()) == want
    assert tokens.appends(spark, cache) == before  # nothing new, so no new folder


def test_unfinished_appends_are_not_read(spark, tmp_path):
    cache = tmp_path / "cache"
    df = spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string")
    assert tokens.token_counts(df, str(cache)).count() == 2
    (folder,) = cache.glob("counts-*")
    shutil.copytree(folder, cache / "counts-unfinished")
    (cache / "counts-unfinished" / "_SUCCESS").unlink()
    assert [f.rsplit("/", 1)[1] for f in tokens.appends(spark, str(cache))] == [folder.name]


def test_a_missing_count_is_an_error(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "_append", lambda counts, cache: None)
    df = spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string")
    with pytest.raises(Exception, match="a count is missing"):
        tokens.token_counts(df, str(tmp_path / "cache")).collect()


def test_keep_one_tells_rows_of_one_id_apart(spark):
    a, b = "one two three four five six seven", "nothing in common with the text of the other rows"
    docs = spark.createDataFrame([(1, a, 1), (5, a, 2), (5, b, 3), (5, b, 4), (None, a, 5), (7, None, 6)], "doc_id long, text string, t long")
    kept = sorted(r["t"] for r in simhash.keep_one(docs).collect())
    assert kept == [1, 3, 4, 5, 6] and simhash.keep_one(docs).columns == docs.columns
