"""The pipeline over nulls, repeated rows, very long texts, clashing columns and empty tables."""

from __future__ import annotations

import random

import corpus_pipeline
from scholium.llm import bpe

BENCH = "every river of the north is said to have been named for a king who was lost in it"


def prose(seed, n=60):
    rnd = random.Random(seed)
    words = [f"{rnd.choice('bcdfgklmnprst')}{rnd.choice('aeiou')}{rnd.choice('lmnrst')}{rnd.choice('aeiou')}{i % 97}" for i in range(n)]
    return " ".join(f"the {w} of" if i % 9 == 0 else w for i, w in enumerate(words))


def test_cases(spark, tmp_path):
    good, other, long, loose = prose(1), prose(2), prose(3, 150_000), prose(4)
    rows = [
        (1, good), (1, good), (2, good), (None, good), (None, loose), (None, None), (3, None), (4, ""), (5, "too short"),
        (6, f"{other} {BENCH} end of the text"), (7, f"{other} write to ann@example.org and call now"), (8, long), (9, "word " * 40),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _dropped long, row string, component_id int, words int"
    docs = spark.createDataFrame([(i, t, None, "s", None, 1, "x", 2, 3) for i, t in rows], schema)
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    bench = spark.createDataFrame([(1, BENCH), (2, None), (None, "")], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    count = lambda t: len(bpe.load(bpe.default_path()).encode(t))
    masked = f"{other} write to [EMAIL] and call now"
    assert got == sorted([("1", count(good))] * 2 + [("None", count(good)), ("None", count(loose)), ("7", count(masked)), ("8", count(long))])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
