"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from conftest import SF

from scholium.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracles()


def shown(v) -> str:
    if v is None or v != v:
        return "null"
    if hasattr(v, "tolist"):
        v = v.tolist()
    return "[" + ",".join(map(shown, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns, rows = sorted(df.columns), [r.asDict() for r in df.collect()]
    if name not in ORACLES:
        assert columns
        return
    relation = duck.sql(ORACLES[name])
    assert columns == sorted(relation.columns)
    places = [relation.columns.index(c) for c in columns]
    want = sorted(tuple(shown(r[i]) for i in places) for r in relation.fetchall())
    assert sorted(tuple(shown(r[c]) for c in columns) for r in rows) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_corpus_subpackage():
    from pathlib import Path

    root = Path(catalog.__file__).resolve().parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "scholium.llm" not in path.read_text(), path
