"""The driver's contract."""

import sys

import __spark_entry__


def test_names_agree():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100


def test_the_rest_works_without_the_subpackage(monkeypatch):
    import importlib

    for name in [m for m in sys.modules if m.startswith(("lodestack.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        entry = importlib.reload(__spark_entry__)
        assert "pipeline" not in entry.queries() and "r16_diversify" in entry.queries()
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)


def test_flagship(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["query_id", "chunk_id", "doc_id", "score", "hit", "rank"] and out.count() > 0
