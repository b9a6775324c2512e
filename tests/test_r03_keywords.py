"""r17: the table that texts meet is measured by what it takes in memory, and one part of it is broadcast at a time."""

from lodestack.operators import substrings


def test_keywords_are_met_in_parts_by_memory(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i} the pump {i} of gen {i % 7}") for i in range(40)], "doc_id long, text string")
    keys = spark.createDataFrame([(f"word{i}",) for i in range(40)] + [("the pump",), ("gen 3",)], "keyword string")
    want = {tuple(x) for x in substrings.keyword_hits(keys, docs, "text").collect()}
    written, real = [], substrings.cut
    monkeypatch.setattr(substrings, "cut", lambda df, name: written.append(name) or real(df, name))
    monkeypatch.setattr(substrings, "AT_ONCE", 4096)  # more than the table's file has, less than its rows take
    assert {tuple(x) for x in substrings.keyword_hits(keys, docs, "text").collect()} == want and len(want) > 80
    assert written.count("keywords-hits") > 1
