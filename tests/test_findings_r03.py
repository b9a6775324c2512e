"""What the findings of round 3 named: tables in folders, words at letters of any script, long lines, joins' sizes."""

import duckdb
from pyspark.sql import functions as F

from lodestack.operators import retrieval as r
from lodestack.plans import usage

SF = "/root/testdata/sf0.001"


def test_streams_read_tables_that_are_folders(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    for name in ("st2_stream_ingest", "st2_ingest_status", "st3_stream_dedupe"):
        assert key(usage.QUERIES[name](spark, str(tmp_path))) == key(usage.QUERIES[name](spark, SF)) != []


def test_words_end_at_letters_of_any_script(spark):
    """v4, v5: "zußzu" is one word, for the query and for its SQL."""
    from lodestack.plans.usage import SQL

    said = [(1, 0, "user", "der zußzu der in x"), (2, 0, "user", "ßder zu"), (3, 0, "user", "der schßp"), (4, 0, "user", "in  the")]
    c = duckdb.connect()
    c.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    c.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", said)
    want = {x[0]: x[1:] for x in c.execute(SQL["v4_known_context"]).fetchall()}
    from lodestack.operators import conversations as v

    rows = spark.createDataFrame([(k, x) for k, _, _, x in said], "conv_id long, text string")
    got = {x[0]: tuple(x)[1:] for x in rows.select("conv_id", *v.known_context(F.col("text"), **usage._OWN)).collect()}
    assert got == want and [got[k][2] for k in (1, 2, 3)] == ["DERIN", None, None] and got[4][0] == "In the"


def test_r25_first_documents_before_the_join(spark):
    """A model's first documents are numbered once, not once for each query that asks for the model."""
    known = spark.createDataFrame([(q, "a") for q in range(20)], "query_id long, model string")
    edges = spark.createDataFrame([("a", 1), ("b", 1)], "model string, part int")
    docs = spark.createDataFrame([("b", i) for i in range(50)], "model string, doc long")
    out = r.alternative_docs(known, edges, docs, docs.where("doc = 0").select("doc"))
    assert {tuple(x) for x in out.select("query_id", "doc", "k").collect()} == {(q, 1, 1) for q in range(20)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(query_id" in plan and "windowspecdefinition(model" in plan
