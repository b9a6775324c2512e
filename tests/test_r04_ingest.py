"""st2_stream_ingest takes pages to their ends, and chunks too."""

from lodestack.plans import usage
from lodestack.sources import tables
from lodestack.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_stream_ingest_reaches_the_end_of_a_page(spark, tmp_path):
    lines = [f"erro e{i:03d} on this line here and there, and more of it" for i in range(120)]
    long = "longwords " * 900 + " ".join(f"k{i}" for i in range(30)) + " ABC123 placa gen 2"
    pages = spark.createDataFrame([("a", 1, "n", 1, "\n".join(lines)), ("a", 2, "n", 1, long)], "brand string, doc_id long, name string, page int, text string")
    pages.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pages.schema).parquet(str(tmp_path / "in"))
    jobs.stream_ingest(stream, str(tmp_path / "store"), str(tmp_path / "check")).awaitTermination(120)
    chunks = tables.read_chunks(spark, str(tmp_path / "store")).orderBy("doc_id", "chunk_index").collect()
    first = [r for r in chunks if r["doc_id"] == 1]
    assert {x for r in first for x in r["text"].split("\n")} == set(lines)
    assert [r["chunk_index"] for r in first] == list(range(len(first))) and {r["chunk_total"] for r in first} == {len(first)}
    found = {k: {x for r in chunks if r["doc_id"] == 2 for x in r["signals"][k]} for k in chunks[0]["signals"].asDict()}
    assert found["topics"] == {"controle"} and "ABC123" in found["controller_tokens"] and "GEN2" in found["model_version_tokens"]
    assert found["fault_tokens"] >= {f"K{i}" for i in range(30)}


def test_st2_has_more_than_the_first_chunks(spark):
    from .test_plain_chunks import chunks_of

    import hashlib

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("source IS NOT NULL").collect()
    got = {(r["doc_id"], r["chunk_index"], r["chunk_total"], r["h"]) for r in usage.QUERIES["st2_stream_ingest"](spark, SF).where("brand_slug IS NOT NULL").collect()}
    whole = {r["doc_id"]: chunks_of(r["text"], None, None) for r in docs}
    assert got == {(d, i, len(cs), hashlib.md5(c.encode()).hexdigest()) for d, cs in whole.items() for i, c in enumerate(cs)}
    assert max(map(len, whole.values())) > 8


def test_signals_of_windows_are_those_of_their_text(spark):
    """Lines' signals joined against the text's own: codes at ends of lines, topics and versions that go over them."""
    import random

    from pyspark.sql import functions as F

    from lodestack.functions import text as t
    from lodestack.operators import chunking

    rng = random.Random(4)
    words = ["cadeia", "de", "seguranca", "automacao", "resgate", "porta", "es", "GEN", "2", "gen 3", "v12", "VERSÃO", "E12", "ab1", "uv", "AB123X", "a_b", "ção", "é", "σΣ", "ΑΣ", "x.y", "-", "\t", "longer", "ﬁ", "İ"]
    pages = ["\n".join(rng.choice(["", "| "]) + " ".join(rng.choices(words, k=rng.randrange(9))) + " some words beside" * rng.randrange(3) for _ in range(rng.randrange(60, 110))) for _ in range(40)]
    made = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "doc_id long, text string")
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for docs in (made, given):
        rows = chunking.chunk_records(docs.withColumns({"b": F.lit("b"), "p": F.lit(1)}), "b", "doc_id", "b", "p")
        assert rows.count() > 500 and rows.where(~F.col("signals").eqNullSafe(t.domain_signals("text", None, None))).count() == 0
    seen = chunking.chunk_records(made.withColumns({"b": F.lit("b"), "p": F.lit(1)}), "b", "doc_id", "b", "p").where(F.col("text").rlike(r"(?i)(?<!\w)cadeia\nde seguranca(?!\w)") & ~F.col("text").rlike("(?i)(?<!\\w)es(?!\\w)|cadeia de segu"))
    assert all("seguranca" in r["signals"]["topics"] for r in seen.collect())
