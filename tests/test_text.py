"""Text rules against values worked out by hand."""

from pyspark.sql import functions as F

from lodestack.functions import text as t


def values(spark, column, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r["y"] for r in df.select("i", column("x").alias("y")).orderBy("i").collect()]


def test_normalize_filename(spark):
    names = ["acme INSTALAÇÃO DO ACESSE CODE ACME.pdf", "0a1b2c3d-1234-1234-1234-0123456789ab_Manual.PDF", "0A1B2C3D-1234-1234-1234-0123456789AB_x.pdf", "a+b", "", None, "été.pdf"]
    assert values(spark, t.normalize_filename, names) == ["acme instalacao do acesse code acme", "manual", "0a1b2c3d 1234 1234 1234 0123456789ab x", "a b", "", None, "ete"]


def test_normalize_for_matching(spark):
    assert values(spark, t.normalize_for_matching, ["ATC - C.07.10", "acme+XO+508+falhas.pdf", "a\nb", "Calibração do OVF10"]) == ["atc c 07 10", "acmexo508falhas pdf", "ab", "calibracao do ovf10"]


def test_slugs_and_names(spark):
    assert values(spark, t.slugify, [" Ab  c!", "???", "Ção"]) == ["ab-c", "brand", "o"]
    assert values(spark, t.display_name, ["a/b/0a1b2c3d-1234-1234-1234-0123456789ab_x.y.pdf", "plain"]) == ["x.y", "plain"]


def test_tokens(spark):
    assert values(spark, t.key_tokens, ["Manual de a placa X1"]) == [["manual", "placa", "x1"]]
    assert values(spark, t.fault_tokens, ["e012 and uv, nãouv UV1 E012"]) == [["E012", "UV", "UV1"]]
    assert values(spark, t.has_fault_code, ["zzzzzz", "the", "wwwww1"]) == [False, True, False]


def test_search_keywords(spark):
    got = values(spark, t.search_keywords, ["Falhas no XO 508", "placa LCB2, C.07.10", "", "a"])
    assert got[0][0:2] == ["XO 508", "XO508"]
    assert got[1] == ["LCB2", "C0710", "placa LCB2", "placa LCB2 C0710"]
    assert got[2:] == [[], []]


def test_length_quality(spark):
    assert values(spark, t.length_quality, ["x" * n for n in (49, 50, 199, 200, 499, 500, 2000, 4000)]) == [0.1, 0.4, 0.4, 0.7, 0.7, 0.25, 1.0, 1.0]


def test_readable_gate(spark):
    prose = "some plain words here " * 20
    assert values(spark, t.readable_gate, ["short", prose, prose + "|" * 6, prose + "|" * 5, "x" * 300, "1 2 3 4 5 6 " * 30]) == ["short", "ok", "table", "ok", "few_words", "few_letters"]


def test_bad_question(spark):
    assert values(spark, t.bad_question, ["", None, "is it?", "what is the right way (now?", "what is the right way now?", "what is the use of?"]) == [True, True, True, True, False, True]


def test_expand_query(spark):
    df = spark.createDataFrame([("porta error",)], "x string")
    assert df.select(t.expand_query("x", {"error": ("fault", "error")})).first()[0] == "porta error fault"


def test_empty_text_has_four_signals(spark):
    row = spark.createDataFrame([(None,)], "x string").select(t.domain_signals("x").alias("s")).select("s.*").first()
    assert row.asDict() == {"topics": [], "controller_tokens": [], "fault_tokens": [], "model_version_tokens": []}


def test_let_binds_once(spark):
    assert spark.range(1).select(t.let(F.lit(2), lambda x: x + x)).first()[0] == 4


def test_intent_flags(spark):
    rows = ["Olá!!", "o elevador acme 2", "quais documentos você tem", "noções gerais", "porta DW abre e não fecha, abrindo e fechando", "a porta não parte", "calibração do beta", None]
    got = values(spark, lambda c: t.intent_flags(c, F.lit("Gamma"), ("acme", "beta")), rows)
    assert [r["greeting"] for r in got] == [True] + [False] * 7
    assert [r["cross_brand"] for r in got] == [False, True, False, False, False, False, True, False]
    assert [r["meta_docs"] for r in got] == [False, False, True] + [False] * 5 and got[3]["general_manual"]
    assert [r["door_cycle"] for r in got] == [False] * 4 + [True, True, False, False]
    assert [r["technical"] for r in got] == [False] * 4 + [True, True, True, False] and got[1]["identifier"]


def test_rewrite_flags(spark):
    rows = ["bad \ufffd", "de la a casa", "ação de um", "please check it", "a warning", "\U0001f4c4 Fuente: x", "", None]
    got = values(spark, t.rewrite_flags, rows)
    assert [r["rewrite"] for r in got] == [True, True, False, True, False, True, False, False]
    assert (got[0]["broken"], got[1]["short_words"], got[3]["foreign"], got[5]["cited"]) == (True,) * 4


def test_tokens_are_whole_words(spark):
    assert values(spark, t.fault_tokens, ["e1 xe1 e1é _e1 e1, UV;ov abcdef1 a1234 uv", None]) == [["E1", "XE1", "UV", "OV"], None]
    assert values(spark, t.controller_tokens, ["LCB2 http1 ABCDEFG1 AB12CDEF ab1cd"]) == [["LCB2", "HTTP1", "AB1CD"]]
