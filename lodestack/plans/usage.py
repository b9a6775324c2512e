"""Queries of retrieval, conversations, usage figures and evaluation, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text as t
from ..functions import vocab
from ..operators import conversations as v
from ..operators import evaluation as e
from ..operators import metrics as m
from ..operators import retrieval as r
from ..operators.chunking import embed
from ..sources.scratch import cut
from ..sources.tables import document_status, load, read_chunks
from .text import FILE_NORM, FIRST, in_list, norm, words

QUERIES, SQL = {}, {}
NOW = "2024-01-31 00:00:00"


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# Retrieval: vectors of embeddings are chunks, every hundredth is a query, labels are brands


def chunk_rows(spark, d):
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text", "source", "lang")
    vec = load(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"), F.col("label").alias("brand"))
    rows = vec.join(docs, "vec_id")
    name = F.concat_ws(" ", "source", F.substring(F.split("text", "\n")[0], 1, 60))
    return rows.select(F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % 97).alias("doc_id"), "brand", name.alias("name"), "text", "vector")


def as_queries(chunks):
    return chunks.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "brand", F.substring("text", 1, 80).alias("text"), "vector")


def query_rows(spark, d):
    return as_queries(chunk_rows(spark, d))


_C = "c AS (SELECT e.vec_id AS chunk_id, e.vec_id % 97 AS doc_id, label AS brand, source || ' ' || substr(string_split(text, chr(10))[1], 1, 60) AS name, text, embedding::DOUBLE[] AS v FROM embeddings e JOIN documents ON doc_id = vec_id), q AS (SELECT chunk_id AS query_id, brand, substr(text, 1, 80) AS text, v FROM c WHERE chunk_id % 100 = 0)"
_S = f"{_C}, s AS (SELECT query_id, chunk_id, doc_id, list_cosine_similarity(q.v, c.v) AS similarity FROM q JOIN c USING (brand))"


@query("r1_cosine_topk", f"WITH {_S}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM s WHERE similarity >= 0.1) SELECT query_id, chunk_id, round(similarity, 6) AS similarity FROM k WHERE rank <= 100")
def r1(spark, d):
    return r.cosine_topk(query_rows(spark, d), chunk_rows(spark, d), 100, 0.1).select("query_id", "chunk_id", F.round("similarity", 6).alias("similarity"))


@query("r2_match_documents", f"WITH {_S}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM s WHERE similarity > 0.05) SELECT query_id, chunk_id, rank FROM k WHERE rank <= 10")
def r2(spark, d):
    return r.match_documents(query_rows(spark, d), chunk_rows(spark, d), 0.05, 10).select("query_id", "chunk_id", "rank")


@query("r3_doc_filename_map", f"WITH {_C} SELECT doc_id, arg_min(name, chunk_id) AS name FROM c WHERE doc_id <> 0 GROUP BY 1")
def r3(spark, d):
    return r.doc_filename_map(chunk_rows(spark, d), "doc_id", "name", "chunk_id")


_TOK = f"list_filter(string_split({norm('q.text')}, ' '), lambda w: length(w) >= 2 AND NOT {in_list('w', vocab.STOP_WORDS)})"
_BONUS = f"(SELECT query_id, chunk_id, doc_id, length(list_filter(tk, lambda w: contains(fn, w) OR contains(replace(fn, ' ', ''), w))) AS n FROM (SELECT query_id, chunk_id, doc_id, {_TOK} AS tk, {norm('c.name')} AS fn FROM q JOIN c USING (brand)))"
_FB = "least(0.25, n * 0.08 + CASE WHEN n >= 2 THEN 0.05 ELSE 0 END)"


@query("r4_filename_bonus", f"WITH {_C} SELECT query_id, chunk_id, round({_FB}, 6)::DOUBLE AS bonus FROM {_BONUS}")
def r4(spark, d):
    return r.name_bonuses(query_rows(spark, d), chunk_rows(spark, d), "chunk_id").select("query_id", "chunk_id", "bonus")


@query("r5_filename_candidates", f"WITH {_C} SELECT query_id, chunk_id AS doc_id, round({_FB}, 6)::DOUBLE AS bonus FROM {_BONUS} WHERE {_FB} >= 0.15")
def r5(spark, d):
    names = chunk_rows(spark, d).select(F.col("chunk_id").alias("doc_id"), "brand", "name")
    return r.filename_candidates(query_rows(spark, d), names)


@query("r7_inject_docs", f"WITH {_S}, f AS (SELECT DISTINCT query_id, doc_id FROM s WHERE similarity >= 0.3), w AS (SELECT s.*, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY similarity DESC, chunk_id) AS k FROM s WHERE similarity >= 0.1 AND (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM f)) SELECT query_id, doc_id, chunk_id FROM w WHERE k <= 4")
def r7(spark, d):
    chunks, q = chunk_rows(spark, d), query_rows(spark, d)
    near = cut(r.nearest_per_doc(q, chunks, 4, 0.1), "near")  # a document's best chunk tells if it was found
    return r.inject_docs(near, near.where("similarity >= 0.3"), near).select("query_id", "doc_id", "chunk_id")


#: Components of the stand-in for an embedding service.
DIMENSION = 64


def hashed_words(texts):
    """A stand-in for an embedding service: every word of the text adds one to the component that its hash names, or takes one."""
    import zlib

    import numpy as np

    def vector(text):
        h = np.array([zlib.crc32(w.encode()) for w in text.lower().split()] or [0], dtype=np.int64)
        return np.bincount(h % DIMENSION, weights=1.0 - 2.0 * (h >> 31), minlength=DIMENSION).tolist()

    return texts.map(vector)


def embedded(chunks):
    """Chunks with the stand-in's vector of their whole text."""
    return embed(chunks.drop("vector").where("text IS NOT NULL"), hashed_words, DIMENSION)


@query("r8_multi_query")
def r8(spark, d):
    """Keywords and chunks share the stand-in's space, where a word is far from a text of many: hence the low threshold."""
    return r.multi_query(query_rows(spark, d), embedded(chunk_rows(spark, d)), hashed_words, DIMENSION, least=0.2).select("query_id", "chunk_id", F.round("similarity", 6).alias("similarity"))


@query("r9_union_candidates", f"WITH {_S}, a AS (SELECT query_id, chunk_id, 1 AS phase FROM s WHERE similarity >= 0.2 UNION ALL SELECT query_id, chunk_id, 2 FROM s WHERE chunk_id % 7 = 0 AND similarity >= 0.1) SELECT query_id, chunk_id, min(phase) AS phase FROM a GROUP BY 1, 2")
def r9(spark, d):
    chunks = chunk_rows(spark, d).withColumn("doc_id", F.col("chunk_id"))  # every chunk a document of its own
    above = lambda some, least: r.nearest_per_doc(query_rows(spark, d), some, 1, least).select("query_id", "chunk_id")
    return r.union_candidates([above(chunks, 0.2), above(chunks.where("chunk_id % 7 = 0"), 0.1)], ["query_id", "chunk_id"]).select("query_id", "chunk_id", "phase")


@query("r10_lexical_bonus", f"SELECT doc_id, round(least(0.24, coalesce(list_sum(list_transform(['UV', 'OV', 'THE', 'ON', 'ERER'], lambda x: CASE WHEN list_contains(w, x) THEN 0.08 WHEN contains(u, x) THEN 0.04 ELSE 0.0 END)), 0)), 6)::DOUBLE AS bonus FROM (SELECT doc_id, upper(text) AS u, {words('upper(text)')} AS w FROM documents WHERE text IS NOT NULL)")
def r10(spark, d):
    docs = load(spark, d, "documents").where(F.col("text").isNotNull()).withColumn("tokens", F.array(*[F.lit(x) for x in ("UV", "OV", "THE", "ON", "ERER")]))
    return docs.select("doc_id", F.round(r.lexical_bonus("text", "tokens"), 6).alias("bonus"))


@query("r11_keyword_bonus", r"SELECT doc_id, round(least(0.25, coalesce(list_sum(list_transform(['license', 'onthe', 'gen-2', 'e s'], lambda k: CASE WHEN contains(l, k) THEN 0.10 WHEN length(regexp_replace(k, '[.\s-]', '', 'g')) >= 3 AND contains(c, regexp_replace(k, '[.\s-]', '', 'g')) THEN 0.06 ELSE 0.0 END)), 0)), 6)::DOUBLE AS bonus FROM (SELECT doc_id, lower(text) AS l, regexp_replace(lower(text), '[.\s-]', '', 'g') AS c FROM documents WHERE text IS NOT NULL)")
def r11(spark, d):
    docs = load(spark, d, "documents").where(F.col("text").isNotNull()).withColumn("keys", F.array(*[F.lit(x) for x in ("license", "onthe", "gen-2", "e s")]))
    return docs.select("doc_id", F.round(r.keyword_bonus("text", "keys"), 6).alias("bonus"))


@query("r12_signal_bonus")
def r12(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "text", t.domain_signals("text").alias("signals"))
    return docs.select("doc_id", F.round(r.signal_bonus("signals", "text"), 6).alias("bonus"))


@query("r13_identifier_bonus")
def r13(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "text", "source", t.domain_signals("text").alias("signals"), t.query_identifiers("text").alias("ids"))
    return docs.select("doc_id", r.identifier_bonus("text", "source", "signals", "ids").alias("b")).select("doc_id", F.round("b.bonus", 6).alias("bonus"), "b.hit")


def scored(spark, d):
    chunks, q = chunk_rows(spark, d), query_rows(spark, d)
    near = r.cosine_topk(q, chunks, 100, 0.1).select("query_id", "chunk_id", "similarity")
    rows = near.join(chunks.select("chunk_id", "doc_id", "name"), "chunk_id").join(q.select("query_id", "text"), "query_id")
    return rows.select("query_id", "chunk_id", "doc_id", "name", F.round(F.col("similarity") + r.filename_bonus("name", "text"), 6).alias("score"))


_SC = f"{_S}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM s WHERE similarity >= 0.1), b AS (SELECT k.query_id, k.chunk_id, k.doc_id, round(similarity + {_FB}, 6) AS score FROM k JOIN {_BONUS} x ON x.query_id = k.query_id AND x.chunk_id = k.chunk_id WHERE rank <= 100)"
_DIV = f"{_SC}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS place FROM b), n AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY place) AS nth FROM p), f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN nth > 3 THEN 1 ELSE 0 END, place) AS rank FROM n)"


@query("r14_score", f"WITH {_SC} SELECT query_id, chunk_id, score FROM b")
def r14(spark, d):
    return scored(spark, d).select("query_id", "chunk_id", "score")


@query("r15_identifier_first", f"WITH {_SC}, h AS (SELECT *, chunk_id % 3 = 0 AS hit, count(*) FILTER (chunk_id % 3 = 0) OVER (PARTITION BY query_id) AS hits FROM b) SELECT query_id, chunk_id, CASE WHEN hit AND hits >= 3 THEN 1 ELSE 0 END AS lead FROM h")
def r15(spark, d):
    return r.identifier_first(scored(spark, d).withColumn("hit", F.col("chunk_id") % 3 == 0), 7).select("query_id", "chunk_id", "lead")


def ranked(spark, d, k=7):
    return r.diversify(scored(spark, d).withColumn("lead", F.lit(0)), k)


@query("r16_diversify", f"WITH {_DIV} SELECT query_id, chunk_id, doc_id, score, rank FROM f WHERE rank <= 7")
def r16(spark, d):
    return ranked(spark, d).select("query_id", "chunk_id", "doc_id", "score", "rank")


@query("r17_hybrid_search")
def r17(spark, d):
    # Dealt anew, as a table of few files, joined by a broadcast, would leave texts to as few tasks.
    chunks = cut(chunk_rows(spark, d).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk_id"), "chunks")
    queries = cut(as_queries(chunks), "queries")
    return r.hybrid_search(queries, chunks, r.multi_query(queries, embedded(chunks), hashed_words, DIMENSION, least=0.2))


@query("r18_symptom_boost", f"WITH {_DIV}, x AS (SELECT f.*, name, score + CASE WHEN regexp_matches(name, 'e[rn]') THEN 0.12 ELSE 0 END - CASE WHEN regexp_matches(name, 'th') THEN 0.08 ELSE 0 END AS z FROM f JOIN c USING (chunk_id) WHERE rank <= 7) SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY z DESC, rank) AS rank FROM x")
def r18(spark, d):
    return r.symptom_boost(ranked(spark, d), "name", "e[rn]", "th").select("query_id", "chunk_id", "rank")


@query("r19_merge_fallback", f"WITH {_DIV}, a AS (SELECT query_id, chunk_id, score FROM f WHERE rank <= 7), x AS (SELECT query_id, chunk_id, score * 0.5 AS score FROM f WHERE (query_id, chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM a) UNION ALL SELECT * FROM a) SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM x) WHERE rank <= 25")
def r19(spark, d):
    extra = scored(spark, d).withColumn("score", F.col("score") * 0.5)
    return r.merge_fallback(ranked(spark, d), extra, ["chunk_id"]).select("query_id", "chunk_id", "rank")


@query("r20_search_confidence", f"""WITH {_DIV}, g AS (SELECT query_id, max(score) AS top, max(score) - min(score) AS spread, count(DISTINCT doc_id) AS docs, arg_min(doc_id, rank) AS lead FROM f WHERE rank <= 7 GROUP BY 1),
  o AS (SELECT f.query_id, arg_min(score, rank) AS second FROM f JOIN g USING (query_id) WHERE rank <= 7 AND doc_id <> lead GROUP BY 1), x AS (SELECT g.*, top - coalesce(nullif(second, 0), 0) AS gap, coalesce(seen, false) AS seen FROM g LEFT JOIN o USING (query_id) LEFT JOIN (SELECT query_id, bool_or(chunk_id % 5 = 0) AS seen FROM f WHERE rank <= 7 GROUP BY 1) USING (query_id)),
  y AS (SELECT *, CASE WHEN seen AND top >= 0.70 THEN 'strong_match_with_terms' WHEN top >= 0.75 THEN 'strong_match' WHEN top >= 0.68 AND gap >= 0.03 THEN 'clear_leader' WHEN seen AND top >= 0.55 THEN 'terms_found_moderate_score' WHEN NOT seen THEN 'terms_not_found' WHEN docs >= 5 AND spread < 0.05 THEN 'too_many_similar_docs' WHEN top < 0.60 THEN 'low_scores' WHEN docs >= 4 AND gap < 0.02 THEN 'ambiguous_multi_doc' ELSE 'acceptable' END AS reason FROM x)
  SELECT query_id, round(top, 6) AS top, round(spread, 6) AS spread, docs, reason, reason NOT IN ('terms_not_found', 'too_many_similar_docs', 'low_scores', 'ambiguous_multi_doc') AS confident FROM y""")
def r20(spark, d):
    return r.search_confidence(ranked(spark, d).withColumns({"source": F.col("doc_id"), "terms": F.col("chunk_id") % 5 == 0}))


@query("r21_apply_rerank", f"WITH {_DIV}, j AS (SELECT *, rank % 3 * 3 + 1.0 AS judge FROM f WHERE rank <= 7) SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY judge DESC, rank) AS final_rank FROM j WHERE judge >= 5")
def r21(spark, d):
    rows = ranked(spark, d)
    item = F.format_string('{"index": %d, "score": %d.0}', F.col("rank") - 1, F.col("rank") % 3 * 3 + 1)
    answers = rows.groupBy("query_id").agg(F.concat(F.lit("```json\n["), F.array_join(F.collect_list(item), ", "), F.lit(', {"index": 9, "sc')).alias("answer"))
    return r.apply_rerank(rows, answers).select("query_id", "chunk_id", "final_rank")


@query("r22_citations", f"WITH {_DIV} SELECT query_id, 'doc ' || doc_id AS name, chunk_id % 2 AS page, min(rank) AS rank, round(arg_min(score, rank), 3) AS score FROM f WHERE rank <= 7 GROUP BY 1, 2, 3")
def r22(spark, d):
    rows = ranked(spark, d).withColumns({"source": F.format_string("x/doc %d.pdf", "doc_id"), "page": F.col("chunk_id") % 2})
    return r.citations(rows)


@query("r23_build_context", f"WITH {_DIV} SELECT query_id, md5(string_agg(name, chr(10) || '---' || chr(10) ORDER BY rank)) AS h FROM f JOIN c USING (chunk_id) WHERE rank <= 7 GROUP BY 1")
def r23(spark, d):
    return r.build_context(ranked(spark, d), "name").select("query_id", F.md5("context").alias("h"))


@query("r24_ambiguous_equipment", f"WITH {_DIV}, x AS (SELECT query_id, f.doc_id, regexp_replace(upper(name), '[^A-Z0-9]', '', 'g') AS n FROM f JOIN c USING (chunk_id) WHERE rank <= 7), y AS (SELECT query_id, doc_id, unnest(list_filter(['SRC1', 'SRC2', 'THE'], lambda k: contains(n, k))) AS code FROM x), z AS (SELECT query_id, count(DISTINCT doc_id) AS docs FROM x GROUP BY 1) SELECT query_id, docs, coalesce(codes, 0) AS codes, docs >= 2 AND coalesce(codes, 0) >= 2 AS ambiguous FROM z LEFT JOIN (SELECT query_id, count(DISTINCT code) AS codes FROM y GROUP BY 1) USING (query_id)")
def r24(spark, d):
    name = t.fold_accents("name")
    return r.ambiguous_equipment(ranked(spark, d).withColumn("name", name), ("SRC1", "SRC2", "THE"), "name")


SQL["r24_ambiguous_equipment"] = SQL["r24_ambiguous_equipment"].replace("upper(name)", "upper(strip_accents(name))")


@query("r25_alternative_docs", "WITH k AS (SELECT s_suppkey AS query_id, 'Brand#' || (s_suppkey % 20) AS model FROM supplier), g AS (SELECT DISTINCT p_brand AS model, p_size AS part FROM part WHERE p_size < 3), s AS (SELECT DISTINCT query_id, b.model FROM k JOIN g a ON a.model = k.model JOIN g b ON a.part = b.part AND b.model <> k.model), w AS (SELECT query_id, p_partkey AS doc, row_number() OVER (PARTITION BY query_id, s.model ORDER BY p_partkey) AS n FROM s JOIN part ON p_brand = s.model), u AS (SELECT DISTINCT query_id, doc FROM w WHERE n <= 2 AND doc % 4 <> 0), z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc) AS k FROM u) SELECT query_id, doc, k FROM z WHERE k <= 5")
def r25(spark, d):
    p = load(spark, d, "part")
    known = load(spark, d, "supplier").select(F.col("s_suppkey").alias("query_id"), F.format_string("Brand#%d", F.col("s_suppkey") % 20).alias("model"))
    edges = p.where("p_size < 3").select(F.col("p_brand").alias("model"), F.col("p_size").alias("part")).distinct()
    docs = p.select(F.col("p_brand").alias("model"), F.col("p_partkey").alias("doc"))
    returned = docs.where("doc % 4 = 0").select("doc").distinct()
    return r.alternative_docs(known, edges, docs, returned)


# Conversations


def messages(spark, d):
    c = load(spark, d, "conversations")
    return c.select("conv_id", "turn", "role", F.when((F.col("role") == "assistant") & (F.col("conv_id") % 2 == 0), F.concat("text", F.lit("?"))).otherwise(F.col("text")).alias("text"))


_M = "m AS (SELECT conv_id, turn, role, CASE WHEN role = 'assistant' AND conv_id % 2 = 0 THEN text || '?' ELSE text END AS text FROM conversations)"


@query("v1_session_messages", "SELECT conv_id, count(*) AS n, md5(string_agg(role || ':' || coalesce(text, ''), '|' ORDER BY turn)) AS h FROM conversations GROUP BY 1")
def v1(spark, d):
    s = v.session_messages(load(spark, d, "conversations"))
    return s.select("conv_id", F.size("messages").cast("long").alias("n"), F.md5(F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "|")).alias("h"))


@query("v2_last_messages", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 6")
def v2(spark, d):
    return v.last_messages(load(spark, d, "conversations"), 6).select("conv_id", "turn")


@query("v3_clarification_rounds")
def v3(spark, d):
    return v.session_messages(messages(spark, d)).select("conv_id", v.clarification_rounds(F.col("messages")).alias("rounds"))


def context(spark, d):
    text = F.array_join(F.transform(F.filter("messages", lambda x: x["role"] == "user"), lambda x: x["text"]), " ")
    known = v.session_messages(load(spark, d, "conversations")).select("conv_id", text.alias("text"))
    return known.select("conv_id", *v.known_context(F.col("text"), **_OWN))


#: Stands for the caller's equipment: words that the given texts hold.
_OWN = {
    "models": ((r"\b(in\s+the)\b", "In the"), (r"\b(le\s+[a-z]{2})\b", None), (r"\b(die\s+[a-z]{3})\b", None)),
    "boards": ((r"\b(and\s+[a-z]{4})\b", None), (r"\b(und|et)\b", None)),
    "drives": ((r"\b(de\s+la)\b", None), (r"\b(der\s+[a-z]{2,6})\b", None)),
}
_ALL = {"model": _OWN["models"], "board": _OWN["boards"], "drive": _OWN["drives"], **vocab.FACETS}


def _bounded(p):
    """The pattern with ends of words and white space as Java has them: RE2's know ASCII only, and no vertical tab."""
    p = p.replace(r"\s", r"[\s\x0B]")
    p = f"(?:^|{t.NOT_IN_WORD}){p[2:]}" if p.startswith(r"\b") else p
    return f"{p[:-2]}(?:$|{t.NOT_IN_WORD})" if p.endswith(r"\b") else p


def _facet(name):
    out = []
    for p, said in _ALL[name]:
        p = _bounded(p)
        value = f"'{said}'" if said else f"trim(regexp_extract(x, '{p}', 1))"
        value = value if said or name in v.LOWER else f"upper({value})"
        value = f"regexp_replace({value}, '[\\s\\x0B]+', '', 'g')" if name in v.SQUEEZED else value
        out.append(f"CASE WHEN regexp_matches(x, '{p}') THEN {value} END")
    return f"coalesce({', '.join(out)}) AS {name}"


_K = "u AS (SELECT conv_id, trim(strip_accents(lower(coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'user'), '')))) AS x FROM conversations GROUP BY 1), k AS (SELECT conv_id, " + ", ".join(map(_facet, _ALL)) + " FROM u)"


@query("v4_known_context", f"WITH {_K} SELECT * FROM k")
def v4(spark, d):
    return context(spark, d)


@query("v5_missing_info", f"WITH {_K} SELECT conv_id, concat_ws(',', CASE WHEN model IS NULL THEN 'model' END, CASE WHEN board IS NULL AND drive IS NULL THEN 'board or drive' END, CASE WHEN symptom IS NULL AND error_code IS NULL THEN 'symptom or error code' END) AS missing FROM k")
def v5(spark, d):
    return context(spark, d).select("conv_id", F.array_join(v.missing_info(), ",").alias("missing"))


@query("v6_enriched_query")
def v6(spark, d):
    s = v.session_messages(load(spark, d, "conversations")).select("conv_id", F.transform("messages", lambda x: x["text"]).alias("texts"))
    return s.select("conv_id", v.enriched_query(F.slice("texts", 1, F.size("texts") - 1), F.element_at("texts", -1)).alias("query"))


def _any(x, patterns):
    return f"regexp_matches({x}, '{t.any_word(patterns)}')"


_TECHNICAL = f"({_any('x', vocab.TECHNICAL)} OR regexp_matches(x, '(^|{t.NOT_IN_WORD})({'|'.join(vocab.TECHNICAL_BEGINNINGS)})'))"


@query("v7_needs_clarification", f"""WITH {_M}, a AS (SELECT conv_id, turn, role, strip_accents(lower(coalesce(text, ''))) AS x, count(*) OVER w >= 2 AND coalesce(contains(last_value(CASE WHEN role = 'assistant' THEN coalesce(text, '') END IGNORE NULLS) OVER w, '?'), false) AS asked FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  n AS (SELECT *, length(regexp_extract_all(x, '[^\\s]+')) AS n, {_any('x', vocab.MODEL_CODES)} AS code FROM a),
  h AS (SELECT *, coalesce(bool_or(role = 'user' AND code) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS told FROM n)
  SELECT conv_id, turn, CASE WHEN asked THEN false ELSE n <= 2 OR {_any('x', vocab.TROUBLE)} OR (n <= 4 AND {_any('x', vocab.GENERIC_INDICATORS)}) END AS needs, NOT code AND NOT told AND {_TECHNICAL} AND n > 2 AS needs_model FROM h WHERE role = 'user'""")
def v7(spark, d):
    text = F.coalesce("text", F.lit(""))
    rows = messages(spark, d).withColumn("code", (F.col("role") == "user") & v.has_model_code(text))
    w = Window.partitionBy("conv_id").orderBy("turn")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    asked = v.asked_before("role", text, earlier)
    told = F.coalesce(F.max("code").over(earlier), F.lit(False))
    rows = rows.withColumns({"asked": asked, "told": told}).where("role = 'user'")
    return rows.select("conv_id", "turn", v.needs_clarification(text, F.col("asked")).alias("needs"), v.needs_model(text, F.col("told")).alias("needs_model"))


@query("v8_sessions_by_agent", "SELECT coalesce(s_name, 'unknown') AS agent, count(*) AS sessions FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN supplier ON s_suppkey = conv_id % 150 GROUP BY 1")
def v8(spark, d):
    sessions = load(spark, d, "conversations").select("conv_id").distinct().select((F.col("conv_id") % 150).alias("s_suppkey"))
    return v.sessions_by_agent(sessions, load(spark, d, "supplier"), "s_suppkey", "s_name")


@query("v9_merge_pending", "WITH l AS (SELECT user_id AS id, event_id AS seq, CASE WHEN event_type = 'refund' OR event_id % 5 = 0 THEN 'delete' ELSE 'upsert' END AS op, value FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS n FROM l) SELECT id, seq, value FROM k WHERE n = 1 AND op <> 'delete'")
def v9(spark, d):
    log = load(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.when((F.col("event_type") == "refund") | (F.col("event_id") % 5 == 0), "delete").otherwise("upsert").alias("op"), "value")
    return v.merge_pending(log).select("id", "seq", "value")


# Usage


def _period(name, days):
    cur, prev = f"ts BETWEEN TIMESTAMP '{NOW}' - INTERVAL {days} DAY AND TIMESTAMP '{NOW}'", f"ts >= TIMESTAMP '{NOW}' - INTERVAL {2 * days} DAY AND ts < TIMESTAMP '{NOW}' - INTERVAL {days} DAY"
    return f"SELECT '{name}' AS period, n, n_before, value, round(CASE WHEN n_before <> 0 THEN (n - n_before)::DOUBLE / n_before * 100 WHEN n > 0 THEN 100 ELSE 0 END, 6) AS change FROM (SELECT count(*) FILTER ({cur}) AS n, count(*) FILTER ({prev}) AS n_before, round(coalesce(sum(value) FILTER ({cur}), 0), 4) AS value FROM events)"


@query("m1_period_metrics", " UNION ALL ".join(_period(n, k) for n, k in m.DAYS.items()))
def m1(spark, d):
    return m.period_metrics(load(spark, d, "events"), NOW)


@query("m2_queries_per_session", "SELECT conv_id, greatest(1, count(*) FILTER (role = 'user')) AS queries FROM conversations GROUP BY 1")
def m2(spark, d):
    return m.queries_per_session(load(spark, d, "conversations"))


@query("m3_change_and_churn", "SELECT event_type, a, b, round(CASE WHEN b <> 0 THEN (a - b)::DOUBLE / b * 100 WHEN a > 0 THEN 100 ELSE 0 END, 6) AS change FROM (SELECT event_type, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS a, count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS b FROM events GROUP BY 1)")
def m3(spark, d):
    late = F.col("ts") >= F.to_timestamp(F.lit("2024-01-16"))
    g = load(spark, d, "events").groupBy("event_type").agg(F.count_if(late).alias("a"), F.count_if(~late).alias("b"))
    return g.select("event_type", "a", "b", F.round(m.change(F.col("a"), F.col("b")), 6).alias("change"))


_PLANS = "(VALUES " + ", ".join(f"('{k}', {p}::DOUBLE, {'NULL' if n is None else n})" for k, (p, n) in vocab.PLANS.items()) + ") AS p(plan, price, daily_limit)"


@query("m4_plan_distribution", f"SELECT plan, count(c_custkey) AS n, floor(count(c_custkey) * 100.0 / (SELECT count(*) FROM customer) + 0.5)::BIGINT AS percent FROM {_PLANS} LEFT JOIN customer ON c_mktsegment = plan GROUP BY 1")
def m4(spark, d):
    return m.plan_distribution(load(spark, d, "customer"), m.plan_table(spark), "c_mktsegment")


@query("m5_top_agents", "WITH s AS (SELECT conv_id % 30 AS s_suppkey, greatest(1, count(*) FILTER (role = 'user')) AS queries FROM conversations GROUP BY conv_id) SELECT s.s_suppkey, coalesce(s_name, 'default') AS name, sum(queries)::BIGINT AS queries FROM s LEFT JOIN supplier ON supplier.s_suppkey = s.s_suppkey GROUP BY 1, 2 ORDER BY queries DESC, 1 LIMIT 5")
def m5(spark, d):
    sessions = m.queries_per_session(load(spark, d, "conversations")).select((F.col("conv_id") % 30).alias("s_suppkey"), "queries")
    return m.top_agents(sessions, load(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("name")), "s_suppkey")


@query("m6_revenue_by_method", f"SELECT coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'pix' WHEN c_custkey % 3 = 1 THEN 'boleto' END, 'card') AS method, round(sum(price), 2) AS revenue, count(*) AS users FROM customer JOIN {_PLANS} ON plan = c_mktsegment WHERE c_acctbal > 0 GROUP BY 1")
def m6(spark, d):
    users = load(spark, d, "customer").withColumn("method", F.when(F.col("c_custkey") % 3 == 0, "pix").when(F.col("c_custkey") % 3 == 1, "boleto"))
    return m.revenue_by_method(users, m.plan_table(spark), "c_mktsegment", "method", F.col("c_acctbal") > 0)


@query("m7_bucket_series", f"SELECT b AS bucket, (SELECT count(*) FROM events WHERE ts BETWEEN TIMESTAMP '{NOW}' - INTERVAL 1 DAY * (7 - b) AND TIMESTAMP '{NOW}' - INTERVAL 1 DAY * (6 - b)) AS n FROM (SELECT unnest(range(0, 7)) AS b)")
def m7(spark, d):
    return m.bucket_series(load(spark, d, "events"), NOW, "week")


def limits(spark, d):
    users = load(spark, d, "events").select("user_id").distinct()
    return users.select("user_id", F.when(F.col("user_id") % 4 != 0, F.col("user_id") % 4 * 2).cast("int").alias("daily_limit"))


@query("m8_quota_windows", """WITH RECURSIVE e AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, CASE WHEN user_id % 4 <> 0 THEN user_id % 4 * 2 END AS lim FROM events),
  f AS (SELECT user_id, k, lim, ts AS start, CASE WHEN lim = 0 THEN 0 ELSE 1 END AS used, CASE WHEN lim = 0 THEN 0 ELSE 1 END AS total, CASE WHEN lim = 0 THEN 1 ELSE 0 END AS blocked, 1 AS windows FROM e WHERE k = 1
    UNION ALL SELECT e.user_id, e.k, e.lim, CASE WHEN o THEN start ELSE e.ts END, CASE WHEN o THEN CASE WHEN used >= e.lim THEN used ELSE used + 1 END ELSE 1 END, total + CASE WHEN o AND used >= e.lim THEN 0 ELSE 1 END, blocked + CASE WHEN o AND used >= e.lim THEN 1 ELSE 0 END, windows + CASE WHEN o THEN 0 ELSE 1 END
    FROM (SELECT f.*, n.ts AS nts, n.ts < f.start + INTERVAL 24 HOUR AS o FROM f JOIN e n ON n.user_id = f.user_id AND n.k = f.k + 1) f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
  SELECT user_id, windows, total AS used, blocked FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k DESC) AS r FROM f) WHERE r = 1""")
def m8(spark, d):
    return m.quota_windows(load(spark, d, "events"), limits(spark, d))


@query("m9_quota_refunds")
def m9(spark, d):
    step = F.when(F.col("event_id") % 6 == 0, -1).otherwise(1)
    return m.quota_windows(load(spark, d, "events"), limits(spark, d), step=step)


@query("m10_credit_usage", "SELECT user_id, n, lim, round(CASE WHEN lim > 0 THEN least(100.0, n * 100.0 / lim) ELSE 0 END, 6)::DOUBLE AS percent, CASE WHEN lim IS NOT NULL THEN greatest(0, lim - n) ELSE 0 END AS remaining FROM (SELECT user_id, count(*) AS n, CASE WHEN user_id % 4 <> 0 THEN user_id % 4 * 40 END AS lim FROM events GROUP BY 1)")
def m10(spark, d):
    g = load(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).withColumn("lim", F.when(F.col("user_id") % 4 != 0, F.col("user_id") % 4 * 40))
    c = m.credit_usage(F.col("n"), F.col("lim"))
    return g.select("user_id", "n", "lim", F.round(c["percent"], 6).alias("percent"), c["remaining"].alias("remaining"))


@query("m11_user_search", "SELECT c_custkey FROM customer WHERE contains(lower(c_name || ' ' || c_mktsegment), '7 mach')")
def m11(spark, d):
    return m.user_search(load(spark, d, "customer"), "7 MACH", "c_name", "c_mktsegment").select("c_custkey")


@query("m12_merge_profiles", "WITH o AS (SELECT c_custkey AS id, lower(c_name) AS email, c_mktsegment AS plan FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE -c_custkey END AS id, lower(c_name) AS email, 'NEW' AS plan FROM customer WHERE c_custkey % 5 = 0) SELECT o.id, o.email, CASE WHEN o.id IN (SELECT id FROM n) OR o.email IN (SELECT email FROM n WHERE id NOT IN (SELECT id FROM o)) THEN 'NEW' ELSE o.plan END AS plan FROM o UNION ALL SELECT * FROM n WHERE id NOT IN (SELECT id FROM o) AND email NOT IN (SELECT email FROM o)")
def m12(spark, d):
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lower("c_name").alias("email"), F.col("c_mktsegment").alias("plan"))
    new = c.where("id % 5 = 0").select(F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(-F.col("id")).alias("id"), "email", F.lit("NEW").alias("plan"))
    return m.merge_profiles(c.where("id % 3 <> 0"), new)


# Evaluation: labels are cases (quality is what is expected), documents the answers


def answers(spark, d):
    """Documents as answers: some ask to choose at once or at their end, some ask with a strong marker."""
    k = F.col("doc_id")
    said = F.coalesce("text", F.lit(""))
    text = F.when(k % 4 == 0, F.concat(F.lit("Qual modelo? "), said)).when(k % 4 == 1, F.concat(said, F.lit(" Qual placa?"))).when(k % 8 == 2, F.concat(F.lit("Me informe o andar. "), said)).otherwise(said)
    rows = load(spark, d, "documents").select(k.alias("id"), text.alias("text"), F.array("source").alias("sources"), (k % 3).cast("int").alias("n"), (k % 11 == 0).alias("flagged"))
    return rows.withColumn("kind", e.classify_answer(F.col("text"), F.col("n"), F.col("flagged"))).drop("n")


def graded(spark, d):
    cases = load(spark, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 == 0, "DISAMBIGUATE").when(F.col("quality") == 1, "ANSWER").otherwise("CLARIFY").alias("expected"), F.format_string("c%d", F.col("doc_id") % 4).alias("category"), F.array(F.lit("license")).alias("terms"), F.array(F.lit("idiot")).alias("forbidden"), F.when(F.col("doc_id") % 2 == 0, F.array(F.format_string("SRC%d", F.col("doc_id") % 3))).alias("docs"))
    return e.grade_answers(cases, answers(spark, d).where("id % 10 <> 9"))


_A = f"""a AS (SELECT doc_id AS id, source, doc_id % 3 AS n, doc_id % 11 = 0 AS flagged, CASE WHEN doc_id % 4 = 0 THEN 'Qual modelo? ' || coalesce(text, '') WHEN doc_id % 4 = 1 THEN coalesce(text, '') || ' Qual placa?' WHEN doc_id % 8 = 2 THEN 'Me informe o andar. ' || coalesce(text, '') ELSE coalesce(text, '') END AS text FROM documents),
  h AS (SELECT *, lower(substr(text, 1, 500)) AS early, substr(text, 1, greatest(length(text) - 5, 0)) AS head FROM a),
  l AS (SELECT *, lower(substr(text, greatest(length(head) - length(string_split(head, '.')[-1]), 1) + 1)) AS last FROM h),
  b AS (SELECT id, text, source, flagged, CASE WHEN flagged OR regexp_matches(early, '{"|".join(vocab.CLARIFY_MARKERS)}') OR (n = 0 AND contains(early, '?')) OR (n > 0 AND regexp_matches(text, '\\?\\s*$') AND regexp_matches(last, '{"|".join(vocab.CHOICES)}')) THEN 'CLARIFY' ELSE 'ANSWER' END AS kind FROM l)"""
_G = _A + """, x AS (SELECT l.doc_id AS id, 'c' || (l.doc_id % 4) AS category, CASE WHEN l.doc_id % 5 = 0 THEN 'DISAMBIGUATE' WHEN quality = 1 THEN 'ANSWER' ELSE 'CLARIFY' END AS expected, kind, lower(text) AS low, flagged, lower(coalesce(source, '')) AS src FROM labels l LEFT JOIN b ON b.id = l.doc_id AND b.id % 10 <> 9),
  g AS (SELECT id, category, expected, kind, CASE WHEN kind IS NULL THEN 'error' WHEN contains(low, 'idiot') THEN 'fail' WHEN expected = 'CLARIFY' AND kind <> 'CLARIFY' THEN 'fail' WHEN expected = 'ANSWER' AND kind = 'CLARIFY' AND NOT contains(low, 'license') THEN 'fail' WHEN id % 2 = 0 AND NOT flagged AND NOT contains(src, 'src' || (id % 3)) AND NOT contains(low, 'src' || (id % 3)) THEN 'partial' ELSE 'pass' END AS grade FROM x)"""


@query("e1_classify_answer", f"WITH {_A} SELECT id, kind FROM b")
def e1(spark, d):
    return answers(spark, d).select("id", "kind")


@query("e2_grade_answers", f"WITH {_G} SELECT id, grade FROM g")
def e2(spark, d):
    return graded(spark, d).select("id", "grade")


@query("e3_eval_summary", f"WITH {_G} SELECT grade, count(id) AS n, round(count(id) * 100.0 / (SELECT count(*) FROM g), 4)::DOUBLE AS percent FROM (VALUES ('pass'), ('partial'), ('fail'), ('error')) v(grade) LEFT JOIN g USING (grade) GROUP BY 1")
def e3(spark, d):
    return e.eval_summary(graded(spark, d))


@query("e4_category_accuracy", f"WITH {_G} SELECT category, count(*) AS total, count(*) FILTER (grade IN ('pass', 'partial')) AS good, round(count(*) FILTER (grade IN ('pass', 'partial'))::DOUBLE / count(*), 6) AS accuracy FROM g GROUP BY 1")
def e4(spark, d):
    return e.category_accuracy(graded(spark, d))


@query("e5_failure_breakdown", f"WITH {_G} SELECT CASE WHEN expected = 'ANSWER' AND kind = 'CLARIFY' THEN 'over_clarify' WHEN expected = 'CLARIFY' AND kind = 'ANSWER' THEN 'under_clarify' ELSE 'other' END AS failure, count(*) AS n FROM g WHERE grade = 'fail' GROUP BY 1")
def e5(spark, d):
    return e.failure_breakdown(graded(spark, d))


@query("e6_behaviour_accuracy", f"WITH {_G} SELECT expected, count(*) AS n, count(*) FILTER (expected = kind) AS right, round(avg(id % 13), 6) AS mean_elapsed FROM g GROUP BY 1".replace("AS right", 'AS "right"'))
def e6(spark, d):
    return e.behaviour_accuracy(graded(spark, d).withColumn("elapsed", F.col("id") % 13))


@query("e7_search_hit_check", f"WITH {_DIV}, w AS (SELECT query_id, query_id % 97 AS doc_id FROM q), o AS (SELECT query_id, min(rank) AS rank, min(score) AS low, max(score) AS high FROM f JOIN w USING (query_id, doc_id) WHERE rank <= 7 GROUP BY 1) SELECT query_id, coalesce(rank <= 3, false) AS hit, rank, round(coalesce(1.0 / rank, 0), 6)::DOUBLE AS reciprocal, round(low, 6) AS low, round(high, 6) AS high FROM w LEFT JOIN o USING (query_id)")
def e7(spark, d):
    wanted = query_rows(spark, d).select("query_id", (F.col("query_id") % 97).alias("doc_id"))
    return e.search_hit_check(ranked(spark, d), wanted, 3)


# Change of state, as a batch


@query("st4_status_changes", "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS DISTINCT FROM event_type")
def st4(spark, d):
    from ..streaming.jobs import status_changes

    return status_changes(load(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


#: Ends of a key's rows in the queries that stop at one.
_END = ("purchase", "signup")
_ENDED = "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER w AS before, coalesce(bool_or(event_type IN ('purchase', 'signup')) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ended FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE before IS DISTINCT FROM event_type AND NOT ended"


@query("st4_until_the_end", _ENDED)
def st4_end(spark, d):
    from ..streaming.jobs import status_changes

    return status_changes(load(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"], _END).select("user_id", "event_id", "event_type")


# Streams that read what is there and end


def _ended(stream, name):
    """What a stream over the table's files makes, as a table."""
    from ..sources.scratch import folder

    spark, out = stream.sparkSession, folder(stream.sparkSession, name)
    q = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def _arriving(spark, d, name):
    """A table of the given folder, one file or a folder of them, as a stream of its files."""
    # A pattern, as a stream over a plain path has to be over a folder.
    return spark.readStream.schema(load(spark, d, name).schema).parquet(f"{d}/{name}[.]parquet")


@query("st1_stream_quota", """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, CASE WHEN user_id % 4 <> 0 THEN user_id % 4 * 2 END AS lim FROM events),
  f AS (SELECT user_id, event_id, k, ts AS start, CASE WHEN lim = 0 THEN 0 ELSE 1 END AS used, coalesce(lim > 0, true) AS allowed FROM e WHERE k = 1
    UNION ALL SELECT n.user_id, n.event_id, n.k, CASE WHEN n.ts < f.start + INTERVAL 24 HOUR THEN f.start ELSE n.ts END, CASE WHEN n.ts < f.start + INTERVAL 24 HOUR THEN CASE WHEN used >= n.lim THEN used ELSE used + 1 END ELSE CASE WHEN n.lim = 0 THEN 0 ELSE 1 END END,
      CASE WHEN n.ts < f.start + INTERVAL 24 HOUR THEN coalesce(used < n.lim, true) ELSE coalesce(n.lim > 0, true) END FROM f JOIN e n ON n.user_id = f.user_id AND n.k = f.k + 1)
  SELECT user_id, event_id, allowed FROM f""")
def st1(spark, d):
    from ..streaming.jobs import stream_quota

    limit = F.when(F.col("user_id") % 4 != 0, F.col("user_id") % 4 * 2).cast("int")
    return _ended(stream_quota(_arriving(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), limit.alias("daily_limit"))), "quota")


@query("st4_stream_status", _ENDED)
def st4_stream(spark, d):
    from ..streaming.jobs import stream_status

    events = _arriving(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return _ended(stream_status(events, "event_type", _END), "status")


def _ingested(spark, d):
    """Documents as arriving pages, and the store that they are ingested to."""
    from ..sources.scratch import folder
    from ..streaming.jobs import stream_ingest

    out = folder(spark, "ingest")
    pages = _arriving(spark, d, "documents").select(F.col("source").alias("brand"), "doc_id", F.col("lang").alias("name"), F.lit(1).alias("page"), "text")
    stream_ingest(pages, f"{out}/store", f"{out}/check").awaitTermination()
    return f"{out}/store"


@query("st2_stream_ingest")
def st2(spark, d):
    return read_chunks(spark, _ingested(spark, d)).select("brand_slug", "doc_id", "chunk_index", "chunk_total", F.md5("text").alias("h"))


@query("st2_ingest_status", "SELECT source AS brand_slug, doc_id, CASE WHEN length(coalesce(text, '')) > 0 THEN 'indexed' ELSE 'error' END AS status FROM documents")
def st2_status(spark, d):
    docs = load(spark, d, "documents").select(F.col("source").alias("brand_slug"), "doc_id")
    return document_status(spark, _ingested(spark, d), docs).select("brand_slug", "doc_id", "status")


@query("st3_stream_dedupe", f"SELECT DISTINCT own AS brand, name AS norm FROM (SELECT own, {FILE_NORM.format(x='name')} AS name FROM (SELECT source AS own, {FIRST} AS name FROM documents WHERE doc_id % 3 <> 0)) n WHERE name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM documents o WHERE o.doc_id % 3 = 0 AND o.source = n.own AND {FILE_NORM.format(x='string_split(o.text, chr(10))[1]')} = n.name)")
def st3(spark, d):
    from ..streaming.jobs import stream_dedupe

    names = lambda df: df.select(F.col("source").alias("brand"), F.split("text", "\n")[0].alias("name"), "doc_id")
    existing = names(load(spark, d, "documents")).where("doc_id % 3 = 0")
    arriving = names(_arriving(spark, d, "documents")).where("doc_id % 3 <> 0 AND name IS NOT NULL")
    return _ended(stream_dedupe(arriving, existing, "name", "brand").select("brand", "norm"), "dedupe")
