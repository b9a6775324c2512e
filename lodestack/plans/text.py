"""Queries of the text rules, over documents, pages and parts, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import vocab
from ..sources.tables import load

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def norm(x: str, extra: str = "") -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower({x})), '[.\-_/\\{extra}]', ' ', 'g'), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"


def uniq(x: str) -> str:
    return f"list_filter({x}, lambda x, i: list_position({x}, x) = i)"


def in_list(x: str, values) -> str:
    return f"{x} IN ({', '.join(repr(v) for v in values)})"


def words(x: str) -> str:
    return rf"regexp_split_to_array({x}, '[^\p{{L}}\p{{N}}_]+')"


FILE_NORM = r"trim(regexp_replace(regexp_replace(lower(strip_accents(regexp_replace(regexp_replace(trim({x}), '(?i)\.pdf$', ''), '^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}_', ''))), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
#: Java's upper case of sharp s; DuckDB keeps it.
UP = "upper(replace(text, 'ß', 'SS'))"
FIRST = "string_split(text, chr(10))[1]"


@query("t1_normalize_filename", f"SELECT page_id, {FILE_NORM.format(x='url')} AS name FROM pages UNION ALL SELECT -1 - doc_id, {FILE_NORM.format(x=FIRST + chr(124) * 2 + repr('.PDF'))} FROM documents WHERE text IS NOT NULL")
def t1(spark, d):
    pages = load(spark, d, "pages").select("page_id", t.normalize_filename("url").alias("name"))
    docs = load(spark, d, "documents").where(F.col("text").isNotNull())
    first = F.concat(F.split("text", "\n")[0], F.lit(".PDF"))
    return pages.unionByName(docs.select((-1 - F.col("doc_id")).alias("page_id"), t.normalize_filename(first).alias("name")))


@query("t2_normalize_for_matching", f"SELECT doc_id, md5({norm('text')}) AS h, length({norm('text')}) AS n FROM documents")
def t2(spark, d):
    n = t.normalize_for_matching("text")
    return load(spark, d, "documents").select("doc_id", F.md5(n).alias("h"), F.length(n).alias("n"))


@query("t3_slugify", "SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(" + FIRST + ")), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'brand') AS slug FROM documents")
def t3(spark, d):
    return load(spark, d, "documents").select("doc_id", t.slugify(F.split("text", "\n")[0]).alias("slug"))


@query("t4_unique_slugs", """WITH s AS (SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part),
  r AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS k FROM s) SELECT p_partkey, CASE WHEN k = 1 THEN slug ELSE slug || '-' || k END AS slug FROM r""")
def t4(spark, d):
    from ..operators.audit import unique_slugs

    return unique_slugs(load(spark, d, "part"), "p_partkey", "p_name").select("p_partkey", "slug")


@query("t5_key_tokens", f"SELECT doc_id, array_to_string(list_filter(string_split({norm('text')}, ' '), lambda w: length(w) >= 2 AND NOT {in_list('w', vocab.STOP_WORDS)}), ' ') AS tokens FROM documents")
def t5(spark, d):
    return load(spark, d, "documents").select("doc_id", F.array_join(t.key_tokens("text"), " ").alias("tokens"))


@query("t6_search_keywords")
def t6(spark, d):
    return load(spark, d, "conversations").select("conv_id", "turn", F.array_join(t.search_keywords("text"), "|").alias("keywords"))


FAULTS = f"list_filter(list_transform(list_filter({words('lower(text)')}, lambda w: regexp_full_match(w, '[a-z]{{1,5}}[0-9]{{0,3}}')), lambda w: upper(w)), lambda w: regexp_matches(w, '[0-9]') OR {in_list('w', vocab.FAULT_HINTS)})"


@query("t7_fault_tokens", f"WITH f AS (SELECT doc_id, {FAULTS} AS l FROM documents) SELECT doc_id, array_to_string({uniq('l')}, ' ') AS tokens FROM f")
def t7(spark, d):
    return load(spark, d, "documents").select("doc_id", F.array_join(t.fault_tokens("text"), " ").alias("tokens"))


_TOPIC = " || ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN '{k} ' ELSE '' END" for k, p in vocab.TOPICS.items())


@query("t8_domain_signals", f"""WITH d AS (SELECT doc_id, substr(coalesce(text, ''), 1, 6000) AS text FROM documents),
  l AS (SELECT doc_id, {norm('text', chr(92) + 's')} AS t, {FAULTS} AS f, list_filter({words(UP)}, lambda w: regexp_full_match(w, '[A-Z]{{2,6}}[0-9]{{1,5}}[A-Z]{{0,3}}') AND NOT {in_list('w', vocab.NOT_CONTROLLERS)}) AS c,
        list_transform(regexp_extract_all(upper(strip_accents(text)), '{vocab.VERSION}', 1), lambda v: replace(v, ' ', '')) AS v FROM d)
  SELECT doc_id, trim({_TOPIC}) AS topics, array_to_string({uniq('c')}[1:20], ' ') AS controllers, array_to_string({uniq('f')}[1:20], ' ') AS faults, array_to_string({uniq('v')}[1:20], ' ') AS versions FROM l""")
def t8(spark, d):
    s = load(spark, d, "documents").select("doc_id", t.domain_signals("text").alias("s"))
    return s.select("doc_id", F.array_join("s.topics", " ").alias("topics"), F.array_join("s.controller_tokens", " ").alias("controllers"), F.array_join("s.fault_tokens", " ").alias("faults"), F.array_join("s.model_version_tokens", " ").alias("versions"))


@query("t9_query_identifiers")
def t9(spark, d):
    return load(spark, d, "conversations").select("conv_id", "turn", F.array_join(t.query_identifiers("text"), "|").alias("identifiers"))


HAS_FAULT = "(regexp_matches({u}, '" + "|".join(vocab.FAULT_HINTS) + "') OR length(list_filter(" + words('{u}').replace('{L}', '{{L}}').replace('{N}', '{{N}}') + ", lambda w: regexp_full_match(w, '[A-Z]{{1,4}}[0-9]{{0,3}}'))) > 0)"
HAS_FAULT = HAS_FAULT.replace('{u}', "upper(replace({x}, 'ß', 'SS'))")


@query("t10_has_fault_code", f"SELECT doc_id, count(*) AS lines, count(*) FILTER ({HAS_FAULT.format(x='line')}) AS hits FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) GROUP BY doc_id")
def t10(spark, d):
    lines = load(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.split("text", "\n").alias("l"))
    return lines.select("doc_id", F.size("l").cast("long").alias("lines"), F.size(F.filter("l", lambda x: t.has_fault_code(x))).cast("long").alias("hits"))


@query("t11_display_name", "SELECT page_id, regexp_replace(CASE WHEN length(s) > 37 AND substr(s, 9, 1) = '-' AND substr(s, 37, 1) = '_' THEN substr(s, 38) ELSE s END, '\\.[^.]*$', '') AS name FROM (SELECT page_id, string_split(url, '/')[-1] AS s FROM pages)")
def t11(spark, d):
    return load(spark, d, "pages").select("page_id", t.display_name("url").alias("name"))


#: The brands that questions may name, the patterns of a caller's products and manuals: stand-ins that the texts have.
BRANDS, NAMES, MANUALS = ("the", "der", "de", "license"), (r"mit\s+license",), (r"manual\s*geral",)


def _any(x: str, patterns) -> str:
    return f"regexp_matches({x}, '{t.any_word(patterns)}')"


@query("t12_intent_flags", f"""WITH q AS (SELECT doc_id, lower(coalesce(lang, '')) AS own, strip_accents(lower(coalesce(text, ''))) AS t FROM documents),
  b AS (SELECT *, list_filter([{', '.join(f"'{b}'" for b in BRANDS)}], lambda b: regexp_matches(t, '(^|{t.NOT_IN_WORD})' || b || '($|{t.NOT_IN_WORD})')) AS named FROM q)
  SELECT doc_id, {in_list(r"trim(regexp_replace(t, '[!?.\s]+', ' ', 'g'))", vocab.GREETINGS)} AS greeting, length(named) > 0 AND length(list_filter(named, lambda b: contains(own, b) OR contains(b, own))) = 0 AS cross_brand,
    {_any("replace(t, '+', ' ')", (*vocab.MODEL_CODES, *NAMES))} AS identifier, regexp_matches(t, '{"|".join(vocab.META_DOCS)}') AS meta_docs, {_any('t', (*vocab.GENERAL_MANUAL, *MANUALS))} AS general_manual,
    {_any('t', vocab.DOOR)} AND regexp_matches(t, '{vocab.DOOR_CYCLE}|{vocab.NO_START}') AS door_cycle, {_any('t', vocab.TECHNICAL)} OR regexp_matches(t, '(^|{t.NOT_IN_WORD})({"|".join(vocab.TECHNICAL_BEGINNINGS)})') AS technical FROM b""")
def t12(spark, d):
    flags = t.intent_flags("text", "lang", BRANDS, NAMES, MANUALS)
    return load(spark, d, "documents").select("doc_id", flags.alias("f")).select("doc_id", "f.*")


ALIASES = {"error": ("fault", "failure"), "the": ("der", "la")}


@query("t13_expand_query", f"""WITH q AS (SELECT doc_id, substr(text, 1, 200) AS t, replace({norm('substr(text, 1, 200)')}, ' ', '') AS c FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, t || {" || ".join(f"CASE WHEN contains(c, '{k}') AND NOT contains(c, '{m}') THEN ' {m}' ELSE '' END" for k, v in ALIASES.items() for m in v)} AS q FROM q""")
def t13(spark, d):
    docs = load(spark, d, "documents").where(F.col("text").isNotNull())
    return docs.select("doc_id", t.expand_query(F.substring("text", 1, 200), ALIASES).alias("q"))


@query("t13_expand_whole_text")
def t13_whole(spark, d):
    docs = load(spark, d, "documents").where(F.col("text").isNotNull())
    return docs.select("doc_id", t.expand_query("text", ALIASES).alias("q"))


@query("t14_rewrite_flags", f"""WITH w AS (SELECT doc_id, lower(text) AS low, strip_accents(lower(text)) AS t FROM documents WHERE text IS NOT NULL),
  f AS (SELECT doc_id, contains(low, chr(65533)) AS broken, regexp_matches(low, '{t.SHORT_WORDS}') AS short_words, {" + ".join(f"{_any('t', [m])}::INT" for m in vocab.FOREIGN_MARKERS)} >= 2 AS foreign, regexp_matches(low, chr(128196) || '{t.BLANK}*fuente') AS cited FROM w)
  SELECT *, broken OR short_words OR "foreign" OR cited AS rewrite FROM f""".replace("AS foreign", 'AS "foreign"'))
def t14(spark, d):
    docs = load(spark, d, "documents").where(F.col("text").isNotNull())
    return docs.select("doc_id", t.rewrite_flags("text").alias("f")).select("doc_id", "f.*")


@query("t15_bad_question", """WITH q AS (SELECT conv_id, turn, trim(coalesce(text, '')) AS c FROM conversations UNION ALL SELECT conv_id, turn + 1000, trim(coalesce(text, '') || '?') FROM conversations)
  SELECT conv_id, turn, c = '' OR length(regexp_split_to_array(c, '\\s+')) < 5 OR NOT ends_with(c, '?') OR length(replace(c, '(', '')) <> length(replace(c, ')', '')) OR regexp_matches(lower(c), '\\b(of|the|de|la|to|in)\\s*\\?$') AS bad FROM q""")
def t15(spark, d):
    q = load(spark, d, "conversations").select("conv_id", "turn", "text")
    q = q.unionByName(q.select("conv_id", (F.col("turn") + 1000).alias("turn"), F.concat(F.coalesce("text", F.lit("")), F.lit("?")).alias("text")))
    return q.select("conv_id", "turn", t.bad_question("text").alias("bad"))


@query("t16_clean_answer", r"SELECT conv_id, turn, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), ' +([?.,])', '\1', 'g'))) AS h FROM conversations")
def t16(spark, d):
    return load(spark, d, "conversations").select("conv_id", "turn", F.md5(t.clean_answer("text")).alias("h"))


@query("t17_context_snippet", "WITH p AS (SELECT doc_id, text, strpos(lower(text), 'license') AS hit FROM documents) SELECT doc_id, translate(substr(text, greatest(hit - 100, 1), hit - greatest(hit - 100, 1) + 200), chr(10), ' ') AS snippet FROM p WHERE hit > 0")
def t17(spark, d):
    out = load(spark, d, "documents").select("doc_id", t.context_snippet("text", "license").alias("snippet"))
    return out.where(F.col("snippet").isNotNull())


@query("t18_blocked_agents", f"SELECT s_suppkey, s_name FROM supplier WHERE NOT (s_suppkey IN (3, 7) OR contains({norm('s_name')}, '00001'))")
def t18(spark, d):
    from ..operators.audit import drop_blocked

    return drop_blocked(load(spark, d, "supplier"), "s_suppkey", ("s_name",), ids=(3, 7), terms=("00001",)).select("s_suppkey", "s_name")


@query("q1_length_quality", "SELECT doc_id, CASE WHEN n < 50 THEN 0.1 WHEN n < 200 THEN 0.4 WHEN n < 500 THEN 0.7 ELSE least(1.0, n / 2000.0) END::DOUBLE AS q FROM (SELECT doc_id, length(text) AS n FROM documents)")
def q1(spark, d):
    return load(spark, d, "documents").select("doc_id", t.length_quality("text").alias("q"))


def _has_code(k: int) -> str:
    return f"length(list_filter(l, lambda w: regexp_full_match(w, '[a-z]{{1,{k}}}[0-9]{{1,3}}'))) > 0"


@query("q2_extraction_score", f"""WITH p AS (SELECT doc_id, text, lower(text) AS low, {words('lower(text)')} AS l FROM documents),
  s AS (SELECT doc_id, length(text) AS n, (length(text) - length(replace(text, '|', '')) >= 8 OR regexp_matches(low, '{"|".join(vocab.TABLE_PHRASES)}')) AS tab, {_has_code(4)} AS code, {_has_code(3)} AS code3, regexp_matches(low, '{"|".join(vocab.GENERIC_PHRASES)}') AS stock FROM p)
  SELECT doc_id, CASE WHEN coalesce(n, 0) = 0 THEN 0.0 ELSE round(greatest(0.0, least(1.0, least(1.0, n / 3500.0::DOUBLE) + CASE WHEN tab THEN 0.25 ELSE 0 END + CASE WHEN code THEN 0.2 ELSE 0 END - CASE WHEN stock AND (n < 900 OR NOT code3) THEN 0.35 ELSE 0 END)), 6) END::DOUBLE AS score FROM s""")
def q2(spark, d):
    return load(spark, d, "documents").select("doc_id", F.round(t.extraction_score("text"), 6).alias("score"))


@query("q3_readable_gate", r"""WITH p AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS l FROM documents WHERE text IS NOT NULL),
  s AS (SELECT doc_id, length(text) AS c, length(l) AS n, length(text) - length(replace(text, '|', '')) AS pipes, length(list_filter(l, lambda w: length(w) > 25)) AS long, coalesce(list_sum(list_transform(l, lambda w: length(w))), 0) AS chars, length(regexp_replace(text, '\P{L}', '', 'g')) AS letters,
    (length(text) - length(replace(text, 'Ôö', ''))) / 2 + (length(text) - length(replace(text, 'Ôäó', ''))) / 3 + (length(text) - length(replace(text, 'ÔöÔö', ''))) / 4 AS boxes FROM p)
  SELECT doc_id, CASE WHEN c < 200 THEN 'short' WHEN n < 5 THEN 'few_words' WHEN pipes >= 6 THEN 'table' WHEN long > greatest(2, n * 0.08) THEN 'merged_words' WHEN boxes > 4 THEN 'box_marks' WHEN chars / n > 14 THEN 'long_words' WHEN letters / c < 0.35 THEN 'few_letters' ELSE 'ok' END AS reason FROM s""")
def q3(spark, d):
    return load(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", t.readable_gate("text").alias("reason"))


@query("q4_best_extraction", """WITH c AS (SELECT n_chars % 97 AS page, doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL), r AS (SELECT *, CASE WHEN n >= 2000 THEN 1 WHEN n >= 200 THEN 2 ELSE 3 END AS tier FROM c),
  k AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY tier, n DESC, doc_id) AS rn FROM r) SELECT page, doc_id, tier FROM k WHERE rn = 1""")
def q4(spark, d):
    from ..operators.chunking import best_extraction

    n = F.length("text")
    tier = F.when(n >= 2000, 1).when(n >= 200, 2).otherwise(3)
    rows = load(spark, d, "documents").where(F.col("text").isNotNull()).select((F.col("n_chars") % 97).alias("page"), "doc_id", tier.alias("tier"), n.alias("n"))
    return best_extraction(rows, ["page"], ["tier", F.desc("n"), "doc_id"]).select("page", "doc_id", "tier")


@query("q5_cap_text", "SELECT doc_id, length(substr(text, 1, 5000)) AS n, md5(substr(text, 1, 5000)) AS h FROM documents")
def q5(spark, d):
    capped = F.substring("text", 1, 5000)
    return load(spark, d, "documents").select("doc_id", F.length(capped).alias("n"), F.md5(capped).alias("h"))


@query("q6_suspicious_chars", "SELECT doc_id, length(regexp_replace(text, '[\\x00-\\x7FàáâãäçèéêëìíîïñòóôõöùúûüßÀÁÂÃÄÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜ]', '', 'g')) AS n FROM documents")
def q6(spark, d):
    return load(spark, d, "documents").select("doc_id", t.suspicious_chars("text").alias("n"))


@query("a14_mention_counts", f"SELECT w AS mention, count(*) AS n, count(DISTINCT source) AS sources FROM (SELECT source, unnest(list_filter({words(UP)}, lambda w: regexp_full_match(w, '[A-Z]{{1,6}}[0-9]{{1,5}}[A-Z]{{0,3}}'))) AS w FROM documents) GROUP BY 1")
def a14(spark, d):
    from ..operators.audit import mention_counts

    return mention_counts(load(spark, d, "documents"), "text", "source", "^[A-Z]{1,6}[0-9]{1,5}[A-Z]{0,3}$")


@query("a15_source_hits", """WITH h AS (SELECT source, doc_id FROM documents WHERE contains(lower(text), 'license')), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY source) AS hits FROM h)
  SELECT source, hits, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS first_ids FROM r WHERE k <= 3 GROUP BY source, hits""")
def a15(spark, d):
    from ..operators.audit import source_hits

    return source_hits(load(spark, d, "documents").where(F.lower("text").contains("license")), "source", "doc_id", 3)


@query("r6_keyword_candidates", "SELECT DISTINCT b.item_id, d.source, d.doc_id FROM (SELECT item_id, unnest(list_distinct(string_split(lower(text), ' '))) AS k FROM benchmark) b JOIN documents d ON contains(lower(d.text), b.k) WHERE length(b.k) >= 12")
def r6(spark, d):
    from ..operators.retrieval import keyword_candidates

    keys = load(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("keyword")).where(F.length("keyword") >= 12)
    return keyword_candidates(keys, load(spark, d, "documents"), "item_id").select("item_id", "source", "doc_id")


