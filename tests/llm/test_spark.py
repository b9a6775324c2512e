"""The operators on small tables: nulls, empties, repeats, clashing names, brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import bpe, chat, factorisation, jaccard, line_dedup, mixing, pii, quality_rules, rp_forest, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, pos int, `key` string, label int"


def docs_of(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or {}).get(i, "s"), len(t or ""), 1, "k", 2) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, repeats, a long text and columns whose names operators use inside."""
    words = " ".join(random.Random(7).choices([f"w{i}" for i in range(400)], k=20_000))
    return docs_of(spark, [(1, None), (2, ""), (3, "one line that stands in many documents\nx"), (4, "One line that stands in many documents \ny"), (5, "one line that stands in many documents"), (6, words), (6, words), (7, " \n\t"), (None, "no id here but some words")])


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, []).limit(0)


def test_line_dedup(odd, none):
    out = line_dedup.dedup_lines(odd)
    assert out.columns == odd.columns + list(line_dedup.ADDED)
    got = {r["doc_id"]: r for r in out.collect()}
    assert [got[i]["ll_text"] for i in (1, 2, 3, 4, 5)] == ["", "", "x", "y", "one line that stands in many documents"]
    assert (got[3]["ll_lines"], got[3]["ll_dropped"], got[1]["ll_lines"]) == (2, 1, 1)
    assert got[6]["ll_dropped"] == 0 and got[None]["ll_text"] == "no id here but some words"
    assert line_dedup.dedup_lines(none).count() == 0


def test_line_dedup_counts_documents_not_lines(spark):
    line = "a line of more than twenty characters"
    out = line_dedup.dedup_lines(docs_of(spark, [(1, f"{line}\n{line}\n{line}"), (2, line), (2, line)]))
    assert sum(r["ll_dropped"] for r in out.collect()) == 0


def test_bpe_round_trip(odd, none):
    path = bpe.tokenizer_path()
    out = bpe.bpe_decode(bpe.bpe_encode(odd, path), path)
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["bpe_ids"] == got[2]["bpe_ids"] == [] and got[1]["bpe_text"] == ""
    assert got[3]["bpe_text"].replace(" ", "").replace("</w>", " ").split() == "one line that stands in many documents x".split()
    assert bpe.bpe_encode(none, path).count() == 0


def test_bpe_decodes_as_the_library(spark):
    from tokenizers import Tokenizer

    path, rng = bpe.tokenizer_path(), random.Random(2)
    own = Tokenizer.from_file(path)
    texts = ["", "Hello  World", "a<|endoftext|>b", "ß\u0301é 12 \U0001f642\n"] + ["".join(rng.choice(["ab", " ", "é", "x1", "\n", "!?"]) for _ in range(40)) for _ in range(50)]
    got = {r["doc_id"]: r for r in bpe.bpe_decode(bpe.bpe_encode(docs_of(spark, list(enumerate(texts))), path), path).collect()}
    for i, t in enumerate(texts):
        want = own.encode(t, add_special_tokens=False).ids
        assert got[i]["bpe_ids"] == want and got[i]["bpe_text"] == own.decode(want, skip_special_tokens=False)
    both = bpe.bpe_round_trip(docs_of(spark, list(enumerate(texts))).withColumn("bpe_ids", F.lit("clash")), path)
    assert {r["doc_id"]: (r["bpe_ids"], r["bpe_text"]) for r in both.collect()} == {i: (r["bpe_ids"], r["bpe_text"]) for i, r in got.items()}


def test_ledger_and_ablations(odd, none):
    rows = quality_rules.apply_policy(quality_rules.ledger(odd))
    assert {r["doc_id"]: r["kept"] for r in rows.select("doc_id", "kept").collect()}[6]
    table = {r["rule"]: r for r in quality_rules.ablations(rows).collect()}
    assert table["few_words"]["failed"] == 7 and table["few_words"]["docs"] == 9 and table["few_words"]["kept_by_policy"] == 2
    bits = [r["qr_fails"] for r in rows.select("qr_fails").collect()]
    assert table["few_words"]["failed_alone"] == sum(b == 1 for b in bits)
    assert quality_rules.ledger(none).count() == 0
    # Columns named as what the ledger adds are replaced, others stay.
    clash = odd.withColumns({"n_words": F.lit("x"), "qr_fails": F.lit("x"), "kept": F.lit("x")})
    assert {r["doc_id"]: r["n_words"] for r in quality_rules.apply_policy(quality_rules.ledger(clash)).collect()}[3] == 8


def brute_components(texts):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("hot", [2000, 3])
def test_jaccard_matches_brute_force(spark, monkeypatch, hot):
    """A chain of edits, copies, short texts and strangers; with a low mark for hot shingles they are all dealt out."""
    monkeypatch.setattr(jaccard, "HOT", hot)
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(90)]
    texts, words = [], list(base)
    for i in range(30):
        if i % 3 == 0:
            words[rng.randrange(len(words))] = f"e{i}"
        texts.append((i, " ".join(words)))
    for i in range(30, 60):
        w = list(base)
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts.append((i, " ".join(w)))
    texts += [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(60))) for i in range(60, 80)]
    texts += [(80, None), (81, ""), (82, "a b"), (83, "A  b"), (84, "a b c"), (85, texts[70][1].upper())]
    got = {r["doc_id"]: (r["jc_shingles"], r["jc_component"]) for r in jaccard.jaccard_components(docs_of(spark, texts)).collect()}
    assert got == brute_components(texts)


@pytest.mark.parametrize("hot", [2000, 5])
def test_jaccard_settles_a_group_that_is_linked_here_and_there(spark, monkeypatch, hot):
    """Edits of edits: few pairs link, centres settle some, the rest are compared exhaustively, no pair twice."""
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "CHEAP", 0)  # centres are looked for however little there is to do
    compared, plain = [], jaccard.verify

    def watched(docs, nodes, pairs, width, percent):
        compared.extend((r["a"], r["b"]) for r in pairs.collect())
        return plain(docs, nodes, pairs, width, percent)

    monkeypatch.setattr(jaccard, "verify", watched)
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = []
    for i in range(150):
        w = list(base if i % 5 else texts[rng.randrange(len(texts))][1].split() if texts else base)
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        texts.append((i, " ".join(w)))
    want = brute_components(texts)
    assert 10 < len({c for _, c in want.values()}) < 140
    got = {r["doc_id"]: (r["jc_shingles"], r["jc_component"]) for r in jaccard.jaccard_components(docs_of(spark, texts)).collect()}
    assert got == want and len(set(compared)) == len(compared)


def test_jaccard_without_rows(none):
    assert jaccard.jaccard_components(none).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (7, 7), (200, 201)], "a long, b long")
    got = {r["node"]: r["comp"] for r in jaccard.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 200: 200, 201: 200}


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_forest_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16))
    x = np.vstack([x] + [x[:40] + rng.normal(scale=0.05, size=(40, 16)) for _ in range(4)])
    rows = [(i, [float(c) for c in v], int(i % 2)) for i, v in enumerate(x.astype(np.float32))]
    out = rp_forest.near_vectors(vectors_of(spark, rows), leaf=60, depth=2, trees=8)
    got = {r["vec_id"]: r for r in out.collect()}
    y = np.array([r[1] for r in rows])
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    s = (y @ y.T >= 0.93) & (np.arange(len(y))[:, None] % 2 == np.arange(len(y))[None, :] % 2)
    want = s.sum(axis=1) - 1
    links = np.array([got[i]["rp_links"] for i in range(len(y))])
    assert (links <= want).all() and links.sum() >= 0.9 * want.sum() > 0


def test_forest_finds_links_of_a_large_group(spark, monkeypatch):
    """3,000 distinct near copies, a third of all rows: found around their centre, and by leaves that are not split."""
    rng = np.random.default_rng(4)
    centre = rng.normal(size=64)
    x = np.vstack([centre + rng.normal(scale=0.24, size=(3000, 64)), rng.normal(size=(6000, 64))]).astype(np.float32)
    rows = [(i, v.tolist(), int(i >= 3000 and i % 3)) for i, v in enumerate(x)]
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    want = ((y @ y.T >= 0.93) & (label[:, None] == label[None, :])).sum(axis=1) - 1
    table = vectors_of(spark, rows).cache()
    got = {r["vec_id"]: r["rp_links"] for r in rp_forest.near_vectors(table).collect()}
    links = np.array([got[i] for i in range(len(rows))])
    assert (links <= want).all() and links.sum() >= 0.999 * want.sum() > 3_000_000
    # Without the search for centres, a leaf that the group fills is compared whole.
    monkeypatch.setattr(rp_forest, "CANDIDATES", 0)
    alone = rp_forest.near_vectors(table.where("vec_id < 3000"), depth=0, trees=2).collect()
    assert {r["vec_id"]: r["rp_links"] for r in alone} == {i: int((y[:3000] @ y[i] >= 0.93).sum()) - 1 for i in range(3000)}


def test_forest_knows_rare_dimensions(spark):
    """A dimension with two vectors among hundreds, and a sample of ten: its link is found."""
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(rng.normal(size=(300, 16)).astype(np.float32))] + [(900, [1.0, 0.0, 0.5], 1), (901, [1.0, 0.01, 0.5], 1)]
    got = {r["vec_id"]: (r["rp_links"], r["rp_component"]) for r in rp_forest.near_vectors(vectors_of(spark, rows), fit_rows=10).collect()}
    assert got[900] == (1, 900) and got[901] == (1, 900)


def links_by_hand(t):
    """vec_id to its number of links, from all products of each label and length."""
    want = {}
    for _, g in t.groupby([t["label"], t["embedding"].map(len)]):
        x = np.stack(g["embedding"]).astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        want |= dict(zip(g["vec_id"], (x @ x.T >= 0.93).sum(axis=1) - 1, strict=True))
    return want


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_forest_on_given_vectors_and_near_copies(spark, sf):
    """The given vectors, which have no links of their own, and a copy of every third, turned by cosines of 0.9 to 0.97."""
    t = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").where("embedding IS NOT NULL AND label IS NOT NULL").toPandas()
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(c) for c in v], int(y)) for i, v, y in zip(t["vec_id"], t["embedding"], t["label"], strict=True)]
    for i, v, y in rows[::3]:
        v, noise = np.array(v), rng.normal(size=len(v))
        noise -= v * (noise @ v) / (v @ v)
        c = rng.uniform(0.9, 0.97)
        rows.append((i + 10_000_000, (v * c + noise / np.linalg.norm(noise) * np.linalg.norm(v) * (1 - c * c) ** 0.5).tolist(), y))
    df = vectors_of(spark, rows)
    want = links_by_hand(df.toPandas())
    got = {r["vec_id"]: r["rp_links"] for r in rp_forest.near_vectors(df).collect()}
    assert got.keys() == want.keys() and all(got[i] <= want[i] for i in got)
    assert sum(want.values()) > len(t) // 4 and sum(got.values()) >= 0.9 * sum(want.values())


def test_forest_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [1.0, None], 1), (10, [1.0, 0.0], None), (11, [1.0], 1), (12, [], 1)]
    got = {r["vec_id"]: (r["rp_links"], r["rp_component"]) for r in rp_forest.near_vectors(vectors_of(spark, rows)).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), **{i: (0, i) for i in range(4, 13)}}
    assert rp_forest.near_vectors(vectors_of(spark, rows).limit(0)).count() == 0


def test_mixing_keeps_its_targets(spark, none):
    rng = random.Random(1)
    sources = {i: [None, "a", "b", "c"][i % 4] for i in range(200)}
    texts = [(i, None if i % 50 == 0 else " ".join(["w"] * rng.randrange(0, 60))) for i in range(200)]
    rows = mixing.mix(docs_of(spark, texts, sources)).collect()
    again = mixing.mix(docs_of(spark, texts, sources).repartition(7)).collect()
    assert sorted((r["doc_id"], r["mx_copies"]) for r in rows) == sorted((r["doc_id"], r["mx_copies"]) for r in again)
    total = sum(r["mx_size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    assert sum(v[0]["mx_target"] for v in by.values()) == pytest.approx(1.5 * total)
    for v in by.values():
        assert v[0]["mx_source_size"] == sum(r["mx_size"] for r in v) and v[0]["mx_target"] <= 2 * v[0]["mx_source_size"] + 1e-6
        assert abs(sum(r["mx_size"] * r["mx_copies"] for r in v) - v[0]["mx_target"]) <= 1
        assert all(0 <= r["mx_copies"] <= 2 for r in v)
    assert mixing.mix(none).count() == 0


def test_pipeline_mixes_row_by_row(spark, tmp_path):
    """Null and repeated ids: a row that is not taken takes no other row with it, so every source meets its target."""
    import corpus_pipeline

    rng = random.Random(3)
    sources = {i: "abc"[i % 3] for i in range(300)}
    texts = [(i, " ".join([f"w{i}"] * rng.randrange(1, 40))) for i in range(300)]
    docs = docs_of(spark, texts, sources).withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.lit(None)).when(F.col("doc_id") % 5 == 0, F.lit(7)).otherwise(F.col("doc_id")).cast("long"))
    want = {r["source"]: r["mx_target"] for r in mixing.mix(docs).collect()}
    out = corpus_pipeline.mix_sources(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    rows = out.collect()
    for source, target in want.items():
        assert abs(sum(len(r["text"].split()) for r in rows if r["source"] == source) - target) <= 1
    again = corpus_pipeline.mix_sources(spark, docs.repartition(5), str(tmp_path)).collect()
    assert sorted(r["text"] for r in rows) == sorted(r["text"] for r in again)


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    """A folder with labels: good texts are prose, bad ones shout."""
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, int(i % 2), 0) for i in range(1000, 1120)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def prose(rng, n=30):
    return " ".join(f"w{rng.randrange(300)}" for _ in range(n))


def test_pipeline_stages_keep_columns_and_odd_rows(spark, odd, none, labelled):
    """Nulls, empties, repeats, an empty table and clashing names: each stage ends, with the columns of its input."""
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, labelled)
        last = name == corpus_pipeline.STAGES[-1][0]
        assert last or out.columns == odd.columns
        ids = [r["doc_id"] for r in out.select("doc_id").collect()]
        assert set(ids) <= {1, 2, 3, 4, 5, 6, 7, None} and stage(spark, none, labelled).count() == 0
        if last or name == "line dedup":
            assert len(ids) == 9


def test_pipeline_quality_stage_rejects_what_scores_low(spark, labelled):
    import corpus_pipeline
    from lodestack.llm import factorisation as fm

    rng = random.Random(4)
    texts = [(i, prose(rng) if i % 2 else "BUY!! NOW!! $$$ " * rng.randrange(3, 9)) for i in range(1000, 1120)]
    docs = docs_of(spark, texts)
    kept = {r["doc_id"] for r in corpus_pipeline.quality_classifier(spark, docs, labelled).collect()}
    machine = fm.train(docs, spark.read.parquet(f"{labelled}/labels.parquet"))
    features = fm.Features()
    assert kept == {i for i, t in texts if machine.score(*features(t, len(t))) >= 0.5}
    assert sum(i % 2 == 0 for i in kept) <= 3 and sum(i % 2 for i in kept) >= 57


def test_pipeline_line_stage_matches_brute_force(spark, labelled):
    import corpus_pipeline

    rng = random.Random(5)
    lines = [f"line number {i} that is long enough" for i in range(12)] + ["short", ""]
    texts = [(i, "\n".join(rng.choice(lines) + rng.choice(["", " ", "\t"]) for _ in range(rng.randrange(1, 8)))) for i in range(25)]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.dedup_lines(spark, docs_of(spark, texts), labelled).collect()}
    at = {}
    for i, t in texts:
        for x in t.split("\n"):
            at.setdefault(x.strip(" \t").lower(), set()).add(i)
    for i, t in texts:
        want = "\n".join(x for x in t.split("\n") if len(x.strip(" \t")) < 20 or len(at[x.strip(" \t").lower()]) < 3 or max(at[x.strip(" \t").lower()]) == i)
        assert got[i] == (want, len(want))


def test_pipeline_near_stage_and_tokens_match_brute_force(spark, labelled):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng, texts = random.Random(6), []
    for i in range(40):
        w = prose(rng, 60).split() if i % 3 == 0 else texts[rng.randrange(len(texts))][1].split()
        w[rng.randrange(len(w))] = f"e{i}"
        texts.append((i, " ".join(w)))
    out = corpus_pipeline.near_dedup(spark, docs_of(spark, texts), labelled)
    want = brute_components(texts)
    assert sorted(r["doc_id"] for r in out.select("doc_id").collect()) == sorted({c for _, c in want.values()})
    own = Tokenizer.from_file(bpe.tokenizer_path())
    got = {r["doc_id"]: r for r in corpus_pipeline.tokens(spark, docs_of(spark, texts), labelled).collect()}
    assert all(got[i]["bpe_ids"] == own.encode(t, add_special_tokens=False).ids and got[i]["n_tokens"] == len(got[i]["bpe_ids"]) for i, t in texts)


def test_pipeline_runs_whole(spark, labelled, tmp_path):
    import corpus_pipeline

    rng = random.Random(7)
    folder = str(tmp_path / "in")
    docs_of(spark, [(i, prose(rng) if i % 2 else "BUY!! NOW!! $$$ " * 5) for i in range(1000, 1120)]).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{labelled}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "source", "bpe_ids", "n_tokens", "decoded_sha256"] and out.count() >= 50


def test_classifiers_score_every_row(spark, odd, none):
    labels = spark.createDataFrame([(3, 1, 0), (5, 0, 1), (6, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for labelled in (labels, labels.limit(0)):
        out = factorisation.score(odd, factorisation.train(odd, labelled))
        assert out.columns == odd.columns + ["fm_score"] and all(0 <= r["fm_score"] <= 1 for r in out.collect()) and out.count() == 9
        out = toxicity.tag(odd, toxicity.train(odd, labelled))
        assert all(0 <= r["tx_score"] <= 1 for r in out.collect()) and out.count() == 9
        assert toxicity.tag(none, toxicity.Field()).count() == 0


def test_toxic_words_are_found_in_place(spark):
    rng = random.Random(9)
    clean = [(i, " ".join(f"w{rng.randrange(200)}" for _ in range(60))) for i in range(0, 120)]
    toxic = []
    for i in range(120, 240):
        w = [f"w{rng.randrange(200)}" for _ in range(60)]
        for _ in range(3):
            w[rng.randrange(60)] = rng.choice(["vilest,", "Wretch", "vermined"])
        toxic.append((i, " ".join(w)))
    labels = spark.createDataFrame([(i, 1, int(i >= 120)) for i in range(240)], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, clean + toxic)
    out = toxicity.tag(docs, toxicity.train(docs, labels)).collect()
    wrong = [r["doc_id"] for r in out if (r["tx_score"] >= 0.7) != (r["doc_id"] >= 120)]
    assert len(wrong) <= 4
    said = {r["text"][s["start"] : s["end"]] for r in out for s in r["tx_spans"]}
    assert said >= {"vilest,", "Wretch", "vermined"}


def test_pii_rows(odd, none):
    model = pii.train(odd)
    got = {r["doc_id"]: r for r in pii.find(odd, model).collect()}
    assert got[1]["pii_base"] == [] and got[3]["pii_all"] == []
    assert pii.find(none, model).count() == 0


def test_chat_branches_and_edges(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 1.0), (1, 3, 1, "assistant", "good", 2.0), (1, 4, 3, "user", None, 0.0), (2, 1, 1, "user", "own parent", 0.0), (3, 1, 2, "user", "a", 0.0), (3, 2, 1, "user", "b", 0.0), (4, 1, 99, None, "x", None)]
    m = spark.createDataFrame(rows, "conv_id long, msg_id long, parent_id long, role string, text string, score double")
    out = chat.format_paths(chat.choose_paths(m, paths=2)).collect()
    turns = {(r["conv_id"], r["path"]): chat.parse_turns(r["formatted"]) for r in out}
    assert turns[1, 1] == [("user", "q"), ("assistant", "good"), ("user", "")] and turns[1, 2] == [("user", "q"), ("assistant", "bad")]
    assert turns[2, 1] == [("user", "own parent")] and turns[4, 1] == [("unknown", "x")]
    assert turns[3, 1] == [("user", "a")] and turns[3, 2] == [("user", "b")]  # each is the other's parent
    assert chat.choose_paths(m.limit(0)).count() == 0


def test_chat_long_conversation(spark):
    """600 turns with a short branch: paths are marked in ten rounds, and the plan does not grow with them."""
    rows = [(1, i, i - 1 if i else None, "user" if i % 2 == 0 else "assistant", f"t{i}", 1.0) for i in range(600)]
    m = spark.createDataFrame([*rows, (1, 900, 3, "user", "aside", 0.5)], "conv_id long, msg_id long, parent_id long, role string, text string, score double")
    chosen = chat.choose_paths(m)
    assert chosen._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 6
    row = chat.read_back(chat.format_paths(chosen)).first()
    assert row["n_turns"] == 600 and row["loss_chars"] == sum(len(f"t{i}") for i in range(1, 600, 2))


def test_chat_paths_match_enumeration(spark):
    """Random trees, several paths a conversation, against a walk from each leaf."""
    rng = random.Random(6)
    rows = [(c, i, rng.randrange(i) if i and rng.random() < 0.9 else None, "user", f"{c}.{i}", rng.randrange(8) / 4) for c in range(12) for i in range(rng.randrange(1, 25))]
    m = spark.createDataFrame(rows, "conv_id long, msg_id long, parent_id long, role string, text string, score double")
    got = {(r["conv_id"], r["path"]): [t for _, t in chat.parse_turns(r["formatted"])] for r in chat.format_paths(chat.choose_paths(m, paths=3)).collect()}
    want = {}
    for c in range(12):
        tree = {r[1]: r for r in rows if r[0] == c}
        paths = []
        for leaf in set(tree) - {r[2] for r in tree.values()}:
            path = [leaf]
            while tree[path[-1]][2] is not None:
                path.append(tree[path[-1]][2])
            paths.append((-sum(tree[i][5] for i in path), -len(path), leaf, [tree[i][4] for i in reversed(path)]))
        want |= {(c, n): p[3] for n, p in enumerate(sorted(paths)[:3], 1)}
    assert got == want
