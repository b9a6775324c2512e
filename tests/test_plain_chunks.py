"""Chunks, their signals, duplicates of names and reports against plain Python over whole texts."""

import hashlib
import unicodedata
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from lodestack.functions import vocab
from lodestack.operators import chunking
from lodestack.plans import corpus, usage

SF = "/root/testdata/sf0.001"
ENDS = regex.compile("\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]")
WORD = r"(?<![\p{L}\p{N}_])(?:%s)(?![\p{L}\p{N}_])"
CODE = regex.compile(WORD % "[A-Z]{1,4}[0-9]{0,3}")


def once(items, key):
    seen = {}
    for x in items:
        seen.setdefault(key(x), x)
    return list(seen.values())


def squeezed(c):
    return regex.sub(r"[ \t\n\x0b\f\r]+", " ", c).strip(" ").lower()


def table_rows(lines):
    piped = [x for x in lines if "|" in x]
    done, block, code = [], None, ""
    for line in piped if len(piped) >= 3 else []:
        if regex.search(vocab.TABLE_SEPARATOR, line):
            continue
        cells = [c.strip(" ") for c in regex.sub(r"^\|+|\|+$", "", line).split("|")]
        opens = CODE.search(cells[0].upper())
        if opens:
            done += [block] if block else []
            block, code = line, opens[0]
        elif block:
            block += "\n" + (f"| {code}{vocab.CONTINUED}{' | '.join(cells[1:])}" if code and not cells[0] else line)
    done += [block] if block else []
    return once([c for c in done if len(c) >= 40], squeezed)


def chunks_of(text, most=8, rows=4):
    text = (text or "").strip(" ")
    if len(text) <= 2000:
        return [text] if text else []
    lines = [x for x in (y.strip(" ") for y in ENDS.split(text)) if x]
    coded = [i for i, x in enumerate(lines) if CODE.search(x.upper()) or any(h in x.upper() for h in vocab.FAULT_HINTS)]
    near = ["\n".join(lines[max(0, i - 1) : i + 5]) for i in coded]
    width = 12 if len(lines) > 35 else 9
    starts = [0]
    while starts[-1] + width < len(lines):
        starts.append(starts[-1] + max(4, width - 3))
    broad = ["\n".join(lines[i : i + width]) for i in starts]
    found = once(table_rows(lines)[:rows] + [c for c in near if len(c) >= 60] + [c for c in broad if len(c) >= 120], squeezed)
    return found[:most] or [text]


def folded(x):
    return "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn")


def signals_of(text):
    c = text[:6000]
    low = regex.sub(r"[.\-_/\\ \t\n\x0b\f\r]", " ", folded(c.lower()))
    low = regex.sub(" +", " ", regex.sub("[^a-z0-9 ]", "", low)).strip(" ")
    faults = regex.findall(WORD % ("[a-z]{1,5}[0-9]{1,3}|" + "|".join(h.lower() for h in vocab.FAULT_HINTS)), c.lower())
    controls = [w for w in regex.findall(WORD % "[A-Z]{2,6}[0-9]{1,5}[A-Z]{0,3}", c.upper()) if w not in vocab.NOT_CONTROLLERS]
    return [k for k, p in vocab.TOPICS.items() if regex.search(p, low, regex.A)], list(dict.fromkeys(controls))[:20], list(dict.fromkeys(w.upper() for w in faults))[:20]


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


TABLE = "\n".join(["| Code | What |", "|---|---|", "| E12 | a fault of the main board, which stays |", "| | more of it, on a line without a code |", "plain line", "| uv | low voltage, look at the supply of the drive |", "| ? ? | no code here at all, joins the row before |"])
PAGES = [TABLE + "\n" + "lower case words without any codes of note ".upper() * 60, TABLE + "\n" + "\n".join(f"line {i} " + "something longer than four letters " * 2 for i in range(60)), "x" * 2000, "x" * 2001, " ", None, "\n".join("longwords everywhere\x85nothing" for _ in range(100)), "\n".join(f"{i % 3} same lines here again and again" for i in range(90)), "a|b\nc|d\ne|f\n" + "wordless " * 300]


def test_chunks_of_hand_made_pages(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(PAGES)], "i int, text string")
    got = {r["i"]: r["chunks"] for r in chunking.build_chunks(df).collect()}
    assert got == {i: chunks_of(p) for i, p in enumerate(PAGES)}
    every = {r["i"]: r["chunks"] for r in chunking.build_chunks(df, max_chunks=None).collect()}
    assert every == {i: chunks_of(p, None, None) for i, p in enumerate(PAGES)}


def test_c6_values_over_whole_texts(spark, documents):
    want = set()
    for i, r in documents.items():
        chunks = chunks_of(r["text"])
        for n, c in enumerate(chunks):
            key = hashlib.sha256("\x1f".join(str(x) for x in (r["source"], i, 1, n) if x is not None).encode()).hexdigest()
            want.add((key, r["source"], i, n, len(chunks), hashlib.md5(c.encode()).hexdigest(), " ".join(signals_of(c)[2])))
    got = [tuple(r) for r in corpus.QUERIES["c6_chunk_records"](spark, SF).collect()]
    assert len(got) == len(want) and set(got) == want


def test_c8_values(spark, documents):
    seen, updated = Counter(), Counter()
    for i, r in documents.items():
        for c in chunks_of(r["text"]):
            seen[r["source"]] += 1
            updated[r["source"]] += bool(c.strip(" ")) and (i % 2 == 1 or not any(signals_of(c)))
    got = {r["brand_slug"]: (r["seen"], r["updated"]) for r in corpus.QUERIES["c8_backfill_signals"](spark, SF).collect()}
    assert got == {b: (n, updated[b]) for b, n in seen.items()} and 0 < sum(updated.values()) < sum(seen.values())


def test_s7_counts_what_was_graded(spark):
    grades = Counter(r["grade"] for r in usage.QUERIES["e2_grade_answers"](spark, SF).collect())
    assert {r["passed"]: r["n"] for r in corpus.QUERIES["s7_eval_results"](spark, SF).collect()} == grades and len(grades) > 1


def test_d5_groups_over_whole_lines(spark, documents):
    def name_of(text):
        x = regex.sub(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}_", "", regex.sub(r"(?i)\.pdf$", "", text.split("\n")[0].strip(" ")))
        return regex.sub(r"[ \t\n\x0b\f\r]+", " ", regex.sub(r"[^a-z0-9 \t\n\x0b\f\r]", " ", folded(x).lower())).strip(" ")

    names = {i: name_of(r["text"]) for i, r in sorted(documents.items()) if r["text"] is not None}
    founders, want = {}, {}
    for i, name in names.items():
        if name:
            for f, first in founders.items():
                short, long = sorted((name, first), key=len)
                if name == first or (len(short) < len(long) and len(short.split(" ")) >= 3 and short in long):
                    want[i] = f
                    break
            else:
                founders[i] = name
                want[i] = i
    got = {r["id"]: r["group"] for r in corpus.QUERIES["d5_near_duplicate_groups"](spark, SF).collect()}
    assert got == want and len(founders) < len(want)
