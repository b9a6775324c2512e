"""The parts of the operators that run inside a task, against brute force."""

import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestack.llm import bpe, chat, factorisation, jaccard, mixing, pii, quality_rules, toxicity


@pytest.fixture(scope="module")
def merges():
    with open(bpe.tokenizer_path(), encoding="utf-8") as f:
        return bpe.Merges(f.read())


def ids(merges, texts):
    return [list(np.frombuffer(x, dtype=np.int32)) for x in merges.encode(texts)]


def test_bpe_equals_the_library(merges):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(bpe.tokenizer_path())
    rng, texts = random.Random(1), ["", " ", "Hello  World's 12 é <|endoftext|> x<|STARTOFTEXT|>y İ ß K ΑΣ 'S", "aaaa" * 5000, "\x1c a\x85b"]
    pieces = ["a", "b", "the", "'s", "ll", " ", "\n", "<|endoftext|>", "ß", "Ñ", "½", "²", "漢字", "🙂", "\U00016ebd", "\U00013692"]
    texts += ["".join(rng.choice(pieces) + (chr(rng.randrange(0x20, 0x3000)) if rng.random() < 0.3 else "") for _ in range(rng.randrange(60))) for _ in range(400)]
    assert ids(merges, texts) == [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]


def test_bpe_equals_the_library_on_every_code_point(merges):
    """Alone, inside a word, among marks of two classes, and decomposed."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(bpe.tokenizer_path())
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Co"]
    for make in (lambda c: f"a{c}b 1{c}{c}", lambda c: f"a\u0316{c}\u0301\u0316", lambda c: unicodedata.normalize("NFD", c) + "\u0345x"):
        texts = ["\n".join(map(make, points[i : i + 64])) for i in range(0, len(points), 64)]
        wrong = [i for i, (a, b) in enumerate(zip(ids(merges, texts), own.encode_batch(texts, add_special_tokens=False), strict=True)) if a != b.ids]
        bad = [c for i in wrong for c in points[64 * i : 64 * i + 64] if ids(merges, [make(c)])[0] != own.encode(make(c), add_special_tokens=False).ids]
        assert not wrong, [hex(ord(c)) for c in bad]


def test_bpe_does_not_depend_on_what_else_is_in_the_batch(merges):
    texts = ["lowering the lowest lows", "aaaa aaa aa a", "mississippi"]
    together = ids(merges, texts)
    merges.cache.clear()
    assert [ids(merges, [t])[0] for t in texts] == together


def test_measures_match_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        text = " ".join(rng.choice("ab") for _ in range(rng.randrange(40))) + rng.choice(["", "\n", "\x0b\x1c", "\n\nx\nx", "#|é"])
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        m = dict(zip(quality_rules.MEASURES, quality_rules.measure(text), strict=True))
        assert (m["n_words"], m["word_chars"], m["n_repeat_words"], m["n_dup_lines"]) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
    assert quality_rules.measure(None) == quality_rules.measure("") == (0,) * len(quality_rules.MEASURES)


def test_fit_counts_is_near_the_best():
    rng = random.Random(0)
    for _ in range(300):
        lengths = np.array(rng.sample(range(1, 25), rng.randrange(1, 6)))
        counts = np.array([rng.randrange(0, 5) for _ in lengths])
        budget = rng.randrange(0, int((lengths * counts).sum()) + 3)
        take = mixing.fit_counts(lengths, counts, budget)
        assert (0 <= take).all() and (take <= counts).all()
        sums = {0}
        for n, c in zip(lengths, counts, strict=True):
            sums = {s + k * int(n) for s in sums for k in range(int(c) + 1)}
        assert abs(int((take * lengths).sum()) - budget) == min(abs(s - budget) for s in sums)


def sets_of(texts):
    flat, at = jaccard.shingle_sets(pa.array(texts, pa.string()))
    return [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


def test_shingles_match_plain_windows():
    """Texts share a hash where and only where their windows of words are the same."""
    rng, low = random.Random(1), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = [None, "", " ", "a b", "A  b\n", "a b c d e f", "B c d e f", "x " * 100, "é ü\x0b ß A b c d", "w\x85w x\xa0y \x1c"]
    texts += [" ".join(rng.choice("abAB") * rng.randrange(1, 4) for _ in range(rng.randrange(12))) + rng.choice(["", " ", "\n"]) for _ in range(500)]
    hashes = {}
    for t, got in zip(texts, sets_of(texts), strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        want = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        assert len(got) == len(set(got)) == len(want) and got == sorted(got)
        hashes.setdefault(frozenset(want), set()).add(tuple(got))
    assert all(len(v) == 1 for v in hashes.values()) and len({v for s in hashes.values() for v in s}) == len(hashes)
    assert sets_of(texts)[3:40] == sets_of(texts[3:40])


def test_long_texts_are_hashed_as_short_ones(monkeypatch):
    words = [f"w{i}" for i in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(["a b c d e", " ".join(words), None, "x"])], names=["text"])
    monkeypatch.setattr(jaccard, "AT_ONCE", 10)
    parts = [p.column(0).to_pylist() for p in jaccard._slices(iter([batch]))]
    assert [t for p in parts for t in p] == batch.column(0).to_pylist() and len(parts) >= 2
    assert sets_of([" ".join(words)])[0] == sorted({h for i in range(2996) for h in sets_of([" ".join(words[i : i + 5])])[0]})


def test_parities_bound_what_sets_do_not_share():
    rng = np.random.default_rng(0)
    for size in (5, 150, 3000):
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        b = np.unique(np.r_[a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 63, size // 10, dtype=np.uint64)])
        p = jaccard.parities(np.r_[a, b], np.array([0, len(a), len(a) + len(b)]))
        bits = sum(int(x).bit_count() for x in (p[0] ^ p[1]).view(np.uint64))
        apart = len(np.setxor1d(a, b))
        assert bits <= apart and (apart > 200 or bits >= 0.7 * apart)


def test_sketch_blocks_round_trip():
    counts = np.zeros(jaccard.BLOCK, dtype=np.uint32)
    counts[[0, 5, 40, jaccard.BLOCK - 1]] = [1, 70000, 3, 9]
    assert (jaccard._unpack(jaccard._pack(counts)) == counts).all()


def test_base_spans_match_plain_patterns():
    def plain(t):
        out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = re.sub("[^0-9]", "", m[0])
            if 14 <= len(d) <= 19 and pii.luhn(d):
                out.append((m.start(), m.end(), "card"))
        out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))

    rng = random.Random(4)
    pieces = ["a", "@", ".", "1", "23", "+", "(", ")", " ", "-", "b.c", "a@b.co", "1.2.3.4", "4111111111111111", "٣"]
    for _ in range(5000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randrange(40)))
        assert pii.base_spans(t) == plain(t)


def test_repeats_in_another_dress_are_found_and_clean_words_left():
    known = [f"x mail user{i}@mail.example.com call +1 (555) 010-{i:04d} card 4111111111111111 at 10.0.0.{i} in {i} ways" for i in range(60)]
    model = pii.fit(known)
    text = "card 4111111111111111 4111111111111111 then 12 plain words and version 2.0"
    added = pii.added_spans(text, pii.base_spans(text), model)
    assert [(text[a:b], k) for a, b, k in added] == [("4111111111111111", "card")] * 2
    clean = "there were 12 boxes in 1999 and 3 of 45 were red"
    assert pii.added_spans(clean, pii.base_spans(clean), model) == []


def test_any_character_is_read():
    """Also digits that are none of 0-9, which once stopped the whole job."""
    model = pii.fit(["x mail a@b.co call +1 555 010 1234"] * 6)
    points = [c for c in map(chr, range(0x110000)) if c.isnumeric() or c.isdigit() or ord(c) % 37 == 0 and not 0xD800 <= ord(c) < 0xE000]
    for at in range(0, len(points), 100):
        chars = points[at : at + 100]
        text = " ".join(f"1{c * 13} 4{c}@" for c in chars)
        assert pii.added_spans(text, pii.base_spans(text), model) is not None


def test_one_off():
    for a, b, yes in (("abc", "abd", 1), ("abc", "abcd", 1), ("abc", "bc", 1), ("abc", "abc", 1), ("abc", "acb", 0), ("abcd", "ab", 0), ("", "x", 1)):
        assert pii.one_off(a, b) == pii.one_off(b, a) == bool(yes)


def learned(n=150):
    rng = random.Random(3)
    texts = []
    for i in range(n):
        phone, ip = f"+1555{rng.randrange(10**7):07d}", f"10.{rng.randrange(256)}.{rng.randrange(256)}.{i % 256}"
        texts.append(f"call {phone} from {ip} in 19{i % 90 + 10} or {phone} again, order {rng.randrange(10**6)} then {ip} and {rng.randrange(10**4)} boxes")
    return texts


def test_skip_weights_are_learned_and_find_hidden_repeats():
    """Labels of the second of two repeats are hidden: the field finds them, and tags nothing else."""
    model, rng = pii.fit(learned()), random.Random(9)
    assert (model.skip[[2, 4]] > pii.SKIP_PRIOR).all()  # ip and phone have repeats to learn from
    found = wrong = hidden = 0
    for i in range(200):
        number = f"{rng.randrange(10**10, 10**11)}"
        text = f"call +{number} now, in 1987 or by {number} at 12 sharp, {rng.randrange(10**5)} times" if i % 2 else f"order {number} of 1987 came in {rng.randrange(10**5)} parts and {number} went"
        added = pii.added_spans(text, pii.base_spans(text), model)
        hidden += i % 2
        found += sum((text[a:b], k) == (number, "phone") for a, b, k in added) if i % 2 else 0
        wrong += len(added) - (sum(text[a:b] == number for a, b, _ in added) if i % 2 else 0)
    assert found >= 0.9 * hidden and wrong <= 0.02 * hidden


def test_messages_settle_where_marginals_are_known():
    """A chain without loops: belief propagation gives the marginals of enumeration."""
    model, text = pii.fit(learned(40)), "+15550001111 15550001111 10.0.0.300 1999"
    words = pii.live_words(text)
    got = pii.marginals(model, words, {0: 4})
    n = len(pii.KINDS) + 1
    chain, skip = pii.neighbours(words)
    want = np.zeros((len(words), n))
    for y in np.ndindex(*[n] * len(words)):
        if y[0] == 4:
            z = sum(model.potentials(w[3])[k] for w, k in zip(words, y, strict=True)) + sum(model.chain[y[i], y[j]] for i, j in chain) + sum(model.skip[y[i]] for i, j in skip if y[i] == y[j])
            want[np.arange(len(words)), list(y)] += np.exp(z)
    want /= want.sum(axis=1, keepdims=True)
    assert len(chain) == 3 and not skip and np.abs(got - want).max() < 0.01


def test_chain_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    lengths = np.array([3, 1, 5])
    e, trans = rng.normal(size=9), np.exp(rng.normal(size=(2, 2)))
    got, start = toxicity.chain(e, lengths, trans), 0
    for n in lengths:
        total, ones = 0.0, np.zeros(n)
        for bits in range(1 << n):
            y = [(bits >> k) & 1 for k in range(n)]
            w = np.exp(sum(e[start + k] for k in range(n) if y[k])) * np.prod([trans[y[k], y[k + 1]] for k in range(n - 1)])
            total += w
            ones += w * np.array(y)
        assert np.allclose(got[start : start + n], ones / total)
        start += n


def test_machine_uses_the_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    m = factorisation.Machine(0.3, rng.normal(size=6), rng.normal(size=(6, 3)))
    x = np.array([0.5, 1.0, -2.0])
    at = np.array([0, 2, 5])
    pairs = sum(m.v[at[i]] @ m.v[at[j]] * x[i] * x[j] for i in range(3) for j in range(i + 1, 3))
    assert np.isclose(m.score(at, x), 1 / (1 + np.exp(-(0.3 + m.w[at] @ x + pairs))))


def test_machine_learns_and_has_a_score_without_labels():
    f = factorisation.Features()
    good, bad = ["the quick fox jumps over it all day long"] * 30, ["BUY!! NOW!! BUY!! NOW!!"] * 30
    m = factorisation.fit([f(t) for t in good + bad], np.array([1.0] * 30 + [0.0] * 30), epochs=60)
    assert m.score(*f(good[0])) > 0.9 > 0.1 > m.score(*f(bad[0]))
    assert 0 <= m.score(*f("")) <= 1 and 0 <= m.score(*f(None)) <= 1
    assert factorisation.fit([], np.zeros(0)).score(*f("x")) == pytest.approx(0.5)


def test_template_is_reversible():
    rng = random.Random(2)
    pieces = ["<|end|>", "<|", "|>", "\\", "\\!", "!", "a", "\n", "[INST]", "</s>", "<<SYS>>", "<", "|", ">"]
    for _ in range(2000):
        turns = [(rng.choice(["user", "assistant", "a|b", "x<|end|>", "s\\"]), "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))) for _ in range(rng.randrange(5))]
        text, spans = chat.format_turns(turns)
        assert chat.parse_turns(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
        assert not any(c in chat.escape(t) for c in chat.CONTROLS for _, t in turns)


