"""Column functions on text: names, tokens, signals, flags. Narrow work inside code generation, no shuffle, no Python."""

from __future__ import annotations

import re
import string
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

#: What separates words of letters, digits and underscores.
NOT_WORD = r"[^\p{L}\p{N}_]+"
#: One character, or an end of the text, that a word is set off by.
NOT_IN_WORD = r"[^\p{L}\p{N}_]"
#: [a-z0-9], each by itself: Java looks those up in one table, but asks range by range, slowly where a class has several.
PLAIN = string.ascii_lowercase + string.digits
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}_"


def _folds() -> tuple[str, str]:
    """Single Latin letters with marks, and what they are without; made from the Unicode decompositions."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _PLAIN = _folds()


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold_accents(c) -> Column:
    """Letters without their marks, composed or not; a text of ASCII has none."""
    c = col(c)
    return F.when(F.octet_length(c) == F.char_length(c), c).otherwise(F.regexp_replace(F.translate(c, _MARKED, _PLAIN), r"\p{Mn}", ""))


def normalize_filename(c) -> Column:
    """A file name to compare by: no .pdf, no upload prefix, no accents, lower case, single spaces."""
    c = F.regexp_replace(F.regexp_replace(F.trim(col(c)), r"(?i)\.pdf$", ""), UUID, "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(fold_accents(c)), r"[^a-z0-9\s]", " "), r"\s+", " "))


def normalize_for_matching(c, spaces: bool = False) -> Column:
    """Text to match by. Line breaks and tabs vanish, gluing words, unless `spaces` makes them spaces first."""
    return _plain_words(F.lower(col(c)), spaces)


def _plain_words(low: Column, spaces: bool) -> Column:
    """normalize_for_matching of a text in lower case."""
    c = F.regexp_replace(fold_accents(low), r"[.\-_/\\\t\n\x0B\f\r]+" if spaces else r"[.\-_/\\]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, f"[^{PLAIN} ]+", ""), "  +", " "))


def slugify(c, empty: str = "brand") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(col(c))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(empty))


def key_tokens(c, stop=vocab.STOP_WORDS) -> Column:
    words = F.split(normalize_for_matching(c), " ")
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*stop))


def whole_word(pattern: str) -> str:
    """pattern where it is a whole word; it takes the word alone, not what stands around it."""
    return rf"(?<![\p{{L}}\p{{N}}_])(?:{pattern})(?![\p{{L}}\p{{N}}_])"


def word_ends(pattern: str) -> str:
    """pattern with \\b at its ends told by letters and digits of any script; what \\b knows differs between versions of Java."""
    pattern = rf"(?<![\p{{L}}\p{{N}}_]){pattern[2:]}" if pattern.startswith(r"\b") else pattern
    return rf"{pattern[:-2]}(?![\p{{L}}\p{{N}}_])" if pattern.endswith(r"\b") else pattern


def any_word(patterns) -> str:
    """Any of the patterns as whole words, in a form that other engines read too. To ask whether a text has one."""
    return f"(^|{NOT_IN_WORD})({'|'.join(patterns)})($|{NOT_IN_WORD})"


def folded(c) -> Column:
    """Lower case without accents; everything else as it is."""
    return fold_accents(F.lower(F.coalesce(col(c), F.lit(""))))


def words_of(c) -> Column:
    return F.split(col(c), NOT_WORD)


def with_digits(c: Column, some: Column, none: Column) -> Column:
    """some where the text has a digit, none elsewhere: most texts have none, and codes need one."""
    return F.when(c.rlike("[0-9]"), some).when(c.isNotNull(), none)


def fault_tokens(c, hints=vocab.FAULT_HINTS) -> Column:
    """Codes of up to five letters and three digits, with a digit or among the hints; in order, once each."""
    listed = "|".join(h.lower() for h in hints if re.fullmatch("[A-Z]{1,5}[0-9]{0,3}", h))
    c = col(c)
    find = lambda pattern: F.regexp_extract_all(F.lower(c), F.lit(whole_word(pattern)), 0)
    found = with_digits(c, find("|".join(filter(None, ["[a-z]{1,5}[0-9]{1,3}", listed]))), find(listed) if listed else F.array().cast("array<string>"))
    return F.array_distinct(F.transform(found, F.upper))


def has_fault_code(c, hints=vocab.FAULT_HINTS) -> Column:
    up = F.upper(col(c))
    return up.rlike(whole_word("[A-Z]{1,4}[0-9]{0,3}")) | up.rlike("|".join(hints))


def controller_tokens(c) -> Column:
    c = col(c)
    found = F.regexp_extract_all(F.upper(c), F.lit(whole_word("[A-Z]{2,6}[0-9]{1,5}[A-Z]{0,3}")), 0)
    return with_digits(c, F.array_distinct(F.filter(found, lambda w: ~w.isin(*vocab.NOT_CONTROLLERS))), F.array().cast("array<string>"))


def version_tokens(c) -> Column:
    c = col(c)
    found = F.regexp_extract_all(F.upper(fold_accents(c)), F.lit(vocab.VERSION), 1)
    return with_digits(c, F.array_distinct(F.transform(found, lambda m: F.replace(m, F.lit(" "), F.lit("")))), F.array().cast("array<string>"))


def _spaced(pattern: str) -> str:
    """pattern for plain words with a space before and after each: a search looks at spaces only, not at each \\b.

    Other forms than \\b(one|other)\\b, with letters or digits at the ends of each, stay as they are.
    """
    inner = pattern[3:-3]
    same = pattern == rf"\b({inner})\b" and not re.search(r"[()\[\]]", inner) and all(re.fullmatch(r"[a-z0-9](.*[a-z0-9])?", x) and not re.search(r"\\[a-z0-9]$", x) for x in inner.split("|"))
    return f" (?:{inner}) " if same else pattern


def topics(c, patterns=vocab.TOPICS) -> Column:
    """Topics whose pattern stands in the text to match by, in the order given."""
    found = {k: _spaced(p) for k, p in patterns.items()}
    if all(found[k] != p for k, p in patterns.items()):
        every = f" (?:{'|'.join(p[4:-2] for p in found.values())}) "
        pad = lambda t: F.concat(F.lit(" "), t, F.lit(" "))
    else:
        found, every, pad = patterns, "|".join(f"(?:{p})" for p in patterns.values()), lambda t: t
    each = lambda t: F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(k)) for k, p in found.items()]))
    # One pass says that a text has none of them, as most do.
    listed = lambda t: F.when(t.rlike(every), each(t)).when(t.isNotNull(), F.array().cast("array<string>")).otherwise(each(t))
    return let(F.lower(col(c)), lambda low: let(pad(_plain_words(low, True)), listed))


def domain_signals(c, chars: int | None = 6000, most: int | None = 20) -> Column:
    """Topics, controller, fault and version tokens of the first `chars` characters, `most` of a kind, which is the rule
    that other figures ask for; None is all of them."""
    c = F.coalesce(col(c), F.lit(""))
    c = c if chars is None else F.substring(c, 1, chars)
    first = lambda found, n: found if most is None else F.slice(found, 1, n)
    return F.struct(first(topics(c), 12).alias("topics"), first(controller_tokens(c), most).alias("controller_tokens"), first(fault_tokens(c), most).alias("fault_tokens"), first(version_tokens(c), most).alias("model_version_tokens"))


def line_signals(c) -> Column:
    """What joined_signals takes of each line; `opens`: it has the first word of a topic of several."""
    several = sorted({w.split(r"\s+")[0] for p in vocab.TOPICS.values() for w in p[3:-3].split("|") if r"\s+" in w})
    c = col(c)
    opens = normalize_for_matching(c, True).rlike(rf"\b({'|'.join(several)})\b")
    return F.struct(topics(c).alias("topics"), controller_tokens(c).alias("controller_tokens"), fault_tokens(c).alias("fault_tokens"), opens.alias("opens"))


def joined_signals(c: Column, lines: Column) -> Column:
    """domain_signals of all of c, which is lines joined by \\n, from line_signals of each.

    No code goes over the end of a line. Topics of several words and versions may, so these are looked for in c itself,
    topics only where a line has the first of such words.
    """
    every = lambda kind: F.array_distinct(F.flatten(F.transform(lines, lambda x: x[kind])))
    listed = let(every("topics"), lambda found: F.filter(F.array(*[F.lit(k) for k in vocab.TOPICS]), lambda k: F.array_contains(found, k)))
    found = F.when(F.exists(lines, lambda x: x["opens"]), topics(c)).otherwise(listed)
    return F.struct(found.alias("topics"), every("controller_tokens").alias("controller_tokens"), every("fault_tokens").alias("fault_tokens"), version_tokens(c).alias("model_version_tokens"))


def display_name(c) -> Column:
    """Last part of a path, without an upload prefix and the last extension."""
    s = F.element_at(F.split(col(c), "/"), -1)
    prefixed = (F.length(s) > 37) & (F.substring(s, 9, 1) == "-") & (F.substring(s, 37, 1) == "_")
    return F.regexp_replace(F.when(prefixed, F.substr(s, F.lit(38))).otherwise(s), r"\.[^.]*$", "")


def clean_answer(c) -> Column:
    c = F.regexp_replace(F.regexp_replace(col(c), r"\n{3,}", "\n\n"), r"[ \t]+\n", "\n")
    return F.trim(F.regexp_replace(c, r" +([?.,])", "$1"))


def context_snippet(c, term: str, before: int = 100, after: int = 200) -> Column:
    """Text around the first hit of term (case does not matter), on one line; null without a hit."""
    c = col(c)
    at = F.locate(term.lower(), F.lower(c))
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.translate(F.substr(c, start, at - start + after), "\n", " "))


#: White space as Unicode has it.
BLANK = r"[\s\x0B\x{1c}-\x{1f}\x{85}\p{Z}]"
SHORT_WORDS = any_word([f"[a-z]{{1,2}}{BLANK}+[a-z]{{1,2}}{BLANK}+[a-z]{{1,2}}"])


def rewrite_flags(c, foreign=vocab.FOREIGN_MARKERS) -> Column:
    """How an answer looks wrong: broken characters, three very short words in a row, two words of other languages or a
    foreign citation; `rewrite` if any. A null text is empty and looks right."""
    low = F.lower(F.coalesce(col(c), F.lit("")))
    broken, short, cited = low.contains("\ufffd"), low.rlike(SHORT_WORDS), low.rlike(f"\U0001f4c4{BLANK}*fuente")
    hits = let(fold_accents(low), lambda f: sum((f.rlike(any_word([w])).cast("int") for w in foreign), F.lit(0)))
    flags = F.struct(broken.alias("broken"), short.alias("short_words"), (hits >= 2).alias("foreign"), cited.alias("cited"))
    return let(flags, lambda x: x.withField("rewrite", x["broken"] | x["short_words"] | x["foreign"] | x["cited"]))


def bad_question(c, endings=("of", "the", "de", "la", "to", "in")) -> Column:
    """Whether a question is empty, short, without a question mark, unbalanced, or breaks off."""
    c = F.trim(F.coalesce(col(c), F.lit("")))
    count = lambda x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    return (c == "") | (F.size(F.split(c, r"\s+")) < 5) | ~c.endswith("?") | (count("(") != count(")")) | F.lower(c).rlike(r"\b(" + "|".join(endings) + r")\s*\?$")


def intent_flags(c, brand=None, brands=(), names=(), manuals=()) -> Column:
    """What a question asks for, over its folded text.

    greeting: nothing but one. cross_brand: brands are named, and none of them is part of the current one or has it as
    its part. identifier: an equipment code or one of `names` (patterns). meta_docs: about the documents themselves.
    general_manual: a general manual, also by one of `manuals`. door_cycle: a door that opens and closes or a start that
    fails at a door. technical: a technical question.
    """
    own = F.lower(F.coalesce(col(brand), F.lit(""))) if brand is not None else F.lit("")

    def flags(t: Column) -> Column:
        named = F.array_compact(F.array(*[F.when(t.rlike(any_word([re.escape(b)])), F.lit(b)) for b in brands]) if brands else F.array().cast("array<string>"))
        compact = F.trim(F.regexp_replace(t, r"[!?.\s]+", " "))
        return F.struct(
            compact.isin(*vocab.GREETINGS).alias("greeting"), let(named, lambda n: (F.size(n) > 0) & F.forall(n, lambda b: ~(F.contains(own, b) | F.contains(b, own)))).alias("cross_brand"),
            F.replace(t, F.lit("+"), F.lit(" ")).rlike(any_word([*vocab.MODEL_CODES, *names])).alias("identifier"), t.rlike("|".join(vocab.META_DOCS)).alias("meta_docs"),
            t.rlike(any_word([*vocab.GENERAL_MANUAL, *manuals])).alias("general_manual"), (t.rlike(any_word(vocab.DOOR)) & t.rlike(f"{vocab.DOOR_CYCLE}|{vocab.NO_START}")).alias("door_cycle"), technical(t).alias("technical"),
        )

    return let(folded(c), flags)


def technical(t: Column) -> Column:
    """Whether folded text asks something technical."""
    return t.rlike(any_word(vocab.TECHNICAL)) | t.rlike(f"(^|{NOT_IN_WORD})({'|'.join(vocab.TECHNICAL_BEGINNINGS)})")


def expand_query(c, aliases: dict[str, tuple[str, ...]]) -> Column:
    """The query and, for each theme it names, the theme's other terms that its compact form does not hold yet."""
    c = col(c)
    # What normalize_for_matching leaves without its spaces, in one pass and once for all themes.
    bare = F.regexp_replace(fold_accents(F.lower(c)), "[^a-z0-9]+", "")
    terms = lambda compact: F.array_compact(F.array(*[F.when(compact.contains(theme) & ~compact.contains(re.sub(r"[^a-z0-9]", "", t.lower())), F.lit(t)) for theme, more in aliases.items() for t in more]))
    return F.concat_ws(" ", c, let(bare, terms))


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, so that long expressions do not repeat it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def search_keywords(c, stop=vocab.PHRASE_STOP_WORDS) -> Column:
    """Codes to look up literally: single words, then pairs, then threes; once each by lower case, first spelling kept."""
    none = F.array().cast("array<string>")
    opens = lambda w, low: w.rlike(f"^[A-Za-z]{{{low},5}}$")

    def single(w: Column) -> Column:
        code = w.rlike("^([A-Za-z]+[0-9]|[0-9]+[A-Za-z])") | w.rlike("^[A-Z]{3,}$")
        dotted = F.array(w, F.replace(w, F.lit("."), F.lit("")))
        return F.when(F.length(w) < 2, none).when(code, F.array(w)).when(w.rlike(r"^[A-Za-z]?\.?[0-9]+\.[0-9]"), dotted).otherwise(none)

    def several(words: Column) -> Column:
        word = lambda i, k: F.get(words, i + k)
        at = lambda k: F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))

        def pair(i: Column) -> Column:
            both = F.concat_ws(" ", word(i, 0), word(i, 1))
            numbered = opens(word(i, 0), 1) & word(i, 1).rlike("^[0-9]{2,5}$")
            named = opens(word(i, 0), 2) & word(i, 1).rlike("^[A-Za-z0-9]{2,}$") & ~F.upper(word(i, 0)).isin(*stop)
            return F.when(numbered, F.array(both, F.concat(word(i, 0), word(i, 1)))).when(named, F.array(both)).otherwise(none)

        def three(i: Column) -> Column:
            fine = opens(word(i, 0), 2) & (word(i, 1) != "") & (word(i, 2) != "") & ~F.upper(word(i, 0)).isin(*stop)
            return F.when(fine, F.array(F.concat_ws(" ", word(i, 0), word(i, 1), word(i, 2)))).otherwise(none)

        every = F.concat(F.flatten(F.transform(words, single)), F.flatten(F.transform(at(2), pair)), F.flatten(F.transform(at(3), three)))
        # Sorted, equal keys stand side by side: a search for each would take the square of a long text's words.
        tagged = F.sort_array(F.transform(every, lambda k, i: F.struct(F.lower(k).alias("low"), i.alias("i"), k.alias("k"))))
        fresh = lambda s: F.filter(s, lambda x, i: (F.length(x["k"]) >= 2) & ~F.get(s, i - 1)["low"].eqNullSafe(x["low"]))
        return F.transform(F.sort_array(F.transform(let(tagged, fresh), lambda x: F.struct(x["i"], x["k"]))), lambda x: x["k"])

    words = F.transform(F.filter(F.split(F.trim(col(c)), r"\s+"), lambda w: w != ""), lambda w: F.regexp_replace(w, "[().,;:!?]", ""))
    return let(words, several)


def query_identifiers(c) -> Column:
    """What a query names for certain: its keywords and versions, letters and digits only, at most 24."""
    bare = lambda k: F.upper(F.regexp_replace(k, "[^A-Za-z0-9]", ""))
    words = F.filter(F.transform(search_keywords(c), bare), lambda k: F.length(k) >= 3)
    return F.slice(F.array_distinct(F.concat(words, F.transform(version_tokens(c), bare))), 1, 24)


# Quality of extracted text


def length_quality(c) -> Column:
    n = F.char_length(col(c))
    return F.when(n < 50, 0.1).when(n < 200, 0.4).when(n < 500, 0.7).otherwise(F.least(F.lit(1.0), n / 2000))


def extraction_score(c) -> Column:
    """Length, tables and codes for; stock phrases against; from 0 to 1."""
    c = col(c)
    low = F.lower(c)
    pipes = F.length(c) - F.length(F.replace(c, F.lit("|"), F.lit("")))
    tables = (pipes >= 8) | low.rlike("|".join(vocab.TABLE_PHRASES))
    code = lambda letters: F.exists(words_of(low), lambda w: w.rlike(f"^[a-z]{{1,{letters}}}[0-9]{{1,3}}$"))
    stock = low.rlike("|".join(vocab.GENERIC_PHRASES))
    generic = stock & ((F.length(c) < 900) | ~code(3))
    score = F.least(F.lit(1.0), F.length(c) / 3500) + F.when(tables, 0.25).otherwise(0.0) + F.when(code(4), 0.2).otherwise(0.0) - F.when(generic, 0.35).otherwise(0.0)
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def readable_gate(c, min_chars: int = 200) -> Column:
    """The first reason why a text does not read like prose, or "ok"."""
    c = col(c)
    n = F.regexp_count(c, F.lit(r"\S+"))
    count = lambda s: (F.length(c) - F.length(F.replace(c, F.lit(s), F.lit("")))) / len(s)
    chars = F.length(F.regexp_replace(c, r"\s+", ""))
    letters = F.length(F.regexp_replace(c, r"\P{L}", ""))
    long = F.regexp_count(c, F.lit(r"\S{26,}"))
    return (
        F.when(F.length(c) < min_chars, "short").when(n < 5, "few_words").when(count("|") >= 6, "table").when(long > F.greatest(F.lit(2.0), n * 0.08), "merged_words")
        .when(count("Ôö") + count("Ôäó") + count("ÔöÔö") > 4, "box_marks").when(chars / n > 14, "long_words").when(letters / F.length(c) < 0.35, "few_letters").otherwise("ok")
    )


def suspicious_chars(c, allowed: str = "àáâãäçèéêëìíîïñòóôõöùúûüßÀÁÂÃÄÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜ") -> Column:
    return F.length(F.regexp_replace(col(c), f"[\\x00-\\x7F{allowed}]", ""))
