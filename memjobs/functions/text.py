"""Text functions on columns: tokenizers, lexical units, overlap scores, token counts.

All are built from Spark's own functions, so they stay inside compiled stages and need no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no keywords.
IGNORED_TERMS = [
    "主题", "核心实体", "用户意图", "相关实体", "问题",
    "topic", "core", "entity", "intent", "query", "question", "user", "related",
    "what", "when", "where", "who", "why", "how", "did", "does", "do", "is", "are", "was", "were",
    "the", "a", "an", "of", "to", "from", "in", "on", "for", "with", "about", "this", "that", "it",
]
CJK = r"\x{4e00}-\x{9fff}"
PUNCTUATION = r"[!-/:-@\[-`{-~]"
BLANKS = r"[ \t\n\r\f\x0b]+"
MOST_TERMS = 12


def blank(text: Column) -> Column:
    """Null or white space only."""
    return F.coalesce(F.regexp_replace(text, BLANKS, ""), F.lit("")) == ""


def turn_text(speaker: Column, text: Column) -> Column:
    return F.concat(F.lit("["), speaker, F.lit("]: "), text)


def tokens_of(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def answer_text(text: Column) -> Column:
    """Lower case, ASCII punctuation deleted, white space collapsed."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, "")
    return F.array_join(tokens_of(bare), " ")


def answer_tokens(text: Column) -> Column:
    return tokens_of(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, ""))


def memory_tokens(text: Column) -> Column:
    """Each CJK character, and each run of ASCII letters, digits and underscores in lower case."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"([{CJK}]|[a-zA-Z0-9_]+)"), F.lit(1)), F.lower)


def _stems(word: Column) -> Column:
    """The word and what it may be a form of."""
    n = F.length(word)

    def cut(k: int) -> Column:
        return F.substring(word, F.lit(1), n - k)

    ies = word.endswith("ies") & (n > 4)
    plural = F.when(ies, F.concat(cut(3), F.lit("y"))).when(word.endswith("s") & (n > 3), cut(1))
    past = word.endswith("ed") & (n > 4)
    running = word.endswith("ing") & (n > 5)
    forms = F.array(
        word, plural, F.when(past, cut(2)), F.when(past, cut(1)), F.when(running, cut(3)), F.when(running, F.concat(cut(3), F.lit("e")))
    )
    # most words have none of these endings
    return F.when(word.endswith("s") | word.endswith("ed") | word.endswith("ing"), F.filter(forms, lambda f: f.isNotNull())).otherwise(F.array(word))


def lexical_units(text: Column) -> Column:
    """Words of more than one character with their likely stems, and pairs of neighbouring CJK characters; distinct."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.filter(F.array_distinct(F.split(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "), " ")), lambda w: F.length(w) > 1)
    none = F.array().cast("array<string>")

    def pairs(han: Column) -> Column:
        return F.when(F.length(han) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.length(han) - 1, F.lit(1))), lambda i: F.substring(han, i, F.lit(2)))).otherwise(none)

    return F.array_distinct(F.concat(F.flatten(F.transform(words, _stems)), bound(F.regexp_replace(low, f"[^{CJK}]+", ""), pairs)))


def keyword_terms(query: Column, *excluded: Column, limit: int = MOST_TERMS) -> Column:
    """Units of the query that are no stop words and no units of ``excluded``; the longest first, then by value, descending."""
    units = F.array_except(lexical_units(query), F.array(*map(F.lit, IGNORED_TERMS)))
    for value in excluded:
        units = F.array_except(units, lexical_units(value))
    sized = F.transform(F.filter(units, lambda u: (F.length(u) > 1) & (F.length(u) <= 32)), lambda u: F.struct(F.length(u).alias("n"), u.alias("u")))
    return F.transform(F.slice(F.sort_array(sized, asc=False), 1, limit), lambda s: s["u"])


def lexical_overlap(query: Column, candidate: Column) -> Column:
    """Share of the query's units (twelve count at most) that the candidate has."""
    return unit_overlap(lexical_units(query), lexical_units(candidate))


def unit_overlap(query: Column, candidate: Column) -> Column:
    """``lexical_overlap`` of units that are already taken apart; 0 if the query has none."""
    return F.least(F.size(F.array_intersect(query, candidate)) / F.greatest(F.lit(1), F.least(F.size(query), F.lit(MOST_TERMS))), F.lit(1.0))


def keyword_score(terms: Column, candidate: Column) -> Column:
    """0 without terms; the terms are taken apart again, so their stems count as well."""
    return F.when(F.size(terms) == 0, F.lit(0.0)).otherwise(lexical_overlap(F.array_join(terms, " "), candidate))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def runs(items: Column) -> Column:
    """(item, n): each different item, sorted, and how often it occurs. Sorting apart this takes linear time."""

    def counted(s: Column) -> Column:
        places = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (i == 0) | (F.get(s, i) != F.get(s, F.greatest(i - 1, F.lit(0)))))
        return bound(starts, lambda p: F.transform(p, lambda i, k: F.struct(F.get(s, i).alias("item"), (F.coalesce(F.get(p, k + 1), F.size(s)) - i).alias("n"))))

    return bound(F.sort_array(items), counted)


def numbered(words: Column) -> Column:
    """Distinct texts, one for each word: the word and how many equal ones stand before it. As multisets words turn into sets."""
    return F.flatten(F.transform(runs(words), lambda r: F.transform(F.sequence(F.lit(1), r["n"]), lambda k: F.concat_ws(" ", r["item"], k.cast("string")))))


def bag_cosine(a: Column, b: Column) -> Column:
    """Cosine of the token counts of two texts; 0 if either has no tokens. One sorted list holds the words of both."""

    def of(text: Column, side: int) -> Column:
        return F.transform(memory_tokens(text), lambda w: F.struct(w.alias("word"), F.lit(side).alias("side")))

    def cosine(r: Column) -> Column:
        def square(side: int) -> Column:
            return F.aggregate(r, F.lit(0.0), lambda s, x: s + F.when(x["item"]["side"] == side, x["n"].cast("double") * x["n"]).otherwise(0.0))

        squares = square(0), square(1)
        both = F.transform(r, lambda x, k: F.when((k > 0) & (F.get(r, F.greatest(k - 1, F.lit(0)))["item"]["word"] == x["item"]["word"]), x["n"].cast("double") * F.get(r, F.greatest(k - 1, F.lit(0)))["n"]).otherwise(0.0))
        return F.when((squares[0] == 0) | (squares[1] == 0), F.lit(0.0)).otherwise(F.aggregate(both, F.lit(0.0), lambda s, x: s + x) / (F.sqrt(squares[0]) * F.sqrt(squares[1])))

    return bound(runs(F.concat(of(a, 0), of(b, 1))), cosine)


def grams(text: Column, n: int) -> Column:
    """Distinct strings of ``n`` neighbouring characters; none if the text is shorter. Linear in the text."""

    def joined(chars: Column) -> Column:
        last = F.size(chars) - n
        places = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(places, lambda i: F.concat(*(F.get(chars, i + k) for k in range(n)))))

    return bound(F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != ""), joined)


def word_count(text: Column) -> Column:
    return F.size(tokens_of(text))


def budget_tokens(text: Column) -> Column:
    """A third of the UTF-8 bytes, rounded up: a careful estimate without a vocabulary."""
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 3).cast("long")


def compression_ratio(total: Column, retrieved: Column, floor: bool = True) -> Column:
    """Total over retrieved tokens, at least 1. Nothing retrieved: the total itself, or 1. Without ``floor``: null and no minimum."""
    if not floor:
        return F.when(retrieved > 0, total / retrieved)
    return F.when(retrieved <= 0, F.when(total > 0, total.cast("double")).otherwise(1.0)).otherwise(F.greatest(total / retrieved, F.lit(1.0)))


def truncated(text: Column, limit: int) -> Column:
    text = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{BLANKS}|{BLANKS}$", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, limit), f"{BLANKS}$", ""), F.lit("...")))


def headed_sections(text: Column, headers: list[str]) -> Column:
    """Map of header to section. A header stands at a line's start before a colon; of equal headers the last counts."""
    names = "|".join(h.replace(".", r"\.") for h in headers)
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?ms)^\s*((?:{names})\s*[:：].*?)(?=^\s*(?:{names})\s*[:：]|\z)"), F.lit(1))
    pairs = F.transform(
        parts,
        lambda p: F.struct(
            F.regexp_extract(p, rf"^({names})\s*[:：]", 1).alias("key"),
            F.trim(F.regexp_replace(F.regexp_replace(p, rf"^(?:{names})\s*[:：]", ""), r"^\s+|\s+$", "")).alias("value"),
        ),
    )
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def kept_sections(text: Column, headers: list[str], retained: list[str]) -> Column:
    """Only the ``retained`` sections, in that order; a text without headers stays as it is."""
    sections = headed_sections(text, headers)
    rendered = F.filter(F.array(*(F.when(F.map_contains_key(sections, F.lit(h)), F.concat(F.lit(f"{h}："), sections[h])) for h in retained)), lambda s: s.isNotNull())
    return F.when(F.size(sections) == 0, F.trim(text)).otherwise(F.array_join(rendered, "\n\n"))


def note_keywords(text: Column, most: int = 5) -> Column:
    """The first words of at least two letters or CJK characters."""
    return F.slice(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"([a-zA-Z{CJK}]{{2,}})"), F.lit(1)), 1, most)


def session_time(raw: Column) -> Column:
    """The timestamp of text such as ``1:56 pm on 8 May, 2023``; null where it isn't of that form."""
    shouted = F.regexp_replace(F.regexp_replace(raw, r"(?i)\bam\b", "AM"), r"(?i)\bpm\b", "PM")
    return F.try_to_timestamp(shouted, F.lit("h:mm a 'on' d MMMM, yyyy"))
