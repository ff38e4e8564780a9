"""Text functions, Column -> Column, built from native expressions only.

Regular expressions stay in the subset that Java and RE2 read alike (no
lookaround, no backreferences), unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of the scripts that the corpus is written in.
CYRILLIC = "а-яёА-ЯЁәғқңөұүһіӘҒҚҢӨҰҮҺІ"
KAZAKH_ONLY = "әғқңөұүһіӘҒҚҢӨҰҮҺІ"
LATIN = "A-Za-z"
CJK = "一-鿿぀-ヿ가-힯"


def let(c: Column, f) -> Column:
    """f(c) with c computed once: a lambda's variable isn't inlined, a column expression is, per use and per element."""
    return F.get(F.transform(F.array(c), lambda x: f(x)), F.lit(0))


def squash(c: Column) -> Column:
    """Trim and make every run of white space one space."""
    return F.trim(F.regexp_replace(c, r"[ \t\r\n\f]+", " "))


def norm_key(c: Column) -> Column:
    """Key of exact duplicates: squashed, lower case."""
    return F.lower(squash(c))


def plain_words(c: Column) -> Column:
    """Lower case without anything but letters, digits and single spaces."""
    return squash(F.regexp_replace(F.lower(c), rf"[^a-z0-9_{CYRILLIC} \t\r\n]", ""))


def tokens(c: Column) -> Column:
    """Words of any script in order (array); an empty text has none."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "), " "), lambda x: x != "")


def prefix_key(c: Column, n: int) -> Column:
    return F.substring(F.lower(c), 1, n)


def count_matches(c: Column, pattern: str) -> Column:
    """Matches of a pattern; null text has none."""
    return F.coalesce(F.regexp_count(c, F.lit(pattern)), F.lit(0))


def count_of(c: Column, literal: str) -> Column:
    """Occurrences of a literal that don't overlap."""
    return F.coalesce(((F.length(c) - F.length(F.replace(c, F.lit(literal), F.lit("")))) / len(literal)).cast("int"), F.lit(0))


def letters(c: Column, klass: str) -> Column:
    """How many characters of a class the text has."""
    return F.length(F.regexp_replace(c, f"[^{klass}]", ""))


def ellipsis(c: Column, n: int) -> Column:
    """At most n characters, the last of them an ellipsis where text was dropped."""
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, n - 1)), F.lit("…")))


def middle_collapse(c: Column, n: int) -> Column:
    """Head and tail of a long text with a mark between."""
    half = n // 2
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, half), F.lit("\n…\n"), F.right(c, F.lit(half))))


def strip_cjk(c: Column) -> Column:
    return squash(F.regexp_replace(c, f"[{CJK}]", ""))


def until_stop(c: Column, stops: list[str]) -> Column:
    """The text before the first of several literals."""
    places = [F.when(F.instr(c, s) > 0, F.instr(c, s)) for s in stops]
    first = F.least(*places, F.lit(1 << 30)) if len(places) > 1 else F.coalesce(places[0], F.lit(1 << 30))
    return F.when(first < (1 << 30), F.substr(c, F.lit(1), (first - 1).cast("int"))).otherwise(c)


def strip_markdown(c: Column) -> Column:
    """Without fenced code and tags; spaces squeezed, at most one blank line in a row."""
    c = F.regexp_replace(c, r"(?s)```.*?```", " ")
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def sentences_by_marks(c: Column) -> Column:
    """Variant a: non-blank pieces between runs of . ! ? …"""
    return F.size(F.filter(F.split(c, r"[.!?…]+"), lambda x: F.trim(F.regexp_replace(x, r"[\r\n\t]", " ")) != ""))


def sentences_by_gap(c: Column) -> Column:
    """Variant b: one more than the gaps after . ! ?"""
    return F.when(F.trim(c) == "", 0).otherwise(count_matches(F.regexp_replace(c, r"[ \t\r\n]+$", ""), r"[.!?][ \t\r\n]+") + 1)


def sentences_closed(c: Column) -> Column:
    """Variant c: closed sentences, at least 1."""
    return F.greatest(count_matches(c, r"[^.!?]+[.!?]+"), F.lit(1))


def sentences_spaced(c: Column) -> Column:
    """Variant d: non-blank pieces between marks that white space follows."""
    return F.size(F.filter(F.split(c, r"[.!?。।]+[ \t\r\n]+"), lambda x: F.trim(x) != ""))


def token_estimate(c: Column) -> Column:
    """Words times 1.3, rounded half up."""
    return F.floor(F.size(F.filter(F.split(squash(c), " "), lambda x: x != "")) * F.lit(1.3) + F.lit(0.5)).cast("long")


def guarded(c: Column, phrase: str) -> Column:
    """Whether a phrase stands with no ASCII word character on either side, in any case."""
    from re import escape

    return F.coalesce(F.lower(c).rlike(rf"(^|[^a-z0-9_]){escape(phrase.lower())}([^a-z0-9_]|$)"), F.lit(False))


def contains_any(c: Column, phrases: list[str]) -> Column:
    low = F.lower(c)
    out = F.lit(False)
    for p in phrases:
        out = out | F.coalesce(F.contains(low, F.lit(p.lower())), F.lit(False))
    return out


def first_hit(c: Column, phrases: list[str]) -> Column:
    """The first phrase of the list (list order) that the text holds, or null."""
    low = F.lower(c)
    return F.coalesce(*[F.when(F.contains(low, F.lit(p.lower())), F.lit(p)) for p in phrases])


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two arrays; 0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def char_bigrams(c: Column) -> Column:
    def of(t: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substr(t, i, F.lit(2)))
        return F.when(F.length(t) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(pairs))

    return let(c, of)


def ngrams(ws: Column, n: int) -> Column:
    """Word n-grams, joined by spaces, in order."""

    def of(w: Column) -> Column:
        size = F.size(w)
        runs = F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
        return F.when(size < n, F.array().cast("array<string>")).otherwise(runs)

    return let(ws, of)


def window_hours(c: Column) -> Column:
    """Hours of '3 days', '1.5 weeks' and the like; null for anything else."""
    amount = F.regexp_extract(F.lower(c), r"([0-9]+(\.[0-9]+)?)[ ]*(hour|day|week|month)s?", 1)
    unit = F.regexp_extract(F.lower(c), r"([0-9]+(\.[0-9]+)?)[ ]*(hour|day|week|month)s?", 3)
    # Hours of each unit.
    hours = F.when(unit == "hour", 1).when(unit == "day", 24).when(unit == "week", 168).when(unit == "month", 720)
    return F.when(amount != "", amount.try_cast("double") * hours)
