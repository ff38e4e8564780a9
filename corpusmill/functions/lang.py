"""Script and language rules, Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import CJK, CYRILLIC, KAZAKH_ONLY, LATIN, count_matches, letters


def cyrillic_share(c: Column) -> Column:
    """Cyrillic share of the Latin and Cyrillic letters; 0 without letters."""
    cyr = letters(c, CYRILLIC)
    return F.coalesce(F.try_divide(cyr, cyr + letters(c, LATIN)), F.lit(0.0))


def by_ratio(c: Column, high: float = 0.30) -> Column:
    """ru from a share of Cyrillic letters on, else en."""
    return F.when(cyrillic_share(c) >= high, "ru").otherwise("en")


def with_kazakh(c: Column, share: float = 0.05) -> Column:
    """kk where more than ``share`` of the Cyrillic letters are Kazakh only; else ru or en."""
    cyr, kk = letters(c, CYRILLIC), letters(c, KAZAKH_ONLY)
    return F.when(kk > cyr * share, "kk").when(cyr > letters(c, LATIN), "ru").otherwise("en")


def intent(c: Column) -> Column:
    """The language a message asks to be answered in; null without letters."""
    cyr, lat, kk = letters(c, CYRILLIC), letters(c, LATIN), letters(c, KAZAKH_ONLY)
    cyr_words = count_matches(c, f"[{CYRILLIC}]+")
    return F.when((kk > 0) & (cyr >= 2), "kk").when((cyr >= 15) | (cyr_words >= 2), "ru").when(cyr + lat == 0, F.lit(None).cast("string")).when(cyr > lat, "ru").otherwise("en")


def resolve(c: Column, locale: Column) -> Column:
    """Intent, else a known locale, else en."""
    known = F.lower(F.trim(locale))
    return F.coalesce(intent(c), F.when(known.isin("en", "ru", "kk"), known), F.lit("en"))


def cjk_drift(c: Column) -> Column:
    """6 CJK characters or more, or 6 % of all letters."""
    n = letters(c, CJK)
    total = n + letters(c, CYRILLIC) + letters(c, LATIN)
    return (n >= 6) | ((n > 0) & (n >= total * 0.06))


def latin_run(c: Column, n: int = 3) -> Column:
    """Whether n Latin words stand in a row."""
    return F.coalesce(c.rlike(r"([A-Za-z]{2,}[ ]+){%d}[A-Za-z]{2,}" % (n - 1)), F.lit(False))


def latin_word_share(c: Column) -> Column:
    lat, cyr = count_matches(c, "[A-Za-z]+"), count_matches(c, f"[{CYRILLIC}]+")
    return F.coalesce(F.try_divide(lat, lat + cyr), F.lit(0.0))


def script_leak(c: Column) -> Column:
    """The kind of foreign script in a Cyrillic text, or null: run, ratio or any."""
    has = letters(c, CYRILLIC) > 0
    return F.when(has & latin_run(c), "run").when(has & (latin_word_share(c) > 0.12), "ratio").when(has & (letters(c, LATIN) > 0), "any")


def fallback_chain(lang: Column) -> Column:
    """Languages to search in order."""
    # Each language's chain.
    return (
        F.when(lang == "en", F.array(F.lit("en"))).when(lang == "ru", F.array(F.lit("ru"), F.lit("en"))).when(lang == "kk", F.array(F.lit("kk"), F.lit("ru"), F.lit("en")))
        .otherwise(F.array(lang, F.lit("en")))
    )
