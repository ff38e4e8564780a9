"""Cleaning chains of model text; native expressions first, Arrow only where none exists."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import CYRILLIC, let, squash

#: Ordered rewrites (pattern, replacement); Java syntax, backreferences allowed.
CHAIN = (
    (r"(?im)^\s*(?:assistant|user|system|ответ|жауап)\s*:\s*", ""),  # role headers
    ("́", ""),  # stress marks
    (r"([!?])\1{2,}", "$1$1"),  # mark runs
    (r"\.{4,}", "..."),
    (rf"(?iu)\b([{CYRILLIC}a-z]+)(\s+\1\b){{2,}}", "$1"),  # a word three times or more
    (r"[,;]{2,}", ","),
    (r"[ \t]+([,.!?])", "$1"),  # blanks before marks
    (r"[ \t]{2,}", " "),
    (r"\n{3,}", "\n\n"),
)


def clean_chain(c: Column) -> Column:
    """The rewrites of CHAIN in order, trimmed."""
    for pattern, to in CHAIN:
        c = F.regexp_replace(c, pattern, to)
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def complete_head(c: Column, least: int = 30) -> Column:
    """The text up to its last closed sentence; the whole text if that leaves under ``least`` characters."""

    def of(t: Column) -> Column:
        head = F.regexp_extract(t, r"(?s)^(.*[.!?…])(?:[»\")\]]*)(?:\s|$)", 1)
        return F.when((F.length(head) >= least) & (F.length(head) < F.length(t)), head).otherwise(t)

    return let(c, of)


def answer_after_thinking(tokens: Column, start: str, end: str) -> Column:
    """Tokens after the last end mark; none if thinking was opened and never closed."""

    def of(t: Column) -> Column:
        n = F.size(t)
        back = F.array_position(F.reverse(t), end)
        closed = F.slice(t, F.when(back > 0, n - back + 2).otherwise(F.lit(1)).cast("int"), n)
        return F.when(n == 0, t).when(back > 0, closed).when(F.array_contains(t, start), F.array().cast("array<string>")).otherwise(t)

    return let(tokens, of)


def strip_latin_leaks(c: Column, most: float = 0.3) -> Column:
    """Latin words out of a Cyrillic text, short brackets with them; null where over ``most`` of the words were Latin."""
    latin = F.coalesce(F.regexp_count(c, F.lit("[A-Za-z]+")), F.lit(0))
    cyr = F.coalesce(F.regexp_count(c, F.lit(f"[{CYRILLIC}]+")), F.lit(0))
    out = squash(F.regexp_replace(F.regexp_replace(c, r"\([^()]*[A-Za-z][^()]*\)", ""), r"[A-Za-z][A-Za-z'’-]*", ""))
    out = F.regexp_replace(out, r"\s+([,.!?])", "$1")
    return F.when(cyr == 0, c).when(latin > (latin + cyr) * most, F.lit(None).cast("string")).otherwise(out)


def stable_pick(seed: Column, n: int) -> Column:
    """int(sha256(seed)) mod n, folded over the 64 hexadecimal digits (256 bits never fit a number)."""
    digits = F.split(F.sha2(seed, 256), "")
    value = lambda d: F.instr(F.lit("0123456789abcdef"), d) - 1
    return F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0).cast("long"), lambda a, d: (a * 16 + value(d)) % n)


def _nfkc(texts: pd.Series) -> pd.Series:
    hidden = re.compile("[​-‍⁠﻿­]")
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", hidden.sub("", t)).split()))


def nfkc(c: Column) -> Column:
    """NFKC without invisible characters, squashed; no native expression does it."""
    return F.pandas_udf(_nfkc, "string")(c)


def lcg_order(n: int, seed: int) -> list[int]:
    """Fisher-Yates order of n rows by a 32-bit linear congruential generator."""
    # Multiplier and increment of the generator.
    state, order = seed % 2**32, list(range(n))
    for i in range(n - 1, 0, -1):
        state = (1664525 * state + 1013904223) % 2**32
        j = state * (i + 1) // 2**32
        order[i], order[j] = order[j], order[i]
    return order


def lcg_split(rows: DataFrame, id_col: str, stratum: str, share: float = 0.1) -> DataFrame:
    """(id, stratum, split) by the generator's order within each stratum.

    For replaying small historical splits only: the generator is sequential, so a
    stratum is one task's work.  ``sampling.stratified_split`` is the operator for
    data of any size.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(id_col, ignore_index=True)
        name = f[stratum].iloc[0] or ""
        n_val = int(len(f) * share + 0.5)
        order = lcg_order(len(f), len(name) * 7919 + len(f))
        split = pd.Series("train", index=range(len(f)))
        split.iloc[order[:n_val]] = "val"
        return pd.DataFrame({id_col: f[id_col], stratum: f[stratum], "split": split})

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, stratum).groupBy(stratum).applyInPandas(run, f"{id_col} {kind}, {stratum} string, split string")


def overlay(base: Column, patch: Column) -> Column:
    """Map ``base`` with ``patch`` over it; the patch wins."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(patch, k)), patch)


def minimal_clean(c: Column, leaks: list[str]) -> Column:
    """One pass: leaked strings out, a word said three times or more once, runs of stops and blanks as an ellipsis, edges bare,
    and a tail without closing mark cut back to the last sentence end, if that keeps more than six tenths."""
    out = c
    for x in leaks:
        out = F.replace(out, F.lit(x), F.lit(""))
    out = F.regexp_replace(out, r"(?iU)(\b\w+\b)(\s+\1){2,}", "$1")
    out = F.regexp_replace(out, r"[.,\s]{3,}", "... ")
    out = F.regexp_replace(out, r"^[ ,.:;\n\t]+|[ ,.:;\n\t]+$", "")
    # The first kind of end that lies far enough on, in the order full stop, question, exclamation.
    ends = [F.length(out) - F.length(F.substring_index(out, mark, -1)) - len(mark) for mark in (". ", "? ", "! ")]
    far = F.coalesce(*[F.when(F.contains(out, F.lit(mark)) & (e > F.length(out) * 0.6), e) for mark, e in zip((". ", "? ", "! "), ends, strict=True)])
    cut = F.when(~out.rlike(r"[.!?]$") & far.isNotNull(), F.substring(out, F.lit(1), far + 1)).otherwise(out)
    return F.coalesce(F.regexp_replace(cut, r"^\s+|\s+$", ""), F.lit(""))
