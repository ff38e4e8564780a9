"""Problem 6: missing or wrong document language labels.

Word-first backoff: a known word scores its per-language log frequency; an unseen
one falls back to progressively shorter character n-grams.  A text's words are
then cut into segments of one language by dynamic programming with a price for
each switch, so borrowed words stay inside their sentence.

Words of languages written in Cyrillic are also learnt in romanised form, so a
language is the same whatever its script.

The model is fitted on a bounded sample of labelled rows (FIT_ROWS, chosen by
hash); labels and segments are given for all rows and whole texts.

Defined cases: null or wordless texts get no segment and no language; ties go to
the language that is first by name; digits and symbols carry no evidence.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.tokens import usual_lang

#: Most labelled rows the model is fitted on.
FIT_ROWS = 60_000
#: Most words kept per language, the most frequent ones.
MAX_WORDS = 60_000
#: Longest character n-gram for unseen words.
NGRAM = 4
#: Log-odds price of switching the language between two words.
SWITCH = 7.0
#: A segment counts as a language of the text from this many words on, or if it holds a whole sentence of two words or more.
CLAUSE_WORDS = 4

# Usual romanisation of Cyrillic letters, Kazakh ones included.
ROMAN = dict(
    zip(
        "абвгдеёжзийклмнопрстуфхцчшщъыьэюяәғқңөұүһі",
        "a b v g d e yo zh z i y k l m n o p r s t u f h ts ch sh sch  y  e yu ya a g q n o u u h i".split(" "),
        strict=True,
    )
)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")
_HIDDEN = re.compile("[­​-‏⁠﻿]")


def romanise(word: str) -> str:
    return "".join(ROMAN.get(c, c) for c in word)


def holds_sentence(text: str, start: int, end: int) -> bool:
    """Whether the words from ``start`` to ``end`` of a text hold a sentence of two words or more from its first to its last."""
    at = 0
    for part in _SENTENCE.split(text):
        n = len(words(part))
        if n > 1 and start <= at and at + n <= end:
            return True
        at += n
    return False


def words(text: str | None) -> list[str]:
    return _WORD.findall(_HIDDEN.sub("", text).lower()) if text else []


class Model:
    """Log frequencies of words and n-grams per language; a plain picklable object."""

    def __init__(self, counts: dict[str, Counter]):
        self.langs = sorted(counts)
        counts = {k: counts[k] + Counter() for k in self.langs}
        self._purify(counts)
        grams = {k: [Counter() for _ in range(NGRAM + 1)] for k in self.langs}
        roman = {k: Counter() for k in self.langs}
        for k, c in counts.items():
            for w, n in c.items():
                r = romanise(w)
                if r != w:
                    roman[k][r] += max(1, n // 4)
        for k in self.langs:
            counts[k].update(roman[k])
            for w, n in counts[k].items():
                shown = f"^{w}$"
                for size in range(1, NGRAM + 1):
                    for i in range(len(shown) - size + 1):
                        grams[k][size][shown[i : i + size]] += n
        totals = {k: sum(counts[k].values()) + 1 for k in self.langs}
        every = set().union(*counts.values()) if counts else set()
        self.words = {w: tuple(math.log((counts[k][w] + 0.05) / totals[k]) for k in self.langs) for w in every}
        self.grams: list[dict[str, tuple[float, ...]]] = [{}]
        for size in range(1, NGRAM + 1):
            t = {k: sum(grams[k][size].values()) + 1 for k in self.langs}
            seen = set().union(*(grams[k][size] for k in self.langs)) if self.langs else set()
            self.grams.append({g: tuple(math.log((grams[k][size][g] + 0.5) / t[k]) for k in self.langs) for g in seen if sum(grams[k][size][g] for k in self.langs) >= 3})
        self.cache: dict[str, tuple[float, ...]] = {}

    def _purify(self, counts: dict[str, Counter]) -> None:
        """Words with under a tenth of their relative frequency in a language come from wrong labels there."""
        totals = {k: sum(c.values()) or 1 for k, c in counts.items()}
        for w in set().union(*counts.values()) if counts else ():
            rate = {k: counts[k][w] / totals[k] for k in counts}
            top = max(rate.values())
            for k, r in rate.items():
                if r and r < 0.1 * top:
                    del counts[k][w]

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def scores(self, word: str) -> tuple[float, ...]:
        """Log evidence per language, bounded so that one word can't decide a text."""
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) > 300_000:
                self.cache.clear()
            raw = self.words.get(word)
            if raw is None:
                raw = self._backoff(word)
            top = max(raw, default=0.0)
            got = self.cache[word] = tuple(max(x - top, -6.0) for x in raw)
        return got

    def _backoff(self, word: str) -> tuple[float, ...]:
        shown = f"^{word}$"
        total = [0.0] * len(self.langs)
        for size in range(NGRAM, 0, -1):
            hits = [g for i in range(len(shown) - size + 1) if (g := self.grams[size].get(shown[i : i + size]))]
            if len(hits) * 2 >= len(shown) - size + 1 and hits:
                for g in hits:
                    for i, x in enumerate(g):
                        total[i] += x / len(hits) * 2
                break
        return tuple(total)

    def segments(self, text: str | None) -> list[tuple[str, int, float]]:
        """(language, words, confidence) of each segment in order."""
        ws = words(text)
        if not ws or not self.langs:
            return []
        n = len(self.langs)
        best = [0.0] * n
        back: list[list[int]] = []
        evidence = [self.scores(w) for w in ws]
        for e in evidence:
            top = max(range(n), key=lambda i: (best[i], -i))
            gate = best[top] - SWITCH
            row = [i if best[i] >= gate else top for i in range(n)]
            best = [max(best[i], gate) + e[i] for i in range(n)]
            back.append(row)
        at = max(range(n), key=lambda i: (best[i], -i))
        path = [at]
        for row in reversed(back[1:]):
            at = row[at]
            path.append(at)
        path.reverse()
        out, i = [], 0
        while i < len(path):
            j = i
            total = [0.0] * n
            while j < len(path) and path[j] == path[i]:
                for k, x in enumerate(evidence[j]):
                    total[k] += x
                j += 1
            peak = max(total)
            share = math.exp(total[path[i]] - peak) / sum(math.exp(x - peak) for x in total)
            out.append((self.langs[path[i]], j - i, share))
            i = j
        return out

    def languages(self, texts: list[str | None]) -> list[tuple[str, int, float]]:
        """(language, words, confidence) of each language of at least one clause, most words first."""
        size: dict[str, int] = defaultdict(int)
        weight: dict[str, float] = defaultdict(float)
        biggest: dict[str, int] = defaultdict(int)
        for t in texts:
            at = 0
            for k, n, share in self.segments(t):
                size[k] += n
                weight[k] += share * n
                # A whole sentence counts, however short.
                whole = 1 < n < CLAUSE_WORDS and holds_sentence(t, at, at + n)
                biggest[k] = max(biggest[k], CLAUSE_WORDS if whole else n)
                at += n
        kept = [k for k in size if biggest[k] >= CLAUSE_WORDS] or ([max(sorted(size), key=size.get)] if size else [])
        return sorted(((k, size[k], weight[k] / size[k]) for k in kept), key=lambda x: (-x[1], x[0]))


def _fold_words(batches):
    """Word counts per language of each batch, so that only counts are shuffled."""
    for batch in batches:
        total: dict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[lang].update(words(text))
        rows = [(k, w, n) for k, c in total.items() for w, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])


def fit(labelled: DataFrame, lang: Column, text: Column, id_col: Column, n_rows: int | None = None, fit_rows: int = FIT_ROWS, max_words: int = MAX_WORDS) -> Model:
    """Fit on at most about ``fit_rows`` rows, those of smallest hash; MAX_WORDS words per language reach the driver."""
    from pyspark.sql import Window

    n = labelled.count() if n_rows is None else n_rows
    part = min(1.0, fit_rows / max(n, 1))
    picked = labelled.where(F.pmod(F.xxhash64(id_col, F.lit("fit")), F.lit(1 << 20)) < int(part * (1 << 20)) + (part == 1.0))
    rows = picked.select(usual_lang(lang).alias("lang"), text.alias("text")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(_fold_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("r") <= max_words)
    got: dict[str, Counter] = defaultdict(Counter)
    for r in top.select("lang", "word", "n").collect():
        got[r["lang"]][r["word"]] = r["n"]
    return Model(dict(got))


def label_rows(rows: DataFrame, id_col: str, texts: Column, model: Model) -> DataFrame:
    """(id, langs array<struct<lang, words, confidence>>): the languages each row holds.

    ``texts`` is an array of strings; segments don't run over its elements.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model)  # MAX_WORDS words per language at most

    def run(batches):
        m = shared.value
        kind = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32()), ("confidence", pa.float64())]))
        for batch in batches:
            out = [[{"lang": k, "words": n, "confidence": c} for k, n, c in m.languages(t or [])] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["id", "langs"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("id"), texts.alias("texts")).mapInArrow(run, f"id {kind}, langs array<struct<lang:string,words:int,confidence:double>>")


def segment_rows(rows: DataFrame, id_col: str, texts: Column, model: Model) -> DataFrame:
    """(id, msg_idx, seg_idx, lang, words, confidence): every segment of every text."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # MAX_WORDS words per language at most
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        m = shared.value
        for batch in batches:
            got = [(i, a, b, *s) for i, ts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for a, t in enumerate(ts or []) for b, s in enumerate(m.segments(t))]
            types = (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in got], t) for i, t in enumerate(types)], ["id", "msg_idx", "seg_idx", "lang", "words", "confidence"])

    return rows.select(F.col(id_col).alias("id"), texts.alias("texts")).mapInArrow(run, f"id {kind}, msg_idx int, seg_idx int, lang string, words int, confidence double")


def contents(messages: str = "messages") -> Column:
    return F.transform(messages, lambda m: m["content"])


def synth_model(synth: DataFrame) -> Model:
    """The model of problem 6, fitted on labelled dialogues."""
    text = F.array_join(F.filter(contents(), lambda x: x.isNotNull()), "\n")
    return fit(synth, F.col("meta.locale"), text, F.col("rec_id"))


def relabel(synth: DataFrame, model: Model | None = None) -> DataFrame:
    """(rec_id, given, langs): every record with its given label (null if unusable) and its languages."""
    model = model or synth_model(synth)
    tagged = synth.select("rec_id", "messages", usual_lang(F.col("meta.locale")).alias("given"))
    shared = tagged.select(F.struct("rec_id", "given").alias("key"), "messages")
    return label_rows(shared, "key", contents(), model).select("id.rec_id", "id.given", "langs")


def mislabelled(synth: DataFrame) -> DataFrame:
    """(rec_id, lang): records without a right label or of several languages, a row per language they hold."""
    t = relabel(synth).where("size(langs) > 0")
    wrong = F.col("given").isNull() | (F.size("langs") > 1) | (F.col("langs")[0]["lang"] != F.col("given"))
    return t.where(wrong).select("rec_id", F.explode("langs.lang").alias("lang"))
