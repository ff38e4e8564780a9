"""How likely a text is complete, judged by its closing words.

A model of sentence ends is counted over all texts.  For a sentence's opening two words, for word pairs and for single words
it holds how often they close a sentence and how often the sentence goes on.  The
last sentence of a text is never used as evidence of an end unless it bears a
closing mark, so cut texts don't teach the model that cuts are ends.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.runtime import salted_join, salts_for, settle

#: Most entries that the driver and the workers hold; with more, texts are joined to the entries they ask for (``asked``, ``answers``).
MAX_ENTRIES = 1_000_000
#: Keys that a task holds before it gives its counts out.
TASK_ENTRIES = 500_000
#: Whole closing lines without a mark count as complete from this many sightings on.
CLOSING_LINES = 3

_CUT = re.compile(r"(?<=[.!?…])[»\")\]]*\s+|\s*\n\s*")
_WORD = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*")
_HIDDEN = re.compile("[­​-‏⁠﻿️]")
_END = re.compile(r"[.!?][»\"”’')\]*_`]*$")
_TAIL_EXTRAS = re.compile(r"(?:\s*(?:#[^\s#]+|\[\d+\]|[:;]-?[)(DP]|<3|[\U0001F300-\U0001FAFF☀-➿]+|\([^()\n]*\)))+\s*$")
_MARKS = re.compile(r"\s*(?:\[\s*(?:\.\.\.|…)\s*\]|\(\s*(?:\.\.\.|…)\s*\)|…|\.\.\.+|--+>?|→|>>)\s*$")
_HARD_MARK = re.compile(r"(?:\[\s*(?:\.\.\.|…)\s*\]|\(\s*(?:\.\.\.|…)\s*\))\s*$")
_BROKEN = re.compile(r"�\s*$|&#?\w{0,7}$|<(?!3\s*$)[^<>\n]{0,40}$|\\u?[0-9a-f]{0,4}$")
_ITEM = re.compile(r"^\s*(?:[-*•]|\d+[.)])\s+")
_BULLET = re.compile(r"^\s*(?:[-*•—–]|\d+[.)])\s*")


def words(text: str) -> list[str]:
    """Lower-case words; all numbers are one word."""
    return ["0" if w[0].isdigit() and w.isdigit() else w for w in _WORD.findall(text.lower())]


def line(sentence: str) -> list[str]:
    """The words of a sentence; a list item's first word bears a sign, so items have counts of their own."""
    w = words(_BULLET.sub("", sentence))
    if w and _ITEM.match(sentence):
        w[0] = f"•{w[0]}"
    return w


def clean(text: str) -> str:
    return _HIDDEN.sub("", text).rstrip()


def sentences(text: str) -> list[str]:
    return [s for s in _CUT.split(text) if s and s.strip()]


def counts(texts, held: tuple[Counter, Counter, Counter] | None = None) -> tuple[Counter, Counter, Counter]:
    """(ends, goes on, unmarked last lines) by key of the texts, added to ``held``."""
    end, on, last = held = held or (Counter(), Counter(), Counter())
    goes: list[str] = []
    stops: list[str] = []
    for text in texts:
        if not text:
            continue
        parts = sentences(clean(text))
        for k, s in enumerate(parts):
            w = line(s)
            if not w:
                continue
            if k == len(parts) - 1 and not _END.search(s):
                last[" ".join(w)] += 1
                continue
            if len(w) == 1:
                stops += w[0], f"|{w[0]}"
                continue
            body, start = w[:-1], f"{w[0]} {w[1]}|"
            goes += body
            goes.append(f"|{w[0]}")
            goes += [start + x for x in body[1:]]
            goes += map(">".join, zip(body, body[1:], strict=False))
            stops += w[-1], start + w[-1], f"{w[-2]}>{w[-1]}"
    on.update(goes)
    end.update(stops)
    return held


def _count_batches(batches):
    """Counts of a task's texts, given out whenever they reach TASK_ENTRIES keys."""

    def rows(end, on, last):
        keys = list(end.keys() | on.keys())
        n = len(keys) + len(last)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(["w"] * len(keys) + ["l"] * len(last), pa.string()), pa.array(keys + list(last), pa.string()),
                pa.array([end[k] for k in keys] + list(last.values()), pa.int64()), pa.array([on[k] for k in keys] + [0] * (n - len(keys)), pa.int64()),
            ],
            ["kind", "key", "n_end", "n_on"],
        )

    held = Counter(), Counter(), Counter()
    for batch in batches:
        counts(batch.column(0).to_pylist(), held)
        if sum(map(len, held)) > TASK_ENTRIES:
            yield rows(*held)
            held = Counter(), Counter(), Counter()
    yield rows(*held)


class Terminality:
    """Counts of sentence ends; picklable."""

    def __init__(self, ends: dict[str, tuple[int, int]], last: dict[str, int]):
        self.ends, self.last = ends, last
        self.vocabulary = sorted(k for k in ends if "|" not in k and ">" not in k)
        self.starts = sorted({k.split("|")[0] for k in ends if "|" in k and k[0] != "|"})
        self.pairs = sorted(k for k in ends if ">" in k)

    @staticmethod
    def _begins(known: list[str], w: str) -> bool:
        """Whether w only begins a known entry and is none itself."""
        i = bisect_left(known, w)
        return i < len(known) and known[i] != w and known[i].startswith(w)

    def closing(self, w: list[str]) -> float:
        """Probability that a sentence of these words is complete."""
        last, start = w[-1], " ".join(w[:2])
        key = f"{start}|{last}" if len(w) > 1 else f"|{last}"
        e, m = self.ends.get(key, (0, 0))
        if e + m >= 2:
            return e / (e + m)
        whole = self.last.get(" ".join(w), 0)
        if len(w) >= 3 and whole >= CLOSING_LINES and not sum(self.ends.get(f"{start}|{w[1]}", (0, 0))):
            return 0.95  # a closing line of its own: no other sentence opens so
        partial = last not in self.ends and self._begins(self.vocabulary, last)
        if partial or len(w) == 2 and self._begins(self.starts, start):
            return 0.02
        if whole >= CLOSING_LINES and not m:
            return 0.95
        if len(w) > 1:
            pair = f"{w[-2]}>{last}"
            e, m = self.ends.get(pair, (0, 0))
            if e + m >= 2:
                return e / (e + m)
            if not e + m and self._begins(self.pairs, pair):
                return 0.1
        e, m = self.ends.get(last, (0, 0))
        if e + m < 3 and self._begins(self.vocabulary, last):
            return 0.05
        if e + m:
            return (e + 0.2) / (e + m + 0.5) * (0.8 if len(w) > 1 else 1.0)
        return 0.3

    def _seen(self, w: list[str]) -> int:
        """Sightings of a sentence that opens like this with this last word in it."""
        return sum(self.ends.get(f"{' '.join(w[:2])}|{w[-1]}" if len(w) > 1 else f"|{w[0]}", (0, 0)))

    def complete(self, text: str | None) -> float:
        """Probability that ``text`` ends where it should; 1.0 for a text without words."""
        text = clean(text or "")
        if not text:
            return 1.0
        if _BROKEN.search(text):
            return 0.01
        if _HARD_MARK.search(text):
            return 0.03
        if _END.search(text) and not text.endswith("..."):
            return 0.99
        shown = _TAIL_EXTRAS.sub("", text).rstrip()
        if not shown:
            return 0.95
        if shown != text and (_END.search(shown) and not shown.endswith("...") or shown.endswith("…")):
            return 0.97
        core = shown
        while _MARKS.search(core):
            core = _MARKS.sub("", core).rstrip()
        if core != shown and _END.search(core):
            return 0.9
        if not core:
            return 0.9
        parts = sentences(core)
        w = line(parts[-1]) if parts else []
        if not w:
            return 0.1  # a bare bullet or dash
        p = self.closing(w)
        if core[-1] in ",;:—–-(«„“" and core == shown:
            p *= 0.1
        if core == shown and core[-1] in "»\"”" and self._seen(w) < 3:
            p = max(p, 0.8)  # closes a quotation, and nothing says that its sentence goes on
        if shown != text:  # a tag or sign follows: the text goes on after the words, so it isn't cut there
            p = max(p, 0.8)
        return p


class _Asks(Terminality):
    """Keeps the words that a text is judged by."""

    def __init__(self):
        super().__init__({}, {})
        self.w: list[str] = []

    def closing(self, w: list[str]) -> float:
        self.w = w
        return 0.5


def asked(text: str | None) -> list[tuple[str, str]]:
    """(kind, key) of all entries that ``Terminality.complete`` may look up for a text."""
    asks = _Asks()
    asks.complete(text)
    if not (w := asks.w):
        return []
    start, pair = " ".join(w[:2]), f"{w[-2]}>{w[-1]}" if len(w) > 1 else ""
    keys = [("l", " ".join(w)), ("w", w[-1]), ("v", w[-1])]
    keys += [("w", f"{start}|{w[-1]}"), ("w", f"{start}|{w[1]}"), ("w", pair), ("p", pair), ("s", start)] if pair else [("w", f"|{w[-1]}")]
    return list(dict.fromkeys(keys))


def answers(total: DataFrame) -> DataFrame:
    """(kind, key, n_end, n_on) of the counts, and which strings are or begin words (v), openings (s) and pairs (p): n_end is 1 if one is, n_on if it goes on."""
    w = total.where("kind = 'w'").select("key")
    known = w.where("not (key like '%|%' or key like '%>%')").select(F.lit("v").alias("kind"), "key", F.lit(1).alias("least"))
    pairs = w.where("key like '%>%'").select(F.lit("p").alias("kind"), "key", (F.instr("key", ">") + 1).alias("least"))
    starts = w.where("key like '%|%' and key not like '|%'").select(F.substring_index("key", "|", 1).alias("key")).distinct()
    starts = starts.select(F.lit("s").alias("kind"), "key", (F.instr("key", " ") + 1).alias("least"))
    cut = known.unionByName(pairs).unionByName(starts).select("kind", F.explode(F.sequence("least", F.length("key"))).alias("n"), F.col("key").alias("full"))
    cut = cut.select("kind", F.substring("full", F.lit(1), F.col("n")).alias("key"), (F.length("full") == F.col("n")).alias("whole"))
    cut = cut.groupBy("kind", "key").agg(F.max(F.col("whole").cast("long")).alias("n_end"), F.max((~F.col("whole")).cast("long")).alias("n_on"))
    return total.unionByName(cut)


def told(answered: list[dict] | None) -> Terminality:
    """The model of the ``answers`` to what one text asked; it judges that text as the whole model does."""
    rows = [(x["kind"], x["key"], x["n_end"], x["n_on"]) for x in answered or []]
    of = lambda kind: [r[1:] for r in rows if r[0] == kind]
    model = Terminality({k: (e, m) for k, e, m in of("w")}, {k: e for k, e, _ in of("l")})
    begins = lambda kind: sorted(x for k, e, m in of(kind) for x in [k] * e + [f"{k}\U0010ffff"] * m)
    model.vocabulary, model.starts, model.pairs = begins("v"), begins("s"), begins("p")
    return model


def tell(asks: DataFrame, total: DataFrame, tag: str) -> DataFrame:
    """(h, told): of the ``totals``, the answers to all (h, kind, key) that a text asks; ``asks`` are settled, and a text without any answer has no row."""
    often = asks.groupBy("kind", "key").agg(salts_for(F.count(F.lit(1))).alias("n_salts"))
    known = settle(answers(total).join(often, ["kind", "key"]), f"{tag}-answers")  # what nobody asks for goes
    return salted_join(asks, known, ["kind", "key"], F.col("h")).groupBy("h").agg(F.collect_list(F.struct("kind", "key", "n_end", "n_on")).alias("told"))  # ten a text at most


def totals(texts: DataFrame, text: Column) -> DataFrame:
    """(kind, key, n_end, n_on): the sentence ends of all texts.

    An opening or pair seen once is left out: it is judged by its last word alone, as one never seen.
    """
    total = texts.where(text.isNotNull()).select(text.alias("text")).mapInArrow(_count_batches, "kind string, key string, n_end long, n_on long").groupBy("kind", "key").agg(F.sum("n_end").alias("n_end"), F.sum("n_on").alias("n_on"))
    return total.where("n_end + n_on > 1 or not (key like '%|%' or key like '%>%')")


def fit(total: DataFrame) -> Terminality:
    """The model of all ``totals``, on the driver: for up to MAX_ENTRIES of them."""
    got = total.toArrow()
    ends, last = {}, {}
    for kind, key, e, m in zip(*(got.column(c).to_pylist() for c in ("kind", "key", "n_end", "n_on")), strict=True):
        if kind == "w":
            ends[key] = (e, m)
        else:
            last[key] = e
    return Terminality(ends, last)
