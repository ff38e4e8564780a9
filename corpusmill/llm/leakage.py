"""Problem 8: evaluation texts leaking into training text.

Texts become word lists in which numbers, names and units are typed
placeholders; a name is told by its form (capitalised inside a sentence), in either
text by itself, so a name that no item holds is one too.  Hashes of all windows of
WINDOW canonical words are joined with those of the evaluation items.  Windows
with names count twice, with the names as placeholders and as words, so a passage
in other letter case is still found.  The values in the slots then tell an exact
leak (all equal in a window) from a re-parameterised one: over all windows of a
passage each item value goes to one value.

Defined cases: null or short texts (under WINDOW words) match nothing; words are
runs of letters and digits after case folding, invisible characters removed;
windows repeated within an item or a document count once; empty tables give no
rows; a name at the start of its sentence only is a word like any other.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.runtime import salts_for, settle

WINDOW = 12
#: Item windows up to this number are broadcast (8 bytes each, with their slots about 200); beyond, a salted shuffle join.
BROADCAST_WINDOWS = 500_000

# Words of measure in the three languages.
UNITS = frozenset(
    "second seconds minute minutes hour hours day days week weeks month months year years time times step steps percent kilo kilos meter meters "
    "секунд секунды минут минуты минуту час часа часов день дня дней неделя недели недель месяц месяца месяцев год года лет раз раза шаг шага шагов процентов метров "
    "секунд минут сағат күн апта ай жыл рет қадам пайыз метр".split()
)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SHOWN = re.compile(r"[^\W_]+")
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_NAME = re.compile(r"(?<=[\w,;:—–] )[A-ZА-ЯЁӘҒҚҢӨҰҮІ][^\W\d_]{2,}")


def words(text: str | None) -> list[str]:
    return _SHOWN.findall(_HIDDEN.sub("", text).lower()) if text else []


def names(text: str) -> frozenset[str]:
    """Words that stand capitalised inside a sentence of ``text``."""
    return frozenset(w.lower() for w in _NAME.findall(_HIDDEN.sub("", text)))


def _hash64(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "little")


class Canon:
    """Words to (canonical hash, raw hash, whether a slot); a bounded cache per process."""

    def __init__(self, size: int = 500_000):
        self.size = size
        self.cache: dict[str, tuple[int, int, bool]] = {}

    def __call__(self, w: str) -> tuple[int, int, bool]:
        got = self.cache.get(w)
        if got is None:
            if len(self.cache) >= self.size:
                self.cache.clear()
            kind = "<num>" if any(c.isdigit() for c in w) else "<unit>" if w in UNITS else None
            got = self.cache[w] = (_hash64(kind or w), _hash64(w), kind is not None)
        return got


def _windows(values: np.ndarray, power: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Rolling hash of each WINDOW consecutive values."""
    with np.errstate(over="ignore"):
        part = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power[: len(values)], dtype=np.uint64)])
        n = len(values) - WINDOW + 1
        return (part[WINDOW:] - part[:n]) * inverse[:n]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = lambda b: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1), b, np.uint64)]))
        return up(_BASE), up(_INVERSE)


_NAME_HASH = _hash64("<name>")
_ROWS = "key {0}, pos int, h long, raw long, slots array<string>"


def text_windows(text: str, canon: Canon, wanted: np.ndarray | None) -> list[tuple[int, int, int, list[str]]]:
    """(position, template hash, raw hash, slot values) of the windows of a text, or of those in ``wanted``."""
    ws = words(text)
    if len(ws) < WINDOW:
        return []
    got = [canon(w) for w in ws]
    power, inverse = _powers(len(ws))
    as_words = np.fromiter((g[0] for g in got), np.uint64, len(got))
    slot = np.fromiter((g[2] for g in got), bool, len(got))
    known = names(text)
    named = np.fromiter((w in known for w in ws), bool, len(ws)) & ~slot if known else np.zeros(len(ws), bool)
    variants = [(_windows(as_words, power, inverse).view(np.int64), np.ones(len(ws) - WINDOW + 1, bool), slot)]
    if named.any():
        held = np.concatenate([[0], np.cumsum(named)])
        h = _windows(np.where(named, np.uint64(_NAME_HASH), as_words), power, inverse).view(np.int64)
        variants.append((h, held[WINDOW:] > held[: len(h)], slot | named))
    raw = None
    out = []
    for h, use, slots in variants:
        if wanted is not None:
            place = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
            use = use & (wanted[place] == h)
        at = np.flatnonzero(use)
        if not len(at):
            continue
        if raw is None:
            raw = _windows(np.fromiter((g[1] for g in got), np.uint64, len(got)), power, inverse).view(np.int64)
        out += [(int(i), int(h[i]), int(raw[i]), [ws[j] for j in range(i, i + WINDOW) if slots[j]]) for i in at]
    return out


def _window_batches(shared):
    """Arrow batches (key, text) -> (key, pos, h, raw, slots) of all windows, or of those in ``shared``."""

    def run(batches):
        canon = Canon()
        wanted = shared.value if shared else None
        for batch in batches:
            rows = [(key, *w) for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if text for w in text_windows(text, canon, wanted)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["key", "pos", "h", "raw", "slots"])

    return run


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "id", item_text: str = "message") -> DataFrame:
    """(doc_id, item_id, exact, reparameterised, n_windows) of each document and item that share a window.

    Up to BROADCAST_WINDOWS item windows, their hashes go to all tasks and documents give only windows that may match; beyond,
    all windows are joined by hash, frequent ones over salts.  The rows are the same.
    """
    spark = docs.sparkSession
    texts = items.select(F.col(item_id).cast("string").alias("key"), F.col(item_text).alias("text"))
    win = texts.mapInArrow(_window_batches(None), _ROWS.format("string"))
    win = win.groupBy(F.col("key").alias("item_id"), "h", F.col("raw").alias("item_raw")).agg(F.min(F.struct("pos", "slots")).alias("w"))  # a repeated window counts once
    win = settle(win.select("item_id", "h", "item_raw", F.col("w.pos").alias("item_pos"), F.col("w.slots").alias("item_slots")), "leak-items")
    small = win.count() <= BROADCAST_WINDOWS
    shared = None
    if small:
        wanted = win.select("h").distinct().toArrow().column("h").to_numpy()  # BROADCAST_WINDOWS at most
        shared = spark.sparkContext.broadcast(np.sort(wanted) if len(wanted) else np.zeros(1, np.int64))
    kind = docs.schema[doc_id].dataType.simpleString()
    hits = docs.select(doc_id, doc_text).mapInArrow(_window_batches(shared), _ROWS.format(kind))
    if small:
        both = hits.join(F.broadcast(win), "h")
    else:
        hits = settle(hits, "leak-windows")
        often = hits.groupBy("h").agg(salts_for(F.count(F.lit(1))).alias("n_salts")).where("n_salts > 1")
        salted = F.broadcast(often)  # windows / ROWS_PER_SALT at most
        hits = hits.join(salted, "h", "left").withColumn("salt", F.pmod(F.xxhash64("key", "pos"), F.coalesce("n_salts", F.lit(1))).cast("int")).drop("n_salts")
        spread = win.join(salted, "h", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("n_salts", F.lit(1)) - 1))).drop("n_salts")
        both = hits.join(spread, ["h", "salt"])
    same = (F.col("raw") == F.col("item_raw")) & (F.col("slots") == F.col("item_slots"))
    # A passage is a run of windows at one distance between the two texts; it has as many windows as an item at most.
    passage = both.groupBy("key", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(
        F.max(same).alias("exact"), F.max(~same).alias("differs"), F.countDistinct("pos").alias("n_windows"),
        F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("item_slots", "slots")))).alias("pairs"),
    )
    values = F.transform("pairs", lambda p: p["item_slots"])
    one_to_one = F.size("pairs") == F.size(F.array_distinct(values))
    marked = passage.select(F.col("key").alias(doc_id), "item_id", "exact", (F.col("differs") & one_to_one).alias("shifted"), "n_windows")
    return marked.where("exact or shifted").groupBy(doc_id, "item_id").agg(F.max("exact").alias("exact"), F.max("shifted").alias("reparameterised"), F.sum("n_windows").alias("n_windows"))
