"""Problem 10: text cut off by field limits.

Near-copies are found by min-hash banding over shingles of five words (one row
per distinct text takes part); within a band's bucket every text that may be cut is compared
with every text that is as long or longer, large buckets in blocks of BLOCK x BLOCK
texts, and a copy whose words run along the other's and stop early
is taken for cut unless it ends complete.  All other texts are scored by the
terminality of their closing words.

Defined cases: null and empty texts aren't cut; texts under five words have no
near-copies; repeated texts share one verdict; texts that end in a mark of closure, list item, tag, sign or reference are
complete.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import terminality
from corpusmill.llm.terminality import Terminality
from corpusmill.runtime import block_join, salted_join, salts_for, settle

SHINGLE = 5
#: Bands x rows: a pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8**4)**12 = 0.998.
BANDS, ROWS = 12, 4
SIMILAR = 0.8
#: Texts of a bucket that meet in one task.
BLOCK = 1000
#: Below this completeness a text counts as cut; with a longer near-copy, below the second.
CUT, CUT_ALIGNED = 0.6, 0.9

_rng = np.random.default_rng(7)
_A = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_cache: dict[str, int] = {}


def _word(w: str) -> int:
    h = _cache.get(w)
    if h is None:
        if len(_cache) > 300_000:
            _cache.clear()
        h = _cache[w] = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
    return h


def shingles(ws: list[str]) -> np.ndarray:
    """Distinct hashes of all five-word windows."""
    n = len(ws) - SHINGLE + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    v = np.fromiter((_word(w) for w in ws), np.uint64, len(ws))
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for i in range(SHINGLE):
            h = (h ^ v[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return np.unique(h)


def bands(ws: list[str]) -> list[int]:
    """Keys of the min-hash bands; none for texts under five words."""
    h = shingles(ws)
    if not len(h):
        return []
    with np.errstate(over="ignore"):
        x = h[None, :] * _A[:, None] + _B[:, None]
        x ^= x >> np.uint64(32)
        low = x.min(axis=1).reshape(BANDS, ROWS)
        key = low[:, 0]
        for i in range(1, ROWS):
            key = (key * np.uint64(0xFF51AFD7ED558CCD)) ^ low[:, i]
        key = key * np.uint64(0xC4CEB9FE1A85EC53) + np.arange(BANDS, dtype=np.uint64)
    return key.view(np.int64).tolist()


def _score_batches(shared=None):
    """Scores by the whole model, or by what each text was ``told`` of it."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            ws = [terminality.words(t) for t in texts]
            if shared is None:
                rows = batch.column("told").to_pylist()
                complete = [terminality.told(r).complete(t) for t, r in zip(texts, rows, strict=True)]
            else:
                model: Terminality = shared.value
                complete = [model.complete(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("h"), batch.column("n"), batch.column("text"), pa.array([len(w) for w in ws], pa.int32()), pa.array(complete, pa.float64()), pa.array([bands(w) for w in ws], pa.list_(pa.int64()))],
                ["h", "n", "text", "n_words", "complete", "bands"],
            )

    return run


def _ask_batches(batches):
    for batch in batches:
        rows = [(h, kind, key) for h, t in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist(), strict=True) for kind, key in terminality.asked(t)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["h", "kind", "key"])


def _scored(distinct: DataFrame, max_entries: int) -> DataFrame:
    """``distinct`` with completeness and bands: by a model sent to all tasks or, beyond ``max_entries``, by a join of each text with the entries it asks for."""
    total = settle(terminality.totals(distinct, F.col("text")), "cut-counts")
    schema = "h string, n long, text string, n_words int, complete double, bands array<long>"
    if total.count() <= max_entries:
        return distinct.mapInArrow(_score_batches(distinct.sparkSession.sparkContext.broadcast(terminality.fit(total))), schema)
    asks = settle(distinct.mapInArrow(_ask_batches, "h string, kind string, key string"), "cut-asked")
    return distinct.join(terminality.tell(asks, total, "cut"), "h", "left").mapInArrow(_score_batches(), schema)


def ends_early(cut: str, full: str) -> bool:
    """Whether ``cut``'s words run along ``full``'s (near-copies only) and stop before it ends."""
    a, b = terminality.words(cut), terminality.words(full)
    if len(a) < SHINGLE or len(a) >= len(b) and not (len(a) == len(b) and b[-1].startswith(a[-1]) and b[-1] != a[-1]):
        return False
    x, y = set(shingles(a[:-1]).tolist()), set(shingles(b).tolist())
    if not x or len(x & y) < SIMILAR * len(x | y):
        return False
    # The closing words of the cut copy must stand at about the same place in the longer one.
    tail = a[-4:-1]
    return any(b[i : i + 3] == tail and i + 3 < len(b) and b[i + 3].startswith(a[-1]) for i in range(max(0, len(a) - 4 - len(b) // 5), min(len(b), len(a) + len(b) // 5)))


def _align_batches(batches):
    for batch in batches:
        keep = [i for i, (a, b) in enumerate(zip(batch.column("text").to_pylist(), batch.column("full").to_pylist(), strict=True)) if ends_early(a, b)]
        yield batch.select(["h"]).take(pa.array(keep, pa.int64()))


def truncated(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, complete, aligned) of every cut document."""
    # Texts within distinct rows only; copies share a verdict by hash, and don't count as further evidence.
    both = F.concat(F.lpad(F.hex(F.xxhash64(text)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit("t"), F.col(text))), 16, "0"))
    keyed = docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("text"), both.alias("h"))
    distinct = settle(keyed.groupBy("h").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n")), "cut-texts")
    scored = settle(_scored(distinct, terminality.MAX_ENTRIES), "cut-scored")
    member = scored.select("h", "n_words", "complete", F.explode("bands").alias("band"))
    size = member.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("complete").alias("least")).where(F.col("size") > 1).where(F.col("least") < CUT_ALIGNED)
    member = settle(member.join(size.select("band"), "band", "left_semi"), "cut-bands")  # buckets with an open text and another one
    open_ = member.where(F.col("complete") < CUT_ALIGNED).select("band", "h", F.col("n_words").alias("open_words"))
    full = member.select("band", F.col("h").alias("full_h"), F.col("n_words").alias("full_words"))
    links = block_join(open_, full, ["band"], F.col("h"), F.col("full_h"), BLOCK).where("h <> full_h and full_words >= open_words").select("h", "full_h").distinct()
    pairs = links.join(scored.select("h", "text"), "h").join(scored.select(F.col("h").alias("full_h"), F.col("text").alias("full")), "full_h")
    aligned = pairs.mapInArrow(_align_batches, "h string").distinct().withColumn("aligned", F.lit(True))
    verdict = scored.select("h", "n", "complete").join(aligned, "h", "left").fillna(False, ["aligned"])
    cut = verdict.where((F.col("complete") < CUT) | F.col("aligned"))
    cut = settle(cut.withColumn("n_salts", salts_for(F.col("n"))).drop("n"), "cut-found")
    return salted_join(keyed.select("id", "h"), cut, ["h"], F.col("id")).select(F.col("id").alias(id_col), "complete", "aligned")
