"""Problem 4: same or near-same records across splits.

Records become word lists of their user and assistant turns; equal lists are one
class.  A rolling hash over word pairs cuts the lists into content-defined
chunks, whose digests are joined across the two splits.  The words of shared
chunks are summed per pair: a pair whose sum, with the words of chunks left out of
the join, stays under OVERLAP of the longer record is dropped, and the exact longest
common subsequence settles the rest.

What is left out of the join: of each record the most frequent chunks, as long as
they make up less than OVERLAP of its words.  Two records that share OVERLAP or more
have a chunk in common beyond those, so no such pair is lost, however many records
hold a chunk: a chunk with more than BLOCK_PAIRS pairs is joined in blocks.  In a
block a 512-bit sketch of each record's words and their repeats drops pairs that
provably can't reach SIMILAR.

Edits can leave less than OVERLAP of whole chunks in a pair over SIMILAR.  Records up
to SHORT words are therefore cut into single words, where the share of words
in common is SIMILAR at least and nothing can be lost; ``short`` without bound makes
the whole search exact.  Recall close to the threshold is in the README.

Defined cases: null texts and records without user or assistant words have no
partner; either end tag and any line end are understood, and a turn without end
tag runs to the next start; repeated rows are rows of their own in the result but
one class in the work; ties don't occur (all pairs over the threshold are kept).
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.runtime import salted_join, salts_for, settle

#: Shared words in the same order, as a share of the longer record.
SIMILAR = 0.75
#: Words of shared chunks, as a share of the longer record, from which a pair is looked at.
OVERLAP = 0.15
#: Mean words per chunk.
SCALE = 3
#: Records of so many words or fewer are cut into single words.
SHORT = 32
#: Chunk frequencies are counted in so many buckets, which bounds what is broadcast.
BUCKETS = 1 << 20
#: Pairs that one block of a chunk's join compares at most.
BLOCK_PAIRS = 1 << 27
#: Chunk entries (records x chunks) per task of the join.
TASK_ENTRIES = 1_500_000
#: Rows by id up to this number are broadcast (about 16 bytes each); beyond, a shuffle join.
BROADCAST_KEYS = 1_000_000
#: 64-bit words of a record's sketch.
SKETCH = 8
#: Pairs compared at a time: enough to outweigh the calls, few enough for the processor's cache.
TILE = 32_768

_WORD = re.compile(r"[^\W_]+")
_ROLE = re.compile(r"\s*(\w+)[ \t]*(?:\r\n|\r|\n|[ \t])?")
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_cache: dict[str, int] = {}


def turn_words(text: str | None) -> list[str]:
    """Words of the user and assistant turns of a ChatML text."""
    if not text:
        return []
    said = []
    for part in text.split("<|im_start|>")[1:]:
        role = _ROLE.match(part)
        if role and role[1] == "system":
            continue
        end = part.find("<|")
        said.append(part[role.end() if role else 0 : end if end >= 0 else len(part)])
    whole = "\n".join(said)
    if not whole.isascii():
        whole = _HIDDEN.sub("", whole)
    return _WORD.findall(whole.lower())


def _hash(w: str) -> int:
    h = _cache.get(w)
    if h is None:
        if len(_cache) > 300_000:
            _cache.clear()
        h = _cache[w] = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
    return h


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(31))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def chunks(values: np.ndarray, ends: np.ndarray, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Content-defined chunks of records in a row: digest, words, record.

    ``values`` are the word hashes of all records one after another, ``ends``
    where each record ends.  A scale of 1 makes every word a chunk.
    """
    n = len(values)
    with np.errstate(over="ignore"):
        roll = np.zeros(n, np.uint64)
        roll[1:] = _mix(values[:-1] * np.uint64(0x9E3779B97F4A7C15) + values[1:])
        cut = (roll >> np.uint64(33)) % np.uint64(scale) == 0
        cut[np.concatenate([[0], ends[:-1]])] = scale == 1  # the pair over a border doesn't count
        cut[ends - 1] = True
        last = np.flatnonzero(cut)
        first = np.concatenate([[0], last[:-1] + 1])
        size = last - first + 1
        place = np.arange(n) - np.repeat(first, size)
        power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(int(size.max()), 0xC2B2AE3D27D4EB4F, np.uint64)]))
        digest = np.add.reduceat((values ^ (values >> np.uint64(29))) * power[place], first)  # polynomial over the chunk's words
        digest = _mix(digest + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(scale))
    return digest, size, np.searchsorted(ends - 1, last)


def repeats(digest: np.ndarray, record: np.ndarray) -> np.ndarray:
    """How often each chunk came before in its record."""
    order = np.lexsort((digest, record))
    d, r = digest[order], record[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (r[1:] != r[:-1])])
    first = np.flatnonzero(new)
    out = np.empty(len(d), np.int64)
    out[order] = np.arange(len(d)) - np.repeat(first, np.diff(np.append(first, len(d))))
    return out


def items(values: np.ndarray, ends: np.ndarray, short: int = SHORT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, words, record) of all records' chunks by record, and a sketch of each record.

    Repeats of a chunk in its record are keys of their own.  Records up to ``short`` words have single words, marked by 0
    words, and those from SIMILAR x ``short`` on have chunks, so any two records that can be a pair have one kind in common.
    """
    n = np.diff(ends, prepend=0)
    with np.errstate(over="ignore"):
        numbered = lambda d, r: _mix(d + repeats(d, r).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        digest, size, record = chunks(values, ends)
        long_ = (n >= SIMILAR * short)[record]
        digest, size, record = digest[long_], size[long_], record[long_]
        if len(digest):
            digest = numbered(digest, record)
        word, _, of = chunks(values, ends, 1)
        word = numbered(word, of)
    bit = (word >> np.uint64(7)) % np.uint64(64 * SKETCH)
    sketch = np.zeros((len(n), SKETCH), np.uint64)
    np.bitwise_or.at(sketch, (of, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    brief = (n <= short)[of]
    key, words = np.concatenate([digest, word[brief]]), np.concatenate([size, np.zeros(int(brief.sum()), np.int64)])
    record = np.concatenate([record, of[brief]])
    order = np.argsort(record, kind="stable")
    return key[order], words[order], record[order], sketch


def _packed(rows: np.ndarray, ends: np.ndarray | None = None) -> pa.Array:
    """Rows of a matrix, or the pieces of a vector, as binary values."""
    width = rows.dtype.itemsize
    at = np.concatenate([[0], ends]) * width if ends is not None else np.arange(len(rows) + 1) * rows.shape[1] * width
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _unpacked(column: pa.Array, dtype) -> np.ndarray:
    """All bytes of a binary column in a row."""
    buffers = column.buffers()
    at = np.frombuffer(buffers[1], np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(buffers[2], np.uint8, at[-1] - at[0], at[0]).view(dtype) if len(column) and at[-1] > at[0] else np.zeros(0, dtype)


def _parse_batches(short: int):
    """(row_id, side, text) -> class, words, keys with their words, sketch."""

    def run(batches):
        for batch in batches:
            ids, sides, classes, flat, n = [], [], [], [], []
            for i, s, t in zip(*(batch.column(k).to_pylist() for k in ("row_id", "side", "text")), strict=True):
                ws = turn_words(t)
                if ws:
                    ids.append(i)
                    sides.append(s)
                    flat.append(np.fromiter(map(_hash, ws), np.uint64, len(ws)))
                    n.append(len(ws))
                    classes.append(hashlib.blake2b(flat[-1].tobytes(), digest_size=16).digest())
            if not ids:
                continue
            key, words, record, sketch = items(np.concatenate(flat), np.cumsum(n), short)
            at = pa.array(np.searchsorted(record, np.arange(len(n) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (key.view(np.int64), words.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sides), pa.array(classes, pa.binary()), pa.array(n, pa.int32()), *lists, _packed(sketch)], ["row_id", "side", "c", "n", "keys", "sizes", "sketch"])

    return run


_PARSED = "row_id long, side boolean, c binary, n int, keys array<long>, sizes array<int>, sketch binary"


def _buckets(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _count_batches(batches):
    """(side, keys) -> how many keys of either side each bucket holds; BUCKETS rows a task at most."""
    seen = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        sides, lists = batch.column("side").to_numpy(zero_copy_only=False), batch.column("keys")
        bucket = _buckets(lists.flatten().to_numpy().view(np.uint64))
        mine = np.repeat(sides, lists.value_lengths().to_numpy())
        seen[0] += np.bincount(bucket[mine], minlength=BUCKETS)
        seen[1] += np.bincount(bucket[~mine], minlength=BUCKETS)
    some = np.flatnonzero(seen.any(axis=0))
    for i in range(0, len(some), 100_000):
        part = some[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(seen[0, part]), pa.array(seen[1, part])], ["bucket", "na", "nb"])


class Frequencies:
    """How frequent the chunks of each bucket are, rounded, and into how many blocks their join is cut; BUCKETS x 9 bytes."""

    def __init__(self, bucket: np.ndarray, na: np.ndarray, nb: np.ndarray):
        side = int(BLOCK_PAIRS**0.5)
        self.level = np.zeros(BUCKETS, np.uint8)  # 0: no chunk of this bucket is in both splits
        self.level[bucket] = np.minimum(254, np.rint(4 * np.log2(na.astype(float) * nb))).astype(np.uint8) + 1
        self.blocks = np.ones((2, BUCKETS), np.int32)
        many = na.astype(float) * nb > BLOCK_PAIRS
        for k, n in enumerate((na, nb)):
            self.blocks[k, bucket[many]] = -(-n[many] // side)
        self.entries = int(na.sum() + nb.sum())


def _place_batches(shared, parts: int):
    """Records -> one row per record and task of the join, with the keys that meet there."""
    names = ["part", "row_id", "side", "n", "rest", "rest_words", "sketch", "keys", "sizes"]

    def run(batches):
        f: Frequencies = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("keys")
            n = batch.column("n").to_numpy()
            side = batch.column("side").to_numpy(zero_copy_only=False)
            ids = batch.column("row_id").to_numpy().view(np.uint64)
            key = lists.flatten().to_numpy().view(np.uint64)
            size = batch.column("sizes").flatten().to_numpy()
            record = np.repeat(np.arange(len(n)), lists.value_lengths().to_numpy())
            level = f.level[_buckets(key)]
            kept = level > 0
            key, size, record, level = key[kept], size[kept], record[kept], level[kept]
            single = size == 0
            group = record * 2 + single
            order = np.lexsort((key, level, group))  # rare ones first
            key, size, record, single, group = key[order], size[order], record[order], single[order], group[order]
            words = np.maximum(size, 1).astype(np.int64)
            total = np.bincount(group, words, minlength=2 * len(n)).astype(np.int64)
            start = np.cumsum(total) - total
            left = total[group] - (np.cumsum(words) - words - start[group])  # the words of this chunk and more frequent ones
            kept = left >= np.where(single, SIMILAR, OVERLAP) * n[record] - 1e-9
            rest = np.bincount(group[~kept], words[~kept], minlength=2 * len(n)).astype(np.int64)
            key, size, record = key[kept], size[kept], record[kept]
            bucket = _buckets(key)
            ka, kb = f.blocks[0, bucket], f.blocks[1, bucket]
            mine = side[record]
            copies = np.where(mine, kb, ka)
            at = np.repeat(np.arange(len(key)), copies)
            turn = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
            own = _mix(ids[record] + np.uint64(1))
            with np.errstate(over="ignore"):
                ia = np.where(mine[at], own[at] % ka[at].astype(np.uint64), turn).astype(np.uint64)
                ib = np.where(mine[at], turn, own[at] % kb[at].astype(np.uint64)).astype(np.uint64)
                block = np.where((ka * kb)[at] > 1, _mix(key[at] + ia * np.uint64(0x9E3779B97F4A7C15) + ib * np.uint64(0xC2B2AE3D27D4EB4F)), key[at])
            size, record = size[at], record[at]
            part = (block % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((part, record))
            block, size, record, part = block[order], size[order], record[order], part[order]
            if not len(block):
                continue
            new = np.concatenate([[True], (record[1:] != record[:-1]) | (part[1:] != part[:-1])])
            first = np.flatnonzero(new)
            ends = np.append(first[1:], len(block))
            who = record[first]
            for i in range(0, len(who), 20_000):
                j = min(i + 20_000, len(who))
                w, a, b = who[i:j], first[i], ends[j - 1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[first[i:j]].astype(np.int32)), batch.column("row_id").take(pa.array(w)), pa.array(side[w]), pa.array(n[w]), pa.array(rest[2 * w].astype(np.int32)), pa.array(rest[2 * w + 1].astype(np.int32)),
                     batch.column("sketch").take(pa.array(w)), _packed(block[a:b], ends[i:j] - a), _packed(size[a:b].astype(np.int32), ends[i:j] - a)],
                    names,
                )

    return run


_PLACED = "part int, row_id long, side boolean, n int, rest int, rest_words int, sketch binary, keys binary, sizes binary"
_HITS = "ra long, rb long, single boolean, words long, lack double"


class _Side:
    """The rows of one split in a task of the join, their entries in the order of keys and record lengths."""

    def __init__(self, batches: list[pa.RecordBatch], side: bool):
        sides = [b.column("side").to_numpy(zero_copy_only=False) == side for b in batches]
        column = lambda name: np.concatenate([b.column(name).to_numpy()[s] for b, s in zip(batches, sides, strict=True)])
        self.ids, self.n, self.rest = column("row_id"), column("n").astype(np.int64), np.stack([column("rest"), column("rest_words")])
        self.sketch = np.concatenate([_unpacked(b.column("sketch"), np.uint64).reshape(-1, SKETCH)[s] for b, s in zip(batches, sides, strict=True)]).T.copy()
        self.bits = np.bitwise_count(self.sketch).sum(axis=0, dtype=np.int64)
        held = [np.diff(np.frombuffer(b.column("keys").buffers()[1], np.int32, len(b) + 1, b.column("keys").offset * 4)) // 8 for b in batches]
        flat = lambda name, dtype: np.concatenate([_unpacked(b.column(name), dtype)[np.repeat(s, h)] for b, s, h in zip(batches, sides, held, strict=True)])
        key, size = flat("keys", np.uint64), flat("sizes", np.int32)
        row = np.repeat(np.arange(len(self.n)), np.concatenate([h[s] for h, s in zip(held, sides, strict=True)]))
        order = np.lexsort((self.n[row], key))
        self.key, self.size, self.row = key[order], size[order], row[order]


def _summed(hits: list[np.ndarray]) -> np.ndarray:
    """Hits of the same two rows and kind as one, with their words added up."""
    h = np.concatenate(hits)
    h = h[np.lexsort((h[:, 2], h[:, 1], h[:, 0]))]
    first = np.flatnonzero(np.concatenate([[True], (h[1:, :3] != h[:-1, :3]).any(axis=1)]))
    out = h[first]
    out[:, 3] = np.add.reduceat(h[:, 3], first)
    return out


def _bits(planes: np.ndarray) -> np.ndarray:
    """Bits that are set in all planes together; up to three planes a sum fits a byte."""
    p = np.bitwise_count(planes)
    total = np.zeros(p.shape[1:], np.uint16)
    for k in range(0, SKETCH, 3):
        part = p[k]
        for x in p[k + 1 : k + 3]:
            part = part + x
        total += part
    return total


def _meet_batches(batches):
    """All rows of a task -> pairs that share a chunk and may reach SIMILAR, with the words of the chunks that they share here."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    a, b = _Side(held, True), _Side(held, False)
    del held
    if not len(a.key) or not len(b.key):
        return
    low, high = np.searchsorted(b.key, a.key, "left"), np.searchsorted(b.key, a.key, "right")
    hits: list[np.ndarray] = []
    waiting = 0

    def keep(i: np.ndarray, j: np.ndarray, words: np.ndarray) -> int:
        hits.append(np.stack([i, j, words == 0, np.maximum(words, 1)], 1).astype(np.int64))
        return len(i)

    def may_reach(i, j, common) -> np.ndarray:
        # A word is missing for each bit that only one record has.
        least = SIMILAR * np.maximum(a.n[i], b.n[j])
        return (common >= a.bits[i] - (a.n[i] - least)) & (common >= b.bits[j] - (b.n[j] - least))

    def flush():
        h = _summed(hits)
        hits.clear()
        i, j, single = h[:, 0], h[:, 1], h[:, 2]
        longer = np.maximum(a.n[i], b.n[j])
        lack = np.where(single == 1, SIMILAR, OVERLAP) * longer - np.minimum(a.rest[single, i], b.rest[single, j])
        for k in range(0, len(h), 100_000):
            s = slice(k, k + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(a.ids[i[s]]), pa.array(b.ids[j[s]]), pa.array(single[s] == 1), pa.array(h[s, 3]), pa.array(lack[s])], ["ra", "rb", "single", "words", "lack"])

    # Keys with few pairs go together; the others in tiles of rows of one key.
    first = np.flatnonzero(np.concatenate([[True], a.key[1:] != a.key[:-1]]))
    held = np.diff(np.append(first, len(a.key)))
    many = np.repeat(held, held) * (high - low) > 2048
    few = np.flatnonzero((high > low) & ~many)
    lengths = (high - low)[few]
    upto = np.cumsum(lengths)
    for k in range(0, int(upto[-1]) if len(few) else 0, 50_000):
        s, e = np.searchsorted(upto, k, "right"), np.searchsorted(upto, k + 50_000, "right")
        if s == e:
            continue
        x = np.repeat(few[s:e], lengths[s:e])
        y = low[x] + np.arange(len(x)) - np.repeat(np.cumsum(lengths[s:e]) - lengths[s:e], lengths[s:e])
        i, j = a.row[x], b.row[y]
        like = np.flatnonzero(np.minimum(a.n[i], b.n[j]) >= SIMILAR * np.maximum(a.n[i], b.n[j]))
        x, i, j = x[like], i[like], j[like]
        ok = may_reach(i, j, _bits(a.sketch[:, i] & b.sketch[:, j]))
        waiting += keep(i[ok], j[ok], a.size[x[ok]])
        if waiting > 2_000_000:
            yield from flush()
            waiting = 0
    least = np.maximum(0, np.ceil(a.bits - (1 - SIMILAR) * a.n)).astype(np.uint16)
    for f, k in zip(first.tolist(), held.tolist(), strict=True):
        if not many[f]:
            continue
        rows_a, rows_b = a.row[f : f + k], b.row[low[f] : high[f]]  # both by length
        planes_a, planes_b, lengths_b = a.sketch[:, rows_a, None], b.sketch[:, None, rows_b], b.n[rows_b]
        starts, stops = np.searchsorted(lengths_b, SIMILAR * a.n[rows_a], "left"), np.searchsorted(lengths_b, a.n[rows_a] / SIMILAR, "right")
        x = 0
        while x < k:
            s = starts[x]
            y = min(k, x + max(1, TILE // max(1, stops[x] - s)))
            e = stops[y - 1]
            if e > s:
                common = _bits(planes_a[:, x:y] & planes_b[:, :, s:e])
                near_a, near_b = np.nonzero(common >= least[rows_a[x:y], None])
                if len(near_a):
                    i, j = rows_a[x + near_a], rows_b[s + near_b]
                    ok = may_reach(i, j, common[near_a, near_b])
                    waiting += keep(i[ok], j[ok], np.full(int(ok.sum()), a.size[f]))
                    if waiting > 2_000_000:
                        yield from flush()
                        waiting = 0
            x = y
    if waiting:
        yield from flush()


def lcs(a: list, b: list, at: dict | None = None) -> int:
    """Length of the longest common subsequence, by bit-parallel rows; ``at`` is ``places(a)``, if known."""
    at = places(a) if at is None else at
    full = (1 << len(a)) - 1
    s = full
    for y in b:
        u = s & at.get(y, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def places(a: list) -> dict:
    """Where each word of ``a`` stands, as bits."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    return at


def chunk_overlap(a: list[str], b: list[str]) -> float:
    """Words of the chunks that both records hold, as a share of the longer one."""
    keys = []
    for x in (a, b):
        v = np.fromiter(map(_hash, x), np.uint64, len(x))
        digest, size, record = chunks(v, np.array([len(v)]))
        keys.append(dict(zip(zip(digest.tolist(), repeats(digest, record).tolist(), strict=True), size.tolist(), strict=True)))
    return sum(n for k, n in keys[0].items() if k in keys[1]) / max(len(a), len(b))


def _settle_pairs(batches):
    """Exact share of candidate pairs; keeps those that reach SIMILAR."""
    known: dict[str, tuple[list[str], dict]] = {}

    def parsed(text: str) -> tuple[list[str], dict]:
        got = known.get(text)
        if got is None:
            if len(known) >= 2000:
                known.clear()
            ws = turn_words(text)
            got = known[text] = ws, places(ws)
        return got

    for batch in batches:
        keep, shares, over = [], [], []
        for i, (x, y) in enumerate(zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True)):
            (a, at), (b, _) = parsed(x), parsed(y)
            share = lcs(a, b, at) / max(len(a), len(b))
            if SIMILAR <= share < 1:
                keep.append(i)
                shares.append(share)
                over.append(chunk_overlap(a, b))
        got = batch.select(["ra", "rb"]).take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([*got.columns, pa.array(shares, pa.float64()), pa.array(over, pa.float64())], ["ra", "rb", "share", "overlap"])


def candidates(classes: DataFrame) -> DataFrame:
    """(ra, rb, words) first rows of different classes whose shared chunks may reach OVERLAP, or shared words SIMILAR in short records."""
    spark = classes.sparkSession
    counted = classes.select("side", "keys").mapInArrow(_count_batches, "bucket int, na long, nb long").groupBy("bucket").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    got = counted.where("na > 0 and nb > 0").toArrow()  # BUCKETS rows at most
    f = Frequencies(*(got.column(k).to_numpy() for k in ("bucket", "na", "nb")))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), f.entries // TASK_ENTRIES + 1)
    placed = classes.mapInArrow(_place_batches(spark.sparkContext.broadcast(f), parts), _PLACED)
    hits = placed.repartitionById(parts, "part").mapInArrow(_meet_batches, _HITS)
    sums = hits.groupBy("ra", "rb", "single").agg(F.sum("words").alias("words"), F.max("lack").alias("lack"))
    return sums.where(F.col("words") >= F.col("lack") - 1e-6).groupBy("ra", "rb").agg(F.max("words").alias("words"))


def overlaps(held_out: DataFrame, train: DataFrame, id_col: str = "row_id", text: str = "text", short: int = SHORT) -> DataFrame:
    """(held_id, train_id, share, overlap) of all pairs across the two tables; ``short`` as in ``items``."""
    rows = held_out.select(F.col(id_col).cast("long").alias("row_id"), F.lit(True).alias("side"), F.col(text).alias("text")).unionByName(
        train.select(F.col(id_col).cast("long").alias("row_id"), F.lit(False).alias("side"), F.col(text).alias("text"))
    )
    parsed = settle(rows.mapInArrow(_parse_batches(short), _PARSED), "overlap-parsed")
    members = parsed.select("row_id", "side", "c")
    sized = settle(members.groupBy("side", "c").agg(F.min("row_id").alias("first_id"), F.count(F.lit(1)).alias("n")).withColumn("n_salts", salts_for(F.col("n"))), "overlap-classes")
    # One row stands for each class in either split.  The others are few in most corpora: then no row is shuffled for it.
    several = sized.where("n > 1").select("side", "c", "first_id", "n_salts")
    later = settle(salted_join(members, several, ["side", "c"], F.col("row_id")).where("row_id <> first_id").select("row_id", "side"), "overlap-later")
    classes = parsed.join(F.broadcast(later) if later.count() <= BROADCAST_KEYS else later, ["row_id", "side"], "left_anti")
    asked = settle(candidates(classes), "overlap-asked")
    few = asked.count() <= BROADCAST_KEYS
    wanted = asked.select(F.col("ra").alias("row_id"), F.lit(True).alias("side")).unionByName(asked.select(F.col("rb").alias("row_id"), F.lit(False).alias("side"))).distinct()
    texts = rows.join(F.broadcast(wanted) if few else wanted, ["row_id", "side"], "left_semi")
    ta, tb = texts.where("side").select(F.col("row_id").alias("ra"), F.col("text").alias("ta")), texts.where("not side").select(F.col("row_id").alias("rb"), F.col("text").alias("tb"))
    near = asked.join(ta, "ra").join(tb, "rb").select("ra", "rb", "ta", "tb").mapInArrow(_settle_pairs, "ra long, rb long, share double, overlap double")
    same = sized.where("side").select("c", F.col("first_id").alias("ra")).join(sized.where("not side").select("c", F.col("first_id").alias("rb")), "c")
    linked = settle(near.unionByName(same.select("ra", "rb", F.lit(1.0).alias("share"), F.lit(1.0).alias("overlap"))), "overlap-linked")
    # Back to rows; classes of many rows are spread over salts.
    size_a = sized.where("side").select(F.col("first_id").alias("ra"), F.col("c").alias("ca"), F.col("n_salts").alias("sa"))
    size_b = sized.where("not side").select(F.col("first_id").alias("rb"), F.col("c").alias("cb"), F.col("n_salts").alias("sb"))
    spread = linked.join(size_a, "ra").join(size_b, "rb").withColumn("salt_a", F.explode(F.sequence(F.lit(0), F.col("sa") - 1))).withColumn("salt_b", F.explode(F.sequence(F.lit(0), F.col("sb") - 1)))
    hot = F.broadcast(sized.where("n_salts > 1").select("side", "c", "n_salts"))  # at most rows / ROWS_PER_SALT
    tagged = members.join(hot, ["side", "c"], "left").withColumn("salt", F.when(F.col("n_salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("row_id"), F.col("n_salts")).cast("int")))
    rows_a = tagged.where("side").select(F.col("c").alias("ca"), F.col("salt").alias("salt_a"), F.col("row_id").alias("held_id"))
    rows_b = tagged.where("not side").select(F.col("c").alias("cb"), F.col("salt").alias("salt_b"), F.col("row_id").alias("train_id"))
    return spread.join(rows_a, ["ca", "salt_a"]).join(rows_b, ["cb", "salt_b"]).select("held_id", "train_id", "share", "overlap")
