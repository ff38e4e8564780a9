"""Problem 2: token budget per source, language and domain.

Counts come from a public byte-level BPE.  A content-and-tokenizer-hash table
keeps the count of every content ever seen, so only unseen or changed documents
are encoded, each distinct content once; cubes follow by signed deltas, removed
documents included.  ``TokenLedger`` keeps all three in a folder, from which any
later session goes on.

Within one Arrow batch, a text is cut at single spaces: in this family of
tokenizers a space always starts a new pre-token, so the count of a text is the
sum of the counts of its space-led pieces, which a bounded cache holds.

Defined cases: null text has 0 tokens; empty text has 0; null source, language
or domain form a slice of their own (null); repeated ids within one snapshot are
an error of the caller; an empty snapshot removes everything.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.runtime import salted_join, salts_for, settle

#: Folder of the public vocabularies; a parameter of every operator here.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: The pre-token pattern of this vocabulary family (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces remembered per Python worker; the cache is emptied when full.
CACHE_PIECES = 300_000
#: Row ids up to this number are broadcast (about 30 bytes each); beyond, a shuffle join.
BROADCAST_IDS = 300_000

_encoders: dict[str, object] = {}


def encoder(path: str):
    """The tiktoken encoding of a vocabulary file, once per process."""
    if path not in _encoders:
        with open(path, "rb") as f:
            encoder_of(path, f.read())
    return _encoders[path]


def encoder_of(path: str, vocabulary: bytes):
    """The same from the file's bytes, which the driver broadcasts: executors need no vocabulary folder."""
    if path not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _encoders[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def counter(path: str, cache_pieces: int = CACHE_PIECES, vocabulary: bytes | None = None):
    """A function text -> number of tokens, with a cache of space-led pieces."""
    encode = (encoder(path) if vocabulary is None else encoder_of(path, vocabulary)).encode_ordinary
    cache: dict[str, int] = {}

    def count(text: str | None) -> int:
        if not text:
            return 0
        parts = text.split(" ")
        total = len(encode(parts[0])) if parts[0] else 0
        rest = parts[1:]
        try:
            return total + sum(map(cache.__getitem__, rest))
        except KeyError:
            if len(cache) > cache_pieces:
                cache.clear()
            for p in rest:
                if p not in cache:
                    cache[p] = len(encode(" " + p))
            return total + sum(map(cache.__getitem__, rest))

    return count


def with_token_counts(rows: DataFrame, text: str, out: str = "n_tokens", vocabulary: str = VOCABULARY, tokenizers: str = TOKENIZERS) -> DataFrame:
    """``rows`` without ``text``, with the token count in its place; no shuffle."""
    path = f"{tokenizers}/{vocabulary}"
    keep = [c for c in rows.columns if c not in (text, out)]
    fields = [rows.schema[c] for c in keep]
    with open(path, "rb") as f:
        shared = rows.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file, about a megabyte

    def run(batches: Iterable[pa.RecordBatch]):
        count = counter(path, vocabulary=shared.value)
        for b in batches:
            n = pa.array([count(t) for t in b.column(text).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), n], [*keep, out])

    from pyspark.sql.types import LongType, StructField, StructType

    return rows.mapInArrow(run, StructType([*fields, StructField(out, LongType())]))


def content_hash(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """128 bits over the content and the tokenizer's name; null hashes as its own value."""
    shown = F.coalesce(text, F.lit("\x00null"))
    return F.concat(F.lpad(F.hex(F.xxhash64(shown, F.lit(vocabulary))), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(vocabulary + "/2"), shown)), 16, "0"))


def unseen(docs: DataFrame, id_cols: list[str], known: DataFrame | None = None, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(content_hash, text) of each content of ``docs`` that isn't in ``known``, once.

    Only ids and hashes are shuffled to find them; texts stay where they are read while the rows to leave out
    (repeats and known contents), or the rows to take, are few enough to be broadcast (BROADCAST_IDS, counted).
    """
    hashed = docs.select(*id_cols, content_hash(F.col(text), vocabulary).alias("content_hash"), text)
    keys = hashed.select("content_hash", F.struct(*id_cols).alias("_id"))
    if known is not None:
        keys = keys.join(known.select("content_hash"), "content_hash", "left_anti")
        take = settle(keys.groupBy("content_hash").agg(F.min("_id").alias("_id")).select("_id.*"), "tokens-unseen")
        small = F.broadcast(take) if take.count() <= BROADCAST_IDS else take
        return hashed.join(small, id_cols, "left_semi").select("content_hash", text)
    later = repeated(keys)
    return hashed.join(F.broadcast(later) if later.count() <= BROADCAST_IDS else later, id_cols, "left_anti").select("content_hash", text)


def repeated(keys: DataFrame) -> DataFrame:
    """Ids of the rows of ``keys`` (content_hash, struct _id) whose content a smaller id has too."""
    repeats = keys.groupBy("content_hash").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeats = settle(repeats.select("content_hash", "_first", salts_for(F.col("n")).alias("n_salts")), "tokens-repeats")
    return settle(salted_join(keys, repeats, ["content_hash"], F.col("_id")).where("_id <> _first").select("_id.*"), "tokens-later")


def count_table(docs: DataFrame, id_cols: list[str], known: DataFrame | None = None, text: str = "text", vocabulary: str = VOCABULARY, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(content_hash, n_tokens) of the contents of ``docs`` that aren't in ``known``, each encoded once."""
    return with_token_counts(unseen(docs, id_cols, known, text, vocabulary), text, vocabulary=vocabulary, tokenizers=tokenizers)


def snapshot(docs: DataFrame, counts: DataFrame | None, id_cols: list[str], dims: list[str], text: str = "text", vocabulary: str = VOCABULARY, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(ids, dims, content_hash, n_tokens): counts from the table, or encoded in place without one."""
    cols = list(dict.fromkeys([*id_cols, *dims]))  # a dimension may be part of the id
    hashed = docs.select(*cols, content_hash(F.col(text), vocabulary).alias("content_hash"), *([text] if counts is None else []))
    if counts is None:
        return with_token_counts(hashed, text, vocabulary=vocabulary, tokenizers=tokenizers)
    often = hashed.groupBy("content_hash").agg(salts_for(F.count(F.lit(1))).alias("n_salts")).where("n_salts > 1")
    sized = counts.join(F.broadcast(often), "content_hash", "left").fillna(1, ["n_salts"])  # often: rows / ROWS_PER_SALT at most
    return salted_join(hashed, sized, ["content_hash"], F.struct(*id_cols)).select(*cols, "content_hash", "n_tokens")


def deltas(old: DataFrame, new: DataFrame, id_cols: list[str], dims: list[str]) -> DataFrame:
    """Signed changes (dims, d_rows, d_tokens) between two snapshots: removed, added, changed or moved rows."""
    state = F.xxhash64("content_hash", *[F.coalesce(F.col(d), F.lit("\x00")) for d in dims])
    cols = list(dict.fromkeys([*id_cols, *dims]))
    a = old.select(*[F.col(c).alias(f"o_{c}") for c in cols], F.col("n_tokens").alias("o_n"), state.alias("o_state"))
    b = new.select(*cols, "n_tokens", state.alias("state"))
    on = F.lit(True)
    for i in id_cols:
        on = on & (F.col(f"o_{i}") == F.col(i))
    both = a.join(b, on, "full").where("o_state is null or state is null or o_state <> state")
    gone = both.where("o_state is not null").select(*[F.col(f"o_{d}").alias(d) for d in dims], F.lit(-1).alias("s"), F.col("o_n").alias("n"))
    come = both.where("state is not null").select(*dims, F.lit(1).alias("s"), F.col("n_tokens").alias("n"))
    return gone.unionByName(come).groupBy(*dims).agg(F.sum("s").cast("long").alias("d_rows"), F.sum(F.col("s") * F.col("n")).cast("long").alias("d_tokens"))


def cube(snap: DataFrame, dims: list[str]) -> DataFrame:
    """(dims, n_rows, n_tokens) per finest slice; coarser totals are sums of it."""
    return snap.groupBy(*dims).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_tokens").cast("long").alias("n_tokens"))


def apply_deltas(old_cube: DataFrame, change: DataFrame, dims: list[str]) -> DataFrame:
    """The cube after ``change``; slices that became empty leave it."""
    d = change.select(*dims, F.col("d_rows").alias("n_rows"), F.col("d_tokens").alias("n_tokens"))
    return old_cube.unionByName(d).groupBy(*dims).agg(F.sum("n_rows").alias("n_rows"), F.sum("n_tokens").alias("n_tokens")).where("n_rows <> 0")


def rollups(finest: DataFrame, dims: list[str]) -> DataFrame:
    """All grouping sets of the cube, from the finest slices (no second pass over rows).

    ``level`` names the grouped dimensions; a dimension that isn't grouped is null.
    """
    g = finest.cube(*dims).agg(F.grouping_id().alias("gid"), F.sum("n_rows").alias("n_rows"), F.sum("n_tokens").alias("n_tokens"))
    bits = [F.when(F.col("gid").bitwiseAND(1 << (len(dims) - 1 - i)) == 0, F.lit(d)) for i, d in enumerate(dims)]
    return g.select(F.concat_ws(",", *bits).alias("level"), *dims, "n_rows", "n_tokens")


class TokenLedger:
    """Snapshot, count table and cube kept in a folder, brought up to date by ``update``.

    Each update is a version: ``counts/N`` holds the contents first seen then (the count table is all of
    them), ``snapshot/N`` the rows with their counts, ``deltas/N`` the signed changes and ``cube/N`` the totals, written last.
    A new object goes on from the last version whose cube is complete; what a broken update left is overwritten.
    """

    def __init__(self, spark: SparkSession, folder: str, id_cols: list[str], dims: list[str], vocabulary: str = VOCABULARY, tokenizers: str = TOKENIZERS):
        self.spark, self.folder, self.id_cols, self.dims, self.vocabulary, self.tokenizers = spark, folder.rstrip("/"), id_cols, dims, vocabulary, tokenizers
        self.version = -1
        while self._complete(self.version + 1):
            self.version += 1

    def _complete(self, version: int) -> bool:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/cube/{version}/_SUCCESS")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def _read(self, part: str, version: int | None = None) -> DataFrame | None:
        version = self.version if version is None else version
        return None if version < 0 else self.spark.read.parquet(f"{self.folder}/{part}/{version}")

    def _write(self, df: DataFrame, part: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/{part}/{self.version + 1}")
        return self._read(part, self.version + 1)

    def counts(self, version: int | None = None) -> DataFrame | None:
        """The count table: the new contents of all versions so far."""
        version = self.version if version is None else version
        return None if version < 0 else self.spark.read.parquet(*[f"{self.folder}/counts/{v}" for v in range(version + 1)])

    def snapshot(self) -> DataFrame:
        return self._read("snapshot")

    def cube(self) -> DataFrame:
        return self._read("cube")

    def changes(self) -> DataFrame:
        """The signed changes (dims, d_rows, d_tokens) of the last update."""
        return self._read("deltas")

    def update(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """Take ``docs`` as the new state; returns the new cube."""
        self._write(count_table(docs, self.id_cols, self.counts(), text, self.vocabulary, self.tokenizers), "counts")
        new = self._write(snapshot(docs, self.counts(self.version + 1), self.id_cols, self.dims, text, self.vocabulary), "snapshot")
        old = self.snapshot() if self.version >= 0 else new.limit(0)
        change = self._write(deltas(old, new, self.id_cols, self.dims), "deltas")
        before = self.cube() if self.version >= 0 else cube(new.limit(0), self.dims)
        self._write(apply_deltas(before, change, self.dims), "cube")
        self.version += 1
        return self.cube()

    def remove(self, ids: DataFrame) -> DataFrame:
        """An update that takes the rows of ``ids`` (distinct) out; returns the new cube.

        Only the ledger is read: no text is looked at or moved.
        """
        small = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        old = self.snapshot()
        self._write(self.counts().limit(0), "counts")
        self._write(old.join(small, self.id_cols, "left_anti"), "snapshot")
        gone = old.join(small, self.id_cols, "left_semi").groupBy(*self.dims)
        change = self._write(gone.agg((-F.count(F.lit(1))).alias("d_rows"), (-F.sum("n_tokens")).alias("d_tokens")), "deltas")
        self._write(apply_deltas(self.cube(), change, self.dims), "cube")
        self.version += 1
        return self.cube()


def usual_lang(col: Column, known: tuple[str, ...] | None = ("en", "ru", "kk")) -> Column:
    """Lower-case primary subtag of a language tag; null where it names no language, or none of ``known``."""
    tag = F.regexp_extract(F.lower(F.trim(col)), r"^([a-z]{2,3})(?:$|[^a-z])", 1)
    alias = F.create_map(*[F.lit(x) for x in ("eng", "en", "rus", "ru", "kaz", "kk", "kz", "kk")])
    tag = F.coalesce(F.element_at(alias, tag), tag)
    return F.when(tag.isin(*known) if known else tag != "", tag)


def corpus_units(val: DataFrame, documents: DataFrame, synth: DataFrame, sources: DataFrame) -> DataFrame:
    """(tbl, row_key, source, lang, domain, text, arrived) of the three tables.

    Message contents of a dialogue are joined by line ends; the language slice of
    dialogues is meta.locale.  ``sources`` is a dimension table of one row per
    source, far below any row table; its size is left to the optimizer to judge.
    """
    parts = [
        val.select(F.lit("val").alias("tbl"), F.col("row_id").alias("row_key"), "source", F.col("lang").alias("lang"), "text", F.col("rendered_at").alias("arrived")),
        documents.select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("row_key"), "source", "lang", "text", F.col("ingested_at").alias("arrived")),
        synth.select(
            F.lit("v13_shape_synth").alias("tbl"), F.col("rec_id").alias("row_key"), F.col("batch_name").alias("source"), F.col("meta.locale").alias("lang"),
            F.array_join(F.transform("messages", lambda m: F.coalesce(m["content"], F.lit(""))), "\n").alias("text"), F.col("ingested_at").alias("arrived"),
        ),
    ]
    units = parts[0].unionByName(parts[1]).unionByName(parts[2])
    domain = sources.groupBy("source").agg(F.min("domain_name").alias("domain"))
    return units.withColumn("lang", usual_lang(F.col("lang"), None)).join(domain, "source", "left")


def tokenizer_available(tokenizers: str = TOKENIZERS) -> bool:
    return importlib.util.find_spec("tiktoken") is not None and os.path.exists(f"{tokenizers}/{VOCABULARY}")
