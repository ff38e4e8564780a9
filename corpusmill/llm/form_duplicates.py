"""Problem 3: duplicates hidden by formatting differences.

Rows are hashed in place (``fold.hash_strings``); only 16 bytes and an id per
row are shuffled.  Texts travel only for rows whose hash is shared, and each of
them is compared with its group's first row by two pointers.  Rows that turn out
to collide without being equal are grouped again by a digest of their canonical
form, so the result is exact.

Defined cases: null messages are no row of any group; null content counts as no
words; roles compare exactly (null as its own role); repeated deliveries are
rows of their own; an empty table gives no groups.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import fold
from corpusmill.runtime import salted_join, salts_for, settle

_ROLE = np.uint64(0xD6E8FEB86659FD93)


def _flat(messages: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Row offsets, roles and contents of an array<struct<role, content>> column."""
    if isinstance(messages, pa.ChunkedArray):
        messages = messages.combine_chunks()
    counts = np.asarray(messages.value_lengths().fill_null(0))
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    inner = messages.flatten()
    kinds = [inner.type.field(i).name for i in range(inner.type.num_fields)]
    fields = inner.flatten()
    return offsets, fields[kinds.index("role")], fields[kinds.index("content")]


def _hash_batches(batches):
    for batch in batches:
        offsets, roles, contents = _flat(batch.column(1))
        a, b, size = fold.hash_strings(contents)
        role_hash = pa.compute.fill_null(roles, "\x00").dictionary_encode()
        kinds = np.array([int.from_bytes(hashlib.blake2b(r.as_py().encode(), digest_size=8).digest(), "little") for r in role_hash.dictionary] or [0], np.uint64)
        role = kinds[np.asarray(role_hash.indices)] if len(roles) else np.zeros(0, np.uint64)
        n = np.diff(offsets)
        place = np.arange(len(a)) - np.repeat(offsets[:-1], n)
        out = []
        with np.errstate(over="ignore"):
            for h, base in zip((a, b), fold.BASES[::-1], strict=True):
                x = (h ^ (size.astype(np.uint64) * _ROLE)) + role * np.uint64(0xFF51AFD7ED558CCD)
                x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
                x = (x ^ (x >> np.uint64(29))) * fold.powers(base, int(n.max(initial=0)) + 1)[place]
                part = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
                out.append(part[offsets[1:]] - part[offsets[:-1]])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(out[0].view(np.int64)), pa.array(out[1].view(np.int64)), pa.array(n.astype(np.int32))],
            ["id", "h1", "h2", "n_messages"],
        )


def fingerprints(rows: DataFrame, id_col: str, messages_col: str) -> DataFrame:
    """(id, h1, h2, n_messages) of each row with messages."""
    return (
        rows.where(F.col(messages_col).isNotNull())
        .select(F.col(id_col).cast("long").alias("id"), F.col(messages_col).alias("messages"))
        .mapInArrow(_hash_batches, "id long, h1 long, h2 long, n_messages int")
    )


def _compare_batches(batches):
    """Adds ``same``: whether both conversations are equal, and a digest where they aren't."""
    for batch in batches:
        same, digest = [], []
        for mine, theirs in zip(batch.column("messages").to_pylist(), batch.column("keep_messages").to_pylist(), strict=True):
            ok = len(mine) == len(theirs) and all(
                (x or {}).get("role") == (y or {}).get("role") and fold.same_words((x or {}).get("content"), (y or {}).get("content"))
                for x, y in zip(mine, theirs, strict=True)
            )
            same.append(ok)
            canon = None if ok else repr([((x or {}).get("role"), fold.canonical((x or {}).get("content"))) for x in mine])
            digest.append(canon and hashlib.blake2b(canon.encode(), digest_size=16).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("keep_id"), pa.array(same, pa.bool_()), pa.array(digest, pa.string())],
            ["id", "keep_id", "same", "digest"],
        )


def form_duplicates(rows: DataFrame, id_col: str = "rec_id", messages_col: str = "messages") -> DataFrame:
    """(keep_id, dup_id): one row for each row that repeats an earlier id's words.

    ``keep_id`` is the smallest id of the group.
    """
    keys = ["h1", "h2", "n_messages"]
    prints = settle(fingerprints(rows, id_col, messages_col), "form-prints")
    groups = (
        prints.groupBy(*keys)
        .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .withColumn("n_salts", salts_for(F.col("n")))
        .drop("n")
    )
    groups = settle(groups, "form-groups")
    members = salted_join(prints, groups, keys, F.col("id"), "inner").select("id", "keep_id")
    texts = rows.select(F.col(id_col).cast("long").alias("id"), F.col(messages_col).alias("messages"))
    dups = members.where("id <> keep_id").join(texts, "id")
    keeps = groups.select("keep_id", "n_salts").join(texts.withColumnRenamed("id", "keep_id"), "keep_id").withColumnRenamed("messages", "keep_messages")
    compared = salted_join(dups, keeps, ["keep_id"], F.col("id"), "inner").select("id", "keep_id", "messages", "keep_messages").mapInArrow(
        _compare_batches, "id long, keep_id long, same boolean, digest string"
    )
    compared = settle(compared, "form-compared")
    good = compared.where("same").select("keep_id", F.col("id").alias("dup_id"))
    # Hash collisions: as good as never, but exact.  Rows unequal to the first row form groups by digest.
    odd = compared.where("not same")
    odd_keep = odd.groupBy("digest").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    odd_keep = odd_keep.withColumn("n_salts", salts_for(F.col("n"))).drop("n")
    rest = salted_join(odd.select("digest", "id"), odd_keep, ["digest"], F.col("id")).where("id <> keep_id")
    return good.unionByName(rest.select("keep_id", F.col("id").alias("dup_id")))


def collapse(rows: DataFrame, id_col: str = "rec_id", messages_col: str = "messages") -> DataFrame:
    """One id per conversation with its number of copies."""
    dup = form_duplicates(rows, id_col, messages_col)
    ids = rows.where(F.col(messages_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"))
    counts = dup.groupBy("keep_id").agg((F.count(F.lit(1)) + 1).alias("n_copies"))
    single = ids.join(dup.select(F.col("dup_id").alias("id")), "id", "left_anti")
    return single.join(counts, F.col("id") == F.col("keep_id"), "left").select("id", F.coalesce("n_copies", F.lit(1)).alias("n_copies"))
