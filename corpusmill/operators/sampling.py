"""Deterministic splits, quotas and weights by hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw_key(id_col: Column, seed: int) -> Column:
    """A portable random key: md5 of id and seed."""
    return F.md5(F.concat_ws(":", id_col.cast("string"), F.lit(str(seed))))


def hash_split(rows: DataFrame, id_col: str, per_mille: int, seed: int = 42) -> DataFrame:
    """val or train by the key's first digits: no sort, no shuffle, the same at any size."""
    bucket = F.conv(F.substring(draw_key(F.col(id_col), seed), 1, 7), 16, 10).cast("long") % 1000
    return rows.withColumn("split", F.when(bucket < per_mille, "val").otherwise("train"))


def stratified_split(rows: DataFrame, id_col: str, stratum: Column, share: float, seed: int = 42) -> DataFrame:
    """Exactly floor(n x share + 0.5) validation rows per stratum, those of smallest key."""
    keyed = rows.withColumn("_s", F.coalesce(stratum, F.lit(""))).withColumn("_k", draw_key(F.col(id_col), seed))
    ranked = bucket_rank(keyed, ["_s"], F.col("_k"), F.substring("_k", 1, 2))
    need = F.floor(F.col("_total") * share + 0.5)
    return ranked.withColumn("split", F.when(F.col("_rank") <= need, "val").otherwise("train")).drop("_s", "_k", "_total", "_rank")


def bucket_rank(rows: DataFrame, groups: list[str], order: Column, bucket: Column, only: DataFrame | None = None) -> DataFrame:
    """``_rank`` of each row within its groups and the group's ``_total``, without one task per group.

    ``bucket`` must be monotone in ``order``.  Rows are ranked within a bucket;
    the rows before a bucket come from a small table of counts, joined on group
    and bucket.  A group with a third of all rows is as many tasks as it has
    buckets.  ``only`` (a row per group) limits the work to its groups and adds
    its columns.
    """
    t = rows.withColumn("_b", bucket)
    counts = t.groupBy(*groups, "_b").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0))).withColumn("_total", F.sum("_n").over(Window.partitionBy(*groups))).drop("_n")
    if only is not None:
        base = base.join(only, groups)
    within = F.row_number().over(Window.partitionBy(*groups, "_b").orderBy(order))
    return t.withColumn("_in", within).join(base, [*groups, "_b"]).withColumn("_rank", F.col("_in") + F.col("_before")).drop("_in", "_b", "_before")


def quota(rows: DataFrame, id_col: str, group: Column, quotas: DataFrame, seed: int = 42) -> DataFrame:
    """At most ``quotas.n`` rows per ``quotas.grp``, those of smallest key."""
    keyed = rows.withColumn("grp", group).where("grp is not null").withColumn("_k", draw_key(F.col(id_col), seed))
    most = quotas.select("grp", F.col("n").alias("_most"))
    ranked = bucket_rank(keyed, ["grp"], F.col("_k"), F.substring("_k", 1, 2), most)
    return ranked.where(F.col("_rank") <= F.col("_most")).drop("_k", "_rank", "_most", "_total")


def slots(rows: DataFrame, id_col: str, group: Column, width: int = 100_000) -> DataFrame:
    """``slot``: the row's place within its group by id; sort by (slot, group) to interleave the groups."""
    t = rows.withColumn("_g", F.coalesce(group, F.lit("")))
    ranked = bucket_rank(t, ["_g"], F.col(id_col), F.floor(F.col(id_col) / width))
    return ranked.withColumn("slot", F.col("_rank").cast("int")).drop("_g", "_rank", "_total")


def oversample(rows: DataFrame, weight: Column) -> DataFrame:
    """Each row ``weight`` times, with its copy number from 1."""
    return rows.withColumn("_w", weight.cast("int")).where("_w > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_w")))).drop("_w")


def balance(rows: DataFrame, id_col: str, group: Column, quotas: DataFrame, seed: int = 42) -> DataFrame:
    """Exactly ``quotas.n`` rows per ``quotas.grp``: those of smallest key, or, where a group is short, all of its rows over and over.

    ``copy`` numbers the uses of a row from 1.  Groups without rows give none; rows of other groups are left out.
    """
    keyed = rows.withColumn("grp", group).where("grp is not null").withColumn("_k", draw_key(F.col(id_col), seed))
    ranked = bucket_rank(keyed, ["grp"], F.col("_k"), F.substring("_k", 1, 2), quotas.select("grp", F.col("n").alias("_most")))
    uses = (F.floor(F.col("_most") / F.col("_total")) + F.when(F.col("_rank") <= F.col("_most") % F.col("_total"), 1).otherwise(0)).cast("int")
    return oversample(ranked.withColumn("_uses", uses), F.col("_uses")).drop("_k", "_rank", "_most", "_total", "_uses")


def positions(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``pos``: each row's place from 0 in a total order, without a task that holds all rows.

    Rows are range-partitioned and sorted; a row's place is its place within its partition plus the sizes of the
    partitions before, a small table (one row per partition).
    """
    from corpusmill.runtime import settle

    place = F.monotonically_increasing_id()
    sorted_ = settle(rows.orderBy(*order).withColumn("_part", F.shiftrightunsigned(place, 33).cast("int")).withColumn("_at", place.bitwiseAND((1 << 33) - 1)), "positions")
    sizes = sorted_.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return sorted_.join(F.broadcast(before), "_part").withColumn("pos", F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")  # one row per partition


def zip_rows(left: DataFrame, right: DataFrame, left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """Row i of one side with row i of the other; sides of different length are an error, as nothing can be said of the rest."""
    a, b = positions(left, left_order), positions(right, right_order)
    n, m = a.count(), b.count()
    if n != m:
        raise ValueError(f"{n} rows can't be aligned with {m}")
    return a.join(b, "pos")
