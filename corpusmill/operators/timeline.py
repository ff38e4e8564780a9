"""Operators on event sequences: transitions, trends, recency, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hours_between(a: Column, b: Column) -> Column:
    return F.timestamp_diff("SECOND", a, b) / 3600.0


def adjacent(events: DataFrame, who: str, order: list[str], label: str) -> DataFrame:
    """Consecutive events of one subject with different labels: (who, from, to, hours)."""
    w = Window.partitionBy(who).orderBy(*order)
    t = events.withColumn("to", F.lead(label).over(w)).withColumn("next_ts", F.lead("ts").over(w))
    return t.where(F.col("to").isNotNull() & (F.col("to") != F.col(label))).select(who, F.col(label).alias("from"), "to", "ts", hours_between(F.col("ts"), F.col("next_ts")).alias("hours"))


def validate_transitions(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds ``verdict``: no_edge, too_fast, too_slow or ok.

    ``edges`` is a hand-written dimension (from, to, min_hours, max_hours), one
    row per pair of labels; whether it is broadcast is left to its size.
    """
    t = steps.join(edges, ["from", "to"], "left")
    verdict = F.when(F.col("min_hours").isNull(), "no_edge").when(F.col("hours") < F.col("min_hours"), "too_fast").when(F.col("hours") > F.col("max_hours"), "too_slow").otherwise("ok")
    return t.withColumn("verdict", verdict)


def monotone(values: Column) -> Column:
    """rising, falling or mixed of an array with two or more values; null else."""
    pairs = F.zip_with(F.slice(values, F.lit(1), F.size(values) - 1), F.slice(values, F.lit(2), F.size(values) - 1), lambda a, b: b - a)
    return F.when(F.size(values) < 2, F.lit(None).cast("string")).when(F.forall(pairs, lambda d: d > 0), "rising").when(F.forall(pairs, lambda d: d < 0), "falling").otherwise("mixed")


def sessions(events: DataFrame, who: str, gap_minutes: int) -> DataFrame:
    """(who, session, start, end, n): runs of events with gaps up to ``gap_minutes``."""
    w = Window.partitionBy(who).orderBy("ts", "event_id")
    new = F.coalesce((hours_between(F.lag("ts").over(w), F.col("ts")) * 60 > gap_minutes).cast("int"), F.lit(1))
    t = events.withColumn("new", new).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return t.groupBy(who, "session").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n"))


def dependency_order(items: DataFrame, id_col: str, needs: str) -> DataFrame:
    """(id, root, level): how many items must come before each one, and the first of its chain.

    A chain is followed by doubling: every round joins each item with the item that its
    link has reached so far, so chains of length n take log2 n rounds.  A null, unknown or own id is no
    dependency (level 0); items of a cycle, or that wait for one, have no order: null root and level.
    """
    from corpusmill.runtime import settle

    base = items.select(F.col(id_col).alias("id"), F.col(needs).alias("to"))
    known = base.select(F.col("id").alias("to")).distinct()
    linked = base.where("to is not null and to <> id").join(known, "to", "left_semi").groupBy("id").agg(F.min("to").alias("to"))
    t = settle(base.select("id").distinct().join(linked, "id", "left").select("id", "to", F.when(F.col("to").isNotNull(), 1).otherwise(0).cast("long").alias("level"), F.col("id").alias("root")), "chain")
    n, reach = t.count(), 1
    while t.where("to is not null").limit(1).count() and reach < 2 * n:
        far = t.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("level").alias("more"), F.col("root").alias("far_root"))
        level = F.when(F.col("to").isNull(), F.col("level")).otherwise(F.col("level") + F.col("more"))
        t = settle(t.join(far, "to", "left").select("id", F.col("next").alias("to"), level.alias("level"), F.coalesce("far_root", "root").alias("root")), "chain")
        reach *= 2
    ends = F.col("to").isNull()
    return t.select("id", F.when(ends, F.col("root")).alias("root"), F.when(ends, F.col("level")).alias("level"))
