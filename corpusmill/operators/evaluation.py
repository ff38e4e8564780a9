"""Evaluation analytics: pass rates, comparisons, gates and diversity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import ngrams, tokens


def pass_rates(scored: DataFrame, group_sets: list[list[str]], passed: str = "passed") -> DataFrame:
    """One pass over the rows for all grouping sets; ungrouped columns are null."""
    cols = sorted({c for s in group_sets for c in s})
    sets = [[F.col(c) for c in s] for s in group_sets]
    g = scored.groupingSets(sets, *[F.col(c) for c in cols]).agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("total"), F.count_if(passed).alias("n_passed"))
    return g.withColumn("failed_n", F.col("total") - F.col("n_passed")).withColumn("pass_rate", F.try_divide(F.col("n_passed"), F.col("total")))


def full_compare(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer comparison of pass flags; a missing side counts as not passed."""
    b = before.select(*keys, F.col("passed").alias("was"))
    a = after.select(*keys, F.col("passed").alias("now"))
    t = b.join(a, keys, "full").withColumn("was", F.coalesce("was", F.lit(False))).withColumn("now", F.coalesce("now", F.lit(False)))
    return t.withColumn("change", F.when(F.col("was") == F.col("now"), "same").when(F.col("now"), "fixed").otherwise("broken"))


def direction(delta: Column, dead_band: float = 0.001) -> Column:
    return F.when(delta > dead_band, "improved").when(delta < -dead_band, "worse").otherwise("flat")


def distinct_n(rows: DataFrame, group: list[str], text: Column, n: int = 2) -> DataFrame:
    """Distinct n-grams over all n-grams per group, counted in two map-combined steps."""
    t = rows.select(*group, F.explode(ngrams(tokens(text), n)).alias("g"))
    per = t.groupBy(*group, "g").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy(*group).agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("c").alias("n_all"), (F.count(F.lit(1)) / F.sum("c")).alias(f"distinct_{n}"))


def adjacent_delta(rows: DataFrame, order: str, metric: str) -> DataFrame:
    """Each config's metric against the one before in order; configs are few by nature."""
    w = Window.orderBy(order)
    return rows.withColumn("previous", F.lag(metric).over(w)).withColumn("delta", F.col(metric) - F.col("previous"))


def explode_reasons(rows: DataFrame, reasons: str, categories: list[str]) -> DataFrame:
    """Count of every fixed category, 0 where none occurred."""
    got = rows.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    dim = rows.sparkSession.createDataFrame([(c,) for c in categories], "reason string")
    return dim.join(got, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("n"))


def percentiles(rows: DataFrame, group: str, value: str, shares: list[float], accuracy: int | None = None) -> DataFrame:
    """(group, n, least, p50 ..., most): percentiles per group, nulls left out.

    Exact ones keep the distinct values of a group together (equal values are counted before the shuffle); with
    ``accuracy`` they come from a sketch of bounded size, off by n / accuracy ranks at most.
    """
    names = [f"p{round(s * 100)}" for s in shares]
    if accuracy is not None:
        cut = [F.percentile_approx(value, s, accuracy).alias(k) for s, k in zip(shares, names, strict=True)]
        return rows.groupBy(group).agg(F.count(value).alias("n"), F.min(value).alias("least"), *cut, F.max(value).alias("most"))
    counted = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("_n"))
    cut = [F.percentile(value, s, F.col("_n")).alias(k) for s, k in zip(shares, names, strict=True)]
    return counted.groupBy(group).agg(F.coalesce(F.sum(F.when(F.col(value).isNotNull(), F.col("_n"))), F.lit(0)).alias("n"), F.min(value).alias("least"), *cut, F.max(value).alias("most"))
