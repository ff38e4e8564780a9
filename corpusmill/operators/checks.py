"""Ordered named checks: the first that fires wins, all that fire can be listed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class CheckSet:
    """(name, condition that means failure) in order; a null condition doesn't fire."""

    def __init__(self, *checks: tuple[str, Column]):
        self.checks = [(name, F.coalesce(cond, F.lit(False))) for name, cond in checks]

    def first_failure(self) -> Column:
        return F.coalesce(*[F.when(cond, F.lit(name)) for name, cond in self.checks])

    def failures(self) -> Column:
        return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in self.checks]))

    def apply(self, rows: DataFrame) -> DataFrame:
        """Adds ``failed`` (first check or null) and ``passed``."""
        return rows.withColumn("failed", self.first_failure()).withColumn("passed", F.col("failed").isNull())
