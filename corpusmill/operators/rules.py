"""A rule engine over nested drafts: one struct column per rule, the first violation wins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Name, severity (block or warn), whether a retry may help, message, and when it is violated."""

    name: str
    severity: str
    retriable: bool
    message: str
    violated: Column


class RuleSet:
    """Rules in order of precedence; a null condition means that the rule doesn't apply."""

    def __init__(self, *rules: Rule):
        self.rules = rules

    def _struct(self, r: Rule) -> Column:
        return F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.retriable).alias("retriable"), F.lit(r.message).alias("message"))

    def first(self) -> Column:
        return F.coalesce(*[F.when(F.coalesce(r.violated, F.lit(False)), self._struct(r)) for r in self.rules])

    def every(self) -> Column:
        return F.array_compact(F.array(*[F.when(F.coalesce(r.violated, F.lit(False)), self._struct(r)) for r in self.rules]))

    def apply(self, drafts: DataFrame) -> DataFrame:
        return drafts.withColumn("violation", self.first()).withColumn("violations", self.every())


def distinct_days(times: Column) -> Column:
    return F.size(F.array_distinct(F.transform(times, lambda t: F.to_date(t))))


def span_hours(times: Column) -> Column:
    """Hours between the first and the last time; null under one time."""
    return F.timestamp_diff("SECOND", F.array_min(times), F.array_max(times)) / 3600.0


def all_known(labels: Column, vocabulary: list[str]) -> Column:
    return F.forall(labels, lambda x: x.isin(*vocabulary))


def all_in(claimed: Column, evidence: Column) -> Column:
    """Every claimed value is among the evidence (string equality)."""
    return F.size(F.array_except(claimed, evidence)) == 0


def shared(a: Column, b: Column) -> Column:
    return F.arrays_overlap(a, b)


def last_sentence_asks(c: Column) -> Column:
    """Whether at most one question is asked and it closes the text."""
    n = F.coalesce(F.regexp_count(c, F.lit(r"\?")), F.lit(0))
    return (n == 0) | ((n == 1) & F.coalesce(F.rtrim(c).endswith("?"), F.lit(False)))


def quoted_support(quote: Column, excerpts: Column, least: float = 0.8) -> Column:
    """Whether some excerpt is within a Levenshtein ratio of the quotation."""
    ratio = lambda x: 1 - F.levenshtein(quote, x) / F.greatest(F.length(quote), F.length(x), F.lit(1))
    return F.exists(excerpts, lambda x: ratio(x) >= least)
