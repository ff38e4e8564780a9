"""Problem 9: mixing sources to target weights.

Tokens are summed per source; a source's repetition rate is the share it should
have of the total over what it holds, capped by its repeats.  Every document is
emitted floor(rate) times plus one hash-seeded Bernoulli copy with the fraction
as probability, so emission needs no shuffle and gives the same mix every time.

Defined cases: documents of unlisted or null sources take no part; a listed
source without documents falls short; null or empty texts hold 0 tokens; a null
share or cap counts as 0; an empty target table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.tokens import with_token_counts

#: Hash values are cut to this many steps for the Bernoulli draw.
_STEPS = 1 << 30


def source_tokens(docs: DataFrame, targets: DataFrame, **kw) -> DataFrame:
    """(source, have) for every listed source.

    ``targets`` has one row per source to mix, written by hand; as a dimension
    its size is bounded by the number of sources, not of documents.
    """
    listed = targets.select("source").distinct()
    rows = docs.select("source", "text").join(listed, "source", "left_semi")
    have = with_token_counts(rows, "text", **kw).groupBy("source").agg(F.sum("n_tokens").alias("have"))
    return listed.join(have, "source", "left").fillna(0, ["have"])


def rates(have: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, have, need, cap, rate, short) per listed source."""
    caps = targets.groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap"))
    total = have.agg(F.coalesce(F.sum("have"), F.lit(0))).scalar()
    t = have.join(caps, "source").fillna(0, ["share", "cap"]).withColumn("total", total)
    need = F.col("share") * F.col("total")
    return t.select(
        "source", "have", need.alias("need"), "cap",
        F.when(F.col("have") > 0, F.least(need / F.col("have"), F.col("cap").cast("double"))).otherwise(F.lit(0.0)).alias("rate"),
        (F.col("have") * F.col("cap") < need).alias("short"),
    )


def mix(docs: DataFrame, source_rates: DataFrame, id_col: str = "doc_id", seed: int = 42) -> DataFrame:
    """(id, source, copy): each document floor(rate) times plus a seeded extra copy."""
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(_STEPS)) / F.lit(float(_STEPS))
    rows = docs.select(id_col, "source").join(source_rates.select("source", "rate"), "source")
    copies = (F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    return rows.withColumn("_n", copies).where("_n > 0").select(id_col, "source", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy"))


def shares(docs: DataFrame, source_rates: DataFrame, id_col: str = "doc_id", seed: int = 42, **kw) -> DataFrame:
    """(source, target_tokens, mixed_tokens, mixed_share, short) of the mix as drawn."""
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(_STEPS)) / F.lit(float(_STEPS))
    rows = docs.select(id_col, "source", "text").join(source_rates.select("source", "rate"), "source")
    rows = rows.withColumn("copies", (F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int"))
    counted = with_token_counts(rows.where("copies > 0").select("source", "copies", "text"), "text", **kw)
    got = counted.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens"))
    total = got.agg(F.sum("mixed_tokens")).scalar()
    t = source_rates.join(got, "source", "left").fillna(0, ["mixed_tokens"]).withColumn("total", total)
    return t.select("source", F.col("need").alias("target_tokens"), "mixed_tokens", F.try_divide("mixed_tokens", "total").alias("mixed_share"), "short")
