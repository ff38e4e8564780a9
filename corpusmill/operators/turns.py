"""Dialogue turns: explode, pair, render, parse, cap and budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import count_matches

END = r"<\|(?:redacted_)?im_end\|>"
TURN = rf"(?s)<\|im_start\|>(\w+)[ \t]*\r?\n?(.*?){END}"


def explode_turns(rows: DataFrame, id_col: str, messages: str = "messages") -> DataFrame:
    """(id, turn from 0, role, content); rows without messages give none."""
    return rows.select(id_col, F.posexplode(messages).alias("turn", "m")).select(id_col, "turn", F.col("m.role").alias("role"), F.col("m.content").alias("content"))


def parse_chatml(c: Column) -> Column:
    """array<struct<role, content>> of a rendered text; either end tag closes a turn."""
    roles = F.regexp_extract_all(c, F.lit(TURN), F.lit(1))
    contents = F.regexp_extract_all(c, F.lit(TURN), F.lit(2))
    return F.zip_with(roles, contents, lambda r, t: F.struct(r.alias("role"), t.alias("content")))


def last_of(messages: Column, role: str) -> Column:
    """Content of the last message of a role; '' without one."""
    return F.coalesce(F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(-1))["content"], F.lit(""))


def first_of(messages: Column, role: str) -> Column:
    return F.get(F.filter(messages, lambda m: m["role"] == role), F.lit(0))["content"]


def render_chatml(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), F.coalesce(m["content"], F.lit("")), F.lit("<|im_end|>\n"))), "")


def with_system(messages: Column, prompt: Column) -> Column:
    """The messages led by a system message; one that is there already stays."""
    system = F.struct(F.lit("system").alias("role"), prompt.alias("content"))
    return F.when(F.exists(messages, lambda m: m["role"] == "system"), messages).otherwise(F.concat(F.array(system), messages))


def adjacent_pairs(turns: DataFrame, id_col: str, least_user: int = 8, least_reply: int = 16) -> DataFrame:
    """User turns with the assistant turn right after, both long enough."""
    w = Window.partitionBy(id_col).orderBy("turn")
    t = turns.withColumn("next_role", F.lead("role").over(w)).withColumn("reply", F.lead("content").over(w))
    return t.where((F.col("role") == "user") & (F.col("next_role") == "assistant") & (F.length("content") >= least_user) & (F.length("reply") >= least_reply)).select(id_col, "turn", F.col("content").alias("query"), "reply")


def last_turns(turns: DataFrame, id_col: str, k: int) -> DataFrame:
    """The last k turns of each dialogue."""
    w = Window.partitionBy(id_col).orderBy(F.desc("turn"))
    return turns.withColumn("back", F.row_number().over(w)).where(F.col("back") <= k)


def within_budget(turns: DataFrame, id_col: str, budget: int) -> DataFrame:
    """Drop the oldest turns until the rest fits; the last turn always stays."""
    w = Window.partitionBy(id_col).orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = turns.withColumn("used", F.sum(F.coalesce(F.length("content"), F.lit(0))).over(w)).withColumn("back", F.count(F.lit(1)).over(w))
    return t.where((F.col("used") <= budget) | (F.col("back") == 1)).drop("back")


def phase_by_count(turns: DataFrame, id_col: str) -> DataFrame:
    """open before any user turn, closing from the fifth on, else deepening."""
    w = Window.partitionBy(id_col).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    n = F.coalesce(F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w), F.lit(0))
    return turns.withColumn("phase", F.when(n == 0, "open").when(n >= 5, "closing").otherwise("deepening"))


def n_turns(c: Column) -> Column:
    return count_matches(c, END)
