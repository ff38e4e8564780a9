"""Chunks of long texts as table functions over native arrays."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import squash


def word_windows(docs: DataFrame, id_col: str, text: str, size: int = 200, overlap: int = 40, least: int = 30) -> DataFrame:
    """(id, start, chunk): windows of ``size`` words; a short last one only if it is the first."""
    step = max(1, size - overlap)
    ws = docs.select(id_col, F.filter(F.split(squash(F.col(text)), " "), lambda x: x != "").alias("w")).withColumn("n", F.size("w"))
    # A window that reaches the end is the last.
    stop = F.when(F.col("n") <= size, F.lit(0)).otherwise((F.ceil((F.col("n") - size) / F.lit(step)) * step).cast("int"))
    starts = ws.where("n > 0").select(id_col, "w", "n", F.explode(F.sequence(F.lit(0), stop, F.lit(step))).alias("start"))
    return starts.where((F.col("start") == 0) | (F.least(F.col("n") - F.col("start"), F.lit(size)) >= least)).select(id_col, "start", F.array_join(F.slice("w", F.col("start") + 1, F.lit(size)), " ").alias("chunk"))


def sections(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, section, title, n_lines): lines grouped under ## and ### headings; section 0 is before any."""
    lines = docs.select(id_col, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    head = F.col("line").rlike("^#{1,3} ").cast("int")
    from pyspark.sql import Window

    w = Window.partitionBy(id_col).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = lines.withColumn("section", F.sum(head).over(w)).withColumn("title", F.when(head == 1, F.regexp_replace("line", "^#{1,3} ", "")))
    return t.groupBy(id_col, "section").agg(F.max("title").alias("title"), F.count(F.lit(1)).alias("n_lines"))


def pack_paragraphs(docs: DataFrame, id_col: str, text: str, limit: int = 600) -> DataFrame:
    """(id, part, body): paragraphs packed greedily until the next would overflow; long ones are cut."""

    def run(frames: Iterable[pd.DataFrame]):
        for frame in frames:
            out = []
            for key, body in zip(frame[id_col], frame[text], strict=True):
                part, n = "", 0
                for p in (x.strip() for x in (body or "").split("\n\n")):
                    while len(p) > limit:
                        if part:
                            out.append((key, n, part))
                            part, n = "", n + 1
                        out.append((key, n, p[:limit]))
                        p, n = p[limit:], n + 1
                    if p and part and len(part) + 2 + len(p) > limit:
                        out.append((key, n, part))
                        part, n = p, n + 1
                    elif p:
                        part = f"{part}\n\n{p}" if part else p
                if part:
                    out.append((key, n, part))
            yield pd.DataFrame(out, columns=[id_col, "part", "body"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInPandas(run, f"{id_col} {kind}, part int, body string")


def split_parts(c: Column, n: int) -> Column:
    """A text as an array of up to ``n`` parts: its paragraphs dealt out in turn, or, with fewer paragraphs than parts, cuts of equal length.

    A text shorter than ``n`` characters stays whole; parts without text are left out; null gives an empty array.
    """
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    paragraphs = F.filter(F.transform(F.split(c, "\n\n"), strip), lambda x: x != "")
    step = F.greatest(F.lit(1), F.floor(F.length(c) / n).cast("int"))
    cuts = F.filter(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: strip(F.substring(c, i * step + 1, step))), lambda x: x != "")
    dealt = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: strip(F.array_join(F.filter(paragraphs, lambda _, i: i % n == k), "\n\n")))
    return F.when(F.size(paragraphs) >= n, dealt).when(F.length(c) < n, F.array(c)).otherwise(cuts)
