"""JSON lines, JSON arrays, directories, markdown, HTML/XML books, configs and salvage of model output.

Readers take an explicit schema; none infers one from the data, so a scan is one
pass and reads only the columns asked for.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

MESSAGES = "array<struct<role:string,content:string>>"


def _schema(spark: SparkSession, ddl: str) -> StructType:
    return spark.createDataFrame([], ddl).schema


def read_jsonl_strict(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Blank lines are skipped; a malformed line fails the query."""
    return spark.read.schema(ddl).option("mode", "FAILFAST").json(path)


def read_jsonl_lenient(spark: SparkSession, path: str, ddl: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, malformed lines as ``_corrupt_record``)."""
    schema = StructType([*_schema(spark, ddl).fields, StructField("_corrupt_record", StringType())])
    raw = spark.read.text(path).where(F.trim("value") != "")
    parsed = raw.select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*")
    return parsed.where("_corrupt_record is null").drop("_corrupt_record"), parsed.where("_corrupt_record is not null").select("_corrupt_record")


def read_json_array(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A file whose root is a list of objects."""
    return spark.read.schema(ddl).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_directory(spark: SparkSession, path: str, ddl: str, pattern: str = "*.jsonl") -> DataFrame:
    """All matching files below ``path``, with the file each row comes from."""
    t = spark.read.schema(ddl).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(path)
    return t.select("*", F.col("_metadata.file_path").alias("source_file"))


def read_strict_keys(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Rows of JSON lines that have no key beyond the schema's; others are dropped."""
    known = F.array(*[F.lit(f.name) for f in _schema(spark, ddl).fields])
    raw = spark.read.text(path).where(F.trim("value") != "")
    keys = F.json_object_keys("value")
    ok = keys.isNotNull() & (F.size(F.array_except(keys, known)) == 0)
    return raw.where(ok).select(F.from_json("value", ddl).alias("r")).select("r.*")


def unify_messages(rows: DataFrame) -> DataFrame:
    """``messages`` from whichever of messages, conversations or ChatML text a row has."""
    from corpusmill.operators.turns import parse_chatml

    have = [F.col(c) for c in ("messages", "conversations") if c in rows.columns]
    if "text" in rows.columns:
        have.append(parse_chatml(F.col("text")))
    return rows.withColumn("messages", F.coalesce(*have))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(file, title, body) of markdown files; drafts (_*) and READMEs are left out."""
    t = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    name = F.col("_metadata.file_name")
    t = t.select(name.alias("file"), F.col("value").alias("body")).where(~F.startswith("file", F.lit("_")) & (F.lower("file") != "readme.md"))
    title = F.nullif(F.regexp_extract("body", r"(?m)^#\s+(.+)$", 1), F.lit(""))
    return t.select("file", F.coalesce(title, F.regexp_replace("file", r"\.md$", "")).alias("title"), "body")


def book_text(data: bytes | None, name: str) -> str | None:
    """Plain text of txt, html, xml and fb2 bytes; None for a format that needs other libraries."""
    if data is None or not re.search(r"\.(txt|md|html?|xml|fb2)$", name, re.I):
        return None
    try:
        raw = data.decode("utf-8")
    except UnicodeDecodeError:
        raw = data.decode("cp1251", "replace")
    if re.search(r"\.(txt|md)$", name, re.I):
        return raw
    raw = re.sub(r"(?is)<(binary|script|style|description)\b.*?</\1>", " ", raw)
    raw = re.sub(r"(?i)</(p|div|title|section|h[1-6])>", "\n", raw)
    raw = html.unescape(re.sub(r"<[^>]+>", " ", raw))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", raw)).strip()


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """(file, body) of books in several formats, through the binary source."""

    def run(frames: Iterable[pd.DataFrame]):
        for f in frames:
            yield pd.DataFrame({"file": f["path"], "body": [book_text(c, p) for c, p in zip(f["content"], f["path"], strict=True)]})

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").mapInPandas(run, "file string, body string").where("body is not null")


def salvage_objects(text: str | None) -> list[str]:
    """Every top-level {...} of a model's output that is JSON; strings and escapes are honoured everywhere, fences ignored."""
    if not text or "{" not in text:
        return []
    text = re.sub(r"(?i)```(?:jsonl?)?", "", text)
    out, depth, start, quoted, escaped = [], 0, None, False, False
    for i, c in enumerate(text):
        if quoted:
            quoted, escaped = escaped or c != '"', c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c == "{":
            start, depth = (i if depth == 0 else start), depth + 1
        elif c == "}":
            depth -= 1
            if depth == 0 and start is not None:
                out.append(text[start : i + 1])
                start = None
    return [x for x in out if _is_json(x)]


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def salvage_rows(rows: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, object): the text of each object found."""

    def run(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            pairs = [(i, o) for i, t in enumerate(b.column(1).to_pylist()) for o in salvage_objects(t)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i for i, _ in pairs], pa.int64())), pa.array([o for _, o in pairs], pa.string())], [id_col, "object"])

    return rows.select(id_col, text).mapInArrow(run, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, object string")


def salvage_json(rows: DataFrame, id_col: str, text: str, ddl: str) -> DataFrame:
    """(id, fields of ddl): one row for each object found in the text."""

    return salvage_rows(rows, id_col, text).select(id_col, F.from_json("object", ddl).alias("o")).select(id_col, "o.*")


def write_jsonl(rows: DataFrame, path: str, mode: str = "overwrite", rows_per_file: int = 0) -> None:
    """UTF-8 JSON lines; ``rows_per_file`` gives batch files."""
    w = rows.write.mode(mode).option("ignoreNullFields", False)
    (w.option("maxRecordsPerFile", rows_per_file) if rows_per_file else w).json(path)


def append_unseen(rows: DataFrame, path: str, key: str) -> DataFrame:
    """Append the rows whose key the parquet table at ``path`` lacks; returns them (resume)."""
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        rows = rows.join(spark.read.parquet(path).select(key), key, "left_anti")
    rows.write.mode("append").parquet(path)
    return rows


def report_markdown(rows: DataFrame, title: str, most: int = 1000) -> str:
    """A small aggregate as a markdown table; refuses more than ``most`` rows."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a report of more than {most} rows isn't a report")
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns) + "\n"
    return f"# {title}\n\n{head}" + "".join("| " + " | ".join("" if x is None else str(x) for x in r) + " |\n" for r in got)
