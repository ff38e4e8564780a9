"""Session defaults, the shared work folder and helpers for skewed keys.

Nothing here pulls data to the driver.  ``settle`` cuts lineage by writing a
table into the folder all executors share, so a lost executor costs a re-read;
``release`` deletes those tables once the results are written.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key that a single task may take before the key is salted.
ROWS_PER_SALT = 50_000
#: Hot keys up to this number are broadcast; beyond, they are joined by a shuffle.
BROADCAST_HOT = 500_000


def session(app: str = "corpusmill", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    Taken from ``spark.checkpoint.dir``; a temporary folder is made only for a
    local master that has none, never on a cluster.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="corpusmill-")
    atexit.register(shutil.rmtree, made, True)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


_scratch: list[str] = []


def scratch(spark: SparkSession, tag: str = "t") -> str:
    """A new path in the shared folder; it goes away with ``release`` or the driver's JVM (Hadoop deleteOnExit)."""
    path = f"{shared_dir(spark).rstrip('/')}/corpusmill/{tag}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    _scratch.append(path)
    return path


def settle(df: DataFrame, tag: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and return it read back."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete all tables settled so far; results that read them must have been written.  Returns their number."""
    n = 0
    while _scratch:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        n += where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return n


def salts_for(count: Column, rows_per_salt: int = ROWS_PER_SALT) -> Column:
    """How many salts a key with ``count`` rows needs (1 for usual keys)."""
    return F.greatest(F.lit(1), F.ceil(count / F.lit(rows_per_salt))).cast("int")


def salted_join(rows: DataFrame, groups: DataFrame, keys: list[str], row_id: Column, how: str = "inner") -> DataFrame:
    """Join many rows to one row per key without a task holding a whole hot key.

    ``groups`` has one row per key and a column ``n_salts``.  Each row goes to
    salt ``hash(row_id) % max salts``; the group row is repeated once per salt,
    so the copies are ``sum(n_salts)``, i.e. rows / ROWS_PER_SALT + keys.
    Keys compare null-safe only if the caller made them non-null.
    """
    hot = groups.where("n_salts > 1").select(*keys, F.col("n_salts").alias("_n"))
    cool = groups.where("n_salts = 1")
    # Hot keys hold over ROWS_PER_SALT rows each, so their number is rows / ROWS_PER_SALT at most; counted all the same.
    n_hot = hot.count()
    if not n_hot:
        return rows.join(groups.drop("n_salts"), keys, how)
    marked = rows.join(F.broadcast(hot) if n_hot <= BROADCAST_HOT else hot, keys, "left").withColumn(
        "_salt", F.when(F.col("_n").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(row_id), F.col("_n")).cast("int"))
    ).drop("_n")
    spread = cool.withColumn("_salt", F.lit(0)).unionByName(
        groups.where("n_salts > 1").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("n_salts") - 1)))
    ).drop("n_salts")
    return marked.join(spread, [*keys, "_salt"], how).drop("_salt")


def block_join(left: DataFrame, right: DataFrame, keys: list[str], left_id: Column, right_id: Column, block: int = 1000) -> DataFrame:
    """Many-to-many join on ``keys`` in which no task holds more than about ``block`` x ``block`` rows of a key.

    A key with more rows than ``block`` on a side is cut into a grid: each left row goes to one line of it
    and all columns, each right row the other way round.  Both inputs are counted, so they should be settled.
    """
    parts = lambda n: F.ceil(F.coalesce(F.col(n), F.lit(1)) / F.lit(block)).cast("int")
    nl = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nl")).where(F.col("_nl") > block)
    nr = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nr")).where(F.col("_nr") > block)
    hot = settle(nl.join(nr, keys, "full").select(*keys, parts("_nl").alias("_kl"), parts("_nr").alias("_kr")), "hot-blocks")
    n_hot = hot.count()
    if not n_hot:
        return left.join(right, keys)
    small = F.broadcast(hot) if n_hot <= BROADCAST_HOT else hot  # (rows left + rows right) / block keys at most
    one = lambda c: F.coalesce(F.col(c), F.lit(1))
    mine = lambda i, k: F.pmod(F.xxhash64(i), one(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), one(k) - 1))
    a = left.join(small, keys, "left").withColumn("_il", mine(left_id, "_kl")).withColumn("_ir", every("_kr")).drop("_kl", "_kr")
    b = right.join(small, keys, "left").withColumn("_ir", mine(right_id, "_kr")).withColumn("_il", every("_kl")).drop("_kl", "_kr")
    return a.join(b, [*keys, "_il", "_ir"]).drop("_il", "_ir")
