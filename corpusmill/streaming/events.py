"""Extensions for unbounded input: late data, sessions and custom state over events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1, pattern: str = "*.parquet") -> DataFrame:
    """A stream of event files; times without zone are read in the session's (UTC)."""
    t = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", pattern).parquet(folder)
    return t.withColumn("ts", F.col("ts").cast("timestamp"))


def first_deliveries(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events once each, however often delivered, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def hourly(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts and mean value per type and hour; rows later than the watermark are left out."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value")).select("w.start", "w.end", "event_type", "n", "mean_value")


def sliding(events: DataFrame, late: str = "1 day", size: str = "6 hours", step: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size, step).alias("w"), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "event_type", "n")


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Sessions per user, closed by the watermark."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return w.agg(F.count(F.lit(1)).alias("n")).select("user_id", "w.start", "w.end", "n")


def transition_alerts(events: DataFrame, allowed: set[tuple[str, str]], late: str = "1 day") -> DataFrame:
    """(user_id, from, to, ts, late) of steps that aren't allowed; keeps each user's last event as state.

    All of a user's events of a trigger are put in order together, ties by type.  An event older than the state can't
    be put in order any more: it is reported with ``late`` and leaves the state as it is.
    """

    def run(key, frames, state):
        last_ts, last = state.get if state.exists else (None, None)
        out = []
        for ts, kind in sorted((x for f in frames for x in zip(f["ts"], f["event_type"], strict=True)), key=lambda x: (x[0], x[1] or "")):
            if last_ts is not None and ts.timestamp() < last_ts:
                out.append((key[0], last, kind, ts, True))
                continue
            if last is not None and kind != last and (last, kind) not in allowed:
                out.append((key[0], last, kind, ts, False))
            last_ts, last = ts.timestamp(), kind
        if last is not None:
            state.update((last_ts, last))
        yield pd.DataFrame(out, columns=["user_id", "from", "to", "ts", "late"])

    return (
        events.withWatermark("ts", late).groupBy("user_id")
        .applyInPandasWithState(run, "user_id long, `from` string, `to` string, ts timestamp, late boolean", "last_ts double, last string", "append", "NoTimeout")
    )


def run_once(stream: DataFrame, folder: str) -> DataFrame:
    """Work off what is there (as many triggers as the source has) into ``folder``; returns what was written."""
    q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
