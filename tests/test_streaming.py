import datetime as dt

import pytest

from corpusmill.streaming import events as ev


@pytest.fixture
def folder(spark, tmp_path):
    rows = [
        [(1, dt.datetime(2024, 1, 1, 0, 5), 1, "view", 1.0, None), (2, dt.datetime(2024, 1, 1, 0, 30), 1, "purchase", 3.0, None), (2, dt.datetime(2024, 1, 1, 0, 30), 1, "purchase", 3.0, None)],
        [(3, dt.datetime(2024, 1, 5, 0, 0), 1, "view", 1.0, None)],
        [(5, dt.datetime(2024, 1, 9, 0, 0), 2, "view", 1.0, None)],
        # Late rows are filtered by the watermark of the batch before the last.
        [(4, dt.datetime(2024, 1, 1, 0, 10), 1, "view", 9.0, None), (6, dt.datetime(2024, 1, 20, 0, 0), 2, "view", 1.0, None)],
    ]
    for i, r in enumerate(rows):
        t = spark.createDataFrame(r, ev.EVENTS).coalesce(1)
        t.write.mode("append").parquet(str(tmp_path / "in"))
        newest = max((tmp_path / "in").glob("part-*.parquet"), key=lambda p: p.stat().st_mtime_ns)
        import os

        os.utime(newest, (1_700_000_000 + i * 10, 1_700_000_000 + i * 10))
    return tmp_path


def drain(stream, folder, name):
    spark = stream.sparkSession
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_once_and_late_rows(spark, folder):
    got = [r["event_id"] for r in drain(ev.first_deliveries(ev.read_events(spark, str(folder / "in"))), folder, "once")]
    assert sorted(got) == [1, 2, 3, 5, 6]


def test_hourly_leaves_out_late_rows(spark, folder):
    got = {(r["start"].day, r["event_type"]): r["n"] for r in drain(ev.hourly(ev.read_events(spark, str(folder / "in"))), folder, "hourly")}
    assert got[(1, "view")] == 1 and got[(1, "purchase")] == 2


def test_sessions_and_state(spark, folder):
    got = {(r["user_id"], r["start"].day): r["n"] for r in drain(ev.sessions(ev.read_events(spark, str(folder / "in"))), folder, "sess")}
    assert got[(1, 1)] == 3
    alerts = drain(ev.transition_alerts(ev.read_events(spark, str(folder / "in")), {("view", "click")}), folder, "alerts")
    assert ("view", "purchase") in {(r["from"], r["to"]) for r in alerts}
