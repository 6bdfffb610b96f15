"""Event-time streams: late rows, state that falls, batches tried again, and the trend of a stream against that of a table."""

import datetime as dt
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from starfold.operators.kernels import biweight_trend
from starfold.streaming import events, trend

START = dt.datetime(2024, 1, 1)
HOUR = 3_600_000_000


class Source:
    """A folder that files arrive in, one after another."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema = spark, str(folder / "in"), schema

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.folder)
        time.sleep(0.05)

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.folder)


@pytest.fixture
def log(spark):
    log = events.ProgressLog()
    spark.streams.addListener(log)
    yield log
    spark.streams.removeListener(log)


def waited(log, batches):
    """Listener events come a moment after their batch."""
    for _ in range(100):
        if len(log.batches) >= batches:
            break
        time.sleep(0.1)
    return list(log.batches)


def at(hours):
    return START + dt.timedelta(hours=hours)


def test_closed_sessions_drop_late_rows_and_forget(spark, tmp_path, log):
    s = Source(spark, tmp_path, "key long, ts timestamp")
    s.add([(1, at(0)), (1, at(1)), (2, at(0)), (1, at(10))])
    s.add([(3, at(100))])
    s.add([(1, at(2)), (3, at(101))])  # two hours are long past
    s.add([(4, at(300))])
    out = events.append_to_end(spark, events.closed_sessions(s.stream(), "ts", "key", "6 hours", "1 hour"))
    got = sorted((r["key"], r["n"], r["first"], r["last"]) for r in out.collect())
    assert got == [(1, 1, at(10), at(10)), (1, 2, at(0), at(1)), (2, 1, at(0), at(0)), (3, 2, at(100), at(101))]
    batches = waited(log, 5)
    assert sum(b["late"] for b in batches) == 1 and sum(b["rows"] for b in batches) == 8
    assert batches[0]["state_rows"] >= 3 and batches[-1]["state_rows"] == 1  # only the open one is left
    assert all(v is None for v in log.ended.values()) and log.ended


def test_no_rows_give_no_rows(spark, tmp_path):
    s = Source(spark, tmp_path, "key long, ts timestamp")
    s.add([])
    assert events.append_to_end(spark, events.closed_sessions(s.stream(), "ts", "key", "6 hours", "1 hour")).collect() == []


def test_completions_count_once_and_leave_the_state(spark, tmp_path, log):
    s = Source(spark, tmp_path, "task string, ts timestamp, host string")
    s.add([("a", at(0), "x"), ("a", at(0), "x"), ("b", at(1), "x")])
    s.add([("a", at(1), "y"), ("c", at(2), "y")])  # a worker that tried again
    s.add([("d", at(200), "z")])
    out = events.append_to_end(spark, events.first_completions(s.stream(), ["task"], "ts", "3 hours"))
    assert sorted((r["task"], r["host"]) for r in out.collect()) == [("a", "x"), ("b", "x"), ("c", "y"), ("d", "z")]
    assert waited(log, 4)[-1]["state_rows"] == 1


def test_a_batch_tried_again_leaves_its_rows_once(spark, tmp_path):
    s = Source(spark, tmp_path, "task string, ts timestamp")
    s.add([("a", at(0))])
    s.add([("b", at(1))])
    s.add([("c", at(2))])
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    fails = [True]

    def work(batch):
        if batch.filter("task = 'b'").count() and fails.pop():
            batch.write.mode("overwrite").parquet(f"{out}/batch=1")  # written, but the batch isn't committed
            raise RuntimeError("the driver is lost")
        return batch

    result = lambda: events.first_completions(s.stream(), ["task"], "ts", "3 hours")
    with pytest.raises(Exception, match="lost"):
        events.append_to_end(spark, result(), out, progress, work)
    assert sorted(r["task"] for r in spark.read.parquet(out).collect()) == ["a", "b"]
    fails.append(False)
    done = events.append_to_end(spark, result(), out, progress, work)
    assert sorted(r["task"] for r in done.collect()) == ["a", "b", "c"]
    s.add([("d", at(3)), ("c", at(2))])
    again = events.append_to_end(spark, result(), out, progress)
    assert sorted(r["task"] for r in again.collect()) == ["a", "b", "c", "d"]


def plain_trends(rows, half, gap, passed_ms):
    """The batch kernel on whole segments, for the rows whose window has passed."""
    found = {}
    for key in {r[0] for r in rows}:
        mine = sorted((us, c, x) for k, c, us, x in rows if k == key and x is not None and np.isfinite(x))
        us = np.array([r[0] for r in mine])
        segment = np.concatenate([[0], np.cumsum(np.diff(us) > gap)])
        for s in np.unique(segment):
            at_ = segment == s
            t, x = us[at_].astype(float), np.array([r[2] for r in mine])[at_]
            for (u, c, _), v in zip([m for m, a in zip(mine, at_, strict=True) if a], biweight_trend(t, x, np.ones(len(t), bool), 2.0 * half), strict=True):
                if trend.due_ms(u, half) <= passed_ms:
                    found[key, c] = v if v > 0 else 1.0
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_the_trend_of_a_stream_is_that_of_a_table(spark, tmp_path, log, seed):
    rng = np.random.default_rng(seed)
    rows, half, gap = [], 6 * HOUR, 4 * HOUR
    for key in range(3):
        us = np.cumsum(rng.exponential(0.7 * HOUR, 150)).astype(np.int64) + rng.integers(0, HOUR)
        rows += [(key, i, int(u), None if i % 41 == 7 else float(10 + np.sin(u / HOUR / 9) + rng.normal() * 0.1)) for i, u in enumerate(us)]
    rows += [(9, 0, 5 * HOUR, 3.0), (9, 1, 5 * HOUR, 4.0), (9, 2, 5 * HOUR, float("nan"))]  # a key that goes idle; ties
    table = spark.createDataFrame(rows, "target_id long, cadence long, us long, flux double").withColumn("ts", F.timestamp_micros("us"))
    stream = events.arrivals(spark, table, "us", 6, 7 * HOUR)
    out = events.append_to_end(spark, trend.sliding_trend(stream, 2 * half, gap, "8 hours"))
    last = max(r[2] for r in rows)
    expected = plain_trends(rows, half, gap, last // 1000 - 8 * 3_600_000)
    got = {(r["target_id"], r["cadence"]): r["trend"] for r in out.collect()}
    assert out.count() == len(got) and set(got) == set(expected) and len(got) > 300
    assert all(abs(got[k] - v) < 1e-9 for k, v in expected.items())
    assert all(b["late"] == 0 for b in waited(log, 6))


def test_an_idle_key_leaves_no_state(spark, tmp_path, log):
    s = Source(spark, tmp_path, "target_id long, cadence long, ts timestamp, flux double")
    s.add([(1, i, at(i / 10), 1.0 + i) for i in range(50)] + [(None, 1, at(0), 1.0), (1, 99, None, 1.0)])
    s.add([(2, 0, at(100), 5.0)])
    s.add([(1, 77, at(1), 9.0), (2, 1, at(101), 6.0)])  # late
    out = events.append_to_end(spark, trend.sliding_trend(s.stream(), 4 * HOUR, HOUR, "1 hour"))
    assert sorted(r["cadence"] for r in out.filter("target_id = 1").collect()) == list(range(50))
    batches = waited(log, 4)
    held = [b["state_rows"] for b in batches]
    assert max(held) == 2 * held[-1] and sum(b["late"] for b in batches) == 1  # of two keys the last one alone is left


def test_progress_is_bounded_and_emitted():
    seen = []
    log = events.ProgressLog(most=2, emit=seen.append)
    for i in range(5):
        log.batches.append({"batch": i})
    assert [b["batch"] for b in log.batches] == [3, 4] and seen == []
