"""Streams in append mode: what the watermark has passed, of a table that arrives in several batches and out of order."""

from __future__ import annotations

from pyspark.sql import functions as F

from starfold.queries import query
from starfold.queries.curves import rounded
from starfold.sources.tables import table
from starfold.streaming import events, trend

HOUR_US = 3_600_000_000
#: Rows come up to 20 hours out of order, and the watermark trails by 24.
SCATTER_US, DELAY = 20 * HOUR_US, "24 hours"
PASSED_SQL = "CAST((SELECT epoch_us(max(ts)) FROM events) // 1000 - 24 * 3600 * 1000 AS BIGINT)"


def arriving(spark, d, *columns, files=5):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("us", F.unix_micros("ts"))
    return events.arrivals(spark, e.select("us", *columns), "us", files, SCATTER_US)


@query(f"""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s)
 SELECT user_id AS target_id, count(*) AS n, CAST(epoch_us(min(ts)) AS BIGINT) AS first_us, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us FROM g GROUP BY user_id, k HAVING epoch_us(max(ts)) + 6 * {HOUR_US} <= {PASSED_SQL} * 1000""")
def stream_closed_sessions(spark, d):
    """Segments that are over: the watermark is past their last row and the gap."""
    s = arriving(spark, d, F.col("user_id").alias("target_id"), "ts")
    done = events.append_to_end(spark, events.closed_sessions(s, "ts", "target_id", "6 hours", DELAY))
    return done.select("target_id", "n", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"))


@query("SELECT DISTINCT user_id AS target_id, event_type AS task, strftime(ts, '%Y-%m-%d') AS day FROM events")
def stream_completions(spark, d):
    """A task is a user, a kind and a day; of its completions the first to arrive counts."""
    s = arriving(spark, d, F.col("user_id").alias("target_id"), F.col("event_type").alias("task"), F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts")
    return events.append_to_end(spark, events.first_completions(s, ["target_id", "task", "day"], "ts", "48 hours")).select("target_id", "task", "day")


@query(f"""WITH e AS (SELECT user_id AS target_id, event_id AS cadence, epoch_us(ts) AS us, value AS x FROM events),
 b AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY target_id ORDER BY us, cadence) > 18 * {HOUR_US} THEN 1 ELSE 0 END AS new FROM e),
 p AS (SELECT *, sum(new) OVER (PARTITION BY target_id ORDER BY us, cadence ROWS UNBOUNDED PRECEDING) AS segment FROM b),
 near AS (SELECT a.target_id, a.cadence, a.x, a.us, b.x AS y FROM p a JOIN p b ON a.target_id = b.target_id AND a.segment = b.segment AND b.us BETWEEN a.us - 36 * {HOUR_US} AND a.us + 36 * {HOUR_US}),
 m AS (SELECT target_id, cadence, median(y) AS m FROM near GROUP BY 1, 2),
 s AS (SELECT n.target_id, n.cadence, any_value(m) AS m, median(abs(y - m)) AS s FROM near n JOIN m USING (target_id, cadence) GROUP BY 1, 2),
 w AS (SELECT n.target_id, n.cadence, n.x, n.us, m, s, y, CASE WHEN s < 1e-12 THEN 0 WHEN abs((y - m) / (6 * s)) < 1 THEN (1 - ((y - m) / (6 * s)) ** 2) ** 2 ELSE 0 END AS w FROM near n JOIN s USING (target_id, cadence)),
 t AS (SELECT target_id, cadence, any_value(x) AS x, any_value(us) AS time_us, CASE WHEN any_value(s) < 1e-12 OR sum(w) = 0 THEN any_value(m) ELSE sum(w * y) / sum(w) END AS trend FROM w GROUP BY 1, 2)
 SELECT target_id, cadence, time_us, round(x / CASE WHEN trend > 0 THEN trend ELSE 1 END, 6) AS flux_detrended, round(CASE WHEN trend > 0 THEN trend ELSE 1 END, 6) AS trend FROM t WHERE (time_us + 36 * {HOUR_US}) // 1000 + 1 <= {PASSED_SQL}""")
def stream_trend(spark, d):
    """The biweight trend, three days wide, of rows whose window the watermark has passed."""
    s = arriving(spark, d, F.col("user_id").alias("target_id"), F.col("event_id").alias("cadence"), "ts", F.col("value").alias("flux"))
    return rounded(events.append_to_end(spark, trend.sliding_trend(s, 72 * HOUR_US, 18 * HOUR_US, DELAY)))
