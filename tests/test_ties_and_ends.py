"""Equal scores and events at an interval's very end: what the queries' SQL says of them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from starfold import catalog
from starfold.operators import cohort


def test_the_first_of_equal_matches_is_picked(spark, tmp_path):
    rows = "(9, 1, 'view', 5.0, 1), (4, 1, 'click', 5.0, 1), (7, 1, 'click', 5.0, 1), (1, 1, 'view', 2.0, 1), (2, 2, 'click', NULL, NULL), (3, 2, 'view', 1.0, 1), (NULL, 3, 'view', 9.0, 1), (8, 3, 'view', 1.0, 1), (5, 4, 'view', NULL, 1)"
    con = duckdb.connect()
    con.execute("SET threads = 1")  # its arg_max then keeps the first row of equal ones
    con.execute(f"CREATE TABLE events AS SELECT a::BIGINT AS event_id, b::BIGINT AS user_id, c AS event_type, d::DOUBLE AS value, CASE WHEN e = 1 THEN TIMESTAMP '2024-01-01' END AS ts FROM (VALUES {rows}) v(a, b, c, d, e) ORDER BY a")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    expected = con.execute(catalog.oracle_sql()["best_match_pick"]).fetchall()
    got = catalog.queries()["best_match_pick"](spark, str(tmp_path)).select("target_id", "clicked", "best_event", "best_value").collect()
    assert sorted(map(tuple, got)) == sorted(expected) == [(1, True, 4, 5.0), (2, False, 3, 1.0), (3, False, 8, 9.0), (4, False, None, None)]


def test_a_pick_does_not_depend_on_the_rows_order(spark, tmp_path):
    rows = spark.range(40).select((39 - F.col("id")).alias("event_id"), (F.col("id") % 2).alias("user_id"), F.lit("view").alias("event_type"), F.lit(3.0).alias("value"), F.timestamp_seconds("id").alias("ts"))
    rows.repartition(5, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["target_id"]: r["best_event"] for r in catalog.queries()["best_match_pick"](spark, str(tmp_path)).collect()}
    assert got == {0: 1, 1: 0}


@pytest.mark.parametrize("epoch,period,day,cycle", [(3.1 + 13, 5.37 + 3, 2313, 275), (3.1 + 10, 5.37 + 10, 4235, 275), (3.1, 5.37, 20, 4)])
def test_an_event_at_an_intervals_end_is_judged_as_in_sql(spark, epoch, period, day, cycle):
    """Half a duration is taken off first and then the bound; with both summed up before, the first case, from sf0.1, would meet its interval and the second wouldn't."""
    start, stop = day + 0.137, day + 4.637
    events = spark.createDataFrame([(1, epoch, period, 0.2, 0.003, 0.0004)], "id int, epoch double, period double, duration double, epoch_error double, period_error double")
    got = cohort.events_in_intervals(events, spark.createDataFrame([(1, start, stop)], "id int, start double, stop double"), "id").collect()
    expected = []
    for n in range(cycle - 9, cycle + 10):
        at, bound = epoch + n * period, 0.003 + abs(n) * 0.0004
        if at - 0.1 - bound <= stop and at + 0.1 + bound >= start:
            expected.append(n)
    assert [r["cycle"] for r in got] == expected[:1]
