"""Steps whose work must not outgrow their rows, and bounds that must be exact."""

import datetime as dt
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from barwright.operators import asof, book, labels, scan
from barwright.plans import market

T0 = dt.datetime(2024, 1, 1)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def times(spark, n, step="1 minute"):
    return spark.range(n).select("id", (F.lit(T0) + F.col("id") * F.expr(f"interval {step}")).alias("ts"))


@pytest.mark.parametrize("chunk", [None, "day"])
def test_forward_asof_goes_through_a_chunk_once(spark, chunk):
    rows = times(spark, 9)
    found = asof.asof_join(rows, rows.select("ts", F.col("id").alias("v")), "ts", [], "forward", allow_exact=False, chunk=chunk)
    assert "unboundedfollowing" not in plan(found)
    assert {r.id: r.v for r in found.collect()} == {i: i + 1 if i < 8 else None for i in range(9)}


def test_event_flags_go_through_a_day_once(spark):
    assert "unboundedfollowing" not in plan(asof.event_flags(times(spark, 9), times(spark, 9)))


@pytest.mark.parametrize("us", [59850, 478590, 7716810, 60_000_030])
def test_event_flags_query_rounds_halves_as_its_sql(spark, tmp_path, us):
    rows = [(1001, T0, 1, "purchase", 1.0, "{}"), (1002, T0 + dt.timedelta(microseconds=us), 1, "error", 1.0, "{}"), (1003, T0 + dt.timedelta(hours=1), 1, "purchase", 1.0, "{}")]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    with duckdb.connect() as duck:
        duck.execute(f"create view events as select * replace (cast(ts as timestamp) as ts) from '{tmp_path}/events.parquet/*.parquet'")
        want = dict(duck.execute(f"select id, minutes_to_next from ({market.ORACLES['jn7_9_event_flags']})").fetchall())
    assert {r.id: r.minutes_to_next for r in market.jn7_9_event_flags(spark, str(tmp_path)).collect()} == want


def test_running_ahead_goes_through_a_chunk_once(spark):
    rows = times(spark, 90, "1 hour").withColumn("k", F.lit("a"))
    made = scan.running(rows, {"s": ("sum", "id"), "next": ("last", F.when(F.col("id") % 7 == 0, F.col("id")))}, ["k"], ["ts"], ahead=True)
    assert "unboundedfollowing" not in plan(made)
    assert {r.id: (r.s, r.next) for r in made.collect()} == {i: (sum(range(i, 90)), -(-i // 7) * 7 if i <= 84 else None) for i in range(90)}


def test_asof_ties_compare_by_value(spark):
    left, right = spark.createDataFrame([(T0,)], "ts timestamp"), spark.createDataFrame([(T0, 9), (T0, 10)], "ts timestamp, v int")
    assert asof.asof_join(left, right, right_tie="v").first().v == 10
    assert asof.asof_join(left, right, right_tie="v", direction="forward").first().v == 9


def test_forward_asof_query_takes_the_greatest_of_equal_times(spark, tmp_path):
    rows = [(1, T0, 1, "purchase", 1.0, "{}"), *((i, T0 + dt.timedelta(hours=1), 1, "view", 1.0, "{}") for i in (9, 12, 10))]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    assert [r.view_id for r in market.jn1_asof_forward_chunked(spark, str(tmp_path)).collect()] == [12]


@pytest.mark.parametrize("n, counts", [(720, [504, 144, 72]), (10, [7, 2, 1]), (7, [4, 2, 1]), (1, [0, 0, 1])])
def test_split_bounds_are_exact(spark, n, counts):
    rows = times(spark, n).withColumn("symbol", F.lit("a"))
    got = {r.split: r["count"] for r in labels.chrono_split(rows, {"train": 0.7, "valid": 0.2, "test": 0.1}).groupBy("split").count().collect()}
    assert [got.get(s, 0) for s in ("train", "valid", "test")] == counts


def test_split_by_thirds(spark):
    rows = times(spark, 9).withColumn("symbol", F.lit("a"))
    assert sorted(r["count"] for r in labels.chrono_split(rows, {"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}).groupBy("split").count().collect()) == [3, 3, 3]


def test_book_messages_fold_before_they_meet_their_snapshot(spark):
    rows = [
        ("a", 1, 0, "delta", "bid", 1.0, 9.0), ("a", 5, 0, "snapshot", "bid", 1.0, 2.0), ("a", 5, 1, "snapshot", "bid", 2.0, 3.0), ("a", 5, 7, "delta", "bid", 2.0, 8.0),
        ("a", 6, 0, "delta", "bid", 3.0, 4.0), ("a", 7, 0, "delta", "bid", 3.0, 5.0), ("a", 3, 0, "snapshot", "ask", 4.0, 6.0), ("a", 8, 0, "delta", "bid", 1.0, 0.0),
        ("a", 9, 0, None, "ask", 5.0, 1.0), ("b", 1, 0, "delta", "bid", 1.0, 1.0), ("a", 9, 1, "delta", "ask", None, 1.0),
    ]
    made = book.book_asof(spark.createDataFrame(rows, "symbol string, u long, pos long, type string, side string, price double, qty double"))
    assert re.search(r"aggregate \[symbol#\d+, side#\d+, price", plan(made).split("join inner", 1)[1])
    assert sorted((r.symbol, r.side, r.price, r.qty) for r in book.unpack(made).collect()) == [("a", "ask", 5.0, 1.0), ("a", "bid", 2.0, 3.0), ("a", "bid", 3.0, 5.0)]
