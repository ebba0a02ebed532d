"""Readers, writers and stream helpers on small inputs."""

import datetime
import random
import json
import os

import pytest
from pyspark.sql import functions as F

from barwright.operators import indicators, scan
from barwright.sources import readers
from barwright.streaming import streams

DAY = datetime.datetime(2024, 1, 1)


def at(minutes):
    return DAY + datetime.timedelta(minutes=minutes)


def started(writer, folder):
    writer.option("checkpointLocation", str(folder)).trigger(availableNow=True).start().awaitTermination()


def streamed(spark, rows, schema, folder):
    frame = spark.createDataFrame(rows, schema)
    frame.coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(frame.schema).parquet(str(folder))


def test_bars_from_csv_and_partitions(spark, tmp_path):
    bars = spark.createDataFrame([("a", "1h", at(0), 1.0, 2.0, 0.5, 1.5, 9.0), ("b", "1h", at(60 * 24), 1.0, 2.0, 0.5, None, 9.0)], readers.BARS)
    bars.write.option("header", True).csv(str(tmp_path / "csv"))
    assert sorted(readers.read_bars(spark, str(tmp_path / "csv")).collect()) == sorted(bars.collect())
    readers.write_bars(bars, str(tmp_path / "bars"))
    assert os.path.isdir(tmp_path / "bars" / "symbol=a" / "date=2024-01-01")
    readers.write_ticks(bars.select("ts", "close"), str(tmp_path / "ticks"))
    readers.write_ticks(bars.select("ts", "close"), str(tmp_path / "ticks"))
    assert spark.read.parquet(str(tmp_path / "ticks")).where("hour = 0").count() == 4


def test_l2_csv(spark, tmp_path):
    names = ["timestamp", *(f"{s}_{k}_{i}" for i in range(2) for s in ("bid", "ask") for k in ("p", "v"))]
    spark.createDataFrame([tuple(["2024-01-01 00:00:00", *map(str, (10, 1, 11, 2, 9, 3, 12, 4))])], names).write.option("header", True).csv(str(tmp_path / "l2"))
    (row,) = readers.read_l2_csv(spark, str(tmp_path / "l2"), depth=2).collect()
    assert [tuple(x) for x in row.bids] == [(10.0, 1.0), (9.0, 3.0)] and [tuple(x) for x in row.asks] == [(11.0, 2.0), (12.0, 4.0)]
    with pytest.raises(ValueError):
        readers.read_l2_csv(spark, str(tmp_path / "l2"), depth=3)


def test_registry_and_log(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "metadata.json").write_text(json.dumps({"model_id": "x", "asset_symbol": "a", "blueprint": {"architecture": "net"}, "validation_metrics": {"sharpe_ratio": "1.5"}}, indent=1))
    (row,) = readers.read_registry(spark, str(tmp_path / "m")).collect()
    assert (row.model_id, row.status, row.model_type, row.features, row.sharpe) == ("x", "unknown", "net", [], 1.5)
    readers.append_trade_log(spark.createDataFrame([(at(0), "m1", "5"), (at(1), "m2", "bad")], "timestamp timestamp, model_id string, net_pnl string"), str(tmp_path / "log"))
    assert [r.model_id for r in readers.read_trade_log(spark, str(tmp_path / "log"), last=1).collect()] == ["m2"]


def test_incremental_and_stale(spark):
    old = spark.createDataFrame([(1, at(0)), (2, at(5))], "id long, ts timestamp")
    new = spark.createDataFrame([(2, at(5)), (3, at(6)), (3, at(6)), (4, None)], "id long, ts timestamp")
    assert [r.id for r in readers.incremental(old, new, "ts", ["id"]).collect()] == [3]
    assert sorted(r.id for r in readers.incremental(old.limit(0), new, "ts", ["id"]).collect()) == [2, 3]
    got = {r.id: r.stale for r in readers.stale_keys(new, ["id"], "ts", 1, F.lit(str(at(65))).cast("timestamp")).collect()}
    assert got == {2: False, 3: False, 4: True}


def test_upsert_keeps_the_latest_and_raises_on_other_trouble(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = lambda *rows: spark.createDataFrame([*rows], "k long, v long, n long")
    readers.upsert_latest(frame((1, 10, 1), (2, 20, 1), (2, 21, 2)), path, ["k"], "n")
    readers.upsert_latest(frame((2, 22, 3), (3, 30, 1), (1, 9, 0)), path, ["k"], "n")
    assert {r.k: r.v for r in spark.read.parquet(path).collect()} == {1: 10, 2: 22, 3: 30}
    assert os.listdir(tmp_path) == ["t"]
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception, match="(?i)parquet|schema|footer"):
        readers.upsert_latest(frame((1, 1, 1)), str(tmp_path / "broken"), ["k"], "n")


def test_stream_asof_and_each_batch(spark, tmp_path):
    stream = streamed(spark, [("a", at(1)), ("a", at(10)), ("b", at(3))], "symbol string, ts timestamp", tmp_path / "in")
    right = spark.createDataFrame([("a", at(0), 1), ("a", at(5), 2), ("b", at(4), 3)], "symbol string, ts timestamp, v int")
    got = []
    started(streams.asof_stream(stream, lambda: right, lambda rows, _: got.extend(rows.collect()), by=["symbol"]), tmp_path / "c")
    assert sorted((r.symbol, r.ts, r.v) for r in got) == [("a", at(1), 1), ("a", at(10), 2), ("b", at(3), None)]
    history = lambda: spark.createDataFrame([("a", at(0))], "symbol string, ts timestamp")
    counted = []
    step = lambda rows: rows.withColumn("n", F.expr("count(*) over (partition by symbol)"))
    started(streams.each_batch(stream, step, lambda rows, _: counted.extend(rows.collect()), history), tmp_path / "c2")
    assert sorted((r.symbol, r.n) for r in counted) == [("a", 3), ("a", 3), ("b", 1)]


def test_upsert_stream(spark, tmp_path):
    stream = streamed(spark, [(1, 1, 1), (1, 2, 2), (2, 5, 1)], "k long, v long, n long", tmp_path / "in")
    started(streams.upsert_stream(stream, str(tmp_path / "t"), ["k"], "n"), tmp_path / "c")
    assert {r.k: r.v for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {1: 2, 2: 5}


def test_sampled_books_and_complete_windows(spark, tmp_path):
    level = "array<struct<price:double,qty:double>>"
    rows = [("a", DAY + datetime.timedelta(seconds=s), [(float(s), 1.0)], []) for s in (1, 4, 12, 300)]
    stream = streamed(spark, rows, f"symbol string, ts timestamp, bids {level}, asks {level}", tmp_path / "in")
    out = []
    started(streams.sampled_books(stream).writeStream.outputMode("complete").foreachBatch(lambda d, _: out.extend(d.collect())), tmp_path / "c")
    last = {r.bucket: r.bids[0].price for r in out}
    assert last == {DAY: 4.0, DAY + datetime.timedelta(seconds=10): 12.0, DAY + datetime.timedelta(seconds=300): 300.0}
    both = spark.createDataFrame([("a", at(0)), ("b", at(0)), ("a", at(1))], "symbol string, ts timestamp")
    assert [r.bucket for r in streams.complete_windows(both, 2).collect()] == [DAY]


def exchanges(df):
    """Exchanges and scans of a plan before anything is reused."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan.count("Scan ExistingRDD")


def test_recurrences_deal_rows_once_a_level(spark):
    bars = spark.createDataFrame([("a", at(i), 10.0 + i % 7, 11.0 + i % 5, 9.0, 10.0 + (i * i) % 11, 1.0) for i in range(60)], "symbol string, ts timestamp, open double, high double, low double, close double, volume double")
    assert exchanges(indicators.rsi(bars)) <= (4, 2) and exchanges(indicators.atr(bars)) <= (4, 2)
    assert exchanges(indicators.adx(bars)) <= (10, 4)


def brute_ewm(values, alpha):
    out, y = [], None
    for x in values:
        if x is not None:
            y = x if y is None else alpha * x + (1 - alpha) * y
        out.append(y)
    return out


@pytest.mark.parametrize("run", [None, 1, 7])
def test_ewm_over_many_units_and_gaps(spark, run):
    values = [None if i < 40 or i % 3 == 0 or 300 < i < 700 else float((i * 37) % 101) for i in range(900)]
    rows = spark.createDataFrame([("a", at(i * 17), v) for i, v in enumerate(values)] + [(None, at(5), 1.0), (None, at(9000), 2.0)], "symbol string, ts timestamp, x double")
    got = scan.ewm(rows, {"slow": ("x", 0.001), "mid": ("x", 0.3), "fast": ("x", 0.9999), "last": ("x", 1.0)}, ["symbol"], ["ts"], run=run).orderBy("ts").collect()
    for name, alpha in (("slow", 0.001), ("mid", 0.3), ("fast", 0.9999), ("last", 1.0)):
        assert [r[name] for r in got if r.symbol] == [None if w is None else pytest.approx(w, rel=1e-12) for w in brute_ewm(values, alpha)]
    assert [r.mid for r in got if r.symbol is None] == [1.0, pytest.approx(1.3)]


def test_ewm_across_a_gap_that_forgets_and_no_overflow(spark):
    values = [float(i % 13) for i in range(3000)] + [None] * 4000 + [float(i % 7) for i in range(3000)]
    rows = spark.createDataFrame([("a", at(i / 10), v) for i, v in enumerate(values)], "symbol string, ts timestamp, x double")
    got = scan.ewm(rows, {"y": ("x", 2 / 15), "z": ("x", 0.99)}, ["symbol"], ["ts"]).orderBy("ts").collect()
    for name, alpha in (("y", 2 / 15), ("z", 0.99)):
        assert [r[name] for r in got] == [pytest.approx(w, rel=1e-12, abs=1e-200) for w in brute_ewm(values, alpha)]


def test_ewm_seeded_by_a_mean_of_values(spark):
    values = [None if i % 4 == 1 else float((i * 29) % 23) for i in range(80)]
    rows = spark.createDataFrame([("a", at(i * 90), v) for i, v in enumerate(values)], "symbol string, ts timestamp, x double")
    got = [r.y for r in scan.ewm(rows, {"y": ("x", 0.2)}, ["symbol"], ["ts"], "sma", 10).orderBy("ts").collect()]
    seen, want, y = [], [], None
    for v in values:
        if v is not None:
            seen.append(v)
            y = sum(seen) / 10 if len(seen) == 10 else 0.2 * v + 0.8 * y if len(seen) > 10 else None
        want.append(y)
    assert got == [None if w is None else pytest.approx(w, rel=1e-12) for w in want]


def test_means_of_changes_match_a_loop_over_days_and_gaps(spark):
    rng = random.Random(8)
    bars = [(f"{'ab'[i % 2]}", at(i * 13), *(None if rng.random() < 0.1 else 50 + rng.random() * 9 for _ in range(3))) for i in range(700)]
    df = spark.createDataFrame(bars, "symbol string, ts timestamp, high double, low double, close double")
    got = {(r.symbol, r.ts): r for r in indicators.atr(indicators.rsi(df, n=9), n=5).collect()}
    for symbol in "ab":
        was, g, lo, tr = None, None, None, None
        for s, ts, high, low, close in bars:
            if s != symbol:
                continue
            if was is not None and was[2] is not None and close is not None:
                d = close - was[2]
                g = max(d, 0.0) if g is None else g + (max(d, 0.0) - g) / 9
                lo = max(-d, 0.0) if lo is None else lo + (max(-d, 0.0) - lo) / 9
            wide = [x - y if y is low else abs(x - y) for x, y in ((high, low), (high, was and was[2]), (low, was and was[2])) if x is not None and y is not None]
            if wide:
                tr = max(wide) if tr is None else tr + (max(wide) - tr) / 5
            r = got[symbol, ts]
            want = 100 * g / (g + lo) if g is not None and g + lo > 0 else None
            assert r.rsi_9 == (None if want is None else pytest.approx(want, rel=1e-10)) and r.atr_5 == (None if tr is None else pytest.approx(tr, rel=1e-10))
            was = (high, low, close)


@pytest.mark.parametrize("ahead", [False, True])
def test_running_over_chunks(spark, ahead):
    values = [None if i % 4 else float((i * 29) % 17) for i in range(60)]
    rows = spark.createDataFrame([("a", at(i * 120), v) for i, v in enumerate(values)], "symbol string, ts timestamp, x double")
    got = scan.running(rows, {k: (k, "x") for k in scan.RUNNING}, ["symbol"], ["ts"], ahead=ahead).orderBy("ts").collect()
    for i, r in enumerate(got):
        seen = [v for v in (values[i:] if ahead else values[: i + 1]) if v is not None]
        want = {"last": (seen[0] if ahead else seen[-1]) if seen else None, "max": max(seen, default=None), "min": min(seen, default=None), "sum": sum(seen) if seen else None, "count": len(seen)}
        assert {k: r[k] for k in want} == want
