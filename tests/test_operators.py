"""Small hand-made inputs: edges, ties, nulls, chunk parity and streams."""

import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwright.functions import scalar
from barwright.operators import asof, backtest, book, clean, indicators, labels, ml, perf, risk, scan
from barwright.sources import readers
from barwright.streaming import streams

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_asof_edges(spark):
    left = spark.createDataFrame([(1, "a", at(5)), (2, "a", at(1)), (3, None, at(5)), (4, "b", at(9))], "id int, k string, ts timestamp")
    right = spark.createDataFrame([("a", at(5), 10), ("a", at(5), 11), ("a", at(3), 9), (None, at(1), 7)], "k string, ts timestamp, v int")
    got = {r.id: r.v for r in asof.asof_join(left, right, "ts", ["k"], right_tie="v").collect()}
    assert got == {1: 11, 2: None, 3: None, 4: None}
    strict = {r.id: r.v for r in asof.asof_join(left, right, "ts", ["k"], allow_exact=False).collect()}
    assert strict[1] == 9
    ahead = {r.id: r.v for r in asof.asof_join(left, right, "ts", ["k"], "forward", right_tie="v").collect()}
    assert ahead == {1: 10, 2: 9, 3: None, 4: None}


def test_asof_never_looks_ahead_and_chunks_agree(spark):
    rows = [(i, "a" if i % 2 else "b", at(i * 37 % 5000)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, k string, ts timestamp")
    right = df.where("id % 3 = 0").select("k", "ts", F.col("id").alias("v"))
    whole = asof.asof_join(df, right, "ts", ["k"], right_tie="v")
    assert whole.where("ts_right > ts").count() == 0
    chunked = asof.asof_join(df, right, "ts", ["k"], right_tie="v", chunk="day")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, chunked.collect()))


def test_ewm_units_match_a_loop(spark):
    values = [((i * 7919) % 101) / 10 for i in range(3000)]
    df = spark.createDataFrame([("x", at(i), v if i % 50 else None) for i, v in enumerate(values)], "symbol string, ts timestamp, v double")
    got = {r.ts: r.y for r in scan.ewm(df, {"y": ("v", 0.3)}, ["symbol"], ["ts"], run=400).collect()}
    mean = None
    for i, v in enumerate(values):
        if i % 50:
            mean = v if mean is None else 0.3 * v + 0.7 * mean
        assert got[at(i)] == (pytest.approx(mean, abs=1e-9) if mean is not None else None)


def test_rolling_is_the_same_in_blocks(spark):
    df = spark.createDataFrame([("x" if i % 3 else "y", at(i * 11), float(i * i % 97)) for i in range(600)], "symbol string, ts timestamp, close double")
    whole = indicators.rolling(df, {"m": ("close", "mean", 20)})
    small = indicators.rolling(df, {"m": ("close", "mean", 20)}, size=50)
    key = lambda d: {(r.symbol, r.ts): r.m and round(r.m, 9) for r in d.collect()}
    assert key(whole) == key(small)


def test_triple_barrier_ties(spark):
    bars = [(at(0), 10.0, 10.0, 10.0), (at(1), 13.0, 7.0, 10.0), (at(2), 10.0, 9.0, 9.5), (at(3), 10.0, 7.0, 8.0), (at(4), 8.5, 8.0, 8.0), (at(5), 8.5, 8.0, 8.0)]
    df = spark.createDataFrame([("s", t, h, lo, c, 1.0) for t, h, lo, c in bars], "symbol string, ts timestamp, high double, low double, close double, atr_14 double")
    got = [r.label for r in labels.triple_barrier(df, horizon=3).orderBy("ts").collect()]
    assert got == [1, 2, 2, None, None, None]
    far = labels.triple_barrier(df, pt=5.0, sl=5.0, horizon=3).orderBy("ts").collect()
    assert [r.label for r in far] == [0, 0, 0, None, None, None]
    assert [r.label for r in labels.triple_barrier(df, horizon=3, tail="zero").orderBy("ts").collect()][3:] == [0, 0, 0]


def test_validator_flags(spark):
    rows = [("bad", at(i), 1.0, 1.0, 0.0 if i == 3 else 1.0, 1.3 if i == 5 else 1.0) for i in range(12)] + [("flat", at(i), 1.0, 1.0, 1.0, 1.0) for i in range(12)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double")
    got = {(r.symbol, r.check): r.passed for r in clean.validate_bars(df, ["symbol"], ["ts"]).collect()}
    assert not got["bad", "non_positive"] and not got["bad", "spike"] and got["bad", "stale"]
    assert not got["flat", "stale"] and got["flat", "spike"]


def test_breaker_scenarios(spark):
    rows = [("a", at(0), 100.0), ("a", at(1), 96.0), ("a", at(2), 94.0), ("a", at(3), 100.0), ("a", at(1440), 100.0), ("a", at(1441), 69.0), ("a", at(2880), 120.0)]
    df = spark.createDataFrame(rows, "account string, ts timestamp, equity double")
    got = [r.allowed for r in risk.circuit_breaker(df, 0.05, 0.30).orderBy("ts").collect()]
    assert got == [True, True, False, False, True, False, False]


def test_signals_pair_into_trades(spark):
    signal = [1, 0, 2, 1, 1, 2, 2, 1]
    df = spark.createDataFrame([("s", at(i), float(10 + i), float(10 + i), 100.0, s) for i, s in enumerate(signal)], "symbol string, ts timestamp, open double, close double, volume double, signal int")
    got = [(r.entry_bar, r.exit_bar) for r in backtest.extract_trades(df).orderBy("trade").collect()]
    assert got == [(3, 5), (7, None)]  # the first bar's entry does not count
    fills = backtest.next_open_trades(df, costs=backtest.Costs(0, 0, 0)).orderBy("trade").collect()
    assert [(r.entry_bar, r.exit_bar, r.forced) for r in fills] == [(1, 3, False), (4, 6, False)]
    walked = backtest.next_open_capped(backtest.next_open_trades(df), participation=1e9).orderBy("trade").collect()
    free = backtest.next_open(backtest.next_open_trades(df)).orderBy("trade").collect()
    assert [r.equity for r in walked] == pytest.approx([r.equity for r in free])


def message(kind, u, bids=(), asks=()):
    return json.dumps({"topic": "orderbook.50.BTC", "type": kind, "data": {"s": "BTC", "u": u, "b": [list(map(str, x)) for x in bids], "a": [list(map(str, x)) for x in asks]}})


MESSAGES = [
    message("delta", 1, [(99, 5)]), message("snapshot", 10, [(100, 1), (99, 2)], [(101, 1)]), message("delta", 11, [(100, 3)]), message("delta", 12, [(99, 0)], [(102, 4)]),
    message("delta", 13, [(100.5, 7)]), message("delta", 12, [(50, 1)]), '{"topic": "tickers.BTC"}', "not json",
]


def test_book_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(MESSAGES[:4]))
    spark.read.text(str(tmp_path / "in"))
    batch = book.book_asof(readers.read_l2_messages(spark.createDataFrame([(m,) for m in MESSAGES if "50, 1" not in m and '"50"' not in m], "value string"))).collect()[0]
    lines = spark.readStream.text(str(tmp_path / "in"))
    run = lambda: streams.rebuild_stream(readers.read_l2_messages(lines)).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda d, n: got.extend(d.collect())).trigger(availableNow=True).start().awaitTermination()
    got = []
    run()
    (tmp_path / "in" / "b.txt").write_text("\n".join(MESSAGES[4:]))  # a restart from the checkpoint
    run()
    last = got[-1]
    assert [(x.price, x.qty) for x in last.bids] == [(x.price, x.qty) for x in batch.bids] == [(100.5, 7.0), (100.0, 3.0)]
    assert [(x.price, x.qty) for x in last.asks] == [(x.price, x.qty) for x in batch.asks] == [(101.0, 1.0), (102.0, 4.0)]


def test_stream_bars_and_breaker(spark, tmp_path):
    ticks = spark.createDataFrame([("s", at(m), i, float(p), 1.0) for i, (m, p) in enumerate([(0, 5), (1, 7), (4, 6), (5, 9), (60, 1)])], "symbol string, ts timestamp, id long, price double, qty double")
    ticks.write.parquet(str(tmp_path / "ticks"))
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "ticks"))
    streams.stream_bars(stream, "5 minutes").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c1")).option("path", str(tmp_path / "bars")).trigger(availableNow=True).start().awaitTermination()
    got = [(r.open, r.high, r.low, r.close, r.volume) for r in spark.read.parquet(str(tmp_path / "bars")).orderBy("ts").collect()]
    assert got[0] == (5.0, 7.0, 5.0, 6.0, 3.0)
    equity = spark.createDataFrame([("a", at(0), 100.0), ("a", at(1), 89.0), ("a", at(1440), 100.0)], "account string, ts timestamp, equity double")
    equity.write.parquet(str(tmp_path / "eq"))
    out = []
    streams.breaker_stream(spark.readStream.schema(equity.schema).parquet(str(tmp_path / "eq")), late="0 seconds").writeStream.option("checkpointLocation", str(tmp_path / "c2")).foreachBatch(lambda d, n: out.extend(d.collect())).trigger(availableNow=True).start().awaitTermination()
    assert [r.allowed for r in sorted(out, key=lambda r: r.ts)] == [True, False, True]


def test_readers_round_trip(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_text('{"timestamp": "2024-01-01T00:00:00", "model_id": "m", "net_pnl": 3.5, "action": "EXIT"}\nbroken {\n{"timestamp": "2024-01-02T00:00:00", "model_id": "m", "net_pnl": "N/A", "action": "EXIT"}\n')
    rows = readers.read_trade_log(spark, str(log))
    assert rows.count() == 2
    assert perf.pnl_by_model(rows).collect()[0].net_pnl == 3.5
    table = str(tmp_path / "state")
    first = spark.createDataFrame([(1, at(0), "a"), (2, at(0), "b")], "k int, ts timestamp, v string")
    readers.upsert_latest(first, table, ["k"], "ts")
    readers.upsert_latest(spark.createDataFrame([(1, at(5), "new"), (2, at(-5), "old")], first.schema), table, ["k"], "ts")
    assert {r.k: r.v for r in spark.read.parquet(table).collect()} == {1: "new", 2: "b"}
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "metadata.json").write_text(json.dumps({"model_id": "x", "asset_symbol": "BTC", "blueprint": {"model_type": "gp", "features": ["a"]}, "validation_metrics": {"sharpe_ratio": "1.5"}}))
    got = readers.read_registry(spark, str(tmp_path / "m" / "*.json")).collect()[0]
    assert (got.model_type, got.sharpe, got.status) == ("gp", 1.5, "unknown")


def test_formulas_are_checked(spark):
    df = spark.createDataFrame([("s", 2.0, 3.0), ("s", 4.0, 9.0), ("s", 5.0, 1.0)], "symbol string, close double, volume double")
    made = ml.formula_features(df, ["mul(volume, volume)", "add(close, 1)", "div(1, sub(close, close))"])
    assert "f_0" in made.columns and "f_1" not in made.columns
    with pytest.raises(ValueError):
        ml.compile_formula("__import__(close)", df.columns)


def test_scalars(spark):
    row = spark.range(1).select(scalar.clean_symbol(F.lit("BTC/USDT:USDT")).alias("s"), scalar.identifier(F.lit("add(a, b)")).alias("i"), scalar.normal_cdf(F.lit(1.96)).alias("p"), scalar.protected_div(F.lit(1.0), F.lit(0.0)).alias("d"), scalar.finite(F.lit(float("inf"))).alias("f")).first()
    assert row.s == "BTCUSDT" and row.i == "add_a_b" and row.p == pytest.approx(0.975, abs=1e-4) and row.d == 1.0 and row.f is None
    assert scalar.timeframe_seconds("15m") == 900


def test_complexity_tells_pattern_from_noise(spark):
    import random

    rnd = random.Random(1)
    rows = [("flat", at(i), 100.0 + (i % 2)) for i in range(150)] + [("wild", at(i), 100.0 + rnd.random() * 9) for i in range(150)]
    got = indicators.lz_complexity(spark.createDataFrame(rows, "symbol string, ts timestamp, close double"), "close").where(F.col("ts") >= F.lit(at(140))).toPandas()
    mean = got.groupby("symbol")["lz"].mean()
    assert mean["flat"] < mean["wild"]
    assert isinstance(got, pd.DataFrame)
