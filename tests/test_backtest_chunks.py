"""Backtests against a bar-by-bar walk, on any size of chunks."""

import datetime
import random

import pytest

from barwright.operators import backtest

START = datetime.datetime(2024, 1, 1, 0, 30)
CHUNKS = ["hour", "day", "year"]


@pytest.fixture(scope="module")
def bars():
    rng = random.Random(11)
    out, price = [], {"a": 100.0, "b": 50.0, "c": 10.0, "d": 5.0}
    for i in range(160):
        for symbol in price:
            if symbol == "d" and i > 3:
                continue
            price[symbol] *= 1 + rng.uniform(-0.03, 0.032)
            signal = rng.choices([0, 1, 2], [0.7, 0.15, 0.15])[0] if symbol != "c" else int(i == 0) or 2 * int(i == 9)
            close = price[symbol] * (1 + rng.uniform(-0.01, 0.01))
            out.append((symbol, START + datetime.timedelta(minutes=23 * i), price[symbol], close, float(rng.randint(1, 50)), signal))
    return out


def frame(spark, bars):
    return spark.createDataFrame(bars, "symbol string, ts timestamp, open double, close double, volume double, signal int").repartition(3)


def walked(bars, symbol):
    return [b for b in bars if b[0] == symbol]


def edges(signals):
    """(entry, exit or None) of bars whose signals count from the second on."""
    out, on = [], None
    for i, s in enumerate(signals):
        if i and s == 1 and on is None:
            on = i
        elif i and s == 2 and on is not None:
            out.append((on, i))
            on = None
    return out + ([(on, None)] if on is not None else [])


@pytest.mark.parametrize("chunk", CHUNKS)
def test_trades(spark, bars, chunk):
    got = sorted((r.symbol, r.trade, r.entry_bar, r.exit_bar, r.entry_ts, r.exit_ts) for r in backtest.extract_trades(frame(spark, bars), chunk=chunk).collect() if r.exit_bar is not None)
    want = []
    for symbol in "abcd":
        own = walked(bars, symbol)
        want += [(symbol, n + 1, a, b, own[a][1], own[b][1]) for n, (a, b) in enumerate(edges([x[5] for x in own])) if b is not None]
    assert got == sorted(want)


def walk_same_open(own, capital, target, costs):
    cross, cash, peak, worst, trades, entry, cap = costs.spread + costs.slippage, capital, capital, 0.0, 0, None, capital
    for i, (_, _, opened, close, _, signal) in enumerate(own):
        if i == 0:
            cap, held = capital, False
        else:
            held = entry is not None
            cap = cash * (1 + (1 - costs.fee) / (entry[0] * (1 + cross)) * (close - entry[1])) if held else cash
        peak = max(peak, cap)
        worst = max(worst, (peak - cap) / peak)
        if i and cap >= capital * (1 + target):
            return cap, trades, worst, i, len(own)
        if i and signal == 1 and entry is None:
            entry, trades = (opened, close), trades + 1
        elif i and signal == 2 and entry is not None:
            cash *= (1 - costs.fee) ** 2 * opened * (1 - cross) / (entry[0] * (1 + cross))
            entry, cap = None, cash
    return cap, trades, worst, len(own), len(own)


@pytest.mark.parametrize("chunk", CHUNKS)
@pytest.mark.parametrize("target", [0.02, 0.2, 9.0])
def test_same_open(spark, bars, chunk, target):
    costs = backtest.Costs()
    got = {r.symbol: r for r in backtest.same_open(frame(spark, bars), target=target, costs=costs, chunk=chunk).collect()}
    assert set(got) == set("abcd")
    for symbol, r in got.items():
        cap, trades, worst, ttt, n = walk_same_open(walked(bars, symbol), 10_000.0, target, costs)
        assert (r.trades, r.time_to_target, r.bars) == (trades, ttt, n)
        assert r.final_capital == pytest.approx(cap, rel=1e-9) and r.max_drawdown == pytest.approx(worst, abs=1e-9)


@pytest.mark.parametrize("chunk", CHUNKS)
def test_next_open_trades(spark, bars, chunk):
    costs = backtest.Costs(atr_slip=0.5)
    df = frame(spark, bars).selectExpr("*", "volume / 100 AS atr")
    got = {(r.symbol, r.trade): r for r in backtest.next_open_trades(df, costs=costs, atr="atr", chunk=chunk).collect()}
    cross, count = costs.spread + costs.slippage, 0
    for symbol in "abcd":
        own = walked(bars, symbol)
        slip = [0.5 * b[4] / 100 for b in own]
        for n, (a, b) in enumerate(edges([0, *(x[5] for x in own[:-1])])):
            r, count = got[symbol, n + 1], count + 1
            assert (r.entry_bar, r.exit_bar, r.forced) == (a, len(own) - 1 if b is None else b, b is None)
            assert r.entry_price == pytest.approx(own[a][2] * (1 + cross) + slip[a - 1]) and r.liquidity == pytest.approx(own[a][2] * own[a][4])
            assert r.exit_price == pytest.approx(own[-1][3] * (1 - cross) - slip[-1] if b is None else own[b][2] * (1 - cross) - slip[b - 1])
    assert count == len(got)
    whole = backtest.next_open(backtest.next_open_trades(df, chunk=chunk))
    small = backtest.next_open(backtest.next_open_trades(df, chunk=chunk), chunk=2)
    assert [r.equity for r in whole.orderBy("symbol", "trade").collect()] == [pytest.approx(r.equity) for r in small.orderBy("symbol", "trade").collect()]


@pytest.mark.parametrize("run", [1, 7, 128])
def test_capped_positions_match_the_walk(spark, run):
    rng = random.Random(3)
    rows = []
    for symbol, scale in (("deep", 1e6), ("thin", 2e3), ("mixed", 1e5), (None, 5e4)):
        for n in range(1, 61):
            entry = rng.uniform(1, 100)
            rows.append((symbol, n, entry, entry * rng.uniform(0.6, 1.6), None if rng.random() < 0.1 else scale * rng.random()))
    df = spark.createDataFrame(rows, "symbol string, trade long, entry_price double, exit_price double, liquidity double").repartition(3)
    got = {(r.symbol, r.trade): r for r in backtest.next_open_capped(df, run=run).collect()}
    cash = {}
    for symbol, n, entry, leave, liquid in rows:
        now, ret = cash.get(symbol, 10_000.0), leave / entry * 0.999 - 1.001
        value = min(now * 0.95, liquid * 0.1) if liquid is not None else now * 0.95
        cash[symbol] = now + value * ret
        r = got.pop((symbol, n))
        assert (r.ret, r.equity, r.pnl, r.liquidity) == (pytest.approx(ret), pytest.approx(cash[symbol], rel=1e-9), pytest.approx(value * ret, rel=1e-9, abs=1e-9), liquid)
    assert not got
    with pytest.raises(ValueError, match="share"):
        backtest.next_open_capped(df, share=1.0)
