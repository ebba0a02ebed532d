"""Measures folded over chunks against loops."""

import datetime
import math
import random

import pytest

from barwright.operators import book, indicators, perf

START = datetime.datetime(2024, 1, 1, 0, 30)


def at(i, minutes=97):
    return START + datetime.timedelta(minutes=minutes * i)


@pytest.mark.parametrize("chunk", ["hour", "day", "year"])
def test_performance(spark, chunk):
    rng = random.Random(1)
    rows = [(k, at(i), None if rng.random() < 0.05 else rng.gauss(0.001, 0.05)) for k in ("a", None, "c") for i in range(120)] + [("up", at(i), 0.01) for i in range(9)]
    got = {r.k: r for r in perf.performance(spark.createDataFrame(rows, "k string, ts timestamp, r double").repartition(3), "r", ["k"], ["ts"], chunk=chunk).collect()}
    assert set(got) == {"a", None, "c", "up"}
    for k, r in got.items():
        own, equity, peak, worst = [x for key, _, x in rows if key == k and x is not None], 1.0, 1.0, 0.0
        for x in own:
            equity *= 1 + x
            peak = max(peak, equity)
            worst = max(worst, (peak - equity) / peak)
        assert r.n == len(own) and r.total == pytest.approx(equity - 1, abs=1e-12) and r.max_drawdown == pytest.approx(worst, abs=1e-12)
        mean = sum(own) / len(own)
        spread = math.sqrt(sum((x - mean) ** 2 for x in own) / len(own))
        assert r.sharpe == (None if spread < 1e-9 else pytest.approx(mean / spread * math.sqrt(252)))


def test_tick_signs_carry_over_chunks(spark):
    prices = [5.0, 5.0, None, 4.0, 4.0, 4.0, 3.0, 3.0, 3.0, 3.0, 7.0, 7.0, 7.0, 1.0, 1.0]
    df = spark.createDataFrame([(k, at(i, 700), p) for k in ("a", None) for i, p in enumerate(prices)], "symbol string, ts timestamp, price double")
    sign, want, was = None, [], None
    for p in prices:
        sign = 1.0 if p is None or was is None or p > was else -1.0 if p < was else sign
        want.append(sign)
        was = p
    for symbol in ("a", None):
        assert [r.tick_sign for r in sorted(book.tick_signs(df).collect(), key=lambda r: r.ts) if r.symbol == symbol] == want


def test_spreads_against_earlier_ones_far_from_zero(spark):
    rng = random.Random(2)
    values = [1e6 + rng.gauss(0, 1 + (i // 60) % 3) for i in range(400)]
    df = spark.createDataFrame([("s", at(i), v) for i, v in enumerate(values)], "symbol string, ts timestamp, x double")
    got = indicators.takens_spread(df, "x", window=20, stride=5, history=6).orderBy("ts").collect()
    seen = []
    for r in got:
        if len(seen) > 6:
            mean = sum(seen) / len(seen)
            sd = math.sqrt(sum((x - mean) ** 2 for x in seen) / len(seen))
            assert r.spread_z == pytest.approx((r.spread - mean) / sd, rel=1e-6) and r.unusual == (r.spread_z > 2)
        else:
            assert r.spread_z is None and not r.unusual
        seen.append(r.spread)
    assert len(seen) == 77


def test_pairs_with_calendars_of_their_own(spark):
    import numpy as np

    from barwright.operators import cross

    rng = random.Random(3)
    rows = [(f"s{k}", at(i, 60), 100 + rng.gauss(0, 1)) for i in range(160) for k in range(9) if rng.random() < 0.3 + 0.07 * k]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, close double").repartition(3)
    moves = {}
    for k in range(9):
        own = sorted((t, c) for s, t, c in rows if s == f"s{k}")
        moves[f"s{k}"] = {t: c / p - 1 for (_, p), (t, c) in zip(own, own[1:], strict=False)}
    covs = {(r.src, r.dst): r for r in cross.covariance(df, chunk="day").collect()}
    edges = {(r.src, r.dst): r.weight for r in cross.corr_edges(df, 20, 0.05).collect()}
    assert len(covs) == 9 * 8 // 2 + 9
    for a in moves:
        for b in moves:
            if a < b:
                common = sorted(moves[a].keys() & moves[b].keys())
                x, y = np.array([moves[a][t] for t in common]), np.array([moves[b][t] for t in common])
                assert covs[a, b].n == len(common) and covs[a, b].cov == pytest.approx(np.cov(x, y)[0, 1], rel=1e-9)
                w = np.corrcoef(x[-20:], y[-20:])[0, 1] if len(common) >= 20 else None
                assert edges.get((a, b)) == edges.get((b, a)) == (pytest.approx(w, rel=1e-9) if w is not None and abs(w) > 0.05 else None)
