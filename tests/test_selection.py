"""Exact selection against numpy, with ties, nulls, few rows and coarse sketches."""

import random

import numpy as np
import pytest

from barwright.operators import perf, selection

QS = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q90": 0.9, "q100": 1.0}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    out = [("many", rng.gauss(0, 1)) for _ in range(4000)] + [("ties", float(rng.choice([1, 1, 1, 2, 3]))) for _ in range(900)] + [("one", 7.0), ("two", 1.0), ("two", 2.0), (None, 5.0), (None, 6.0), ("none", None)]
    return out + [("skewed", 10.0 ** rng.randint(-8, 8)) for _ in range(3000)] + [("same", 3.0)] * 2500


@pytest.mark.parametrize(("grid", "passes"), [(256, 2), (4, 3), (4, 1)])
def test_quantiles_match_numpy(spark, rows, monkeypatch, grid, passes):
    monkeypatch.setattr(selection, "GRID", grid)
    monkeypatch.setattr(selection, "ACCURACY", grid * 8)
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    got = {r.k: r for r in selection.quantiles(df, {n: ("v", q) for n, q in QS.items()}, ["k"], passes).collect()}
    assert set(got) == {k for k, _ in rows}
    for k, r in got.items():
        own = [v for key, v in rows if key == k and v is not None]
        for n, q in QS.items():
            assert r[n] == (pytest.approx(np.quantile(own, q), rel=1e-12, abs=1e-15) if own else None)


def test_quantiles_of_all_rows_and_of_none(spark, rows):
    df = spark.createDataFrame(rows, "k string, v double")
    got = selection.quantiles(df, {"m": ("v", 0.5)}, []).collect()
    assert [r.m for r in got] == [pytest.approx(np.median([v for _, v in rows if v is not None]))]
    assert selection.quantiles(df.where("false"), {"m": ("v", 0.5)}, ["k"]).count() == 0


def test_top_fraction_of_all_rows(spark):
    rng = random.Random(7)
    rows = [(i, None if i % 50 == 0 else float(rng.choice([1, 2, 2, 3, 9])) + (i % 7 == 0) * rng.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, s double").repartition(3)
    want = sorted(rows, key=lambda r: (-(r[1] if r[1] is not None else -1e9), r[0]))
    for frac, floor in ((0.02, 10), (0.5, 10), (0.0, 3), (1.0, 1)):
        got = sorted(r.id for r in perf.top_fraction(df, "s", "id", frac, floor).collect())
        assert got == sorted(i for i, _ in want[: max(floor, int(3000 * frac))])
