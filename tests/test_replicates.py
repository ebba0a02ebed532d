"""Resampling tests have replicates enough to decide."""

import random

import numpy as np
import pytest

from barwright.operators import ml, resample
from barwright.plans import study, trading


def test_treatment_effect_can_pass(spark):
    rnd = random.Random(2)
    rows = [(k, i, rnd.gauss(0, 1), rnd.gauss(5, 2)) for k in ("a", "b", None) for i in range(60)]
    rows = [(k, i, t, c, 0.5 * t - 0.2 * c + rnd.gauss(0, 0.3)) for k, i, t, c in rows]
    df = spark.createDataFrame(rows, "k string, i int, t double, c double, y double")
    got = ml.treatment_effect(df, "t", "y", ["c"], ["k"], ["i"]).first()
    x = np.array([[1.0, t, c] for _, _, t, c, _ in rows])
    assert got.effect == pytest.approx(np.linalg.lstsq(x, np.array([r[4] for r in rows]), rcond=None)[0][1], abs=1e-9)
    assert got.p_value == pytest.approx(0.01) and abs(got.placebo_mean) < 0.1


def test_one_placebo_is_a_fit_to_the_permuted_treatment(spark):
    rnd = random.Random(3)
    rows = [("ab"[i % 2], i, rnd.gauss(0, 1), rnd.gauss(0, 1), rnd.gauss(0, 1)) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, i int, t double, c double, y double")
    got = ml.treatment_effect(df, "t", "y", ["c"], ["k"], ["i"], placebos=1, seed=5).first()
    fake = resample.permuted(df, "t", ["k"], ["i"], 5).collect()
    x = np.array([[1.0, r.t, r.c] for r in fake])
    assert got.placebo_mean == pytest.approx(np.linalg.lstsq(x, np.array([r.y for r in fake]), rcond=None)[0][1], abs=1e-9)


def test_registered_replicates(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(ml, "treatment_effect", lambda *a, **k: seen.update(placebos=k["placebos"]))
    monkeypatch.setattr(resample, "bootstrap_ci", lambda *a, **k: seen.update(reps=k["reps"]))
    study.QUERIES["sta5_treatment_effect"](spark, "/root/testdata/sf0.001")
    trading.QUERIES["rst1_bootstrap_ci"](spark, "/root/testdata/sf0.001")
    assert seen["placebos"] >= 99 and seen["reps"] >= 1000


def test_shuffled_places_are_bijections_without_bias(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 3, 10, 257):
        got = spark.range(n).select(resample.shuffled_place(F.col("id"), F.lit(n), F.lit(n), F.lit("key")).alias("p")).collect()
        assert sorted(r.p for r in got) == list(range(n))
    # of 6,000 permutations of five places, each place takes each value about as often, and so does each pair of places
    every = spark.range(30_000).select((F.col("id") % 5).alias("i"), F.floor(F.col("id") / 5).alias("rep")).withColumn("p", resample.shuffled_place(F.col("i"), F.lit(5), F.lit(1), F.col("rep"))).toPandas()
    table = every.pivot(index="rep", columns="i", values="p")
    for i in range(5):
        assert np.abs(table[i].value_counts().to_numpy() - 1200).max() < 5 * np.sqrt(1200)
    pairs = (table[0] * 5 + table[3]).value_counts()
    assert len(pairs) == 20 and np.abs(pairs.to_numpy() - 300).max() < 5 * np.sqrt(300)


def test_permuted_keeps_each_keys_values(spark):
    rows = [(k, i * 40_000, float(i)) for k in ("a", None) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, i long, v double")
    got = resample.permuted(df, "v", ["k"], ["i"]).collect()
    for k in ("a", None):
        own = [r.v for r in sorted((r for r in got if r.k == k), key=lambda r: r.i)]
        assert sorted(own) == [float(i) for i in range(40)] and own != sorted(own)
    again = resample.permuted(df.repartition(5), "v", ["k"], ["i"]).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_bootstrap_counts_sum_and_do_not_depend_on_partitioning(spark):
    from pyspark.sql import functions as F

    sizes = spark.createDataFrame([((1,), [(0, 5), (1, 7), (2, 100)]), ((2,), [(0, 3)])], "_k struct<k0:int>, chunks array<struct<chunk:bigint,m:int>>")
    got = resample.bootstrap_counts(sizes, 250, 3)
    each = got.select("_k", "block", F.posexplode("counts").alias("at", "c")).groupBy("_k", "block", "at").agg(F.sum("c").alias("c")).groupBy("_k").agg(F.count("c").alias("reps"), F.min("c").alias("low"), F.max("c").alias("high")).collect()
    assert {(r._k.k0, r.reps, r.low, r.high) for r in each} == {(1, 250, 112, 112), (2, 250, 3, 3)}
    assert sorted(map(str, got.collect())) == sorted(map(str, resample.bootstrap_counts(sizes.repartition(4), 250, 3).collect()))


def test_bootstrap_interval_is_that_of_the_mean(spark):
    rnd = random.Random(9)
    rows = [(k, i, rnd.gauss(0.5, 2)) for k in ("a", None) for i in range(600)] + [("few", i, 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, i long, r double")
    got = {r.k: r for r in resample.bootstrap_ci(df, "r", ["k"], ["i"], reps=2000, chunk_trades=50).collect()}
    assert set(got) == {"a", None}
    for k, r in got.items():
        x = np.array([v for key, _, v in rows if key == k])
        spread = 1.96 * x.std() / np.sqrt(len(x))
        assert r.n == 600 and r.mean == pytest.approx(x.mean()) and r.ci_low == pytest.approx(x.mean() - spread, abs=0.12 * spread) and r.ci_high == pytest.approx(x.mean() + spread, abs=0.12 * spread)
