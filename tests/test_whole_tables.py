"""Queries read whole tables."""

import random

import pytest
from pyspark.sql import functions as F

from barwright.operators import ml
from barwright.plans.registry import QUERIES

DATA = "/root/testdata/sf0.001"


def test_niche_share_matches_brute_force(spark):
    rnd = random.Random(4)
    sets = [sorted(rnd.sample(range(12), rnd.randint(1, 7))) for _ in range(300)] + [[], list(range(10)), list(range(7))]
    rows = spark.createDataFrame([(i, s, 6.0) for i, s in enumerate(sets)], "k long, s array<long>, f double")
    got = {r.k: (r.niche, round(r.shared_fitness, 9)) for r in ml.niche_share(rows, "k", "s", "f").collect()}
    alike = lambda a, b: 10 * len(a & b) >= 7 * len(a | b)
    want = {i: sum(alike(set(a), set(b)) for b in sets) if a else 1 for i, a in enumerate(sets)}
    assert got == {i: (n, round(6.0 / n, 9)) for i, n in want.items()}


@pytest.mark.parametrize("name", ["ml7_niche_share", "ml7_niche_share_whole"])
def test_every_order_has_a_niche(spark, name):
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet")
    assert QUERIES[name](spark, DATA).count() == lines.select("l_orderkey").distinct().count()


@pytest.mark.parametrize("name", ["set1_2_append_aligned", "set1_2_append_aligned_whole"])
def test_all_rows_are_appended(spark, name):
    assert QUERIES[name](spark, DATA).count() == sum(spark.read.parquet(f"{DATA}/{t}.parquet").count() for t in ("lineitem", "orders"))


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.8])
def test_niches_of_long_and_short_sets_match_brute_force(spark, threshold):
    rnd = random.Random(8)
    base = [rnd.sample(range(60), n) for n in (4, 9, 16, 17, 30)]
    sets = [sorted({*rnd.sample(b, len(b) - rnd.randint(0, len(b) // 3)), *rnd.sample(range(60), rnd.randint(0, 2 + len(b) // 5))}) for b in base for _ in range(40)]
    rows = spark.createDataFrame([(i, s, 6.0) for i, s in enumerate(sets)], "k long, s array<long>, f double")
    got = {r.k: r.niche for r in ml.niche_share(rows, "k", "s", "f", threshold).collect()}
    alike = lambda a, b: 10 * len(a & b) >= round(10 * threshold) * len(a | b)
    assert got == {i: sum(alike(set(a), set(b)) for b in sets) for i, a in enumerate(sets)}


def test_short_sets_of_a_frequent_item_do_not_meet_in_pairs(spark):
    """Only a set's subsets grow with the sets, no step has a row per pair."""
    rnd = random.Random(2)
    sets = sorted({tuple(sorted({0, 1, *rnd.sample(range(2, 90), 3)})) for _ in range(3000)})
    rows = spark.createDataFrame([(i, [*s], 1.0) for i, s in enumerate(sets)], "k long, s array<long>, f double")
    longest, places, _ = ml._subset_tables(ml.Fraction("0.7"))
    assert sum(n == 5 for n, _, _ in places) == 6 and longest >= 10
    folded = rows.select(F.col("s").alias("_s"), F.lit(1).alias("_w"))
    assert ml._met_in_rare(folded, ml.Fraction("0.7"), longest).count() == 0
    assert {r.niche for r in ml.niche_share(rows, "k", "s", "f").collect()} == {1}
