"""Resampling tests and the gauntlet report. Randomness is seeded hashes of keys and rows, so results do not depend on partitioning."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.operators.scan import carried, chunked, earlier

#: Rounds of the keyed permutation; pairs of places are as good as random after some twice the logarithm of their number.
ROUNDS = 24
#: Trades of a chunk that draws for itself, on average; replicates that travel together.
CHUNK_TRADES, REP_BLOCK = 4096, 100


def numbered(df: DataFrame, by: list[str], order: list[str], chunk: str = "day") -> DataFrame:
    """Adds row number ``_i`` from 0 and count ``_n`` per key, by chunks of time and a prefix over their counts."""
    rows = chunked(df, by, order, chunk).withColumn("_r", F.row_number().over(Window.partitionBy("_ck").orderBy(*order)))
    sides = {"_i": lambda w: F.coalesce(F.sum("_c").over(earlier(w)), F.lit(0)), "_n": lambda w: F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))}
    met = carried(rows, [F.count(F.lit(1)).alias("_c")], [sides], [*by]).withColumn("_i", F.col("_i") + F.col("_r") - 1)
    return met.drop("_r", *([] if "_ck" in df.columns else ["_ck"]))


def shuffled_place(i: Column, n: Column, *key: Column, rounds: int = ROUNDS) -> Column:
    """A permutation of ``0 .. n - 1`` named by ``key``, at ``i``, as an expression.

    Each round pairs every place with its mirror about a keyed centre, and a keyed coin of the higher
    one swaps the two or leaves them (swap-or-not); so it is a bijection for any ``n``, without sorting.
    """
    def once(x: Column, turn: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(*key, turn), n) - x, n)
        return F.when(F.xxhash64(*key, turn, F.greatest(x, mirror)).bitwiseAND(F.lit(1 << 20)) == 0, x).otherwise(mirror)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), i.cast("bigint"), once)


def bootstrap_counts(sizes: DataFrame, reps: int, seed: int) -> DataFrame:
    """``_k, chunk, block, counts``: how many of a replicate's draws fall to each chunk, for blocks of replicates.

    ``sizes`` has a key ``_k`` and its ``chunks`` (``chunk, m``). The counts of a replicate are one
    multinomial draw, a chain of binomial splits over the chunks, so they sum to the key's rows.
    """
    blocks = -(-reps // REP_BLOCK)

    def split(chunks: pa.Array, block: pa.Array, mark: pa.Array) -> pa.Array:
        out = []
        for own, b, key in zip(chunks.to_pylist(), block.to_pylist(), mark.to_pylist(), strict=True):
            m = np.array([c["m"] for c in own], dtype=np.int64)
            rng = np.random.Generator(np.random.Philox(key=key & (2**64 - 1)))
            counts = rng.multinomial(m.sum(), m / m.sum(), size=min(REP_BLOCK, reps - b * REP_BLOCK))
            out.append([{"chunk": c["chunk"], "counts": counts[:, i].tolist()} for i, c in enumerate(own)])
        return pa.array(out, pa.list_(pa.struct([("chunk", pa.int64()), ("counts", pa.list_(pa.int64()))])))

    split.__annotations__ = {"chunks": pa.Array, "block": pa.Array, "mark": pa.Array, "return": pa.Array}
    rows = sizes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = F.arrow_udf(split, "array<struct<chunk:bigint,counts:array<bigint>>>")("chunks", "block", F.xxhash64(F.lit(seed), "_k", "block"))
    return rows.select("_k", "block", F.explode(dealt).alias("d")).select("_k", "d.chunk", "block", "d.counts")


def _drawn(values: Column, counts: Column, mark: Column) -> Column:
    """Sums of so many draws with replacement from ``values`` as ``counts`` says, one for each."""

    def draw(values: pa.Array, counts: pa.Array, mark: pa.Array) -> pa.Array:
        out = []
        for v, c, key in zip(values, counts, mark.to_pylist(), strict=True):
            v, c = v.values.to_numpy(zero_copy_only=False), c.values.to_numpy(zero_copy_only=False)
            rng = np.random.Generator(np.random.Philox(key=key & (2**64 - 1)))
            picked = v[rng.integers(0, len(v), int(c.sum()))]
            out.append(np.bincount(np.repeat(np.arange(len(c)), c), weights=picked, minlength=len(c)).tolist())
        return pa.array(out, pa.list_(pa.float64()))

    draw.__annotations__ = {"values": pa.Array, "counts": pa.Array, "mark": pa.Array, "return": pa.Array}
    return F.arrow_udf(draw, "array<double>")(values, counts, mark)


def bootstrap_ci(trades: DataFrame, ret: str, by: list[str], order: list[str], reps: int = 1000, seed: int = 42, least: int = 10, chunk_trades: int = CHUNK_TRADES) -> DataFrame:
    """``n, mean, ci_low, ci_high, win_rate, passed`` per key from ``reps`` resamples of the mean with replacement.

    A key's trades fall into chunks of about ``chunk_trades`` by a hash of ``order``; each replicate's draws are split over
    them (``bootstrap_counts``), and chunks draw for themselves. Generators are seeded by hashes.
    Passed: the lower bound is above 0, the mean above 0.01 and the win rate above 40; keys under ``least`` trades have no row.
    """
    known = trades.where(F.col(ret).isNotNull()).withColumn("_k", F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(by))))
    facts = known.groupBy("_k").agg(F.count(F.lit(1)).alias("n"), F.avg(ret).alias("mean"), (100 * F.avg((F.col(ret) > 0).cast("double"))).alias("win_rate")).where(F.col("n") >= least)
    sized = known.join(facts.select(F.col("_k").alias("_kf"), "n"), F.col("_k") == F.col("_kf"))
    place = F.pmod(F.xxhash64(F.lit(seed), *order), F.ceil(F.col("n") / chunk_trades)).alias("chunk")
    chunks = sized.groupBy("_k", place).agg(F.array_sort(F.collect_list(F.col(ret).cast("double"))).alias("values"))
    sizes = chunks.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("chunk", F.size("values").alias("m")))).alias("chunks"))
    counts = bootstrap_counts(sizes, reps, seed).select(F.col("_k").alias("_kc"), F.col("chunk").alias("_cc"), "block", "counts")
    met = chunks.join(counts, (F.col("_k") == F.col("_kc")) & (F.col("chunk") == F.col("_cc")))
    sums = met.select("_k", "block", F.posexplode(_drawn(F.col("values"), F.col("counts"), F.xxhash64(F.lit(seed + 1), "_k", "chunk", "block"))).alias("at", "total"))
    totals = sums.groupBy("_k", "block", "at").agg(F.sum("total").alias("total")).join(facts.select(F.col("_k").alias("_kf"), "n"), F.col("_k") == F.col("_kf"))
    means = totals.select("_k", (F.col("total") / F.col("n")).alias("_m"))
    ci = means.groupBy(F.col("_k").alias("_kc")).agg(F.percentile("_m", 0.025).alias("ci_low"), F.percentile("_m", 0.975).alias("ci_high"))
    passed = (F.col("ci_low") > 0) & (F.col("mean") > 0.01) & (F.col("win_rate") > 40)
    names = [F.col(f"_k.k{i}").alias(c) for i, c in enumerate(by)]
    return facts.join(ci, F.col("_k") == F.col("_kc")).select(*names, "n", "mean", "ci_low", "ci_high", "win_rate", passed.alias("passed"))


def permuted(df: DataFrame, column: str, by: list[str], order: list[str], seed: int = 42) -> DataFrame:
    """``df`` with one column's values dealt anew among a key's rows: the row at place ``i`` gets the value at ``shuffled_place(i)``."""
    placed = numbered(df, by, order).withColumn("_k", F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(by))))
    given = placed.select(F.col("_k").alias("_kg"), F.col("_i").alias("_j"), F.col(column).alias("_v"))
    there = shuffled_place(F.col("_i"), F.col("_n"), F.lit(seed), F.col("_k"))
    return placed.join(given, (F.col("_k") == F.col("_kg")) & (there == F.col("_j"))).withColumn(column, F.col("_v")).select(*df.columns)


def permutation_importance(df: DataFrame, features: list[str], score: Callable[[DataFrame], DataFrame], by: list[str], order: list[str], seed: int = 42) -> DataFrame:
    """``by, feature, importance``: relative drop of ``score(df)`` (columns ``by, score``) when a feature is permuted."""
    base = score(df).select(*by, F.col("score").alias("_base"))
    out = None
    for i, f in enumerate(features):
        one = score(permuted(df, f, by, order, seed + i)).join(base, by)
        one = one.select(*by, F.lit(f).alias("feature"), F.coalesce(F.try_divide(F.col("_base") - F.col("score"), F.abs("_base")), F.lit(0.0)).alias("importance"))
        out = one if out is None else out.unionByName(one)
    return out


def add_noise(df: DataFrame, cols: list[str], frac: float = 0.01, seed: int = 42, by: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Gaussian noise of ``frac`` of each column's deviation; the deviations are one row per key, met by a join.

    A draw is made of two hashes of (seed, column, key, order), so results do not depend on partitioning.
    """
    spread = df.groupBy(*by).agg(*(F.stddev_samp(c).alias(f"_s_{c}") for c in cols))
    met = df.join(spread, [*by])

    def chance(i: int, part: int) -> Column:
        return (F.pmod(F.xxhash64(F.lit(seed), F.lit(i), F.lit(part), *by, *order), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))

    normal = lambda i: F.sqrt(-2 * F.ln(chance(i, 0))) * F.cos(2 * math.pi * chance(i, 1))
    return met.withColumns({c: F.col(c) + normal(i) * F.coalesce(f"_s_{c}", F.lit(0.0)) * frac for i, c in enumerate(cols)}).drop(*(f"_s_{c}" for c in cols))


def in_sample_gate(result: DataFrame, min_sharpe: float = 0.5, min_pnl: float = 0.0) -> Column:
    return (F.col("sharpe") >= min_sharpe) & (F.col("pnl_pct") > min_pnl)


def walk_forward_gate(folds: DataFrame, by: list[str], score: str = "sharpe", least: float = 1.0) -> DataFrame:
    """``avg, worst, passed``: the folds' mean is at least ``least`` and none is negative."""
    made = folds.groupBy(*by).agg(F.avg(score).alias("avg"), F.min(score).alias("worst"))
    return made.withColumn("passed", (F.col("avg") >= least) & (F.col("worst") >= 0))


def gauntlet_report(checks: DataFrame, by: list[str], order: str = "step") -> DataFrame:
    """Rows of ``by, step, check, passed`` up to the first failure of each run, with ``verdict`` for the whole run."""
    w = Window.partitionBy(*by)
    failed = F.min(F.when(~F.col("passed"), F.col(order))).over(w)
    rows = checks.withColumn("_f", failed)
    return rows.where(F.col("_f").isNull() | (F.col(order) <= F.col("_f"))).withColumn("verdict", F.when(F.col("_f").isNull(), "passed").otherwise("failed")).drop("_f")
