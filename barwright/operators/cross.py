"""Cross-asset relations and statistics: correlation graphs, lag screens, signatures, drift."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions.scalar import safe_ratio
from barwright.operators.asof import asof_join
from barwright.operators.indicators import atr, perm_entropy, rolling_corr, rsi, shifted
from barwright.operators.perf import sample_kurtosis, sample_skew
from barwright.operators.scan import columns_step, in_blocks, index_rows


#: Blocks that symbols fall into; each pair of blocks is one matrix product a chunk of time.
SYMBOL_BLOCKS = 8


def pair_sums(rows: DataFrame, c: str, ts: str = "ts", by: str = "symbol", chunk: str = "month", blocks: int = SYMBOL_BLOCKS) -> DataFrame:
    """``src, dst, at, n, sx, sy, sxy``: per unordered pair of symbols and time chunk, sums over the times that both have.

    Values of a block of symbols in a chunk are a matrix of times by symbols, and a pair of blocks is four matrix
    products; so a pair costs a row per chunk, not one per time. A symbol's rows go to ``blocks`` groups. Rows are unique by symbol and time.
    """

    def products(key: tuple, rows: pa.Table) -> pa.Table:
        times = rows.column("t").combine_chunks().dictionary_encode()
        names = rows.column("s").combine_chunks().dictionary_encode()
        at, who = times.indices.to_numpy(zero_copy_only=False), names.indices.to_numpy(zero_copy_only=False)
        value = np.zeros((len(times.dictionary), len(names.dictionary)))
        there = np.zeros_like(value)
        value[at, who], there[at, who] = rows.column("v").to_numpy(), 1.0
        own = np.zeros(len(names.dictionary), dtype=np.int64)
        own[who] = rows.column("b").to_numpy()
        text = np.array(names.dictionary.to_pylist(), dtype=object)
        n = there.T @ there
        # each pair once: within a block, or of this group's two blocks
        i, j = key[1].as_py(), key[2].as_py()
        wanted = (n > 0) & (text[:, None] < text[None, :]) & ((own[:, None] != own[None, :]) | (i == j))
        a, b = np.nonzero(wanted)
        sums = {"n": n, "sx": value.T @ there, "sy": there.T @ value, "sxy": value.T @ value}
        return pa.table({"src": pa.array(text[a], pa.string()), "dst": pa.array(text[b], pa.string()), "at": pa.array([key[0].as_py()] * len(a), pa.timestamp("us", "UTC")), **{k: v[a, b].astype(np.int64 if k == "n" else np.float64) for k, v in sums.items()}})

    own = F.pmod(F.xxhash64(by), F.lit(blocks)).alias("b")
    dealt = rows.where(F.col(c).isNotNull()).select(F.date_trunc(chunk, F.col(ts).cast("timestamp")).alias("at"), F.col(ts).cast("timestamp").alias("t"), F.col(by).alias("s"), own, F.col(c).cast("double").alias("v"))
    cells = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("at", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "t", "s", "b", "v")
    return cells.groupBy("at", "i", "j").applyInArrow(products, "src string, dst string, at timestamp, n bigint, sx double, sy double, sxy double")


def corr_edges(bars: DataFrame, n: int = 30, least: float = 0.1, c: str = "close", ts: str = "ts", chunk: str = "day") -> DataFrame:
    """``src, dst, weight`` in both directions: correlation of relative changes over a pair's last ``n`` common times, beyond ``least`` in size.

    Common times are counted per chunk; only chunks that hold a pair's last ones are read row by row.
    """
    moved = shifted(bars, {"_r": (c, "pct", 1)}, ["symbol"], [ts]).where("_r is not null").select("symbol", F.col(ts).cast("timestamp").alias("t"), F.date_trunc(chunk, F.col(ts).cast("timestamp")).alias("at"), F.col("_r").alias("r"))
    later = F.coalesce(F.sum("n").over(Window.partitionBy("src", "dst").orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    needed = pair_sums(moved, "r", "t", chunk=chunk).withColumn("_later", later).where(F.col("_later") < n).select("src", "dst", "at")
    x = needed.join(moved.select(F.col("symbol").alias("src"), "at", "t", F.col("r").alias("x")), ["src", "at"])
    both = x.join(moved.select(F.col("symbol").alias("dst"), "at", "t", F.col("r").alias("y")), ["dst", "at", "t"])
    last = both.withColumn("_n", F.row_number().over(Window.partitionBy("src", "dst").orderBy(F.col("t").desc()))).where(F.col("_n") <= n)
    spread = F.sqrt(F.var_pop("x") * F.var_pop("y"))
    weight = F.when((F.count("x") >= n) & (spread > 1e-12), F.try_divide(F.covar_pop("x", "y"), spread))
    edges = last.groupBy("src", "dst").agg(weight.alias("weight")).where(F.abs("weight") > least)
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def influence(edges: DataFrame) -> DataFrame:
    """``symbol, incoming, outgoing``: sums of absolute edge weights."""
    w = F.abs("weight")
    into = edges.groupBy(F.col("dst").alias("symbol")).agg(F.sum(w).alias("incoming"))
    out = edges.groupBy(F.col("src").alias("symbol")).agg(F.sum(w).alias("outgoing"))
    return into.join(out, "symbol", "full").select("symbol", F.coalesce("incoming", F.lit(0.0)).alias("incoming"), F.coalesce("outgoing", F.lit(0.0)).alias("outgoing"))


def lag_screen(df: DataFrame, target: str, features: list[str], max_lag: int = 3, t_least: float = 1.96, by=("symbol",), order=("ts",)) -> DataFrame:
    """``by, feature, lag, n, corr, t, linked``: correlation of the target with earlier feature values, by t value.

    A screen of pairwise lagged correlations, not a causal discovery.
    """
    made = {f"_{f}_{k}": (f, "lag", k) for f in features for k in range(1, max_lag + 1)}
    rows = shifted(df, made, [*by], [*order])
    long = rows.select(*by, F.col(target).alias("y"), F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(k).alias("lag"), F.col(f"_{f}_{k}").cast("double").alias("x")) for f in features for k in range(1, max_lag + 1)))).alias("e")).select(*by, "y", "e.*")
    ok = long.where("x is not null and y is not null")
    sd = F.stddev_pop("x") * F.stddev_pop("y")
    facts = ok.groupBy(*by, "feature", "lag").agg(F.count(F.lit(1)).alias("n"), F.when(sd > 1e-12, safe_ratio(F.covar_pop("x", "y"), sd)).alias("corr"))
    t = F.col("corr") * F.sqrt(safe_ratio(F.col("n") - 2, 1 - F.col("corr") * F.col("corr")))
    return facts.withColumns({"t": t, "linked": F.coalesce(F.abs(t) > t_least, F.lit(False))})


def influence_map(bars: DataFrame, leader: str, n: int = 60, ts: str = "ts", c: str = "close") -> DataFrame:
    """Adds ``perm_entropy`` of closes and ``lead_corr``, the rolling correlation of changes with the leader's (0 for itself)."""
    moved = shifted(bars, {"_r": (c, "pct", 1)}, ["symbol"], [ts])
    lead = moved.where(F.col("symbol") == leader).select(ts, F.col("_r").alias("_lr"))
    met = asof_join(moved, lead, ts, [], chunk="day").drop(f"{ts}_right")
    made = rolling_corr(met, "_r", "_lr", n, "lead_corr", ["symbol"], [ts])
    made = made.withColumn("lead_corr", F.when(F.col("symbol") == leader, 0.0).otherwise(F.col("lead_corr")))
    return perm_entropy(made, c, n).drop("_r", "_lr")


def covariance(bars: DataFrame, c: str = "close", ts: str = "ts", chunk: str = "month") -> DataFrame:
    """``src, dst, n, cov`` of relative changes for pairs, and of each symbol with itself."""
    moved = shifted(bars, {"_r": (c, "pct", 1)}, ["symbol"], [ts]).where("_r is not null")
    facts = moved.groupBy("symbol").agg(F.avg("_r").alias("_m"), F.count("_r").alias("n"), F.var_samp("_r").alias("cov"))
    off = moved.join(facts.select("symbol", "_m"), "symbol").withColumn("_o", F.col("_r") - F.col("_m"))  # about the mean, so that sums of products stay precise
    sums = pair_sums(off, "_o", ts, chunk=chunk).groupBy("src", "dst").agg(*(F.sum(k).alias(k) for k in ("n", "sx", "sy", "sxy")))
    pairs = sums.select("src", "dst", "n", F.when(F.col("n") > 1, (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / (F.col("n") - 1)).alias("cov"))
    return pairs.unionByName(facts.select(F.col("symbol").alias("src"), F.col("symbol").alias("dst"), "n", "cov"))


def market_signature(bars: DataFrame, n: int = 14) -> DataFrame:
    """``symbol, atr_pct, volume, skew, kurtosis``: means and bias-corrected shape of relative changes."""
    made = shifted(atr(bars, n), {"_r": ("close", "pct", 1)})
    return made.groupBy("symbol").agg((100 * F.avg(safe_ratio(F.col(f"atr_{n}"), F.col("close")))).alias("atr_pct"), F.avg("volume").alias("volume"), sample_skew("_r").alias("skew"), sample_kurtosis("_r").alias("kurtosis"))


def signal_signature(df: DataFrame, by: list[str], signal: str = "signal", least: int = 10) -> DataFrame:
    """``volume_ratio`` (signed over active volume), ``activity``, ``active_volume`` and ``active_sigma`` (population, more than ``least`` active bars)."""
    on = F.col(signal) != 0
    sign = F.when(F.col(signal) == 1, 1.0).when(F.col(signal) == 2, -1.0)
    total = F.sum(F.when(on, F.col("volume")))
    return df.groupBy(*by).agg(
        F.coalesce(safe_ratio(F.sum(sign * F.col("volume")), total), F.lit(0.0)).alias("volume_ratio"), F.avg(on.cast("double")).alias("activity"),
        F.coalesce(F.avg(F.when(on, F.col("volume"))), F.lit(0.0)).alias("active_volume"), F.when(F.count(F.when(on, 1)) > least, F.stddev_pop(F.when(on, F.col("close")))).otherwise(0.0).alias("active_sigma"),
    )


def param_sweep(bars: DataFrame, grid: DataFrame, observed: DataFrame, n: int = 14) -> DataFrame:
    """Per symbol the grid row ``low, high`` whose RSI signals look most like the observed signature: ``low, high, distance, fit``.

    The grid (a checked, small table of thresholds) meets bars that already have their RSI, computed once.
    """
    with_rsi = rsi(bars, "close", n).select("symbol", "ts", "close", "volume", f"rsi_{n}")
    met = with_rsi.crossJoin(F.broadcast(grid)).withColumn("signal", F.when(F.col(f"rsi_{n}") < F.col("low"), 1).when(F.col(f"rsi_{n}") > F.col("high"), 2).otherwise(0))
    made = signal_signature(met, ["symbol", "low", "high"])
    names = ["volume_ratio", "activity"]
    both = made.join(observed.select("symbol", *(F.col(c).alias(f"_{c}") for c in names)), "symbol")
    d = F.sqrt(sum((F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}")) for c in names))
    best = both.withColumn("distance", d).groupBy("symbol").agg(F.min_by(F.struct("low", "high", "distance"), F.struct("distance", "low", "high")).alias("b"))
    return best.select("symbol", "b.*").withColumn("fit", 1 / (1 + F.col("distance")))


def drift_points(df: DataFrame, c: str, window: int = 200, delta: float = 0.005, grace: int = 100, step: int = 10, by=("symbol",), order=("ts",)) -> DataFrame:
    """Rows at which some split of the last ``window`` values shows a mean shift beyond an ADWIN-style bound.

    Adds ``cut`` (``|mean difference| - bound`` of the worst split) and ``drift``; only every ``step``-th
    split is looked at, none before ``grace`` values.
    """
    by, order = [*by], [*order]
    # sums are from a block's start on, as only their differences count
    sums = columns_step({"_s": lambda w: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_v": lambda w: F.var_pop(c).over(w.rowsBetween(-(window - 1), 0))})
    splits = [*range(step, window, step)]
    lags = columns_step({f"_l{back}": (lambda w, back=back: F.lag("_s", back).over(w)) for back in [*splits, window]})
    made = in_blocks(index_rows(df, by, order), [sums, lags], by, order, before=window + 1).withColumn("_i", F.col("_ix") + 1)
    n = F.col("_i") - F.greatest(F.lit(0), F.col("_i") - window)
    worst = []
    for back in splits:
        n1 = F.lit(float(back))
        n0 = n - back
        mid = F.col(f"_l{back}")
        m0, m1 = safe_ratio(mid - F.coalesce(f"_l{window}", F.lit(0.0)), n0), (F.col("_s") - mid) / n1
        m = 1 / (1 / n1 + safe_ratio(F.lit(1.0), n0))
        log = F.lit(math.log(2 / delta)) + F.ln(n)
        bound = F.sqrt(2 / m * F.col("_v") * log) + 2 / (3 * m) * log
        worst.append(F.when((n0 > 0) & mid.isNotNull(), F.abs(m0 - m1) - bound))
    helpers = ["_i", "_ix", "_s", "_v", *(f"_l{back}" for back in [*splits, window])]
    out = made.withColumn("cut", F.when(F.col("_i") >= grace, F.greatest(*worst)))
    return out.withColumn("drift", F.coalesce(F.col("cut") > 0, F.lit(False))).drop(*helpers)
