"""Ticks to bars, regular grids, set operations and registry-style rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.operators import selection
from barwright.operators.clean import fill


def ohlcv_resample(ticks: DataFrame, width: str, by: tuple[str, ...] = ("symbol",), ts: str = "ts", price: str = "price", qty: str = "qty", tie: str = "id", filled: bool = False) -> DataFrame:
    """Bars ``by, ts (bucket start), open, high, low, close, volume``; ties in time go by ``tie``.

    Partial aggregation happens before the shuffle. With ``filled``, the grid between a key's first and
    last bar is complete: missing bars repeat the last close, with volume 0.
    """
    at = F.struct(F.col(ts), F.col(tie))
    bars = (
        ticks.where(F.col(price).isNotNull()).groupBy(*by, F.window(F.col(ts).cast("timestamp"), width)["start"].alias("_w"))
        .agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.sum(qty).alias("volume"))
        .withColumnRenamed("_w", "ts")
    )
    return fill_grid(bars, width, by) if filled else bars


def fill_grid(bars: DataFrame, width: str, by: tuple[str, ...] = ("symbol",), ts: str = "ts") -> DataFrame:
    """Bars on every step between a key's first and last: missing ones are flat at the last close."""
    span = bars.groupBy(*by).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    grid = span.select(*by, F.explode(F.sequence(F.col("_a"), F.col("_b"), F.expr(f"interval {width}"))).alias(ts))
    met = fill(grid.join(bars, [*by, ts], "left"), ["close"], "ffill", [*by], [ts])
    flat = {c: F.coalesce(F.col(c), F.col("close")) for c in ("open", "high", "low")}
    return met.withColumns(flat | {"volume": F.coalesce("volume", F.lit(0.0))})


def daily_sum(df: DataFrame, ts: str, amounts: str) -> DataFrame:
    """``day, total``: sum over a map column's values by day."""
    return df.select(F.to_date(ts).alias("day"), F.explode(amounts).alias("k", "v")).groupBy("day").agg(F.sum("v").alias("total"))


def latest(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The whole latest row per key."""
    return df.groupBy(*by).agg(F.max_by(F.struct(*(c for c in df.columns if c not in by)), F.struct(*order)).alias("_r")).select(*by, "_r.*")


def prune_list(importance: DataFrame, feature: str = "feature", value: str = "importance") -> DataFrame:
    """Features whose mean importance over keys is at most 0."""
    return importance.groupBy(feature).agg(F.avg(value).alias("mean_importance")).where("mean_importance <= 0")


def elite_stats(elite: DataFrame, profit: str = "profit_pct", dna: str = "has_dna") -> DataFrame:
    return elite.agg(F.count(F.lit(1)).alias("n"), F.avg(profit).alias("avg_profit"), F.max(profit).alias("max_profit"), F.count(F.when(F.col(dna), 1)).alias("with_dna"))


def quantiles(df: DataFrame, c: str, by: list[str], approximate: bool = False) -> DataFrame:
    """``q25, q50, q75, iqr``; exact with linear interpolation (see ``selection``), or approximate in one pass."""
    names = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    if approximate:
        rows = df.groupBy(*by).agg(F.approx_percentile(c, [*names.values()], 10_000).alias("_q")).select(*by, *(F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(names)))
    else:
        rows = selection.quantiles(df, {n: (c, q) for n, q in names.items()}, by)
    return rows.withColumn("iqr", F.col("q75") - F.col("q25"))


def append_aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both; a column that one side lacks is null there; the first side's order of columns."""
    return a.unionByName(b, allowMissingColumns=True)


def concat_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = append_aligned(out, f)
    return out


def best_elite(elite: DataFrame, symbol: str | None = None, architecture: str | None = None, prefix: str | None = None) -> DataFrame:
    """The most profitable row under optional filters."""
    rows = elite
    if symbol:
        rows = rows.where(F.col("symbol") == symbol)
    if architecture:
        rows = rows.where(F.col("architecture") == architecture)
    if prefix:
        rows = rows.where(F.col("model_id").startswith(prefix))
    return rows.agg(F.max_by(F.struct(*elite.columns), F.struct("profit_pct", "model_id")).alias("b")).where("b is not null").select("b.*")


def best_per_key(df: DataFrame, by: list[str], score: str, key: str, k: int = 5, ascending: bool = True) -> DataFrame:
    """The ``k`` best rows per key by score, ties to the smaller ``key``."""
    w = Window.partitionBy(*by).orderBy(F.col(score).asc_nulls_last() if ascending else F.col(score).desc_nulls_last(), key)
    return df.withColumn("rank", F.row_number().over(w)).where(f"rank <= {k}")


def registry_listing(registry: DataFrame, model_type: str, kind: str = "model_type", when: str = "registered") -> DataFrame:
    return registry.where(F.col(kind) == model_type).orderBy(F.col(when).desc())


def pivot_closes(bars: DataFrame, symbols: list[str], ts: str = "ts") -> DataFrame:
    """Closes side by side for a short list of symbols."""
    return bars.groupBy(ts).pivot("symbol", symbols).agg(F.first("close"))
