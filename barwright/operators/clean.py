"""Cleaning and validation of bars and other keyed series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.functions.scalar import finite, safe_ratio
from barwright.operators.scan import index_rows, over_blocks, running


def sanitize(df: DataFrame, cols: list[str], how: str = "null") -> DataFrame:
    """NaN and infinities of ``cols`` become null; ``how="drop"`` also drops rows with a null among them."""
    out = df.withColumns({c: finite(c) for c in cols})
    return out.dropna(subset=cols) if how == "drop" else out


def fill(df: DataFrame, cols: list[str], mode: str, by: list[str], order: list[str], time: str | None = None) -> DataFrame:
    """Fill nulls per key: ``ffill``, ``bfill`` (looks ahead) or ``time`` (linear in time between neighbours, nearest at the ends).

    ``time`` looks ahead, too; ``ffill`` is the causal choice. A column without any value stays null.
    """
    if mode in ("ffill", "bfill"):
        return running(df, {c: ("last", c) for c in cols}, by, order, ahead=mode == "bfill").select(*df.columns)
    at = F.unix_micros(F.col(time or order[0]).cast("timestamp")).cast("double")
    out = df.withColumn("_at", at)
    here = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("_at").alias("t"), F.col(c).alias("v"))) for c in cols}
    out = running(out, {f"_p_{c}": ("last", x) for c, x in here.items()}, by, order)
    out = running(out, {f"_n_{c}": ("last", x) for c, x in here.items()}, by, order, ahead=True)
    for c in cols:
        p, n = F.col(f"_p_{c}"), F.col(f"_n_{c}")
        blend = p["v"] + (n["v"] - p["v"]) * safe_ratio(F.col("_at") - p["t"], n["t"] - p["t"])
        out = out.withColumn(c, F.coalesce(F.col(c), blend, p["v"], n["v"]))
    return out.select(*df.columns)


def column_variance(df: DataFrame, cols: list[str]) -> DataFrame:
    """``column, variance`` (sample) of each column in one pass; null for fewer than two values."""
    row = df.agg(*(F.var_samp(c).alias(c) for c in cols))
    return row.unpivot([], cols, "column", "variance")


def drop_constant(df: DataFrame, cols: list[str], eps: float = 1e-9) -> DataFrame:
    """``df`` without those of ``cols`` whose sample variance is null or at most ``eps``."""
    flat = [r["column"] for r in column_variance(df, cols).where(f"variance is null or variance <= {eps}").collect()]
    return df.drop(*flat)


def affix(df: DataFrame, keep: list[str], prefix: str = "", suffix: str = "") -> DataFrame:
    """Rename all columns but ``keep``."""
    return df.withColumnsRenamed({c: f"{prefix}{c}{suffix}" for c in df.columns if c not in keep})


def drop_repeated_columns(df: DataFrame) -> DataFrame:
    """The first of each set of columns that share a name."""
    first = {c: i for i, c in reversed([*enumerate(df.columns)])}
    unique = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
    return unique.select(*(F.col(f"_{i}").alias(c) for c, i in sorted(first.items(), key=lambda x: x[1])))


def validate_bars(df: DataFrame, by: list[str], order: list[str], max_null: float = 0.1, max_spike: float = 0.2, stale: int = 10, cols: tuple[str, ...] = ("open", "high", "low", "close")) -> DataFrame:
    """One row per key and check: ``check, passed, value``.

    Checks: largest null ratio of ``cols``; number of prices at or below zero; whether the last
    ``stale`` close changes are all zero (a missing change counts as zero); largest absolute relative close change.
    """
    moved = over_blocks(index_rows(df, by, order), {"_was": lambda w: F.lag("close").over(w)}, by, order, before=1)
    moved = moved.withColumns({"_move": F.col("close") - F.col("_was"), "_jump": F.abs(safe_ratio(F.col("close"), F.col("_was")) - 1)})
    nulls = F.greatest(*(F.avg(F.col(c).isNull().cast("double")) for c in cols))
    low = sum(F.sum(F.coalesce((F.col(c) <= 0).cast("long"), F.lit(0))) for c in cols)
    # still since before the last rows: its latest change is earlier
    still = F.coalesce(F.max(F.when(F.col("_move") != 0, F.col("_ix"))), F.lit(-1)) < F.greatest(F.count(F.lit(1)) - stale, F.lit(0))
    facts = moved.groupBy(*by).agg(nulls.alias("null_ratio"), low.cast("double").alias("non_positive"), F.when(still, 1.0).otherwise(0.0).alias("stale"), F.coalesce(F.max("_jump"), F.lit(0.0)).alias("spike"))
    long = facts.unpivot(by, ["null_ratio", "non_positive", "stale", "spike"], "check", "value")
    limit = F.when(F.col("check") == "null_ratio", max_null).when(F.col("check") == "spike", max_spike).otherwise(0.0)
    return long.select(*by, "check", (F.col("value") <= limit).alias("passed"), "value")


def class_balance(df: DataFrame, label: str, warn_below: float = 0.1) -> DataFrame:
    """``label, n, share, scarce``: size and share of each class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    share = F.col("n") / F.col("_total")
    return counts.crossJoin(F.broadcast(total)).select(label, "n", share.alias("share"), (share < warn_below).alias("scarce"))
