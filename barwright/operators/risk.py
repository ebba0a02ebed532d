"""Risk rules over equity streams, bars and trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions.scalar import clip, safe_ratio
from barwright.operators.scan import carried, chunked, earlier


def circuit_breaker(equity: DataFrame, daily: float = 0.10, peak: float = 0.30, by: str = "account", ts: str = "ts", value: str = "equity") -> DataFrame:
    """Adds ``daily_tripped`` (latched to the end of the day), ``peak_tripped`` (latched for good) and ``allowed``.

    The daily loss is against the day's first equity, the peak loss (a share of 1 at most) against the highest so far.

    Both latches take one pass: a day trips on a peak before it exactly if its own rows do among
    themselves, or its lowest equity does against that peak.
    """
    if peak > 1:
        raise ValueError("a peak loss is a share of the peak")
    rows = chunked(equity, [by], [ts])
    upto = Window.partitionBy("_ck").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    fell = lambda top, now: F.coalesce(F.when(top > 0, (top - now) / top) >= peak, F.lit(False))
    start = F.first(value).over(upto)
    rows = rows.withColumn("_hh", F.max(value).over(upto))
    rows = rows.withColumns({"_l": F.coalesce(safe_ratio(start - F.col(value), start) >= daily, F.lit(False)), "_f": fell(F.col("_hh"), F.col(value))})
    tops = {"_top": lambda w: F.max("_h").over(earlier(w))}
    trips = {"_top": lambda w: F.col("_top"), "_gone": lambda w: F.max(F.col("_t") | fell(F.col("_top"), F.col("_low"))).over(earlier(w))}
    rows = carried(rows, [F.max(value).alias("_h"), F.min(value).alias("_low"), F.max("_f").alias("_t")], [tops, trips], [by])
    rows = rows.withColumn("_f", fell(F.greatest("_hh", "_top"), F.col(value)))
    made = rows.withColumns({"peak_tripped": F.coalesce("_gone", F.lit(False)) | F.max("_f").over(upto), "daily_tripped": F.max("_l").over(upto)})
    made = made.withColumn("allowed", ~F.col("daily_tripped") & ~F.col("peak_tripped"))
    return made.drop("_hh", "_top", "_l", "_f", "_gone", *([] if "_ck" in equity.columns else ["_ck"]))


def volatility_gate(df: DataFrame, c: str, cap: float = 0.05) -> DataFrame:
    """Rows whose volatility is known and at most ``cap``."""
    return df.where(F.col(c) <= cap)


def kelly(p: str | Column, b: str | Column, fraction: float = 0.2) -> Column:
    """Fractional Kelly share within [0, 1]; 0 without an edge ratio."""
    p, b = (F.col(x) if isinstance(x, str) else x for x in (p, b))
    return F.when(b > 0, clip(fraction * (p - safe_ratio(1 - p, b)), 0.0, 1.0)).otherwise(0.0)


def trailing_stop(bars: DataFrame, mult: float = 3.0, by=("trade",), order=("ts",), side: str = "side", atr: str = "atr") -> DataFrame:
    """Adds ``stop``: for longs the highest of peak minus ATR multiples so far, for shorts the lowest of trough plus them.

    Both are nested extremes, yet one pass: against a peak before a chunk, its best stop is the peak
    less its smallest ATR multiple, or what its own rows make.
    """
    by, order, long, wide = [*by], [*order], F.col(side) == "long", F.col(atr) * mult
    rows = chunked(bars, by, order)
    upto = Window.partitionBy("_ck").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_hh": F.max("high").over(upto), "_ll": F.min("low").over(upto)})
    totals = [F.max("high").alias("_h"), F.min("low").alias("_l"), F.min(wide).alias("_w"), F.max(F.col("_hh") - wide).alias("_eh"), F.min(F.col("_ll") + wide).alias("_el")]
    ends = {"_top": lambda w: F.max("_h").over(earlier(w)), "_low": lambda w: F.min("_l").over(earlier(w))}
    stops = {
        "_top": lambda w: F.col("_top"), "_low": lambda w: F.col("_low"),
        "_up": lambda w: F.max(F.greatest(F.col("_eh"), F.col("_top") - F.col("_w"))).over(earlier(w)), "_dn": lambda w: F.min(F.least(F.col("_el"), F.col("_low") + F.col("_w"))).over(earlier(w)),
    }
    rows = carried(rows, totals, [ends, stops], by)
    up, down = F.max(F.greatest("_hh", "_top") - wide).over(upto), F.min(F.least("_ll", "_low") + wide).over(upto)
    made = rows.withColumns({"_su": up, "_sd": down}).withColumn("stop", F.when(long, F.greatest("_up", "_su")).otherwise(F.least("_dn", "_sd")))
    return made.drop("_hh", "_ll", "_top", "_low", "_up", "_dn", "_su", "_sd", *([] if "_ck" in bars.columns else ["_ck"]))


def size_chain(df: DataFrame, least: float = 0.01) -> DataFrame:
    """Adds ``size``: ``kelly`` (at most 0.95) times risk, flow, influence and shape factors; 0 at or below ``least``.

    Reads ``kelly, risk_multiplier, mce_skew, mce_pressure, influence, unusual``.
    """
    flow = F.when(F.col("mce_skew") < -0.2, 0.5).otherwise(1.0) * F.when(F.col("mce_pressure") > 0.8, 0.3).otherwise(1.0)
    pull = F.greatest(F.lit(0.1), 1 - F.abs(F.col("influence") * 2))
    size = F.least(F.col("kelly"), F.lit(0.95)) * F.col("risk_multiplier") * flow * pull * F.when(F.col("unusual"), 0.1).otherwise(1.0)
    return df.withColumn("size", F.when(size > least, size).otherwise(0.0))


def levels(df: DataFrame, stop_mult: float = 2.0, price: str = "close", atr: str = "atr", regime: str = "regime") -> DataFrame:
    """Adds ``reward`` (by regime 0, 1, other), ``stop_loss`` and ``take_profit``."""
    reward = F.when(F.col(regime) == 0, 3.5).when(F.col(regime) == 1, 2.5).otherwise(2.0)
    far = F.col(atr) * stop_mult
    return df.withColumns({"reward": reward, "stop_loss": F.col(price) - far, "take_profit": F.col(price) + far * reward})


def adaptive_timeout(atr: str, price: str) -> Column:
    """Minutes a position may last: the livelier the price, the fewer."""
    pct = F.when(F.col(price) > 0, 100 * F.col(atr) / F.col(price)).otherwise(1.0)
    return F.when(pct >= 2.5, 3).when(pct >= 1.5, 5).when(pct >= 1.0, 7).when(pct >= 0.5, 9).otherwise(10)


def exit_reason(bars: DataFrame, by=("trade",), ts: str = "ts") -> DataFrame:
    """First bar of each trade that ends it, and why: stop loss, then take profit, then timeout, then signal.

    Reads ``close, atr, stop_loss, take_profit, entry_ts, signal``; trades that nothing ends have no row.
    """
    held = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("entry_ts").cast("timestamp"))) / F.lit(60e6)
    why = (
        F.when(F.col("close") <= F.col("stop_loss"), "stop_loss").when(F.col("close") >= F.col("take_profit"), "take_profit")
        .when(held > adaptive_timeout("atr", "close"), "timeout").when(F.col("signal") == 2, "signal")
    )
    hits = bars.withColumn("_why", why).where("_why is not null")
    return hits.groupBy(*by).agg(F.min_by(F.struct(F.col(ts).alias("exit_ts"), F.col("close").alias("exit_price"), F.col("_why").alias("reason")), F.col(ts)).alias("e")).select(*by, "e.*")
