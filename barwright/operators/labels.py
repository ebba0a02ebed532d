"""Labels, trading signals and time-ordered splits. Signals: 0 hold, 1 enter, 2 leave."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.functions.scalar import safe_ratio
from barwright.operators.indicators import BY, ORDER, atr, bbands, choppiness, ema, rolling, rsi, shifted
from barwright.operators.resample import numbered
from barwright.operators.scan import index_rows, indexed, over_blocks, running


def triple_barrier(df: DataFrame, pt: float = 2.0, sl: float = 2.0, horizon: int = 20, width: str = "atr_14", tail: str = "null", by=BY, order=ORDER) -> DataFrame:
    """Adds ``label``: which barrier the next ``horizon`` bars touch first, 1 the upper, 2 the lower, 0 neither.

    Barriers stand at close plus or minus a multiple of ``width``; the upper one is looked at first
    within a bar. The last ``horizon`` bars have no label (``tail="zero"``: label 0), as has a bar without a width.
    """
    made = over_blocks(df, {"_ahead": lambda w: F.collect_list(F.struct("high", "low")).over(w.rowsBetween(1, horizon))}, by, order, after=horizon)
    up, down = F.col("close") + F.col(width) * pt, F.col("close") - F.col(width) * sl
    hits = F.filter(F.transform("_ahead", lambda b: F.when(b["high"] >= up, F.lit(1)).when(b["low"] <= down, F.lit(2)).otherwise(F.lit(0))), lambda x: x > 0)
    label = F.coalesce(F.get(hits, F.lit(0)), F.lit(0))
    short = F.size("_ahead") < horizon
    return made.withColumn("label", F.when(F.col(width).isNull(), None).when(short, F.lit(0) if tail == "zero" else F.lit(None).cast("int")).otherwise(label)).drop("_ahead")


def reversion_label(df: DataFrame, n: int = 20, k: float = 2.0, by=BY, order=ORDER) -> DataFrame:
    """Adds ``label``: 1 below the lower band, 2 above the upper one, else 0, also before the bands exist."""
    made = bbands(df, "close", n, k, by=by, order=order)
    label = F.when(F.col("close") < F.col("bb_low"), 1).when(F.col("close") > F.col("bb_high"), 2).otherwise(0)
    return made.withColumn("label", label)


def forward_return(df: DataFrame, k: int = 1, c: str = "close", by=BY, order=ORDER) -> DataFrame:
    made = shifted(df, {"_n": (c, "lead", k)}, by, order)
    return made.withColumn(f"fwd_{k}", safe_ratio(F.col("_n"), F.col(c)) - 1).drop("_n")


def meta_label(signal: str, fwd: str) -> Column:
    """1 where an entry is followed by a rise or an exit by a fall; 0 else, also without a future."""
    return F.when(((F.col(signal) == 1) & (F.col(fwd) > 0)) | ((F.col(signal) == 2) & (F.col(fwd) < 0)), 1).otherwise(0)


def sign_label(ret: str, eps: float = 0.001) -> Column:
    """2 above ``eps``, 0 below its negative, else 1; null for null."""
    return F.when(F.col(ret) > eps, 2).when(F.col(ret) < -eps, 0).when(F.col(ret).isNotNull(), 1)


def to_signals(df: DataFrame, condition: Column, by=BY, order=ORDER, out: str = "signal") -> DataFrame:
    """Edges of a condition: 1 where it starts to hold, 2 where it stops, else 0; null counts as false."""
    held = df.withColumn("_on", F.coalesce(condition, F.lit(False)))
    edge = lambda w: F.coalesce(F.lag("_on").over(w), F.lit(False))
    made = over_blocks(held, {"_was": edge}, by, order, before=1)
    return made.withColumn(out, F.when(F.col("_on") & ~F.col("_was"), 1).when(~F.col("_on") & F.col("_was"), 2).otherwise(0)).drop("_on", "_was")


def position(df: DataFrame, signal: str = "signal", by=BY, order=ORDER, out: str = "position") -> DataFrame:
    """1 from an entry on until the next exit, else 0; repeated entries and exits change nothing."""
    made = running(df, {"_last": ("last", F.when(F.col(signal) != 0, F.col(signal)))}, by, order)
    return made.withColumn(out, F.coalesce((F.col("_last") == 1).cast("int"), F.lit(0))).drop("_last")


def ma_cross(df: DataFrame, fast: int = 10, slow: int = 30, by=BY, order=ORDER) -> DataFrame:
    """Adds ``signal``: 1 while the fast mean is above the slow one, 2 while below, 0 before both exist."""
    made = rolling(df, {"_f": ("close", "mean", fast), "_s": ("close", "mean", slow)}, by, order)
    return made.withColumn("signal", F.when(F.col("_f") > F.col("_s"), 1).when(F.col("_f") < F.col("_s"), 2).otherwise(0)).drop("_f", "_s")


def rsi_signal(df: DataFrame, n: int = 14, low: float = 30, high: float = 70, by=BY, order=ORDER) -> DataFrame:
    made = rsi(df, "close", n, by, order)
    return made.withColumn("signal", F.when(F.col(f"rsi_{n}") < low, 1).when(F.col(f"rsi_{n}") > high, 2).otherwise(0))


def trend_bias(df: DataFrame, fast: int = 50, slow: int = 200, band: float = 0.005, by=BY, order=ORDER) -> DataFrame:
    """One row per key: ``bias`` of the latest bar, LONG or SHORT where the means differ by more than ``band``; NEUTRAL for fewer than ``slow`` rows."""
    made = ema(ema(indexed(df, by, order), "close", fast, by=by, order=order), "close", slow, by=by, order=order)
    last = made.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct(F.col(f"ema_{fast}").alias("f"), F.col(f"ema_{slow}").alias("s")), F.struct(*order)).alias("e"))
    bias = F.when(F.col("n") < slow, "NEUTRAL").when(F.col("e.f") > F.col("e.s") * (1 + band), "LONG").when(F.col("e.f") < F.col("e.s") * (1 - band), "SHORT").otherwise("NEUTRAL")
    return last.select(*by, bias.alias("bias"))


def environment(df: DataFrame, n: int = 14, least: int = 50, by=BY, order=ORDER) -> DataFrame:
    """One row per key: ``environment`` from the latest bar's ATR share against its third quartile and choppiness against its median."""
    made = choppiness(atr(indexed(df, by, order), n, by, order), n, by, order)
    facts = made.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.percentile(f"atr_ratio_{n}", 0.75).alias("v75"), F.percentile(f"chop_{n}", 0.5).alias("c50"),
        F.max_by(F.struct(F.col(f"atr_ratio_{n}").alias("v"), F.col(f"chop_{n}").alias("c")), F.struct(*order)).alias("e"),
    )
    vol = F.when(F.col("e.v") > F.col("v75"), "Volatile").otherwise("Quiet")
    chop = F.when(F.col("e.c") > F.col("c50"), "Ranging").otherwise("Trending")
    return facts.select(*by, F.when((F.col("n") < least) | F.col("e.c").isNull(), "Undefined").otherwise(F.concat_ws("-", vol, chop)).alias("environment"))


def chrono_split(df: DataFrame, fractions: dict[str, float], by=BY, order=ORDER) -> DataFrame:
    """Adds ``split``: names in time order, each with its share of a key's rows (bounds are exact and round down)."""
    rows = index_rows(df, by, order)
    total = df.groupBy(*by).agg(F.count(F.lit(1)).cast("decimal(20,0)").alias("_n"))
    met = rows.join(total, by)
    out, edge = F.lit([*fractions][-1]), Decimal(1)
    for name, share in reversed([*fractions.items()]):
        out = F.when(F.col("_ix") < F.floor(F.col("_n") * F.lit(edge)), name).otherwise(out) if edge < 1 else F.lit(name)
        edge -= round(Decimal(str(share)), 15)  # in doubles, 720 rows times 0.7 come to less than 504
    return met.withColumn("split", out).drop("_ix", "_n")


def walk_forward(df: DataFrame, train: int, test: int, folds: int = 3, shrink: float = 0.8, least: int = 400, by=BY, order=ORDER) -> DataFrame:
    """Rows by fold, ``fold`` from 0 and ``part`` train or test; folds start ``test`` rows apart.

    While a key has too few rows, both lengths shrink by ``shrink``; keys under ``least`` rows have none.
    """
    rows = index_rows(df, by, order)
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(f"_n >= {least}")
    steps = F.greatest(F.lit(0), F.ceil(F.ln(F.col("_n") / F.lit(train + folds * test)) / F.log(F.lit(shrink)) - 1e-9))
    scaled = n.withColumn("_k", F.pow(F.lit(shrink), steps)).select(*by, F.floor(train * F.col("_k") + 1e-9).alias("_train"), F.floor(test * F.col("_k") + 1e-9).alias("_test"))
    plan = scaled.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    i, start = F.col("_ix"), F.col("fold") * F.col("_test")
    met = rows.join(plan, by).where((i >= start) & (i < start + F.col("_train") + F.col("_test")))
    return met.withColumn("part", F.when(i < start + F.col("_train"), "train").otherwise("test")).drop("_ix", "_train", "_test")


def regime_tasks(df: DataFrame, regime: str = "regime", min_rows: int = 20, by=BY, order=ORDER) -> DataFrame:
    """Adds ``part``: the first half of each (key, regime) is support, the rest query; regime -1 and small groups go."""
    keys = [*by, regime]
    made = numbered(df.where(F.col(regime) != -1), keys, [*order]).where(F.col("_n") >= min_rows)
    return made.withColumn("part", F.when(F.col("_i") < F.floor(F.col("_n") / 2), "support").otherwise("query")).drop("_i", "_n")
