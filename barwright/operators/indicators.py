"""Technical features over keyed bars: rolling, recursive and shape measures.

Functions that take ``(df, ...)`` add columns and spread long keys over row blocks; a rolling value is
null until its frame holds ``n`` non-null values (``min_periods``).
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barwright.functions.scalar import safe_ratio
from barwright.operators.scan import chunked, columns_step, ewm, in_blocks, index_rows, indexed, over_blocks, running

BY, ORDER = ["symbol"], ["ts"]
#: How a rolling statistic is taken over a frame.
STATS = {
    "mean": F.avg,
    "std": F.stddev_samp,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "skew": lambda c: F.skewness(c) * F.sqrt(F.count(c) * (F.count(c) - 1)) / (F.count(c) - 2),
}


def _over(expr_of, c: Column, w, n: int, least: int) -> Column:
    """A statistic over the last ``n`` rows, null for fewer than ``least`` values."""
    f = w.rowsBetween(-(n - 1), 0)
    count = F.count(c).over(f)
    if expr_of == "skew":
        value = F.when(count > 2, F.try_divide(F.skewness(c).over(f) * F.sqrt(count * (count - 1)), count - 2))
    else:
        value = STATS[expr_of](c).over(f)
    return F.when(count >= least, value)


def rolling(df: DataFrame, columns: dict[str, tuple[str | Column, str, int]], by=BY, order=ORDER, min_periods: int | None = None, size: int | None = None) -> DataFrame:
    """Add ``{name: (column, statistic, n)}``; statistics: mean, std (sample), sum, min, max, skew (bias-corrected)."""
    made = {}
    for name, (c, stat, n) in columns.items():
        made[name] = _maker(F.col(c) if isinstance(c, str) else c, stat, n, min_periods or n)
    return over_blocks(df, made, by, order, before=max(n for _, _, n in columns.values()), size=size)


def _maker(c: Column, stat: str, n: int, least: int):
    return lambda w: _over(stat, c, w, n, least)


def _shift_maker(c: str, kind: str, k: int):
    c = F.col(c)
    before = lambda w: F.lag(c, k).over(w)
    return {
        "lag": before, "lead": lambda w: F.lead(c, k).over(w), "diff": lambda w: c - before(w),
        "pct": lambda w: safe_ratio(c, before(w)) - 1, "log": lambda w: F.ln(safe_ratio(c, before(w))),
    }[kind]


def shift_step(columns: dict[str, tuple[str, str, int]]):
    return columns_step({n: _shift_maker(*v) for n, v in columns.items()})


def shifted(df: DataFrame, columns: dict[str, tuple[str, str, int]], by=BY, order=ORDER) -> DataFrame:
    """Add ``{name: (column, kind, k)}`` with kind ``lag``, ``lead``, ``diff``, ``pct`` or ``log``."""
    k = max(k for _, _, k in columns.values())
    lead = max([k for _, kind, k in columns.values() if kind == "lead"], default=0)
    return in_blocks(df, [shift_step(columns)], by, order, before=k, after=lead)


def sma(df: DataFrame, c: str, n: int, out: str | None = None, **keys) -> DataFrame:
    return rolling(df, {out or f"sma_{n}": (c, "mean", n)}, **keys)


def ema(df: DataFrame, c: str, span: int, seed: str = "first", out: str | None = None, by=BY, order=ORDER) -> DataFrame:
    return ewm(df, {out or f"ema_{span}": (c, 2 / (span + 1))}, by, order, seed, span)


def rma(df: DataFrame, c: str, n: int, out: str, by=BY, order=ORDER) -> DataFrame:
    """Wilder's mean, ``alpha = 1/n``, from the first value on."""
    return ewm(df, {out: (c, 1 / n)}, by, order)


def rsi_means(c: str = "close", n: int = 14) -> dict:
    """Columns for ``ewm`` (with ``back=(c,)``) from which ``rsi_of`` takes its value: means of rises and of falls."""
    rise = lambda now, was: F.when(was[c].isNotNull() & now[c].isNotNull(), F.greatest(now[c] - was[c], F.lit(0.0)))
    return {"_g": (rise, 1 / n), "_l": (lambda now, was: rise(was, now), 1 / n)}


def rsi_of(df: DataFrame, n: int = 14) -> DataFrame:
    return df.withColumn(f"rsi_{n}", 100 * safe_ratio(F.col("_g"), F.col("_g") + F.col("_l"))).drop("_g", "_l")


def rsi(df: DataFrame, c: str = "close", n: int = 14, by=BY, order=ORDER) -> DataFrame:
    """``rsi_{n}``: 100 G/(G + L) of Wilder means of rises and falls; null in a key's first row or where both are 0."""
    return rsi_of(ewm(df, rsi_means(c, n), by, order, back=(c,)), n)


def macd(df: DataFrame, c: str = "close", fast: int = 12, slow: int = 26, signal: int = 9, by=BY, order=ORDER) -> DataFrame:
    """``macd, macd_signal, macd_hist`` of first-value-seeded exponential means."""
    both = ewm(chunked(df, by, order), {"_f": (c, 2 / (fast + 1)), "_s": (c, 2 / (slow + 1))}, by, order)
    line = both.withColumn("macd", F.col("_f") - F.col("_s")).drop("_f", "_s")
    made = ewm(line, {"macd_signal": ("macd", 2 / (signal + 1))}, by, order).withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))
    return made if "_ck" in df.columns else made.drop("_ck")


def bbands(df: DataFrame, c: str = "close", n: int = 20, k: float = 2.0, ddof: int = 1, **keys) -> DataFrame:
    """``bb_low, bb_mid, bb_high, bb_width`` (percent of the middle) and ``bb_pos``; sample deviation unless ``ddof=0``."""
    out = rolling(df, {"bb_mid": (c, "mean", n), "_sd": (c, "std", n)}, **keys)
    sd = F.col("_sd") * (1.0 if ddof else math.sqrt((n - 1) / n))
    out = out.withColumns({"bb_low": F.col("bb_mid") - k * sd, "bb_high": F.col("bb_mid") + k * sd}).drop("_sd")
    width = F.col("bb_high") - F.col("bb_low")
    return out.withColumns({"bb_width": 100 * safe_ratio(width, F.col("bb_mid")), "bb_pos": safe_ratio(F.col(c) - F.col("bb_low"), width)})


def _range(now, was) -> Column:
    """True range of a bar; high minus low without a bar before."""
    return F.greatest(now["high"] - now["low"], F.abs(now["high"] - was["close"]), F.abs(now["low"] - was["close"]))


def true_range(df: DataFrame, by=BY, order=ORDER, out: str = "true_range") -> DataFrame:
    """High minus low in a key's first row, else the widest of the three ranges."""
    bar = F.struct("high", "low", "close")
    return over_blocks(df, {out: lambda w: _range(bar, F.lag(bar).over(w))}, by, order, before=1)


def atr(df: DataFrame, n: int = 14, by=BY, order=ORDER) -> DataFrame:
    """``atr_{n}``, Wilder's mean of the true range, and ``atr_ratio_{n}``, its share of the close."""
    made = true_range(df, by, order, "atr_1") if n == 1 else ewm(df, {f"atr_{n}": (_range, 1 / n)}, by, order, back=("high", "low", "close"))
    return made.withColumn(f"atr_ratio_{n}", F.col(f"atr_{n}") / (F.col("close") + 1e-9))


def adx(df: DataFrame, n: int = 14, by=BY, order=ORDER) -> DataFrame:
    """``plus_di, minus_di, adx``: Wilder's directional movement, all means from their first value on."""
    up, down = (lambda now, was: now["high"] - was["high"]), (lambda now, was: was["low"] - now["low"])

    def movement(mine, other):
        known = lambda now, was: F.when(up(now, was).isNotNull(), 0.0)
        return lambda now, was: F.when((mine(now, was) > other(now, was)) & (mine(now, was) > 0), mine(now, was)).otherwise(known(now, was))

    ranged = lambda now, was: F.when(up(now, was).isNotNull(), _range(now, was))
    means = ewm(chunked(df, by, order), {"_p": (movement(up, down), 1 / n), "_m": (movement(down, up), 1 / n), "_t": (ranged, 1 / n)}, by, order, back=("high", "low", "close"))
    made = means.withColumns({"plus_di": 100 * safe_ratio(F.col("_p"), F.col("_t")), "minus_di": 100 * safe_ratio(F.col("_m"), F.col("_t"))})
    dx = 100 * safe_ratio(F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di"))
    return ewm(made, {"adx": (dx, 1 / n)}, by, order).drop("_p", "_m", "_t", *([] if "_ck" in df.columns else ["_ck"]))


def volatility(df: DataFrame, n: int = 20, **keys) -> DataFrame:
    """``ret_1``, ``volatility_{n}`` (scaled by the root of n), ``skew_{n}`` and ``momentum_{n}``."""
    r = shifted(indexed(df, keys.get("by", BY), keys.get("order", ORDER)), {"ret_1": ("close", "pct", 1), f"momentum_{n}": ("close", "pct", n)}, **keys)
    made = rolling(r, {"_s": ("ret_1", "std", n), f"skew_{n}": ("ret_1", "skew", n)}, **keys)
    made = made.withColumn(f"volatility_{n}", F.col("_s") * math.sqrt(n)).drop("_s")
    return made if "_ix" in df.columns else made.drop("_ix")


def zscore(df: DataFrame, c: str, n: int, out: str | None = None, **keys) -> DataFrame:
    made = rolling(df, {"_m": (c, "mean", n), "_s": (c, "std", n)}, **keys)
    return made.withColumn(out or f"z_{n}", safe_ratio(F.col(c) - F.col("_m"), F.col("_s"))).drop("_m", "_s")


def smooth_momentum(df: DataFrame, c: str, n: int = 7, out: str = "smooth_momentum", **keys) -> DataFrame:
    """Relative change of the ``n``-row mean."""
    made = rolling(indexed(df, keys.get("by", BY), keys.get("order", ORDER)), {"_m": (c, "mean", n)}, **keys)
    made = shifted(made, {out: ("_m", "pct", 1)}, **keys).drop("_m")
    return made if "_ix" in df.columns else made.drop("_ix")


def rolling_sharpe(df: DataFrame, c: str, n: int = 50, periods: int = 252, **keys) -> DataFrame:
    made = rolling(df, {"_m": (c, "mean", n), "_s": (c, "std", n)}, **keys)
    return made.withColumn(f"sharpe_{n}", safe_ratio(F.col("_m"), F.col("_s")) * math.sqrt(periods)).drop("_m", "_s")


def rolling_corr(df: DataFrame, a: str, b: str, n: int, out: str = "corr", by=BY, order=ORDER) -> DataFrame:
    """Pearson correlation over ``n`` complete pairs; null where either side does not vary."""

    def corr(w):
        f = w.rowsBetween(-(n - 1), 0)
        ok = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(ok, F.col(a)), F.when(ok, F.col(b))
        count = F.count(x).over(f)
        mean = lambda c: F.avg(c).over(f)
        cov = mean(x * y) - mean(x) * mean(y)
        spread = F.sqrt(F.var_pop(x).over(f) * F.var_pop(y).over(f))
        return F.when(count >= n, F.when(spread > 1e-12, F.try_divide(cov, spread)))

    return over_blocks(df, {out: corr}, by, order, before=n)


def choppiness(df: DataFrame, n: int = 14, by=BY, order=ORDER) -> DataFrame:
    wide = true_range(indexed(df, by, order), by, order, "_tr")
    made = rolling(wide, {"_sum": ("_tr", "sum", n), "_hh": ("high", "max", n), "_ll": ("low", "min", n)}, by, order)
    ratio = safe_ratio(F.col("_sum"), F.col("_hh") - F.col("_ll"))
    made = made.withColumn(f"chop_{n}", F.when(ratio > 0, 100 * F.log10(ratio) / math.log10(n))).drop("_tr", "_sum", "_hh", "_ll")
    return made if "_ix" in df.columns else made.drop("_ix")


def perm_entropy(df: DataFrame, c: str, n: int = 60, out: str = "perm_entropy", by=BY, order=ORDER) -> DataFrame:
    """Normalised permutation entropy of order 3, delay 1, over the last ``n`` values (``n - 2`` patterns)."""

    def pattern(w):
        x, y, z = F.lag(c, 2).over(w), F.lag(c, 1).over(w), F.col(c)
        code = (x <= y).cast("int") * 4 + (y <= z).cast("int") * 2 + (x <= z).cast("int")
        return F.when(x.isNotNull() & y.isNotNull() & z.isNotNull(), code)

    def entropy(w):
        f = w.rowsBetween(-(n - 3), 0)
        total = F.count("_code").over(f)
        terms = []
        for code in (0, 1, 2, 5, 6, 7):  # the six orders of three values; 3 and 4 contradict themselves
            p = F.try_divide(F.count(F.when(F.col("_code") == code, 1)).over(f), total)
            terms.append(F.when(p > 0, -p * F.ln(p)).otherwise(0.0))
        return F.when(total >= n - 2, sum(terms) / math.log(6))

    return in_blocks(df, [columns_step({"_code": pattern}), columns_step({out: entropy})], by, order, before=n + 2).drop("_code")


def drawdown(df: DataFrame, equity: str = "equity", by=BY, order=ORDER) -> DataFrame:
    """``peak`` so far and ``drawdown`` from it, at least 0."""
    return running(df, {"peak": ("max", equity)}, by, order).withColumn("drawdown", safe_ratio(F.col("peak") - F.col(equity), F.col("peak")))


def sequences(df: DataFrame, cols: list[str], length: int, horizon: int = 0, by=BY, order=ORDER) -> DataFrame:
    """``past``, the last ``length`` rows as structs, and with a horizon ``future``, the next rows; only full ones stay.

    ``time_idx`` numbers a key's rows from 0.
    """
    row = F.struct(*cols)
    made = {"past": lambda w: F.collect_list(row).over(w.rowsBetween(-(length - 1), 0))}
    if horizon:
        made["future"] = lambda w: F.collect_list(row).over(w.rowsBetween(1, horizon))
    out = over_blocks(indexed(df, by, order), made, by, order, before=length, after=horizon).withColumn("time_idx", F.col("_ix"))
    out = out if "_ix" in df.columns else out.drop("_ix")
    full = F.size("past") == length
    return out.where(full & (F.size("future") == horizon) if horizon else full)


def takens_spread(df: DataFrame, c: str, window: int = 50, dim: int = 3, delay: int = 1, stride: int = 10, history: int = 10, by=BY, order=ORDER) -> DataFrame:
    """Every ``stride``-th full window: ``spread``, the population deviation of distances between its delay vectors,
    ``spread_z`` against the key's earlier spreads (once more than ``history``) and ``unusual`` (above 2)."""
    rows = index_rows(df, by, order).withColumn("_n", F.col("_ix") + 1)
    full = over_blocks(rows, {"_w": lambda w: F.collect_list(c).over(w.rowsBetween(-(window - 1), 0))}, by, order, before=window)
    full = full.where((F.size("_w") == window) & ((F.col("_n") - window) % stride == 0))
    vectors = F.transform(F.sequence(F.lit(0), F.lit(window - 1 - (dim - 1) * delay)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: F.get("_w", (i + j * delay).cast("int"))))
    ready = full.withColumn("_v", vectors)
    square = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    pairs = F.flatten(F.transform("_v", lambda a, i: F.transform(F.slice("_v", i + 2, F.size("_v")), lambda b: F.sqrt(square(a, b)))))
    dist = ready.withColumn("_d", pairs)
    mean = F.aggregate("_d", F.lit(0.0), lambda s, x: s + x) / F.size("_d")
    withm = dist.withColumn("_m", mean)
    var = F.aggregate(F.transform("_d", lambda x: (x - F.col("_m")) * (x - F.col("_m"))), F.lit(0.0), lambda s, x: s + x) / F.size("_d")
    spread = withm.withColumn("spread", F.sqrt(var)).drop("_w", "_v", "_d", "_m", "_n", "_ix")
    # moments of earlier spreads: running sums about the key's mean, which keeps them stable, less the row's own
    key = F.struct(*(F.col(b).alias(f"k{i}") for i, b in enumerate(by)))
    middle = spread.groupBy(key.alias("_km")).agg(F.avg("spread").alias("_mid"))
    off = spread.withColumn("_kk", key).join(middle, F.col("_kk") == F.col("_km")).withColumn("_o", F.col("spread") - F.col("_mid"))
    seen = running(off, {"_n": ("count", "_o"), "_s": ("sum", "_o"), "_q": ("sum", F.col("_o") * F.col("_o"))}, [*by], [*order])
    own = F.coalesce("_o", F.lit(0.0))
    n, s, q = F.col("_n") - F.col("_o").isNotNull().cast("long"), F.col("_s") - own, F.col("_q") - own * own
    mean = F.try_divide(s, n)
    z = F.when(n > history, safe_ratio(F.col("_o") - mean, F.sqrt(F.greatest(F.lit(0.0), F.try_divide(q, n) - mean * mean))))
    made = seen.withColumn("spread_z", z).drop("_kk", "_km", "_mid", "_o", "_n", "_s", "_q")
    return made.withColumn("unusual", F.coalesce(F.col("spread_z") > 2, F.lit(False)))


def _lempel_ziv(symbols: list[int]) -> float:
    """Normalised number of new phrases of a left-to-right parse, at most 1."""
    text, n, count, at = bytes(symbols), len(symbols), 0, 0
    while at < n:
        size = 1
        while at + size <= n and text.find(text[at : at + size], 0, at + size - 1) != -1:
            size += 1
        count += 1
        at += size
    return min(1.0, count * math.log2(n) / n) if n > 1 else 0.0


def lz_complexity(df: DataFrame, c: str, window: int = 100, bins: int = 5, every: int = 10, least: int = 20, by=BY, order=ORDER) -> DataFrame:
    """Every ``every``-th row's ``lz``: Lempel-Ziv complexity of the last ``window`` relative changes cut into equal-width bins.

    Neutral 0.5 for fewer than ``least`` changes; ``compressibility`` is one minus the deflated share of the binned bytes.
    """

    @F.pandas_udf(T.StructType([T.StructField("lz", T.DoubleType()), T.StructField("compressibility", T.DoubleType())]))
    def measure(rows: pd.Series) -> pd.DataFrame:
        import zlib

        import numpy as np

        out = []
        for values in rows:
            x = np.asarray([v for v in values if v is not None], dtype=float)
            if len(x) < least:
                out.append((0.5, 0.0))
                continue
            low, high = x.min(), x.max()
            cut = np.minimum(((x - low) / (high - low) * bins).astype(int), bins - 1) if high > low else np.zeros(len(x), dtype=int)
            raw = bytes(cut.tolist())
            out.append((_lempel_ziv(cut.tolist()), max(0.0, 1 - len(zlib.compress(raw)) / len(raw))))
        return pd.DataFrame(out, columns=["lz", "compressibility"])

    rows = index_rows(df, by, order).withColumn("_n", F.col("_ix") + 1)
    moves = shifted(rows, {"_r": (c, "pct", 1)}, by, order)
    full = over_blocks(moves, {"_w": lambda w: F.collect_list("_r").over(w.rowsBetween(-(window - 1), 0))}, by, order, before=window)
    return full.where(F.col("_n") % every == 0).withColumn("_z", measure("_w")).withColumns({"lz": F.col("_z.lz"), "compressibility": F.col("_z.compressibility")}).drop("_n", "_r", "_w", "_z", "_ix")


def risk_multiplier(complexity: str | Column, kind: str = "inverse", low: float = 0.1, high: float = 1.0) -> Column:
    """Exposure for a complexity of 0 to 1: falling in a line, exponentially, or in steps at 0.3 and 0.7."""
    x = F.col(complexity) if isinstance(complexity, str) else complexity
    if kind == "inverse":
        return high - (high - low) * x
    if kind == "exponential":
        return F.greatest(F.lit(low), high * F.exp(-2.0 * x))
    return F.when(x < 0.3, high).when(x < 0.7, 0.5).otherwise(low)

