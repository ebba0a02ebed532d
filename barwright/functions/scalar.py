"""Scalar column functions: protected arithmetic, symbols, identifiers, times and nested access."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of a timeframe's unit letter.
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


# math ------------------------------------------------------------------------------------------


def protected_div(a, b, eps: float = 1e-6, inclusive: bool = False) -> Column:
    """``a / b``, or 1 where ``abs(b)`` is below ``eps`` (or equal, if ``inclusive``)."""
    a, b = _c(a), _c(b)
    small = F.abs(b) <= eps if inclusive else F.abs(b) < eps
    return F.when(small, F.lit(1.0)).otherwise(F.try_divide(a, b))


def protected_sqrt(x) -> Column:
    return F.sqrt(F.abs(_c(x)))


def protected_log(x, eps: float = 1e-3) -> Column:
    """Log of the absolute value; 0 within ``eps`` of zero."""
    size = F.abs(_c(x))
    return F.when(size <= eps, F.lit(0.0)).otherwise(F.ln(F.greatest(size, F.lit(eps))))


def protected_inv(x, eps: float = 1e-3) -> Column:
    x = _c(x)
    return F.when(F.abs(x) <= eps, F.lit(0.0)).otherwise(F.try_divide(F.lit(1.0), x))


def clip(x, low: float, high: float) -> Column:
    """``x`` within [low, high]; null stays null."""
    x = _c(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def finite(x) -> Column:
    """``x`` as a double, null where it is NaN or infinite."""
    x = _c(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def safe_ratio(a, b) -> Column:
    return F.try_divide(_c(a), _c(b))


def softmax(values: Column) -> Column:
    """Softmax of an array column, shifted by its maximum."""
    top = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.transform(values, lambda x: F.exp(x - top) / total)


#: Coefficients of the five-term polynomial for the normal distribution function (fixed values of the published approximation).
PHI_P = 0.2316419
PHI_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_cdf(x) -> Column:
    """Standard normal distribution function to about 7.5e-8."""
    x = _c(x)
    t = 1.0 / (1.0 + PHI_P * F.abs(x))
    poly = t * (PHI_B[0] + t * (PHI_B[1] + t * (PHI_B[2] + t * (PHI_B[3] + t * PHI_B[4]))))
    upper = F.exp(-x * x / 2.0) * (0.3989422804014327) * poly
    return F.when(x >= 0, 1.0 - upper).otherwise(upper)


# comparisons and logic as 0/1 signals --------------------------------------------------------------


def gt(a, b) -> Column:
    return (_c(a) > _c(b)).cast("int")


def lt(a, b) -> Column:
    return (_c(a) < _c(b)).cast("int")


def both(a, b) -> Column:
    return ((_c(a) != 0) & (_c(b) != 0)).cast("int")


def either(a, b) -> Column:
    return ((_c(a) != 0) | (_c(b) != 0)).cast("int")


def negate(a) -> Column:
    return (_c(a) == 0).cast("int")


# strings --------------------------------------------------------------------------------------------


def clean_symbol(x) -> Column:
    """``BTC/USDT:USDT`` to ``BTCUSDT``."""
    return F.replace(F.split_part(_c(x), F.lit(":"), F.lit(1)), F.lit("/"), F.lit(""))


def identifier(x) -> Column:
    """A formula as an identifier: runs of other characters become one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(_c(x), "[^A-Za-z0-9]+", "_"), "^_|_$", "")


# times ----------------------------------------------------------------------------------------------


def from_epoch_ms(x) -> Column:
    return F.timestamp_millis(_c(x))


def from_epoch_s(x) -> Column:
    return F.timestamp_seconds(_c(x))


def day_of(x) -> Column:
    return F.date_trunc("day", _c(x))


def to_utc(x, zone: str = "GMT") -> Column:
    return F.to_utc_timestamp(_c(x), zone)


def minutes_between(later, earlier) -> Column:
    """Minutes as a double, to the microsecond; negative where ``later`` is earlier."""
    return (F.unix_micros(_c(later).cast("timestamp")) - F.unix_micros(_c(earlier).cast("timestamp"))) / F.lit(60e6)


def timeframe_seconds(tf: str) -> int:
    """``15m`` to 900."""
    return int(tf[:-1]) * UNIT_SECONDS[tf[-1]]


# nested ---------------------------------------------------------------------------------------------


def nested(column: str, path: str, kind: str, default=None) -> Column:
    """A value at a JSON path of a string column, cast, with a default where it is absent or not castable."""
    found = F.get_json_object(F.col(column), path).try_cast(kind)
    return found if default is None else F.coalesce(found, F.lit(default))


def sum_levels(levels, field: str, n: int) -> Column:
    """Sum of ``field`` over the first ``n`` structs of an array; 0 for none."""
    return F.aggregate(F.slice(_c(levels), 1, n), F.lit(0.0), lambda s, x: s + x[field])
