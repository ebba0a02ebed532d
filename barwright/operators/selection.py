"""Exact order statistics without sorting: mergeable sketches bound them, counts narrow the bounds, few rows are ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points that a sketch is asked for; each pass leaves some three of so many parts of the candidates.
GRID = 256
#: Rank error of a sketch, as a share of its rows: an eighth of a part.
ACCURACY = GRID * 8
PASSES = 2


def _key(by: list[str]) -> Column:
    """The key as one column that is never null."""
    return F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(by))) if by else F.struct(F.lit(0).alias("k0"))


def ranked_values(rows: DataFrame, wanted: DataFrame, passes: int = PASSES, few_keys: bool = False) -> DataFrame:
    """``_k, name, rank, value``: the value at place ``rank`` (from 0, ascending) of ``rows(_k, v)``, for each row ``_k, name, rank`` of ``wanted``.

    ``v`` is a double without nulls; NaN is the largest. Each of ``passes`` passes sketches the
    candidates of a rank and keeps the parts around it; the last one counts the distinct values left, of
    which a window finds the rank. All passes are map-side combined aggregates over ``rows``. ``few_keys`` says that ``wanted``
    has a few rows by construction, so that bounds are broadcast.
    """
    side = F.broadcast if few_keys else (lambda d: d)
    share = F.array(*(F.lit(i / GRID) for i in range(GRID + 1)))
    # bounds are inclusive, null is none; NaN compares as the largest value in Spark
    bounds = wanted.withColumns({"low": F.lit(None).cast("double"), "high": F.lit(None).cast("double")})
    inside = lambda v: (F.col("low").isNull() | (v >= F.col("low"))) & (F.col("high").isNull() | (v <= F.col("high")))
    for _ in range(passes):
        met = rows.join(side(bounds.withColumnRenamed("_k", "_kb")), F.col("_k") == F.col("_kb"))
        own = F.when(inside(F.col("v")), F.col("v"))
        parts = met.groupBy("_k", "name", "rank", "low", "high").agg(
            F.count(F.when(F.col("v") < F.col("low"), 1)).alias("below"), F.count(own).alias("n"), F.approx_percentile(own, share, ACCURACY).alias("grid"), F.min(own).alias("least"), F.max(own).alias("most"),
        )
        at = F.floor((F.col("rank") - F.col("below")) * GRID / F.col("n")).cast("int")
        # the part that holds the rank and its neighbours, and a place more for very few candidates
        narrow = parts.withColumns({"_low": F.get("grid", at - 2), "_high": F.get("grid", at + 3)})
        low, high = F.when(at >= 2, F.col("_low")).otherwise(F.col("least")), F.when(at + 3 <= GRID, F.col("_high")).otherwise(F.col("most"))
        few = F.col("n") <= ACCURACY
        bounds = narrow.select("_k", "name", "rank", F.when(few, F.col("least")).otherwise(low).alias("low"), F.when(few, F.col("most")).otherwise(high).alias("high"))
    met = rows.join(side(bounds.withColumnRenamed("_k", "_kb")), F.col("_k") == F.col("_kb"))
    spot = F.when(F.col("v") < F.col("low"), F.struct(F.lit(None).cast("double").alias("v"))).when(inside(F.col("v")), F.struct("v"))
    counted = met.withColumn("spot", spot).where("spot is not null").groupBy("_k", "name", "rank", "spot").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("_k", "name").orderBy(F.col("spot.v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    return counted.withColumn("upto", upto).where(F.col("upto") > F.col("rank")).groupBy("_k", "name", "rank").agg(F.min("spot.v").alias("value"))


def quantiles(df: DataFrame, columns: dict[str, tuple[str | Column, float]], by: list[str], passes: int = PASSES) -> DataFrame:
    """One row per key with ``{name: (column, q)}``: exact quantiles with linear interpolation, nulls left out; null for a key without values."""
    keyed = df.withColumn("_k", _key(by))
    sources: dict[str, list[str]] = {}
    for name, (c, _) in columns.items():
        sources.setdefault(str(c), []).append(name)
    out = keyed.select("_k").distinct()
    for names in sources.values():
        column = columns[names[0]][0]
        rows = keyed.select("_k", (F.col(column) if isinstance(column, str) else column).cast("double").alias("v")).where("v is not null")
        sizes = rows.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
        asked = F.array(*(F.struct(F.lit(n).alias("name"), ((F.col("_n") - 1) * F.lit(columns[n][1])).alias("h")) for n in names))
        places = sizes.select("_k", F.explode(asked).alias("a")).select("_k", "a.name", "a.h")
        both = places.select("_k", F.explode(F.array(*(F.struct(F.concat("name", F.lit(f"/{i}")).alias("name"), (r(F.col("h"))).cast("bigint").alias("rank")) for i, r in enumerate((F.floor, F.ceil))))).alias("a")).select("_k", "a.*")
        found = ranked_values(rows, both, passes, few_keys=not by).groupBy("_k").pivot("name", [f"{n}/{i}" for n in names for i in (0, 1)]).agg(F.first("value"))
        part = lambda n: (F.col("_n") - 1) * F.lit(columns[n][1]) - F.floor((F.col("_n") - 1) * F.lit(columns[n][1]))
        value = {n: F.when(part(n) == 0, F.col(f"`{n}/0`")).otherwise(F.col(f"`{n}/0`") + part(n) * (F.col(f"`{n}/1`") - F.col(f"`{n}/0`"))) for n in names}
        done = found.join(sizes.withColumnRenamed("_k", "_kn"), F.col("_k") == F.col("_kn")).select(F.col("_k").alias("_kv"), *(v.alias(n) for n, v in value.items()))
        out = out.join(done, F.col("_k") == F.col("_kv"), "left").drop("_kv")
    return out.select(*(F.col(f"_k.k{i}").alias(c) for i, c in enumerate(by)), *columns)
