"""As-of joins without range conditions: one union, one exchange, one window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions.scalar import minutes_between, timeframe_seconds
from barwright.operators.clean import fill


def asof_join(left: DataFrame, right: DataFrame, on: str = "ts", by: list[str] | None = None, direction: str = "backward", allow_exact: bool = True, suffix: str = "", right_tie: str | None = None, chunk: str | None = None) -> DataFrame:
    """Each left row with the last right row at or before it (``forward``: first at or after it), per key.

    Adds the right columns other than the keys (with ``suffix``), and the matched time as ``{on}_right``.
    Rows of a null key or time match nothing but stay. Right rows that tie in time: the greatest
    ``right_tie`` (smallest for ``forward``) wins. With ``chunk`` (such as ``"day"``), keys are also dealt
    by time chunk, and the last row before a chunk is carried in, so that a few long keys still spread;
    without a key that is by day at least.
    """
    by = by or []
    chunk = chunk or (None if by else "day")
    back = direction == "backward"
    values = [c for c in right.columns if c not in by and c != on]
    packed = F.struct(F.col(on).alias(f"{on}_right"), *(F.col(c).alias(c + suffix) for c in values))
    tie = F.col(right_tie) if right_tie else F.lit(None).cast("int")
    usable = F.col(on).isNotNull()
    for c in by:
        usable = usable & F.col(c).isNotNull()
    r = right.where(usable).select(*by, F.col(on).cast("timestamp").alias("_t"), F.lit(0 if allow_exact == back else 1).alias("_side"), tie.alias("_tie"), packed.alias("_r"), F.lit(None).cast(left.schema).alias("_l"))
    whole = F.struct(*(F.col(c) for c in left.columns))
    l_side = F.lit(1 if allow_exact == back else 0)
    left_rows = left.select(*by, F.col(on).cast("timestamp").alias("_t"), l_side.alias("_side"), F.lit(None).cast(r.schema["_tie"].dataType).alias("_tie"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), whole.alias("_l"))
    rows = r.unionByName(left_rows)
    keys = [*by]
    if chunk:
        rows = rows.withColumn("_chunk", F.date_trunc(chunk, "_t"))
        edges = rows.groupBy(*by, "_chunk").agg((F.max_by if back else F.min_by)("_r", F.when(F.col("_r").isNotNull(), F.struct("_t", "_tie"))).alias("_e"))
        over = Window.partitionBy(*by).orderBy(F.col("_chunk") if back else F.col("_chunk").desc())
        carried = edges.withColumn("_c", F.last("_e", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)))
        keys.append("_chunk")
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    # forward in falling order: a frame that ends with the key would be gone through again for every row
    w = w.orderBy(*(F.col(c) if back else F.col(c).desc() for c in ("_t", "_side", "_tie")))
    found = F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("_m", found).where("_l is not null")
    if chunk:
        edge = carried.select(*(F.col(c).alias(f"_k_{c}") for c in by), F.col("_chunk").alias("_kc"), "_c")
        same = F.col("_chunk").eqNullSafe(F.col("_kc"))
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        out = out.join(edge, same, "left").withColumn("_m", F.coalesce("_m", "_c"))
    return out.select("_l.*", *(F.when(_usable(by), F.col(f"_m.{n}")).alias(n) for n in r.schema["_r"].dataType.names))


def _usable(by: list[str]):
    ok = F.col("_t").isNotNull()
    for c in by:
        ok = ok & F.col(c).isNotNull()
    return ok


def mtf_align(frames: dict[str, DataFrame], by: list[str], on: str = "ts", availability: str = "close", naming: str = "suffix", drop: tuple[str, ...] = ("open", "high", "low", "close", "volume"), prefixes: dict[str, str] | None = None, chunk: str | None = "day") -> DataFrame:
    """Features of several timeframes on the shortest one's rows.

    Higher timeframes lose the ``drop`` columns, are renamed by suffix ``_{tf}`` (or a prefix) and join
    as of the time they are known: their close (``availability="close"``) or, looking ahead, their open.
    """
    order = sorted(frames, key=timeframe_seconds)
    out = frames[order[0]]
    for tf in order[1:]:
        high = frames[tf].drop(*drop)
        if availability == "close":
            high = high.withColumn(on, F.col(on) + F.expr(f"interval {timeframe_seconds(tf)} seconds"))
        name = (lambda c, tf=tf: f"{c}_{tf}") if naming == "suffix" else (lambda c, tf=tf: f"{(prefixes or {}).get(tf, tf)}_{c}")
        high = high.select(*by, on, *(F.col(c).alias(name(c)) for c in high.columns if c not in [*by, on]))
        out = asof_join(out, high, on, by, chunk=chunk).drop(f"{on}_right")
    return out


def event_flags(df: DataFrame, events: DataFrame, on: str = "ts", blackout_min: float = 60, close_min: float = 30) -> DataFrame:
    """``df`` with ``minutes_to_next`` (infinite if none), ``blackout`` (an event nearer than ``blackout_min``) and ``force_close``.

    Both neighbours come from as-of joins dealt by day, so the calendar may be of any size.
    """
    times = events.select(F.col(on).cast("timestamp").alias(on)).where(f"{on} is not null").distinct()
    after = asof_join(df, times, on, [], "forward", chunk="day").withColumnRenamed(f"{on}_right", "_next")
    around = asof_join(after, times, on, [], "backward", chunk="day").withColumnRenamed(f"{on}_right", "_last")
    ahead = minutes_between("_next", on)
    behind = minutes_between(on, "_last")
    near = F.coalesce(ahead < blackout_min, F.lit(False)) | F.coalesce(behind < blackout_min, F.lit(False))
    return around.withColumns({"minutes_to_next": F.coalesce(ahead, F.lit(float("inf"))), "blackout": near, "force_close": F.coalesce(ahead <= close_min, F.lit(False))}).drop("_next", "_last")


def full_join_filled(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """Full outer join on a time column, then the last known values carried forward."""
    joined = a.join(b, on, "full")
    return fill(joined, [c for c in joined.columns if c != on], "ffill", [], [on])


def new_rows(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose keys are not among the existing ones, each key once."""
    return incoming.dropDuplicates(keys).join(existing.select(*keys).distinct(), keys, "left_anti")
