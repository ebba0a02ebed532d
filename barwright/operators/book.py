"""Order books: rebuilding from messages, level measures, flow features and fills.

A book is a row with ``bids`` (best, i.e. highest, first) and ``asks`` (lowest first), arrays of
``struct(price, qty)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions.scalar import finite, safe_ratio, sum_levels
from barwright.operators.clean import fill
from barwright.operators.scan import carried, chunked, earlier, ewm, over_blocks


def book_asof(messages: DataFrame, at=None, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Books from level messages ``by, ts, u, pos, type, side, price, qty`` up to time ``at`` (all if None).

    The latest snapshot resets a book; later deltas replace a level, a quantity of 0 deletes it. Updates
    before a book's first snapshot are ignored, as are levels without a price. Keys without a snapshot have no row.
    """
    seen = messages if at is None else messages.where(F.col("ts") <= F.lit(at))
    keys = [*by]
    last = seen.where("type = 'snapshot'").groupBy(*keys).agg(F.max("u").alias("_s"))
    # a level's last snapshot row and last delta, whichever is live: messages fold before they meet their key's snapshot
    latest = lambda kind: F.max(F.when(kind, F.struct("u", "pos", "qty")))
    reset = F.coalesce(F.col("type") == "snapshot", F.lit(False))
    ends = seen.where("price is not null").groupBy(*keys, "side", "price").agg(latest(reset).alias("_a"), latest(~reset).alias("_b"))
    live = F.when(F.col("_b.u") > F.col("_s"), F.col("_b.qty")).when(F.col("_a.u") == F.col("_s"), F.col("_a.qty"))
    levels = ends.join(last, keys).select(*keys, "side", "price", live.alias("qty")).where("qty > 0")
    return pack(levels, by)


def pack(levels: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Books from long rows ``by, side (bid/ask), price, qty``; an empty side is an empty array."""
    side = lambda s: F.collect_list(F.when(F.col("side") == s, F.struct("price", "qty")))
    made = levels.groupBy(*by).agg(F.sort_array(side("bid"), asc=False).alias("bids"), F.sort_array(side("ask")).alias("asks"))
    return made


def unpack(books: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Long rows ``by, side, level (from 0), price, qty`` of books."""
    keep = [*by]
    one = lambda s, c: books.select(*keep, F.lit(s).alias("side"), F.posexplode(c).alias("level", "l")).select(*keep, "side", "level", "l.price", "l.qty")
    return one("bid", "bids").unionByName(one("ask", "asks"))


def widen(books: DataFrame, depth: int, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Wide columns ``bid_p_i, bid_v_i, ask_p_i, ask_v_i``; missing levels are null."""
    columns = []
    for i in range(depth):
        for name, c in (("bid", "bids"), ("ask", "asks")):
            level = F.get(c, F.lit(i))
            columns += [level["price"].alias(f"{name}_p_{i}"), level["qty"].alias(f"{name}_v_{i}")]
    return books.select(*by, *columns)


def narrow(wide: DataFrame, depth: int, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Books from wide columns; levels without a price are left out."""
    side = lambda n: F.filter(F.array(*(F.struct(finite(f"{n}_p_{i}").alias("price"), finite(f"{n}_v_{i}").alias("qty")) for i in range(depth))), lambda x: x["price"].isNotNull())
    return wide.select(*by, side("bid").alias("bids"), side("ask").alias("asks"))


def bbo(books: DataFrame) -> DataFrame:
    """Adds ``bid, ask, mid, spread``; null where a side is empty."""
    bid, ask = F.get("bids", F.lit(0))["price"], F.get("asks", F.lit(0))["price"]
    return books.withColumns({"bid": bid, "ask": ask, "mid": (bid + ask) / 2, "spread": ask - bid})


def imbalance(books: DataFrame, depth: int = 10) -> DataFrame:
    """Adds ``obi`` (bid share of the first ``depth`` levels' quantity, 0.5 for an empty side) and ``rel_spread`` (0 then)."""
    b, a = sum_levels("bids", "qty", depth), sum_levels("asks", "qty", depth)
    bid, ask = F.get("bids", F.lit(0))["price"], F.get("asks", F.lit(0))["price"]
    ok = (F.size("bids") > 0) & (F.size("asks") > 0)
    return books.withColumns({"obi": F.when(ok & (b + a > 0), safe_ratio(b, b + a)).otherwise(0.5), "rel_spread": F.when(ok, F.coalesce(safe_ratio(ask - bid, (ask + bid) / 2), F.lit(0.0))).otherwise(0.0)})


def signed_pressure(books: DataFrame, depth: int = 10) -> DataFrame:
    """Adds ``pressure_l1`` and ``voi``: (bid - ask)/(bid + ask) of best and of ``depth`` levels' quantity, 0 for none."""
    made = {}
    for name, n in (("pressure_l1", 1), ("voi", depth)):
        b, a = sum_levels("bids", "qty", n), sum_levels("asks", "qty", n)
        made[name] = F.coalesce(safe_ratio(b - a, b + a), F.lit(0.0))
    return books.withColumns(made)


def pressure_density(books: DataFrame, depth: int = 5, tick: float = 0.01) -> DataFrame:
    """Adds ``book_pressure`` (bid share of ``depth`` levels, 0.5 for none) and ``density`` (quantity per ticked level)."""
    b, a = sum_levels("bids", "qty", depth), sum_levels("asks", "qty", depth)
    levels = F.least(F.size("bids"), F.lit(depth)) + F.least(F.size("asks"), F.lit(depth))
    return books.withColumns({"book_pressure": F.coalesce(safe_ratio(b, b + a), F.lit(0.5)), "density": F.coalesce(safe_ratio(b + a, levels * tick), F.lit(0.0))})


def static_ofi(bid_qty: str, ask_qty: str) -> Column:
    return F.coalesce(safe_ratio(F.col(bid_qty) - F.col(ask_qty), F.col(bid_qty) + F.col(ask_qty)), F.lit(0.0))


def top_of_book(books: DataFrame) -> DataFrame:
    """Adds ``bid_p, bid_v, ask_p, ask_v`` of the best levels."""
    b, a = F.get("bids", F.lit(0)), F.get("asks", F.lit(0))
    return books.withColumns({"bid_p": b["price"], "bid_v": b["qty"], "ask_p": a["price"], "ask_v": a["qty"]})


def ofi(tops: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds ``ofi_l1``: flow of the best levels against the row before; 0 in a key's first row."""

    def flow(w):
        bp, bv, ap, av = (F.lag(c).over(w) for c in ("bid_p", "bid_v", "ask_p", "ask_v"))
        bid = F.when(F.col("bid_p") > bp, F.col("bid_v")).when(F.col("bid_p") == bp, F.col("bid_v") - bv).when(F.col("bid_p") < bp, -bv).otherwise(0.0)
        ask = F.when(F.col("ask_p") < ap, F.col("ask_v")).when(F.col("ask_p") == ap, F.col("ask_v") - av).when(F.col("ask_p") > ap, -av).otherwise(0.0)
        return F.coalesce(bid - ask, F.lit(0.0))

    return over_blocks(tops, {"ofi_l1": flow}, by, order, before=1)


def l1_features(tops: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds ``bpr_l1`` (bid to ask quantity), ``wmp`` (quantity-weighted mid) and ``spread_l1``; gaps carry the last value, else 0."""
    made = tops.withColumns({
        "bpr_l1": safe_ratio(F.col("bid_v"), F.col("ask_v")),
        "wmp": safe_ratio(F.col("bid_p") * F.col("ask_v") + F.col("ask_p") * F.col("bid_v"), F.col("bid_v") + F.col("ask_v")),
        "spread_l1": F.col("ask_p") - F.col("bid_p"),
    })
    names = ["bpr_l1", "wmp", "spread_l1"]
    return fill(made, names, "ffill", by, order).fillna(0.0, names)


def tick_signs(ticks: DataFrame, price: str = "price", by=("symbol",), order=("ts",)) -> DataFrame:
    """Adds ``tick_sign``: the tick rule, carried over equal prices, +1 in a key's first row and next to a missing price."""
    by, order = [*by], [*order]
    w = Window.partitionBy("_ck").orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    sign = lambda now, was: F.when((now - was).isNull() | (now > was), 1.0).when(now < was, -1.0)
    rows = chunked(ticks, by, order).withColumn("_r", F.row_number().over(w))
    rows = rows.withColumn("_s", F.when(F.col("_r") > 1, sign(F.col(price), F.lag(price).over(w))))
    totals = [F.min_by(price, "_r").alias("_top"), F.max_by(F.col(price), F.col("_r")).alias("_end"), F.max_by("_s", F.when(F.col("_s").isNotNull(), F.col("_r"))).alias("_last")]
    across = [
        {"_edge": lambda w: sign(F.col("_top"), F.lag("_end").over(w))},  # of a chunk's first row, against the chunk before
        {"_edge": lambda w: F.coalesce("_edge", F.last(F.coalesce("_last", "_edge"), ignorenulls=True).over(earlier(w)))},
    ]
    made = carried(rows, totals, across, by).withColumn("tick_sign", F.coalesce(F.last("_s", ignorenulls=True).over(upto), "_edge"))
    return made.drop("_r", "_s", "_edge", *([] if "_ck" in ticks.columns else ["_ck"]))


def flow_means(qty: str = "qty", span: int = 30) -> dict:
    """Columns for ``ewm`` over ``tick_signs`` from which ``flow_of`` takes its value: means of signed and of all volume."""
    return {"_a": (F.col("tick_sign") * F.col(qty), 2 / (span + 1)), "_b": (F.col(qty), 2 / (span + 1))}


def flow_of(df: DataFrame) -> DataFrame:
    return df.withColumn("tfi", F.coalesce(safe_ratio(F.col("_a"), F.col("_b")), F.lit(0.0))).drop("_a", "_b")


def trade_flow(ticks: DataFrame, price: str = "price", qty: str = "qty", span: int = 30, by=("symbol",), order=("ts",)) -> DataFrame:
    """Adds ``tick_sign`` (tick rule, carried over equal prices, first +1) and ``tfi``, signed over total mean volume."""
    by, order = [*by], [*order]
    made = flow_of(ewm(tick_signs(chunked(ticks, by, order), price, by, order), flow_means(qty, span), by, order))
    return made if "_ck" in ticks.columns else made.drop("_ck")


def mce_proxies(df: DataFrame, ofi_col: str = "ofi_l1", spread: str = "spread_l1", n: int = 60, by=("symbol",), order=("ts",)) -> DataFrame:
    """Adds ``mce_skew`` (exponential mean of flow) and ``mce_pressure`` (rolling spread deviation, 0 for one row)."""
    by, order = [*by], [*order]
    made = ewm(df, {"mce_skew": (ofi_col, 2 / (n + 1))}, by, order)
    return over_blocks(made, {"mce_pressure": lambda w: F.coalesce(F.stddev_samp(spread).over(w.rowsBetween(-(n - 1), 0)), F.lit(0.0))}, by, order, before=n)


def bar_proxies(bars: DataFrame, n: int = 50, by=("symbol",), order=("ts",)) -> DataFrame:
    """Order-flow stand-ins from bars alone: ``ofi_proxy`` (z-score of signed volume), ``pressure_proxy`` (range over close) and ``liquidity_proxy`` (volume over range)."""
    by, order = [*by], [*order]

    def z(w):
        f = w.rowsBetween(-(n - 1), 0)
        return F.when(F.count("_sv").over(f) >= n, safe_ratio(F.col("_sv") - F.avg("_sv").over(f), F.stddev_samp("_sv").over(f)))

    signed = over_blocks(bars, {"_sv": lambda w: F.coalesce(F.signum(F.col("close") - F.lag("close").over(w)), F.lit(0.0)) * F.col("volume")}, by, order, before=1)
    made = over_blocks(signed, {"ofi_proxy": z}, by, order, before=n)
    width = F.col("high") - F.col("low")
    made = made.withColumns({"pressure_proxy": safe_ratio(width, F.col("close")), "liquidity_proxy": safe_ratio(F.col("volume"), width)}).drop("_sv")
    return fill(made, ["ofi_proxy", "liquidity_proxy"], "ffill", by, order).fillna(0.0, ["ofi_proxy", "pressure_proxy", "liquidity_proxy"])


def walk_book(orders: DataFrame, books: DataFrame, by: tuple[str, ...] = ("symbol",), order_id: str = "order_id") -> DataFrame:
    """Fills of market orders ``by, order_id, side (buy/sell), want`` against books: ``filled, vwap, slippage_bps`` against the mid.

    Partial fills are kept, orders without any fill have no row.
    """
    met = orders.join(bbo(books), [*by])
    side = F.when(F.col("side") == "buy", F.col("asks")).otherwise(F.col("bids"))
    levels = met.select(*by, order_id, "side", "want", "mid", F.posexplode(side).alias("level", "l"))
    before = F.coalesce(F.sum("l.qty").over(Window.partitionBy(*by, order_id).orderBy("level").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    taken = levels.withColumn("_take", F.greatest(F.lit(0.0), F.least(F.col("l.qty"), F.col("want") - before)))
    done = taken.groupBy(*by, order_id, "side", "mid").agg(F.sum("_take").alias("filled"), F.sum(F.col("_take") * F.col("l.price")).alias("_paid")).where("filled > 0")
    vwap = F.col("_paid") / F.col("filled")
    worse = F.when(F.col("side") == "buy", vwap - F.col("mid")).otherwise(F.col("mid") - vwap)
    return done.select(*by, order_id, "filled", vwap.alias("vwap"), (safe_ratio(worse, F.col("mid")) * 10_000).alias("slippage_bps"))


def sample_last(books: DataFrame, every: str = "10 seconds", by: tuple[str, ...] = ("symbol",), ts: str = "ts") -> DataFrame:
    """The last row of each key and time bucket, with the bucket's start as ``bucket``."""
    rows = books.withColumn("bucket", F.window(F.col(ts).cast("timestamp"), every)["start"])
    best = rows.groupBy(*by, "bucket").agg(F.max_by(F.struct(*books.columns), F.col(ts)).alias("_r"))
    return best.select("bucket", "_r.*")
