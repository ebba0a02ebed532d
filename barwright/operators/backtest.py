"""Set-based backtests: every (symbol, run) at once, trades from signal edges, no bar loop."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions.scalar import safe_ratio
from barwright.operators.scan import carried, chunk_table, chunked, earlier, over_chunks, running


@dataclass(frozen=True)
class Costs:
    """Shares of price: ``fee`` per side, ``spread`` and ``slippage`` against the trader; ``atr_slip`` times ATR per fill."""

    fee: float = 0.001
    spread: float = 0.0002
    slippage: float = 0.0001
    atr_slip: float = 0.0


#: The signal that counts at a bar, of structs of this row and the row before (null in a key's first row).
Signal = Callable[[Column, Column], Column]


def _own(signal: str) -> Signal:
    """A bar's own signal; that of a key's first bar does not count."""
    return lambda now, was: F.when(was.isNotNull(), now[signal])


def _states(df: DataFrame, signal: Signal, columns: list[str], by: list[str], order: list[str], chunk: str = "day") -> DataFrame:
    """Adds bar number ``_b``, ``_in`` (enters here), ``_out`` (leaves here), ``_held`` (in position before the bar), trade number
    ``_t``, and structs of ``columns``: ``_prev``, the row before, and ``_entry``, the latest entry's row.

    A chunk of bars is a transition: being in or out before it, and the row before it, decide its first bar's
    signal and whether its first entry is one; all else is its own. So its summary is a few values, and
    a prefix over the table of chunks gives the state, the bars and the trades before each.
    """
    w = Window.partitionBy("_ck").orderBy(*order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    now = F.struct(*columns)
    real = lambda s: F.when(s != 0, s)
    is_on = lambda s: F.coalesce(s == 1, F.lit(False))
    rows = chunked(df, by, order, chunk).withColumn("_r", F.row_number().over(w)).withColumn("_lag", F.lag(now).over(w))
    rows = rows.withColumn("_sig", F.when(F.col("_r") > 1, real(signal(now, F.col("_lag")))))
    # entries of the chunk's later rows if it begins out of position
    rows = rows.withColumn("_own", is_on(F.last("_sig", ignorenulls=True).over(upto)) & ~is_on(F.last("_sig", ignorenulls=True).over(before)))
    some = F.when(F.col("_sig").isNotNull(), F.col("_r"))
    totals = [
        F.count(F.lit(1)).alias("_n"), F.min_by(now, "_r").alias("_top"), F.max_by(now, "_r").alias("_end"), F.min_by("_sig", some).alias("_first"), F.max_by("_sig", some).alias("_last"),
        F.sum(F.col("_own").cast("long")).alias("_ins"), F.max_by(now, F.when(F.col("_own"), F.col("_r"))).alias("_mine"),
    ]
    edge, on, later = F.col("_edge"), is_on(F.col("_state")), F.col("_ins") - (is_on(F.coalesce("_edge", "_state")) & is_on(F.col("_first"))).cast("long")
    opens = is_on(edge) & ~on
    across = [
        {"_before": lambda w: F.lag("_end").over(w)},
        {"_edge": lambda w: real(signal(F.col("_top"), F.col("_before")))},
        {"_state": lambda w: F.last(F.coalesce("_last", "_edge"), ignorenulls=True).over(earlier(w))},
        {"_new": lambda w: later + opens.cast("long"), "_kept": lambda w: F.when(later > 0, F.col("_mine")).when(opens, F.col("_top"))},
        {"_before": lambda w: F.col("_before"), "_edge": lambda w: edge, "_state": lambda w: F.col("_state"), "_bars": lambda w: F.coalesce(F.sum("_n").over(earlier(w)), F.lit(0)), "_trades": lambda w: F.coalesce(F.sum("_new").over(earlier(w)), F.lit(0)), "_kept": lambda w: F.last("_kept", ignorenulls=True).over(earlier(w))},
    ]
    met = carried(rows, totals, across, by)
    met = met.withColumns({"_b": F.col("_bars") + F.col("_r") - 1, "_prev": F.coalesce("_lag", "_before"), "_sig": F.coalesce("_sig", F.when(F.col("_r") == 1, edge))})
    met = met.withColumns({"_on": is_on(F.coalesce(F.last("_sig", ignorenulls=True).over(upto), F.col("_state"))), "_held": is_on(F.coalesce(F.last("_sig", ignorenulls=True).over(before), F.col("_state")))})
    met = met.withColumns({"_in": F.col("_on") & ~F.col("_held"), "_out": ~F.col("_on") & F.col("_held")})
    met = met.withColumns({"_t": F.col("_trades") + F.sum(F.col("_in").cast("long")).over(upto), "_entry": F.coalesce(F.last(F.when(F.col("_in"), now), ignorenulls=True).over(upto), F.col("_kept"))})
    return met.drop("_r", "_lag", "_sig", "_own", "_before", "_edge", "_state", "_bars", "_trades", "_kept", "_on")


def extract_trades(df: DataFrame, signal: str = "signal", by=("symbol",), order=("ts",), chunk: str = "day") -> DataFrame:
    """One row per trade: ``trade, entry_bar, exit_bar`` and their times; an open trade has no exit. The first bar's signal does not count."""
    by, order = [*by], [*order]
    s = _states(df, _own(signal), [signal], by, order, chunk).where("_in or _out")
    trade = F.col("_t")
    pick = lambda c, flag: F.max(F.when(F.col(flag), F.col(c)))
    return s.groupBy(*by, trade.alias("trade")).agg(pick("_b", "_in").alias("entry_bar"), pick("_b", "_out").alias("exit_bar"), pick(order[0], "_in").alias("entry_ts"), pick(order[0], "_out").alias("exit_ts"))


def same_open(df: DataFrame, signal: str = "signal", capital: float = 10_000.0, target: float = 0.1, costs: Costs = Costs(), by=("symbol",), order=("ts",), chunk: str = "day") -> DataFrame:
    """All-in trades at the signal bar's open, marked at closes; one row per key.

    ``final_capital, trades, max_drawdown, time_to_target, bars``. The run stops at the first bar whose
    marked capital reaches ``(1 + target) * capital``; without one, ``time_to_target`` is the number of
    bars. An entry is first marked against its own bar's close.

    Chunks come to sums of log returns, then to what their bars up to their first hit amount to;
    those of a key are folded up to the first chunk with a hit.
    """
    by, order = [*by], [*order]
    s = _states(df, _own(signal), [signal, "open", "close"], by, order, chunk)
    cross = costs.spread + costs.slippage
    paid = F.col("_entry")["open"] * (1 + cross)
    gain = (1 - costs.fee) ** 2 * F.col("open") * (1 - cross) / paid
    w = Window.partitionBy("_ck").orderBy(*order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_log", F.when(F.col("_out"), F.ln(gain)).otherwise(0.0))
    s = carried(s, [F.sum("_log").alias("_sum")], [{"_sum": lambda w: F.coalesce(F.sum("_sum").over(earlier(w)), F.lit(0.0))}], by)
    mark = F.when(F.col("_held"), 1 + (1 - costs.fee) / paid * (F.col("close") - F.col("_entry")["close"])).otherwise(1.0)
    run = s.withColumns({"_was": F.exp(F.col("_sum") + F.coalesce(F.sum("_log").over(before), F.lit(0.0))), "_after": F.exp(F.col("_sum") + F.sum("_log").over(upto))})
    run = run.withColumn("_cap", F.when(F.col("_b") == 0, F.lit(capital)).otherwise(capital * F.col("_was") * mark))
    run = run.withColumn("_hit", F.coalesce((F.col("_cap") >= capital * (1 + target)) & (F.col("_b") > 0), F.lit(False)))
    run = run.withColumn("_done", F.coalesce(F.max("_hit").over(before), F.lit(False)))
    run = run.withColumn("_live", F.when(~F.col("_done"), F.col("_cap"))).withColumn("_peak", F.max("_live").over(upto))
    end = F.when(F.col("_out") & ~F.col("_hit"), capital * F.col("_after")).otherwise(F.col("_cap"))
    # by running peak, as the one before the chunk may be higher: a drawdown is against the higher of both
    records = run.groupBy("_ck", "_peak").agg(
        F.count(F.lit(1)).alias("n"), F.min("_live").alias("low"), F.min(F.when(F.col("_hit"), F.col("_b"))).alias("hit"), F.sum((F.col("_in") & ~F.col("_done") & ~F.col("_hit")).cast("long")).alias("ins"),
        F.max(F.when(~F.col("_done"), F.struct("_b", end.alias("cap")))).alias("end"),
    )
    parts = chunk_table(records.groupBy("_ck").agg(F.sum("n").alias("n"), F.max("_peak").alias("top"), F.collect_list(F.struct("_peak", "low")).alias("records"), F.min("hit").alias("hit"), F.sum("ins").alias("ins"), F.max("end").alias("end")), by)
    over = over_chunks(by)
    parts = parts.withColumns({"peak": F.greatest(F.lit(capital), F.max("top").over(earlier(over))), "over": F.coalesce(F.max(F.col("hit").isNotNull()).over(earlier(over)), F.lit(False))})
    own = lambda c: F.when(~F.col("over"), c)
    top = lambda r: F.greatest(r["_peak"], F.col("peak"))
    deepest = F.array_max(F.transform("records", lambda r: (top(r) - r["low"]) / top(r)))
    names = [F.col(f"_k{i}").alias(c) for i, c in enumerate(by)]
    out = parts.groupBy(*names).agg(
        F.max(own(F.col("end")))["cap"].alias("final_capital"), F.sum(own(F.col("ins"))).alias("trades"), F.max(own(deepest)).alias("max_drawdown"),
        F.coalesce(F.min("hit"), F.sum("n")).cast("long").alias("time_to_target"), F.sum("n").alias("bars"),
    )
    return out.select(*by, "final_capital", "trades", "max_drawdown", "time_to_target", "bars")


def next_open_trades(df: DataFrame, signal: str = "signal", costs: Costs = Costs(), by=("symbol",), order=("ts",), atr: str | None = None, commission_on: float = 0.0, chunk: str = "day") -> DataFrame:
    """Trades filled at the open after the signal: ``trade, entry_bar, exit_bar, entry_price, exit_price, liquidity, forced``.

    Prices include spread, slippage and ATR slippage; ``liquidity`` is the value traded in the entry bar.
    A position that is still open leaves at the last close (``forced``). The last bar's signals find no fill.
    """
    by, order = [*by], [*order]
    slip = F.coalesce(F.col(atr), F.lit(0.0)) * costs.atr_slip if atr else F.lit(0.0)
    cross = costs.spread + costs.slippage
    rows = df.withColumn("_slip", slip)
    filled = lambda now, was: F.when(now["open"].isNotNull(), was[signal])
    placed = _states(rows, filled, [signal, "open", "_slip"], by, order, chunk)
    last = rows.groupBy(*by).agg(F.max_by(F.struct(F.col("close").alias("c"), F.col("_slip").alias("s")), F.struct(*order)).alias("_last"), (F.count(F.lit(1)) - 1).alias("_bars"))
    pick = lambda c, flag: F.max(F.when(F.col(flag), c))
    before = F.col("_prev")["_slip"]
    trades = placed.where("_in or _out").groupBy(*by, F.col("_t").alias("trade")).agg(
        pick(F.col("_b"), "_in").alias("entry_bar"), pick(F.col("_b"), "_out").alias("exit_bar"), pick(F.col("open") * (1 + cross) + before, "_in").alias("entry_price"),
        pick(F.col("open") * (1 - cross) - before, "_out").alias("exit_price"), pick(F.col("volume") * F.col("open"), "_in").alias("liquidity"),
    )
    met = trades.join(last, by)
    forced = F.col("exit_bar").isNull()
    return met.select(*by, "trade", "entry_bar", F.coalesce("exit_bar", "_bars").alias("exit_bar"), "entry_price", F.coalesce("exit_price", F.col("_last.c") * (1 - cross) - F.col("_last.s")).alias("exit_price"), "liquidity", forced.alias("forced"))


#: Trades of a chunk of a key.
CHUNK_TRADES = 50_000


def next_open(trades: DataFrame, capital: float = 10_000.0, fee: float = 0.001, share: float = 0.95, by=("symbol",), chunk: int = CHUNK_TRADES) -> DataFrame:
    """Equity after each trade of ``next_open_trades`` without a liquidity cap: a running product of factors.

    Adds ``ret`` (of the invested value), ``equity`` and ``pnl``.
    """
    ratio = F.col("exit_price") / F.col("entry_price")
    factor = 1 - share * (1 + fee) + share * (1 - fee) * ratio
    grown = trades.withColumns({"ret": ratio * (1 - fee) - (1 + fee), "_f": factor})
    equity = running(grown, {"_g": ("sum", F.ln("_f"))}, [*by], ["trade"], chunk=chunk).withColumn("equity", capital * F.exp("_g"))
    return equity.withColumn("pnl", F.col("equity") - F.col("equity") / F.col("_f")).drop("_f", "_g")


#: Trades whose effects on capital are composed into one map.
RUN_TRADES = 128


def _compose(trades: Column, share: float) -> Column:
    """What a run of trades makes of the capital before it, as ``x, y`` (corners of a piecewise-linear, rising map from 0 on) and the slope ``s`` behind them.

    A trade of return ``r`` multiplies a capital up to ``k`` by ``1 + share r``; beyond ``k``, where its position
    is capped, it adds ``share k r``. So each trade bends the map at the capital that arrives at ``k``, once.
    """
    start = F.struct(F.array(F.lit(0.0)).alias("x"), F.array(F.lit(0.0)).alias("y"), F.lit(1.0).alias("s"))

    def trade(m: Column, t: Column) -> Column:
        grow, k = 1 + share * t["r"], t["k"]
        below = F.size(F.filter(m["y"], lambda y: y <= k))  # the first corner is at 0, so 1 at least
        x, y, n = m["x"], m["y"], F.size(m["x"])
        x0, y0, x1, y1 = F.get(x, below - 1), F.get(y, below - 1), F.get(x, below), F.get(y, below)
        at = x0 + F.when(below < n, (k - y0) * (x1 - x0) / (y1 - y0)).otherwise((k - y0) / m["s"])
        bent = F.struct(
            F.concat(F.slice(x, F.lit(1), below), F.array(at), F.slice(x, below + 1, n)).alias("x"),
            F.concat(F.transform(F.slice(y, F.lit(1), below), lambda v: v * grow), F.array(k * grow), F.transform(F.slice(y, below + 1, n), lambda v: v + share * k * t["r"])).alias("y"), m["s"].alias("s"),
        )
        return F.when(k.isNull(), F.struct(x.alias("x"), F.transform(y, lambda v: v * grow).alias("y"), (m["s"] * grow).alias("s"))).otherwise(bent)

    return F.aggregate(trades, start, trade)


def _mapped(m: Column, cash: Column) -> Column:
    """A composed map's value."""
    below = F.size(F.filter(m["x"], lambda x: x <= cash))
    x0, y0, x1, y1 = F.get(m["x"], below - 1), F.get(m["y"], below - 1), F.get(m["x"], below), F.get(m["y"], below)
    return y0 + F.when(below < F.size(m["x"]), (cash - x0) * (y1 - y0) / (x1 - x0)).otherwise((cash - x0) * m["s"])


def next_open_capped(trades: DataFrame, capital: float = 10_000.0, fee: float = 0.001, share: float = 0.95, participation: float = 0.1, by=("symbol",), run: int = RUN_TRADES) -> DataFrame:
    """As ``next_open``, with each position at most ``participation`` of its entry bar's traded value (of any size where that is null).

    Runs of ``run`` trades come to one piecewise-linear map each, in their own tasks; a pass over a key's
    maps gives the capital before each run, and runs then walk their trades. The table of maps has at most two numbers a
    trade. Invested capital and its fee must be less than the capital, so that no trade loses more.
    """
    if not 0 < share * (1 + fee) < 1 or participation <= 0:
        raise ValueError("share and its fee must be below 1, participation above 0")
    by, own = [*by], F.struct(*trades.columns)
    ret = F.col("exit_price") / F.col("entry_price") * (1 - fee) - (1 + fee)
    dealt = trades.withColumns({"_kk": F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(by))), "_run": F.floor(F.col("trade") / run)})
    each = F.struct(F.col("trade").alias("n"), ret.alias("r"), (F.col("liquidity") * participation / share).alias("k"), own.alias("own"))
    runs = dealt.groupBy("_kk", "_run").agg(F.array_sort(F.collect_list(each)).alias("trades"))
    maps = runs.select("_kk", "_run", _compose(F.col("trades"), share).alias("m")).groupBy("_kk").agg(F.array_sort(F.collect_list(F.struct("_run", "m"))).alias("maps"))
    opened = F.aggregate(
        "maps", F.struct(F.lit(capital).alias("cash"), F.array().cast("array<struct<run:bigint,cash:double>>").alias("out")),
        lambda a, m: F.struct(_mapped(m["m"], a["cash"]).alias("cash"), F.concat(a["out"], F.array(F.struct(m["_run"].alias("run"), a["cash"].alias("cash")))).alias("out")), lambda a: a["out"],
    )
    openings = maps.select(F.col("_kk").alias("_ko"), F.explode(opened).alias("o")).select("_ko", F.col("o.run").alias("_ro"), F.col("o.cash").alias("_open"))
    met = runs.join(openings, (F.col("_kk") == F.col("_ko")) & (F.col("_run") == F.col("_ro")))
    gain = lambda cash, t: F.coalesce(F.least(cash, t["k"]) * share * t["r"], F.lit(0.0))
    kind = f"array<struct<own:{trades.schema.simpleString()},ret:double,equity:double,pnl:double>>"
    walked = F.aggregate(
        "trades", F.struct(F.col("_open").alias("cash"), F.array().cast(kind).alias("out")),
        lambda a, t: F.struct((a["cash"] + gain(a["cash"], t)).alias("cash"), F.concat(a["out"], F.array(F.struct(t["own"].alias("own"), t["r"].alias("ret"), (a["cash"] + gain(a["cash"], t)).alias("equity"), gain(a["cash"], t).alias("pnl")))).alias("out")), lambda a: a["out"],
    )
    return met.select(F.explode(walked).alias("w")).select("w.own.*", "w.ret", "w.equity", "w.pnl")


def fitness(result: DataFrame, variant: str = "velocity", capital: float = 10_000.0, target: float = 0.1) -> DataFrame:
    """Adds ``fitness`` to rows of ``same_open``.

    ``velocity``: 1 + share of bars saved if the target was hit, else relative profit; minus the
    drawdown. ``ttt_a`` and ``ttt_b``: speed against percent return with different weights.
    """
    profit = (F.col("final_capital") - capital) / capital
    hit = F.col("final_capital") >= capital * (1 + target)
    reached = F.col("time_to_target") < F.col("bars")
    pct, bars, ttt = profit * 100, F.col("bars").cast("double"), F.col("time_to_target").cast("double")
    if variant == "velocity":
        out = F.when(hit, 1 + (bars - ttt) / bars).otherwise(profit) - F.col("max_drawdown")
    elif variant == "ttt_a":
        out = F.when(reached, 10_000 - ttt + F.when(pct > 0, pct * 100).otherwise(-F.abs(pct) * 50)).otherwise(F.when(pct > 0, pct * 100 - bars * 0.5).otherwise(-F.abs(pct) * 100 - bars))
    else:
        out = F.when(reached, F.when(pct > 0, -ttt * (1 + pct / 100)).otherwise(-ttt - F.abs(pct) * 100)).otherwise(F.when(pct > 0, -bars * 0.5 + pct * 10).otherwise(-bars + pct * 10))
    return result.withColumn("fitness", out)


def cost_grid(df: DataFrame, grid: DataFrame, signal: str = "signal", by=("symbol",), order=("ts",)) -> DataFrame:
    """Final factor of uncapped all-in trades for each row ``run_id, fee, spread, slippage`` of a cost table.

    The grid meets the trades, not the bars: only fill prices and the number of trades depend on costs.
    """
    by = [*by]
    fills = next_open_trades(df, signal, Costs(0, 0, 0), by, order)
    met = fills.crossJoin(F.broadcast(grid))
    cross = F.col("spread") + F.col("slippage")
    factor = (1 - F.col("fee")) ** 2 * F.col("exit_price") * (1 - cross) / (F.col("entry_price") * (1 + cross))
    return met.groupBy(*by, "run_id").agg(F.count(F.lit(1)).alias("trades"), F.exp(F.sum(F.ln(factor))).alias("factor"))


def time_to_target(equity: DataFrame, target: float, value: str = "equity", by=("symbol",), index: str = "bar") -> DataFrame:
    """First ``index`` at which ``value`` reaches ``target``; null if never."""
    return equity.groupBy(*by).agg(F.min(F.when(F.col(value) >= target, F.col(index))).alias("time_to_target"))


def mark(column: Column) -> Column:
    """Relative change against 1, as percent."""
    return safe_ratio(column - 1, F.lit(0.01))
