"""Performance measures, trade-log analytics, ranking and promotion rules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions.scalar import normal_cdf, safe_ratio, softmax
from barwright.operators.scan import chunk_table, chunked, earlier, ewm, over_chunks
from barwright.operators.selection import ranked_values


def sample_skew(c: str | Column) -> Column:
    """Bias-corrected skewness of a group; null for fewer than 3 values or no spread."""
    n = F.count(c)
    return F.when((n > 2) & (F.stddev_pop(c) > 0), F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(c: str | Column) -> Column:
    """Bias-corrected excess kurtosis of a group; null for fewer than 4 values or no spread."""
    n = F.count(c).cast("double")
    return F.when((n > 3) & (F.stddev_pop(c) > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def psr(returns: DataFrame, c: str, by: list[str], min_obs: int = 20, ddof: int = 1) -> DataFrame:
    """``n, sharpe, psr`` per key: probability that the Sharpe ratio is above 0 given skew and excess kurtosis.

    0 for fewer than ``min_obs`` returns, no spread, or a negative variance term.
    """
    std = F.stddev_samp(c) if ddof else F.stddev_pop(c)
    facts = returns.where(F.col(c).isNotNull()).groupBy(*by).agg(F.count(c).alias("n"), safe_ratio(F.avg(c), std).alias("sharpe"), sample_skew(c).alias("_g1"), sample_kurtosis(c).alias("_g2"))
    inner = 1 - F.col("_g1") * F.col("sharpe") + (F.col("_g2") - 1) / 4 * F.col("sharpe") * F.col("sharpe")
    value = normal_cdf(F.col("sharpe") * F.sqrt(F.col("n") - 1) / F.sqrt(F.when(inner > 0, inner)))
    return facts.select(*by, "n", "sharpe", F.when(F.col("n") < min_obs, 0.0).otherwise(F.coalesce(value, F.lit(0.0))).alias("psr"))


def performance(returns: DataFrame, c: str, by: list[str], order: list[str], periods: int = 252, ddof: int = 0, chunk: str = "day") -> DataFrame:
    """``n, total, sharpe, sortino, max_drawdown, calmar`` of period returns; ratios are null without spread or drawdown.

    The drawdown is folded over time chunks: each comes to its log return, its highest and lowest point and its own deepest fall.
    """
    known = returns.where(F.col(c).isNotNull()).withColumn("_k", F.struct(*(F.col(b).alias(f"k{i}") for i, b in enumerate(by))))
    std = F.stddev_samp if ddof else F.stddev_pop
    low = std(F.when(F.col(c) < 0, F.col(c)))
    facts = known.groupBy("_k").agg(F.count(c).alias("n"), (F.exp(F.sum(F.log1p(c))) - 1).alias("total"), (safe_ratio(F.avg(c), std(c)) * math.sqrt(periods)).alias("sharpe"), (safe_ratio(F.avg(c), low) * math.sqrt(periods)).alias("sortino"))
    upto = Window.partitionBy("_ck").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    curve = chunked(known, [*by], [*order], chunk).withColumn("_l", F.sum(F.log1p(c)).over(upto)).withColumn("_p", F.max("_l").over(upto))
    parts = chunk_table(curve.groupBy("_ck").agg(F.sum(F.log1p(c)).alias("sum"), F.max("_l").alias("top"), F.min("_l").alias("low"), F.max(F.col("_p") - F.col("_l")).alias("fall")), [*by])
    before = earlier(over_chunks([*by]))
    parts = parts.withColumn("start", F.coalesce(F.sum("sum").over(before), F.lit(0.0))).withColumn("peak", F.greatest(F.lit(0.0), F.max(F.col("start") + F.col("top")).over(before)))
    keys = F.struct(*(F.col(f"_k{i}").alias(f"k{i}") for i in range(len(by))))
    falls = parts.groupBy(keys.alias("_kf")).agg(F.max(F.greatest("fall", F.col("peak") - F.col("start") - F.col("low"))).alias("_fall"))
    met = facts.join(falls, F.col("_k") == F.col("_kf")).withColumn("max_drawdown", F.greatest(F.lit(0.0), -F.expm1(-F.col("_fall"))))
    names = [F.col(f"_k.k{i}").alias(b) for i, b in enumerate(by)]
    return met.select(*names, "n", "total", "sharpe", "sortino", "max_drawdown", safe_ratio(F.col("total"), F.col("max_drawdown")).alias("calmar"))


def trade_stats(trades: DataFrame, pnl: str, by: list[str]) -> DataFrame:
    """``n, wins, losses, win_pct, avg_win, avg_loss, profit_factor``; the factor is null without losses."""
    p = F.col(pnl)
    won, lost = F.sum(F.when(p > 0, p)), F.sum(F.when(p < 0, -p))
    return trades.groupBy(*by).agg(
        F.count(pnl).alias("n"), F.count(F.when(p > 0, 1)).alias("wins"), F.count(F.when(p < 0, 1)).alias("losses"), (100 * safe_ratio(F.count(F.when(p > 0, 1)), F.count(pnl))).alias("win_pct"),
        F.avg(F.when(p > 0, p)).alias("avg_win"), F.avg(F.when(p < 0, p)).alias("avg_loss"), safe_ratio(won, lost).alias("profit_factor"),
    )


def pnl_by_model(trades: DataFrame, model: str = "model_id", pnl: str = "net_pnl") -> DataFrame:
    """``model, n, net_pnl, win_rate``; a value that is no number counts as null."""
    value = F.col(pnl).try_cast("double")
    return trades.groupBy(model).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("net_pnl"), (100 * safe_ratio(F.count(F.when(value > 0, 1)), F.count(F.lit(1)))).alias("win_rate"))


def champion(by_model: DataFrame, model: str = "model_id") -> DataFrame:
    """The model of greatest ``net_pnl``, ties to the smaller identifier, beside the whole system's count and sum."""
    best = F.max_by(F.struct(model, "n", "net_pnl", "win_rate"), F.struct("net_pnl", -F.col(model)))
    return by_model.agg(best.alias("b"), F.sum("n").alias("system_trades"), F.sum("net_pnl").alias("system_pnl")).select("b.*", "system_trades", "system_pnl")


def key_trades(trades: DataFrame, by: list[str], pnl: str, order: list[str], key: str, k: int = 3) -> DataFrame:
    """The ``k`` greatest wins, the ``k`` least and the ``k`` latest trades per key, each trade once."""
    keys = Window.partitionBy(*by)
    rank = lambda *o: F.row_number().over(keys.orderBy(*o))
    ranked = trades.withColumns({"_top": rank(F.col(pnl).desc(), key), "_low": rank(F.col(pnl).asc(), key), "_new": rank(*(F.col(c).desc() for c in order), F.col(key).desc())})
    return ranked.where(f"_top <= {k} or _low <= {k} or _new <= {k}").drop("_top", "_low", "_new")


#: Parts in which ties at a cut are numbered before the first rows of each meet.
TIE_SALTS = 64


def top_fraction(df: DataFrame, score: str, key: str, frac: float = 0.02, floor: int = 10, by: list[str] | None = None) -> DataFrame:
    """The best ``max(floor, frac of rows)`` rows per key (or of all) by score, ties to the smaller ``key``; missing scores come last.

    Without ``by``, the score at the cut is selected without sorting: all above it stay, and its ties, which
    meet in one task unless they are more than are wanted, fill up by ``key``.
    """
    if by:
        met = df.join(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), by)
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc(), key))
        return met.withColumn("_r", rank).where(F.col("_r") <= F.greatest(F.lit(floor), F.floor(F.col("_n") * frac))).drop("_r", "_n")
    now = F.col(score).cast("double")
    facts = df.agg(F.count(F.lit(1)).alias("_n"), F.count(now).alias("_m")).withColumn("_take", F.greatest(F.lit(floor), F.floor(F.col("_n") * frac)))
    place = F.struct(F.lit(0).alias("k0")).alias("_k")
    wanted = facts.where("_take < _m").select(place, F.lit("cut").alias("name"), (F.col("_m") - F.col("_take")).cast("bigint").alias("rank"))
    cut = ranked_values(df.select(place, now.alias("v")).where("v is not null"), F.broadcast(wanted), few_keys=True).select(F.col("value").alias("_cut"))
    # one row each; no cut if all known scores stay
    held = df.crossJoin(F.broadcast(facts.select("_take"))).join(F.broadcast(cut), F.lit(True), "left")
    above = held.where(F.when(F.col("_cut").isNull(), now.isNotNull()).otherwise(now > F.col("_cut")))
    tied = held.where(now.eqNullSafe(F.col("_cut"))).crossJoin(F.broadcast(above.agg(F.count(F.lit(1)).alias("_a"))))
    order = [F.col(score).desc(), F.col(key)]
    few = tied.withColumn("_r", F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64(key), F.lit(TIE_SALTS))).orderBy(*order))).where(F.col("_r") <= F.col("_take") - F.col("_a"))
    last = few.withColumn("_r", F.row_number().over(Window.orderBy(*order))).where(F.col("_r") <= F.col("_take") - F.col("_a"))
    return above.select(*df.columns).unionByName(last.select(*df.columns))


def last_n(df: DataFrame, n: int, by: list[str], order: list[str]) -> DataFrame:
    """The latest ``n`` rows of each key."""
    w = Window.partitionBy(*by).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("_r", F.row_number().over(w)).where(f"_r <= {n}").drop("_r")


def enrich_exits(entries: DataFrame, exits: DataFrame, key: str, risk: float = 0.02) -> DataFrame:
    """Exits with their entry: ``gross_pnl, net_pnl`` (less the exit commission), ``total_commission, pnl_pct, duration_hours, r_multiple``."""
    met = exits.join(entries, key)
    gross = (F.col("exit_price") - F.col("entry_price")) * F.col("amount")
    net = gross - F.col("exit_commission")
    capital = F.col("entry_price") * F.col("amount")
    hours = (F.unix_micros(F.col("exit_time").cast("timestamp")) - F.unix_micros(F.col("entry_time").cast("timestamp"))) / F.lit(3.6e9)
    return met.withColumns({"gross_pnl": gross, "net_pnl": net, "total_commission": F.col("entry_commission") + F.col("exit_commission"), "pnl_pct": 100 * safe_ratio(net, capital), "duration_hours": hours, "r_multiple": safe_ratio(net, capital * risk)})


def cull(agents: DataFrame, trades: DataFrame, agent: str, ret: str, order: list[str], drawdown: float = 0.3, min_trades: int = 20, confidence: float = 0.9) -> DataFrame:
    """``agent, reason``: ``drawdown`` first, then ``psr`` over the last 50 trades below 0.5, or over 20 to 49 trades below ``confidence``; null keeps."""
    n = trades.groupBy(agent).agg(F.count(F.lit(1)).alias("_n"))
    score = psr(last_n(trades, 50, [agent], order), ret, [agent], min_trades).select(agent, "psr")
    met = agents.join(n, agent, "left").join(score, agent, "left")
    lost = safe_ratio(F.col("initial") - F.col("balance"), F.col("initial"))
    few = (F.col("_n") >= min_trades) & (F.col("_n") < 50)
    reason = F.when(lost >= drawdown, "drawdown").when((F.col("_n") >= 50) & (F.col("psr") < 0.5), "psr").when(few & (F.col("psr") < confidence), "psr")
    return met.select(agent, reason.alias("reason"))


def promote(candidates: DataFrame, elite: DataFrame, key: str = "model_id", confidence: float = 0.99) -> DataFrame:
    """The elite table after candidates with ``psr`` above ``confidence`` or a grown balance join it; an entry only improves."""
    good = candidates.where((F.col("psr") > confidence) | (F.col("profit_pct") > 0)).select(key, "profit_pct")
    return elite.select(key, "profit_pct").unionByName(good).groupBy(key).agg(F.max("profit_pct").alias("profit_pct"))


def bench_score(shadow: DataFrame, key: list[str], ttt: str = "ttt", least: int = 3, unreached: float = 1000.0) -> DataFrame:
    """``n, score``: mean time to target plus half its population deviation, lower is better; infinite for few trades."""
    t = F.coalesce(F.col(ttt), F.lit(unreached))
    return shadow.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= least, F.avg(t) + 0.5 * F.stddev_pop(t)).otherwise(float("inf")).alias("score"))


def hotswap(bench: DataFrame, champions: DataFrame, by: str = "symbol", model: str = "model_id", better: float = 0.9, min_psr: float = 0.55, slack: float = 1.1, least: int = 5) -> DataFrame:
    """``by, champion, challenger, swap``: the best challenger with enough trades, and whether it takes over."""
    best = bench.where(F.col("n") >= least).groupBy(by).agg(F.min_by(F.struct(model, "score", "psr", "drawdown"), F.struct("score", model)).alias("b"))
    met = champions.select(by, F.col(model).alias("champion"), F.col("score").alias("_s"), F.col("drawdown").alias("_d")).join(best, by, "left")
    swap = (F.col("b.score") < F.col("_s") * better) & (F.col("b.psr") > min_psr) & (F.col("b.drawdown") < F.col("_d") * slack)
    return met.select(by, "champion", F.col(f"b.{model}").alias("challenger"), F.coalesce(swap, F.lit(False)).alias("swap"))


def softmax_weights(losses: DataFrame, alpha: float, model: str = "model_id", loss: str = "loss", order=("ts",)) -> DataFrame:
    """``model, score, weight``: exponential mean of ``1 - 2 min(loss, 1)`` from a first value of 0.5, then softmax over models."""
    start = losses.groupBy(model).agg(F.min(order[0]).alias(order[0])).select(model, (F.col(order[0]).cast("timestamp") - F.expr("interval 1 second")).alias(order[0]), F.lit(0.5).alias("_v"))
    seen = losses.select(model, F.col(order[0]).cast("timestamp").alias(order[0]), (1 - 2 * F.least(F.col(loss), F.lit(1.0))).alias("_v"))
    means = ewm(start.unionByName(seen), {"score": ("_v", alpha)}, [model], [order[0]])
    last = means.groupBy(model).agg(F.max_by("score", order[0]).alias("score"))
    total = last.agg(F.sum(F.exp("score")).alias("_t"))
    return last.crossJoin(F.broadcast(total)).select(model, "score", (F.exp("score") / F.col("_t")).alias("weight"))


def counter_trade(a: DataFrame, b: DataFrame, prices: DataFrame, on: list[str], signal: str = "signal", ret: str = "ret") -> DataFrame:
    """``n, score``: mean return where the two signals are opposite, neither being 0."""
    met = a.select(*on, F.col(signal).alias("_a")).join(b.select(*on, F.col(signal).alias("_b")), on).join(prices.select(*on, ret), on)
    opposite = (F.col("_a") != 0) & (F.col("_b") != 0) & (F.col("_a") != F.col("_b"))
    return met.where(opposite).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(ret), F.lit(0.0)).alias("score"))


def adversarial_return(df: DataFrame, position: str, ret: str, by: list[str]) -> DataFrame:
    """``log_ret``: sum of log returns while in position."""
    return df.where(F.col(position) == 1).groupBy(*by).agg(F.sum(F.log1p(ret)).alias("log_ret"))


def blend(adversarial: str, mimicry_score: str, weight: float = 0.3) -> Column:
    return (1 - weight) * F.col(adversarial) + weight * F.col(mimicry_score)


def mimicry(pred: DataFrame, predicted: str, probs: str, by: list[str], eps: float = 1e-15) -> DataFrame:
    """``1 / (1 + log loss)`` of one-hot predictions against an array of soft labels."""
    p = F.least(F.lit(1 - eps), F.greatest(F.lit(eps), F.get(probs, F.col(predicted))))
    return pred.groupBy(*by).agg((1 / (1 + F.avg(-F.ln(p)))).alias("mimicry"))


def array_softmax(values: str) -> Column:
    return softmax(F.col(values))
