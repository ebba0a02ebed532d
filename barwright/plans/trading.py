"""Queries over labels, signals, splits, backtests, performance, ranking and risk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.operators import aggregate, backtest, indicators, labels, perf, resample, risk
from barwright.plans.fixtures import BARS_SQL, TRADES_SQL, bars, table, trade_log
from barwright.plans.market import ATR_SQL, CHOP_SQL, RSI_SQL, TR_SQL, _ewm_sql, _roll, rounded
from barwright.sources.readers import latest_by_key

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# labels and signals ---------------------------------------------------------------------------------


@query(BARS_SQL + ATR_SQL + """, a AS (SELECT symbol, ts, close, atr_14, list({'h': high, 'l': low}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS ahead FROM atr),
h AS (SELECT *, list_filter(list_transform(ahead, lambda b: CASE WHEN b.h >= close + 2 * atr_14 THEN 1 WHEN b.l <= close - 2 * atr_14 THEN 2 ELSE 0 END), lambda x: x > 0) AS hits FROM a)
SELECT symbol, ts, CASE WHEN len(ahead) < 20 OR ahead IS NULL THEN NULL ELSE coalesce(hits[1], 0) END AS label FROM h""")
def lab1_triple_barrier(spark, sf_dir):
    return labels.triple_barrier(indicators.atr(bars(spark, sf_dir))).select("symbol", "ts", "label")


@query(BARS_SQL + f", m AS (SELECT symbol, ts, close, {_roll(20, 'avg(close) OVER $W')} AS mid, {_roll(20, 'stddev_samp(close) OVER $W')} AS sd FROM bars) SELECT symbol, ts, CASE WHEN close < mid - 2 * sd THEN 1 WHEN close > mid + 2 * sd THEN 2 ELSE 0 END AS label FROM m")
def lab2_reversion(spark, sf_dir):
    return labels.reversion_label(bars(spark, sf_dir)).select("symbol", "ts", "label")


CROSS_SQL = BARS_SQL + f", mm AS (SELECT *, {_roll(10, 'avg(close) OVER $W')} AS f, {_roll(30, 'avg(close) OVER $W')} AS s FROM bars), sig AS (SELECT *, CASE WHEN f > s THEN 1 WHEN f < s THEN 2 ELSE 0 END AS signal FROM mm)"


@query(CROSS_SQL + ", n AS (SELECT *, lead(close) OVER (PARTITION BY symbol ORDER BY ts) / nullif(close, 0) - 1 AS fwd FROM sig) SELECT symbol, ts, round(fwd, 6) AS fwd_1, CASE WHEN (signal = 1 AND fwd > 0) OR (signal = 2 AND fwd < 0) THEN 1 ELSE 0 END AS meta, CASE WHEN fwd > 0.001 THEN 2 WHEN fwd < -0.001 THEN 0 WHEN fwd IS NOT NULL THEN 1 END AS sign FROM n")
def lab3_5_forward_labels(spark, sf_dir):
    made = labels.forward_return(labels.ma_cross(bars(spark, sf_dir)))
    return rounded(made.select("symbol", "ts", "fwd_1", labels.meta_label("signal", "fwd_1").alias("meta"), labels.sign_label("fwd_1").alias("sign")), "fwd_1")


@query(BARS_SQL + ", c AS (SELECT symbol, ts, close > open AS o, coalesce(lag(close > open) OVER (PARTITION BY symbol ORDER BY ts), false) AS w FROM bars) SELECT symbol, ts, CASE WHEN o AND NOT w THEN 1 WHEN NOT o AND w THEN 2 ELSE 0 END AS signal FROM c")
def sig1_edges(spark, sf_dir):
    return labels.to_signals(bars(spark, sf_dir), F.col("close") > F.col("open")).select("symbol", "ts", "signal")


@query(CROSS_SQL + " SELECT symbol, ts, coalesce((last_value(nullif(signal, 0) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts) = 1)::INTEGER, 0) AS position FROM sig")
def sig2_position(spark, sf_dir):
    return labels.position(labels.ma_cross(bars(spark, sf_dir))).select("symbol", "ts", "position")


@query(CROSS_SQL + " SELECT symbol, ts, signal FROM sig")
def sig3_ma_cross(spark, sf_dir):
    return labels.ma_cross(bars(spark, sf_dir)).select("symbol", "ts", "signal")


@query(BARS_SQL + RSI_SQL + " SELECT symbol, ts, CASE WHEN rsi_14 < 40 THEN 1 WHEN rsi_14 > 60 THEN 2 ELSE 0 END AS signal FROM rsi")
def sig4_rsi(spark, sf_dir):
    return labels.rsi_signal(bars(spark, sf_dir), 14, 40, 60).select("symbol", "ts", "signal")


@query(BARS_SQL + f", e AS (SELECT symbol, ts, {_ewm_sql('close', 2 / 51)} AS f, {_ewm_sql('close', 2 / 201)} AS s FROM bars), l AS (SELECT symbol, count(*) AS n, arg_max(f, ts) AS f, arg_max(s, ts) AS s FROM e GROUP BY symbol) SELECT symbol, CASE WHEN n < 200 THEN 'NEUTRAL' WHEN f > s * 1.005 THEN 'LONG' WHEN f < s * 0.995 THEN 'SHORT' ELSE 'NEUTRAL' END AS bias FROM l")
def sig5_trend_bias(spark, sf_dir):
    return labels.trend_bias(bars(spark, sf_dir))


@query(BARS_SQL + TR_SQL + f", a AS (SELECT *, {_ewm_sql('tr', 1 / 14)} / (close + 1e-9) AS v FROM tr)" + CHOP_SQL + ", j AS (SELECT a.symbol, a.ts, v, CASE WHEN ratio > 0 THEN 100 * log10(ratio) / log10(14) END AS c FROM a JOIN chop USING (symbol, ts)), "
       "g AS (SELECT symbol, count(*) AS n, quantile_cont(v, 0.75) AS v75, quantile_cont(c, 0.5) AS c50, arg_max(v, ts) AS v, arg_max(c, ts) AS c FROM j GROUP BY symbol) SELECT symbol, CASE WHEN n < 50 OR c IS NULL THEN 'Undefined' ELSE concat(CASE WHEN v > v75 THEN 'Volatile' ELSE 'Quiet' END, '-', CASE WHEN c > c50 THEN 'Ranging' ELSE 'Trending' END) END AS environment FROM g")
def sig6_environment(spark, sf_dir):
    return labels.environment(bars(spark, sf_dir))


@query(BARS_SQL + ", i AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars) SELECT symbol, ts, CASE WHEN i < floor(n * 0.7) THEN 'train' WHEN i < floor(n * 0.9) THEN 'valid' ELSE 'test' END AS split FROM i")
def spl1_chrono_split(spark, sf_dir):
    return labels.chrono_split(bars(spark, sf_dir), {"train": 0.7, "valid": 0.2, "test": 0.1}).select("symbol", "ts", "split")


@query(BARS_SQL + """, i AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM bars), n AS (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol HAVING count(*) >= 400),
k AS (SELECT symbol, pow(0.8, greatest(0, ceil(ln(n / 800.0) / ln(0.8) - 1e-9))) AS k FROM n), p AS (SELECT symbol, floor(500 * k + 1e-9) AS tr, floor(100 * k + 1e-9) AS te, unnest([0, 1, 2]) AS fold FROM k)
SELECT symbol, ts, fold, CASE WHEN i < fold * te + tr THEN 'train' ELSE 'test' END AS part FROM i JOIN p USING (symbol) WHERE i >= fold * te AND i < fold * te + tr + te""")
def spl2_walk_forward(spark, sf_dir):
    return labels.walk_forward(bars(spark, sf_dir), 500, 100).select("symbol", "ts", "fold", "part")


@query(BARS_SQL + ", r AS (SELECT symbol, ts, CASE WHEN hour(ts) < 2 THEN -1 ELSE hour(ts) // 6 END AS regime FROM bars), n AS (SELECT *, count(*) OVER (PARTITION BY symbol, regime) AS n, row_number() OVER (PARTITION BY symbol, regime ORDER BY ts) AS i FROM r WHERE regime <> -1) SELECT symbol, ts, regime::INTEGER AS regime, CASE WHEN i <= floor(n / 2) THEN 'support' ELSE 'query' END AS part FROM n WHERE n >= 20")
def spl3_regime_tasks(spark, sf_dir):
    b = bars(spark, sf_dir).withColumn("regime", F.when(F.hour("ts") < 2, -1).otherwise(F.floor(F.hour("ts") / 6)).cast("int"))
    return labels.regime_tasks(b).select("symbol", "ts", "regime", "part")


# backtests --------------------------------------------------------------------------------------------

STATES_SQL = CROSS_SQL + """, st AS (SELECT *, row_number() OVER w - 1 AS b FROM sig WINDOW w AS (PARTITION BY symbol ORDER BY ts)), s2 AS (SELECT *, CASE WHEN b > 0 THEN nullif(signal, 0) END AS q FROM st),
s3 AS (SELECT *, coalesce(last_value(q IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts) = 1, false) AS nw, coalesce(last_value(q IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1, false) AS ws FROM s2),
s4 AS (SELECT *, nw AND NOT ws AS ent, ws AND NOT nw AS ext, ws AS held FROM s3), s5 AS (SELECT *, sum(ent::INT) OVER (PARTITION BY symbol ORDER BY ts) AS t FROM s4)"""


@query(STATES_SQL + " SELECT symbol, t::BIGINT AS trade, max(b) FILTER (ent) AS entry_bar, max(b) FILTER (ext) AS exit_bar, max(ts) FILTER (ent) AS entry_ts, max(ts) FILTER (ext) AS exit_ts FROM s5 WHERE ent OR ext GROUP BY symbol, t")
def btk1_extract_trades(spark, sf_dir):
    made = backtest.extract_trades(labels.ma_cross(bars(spark, sf_dir)))
    return made.withColumns({"entry_bar": F.col("entry_bar").cast("long"), "exit_bar": F.col("exit_bar").cast("long")})


WALK_SQL = CROSS_SQL + """, n AS (SELECT symbol, row_number() OVER w - 1 AS i, open, close, signal, count(*) OVER (PARTITION BY symbol) AS n FROM sig WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
lists AS (SELECT symbol, list({'o': open, 'c': close, 's': signal, 'i': i} ORDER BY i) AS x, count(*) AS n FROM n GROUP BY symbol),
walk AS (SELECT symbol, n, list_reduce(x[2:], lambda a, r: CASE WHEN a.stop >= 0 THEN a ELSE struct_pack(
  cap := CASE WHEN a.cap + a.pos * (r.c - a.last) >= 10500 THEN a.cap + a.pos * (r.c - a.last) WHEN r.s = 2 AND a.pos > 0 THEN a.pos * r.o * (1 - 0.0003) * 0.999 ELSE a.cap + a.pos * (r.c - a.last) END,
  pos := CASE WHEN a.cap + a.pos * (r.c - a.last) >= 10500 THEN a.pos WHEN r.s = 1 AND a.pos = 0 THEN a.cap / (r.o * 1.0003) * 0.999 WHEN r.s = 2 THEN 0 ELSE a.pos END,
  trades := a.trades + CASE WHEN a.cap + a.pos * (r.c - a.last) < 10500 AND r.s = 1 AND a.pos = 0 THEN 1 ELSE 0 END, peak := greatest(a.peak, a.cap + a.pos * (r.c - a.last)),
  dd := greatest(a.dd, (greatest(a.peak, a.cap + a.pos * (r.c - a.last)) - (a.cap + a.pos * (r.c - a.last))) / greatest(a.peak, a.cap + a.pos * (r.c - a.last))),
  stop := CASE WHEN a.cap + a.pos * (r.c - a.last) >= 10500 THEN r.i ELSE -1 END::BIGINT, last := r.c) END,
  struct_pack(cap := 10000.0::DOUBLE, pos := 0.0::DOUBLE, trades := 0, peak := 10000.0::DOUBLE, dd := 0.0::DOUBLE, stop := (-1)::BIGINT, last := x[1].c)) AS w FROM lists)
SELECT symbol, round(w.cap, 4) AS final_capital, w.trades::BIGINT AS trades, round(w.dd, 6) AS max_drawdown, CASE WHEN w.stop >= 0 THEN w.stop ELSE n END AS time_to_target, n AS bars FROM walk"""


@query(WALK_SQL)
def btk3_same_open(spark, sf_dir):
    made = backtest.same_open(labels.ma_cross(bars(spark, sf_dir)), target=0.05)
    return rounded(rounded(made, "final_capital", digits=4), "max_drawdown")


FILLS_SQL = CROSS_SQL + """, fx AS (SELECT symbol, ts, open, close, volume, lag(CASE WHEN nxt IS NOT NULL THEN signal ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts) AS fs FROM (SELECT *, lead(open) OVER (PARTITION BY symbol ORDER BY ts) AS nxt FROM sig)),
f2 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS b FROM fx), f3 AS (SELECT *, nullif(coalesce(CASE WHEN b > 0 THEN fs END, 0), 0) AS q FROM f2),
f4 AS (SELECT *, coalesce(last_value(q IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts) = 1, false) AS nw, coalesce(last_value(q IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1, false) AS ws FROM f3),
f5 AS (SELECT *, sum((nw AND NOT ws)::INT) OVER (PARTITION BY symbol ORDER BY ts) AS t FROM f4), tr AS (SELECT symbol, t, max(b) FILTER (nw AND NOT ws) AS eb, max(b) FILTER (ws AND NOT nw) AS xb, max(open) FILTER (nw AND NOT ws) AS eo, max(open) FILTER (ws AND NOT nw) AS xo FROM f5 WHERE nw <> ws GROUP BY symbol, t),
la AS (SELECT symbol, arg_max(close, ts) AS lc, max(b) AS lb FROM f2 GROUP BY symbol), fills AS (SELECT symbol, t, eb, coalesce(xb, lb) AS xb, eo * 1.0003 AS ep, coalesce(xo, lc) * 0.9997 AS xp, xb IS NULL AS forced, eo, coalesce(xo, lc) AS raw_x FROM tr JOIN la USING (symbol))"""


@query(FILLS_SQL + " SELECT symbol, t::BIGINT AS trade, eb AS entry_bar, xb AS exit_bar, forced, round(xp / ep * 0.999 - 1.001, 6) AS ret, round(10000 * exp(sum(ln(1 - 0.95 * 1.001 + 0.95 * 0.999 * xp / ep)) OVER (PARTITION BY symbol ORDER BY t)), 4) AS equity FROM fills")
def btk2_next_open(spark, sf_dir):
    made = backtest.next_open(backtest.next_open_trades(labels.ma_cross(bars(spark, sf_dir))))
    return rounded(rounded(made.select("symbol", "trade", F.col("entry_bar").cast("long").alias("entry_bar"), F.col("exit_bar").cast("long").alias("exit_bar"), "forced", "ret", "equity"), "ret"), "equity", digits=4)


CAPPED_SQL = (
    FILLS_SQL.replace("AS eo, max(open)", "AS eo, max(volume * open) FILTER (nw AND NOT ws) AS liq, max(open)").replace("AS forced, eo", "AS forced, liq, eo")
    + """, rt AS (SELECT symbol, t, liq, xp / ep * 0.999 - 1.001 AS ret FROM fills),
cs AS (SELECT symbol, t, ret, list_reduce(list({'r': ret, 'l': liq}) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING), lambda a, x: a + least(a * 0.95, coalesce(x.l * 0.1, a * 0.95)) * x.r, 10000.0::DOUBLE) AS equity FROM rt)
SELECT symbol, t::BIGINT AS trade, round(ret, 6) AS ret, round(equity, 4) AS equity, round(equity - coalesce(lag(equity) OVER (PARTITION BY symbol ORDER BY t), 10000), 4) AS pnl FROM cs"""
)


@query(CAPPED_SQL)
def btk2_next_open_capped(spark, sf_dir):
    made = backtest.next_open_capped(backtest.next_open_trades(labels.ma_cross(bars(spark, sf_dir)))).select("symbol", "trade", "ret", "equity", "pnl")
    return rounded(rounded(made, "ret"), "equity", "pnl", digits=4)


@query(WALK_SQL.split("\nSELECT symbol, round(w.cap")[0] + """, r AS (SELECT symbol, w.cap AS fc, w.dd AS dd, CASE WHEN w.stop >= 0 THEN w.stop ELSE n END AS ttt, n AS bars FROM walk), q AS (SELECT *, (fc - 10000) / 10000 AS p, fc >= 10500 AS hit, ttt < bars AS rch FROM r)
SELECT symbol, round(CASE WHEN hit THEN 1 + (bars - ttt) / bars ELSE p END - dd, 6) AS velocity,
  round(CASE WHEN rch THEN 10000 - ttt + CASE WHEN p > 0 THEN p * 10000 ELSE -abs(p) * 5000 END WHEN p > 0 THEN p * 10000 - bars * 0.5 ELSE -abs(p) * 10000 - bars END, 4) AS ttt_a,
  round(CASE WHEN rch THEN CASE WHEN p > 0 THEN -ttt * (1 + p) ELSE -ttt - abs(p) * 10000 END WHEN p > 0 THEN -bars * 0.5 + p * 1000 ELSE -bars + p * 1000 END, 4) AS ttt_b FROM q""")
def btk4_5_fitness(spark, sf_dir):
    run = backtest.same_open(labels.ma_cross(bars(spark, sf_dir)), target=0.05)
    made = run
    for kind in ("velocity", "ttt_a", "ttt_b"):
        made = backtest.fitness(made, kind, target=0.05).withColumnRenamed("fitness", kind)
    return rounded(rounded(made.select("symbol", "velocity", "ttt_a", "ttt_b"), "velocity"), "ttt_a", "ttt_b", digits=4)


@query(TRADES_SQL + ", e AS (SELECT model_id, row_number() OVER w AS bar, 100000 + sum(net_pnl) OVER w AS equity FROM trades WINDOW w AS (PARTITION BY model_id ORDER BY ts, id)) SELECT model_id, min(bar) FILTER (equity >= 300000) AS time_to_target FROM e GROUP BY model_id")
def btk6_time_to_target(spark, sf_dir):
    e = equity_curve(spark, sf_dir)
    return backtest.time_to_target(e, 300_000, by=("model_id",)).withColumn("time_to_target", F.col("time_to_target").cast("long"))


@query(FILLS_SQL + ", g AS (SELECT * FROM (VALUES (0, 0.0, 0.0, 0.0), (1, 0.001, 0.0002, 0.0001), (2, 0.002, 0.0005, 0.0005)) AS v(run_id, fee, spread, slippage)) SELECT symbol, run_id::BIGINT AS run_id, count(*) AS trades, round(exp(sum(ln((1 - fee) * (1 - fee) * raw_x * (1 - spread - slippage) / (eo * (1 + spread + slippage))))), 6) AS factor FROM fills, g GROUP BY symbol, run_id")
def rst4_cost_grid(spark, sf_dir):
    grid = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 0.001, 0.0002, 0.0001), (2, 0.002, 0.0005, 0.0005)], "run_id long, fee double, spread double, slippage double")
    return rounded(backtest.cost_grid(labels.ma_cross(bars(spark, sf_dir)), grid), "factor")


# performance and trade log ---------------------------------------------------------------------------


def equity_curve(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("model_id").orderBy("ts", "id")
    t = trade_log(spark, sf_dir)
    return t.select("model_id", "ts", "id", F.row_number().over(w).alias("bar"), (F.lit(100_000.0) + F.sum("net_pnl").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("equity"))


@query(TRADES_SQL + """, c AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY model_id ORDER BY ts, id)) AS e FROM trades), p AS (SELECT *, greatest(1, max(e) OVER (PARTITION BY model_id ORDER BY ts, id)) AS pk FROM c)
SELECT model_id, count(*) AS n, round(exp(sum(ln(1 + ret))) - 1, 6) AS total, round(avg(ret) / stddev_pop(ret) * sqrt(252), 6) AS sharpe, round(avg(ret) / stddev_pop(ret) FILTER (ret < 0) * sqrt(252), 6) AS sortino, round(max((pk - e) / pk), 6) AS max_drawdown, round((exp(sum(ln(1 + ret))) - 1) / nullif(max((pk - e) / pk), 0), 5) AS calmar FROM p GROUP BY model_id""")
def prf1_performance(spark, sf_dir):
    made = perf.performance(trade_log(spark, sf_dir), "ret", ["model_id"], ["ts", "id"])
    return rounded(rounded(made, "total", "sharpe", "sortino", "max_drawdown"), "calmar", digits=5)


@query(TRADES_SQL + " SELECT model_id, count(net_pnl) AS n, count(*) FILTER (net_pnl > 0) AS wins, count(*) FILTER (net_pnl < 0) AS losses, round(100.0 * count(*) FILTER (net_pnl > 0) / count(net_pnl), 6) AS win_pct, round(avg(net_pnl) FILTER (net_pnl > 0), 4) AS avg_win, round(avg(net_pnl) FILTER (net_pnl < 0), 4) AS avg_loss, round(sum(net_pnl) FILTER (net_pnl > 0) / nullif(-sum(net_pnl) FILTER (net_pnl < 0), 0), 6) AS profit_factor FROM trades GROUP BY model_id")
def prf2_trade_stats(spark, sf_dir):
    return rounded(rounded(perf.trade_stats(trade_log(spark, sf_dir), "net_pnl", ["model_id"]), "win_pct", "profit_factor"), "avg_win", "avg_loss", digits=4)


PSR_SQL = """, g AS (SELECT $K, count(ret) AS n, avg(ret) / nullif(stddev_samp(ret), 0) AS sharpe, skewness(ret) AS g1, kurtosis(ret) AS g2 FROM $T GROUP BY $K),
z AS (SELECT *, CASE WHEN 1 - g1 * sharpe + (g2 - 1) / 4 * sharpe * sharpe > 0 THEN sharpe * sqrt(n - 1) / sqrt(1 - g1 * sharpe + (g2 - 1) / 4 * sharpe * sharpe) END AS z FROM g),
k AS (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS t FROM z), u AS (SELECT *, exp(-z * z / 2) * 0.3989422804014327 * (t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))) AS up FROM k),
psr AS (SELECT $K, n, sharpe, CASE WHEN n < 20 THEN 0 ELSE coalesce(CASE WHEN z >= 0 THEN 1 - up ELSE up END, 0) END AS psr FROM u)"""


@query(TRADES_SQL + PSR_SQL.replace("$K", "model_id").replace("$T", "trades") + " SELECT model_id, n, round(sharpe, 6) AS sharpe, round(psr, 6) AS psr FROM psr")
def prf3_psr(spark, sf_dir):
    return rounded(perf.psr(trade_log(spark, sf_dir), "ret", ["model_id"]), "sharpe", "psr")


@query("""WITH x AS (SELECT o_orderkey AS id, o_totalprice / 100 AS entry_price, o_orderdate AS entry_time, l_extendedprice / 20 AS exit_price, l_shipdate AS exit_time, l_quantity AS amount, l_tax * 10 AS entry_commission, l_discount * 10 AS exit_commission FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1)
SELECT id, round((exit_price - entry_price) * amount, 4) AS gross_pnl, round((exit_price - entry_price) * amount - exit_commission, 4) AS net_pnl, round(entry_commission + exit_commission, 6) AS total_commission, round(100 * ((exit_price - entry_price) * amount - exit_commission) / nullif(entry_price * amount, 0), 5) AS pnl_pct, round((epoch_us(exit_time) - epoch_us(entry_time)) / 3.6e9, 6) AS duration_hours FROM x""")
def prf4_enrich_exits(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    entries = o.select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 100).alias("entry_price"), F.col("o_orderdate").alias("entry_time"))
    exits = li.where("l_linenumber = 1").select(F.col("l_orderkey").alias("id"), (F.col("l_extendedprice") / 20).alias("exit_price"), F.col("l_shipdate").alias("exit_time"), F.col("l_quantity").alias("amount"), (F.col("l_tax") * 10).alias("entry_commission"), (F.col("l_discount") * 10).alias("exit_commission"))
    made = perf.enrich_exits(entries, exits, "id").select("id", "gross_pnl", "net_pnl", "total_commission", "pnl_pct", "duration_hours")
    return rounded(rounded(rounded(made, "gross_pnl", "net_pnl", digits=4), "total_commission", "duration_hours"), "pnl_pct", digits=5)


AGENTS_SQL = TRADES_SQL + ", agents AS (SELECT model_id, 1000000.0 AS initial, 1000000 + sum(net_pnl) AS balance FROM trades GROUP BY model_id), last50 AS (SELECT * FROM trades QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY ts DESC, id DESC) <= 50)" + PSR_SQL.replace("$K", "model_id").replace("$T", "last50")


def agents(spark, sf_dir) -> DataFrame:
    return trade_log(spark, sf_dir).groupBy("model_id").agg(F.lit(1_000_000.0).alias("initial"), (F.lit(1_000_000.0) + F.sum("net_pnl")).alias("balance"))


@query(AGENTS_SQL + ", c AS (SELECT model_id, count(*) AS cnt FROM trades GROUP BY model_id) SELECT model_id, CASE WHEN (initial - balance) / initial >= 0.3 THEN 'drawdown' WHEN cnt >= 50 AND psr < 0.5 THEN 'psr' WHEN cnt >= 20 AND cnt < 50 AND psr < 0.9 THEN 'psr' END AS reason FROM agents LEFT JOIN c USING (model_id) LEFT JOIN psr USING (model_id)")
def prf5_cull(spark, sf_dir):
    return perf.cull(agents(spark, sf_dir), trade_log(spark, sf_dir), "model_id", "ret", ["ts", "id"])


@query(TRADES_SQL + PSR_SQL.replace("$K", "model_id").replace("$T", "trades") + ", e AS (SELECT model_id, 5.0 AS profit_pct FROM psr WHERE model_id < 10 UNION ALL SELECT model_id, 100 * (psr - 0.5) FROM psr WHERE psr > 0.99 OR psr > 0.5) SELECT model_id, round(max(profit_pct), 6) AS profit_pct FROM e GROUP BY model_id")
def prf6_promote(spark, sf_dir):
    scores = perf.psr(trade_log(spark, sf_dir), "ret", ["model_id"])
    return rounded(perf.promote(scores.withColumn("profit_pct", 100 * (F.col("psr") - 0.5)), scores.where("model_id < 10").select("model_id", F.lit(5.0).alias("profit_pct"))), "profit_pct")


BENCH_SQL = TRADES_SQL + ", b AS (SELECT symbol, model_id, count(*) AS n, CASE WHEN count(*) >= 3 THEN avg(CASE WHEN ret > 0 THEN 10 + id % 90 ELSE 1000 END) + 0.5 * stddev_pop(CASE WHEN ret > 0 THEN 10 + id % 90 ELSE 1000 END) ELSE 'infinity'::DOUBLE END AS score FROM trades GROUP BY symbol, model_id)"


def bench(spark, sf_dir) -> DataFrame:
    shadow = trade_log(spark, sf_dir).select("symbol", "model_id", F.when(F.col("ret") > 0, (10 + F.col("id") % 90).cast("double")).alias("ttt"))
    return perf.bench_score(shadow, ["symbol", "model_id"])


@query(BENCH_SQL + " SELECT symbol, model_id, n, round(score, 6) AS score FROM b")
def prf7_bench_score(spark, sf_dir):
    return rounded(bench(spark, sf_dir), "score")


@query(BENCH_SQL + ", ch AS (SELECT symbol, arg_min(model_id, model_id) AS champion, arg_min(score, model_id) AS s FROM b GROUP BY symbol), best AS (SELECT symbol, arg_min(model_id, (score, model_id)) AS challenger, min(score) AS bs FROM b WHERE n >= 5 GROUP BY symbol) SELECT symbol, champion, challenger, coalesce(bs < s * 0.9, false) AS swap FROM ch LEFT JOIN best USING (symbol)")
def prf8_hotswap(spark, sf_dir):
    b = bench(spark, sf_dir).withColumns({"psr": F.lit(0.9), "drawdown": F.lit(0.1)})
    champions = b.groupBy("symbol").agg(F.min_by(F.struct("model_id", "score", "drawdown"), "model_id").alias("c")).select("symbol", "c.*")
    return perf.hotswap(b, champions)


@query(TRADES_SQL + """, l AS (SELECT model_id % 5 AS model_id, ts, avg(abs(ret)) * 4 AS loss FROM trades GROUP BY ALL), f AS (SELECT model_id, list_reduce(list_prepend(0.5::DOUBLE, list((1 - 2 * least(loss, 1))::DOUBLE ORDER BY ts)), lambda a, x: 0.9 * a + 0.1 * x) AS score FROM l GROUP BY model_id)
SELECT model_id, round(score, 6) AS score, round(exp(score) / sum(exp(score)) OVER (), 6) AS weight FROM f""")
def prf9_softmax_weights(spark, sf_dir):
    t = trade_log(spark, sf_dir).groupBy((F.col("model_id") % 5).alias("model_id"), "ts").agg((F.avg(F.abs("ret")) * 4).alias("loss"))
    return rounded(perf.softmax_weights(t, 0.1), "score", "weight")


@query(CROSS_SQL + ", o AS (SELECT symbol, ts, CASE WHEN close > open THEN 1 WHEN close < open THEN 2 ELSE 0 END AS b, close / nullif(open, 0) - 1 AS ret FROM bars) SELECT count(*) AS n, round(coalesce(avg(ret), 0), 6) AS score FROM sig JOIN o USING (symbol, ts) WHERE signal <> 0 AND b <> 0 AND signal <> b")
def prf10_counter_trade(spark, sf_dir):
    b = bars(spark, sf_dir)
    other = b.select("symbol", "ts", F.when(F.col("close") > F.col("open"), 1).when(F.col("close") < F.col("open"), 2).otherwise(0).alias("signal"), (F.col("close") / F.when(F.col("open") != 0, F.col("open")) - 1).alias("ret"))
    return rounded(perf.counter_trade(labels.ma_cross(b), other, other, ["symbol", "ts"]), "score")


@query(CROSS_SQL + ", p AS (SELECT symbol, ts, coalesce((last_value(nullif(signal, 0) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts) = 1)::INT, 0) AS position, close / open - 1 AS r FROM sig) SELECT symbol, round(sum(ln(1 + r)), 5) AS log_ret FROM p WHERE position = 1 GROUP BY symbol")
def prf11_adversarial_return(spark, sf_dir):
    p = labels.position(labels.ma_cross(bars(spark, sf_dir))).withColumn("r", F.col("close") / F.col("open") - 1)
    return rounded(perf.adversarial_return(p, "position", "r", ["symbol"]), "log_ret", digits=5)


@query("WITH p AS (SELECT l_shipdate, l_linenumber % 3 AS pred, [0.2 + l_discount, 0.3, 0.5 - l_discount] AS probs, l_returnflag FROM lineitem) SELECT l_returnflag, round(1 / (1 + avg(-ln(least(1 - 1e-15, greatest(1e-15, probs[pred + 1]))))), 6) AS mimicry FROM p GROUP BY l_returnflag")
def prf12_mimicry(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_linenumber") % 3).alias("pred"), F.array(0.2 + F.col("l_discount"), F.lit(0.3), 0.5 - F.col("l_discount")).alias("probs"))
    return rounded(perf.mimicry(p, "pred", "probs", ["l_returnflag"]), "mimicry")


@query(TRADES_SQL + " SELECT model_id, count(*) AS n, round(sum(net_pnl), 2) AS net_pnl, round(100.0 * count(*) FILTER (net_pnl > 0) / count(*), 6) AS win_rate FROM trades WHERE action = 'EXIT' GROUP BY model_id")
def agg4_pnl_by_model(spark, sf_dir):
    made = perf.pnl_by_model(trade_log(spark, sf_dir).where("action = 'EXIT'"))
    return rounded(rounded(made, "net_pnl", digits=2), "win_rate")


@query(TRADES_SQL + ", m2 AS (SELECT model_id, count(*) AS n, sum(net_pnl) AS p FROM trades GROUP BY model_id) SELECT arg_max(model_id, (p, -model_id)) AS model_id, arg_max(n, (p, -model_id)) AS n, sum(n)::BIGINT AS system_trades FROM m2")
def agg4_champion(spark, sf_dir):
    return perf.champion(perf.pnl_by_model(trade_log(spark, sf_dir))).select("model_id", "n", "system_trades")


@query(TRADES_SQL + " SELECT id, model_id, round(net_pnl, 4) AS net_pnl FROM trades QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY net_pnl DESC, id) <= 3 OR row_number() OVER (PARTITION BY model_id ORDER BY net_pnl, id) <= 3 OR row_number() OVER (PARTITION BY model_id ORDER BY ts DESC, id DESC) <= 3")
def set3_key_trades(spark, sf_dir):
    return rounded(perf.key_trades(trade_log(spark, sf_dir), ["model_id"], "net_pnl", ["ts"], "id").select("id", "model_id", "net_pnl"), "net_pnl", digits=4)


@query("SELECT o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) <= greatest(10, floor(0.02 * count(*) OVER ()))")
def top1_top_fraction(spark, sf_dir):
    return perf.top_fraction(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


@query("SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey)::INTEGER AS rank FROM orders QUALIFY rank <= 5")
def top2_best_per_key(spark, sf_dir):
    return aggregate.best_per_key(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", "o_orderkey").select("o_orderpriority", "o_orderkey", "rank")


ELITE_SQL = "WITH elite AS (SELECT 'm' || (o_custkey % 40) AS model_id, o_orderpriority AS symbol, CASE WHEN o_custkey % 2 = 0 THEN 'gp' ELSE 'nn' END AS architecture, max(o_totalprice) / 1000 AS profit_pct, bool_or(o_orderstatus = 'P') AS has_dna FROM orders GROUP BY ALL)"


def elite(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.concat(F.lit("m"), F.col("o_custkey") % 40).alias("model_id"), F.col("o_orderpriority").alias("symbol"), F.when(F.col("o_custkey") % 2 == 0, "gp").otherwise("nn").alias("architecture")).agg((F.max("o_totalprice") / 1000).alias("profit_pct"), F.bool_or(F.col("o_orderstatus") == "P").alias("has_dna"))


@query(ELITE_SQL + " SELECT model_id, symbol, round(profit_pct, 6) AS profit_pct FROM elite WHERE symbol = '1-URGENT' AND architecture = 'gp' ORDER BY elite.profit_pct DESC, model_id DESC LIMIT 1")
def top3_best_elite(spark, sf_dir):
    return rounded(aggregate.best_elite(elite(spark, sf_dir), "1-URGENT", "gp").select("model_id", "symbol", "profit_pct"), "profit_pct")


@query(ELITE_SQL + " SELECT count(*) AS n, round(avg(profit_pct), 6) AS avg_profit, round(max(profit_pct), 6) AS max_profit, count(*) FILTER (has_dna) AS with_dna FROM elite")
def agg7_elite_stats(spark, sf_dir):
    return rounded(aggregate.elite_stats(elite(spark, sf_dir)), "avg_profit", "max_profit")


@query(ELITE_SQL + " SELECT model_id, symbol, round(profit_pct, 6) AS profit_pct FROM elite WHERE architecture = 'nn'")
def top4_registry_listing(spark, sf_dir):
    return rounded(aggregate.registry_listing(elite(spark, sf_dir), "nn", "architecture", "profit_pct").select("model_id", "symbol", "profit_pct"), "profit_pct")


@query("SELECT p_brand AS feature, round(avg(p_size - 30.0), 6) AS mean_importance FROM part GROUP BY p_brand HAVING avg(p_size - 30.0) <= 0")
def agg6_prune_list(spark, sf_dir):
    return rounded(aggregate.prune_list(table(spark, sf_dir, "part").select(F.col("p_brand").alias("feature"), (F.col("p_size") - 30.0).alias("importance"))), "mean_importance")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def snk5_latest_by_key(spark, sf_dir):
    return latest_by_key(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey")


# resampling tests ---------------------------------------------------------------------------------------


@query()
def rst1_bootstrap_ci(spark, sf_dir):
    return resample.bootstrap_ci(trade_log(spark, sf_dir).where("action = 'EXIT'"), "ret", ["model_id"], ["ts", "id"], reps=1000)


@query()
def rst2_permutation_importance(spark, sf_dir):
    b = indicators.shifted(bars(spark, sf_dir), {"ret": ("close", "pct", 1), "nxt": ("close", "lead", 1)}).dropna()
    score = lambda d: d.groupBy("symbol").agg(F.avg(F.signum("ret") * (F.col("nxt") - F.col("close"))).alias("score"))
    return resample.permutation_importance(b, ["ret", "volume"], score, ["symbol"], ["ts"])


@query()
def rst3_noise(spark, sf_dir):
    return resample.add_noise(bars(spark, sf_dir), ["open", "high", "low", "close"]).select("symbol", "ts", "close")


CHECKS_SQL = TRADES_SQL + ", g AS (SELECT model_id, avg(ret) AS a, count(*) AS n, min(ret) AS lo FROM trades GROUP BY model_id), checks AS (SELECT model_id, 1 AS step, 'count' AS \"check\", n >= 300 AS passed FROM g UNION ALL SELECT model_id, 2, 'mean', a > 0 FROM g UNION ALL SELECT model_id, 3, 'worst', lo > -0.0999 FROM g)"


@query(CHECKS_SQL + ", f AS (SELECT *, min(step) FILTER (NOT passed) OVER (PARTITION BY model_id) AS fs FROM checks) SELECT model_id, step, \"check\", passed, CASE WHEN fs IS NULL THEN 'passed' ELSE 'failed' END AS verdict FROM f WHERE fs IS NULL OR step <= fs")
def rst5_gauntlet_report(spark, sf_dir):
    g = trade_log(spark, sf_dir).groupBy("model_id").agg(F.avg("ret").alias("a"), F.count(F.lit(1)).alias("n"), F.min("ret").alias("lo"))
    steps = F.array(F.struct(F.lit(1).alias("step"), F.lit("count").alias("check"), (F.col("n") >= 300).alias("passed")), F.struct(F.lit(2).alias("step"), F.lit("mean").alias("check"), (F.col("a") > 0).alias("passed")), F.struct(F.lit(3).alias("step"), F.lit("worst").alias("check"), (F.col("lo") > -0.0999).alias("passed")))
    return resample.gauntlet_report(g.select("model_id", F.explode(steps).alias("s")).select("model_id", "s.*"), ["model_id"])


@query(TRADES_SQL + ", f AS (SELECT model_id, year(ts) AS fold, avg(ret) * 100 AS sharpe FROM trades GROUP BY ALL) SELECT model_id, round(avg(sharpe), 6) AS \"avg\", round(min(sharpe), 6) AS worst, avg(sharpe) >= 0.01 AND min(sharpe) >= 0 AS passed FROM f GROUP BY model_id")
def rst6_gates(spark, sf_dir):
    folds = trade_log(spark, sf_dir).groupBy("model_id", F.year("ts").alias("fold")).agg((F.avg("ret") * 100).alias("sharpe"))
    return rounded(resample.walk_forward_gate(folds, ["model_id"], least=0.01), "avg", "worst")


# risk -----------------------------------------------------------------------------------------------------


@query(TRADES_SQL + """, q AS (SELECT model_id AS account, ts, id, 3000000 + sum(net_pnl) OVER (PARTITION BY model_id ORDER BY ts, id) AS equity FROM trades), d AS (SELECT account, ts, arg_max(equity, id) AS equity FROM q GROUP BY account, ts),
x AS (SELECT *, date_trunc('month', ts) AS m FROM d), f AS (SELECT *, coalesce((first_value(equity) OVER dy - equity) / nullif(first_value(equity) OVER dy, 0) >= 0.10, false) AS l, CASE WHEN max(equity) OVER li > 0 THEN coalesce((max(equity) OVER li - equity) / max(equity) OVER li >= 0.30, false) ELSE false END AS pk
 FROM x WINDOW dy AS (PARTITION BY account, CAST(ts AS DATE) ORDER BY ts), li AS (PARTITION BY account ORDER BY ts))
SELECT account, ts, bool_or(l) OVER (PARTITION BY account, CAST(ts AS DATE) ORDER BY ts) AS daily_tripped, bool_or(pk) OVER (PARTITION BY account ORDER BY ts) AS peak_tripped FROM f""")
def rsk1_circuit_breaker(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("model_id").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    q = trade_log(spark, sf_dir).select(F.col("model_id").alias("account"), "ts", "id", (F.lit(3_000_000.0) + F.sum("net_pnl").over(w)).alias("equity"))
    return risk.circuit_breaker(q.groupBy("account", "ts").agg(F.max_by("equity", "id").alias("equity"))).select("account", "ts", "daily_tripped", "peak_tripped")


@query(BARS_SQL + ATR_SQL + " SELECT symbol, ts FROM atr WHERE atr_14 / (close + 1e-9) <= 1.5")
def rsk2_volatility_gate(spark, sf_dir):
    return risk.volatility_gate(indicators.atr(bars(spark, sf_dir)), "atr_ratio_14", 1.5).select("symbol", "ts")


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN b > 0 THEN greatest(0.0, least(1.0, 0.2 * (p - (1 - p) / b))) ELSE 0 END, 6) AS size FROM (SELECT l_orderkey, l_linenumber, 0.5 + l_discount AS p, l_quantity / 20 - 0.1 AS b FROM lineitem)")
def rsk3_kelly(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return rounded(li.select("l_orderkey", "l_linenumber", risk.kelly(0.5 + F.col("l_discount"), F.col("l_quantity") / 20 - 0.1).alias("size")), "size")


@query(BARS_SQL + ATR_SQL + ", e AS (SELECT symbol, ts, CASE WHEN symbol IN ('click', 'view') THEN max(high) OVER w - 3 * atr_14 ELSE min(low) OVER w + 3 * atr_14 END AS e FROM atr WINDOW w AS (PARTITION BY symbol ORDER BY ts)) SELECT symbol, ts, round(CASE WHEN symbol IN ('click', 'view') THEN max(e) OVER w ELSE min(e) OVER w END, 6) AS stop FROM e WINDOW w AS (PARTITION BY symbol ORDER BY ts)")
def rsk4_trailing_stop(spark, sf_dir):
    b = indicators.atr(bars(spark, sf_dir)).withColumns({"side": F.when(F.col("symbol").isin("click", "view"), "long").otherwise("short"), "atr": F.col("atr_14")})
    return rounded(risk.trailing_stop(b, by=("symbol",)).select("symbol", "ts", "stop"), "stop")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS kelly, 1 - l_tax AS rm, l_discount * 10 - 0.5 AS sk, l_tax * 12 AS pr, l_discount AS inf, l_linenumber = 7 AS un FROM lineitem),
s AS (SELECT *, least(kelly, 0.95) * rm * CASE WHEN sk < -0.2 THEN 0.5 ELSE 1 END * CASE WHEN pr > 0.8 THEN 0.3 ELSE 1 END * greatest(0.1, 1 - abs(inf * 2)) * CASE WHEN un THEN 0.1 ELSE 1 END AS size FROM x) SELECT l_orderkey, l_linenumber, round(CASE WHEN size > 0.01 THEN size ELSE 0 END, 6) AS size FROM s""")
def rsk5_size_chain(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    x = li.select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("kelly"), (1 - F.col("l_tax")).alias("risk_multiplier"), (F.col("l_discount") * 10 - 0.5).alias("mce_skew"), (F.col("l_tax") * 12).alias("mce_pressure"), F.col("l_discount").alias("influence"), (F.col("l_linenumber") == 7).alias("unusual"))
    return rounded(risk.size_chain(x).select("l_orderkey", "l_linenumber", "size"), "size")


EXIT_SQL = BARS_SQL + ATR_SQL + """, d AS (SELECT *, date_trunc('day', ts) AS day, first_value(close) OVER w AS ec, first_value(atr_14) OVER w AS ea, first_value(ts) OVER w AS ets FROM atr WINDOW w AS (PARTITION BY symbol, date_trunc('day', ts) ORDER BY ts)),
y AS (SELECT symbol, day, ts, close, CASE WHEN close <= ec - 0.5 * ea THEN 'stop_loss' WHEN close >= ec + 0.5 * ea THEN 'take_profit' WHEN (epoch_us(ts) - epoch_us(ets)) / 60e6 > CASE WHEN close > 0 THEN CASE WHEN 100 * atr_14 / close >= 2.5 THEN 3 WHEN 100 * atr_14 / close >= 1.5 THEN 5 WHEN 100 * atr_14 / close >= 1.0 THEN 7 WHEN 100 * atr_14 / close >= 0.5 THEN 9 ELSE 10 END ELSE 7 END THEN 'timeout' END AS why FROM d)"""


@query(EXIT_SQL + " SELECT symbol, day, min(ts) AS exit_ts, arg_min(why, ts) AS reason FROM y WHERE why IS NOT NULL GROUP BY symbol, day")
def rsk6_exit_reason(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("symbol", "day").orderBy("ts")
    b = indicators.atr(bars(spark, sf_dir)).withColumn("day", F.date_trunc("day", "ts")).withColumns({"entry_ts": F.first("ts").over(w), "_c": F.first("close").over(w), "_a": F.first("atr_14").over(w), "atr": F.col("atr_14"), "signal": F.lit(0)})
    b = b.withColumns({"stop_loss": F.col("_c") - 0.5 * F.col("_a"), "take_profit": F.col("_c") + 0.5 * F.col("_a")})
    return risk.exit_reason(b, ("symbol", "day")).select("symbol", "day", "exit_ts", "reason")


@query(BARS_SQL + ATR_SQL + " SELECT symbol, ts, CASE WHEN hour(ts) % 3 = 0 THEN 3.5 WHEN hour(ts) % 3 = 1 THEN 2.5 ELSE 2.0 END::DOUBLE AS reward, round(close - 2 * atr_14, 6) AS stop_loss, round(close + 2 * atr_14 * CASE WHEN hour(ts) % 3 = 0 THEN 3.5 WHEN hour(ts) % 3 = 1 THEN 2.5 ELSE 2.0 END, 6) AS take_profit FROM atr")
def rsk7_levels(spark, sf_dir):
    b = indicators.atr(bars(spark, sf_dir)).withColumn("regime", F.hour("ts") % 3)
    return rounded(risk.levels(b, atr="atr_14").select("symbol", "ts", "reward", "stop_loss", "take_profit"), "stop_loss", "take_profit")
