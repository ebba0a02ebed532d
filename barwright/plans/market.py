"""Queries over ticks, bars and books: cleaning, joins, aggregation, windows, order flow."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.functions import scalar
from barwright.operators import aggregate, asof, book, clean, indicators, labels
from barwright.operators.scan import chunked, ewm, indexed
from barwright.plans.fixtures import BARS_SQL, LEVELS_SQL, TICKS_SQL, TRADES_SQL, bars, bars_sql, book_levels, book_messages, scratch, table, ticks, trade_log
from barwright.sources import readers

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def holes(spark, sf_dir) -> DataFrame:
    """Bars whose close is missing every fifth hour and infinite every seventh."""
    b = bars(spark, sf_dir)
    h = F.hour("ts")
    return b.withColumn("close", F.when(h % 7 == 3, float("inf")).when(h % 5 == 0, None).otherwise(F.col("close")))


HOLES_SQL = BARS_SQL + ", holes AS (SELECT * REPLACE (CASE WHEN hour(ts) % 7 = 3 OR hour(ts) % 5 = 0 THEN NULL ELSE close END AS close) FROM bars)"


# cleaning and validation --------------------------------------------------------------------------


@query(HOLES_SQL + " SELECT symbol, ts, close FROM holes WHERE close IS NOT NULL")
def cln1_sanitize(spark, sf_dir):
    return clean.sanitize(holes(spark, sf_dir), ["close"], "drop").select("symbol", "ts", "close")


@query(HOLES_SQL + " SELECT symbol, ts, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts) AS close FROM holes")
def cln2_forward_fill(spark, sf_dir):
    return clean.fill(clean.sanitize(holes(spark, sf_dir), ["close"]), ["close"], "ffill", ["symbol"], ["ts"]).select("symbol", "ts", "close")


@query(HOLES_SQL + " SELECT symbol, ts, first_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS close FROM holes")
def cln3_backward_fill(spark, sf_dir):
    return clean.fill(clean.sanitize(holes(spark, sf_dir), ["close"]), ["close"], "bfill", ["symbol"], ["ts"]).select("symbol", "ts", "close")


@query(HOLES_SQL + """, n AS (SELECT symbol, ts, close, epoch_us(ts) AS t,
  last_value(CASE WHEN close IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) OVER p AS pt, last_value(close IGNORE NULLS) OVER p AS pv,
  first_value(CASE WHEN close IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) OVER f AS nt, first_value(close IGNORE NULLS) OVER f AS nv
  FROM holes WINDOW p AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT symbol, ts, round(coalesce(close, pv + (nv - pv) * (t - pt) / (nt - pt), pv, nv), 6) AS close FROM n""")
def cln4_time_interpolation(spark, sf_dir):
    made = clean.fill(clean.sanitize(holes(spark, sf_dir), ["close"]), ["close"], "time", ["symbol"], ["ts"])
    return rounded(made.select("symbol", "ts", "close"), "close")


@query(BARS_SQL + " SELECT 'close' AS \"column\", round(var_samp(close), 6) AS variance FROM bars UNION ALL SELECT 'flat', round(var_samp(1.0), 6) FROM bars UNION ALL SELECT 'volume', round(var_samp(volume), 6) FROM bars")
def cln5_column_variance(spark, sf_dir):
    return rounded(clean.column_variance(bars(spark, sf_dir).withColumn("flat", F.lit(1.0)), ["close", "flat", "volume"]), "variance")


@query(BARS_SQL + " SELECT symbol, ts, open AS x_open_1h, high AS x_high_1h, low AS x_low_1h, close AS x_close_1h, volume AS x_volume_1h FROM bars")
def cln6_affix(spark, sf_dir):
    return clean.affix(bars(spark, sf_dir), ["symbol", "ts"], "x_", "_1h")


@query(BARS_SQL + """, d AS (SELECT *, close - lag(close) OVER w AS mv, abs(close / nullif(lag(close) OVER w, 0) - 1) AS jump, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS age FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
g AS (SELECT symbol, greatest(avg((open IS NULL)::INT), avg((high IS NULL)::INT), avg((low IS NULL)::INT), avg((close IS NULL)::INT))::DOUBLE AS nulls,
  (sum((open <= 0)::INT) + sum((high <= 0)::INT) + sum((low <= 0)::INT) + sum((close <= 0)::INT))::DOUBLE AS low,
  CASE WHEN min(CASE WHEN age > 10 THEN 1 WHEN coalesce(mv, 0) = 0 THEN 1 ELSE 0 END) = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS stale, coalesce(max(jump), 0) AS spike FROM d GROUP BY symbol)
SELECT symbol, 'null_ratio' AS "check", nulls <= 0.1 AS passed, round(nulls, 6) AS value FROM g UNION ALL SELECT symbol, 'non_positive', low <= 0, round(low, 6) FROM g
UNION ALL SELECT symbol, 'stale', stale <= 0, round(stale, 6) FROM g UNION ALL SELECT symbol, 'spike', spike <= 0.2, round(spike, 6) FROM g""")
def val1_validate_bars(spark, sf_dir):
    return rounded(clean.validate_bars(bars(spark, sf_dir), ["symbol"], ["ts"]), "value")


@query(f"WITH {TICKS_SQL} SELECT symbol, ts, id, price FROM ticks WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' AND symbol IN ('click', 'view')")
def flt1_range_filter(spark, sf_dir):
    t = ticks(spark, sf_dir)
    return t.where((F.col("ts") >= "2024-01-05") & (F.col("ts") < "2024-01-12") & F.col("symbol").isin("click", "view")).select("symbol", "ts", "id", "price")


@query("SELECT quality, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, count(*) / sum(count(*)) OVER () < 0.1 AS scarce FROM labels GROUP BY quality")
def flt2_class_balance(spark, sf_dir):
    return rounded(clean.class_balance(table(spark, sf_dir, "labels"), "quality"), "share")


# joins --------------------------------------------------------------------------------------------


@query(f"""WITH {TICKS_SQL}, l AS (SELECT id, user_id, ts FROM ticks WHERE symbol = 'purchase'), r AS (SELECT user_id, ts, max(id) AS view_id FROM ticks WHERE symbol = 'view' GROUP BY user_id, ts)
SELECT l.id, l.user_id, l.ts, r.view_id, r.ts AS ts_right FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def jn1_asof_join(spark, sf_dir):
    t = ticks(spark, sf_dir)
    left = t.where("symbol = 'purchase'").select("id", "user_id", "ts")
    right = t.where("symbol = 'view'").select("user_id", "ts", F.col("id").alias("view_id"))
    return asof.asof_join(left, right, "ts", ["user_id"], right_tie="view_id")


@query(f"""WITH {TICKS_SQL}, l AS (SELECT id, ts FROM ticks WHERE symbol = 'purchase'), r AS (SELECT ts, max(id) AS view_id FROM ticks WHERE symbol = 'view' GROUP BY ts)
SELECT l.id, l.ts, r.view_id, r.ts AS ts_right FROM l ASOF LEFT JOIN r ON l.ts < r.ts""")
def jn1_asof_forward_chunked(spark, sf_dir):
    t = ticks(spark, sf_dir)
    left = t.where("symbol = 'purchase'").select("id", "ts")
    right = t.where("symbol = 'view'").groupBy("ts").agg(F.max("id").alias("view_id"))
    return asof.asof_join(left, right, "ts", [], "forward", allow_exact=False, chunk="day")


MTF_SQL = f"WITH {TICKS_SQL}, {bars_sql('b15', '15 minutes')}, {bars_sql('b60', '1 hour')}, f60 AS (SELECT symbol, ts + INTERVAL '1 hour' AS ts, avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 9 PRECEDING) AS m, count(*) OVER (PARTITION BY symbol ORDER BY ts ROWS 9 PRECEDING) AS n FROM b60)"


@query(MTF_SQL + " SELECT b.symbol, b.ts, b.close, round(CASE WHEN n = 10 THEN m END, 6) AS sma_10_1h FROM b15 b ASOF LEFT JOIN f60 f ON b.symbol = f.symbol AND b.ts >= f.ts")
def jn2_mtf_align(spark, sf_dir):
    frames = {"15m": bars(spark, sf_dir, "15 minutes"), "1h": indicators.sma(bars(spark, sf_dir), "close", 10)}
    return rounded(asof.mtf_align(frames, ["symbol"]).select("symbol", "ts", "close", "sma_10_1h"), "sma_10_1h")


@query(MTF_SQL + " SELECT b.symbol, b.ts, round(CASE WHEN n = 10 THEN m END, 6) AS tactical_sma_10 FROM b15 b ASOF LEFT JOIN f60 f ON b.symbol = f.symbol AND b.ts >= f.ts")
def jn3_mtf_align_prefixed(spark, sf_dir):
    frames = {"15m": bars(spark, sf_dir, "15 minutes"), "1h": indicators.sma(bars(spark, sf_dir), "close", 10)}
    return rounded(asof.mtf_align(frames, ["symbol"], naming="prefix", prefixes={"1h": "tactical"}).select("symbol", "ts", "tactical_sma_10"), "tactical_sma_10")


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def jn4_attributes(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("c_custkey", "n_name", "r_name")


@query(f"""WITH {TICKS_SQL}, a AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS day, sum(price) AS tvl FROM ticks WHERE symbol = 'view' GROUP BY 1), b AS (SELECT CAST(ts AS DATE) AS day, sum(qty) AS supply FROM ticks WHERE symbol = 'click' GROUP BY 1),
j AS (SELECT coalesce(a.day, b.day) AS day, tvl, supply FROM a FULL JOIN b ON a.day = b.day)
SELECT day, round(last_value(tvl IGNORE NULLS) OVER w, 6) AS tvl, round(last_value(supply IGNORE NULLS) OVER w, 6) AS supply FROM j WINDOW w AS (ORDER BY day)""")
def jn5_full_join_filled(spark, sf_dir):
    """A weekly and a daily series."""
    t = ticks(spark, sf_dir)
    a = t.where("symbol = 'view'").groupBy(F.to_date(F.date_trunc("week", "ts")).alias("day")).agg(F.sum("price").alias("tvl"))
    b = t.where("symbol = 'click'").groupBy(F.to_date("ts").alias("day")).agg(F.sum("qty").alias("supply"))
    return rounded(asof.full_join_filled(a, b, "day"), "tvl", "supply")


@query(BARS_SQL + ", a AS (SELECT symbol, ts, close, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS prev FROM bars) SELECT bars.symbol, bars.ts, bars.close, prev FROM bars JOIN a USING (symbol, ts) WHERE prev IS NOT NULL")
def jn6_aligned_concat(spark, sf_dir):
    b = bars(spark, sf_dir)
    prev = indicators.shifted(b, {"prev": ("close", "lag", 1)}).select("symbol", "ts", "prev")
    return b.select("symbol", "ts", "close").join(prev, ["symbol", "ts"]).dropna()


@query(f"""WITH {TICKS_SQL}, ev AS (SELECT DISTINCT ts AS ets FROM ticks WHERE symbol = 'error' AND id % 50 < 3), t AS (SELECT id, ts FROM ticks WHERE symbol = 'purchase'),
n AS (SELECT id, ts, ets AS nxt FROM t ASOF LEFT JOIN ev ON t.ts <= ets), p AS (SELECT id, ets AS prv FROM t ASOF LEFT JOIN ev ON t.ts >= ets)
SELECT n.id, n.ts, coalesce(round((epoch_us(nxt) - epoch_us(ts)) / 60e6, 6), 'infinity'::DOUBLE) AS minutes_to_next,
  coalesce((epoch_us(nxt) - epoch_us(ts)) / 60e6 < 60, false) OR coalesce((epoch_us(ts) - epoch_us(prv)) / 60e6 < 60, false) AS blackout, coalesce((epoch_us(nxt) - epoch_us(ts)) / 60e6 <= 30, false) AS force_close
FROM n JOIN p USING (id)""")
def jn7_9_event_flags(spark, sf_dir):
    t = ticks(spark, sf_dir)
    made = asof.event_flags(t.where("symbol = 'purchase'").select("id", "ts"), t.where("symbol = 'error' and id % 50 < 3").select("ts"))
    return made.withColumn("minutes_to_next", F.round(F.col("minutes_to_next") * 1e6) / 1e6)  # halves go as in SQL


@query(BARS_SQL + " SELECT ts, max(CASE WHEN symbol = 'click' THEN close END) AS click, max(CASE WHEN symbol = 'error' THEN close END) AS error, max(CASE WHEN symbol = 'view' THEN close END) AS view FROM bars WHERE symbol IN ('click', 'error', 'view') GROUP BY ts")
def jn10_pivot_closes(spark, sf_dir):
    return aggregate.pivot_closes(bars(spark, sf_dir).where("symbol in ('click', 'error', 'view')"), ["click", "error", "view"])


@query("SELECT DISTINCT p_brand AS formula FROM part WHERE p_size > 25 AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 3)")
def jn11_new_rows(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return asof.new_rows(p.where("p_size > 25").select(F.col("p_brand").alias("formula")), p.where("p_size = 3").select(F.col("p_brand").alias("formula")), ["formula"])


@query(f"WITH {TICKS_SQL} SELECT id, symbol, ts FROM ticks WHERE ts > (SELECT max(ts) FROM ticks WHERE ts < TIMESTAMP '2024-01-20')")
def src7_incremental(spark, sf_dir):
    """All ticks come in again; those up to the 20th are there already."""
    t = ticks(spark, sf_dir).select("id", "symbol", "ts")
    return readers.incremental(t.where("ts < timestamp '2024-01-20'"), t, "ts", ["id"])


@query(f"WITH {TICKS_SQL}, k AS (SELECT user_id, max(ts) AS newest FROM ticks GROUP BY user_id) SELECT user_id, newest, round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(newest)) / 3.6e9, 6) AS age_hours, newest < TIMESTAMP '2024-02-01' - INTERVAL '240 hours' AS stale FROM k")
def src7_stale_keys(spark, sf_dir):
    return rounded(readers.stale_keys(ticks(spark, sf_dir), ["user_id"], "ts", 240, F.lit("2024-02-01").cast("timestamp")), "age_hours")


# sources and sinks: written to the shared folder and read back -----------------------------------------


@query(BARS_SQL + " SELECT symbol, ts, close, volume FROM bars")
def src1_bars_from_csv(spark, sf_dir):
    path = scratch(spark, "bars-csv")
    b = bars(spark, sf_dir).withColumn("tf", F.lit("1h"))
    b.select("symbol", "tf", "ts", "open", "high", "low", "close", "volume").write.option("header", True).csv(path)
    return readers.read_bars(spark, path).select("symbol", "ts", "close", "volume")


@query(BARS_SQL + " SELECT symbol, ts, open, close, CAST(ts AS DATE) AS date FROM bars")
def snk1_bars_by_symbol_and_date(spark, sf_dir):
    path = scratch(spark, "bars")
    readers.write_bars(bars(spark, sf_dir), path)
    return spark.read.parquet(path).select("symbol", "ts", "open", "close", "date")


@query(f"WITH {TICKS_SQL} SELECT id, symbol, price, CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS hour FROM ticks")
def snk2_ticks_by_hour(spark, sf_dir):
    path = scratch(spark, "ticks")
    readers.write_ticks(ticks(spark, sf_dir), path)
    return spark.read.parquet(path).select("id", "symbol", "price", "date", "hour")


@query(TRADES_SQL + " SELECT CAST(model_id AS VARCHAR) AS model_id, symbol, ts, action, round(net_pnl, 4) AS net_pnl FROM trades")
def src5_snk4_trade_log(spark, sf_dir):
    path = scratch(spark, "log")
    t = trade_log(spark, sf_dir).select(F.col("model_id").cast("string").alias("model_id"), "symbol", F.col("ts").alias("timestamp"), "action", F.round("net_pnl", 4).cast("string").alias("net_pnl"))
    readers.append_trade_log(t.where("action = 'EXIT'"), path)
    readers.append_trade_log(t.where("action <> 'EXIT'"), path)
    return readers.read_trade_log(spark, path).select("model_id", "symbol", F.col("timestamp").alias("ts"), "action", F.round(F.col("net_pnl").cast("double"), 4).alias("net_pnl"))


@query(LEVELS_SQL + " SELECT CAST(book_id AS VARCHAR) AS symbol, book_id AS u, side, CAST(lvl AS INTEGER) AS pos, price, qty FROM ranked")
def src4_l2_messages(spark, sf_dir):
    """Each book as one JSON message, parsed back into level rows."""
    pair = F.struct(F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price")).alias("o"), F.col("price").cast("string").alias("p"), F.col("qty").cast("string").alias("q"))
    side = lambda name: F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == name, pair))), lambda x: F.array(x["p"], x["q"]))
    books = book_levels(spark, sf_dir).groupBy("book_id").agg(side("bid").alias("b"), side("ask").alias("a"))
    data = F.struct(F.col("book_id").cast("string").alias("s"), F.col("book_id").alias("u"), "b", "a")
    lines = books.select(F.to_json(F.struct(F.lit("orderbook.50.X").alias("topic"), F.lit("snapshot").alias("type"), data.alias("data"))).alias("value"))
    return readers.read_l2_messages(lines).select("symbol", "u", "side", "pos", "price", "qty")


# aggregation ----------------------------------------------------------------------------------------


@query(BARS_SQL + " SELECT * FROM bars")
def agg1_ohlcv(spark, sf_dir):
    return bars(spark, sf_dir).select("symbol", "ts", "open", "high", "low", "close", "volume")


@query(BARS_SQL + """, g AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL '1 hour')) AS ts FROM bars GROUP BY symbol),
j AS (SELECT g.symbol, g.ts, open, high, low, volume, last_value(close IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.ts) AS close FROM g LEFT JOIN bars USING (symbol, ts))
SELECT symbol, ts, coalesce(open, close) AS open, coalesce(high, close) AS high, coalesce(low, close) AS low, close, coalesce(volume, 0) AS volume FROM j""")
def agg2_filled_grid(spark, sf_dir):
    return aggregate.fill_grid(bars(spark, sf_dir), "1 hour").select("symbol", "ts", "open", "high", "low", "close", "volume")


@query(f"WITH {TICKS_SQL} SELECT CAST(ts AS DATE) AS day, round(sum(price) + sum(qty), 6) AS total FROM ticks GROUP BY 1")
def agg3_daily_sum(spark, sf_dir):
    t = ticks(spark, sf_dir).withColumn("chains", F.create_map(F.lit("a"), "price", F.lit("b"), "qty"))
    return rounded(aggregate.daily_sum(t, "ts", "chains"), "total")


@query(BARS_SQL + " SELECT symbol, arg_max(ts, ts) AS ts, arg_max(close, ts) AS close, arg_max(volume, ts) AS volume FROM bars GROUP BY symbol")
def agg5_latest(spark, sf_dir):
    return aggregate.latest(bars(spark, sf_dir), ["symbol"], ["ts"]).select("symbol", "ts", "close", "volume")


@query(BARS_SQL + " SELECT symbol, round(quantile_cont(close, 0.25), 6) AS q25, round(quantile_cont(close, 0.5), 6) AS q50, round(quantile_cont(close, 0.75), 6) AS q75, round(quantile_cont(close, 0.75) - quantile_cont(close, 0.25), 6) AS iqr FROM bars GROUP BY symbol")
def agg8_quantiles(spark, sf_dir):
    return rounded(aggregate.quantiles(bars(spark, sf_dir), "close", ["symbol"]), "q25", "q50", "q75", "iqr")


APPENDED_SQL = "SELECT o_orderkey AS id, o_totalprice AS amount, NULL::INTEGER AS line FROM orders UNION ALL SELECT l_orderkey, l_quantity, l_linenumber FROM lineitem"


@query(APPENDED_SQL)
def set1_2_append_aligned(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("amount"), F.col("l_linenumber").alias("line"))
    return aggregate.concat_all([a, b])


@query(APPENDED_SQL)
def set1_2_append_aligned_whole(spark, sf_dir):
    """The same under its earlier name."""
    return set1_2_append_aligned(spark, sf_dir)


@query(BARS_SQL + " SELECT symbol, ts, close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 24")
def src2_last_n(spark, sf_dir):
    from barwright.operators.perf import last_n

    return last_n(bars(spark, sf_dir), 24, ["symbol"], ["ts"]).select("symbol", "ts", "close")


# windows ----------------------------------------------------------------------------------------


def _roll(n: int, expr: str, order: str = "ts") -> str:
    f = f"(PARTITION BY symbol ORDER BY {order} ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count(close) OVER {f} >= {n} THEN {expr.replace('$W', f)} END"


@query(BARS_SQL + f" SELECT symbol, ts, round({_roll(10, 'avg(close) OVER $W')}, 6) AS sma_10, round({_roll(50, 'avg(close) OVER $W')}, 6) AS sma_50 FROM bars")
def win1_sma(spark, sf_dir):
    made = indicators.rolling(bars(spark, sf_dir), {"sma_10": ("close", "mean", 10), "sma_50": ("close", "mean", 50)})
    return rounded(made.select("symbol", "ts", "sma_10", "sma_50"), "sma_10", "sma_50")


def _ewm_sql(x: str, alpha: float) -> str:
    """Exponential mean of a never-null column by folding each row's whole past."""
    return f"list_reduce(list({x}) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), lambda a, x: {1 - alpha!r} * a + {alpha!r} * x)"


@query(BARS_SQL + f" SELECT symbol, ts, round({_ewm_sql('close', 2 / 31)}, 6) AS ewm_30 FROM bars")
def win2_ewm(spark, sf_dir):
    return rounded(indicators.ema(bars(spark, sf_dir), "close", 30, out="ewm_30").select("symbol", "ts", "ewm_30"), "ewm_30")


@query(BARS_SQL + f""", n AS (SELECT *, row_number() OVER w AS i, avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING) AS m FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
s AS (SELECT symbol, ts, CASE WHEN i = 20 THEN m ELSE close END AS x FROM n WHERE i >= 20), e AS (SELECT symbol, ts, {_ewm_sql('x', 2 / 21)} AS ema_20 FROM s)
SELECT symbol, ts, round(ema_20, 6) AS ema_20 FROM bars LEFT JOIN e USING (symbol, ts)""")
def win3_ema_sma_seed(spark, sf_dir):
    return rounded(indicators.ema(bars(spark, sf_dir), "close", 20, seed="sma").select("symbol", "ts", "ema_20"), "ema_20")


RSI_SQL = f""", d AS (SELECT symbol, ts, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS d FROM bars), g AS (SELECT symbol, ts, greatest(d, 0) AS up, greatest(-d, 0) AS dn FROM d WHERE d IS NOT NULL),
e AS (SELECT symbol, ts, {_ewm_sql('up', 1 / 14)} AS u, {_ewm_sql('dn', 1 / 14)} AS v FROM g), rsi AS (SELECT symbol, ts, 100 * u / nullif(u + v, 0) AS rsi_14 FROM bars LEFT JOIN e USING (symbol, ts))"""


@query(BARS_SQL + RSI_SQL + " SELECT symbol, ts, round(rsi_14, 6) AS rsi_14 FROM rsi")
def win4_rsi(spark, sf_dir):
    return rounded(indicators.rsi(bars(spark, sf_dir)).select("symbol", "ts", "rsi_14"), "rsi_14")


@query(BARS_SQL + f", l AS (SELECT symbol, ts, {_ewm_sql('close', 2 / 13)} - {_ewm_sql('close', 2 / 27)} AS macd FROM bars), s AS (SELECT symbol, ts, macd, {_ewm_sql('macd', 2 / 10)} AS sig FROM l) SELECT symbol, ts, round(macd, 6) AS macd, round(sig, 6) AS macd_signal, round(macd - sig, 6) AS macd_hist FROM s")
def win5_macd(spark, sf_dir):
    return rounded(indicators.macd(bars(spark, sf_dir)).select("symbol", "ts", "macd", "macd_signal", "macd_hist"), "macd", "macd_signal", "macd_hist")


BANDS_SQL = f", m AS (SELECT symbol, ts, close, {_roll(20, 'avg(close) OVER $W')} AS mid, {_roll(20, 'stddev_samp(close) OVER $W')} AS sd FROM bars)"


@query(BARS_SQL + BANDS_SQL + " SELECT symbol, ts, round(mid - 2 * sd, 6) AS bb_low, round(mid, 6) AS bb_mid, round(mid + 2 * sd, 6) AS bb_high, round(100 * 4 * sd / nullif(mid, 0), 6) AS bb_width, round((close - mid + 2 * sd) / nullif(4 * sd, 0), 6) AS bb_pos FROM m")
def win6_bollinger(spark, sf_dir):
    names = ["bb_low", "bb_mid", "bb_high", "bb_width", "bb_pos"]
    return rounded(indicators.bbands(bars(spark, sf_dir)).select("symbol", "ts", *names), *names)


TR_SQL = ", tr AS (SELECT *, coalesce(greatest(high - low, abs(high - pc), abs(low - pc)), high - low) AS tr FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc FROM bars))"
ATR_SQL = TR_SQL + f", atr AS (SELECT *, {_ewm_sql('tr', 1 / 14)} AS atr_14 FROM tr)"


@query(BARS_SQL + ATR_SQL + " SELECT symbol, ts, round(atr_14, 6) AS atr_14, round(atr_14 / (close + 1e-9), 6) AS atr_ratio_14 FROM atr")
def win7_8_atr(spark, sf_dir):
    return rounded(indicators.atr(bars(spark, sf_dir)).select("symbol", "ts", "atr_14", "atr_ratio_14"), "atr_14", "atr_ratio_14")


@query(BARS_SQL + TR_SQL + f""", mv AS (SELECT symbol, ts, tr, high - lag(high) OVER w AS up, lag(low) OVER w - low AS dn FROM tr WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
dm AS (SELECT symbol, ts, tr, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS p, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS q FROM mv WHERE up IS NOT NULL),
e AS (SELECT symbol, ts, {_ewm_sql('p', 1 / 14)} AS p, {_ewm_sql('q', 1 / 14)} AS q, {_ewm_sql('tr', 1 / 14)} AS t FROM dm), di AS (SELECT symbol, ts, 100 * p / nullif(t, 0) AS pd, 100 * q / nullif(t, 0) AS md FROM e),
dx AS (SELECT symbol, ts, 100 * abs(pd - md) / (pd + md) AS dx FROM di WHERE pd + md <> 0), ax AS (SELECT symbol, ts, {_ewm_sql('dx', 1 / 14)} AS adx FROM dx),
j AS (SELECT bars.symbol, bars.ts, pd, md, last_value(adx IGNORE NULLS) OVER (PARTITION BY bars.symbol ORDER BY bars.ts) AS adx FROM bars LEFT JOIN di USING (symbol, ts) LEFT JOIN ax USING (symbol, ts))
SELECT symbol, ts, round(pd, 6) AS plus_di, round(md, 6) AS minus_di, round(adx, 6) AS adx FROM j""")
def win9_adx(spark, sf_dir):
    return rounded(indicators.adx(bars(spark, sf_dir)).select("symbol", "ts", "plus_di", "minus_di", "adx"), "plus_di", "minus_di", "adx")


@query(BARS_SQL + " SELECT symbol, ts, round(close / nullif(lag(close, 3) OVER w, 0) - 1, 6) AS pct_3, round(close - lag(close) OVER w, 6) AS diff_1, round(ln(close / nullif(lag(close) OVER w, 0)), 6) AS log_1 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)")
def win10_changes(spark, sf_dir):
    made = indicators.shifted(bars(spark, sf_dir), {"pct_3": ("close", "pct", 3), "diff_1": ("close", "diff", 1), "log_1": ("close", "log", 1)})
    return rounded(made.select("symbol", "ts", "pct_3", "diff_1", "log_1"), "pct_3", "diff_1", "log_1")


RET_SQL = BARS_SQL + ", r AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS ret, close / nullif(lag(close, 20) OVER w, 0) - 1 AS mom FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))"
_F20 = "(PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)"


@query(RET_SQL + f" SELECT symbol, ts, round(CASE WHEN count(ret) OVER {_F20} >= 20 THEN stddev_samp(ret) OVER {_F20} END * sqrt(20), 6) AS volatility_20, round(CASE WHEN count(ret) OVER {_F20} >= 20 THEN skewness(ret) OVER {_F20} END, 6) AS skew_20, round(mom, 6) AS momentum_20 FROM r")
def win11_13_volatility(spark, sf_dir):
    return rounded(indicators.volatility(bars(spark, sf_dir)).select("symbol", "ts", "volatility_20", "skew_20", "momentum_20"), "volatility_20", "skew_20", "momentum_20")


@query(BARS_SQL + f", z AS (SELECT symbol, ts, close, {_roll(30, 'avg(close) OVER $W')} AS m, {_roll(30, 'stddev_samp(close) OVER $W')} AS s, {_roll(7, 'avg(close) OVER $W')} AS m7 FROM bars) SELECT symbol, ts, round((close - m) / nullif(s, 0), 6) AS z_30, round(m7 / nullif(lag(m7) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1, 6) AS smooth_momentum FROM z")
def win14_zscore(spark, sf_dir):
    made = indicators.smooth_momentum(indicators.zscore(bars(spark, sf_dir), "close", 30), "close")
    return rounded(made.select("symbol", "ts", "z_30", "smooth_momentum"), "z_30", "smooth_momentum")


_F50 = "(PARTITION BY symbol ORDER BY ts ROWS 49 PRECEDING)"


@query(RET_SQL + f" SELECT symbol, ts, round(CASE WHEN count(ret) OVER {_F50} >= 50 THEN avg(ret) OVER {_F50} / nullif(stddev_samp(ret) OVER {_F50}, 0) END * sqrt(252), 6) AS sharpe_50 FROM r")
def win15_rolling_sharpe(spark, sf_dir):
    r = indicators.shifted(bars(spark, sf_dir), {"ret": ("close", "pct", 1)})
    return rounded(indicators.rolling_sharpe(r, "ret").select("symbol", "ts", "sharpe_50"), "sharpe_50")


_F30 = "(PARTITION BY symbol ORDER BY ts ROWS 29 PRECEDING)"


@query(BARS_SQL + f" SELECT symbol, ts, round(CASE WHEN count(*) OVER {_F30} >= 30 AND sqrt(var_pop(close) OVER {_F30} * var_pop(volume) OVER {_F30}) > 1e-12 THEN (avg(close * volume) OVER {_F30} - avg(close) OVER {_F30} * avg(volume) OVER {_F30}) / sqrt(var_pop(close) OVER {_F30} * var_pop(volume) OVER {_F30}) END, 6) AS corr FROM bars")
def win16_rolling_corr(spark, sf_dir):
    return rounded(indicators.rolling_corr(bars(spark, sf_dir), "close", "volume", 30).select("symbol", "ts", "corr"), "corr")


_F14 = "(PARTITION BY symbol ORDER BY ts ROWS 13 PRECEDING)"
CHOP_SQL = f", chop AS (SELECT *, CASE WHEN count(*) OVER {_F14} >= 14 THEN sum(tr) OVER {_F14} / nullif(max(high) OVER {_F14} - min(low) OVER {_F14}, 0) END AS ratio FROM tr)"


@query(BARS_SQL + TR_SQL + CHOP_SQL + " SELECT symbol, ts, round(CASE WHEN ratio > 0 THEN 100 * log10(ratio) / log10(14) END, 6) AS chop_14 FROM chop")
def win17_choppiness(spark, sf_dir):
    return rounded(indicators.choppiness(bars(spark, sf_dir)).select("symbol", "ts", "chop_14"), "chop_14")


@query(BARS_SQL + ", x AS (SELECT symbol, ts, close, lag(close, 2) OVER w AS a, lag(close) OVER w AS b FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)), c AS (SELECT symbol, ts, CASE WHEN a IS NOT NULL THEN (a <= b)::INT * 4 + (b <= close)::INT * 2 + (a <= close)::INT END AS code FROM x), "
       "n AS (SELECT symbol, ts, count(code) OVER f AS t, " + ", ".join(f"count(CASE WHEN code = {k} THEN 1 END) OVER f AS c{k}" for k in (0, 1, 2, 5, 6, 7)) + " FROM c WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS 57 PRECEDING)) "
       "SELECT symbol, ts, round(CASE WHEN t >= 58 THEN (" + " + ".join(f"CASE WHEN c{k} > 0 THEN -(c{k} / t) * ln(c{k} / t) ELSE 0 END" for k in (0, 1, 2, 5, 6, 7)) + ") / ln(6) END, 6) AS perm_entropy FROM n")
def win19_perm_entropy(spark, sf_dir):
    return rounded(indicators.perm_entropy(bars(spark, sf_dir), "close").select("symbol", "ts", "perm_entropy"), "perm_entropy")


@query(BARS_SQL + ", p AS (SELECT symbol, ts, close, max(close) OVER (PARTITION BY symbol ORDER BY ts) AS peak FROM bars), d AS (SELECT symbol, (peak - close) / nullif(peak, 0) AS dd FROM p) SELECT symbol, round(max(dd), 6) AS max_drawdown, round(avg(dd), 6) AS avg_drawdown FROM d GROUP BY symbol")
def win20_drawdown(spark, sf_dir):
    made = indicators.drawdown(bars(spark, sf_dir), "close")
    return rounded(made.groupBy("symbol").agg(F.max("drawdown").alias("max_drawdown"), F.avg("drawdown").alias("avg_drawdown")), "max_drawdown", "avg_drawdown")


@query()
def win21_takens_spread(spark, sf_dir):
    return indicators.takens_spread(bars(spark, sf_dir), "close").select("symbol", "ts", "spread", "spread_z", "unusual")


@query()
def win22_23_complexity(spark, sf_dir):
    return indicators.lz_complexity(bars(spark, sf_dir), "close").select("symbol", "ts", "lz", "compressibility")


@query(BARS_SQL + ", c AS (SELECT symbol, ts, hour(ts) / 23.0 AS mci FROM bars) SELECT symbol, ts, round(1.0 - 0.9 * mci, 6) AS inverse, round(greatest(0.1, exp(-2 * mci)), 6) AS exponential, CASE WHEN mci < 0.3 THEN 1.0 WHEN mci < 0.7 THEN 0.5 ELSE 0.1 END::DOUBLE AS step FROM c")
def win24_risk_multiplier(spark, sf_dir):
    c = F.hour("ts") / F.lit(23.0)
    kinds = {k: indicators.risk_multiplier(c, k) for k in ("inverse", "exponential", "step")}
    return rounded(bars(spark, sf_dir).select("symbol", "ts", *(v.alias(k) for k, v in kinds.items())), "inverse", "exponential")


@query(BARS_SQL + ", s AS (SELECT symbol, ts, row_number() OVER w - 1 AS time_idx, list(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 29 PRECEDING) AS past, list(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS future FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)) "
       "SELECT symbol, ts, time_idx, past[1] AS first_past, past[30] AS last_past, future[1] AS first_future, future[5] AS last_future FROM s WHERE len(past) = 30 AND len(future) = 5")
def win25_26_sequences(spark, sf_dir):
    s = indicators.sequences(bars(spark, sf_dir), ["close"], 30, 5)
    at = lambda c, i: F.get(c, F.lit(i))["close"]
    return s.select("symbol", "ts", F.col("time_idx").cast("long").alias("time_idx"), at("past", 0).alias("first_past"), at("past", 29).alias("last_past"), at("future", 0).alias("first_future"), at("future", 4).alias("last_future"))


# order books --------------------------------------------------------------------------------------


def books(spark, sf_dir):
    return book.pack(book_levels(spark, sf_dir), ("book_id",))


_TOPS = ", b AS (SELECT book_id, max(price) FILTER (side = 'bid') AS bid, min(price) FILTER (side = 'ask') AS ask, "
DEPTH_SQL = LEVELS_SQL + _TOPS + "coalesce(sum(qty) FILTER (side = 'bid' AND lvl < 10), 0) AS b10, coalesce(sum(qty) FILTER (side = 'ask' AND lvl < 10), 0) AS a10, coalesce(sum(qty) FILTER (side = 'bid' AND lvl < 1), 0) AS b1, coalesce(sum(qty) FILTER (side = 'ask' AND lvl < 1), 0) AS a1, coalesce(sum(qty) FILTER (side = 'bid' AND lvl < 5), 0) AS b5, coalesce(sum(qty) FILTER (side = 'ask' AND lvl < 5), 0) AS a5, count(*) FILTER (lvl < 5) AS n5 FROM ranked GROUP BY book_id)"


@query(DEPTH_SQL + " SELECT book_id, bid, ask, round((bid + ask) / 2, 6) AS mid, round(ask - bid, 6) AS spread FROM b")
def book3_bbo(spark, sf_dir):
    return rounded(book.bbo(books(spark, sf_dir)).select("book_id", "bid", "ask", "mid", "spread"), "mid", "spread")


@query(DEPTH_SQL + " SELECT book_id, round(CASE WHEN bid IS NOT NULL AND ask IS NOT NULL AND b10 + a10 > 0 THEN b10 / (b10 + a10) ELSE 0.5 END, 6) AS obi, round(CASE WHEN bid IS NOT NULL AND ask IS NOT NULL THEN coalesce((ask - bid) / nullif((ask + bid) / 2, 0), 0) ELSE 0 END, 6) AS rel_spread FROM b")
def book4_imbalance(spark, sf_dir):
    return rounded(book.imbalance(books(spark, sf_dir)).select("book_id", "obi", "rel_spread"), "obi", "rel_spread")


@query(DEPTH_SQL + " SELECT book_id, round((b1 - a1) / (b1 + a1), 6) AS pressure_l1, round((b10 - a10) / (b10 + a10), 6) AS voi FROM b")
def book5_signed_pressure(spark, sf_dir):
    return rounded(book.signed_pressure(books(spark, sf_dir)).select("book_id", "pressure_l1", "voi"), "pressure_l1", "voi")


@query(DEPTH_SQL + " SELECT book_id, round(b5 / (b5 + a5), 6) AS book_pressure, round((b5 + a5) / (n5 * 0.01), 4) AS density FROM b")
def book6_pressure_density(spark, sf_dir):
    return rounded(rounded(book.pressure_density(books(spark, sf_dir)).select("book_id", "book_pressure", "density"), "book_pressure"), "density", digits=4)


@query(DEPTH_SQL + " SELECT book_id, round(coalesce((CASE WHEN bid IS NOT NULL THEN b1 END - CASE WHEN ask IS NOT NULL THEN a1 END) / (b1 + a1), 0), 6) AS static_ofi FROM b")
def book7_static_ofi(spark, sf_dir):
    return rounded(book.top_of_book(books(spark, sf_dir)).select("book_id", book.static_ofi("bid_v", "ask_v").alias("static_ofi")), "static_ofi")


TOPS_SQL = LEVELS_SQL + ", tops AS (SELECT book_id % 16 AS venue, book_id, TIMESTAMP '2024-01-01' + to_minutes(book_id) AS ts, max(price) FILTER (side = 'bid') AS bid_p, max(qty) FILTER (side = 'bid' AND lvl = 0) AS bid_v, min(price) FILTER (side = 'ask') AS ask_p, max(qty) FILTER (side = 'ask' AND lvl = 0) AS ask_v FROM ranked GROUP BY book_id)"


def tops(spark, sf_dir):
    """Best levels of consecutive books at 16 venues, a minute apart by book number."""
    t = book.top_of_book(books(spark, sf_dir)).drop("bids", "asks")
    return t.withColumns({"venue": F.col("book_id") % 16, "ts": F.timestamp_seconds(F.lit(1704067200) + F.col("book_id") * 60)})


OFI_SQL = """, l AS (SELECT *, lag(bid_p) OVER w AS bp, lag(bid_v) OVER w AS bv, lag(ask_p) OVER w AS ap, lag(ask_v) OVER w AS av FROM tops WINDOW w AS (PARTITION BY venue ORDER BY ts)),
o AS (SELECT *, coalesce(CASE WHEN bid_p > bp THEN bid_v WHEN bid_p = bp THEN bid_v - bv WHEN bid_p < bp THEN -bv ELSE 0 END - CASE WHEN ask_p < ap THEN ask_v WHEN ask_p = ap THEN ask_v - av WHEN ask_p > ap THEN -av ELSE 0 END, 0) AS ofi_l1 FROM l)"""


@query(TOPS_SQL + OFI_SQL + " SELECT venue, ts, round(ofi_l1, 6) AS ofi_l1 FROM o")
def book8_ofi(spark, sf_dir):
    return rounded(book.ofi(tops(spark, sf_dir), ["venue"], ["ts"]).select("venue", "ts", "ofi_l1"), "ofi_l1")


@query(TOPS_SQL + ", f AS (SELECT venue, ts, bid_v / nullif(ask_v, 0) AS b, (bid_p * ask_v + ask_p * bid_v) / nullif(bid_v + ask_v, 0) AS w, ask_p - bid_p AS s FROM tops) SELECT venue, ts, round(coalesce(last_value(b IGNORE NULLS) OVER x, 0), 6) AS bpr_l1, round(coalesce(last_value(w IGNORE NULLS) OVER x, 0), 6) AS wmp, round(coalesce(last_value(s IGNORE NULLS) OVER x, 0), 6) AS spread_l1 FROM f WINDOW x AS (PARTITION BY venue ORDER BY ts)")
def book9_l1_features(spark, sf_dir):
    names = ["bpr_l1", "wmp", "spread_l1"]
    return rounded(book.l1_features(tops(spark, sf_dir), ["venue"], ["ts"]).select("venue", "ts", *names), *names)


@query(BARS_SQL + f""", m AS (SELECT symbol, ts, volume, close - lag(close) OVER w AS mv FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
s AS (SELECT symbol, ts, volume, last_value(CASE WHEN mv IS NULL OR mv > 0 THEN 1.0 WHEN mv < 0 THEN -1.0 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts) AS sg FROM m),
x AS (SELECT symbol, ts, sg, sg * volume AS sv, volume FROM s) SELECT symbol, ts, sg::DOUBLE AS tick_sign, round(coalesce({_ewm_sql('sv', 2 / 31)} / nullif({_ewm_sql('volume', 2 / 31)}, 0), 0), 6) AS tfi FROM x""")
def book10_trade_flow(spark, sf_dir):
    return rounded(book.trade_flow(bars(spark, sf_dir), "close", "volume").select("symbol", "ts", "tick_sign", "tfi"), "tfi")


@query(BARS_SQL + f", x AS (SELECT symbol, ts, close - open AS f, high - low AS s FROM bars) SELECT symbol, ts, round({_ewm_sql('f', 2 / 61)}, 6) AS mce_skew, round(coalesce(stddev_samp(s) OVER (PARTITION BY symbol ORDER BY ts ROWS 59 PRECEDING), 0), 6) AS mce_pressure FROM x")
def book11_mce_proxies(spark, sf_dir):
    b = bars(spark, sf_dir).select("symbol", "ts", (F.col("close") - F.col("open")).alias("ofi_l1"), (F.col("high") - F.col("low")).alias("spread_l1"))
    return rounded(book.mce_proxies(b).select("symbol", "ts", "mce_skew", "mce_pressure"), "mce_skew", "mce_pressure")


@query(BARS_SQL + f""", v AS (SELECT *, coalesce(sign(close - lag(close) OVER (PARTITION BY symbol ORDER BY ts)), 0) * volume AS sv FROM bars),
z AS (SELECT symbol, ts, CASE WHEN count(*) OVER {_F50} >= 50 THEN (sv - avg(sv) OVER {_F50}) / nullif(stddev_samp(sv) OVER {_F50}, 0) END AS z, (high - low) / nullif(close, 0) AS p, volume / nullif(high - low, 0) AS l FROM v)
SELECT symbol, ts, round(coalesce(last_value(z IGNORE NULLS) OVER w, 0), 6) AS ofi_proxy, round(coalesce(p, 0), 6) AS pressure_proxy, round(coalesce(last_value(l IGNORE NULLS) OVER w, 0), 6) AS liquidity_proxy FROM z WINDOW w AS (PARTITION BY symbol ORDER BY ts)""")
def book12_bar_proxies(spark, sf_dir):
    names = ["ofi_proxy", "pressure_proxy", "liquidity_proxy"]
    return rounded(book.bar_proxies(bars(spark, sf_dir)).select("symbol", "ts", *names), *names)


MESSAGES_SQL = """WITH msg AS (SELECT CAST(l_suppkey % 8 AS VARCHAR) AS symbol, CASE WHEN l_orderkey % 500 = 0 THEN l_orderkey * 8 ELSE l_orderkey * 8 + l_linenumber END AS u, l_partkey AS pos,
  CASE WHEN l_orderkey % 500 = 0 THEN 'snapshot' ELSE 'delta' END AS type, CASE WHEN l_returnflag = 'R' THEN 'bid' ELSE 'ask' END AS side, floor(l_extendedprice / l_quantity / 10) * 10 AS price, CASE WHEN l_discount = 0 THEN 0.0 ELSE l_quantity END AS qty FROM lineitem),
s AS (SELECT symbol, max(u) AS su FROM msg WHERE type = 'snapshot' GROUP BY symbol), live AS (SELECT msg.* FROM msg JOIN s USING (symbol) WHERE u > su OR (u = su AND type = 'snapshot')),
lv AS (SELECT symbol, side, price, arg_max(qty, (u, pos)) AS qty FROM live GROUP BY symbol, side, price) """


@query(MESSAGES_SQL + "SELECT symbol, side, price, qty FROM lv WHERE qty > 0")
def book1_rebuild(spark, sf_dir):
    return book.unpack(book.book_asof(book_messages(spark, sf_dir))).select("symbol", "side", "price", "qty")


@query(LEVELS_SQL + """, q AS (SELECT book_id, CASE WHEN book_id % 2 = 0 THEN 'ask' ELSE 'bid' END AS side, 30.0 AS want FROM (SELECT DISTINCT book_id FROM levels)),
m AS (SELECT book_id, (max(price) FILTER (side = 'bid') + min(price) FILTER (side = 'ask')) / 2 AS mid FROM levels GROUP BY book_id),
t AS (SELECT q.book_id, q.side, mid, price, greatest(0, least(qty, want - coalesce(sum(qty) OVER (PARTITION BY q.book_id ORDER BY lvl ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take FROM q JOIN ranked USING (book_id, side) JOIN m USING (book_id)),
d AS (SELECT book_id, side, mid, sum(take) AS filled, sum(take * price) AS paid FROM t GROUP BY ALL HAVING sum(take) > 0)
SELECT book_id, filled, round(paid / filled, 6) AS vwap, round(CASE WHEN side = 'ask' THEN paid / filled - mid ELSE mid - paid / filled END / nullif(mid, 0) * 10000, 4) AS slippage_bps FROM d""")
def book13_walk(spark, sf_dir):
    b = books(spark, sf_dir)
    orders = b.select("book_id", F.col("book_id").alias("order_id"), F.when(F.col("book_id") % 2 == 0, "buy").otherwise("sell").alias("side"), F.lit(30.0).alias("want"))
    made = book.walk_book(orders, b, ("book_id",)).select("book_id", "filled", "vwap", "slippage_bps")
    return rounded(rounded(made, "vwap"), "slippage_bps", digits=4)


@query(LEVELS_SQL + " SELECT book_id, side, lvl::INTEGER AS level, price, qty FROM ranked WHERE lvl < 3")
def book14_reshape(spark, sf_dir):
    wide = book.widen(books(spark, sf_dir), 3, ("book_id",))
    return book.unpack(book.narrow(wide, 3, ("book_id",)), ("book_id",))


@query(f"WITH {TICKS_SQL} SELECT symbol, time_bucket(INTERVAL '10 minutes', ts) AS bucket, arg_max(id, ts) AS id, max(ts) AS ts FROM ticks GROUP BY ALL")
def snk3_sampled(spark, sf_dir):
    return book.sample_last(ticks(spark, sf_dir).select("symbol", "ts", "id"), "10 minutes").select("symbol", "bucket", "id", "ts")


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN abs(l_tax) < 1e-6 THEN 1.0 ELSE l_discount / l_tax END, 6) AS pdiv, round(sqrt(abs(l_discount - l_tax)), 6) AS psqrt, round(CASE WHEN l_tax <= 1e-3 THEN 0.0 ELSE 1 / l_tax END, 6) AS pinv,
  round(greatest(0.02, least(0.05, l_tax)), 6) AS clipped, CAST(l_quantity > 25 AS INTEGER) AS big FROM lineitem""")
def fn_protected_math(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return rounded(li.select("l_orderkey", "l_linenumber", scalar.protected_div("l_discount", "l_tax").alias("pdiv"), scalar.protected_sqrt(F.col("l_discount") - F.col("l_tax")).alias("psqrt"), scalar.protected_inv("l_tax").alias("pinv"), scalar.clip("l_tax", 0.02, 0.05).alias("clipped"), scalar.gt("l_quantity", F.lit(25)).alias("big")), "pdiv", "psqrt", "pinv", "clipped")


_T = f"1 / (1 + {scalar.PHI_P} * abs(z))"
_PHI = "exp(-z * z / 2) * 0.3989422804014327 * t * (" + " + t * (".join(map(str, scalar.PHI_B)) + ")" * len(scalar.PHI_B)


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_discount, l_tax, (l_quantity - 25) / 10 AS z FROM lineitem), y AS (SELECT *, {_T} AS t FROM x), n AS (SELECT *, {_PHI} AS u FROM y)
SELECT l_orderkey, l_linenumber, round(CASE WHEN abs(l_tax) <= 1e-3 THEN 0 ELSE ln(abs(l_tax)) END, 6) AS plog, round(CASE WHEN z >= 0 THEN 1 - u ELSE u END, 6) AS cdf, CAST(l_tax < l_discount AS INTEGER) AS small,
  CAST(l_tax <> 0 AND l_discount <> 0 AS INTEGER) AS both_set, CAST(l_tax <> 0 OR l_discount <> 0 AS INTEGER) AS either_set, CAST(l_tax = 0 AS INTEGER) AS untaxed, round(exp(l_tax) / (exp(l_tax) + exp(l_discount)), 6) AS soft FROM n""")
def fn_logs_and_logic(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    made = li.select(
        "l_orderkey", "l_linenumber", scalar.protected_log("l_tax").alias("plog"), scalar.normal_cdf(scalar.finite((F.col("l_quantity") - 25) / 10)).alias("cdf"), scalar.lt("l_tax", "l_discount").alias("small"),
        scalar.both("l_tax", "l_discount").alias("both_set"), scalar.either("l_tax", "l_discount").alias("either_set"), scalar.negate("l_tax").alias("untaxed"), F.get(scalar.softmax(F.array("l_tax", "l_discount")), F.lit(0)).alias("soft"),
    )
    return rounded(made, "plog", "cdf", "soft")


@query("SELECT c_custkey, replace(split_part(n_name || '/' || r_name || ':' || r_name, ':', 1), '/', '') AS symbol, regexp_replace(regexp_replace('f(' || n_name || ' + 1)', '[^A-Za-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS ident FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def fn_strings(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    met = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    pair = F.concat("n_name", F.lit("/"), "r_name", F.lit(":"), "r_name")
    return met.select("c_custkey", scalar.clean_symbol(pair).alias("symbol"), scalar.identifier(F.concat(F.lit("f("), "n_name", F.lit(" + 1)"))).alias("ident"))


@query("SELECT event_id, make_timestamp(epoch_us(ts) // 1000000 * 1000000) AS second, make_timestamp(epoch_us(ts) // 1000 * 1000) AS milli, date_trunc('day', ts)::TIMESTAMP AS day, round((epoch_us(ts) - epoch_us(date_trunc('day', ts)::TIMESTAMP)) / 60e6, 6) AS minutes, ts - INTERVAL '2 hours' AS utc, CAST(900 AS INTEGER) AS width FROM events")
def fn_times(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    made = e.select(
        "event_id", scalar.from_epoch_s(F.unix_seconds("ts")).alias("second"), scalar.from_epoch_ms(F.unix_millis("ts")).alias("milli"), scalar.day_of("ts").alias("day"),
        scalar.minutes_between("ts", scalar.day_of("ts")).alias("minutes"), scalar.to_utc("ts", "GMT+2").alias("utc"), F.lit(scalar.timeframe_seconds("15m")).alias("width"),
    )
    return rounded(made, "minutes")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, coalesce(TRY_CAST(json_extract_string(props, '$.missing') AS DOUBLE), -1) AS missing FROM events")
def fn_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalar.nested("props", "$.k", "double").alias("k"), scalar.nested("props", "$.missing", "double", -1.0).alias("missing"))


FLAGSHIP_SQL = (
    BARS_SQL + ", " + bars_sql("b15", "15 minutes") + ATR_SQL.replace("bars", "b15") + RSI_SQL
    + f""", tm AS (SELECT symbol, ts, volume, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS mv FROM bars),
ts1 AS (SELECT symbol, ts, volume, last_value(CASE WHEN mv IS NULL OR mv > 0 THEN 1.0 WHEN mv < 0 THEN -1.0 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts) * volume AS sv FROM tm),
tf AS (SELECT symbol, ts, coalesce({_ewm_sql('sv', 2 / 31)} / nullif({_ewm_sql('volume', 2 / 31)}, 0), 0) AS tfi FROM ts1),
hi AS (SELECT symbol, ts + INTERVAL '1 hour' AS known, rsi_14, tfi FROM rsi JOIN tf USING (symbol, ts)),
lo AS (SELECT symbol, ts, close, atr_14, CASE WHEN count(*) OVER w = 20 THEN avg(close) OVER w END AS mid, list({{'h': high, 'l': low}}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS ahead FROM atr WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)),
hit AS (SELECT *, list_filter(list_transform(ahead, lambda b: CASE WHEN b.h >= close + 2 * atr_14 THEN 1 WHEN b.l <= close - 2 * atr_14 THEN 2 ELSE 0 END), lambda x: x > 0) AS hits FROM lo)
SELECT hit.symbol, hit.ts, close, round(atr_14, 6) AS atr_14, round(mid, 6) AS bb_mid, round(rsi_14, 6) AS rsi_14_1h, round(tfi, 6) AS tfi_1h, CASE WHEN len(ahead) < 20 OR ahead IS NULL THEN NULL ELSE coalesce(hits[1], 0) END AS label
FROM hit ASOF LEFT JOIN hi ON hit.symbol = hi.symbol AND hit.ts >= hi.known"""
)


@query(FLAGSHIP_SQL)
def flagship(spark, sf_dir):
    """Leak-free training table: 15-minute bars with ATR, bands and triple-barrier labels, as of them the last closed hour's RSI and trade flow."""
    low = indexed(bars(spark, sf_dir, "15 minutes"), indicators.BY, indicators.ORDER)
    low = labels.triple_barrier(indicators.bbands(indicators.atr(low))).drop("_ix")
    # signs first, then all means of the hour in one pass
    signed = book.tick_signs(chunked(bars(spark, sf_dir), indicators.BY, indicators.ORDER), "close")
    means = ewm(signed, {**indicators.rsi_means("close"), **book.flow_means("volume")}, indicators.BY, indicators.ORDER, back=("close",))
    high = book.flow_of(indicators.rsi_of(means)).select("symbol", "ts", "rsi_14", "tfi")
    made = asof.mtf_align({"15m": low, "1h": high}, ["symbol"])
    return rounded(made.select("symbol", "ts", "close", "atr_14", "bb_mid", "rsi_14_1h", "tfi_1h", "label"), "atr_14", "bb_mid", "rsi_14_1h", "tfi_1h")
