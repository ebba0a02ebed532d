"""Queries over cross-asset relations, statistics, Spark ML and set features."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwright.operators import cross, indicators, labels, ml
from barwright.plans.fixtures import BARS_SQL, bars, held, table
from barwright.plans import market
from barwright.plans.market import ATR_SQL, RSI_SQL, rounded

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


MOVES_SQL = BARS_SQL + ", mv AS (SELECT symbol, ts, volume, close, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS r FROM bars)"
PAIRS_SQL = MOVES_SQL + ", pr AS (SELECT a.ts, a.symbol AS src, b.symbol AS dst, a.r AS x, b.r AS y FROM mv a JOIN mv b ON a.ts = b.ts AND a.symbol < b.symbol WHERE a.r IS NOT NULL AND b.r IS NOT NULL)"
_W = "(PARTITION BY src, dst ORDER BY ts ROWS 29 PRECEDING)"
EDGES_SQL = PAIRS_SQL + f""", ec AS (SELECT src, dst, ts, CASE WHEN count(*) OVER {_W} >= 30 AND sqrt(var_pop(x) OVER {_W} * var_pop(y) OVER {_W}) > 1e-12 THEN (avg(x * y) OVER {_W} - avg(x) OVER {_W} * avg(y) OVER {_W}) / sqrt(var_pop(x) OVER {_W} * var_pop(y) OVER {_W}) END AS w FROM pr),
el AS (SELECT src, dst, arg_max(w, ts) AS weight FROM ec GROUP BY src, dst HAVING abs(arg_max(w, ts)) > 0.05), edges AS (SELECT * FROM el UNION ALL SELECT dst, src, weight FROM el)"""


@query(EDGES_SQL + " SELECT src, dst, round(weight, 6) AS weight FROM edges")
def xas1_corr_edges(spark, sf_dir):
    return rounded(cross.corr_edges(bars(spark, sf_dir), 30, 0.05), "weight")


@query(EDGES_SQL + ", i AS (SELECT dst AS symbol, sum(abs(weight)) AS incoming FROM edges GROUP BY 1), o AS (SELECT src AS symbol, sum(abs(weight)) AS outgoing FROM edges GROUP BY 1) SELECT symbol, round(coalesce(incoming, 0), 6) AS incoming, round(coalesce(outgoing, 0), 6) AS outgoing FROM i FULL JOIN o USING (symbol)")
def xas2_influence(spark, sf_dir):
    return rounded(cross.influence(cross.corr_edges(bars(spark, sf_dir), 30, 0.05)), "incoming", "outgoing")


@query(MOVES_SQL + """, lg AS (SELECT symbol, r AS y, unnest([{'feature': 'r', 'lag': 1, 'x': lag(r, 1) OVER w}, {'feature': 'r', 'lag': 2, 'x': lag(r, 2) OVER w}, {'feature': 'volume', 'lag': 1, 'x': lag(volume, 1) OVER w}, {'feature': 'volume', 'lag': 2, 'x': lag(volume, 2) OVER w}]) AS e FROM mv WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
s AS (SELECT symbol, e.feature AS feature, e.lag AS lag, count(*) AS n, covar_pop(e.x, y) / (stddev_pop(e.x) * stddev_pop(y)) AS c FROM lg WHERE e.x IS NOT NULL AND y IS NOT NULL GROUP BY ALL)
SELECT symbol, feature, lag::INTEGER AS lag, n, round(c, 6) AS corr, coalesce(abs(c * sqrt((n - 2) / (1 - c * c))) > 1.96, false) AS linked FROM s""")
def xas3_lag_screen(spark, sf_dir):
    moved = indicators.shifted(bars(spark, sf_dir), {"r": ("close", "pct", 1)})
    return rounded(cross.lag_screen(moved, "r", ["r", "volume"], 2).select("symbol", "feature", "lag", "n", "corr", "linked"), "corr")


_W60 = "(PARTITION BY symbol ORDER BY ts ROWS 59 PRECEDING)"


@query(MOVES_SQL + f""", ld AS (SELECT ts AS lts, r AS lr FROM mv WHERE symbol = 'click'), m AS (SELECT symbol, ts, CASE WHEN lr IS NOT NULL THEN r END AS x, CASE WHEN r IS NOT NULL THEN lr END AS y FROM mv ASOF LEFT JOIN ld ON mv.ts >= lts),
v AS (SELECT symbol, ts, sqrt(var_pop(x) OVER {_W60} * var_pop(y) OVER {_W60}) AS s, avg(x * y) OVER {_W60} - avg(x) OVER {_W60} * avg(y) OVER {_W60} AS c, count(x) OVER {_W60} AS n FROM m)
SELECT symbol, ts, round(CASE WHEN symbol = 'click' THEN 0 WHEN n >= 60 AND s > 1e-12 THEN c / s END, 6) AS lead_corr, perm_entropy FROM v JOIN ({market.ORACLES["win19_perm_entropy"]}) USING (symbol, ts)""")
def xas4_influence_map(spark, sf_dir):
    return rounded(cross.influence_map(bars(spark, sf_dir), "click").select("symbol", "ts", "lead_corr", "perm_entropy"), "lead_corr", "perm_entropy")


@query(PAIRS_SQL + " SELECT src, dst, count(*) AS n, round(covar_samp(x, y), 4) AS cov FROM pr GROUP BY src, dst UNION ALL SELECT symbol, symbol, count(r), round(var_samp(r), 4) FROM mv GROUP BY symbol")
def xas5_covariance(spark, sf_dir):
    return rounded(cross.covariance(bars(spark, sf_dir)), "cov", digits=4)


@query(BARS_SQL + ATR_SQL + ", g AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS r FROM atr) SELECT symbol, round(100 * avg(atr_14 / nullif(close, 0)), 4) AS atr_pct, round(avg(volume), 6) AS volume, round(skewness(r), 5) AS skew, round(kurtosis(r), 5) AS kurtosis FROM g GROUP BY symbol")
def sta1_market_signature(spark, sf_dir):
    return rounded(rounded(rounded(cross.market_signature(bars(spark, sf_dir)), "volume"), "skew", "kurtosis", digits=5), "atr_pct", digits=4)


SIGNATURE = "coalesce(sum(CASE WHEN signal = 1 THEN volume WHEN signal = 2 THEN -volume END) / nullif(sum(volume) FILTER (signal <> 0), 0), 0) AS volume_ratio, avg((signal <> 0)::INT) AS activity"
SIGNALS_SQL = BARS_SQL + RSI_SQL + ", sg AS (SELECT bars.symbol, bars.ts, volume, close, rsi_14, CASE WHEN rsi_14 < 40 THEN 1 WHEN rsi_14 > 60 THEN 2 ELSE 0 END AS signal FROM bars JOIN rsi USING (symbol, ts))"


@query(SIGNALS_SQL + f", s AS (SELECT symbol, {SIGNATURE}, coalesce(avg(volume) FILTER (signal <> 0), 0) AS av, CASE WHEN count(*) FILTER (signal <> 0) > 10 THEN stddev_pop(close) FILTER (signal <> 0) ELSE 0 END AS sg FROM sg GROUP BY symbol) SELECT symbol, round(volume_ratio, 6) AS volume_ratio, round(activity, 6) AS activity, round(av, 6) AS active_volume, round(sg, 6) AS active_sigma FROM s")
def sta2_signal_signature(spark, sf_dir):
    made = cross.signal_signature(labels.rsi_signal(bars(spark, sf_dir), 14, 40, 60), ["symbol"])
    return rounded(made, "volume_ratio", "activity", "active_volume", "active_sigma")


@query(SIGNALS_SQL + f""", ob AS (SELECT symbol, {SIGNATURE} FROM sg GROUP BY symbol), grid AS (SELECT * FROM (VALUES (30, 70), (40, 60), (45, 65)) AS v(low, high)),
c AS (SELECT symbol, low, high, {SIGNATURE.replace('signal', 's2')} FROM (SELECT symbol, volume, low, high, CASE WHEN rsi_14 < low THEN 1 WHEN rsi_14 > high THEN 2 ELSE 0 END AS s2 FROM sg, grid) GROUP BY symbol, low, high),
dd AS (SELECT c.symbol, low, high, sqrt(pow(c.volume_ratio - ob.volume_ratio, 2) + pow(c.activity - ob.activity, 2)) AS distance FROM c JOIN ob USING (symbol))
SELECT symbol, arg_min(low, (distance, low, high))::BIGINT AS low, arg_min(high, (distance, low, high))::BIGINT AS high, round(1 / (1 + min(distance)), 6) AS fit FROM dd GROUP BY symbol""")
def sta3_param_sweep(spark, sf_dir):
    b = bars(spark, sf_dir)
    grid = spark.createDataFrame([(30, 70), (40, 60), (45, 65)], "low long, high long")
    observed = cross.signal_signature(labels.rsi_signal(b, 14, 40, 60), ["symbol"])
    return rounded(cross.param_sweep(b, grid, observed).select("symbol", "low", "high", "fit"), "fit")


def _split_sql(back: int) -> str:
    """How far the means before and after the last ``back`` values are beyond their bound."""
    n0 = f"(n - {back})"
    scale = f"(1.0 / {back} + 1.0 / {n0})"
    return f"CASE WHEN n > {back} AND l{back} IS NOT NULL THEN abs((l{back} - a) / {n0} - (s - l{back}) / {back}) - (sqrt(2 * {scale} * v * g) + 2 * {scale} / 3 * g) END"


_SPLITS = [*range(10, 200, 10)]


@query(BARS_SQL + f""", r AS (SELECT symbol, ts, row_number() OVER w AS i, sum(close) OVER w AS s, var_pop(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 199 PRECEDING) AS v FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
l AS (SELECT *, coalesce(lag(s, 200) OVER w, 0) AS a, {", ".join(f"lag(s, {b}) OVER w AS l{b}" for b in _SPLITS)}, least(i, 200) AS n, ln(2 / 0.005) + ln(least(i, 200)) AS g FROM r WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
c AS (SELECT symbol, ts, CASE WHEN i >= 100 THEN greatest({", ".join(map(_split_sql, _SPLITS))}) END AS cut FROM l) SELECT symbol, ts, round(cut, 4) AS cut, coalesce(cut > 0, false) AS drift FROM c""")
def sta4_drift_points(spark, sf_dir):
    return rounded(cross.drift_points(bars(spark, sf_dir), "close").select("symbol", "ts", "cut", "drift"), "cut", digits=4)


@query()
def sta5_treatment_effect(spark, sf_dir):
    b = indicators.shifted(bars(spark, sf_dir), {"ret": ("close", "pct", 1), "nxt": ("close", "lead", 1)}).withColumn("next_ret", F.col("nxt") - F.col("close"))
    return ml.treatment_effect(b, "ret", "next_ret", ["volume"], ["symbol"], ["ts"], placebos=99)


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_samp(l_quantity) OVER (), 6) AS l_quantity FROM lineitem")
def ml1_standard_scaling(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return rounded(ml.scale(li, ml.scale_stats(li, ["l_quantity"], "standard"), ["l_quantity"]), "l_quantity")


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - quantile_cont(l_quantity, 0.5) OVER ()) / (quantile_cont(l_quantity, 0.75) OVER () - quantile_cont(l_quantity, 0.25) OVER ()), 6) AS l_quantity, round((l_tax - min(l_tax) OVER ()) / (max(l_tax) OVER () - min(l_tax) OVER ()), 6) AS l_tax FROM lineitem")
def ml1_robust_minmax_scaling(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    robust = ml.scale(li, ml.scale_stats(li, ["l_quantity"], "robust"), ["l_quantity"])
    return rounded(ml.scale(robust, ml.scale_stats(li, ["l_tax"], "minmax"), ["l_tax"]), "l_quantity", "l_tax")


def labelled(spark, sf_dir):
    b = indicators.volatility(labels.reversion_label(indicators.atr(bars(spark, sf_dir))))
    return labels.chrono_split(b, {"train": 0.6, "valid": 0.2, "test": 0.2})


FEATURES = ["atr_ratio_14", "bb_pos", "volatility_20", "momentum_20"]


@query()
def ml2_classify(spark, sf_dir):
    d = held(labelled(spark, sf_dir), "labelled")
    part = lambda p: d.where(F.col("split") == p)
    return ml.classify(part("train"), part("valid"), part("test"), FEATURES).select("symbol", "ts", "label", "probability")


@query()
def ml3_meta_model(spark, sf_dir):
    d = held(labelled(spark, sf_dir).withColumn("label", (F.col("label") == 1).cast("int")), "labelled")
    return ml.meta_model(d.where("split = 'train'"), d.where("split = 'test'"), FEATURES).select("symbol", "ts", "label", "probability")


@query(MOVES_SQL + ", g AS (SELECT symbol, ts, CASE WHEN r > 0 THEN 1 WHEN r < 0 THEN -1 ELSE 0 END AS regime FROM mv), t AS (SELECT regime AS src, lead(regime) OVER (PARTITION BY symbol ORDER BY ts) AS dst FROM g) SELECT src, dst, round(count(*) / sum(count(*)) OVER (PARTITION BY src), 6) AS p FROM t WHERE dst IS NOT NULL GROUP BY src, dst")
def ml4_transitions(spark, sf_dir):
    g = indicators.shifted(bars(spark, sf_dir), {"r": ("close", "pct", 1)}).withColumn("regime", F.when(F.col("r") > 0, 1).when(F.col("r") < 0, -1).otherwise(0))
    return rounded(ml.transitions(g, "regime", ["symbol"], ["ts"]), "p")


@query()
def ml4_next_regime(spark, sf_dir):
    made = ml.regimes(indicators.volatility(indicators.atr(bars(spark, sf_dir))), ["atr_ratio_14", "volatility_20"], 3)
    return ml.next_regime(made.select("symbol", "ts", "posterior"), ml.transitions(made, "regime", ["symbol"], ["ts"]), ["symbol", "ts"])


@query()
def ml5_anomaly(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    return ml.anomaly(e, "v").select("vec_id", "error", "anomalous")


PROBS_SQL = "WITH p AS (SELECT l_orderkey, l_linenumber, [0.2 + l_discount, 0.3, 0.5 - l_discount] AS pr, l_linenumber % 3 AS y FROM lineitem), q AS (SELECT quantile_cont(list_sum(list_filter(pr, lambda x: x >= pr[y + 1])), 0.9) AS q FROM p WHERE l_orderkey % 2 = 0)"


@query(PROBS_SQL + ", s AS (SELECT l_orderkey, l_linenumber, list_reverse_sort(pr) AS s, q FROM p, q WHERE l_orderkey % 2 = 1) SELECT l_orderkey, l_linenumber, CASE WHEN 0 >= q THEN 0 WHEN s[1] >= q THEN 1 WHEN s[1] + s[2] >= q THEN 2 ELSE 3 END AS set_size FROM s")
def ml6_conformal(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    p = li.select("l_orderkey", "l_linenumber", F.array(0.2 + F.col("l_discount"), F.lit(0.3), 0.5 - F.col("l_discount")).alias("pr"), (F.col("l_linenumber") % 3).alias("y"))
    return ml.conformal(p.where("l_orderkey % 2 = 0"), p.where("l_orderkey % 2 = 1"), "pr", "y").select("l_orderkey", "l_linenumber", "set_size")


NICHE_SQL = """WITH i AS (SELECT DISTINCT l_orderkey AS k, l_partkey % 200 AS e FROM lineitem), f AS (SELECT l_orderkey AS k, sum(l_quantity) AS f FROM lineitem GROUP BY 1), n AS (SELECT k, count(*) AS n FROM i GROUP BY k),
c AS (SELECT a.k, b.k AS other, count(*) AS c FROM i a JOIN i b USING (e) GROUP BY ALL)
SELECT c.k AS l_orderkey, count(*)::BIGINT AS niche, round(any_value(f) / count(*), 6) AS shared_fitness FROM c JOIN n x ON x.k = c.k JOIN n y ON y.k = c.other JOIN f ON f.k = c.k WHERE c >= 0.7 * (x.n + y.n - c) GROUP BY c.k"""


@query(NICHE_SQL)
def ml7_niche_share(spark, sf_dir):
    """Orders as sets of their parts, parts in 200 families."""
    sets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") % 200).alias("s"), F.sum("l_quantity").alias("f"))
    return rounded(ml.niche_share(sets, "l_orderkey", "s", "f"), "shared_fitness")


@query(NICHE_SQL)
def ml7_niche_share_whole(spark, sf_dir):
    """The same under its earlier name."""
    return ml7_niche_share(spark, sf_dir)


@query("SELECT l_orderkey, max((l_partkey % 20 = 3)::INT) AS has_3, max((l_partkey % 20 = 7)::INT) AS has_7 FROM lineitem GROUP BY 1")
def ml8_multi_hot(spark, sf_dir):
    sets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") % 20).alias("s"))
    return ml.multi_hot(sets, "s", [3, 7]).select("l_orderkey", "has_3", "has_7")


@query("""WITH lex AS (SELECT * FROM (VALUES ('the', 0.5), ('of', -0.25), ('that', 1.0), ('is', -1.0)) AS v(word, weight)), w AS (SELECT source, doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z'']+')) AS word FROM documents),
s AS (SELECT source, doc_id, avg(weight) AS s FROM w JOIN lex USING (word) GROUP BY ALL), m AS (SELECT source, count(*) AS n, avg(coalesce(s, 0)) AS mean_score FROM documents LEFT JOIN s USING (source, doc_id) GROUP BY source)
SELECT source, n, round(mean_score, 6) AS mean_score, round(mean_score - lag(mean_score) OVER (ORDER BY source), 6) AS momentum FROM m""")
def ml9_sentiment(spark, sf_dir):
    lexicon = spark.createDataFrame([("the", 0.5), ("of", -0.25), ("that", 1.0), ("is", -1.0)], "word string, weight double")
    return rounded(ml.sentiment(table(spark, sf_dir, "documents"), lexicon, ["source"], ["source"]), "mean_score", "momentum")


@query(BARS_SQL + " SELECT symbol, ts, round(CASE WHEN abs(high - low) <= 1e-3 THEN 1.0 ELSE volume / (high - low) END, 6) AS f_0, CAST(close > open AS INTEGER) AS f_2 FROM bars")
def ml10_formula_features(spark, sf_dir):
    made = ml.formula_features(bars(spark, sf_dir), ["div(volume, sub(high, low))", "add(close, 1)", "gt(close, open)"])
    return rounded(made.select("symbol", "ts", "f_0", F.col("f_2").cast("int").alias("f_2")), "f_0")


@query()
def ml11_text_complexity(spark, sf_dir):
    return ml.text_complexity(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", "complexity", "penalty")
