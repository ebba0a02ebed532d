"""Driver tables in the shape of the library's inputs, as DataFrames and as SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.operators.aggregate import ohlcv_resample


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``symbol, ts, id, price, qty, user_id`` from events."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("qty"), "user_id")


def bars(spark: SparkSession, sf_dir: str, width: str = "1 hour") -> DataFrame:
    return ohlcv_resample(ticks(spark, sf_dir), width)


def trade_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, model_id, symbol, ts, net_pnl, ret, action`` from orders."""
    o = table(spark, sf_dir, "orders")
    mean = o.agg(F.avg("o_totalprice").alias("_m"))
    pnl = F.col("o_totalprice") - F.col("_m")
    return o.crossJoin(F.broadcast(mean)).select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 40).alias("model_id"), F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("timestamp").alias("ts"), pnl.alias("net_pnl"),
        (pnl / F.col("_m") / 10).alias("ret"), F.when(F.col("o_orderstatus") == "F", "EXIT").otherwise("ENTRY").alias("action"),
    )


def book_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``book_id, side, price, qty`` from line items; one quantity per price."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("book_id"), F.when(F.col("l_returnflag") == "R", "bid").otherwise("ask").alias("side"), (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100) / 100).alias("price"), F.col("l_quantity").alias("qty"))
    return rows.groupBy("book_id", "side", "price").agg(F.sum("qty").alias("qty"))


def book_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``symbol, ts, u, pos, type, side, price, qty``: level updates from line items, with a snapshot every 500 updates or so."""
    li = table(spark, sf_dir, "lineitem")
    u = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    kind = F.when(F.col("l_orderkey") % 500 == 0, "snapshot").otherwise("delta")
    return li.select(
        (F.col("l_suppkey") % 8).cast("string").alias("symbol"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.when(kind == "snapshot", F.col("l_orderkey") * 8).otherwise(u).alias("u"),
        F.col("l_partkey").alias("pos"), kind.alias("type"), F.when(F.col("l_returnflag") == "R", "bid").otherwise("ask").alias("side"),
        (F.floor(F.col("l_extendedprice") / F.col("l_quantity") / 10) * 10).cast("double").alias("price"), F.when(F.col("l_discount") == 0, 0.0).otherwise(F.col("l_quantity")).alias("qty"),
    )


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares; a local one on a local master without such a folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared or 'file://' + tempfile.mkdtemp(prefix='barwright-')}/{name}-{uuid.uuid4().hex}"


def held(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, for what several passes read."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


TICKS_SQL = "ticks AS (SELECT event_type AS symbol, ts, event_id AS id, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS qty, user_id FROM events)"


def bars_sql(name: str = "bars", width: str = "1 hour") -> str:
    return (
        f"{name} AS (SELECT symbol, time_bucket(INTERVAL '{width}', ts) AS ts, arg_min(price, (ts, id)) AS open, max(price) AS high, min(price) AS low, "
        "arg_max(price, (ts, id)) AS close, sum(qty) AS volume FROM ticks WHERE price IS NOT NULL GROUP BY symbol, time_bucket(INTERVAL '" + width + "', ts))"
    )


BARS_SQL = f"WITH {TICKS_SQL}, {bars_sql()}"
TRADES_SQL = (
    "WITH m AS (SELECT avg(o_totalprice) AS m FROM orders), trades AS (SELECT o_orderkey AS id, o_custkey % 40 AS model_id, o_orderpriority AS symbol, o_orderdate AS ts, "
    "o_totalprice - m AS net_pnl, (o_totalprice - m) / m / 10 AS ret, CASE WHEN o_orderstatus = 'F' THEN 'EXIT' ELSE 'ENTRY' END AS action FROM orders, m)"
)
LEVELS_SQL = (
    "WITH levels AS (SELECT l_orderkey AS book_id, CASE WHEN l_returnflag = 'R' THEN 'bid' ELSE 'ask' END AS side, floor(l_extendedprice / l_quantity * 100) / 100 AS price, sum(l_quantity) AS qty "
    "FROM lineitem GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY book_id, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END) - 1 AS lvl FROM levels)"
)
