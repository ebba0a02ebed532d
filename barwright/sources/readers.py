"""Readers and writers for bars, books, trade logs, registries and ticks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BARS = "symbol string, tf string, ts timestamp, open double, high double, low double, close double, volume double"
TRADE_LOG = (
    "timestamp timestamp, agent_id string, symbol string, model_id string, action string, price double, amount double, capital_deployed double, commission double, "
    "stop_loss double, take_profit double, atr string, balance_before double, balance_after double, entry_price double, exit_price double, entry_time timestamp, exit_time timestamp, "
    "duration_hours double, entry_commission double, exit_commission double, total_commission double, gross_pnl double, net_pnl string, pnl_pct double, price_change_pct double, r_multiple double, exit_reason string"
)
L2_MESSAGE = "topic string, type string, data struct<s:string, u:bigint, b:array<array<string>>, a:array<array<string>>>"


def read_bars(spark: SparkSession, path: str, schema: str = BARS) -> DataFrame:
    """OHLCV CSV files with a header and a stated schema; rows without a time are dropped."""
    return spark.read.schema(schema).option("header", True).csv(path).where("ts is not null")


def read_l2_csv(spark: SparkSession, path: str, depth: int = 50, key: str | None = None) -> DataFrame:
    """Wide snapshots as books: ``ts, bids, asks`` (and ``key``); raises if a level's columns are missing."""
    from barwright.operators.book import narrow

    header = spark.read.option("header", True).csv(path).columns
    wanted = [f"{s}_{k}_{i}" for i in range(depth) for s in ("bid", "ask") for k in ("p", "v")]
    missing = [c for c in ["timestamp", *wanted] if c not in header]
    if missing:
        raise ValueError(f"missing columns: {missing[:5]}")
    schema = T.StructType([T.StructField(c, T.TimestampType() if c == "timestamp" else T.DoubleType() if c in set(wanted) else T.StringType()) for c in header])
    rows = spark.read.schema(schema).option("header", True).csv(path).withColumnRenamed("timestamp", "ts")
    return narrow(rows, depth, ("ts", *([key] if key else [])))


def read_l2_messages(lines: DataFrame, column: str = "value", depth: int = 50, ts: str | None = None) -> DataFrame:
    """JSON order-book messages as level rows ``symbol, u, type, side, pos, price, qty`` (and ``ts``); other topics are left out.

    Prices and sizes arrive as strings; what is no number becomes null. Works on batch and stream alike.
    """
    keep = [ts] if ts else []
    parsed = lines.select(*keep, F.from_json(column, L2_MESSAGE).alias("m")).where(F.col("m.topic").startswith(f"orderbook.{depth}."))
    symbol = F.coalesce("m.data.s", F.split_part(F.col("m.topic"), F.lit("."), F.lit(3)))
    level = lambda side, name: F.transform(F.coalesce(side, F.array().cast("array<array<string>>")), lambda x, i: F.struct(F.lit(name).alias("side"), i.alias("pos"), F.get(x, F.lit(0)).try_cast("double").alias("price"), F.get(x, F.lit(1)).try_cast("double").alias("qty")))
    rows = parsed.select(*keep, symbol.alias("symbol"), F.col("m.data.u").alias("u"), F.col("m.type").alias("type"), F.explode(F.concat(level(F.col("m.data.b"), "bid"), level(F.col("m.data.a"), "ask"))).alias("l"))
    return rows.select(*keep, "symbol", "u", "type", "l.*")


def read_trade_log(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    """JSON lines as one nullable schema; malformed lines are skipped. ``last`` keeps that many latest by time."""
    rows = spark.read.schema(TRADE_LOG + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    good = rows.where("_bad is null and timestamp is not null").drop("_bad")
    return good.orderBy(F.col("timestamp").desc()).limit(last) if last else good


def read_registry(spark: SparkSession, glob: str) -> DataFrame:
    """One row per metadata file: ``model_id, asset_symbol, status, registered, model_type, features, sharpe, path``."""
    schema = "model_id string, asset_symbol string, status string, registration_time string, blueprint struct<architecture:string, model_type:string, features:array<string>>, validation_metrics map<string,string>"
    rows = spark.read.schema(schema).option("multiLine", True).json(glob)
    return rows.select(
        "model_id", "asset_symbol", F.coalesce("status", F.lit("unknown")).alias("status"), F.col("registration_time").try_cast("timestamp").alias("registered"),
        F.coalesce("blueprint.model_type", "blueprint.architecture", F.lit("unknown")).alias("model_type"), F.coalesce("blueprint.features", F.array().cast("array<string>")).alias("features"),
        F.try_element_at("validation_metrics", F.lit("sharpe_ratio")).try_cast("double").alias("sharpe"), F.input_file_name().alias("path"),
    )


def write_bars(bars: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet by symbol and date; rows are dealt by those two first, so each folder gets few files."""
    dated = bars.withColumn("date", F.to_date("ts"))
    dated.repartition("symbol", "date").write.mode(mode).partitionBy("symbol", "date").parquet(path)


def write_ticks(ticks: DataFrame, path: str, mode: str = "append", ts: str = "ts") -> None:
    """Parquet by date and hour, dealt by those first, so each folder gets few files."""
    at = F.col(ts).cast("timestamp")
    ticks.withColumns({"date": F.to_date(at), "hour": F.hour(at)}).repartition("date", "hour").write.mode(mode).partitionBy("date", "hour").parquet(path)


def append_trade_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def latest_by_key(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row of greatest ``order`` per key."""
    w = Window.partitionBy(*key).orderBy(F.col(order).desc())
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def upsert_latest(rows: DataFrame, path: str, key: list[str], order: str, buckets: int = 16) -> None:
    """Merge into a Parquet table of one row per key; only key buckets that get new rows are rewritten."""
    spark = rows.sparkSession
    fresh = latest_by_key(rows, key, order).withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)))
    merged = fresh
    if _exists(spark, path):
        touched = fresh.select("_bucket").distinct()
        old = spark.read.parquet(path).join(F.broadcast(touched), "_bucket", "left_semi")
        merged = latest_by_key(fresh.unionByName(old.select(*fresh.columns)), key, order)
    staged = f"{path}_staged_{uuid.uuid4().hex}"
    merged.write.parquet(staged)
    spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)
    _folder(spark, staged, "delete")


def _folder(spark: SparkSession, path: str, action: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.delete(where, True) if action == "delete" else store.exists(where)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether something is stored there; any other trouble with the path is an error of its own."""
    return _folder(spark, path, "exists")


def incremental(existing: DataFrame, incoming: DataFrame, ts: str, key: list[str]) -> DataFrame:
    """Incoming rows later than everything that exists, each key once; all of them where nothing exists. Rows without a time are left out."""
    newest = existing.agg(F.max(ts).alias("_t"))
    later = incoming.join(F.broadcast(newest), F.col(ts) > F.coalesce("_t", F.lit("0001-01-01").cast("timestamp"))).drop("_t")
    return later.dropDuplicates(key)


def stale_keys(df: DataFrame, by: list[str], ts: str, max_hours: float, now: Column | None = None) -> DataFrame:
    """``newest``, ``age_hours`` and ``stale`` per key: whether its latest row is more than ``max_hours`` old. Keys without a time are stale."""
    now = F.current_timestamp() if now is None else now
    age = (F.unix_micros(now) - F.unix_micros(F.col("newest").cast("timestamp"))) / F.lit(3.6e9)
    newest = df.groupBy(*by).agg(F.max(ts).alias("newest"))
    return newest.select(*by, "newest", age.alias("age_hours"), F.coalesce(age > max_hours, F.lit(True)).alias("stale"))
