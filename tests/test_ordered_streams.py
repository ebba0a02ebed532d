"""Streams whose rows arrive out of order equal their batch twins."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from barwright.operators import asof, risk
from barwright.streaming import streams

DAY = datetime.datetime(2024, 1, 1)


def arriving(spark, batches, schema, folder):
    """A stream of files, one a micro-batch."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def results(out, folder, name):
    got = []
    out.writeStream.outputMode("append").foreachBatch(lambda d, _: got.extend(d.collect())).option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start().awaitTermination()
    return got


def shuffled(rows, size, rng, ts):
    """Batches in which rows are at most a batch or two out of order."""
    order = sorted(rows, key=lambda r: (ts(r) + datetime.timedelta(minutes=rng.uniform(0, 9))))
    return [order[i : i + size] for i in range(0, len(order), size)]


@pytest.fixture
def three_parts(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", was)


def test_breaker_in_event_time_order(spark, tmp_path, three_parts):
    rng = random.Random(4)
    rows, value = [], {"a": 100.0, "b": 100.0}
    for i in range(120):
        for account in value:
            value[account] *= 1 + rng.uniform(-0.04, 0.037)
            rows.append((account, DAY + datetime.timedelta(minutes=7 * i + (account == "b")), value[account]))
    end = [("a", DAY + datetime.timedelta(days=9), 1.0), ("b", DAY + datetime.timedelta(days=9), 1.0)]
    schema = "account string, ts timestamp, equity double"
    stream = arriving(spark, [*shuffled(rows, 60, rng, lambda r: r[1]), end], schema, tmp_path / "in")
    got = {(r.account, r.ts): r.allowed for r in results(streams.breaker_stream(stream), tmp_path, "c")}
    want = {(r.account, r.ts): r.allowed for r in risk.circuit_breaker(spark.createDataFrame(rows, schema)).collect()}
    assert got == want and len({*want.values()}) == 2


def test_asof_of_two_streams(spark, tmp_path, three_parts):
    rng = random.Random(5)
    at = lambda i: DAY + datetime.timedelta(minutes=i, microseconds=rng.randint(0, 999_999))
    left = [(rng.choice("ab"), at(rng.randint(0, 300)), i) for i in range(90)]
    right = [(rng.choice("ab"), at(rng.randint(0, 300)), float(i)) for i in range(40)]
    end = [(k, DAY + datetime.timedelta(days=9), -1) for k in "ab"]
    ls, rs = "symbol string, ts timestamp, id long", "symbol string, ts timestamp, v double"
    stream = arriving(spark, [*shuffled(left, 30, rng, lambda r: r[1]), end], ls, tmp_path / "l")
    reference = arriving(spark, [*shuffled(right, 14, rng, lambda r: r[1]), [(*e[:2], -1.0) for e in end]], rs, tmp_path / "r")
    got = {r.id: r.reference_row and r.reference_row.v for r in results(streams.asof_streams(stream, reference, late="300 minutes"), tmp_path, "c") if r.id >= 0}
    batch = asof.asof_join(spark.createDataFrame(left, ls), spark.createDataFrame(right, rs), "ts", ["symbol"])
    assert got == {r.id: r.v for r in batch.select("id", "v").collect()}
    assert any(v is None for v in got.values()) and batch.where(F.col("v").isNotNull()).count() > 50
