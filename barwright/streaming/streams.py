"""Structured Streaming: bars from ticks, stateful books and breakers, and batch functions per micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barwright.operators.asof import asof_join
from barwright.sources.readers import upsert_latest

BOOK_OUT = "symbol string, u bigint, bids array<struct<price:double,qty:double>>, asks array<struct<price:double,qty:double>>"


def stream_bars(ticks: DataFrame, width: str, late: str = "10 minutes", by: str = "symbol") -> DataFrame:
    """Tumbling OHLCV bars of a tick stream ``symbol, ts, id, price, qty``; a bar comes out once the watermark passes it."""
    timed = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    at = F.struct("ts", "id")
    bars = timed.groupBy(by, F.window("ts", width).alias("w")).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("qty").alias("volume"))
    return bars.select(by, F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


class BookProcessor(StatefulProcessor):
    """One book per symbol: snapshots reset, deltas replace or delete levels, stale updates and early deltas are dropped."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        level = T.StructType([T.StructField("side", T.StringType()), T.StructField("price", T.DoubleType())])
        self.levels = handle.getMapState("levels", level, T.StructType([T.StructField("qty", T.DoubleType())]))
        self.last = handle.getValueState("last", T.StructType([T.StructField("u", T.LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        every = pd.concat(list(rows), ignore_index=True)
        every["_reset"] = (every["type"] != "snapshot").astype(int)
        every = every.sort_values(["u", "_reset", "pos"], kind="stable")
        last = self.last.get()[0] if self.last.exists() else None
        changed = False
        for (u, _), group in every.groupby(["u", "_reset"], sort=True):
            snapshot = group["type"].iloc[0] == "snapshot"
            if not snapshot and (last is None or u <= last):
                continue
            if snapshot:
                if last is not None and u < last:
                    continue
                self.levels.clear()
            for side, price, qty in zip(group["side"], group["price"], group["qty"], strict=True):
                if pd.isna(price):
                    continue
                if qty > 0:
                    self.levels.updateValue((side, float(price)), (float(qty),))
                elif self.levels.containsKey((side, float(price))):
                    self.levels.removeKey((side, float(price)))
            last, changed = int(u), True
        if changed:
            self.last.update((last,))
            book = {"bid": [], "ask": []}
            for (side, price), (qty,) in self.levels.iterator():
                book[side].append({"price": price, "qty": qty})
            yield pd.DataFrame({"symbol": [key[0]], "u": [last], "bids": [sorted(book["bid"], key=lambda x: -x["price"])], "asks": [sorted(book["ask"], key=lambda x: x["price"])]})

    def close(self) -> None:
        pass


def rebuild_stream(messages: DataFrame) -> DataFrame:
    """Books on change from a stream of level rows (``read_l2_messages``); needs the RocksDB state store."""
    return messages.groupBy("symbol").transformWithStateInPandas(BookProcessor(), outputStructType=BOOK_OUT, outputMode="Update", timeMode="None")


class OrderedProcessor(StatefulProcessor):
    """Holds a key's rows until the watermark has passed them, then hands them to ``step`` in event-time order, however they arrived.

    Rows have ``us``, their event time in microseconds, and the columns of ``schema``. Later rows than the
    watermark allows are dropped by Spark before they come here.
    """

    schema, names = "us long", ["us"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.schema)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        every = [tuple(None if pd.isna(v) else v for v in row) for frame in rows for row in frame[self.names].astype(object).itertuples(index=False, name=None)]
        if every:
            self.held.appendList(every)
            self._wake(every)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        rows = [*self.held.get()]
        due = [r for r in rows if -(-r[0] // 1000) <= mark]
        rest = [r for r in rows if -(-r[0] // 1000) > mark]
        if due:
            self.held.clear()
            if rest:
                self.held.put(rest)
            yield self.step(key, sorted(due, key=lambda r: r[: self.by]))
        if rest:
            self._wake(rest)
        self.idle(mark)

    #: Leading columns that rows are ordered by.
    by = 1

    def _wake(self, rows: list[tuple]) -> None:
        self.handle.registerTimer(-(-min(r[0] for r in rows) // 1000))

    def step(self, key: Any, rows: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError

    def idle(self, mark: int) -> None:
        """Called once the watermark has reached ``mark`` (milliseconds): a chance to let state go."""

    def close(self) -> None:
        pass


class BreakerProcessor(OrderedProcessor):
    """Daily and peak loss latches per account, in event-time order; an account without rows for ``keep_ms`` starts afresh."""

    schema, names = "us long, day string, equity double", ["us", "day", "equity"]
    daily, peak, keep_ms = 0.10, 0.30, 365 * 24 * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("s", "us long, day string, first double, top double, daily boolean, peak boolean")

    def step(self, key: Any, rows: list[tuple]) -> pd.DataFrame:
        _, day, first, top, down, halted = self.state.get() if self.state.exists() else (None, None, None, None, False, False)
        out = []
        for us, today, equity in rows:
            if today != day:
                day, first, down = today, equity, False
            if equity is not None:
                top = equity if top is None else max(top, equity)
                down = down or bool(first and (first - equity) / first >= self.daily)
                halted = halted or bool(top > 0 and (top - equity) / top >= self.peak)
            out.append((key[0], us, equity, not down and not halted))
        self.state.update((rows[-1][0], day, first, top, down, halted))
        self.handle.registerTimer(rows[-1][0] // 1000 + self.keep_ms)
        return pd.DataFrame(out, columns=["account", "us", "equity", "allowed"])

    def idle(self, mark: int) -> None:
        if self.state.exists() and self.state.get()[0] // 1000 + self.keep_ms <= mark:
            self.state.clear()


def breaker_stream(equity: DataFrame, late: str = "10 minutes") -> DataFrame:
    """``account, ts, equity, allowed`` for a stream of equity values ``account, ts, equity``: see ``circuit_breaker``.

    A row comes out once the watermark, ``late`` behind the newest time, has passed it. Needs the RocksDB state store.
    """
    timed = equity.withWatermark("ts", late).select("account", "ts", F.unix_micros("ts").alias("us"), F.to_date("ts").cast("string").alias("day"), F.col("equity").cast("double").alias("equity"))
    made = timed.groupBy("account").transformWithStateInPandas(BreakerProcessor(), outputStructType="account string, us long, equity double, allowed boolean", outputMode="Append", timeMode="EventTime")
    return made.select("account", F.timestamp_micros("us").alias("ts"), "equity", "allowed")


class AsofProcessor(OrderedProcessor):
    """Gives each row of a key the reference row in force at its time; of versions that have passed, the last one is kept."""

    schema, names, by = "us long, side int, row string", ["us", "side", "row"], 3

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.known = handle.getValueState("known", "us long, row string")

    def step(self, key: Any, rows: list[tuple]) -> pd.DataFrame:
        known = self.known.get() if self.known.exists() else (None, None)
        out, before = [], known
        for us, side, row in rows:
            if side == 0:
                known = (us, row)
            else:
                out.append((row, known[1]))
        if known is not before:
            self.known.update(known)
        return pd.DataFrame(out, columns=["row", "found"])


def asof_streams(stream: DataFrame, reference: DataFrame, on: str = "ts", by: str = "symbol", late: str = "10 minutes") -> DataFrame:
    """``stream`` with ``reference_row``, a struct of the key's latest row of the stream ``reference`` at or before its time; null without one.

    Both wait in state until the watermark has passed them, so the result is that of ``asof_join`` on all rows that are not
    late, whatever the order of arrival; of reference rows at one time the greatest one as JSON counts. Needs the RocksDB state store.
    """
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    packed = lambda d, side: d.withWatermark(on, late).select(F.col(by).cast("string").alias("_k"), F.col(on).alias("_ts"), F.unix_micros(on).alias("us"), F.lit(side).alias("side"), F.to_json(F.struct(*d.columns), exact).alias("row"))
    both = packed(stream, 1).union(packed(reference, 0))
    found = both.groupBy("_k").transformWithStateInPandas(AsofProcessor(), outputStructType="row string, found string", outputMode="Append", timeMode="EventTime")
    return found.select(F.from_json("row", stream.schema, exact).alias("r"), F.from_json("found", reference.schema, exact).alias("reference_row")).select("r.*", "reference_row")


def each_batch(stream: DataFrame, step: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], history: Callable[[], DataFrame] | None = None, new: str = "_new"):
    """Run batch functions on a stream: each micro-batch, with its look-back rows, passes ``step``; rows of the batch go to ``sink``."""

    def run(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn(new, F.lit(True))
        if history is not None:
            rows = rows.unionByName(history().withColumn(new, F.lit(False)))
        sink(step(rows).where(new).drop(new), number)

    return stream.writeStream.foreachBatch(run)


def asof_stream(stream: DataFrame, reference: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], on: str = "ts", by: list[str] | None = None, **options):
    """Join each micro-batch as of a reference table that is read anew each time: see ``asof_join`` for ``options``."""
    return each_batch(stream, lambda rows: asof_join(rows, reference(), on, by, **{"chunk": "day"} | options), sink)


def upsert_stream(stream: DataFrame, path: str, key: list[str], order: str):
    """Keep the latest row per key of a stream in a Parquet table."""
    return stream.writeStream.foreachBatch(lambda batch, _: upsert_latest(batch, path, key, order))


def sampled_books(books: DataFrame, every: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """The last book of each symbol and event-time bucket of a stream with ``ts``."""
    timed = books.withWatermark("ts", late)
    return timed.groupBy("symbol", F.window("ts", every)).agg(F.max_by(F.struct("ts", "bids", "asks"), "ts").alias("b")).select("symbol", F.col("window.start").alias("bucket"), "b.*")


def complete_windows(rows: DataFrame, symbols: int, width: str = "1 minute", ts: str = "ts") -> DataFrame:
    """Buckets of a batch in which all ``symbols`` are present."""
    w = F.window(F.col(ts).cast("timestamp"), width)["start"]
    return rows.groupBy(w.alias("bucket")).agg(F.count_distinct("symbol").alias("n")).where(F.col("n") == symbols).select("bucket")
