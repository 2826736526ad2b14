"""Sessions and changes of a key's value, on tables and on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def session_totals(events: DataFrame, time: str, key: str, value: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(key, start, end, n, total): a key's events without a pause of ``gap``; the end is ``gap`` after the last one.

    On a stream, events later than ``late`` are left out, and a session is given once it can take no more.  Rows without a time are left out.
    """
    rows = events.withWatermark(time, late) if events.isStreaming else events
    found = rows.filter(F.col(time).isNotNull()).groupBy(F.session_window(time, gap).alias("__s"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return found.select(key, F.col("__s.start").alias("start"), F.col("__s.end").alias("end"), "n", "total")


def changes(rows: DataFrame, key: str, time: str, price: str, tie: str) -> DataFrame:
    """(key, time, before, price) of the rows whose price differs from the row of the key before, by time and ``tie``."""
    before = F.lag(price).over(Window.partitionBy(key).orderBy(time, tie))
    found = rows.withColumn("__before", before).filter(F.col("__before") != F.col(price))
    return found.select(F.col(key).alias("key"), F.col(time).alias("time"), F.col("__before").cast("long").alias("before"), F.col(price).cast("long").alias("price"))


class LastPrice(StatefulProcessor):
    """Keeps each key's last price; gives a row for each change, and forgets a key that was silent for ``forget_ms`` of event time."""

    def __init__(self, forget_ms: int):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "price long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(["time", "tie"])
        held = self.last.get() if self.last.exists() else None
        before = None if held is None else held[0]
        out = []
        for time, price in zip(batch["time"], batch["price"], strict=True):
            if before is not None and price != before:
                out.append((key[0], time, int(before), int(price)))
            before = int(price)
        self.last.update((before,))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int(batch["time"].max().timestamp() * 1000) + self.forget_ms)
        yield pd.DataFrame(out, columns=["key", "time", "before", "price"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        yield pd.DataFrame(columns=["key", "time", "before", "price"])

    def close(self) -> None:
        pass


def change_stream(stream: DataFrame, key: str, time: str, price: str, tie: str, late: str = "2 hours", forget: int = 30 * 86_400_000) -> DataFrame:
    """:func:`changes` of a stream, with each key's last price as state.

    Rows of a key are taken in order within a batch, so files should come in order of time; rows later than ``late``
    are left out.  A key is forgotten ``forget`` milliseconds of event time after its last row.  The session needs
    the RocksDB state store.
    """
    rows = stream.select(F.col(key).alias("key"), F.col(time).alias("time"), F.col(price).cast("long").alias("price"), F.col(tie).alias("tie")).dropna(subset=["key", "time", "price"]).withWatermark("time", late)
    return rows.groupBy("key").transformWithStateInPandas(LastPrice(forget), "key string, time timestamp, before long, price long", "Append", "EventTime")
