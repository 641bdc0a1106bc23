"""Packets put in order by track, as a table and as a stream.

On a stream the packets of a track wait in state until the watermark has passed
their time, so that what comes out of order goes out in order; the state also
holds how many went out and the greatest read order among them, which is what
the check of rising numbers needs.  Both live in the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

#: What a stream needs: several states of a key are kept in this store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
ROWS = "track string, ordinal long, ts timestamp, read_order long, row string, rising boolean"


def order_packets(packets: DataFrame) -> DataFrame:
    """``packets(track, ts, read_order, row)`` -> the same with ``ordinal``,
    their place in their track by time, read order and row, and ``rising``:
    does the read order exceed all before it in the track?

    Packets without track, time or read order are left out; of equal ones each
    has a place.  A track is one task's work, which sorts it on disk.
    """
    known = packets.where("track is not null and ts is not null and read_order is not null")
    by_track = Window.partitionBy("track").orderBy("ts", "read_order", "row")
    before = F.max("read_order").over(by_track.rowsBetween(Window.unboundedPreceding, -1))
    rising = F.coalesce(F.col("read_order") > before, F.lit(True))
    return known.select(F.col("track").cast("string").alias("track"), (F.row_number().over(by_track) - 1).cast("long").alias("ordinal"), "ts", F.col("read_order").cast("long").alias("read_order"), "row", rising.alias("rising"))


class _InOrder(StatefulProcessor):
    """Holds the packets of a track until their time has passed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, us int, read_order long, row string")
        self.told = handle.getValueState("told", "n long, last long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        times: set[int] = set()
        new = []
        for batch in rows:
            micros = batch["ts"].astype("datetime64[us]").astype("int64")
            for us, number, row in zip(micros, batch["read_order"], batch["row"], strict=True):
                # A time has passed when the watermark is beyond its last microsecond.
                new.append((int(us // 1000), int(us % 1000), int(number), None if row is None or row != row else row))
                times.add(int(us // 1000) + 1)
        self.waiting.appendList(new)
        for at in times:
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        upto = timerValues.getCurrentWatermarkInMs()
        ready, rest = [], []
        for packet in self.waiting.get():
            (ready if packet[0] < upto else rest).append(tuple(packet))
        if not ready:
            return
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        ready.sort(key=lambda p: (p[0], p[1], p[2], p[3] is not None, p[3] or ""))
        n, last = tuple(self.told.get()) if self.told.exists() else (0, None)
        out = []
        for ms, us, number, row in ready:
            out.append((str(key[0]), n, pd.Timestamp(ms * 1000 + us, unit="us"), number, row, last is None or number > last))
            n, last = n + 1, number if last is None else max(last, number)
        self.told.update((n, last))
        yield pd.DataFrame(out, columns=["track", "ordinal", "ts", "read_order", "row", "rising"])

    def close(self) -> None:
        pass


def order_packet_stream(packets: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """The rows of ``order_packets`` from a stream whose packets come at most
    ``delay`` late; later ones are dropped, as by any watermark.

    A packet goes out once the watermark, the latest time seen less ``delay``,
    has passed it.  The session's state store has to be ``STORE``.  State holds
    what came within ``delay``, by track, and two numbers a track.
    """
    known = packets.where("track is not null and ts is not null and read_order is not null")
    rows = known.select(F.col("track").cast("string").alias("track"), "ts", F.col("read_order").cast("long").alias("read_order"), "row").withWatermark("ts", delay)
    return rows.groupBy("track").transformWithStateInPandas(statefulProcessor=_InOrder(), outputStructType=ROWS, outputMode="Append", timeMode="EventTime")
