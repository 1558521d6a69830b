"""Streaming forms: a session's quota of distinct values with a lifetime, rates by window, an incremental runner."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Fixed value: the only kind of store that keeps maps, lists and timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DECIDED = "session string, value string, ts timestamp, allowed boolean"


def _ms(at: datetime.datetime) -> int:
    return int(at.timestamp() * 1000)


class Quota(StatefulProcessor):
    """A session's state: a map of the values it was given, when its timer is set to, and rows of the batch at hand.

    Rows of a batch come in any order. In one pass they are put into a list in the store, and of values that are new
    those with the earliest requests are kept, so many as may still be given; in a second pass over that list each row
    is decided. So no more than ``most`` values of a session are in memory, whatever it asks.
    """

    def __init__(self, most: int, life_ms: int) -> None:
        self.most, self.life_ms = most, life_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.given = handle.getMapState("given", "value string", "at timestamp")
        self.timer = handle.getValueState("timer", "ms long")
        self.rows = handle.getListState("rows", "value string, ts timestamp")

    def _kept(self) -> set:
        return {k[0] for k in self.given.keys()} if self.given.exists() else set()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        given, first, last, part = self._kept(), {}, 0, []
        for r in rows:
            part.append((r["value"], r["ts"]))
            last = max(last, _ms(r["ts"]))
            value, order = r["value"], (r["ts"], r["value"])
            if value in given or self.most <= len(given):
                pass
            elif value in first:
                first[value] = min(first[value], order)
            elif len(first) < self.most - len(given):
                first[value] = order
            elif order < (worst := max(first.values())):
                first = {v: o for v, o in first.items() if o != worst} | {value: order}
            if len(part) == 1000:
                self.rows.appendList(part)
                part = []
        for value, order in first.items():
            self.given.updateValue((value,), (order[0],))
        given |= set(first)
        if self.rows.exists():
            if part:
                self.rows.appendList(part)
            part = self.rows.get()
        for value, ts in part:
            yield Row(session=key[0], value=value, ts=ts, allowed=value in given)
        self.rows.clear()
        before = self.timer.get()[0] if self.timer.exists() else None
        until = max(last + self.life_ms, timerValues.getCurrentWatermarkInMs() + 1, before or 0)
        if until != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(until)
            self.timer.update((until,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.given.clear()
        self.timer.clear()
        return iter(())

    def close(self) -> None:
        pass


def keep_state(spark: SparkSession) -> None:
    """Streams that the session starts keep their state in the store that maps, lists and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def session_quota(requests: DataFrame, session: str = "session", value: str = "value", at: str = "ts", most: int = 30, ttl: str = "16 minutes") -> DataFrame:
    """session, value, ts and allowed of each request of a stream. The session must ``keep_state``.

    A session may ask for so many different values, the first ones by time within a batch; repeats are free. Requests
    without a value or a time are left out. A session's state goes when event time passes its last request by ``ttl``: a timer, since a store's own lifetimes are of the clock.
    """
    rows = requests.select(F.col(session).cast("string").alias("session"), F.col(value).cast("string").alias("value"), F.col(at).cast("timestamp").alias("ts")).filter("ts IS NOT NULL AND value IS NOT NULL").withWatermark("ts", ttl)
    unit = requests.sparkSession.sql(f"SELECT CAST(unix_millis(TIMESTAMP '1970-01-01 00:00:00 UTC' + INTERVAL {ttl}) AS BIGINT)").first()[0]
    return rows.groupBy("session").transformWithState(Quota(most, unit), DECIDED, "Append", "EventTime")


def rate_alerts(requests: DataFrame, key: str, most: int, at: str = "ts", width: str = "60 seconds", late: str = "60 seconds") -> DataFrame:
    """key, start and n of windows with more requests than allowed, once they are closed."""
    rows = requests.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, width).alias("w"), key).agg(F.count("*").alias("n"))
    return rows.filter(F.col("n") > most).select(key, F.col("w.start").alias("start"), "n")


def run_incrementally(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]):
    """Process what is new since the last run, batch by batch, and stop. A batch that is done again must not add twice."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
