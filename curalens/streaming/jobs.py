"""Arrival-time jobs. Each is a builder (streaming frame -> streaming frame) and a way to land it.

State sits in the state store, so a batch costs what arrives in it and not
what was seen before; keys of all time sit in a table of their own. Changed rows and keys
land in leveled tables: a batch that is run again after a failure changes nothing that counts, so results are
exact however often executors are lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from curalens.operators.lists import newest_reach
from curalens.schemas import SUPPLIED
from curalens.streaming.levels import LeveledTable, admit, upsert

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Monday 00:00 in Asia/Tokyo, counted from the epoch; that zone has no daylight saving.
WEEK_OFFSET = "3 days 15 hours"
STALE_AFTER = "6 hours"
RETRY_WAIT_SECONDS, RETRY_LIMIT = 600, 3


def stream_session(spark: SparkSession, state_partitions: int = 8) -> SparkSession:
    """A session of its own. ``state_partitions`` is fixed by the first start of a job and kept in its checkpoint,
    so it is chosen for the state the job will hold, not for the executors that happen to be up."""
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", "UTC")
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    own.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    return own


def read_events(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(SUPPLIED["events"])
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


# --- builders ---------------------------------------------------------------

def latest_reach(readings: DataFrame) -> DataFrame:
    """Newest reading per media item; of readings at one instant the first to arrive."""
    return readings.groupBy("media_id").agg(newest_reach(readings), F.max("read_at").alias("read_at"),
                                            F.count("*").alias("readings"))


def weekly(posts: DataFrame) -> DataFrame:
    """Posts and reach per local Monday-to-Monday week.

    No watermark: it would drop late posts unseen, and the state is one row a week.
    """
    at = F.window("published_at", "7 days", "7 days", WEEK_OFFSET)
    return posts.groupBy(at.alias("w")).agg(
        F.count("*").alias("posts"), F.count("reach").alias("measured"), F.sum("reach").alias("reach_total")
    ).select(F.col("w.start").alias("week_from"), "posts", "measured", "reach_total")


def trend(posts: DataFrame) -> DataFrame:
    """Reach per kind over the trailing eight weeks, one window a week. No watermark, as above."""
    at = F.window("published_at", "56 days", "7 days", WEEK_OFFSET)
    return posts.groupBy(at.alias("w"), "kind").agg(
        F.count("reach").alias("posts"), F.sum("reach").alias("reach_total")
    ).select(F.col("w.start").alias("window_from"), F.col("w.end").alias("window_to"), "kind", "posts", "reach_total")


def route_stale(slots: DataFrame) -> DataFrame:
    """Slots that come more than six hours late are set aside, not dropped and not published."""
    late = F.col("arrived_at") > F.col("scheduled_at") + F.expr(f"INTERVAL {STALE_AFTER}")
    return slots.withColumn("route", F.when(late, "stale").otherwise("due"))


def retry_state(failures: DataFrame) -> DataFrame:
    """Failures so far, when the next try is allowed, and whether the limit is reached."""
    got = failures.groupBy("item_id").agg(F.count("*").alias("failures"), F.max("at").alias("last_at"))
    return got.select("item_id", F.least("failures", F.lit(RETRY_LIMIT)).alias("attempts"),
                      (F.col("failures") >= RETRY_LIMIT).alias("given_up"),
                      F.when(F.col("failures") < RETRY_LIMIT,
                             F.col("last_at") + F.expr(f"INTERVAL {RETRY_WAIT_SECONDS} SECONDS")).alias("next_try_at"))


class RetryTimers(StatefulProcessor):
    """An item comes out again a while after each failure, until it has failed too often.

    A failure before the item came out restarts the wait. The state of an item is its failures and when it
    is due, in microseconds; its timer is set to the millisecond after. Once it is given up nothing more happens to it.
    """

    def __init__(self, wait_seconds: int, limit: int):
        self.wait, self.limit = wait_seconds * 1_000_000, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("retry", "failures int, due long")

    def _rows(self, key: tuple, found: list[tuple[int, str, int]]) -> Iterator[pd.DataFrame]:
        if found:
            attempts, outcomes, times = zip(*found)
            yield pd.DataFrame({"item_id": [key[0]] * len(found), "attempt": pd.array(attempts, "int32"), "outcome": outcomes,
                                "at": pd.to_datetime(times, unit="us", utc=True)})

    @staticmethod
    def _timer(due: int) -> int:
        return -(-due // 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        failures, due = self.state.get() if self.state.exists() else (0, None)
        asked, found = due, []
        times = pd.concat([r["at"] for r in rows])
        for at in sorted(t.value // 1000 for t in times):
            if failures >= self.limit:
                break
            if due is not None and at >= due:        # it was out before it failed again
                found.append((failures, "retry", due))
            failures, due = failures + 1, at + self.wait
            if failures >= self.limit:
                found.append((failures, "given up", at))
                due = None
        if asked is not None and asked != due:
            self.handle.deleteTimer(self._timer(asked))
        if due is not None and asked != due:
            self.handle.registerTimer(self._timer(due))
        self.state.update((failures, due))
        yield from self._rows(key, found)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        failures, due = self.state.get()
        if due is not None and self._timer(due) == expiredTimerInfo.getExpiryTimeInMs():
            self.state.update((failures, None))
            yield from self._rows(key, [(failures, "retry", due)])

    def close(self) -> None:
        pass


def retries(failures: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """``failures`` (item_id, at) to what comes out again: attempt so far, ``retry`` or ``given up``, and when.

    Timers fire as the watermark, the newest failure less ``delay``, passes them; a failure that comes later than
    that is not counted. Failures of an item in one batch or in many give the same rows.
    """
    return (failures.withWatermark("at", delay).groupBy("item_id").transformWithStateInPandas(
        RetryTimers(RETRY_WAIT_SECONDS, RETRY_LIMIT), "item_id long, attempt int, outcome string, at timestamp", "Append", "EventTime"))


# --- landing ----------------------------------------------------------------

def land_appends(stream: DataFrame, folder: str, partition_by: list[str] | None = None) -> None:
    """Run until all input is used; append-only rows go to the exactly-once file sink."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows").option(
        "checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.start().awaitTermination()


def land_updates(stream: DataFrame, folder: str, keys: list[str]) -> None:
    """Run until all input is used; changed rows go to a leveled table under ``folder``."""
    def write(changed: DataFrame, batch: int) -> None:
        upsert(LeveledTable(changed.sparkSession, folder), changed, batch, keys)

    (stream.writeStream.outputMode("update").foreachBatch(write)
     .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination())


def land_once(stream: DataFrame, folder: str, key: str) -> None:
    """Run until all input is used; keys never seen before, over all time, go to a leveled table of keys.

    There is no state to hold: a batch looks its keys up in the table's filters and in the buckets they point to.
    """
    def write(arrived: DataFrame, batch: int) -> None:
        admit(LeveledTable(arrived.sparkSession, folder), arrived, batch, key)

    (stream.writeStream.outputMode("append").foreachBatch(write)
     .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination())
