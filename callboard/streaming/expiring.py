"""Changes of availability while snapshot files arrive; who is not heard of for a while is no longer available.

Each agent has one record of state, its last snapshot, and a timer. A newer snapshot replaces the record
and moves the timer; when the timer is due, a change to not available goes out and the record is removed. A
batch touches only the agents it hears of and those whose timers are due, and the state has no more agents
than were heard of within the time limit (and the watermark's delay), however many there ever were.

Time is when files were written. A snapshot that is older than the agent's last one changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHANGE_SCHEMA = "ldap STRING, at TIMESTAMP, available BOOLEAN, expired BOOLEAN"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Expiring(StatefulProcessor):
    """State and timer of one agent. Times are microseconds since 1970, whatever the zone of worker and session."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at LONG, file_path STRING, available BOOLEAN")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        """Snapshots of one agent; those of one file say available if any of them does."""
        files: dict[tuple[int, str], bool] = {}
        for row in rows:
            at = row["at"], row["file_path"]
            files[at] = files.get(at, False) or bool(row["available"])
        last = self.last.get() if self.last.exists() else None
        before = (last[0], last[1], last[2]) if last else None
        for (at, path), available in sorted(files.items()):
            if before and (at, path) <= before[:2]:
                continue
            if before and before[2] and at - before[0] > self.limit:
                yield Row(ldap=key[0], at=before[0] + self.limit, available=False, expired=True)
                before = (before[0], before[1], False)
            if available != (before[2] if before else False):
                yield Row(ldap=key[0], at=at, available=available, expired=False)
            before = at, path, available
        if before is not None:
            self.last.update(before)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((before[0] + self.limit) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at, _, available = self.last.get()
        self.last.clear()
        if available:
            yield Row(ldap=key[0], at=at + self.limit, available=False, expired=True)

    def close(self) -> None:
        pass


def changes(snapshots: DataFrame, hours: float, delay: str = "0 seconds") -> DataFrame:
    """Stream of (ldap, at, available, expired): each change of an agent's availability, the first one to available.

    ``snapshots`` is what ``availability.arriving`` gives. ``delay`` is how late a file may be.
    """
    micros = F.unix_micros("file_time").alias("at")
    known = snapshots.where(F.col("ldap").isNotNull()).select("ldap", "file_time", micros, "file_path", "available")
    made = CHANGE_SCHEMA.replace("TIMESTAMP", "LONG")
    changed = (
        known.withWatermark("file_time", delay)
        .groupBy("ldap")
        .transformWithState(Expiring(int(hours * 3600 * 1_000_000)), made, outputMode="Append", timeMode="EventTime")
    )
    return changed.withColumn("at", F.timestamp_micros("at"))


def keep_log(changed: DataFrame, folder: str, checkpoint: str, available_now: bool = True):
    """Start the stream that appends changes to ``folder``. Timers need the state to be kept in RocksDB."""
    spark = changed.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS_DB)
    try:
        writer = changed.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def available_agents(spark: SparkSession, folder: str, as_of: datetime | None = None) -> DataFrame:
    """Logins that are available by the log, at a time or by all of it."""
    log = spark.read.schema(CHANGE_SCHEMA).parquet(folder)
    if as_of is not None:
        log = log.where(F.col("at") <= F.lit(as_of))
    last = log.groupBy("ldap").agg(F.max(F.struct("at", ~F.col("expired"), "available")).alias("last"))
    return last.where("last.available").select("ldap")
