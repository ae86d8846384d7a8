"""Availability of agents, kept up to date while snapshot files arrive."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.snapshots import SEAM
from ..session import file_system
from ..sources.snapshots import agents, hour_of_path, listed_files, pieces_of

RECORD = ["hour", "file_time", "file_path", "available"]
STATE_SCHEMA = "ldap STRING, hour STRING, file_time TIMESTAMP, file_path STRING, available BOOLEAN"
# Versions of the state that stay: the present one, and the one before for a batch that is run again.
KEPT_VERSIONS = 2


def arriving(
    spark: SparkSession, folder: str, files_per_trigger: int | None = None, archive: str | None = None
) -> DataFrame:
    """Stream of snapshots from every file that appears below ``folder``.

    A trigger lists the folder whole. With ``archive`` files are moved there once they are dealt
    with, so that the listing stays as short as what is new.
    """
    reader = (
        spark.readStream.schema("value STRING").option("lineSep", SEAM).option("recursiveFileLookup", True)
    )
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return agents(pieces_of(reader.text(folder)))


def records(snapshots: DataFrame) -> DataFrame:
    """Snapshots as states: (ldap, hour, file_time, file_path, available)."""
    known = snapshots.where(F.col("ldap").isNotNull())
    return known.select("ldap", hour_of_path(F.col("file_path")).alias("hour"), *RECORD[1:])


def latest_state(states: DataFrame) -> DataFrame:
    """Latest known state of every agent.

    Files are ordered by the hour of their folder, then by when they were written. An
    agent met twice in one file is available if either record says so. Both rules are
    one maximum, so the state is a single row per agent, a late, older file changes
    nothing, and a file that is met again changes nothing either.
    """
    return states.groupBy("ldap").agg(F.max(F.struct(*RECORD)).alias("last")).select("ldap", "last.*")


def versions(spark: SparkSession, table: str) -> list[int]:
    """Numbers of the states that are written whole, in order."""
    files, path = file_system(spark, table)
    if not files.exists(path):
        return []
    found = [status.getPath() for status in files.listStatus(path)]
    whole = [p for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().removeprefix("version=")) for p in whole)


def keep_up(snapshots: DataFrame, table: str, checkpoint: str, available_now: bool = True):
    """Start the stream; each batch writes the whole state, one row per agent, as a new version.

    A version is the one before it and the batch, so a batch that is run again writes the same
    and a restart leaves neither gaps nor doubles. Versions nobody needs are removed.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        states, before = records(batch), [v for v in versions(spark, table) if v < batch_id]
        if before:
            states = states.unionByName(_version(spark, table, before[-1]))
        latest_state(states).write.mode("overwrite").parquet(f"{table}/version={batch_id}")
        for old in versions(spark, table)[:-KEPT_VERSIONS]:
            files, path = file_system(spark, f"{table}/version={old}")
            files.delete(path, True)

    writer = snapshots.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _version(spark: SparkSession, table: str, number: int) -> DataFrame:
    return spark.read.schema(STATE_SCHEMA).parquet(f"{table}/version={number}")


def read_state(spark: SparkSession, table: str) -> DataFrame:
    """(ldap, hour, file_time, file_path, available) of every agent, as of the last batch."""
    found = versions(spark, table)
    state = _version(spark, table, found[-1]) if found else spark.createDataFrame([], STATE_SCHEMA)
    return state.where(F.col("ldap").isNotNull())


def hours_between(first: datetime, last: datetime) -> list[datetime]:
    """Full hours from that of ``first`` to that of ``last``."""
    start, end = (t.astimezone(timezone.utc).replace(minute=0, second=0, microsecond=0) for t in (first, last))
    return [start + timedelta(hours=i) for i in range(int((end - start).total_seconds()) // 3600 + 1)]


def advance(
    spark: SparkSession, root: str, table: str, now: datetime, since: datetime, late_hours: int = 1, expiry_hours: float | None = None
) -> int:
    """Bring the state up to ``now`` from the folders of the hours that may have something new; how many were listed.

    The state says how far it came, in a row without a login that has the last file's hour and time. Only the
    folders from ``late_hours`` before that hour up to the present one are listed (from ``since`` on, where there
    is no state yet), and only files written after the last one are read, so neither grows with history. The new
    state is one version, written whole; a run that fails leaves the one before it, and the next run starts from
    there. With ``expiry_hours``, agents whose last file is that much older than ``now`` are left out.
    """
    found = versions(spark, table)
    before = _version(spark, table, found[-1]) if found else None
    last = before.agg(F.max("hour"), F.max("file_time").cast("double")).first() if before is not None else (None, None)
    since = since.astimezone(timezone.utc)
    first = since
    if last[0] is not None:
        first = max(since, datetime.strptime(last[0], "%Y/%m/%d/%H").replace(tzinfo=timezone.utc) - timedelta(hours=late_hours))
    hours = hours_between(first, now)
    new = [
        (path, time, hour.strftime("%Y/%m/%d/%H"))
        for hour in hours
        for path, time in listed_files(spark, root, hour)
        if last[1] is None or time.timestamp() > last[1] + 1e-6
    ]
    if not new and (before is None or expiry_hours is None):
        return len(hours)
    parts = [] if before is None else [before]
    if new:
        lines = spark.read.schema("value STRING").option("lineSep", SEAM).text([path for path, *_ in new])
        parts.append(records(agents(pieces_of(lines))))
        reached = (None, max(hour for *_, hour in new), max(time for _, time, _ in new), "", False)
        parts.append(spark.createDataFrame([reached], STATE_SCHEMA))
    state = latest_state(reduce(DataFrame.unionByName, parts))
    if expiry_hours is not None:
        state = state.where(F.col("ldap").isNull() | (F.col("file_time") > F.lit(now - timedelta(hours=expiry_hours))))
    state.write.mode("overwrite").parquet(f"{table}/version={found[-1] + 1 if found else 0}")
    for old in versions(spark, table)[:-KEPT_VERSIONS]:
        files, path = file_system(spark, f"{table}/version={old}")
        files.delete(path, True)
    return len(hours)
