"""The routing scorecard in versions: readers see one whole version, writers add the next in one step.

A version is a small file ``versions/<number>.json`` that says which folder holds each issue and how far
each stream has come. Folders of rows are written once under a name of their own and never again, so a
reader or a job that fails half way never sees part of a change. A save reads and writes only the issues that
change and publishes the next version by giving its file a name that nobody has taken; where another
writer was faster, the change is made again on top of the other's. On file systems without an atomic
rename (object stores) there must be one writer at a time.

Rows without an issue or a login are passed over. A version lists as many folders as there are issues.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.upsert import upsert
from ..schemas import SCORECARD
from ..session import file_system

KEYS = ["issue_code", "ldap"]
# Versions that stay when older ones are removed, for readers that still use them.
KEPT_VERSIONS = 2
MOST_TRIES = 20


@dataclass
class Version:
    """``folders``: where the rows of each issue are; ``batches``: the last batch taken in from each stream."""

    number: int = 0
    folders: dict[str, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


def numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that are there, in order."""
    files, folder = file_system(spark, f"{path}/versions")
    if not files.exists(folder):
        return []
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    return sorted(int(name.removesuffix(".json")) for name in names if name.endswith(".json") and not name.startswith("."))


def version(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """A version, by default the last one; version 0, with nothing in it, where there is none yet."""
    if number is None:
        number = max(numbers(spark, path), default=0)
    if not number:
        return Version()
    text = spark.read.option("wholetext", True).text(f"{path}/versions/{number}.json").first()[0]
    return Version(number, **json.loads(text))


def _publish(spark: SparkSession, path: str, new: Version) -> bool:
    """Make ``new`` a version in one step; false if there is one of its number already."""
    files, target = file_system(spark, f"{path}/versions/{new.number}.json")
    draft = target.suffix(f".{uuid.uuid4().hex}.draft")
    files.mkdirs(target.getParent())
    out = files.create(draft)
    try:
        out.write(bytearray(json.dumps({"folders": new.folders, "batches": new.batches}).encode()))
    finally:
        out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(draft, target, none)
    except Exception as error:
        files.delete(draft, False)
        if files.exists(target):
            return False
        raise error
    return True


def read(spark: SparkSession, path: str, number: int | None = None, issues: list[str] | None = None) -> DataFrame:
    """Rows of a version (by default the last), of all issues or of some; folders of others are not listed."""
    found = version(spark, path, number).folders
    folders = [folder for issue, folder in found.items() if issues is None or issue in issues]
    if not folders:
        return spark.createDataFrame([], SCORECARD)
    return spark.read.schema(SCORECARD).parquet(*(f"{path}/{folder}" for folder in sorted(folders)))


def for_issue(spark: SparkSession, path: str, issue: str) -> DataFrame:
    """Agents of one issue, best first; equal scores by login."""
    return read(spark, path, issues=[issue]).orderBy(F.desc_nulls_last("score"), F.asc("ldap"))


def _part(issue: str) -> str:
    """Folder name of an issue, whatever characters it has."""
    return hashlib.md5(issue.encode()).hexdigest()


def save(
    spark: SparkSession, path: str, changes: DataFrame, order: list[str], stream: str | None = None, batch: int | None = None
) -> bool:
    """Put rows in by key, as the next version; false if this batch of this stream is in already.

    ``order`` tells which of several changes of a key is the last (see :func:`upsert`). The issues that
    change come to the driver, rows do not.
    """
    changes = changes.dropna(subset=KEYS)
    for _ in range(MOST_TRIES):
        last = version(spark, path)
        if stream is not None and last.batches.get(stream, -1) >= batch:
            return False
        touched = [r["issue_code"] for r in changes.select("issue_code").distinct().collect()]
        current = read(spark, path, last.number, touched)
        name = f"data/{uuid.uuid4().hex}"
        merged = upsert(current, changes, KEYS, order).withColumn("part", F.md5(F.col("issue_code").cast("binary")))
        # Rebalancing gathers an issue into few files and splits one that is too large for a task.
        merged.hint("rebalance", "part").write.partitionBy("part").parquet(f"{path}/{name}")
        new = Version(
            last.number + 1,
            last.folders | {issue: f"{name}/part={_part(issue)}" for issue in touched},
            last.batches | ({stream: batch} if stream is not None else {}),
        )
        if _publish(spark, path, new):
            return True
        files, folder = file_system(spark, f"{path}/{name}")
        files.delete(folder, True)
    raise RuntimeError(f"{MOST_TRIES} times another writer was faster")


def remove_old(spark: SparkSession, path: str, kept: int = KEPT_VERSIONS) -> None:
    """Remove all versions but the last ``kept``, and folders of rows that only removed versions used."""
    every = numbers(spark, path)
    old, stay = every[:-kept], every[-kept:]
    used = {folder for n in stay for folder in version(spark, path, n).folders.values()}
    gone = {folder for n in old for folder in version(spark, path, n).folders.values()} - used
    for name in [*(f"versions/{n}.json" for n in old), *sorted(gone)]:
        files, found = file_system(spark, f"{path}/{name}")
        files.delete(found, True)


def keep_up(changes: DataFrame, path: str, checkpoint: str, order: list[str], stream: str, available_now: bool = True):
    """Start a stream of changes; every batch becomes one version, once, however often it is run.

    A batch that was published but not marked as done in the checkpoint is run again after a restart and
    changes nothing. ``stream`` names the stream and must stay the same with its checkpoint.
    """

    def write(batch: DataFrame, number: int) -> None:
        save(batch.sparkSession, path, batch, order, stream, number)
        remove_old(batch.sparkSession, path)

    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
