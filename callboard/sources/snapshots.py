"""Agent-status snapshot files.

Files lie in one folder per hour, ``connect/AEs/YYYY/MM/DD/HH/``. Each holds JSON
objects written one after the other with nothing between them. The reader splits a
file at the seams between objects, so a large file is read by several tasks and no
row holds a whole file.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.snapshots import SEAM, can_take_a_case, parsed_piece, user
from ..session import file_system

# The folder below the root and the four levels below it.
PREFIX = "connect/AEs"
LEVELS = ["year", "month", "day", "hour"]


def hour_folder(as_of: datetime, named: bool = False) -> str:
    """Folder of the hour of ``as_of``; ``named`` for levels written as ``year=2024``."""
    parts = [as_of.strftime(f) for f in ("%Y", "%m", "%d", "%H")]
    if named:
        parts = [f"{level}={part}" for level, part in zip(LEVELS, parts)]
    return "/".join([PREFIX, *parts]) + "/"


def hour_of_path(path: Column) -> Column:
    """``YYYY/MM/DD/HH`` out of a file's path, for both ways of naming the levels."""
    pattern = r"/(?:year=)?(\d{4})/(?:month=)?(\d{2})/(?:day=)?(\d{2})/(?:hour=)?(\d{2})/[^/]*$"
    return F.concat_ws("/", *[F.regexp_extract(path, pattern, i) for i in (1, 2, 3, 4)])


def files_of_hour(spark: SparkSession, root: str, as_of: datetime, named: bool = False) -> DataFrame:
    """(file_path, file_time) of one hour; no rows where there is no folder.

    Only that folder is listed, and nothing is read from the files themselves.
    """
    folder = f"{root.rstrip('/')}/{hour_folder(as_of, named)}"
    try:
        files = spark.read.format("binaryFile").load(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "file_path STRING, file_time TIMESTAMP")
    return files.select(F.col("path").alias("file_path"), F.col("modificationTime").alias("file_time"))


def listed_files(spark: SparkSession, root: str, as_of: datetime, named: bool = False) -> list[tuple[str, datetime]]:
    """(path, time it was written) of each file of one hour, by one listing of its folder."""
    files, folder = file_system(spark, f"{root.rstrip('/')}/{hour_folder(as_of, named)}")
    if not files.exists(folder):
        return []
    found = [status for status in files.listStatus(folder) if status.isFile()]
    times = (datetime.fromtimestamp(status.getModificationTime() / 1000, timezone.utc) for status in found)
    return [(status.getPath().toString(), time) for status, time in zip(found, times)]


def newest_file(files: DataFrame) -> str | None:
    """Path of the file written last; of equally old files the last by path."""
    return files.agg(F.max(F.struct("file_time", "file_path")).alias("last")).select("last.file_path").first()[0]


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """(piece, file_path, file_time) of a file or of all files below a folder, one row per object."""
    return pieces_of(spark.read.option("lineSep", SEAM).option("recursiveFileLookup", True).text(path))


def pieces_of(lines: DataFrame) -> DataFrame:
    """The same from what a batch or streaming text reader with that separator returns."""
    return lines.select(
        F.col("value").alias("piece"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_modification_time").alias("file_time"),
    )


def agents(pieces: DataFrame) -> DataFrame:
    """(file_path, file_time, ldap, available), one row per snapshot that parses."""
    snapshot = pieces.select("file_path", "file_time", parsed_piece("piece").alias("s"))
    return snapshot.select(
        "file_path", "file_time", "s", user("s").alias("ldap"), can_take_a_case("s").alias("available")
    )


def available_agents(pieces: DataFrame) -> DataFrame:
    """Logins that can take a case by one file: any record that says so is enough.

    A file that is not well-formed as a whole gives nobody.
    """
    rows = agents(pieces)
    whole = rows.agg(F.coalesce(F.bool_and(F.col("s").isNotNull()), F.lit(True))).scalar()
    return rows.where(F.col("available") & F.col("ldap").isNotNull() & whole).select("ldap").distinct()


def available_now(spark: SparkSession, root: str, as_of: datetime | None = None, named: bool = False) -> DataFrame:
    """Logins that can take a case by the newest file of the hour; nobody without a file.

    ``as_of`` is in UTC, by default the present.
    """
    as_of = as_of or datetime.now(timezone.utc)
    path = newest_file(files_of_hour(spark, root, as_of, named))
    if path is None:
        return spark.createDataFrame([], "ldap STRING")
    return available_agents(read_pieces(spark, path))
