"""Session set-up and the shared folder that intermediate tables go to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "callboard", cores: str = "*", partitions: int = 8) -> SparkSession:
    """Session for tests and the benchmark. A cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # Test tables are small: without this, later stages would use one or two of the cores.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster a
    machine-local path would be lost with the machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="callboard-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def run_folder(spark: SparkSession) -> str:
    """Folder below the shared one that holds whatever this application writes in between."""
    return f"{shared_folder(spark)}/callboard/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a folder of this application that nothing uses yet."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """(file system, path) of the JVM for a path."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def clear(spark: SparkSession) -> None:
    """Remove what this application has written in between; frames that still read it end here."""
    files, path = file_system(spark, run_folder(spark))
    files.delete(path, True)


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    Used where several later passes read the same frame. It cuts the lineage,
    survives lost executors, and, unlike a checkpoint, keeps the columns apart,
    so that each pass reads only those it needs. ``options`` are those of the writer.
    """
    path = new_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
