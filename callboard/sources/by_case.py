"""Case tables stored by case, so that joining and deduplicating them by case moves no rows.

Cases, closed cases and health are written in the same number of buckets of the case key, one file
each, as tables of the catalog. Joins between them and the whole-row dedup of health then work bucket by
bucket. A bucket cannot be divided when it is read, so cases with more rows than a task should have are
kept apart, in plain folders, and joined the way that spreads their rows.

Rows without a case key join nothing and are not stored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import ROWS_PER_TASK, hot_rows

KEY = "case_key"
NAMES = ["cases", "closed", "health"]


@dataclass
class CaseTables:
    """Names of the stored tables start with ``prefix``; ``hot`` are the cases kept apart (see ``hot_rows``), if any."""

    prefix: str
    path: str
    hot: DataFrame | None

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """Rows of all cases but the hot ones."""
        return spark.table(f"{self.prefix}_{name}")

    def hot_table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.schema(self.table(spark, name).schema).parquet(f"{self.path}/hot-{name}")


def write(
    cases: DataFrame, closed: DataFrame, health: DataFrame, prefix: str, path: str, buckets: int, rows_per_task: int = ROWS_PER_TASK
) -> CaseTables:
    """Store the three tables, all with a column ``case_key``, in ``buckets``. Tables of that name are replaced.

    Which cases are hot is stored beside the tables and looked up by joins: they may be many.
    """
    spark = cases.sparkSession
    counted = hot_rows(cases, [KEY], rows_per_task)
    counted.write.mode("overwrite").parquet(f"{path}/hot-keys")
    hot = spark.read.schema(counted.schema).parquet(f"{path}/hot-keys")
    hot = None if hot.isEmpty() else hot
    for name, df in zip(NAMES, (cases, closed, health)):
        cold = known = df.where(F.col(KEY).isNotNull())
        if hot is not None:
            is_hot = F.xxhash64(KEY) == F.col("_key")
            known.join(hot, is_hot, "left_semi").write.mode("overwrite").parquet(f"{path}/hot-{name}")
            cold = known.join(hot, is_hot, "left_anti")
        # Dealt as the buckets are, so that each is written by one task to one file.
        writer = cold.repartition(buckets, KEY).write.mode("overwrite").option("path", f"{path}/{name}").bucketBy(buckets, KEY).sortBy(KEY)
        writer.saveAsTable(f"{prefix}_{name}")
    return CaseTables(prefix, path, hot)


def drop(spark: SparkSession, tables: CaseTables) -> None:
    """Forget the tables; their files stay in their folder."""
    for name in NAMES:
        spark.sql(f"DROP TABLE IF EXISTS {tables.prefix}_{name}")
