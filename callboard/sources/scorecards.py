"""The routing scorecard: one row per (issue_code, ldap)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.upsert import upsert
from ..session import materialize
from ..schemas import SCORECARD


def write(df: DataFrame, path: str) -> None:
    """One folder per issue, so that a lookup lists and reads that issue only.

    Rebalancing gathers an issue into few files and splits an issue that is too large
    for one task.
    """
    df.hint("rebalance", "issue_code").write.mode("overwrite").partitionBy("issue_code").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All agents of all issues."""
    return spark.read.schema(SCORECARD).parquet(path)


def for_issue(scorecard: DataFrame, issue: str) -> DataFrame:
    """Agents of one issue, best first; equal scores by login."""
    return scorecard.where(F.col("issue_code") == issue).orderBy(F.desc_nulls_last("score"), F.asc("ldap"))


def of_touched_issues(scorecard: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows of the issues that occur in ``changes``.

    While ``touched`` is small enough to be broadcast, Spark finds the issues first and reads
    their folders only. It does so only where a condition on the small side looks selective;
    this one is true for every issue.
    """
    touched = changes.select("issue_code").where(F.col("issue_code") >= "").distinct()
    return scorecard.join(touched, "issue_code", "left_semi")


def save(spark: SparkSession, path: str, changes: DataFrame, order: list[str]) -> None:
    """Put rows into the stored scorecard, replacing those with the same key.

    Only the folders of the issues that change are read and written again. The new content
    is materialized first, because a folder cannot be replaced while it is being read.
    """
    current = of_touched_issues(read(spark, path), changes)
    merged = materialize(upsert(current, changes, ["issue_code", "ldap"], order), "scorecard")
    (
        merged.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("issue_code")
        .parquet(path)
    )
