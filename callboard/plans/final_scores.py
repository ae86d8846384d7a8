"""Scores per agent, line of business and issue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AGENT_KEYS = ["employee_name", "sub_line_of_business__c"]
ISSUE = "incidentlevel2reason"


def final_score(
    scored: DataFrame, keys: Sequence[str] = (*AGENT_KEYS, ISSUE), score: str = "score", label: str = "pred_score"
) -> DataFrame:
    """Mean score and number of labelled cases per group; groups with a missing key are left out."""
    return (
        scored.dropna(subset=list(keys))
        .groupBy(*keys)
        .agg(F.avg(score).alias("score"), F.count(label).alias("count"))
    )


def pivoted(
    scores: DataFrame, issues: Sequence[str] | None = None, rows: Sequence[str] = tuple(AGENT_KEYS), issue: str = ISSUE
) -> DataFrame:
    """One row per agent and line of business, one column per issue.

    Naming the ``issues`` saves the job that looks for them.
    """
    grouped = scores.groupBy(*rows)
    grouped = grouped.pivot(issue, list(issues)) if issues is not None else grouped.pivot(issue)
    return grouped.agg(F.max("score"))
