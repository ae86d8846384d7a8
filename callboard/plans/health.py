"""Cases with their conversation health and agent figures, ready for modelling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import band, recode
from ..operators.describe import count_by
from ..operators.skew import spread_join

# The health label of the older form and what it becomes.
LABEL_CODES = {1: 1, -1: 0}
MIDDLE_BAND = 1


def with_health(
    cases: DataFrame,
    health: DataFrame,
    columns: Sequence[str] = ("pred_score", "model_prob"),
    dedup: bool = True,
    hot: Mapping[int, int] | DataFrame = {},
) -> DataFrame:
    """Cases with a health score.

    Duplicates are whole rows of ``health``, found before its columns are cut down, so a
    case with two different rows still appears twice, as it should. ``hot`` are the hot
    keys among the cases, if there are any.
    """
    rows = health.dropDuplicates() if dedup else health
    return spread_join(cases, rows.select("case_key", *columns), ["case_key"], hot=hot)


def with_issue_counts(
    cases: DataFrame, keys: Sequence[str] = ("employee_name", "incidentlevel2reason"), hot: Mapping[int, int] | None = None
) -> DataFrame:
    """Add ``counting``: how many cases the row's agent has had of the row's issue.

    Counted by a group-by with map-side sums and joined back, since a window would bring
    all rows of a busy agent into one task. ``cases`` is read three times (hot keys,
    counts, rows), so it should be a materialized table.
    """
    return spread_join(cases, count_by(cases, keys, "case_key", "counting"), list(keys), hot=hot)


def with_agent_figures(
    cases: DataFrame, agents: DataFrame, on: str = "new_employee_key", hot: Mapping[int, int] | None = None
) -> DataFrame:
    """Add the agent's daily hours, contacts per hour and (newer form) number of cases."""
    return spread_join(cases, agents, [on], hot=hot)


def with_band(cases: DataFrame, probability: str = "model_prob") -> DataFrame:
    return cases.withColumn("sign", band(probability))


def without_middle(cases: DataFrame) -> DataFrame:
    """Drop the middle band; a case without a probability stays."""
    return cases.where(~F.col("sign").eqNullSafe(F.lit(MIDDLE_BAND)))


def with_label(cases: DataFrame, source: str = "chs", label: str = "chs") -> DataFrame:
    """The -1/1 health label as 0/1; other values become NULL."""
    return cases.withColumn(label, recode(source, LABEL_CODES))
