"""Contacts per hour: cases and hours per agent and day, then one row per agent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import day
from ..functions.numbers import ratio, real
from ..functions.text import month_patterns
from .cases import excluding, with_agent_key

# Fixed values.
SECONDS_PER_HOUR = 3600.0
MOST_CONTACTS_PER_HOUR = 10.0
LEFT_OUT_MONTHS = ["2022-04", "2022-03", "2022-05", "2022-06"]

MEASURES = ["day_working_hours", "day_billable_hour", "CPH", "number_cases"]


def cases_per_day(call_chat: DataFrame, strict: bool = True) -> DataFrame:
    """(latest_employee_key, day, number_cases)."""
    return call_chat.groupBy("latest_employee_key", day("interaction_starttime", strict).alias("day")).agg(
        F.count("vendorid").alias("number_cases")
    )


def hours_per_day(
    productivity: DataFrame,
    months: Sequence[str] = (),
    seconds_per_hour: float = SECONDS_PER_HOUR,
    strict: bool = True,
) -> DataFrame:
    """(employee_key, Date, day_working_hours, day_billable_hour), without the given months."""
    rows = excluding(productivity, "cal_date", month_patterns(months)) if months else productivity

    def hours(column):
        return F.sum(real(column)) / F.lit(seconds_per_hour)

    return rows.groupBy("employee_key", day("cal_date", strict).alias("Date")).agg(
        hours("login_time").alias("day_working_hours"), hours("billable_hour").alias("day_billable_hour")
    )


def agent_days(cases: DataFrame, hours: DataFrame) -> DataFrame:
    """Every agent and day with hours, with the day's cases where there are any.

    Both sides come out of aggregates with one row per agent and day, so the join has
    no hot key however unevenly the raw rows are spread.
    """
    on = (F.col("latest_employee_key") == F.col("employee_key")) & (F.col("day") == F.col("Date"))
    return cases.join(hours, on, "right").select(
        F.coalesce("latest_employee_key", "employee_key").alias("latest_employee_key"),
        F.coalesce("day", "Date").alias("day"),
        F.col("number_cases").cast("double").alias("number_cases"),
        "day_working_hours",
        "day_billable_hour",
        ratio("number_cases", "day_billable_hour").alias("CPH"),
    )


def plausible_days(days: DataFrame, most: float = MOST_CONTACTS_PER_HOUR) -> DataFrame:
    """Days with a known number of contacts per hour of at most ``most``.

    That takes a known number of cases. Saying so lets Spark turn the outer join before it
    into an inner one.
    """
    return days.where(F.col("number_cases").isNotNull() & (F.col("CPH") <= most))


def rollup_median(days: DataFrame) -> DataFrame:
    """One row per agent over all versions of the key: medians, and the sum of cases.

    An exact median keeps a group's values in one task. A group here has at most one
    value per key version and day, since ``days`` is already aggregated, so its size is
    bounded by the calendar and does not grow with the cases.
    """
    rows = with_agent_key(days, "latest_employee_key").where(F.col("new_employee_key").isNotNull())
    return rows.groupBy("new_employee_key").agg(
        F.median("day_working_hours").alias("day_working_hours"),
        F.median("day_billable_hour").alias("day_billable_hour"),
        F.median("CPH").alias("CPH"),
        F.sum("number_cases").alias("number_cases"),
    )


def rollup_mean(days: DataFrame) -> DataFrame:
    """One row per key version with the means of all four measures (the older form)."""
    rows = days.where(F.col("latest_employee_key").isNotNull())
    return rows.groupBy("latest_employee_key").agg(*[F.avg(m).alias(m) for m in MEASURES])


def agent_rollup(call_chat: DataFrame, productivity: DataFrame, months: Sequence[str] = LEFT_OUT_MONTHS) -> DataFrame:
    """From the two base tables to one row per agent."""
    return rollup_median(plausible_days(agent_days(cases_per_day(call_chat), hours_per_day(productivity, months))))


def agent_rollup_older(call_chat: DataFrame, productivity: DataFrame) -> DataFrame:
    return rollup_mean(plausible_days(agent_days(cases_per_day(call_chat), hours_per_day(productivity))))
