"""The case frame: one row per supported, closed case with employee and closing facts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import like_none, without_version
from ..operators.skew import spread_join

# Which cases count.
LANGUAGE_KEY = "13"
DATA_SOURCE = "LE"
SUPPORT_FLAG = "Support"

EMPLOYEE_COLUMNS = ["employee_key", "employee_name", "sub_line_of_business__c"]
CASE_COLUMNS = [
    "case_key", "incidentlevel2reason", "wait_time", "complete_duration", "avg_response_cust",
    "avg_response_agnt", "agent_handle_time", "close_time", "no_of_upfront_sla_breach",
    "no_of_turns_per_conversation", "no_of_agents", "agent_tenure_days", "csatscore", "cesscore",
    "agentsatisfactionscore", "fcrscore", "fiscal_qtr",
]
QUEUE_COLUMNS = ["agent_path", "skill_category", "first_queue", "last_queue", "workday_id", "bot_involved_flag"]
CLOSING_COLUMNS = ["resolution_days", "customer_tenure_days"]


def wanted_cases(call_chat: DataFrame, support_only: bool = True) -> DataFrame:
    """Cases in the wanted language and source, in the newer form only supported ones."""
    wanted = (F.col("language_key") == LANGUAGE_KEY) & (F.col("data_source") == DATA_SOURCE)
    return call_chat.where(wanted & (F.col("sales_support_flag") == SUPPORT_FLAG) if support_only else wanted)


def case_facts(
    call_chat: DataFrame,
    employees: DataFrame,
    closed_cases: DataFrame,
    support_only: bool = True,
    queues: bool = True,
    hot: Mapping[int, int] = {},
    number: str | None = None,
) -> DataFrame:
    """Cases with their employee and closing facts; both joins are inner.

    ``support_only`` and ``queues`` off give the older form, with 22 columns and all
    cases. The filters are on the scan side, columns not named here are not read. No
    side is forced to be broadcast: Spark does so where a side is small by its size on
    disk, and otherwise sorts both and splits a hot employee or case at run time. Name the
    ``hot`` cases where another join by case follows, because Spark does not split then.
    ``number`` names a column that numbers the wanted rows, so that even equal rows can be
    told apart; a scan numbers its rows the same way when it is run again.
    """
    columns = [*CASE_COLUMNS, *(QUEUE_COLUMNS if queues else [])]
    cases = wanted_cases(call_chat, support_only).select("latest_employee_key", *columns)
    if number:
        cases, columns = cases.withColumn(number, F.monotonically_increasing_id()), [*columns, number]
    closed = closed_cases.select(F.col("transaction_no").alias("case_key"), *CLOSING_COLUMNS)
    staffed = cases.join(
        employees.select(*EMPLOYEE_COLUMNS), F.col("latest_employee_key") == F.col("employee_key")
    )
    return spread_join(staffed, closed, ["case_key"], hot=hot).select(*EMPLOYEE_COLUMNS, *columns, *CLOSING_COLUMNS)


def with_agent_key(df: DataFrame, key: str = "employee_key") -> DataFrame:
    """Add ``new_employee_key``, which is the same for all versions of an agent's key."""
    return df.withColumn("new_employee_key", without_version(key))


def excluding(df: DataFrame, column: str, patterns: Sequence[str]) -> DataFrame:
    """Rows whose text matches none of the patterns; a missing text is dropped too."""
    return df.where(like_none(column, patterns))
