"""The whole job, from base tables to scores per agent and issue, in its two forms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.numbers import number
from ..operators import hypothesis
from ..operators.describe import columns_by_kind
from ..operators.skew import ROWS_PER_TASK, hot_keys, spread_join
from ..session import materialize
from ..sources import by_case
from ..sources.tables import read_table
from . import cases, final_scores, health, productivity, roc, scorecard

# The variables of the model.
CATEGORICAL = [
    "employee_name", "skill_category", "first_queue", "last_queue", "bot_involved_flag",
    "incidentlevel2reason", "sub_line_of_business__c",
]
NUMERIC = [
    "wait_time", "complete_duration", "avg_response_cust", "avg_response_agnt", "agent_handle_time",
    "close_time", "no_of_upfront_sla_breach", "no_of_turns_per_conversation", "no_of_agents",
    "agent_tenure_days", "resolution_days", "customer_tenure_days", "csatscore", "day_working_hours",
    "day_billable_hour", "CPH", "counting", "number_cases",
]
FEATURES_OLDER = ["employee_name", "incidentlevel2reason", "sub_line_of_business__c"] + [
    c for c in NUMERIC if c not in ("customer_tenure_days", "counting", "number_cases")
]
# The attributes of the tests.
COUNTED_ATTRIBUTES = ["no_of_agents", "csatscore"]
MEASURED_ATTRIBUTES = [
    c for c in NUMERIC if c not in (*COUNTED_ATTRIBUTES, "counting", "number_cases")
]


@dataclass
class Tables:
    """The five base tables."""

    call_chat: DataFrame
    employees: DataFrame
    closed_cases: DataFrame
    productivity: DataFrame
    health: DataFrame


def read_tables(spark: SparkSession, call_chat: str, employees: str, closed_cases: str, productivity: str, health: str) -> Tables:
    """The base tables from parquet folders or catalog tables."""
    return Tables(
        read_table(spark, call_chat, schemas.CALL_CHAT),
        read_table(spark, employees, schemas.EMPLOYEES),
        read_table(spark, closed_cases, schemas.CLOSED_CASES),
        read_table(spark, productivity, schemas.PRODUCTIVITY),
        read_table(spark, health, schemas.HEALTH),
    )


def cases_with_health(t: Tables, older: bool = False) -> DataFrame:
    """Case facts with health, two joins by case with the hot cases looked up once.

    Rows are numbered after the filters, so that even equal rows of a hot case are spread and
    the filters still reach the scan.
    """
    hot = hot_keys(cases.wanted_cases(t.call_chat, support_only=not older), [["case_key"]])[0]
    facts = cases.case_facts(
        t.call_chat, t.employees, t.closed_cases, support_only=not older, queues=not older, hot=hot, number="_row"
    )
    if older:
        found = health.with_health(facts, t.health, ["chs"], dedup=False, hot=hot)
    else:
        found = health.with_health(facts, t.health, hot=hot)
    return found.drop("_row")


def store_by_case(t: Tables, prefix: str, path: str, buckets: int, rows_per_task: int = ROWS_PER_TASK) -> by_case.CaseTables:
    """The tables that are joined by case, stored so that this moves no rows, with the columns that are needed."""
    columns = ["latest_employee_key", *cases.CASE_COLUMNS, *cases.QUEUE_COLUMNS]
    wanted = cases.wanted_cases(t.call_chat).select(*columns)
    closed = t.closed_cases.select(F.col("transaction_no").alias("case_key"), *cases.CLOSING_COLUMNS)
    return by_case.write(wanted, closed, t.health, prefix, path, buckets, rows_per_task)


def cases_with_health_by_case(spark: SparkSession, stored: by_case.CaseTables, employees: DataFrame) -> DataFrame:
    """What ``cases_with_health`` gives, from tables stored by case.

    The joins by case come first, while rows lie by case; employees follow. Hot cases are joined on their own.
    """
    facts = stored.table(spark, "cases").join(stored.table(spark, "closed"), "case_key")
    rows = health.with_health(facts, stored.table(spark, "health"))
    if stored.hot is not None:
        numbered = stored.hot_table(spark, "cases").withColumn("_row", F.monotonically_increasing_id())
        facts = spread_join(numbered, stored.hot_table(spark, "closed"), ["case_key"], hot=stored.hot)
        apart = health.with_health(facts, stored.hot_table(spark, "health"), hot=stored.hot)
        rows = rows.unionByName(apart.drop("_row"))
    staff = employees.select(*cases.EMPLOYEE_COLUMNS)
    found = rows.join(staff, F.col("latest_employee_key") == F.col("employee_key")).drop("latest_employee_key")
    return found.select(*cases.EMPLOYEE_COLUMNS, *(c for c in found.columns if c not in cases.EMPLOYEE_COLUMNS))


def all_cases(t: Tables) -> DataFrame:
    """Newer form: cases with health, issue counts, agent figures and band."""
    return with_figures(cases_with_health(t), t)


def with_figures(found: DataFrame, t: Tables) -> DataFrame:
    """Cases with health get issue counts, agent figures and band.

    The joined facts are written once, since four later passes read them, and numbered, so
    that equal rows of a busy agent can be spread.
    """
    facts = cases.with_agent_key(found).withColumn("_row", F.monotonically_increasing_id())
    base = materialize(facts, "cases")
    agents = productivity.agent_rollup(t.call_chat, t.productivity)
    issues, busy = hot_keys(base, [["employee_name", "incidentlevel2reason"], ["new_employee_key"]])
    rows = health.with_agent_figures(health.with_issue_counts(base, hot=issues), agents, hot=busy)
    return health.with_band(rows).withColumn("csatscore", number("csatscore")).drop("_row")


def all_cases_older(t: Tables) -> DataFrame:
    """Older form: no support filter, health label -1/1, mean agent figures."""
    facts = cases_with_health(t, older=True).withColumn("_row", F.monotonically_increasing_id())
    base = materialize(facts, "cases-older")
    agents = productivity.agent_rollup_older(t.call_chat, t.productivity).select(
        F.col("latest_employee_key").alias("employee_key"), "day_working_hours", "day_billable_hour", "CPH"
    )
    rows = health.with_agent_figures(base, agents, "employee_key").drop("_row")
    return health.with_label(rows).withColumn("csatscore", number("csatscore"))


@dataclass
class Result:
    model: scorecard.Scorecard
    scored: DataFrame
    final: DataFrame
    curve: DataFrame


def _run(rows: DataFrame, numeric: list[str], categorical: list[str], label: str, iterations: int) -> Result:
    features = [*numeric, *categorical]
    frame = materialize(rows.select("case_key", *features, label), "model-frame")
    model = scorecard.fit(frame, numeric, categorical, label, iterations=iterations, where=~scorecard.is_test("case_key"))
    # All rows get a score, those of the training part too; the curve uses the test part.
    scored = model.score(model.coded)
    return Result(
        model=model,
        scored=scored,
        final=final_scores.final_score(scored, label=label),
        curve=roc.curve(scored.where(scorecard.is_test("case_key")), "score", label),
    )


def run(rows: DataFrame, label: str = "pred_score") -> Result:
    """Newer form, on the rows of ``all_cases`` outside the middle band."""
    return _run(health.without_middle(rows), NUMERIC, CATEGORICAL, label, scorecard.MOST_ITERATIONS)


def run_older(rows: DataFrame) -> Result:
    """Older form; what is a category and what a number follows from the columns' types."""
    categorical, numeric = columns_by_kind(rows.select(*FEATURES_OLDER))
    return _run(rows, numeric, categorical, "chs", 1000)


def tests(rows: DataFrame) -> DataFrame:
    """Which attributes differ between good and bad conversations; the middle band takes part."""
    rows = materialize(rows.select("pred_score", *MEASURED_ATTRIBUTES, *COUNTED_ATTRIBUTES), "attributes")
    return hypothesis.report(rows, "pred_score", MEASURED_ATTRIBUTES, COUNTED_ATTRIBUTES)
