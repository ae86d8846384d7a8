"""One function per query: (spark, folder of the tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callboard.functions import snapshots as snapshot_text
from callboard.functions.numbers import number, recode
from callboard.functions.text import without_version
from callboard.operators import describe, hypothesis, period_states
from callboard.operators.upsert import upsert
from callboard.plans import binning, cases, final_scores, health, performance, productivity, roc, routing, scorecard
from callboard.session import materialize, new_folder
from callboard.sources import scorecards, snapshots, tables, versions
from callboard.streaming import availability, expiring

from . import standins as s

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Numeric attributes of a line item, its order and its part, used as variables and attributes.
NUMERIC = ["wait_time", "complete_duration", "avg_response_cust", "no_of_agents", "resolution_days"]
CATEGORICAL = ["skill_category", "employee_name", "last_queue"]
# Means of whole seconds in hours often end in a 5 within eight digits; at nine few are halfway between two.
HOUR_DIGITS = 9
EXPIRY_HOURS = 2
# Buckets of case tables, and rows from which a case of the test tables is kept apart.
BUCKETS, HOT_CASE_ROWS = 8, 2
RARE_CATEGORICAL, RARE_SHARE = ["skill_category", "employee_name"], 0.012


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Sums of doubles depend on their order in the last digits."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Productivity


@query
def agent_day_productivity(spark, sf):
    days = productivity.agent_days(
        productivity.cases_per_day(s.call_chat(spark, sf)), productivity.hours_per_day(s.productivity(spark, sf))
    )
    return rounded(days, "day_working_hours", "day_billable_hour", "CPH", digits=HOUR_DIGITS)


@query
def agent_rollup_median(spark, sf):
    return rounded(productivity.agent_rollup(s.call_chat(spark, sf), s.productivity(spark, sf)), *productivity.MEASURES, digits=HOUR_DIGITS)


@query
def agent_rollup_mean(spark, sf):
    older = productivity.agent_rollup_older(s.call_chat(spark, sf), s.productivity(spark, sf))
    return rounded(older, *productivity.MEASURES, digits=HOUR_DIGITS)


@query
def exclude_months(spark, sf):
    patterns = ["%2024-01-0%", "%2024-01-2%"]
    return cases.excluding(s.productivity(spark, sf), "cal_date", patterns)


# Cases


def _facts(spark, sf):
    return cases.case_facts(s.call_chat(spark, sf), s.employees(spark, sf), s.closed_cases(spark, sf))


def _with_health(spark, sf):
    return performance.cases_with_health(s.base_tables(spark, sf))


@query
def case_facts(spark, sf):
    return _facts(spark, sf)


@query
def case_facts_older(spark, sf):
    return cases.case_facts(
        s.call_chat(spark, sf), s.employees(spark, sf), s.closed_cases(spark, sf), support_only=False, queues=False
    )


@query
def key_strip_version(spark, sf):
    keys = s.call_chat(spark, sf).groupBy("latest_employee_key").agg(F.count("*").alias("n"))
    return keys.withColumn("new_employee_key", without_version("latest_employee_key"))


@query
def dedup_then_join(spark, sf):
    return _with_health(spark, sf).groupBy("case_key", "pred_score", "model_prob").agg(F.count("*").alias("n"))


@query
def issue_case_count(spark, sf):
    return describe.count_by(_facts(spark, sf), ["employee_name", "incidentlevel2reason"], "case_key", "counting")


@query
def issue_case_count_joined(spark, sf):
    counted = health.with_issue_counts(materialize(_facts(spark, sf), "facts"))
    return counted.select("case_key", "employee_name", "incidentlevel2reason", "wait_time", "counting")


@query
def model_frame(spark, sf):
    return _model_frame(performance.all_cases(s.base_tables(spark, sf)))


@query
def model_frame_stored_by_case(spark, sf):
    """The same from tables stored by case; cases with more than two rows count as hot."""
    t, path = s.base_tables(spark, sf), new_folder(spark, "by-case")
    stored = performance.store_by_case(t, f"by_case_{path[-32:]}", path, BUCKETS, rows_per_task=HOT_CASE_ROWS)
    found = performance.cases_with_health_by_case(spark, stored, t.employees)
    return _model_frame(performance.with_figures(found, t))


def _model_frame(rows):
    rows = rows.select(
        "case_key", "new_employee_key", "pred_score", "model_prob", "sign", "counting", "number_cases",
        "day_working_hours", "day_billable_hour", "CPH", "csatscore", "wait_time",
    )
    return rounded(rows, "day_working_hours", "day_billable_hour", "CPH", digits=HOUR_DIGITS)


@query
def model_frame_older(spark, sf):
    rows = performance.all_cases_older(s.base_tables(spark, sf)).select(
        "case_key", "employee_key", "chs", "day_working_hours", "day_billable_hour", "CPH", "csatscore", "wait_time"
    )
    return rounded(rows, "day_working_hours", "day_billable_hour", "CPH", digits=HOUR_DIGITS)


# Labels and descriptive tables


@query
def score_band_filter(spark, sf):
    rows = s.health(spark, sf).dropDuplicates()
    return describe.frequencies(health.without_middle(health.with_band(rows)), "pred_score")


@query
def band_frequencies(spark, sf):
    return describe.frequencies(health.with_band(s.health(spark, sf)), "sign")


@query
def label_recode(spark, sf):
    rows = s.table(spark, sf, "labels").withColumn("chs", F.col("quality") - F.col("toxic"))
    return rows.select("doc_id", "chs", recode("chs", health.LABEL_CODES).alias("label"))


@query
def survey_scores_cast(spark, sf):
    rows = s.call_chat(spark, sf)
    return rows.groupBy("agentsatisfactionscore").agg(
        F.count(number("agentsatisfactionscore")).alias("n"), F.sum(number("agentsatisfactionscore")).alias("total")
    )


@query
def attribute_means_by_label(spark, sf):
    rows = _with_health(spark, sf)
    attributes = ["wait_time", "complete_duration", "avg_response_cust", "no_of_agents", "resolution_days"]
    return rounded(describe.means_by_label(rows, "pred_score", attributes), *attributes)


@query
def case_frame_shape(spark, sf):
    return describe.shape(_with_health(spark, sf))


@query
def first_cases(spark, sf):
    keys = ["case_key", "wait_time", "complete_duration", "employee_key"]
    return describe.first_rows(_with_health(spark, sf).select(*keys), keys)


@query
def label_crosstab(spark, sf):
    return describe.crosstab(materialize(_with_health(spark, sf).select("pred_score", "no_of_agents"), "crosstab"), "pred_score", "no_of_agents")


@query
def label_crosstab_cells(spark, sf):
    return describe.cells(_with_health(spark, sf), "pred_score", "skill_category")


@query
def histogram_50(spark, sf):
    rows = _with_health(spark, sf)
    populations = {
        "all": F.lit(True),
        "bad": F.col("pred_score") == 0,
        "no_csat": F.col("csatscore").isNull(),
    }
    return rounded(describe.histograms(rows, "model_prob", populations), "lower", "upper")


# Tests


@query
def t_test(spark, sf):
    rows = _with_health(spark, sf).withColumn("csatscore", number("csatscore"))
    result = hypothesis.t_test(rows, "pred_score", [*NUMERIC, "csatscore"])
    return rounded(result, "statistic", "p_value")


@query
def chi_square(spark, sf):
    return rounded(hypothesis.chi_square(_with_health(spark, sf), "pred_score", ["skill_category"]), "statistic", "p_value")


@query
def chi_square_corrected(spark, sf):
    result = hypothesis.chi_square(_with_health(spark, sf), "pred_score", ["bot_involved_flag"])
    return rounded(result, "statistic", "p_value")


@query
def expected_cells(spark, sf):
    return rounded(hypothesis.expected_cells(_with_health(spark, sf), "pred_score", ["skill_category"]), "expected")


@query
def ab_report(spark, sf):
    report = performance.tests(performance.all_cases(s.base_tables(spark, sf)))
    return rounded(report, "statistic", "p_value")


@query
def ab_report_merged(spark, sf):
    """The same report, merged from the stored states of the quarters."""
    path = new_folder(spark, "test-states")
    measured, counted = performance.MEASURED_ATTRIBUTES, performance.COUNTED_ATTRIBUTES
    rows = performance.all_cases(s.base_tables(spark, sf)).select("fiscal_qtr", "pred_score", *measured, *counted)
    period_states.save(materialize(rows, "attributes"), path, "pred_score", measured, counted, "fiscal_qtr")
    return rounded(period_states.report(spark, path, measured, counted), "statistic", "p_value")


# Scorecard


@query
def hash_split(spark, sf):
    rows = s.call_chat(spark, sf).select("case_key", scorecard.is_test("case_key").alias("test"))
    return rows.groupBy("case_key", "test").agg(F.count("*").alias("n"))


def _labelled(spark, sf):
    return materialize(_with_health(spark, sf).select("case_key", "pred_score", *NUMERIC, *CATEGORICAL), "labelled")


def _evidence(found: binning.Binning) -> DataFrame:
    rows = binning.evidence(found.table)
    rows = rows.withColumns({c: F.when(F.abs(c) < float("inf"), F.col(c)) for c in ("lower", "upper")})
    return rounded(rows, "lower", "upper", "share", "event_rate", "woe", "iv", "js")


@query
def woe_iv_prebins(spark, sf):
    found = binning.fit_binning(_labelled(spark, sf), NUMERIC, [], "pred_score", smallest=0.0, trend=None)
    return _evidence(found)


@query
def woe_iv_numeric(spark, sf):
    return _evidence(binning.fit_binning(_labelled(spark, sf), NUMERIC, [], "pred_score"))


@query
def woe_iv_categorical(spark, sf):
    return _evidence(binning.fit_binning(_labelled(spark, sf), [], CATEGORICAL, "pred_score"))


@query
def woe_iv_categorical_crossfit(spark, sf):
    """Categories take their event rates from the other folds of the cases."""
    found = binning.fit_binning(_labelled(spark, sf), [], CATEGORICAL, "pred_score", folds=5, key="case_key")
    return _evidence(found)


@query
def category_rates_crossfit(spark, sf):
    """What a row of each category and fold is fitted with, and what one is scored with (no fold)."""
    counted = binning.category_counts(
        _labelled(spark, sf), CATEGORICAL, "pred_score", binning.fold_of("case_key", 5).alias("fold")
    )
    fitting, scoring, _ = binning.cross_fitted(materialize(counted, "category-folds"))
    rows = fitting.unionByName(scoring.withColumn("fold", F.lit(None).cast("int")))
    return rounded(rows, "rate", digits=9)


@query
def woe_iv_optimal(spark, sf):
    return _evidence(binning.fit_binning(_labelled(spark, sf), NUMERIC, CATEGORICAL, "pred_score", method="optimal"))


@query
def woe_iv_optimal_turning(spark, sf):
    """Event rates may turn once."""
    return _evidence(binning.fit_binning(_labelled(spark, sf), NUMERIC, [], "pred_score", method="optimal", trend="turning"))


@query
def woe_iv_tree_prebins(spark, sf):
    found = binning.fit_binning(_labelled(spark, sf), NUMERIC, [], "pred_score", prebins="tree", trend=None)
    return _evidence(found)


@query
def woe_iv_tree_optimal(spark, sf):
    found = binning.fit_binning(_labelled(spark, sf), NUMERIC, [], "pred_score", prebins="tree", method="optimal")
    return _evidence(found)


@query
def iv_selection(spark, sf):
    found = binning.fit_binning(_labelled(spark, sf), NUMERIC, CATEGORICAL, "pred_score")
    return rounded(binning.informative(binning.information_values(found.table)), "iv")


def _result(spark, sf) -> performance.Result:
    """The whole job with all its variables."""
    return performance.run(performance.all_cases(s.base_tables(spark, sf)))


def _detailed(table: DataFrame) -> DataFrame:
    table = table.withColumns({c: F.when(F.abs(c) < float("inf"), F.col(c)) for c in ("lower", "upper")})
    table = rounded(table, "lower", "upper", "share", "event_rate", "woe", "iv", "js")
    return rounded(table, "coefficient", "points", digits=4)


@query
def scorecard_table(spark, sf):
    return _detailed(_result(spark, sf).model.table)


@query
def scorecard_scores(spark, sf):
    return rounded(_result(spark, sf).scored.select("case_key", "score"), "score", digits=3)


@query
def scorecard_kept(spark, sf):
    """Scores by a scorecard that was stored and read again."""
    result, path = _result(spark, sf), new_folder(spark, "scorecard-model")
    result.model.write(path)
    again = scorecard.Scorecard.read(spark, path).score(result.scored.drop("score"))
    return rounded(again.select("case_key", "score"), "score", digits=3)


@query
def category_bins(spark, sf):
    return rounded(rounded(_result(spark, sf).model.category_bins(), "woe"), "points", digits=4)


@query
def woe_iv_categorical_rare(spark, sf):
    found = binning.fit_binning(_labelled(spark, sf), [], RARE_CATEGORICAL, "pred_score", rare=RARE_SHARE)
    return _evidence(found)


@query
def roc_curve(spark, sf):
    return rounded(roc.curve(_with_health(spark, sf), "resolution_days", "pred_score"), "tpr", "fpr")


@query
def roc_auc(spark, sf):
    points = materialize(roc.curve(_with_health(spark, sf), "resolution_days", "pred_score"), "curve")
    return rounded(roc.area(points), "auc")


@query
def ks(spark, sf):
    points = roc.curve(s.labelled_documents(spark, sf), "n_chars", "quality")
    return rounded(roc.distance(points), "ks")


# Final scores


def _scored(spark, sf):
    """Stand-in score, so that the table can be checked without a fit."""
    return _with_health(spark, sf).withColumn("score", F.col("avg_response_agnt") / 10 + F.col("wait_time") / 50)


@query
def final_score(spark, sf):
    return rounded(final_scores.final_score(_scored(spark, sf)), "score")


@query
def final_score_pivot(spark, sf):
    pivot = final_scores.pivoted(materialize(final_scores.final_score(_scored(spark, sf)), "final-scores"))
    return rounded(pivot, *pivot.columns[2:])


@query
def exported_pivot(spark, sf):
    path = new_folder(spark, "pivot-csv")
    pivot = final_score_pivot(spark, sf)
    tables.write_csv(pivot, path)
    return spark.read.schema(pivot.schema).option("header", True).csv(path)


@query
def exported_model_table(spark, sf):
    path = new_folder(spark, "model-csv")
    table = _detailed(_result(spark, sf).model.table)
    tables.write_csv(table, path)
    return spark.read.schema(table.schema).option("header", True).csv(path)


@query
def exported_scores(spark, sf):
    path = new_folder(spark, "scores-csv")
    scores = rounded(final_scores.final_score(_scored(spark, sf)), "score")
    tables.write_csv(scores, path)
    return spark.read.schema(scores.schema).option("header", True).csv(path)


@query
def agent_performance(spark, sf):
    return rounded(_result(spark, sf).final, "score", digits=3)


@query
def agent_performance_older(spark, sf):
    final = performance.run_older(performance.all_cases_older(s.base_tables(spark, sf))).final
    return rounded(final, "score", digits=3)


# Snapshots


@query
def json_repair_explode(spark, sf):
    first = s.snapshot_json("event_id", "ldap", "routable", "slots")
    second = s.snapshot_json("event_id + 1", "concat(ldap, '}{x')", "NOT routable", "1")
    strung = s.event_snapshots(spark, sf).selectExpr("event_id", f"concat({first}, {second}) AS text")
    rows = strung.select("event_id", F.posexplode(snapshot_text.parsed("text")).alias("position", "s"))
    return rows.select(
        "event_id",
        "position",
        F.col("s.AWSAccountId").alias("account"),
        snapshot_text.user("s").alias("ldap"),
        snapshot_text.can_take_a_case("s").alias("available"),
    )


def _written_snapshots(spark, sf):
    root = new_folder(spark, "snapshots")
    s.write_snapshots(spark, sf, root)
    return root


@query
def snapshot_pieces(spark, sf):
    root = _written_snapshots(spark, sf)
    rows = snapshots.agents(snapshots.read_pieces(spark, f"{root}/{snapshots.PREFIX}"))
    return rows.select(snapshots.hour_of_path(F.col("file_path")).alias("hour"), "ldap", "available")


@query
def latest_file_available(spark, sf):
    root = _written_snapshots(spark, sf)
    last = s.table(spark, sf, "events").agg(F.max("ts")).first()[0]
    return snapshots.available_now(spark, root, last)


@query
def availability_stream(spark, sf):
    root = _written_snapshots(spark, sf)
    state = new_folder(spark, "availability")
    stream = availability.arriving(spark, f"{root}/{snapshots.PREFIX}", files_per_trigger=400)
    availability.keep_up(stream, state, new_folder(spark, "availability-progress")).awaitTermination()
    return availability.read_state(spark, state).select("ldap", "hour", "available")


@query
def availability_expiring(spark, sf):
    """Every change of availability; an agent not heard of for two hours is no longer available."""
    root, log = _written_snapshots(spark, sf), new_folder(spark, "availability-log")
    stream = availability.arriving(spark, f"{root}/{snapshots.PREFIX}", files_per_trigger=400)
    changed = expiring.changes(stream, hours=EXPIRY_HOURS)
    expiring.keep_log(changed, log, new_folder(spark, "availability-log-progress")).awaitTermination()
    rows = spark.read.schema(expiring.CHANGE_SCHEMA).parquet(log)
    return rows.withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm"))


@query
def availability_by_hour(spark, sf):
    """The state brought up to date ten times over the events' time, by hour folders."""
    root, state = _written_snapshots(spark, sf), new_folder(spark, "availability-by-hour")
    first, last = s.table(spark, sf, "events").agg(F.min("ts"), F.max("ts")).first()
    first, last = (t.replace(tzinfo=timezone.utc) for t in (first, last))
    for i in range(1, 11):
        availability.advance(spark, root, state, first + (last - first) * i / 10, since=first)
    return availability.read_state(spark, state).select("ldap", "hour", "available")


# Routing


@query
def routed_as_of(spark, sf):
    """Every event is a request at its time, about the type of some part, answered from two hours' files."""
    root = _written_snapshots(spark, sf)
    seen = snapshots.agents(snapshots.read_pieces(spark, f"{root}/{snapshots.PREFIX}"))
    seen = materialize(seen, "snapshots")
    return routing.route_as_of(s.requests(spark, sf), s.agents_scorecard(spark, sf), seen, hours_back=1).drop("at")


@query
def best_available_agent(spark, sf):
    parts = s.table(spark, sf, "part").select(F.col("p_type").alias("issue_code"))
    requests = parts.unionByName(s.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("issue_code")))
    return routing.route(requests, s.routing_scorecard(spark, sf), s.available_suppliers(spark, sf))


@query
def best_agent_for_one_issue(spark, sf):
    return routing.route_one("PROMO", s.routing_scorecard(spark, sf), s.available_suppliers(spark, sf))


@query
def agents_for_issue(spark, sf):
    path = new_folder(spark, "scorecard")
    scorecards.write(s.routing_scorecard(spark, sf), path)
    return scorecards.for_issue(scorecards.read(spark, path), "SMALL")


def _writes(spark, sf):
    """Many writes per agent and issue; the last by ship date and order counts."""
    return s.line_parts(spark, sf).selectExpr(
        "p_brand AS issue_code", "s_name AS ldap", "l_extendedprice AS score", "l_shipdate", "l_orderkey"
    )


def _suppliers_scorecard(spark, sf):
    """Suppliers have a row for some brand and one that nobody writes to."""
    return s.table(spark, sf, "supplier").selectExpr(
        "explode(array(concat('Brand#', s_suppkey % 30), 'none')) AS issue_code", "s_name AS ldap", "s_acctbal AS score"
    )


@query
def scorecard_upsert(spark, sf):
    """Every line item writes."""
    current = _suppliers_scorecard(spark, sf)
    return upsert(current, _writes(spark, sf), ["issue_code", "ldap"], ["l_shipdate", "l_orderkey"])


@query
def scorecard_upsert_stream(spark, sf):
    """The same writes as a stream of files, a year of ship dates each, into a scorecard kept in versions."""
    path, feed = new_folder(spark, "scorecard-versions"), new_folder(spark, "scorecard-feed")
    versions.save(spark, path, _suppliers_scorecard(spark, sf), [])
    s.write_by_year(_writes(spark, sf), "l_shipdate", feed)
    changes = spark.readStream.schema(s.WRITES).option("maxFilesPerTrigger", 1).parquet(feed)
    order = ["l_shipdate", "l_orderkey"]
    versions.keep_up(changes, path, new_folder(spark, "scorecard-progress"), order, "feed").awaitTermination()
    return versions.read(spark, path)


@query
def scorecard_save(spark, sf):
    path = new_folder(spark, "scorecard")
    scorecards.write(s.routing_scorecard(spark, sf), path)
    changes = s.available_suppliers(spark, sf).select(F.lit("PROMO").alias("issue_code"), "ldap", F.lit(1.5).alias("score"))
    scorecards.save(spark, path, changes, [])
    return scorecards.read(spark, path)


@query
def agents_as_json(spark, sf):
    rows = s.routing_scorecard(spark, sf).select("issue_code", "ldap", F.format_number("score", 6).alias("score"))
    return tables.as_json(rows)
