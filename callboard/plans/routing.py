"""Which available agent should take a case?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import spread_join
from ..sources.snapshots import hour_of_path

# Fixed value: the answer when no agent fits.
NOT_FOUND = "Not Found"


def only_available(scorecard: DataFrame, available: DataFrame) -> DataFrame:
    return scorecard.join(available.select("ldap"), "ldap", "left_semi")


def best_agents(scorecard: DataFrame, available: DataFrame) -> DataFrame:
    """(issue_code, ldap): the best-scoring available agent of every issue; the lower login on a tie.

    An aggregate with map-side reduction instead of a ranking window, so an issue with
    very many agents is not sorted in one task. As the login is text, Spark sorts each task's
    rows by issue to do so; ``min_by`` would too.
    """
    first = F.min(F.struct(F.col("score").isNull(), -F.col("score"), F.col("ldap"))).alias("first")
    return (
        only_available(scorecard, available).groupBy("issue_code").agg(first).select("issue_code", "first.ldap")
    )


def route(requests: DataFrame, scorecard: DataFrame, available: DataFrame) -> DataFrame:
    """(issue_code, ldap) with one row per requested issue, ``Not Found`` where nobody fits."""
    wanted = requests.select("issue_code").distinct()
    return wanted.join(best_agents(scorecard, available), "issue_code", "left").select(
        "issue_code", F.coalesce("ldap", F.lit(NOT_FOUND)).alias("ldap")
    )


def route_one(issue: str, scorecard: DataFrame, available: DataFrame) -> DataFrame:
    """One row with the agent for one issue."""
    best = only_available(scorecard.where(F.col("issue_code") == issue), available)
    best = best.orderBy(F.desc_nulls_last("score"), F.asc("ldap")).limit(1)
    return best.agg(F.coalesce(F.max("ldap"), F.lit(NOT_FOUND)).alias("ldap"))


def files_by_hour(snapshots: DataFrame, hours_back: int = 0) -> DataFrame:
    """(hour, files): the files that a request of an hour may be answered with, by when they were written.

    They are those of the hour's folder and of ``hours_back`` folders before it; a file that is not well-formed
    as a whole counts as one that has nobody. An hour has a bounded number of files.
    """
    whole = F.bool_and(F.col("s").isNotNull()).alias("whole")
    files = snapshots.groupBy("file_path", "file_time").agg(whole)
    folder = F.to_timestamp(hour_of_path(F.col("file_path")), "yyyy/MM/dd/HH")
    hour = F.explode(F.sequence(F.lit(0), F.lit(hours_back)))
    rows = files.select("file_path", "file_time", "whole", folder.alias("folder"), hour.alias("later"))
    rows = rows.withColumn("hour", F.date_format(F.expr("folder + make_interval(0, 0, 0, 0, later, 0, 0)"), "yyyy/MM/dd/HH"))
    one = F.struct("file_time", "file_path", "whole")
    return rows.groupBy("hour").agg(F.sort_array(F.collect_list(one)).alias("files"))


def route_as_of(
    requests: DataFrame, scorecard: DataFrame, snapshots: DataFrame, at: str = "at", hours_back: int = 0
) -> DataFrame:
    """``requests`` with ``ldap``: the best agent available by the newest file there was at the time of the request.

    ``requests`` has ``issue_code`` and a time; ``snapshots`` is what ``sources.snapshots.agents`` gives, of
    whichever folders are asked about. A request finds its file in its hour's short list, so nothing is put in
    order over all requests or all files. Agents are then ranked once for each issue and file that are asked for
    together, however many requests do. Hours and issues with very many requests are spread over tasks.
    """
    if "ldap" in requests.columns:
        requests = requests.drop("ldap")
    hour = F.date_format(F.col(at).cast("timestamp"), "yyyy/MM/dd/HH")
    asked = requests.withColumn("hour_", hour)
    lists = files_by_hour(snapshots, hours_back).withColumnsRenamed({"hour": "hour_", "files": "files_"})
    then = F.filter("files_", lambda f: f["file_time"] <= F.col(at).cast("timestamp"))
    file = F.element_at(then, -1)
    known = spread_join(asked, lists, ["hour_"], "left").withColumn("file_", F.when(F.size(then) > 0, file))
    known = known.withColumn("file_", F.when(F.col("file_.whole"), F.col("file_.file_path"))).drop("files_", "hour_")

    pairs = known.where(F.col("file_").isNotNull()).select("issue_code", "file_").distinct()
    here = snapshots.where(F.col("available") & F.col("ldap").isNotNull())
    here = here.select(F.col("file_path").alias("file_"), "ldap").distinct()
    ranked = F.min(F.struct(F.col("score").isNull(), -F.col("score"), F.col("ldap"))).alias("first")
    best = scorecard.join(pairs, "issue_code").join(here, ["file_", "ldap"], "left_semi")
    best = best.groupBy("issue_code", "file_").agg(ranked).select("issue_code", "file_", "first.ldap")
    found = spread_join(known, best, ["issue_code", "file_"], "left").drop("file_")
    return found.withColumn("ldap", F.coalesce("ldap", F.lit(NOT_FOUND))).select(*requests.columns, "ldap")
