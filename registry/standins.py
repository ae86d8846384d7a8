"""The job's base tables, derived from the test tables by Spark.

Every function reads whole tables; ``registry/oracle.py`` states the same derivations in SQL.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callboard.plans.performance import Tables
from callboard.session import file_system
from callboard.sources.snapshots import PREFIX

# Schemas of the test tables that are used.
SCHEMAS = {
    "supplier": "s_suppkey LONG, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey LONG, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey LONG, o_custkey LONG, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey LONG, l_partkey LONG, l_suppkey LONG, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id LONG, ts TIMESTAMP_NTZ, user_id LONG, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG",
    "labels": "doc_id LONG, quality INT, toxic INT",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def _employee_key(number: str, day: str) -> str:
    return f"concat('E', {number}, '||CRM||', if({day} <= 15, '2024-01-01', '2024-01-16'))"


def call_chat(spark: SparkSession, sf: str) -> DataFrame:
    line, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    day = "(datediff(l_shipdate, DATE'1995-01-01') % 30 + 1)"
    score = "if(p_size % 5 != 0, string(l_linenumber % 5 + 1), NULL)"
    return line.join(part, F.expr("l_partkey = p_partkey")).selectExpr(
        "string(l_orderkey) AS case_key",
        f"{_employee_key('l_suppkey', day)} AS latest_employee_key",
        "if(l_linenumber < 7, concat('V', l_linenumber), NULL) AS vendorid",
        f"concat('2024-01-', lpad({day}, 2, '0'), ' 10:11:12') AS interaction_starttime",
        "if(l_returnflag = 'N', '11', '13') AS language_key",
        "if(l_linestatus = 'F', 'LE', 'SA') AS data_source",
        "if(l_linenumber <= 5, 'Support', 'Sales') AS sales_support_flag",
        "p_type AS incidentlevel2reason",
        "p_brand AS skill_category",
        "concat('Q', p_size % 7) AS first_queue",
        "if(l_tax > 0.01D, concat('Q', p_size % 4), NULL) AS last_queue",
        "p_name AS agent_path",
        "concat('W', l_suppkey) AS workday_id",
        "if(p_size % 2 = 0, 'Y', 'N') AS bot_involved_flag",
        "concat('Q', quarter(l_shipdate)) AS fiscal_qtr",
        "l_quantity * 10 AS wait_time",
        "l_extendedprice / 100 AS complete_duration",
        "if(l_tax > 0, l_tax * 1000, NULL) AS avg_response_cust",
        "l_discount * 1000 AS avg_response_agnt",
        "l_extendedprice / l_quantity AS agent_handle_time",
        "p_retailprice AS close_time",
        "bigint(l_linenumber % 3) AS no_of_upfront_sla_breach",
        "bigint(l_quantity) AS no_of_turns_per_conversation",
        "bigint(l_linenumber % 3 + 1) AS no_of_agents",
        "bigint(p_size * 30) AS agent_tenure_days",
        f"{score} AS csatscore",
        f"{score} AS cesscore",
        f"if(p_size % 9 = 0, 'n/a', {score}) AS agentsatisfactionscore",
        f"{score} AS fcrscore",
    )


def employees(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions of every employee."""
    return table(spark, sf, "supplier").selectExpr("*", "explode(array(1, 16)) AS day").selectExpr(
        f"{_employee_key('s_suppkey', 'day')} AS employee_key",
        "s_name AS employee_name",
        "concat('LOB', s_nationkey) AS sub_line_of_business__c",
    )


def closed_cases(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        "string(o_orderkey) AS transaction_no",
        "o_totalprice / 10000 AS resolution_days",
        "double(datediff(o_orderdate, DATE'1995-01-01')) AS customer_tenure_days",
    )


def productivity(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        f"{_employee_key('user_id', 'dayofmonth(ts)')} AS employee_key",
        # One in ten lies in a month that is left out.
        "concat(if(event_id % 10 = 1, '2022-04', '2024-01'), date_format(ts, '-dd HH:mm:ss')) AS cal_date",
        "floor(value * 150) AS login_time",
        "floor(value * 100) AS billable_hour",
    )


def health(spark: SparkSession, sf: str) -> DataFrame:
    """Some rows twice, some twice with another ``chs``, some without a probability."""
    score = "int((o_orderkey * 7919 + 13) % 100 < 100 * o_totalprice / 500000)"
    return table(spark, sf, "orders").selectExpr(
        "string(o_orderkey) AS case_key",
        f"{score} AS pred_score",
        "if(o_orderkey % 10 != 3, o_totalprice / 500000, NULL) AS model_prob",
        f"""explode(array_compact(array(
              2 * {score} - 1,
              if(o_orderkey % 7 = 0, 2 * {score} - 1, NULL),
              if(o_orderkey % 11 = 0, 1 - 2 * {score}, NULL)))) AS chs""",
    )


def base_tables(spark: SparkSession, sf: str) -> Tables:
    return Tables(
        call_chat(spark, sf), employees(spark, sf), closed_cases(spark, sf), productivity(spark, sf), health(spark, sf)
    )


def labelled_documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").drop("text").join(table(spark, sf, "labels"), "doc_id")


def line_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with their part and supplier."""
    line, part, supplier = (table(spark, sf, n) for n in ("lineitem", "part", "supplier"))
    return line.join(part, F.expr("l_partkey = p_partkey")).join(supplier, F.expr("l_suppkey = s_suppkey"))


def routing_scorecard(spark: SparkSession, sf: str) -> DataFrame:
    """(issue_code, ldap, score) from all line items, parts and suppliers."""
    return (
        line_parts(spark, sf)
        .groupBy(F.col("p_type").alias("issue_code"), F.col("s_name").alias("ldap"))
        .agg(F.round(F.avg("l_discount"), 6).alias("score"))
    )


def agents_scorecard(spark: SparkSession, sf: str) -> DataFrame:
    """(issue_code, ldap, score) of the agents in the snapshots, from all line items and parts."""
    line, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    rows = line.join(part, F.expr("l_partkey = p_partkey"))
    agent = F.expr("concat('agent', l_suppkey % 40)").alias("ldap")
    return rows.groupBy(F.col("p_type").alias("issue_code"), agent).agg(F.round(F.avg("l_discount"), 6).alias("score"))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """(event_id, issue_code, at): every event asks about the type of the part it has the number of; some ask about none."""
    events = table(spark, sf, "events").selectExpr("event_id", "CAST(ts AS TIMESTAMP) AS at")
    part = table(spark, sf, "part").selectExpr("p_partkey", "p_type AS issue_code")
    return events.join(part, F.expr("event_id % 2500 = p_partkey"), "left").select("event_id", "issue_code", "at")


def available_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").where("s_acctbal > 5000").selectExpr("s_name AS ldap")


def snapshot_json(account: str, user: str, routable: str, slots: str) -> str:
    """Expression for one snapshot object as text, its keys in the order of the files."""
    return f"""to_json(named_struct(
      'AWSAccountId', string({account}),
      'CurrentAgentSnapshot', named_struct(
        'AgentStatus', named_struct('Type', if({routable}, 'ROUTABLE', 'OFFLINE')),
        'Configuration', named_struct(
          'Username', {user},
          'RoutingProfile', named_struct('Concurrency', array(named_struct(
            'AvailableSlots', {slots}, 'MaximumSlots', 5)))))))"""


def event_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """(event_id, ts, ldap, routable, slots) from all events."""
    return table(spark, sf, "events").selectExpr(
        "event_id",
        "ts",
        "concat('agent', user_id % 40) AS ldap",
        "event_type IN ('click', 'view') AS routable",
        "int(get_json_object(props, '$.k')) % 3 AS slots",
    )


def write_snapshots(spark: SparkSession, sf: str, root: str) -> None:
    """All events as status files, two an hour, in folders ``connect/AEs/YYYY/MM/DD/HH``.

    The text writer ends each record with a separator of its own; here that is the object's
    closing brace, so nothing stands between two objects. It names folders ``level=value``, so
    the files, one for each half hour, are moved to where the feed would have put them, with the
    end of their half hour as the time they were written.
    """
    rows = event_snapshots(spark, sf).selectExpr(
        "date_format(ts, 'yyyy/MM/dd/HH') AS hour",
        "int(minute(ts) / 30) AS half",
        f"{snapshot_json('event_id', 'ldap', 'routable', 'slots')} AS json",
    )
    folder = f"{root}/written"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = rows.selectExpr("left(json, length(json) - 1) AS value", "replace(hour, '/', '-') AS hour", "half")
    body.repartition(parts, "hour", "half").write.partitionBy("hour", "half").option("lineSep", "}").text(folder)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "hour", "half")
    files, _ = file_system(spark, root)
    path = spark._jvm.org.apache.hadoop.fs.Path
    for row in found.collect():
        hour = datetime.strptime(row["hour"], "%Y-%m-%d-%H").replace(tzinfo=timezone.utc)
        target = path(f"{root}/{PREFIX}/{hour:%Y/%m/%d/%H}/half-{row['half']}.json")
        files.mkdirs(target.getParent())
        files.rename(path(row["path"]), target)
        files.setTimes(target, int(hour.timestamp() + 1800 * (row["half"] + 1)) * 1000, -1)


WRITES = "issue_code STRING, ldap STRING, score DOUBLE, l_shipdate TIMESTAMP_NTZ, l_orderkey LONG"


# Bytes of a stretch of a feed's file that is read on its own, so that several tasks can read one file.
FEED_STRETCH = 16 << 20


def write_by_year(rows: DataFrame, time: str, folder: str) -> None:
    """Rows as parquet files, one for each year of ``time`` (rows without one first), a task and a file for each.

    All are written at once. Files are named in the order of their tasks and get times of writing in that
    order, by which a stream takes them.
    """
    spark = rows.sparkSession
    by_year = rows.withColumn("year", F.year(time))
    years = [r["year"] for r in by_year.select("year").distinct().orderBy(F.asc_nulls_first("year")).collect()]
    place = F.lit(0)
    for i, year in enumerate(years):
        place = F.when(F.col("year") == year, i).otherwise(place) if year is not None else place
    dealt = by_year.repartitionById(max(1, len(years)), place.cast("int")).drop("year")
    dealt.write.option("parquet.block.size", FEED_STRETCH).parquet(folder)
    files, path = file_system(spark, folder)
    found = sorted((s for s in files.listStatus(path) if s.getPath().getName().startswith("part-")), key=lambda s: s.getPath().getName())
    last = max((s.getModificationTime() for s in found), default=0)
    for i, status in enumerate(found):
        files.setTimes(status.getPath(), last + 1000 * i, -1)
