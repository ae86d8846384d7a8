"""SQL for DuckDB: what each query of ``registry/queries.py`` should return.

Written independently of the Spark code: plain windows, sorts and self-joins, which suit
small tables only. Every statement reads the whole tables.
"""

from __future__ import annotations

import re

ORACLE: dict[str, str] = {}

# The stand-ins of registry/standins.py.

_DAY = "(date_diff('day', DATE '1995-01-01', l_shipdate::DATE) % 30 + 1)"
_SCORE = "CASE WHEN p_size % 5 <> 0 THEN (l_linenumber % 5 + 1)::VARCHAR END"
_HEALTHY = "((o_orderkey * 7919 + 13) % 100 < 100 * o_totalprice / 500000)::INT"


def _key(number: str, day: str) -> str:
    return f"'E' || {number} || '||CRM||' || CASE WHEN {day} <= 15 THEN '2024-01-01' ELSE '2024-01-16' END"


BASE = {
    "call_chat": f"""
      SELECT l_orderkey::VARCHAR AS case_key, {_key('l_suppkey', _DAY)} AS latest_employee_key,
        CASE WHEN l_linenumber < 7 THEN 'V' || l_linenumber END AS vendorid,
        '2024-01-' || lpad({_DAY}::VARCHAR, 2, '0') || ' 10:11:12' AS interaction_starttime,
        CASE WHEN l_returnflag = 'N' THEN '11' ELSE '13' END AS language_key,
        CASE WHEN l_linestatus = 'F' THEN 'LE' ELSE 'SA' END AS data_source,
        CASE WHEN l_linenumber <= 5 THEN 'Support' ELSE 'Sales' END AS sales_support_flag,
        p_type AS incidentlevel2reason, p_brand AS skill_category, 'Q' || (p_size % 7) AS first_queue,
        CASE WHEN l_tax > 0.01::DOUBLE THEN 'Q' || (p_size % 4) END AS last_queue,
        p_name AS agent_path, 'W' || l_suppkey AS workday_id,
        CASE WHEN p_size % 2 = 0 THEN 'Y' ELSE 'N' END AS bot_involved_flag,
        'Q' || quarter(l_shipdate) AS fiscal_qtr,
        l_quantity * 10 AS wait_time, l_extendedprice / 100 AS complete_duration,
        CASE WHEN l_tax > 0 THEN l_tax * 1000 END AS avg_response_cust, l_discount * 1000 AS avg_response_agnt,
        l_extendedprice / l_quantity AS agent_handle_time, p_retailprice AS close_time,
        (l_linenumber % 3)::BIGINT AS no_of_upfront_sla_breach, l_quantity::BIGINT AS no_of_turns_per_conversation,
        (l_linenumber % 3 + 1)::BIGINT AS no_of_agents, (p_size * 30)::BIGINT AS agent_tenure_days,
        {_SCORE} AS csatscore, {_SCORE} AS cesscore,
        CASE WHEN p_size % 9 = 0 THEN 'n/a' ELSE {_SCORE} END AS agentsatisfactionscore, {_SCORE} AS fcrscore
      FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "employees": f"""
      SELECT {_key('s_suppkey', 'd')} AS employee_key, s_name AS employee_name,
        'LOB' || s_nationkey AS sub_line_of_business__c
      FROM supplier, (VALUES (1), (16)) AS days(d)""",
    "closed_cases": """
      SELECT o_orderkey::VARCHAR AS transaction_no, o_totalprice / 10000 AS resolution_days,
        date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::DOUBLE AS customer_tenure_days
      FROM orders""",
    "productivity": f"""
      SELECT {_key('user_id', 'day(ts)')} AS employee_key,
        CASE WHEN event_id % 10 = 1 THEN '2022-04' ELSE '2024-01' END || strftime(ts, '-%d %H:%M:%S') AS cal_date,
        floor(value * 150)::BIGINT AS login_time, floor(value * 100)::BIGINT AS billable_hour
      FROM events""",
    "health": f"""
      SELECT o_orderkey::VARCHAR AS case_key, {_HEALTHY} AS pred_score,
        CASE WHEN o_orderkey % 10 <> 3 THEN o_totalprice / 500000 END AS model_prob, 2 * {_HEALTHY} - 1 AS chs
      FROM orders, generate_series(1, CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1 END)
      UNION ALL
      SELECT o_orderkey::VARCHAR, {_HEALTHY}, CASE WHEN o_orderkey % 10 <> 3 THEN o_totalprice / 500000 END,
        1 - 2 * {_HEALTHY}
      FROM orders WHERE o_orderkey % 11 = 0""",
}

_CASE_COLUMNS = """case_key, incidentlevel2reason, wait_time, complete_duration,
  avg_response_cust, avg_response_agnt, agent_handle_time, close_time, no_of_upfront_sla_breach,
  no_of_turns_per_conversation, no_of_agents, agent_tenure_days, csatscore, cesscore, agentsatisfactionscore,
  fcrscore, fiscal_qtr, resolution_days, customer_tenure_days, employee_key, employee_name, sub_line_of_business__c"""

STEPS = BASE | {
    "facts": """
      SELECT * FROM call_chat JOIN employees ON employee_key = latest_employee_key
        JOIN closed_cases ON case_key = transaction_no
      WHERE language_key = '13' AND data_source = 'LE' AND sales_support_flag = 'Support'""",
    "facts_older": """
      SELECT * FROM call_chat JOIN employees ON employee_key = latest_employee_key
        JOIN closed_cases ON case_key = transaction_no
      WHERE language_key = '13' AND data_source = 'LE'""",
    "with_health": """
      SELECT facts.*, h.pred_score, h.model_prob FROM facts JOIN (SELECT DISTINCT * FROM health) h USING (case_key)""",
    "all_days": """
      SELECT coalesce(c.latest_employee_key, h.employee_key) AS latest_employee_key, coalesce(c.day, h.day) AS day,
        number_cases::DOUBLE AS number_cases, day_working_hours, day_billable_hour,
        CASE WHEN day_billable_hour <> 0 THEN number_cases / day_billable_hour END AS "CPH"
      FROM (SELECT latest_employee_key, interaction_starttime[1:10]::DATE AS day, count(vendorid) AS number_cases
            FROM call_chat GROUP BY ALL) c
      RIGHT JOIN (SELECT employee_key, cal_date[1:10]::DATE AS day, sum(login_time)::DOUBLE / 3600 AS day_working_hours,
                    sum(billable_hour)::DOUBLE / 3600 AS day_billable_hour
                  FROM productivity GROUP BY ALL) h
        ON c.latest_employee_key = h.employee_key AND c.day = h.day""",
    "days": "SELECT * FROM all_days WHERE NOT regexp_matches(day::VARCHAR, '2022-0[3456]')",
    "agents": r"""
      SELECT regexp_replace(latest_employee_key, '\|\|[^|]*$', '') AS new_employee_key,
        median(day_working_hours) AS day_working_hours, median(day_billable_hour) AS day_billable_hour,
        median("CPH") AS "CPH", sum(number_cases) AS number_cases
      FROM days WHERE "CPH" <= 10 GROUP BY 1""",
    "agents_older": """
      SELECT latest_employee_key, avg(day_working_hours) AS day_working_hours,
        avg(day_billable_hour) AS day_billable_hour, avg("CPH") AS "CPH", avg(number_cases) AS number_cases
      FROM all_days WHERE "CPH" <= 10 GROUP BY 1""",
    "all_cases": r"""
      SELECT w.* EXCLUDE (csatscore), csatscore::DOUBLE AS csatscore, new_employee_key, counting, day_working_hours,
        day_billable_hour, "CPH", number_cases,
        CASE WHEN model_prob <= 0.35::DOUBLE THEN 0 WHEN model_prob < 0.7::DOUBLE THEN 1
             WHEN model_prob >= 0.7::DOUBLE THEN 2 END AS sign
      FROM with_health w
      JOIN (SELECT employee_name, incidentlevel2reason, count(case_key) AS counting FROM with_health GROUP BY ALL)
        USING (employee_name, incidentlevel2reason)
      JOIN agents ON regexp_replace(w.employee_key, '\|\|[^|]*$', '') = new_employee_key""",
    "all_cases_older": """
      SELECT f.* EXCLUDE (csatscore), csatscore::DOUBLE AS csatscore,
        CASE h.chs WHEN 1 THEN 1 WHEN -1 THEN 0 END AS chs, day_working_hours, day_billable_hour, "CPH"
      FROM facts_older f JOIN health h USING (case_key) JOIN agents_older a ON f.employee_key = a.latest_employee_key""",
    "scored": "SELECT *, avg_response_agnt / 10 + wait_time / 50 AS score FROM with_health",
    "final": """
      SELECT employee_name, sub_line_of_business__c, incidentlevel2reason, round(avg(score), 6) AS score,
        count(pred_score) AS count
      FROM scored GROUP BY ALL""",
    "lines": """
      SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""",
    "routing": """
      SELECT p_type AS issue_code, s_name AS ldap, round(avg(l_discount), 6) AS score FROM lines GROUP BY ALL""",
    "available": "SELECT s_name AS ldap FROM supplier WHERE s_acctbal > 5000",
    "records": """
      SELECT event_id, 'agent' || (user_id % 40) AS ldap, date_trunc('hour', ts) AS h, minute(ts) // 30 AS half,
        event_type IN ('click', 'view') AND (props->>'k')::INT % 3 > 0 AS available
      FROM events""",
    "files": "SELECT ldap, h, half, bool_or(available) AS available FROM records GROUP BY ALL",
}


def sql(query: str, **more: str) -> str:
    """``query`` with the steps it needs in front, in the order they are defined."""
    steps = STEPS | more
    needed: set[str] = set()

    def need(text: str) -> None:
        words = set(text.replace("(", " ").replace(")", " ").replace(",", " ").replace(".", " ").split())
        for name in steps:
            if name in words and name not in needed:
                needed.add(name)
                need(steps[name])

    need(query)
    head = ",\n".join(f"{name} AS MATERIALIZED ({text})" for name, text in steps.items() if name in needed)
    return f"WITH RECURSIVE {head}\n{query}" if head else query


def _rounded(*columns: str, digits: int = 6) -> str:
    return ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in columns)


_MEASURES = ("day_working_hours", "day_billable_hour", "CPH", "number_cases")

ORACLE["agent_day_productivity"] = sql(
    f"SELECT latest_employee_key, day, number_cases, {_rounded(*_MEASURES[:3], digits=9)} FROM all_days"
)
ORACLE["agent_rollup_median"] = sql(f"SELECT new_employee_key, {_rounded(*_MEASURES, digits=9)} FROM agents")
ORACLE["agent_rollup_mean"] = sql(f"SELECT latest_employee_key, {_rounded(*_MEASURES, digits=9)} FROM agents_older")
ORACLE["exclude_months"] = sql(
    "SELECT * FROM productivity WHERE NOT (cal_date LIKE '%2024-01-0%' OR cal_date LIKE '%2024-01-2%')"
)
ORACLE["case_facts"] = sql(
    f"SELECT {_CASE_COLUMNS}, agent_path, skill_category, first_queue, last_queue, workday_id, bot_involved_flag FROM facts"
)
ORACLE["case_facts_older"] = sql(f"SELECT {_CASE_COLUMNS} FROM facts_older")
ORACLE["key_strip_version"] = sql(
    """SELECT latest_employee_key, count(*) AS n,
         split_part(latest_employee_key, '||', 1) || '||' || split_part(latest_employee_key, '||', 2) AS new_employee_key
       FROM call_chat GROUP BY ALL"""
)
ORACLE["dedup_then_join"] = sql("SELECT case_key, pred_score, model_prob, count(*) AS n FROM with_health GROUP BY ALL")
ORACLE["issue_case_count"] = sql(
    "SELECT employee_name, incidentlevel2reason, count(case_key) AS counting FROM facts GROUP BY ALL"
)
ORACLE["issue_case_count_joined"] = sql(
    """SELECT case_key, employee_name, incidentlevel2reason, wait_time,
         count(case_key) OVER (PARTITION BY employee_name, incidentlevel2reason) AS counting FROM facts"""
)
ORACLE["model_frame"] = sql(
    f"""SELECT case_key, new_employee_key, pred_score, model_prob, sign, counting, number_cases,
          {_rounded(*_MEASURES[:3], digits=9)}, csatscore, wait_time FROM all_cases"""
)
ORACLE["model_frame_stored_by_case"] = ORACLE["model_frame"]
ORACLE["model_frame_older"] = sql(
    f"SELECT case_key, employee_key, chs, {_rounded(*_MEASURES[:3], digits=9)}, csatscore, wait_time FROM all_cases_older"
)

# Labels and descriptive tables.

_BAND = """CASE WHEN model_prob <= 0.35::DOUBLE THEN 0 WHEN model_prob < 0.7::DOUBLE THEN 1
             WHEN model_prob >= 0.7::DOUBLE THEN 2 END"""
ORACLE["score_band_filter"] = sql(
    f"""SELECT pred_score, count(*) AS count FROM (SELECT DISTINCT * FROM health)
        WHERE {_BAND} IS DISTINCT FROM 1 GROUP BY ALL"""
)
ORACLE["band_frequencies"] = sql(
    f"SELECT {_BAND} AS sign, count(*) AS count FROM health WHERE model_prob IS NOT NULL GROUP BY ALL"
)
ORACLE["label_recode"] = """SELECT doc_id, quality - toxic AS chs,
  CASE quality - toxic WHEN 1 THEN 1 WHEN -1 THEN 0 END AS label FROM labels"""
ORACLE["survey_scores_cast"] = sql(
    """SELECT agentsatisfactionscore, count(TRY_CAST(agentsatisfactionscore AS DOUBLE)) AS n,
         sum(TRY_CAST(agentsatisfactionscore AS DOUBLE)) AS total FROM call_chat GROUP BY ALL"""
)
NUMERIC = ("wait_time", "complete_duration", "avg_response_cust", "no_of_agents", "resolution_days")
CATEGORICAL = ("skill_category", "employee_name", "last_queue")
ORACLE["attribute_means_by_label"] = sql(
    f"SELECT pred_score, {', '.join(f'round(avg({c}), 6) AS {c}' for c in NUMERIC)} FROM with_health GROUP BY ALL"
)
ORACLE["case_frame_shape"] = sql("SELECT count(*) AS rows, 30 AS columns FROM with_health")
ORACLE["first_cases"] = sql(
    """SELECT case_key, wait_time, complete_duration, employee_key FROM with_health
       ORDER BY case_key, wait_time, complete_duration, employee_key LIMIT 5"""
)
ORACLE["label_crosstab"] = sql(
    """SELECT pred_score, count(*) FILTER (no_of_agents = 1) AS "1", count(*) FILTER (no_of_agents = 2) AS "2",
         count(*) FILTER (no_of_agents = 3) AS "3" FROM with_health GROUP BY ALL"""
)
ORACLE["label_crosstab_cells"] = sql(
    "SELECT pred_score, skill_category, count(*) AS count FROM with_health GROUP BY ALL"
)
ORACLE["histogram_50"] = sql(
    """SELECT population, b::INT AS bin, round(lo + (b - 1) * (hi - lo) / 50, 6) AS lower,
         round(lo + b * (hi - lo) / 50, 6) AS upper,
         (SELECT count(*) FROM members m WHERE m.population = e.population
            AND least(floor(50 * (x - lo) / (hi - lo)) + 1, 50) = b) AS count
       FROM (SELECT population, min(x) AS lo, max(x) AS hi FROM members GROUP BY ALL) e, generate_series(1, 50) AS g(b)""",
    members="""
      SELECT 'all' AS population, model_prob AS x FROM with_health WHERE model_prob IS NOT NULL
      UNION ALL SELECT 'bad', model_prob FROM with_health WHERE model_prob IS NOT NULL AND pred_score = 0
      UNION ALL SELECT 'no_csat', model_prob FROM with_health WHERE model_prob IS NOT NULL AND csatscore IS NULL""",
)

# Tests. The p-values are the densities integrated by Simpson's rule.

_STEPS_OF_INTEGRAL = 4000


def _integral(density: str, upto: str) -> str:
    return f"""(SELECT sum({density} * CASE WHEN i IN (0, {_STEPS_OF_INTEGRAL}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
                  * {upto} / {_STEPS_OF_INTEGRAL} / 3
                FROM (SELECT i, i * {upto} / {_STEPS_OF_INTEGRAL} AS u FROM generate_series(0, {_STEPS_OF_INTEGRAL}) AS g(i)))"""


_T_DENSITY = """exp(lgamma((df + 1) / 2) - lgamma(df / 2) - ln(df * pi()) / 2 - (df + 1) / 2 * ln(1 + u * u / df))"""
_CHI_DENSITY = "2 * pow(u, df - 1) * exp(-u * u / 2 - df / 2 * ln(2) - lgamma(df / 2))"


def _t_results(attributes: tuple[str, ...], source: str) -> str:
    one = """SELECT '{a}' AS attribute, 't' AS test,
        (avg({a}) FILTER (pred_score = 0) - avg({a}) FILTER (pred_score = 1)) / sqrt(
          (var_samp({a}) FILTER (pred_score = 0) * (count({a}) FILTER (pred_score = 0) - 1)
           + var_samp({a}) FILTER (pred_score = 1) * (count({a}) FILTER (pred_score = 1) - 1)) / (count({a}) - 2)
          * (1 / (count({a}) FILTER (pred_score = 0)) + 1 / (count({a}) FILTER (pred_score = 1)))) AS statistic,
        (count({a}) - 2)::DOUBLE AS df
      FROM {source}"""
    return " UNION ALL ".join(one.format(a=a, source=source) for a in attributes)


def _chi_results(attributes: tuple[str, ...], source: str) -> str:
    one = """SELECT '{a}' AS attribute, 'chi_square' AS test,
        sum(pow(CASE WHEN freedom = 1 THEN greatest(abs(o - e) - 0.5, 0) ELSE abs(o - e) END, 2) / e) AS statistic,
        any_value(freedom)::DOUBLE AS df
      FROM (SELECT l.g, v.value, r * c / total AS e,
              (SELECT count(*) FROM {source} s WHERE s.pred_score = l.g AND s.{a} = v.value) AS o,
              (count(DISTINCT l.g) OVER () - 1) * (count(DISTINCT v.value) OVER () - 1) AS freedom
            FROM (SELECT pred_score AS g, count({a}) AS r FROM {source} GROUP BY 1) l,
                 (SELECT {a} AS value, count(*) AS c FROM {source} WHERE {a} IS NOT NULL GROUP BY 1) v,
                 (SELECT count({a})::DOUBLE AS total FROM {source}))"""
    return " UNION ALL ".join(one.format(a=a, source=source) for a in attributes)


def _with_p(results: str) -> str:
    return f"""SELECT attribute, test, round(statistic, 6) AS statistic, df,
        abs(round(greatest(CASE test
          WHEN 't' THEN 1 - 2 * {_integral(_T_DENSITY, 'abs(statistic)')}
          ELSE 1 - {_integral(_CHI_DENSITY, 'sqrt(statistic)')} END, 0), 6)) AS p_value
      FROM ({results})"""


_CSAT = {"csat_health": "SELECT * REPLACE (csatscore::DOUBLE AS csatscore) FROM with_health"}
ORACLE["t_test"] = sql(_with_p(_t_results((*NUMERIC, "csatscore"), "csat_health")), **_CSAT)
ORACLE["chi_square"] = sql(_with_p(_chi_results(("skill_category",), "with_health")))
ORACLE["chi_square_corrected"] = sql(_with_p(_chi_results(("bot_involved_flag",), "with_health")))
ORACLE["expected_cells"] = sql(
    """SELECT 'skill_category' AS attribute, skill_category AS value, g::INT AS label,
         count(*) FILTER (pred_score = g) AS observed,
         round((SELECT count(*) FROM with_health w WHERE w.pred_score = g) * count(*)
               / (SELECT count(*) FROM with_health)::DOUBLE, 6) AS expected
       FROM with_health, (VALUES (0), (1)) AS labels_(g) GROUP BY skill_category, g"""
)
_MEASURED = (
    "wait_time", "complete_duration", "avg_response_cust", "avg_response_agnt", "agent_handle_time", "close_time",
    "no_of_upfront_sla_breach", "no_of_turns_per_conversation", "agent_tenure_days", "resolution_days",
    "customer_tenure_days", "day_working_hours", "day_billable_hour", '"CPH"',
)
ORACLE["ab_report"] = sql(
    _with_p(
        _t_results(_MEASURED, "all_cases").replace("'\"CPH\"'", "'CPH'")
        + " UNION ALL "
        + _chi_results(("no_of_agents", "csatscore"), "all_cases")
    )
)

ORACLE["ab_report_merged"] = ORACLE["ab_report"]

# Scorecard.

_IS_TEST = "(('0x' || substr(md5(case_key), 1, 4))::BIGINT % 5 < 1)"
ORACLE["hash_split"] = sql(f"SELECT case_key, {_IS_TEST} AS test, count(*) AS n FROM call_chat GROUP BY ALL")


def _folded(c: str, source: str, folds: int, shrink: float = 20.0) -> str:
    """(v, x, category, y): the rate of the category in the other folds, mixed with that of all their rows."""
    return f"""
      SELECT '{c}' AS v, CASE WHEN category IS NOT NULL THEN
          (sum(y) OVER cat - sum(y) OVER catf + {shrink}::DOUBLE * ((sum(y) OVER whole - sum(y) OVER wholef)
             / (count(*) OVER whole - count(*) OVER wholef))) / (count(*) OVER cat - count(*) OVER catf + {shrink}::DOUBLE)
        END AS x, category, y, f
      FROM (SELECT {c} AS category, pred_score AS y, {_fold(folds)} AS f FROM {source})
      WINDOW cat AS (PARTITION BY category), catf AS (PARTITION BY category, f),
        whole AS (PARTITION BY category IS NULL), wholef AS (PARTITION BY category IS NULL, f)"""


def _fold(folds: int) -> str:
    return f"(('0x' || substr(md5(case_key), 5, 4))::BIGINT % {folds})"


def optimal_steps(legs: int, smallest: float = 0.05) -> dict[str, str]:
    """Steps from ``known`` to ``joined``: of all ways to join neighbours the one with the greatest information value.

    With one leg the event rate rises or falls, with two it may turn once.
    """
    return {
        "upto": """
          SELECT v, i, lower, n, events, total, sum(n) OVER w AS cn, sum(events) OVER w AS ce, sum(events) OVER (PARTITION BY v) AS te
          FROM known WINDOW w AS (PARTITION BY v ORDER BY i)""",
        "runs": f"""
          SELECT *, ((n - e) / (total - te) - e / te) * ln(((n - e) / (total - te)) / (e / te)) AS iv
          FROM (SELECT a.v, a.i, b.i AS j, (b.cn - a.cn + a.n)::BIGINT AS n, (b.ce - a.ce + a.events)::BIGINT AS e, a.total, a.te
                FROM upto a JOIN upto b ON a.v = b.v AND a.i <= b.i)
          WHERE n >= {smallest}::DOUBLE * total AND e > 0 AND e < n""",
        "ways": f"""
          SELECT v, way, 0 AS leg, j, n, e, iv, [i] AS starts FROM runs, (VALUES (1), (-1)) AS ways_(way) WHERE i = 1
          UNION ALL
          SELECT w.v, w.way, l.leg, r.j, r.n, r.e, w.iv + r.iv, list_append(w.starts, r.i)
          FROM ways w JOIN runs r ON r.v = w.v AND r.i = w.j + 1, range({legs}) AS l(leg)
          WHERE l.leg >= w.leg AND CASE WHEN l.leg = 0 THEN w.way ELSE -w.way END * (r.e * w.n - w.e * r.n) > 0""",
        "best": """
          SELECT v, arg_max(starts, iv) AS starts
          FROM ways JOIN (SELECT v, max(i) AS j FROM known GROUP BY v) USING (v, j) GROUP BY v""",
        "joined": """
          SELECT v, min(lower) AS lower, sum(n)::BIGINT AS n, sum(events)::BIGINT AS events
          FROM (SELECT known.*, len(list_filter(coalesce(starts, [1]), lambda s: s <= i)) AS b FROM known LEFT JOIN best USING (v))
          GROUP BY v, b""",
    }


def tree_steps(depth: int = 4, smallest: float = 0.05) -> dict[str, str]:
    """Steps from the histogram ``known`` to ``leaves``: the leaves of a tree of that depth, as ``known`` has its rows."""
    steps = {
        "places": """
          SELECT v, i, sum(n) OVER w AS cn, sum(events) OVER w AS ce, total
          FROM known WINDOW w AS (PARTITION BY v ORDER BY i)""",
        "tree0": """
          SELECT v, 1 AS lo, max(i) AS hi, 0 AS n0, 0 AS e0, max(cn)::BIGINT AS n, max(ce)::BIGINT AS e FROM places GROUP BY v""",
    }
    for d in range(depth):
        steps[f"falls{d}"] = f"""
          SELECT v, lo, arg_max((k, ln_, le), (fall, -k)) AS cut FROM (
            SELECT *, e * (n - e) / n - (le * (ln_ - le) / ln_ + (e - le) * (n - ln_ - (e - le)) / (n - ln_)) AS fall
            FROM (SELECT t.*, p.i AS k, (p.cn - t.n0)::BIGINT AS ln_, (p.ce - t.e0)::BIGINT AS le, p.total
                  FROM tree{d} t JOIN places p ON p.v = t.v AND p.i >= t.lo AND p.i < t.hi)
            WHERE least(ln_, n - ln_) >= {smallest}::DOUBLE * total) WHERE fall > 0 GROUP BY v, lo"""
        steps[f"tree{d + 1}"] = f"""
          SELECT v, lo, coalesce(cut[1], hi) AS hi, n0, e0, coalesce(cut[2], n) AS n, coalesce(cut[3], e) AS e
          FROM tree{d} LEFT JOIN falls{d} USING (v, lo)
          UNION ALL
          SELECT v, cut[1] + 1, hi, n0 + cut[2], e0 + cut[3], n - cut[2], e - cut[3] FROM tree{d} JOIN falls{d} USING (v, lo)"""
    steps["leaves"] = f"""
      SELECT t.v, t.n::BIGINT AS n, t.e::BIGINT AS events, row_number() OVER (PARTITION BY t.v ORDER BY lo) AS i, total, lower
      FROM tree{depth} t JOIN known ON known.v = t.v AND known.i = lo"""
    return steps


def with_steps(steps: dict[str, str], after: str, more: dict[str, str], renamed: dict[str, str] | None = None) -> dict[str, str]:
    """``steps`` with ``more`` put in after one of them in place of those of the same name; later ones read ``renamed``."""
    out: dict[str, str] = {}
    late = False
    for name, text in steps.items():
        if name not in more:
            for old, new in (renamed or {}).items():
                text = re.sub(rf"\b{old}\b", new, text) if late else text
            out[name] = text
        if name == after:
            out |= more
            late = True
    return out


def binning_steps(
    numeric: tuple[str, ...], categorical: tuple[str, ...], source: str, smallest: float = 0.05, trend: bool = True,
    rare: float = 0, parts: int = 20, folds: int = 0,
) -> dict[str, str]:
    """Steps ending in ``bins``: variable, bin, lower, upper, n, events."""
    rows = [f"SELECT '{c}' AS v, {c}::DOUBLE AS x, NULL::VARCHAR AS category, pred_score AS y FROM {source}" for c in numeric]
    rows += [
        f"""SELECT '{c}' AS v, CASE WHEN {c} IS NOT NULL THEN sum(pred_score) OVER (PARTITION BY {c})
              / count(*) OVER (PARTITION BY {c})::DOUBLE END AS x, {c} AS category, pred_score AS y
            FROM (SELECT pred_score, CASE WHEN count(*) OVER (PARTITION BY {c}) < {rare}::DOUBLE * count({c}) OVER ()
                    THEN 'Other' ELSE {c} END AS {c} FROM {source} WHERE {c} IS NOT NULL
                  UNION ALL SELECT pred_score, NULL FROM {source} WHERE {c} IS NULL)"""
        for c in categorical
    ]
    if folds:
        rows = [_folded(c, source, folds) for c in categorical]
    steps = {
        "long_rows": " UNION ALL ".join(rows),
        "cuts": f"""
          SELECT v, list(DISTINCT x) AS cuts FROM (
            SELECT v, x, row_number() OVER (PARTITION BY v ORDER BY x) AS place, count(*) OVER (PARTITION BY v) AS n
            FROM long_rows WHERE x IS NOT NULL)
          WHERE place IN (SELECT k * n // {parts} + 1 FROM generate_series(1, {parts - 1}) AS g(k)) GROUP BY v""",
        "prebins": """
          SELECT v, CASE WHEN x IS NULL THEN -1 ELSE len(list_filter(cuts, lambda c: c <= x)) END AS prebin, count(*) AS n,
            sum(y)::BIGINT AS events
          FROM long_rows JOIN cuts USING (v) GROUP BY ALL""",
        "known": """
          SELECT v, n, events, row_number() OVER (PARTITION BY v ORDER BY prebin) AS i,
            sum(n) OVER (PARTITION BY v) AS total,
            CASE WHEN prebin > 0 THEN list_sort(cuts)[prebin] ELSE '-inf'::DOUBLE END AS lower
          FROM prebins JOIN cuts USING (v) WHERE prebin >= 0""",
        "scan": f"""
          SELECT v, i, 0 AS g, n AS cn, events AS ce, total, lower, n, events FROM known WHERE i = 1
          UNION ALL
          SELECT k.v, k.i, CASE WHEN full_ THEN s.g + 1 ELSE s.g END, CASE WHEN full_ THEN k.n ELSE s.cn + k.n END,
            CASE WHEN full_ THEN k.events ELSE s.ce + k.events END, k.total, k.lower, k.n, k.events
          FROM (SELECT *, cn >= {smallest}::DOUBLE * total AND ce > 0 AND ce < cn AS full_ FROM scan) s
            JOIN known k ON k.v = s.v AND k.i = s.i + 1""",
        "large": f"""
          SELECT v, g2 AS b, min(lower) AS lower, sum(n)::BIGINT AS n, sum(events)::BIGINT AS events
          FROM (SELECT scan.*, CASE WHEN g = last_g AND NOT last_full AND g > 0 THEN g - 1 ELSE g END AS g2
                FROM scan JOIN (SELECT v, arg_max(g, i) AS last_g,
                                  arg_max(cn >= {smallest}::DOUBLE * total AND ce > 0 AND ce < cn, i) AS last_full
                                FROM scan GROUP BY v) USING (v))
          GROUP BY ALL""",
        "sums": """
          SELECT v, b, lower, n, events, sum(n) OVER w AS cum_n, sum(events) OVER w AS cum_e
          FROM large WINDOW w AS (PARTITION BY v ORDER BY b)""",
        "spans": """
          SELECT s.v, s.b, j.b AS jb, (k.cum_e - j.cum_e + j.events) / (k.cum_n - j.cum_n + j.n)::DOUBLE AS rate
          FROM sums s JOIN sums j ON j.v = s.v AND j.b <= s.b JOIN sums k ON k.v = s.v AND k.b >= s.b""",
        "isotonic": """
          SELECT v, b, 0 AS way, max(rate) AS level FROM
            (SELECT v, b, jb, min(rate) AS rate FROM spans GROUP BY ALL) GROUP BY v, b
          UNION ALL
          SELECT v, b, 1, min(rate) FROM (SELECT v, b, jb, max(rate) AS rate FROM spans GROUP BY ALL) GROUP BY v, b""",
        "pooled": """
          SELECT v, way, level, min(lower) AS lower, sum(n)::BIGINT AS n, sum(events)::BIGINT AS events
          FROM isotonic JOIN large USING (v, b) GROUP BY ALL""",
        "chosen": """
          SELECT v, arg_max(way, (iv, -way)) AS way FROM (
            SELECT v, way, sum(CASE WHEN events > 0 AND n > events
                THEN ((n - events) / tn - events / te) * ln(((n - events) / tn) / (events / te)) ELSE 0 END) AS iv
            FROM (SELECT *, sum(n - events) OVER (PARTITION BY v, way) AS tn,
                    sum(events) OVER (PARTITION BY v, way) AS te FROM pooled) GROUP BY ALL) GROUP BY v""",
        "joined": (
            "SELECT v, lower, n, events FROM pooled JOIN chosen USING (v, way)"
            if trend
            else "SELECT v, lower, n, events FROM large"
        ),
        "bins": """
          SELECT v AS variable, (row_number() OVER w - 1)::INT AS bin,
            CASE WHEN row_number() OVER w = 1 THEN '-inf'::DOUBLE ELSE lower END AS lower,
            coalesce(lead(lower) OVER w, 'inf'::DOUBLE) AS upper, n, events
          FROM joined WINDOW w AS (PARTITION BY v ORDER BY lower)
          UNION ALL SELECT v, -1, NULL, NULL, n, events FROM prebins WHERE prebin = -1""",
        "evidence": """
          SELECT *, n / sum(n) OVER e AS share, n - events AS non_events, events / n AS event_rate,
            CASE WHEN events > 0 AND n > events THEN ln(p / q) ELSE 0 END AS woe,
            CASE WHEN events > 0 AND n > events THEN (p - q) * ln(p / q) ELSE 0 END AS iv,
            CASE WHEN events > 0 AND n > events
              THEN (p * ln(2 * p / (p + q)) + q * ln(2 * q / (p + q))) / 2 ELSE 0 END AS js
          FROM (SELECT *, (n - events) / sum(n - events) OVER e AS p, events / sum(events) OVER e AS q
                FROM bins WINDOW e AS (PARTITION BY variable))
          WINDOW e AS (PARTITION BY variable)""",
    }
    return steps


_EVIDENCE_COLUMNS = """variable, bin, CASE WHEN isfinite(lower) THEN round(lower, 6) END AS lower,
  CASE WHEN isfinite(upper) THEN round(upper, 6) END AS upper, n, events, non_events,
  round(share, 6) AS share, round(event_rate, 6) AS event_rate, round(woe, 6) AS woe, round(iv, 6) AS iv,
  round(js, 6) AS js"""

ORACLE["woe_iv_prebins"] = sql(
    f"SELECT {_EVIDENCE_COLUMNS} FROM evidence", **binning_steps(NUMERIC, (), "with_health", 0.0, False)
)
ORACLE["woe_iv_numeric"] = sql(f"SELECT {_EVIDENCE_COLUMNS} FROM evidence", **binning_steps(NUMERIC, (), "with_health"))
ORACLE["woe_iv_categorical"] = sql(
    f"SELECT {_EVIDENCE_COLUMNS} FROM evidence", **binning_steps((), CATEGORICAL, "with_health")
)
ORACLE["woe_iv_categorical_rare"] = sql(
    f"SELECT {_EVIDENCE_COLUMNS} FROM evidence",
    **binning_steps((), ("skill_category", "employee_name"), "with_health", rare=0.012),
)
ORACLE["woe_iv_categorical_crossfit"] = sql(
    f"SELECT {_EVIDENCE_COLUMNS} FROM evidence", **binning_steps((), CATEGORICAL, "with_health", folds=5)
)
ORACLE["category_rates_crossfit"] = sql(
    """SELECT v AS variable, category, f::INT AS fold, count(*) AS n, sum(y)::BIGINT AS events, round(any_value(x), 9) AS rate
       FROM folded WHERE category IS NOT NULL GROUP BY v, category, f
       UNION ALL
       SELECT v, category, NULL, count(*), sum(y)::BIGINT, round((sum(y) + 20 * any_value(m)) / (count(*) + 20), 9)
       FROM (SELECT *, avg(y) OVER (PARTITION BY v) AS m FROM folded WHERE category IS NOT NULL) GROUP BY v, category""",
    folded=" UNION ALL ".join(_folded(c, "with_health", 5) for c in CATEGORICAL),
)
ORACLE["woe_iv_optimal"] = sql(
    f"SELECT {_EVIDENCE_COLUMNS} FROM evidence",
    **with_steps(binning_steps(NUMERIC, CATEGORICAL, "with_health"), "known", optimal_steps(1)),
)
ORACLE["woe_iv_optimal_turning"] = sql(
    f"SELECT {_EVIDENCE_COLUMNS} FROM evidence",
    **with_steps(binning_steps(NUMERIC, (), "with_health"), "known", optimal_steps(2)),
)
_TREE = with_steps(
    binning_steps(NUMERIC, (), "with_health", trend=False, parts=200), "known", tree_steps(), {"known": "leaves"}
)
ORACLE["woe_iv_tree_prebins"] = sql(f"SELECT {_EVIDENCE_COLUMNS} FROM evidence", **_TREE)
ORACLE["woe_iv_tree_optimal"] = sql(
    f"SELECT {_EVIDENCE_COLUMNS} FROM evidence",
    **with_steps(_TREE, "leaves", {k: re.sub(r"\bknown\b", "leaves", v) for k, v in optimal_steps(1).items()}),
)
ORACLE["iv_selection"] = sql(
    """SELECT variable, round(sum(iv), 6) AS iv FROM evidence GROUP BY variable
       HAVING sum(iv) BETWEEN 0.005 AND 0.5""",
    **binning_steps(NUMERIC, CATEGORICAL, "with_health"),
)


def _newton(k: int, c: float, rounds: int) -> dict[str, str]:
    """Steps ``w0 .. w<rounds>``: minimise |w|^2 / 2 + c * loss over rows of ``train_x`` (y, x).

    ``x`` is a list that starts with 1; each step has one row with the list ``b``. Gradient and
    Hessian are sums in long form, put into one matrix that a recursion eliminates column by column.
    """
    steps = {"w0": f"SELECT [0.0::DOUBLE for _ in range({k})] AS b"}
    for r in range(rounds):
        steps[f"p{r}"] = f"SELECT x, y, 1 / (1 + exp(-list_dot_product(x, b))) AS p FROM train_x, w{r}"
        steps[f"g{r}"] = f"""
          SELECT i, {k + 1} AS j, {c} * sum((p - y) * x[i]) + any_value(CASE WHEN i > 1 THEN b[i] ELSE 0 END) AS h
          FROM p{r}, w{r}, range(1, {k + 1}) AS a(i) GROUP BY i
          UNION ALL
          SELECT i, j, {c} * sum(p * (1 - p) * x[i] * x[j]) + CASE WHEN i = j AND i > 1 THEN 1 ELSE 0 END
          FROM p{r}, range(1, {k + 1}) AS a(i), range(1, {k + 1}) AS d(j) GROUP BY i, j"""
        steps[f"m{r}"] = f"""
          SELECT list(line ORDER BY i) AS m FROM (SELECT i, list(h ORDER BY j) AS line FROM g{r} GROUP BY i)"""
        steps[f"s{r}"] = f"""
          SELECT 0 AS done, m FROM m{r}
          UNION ALL
          SELECT done + 1, [CASE WHEN i = done + 1 THEN [m[i][j] / m[i][i] for j in range(1, {k + 2})]
              ELSE [m[i][j] - m[i][done + 1] * m[done + 1][j] / m[done + 1][done + 1] for j in range(1, {k + 2})]
            END for i in range(1, {k + 1})]
          FROM s{r} WHERE done < {k}"""
        steps[f"w{r + 1}"] = f"SELECT [b[i] - m[i][{k + 1}] for i in range(1, {k + 1})] AS b FROM s{r}, w{r} WHERE done = {k}"
    return steps


def scorecard_steps(
    numeric: tuple[str, ...], categorical: tuple[str, ...], rows: str, label: str, rounds: int = 8
) -> dict[str, str]:
    """Steps ending in ``detailed`` (the evidence of each bin with coefficient and points) and ``card_scores``.

    ``rows`` is what is scored; the rows with a label outside the test part are fitted.
    """
    variables = [*numeric, *categorical]
    steps = {
        "frame": f"SELECT * EXCLUDE ({label}), {label} AS pred_score, row_number() OVER () AS rid FROM ({rows})",
        "train": f"SELECT * FROM frame WHERE NOT {_IS_TEST} AND pred_score IS NOT NULL",
    }
    steps |= binning_steps(numeric, categorical, "train")
    steps["rates"] = """SELECT v, category, x, count(*) AS n, sum(y)::BIGINT AS events FROM long_rows
      WHERE category IS NOT NULL GROUP BY ALL"""
    values = [f"SELECT rid, '{c}' AS v, {c}::DOUBLE AS x, {c} IS NULL AS missing FROM frame" for c in numeric]
    values += [
        f"SELECT rid, '{c}', rates.x, rates.x IS NULL FROM frame LEFT JOIN rates ON rates.v = '{c}' AND category = {c}::VARCHAR"
        for c in categorical
    ]
    steps["frame_values"] = " UNION ALL ".join(values)
    order = ", ".join(f"('{v}', {i})" for i, v in enumerate(variables, 2))
    steps["variables"] = f"SELECT * FROM (VALUES {order}) AS every(v, i)"
    steps["places"] = """
      SELECT rid, f.v, i, coalesce(bin, -1) AS bin, coalesce(woe, 0) AS woe
      FROM frame_values f JOIN variables ON variables.v = f.v
      LEFT JOIN evidence e ON e.variable = f.v AND e.bin >= 0 AND x >= e.lower AND x < e.upper"""
    steps["train_x"] = """
      SELECT pred_score AS y, list_prepend(1.0::DOUBLE, list(woe ORDER BY i)) AS x
      FROM places JOIN train USING (rid) GROUP BY rid, pred_score"""
    steps |= _newton(len(variables) + 1, 5.0, rounds)
    steps["weights"] = f"SELECT v AS variable, b[i] AS coefficient FROM variables, w{rounds}"
    steps["parts"] = """
      SELECT variable, bin, lower, upper, n, share, non_events, events, event_rate, woe, iv, js, coefficient,
        coefficient * CASE WHEN bin < 0 THEN 0 ELSE woe END AS part
      FROM evidence JOIN weights USING (variable)
      UNION ALL
      SELECT variable, -1, NULL, NULL, 0, 0, 0, 0, NULL, 0, 0, 0, coefficient, 0 FROM weights
      WHERE variable NOT IN (SELECT variable FROM evidence WHERE bin = -1)"""
    # Weight of evidence 0 is always possible.
    steps["ends"] = "SELECT variable, least(min(part), 0) AS lo, greatest(max(part), 0) AS hi FROM parts GROUP BY variable"
    steps["detailed"] = """
      SELECT parts.*, 100 / (SELECT sum(hi - lo) FROM ends) * (part - lo) AS points
      FROM parts JOIN ends USING (variable)"""
    steps["card_scores"] = """
      SELECT frame.*, total AS score FROM frame JOIN (
        SELECT rid, sum(points) AS total FROM places JOIN detailed ON detailed.variable = v AND detailed.bin = places.bin
        GROUP BY rid) USING (rid)"""
    return steps


_NUMERIC_OLDER = (
    "wait_time", "complete_duration", "avg_response_cust", "avg_response_agnt", "agent_handle_time", "close_time",
    "no_of_upfront_sla_breach", "no_of_turns_per_conversation", "no_of_agents", "agent_tenure_days", "resolution_days",
    "csatscore", "day_working_hours", "day_billable_hour", "CPH",
)
_CATEGORICAL_OLDER = ("employee_name", "incidentlevel2reason", "sub_line_of_business__c")
_NEWER = scorecard_steps(
    (*_NUMERIC_OLDER, "customer_tenure_days", "counting", "number_cases"),
    (*_CATEGORICAL_OLDER, "skill_category", "first_queue", "last_queue", "bot_involved_flag"),
    "SELECT * FROM all_cases WHERE sign IS DISTINCT FROM 1",
    "pred_score",
)
_OLDER = scorecard_steps(_NUMERIC_OLDER, _CATEGORICAL_OLDER, "SELECT * FROM all_cases_older", "chs")
_FINAL = """SELECT employee_name, sub_line_of_business__c, incidentlevel2reason, round(avg(score), 3) AS score,
    count(pred_score) AS count FROM card_scores GROUP BY ALL"""
ORACLE["scorecard_table"] = sql(
    f"""SELECT {_EVIDENCE_COLUMNS}, round(coefficient, 4) AS coefficient, round(points, 4) AS points FROM detailed""",
    **_NEWER,
)
ORACLE["scorecard_scores"] = sql("SELECT case_key, round(score, 3) AS score FROM card_scores", **_NEWER)
ORACLE["category_bins"] = sql(
    """SELECT d.variable, d.bin, category, rates.n, rates.events, round(woe, 6) AS woe, round(points, 4) AS points
       FROM rates JOIN detailed d ON d.variable = rates.v AND d.bin >= 0 AND x >= d.lower AND x < d.upper""",
    **_NEWER,
)
ORACLE["agent_performance"] = sql(_FINAL, **_NEWER)
ORACLE["agent_performance_older"] = sql(_FINAL, **_OLDER)

_CURVE = """
  SELECT score, positives, negatives, sum(positives) OVER w AS tp, sum(negatives) OVER w AS fp,
    sum(positives) OVER w / sum(positives) OVER ()::DOUBLE AS tpr,
    sum(negatives) OVER w / sum(negatives) OVER ()::DOUBLE AS fpr
  FROM (SELECT {score}::DOUBLE AS score, sum({label})::BIGINT AS positives, sum(1 - {label})::BIGINT AS negatives
        FROM {source} GROUP BY 1)
  WINDOW w AS (ORDER BY score DESC)"""
ORACLE["roc_curve"] = sql(
    """SELECT score, positives, negatives, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr
       FROM points""",
    points=_CURVE.format(score="resolution_days", label="pred_score", source="with_health"),
)
ORACLE["roc_auc"] = sql(
    """SELECT round(sum((g.fpr - coalesce(g.before_f, 0)) * (g.tpr + coalesce(g.before_t, 0)) / 2), 6) AS auc,
         sum(positives)::BIGINT AS n_positive, sum(negatives)::BIGINT AS n_negative
       FROM (SELECT *, lag(fpr) OVER (ORDER BY score DESC) AS before_f, lag(tpr) OVER (ORDER BY score DESC) AS before_t
             FROM points) g""",
    points=_CURVE.format(score="resolution_days", label="pred_score", source="with_health"),
)
ORACLE["ks"] = sql(
    "SELECT round(abs(tpr - fpr), 6) AS ks, score FROM points ORDER BY abs(tpr - fpr) DESC, score DESC LIMIT 1",
    points=_CURVE.format(score="n_chars", label="quality", source="documents JOIN labels USING (doc_id)"),
)
# Final scores.

ORACLE["final_score"] = sql("SELECT * FROM final")
ORACLE["final_score_pivot"] = sql(
    "SELECT employee_name, sub_line_of_business__c, "
    + ", ".join(
        f"max(score) FILTER (incidentlevel2reason = '{i}') AS \"{i}\""
        for i in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
    )
    + " FROM final GROUP BY ALL"
)
ORACLE["exported_scores"] = ORACLE["final_score"]
ORACLE["exported_pivot"] = ORACLE["final_score_pivot"]
ORACLE["exported_model_table"] = ORACLE["scorecard_table"]
ORACLE["scorecard_kept"] = ORACLE["scorecard_scores"]

# Snapshots.

ORACLE["json_repair_explode"] = sql(
    """SELECT event_id, 0 AS position, event_id::VARCHAR AS account, ldap, available FROM records
       UNION ALL
       SELECT event_id, 1, (event_id + 1)::VARCHAR, ldap || '}{x', event_type NOT IN ('click', 'view')
       FROM records JOIN events USING (event_id)"""
)
ORACLE["snapshot_pieces"] = sql("SELECT strftime(h, '%Y/%m/%d/%H') AS hour, ldap, available FROM records")
ORACLE["latest_file_available"] = sql(
    "SELECT ldap FROM files WHERE available AND (h, half) = (SELECT max((h, half)) FROM files)"
)
ORACLE["availability_stream"] = sql(
    """SELECT ldap, strftime(max(h), '%Y/%m/%d/%H') AS hour, arg_max(available, (h, half)) AS available
       FROM files GROUP BY ldap"""
)

# Files are written at the end of their half hour. Timers are due up to the time of the last file.
ORACLE["availability_expiring"] = sql(
    """SELECT ldap, strftime(t, '%Y-%m-%d %H:%M') AS "at", available, expired FROM (
         SELECT ldap, t, available, false AS expired FROM seen
         WHERE available <> CASE WHEN last_t IS NULL OR t - last_t > INTERVAL 2 HOUR THEN false ELSE last_available END
         UNION ALL
         SELECT ldap, t + INTERVAL 2 HOUR, false, true FROM seen
         WHERE available AND (next_t - t > INTERVAL 2 HOUR
                              OR next_t IS NULL AND t + INTERVAL 2 HOUR <= (SELECT max(t) FROM seen)))""",
    seen="""
      SELECT ldap, t, available, lag(available) OVER w AS last_available, lag(t) OVER w AS last_t, lead(t) OVER w AS next_t
      FROM (SELECT ldap, h + INTERVAL 30 MINUTE * (half + 1) AS t, available FROM files)
      WINDOW w AS (PARTITION BY ldap ORDER BY t)""",
)

ORACLE["availability_by_hour"] = ORACLE["availability_stream"]

# Routing.

# Files are written at the end of their half hour; a request may be answered from its hour or the one before.
ORACLE["routed_as_of"] = sql(
    """SELECT event_id, issue_code, coalesce((SELECT arg_min(c.ldap, (-c.score, c.ldap)) FROM card c JOIN files f USING (ldap)
         WHERE c.issue_code = a.issue_code AND f.h = a.file[1] AND f.half = a.file[2] AND f.available), 'Not Found') AS ldap
       FROM asked a""",
    card="""
      SELECT p_type AS issue_code, 'agent' || (l_suppkey % 40) AS ldap, round(avg(l_discount), 6) AS score
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
    asked="""
      SELECT event_id, any_value(p_type) AS issue_code, max((h, half)) AS file
      FROM events LEFT JOIN part ON event_id % 2500 = p_partkey
      LEFT JOIN (SELECT DISTINCT h, half FROM files) m
        ON h + INTERVAL 30 MINUTE * (half + 1) <= ts AND h >= date_trunc('hour', ts) - INTERVAL 1 HOUR
      GROUP BY event_id""",
)

ORACLE["best_available_agent"] = sql(
    """SELECT issue_code, coalesce(best, 'Not Found') AS ldap
       FROM (SELECT p_type AS issue_code FROM part UNION SELECT o_orderpriority FROM orders)
       LEFT JOIN (SELECT issue_code, arg_min(ldap, (-score, ldap)) AS best FROM routing JOIN available USING (ldap)
                  GROUP BY issue_code) USING (issue_code)"""
)
ORACLE["best_agent_for_one_issue"] = sql(
    """SELECT ldap FROM routing JOIN available USING (ldap) WHERE issue_code = 'PROMO'
       ORDER BY score DESC, ldap LIMIT 1"""
)
ORACLE["agents_for_issue"] = sql("SELECT * FROM routing WHERE issue_code = 'SMALL'")
ORACLE["scorecard_upsert"] = sql(
    """SELECT coalesce(c.issue_code, w.issue_code) AS issue_code, coalesce(c.ldap, w.ldap) AS ldap,
         coalesce(w.score, c.score) AS score
       FROM (SELECT 'Brand#' || (s_suppkey % 30) AS issue_code, s_name AS ldap, s_acctbal AS score FROM supplier
             UNION ALL SELECT 'none', s_name, s_acctbal FROM supplier) c
       FULL JOIN (SELECT p_brand AS issue_code, s_name AS ldap,
                    arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_extendedprice)) AS score
                  FROM lines GROUP BY ALL) w USING (issue_code, ldap)"""
)
ORACLE["scorecard_upsert_stream"] = ORACLE["scorecard_upsert"]
ORACLE["scorecard_save"] = sql(
    """SELECT issue_code, ldap,
         CASE WHEN issue_code = 'PROMO' AND ldap IN (SELECT ldap FROM available) THEN 1.5 ELSE score END::DOUBLE AS score
       FROM routing
       UNION ALL SELECT 'PROMO', ldap, 1.5 FROM available
       WHERE ldap NOT IN (SELECT ldap FROM routing WHERE issue_code = 'PROMO')"""
)
ORACLE["agents_as_json"] = sql(
    """SELECT '{"issue_code":"' || issue_code || '","ldap":"' || ldap || '","score":"' || printf('%.6f', score) || '"}' AS body
       FROM routing"""
)
