"""Input schemas, as DDL text. Every reader uses one of these; nothing is inferred."""

from __future__ import annotations

CALL_CHAT = """
    case_key STRING, latest_employee_key STRING, vendorid STRING, interaction_starttime STRING,
    language_key STRING, data_source STRING, sales_support_flag STRING,
    incidentlevel2reason STRING, skill_category STRING, first_queue STRING, last_queue STRING,
    agent_path STRING, workday_id STRING, bot_involved_flag STRING, fiscal_qtr STRING,
    wait_time DOUBLE, complete_duration DOUBLE, avg_response_cust DOUBLE, avg_response_agnt DOUBLE,
    agent_handle_time DOUBLE, close_time DOUBLE, no_of_upfront_sla_breach BIGINT,
    no_of_turns_per_conversation BIGINT, no_of_agents BIGINT, agent_tenure_days BIGINT,
    csatscore STRING, cesscore STRING, agentsatisfactionscore STRING, fcrscore STRING"""

EMPLOYEES = "employee_key STRING, employee_name STRING, sub_line_of_business__c STRING"

CLOSED_CASES = "transaction_no STRING, resolution_days DOUBLE, customer_tenure_days DOUBLE"

PRODUCTIVITY = "employee_key STRING, cal_date STRING, login_time BIGINT, billable_hour BIGINT"

HEALTH = "case_key STRING, pred_score INT, model_prob DOUBLE, chs INT"

SNAPSHOT = """
    AWSAccountId: STRING,
    CurrentAgentSnapshot: STRUCT<
      AgentStatus: STRUCT<Type: STRING>,
      Configuration: STRUCT<
        Username: STRING,
        RoutingProfile: STRUCT<
          Concurrency: ARRAY<STRUCT<AvailableSlots: INT, MaximumSlots: INT>>>>>"""

SCORECARD = "issue_code STRING, ldap STRING, score DOUBLE"
