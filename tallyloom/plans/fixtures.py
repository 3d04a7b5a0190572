"""The given tables in the shape of the event model (adapter views)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.plans.session import tune

START, END, PIVOT = "2024-01-01 00:00:00", "2024-01-31 00:00:00", "2024-01-16 00:00:00"

# Runs unchanged in Spark SQL and in ANSI SQL engines; gives the raw product
# events the columns of the flat agent-event row.
AGENT_EVENTS_CTE = """base AS (
SELECT event_id,
  't_' || CAST(user_id % 8 AS STRING) AS tenant_id,
  CASE event_type
    WHEN 'signup' THEN 'task_started'
    WHEN 'purchase' THEN 'task_completed'
    WHEN 'view' THEN 'step_executed'
    WHEN 'error' THEN CASE event_id % 4 WHEN 0 THEN 'task_failed' WHEN 1 THEN 'task_abandoned' ELSE 'step_executed' END
    ELSE CASE event_id % 10 WHEN 0 THEN 'handoff_to_human' WHEN 1 THEN 'human_approved' WHEN 2 THEN 'human_edited'
         WHEN 3 THEN 'human_overrode' WHEN 4 THEN 'feedback_given' WHEN 5 THEN 'feedback_given' ELSE 'step_executed' END
  END AS event,
  event_type AS src_type, ts AS timestamp, user_id % 8 AS tenant_no,
  'task_' || CAST(user_id AS STRING) || '_' || CAST(dayofyear(ts) - dayofyear(ts) % 2 AS STRING) AS task_id,
  'run_' || CAST(hour(ts) % 3 AS STRING) AS run_id,
  CASE WHEN user_id % 10 = 0 THEN '' ELSE 's_' || CAST(user_id AS STRING) END AS session_id,
  'type_' || CAST((user_id + CAST((dayofyear(ts) - dayofyear(ts) % 2) / 2 AS BIGINT)) % 5 AS STRING) AS task_type,
  'agent_' || CAST(user_id % 3 AS STRING) AS agent_name,
  CASE WHEN dayofyear(ts) < 16 THEN '1.0.0' ELSE '1.1.0' END AS agent_version,
  CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k, value AS v
FROM events),
agent_events AS (
SELECT event_id, tenant_id, event, timestamp, task_id, run_id, session_id, task_type, agent_name, agent_version,
  CASE WHEN event = 'step_executed' AND k % 3 <> 0 THEN 'tool_' || CAST(k % 6 AS STRING) ELSE '' END AS tool_name,
  CASE WHEN event = 'step_executed' AND k % 3 = 0 THEN 'model_' || CAST(k % 2 AS STRING) ELSE '' END AS model,
  CASE WHEN event <> 'step_executed' THEN '' WHEN src_type <> 'error' THEN 'ok' WHEN k % 2 = 0 THEN 'error' ELSE 'timeout' END AS status,
  CASE WHEN event <> 'task_completed' THEN '' WHEN k % 2 = 0 THEN 'verified' ELSE 'self_reported' END AS verification,
  CASE WHEN event <> 'task_started' THEN '' WHEN k % 4 = 0 THEN 'human' WHEN k % 4 = 1 THEN 'agent' WHEN k % 4 = 2 THEN 'schedule' ELSE 'api' END AS initiator,
  CASE WHEN event = 'step_executed' AND k % 7 = 0 THEN 'step_' || CAST(event_id - 1 AS STRING) ELSE '' END AS retry_of_step_id,
  CAST(CASE WHEN event = 'step_executed' THEN k * 10 ELSE 0 END AS DOUBLE) AS tokens_in,
  CAST(CASE WHEN event = 'step_executed' THEN k * 3 ELSE 0 END AS DOUBLE) AS tokens_out,
  CAST(CASE WHEN event = 'step_executed' THEN v * 10 ELSE 0 END AS DOUBLE) AS latency_ms,
  CAST(CASE WHEN event = 'task_completed' THEN v / 100 ELSE 0 END AS DOUBLE) AS cost_usd,
  CAST(CASE WHEN event = 'feedback_given' THEN k % 2 ELSE 0 END AS DOUBLE) AS rating_value,
  CAST(CASE WHEN event = 'human_edited' THEN k ELSE 0 END AS DOUBLE) AS edit_magnitude_value,
  CAST(CASE WHEN event = 'human_approved' THEN v * 100 ELSE 0 END AS DOUBLE) AS response_latency_ms,
  CAST(1 + tenant_no * 5 AS INT) AS retention_days
FROM base)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def agent_events(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """The adapter view over the events table, or over ``events`` (a stream of it)."""
    text = f"WITH {AGENT_EVENTS_CTE} SELECT * FROM agent_events".replace("FROM events)", "FROM {events})")
    return spark.sql(text, events=table(spark, sf_dir, "events") if events is None else events)


def oracle(select: str, *ctes: str) -> str:
    """Reference SQL over the adapter view."""
    return "WITH " + ",\n".join([AGENT_EVENTS_CTE, *ctes]) + "\n" + select


IN_WINDOW = f"timestamp >= TIMESTAMP '{START}' AND timestamp < TIMESTAMP '{END}'"
