"""Event model: names, flat row layout and fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = "0.1.0"

# The ten agent event names.
CORE_EVENTS = (
    "task_started", "task_completed", "task_failed", "task_abandoned", "step_executed",
    "handoff_to_human", "human_approved", "human_edited", "human_overrode", "feedback_given",
)
END_EVENTS = ("task_completed", "task_failed", "task_abandoned")
HUMAN_EVENTS = ("handoff_to_human", "human_approved", "human_edited", "human_overrode")

# One event is one row of this identity; a redelivery repeats all five values.
IDENTITY = ("tenant_id", "task_type", "event", "timestamp", "event_id")

_STRINGS = (
    "tenant_id", "event", "event_id", "task_id", "run_id", "session_id", "task_type", "agent_name",
    "agent_version", "tool_name", "model", "status", "verification", "initiator", "retry_of_step_id",
)
_DOUBLES = (
    "tokens_in", "tokens_out", "latency_ms", "cost_usd", "rating_value", "edit_magnitude_value",
    "response_latency_ms",
)

EVENT_ROW = T.StructType(
    [T.StructField(c, T.StringType()) for c in _STRINGS[:3]]
    + [T.StructField("timestamp", T.TimestampType())]
    + [T.StructField(c, T.StringType()) for c in _STRINGS[3:]]
    + [T.StructField(c, T.DoubleType()) for c in _DOUBLES]
    + [T.StructField("retention_days", T.IntegerType()), T.StructField("payload", T.StringType())]
)


def is_event(*names: str) -> Column:
    col = F.col("event")
    return col == names[0] if len(names) == 1 else col.isin(*names)


def ended() -> Column:
    return is_event(*END_EVENTS)


def human_touch() -> Column:
    return is_event(*HUMAN_EVENTS)
