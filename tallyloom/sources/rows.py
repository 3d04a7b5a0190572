"""Enriched JSON messages to flat event rows, and the dead letters among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.jsonrules import UUID, Picked, pick_fields
from tallyloom.functions.scalars import pinned
from tallyloom.schema import EVENT_ROW

_REQUIRED = ("tenant_id", "event", "task_id", "run_id", "task_type", "timestamp")
_TEXT = ("session_id", "tool_name", "model", "status", "verification", "initiator", "retry_of_step_id")
_NUMBER = {
    "tokens_in": "tokens_in", "tokens_out": "tokens_out", "latency_ms": "latency_ms", "cost_usd": "cost_usd",
    "rating_value": "rating.value", "edit_magnitude_value": "edit_magnitude.value", "response_latency_ms": "response_latency_ms",
}
DEFAULT_RETENTION, MIN_RETENTION, MAX_RETENTION = 365, 1, 3650


_FIELDS = tuple(dict.fromkeys((*_REQUIRED, *_TEXT, *_NUMBER.values(), "event_id", "agent.name", "agent.version", "retention_days")))


def _filled(doc: Picked, path: str) -> Column:
    return F.coalesce(doc.text(path) != "", F.lit(False))


def map_messages(df: DataFrame, value: str = "value") -> DataFrame:
    """Add the flat row (``row``, NULL when unmappable) and ``dead_reason`` to each message.

    Required fields must be there and well formed; everything else coerces,
    missing or mistyped, to '' or 0. The message itself is kept whole.
    """
    d = pick_fields(df, "_f", F.try_parse_json(value), _FIELDS)
    doc = Picked(F.col("_f"))
    version = doc.kind("agent.version")
    when = F.try_to_timestamp(doc.text("timestamp"))
    unmappable = F.concat_ws(
        ",", *[F.when(~_filled(doc, p), p) for p in _REQUIRED],
        F.when(~F.coalesce(doc.text("event_id").rlike(UUID), F.lit(False)), "event_id"),
        F.when(~_filled(doc, "agent.name"), "agent.name"),
        F.when(version.isNotNull() & (version != "STRING"), "agent.version"),
        F.when(_filled(doc, "timestamp") & when.isNull(), "timestamp"))
    reason = F.when(doc.struct.isNull(), "unparsable").when(F.col("_bad") != "", F.concat(F.lit("unmappable: "), F.col("_bad")))
    retention = doc.number("retention_days")
    built = {
        **{p: doc.text(p) for p in (*_REQUIRED[:-1], "event_id")},
        "timestamp": when,
        **{p: F.coalesce(doc.text(p), F.lit("")) for p in _TEXT},
        "agent_name": doc.text("agent.name"),
        "agent_version": F.coalesce(doc.text("agent.version"), F.lit("")),
        **{c: F.coalesce(doc.number(p), F.lit(0.0)) for c, p in _NUMBER.items()},
        "retention_days": F.when(retention.isNull(), DEFAULT_RETENTION).otherwise(
            # clamped as it comes, so a number beyond an int cannot stop the job
            F.floor(F.least(F.lit(float(MAX_RETENTION)), F.greatest(F.lit(float(MIN_RETENTION)), retention)) + 0.5).cast("int")),
        "payload": F.col(value),
    }
    row = F.struct(*[built[f.name].cast(f.dataType).alias(f.name) for f in EVENT_ROW.fields])
    d = pinned(pinned(d, "_bad", unmappable), "dead_reason", reason)
    return pinned(d, "row", F.when(F.col("dead_reason").isNull(), row)).drop("_f", "_bad")


def to_event_rows(df: DataFrame, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Flat rows of the mappable messages; ``keep`` carries columns of the input along."""
    return map_messages(df, value).where(F.col("row").isNotNull()).select("row.*", *keep)


def split_dead_letters(df: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(rows, dead letters with their reason and the original message). No message is lost."""
    mapped = map_messages(df, value)
    return (mapped.where(F.col("row").isNotNull()).select("row.*"),
            mapped.where(F.col("row").isNull()).select(F.col("dead_reason").alias("reason"), F.col(value).alias("original")))
