"""OTLP trace payloads (JSON) to agent events.

One payload is one row; the spans of a resource are an array inside it, so the
task type of the first root span is known without a join or a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.scalars import pinned, uuid_from
from tallyloom.schema import SCHEMA_VERSION

_ATTRS = "array<struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>>>"
OTLP_SCHEMA = (
    f"resourceSpans array<struct<resource:struct<attributes:{_ATTRS}>,scopeSpans:array<struct<spans:array<struct<"
    "traceId:string,spanId:string,parentSpanId:string,name:string,startTimeUnixNano:string,endTimeUnixNano:string,"
    f"attributes:{_ATTRS},status:struct<code:int>>>>>>>"
)

# Attributes with a column of their own.
MAPPED = ("gen_ai.request.model", "gen_ai.response.model", "gen_ai.tool.name", "gen_ai.usage.input_tokens",
          "gen_ai.usage.output_tokens", "gen_ai.operation.name")
OUTCOMES = ("completed", "failed", "abandoned")


def _present(a: Column) -> Column:
    v = a["value"]
    return v["stringValue"].isNotNull() | v["intValue"].isNotNull() | v["doubleValue"].isNotNull()


def _as_text(a: Column) -> Column:
    v = a["value"]
    d = v["doubleValue"]
    whole = F.when(d == F.floor(d), d.cast("long").cast("string")).otherwise(d.cast("string"))
    return F.coalesce(v["stringValue"], v["intValue"], whole)


def _attr(attrs: Column, key: str) -> Column:
    """The last value of a key, as text."""
    hits = F.filter(attrs, lambda a: (a["key"] == key) & _present(a))
    return _as_text(F.try_element_at(hits, F.lit(-1)))


def _first(*cols: Column) -> Column:
    return F.coalesce(*cols)


def _is_root(span: Column) -> Column:
    return F.coalesce(span["parentSpanId"], F.lit("")) == ""


def _millis(nanos: Column) -> Column:
    return F.floor(nanos.try_cast("decimal(20,0)") / F.lit(1_000_000)).try_cast("long")


def _iso(ms: Column) -> Column:
    return F.concat(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))


def map_spans(df: DataFrame, payload: str = "payload", keep: tuple[str, ...] = (), namespace: str = "agent") -> DataFrame:
    """One row per span with its events (0 to 2 structs) and, when there is none, the reason.

    ``namespace`` prefixes the attributes for task, run, task type, tool and
    outcome (``agent.task_id`` and so on). Ids are hashes of the span identity,
    so a retried export gives the same events.
    """
    rs = df.select(*keep, F.from_json(payload, OTLP_SCHEMA).alias("_p")).select(*keep, F.explode("_p.resourceSpans").alias("r"))
    spans = F.flatten(F.transform(F.filter("r.scopeSpans", lambda s: s["spans"].isNotNull()), lambda s: s["spans"]))
    rs = rs.select(*keep, F.col("r.resource.attributes").alias("_ra"), spans.alias("_spans"))
    root = F.try_element_at(F.filter("_spans", _is_root), F.lit(1))
    rs = rs.withColumn("_root_type", F.coalesce(_attr(root["attributes"], f"{namespace}.task_type"), root["name"]))
    per = rs.select(*keep, "_ra", "_root_type", F.size("_spans").alias("_n"), F.explode("_spans").alias("s"))
    a = F.col("s.attributes")
    per = per.select(
        *keep, "s", "_n",
        F.coalesce(_attr(F.col("_ra"), "service.name"), F.lit("unknown-agent")).alias("agent_name"),
        _first(_attr(a, f"{namespace}.task_type"), _attr(F.col("_ra"), f"{namespace}.task_type"), F.col("_root_type"), F.col("s.name")).alias("task_type"),
        _first(_attr(a, f"{namespace}.task_id"), F.col("s.traceId")).alias("task_id"),
        _first(_attr(a, f"{namespace}.run_id"), F.col("s.traceId")).alias("run_id"),
        _first(_attr(a, "gen_ai.request.model"), _attr(a, "gen_ai.response.model")).alias("model"),
        _first(_attr(a, f"{namespace}.tool.name"), _attr(a, "gen_ai.tool.name")).alias("tool_name"),
        _attr(a, "gen_ai.operation.name").alias("_op"), _attr(a, f"{namespace}.outcome").alias("_outcome"),
        _attr(a, "gen_ai.usage.input_tokens").try_cast("double").alias("tokens_in"),
        _attr(a, "gen_ai.usage.output_tokens").try_cast("double").alias("tokens_out"),
        _millis(F.col("s.startTimeUnixNano")).alias("_start"), _millis(F.col("s.endTimeUnixNano")).alias("_end"),
        F.floor((F.col("s.endTimeUnixNano").try_cast("decimal(20,0)") - F.col("s.startTimeUnixNano").try_cast("decimal(20,0)")) / F.lit(1_000_000)).try_cast("long").alias("_took"),
        F.when(F.col("s.status.code") == 2, "error").otherwise("ok").alias("_status"),
        _passthrough(a).alias("otel_attributes"),
    )
    is_step = F.col("model").isNotNull() | F.col("tool_name").isNotNull() | F.coalesce(F.col("_op").isin("execute_tool", "chat"), F.lit(False))
    is_end = ~is_step & (F.coalesce(F.col("s.parentSpanId"), F.lit("")) == "") & F.coalesce(F.col("_outcome").isin(*OUTCOMES), F.lit(False))
    ident = lambda event: uuid_from(F.col("s.traceId"), F.col("s.spanId"), event)
    null = lambda t: F.lit(None).cast(t)

    def event(name: Column, at: Column, **fields: Column) -> Column:
        layout = {
            "step_id": "string", "step_index": "int", "step_type": "string", "model": "string", "tool_name": "string", "tokens_in": "double",
            "tokens_out": "double", "latency_ms": "long", "status": "string", "otel_attributes": "map<string,string>", "initiator": "string",
            "verification": "string", "duration_ms": "long", "steps_total": "int", "error_type": "string", "retryable": "boolean", "abandoned_by": "string",
        }
        return F.struct(
            name.alias("event"), ident(name).alias("event_id"), _iso(at).alias("timestamp"),
            *[fields.get(f, null(t)).cast(t).alias(f) for f, t in layout.items()])

    end_name = F.concat(F.lit("task_"), F.col("_outcome"))
    if_end = lambda word, col: F.when(F.col("_outcome") == word, col)
    step = event(
        F.lit("step_executed"), F.col("_end"), step_id=F.col("s.spanId"), step_index=F.lit(0),
        step_type=F.when(F.col("model").isNotNull() | F.coalesce(F.col("_op") == "chat", F.lit(False)), "llm_call").otherwise("tool_call"),
        model=F.col("model"), tool_name=F.col("tool_name"), tokens_in=F.col("tokens_in"), tokens_out=F.col("tokens_out"),
        latency_ms=F.col("_took"), status=F.col("_status"), otel_attributes=F.col("otel_attributes"))
    start = event(F.lit("task_started"), F.col("_start"), initiator=F.lit("api"))
    finish = event(
        end_name, F.col("_end"), duration_ms=F.col("_took"), verification=if_end("completed", F.lit("self_reported")),
        steps_total=if_end("completed", F.col("_n")), error_type=if_end("failed", F.lit("task_failed")),
        retryable=if_end("failed", F.lit(False)), abandoned_by=if_end("abandoned", F.lit("system")))
    unread = lambda time, ms: F.col(time).isNotNull() & F.col(ms).isNull()
    bad_time = unread("s.startTimeUnixNano", "_start") | unread("s.endTimeUnixNano", "_end")
    events = F.when(bad_time, None).when(is_step, F.array(step)).when(is_end, F.array(start, finish))
    # fixed values: the reason for spans without conventions is recorded by readers
    reason = F.when(~is_step & ~is_end, "no recognized conventions").when(bad_time, "time is no number")
    out = pinned(per, "_out", F.struct(events.alias("events"), reason.alias("reason")))
    return out.select(
        *keep, F.lit(SCHEMA_VERSION).alias("schema_version"), "task_id", "run_id", "task_type", "agent_name", F.col("s.name").alias("span"),
        "_out.events", "_out.reason")


def _passthrough(attrs: Column) -> Column:
    """Unmapped ``gen_ai.*`` attributes ride along; the last value of a repeated key wins."""
    own = F.filter(attrs, lambda a: a["key"].startswith("gen_ai.") & ~a["key"].isin(*MAPPED) & _present(a))
    last = F.filter(own, lambda a, i: ~F.exists(F.slice(own, i + 2, F.size(own)), lambda b: b["key"] == a["key"]))
    return F.when(F.size(own) > 0, F.map_from_entries(F.transform(last, lambda a: F.struct(a["key"], _as_text(a)))))


def otlp_to_events(df: DataFrame, payload: str = "payload", keep: tuple[str, ...] = (), namespace: str = "agent") -> DataFrame:
    """Events of all mapped spans, flat."""
    m = map_spans(df, payload, keep, namespace)
    base = [*keep, "schema_version", "task_id", "run_id", "task_type", "agent_name"]
    return m.select(*base, F.explode("events").alias("e")).select(*base, "e.*")


_WHOLE = ("tokens_in", "tokens_out", "latency_ms", "duration_ms")
_PLAIN = ("event_id", "schema_version", "event", "timestamp", "task_id", "run_id", "task_type", "step_id", "step_index", "step_type", "model", "tool_name",
          "status", "otel_attributes", "initiator", "verification", "steps_total", "retryable", "abandoned_by")


def _message() -> Column:
    return F.to_json(F.struct(
        *_PLAIN, F.struct(F.col("agent_name").alias("name")).alias("agent"), F.when(F.col("error_type").isNotNull(), F.struct(F.col("error_type").alias("type"))).alias("error"),
        *[F.greatest(F.col(c).cast("long"), F.lit(0)).alias(c) for c in _WHOLE]))


def span_messages(df: DataFrame, payload: str = "payload", keep: tuple[str, ...] = (), namespace: str = "agent") -> DataFrame:
    """The events of all mapped spans as the JSON messages that clients send, ready for validation and ingest.

    Ids are those of ``map_spans``, so an export that is sent again gives the same messages.
    """
    return otlp_to_events(df, payload, keep, namespace).select(*keep, _message().alias("payload"))


def span_outcomes(df: DataFrame, payload: str = "payload", keep: tuple[str, ...] = (), namespace: str = "agent") -> DataFrame:
    """``span_messages`` and ``unmapped_spans`` in one reading of the payloads: a row has a payload or a reason."""
    base = [*keep, "schema_version", "task_id", "run_id", "task_type", "agent_name", "reason"]
    e = map_spans(df, payload, keep, namespace).select(*base, F.explode_outer("events").alias("e")).where(F.col("e").isNotNull() | F.col("reason").isNotNull())
    return e.withColumn("_sent", F.col("e").isNotNull()).select(*base, "_sent", "e.*").select(*keep, F.when(F.col("_sent"), _message()).alias("payload"), "reason")


def unmapped_spans(df: DataFrame, payload: str = "payload", keep: tuple[str, ...] = (), namespace: str = "agent") -> DataFrame:
    return map_spans(df, payload, keep, namespace).where(F.col("reason").isNotNull()).select(*keep, "span", "reason")
