"""Validation and cleaning of event documents as jobs over tables or streams."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions.jsonrules import Picked, Rule, field, flatten_json, number_of, paths_of, pick_fields, reasons, text_of
from tallyloom.functions.scalars import pinned, uuid_from
from tallyloom.schema import CORE_EVENTS

# ---- agent and product events --------------------------------------------

ENVELOPE = (
    Rule("event_id", "uuid"), Rule("schema_version"), Rule("timestamp", "datetime"), Rule("task_id"), Rule("run_id"), Rule("task_type"),
    Rule("agent", "object"), Rule("agent.name"), Rule("agent.version", required=False), Rule("agent.model", required=False),
    Rule("session_id", required=False),
)


def _for(event: str, *rules: Rule) -> tuple[Rule, ...]:
    return tuple(replace(r, when=event) for r in rules)


def _opt(path: str, kind: str = "string", **kw) -> Rule:
    return Rule(path, kind, required=False, **kw)


def _count(path: str, required: bool = True) -> Rule:
    return Rule(path, "int", required=required, low=0)


# The fields of the ten agent events.
CORE_RULES = (
    *_for("task_started", Rule("initiator", values=("human", "agent", "schedule", "api")), _opt("parent_task_id"), _opt("input_ref")),
    *_for("task_completed", Rule("verification", values=("verified", "self_reported")), _opt("verifier"), _count("duration_ms"), _count("steps_total"),
          _count("tokens_in_total", False), _count("tokens_out_total", False), _opt("cost_usd", "number", low=0), _opt("output_ref")),
    *_for("task_failed", Rule("error", "object"), Rule("error.type"), _opt("error.message", "text"), _opt("failed_step_id"), Rule("retryable", "bool"), _count("duration_ms")),
    *_for("task_abandoned", Rule("abandoned_by", values=("human", "timeout", "system")), _opt("reason", "text"), _count("duration_ms")),
    *_for("step_executed", Rule("step_id"), _count("step_index"),
          Rule("step_type", values=("llm_call", "tool_call", "retrieval", "code_execution", "handoff", "other")), _opt("tool_name"), _opt("model"),
          _count("tokens_in", False), _count("tokens_out", False), _count("latency_ms"), Rule("status", values=("ok", "error", "timeout")),
          _opt("error", "object"), Rule("error.type"), _opt("error.message", "text"), _opt("retry_of_step_id")),
    *_for("handoff_to_human", Rule("handoff_id"),
          Rule("reason", values=("approval_required", "low_confidence", "error", "policy", "clarification", "user_request")), Rule("blocking", "bool"), _opt("context_ref")),
    *_for("human_approved", Rule("handoff_id"), _count("response_latency_ms")),
    *_for("human_edited", _opt("handoff_id"), Rule("artifact_type"), _opt("edit_magnitude", "object"),
          Rule("edit_magnitude.unit", values=("chars", "tokens", "lines")), _count("edit_magnitude.value")),
    *_for("human_overrode", _opt("handoff_id"), _opt("takeover_step_id"), _opt("reason", "text")),
    *_for("feedback_given", Rule("rating", "object"), Rule("rating.kind", values=("binary", "scale")), Rule("rating.value", "number"),
          Rule("source", values=("end_user", "operator")), _opt("comment_ref")),
)

PRODUCT_NAME = Rule("event", "snake")


def validate_events(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Add ``reasons`` and ``reason_class`` (NULL when valid).

    The ten core events are held to their own rules, every other event to the
    envelope and a snake_case name. A bad name is ``invalid_event_name``,
    anything else ``schema_validation``.
    """
    out = pick_fields(df, "_f", F.try_parse_json(payload), (*paths_of((*ENVELOPE, *CORE_RULES)), "event"))
    doc = Picked(F.col("_f"))
    why = reasons(doc, (*ENVELOPE, *CORE_RULES), "event", (PRODUCT_NAME,))
    out = pinned(out, "reasons", why).drop("_f")
    bad_name = F.exists("reasons", lambda r: r.startswith("event:"))
    return out.withColumn("reason_class", F.when(F.size("reasons") == 0, F.lit(None).cast("string")).when(bad_name, "invalid_event_name").otherwise("schema_validation"))


def validate_core_events(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Only rows that name a core event."""
    name = F.get_json_object(payload, "$.event")
    return validate_events(df.where(name.isin(*CORE_EVENTS)), payload)


def validate_product_events(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Rows that name no core event (unparsable ones too)."""
    name = F.get_json_object(payload, "$.event")
    return validate_events(df.where(~F.coalesce(name.isin(*CORE_EVENTS), F.lit(False))), payload)


def rejection_counts(validated: DataFrame, unmapped: DataFrame | None = None, by: Sequence[str] = ("tenant_id",)) -> DataFrame:
    """Rejections per tenant and reason class; unmapped spans count as their own class."""
    rows = validated.where(F.col("reason_class").isNotNull()).select(*by, "reason_class")
    if unmapped is not None:
        rows = rows.unionByName(unmapped.select(*by, F.lit("unmapped_span").alias("reason_class")))
    per = rows.groupBy(*by, "reason_class").agg(F.count(F.lit(1)).alias("rejected"))
    return per.withColumn("total", F.sum("rejected").over(Window.partitionBy(*by)))


def enrich_with_settings(events: DataFrame, settings: DataFrame) -> DataFrame:
    """Attach retention, redaction flag and residency of the tenant; defaults 365, true, 'us'.

    One settings row per tenant; Spark broadcasts the side when it is small.
    """
    s = settings.select("tenant_id", F.col("retention_days").alias("_r"), F.col("redact").alias("_x"), F.col("residency").alias("_z"))
    return events.join(s, "tenant_id", "left").withColumns({
        "retention_days": F.coalesce("_r", F.lit(365)), "redact": F.coalesce("_x", F.lit(True)), "residency": F.coalesce("_z", F.lit("us")),
    }).drop("_r", "_x", "_z")


# ---- web events ----------------------------------------------------------

# The web event vocabulary and limits.
WEB_TYPES = ("page_view", "click", "scroll", "form_submit", "search", "purchase", "signup", "login", "logout", "error", "feature_use",
             "time_spent", "navigation", "interaction", "conversion", "abandonment")
WEB_CATEGORIES = ("engagement", "conversion", "navigation", "error", "feature", "performance", "user_preference", "content_interaction")
WEB_REQUIRED = ("userId", "sessionId", "type", "category", "action")
MAX_EVENT_SIZE, MAX_PROPERTIES, MAX_STRING, MAX_TAGS, MAX_PER_SECOND = 10_000, 50, 1000, 100, 100
SENSITIVE_KEYS = ("password", "ssn", "creditcard", "token", "key")
FEEDBACK_TYPES = ("bug_report", "feature_request", "improvement", "complaint", "compliment", "question", "suggestion", "review", "rating",
                  "nps", "usability", "performance", "accessibility", "security", "other")
FEEDBACK_CATEGORIES = ("ui_ux", "functionality", "performance", "security", "accessibility", "content", "integration", "mobile", "desktop",
                       "api", "documentation", "support", "billing", "onboarding", "navigation", "search", "other")
FEEDBACK_PRIORITIES = ("critical", "high", "medium", "low")
FEEDBACK_STATUS = ("new", "acknowledged", "in_review", "planned", "in_progress", "completed", "rejected", "duplicate", "cannot_reproduce")
CONTEXT_FIELDS = ("page", "referrer", "userAgent", "device", "location", "campaign", "source", "medium", "feature", "component", "version",
                  "experiment", "variant")
USER_FIELDS = ("id", "segment", "cohort", "plan", "usage", "role", "company", "industry", "size", "location")

WEB_BASE = (
    _opt("id", "uuid"), Rule("userId"), Rule("sessionId"), _opt("timestamp", "number", above=0), Rule("type", values=WEB_TYPES),
    Rule("category", values=WEB_CATEGORIES), Rule("action"), _opt("label", "text"), _opt("value", "number"), _opt("properties", "object"),
    _opt("context", "object"), *[_opt(f"context.{f}", "text") for f in CONTEXT_FIELDS],
    _opt("metadata", "object"), *[_opt(f"metadata.{f}", "bool") for f in ("processed", "scored", "segmented", "anonymized")],
    *[_opt(f"metadata.{f}", "number", low=0, high=1) for f in ("quality", "confidence")],
    *[_opt(f"metadata.{f}", "array") for f in ("tags", "flags")],
)


def _web(kind: str, category: str, *rules: Rule) -> tuple[Rule, ...]:
    named = tuple(replace(r, path=f"properties.{r.path}", when=kind) for r in rules)
    return (Rule("category", values=(category,), code=f"must be {category}", when=kind), *named)


WEB_RULES = (
    *WEB_BASE,
    *_web("page_view", "navigation", Rule("page"), _opt("title", "text"), _opt("url", "url"), _opt("referrer", "text"),
          _opt("loadTime", "number", above=0), _opt("scrollDepth", "number", low=0, high=100)),
    *_web("click", "engagement", Rule("element"), _opt("elementType", values=("button", "link", "image", "text", "form", "other")),
          _opt("position", "object"), _opt("target", "text")),
    *_web("form_submit", "conversion", Rule("formId"), _opt("formName", "text"), _opt("fields", "array"), _opt("completionTime", "number", above=0),
          _opt("validationErrors", "array")),
    *_web("purchase", "conversion", Rule("transactionId"), Rule("amount", "number", above=0), Rule("currency", "text", length=3), _opt("items", "array"),
          _opt("paymentMethod", "text"), _opt("couponCode", "text"), _opt("discount", "number")),
    *_web("error", "error", Rule("errorType"), Rule("errorMessage"), _opt("errorCode", "text"), _opt("stackTrace", "text"), _opt("userAgent", "text"),
          _opt("url", "text"), _opt("line", "number"), _opt("column", "number")),
)

FEEDBACK_RULES = (
    _opt("id", "uuid"), _opt("userId", "text"), _opt("sessionId", "text"), _opt("timestamp", "number", above=0), Rule("type", values=FEEDBACK_TYPES),
    Rule("category", values=FEEDBACK_CATEGORIES), _opt("priority", values=FEEDBACK_PRIORITIES), _opt("status", values=FEEDBACK_STATUS),
    Rule("title"), Rule("description"), _opt("rating", "number", low=1, high=10), _opt("npsScore", "number", low=0, high=10),
    _opt("user", "object"), *[_opt(f"user.{f}", "text") for f in USER_FIELDS], _opt("user.tenure", "number"), _opt("user.isAnonymous", "bool"),
)


def _flat(df: DataFrame, payload: str) -> DataFrame:
    return pinned(df, "_f", flatten_json(F.try_parse_json(payload)))


def _truthy(flat: Column, path: str) -> Column:
    f = field(flat, path)
    falsy = (f["t"] == "VOID") | ((f["t"] == "STRING") & (f["s"] == "")) | ((f["t"] == "BOOLEAN") & (f["s"] == "false")) | (f["n"] == 0)
    return f.isNotNull() & ~F.coalesce(falsy, F.lit(False))


def check_web_structure(df: DataFrame, payload: str = "payload", out: str = "structure_errors") -> DataFrame:
    """Size at most 10 kB and five required fields that hold something."""
    d = _flat(df, payload)
    checks = [F.when(F.length(payload) > MAX_EVENT_SIZE, "size: too large")]
    checks += [F.when(~_truthy(F.col("_f"), f), f"{f}: missing") for f in WEB_REQUIRED]
    errors = F.when(F.col("_f").isNotNull(), F.array_compact(F.array(*checks))).otherwise(F.array(F.lit("event: not an object")))
    return pinned(d, out, errors).drop("_f")


def rate_limit_flags(df: DataFrame, user: str, session: str, ts: str, tie: str, per_second: int = MAX_PER_SECOND) -> DataFrame:
    """Flag the events of a user and session beyond ``per_second`` within one event-time second."""
    second = F.date_trunc("second", ts)
    w = Window.partitionBy(F.col(user), F.col(session), second).orderBy(ts, tie)
    return df.withColumn("rate_limited", F.row_number().over(w) > per_second)


def check_web_schema(df: DataFrame, payload: str = "payload", out: str = "schema_errors", feedback: bool = False) -> DataFrame:
    """Base schema plus the schema of five event types; feedback has its own."""
    rules = (FEEDBACK_RULES, None) if feedback else (WEB_RULES, "type")
    read = pick_fields(df, "_f", F.try_parse_json(payload), (*paths_of(rules[0]), "type"))
    return pinned(read, out, reasons(Picked(F.col("_f")), *rules)).drop("_f")


def check_business_rules(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Vocabulary, sizes and purchase amount; warnings apart."""
    d = pinned(pinned(df, "_doc", F.try_parse_json(payload)), "_f", flatten_json(F.col("_doc")))
    doc, flat = F.col("_doc"), F.col("_f")
    kind, category = text_of(flat, "type"), text_of(flat, "category")
    props = F.size(F.map_keys(F.try_variant_get(doc, "$.properties", "map<string,variant>")))
    tags = F.size(F.try_variant_get(doc, "$.metadata.tags", "array<variant>"))
    errors = F.array(
        F.when(~F.coalesce(kind.isin(*WEB_TYPES), F.lit(False)), "type: not allowed"),
        F.when(~F.coalesce(category.isin(*WEB_CATEGORIES), F.lit(False)), "category: not allowed"),
        F.when(props > MAX_PROPERTIES, "properties: too many"),
        F.when(F.length(text_of(flat, "action")) > MAX_STRING, "action: too long"),
        F.when(tags > MAX_TAGS, "tags: too many"),
        F.when((kind == "purchase") & (number_of(flat, "properties.amount") < 0), "amount: not positive"))
    warnings = F.array(F.when((kind == "form_submit") & ~_truthy(flat, "properties.formId"), "formId: recommended"))
    return d.withColumn("rule_errors", F.array_compact(errors)).withColumn("warnings", F.array_compact(warnings)).drop("_doc", "_f")


def clean_text(text: Column) -> Column:
    """Strip script blocks, then tags, then outer space."""
    no_script = F.regexp_replace(text, r"(?is)<script(?![A-Za-z0-9_])[^<]*(?:(?!</script>)<[^<]*)*</script>", "")
    return F.trim(F.regexp_replace(no_script, r"<[^>]*>", ""))


def sanitize_events(df: DataFrame, action: str = "action", properties: str = "properties") -> DataFrame:
    """Clean the action and the property values (a map) and drop properties whose key looks sensitive."""
    low = lambda k: F.lower(k)

    def safe(k: Column, v: Column) -> Column:
        bad = F.lit(False)
        for word in SENSITIVE_KEYS:
            bad = bad | F.contains(low(k), F.lit(word))
        return ~bad

    new_action = clean_text(F.col(action))
    props = F.map_filter(F.transform_values(properties, lambda k, v: clean_text(v)), safe)
    changed = (F.coalesce(new_action != F.col(action), F.lit(False))) | F.col(properties).isNotNull()
    return df.withColumn("sanitized", changed).withColumn(action, new_action).withColumn(properties, props)


def enrich_web_events(df: DataFrame, now: Column, id_col: str = "id", ts: str = "timestamp_ms", key: Sequence[str] | None = None) -> DataFrame:
    """Default id (content hash, so a replay gets the same one), timestamp and metadata flags.

    Without ``key`` the hash is of the whole event, so two events of a session that differ anywhere get two ids.
    A struct column ``metadata`` keeps its own fields, tags and flags; the flags and scores of the pipeline are set anew.
    """
    whole = [c for c in df.columns if c != id_col]
    made = uuid_from(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]) if key else uuid_from(F.to_json(F.struct(*whole), {"ignoreNullFields": "false"}))
    own = df.schema["metadata"].dataType.fieldNames() if "metadata" in df.columns else []
    fields = {c: F.col(f"metadata.`{c}`") for c in own}
    fields |= {"processed": F.lit(False), "scored": F.lit(False), "segmented": F.lit(False), "quality": F.lit(1.0), "confidence": F.lit(1.0)}
    none = F.expr("CAST(array() AS ARRAY<STRING>)")
    fields |= {c: F.coalesce(fields[c], none) if c in own else none for c in ("tags", "flags")}
    return df.withColumn(id_col, F.coalesce(F.col(id_col), made)).withColumn(ts, F.coalesce(F.col(ts), now)).withColumn(
        "metadata", F.struct(*[c.alias(n) for n, c in fields.items()]))


def validation_summary(df: DataFrame, errors: str, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Totals, and error counts by the text before the first colon.

    Reads the ``errors`` array and the flags ``rate_limited`` and ``sanitized``.
    A row fails when it has errors or is rate limited.
    """
    bad = (F.size(errors) > 0) | F.col("rate_limited")
    totals = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~bad).alias("valid"), F.count_if(bad).alias("invalid"),
        F.count_if("rate_limited").alias("rate_limited"), F.count_if(~bad & F.col("sanitized")).alias("sanitized"))
    kinds = df.select(*by, F.explode(errors).alias("_e")).groupBy(*by, F.split("_e", ":")[0].alias("error")).agg(F.count(F.lit(1)).alias("n"))
    return totals, kinds


# ---- findings and scores -------------------------------------------------

_CLAIM = r"(\$\d[\d,]*(?:\.\d+)?|\d[\d,]*(?:\.\d+)?%|(?<![A-Za-z0-9_.])\d[\d,]*\.\d+(?![A-Za-z0-9_%]))"
_NOT_A_CLAIM = r"(?:^|[^A-Za-z0-9_])(?:v|q_|run_|task_|step_)[A-Za-z0-9_]*$"


def uncited_claims(findings: DataFrame, prose: Column, values: Column, out: str = "uncited") -> DataFrame:
    """Numeric claims in the prose that match no registered metric value (either contains the other).

    The text is split at its claims, so each claim is seen with the 12
    characters before it; version tags and ids are no claims.
    """
    d = findings.withColumn("_p", prose).withColumn("_v", values)
    d = pinned(pinned(d, "_tokens", F.regexp_extract_all("_p", F.lit(_CLAIM), F.lit(1))), "_parts", F.split("_p", _CLAIM, -1))

    def before(i: Column) -> Column:
        """Text up to the i-th claim, at most its last 12 characters."""
        joined = F.concat(
            F.when(i > 1, F.concat(F.coalesce(F.try_element_at("_parts", i - 1), F.lit("")), F.coalesce(F.try_element_at("_tokens", i - 1), F.lit("")))).otherwise(""),
            F.coalesce(F.try_element_at("_parts", i), F.lit("")))
        return F.when(F.length(joined) > 12, F.substring(joined, F.length(joined) - 11, F.lit(12))).otherwise(joined)

    indexed = F.transform("_tokens", lambda t, i: F.struct(t.alias("t"), before(i + 1).alias("b")))
    open_claims = F.filter(indexed, lambda c: ~c["b"].rlike(_NOT_A_CLAIM) & ~F.exists("_v", lambda v: F.contains(v, c["t"]) | F.contains(c["t"], v)))
    return d.withColumn(out, F.transform(open_claims, lambda c: c["t"])).drop("_p", "_v", "_tokens", "_parts")


SCORE_RULES = (
    Rule("trace_ref", "object"), Rule("trace_ref.task_id"), Rule("trace_ref.run_id"), Rule("evaluator", "object"), Rule("evaluator.id"),
    Rule("evaluator.kind", values=("code", "judge", "human")), Rule("evaluator.rubric_hash"), _opt("evaluator.judge_model", nullable=True),
    Rule("versions", "object"), Rule("versions.prompt_version"), Rule("versions.model_version"), Rule("versions.agent_version"),
    _opt("versions.dataset_version", nullable=True), Rule("value", "number", low=0, high=1), _opt("label", nullable=True),
    _opt("reasoning", "text", nullable=True), _opt("judge_latency_ms", "number", nullable=True, low=0), _opt("judge_tokens", "number", nullable=True, low=0),
)


def validate_scores(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Reasons an evaluation score document is refused for."""
    read = pick_fields(df, "_f", F.try_parse_json(payload), paths_of(SCORE_RULES))
    return pinned(read, "reasons", reasons(Picked(F.col("_f")), SCORE_RULES)).drop("_f")


def settings_table(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), "tenant_id string, retention_days int, redact boolean, residency string")
