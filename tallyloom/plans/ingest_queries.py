"""Registered queries: validation, redaction, row mapping, trace payloads.

The messages are built from the events table; defects are put in by rule, so
the reference SQL can say what each operator must find.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.redaction import RECOGNISERS, redact_text
from tallyloom.functions.scalars import pinned, r6
from tallyloom.operators import redact as RD
from tallyloom.operators import validate as V
from tallyloom.plans.fixtures import agent_events, oracle, table
from tallyloom.sources import otlp as OT
from tallyloom.sources import rows as RW

QUERIES = {}
ORACLE = {}


def _add(key, run, sql=None):
    QUERIES[key] = run
    if sql is not None:
        ORACLE[key] = sql


def _only(event, col):
    return F.when(F.col("event") == event, col)


def _landed(df):
    """Documents arrive as stored text: keep the optimizer from inlining how they were made into how they are read."""
    return pinned(df.withColumnRenamed("payload", "_made"), "payload", F.col("_made")).drop("_made")


def messages(spark, sf_dir, events=None):
    """(event_id, tenant_id, event, payload): every event as an enriched message, one in two with a defect by event_id % 20."""
    ev = agent_events(spark, sf_dir, events)
    d = F.col("event_id") % 20
    md = F.md5(F.col("event_id").cast("string"))
    uid = F.concat_ws("-", F.substring(md, 1, 8), F.substring(md, 9, 4), F.substring(md, 13, 4), F.substring(md, 17, 4), F.substring(md, 21, 12))
    step, ended = F.col("event") == "step_executed", F.col("event").isin("task_completed", "task_failed", "task_abandoned")
    empty = lambda c: F.when(F.col(c) != "", F.col(c))
    body = F.struct(
        F.when(d != 2, uid).otherwise("x").alias("event_id"), F.lit("0.1.0").alias("schema_version"), F.col("tenant_id"),
        F.when(d == 1, "Bad-Name").when(d == 5, "checkout_done").otherwise(F.col("event")).alias("event"),
        F.when(d == 3, "yesterday").otherwise(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("timestamp"),
        F.when(d != 0, F.col("task_id")).alias("task_id"), F.col("run_id"), F.col("task_type"),
        F.when(d != 4, F.struct(F.col("agent_name").alias("name"), F.col("agent_version").alias("version"))).alias("agent"),
        empty("session_id").alias("session_id"),
        F.when(F.col("event") == "task_started", F.when(d == 7, "robot").otherwise(F.col("initiator"))).alias("initiator"),
        empty("verification").alias("verification"), F.when(ended, F.lit(5)).alias("duration_ms"), _only("task_completed", F.lit(3)).alias("steps_total"),
        _only("task_completed", F.col("cost_usd")).alias("cost_usd"), _only("task_failed", F.struct(F.lit("oops").alias("type"))).alias("error"),
        _only("task_failed", F.lit(True)).alias("retryable"), _only("task_abandoned", F.lit("timeout")).alias("abandoned_by"),
        F.when(step, F.lit("s1")).alias("step_id"), F.when(step, F.lit(0)).alias("step_index"),
        F.when(step, F.when(F.col("tool_name") != "", "tool_call").otherwise("llm_call")).alias("step_type"),
        empty("tool_name").alias("tool_name"), empty("model").alias("model"),
        F.when(step, F.when(d == 8, F.lit(1.5)).otherwise(F.col("tokens_in"))).alias("tokens_in"), F.when(step, F.col("tokens_out").cast("long")).alias("tokens_out"),
        F.when(step, F.floor("latency_ms")).alias("latency_ms"), F.when(step, F.when(d == 7, "weird").otherwise(F.col("status"))).alias("status"),
        empty("retry_of_step_id").alias("retry_of_step_id"),
        F.when(F.col("event").isin("handoff_to_human", "human_approved"), F.lit("h1")).alias("handoff_id"),
        _only("handoff_to_human", F.lit("policy")).alias("reason"), _only("handoff_to_human", F.lit(False)).alias("blocking"),
        _only("human_approved", F.floor("response_latency_ms")).alias("response_latency_ms"),
        _only("human_edited", F.lit("email_draft")).alias("artifact_type"),
        _only("human_edited", F.struct(F.lit("chars").alias("unit"), F.col("edit_magnitude_value").cast("long").alias("value"))).alias("edit_magnitude"),
        _only("feedback_given", F.struct(F.lit("binary").alias("kind"), F.col("rating_value").cast("long").alias("value"))).alias("rating"),
        _only("feedback_given", F.lit("operator")).alias("source"),
        F.when(d == 9, F.lit("mail a.b@example.org or call 555-123-4567")).alias("note"),
        F.when(d == 10, F.lit(99999.4)).when(d == 11, F.lit(-3.0)).otherwise(F.col("retention_days").cast("double")).alias("retention_days"),
    )
    text = F.to_json(body)
    return ev.select("event_id", "tenant_id", F.col("event").alias("src_event"), F.when(d == 6, F.substring(text, 1, 20)).otherwise(text).alias("payload")).transform(_landed)


CORE = "event IN ('" + "', '".join(V.CORE_EVENTS) + "')"
_D = "event_id % 20"
REASON = (f"CASE {_D} WHEN 0 THEN 'task_id: missing' WHEN 1 THEN 'event: not snake_case' WHEN 2 THEN 'event_id: not a uuid' WHEN 3 THEN 'timestamp: not a datetime with offset' "
          "WHEN 4 THEN 'agent: missing' WHEN 6 THEN '(document): not an object' WHEN 7 THEN CASE WHEN event = 'step_executed' THEN 'status: not allowed' WHEN event = 'task_started' THEN 'initiator: not allowed' ELSE '' END "
          "WHEN 8 THEN CASE WHEN event = 'step_executed' THEN 'tokens_in: not an integer' ELSE '' END ELSE '' END")
CLASS = f"CASE WHEN {_D} = 1 THEN 'invalid_event_name' WHEN {REASON} <> '' THEN 'schema_validation' END"


def _checked(df):
    return df.select("event_id", F.concat_ws(";", "reasons").alias("reasons"), "reason_class")


_add("V1_validate_core_events", lambda s, d: _checked(V.validate_core_events(messages(s, d))),
     oracle(f"SELECT event_id, {REASON} AS reasons, {CLASS} AS reason_class FROM agent_events WHERE {_D} NOT IN (1, 5, 6)"))
_add("V2_validate_product_events", lambda s, d: _checked(V.validate_product_events(messages(s, d))),
     oracle(f"SELECT event_id, {REASON} AS reasons, {CLASS} AS reason_class FROM agent_events WHERE {_D} IN (1, 5, 6)"))
_add("V3_rejection_counts", lambda s, d: V.rejection_counts(V.validate_events(messages(s, d)), OT.unmapped_spans(payloads(s, d), keep=("tenant_id",))),
     oracle(f"SELECT tenant_id, rc AS reason_class, count(*) AS rejected, CAST(sum(count(*)) OVER (PARTITION BY tenant_id) AS BIGINT) AS total FROM (SELECT tenant_id, {CLASS} AS rc FROM agent_events "
            "UNION ALL SELECT tenant_id, 'unmapped_span' FROM agent_events WHERE event NOT IN ('step_executed', 'task_completed', 'task_failed', 'task_abandoned')) WHERE rc IS NOT NULL GROUP BY 1, 2"))


def settings(spark, sf_dir):
    """One settings row per nation, for the tenant with twice its number: odd tenants have none."""
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("t_"), (n * 2).cast("string")).alias("tenant_id"), (n * 100 + 30).cast("int").alias("retention_days"), (n != 2).alias("redact"),
        F.when(n % 2 == 0, "eu").otherwise("us").alias("residency"))


def _v4(spark, sf_dir):
    ev = agent_events(spark, sf_dir).drop("retention_days")
    return V.enrich_with_settings(ev, settings(spark, sf_dir)).groupBy("tenant_id", "retention_days", "redact", "residency").agg(F.count(F.lit(1)).alias("n"))


_add("V4_enrich_with_settings", _v4, oracle(
    "SELECT tenant_id, CAST(coalesce(n_nationkey * 100 + 30, 365) AS INTEGER) AS retention_days, coalesce(n_nationkey <> 2, true) AS redact, "
    "CASE WHEN n_nationkey % 2 = 0 THEN 'eu' ELSE 'us' END AS residency, count(*) AS n FROM agent_events LEFT JOIN nation ON tenant_id = 't_' || (n_nationkey * 2) GROUP BY 1, 2, 3, 4"))

# ---- redaction -----------------------------------------------------------

_RE2 = {
    "private_key_block": r"-----BEGIN (?:RSA |EC |OPENSSH |PGP )?PRIVATE KEY-----[\s\S]*?(?:-----END (?:RSA |EC |OPENSSH |PGP )?PRIVATE KEY-----|\z)",
    "bearer_token": r"\b[Bb]earer[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+[A-Za-z0-9._~+/-]{20,}=*",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b(?:\d[ -]?){13,19}\b",
    "phone": r"(?:\+\d{1,3}[ .-]?)?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}\b",
    "ipv4": r"\b(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\b",
}
_DIG = "regexp_replace(c, '[ -]', '', 'g')"
_LUHN = (f"len({_DIG}) BETWEEN 13 AND 19 AND list_sum(list_transform(string_split(reverse({_DIG}), ''), lambda ch, i: CASE WHEN i % 2 = 1 THEN CAST(ch AS INTEGER) "
         "WHEN CAST(ch AS INTEGER) > 4 THEN CAST(ch AS INTEGER) * 2 - 9 ELSE CAST(ch AS INTEGER) * 2 END)) % 10 = 0")


def redaction_sql(key, src, col="text"):
    """Stage by stage: count, then replace. Cards are put back together around their matches."""
    ctes, prev, counts = [], src, []
    for i, (kind, pattern, name, _) in enumerate(RECOGNISERS):
        pat = _RE2.get(kind, pattern)
        mark = f"[REDACTED:{name}]"
        carry = "".join(f", {c}" for c in counts)
        if kind == "credit_card":
            found = f"regexp_extract_all({col}, '{pat}')"
            ctes.append(f"r{i} AS (SELECT {key}{carry}, len(list_filter(found, lambda c: {_LUHN})) AS {kind}, CASE WHEN len(found) = 0 THEN {col} ELSE array_to_string(list_transform(list_zip(kept, "
                        f"list_transform(found, lambda c: CASE WHEN {_LUHN} THEN '{mark}' ELSE c END)), lambda z: z[1] || coalesce(z[2], '')), '') END AS {col} "
                        f"FROM (SELECT *, {found} AS found, regexp_split_to_array({col}, '{pat}') AS kept FROM {prev}))")
        else:
            ctes.append(f"r{i} AS (SELECT {key}{carry}, len(regexp_extract_all({col}, '{pat}')) AS {kind}, regexp_replace({col}, '{pat}', '{mark}', 'g') AS {col} FROM {prev})")
        counts.append(kind)
        prev = f"r{i}"
    return ", ".join(ctes), prev


def _v5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = redact_text(docs, "text", "n_")
    return out.select("doc_id", F.md5("text").alias("text_md5"), *[F.col(f"n_{k}").cast("long").alias(k) for k in RD.KINDS])


_stages, _last = redaction_sql("doc_id", "documents")
_add("V5_redact_text", _v5, f"WITH {_stages} SELECT doc_id, md5(text) AS text_md5, {', '.join(RD.KINDS)} FROM {_last}")


def _v6(spark, sf_dir):
    """Conversation turns as nested events: the role is structural (kind), the text and a list of its lines are not.

    The payload is free-form JSON of six levels with numbers, arrays in arrays, and objects below structural keys.
    """
    c = table(spark, sf_dir, "conversations")
    text, number = F.col("text"), F.lit(4111111111111111)
    leaf = F.struct(text.alias("name"), text.alias("said"), number.alias("n"), F.array(F.array(text)).alias("parts"))
    body = F.struct(
        text.alias("note"), text.alias("status"), F.struct(F.array(F.struct(F.struct(F.struct(leaf.alias("five")).alias("four")).alias("three"))).alias("two")).alias("one"),
        F.array(text, text).alias("model"), F.struct(F.struct(F.array(text).alias("list")).alias("deep")).alias("tool_name"))
    ev = c.select("conv_id", "turn", F.struct(text.alias("kind"), text.alias("body"), F.array("text").alias("lines")).alias("message"), F.to_json(body).alias("payload"))
    typed = RD.redact_events(RD.redact_payloads(ev, "payload", "found"), skip=("payload", "found"))
    j, five = F.col("payload"), "$.one.two[0].three.four.five"
    at = lambda path: F.md5(F.get_json_object(j, path))
    return typed.select(
        "conv_id", "turn", F.md5("message.kind").alias("kept"), F.md5("message.body").alias("body"), F.md5(F.col("message.lines")[0]).alias("line"),
        at("$.note").alias("note"), at("$.status").alias("status"), at(f"{five}.name").alias("deep_kept"), at(f"{five}.said").alias("deep"), at(f"{five}.parts[0][0]").alias("part"),
        F.get_json_object(j, f"{five}.n").alias("number"), at("$.model[1]").alias("listed"), at("$.tool_name.deep.list[0]").alias("below"),
        F.try_parse_json(j).isNotNull().alias("is_json"), F.coalesce(F.aggregate(F.map_values("found"), F.lit(0), lambda a, n: a + n), F.lit(0)).cast("long").alias("found"))


_cst, _cl = redaction_sql("conv_id, turn", "conversations")
_OLD, _NEW = "md5(c.text) AS ", "md5(r.text) AS "
_add("V6_redact_events", _v6, f"WITH {_cst} SELECT r.conv_id, r.turn, " + ", ".join(_OLD + n for n in ("kept", "status", "deep_kept", "listed")) + ", "
     + ", ".join(_NEW + n for n in ("body", "line", "note", "deep", "part", "below")) + f", '4111111111111111' AS number, true AS is_json, CAST(4 * ({' + '.join(RD.KINDS)}) AS BIGINT) AS found "
     f"FROM {_cl} r JOIN conversations c ON c.conv_id = r.conv_id AND c.turn = r.turn")

# ---- web events ----------------------------------------------------------


def web(spark, sf_dir):
    """Product events as web event documents; defects by event_id % 16."""
    ev = table(spark, sf_dir, "events")
    d = F.col("event_id") % 16
    kind = F.when(F.col("event_type") == "view", "page_view").otherwise(F.col("event_type"))
    category = F.when(F.col("event_type") == "view", "navigation").when(F.col("event_type") == "click", "engagement").when(
        F.col("event_type") == "error", "error").otherwise("conversion")
    k = F.get_json_object("props", "$.k").cast("int")
    props = F.struct(
        F.when((F.col("event_type") == "view") & (d != 3), F.lit("/home")).alias("page"), F.when(F.col("event_type") == "click", F.lit("btn")).alias("element"),
        F.when(F.col("event_type") == "purchase", F.lit("t1")).alias("transactionId"),
        F.when(F.col("event_type") == "purchase", F.when(d == 4, F.lit(-1.0)).otherwise(F.col("value"))).alias("amount"),
        F.when(F.col("event_type") == "purchase", F.when(d == 5, F.lit("EURO")).otherwise("EUR")).alias("currency"),
        F.when(F.col("event_type") == "error", F.lit("E")).alias("errorType"), F.when(F.col("event_type") == "error", F.lit("m")).alias("errorMessage"),
        F.when(d == 6, F.lit("secret")).alias("userPassword"), F.when(d == 7, F.lit(" <b>bold</b> ")).alias("label"), k.cast("string").alias("k"))
    body = F.struct(
        F.when(d != 0, F.col("user_id").cast("string")).alias("userId"), F.when(d != 1, F.concat(F.lit("s"), F.col("user_id").cast("string"))).otherwise("").alias("sessionId"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), F.when(d == 2, F.lit("teleport")).otherwise(kind).alias("type"),
        F.when(d == 8, F.lit("engagement")).otherwise(category).alias("category"),
        F.when(d == 9, F.repeat(F.lit("a"), 1001)).when(d == 10, F.lit("go<script>x()</script> <i>now</i>")).otherwise("act").alias("action"),
        F.when(d == 11, F.repeat(F.lit("z"), 10_000)).alias("label"), props.alias("properties"))
    return ev.select("event_id", "user_id", "ts", "event_type", F.to_json(body).alias("payload")).transform(_landed)


_W = "event_id % 16"
STRUCT = f"CASE {_W} WHEN 11 THEN 'size: too large' WHEN 0 THEN 'userId: missing' WHEN 1 THEN 'sessionId: missing' ELSE '' END"
SCHEMA = (f"concat_ws(';', CASE WHEN {_W} = 0 THEN 'userId: missing' END, CASE WHEN {_W} = 1 THEN 'sessionId: empty' END, CASE WHEN {_W} = 2 THEN 'type: not allowed' END, "
          f"CASE WHEN {_W} = 3 AND event_type = 'view' THEN 'properties.page: missing' END, CASE WHEN {_W} = 8 AND event_type IN ('view', 'purchase', 'error') THEN 'category: must be ' || "
          "CASE event_type WHEN 'view' THEN 'navigation' WHEN 'purchase' THEN 'conversion' ELSE 'error' END END, "
          f"CASE WHEN {_W} = 4 AND event_type = 'purchase' THEN 'properties.amount: too small' END, CASE WHEN {_W} = 5 AND event_type = 'purchase' THEN 'properties.currency: wrong length' END)")
RULES = (f"CASE WHEN {_W} = 2 THEN 'type: not allowed' WHEN {_W} = 9 THEN 'action: too long' WHEN {_W} = 4 AND event_type = 'purchase' THEN 'amount: not positive' ELSE '' END")
_add("V7_check_web_structure", lambda s, d: V.check_web_structure(web(s, d)).select("event_id", F.concat_ws(";", "structure_errors").alias("errors")),
     f"SELECT event_id, {STRUCT} AS errors FROM events")


def _v8(spark, sf_dir):
    """Sessions are user groups and the clock is compressed to hours, so that the limit bites."""
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("user_id") % 4, F.date_trunc("hour", "ts").alias("at"))
    ev = ev.toDF("event_id", "event_type", "grp", "at")
    return V.rate_limit_flags(ev, "grp", "event_type", "at", "event_id", 1).select("event_id", "rate_limited")


_add("V8_rate_limit_flags", _v8,
     "SELECT event_id, row_number() OVER (PARTITION BY user_id % 4, event_type, date_trunc('hour', ts) ORDER BY event_id) > 1 AS rate_limited FROM events")
_add("V9_check_web_schema", lambda s, d: V.check_web_schema(web(s, d)).select("event_id", F.concat_ws(";", "schema_errors").alias("errors")),
     f"SELECT event_id, {SCHEMA} AS errors FROM events")
_add("V10_check_business_rules", lambda s, d: V.check_business_rules(web(s, d)).select(
    "event_id", F.concat_ws(";", "rule_errors").alias("errors"), F.concat_ws(";", "warnings").alias("warnings")),
    f"SELECT event_id, {RULES} AS errors, '' AS warnings FROM events")


def _parsed(spark, sf_dir):
    w = web(spark, sf_dir)
    return w.select("event_id", "ts", "event_type", F.get_json_object("payload", "$.userId").alias("userId"), F.get_json_object("payload", "$.sessionId").alias("sessionId"),
                    F.get_json_object("payload", "$.type").alias("type"), F.get_json_object("payload", "$.action").alias("action"),
                    F.from_json(F.get_json_object("payload", "$.properties"), "map<string,string>").alias("properties"))


def _v11(spark, sf_dir):
    out = V.sanitize_events(_parsed(spark, sf_dir))
    return out.select("event_id", "action", "sanitized", F.size("properties").alias("n_props"), F.try_element_at("properties", F.lit("label")).alias("label"),
                      F.map_contains_key("properties", "userPassword").alias("has_password"))


_NPROPS = ("1 + CASE event_type WHEN 'view' THEN CASE WHEN event_id % 16 <> 3 THEN 1 ELSE 0 END WHEN 'click' THEN 1 WHEN 'purchase' THEN 3 WHEN 'error' THEN 2 ELSE 0 END + CASE WHEN event_id % 16 = 7 THEN 1 ELSE 0 END")
_add("V11_sanitize_events", _v11,
     f"SELECT event_id, CASE {_W} WHEN 9 THEN repeat('a', 1001) WHEN 10 THEN 'go now' ELSE 'act' END AS action, true AS sanitized, CAST({_NPROPS} AS INTEGER) AS n_props, "
     f"CASE WHEN {_W} = 7 THEN 'bold' END AS label, false AS has_password FROM events")


def _v12(spark, sf_dir):
    p = _parsed(spark, sf_dir).withColumn("id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("e"), F.col("event_id").cast("string")))).withColumn(
        "timestamp_ms", F.when(F.col("event_id") % 5 != 0, F.unix_millis(F.col("ts").cast("timestamp"))))
    own = F.struct(F.col("event_type").alias("channel"), F.lit(True).alias("processed"), F.array("type").alias("tags"), F.lit(None).cast("array<string>").alias("flags"))
    p = p.withColumn("metadata", F.when(F.col("event_id") % 7 != 0, own))
    out = V.enrich_web_events(p, F.lit(1704067200000), key=("event_id", "type"))
    return out.select("event_id", "id", "timestamp_ms", "metadata.processed", r6(F.col("metadata.quality")).alias("quality"), "metadata.channel",
                      F.concat_ws(",", "metadata.tags").alias("tags"), F.size("metadata.flags").alias("n_flags"))


_UID = "sha256(event_id || '|' || CASE WHEN event_id % 16 = 2 THEN 'teleport' WHEN event_type = 'view' THEN 'page_view' ELSE event_type END)"
_add("V12_enrich_web_events", _v12,
     f"SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'e' || event_id ELSE concat_ws('-', substr({_UID}, 1, 8), substr({_UID}, 9, 4), substr({_UID}, 13, 4), substr({_UID}, 17, 4), substr({_UID}, 21, 12)) END AS id, "
     "CASE WHEN event_id % 5 <> 0 THEN epoch_us(ts) // 1000 ELSE 1704067200000 END AS timestamp_ms, false AS processed, 1.0::DOUBLE AS quality, "
     "CASE WHEN event_id % 7 <> 0 THEN event_type END AS channel, CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 16 = 2 THEN 'teleport' WHEN event_type = 'view' THEN 'page_view' ELSE event_type END AS tags, "
     "0 AS n_flags FROM events")


def _v13(spark, sf_dir):
    w = V.check_business_rules(V.check_web_schema(V.check_web_structure(web(spark, sf_dir))))
    # stages stop at the first that fails: structure, rate limit, schema, business rules
    errs = F.when(F.size("structure_errors") > 0, F.col("structure_errors")).when(F.size("schema_errors") > 0, F.col("schema_errors")).otherwise(F.col("rule_errors"))
    w = w.withColumn("errors", errs).withColumn("rate_limited", F.lit(False)).withColumn("sanitized", F.lit(True))
    totals, kinds = V.validation_summary(w, "errors", ["event_type"])
    return totals.unpivot(["event_type"], ["total", "valid", "invalid", "rate_limited", "sanitized"], "measure", "n").unionByName(
        kinds.select("event_type", F.concat(F.lit("error "), "error").alias("measure"), "n"))


_ERR = f"CASE WHEN {STRUCT} <> '' THEN {STRUCT} WHEN {SCHEMA} <> '' THEN {SCHEMA} ELSE {RULES} END"
_add("V13_validation_summary", _v13,
     f"WITH e AS (SELECT event_type, {_ERR} AS err FROM events) SELECT event_type, 'total' AS measure, count(*) AS n FROM e GROUP BY 1 UNION ALL SELECT event_type, 'valid', count(*) FILTER (WHERE err = '') FROM e GROUP BY 1 "
     "UNION ALL SELECT event_type, 'invalid', count(*) FILTER (WHERE err <> '') FROM e GROUP BY 1 UNION ALL SELECT event_type, 'rate_limited', 0 FROM e GROUP BY 1 "
     "UNION ALL SELECT event_type, 'sanitized', count(*) FILTER (WHERE err = '') FROM e GROUP BY 1 "
     "UNION ALL SELECT event_type, 'error ' || split_part(x, ':', 1), count(*) FROM (SELECT event_type, unnest(string_split(err, ';')) AS x FROM e WHERE err <> '') GROUP BY 1, 2")


def _v14(spark, sf_dir):
    """An order as a finding: the price is cited, the tax figure is not, the id is no claim."""
    o = table(spark, sf_dir, "orders")
    price = F.format_string("$%.2f", "o_totalprice")
    share = F.format_string("%.1f%%", (F.col("o_custkey") % 100) / 7.0)
    prose = F.concat(F.lit("Order came to "), price, F.lit(" which is "), share, F.lit(" of run_"), F.col("o_orderkey").cast("string"), F.lit(".5 and v2.1 today"))
    f = o.select("o_orderkey", prose.alias("prose"), F.array(price).alias("vals"))
    return V.uncited_claims(f, F.col("prose"), F.col("vals")).select("o_orderkey", F.array_join("uncited", ";").alias("uncited"))


_add("V14_uncited_claims", _v14,
     "SELECT o_orderkey, CASE WHEN contains(p, s) THEN '' ELSE s END AS uncited FROM (SELECT o_orderkey, printf('$%.2f', o_totalprice) AS p, printf('%.1f%%', (o_custkey % 100) / 7.0::DOUBLE) AS s FROM orders)")

# ---- rows, dead letters, traces ------------------------------------------


def _s4(spark, sf_dir):
    rows = RW.to_event_rows(messages(spark, sf_dir), "payload")
    return rows.select("tenant_id", "event", "event_id", "task_id", "session_id", "agent_version", "tool_name", "status", r6(F.col("tokens_in")).alias("tokens_in"),
                       r6(F.col("cost_usd")).alias("cost_usd"), r6(F.col("rating_value")).alias("rating_value"), r6(F.col("edit_magnitude_value")).alias("edit_magnitude_value"), "retention_days",
                       F.unix_millis("timestamp").alias("at_ms"))


_MD = "md5(CAST(event_id AS VARCHAR))"
_UUID = f"concat_ws('-', substr({_MD}, 1, 8), substr({_MD}, 9, 4), substr({_MD}, 13, 4), substr({_MD}, 17, 4), substr({_MD}, 21, 12))"
_add("S04_to_event_rows", _s4, oracle(
    f"SELECT tenant_id, CASE {_D} WHEN 1 THEN 'Bad-Name' WHEN 5 THEN 'checkout_done' ELSE event END AS event, {_UUID} AS event_id, task_id, session_id, agent_version, tool_name, "
    f"CASE WHEN event = 'step_executed' AND {_D} = 7 THEN 'weird' ELSE status END AS status, CASE WHEN event = 'step_executed' AND {_D} = 8 THEN 1.5 ELSE tokens_in END AS tokens_in, "
    f"round(cost_usd, 6) AS cost_usd, rating_value, edit_magnitude_value, CAST(CASE {_D} WHEN 10 THEN 3650 WHEN 11 THEN 1 ELSE retention_days END AS INTEGER) AS retention_days, "
    f"epoch_us(timestamp) // 1000 AS at_ms FROM agent_events WHERE {_D} NOT IN (0, 2, 3, 4, 6)"))


def _s5(spark, sf_dir):
    rows, dead = RW.split_dead_letters(messages(spark, sf_dir), "payload")
    return dead.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).unionByName(rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit("mapped").alias("reason"), "n"))


_add("S05_split_dead_letters", _s5, oracle(
    f"SELECT CASE {_D} WHEN 0 THEN 'unmappable: task_id' WHEN 2 THEN 'unmappable: event_id' WHEN 3 THEN 'unmappable: timestamp' WHEN 4 THEN 'unmappable: agent.name' WHEN 6 THEN 'unparsable' ELSE 'mapped' END AS reason, "
    "count(*) AS n FROM agent_events GROUP BY 1"))


def payloads(spark, sf_dir, events=None):
    """Each event as an OTLP payload of one span: steps carry gen_ai attributes, ends an outcome, the rest neither."""
    ev = agent_events(spark, sf_dir, events)
    s = lambda key, v: F.when(v.isNotNull(), F.struct(F.lit(key).alias("key"), F.struct(v.cast("string").alias("stringValue"), F.lit(None).cast("string").alias("intValue")).alias("value")))
    i = lambda key, v: F.when(v.isNotNull(), F.struct(F.lit(key).alias("key"), F.struct(F.lit(None).cast("string").alias("stringValue"), v.cast("long").cast("string").alias("intValue")).alias("value")))
    step = F.col("event") == "step_executed"
    end = F.col("event").isin("task_completed", "task_failed", "task_abandoned")
    attrs = F.array_compact(F.array(
        s("gen_ai.request.model", F.when(step & (F.col("model") != ""), F.col("model"))), s("gen_ai.tool.name", F.when(step & (F.col("tool_name") != ""), F.col("tool_name"))),
        i("gen_ai.usage.input_tokens", F.when(step, F.col("tokens_in"))), s("gen_ai.system", F.when(step, F.lit("x"))),
        s("agent.outcome", F.when(end, F.substring("event", 6, 20))), s("agent.task_id", F.when(F.col("event_id") % 2 == 0, F.col("task_id"))), s("agent.task_type", F.when(F.col("event_id") % 3 == 0, F.col("task_type")))))
    us = F.unix_micros(F.col("timestamp").cast("timestamp"))
    span = F.struct(
        F.md5(F.concat(F.lit("t"), F.col("event_id").cast("string"))).alias("traceId"), F.substring(F.md5(F.col("event_id").cast("string")), 1, 16).alias("spanId"),
        F.when(step, F.lit("p1")).alias("parentSpanId"), F.concat(F.lit("span "), F.col("event")).alias("name"),
        F.concat(us.cast("string"), F.lit("000")).alias("startTimeUnixNano"), F.concat((us + F.floor(F.col("latency_ms")) * 1000).cast("string"), F.lit("000")).alias("endTimeUnixNano"),
        attrs.alias("attributes"), F.struct(F.when(F.col("status") == "error", 2).otherwise(1).alias("code")).alias("status"))
    body = F.struct(F.array(F.struct(
        F.struct(F.array(s("service.name", F.when(F.col("agent_name") != "agent_0", F.col("agent_name")))).alias("attributes")).alias("resource"),
        F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans"))
    return ev.select("tenant_id", "event_id", F.to_json(body).alias("payload")).transform(_landed)


def _s8(spark, sf_dir):
    e = OT.otlp_to_events(payloads(spark, sf_dir), keep=("tenant_id",))
    return e.select("tenant_id", "event", "event_id", "timestamp", "task_id", "task_type", "agent_name", "step_type", "model", "tool_name", r6(F.col("tokens_in")).alias("tokens_in"),
                    "latency_ms", "status", F.try_element_at("otel_attributes", F.lit("gen_ai.system")).alias("system"), "initiator", "verification", "duration_ms", "abandoned_by")


_TR = "md5('t' || CAST(event_id AS VARCHAR))"
_SHA = "sha256(" + _TR + " || '|' || substr(" + _MD + ", 1, 16) || '|' || {0})"


def _oid(ev):
    h = _SHA.format(ev)
    return f"concat_ws('-', substr({h}, 1, 8), substr({h}, 9, 4), substr({h}, 13, 4), substr({h}, 17, 4), substr({h}, 21, 12))"


_COMMON = (f"CASE WHEN event_id % 2 = 0 THEN task_id ELSE {_TR} END AS task_id, CASE WHEN event_id % 3 = 0 THEN task_type ELSE 'span ' || event END AS task_type, "
           "CASE WHEN agent_name = 'agent_0' THEN 'unknown-agent' ELSE agent_name END AS agent_name")


def _iso(us):
    return f"strftime(make_timestamp((({us}) // 1000) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


_US = "epoch_us(timestamp)"
_END_US = "epoch_us(timestamp) + CAST(floor(latency_ms) AS BIGINT) * 1000"
_NULLS = lambda *names: ", ".join(f"NULL AS {n}" for n in names)
_ISEND = "event IN ('task_completed', 'task_failed', 'task_abandoned')"
_add("S08_otlp_to_events", _s8, oracle(
    f"SELECT tenant_id, event, {_oid('event')} AS event_id, {_iso(_END_US)} AS timestamp, {_COMMON}, CASE WHEN model <> '' THEN 'llm_call' ELSE 'tool_call' END AS step_type, "
    "nullif(model, '') AS model, nullif(tool_name, '') AS tool_name, tokens_in, CAST(floor(latency_ms) AS BIGINT) AS latency_ms, CASE WHEN status = 'error' THEN 'error' ELSE 'ok' END AS status, 'x' AS system, "
    f"{_NULLS('initiator', 'verification', 'duration_ms', 'abandoned_by')} FROM agent_events WHERE event = 'step_executed' "
    f"UNION ALL SELECT tenant_id, 'task_started', {_oid(chr(39) + 'task_started' + chr(39))}, {_iso(_US)}, {_COMMON}, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'api', NULL, NULL, NULL FROM agent_events WHERE {_ISEND} "
    f"UNION ALL SELECT tenant_id, event, {_oid('event')}, {_iso(_END_US)}, {_COMMON}, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN event = 'task_completed' THEN 'self_reported' END, CAST(floor(latency_ms) AS BIGINT), "
    f"CASE WHEN event = 'task_abandoned' THEN 'system' END FROM agent_events WHERE {_ISEND}"))


def _g10(spark, sf_dir):
    """Labels as score documents; every fifth has a value above 1, every seventh no model version."""
    lab = table(spark, sf_dir, "labels")
    d = F.col("doc_id")
    body = F.struct(
        F.struct(d.cast("string").alias("task_id"), F.lit("r").alias("run_id")).alias("trace_ref"),
        F.struct(F.lit("e").alias("id"), F.when(d % 11 == 0, "robot").otherwise("human").alias("kind"), F.lit("rb").alias("rubric_hash")).alias("evaluator"),
        F.struct(F.lit("p").alias("prompt_version"), F.when(d % 7 != 0, F.lit("m")).alias("model_version"), F.lit("a").alias("agent_version")).alias("versions"),
        F.when(d % 5 == 0, F.col("quality") + 1.5).otherwise(F.col("quality").cast("double")).alias("value"))
    return V.validate_scores(lab.select("doc_id", F.to_json(body).alias("payload"))).select("doc_id", F.concat_ws(";", "reasons").alias("reasons"))


_add("G10_validate_scores", _g10,
     "SELECT doc_id, concat_ws(';', CASE WHEN doc_id % 11 = 0 THEN 'evaluator.kind: not allowed' END, CASE WHEN doc_id % 7 = 0 THEN 'versions.model_version: missing' END, CASE WHEN doc_id % 5 = 0 THEN 'value: too large' END) AS reasons FROM labels")
