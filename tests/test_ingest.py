import json
import math
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.jsonrules import flatten_json
from tallyloom.functions.redaction import may_match, redact_text, redacted
from tallyloom.operators import funnels
from tallyloom.operators import lifecycle as L
from tallyloom.operators import metrics as M
from tallyloom.operators import validate as V
from tallyloom.operators.redact import redact_events, redact_json, redact_payloads, redaction_counts
from tallyloom.sources import events as S
from tallyloom.sources import otlp as OT
from tallyloom.sources import rows as RW
from tallyloom.streaming import jobs as J
from tallyloom.streaming import sink as K

GOOD = {"event": "task_started", "event_id": "0b0e7a1c-2f3d-4c5b-8a9e-1f2d3c4b5a69", "schema_version": "0.1.0", "timestamp": "2024-01-01T10:00:00.000Z",
        "task_id": "k", "run_id": "r", "task_type": "x", "agent": {"name": "a"}, "initiator": "human"}


def docs(spark, *objects):
    return spark.createDataFrame([(i, "t", o if isinstance(o, str) else json.dumps(o)) for i, o in enumerate(objects)], "i int, tenant_id string, payload string")


def text(spark, s):
    return spark.createDataFrame([(s,)], "s string").select(redacted(F.col("s")).alias("r")).collect()[0]["r"]


@pytest.mark.parametrize("raw, want", [
    ("mail jo.doe+x@example.co.uk now", "mail [REDACTED:email] now"),
    ("card 4111 1111 1111 1111.", "card [REDACTED:credit_card]."),
    ("order 4111 1111 1111 1112.", "order 4111 1111 1111 1112."),
    ("call (555) 123-4567", "call [REDACTED:phone]"),
    ("ssn 123-45-6789", "ssn [REDACTED:ssn]"),
    ("host 10.0.0.255 up, v1.2.3", "host [REDACTED:ip] up, v1.2.3"),
    ("AKIA" + "A" * 16, "[REDACTED:aws_access_key]"),
    ("Bearer " + "a" * 24, "[REDACTED:bearer_token]"),
    ("xoxb-" + "1" * 12 + "@example.org", "[REDACTED:slack_token]@example.org"),
    ("-----BEGIN PRIVATE KEY-----\nabc\n-----END PRIVATE KEY-----!", "[REDACTED:private_key]!"),
    ("-----BEGIN RSA PRIVATE KEY-----\nabc, cut off", "[REDACTED:private_key]"),
])
def test_recognisers(spark, raw, want):
    assert text(spark, raw) == want


def test_counts_ignore_placeholders_that_were_there(spark):
    df = spark.createDataFrame([("a@b.io and [REDACTED:email] and c@d.io",)], "s string")
    r = redact_text(df, "s", "n_").collect()[0]
    assert r["n_email"] == 2 and r["n_ssn"] == 0 and r["s"].count("[REDACTED:email]") == 3


def test_structural_keys_survive(spark):
    obj = {"tool_name": "a@b.io", "note": "a@b.io", "n": 1.50, "nested": {"status": "a@b.io", "text": "a@b.io", "list": ["a@b.io", 3]}, "q": 'say "a@b.io"\n'}
    r = docs(spark, obj).select(redact_json(F.col("payload")).alias("out"), redaction_counts(F.col("payload"), redact_json(F.col("payload"))).alias("c")).collect()[0]
    out = json.loads(r["out"])
    mark = "[REDACTED:email]"
    assert out["tool_name"] == "a@b.io" and out["note"] == mark and out["n"] == 1.5
    assert out["nested"] == {"status": "a@b.io", "text": mark, "list": [mark, 3]} and out["q"] == f'say "{mark}"\n'
    assert r["c"] == {"email": 4}
    typed = spark.createDataFrame([(("a@b.io", ["a@b.io"]),)], "m struct<name:string,notes:array<string>>")
    assert redact_events(typed).collect()[0]["m"] == ("a@b.io", [mark])


def test_core_and_product_rules(spark):
    bad = [GOOD, {**GOOD, "initiator": "robot"}, {**GOOD, "event": "Not Snake"}, {**GOOD, "event": "checkout", "extra": 1}, {**GOOD, "timestamp": "2024-01-01"},
           {k: v for k, v in GOOD.items() if k != "agent"}, "{broken", "[1]", {**GOOD, "task_id": 5}, {**GOOD, "session_id": None}, {**GOOD, "agent": {"name": ""}}]
    got = {r["i"]: (r["reasons"], r["reason_class"]) for r in V.validate_events(docs(spark, *bad)).collect()}
    assert got[0] == ([], None) and got[3] == ([], None)
    assert got[1] == (["initiator: not allowed"], "schema_validation")
    assert got[2] == (["event: not snake_case"], "invalid_event_name")
    assert got[4][0] == ["timestamp: not a datetime with offset"] and got[5][0] == ["agent: missing"]
    assert got[6][1] == got[7][1] == "schema_validation"
    assert got[8][0] == ["task_id: wrong type"] and got[9][0] == ["session_id: wrong type"] and got[10][0] == ["agent.name: empty"]


def test_row_mapping_and_dead_letters(spark):
    msgs = [{**GOOD, "tenant_id": "t", "retention_days": 99999, "tokens_in": "7", "tool_name": 3, "rating": {"value": 2}}, GOOD, {**GOOD, "tenant_id": "t", "event_id": "x"}, "nope"]
    rows, dead = RW.split_dead_letters(docs(spark, *msgs), "payload")
    r = rows.collect()
    assert len(r) == 1 and r[0]["retention_days"] == 3650 and r[0]["tokens_in"] == 0.0 and r[0]["tool_name"] == "" and r[0]["rating_value"] == 2.0 and r[0]["agent_version"] == ""
    assert sorted(d["reason"] for d in dead.collect()) == ["unmappable: event_id", "unmappable: tenant_id", "unparsable"]


def test_trace_mapping(spark):
    attr = lambda k, v: {"key": k, "value": {"stringValue": v} if isinstance(v, str) else {"intValue": str(v)}}
    span = lambda sid, parent, attrs, **kw: {"traceId": "tr", "spanId": sid, "parentSpanId": parent, "name": sid, "startTimeUnixNano": "1704067200000000000",
                                             "endTimeUnixNano": "1704067201500000000", "attributes": attrs, **kw}
    p = {"resourceSpans": [{"resource": {"attributes": [attr("service.name", "sdr")]}, "scopeSpans": [{"spans": [
        span("root", "", [attr("agent.outcome", "completed"), attr("agent.task_type", "reply")]),
        span("llm", "root", [attr("gen_ai.request.model", "m"), attr("gen_ai.usage.input_tokens", 12), attr("gen_ai.system", "old"), attr("gen_ai.system", "new")], status={"code": 2}),
        span("odd", "root", [attr("x", "y")])]}]}]}
    d = docs(spark, p, p)
    ev = OT.otlp_to_events(d).collect()
    assert len(ev) == 6 and len({e["event_id"] for e in ev}) == 3  # a retry gives the same ids
    by = {e["event"]: e for e in ev}
    step = by["step_executed"]
    assert (step["model"], step["tokens_in"], step["latency_ms"], step["status"], step["step_type"]) == ("m", 12.0, 1500, "error", "llm_call")
    assert step["otel_attributes"] == {"gen_ai.system": "new"} and step["task_type"] == "reply" and step["agent_name"] == "sdr"
    assert by["task_started"]["timestamp"] == "2024-01-01T00:00:00.000Z" and by["task_completed"]["steps_total"] == 3
    assert [u["span"] for u in OT.unmapped_spans(d).collect()] == ["odd", "odd"]


def test_sanitizer(spark):
    s = spark.createDataFrame([("<b>x</b><script>a<b</script> ",)], "a string").select(V.clean_text(F.col("a")).alias("a")).collect()[0]["a"]
    assert s == "x"


def test_uncited_claims(spark):
    f = spark.createDataFrame([("TSR is 61.2% and 3.5 more, see run_4.25, v1.2 and $9.99", ["61.2%"])], "p string, v array<string>")
    assert V.uncited_claims(f, F.col("p"), F.col("v")).collect()[0]["uncited"] == ["3.5", "$9.99"]


def _event_files(spark, make_events, path, n=3):
    ev = make_events([{"event": e, "session_id": f"s{i % 2}", "cost_usd": 1} for i, e in enumerate(["task_completed", "task_failed", "step_executed"] * 10)])
    ev = ev.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    for i in range(n):
        ev.where(F.pmod(F.hash("event_id"), F.lit(n)) == i).coalesce(1).write.mode("append").parquet(path)
    return ev


def test_streams_restart_and_equal_batch(spark, make_events):
    d = tempfile.mkdtemp(prefix="run-")
    ev = _event_files(spark, make_events, f"{d}/in")
    src = lambda: J.event_stream(spark, f"{d}/in", ev.schema, "parquet", maxFilesPerTrigger="1")
    K.run_to_table(J.rollup_stream(src()), f"{d}/out", f"{d}/cp", "update")
    read = lambda: K.latest_per_key(K.read_batches(spark, f"{d}/out"), ["tenant_id", "task_type", "day"])
    want = [tuple(r) for r in M.daily_rollup_build(ev).collect()]
    assert sorted(tuple(r) for r in read().collect()) == sorted(want)
    K.run_to_table(J.rollup_stream(src()), f"{d}/out", f"{d}/cp", "update")  # restart: nothing new
    assert sorted(tuple(r) for r in read().collect()) == sorted(want)
    ev.coalesce(1).write.mode("append").parquet(f"{d}/in")  # redelivery
    K.run_to_table(J.dedupe_stream(src(), "1 hour"), f"{d}/dd", f"{d}/cp2")
    assert K.read_batches(spark, f"{d}/dd").count() == 30


def test_ingest_batch_replay(spark):
    d = tempfile.mkdtemp(prefix="run-")
    settings = V.settings_table(spark, [("t", 30, True, "eu")])
    batch = docs(spark, {**GOOD, "note": "a@b.io", "tenant_id": "forged"}, {**GOOD, "initiator": "robot"})
    for _ in range(2):
        J.ingest_batch(spark, batch, 0, settings, d)
    J.ingest_batch(spark, batch, 1, settings, d)  # the same messages under a new batch id fold at read
    rows = S.dedupe_events(K.read_batches(spark, f"{d}/events")).collect()
    assert len(rows) == 1 and rows[0]["tenant_id"] == "t" and rows[0]["store"] == "eu" and rows[0]["retention_days"] == 30
    assert "[REDACTED:email]" in rows[0]["payload"] and "a@b.io" not in rows[0]["payload"] and "forged" not in rows[0]["payload"]
    assert K.read_batches(spark, f"{d}/rejections").where("batch_id = 0").collect()[0]["rejected"] == 1


def test_erasure_and_retention_in_place(spark, make_events):
    d = tempfile.mkdtemp(prefix="run-")
    rows = [{"event": "task_completed", "timestamp": f"2024-0{m}-15 00:00:00", "session_id": s} for m in (1, 2, 3) for s in ("a", "a", "b")]
    rows = [r for r in rows if not (r["timestamp"].startswith("2024-02") and r["session_id"] == "b")]
    S.write_event_table(make_events(rows).withColumn("retention_days", F.lit(365)), d)
    touched = L.rewrite_table(spark, d, F.col("session_id") != "a")
    assert touched == ["2024-01", "2024-02", "2024-03"]
    left = S.read_event_table(spark, d).collect()
    assert len(left) == 2 and {r["session_id"] for r in left} == {"b"}
    assert L.rewrite_table(spark, d, L.alive(F.lit("2025-02-01 00:00:00").cast("timestamp_ntz"))) == ["2024-01"]


def test_rollup_after_erasure_equals_raw(spark, make_events):
    ev = make_events([{"event": "task_completed", "session_id": s, "cost_usd": 1} for s in ("a", "a", "b")])
    req = spark.createDataFrame([("t", "a")], "tenant_id string, session_id string")
    rollup = L.erase_end_users_from_rollup(M.daily_rollup_build(ev), ev, req)
    assert L.reconcile_rollup(rollup, L.erase_end_users(ev, req)).count() == 0
    assert rollup.collect()[0]["completed"] == 1


def test_content_token_ignores_order(spark):
    a = spark.range(100).withColumn("x", F.col("id") * 2)
    t = lambda df: S.content_token(df).collect()[0]["token"]
    assert t(a) == t(a.repartition(7).orderBy(F.desc("id"))) != t(a.where("id < 99"))


def test_numbers_beyond_their_type_do_not_stop_the_job(spark):
    from pyspark.sql import functions as F
    from tallyloom.sources.otlp import map_spans
    from tallyloom.sources.rows import map_messages

    message = ('{"schema_version":"1.0","event":"task_started","event_id":"3f2504e0-4f89-41d3-9a0c-0305e82c3301","tenant_id":"t","task_id":"k","run_id":"r",'
               '"task_type":"x","timestamp":"2024-01-01T00:00:00Z","agent":{"name":"a"},"retention_days":%s}')
    rows = spark.createDataFrame([(message % n,) for n in ("99999999999", "1e300", "-5")], "value string")
    got = [r.d for r in map_messages(rows).select(F.col("row.retention_days").alias("d")).collect()]
    assert len(got) == 3 and all(d is None or 1 <= d <= 3650 for d in got)

    span = '{"resourceSpans":[{"scopeSpans":[{"spans":[{"traceId":"t","spanId":"s","name":"chat","startTimeUnixNano":"oops","endTimeUnixNano":"1","attributes":[{"key":"gen_ai.operation.name","value":{"stringValue":"chat"}}]}]}]}]}'
    out = map_spans(spark.createDataFrame([(span,)], "payload string")).collect()
    assert len(out) == 1 and out[0].events is None and out[0].reason


def test_structural_key_spares_strings_only(spark):
    from tallyloom.operators.redact import redact_events

    df = spark.sql("SELECT map('reason', named_struct('note', 'mail a.b@example.org')) AS props")
    assert "example.org" not in str(redact_events(df).first().props)


def test_rolling_window_keeps_every_reading(spark):
    from pyspark.sql import functions as F
    from tallyloom.operators.rolling import rolling_aggregate

    df = spark.range(1500).select(F.lit("m").alias("name"), F.timestamp_millis(F.col("id") * 10 + 1704067200000).cast("timestamp_ntz").alias("ts"), F.lit(1.0).alias("value"))
    got = rolling_aggregate(df, "name", "ts", "value").agg(F.max("count"), F.max("sum")).first()
    assert tuple(got) == (1500, 1500.0)


def plain_redaction(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").distinct()
    return {r["t"]: r["r"] for r in df.select("t", redacted(F.col("t")).alias("r")).collect()}


def walked(value, key, change):
    from tallyloom.functions.redaction import STRUCTURAL_KEYS

    if isinstance(value, str):
        return value if key in STRUCTURAL_KEYS else change(value)
    if isinstance(value, list):
        return [walked(v, key, change) for v in value]
    if isinstance(value, dict):
        return {k: walked(v, k, change) for k, v in value.items()}
    return value


def test_redaction_at_any_depth(spark):
    """Against a recursive walk: six levels and more, numbers like cards, key blocks, escapes, odd keys, arrays below structural keys."""
    mail, card, block = "to a.b@c.io \\ \"x\" é\n{[", "4111 1111 1111 1111", "-----BEGIN PRIVATE KEY-----\nabc"
    deep = {"n": 4111111111111111, "said": mail, "name": mail, "source": [mail, [mail, {"q": [mail]}, mail], {"name": mail}]}
    for k in ("six", "five", "na.me", "", "mo\"del", "a:b"):
        deep = {k: [deep, block, [mail]], "x\\": card, "status": {"y": block}}
    objects = [deep, {"model": [], "a": {}, "b": [mail]}, {"name": [[mail], {"k": mail}], "b": mail}, {"\u0001": mail, "v": "\u0002\u0001"}, {}, {"event": mail, "kinds": [mail]}]
    found: set = set()
    for o in objects:
        walked(o, None, lambda t: found.add(t) or t)
    plain = plain_redaction(spark, found)
    texts = [json.dumps(o, ensure_ascii=bool(i % 2), indent=(None, 1)[i % 2]) for i, o in enumerate([*objects, *objects[:3]])] + [f'{{"na\\u006de": "{card}", "b" : "{card}"}}', f"no json {card}", None, "[1]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, p string")
    got = [r["p"] for r in redact_payloads(df, "p", "c").orderBy("i").collect()]
    for text, out in zip(texts[:-4], got):
        assert json.loads(out) == walked(json.loads(text), None, plain.get)
    assert json.loads(got[-4]) == {"name": card, "b": "[REDACTED:credit_card]"}
    assert got[-3:] == ["no json [REDACTED:credit_card]", None, "[1]"]
    counts = [r["c"] for r in redact_payloads(df, "p", "c").orderBy("i").collect()]
    assert counts[1] == {"email": 1} and counts[5] == {"email": 1} and counts[-4] == {"credit_card": 1}


def test_keys_with_dots_are_seen(spark):
    from tallyloom.functions.jsonrules import flatten_json

    row = docs(spark, {"a.b": 1, "a": {"b": 2, "c.d": 3}}).select(flatten_json(F.try_parse_json("payload")).alias("f")).collect()[0]["f"]
    assert {k: v["n"] for k, v in row.items() if v["n"] is not None} == {r"a\.b": 1.0, "a.b": 2.0, r"a.c\.d": 3.0}


SETTINGS = "tenant_id string, retention_days int, redact boolean, residency string"


def test_replayed_batch_reads_no_rows_and_writes_none(spark, make_events, tmp_path):
    """The same rows in another order under a new id are recognised by their token; other months are not read."""
    d = str(tmp_path / "t")
    jan, feb = make_events([{"timestamp": "2024-01-05 00:00:00"}] * 3), make_events([{"event_id": f"f{i}", "timestamp": "2024-02-05 00:00:00"} for i in range(3)])
    assert J.write_events_idempotent(spark, jan, d, 0) and J.write_events_idempotent(spark, jan, d, 0)
    assert J.write_events_idempotent(spark, feb, d, 1)
    assert not J.write_events_idempotent(spark, jan.orderBy(F.desc("event_id")), d, 2)
    spoilt = next(p for p in (tmp_path / "t" / "batch_id=0" / "month=2024-01").glob("part-*"))
    spoilt.write_bytes(b"no table")  # a batch of February never looks at January
    assert J.write_events_idempotent(spark, feb.unionByName(make_events([{"event_id": "g", "timestamp": "2024-02-06 00:00:00"}])), d, 3)
    assert [r["event_id"] for r in spark.read.parquet(f"{d}/batch_id=3").collect()] == ["g"]


def test_last_copy_in_a_batch_wins(spark, tmp_path):
    msgs = [json.dumps({**GOOD, "note": n}) for n in ("first", "second", "third")]
    batch = spark.createDataFrame([("t", m) for m in msgs], "tenant_id string, payload string").coalesce(1)
    J.ingest_batch(spark, batch, 0, spark.createDataFrame([], SETTINGS), str(tmp_path))
    rows = K.read_batches(spark, f"{tmp_path}/events").collect()
    assert len(rows) == 1 and "third" in rows[0]["payload"]


def test_spans_land_as_rows_and_come_again_without_copies(spark, tmp_path):
    attr = lambda k, v: {"key": k, "value": {"stringValue": v} if isinstance(v, str) else {"intValue": str(v)}}
    span = lambda sid, parent, attrs: {"traceId": "tr", "spanId": sid, "parentSpanId": parent, "name": "call", "startTimeUnixNano": "1704067200000000000", "endTimeUnixNano": "1704067201500000000", "attributes": attrs}
    p = json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [
        span("root", "", [attr("agent.outcome", "failed")]), span("llm", "root", [attr("gen_ai.request.model", "m"), attr("gen_ai.usage.input_tokens", 12), attr("gen_ai.prompt", "ask a.b@c.io")]),
        span("odd", "root", [])]}]}]})
    batch = spark.createDataFrame([("t", p), ("u", p)], "tenant_id string, payload string")
    settings = spark.createDataFrame([("t", 30, True, "eu")], SETTINGS)
    for i in (0, 1):
        J.ingest_spans_batch(spark, batch.orderBy(F.desc("tenant_id")) if i else batch, i, settings, str(tmp_path))
    rows = K.read_batches(spark, f"{tmp_path}/events").collect()
    assert len(rows) == 6 and {(r["tenant_id"], r["event"], r["store"]) for r in rows} == {(t, e, s) for t, s in (("t", "eu"), ("u", "us")) for e in ("task_started", "task_failed", "step_executed")}
    step = next(r for r in rows if r["event"] == "step_executed" and r["tenant_id"] == "t")
    assert step["tokens_in"] == 12 and step["model"] == "m" and "a.b@c.io" not in step["payload"] and "[REDACTED:email]" in step["payload"]
    bad = K.read_batches(spark, f"{tmp_path}/rejections").where("batch_id = 0").collect()
    assert sorted((r["tenant_id"], r["reason_class"], r["rejected"]) for r in bad) == [("t", "unmapped_span", 1), ("u", "unmapped_span", 1)]


def test_a_batch_of_one_partition_is_spread_over_the_cores(spark):
    batch = spark.range(100).select(F.lit("t").alias("tenant_id"), F.col("id").cast("string").alias("payload")).coalesce(1)
    spread = J._spread(batch)
    assert spread.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert [r["payload"] for r in spread.orderBy("_at").collect()] == [str(i) for i in range(100)]


def test_a_batch_with_empty_parts_is_spread_over_the_cores(spark, tmp_path):
    spark.range(4000).select(F.lit("t").alias("tenant_id"), F.sha2(F.col("id").cast("string"), 256).alias("payload")).coalesce(1).write.parquet(str(tmp_path / "b"))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        # the one row group is cut in many parts by bytes, and one of them holds the rows
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        batch = spark.read.parquet(str(tmp_path / "b"))
        filled = lambda df: df.select(F.spark_partition_id()).distinct().count()
        assert batch.rdd.getNumPartitions() >= 4 and filled(batch) < 4
        assert filled(J._spread(batch)) >= 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_rules_and_message_fields_are_compiled(spark):
    """Filters and transforms by a function read the expressions in them one by one, for every message."""
    d = docs(spark, GOOD)
    for df in (V.validate_events(d).select("reasons"), RW.map_messages(d, "payload").select("row")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "lambdafunction" not in plan


def test_picked_fields_are_those_of_the_flattened_document(spark):
    from tallyloom.functions.jsonrules import Picked, pick_fields

    values = ["x", "", 0, -1.5, 1e300, 10**25, True, None, [], [1], {}, {"b": "y"}, {"b": None, "a.b": 1}]
    raw = [{"a": v} for v in values] + [{"a.b": "z"}, {"a": {"b": 2, "c.d": 3}, "a.b": 1}, {}, "[]", "x", '{"a":1,"a":2}', '{"a":1']
    d = pick_fields(docs(spark, *raw), "p", F.try_parse_json("payload"), ("a", "a.b"))
    doc, flat = Picked(F.col("p")), flatten_json(F.try_parse_json("payload"))
    for path in ("a", "a.b"):
        f = F.try_element_at(flat, F.lit(path))
        rows = d.select(
            F.struct(F.col("p").isNull(), F.regexp_extract(doc.kind(path), "^[A-Z]+", 0), doc.text(path), doc.number(path)).alias("new"),
            F.struct(flat.isNull(), f["t"], F.when(f["t"] == "STRING", f["s"]), f["n"]).alias("old")).collect()
        assert len(rows) == len(raw) and [tuple(r["new"]) for r in rows] == [tuple(r["old"]) for r in rows]


def test_ids_that_look_like_finds_spare_the_cutting_and_texts_beside_them_do_not(spark):
    number = "4111111111111111"
    cases = ['{"run_id":"%s","x":"y"}', '{"run_id":"%s","x":"mail a.b@c.io"}', '{"x":"%s"}', '{"a":{"name" : "%s"}}', '{"a":["run_id","%s"]}', '{"run_id":["%s"]}',
             '{"run_id":{"x":"%s"}}', '{"x":"run_id","y":"%s"}', '{"x":"\\"run_id\\":\\"%s"}', '{"run_id":"%s"']
    got = [r[0] for r in docs(spark, *[c % number for c in cases]).select("i", redact_json(F.col("payload")).alias("r")).orderBy("i").select("r").collect()]
    spared = (0, 1, 3, 5)
    mark = "[REDACTED:credit_card]"
    assert got == [(c % (number if i in spared else mark)).replace("a.b@c.io", "[REDACTED:email]") for i, c in enumerate(cases)]


def test_spans_are_mapped_once_for_messages_and_reasons(spark, tmp_path, monkeypatch):
    calls, plain = [], OT.map_spans
    monkeypatch.setattr(OT, "map_spans", lambda *a, **k: calls.append(1) or plain(*a, **k))
    attr = lambda k, v: {"key": k, "value": {"stringValue": v}}
    span = lambda sid, attrs, start="1704067200000000000": {"traceId": "tr", "spanId": sid, "name": "call", "startTimeUnixNano": start, "endTimeUnixNano": "1704067201500000000", "attributes": attrs}
    spans = [span("a", [attr("agent.outcome", "completed")]), span("b", [attr("gen_ai.tool.name", "x")]), span("c", []), span("d", [attr("gen_ai.tool.name", "x")], "soon"), span("b", [attr("gen_ai.tool.name", "y")])]
    p = json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": spans}]}]})
    batch = spark.createDataFrame([("t", p), (None, p), ("t", "no json"), ("t", None)], "tenant_id string, payload string")
    out = OT.span_outcomes(batch, keep=("tenant_id",))
    key = lambda rows: sorted(map(str, rows))
    assert key(out.where("payload IS NOT NULL").select("tenant_id", "payload").collect()) == key(OT.span_messages(batch, keep=("tenant_id",)).collect())
    assert key(out.where("payload IS NULL").select("tenant_id", "reason").collect()) == key(OT.unmapped_spans(batch, keep=("tenant_id",)).select("tenant_id", "reason").collect())
    calls.clear()
    J.ingest_spans_batch(spark, batch.where("tenant_id = 't'").limit(1), 0, spark.createDataFrame([], SETTINGS), str(tmp_path))
    rows = K.read_batches(spark, f"{tmp_path}/events").collect()
    assert len(calls) == 1 and sorted(r["event"] for r in rows) == ["step_executed", "task_completed", "task_started"]
    assert next(r["tool_name"] for r in rows if r["event"] == "step_executed") == "y"  # of equal spans in a payload the last wins
    assert [r["rejected"] for r in K.read_batches(spark, f"{tmp_path}/rejections").collect()] == [2]


@pytest.mark.parametrize("leaf", [
    "jo@example.org", "4111 1111 1111 1111", "(555) 123-4567", "123-45-6789", "10.0.0.255", "AKIA" + "A" * 16, "ghp_" + "a" * 36, "sk-ant-" + "a" * 12,
    "sk-" + "a" * 20 + "T3BlbkFJ" + "a" * 20, "xoxb-" + "1" * 12, "-----BEGIN PRIVATE KEY-----x", "Bearer " + "a" * 24])
def test_payloads_with_something_to_find_are_cut_and_others_left(spark, leaf):
    escaped = '{"a":{"n":1.0},"note":"' + "".join(f"\\u{ord(c):04x}" for c in leaf) + '"}'
    kept = '{"event_id" : "0b0e7a1c-2f3d-4c5b-8a9e-1f2d3c4b5a69", "timestamp":"2024-01-01T10:00:00.000Z","n":[1.50, 12345678901] }'
    df = docs(spark, {"note": leaf}, escaped, kept)
    got = [r["r"] for r in df.orderBy("i").select(redact_json(F.col("payload")).alias("r")).collect()]
    assert "[REDACTED:" in got[0] and leaf not in got[0] and "[REDACTED:" in got[1] and got[2] == kept
    assert [r["m"] for r in df.orderBy("i").select(may_match(F.col("payload")).alias("m")).collect()] == [True, False, False]


def test_members_of_a_document_are_typed_once(spark):
    one = spark.range(1).select(flatten_json(F.try_parse_json(F.lit('{"a.b":1,"c":{"d.e":"x","f":null,"g":[1]},"h":2.5,"i":true}'))).alias("f"))
    flat = {k: tuple(v) for k, v in one.collect()[0]["f"].items()}
    assert flat == {"a\\.b": ("BIGINT", "1", 1.0), "c": ("OBJECT", None, None), "h": ("DECIMAL", "2.5", 2.5), "i": ("BOOLEAN", "true", None),
                    "c.d\\.e": ("STRING", "x", None), "c.f": flat["c.f"], "c.g": ("ARRAY", None, None)}
    plan = one._jdf.queryExecution().analyzed().toString().lower()
    assert plan.count("schema_of_variant(") == 2  # one for each level


def test_rewrite_cut_off_is_completed(spark, make_events, tmp_path, monkeypatch):
    """Before its plan a rewrite leaves the table alone; after it the next call completes it, also between a delete and a rename."""
    d = str(tmp_path / "t")
    S.write_event_table(make_events([{"timestamp": f"2024-0{m}-15 00:00:00", "session_id": s} for m in (1, 2, 3) for s in "ab" if (m, s) != (2, "b")]), d)
    keep = F.col("session_id") != "a"
    ids = lambda: sorted(r["session_id"] for r in spark.read.parquet(d).collect())
    with monkeypatch.context() as m:
        m.setattr(L, "_swap", lambda spark, path: (_ for _ in ()).throw(RuntimeError("lost")) if (tmp_path / "t-rewrite" / "plan").exists() else [])
        with pytest.raises(RuntimeError):
            L.rewrite_table(spark, d, keep)
    assert ids() == ["a", "a", "a", "b", "b"]
    for f in (tmp_path / "t" / "month=2024-01").iterdir():  # cut off after the first delete
        f.unlink()
    (tmp_path / "t" / "month=2024-01").rmdir()
    assert L.recover(spark, d) == ["2024-01", "2024-02", "2024-03"] and L.recover(spark, d) == []
    assert ids() == ["b", "b"]
    (tmp_path / "t-rewrite" / "rows").mkdir(parents=True)  # cut off before the plan
    assert L.rewrite_table(spark, d, keep) == [] and ids() == ["b", "b"] and not (tmp_path / "t-rewrite").exists()


def test_metadata_of_an_event_stays(spark):
    df = spark.sql("SELECT 'i' AS id, 1L AS timestamp_ms, named_struct('channel', 'web', 'processed', true, 'tags', array('x')) AS metadata")
    got = V.enrich_web_events(df, F.lit(0)).first()["metadata"]
    assert got["channel"] == "web" and got["processed"] is False and got["tags"] == ["x"] and got["flags"] == [] and got["quality"] == 1.0


def test_windows_of_a_stream_in_small_batches(spark):
    """Several micro-batches, equal readings, ties in time, a null; the closed windows equal brute force and the state shrinks."""
    import random
    from datetime import datetime, timedelta

    rnd, t0, d = random.Random(3), datetime(2024, 1, 1), tempfile.mkdtemp()
    rows = [("m" if rnd.random() < 0.8 else "n", t0 + timedelta(seconds=rnd.randrange(i * 100, i * 100 + 100)), float(rnd.randrange(9))) for i in range(6) for _ in range(150)]
    rows += [("m", t0, None), ("one", t0, 4.0)]
    for i in range(6):
        part = [r for r in rows if (r[1] - t0).total_seconds() // 100 == i]
        spark.createDataFrame(part, "k string, at timestamp_ntz, v double").coalesce(1).write.mode("append").parquet(f"{d}/in")
        time.sleep(0.05)
    src = J.event_stream(spark, f"{d}/in", "k string, at timestamp_ntz, v double", "parquet", maxFilesPerTrigger="1", latestFirst="false").withColumn("at", F.col("at").cast("timestamp"))
    closed = J.closed_readings_stream(src, "k", "at", "v", "60 seconds", "60 seconds", "200 seconds")
    K.run_available(closed, lambda df, i: K.write_batch(J.window_metrics(df, "k"), f"{d}/w", i), f"{d}/cp")
    got = {(r["k"], r["at"]): r for r in K.read_batches(spark, f"{d}/w").collect()}
    assert len(got) == K.read_batches(spark, f"{d}/w").count() >= 6
    for (k, at), r in got.items():
        mine = sorted(((t, v) for n, t, v in rows if n == k and 0 <= (t - at).total_seconds() < 60 and v is not None))
        values = [v for _, v in mine]
        ordered = sorted(values)
        assert r["count"] == len(values) + (k == "m" and at == t0) and r["sum"] == sum(values) and r["last"] == values[-1]
        for name, p in {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}.items():
            assert r[name] == ordered[max(0, math.ceil(len(ordered) * p) - 1)]
        last = values[-10:]
        half = len(last) // 2
        if len(values) < 3 or not half or sum(last[:half]) == 0:
            assert r["trend"] == "stable"
        else:
            a, b = sum(last[:half]) / half, sum(last[half:]) / (len(last) - half)
            assert r["trend"] == ("up" if (b - a) / a > 0.05 else "down" if (b - a) / a < -0.05 else "stable")
        gap = (mine[-1][0] - mine[-2][0]).total_seconds() if len(mine) > 1 else 0
        assert r["rate"] == ((mine[-1][1] - mine[-2][1]) / gap if gap else 0.0)


def test_days_of_a_funnel_stream_leave_the_state_and_batches_compact(spark):
    d = tempfile.mkdtemp()
    schema = "user_id string, ts timestamp, event_type string, props string"
    for day in range(1, 6):
        part = [(f"u{i}", f"2024-01-0{day} 0{i}:00:00", "view", "{}") for i in range(3)]
        spark.createDataFrame(part, "user_id string, ts string, event_type string, props string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(f"{d}/in")
        time.sleep(0.05)
    src = J.event_stream(spark, f"{d}/in", schema, "parquet", maxFilesPerTrigger="1")
    stream = J.funnel_stream(src, [funnels.Step("view", "view")])
    query = (stream.writeStream.foreachBatch(lambda df, i: K.write_batch(df, f"{d}/out", i)).outputMode("update").option("checkpointLocation", f"{d}/cp")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 9
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] < 15
    keys = ["user_id", "step_id", "day"]
    before = sorted(map(tuple, K.read_latest(spark, f"{d}/out", keys).collect()))
    assert len(before) == 15
    K.compact_batches(spark, f"{d}/out", keys, 1)
    K.compact_batches(spark, f"{d}/out", keys, 3)
    assert sorted(map(tuple, K.read_latest(spark, f"{d}/out", keys).collect())) == before
    assert {tuple(r) for r in J.funnel_latest(K.read_latest(spark, f"{d}/out", keys)).select("user_id", "hits").collect()} == {(f"u{i}", 5) for i in range(3)}
