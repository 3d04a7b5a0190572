import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tallyloom.plans.session import local_session

    session = local_session("tests", cores=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def make_events(spark):
    """Event rows from short dicts; everything not given is '' or 0."""
    from pyspark.sql import functions as F

    text = ("tenant_id", "event", "event_id", "task_id", "run_id", "session_id", "task_type", "agent_name", "agent_version", "tool_name", "model",
            "status", "verification", "initiator", "retry_of_step_id")
    numbers = ("tokens_in", "tokens_out", "latency_ms", "cost_usd", "rating_value", "edit_magnitude_value", "response_latency_ms")

    def build(rows):
        full = []
        for i, r in enumerate(rows):
            d = {c: "" for c in text} | {c: 0.0 for c in numbers}
            d |= {"tenant_id": "t", "event_id": f"e{i}", "task_id": f"k{i}", "run_id": "r", "task_type": "x", "timestamp": f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}"}
            d |= r
            full.append(tuple(d[c] if c not in numbers else float(d[c]) for c in (*text, *numbers, "timestamp")))
        ddl = ", ".join([f"{c} string" for c in text] + [f"{c} double" for c in numbers] + ["timestamp string"])
        return spark.createDataFrame(full, ddl).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))

    return build
