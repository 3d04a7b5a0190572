"""Citation log: which metric query produced a number."""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.metrics import MetricArgs, check_args, query_id


def citation(spark: SparkSession, name: str, args: MetricArgs) -> DataFrame:
    """One row: query id, metric, definition and parameters."""
    m = check_args(name, args)
    params = json.dumps({k: v for k, v in vars(args).items() if v is not None}, sort_keys=True)
    return spark.range(1).select(
        F.lit(query_id(name, args)).alias("query_id"), F.lit(name).alias("metric"), F.lit(m.layer).alias("layer"),
        F.lit(params).alias("params"), F.current_timestamp().alias("executed_at"))


def log_citations(spark: SparkSession, path: str, cited: Iterable[tuple[str, MetricArgs]]) -> list[str]:
    """Append the citations of many metrics as one file; an explicit call, so that a lazy metric has no side effect."""
    cited = list(cited)
    rows = reduce(DataFrame.unionByName, [citation(spark, name, args) for name, args in cited])
    rows.coalesce(1).write.mode("append").parquet(path)
    return [query_id(name, args) for name, args in cited]


def log_citation(spark: SparkSession, path: str, name: str, args: MetricArgs) -> str:
    return log_citations(spark, path, [(name, args)])[0]


def resolve_citation(spark: SparkSession, path: str, qid: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("query_id") == qid)
