"""Effectively-once Parquet output of a stream.

There is no transactional table here. Each micro-batch owns the folder of its
batch id and overwrites it, so a batch that is run again after a failure
changes nothing; readers see all batches as one table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_batch(batch: DataFrame, path: str, batch_id: int, by: Sequence[str] = ()) -> None:
    """Overwrite the batch's folder, whatever an earlier attempt left there."""
    batch.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*by).parquet(f"{path}/batch_id={batch_id}")


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def latest_per_key(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last version of each key of an update-mode stream."""
    rest = [c for c in table.columns if c not in (*keys, "batch_id")]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_v")).select(*keys, "_v.*")


def _folders(spark: SparkSession, path: str, prefix: str) -> dict[int, str]:
    """Finished folders ``prefix=N`` of a path by number; a folder is finished when its job marked it so."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return {}
    named = [f.getPath() for f in fs.listStatus(p) if f.getPath().getName().startswith(f"{prefix}=")]
    done = [f for f in named if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))]
    return {int(f.getName().split("=")[1]): f.toString() for f in done}


def _versions(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """Versions of all keys: the newest compacted folder and the batches after it, up to a batch."""
    base = max((n for n in _folders(spark, f"{path}-compact", "upto") if upto is None or n <= upto), default=None)
    later = [(n, f) for n, f in _folders(spark, path, "batch_id").items() if (base is None or n > base) and (upto is None or n <= upto)]
    tables = [spark.read.parquet(f"{path}-compact/upto={base}").withColumn("batch_id", F.lit(base).cast("long"))] if base is not None else []
    if later:
        tables.append(spark.read.option("basePath", path).parquet(*[f for _, f in sorted(later)]).withColumn("batch_id", F.col("batch_id").cast("long")))
    if not tables:
        raise FileNotFoundError(path)
    return tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1])


def read_latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Last version of each key of an update-mode stream, from the compacted folder and later batches."""
    return latest_per_key(_versions(spark, path), keys)


def compact_batches(spark: SparkSession, path: str, keys: Sequence[str], upto: int) -> None:
    """Fold the batches up to a committed one into one folder that readers start from.

    The folder counts from the moment its job has finished; one that was cut off
    is written again, and readers meanwhile take the older one with all batches.
    Batches that come later, or again, are read beside it.
    """
    latest_per_key(_versions(spark, path, upto), keys).write.mode("overwrite").parquet(f"{path}-compact/upto={upto}")


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", timeout: float | None = None) -> None:
    """Process everything that is there and stop; the checkpoint moves only after ``each`` returned.

    A backlog takes the time it takes; only a caller that passes ``timeout`` (seconds) sets a limit.
    """
    query = (stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    if query.awaitTermination(timeout) is False:
        query.stop()
        raise TimeoutError("the stream did not finish in time")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    run_available(stream, lambda df, i: write_batch(df, path, i), checkpoint, mode)
