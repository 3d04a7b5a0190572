"""Helpers shared by the text operators: column contracts, hashes and the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space; everything else is part of a word.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(UPPER, LOWER)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def crc_of_id(name: str = "doc_id") -> Column:
    """CRC-32 of the id written as text; a missing id counts as empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))


class Cached(dict):
    """What was made of a key, at most ``most`` new ones and as many of the time before, of which those in use move on."""

    most = 200_000

    def __init__(self):
        super().__init__()
        self.older: dict = {}

    def made(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        found = self.older.pop(key, None)
        if found is None:
            found = self.made(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="tallyloom-llm-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only a session that runs in one process, as tests do, may do without: it
    gets a temporary folder of its own.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder()


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it from there.

    What follows starts from the files, so a lost executor costs no more than
    the tasks it ran.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int, limit: int = 2_000_000) -> DataFrame:
    """Offer ``df`` for broadcasting where its counted rows are few, else leave the join to Spark."""
    return F.broadcast(df) if rows <= limit else df
