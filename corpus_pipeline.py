"""A training corpus from raw documents: five stages, each a table of documents made from the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import line_templates, mixing, near_dedup, packing, toxicity
from tallyloom.llm.common import crc_of_id, stored
from tallyloom.llm.queries import tokenizer_path


def _bound_batches(spark: SparkSession, size: str = "8m") -> None:
    """Whole texts go to Python in Arrow batches of some megabytes; where a batch ends changes no result."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, learned on the labelled ones among them, doesn't reject."""
    _bound_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_of_id() % 3 != 1)
    scorer = toxicity.learn(docs, labels.select("doc_id", "toxic"))
    return toxicity.score_toxicity(docs, scorer).where("predicted = 0").select(*[f"`{c}`" for c in docs.columns])


def without_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without boilerplate lines, their length counted anew; a text that was nothing else goes."""
    _bound_batches(spark)
    found = line_templates.drop_recurring_lines(docs).where("n_dropped = 0 OR n_dropped < n_lines")
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*[f"`{c}`" for c in docs.columns])


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bound_batches(spark)
    return near_dedup.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    return mixing.mix_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bound_batches(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_recurring_lines),
    ("near_dedup", without_near_duplicates),
    ("source_mixing", mixed),
    ("best_fit_packing", packed),
]

#: Learned scores, a template tree and a genetic algorithm are not SQL's to express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
