"""The corpus pipeline: five stages, each over all that its predecessor kept.

toxicity     drops the documents that the labelled neighbours call toxic
line_dedup   cuts blocks that earlier documents have already
near_dedup   keeps one document (the least doc_id) of each SimHash component
pii          masks personal data
packing      packs the rest into sequences of at most 1024 tokens

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last have the
columns of ``docs``. ``run`` writes each stage's result to the shared folder and reads it
again as the next one's input.

Null and empty texts, and those that line_dedup emptied, share one fingerprint: near_dedup keeps
the least doc_id of them (an empty text in packing) and those without doc_id. Repeated rows fall
together there too: of rows that share a doc_id, all of the kept document stay. Ties are told by
doc_id throughout. Very long texts go through each stage whole. An empty table gives an empty
result; columns beside doc_id and text are carried along, up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.llm.common import free_name, settle


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't predicted toxic; the labels are those of ``sf_dir``."""
    from batchloom.llm.toxicity import clean, learn

    return clean(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from batchloom.llm.linededup import without_copies

    return without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each component; documents without doc_id stay."""
    from batchloom.llm.simhash import near_duplicates

    seen, own = free_name(docs, "seen__"), free_name(docs, "kept__")
    gone = near_duplicates(docs).where("doc_id <> component_id").select(F.col("doc_id").alias(seen)).distinct()
    # The ids that go are hashed, so that texts pass by without being sorted.
    return docs.withColumn(own, F.col("doc_id")).join(gone.hint("shuffle_hash"), F.col(own) == F.col(seen), "left_anti").drop(own)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from batchloom.llm.pii import redact

    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from batchloom.llm.packing import PackConfig, pack

    # Workers still hold memory of earlier stages: fewer words are remembered here.
    return pack(docs, PackConfig(public_tokenizers.path("byte_bpe_50k.json"), with_ids=True, max_words=250_000))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("pii", pii), ("packing", packing)]

# Trained models and token ids are beyond SQL; tests/llm compare each stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs, name)
    return docs
