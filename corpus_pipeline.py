"""A corpus pipeline over the documents table: STAGES, one operator of :mod:`weft.llm` each.

Every stage works on what the one before it kept, written as Parquet and read
again.  The first four return the columns of documents; the last returns the
packed pieces.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import decontam, language, neardup, packing, queries, toxicity
from weft.llm import text as tx
from weft.session import scratch_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted to be toxic; null and empty texts stay."""
    model = toxicity.train(docs, queries.table(spark, sf_dir, "labels"))
    name = tx.free_name(docs.columns, "_toxicity")
    return toxicity.scores(docs, model, out=name).where(F.col(f"{name}.predicted") == 0).drop(name)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough likeness; those without a letter, null ones among them, go."""
    model = language.train(docs)
    name = tx.free_name(docs.columns, "_language")
    return language.identify(docs, model, out=name).where(~F.col(f"{name}.rejected")).drop(name)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the least doc_id."""
    return neardup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans they share with the benchmark, n_chars counted anew where one went; those mostly made of such spans go."""
    name = tx.free_name(docs.columns, "_before")
    cleaned = decontam.clean(docs.withColumn(name, F.length("text")), queries.table(spark, sf_dir, "benchmark"))
    changed = ~F.length("text").eqNullSafe(F.col(name))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cleaned.drop(name)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 tokens."""
    placed = packing.layout(docs, queries.tokenizer("word_bpe_49k.json"), queries.END_ID, added=True)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Votes, centroids, hashes and token ids are beyond SQL: tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = queries.table(spark, sf_dir, "documents")
    folder = scratch_path(spark, f"pipeline/{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
