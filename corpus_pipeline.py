"""The corpus pipeline: five stages over documents, each one of the training-data operators.

A stage takes (spark, docs, sf_dir) and returns what the next one works on. ``run`` writes each stage's result as Parquet
to the folder that the cluster shares and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landsight.llm import decontaminate, pieces, quality, secrets, simhash
from landsight.llm.common import read, sendable, stored
from landsight.llm.queries import PIECES_MODEL
from landsight.storage import forget_others, written

#: A classifier, alignment scores and a tokenizer: no SQL says these.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled documents among them."""
    model = quality.train(docs, read(spark, sf_dir, "labels"), usable=~quality.held_out())
    return quality.score(docs, model, score_col="__score", predicted_col="__predicted").where("__predicted = 1").drop("__score", "__predicted")


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8): that of the smallest id. Documents without an id are kept."""
    found = simhash.near_duplicates(docs, scheme=simhash.NEAR)
    gone = stored(found.where("doc_id != component_id").select(F.col("doc_id").alias("__gone")).distinct(), "copies")
    kept = docs.join(sendable(gone), docs["doc_id"] == gone["__gone"], "left_anti")
    again = stored(found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__again")), "repeats")
    if again.isEmpty():
        return kept
    once = kept.join(again, kept["doc_id"] == again["__again"], "left_semi").dropDuplicates(["doc_id"])
    return kept.join(again, kept["doc_id"] == again["__again"], "left_anti").unionByName(once)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked and n_chars following."""
    return secrets.redact(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their number and whether they decode to the text."""
    return pieces.encode(docs, PIECES_MODEL)


STAGES = [
    ("quality classifier", keep_quality),
    ("simhash near-dedup", keep_first_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("secret scans", mask_secrets),
    ("sentencepiece encoding", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, start = read(spark, sf_dir, "documents"), written()
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
        forget_others(spark, start, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
