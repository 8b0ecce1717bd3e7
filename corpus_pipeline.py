"""The corpus pipeline: toxicity, quality, near duplicates, decontamination, tokens.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's docs. ``run`` applies them to the table documents.

Rows pass through untouched but for the texts that decontamination cuts, and the
last stage adds n_ids, ids and exact, in place of columns of these names; nulls,
empty and very long texts, ties, repeated rows and further columns are treated as
the operators say. Rows with a null id can't be told apart by the near-duplicate
stage, which keeps them all. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenroute.llm import decontamination as decontamination_op
from lumenroute.llm import quality, sentencepiece_codec, toxicity
from lumenroute.llm.cluster import delete, prepare, shared_folder, table
from lumenroute.llm.components import drop_near_duplicates


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that near-duplicate pairs connect, the one with the lowest id stays."""
    return drop_near_duplicates(docs, n=3, threshold=0.6)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go, and documents that are mostly made of them."""
    return decontamination_op.decontaminate(docs, table(spark, sf_dir, "benchmark"), n=8, drop_share=0.5)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their SentencePiece ids, and whether these decode to the text."""
    return sentencepiece_codec.with_ids(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("ngram_jaccard_join", drop_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("sentencepiece", encode),
]

#: the classifiers of the first two stages aren't expressible in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the table documents of sf_dir.

    The stages' outputs are in the session's shared folder; each is deleted
    when the next one is written, and the last one stays.
    """
    prepare(spark)
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            delete(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs.select(*(F.col(f"`{c}`") for c in docs.columns))
