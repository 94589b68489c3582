"""The training-data pipeline: stages over ``documents``, each written and read again by the next.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last
return the columns of documents; the last returns doc_id, ids, n_pieces and lossless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm import exact_dedup, mixing, near_dedup, pieces, quality
from corpusmill.llm.common import fresh, stored, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits on the ratings of documents and drops those whose chance of the top grade is below one half."""
    return quality.select_documents(docs, quality.fit(docs, quality.graded(table(spark, sf_dir, "labels"))))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of equal texts."""
    return exact_dedup.exact_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate class."""
    return near_dedup.near_dedup(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents so that sources take up their target shares."""
    return mixing.mix(docs)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every document to pieces with merge-dropout. Copies are numbered, so that each draws its own."""
    (turn,) = fresh(docs, "turn")
    same = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(1))
    numbered = docs.withColumn(turn, F.row_number().over(same) - 1)
    return pieces.encode_documents(numbered, copy_col=turn).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_duplicates),
    ("near dedup", near_duplicates),
    ("mixing sources", source_mix),
    ("piece encoding", piece_encoding),
]

#: Fitting, banding and dropout have no SQL form; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
