"""The corpus pipeline: from documents to a mix for training, stage by stage.

Each stage is one of the operators of tidemark.llm; what a stage returns is written and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, mixing, near_dup, quality, secrets
from tidemark.llm.common import cut, numbered


#: The key that a stage gives each row; no column of documents is called so.
ROW = "_row_of_stage"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject, each row by itself, whatever its doc_id."""
    return quality.keep_quality(docs, quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id; rows without one come last. Each row is a document, whatever its doc_id."""
    rows = numbered(docs, ROW)
    classes = near_dup.near_duplicates(rows.withColumn("doc_id", F.col(ROW)).drop(ROW)).where("n_class > 1").select(F.col("doc_id").alias(ROW), "class_id")
    named = classes.join(rows.select(ROW, "doc_id"), ROW)
    kept = named.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW))[ROW].alias(ROW)).select(ROW)
    gone = classes.join(kept, ROW, "left_anti").select(ROW)
    # texts move once; never by broadcast, as the number of copies has no bound
    return rows.join(gone.hint("shuffle_hash"), ROW, "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, each row by itself, whatever its doc_id."""
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    return secrets.mask_secrets(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: copies of documents in serving order, with what of each is taken."""
    return mixing.mix_sources(docs).where("taken > 0").orderBy("finish", "source", "doc_id", "copy")


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicates", near_dup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("mixing sources", mix_stage),
]

#: Models and hashes have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; between stages a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, "stage")
    return docs
