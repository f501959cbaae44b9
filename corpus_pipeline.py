"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir), works on all rows that the stage before has kept, and
returns a DataFrame that is written as Parquet and read again as the next one's docs.

1. quality: rows whose text scores below quality.GOOD go.
2. near_dups: one row of each class of near-duplicates stays, the one of the least doc_id.
3. decontaminate: rows that hold a window of a benchmark item go.
4. pii: personal data in the texts is replaced by the name of its kind; n_chars follows the text.
5. pieces: the texts' SentencePiece ids (merge-dropout) are added; the texts come back from the ids.

All stages but the last return the columns of their input. Null texts count as empty ones and stay null. A row that is
there twice is one near-duplicate of itself. Empty tables give empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontam, near_dups, pieces, pii, quality
from corpusloom.llm.common import shared_dir, table, unused


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows of docs outside the held-out fourth; drops what the model rejects."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    name = unused(docs, "score")
    return quality.score(docs, model, name).filter(F.col(name) >= quality.GOOD).select(*docs.columns)


def near_dups_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.one_of_each(docs, near_dups.near_classes(docs.select("doc_id", "text")))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = unused(docs, "pii")
    found = pii.find_pii(docs, name=name).withColumn("text", pii.redact("text", name))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of the text and how many there are; lossless: is the text what the ids decode to?"""
    back = pieces.encode_texts(docs.select("doc_id", "text"), decoded="decoded")
    return back.select("doc_id", "pieces", F.coalesce(F.size("pieces"), F.lit(0)).cast("long").alias("n_pieces"), F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))


STAGES = [
    ("quality", quality_stage),
    ("near_dups", near_dups_stage),
    ("decontaminate", decontaminate_stage),
    ("pii", pii_stage),
    ("pieces", pieces_stage),
]

#: The classifier and the sampled near-duplicate classes are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    place = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{place}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{place}/{name}")
    return docs
