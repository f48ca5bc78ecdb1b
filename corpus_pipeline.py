"""The corpus pipeline: toxicity, near-duplicates, benchmark contamination, source weights, shards.

Each stage takes the documents that the one before kept, is written as Parquet, and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import stored, table
from millrace.llm.decontamination import decontaminate
from millrace.llm.mixing import mix_sources, mixed_copies
from millrace.llm.sharding import shard_documents
from millrace.llm.simhash_dedup import drop_near_duplicates
from millrace.llm.toxicity import fit, toxicity_score


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.7. All columns and repeated rows stay; a null or empty text has no vote against it and stays, a very long one is scored whole; an empty table gives an empty one."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity_score(model, F.col("text")) < 0.7)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id. Null and empty texts are alike, repeated rows are one; a null id stays only where its group has no other; all columns stay, whatever their names."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; all columns and repeated rows stay; an empty table gives an empty one."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, dealt to the mix's output shards and shuffled locally: a document that is taken twice is two rows.

    Null sources are one source; null and empty texts ride along without adding words; an empty table gives an empty one. The row travels as one struct, so that
    no column of it can clash with the mix's own.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    mixed = mix_sources(rows, id_col="row.doc_id", text_col="row.text", source_col="row.source")
    return mixed_copies(mixed, id_col="row.doc_id").select("row.*")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's shard and place. Null texts count 16 bytes, repeated rows have a place each, an empty table gives an empty one; columns named like one of the four new ones are replaced."""
    return shard_documents(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: Fitted models and hashed fingerprints are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
