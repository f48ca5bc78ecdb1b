"""Where rows come from: tables, seed lists, sitemaps, caches, run events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import fixed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seed_urls(spark: SparkSession, path: str) -> DataFrame:
    """(url, source) of text files: the first token of each line that is neither empty nor a comment; the source is the file's name without its end."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"))
    line = F.trim("value")
    return lines.where((line != "") & ~line.startswith("#")).select(F.element_at(F.split(line, r"[\s,;]+"), 1).alias("url"), F.concat(F.lit("seed:"), F.regexp_replace("file", r"\.[^.]*$", "")).alias("source"))


def lexicon(spark: SparkSession, family: str, entries=None) -> DataFrame:
    """(family, ordinal, label, pattern) of a lexicon; a small table."""
    entries = entries or {"services": fixed.SERVICES, "icp": fixed.ICP, "tech": fixed.TECH, "funnels": fixed.FUNNEL_TYPES}[family]
    return spark.createDataFrame([(family, i, label, p) for i, (label, p) in enumerate(entries)], "family string, ordinal int, label string, pattern string")


def event_tail(events: DataFrame, user_id: int, after: int, limit: int = 200) -> DataFrame:
    """The newest events of a run behind a cursor, oldest first."""
    newest = events.where((F.col("user_id") == user_id) & (F.col("event_id") > after)).orderBy(F.desc("event_id")).limit(min(limit, 500))
    return newest.orderBy("event_id")


def outbound_first_per_domain(links: DataFrame) -> DataFrame:
    """Links of directory pages, the first of each domain."""
    from millrace.functions.urls import registrable_domain
    from millrace.operators.picks import first_by

    df = links.withColumn("domain", registrable_domain(F.col("url"))).where(F.col("domain") != F.col("site"))
    return first_by(df.select("domain", "url", "page_ord", "link_ord"), ["domain"], [F.col("page_ord"), F.col("link_ord")]).select("domain", "url")
