"""What the corpus operators share: tables, shared-folder tables, names, inline data."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.shared import stored

__all__ = ["LAST_ID", "SPACE", "WORD", "exchanged_joins", "fresh", "inline", "lower_ascii", "n_buckets", "stored", "table"]

#: A word, in Java's and Python's regular expressions: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A run of ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
#: A null doc_id stands after every other id wherever ids are compared.
LAST_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table of that name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def exchanged_joins(spark: SparkSession) -> Iterator[None]:
    """Queries that run within it join by exchanges, but where a hint asks for a broadcast: no join's side goes through the driver, which else collects, packs and keeps each one."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        for n in names:
            spark.conf.set(n, "-1")
        yield
    finally:
        for n, value in before.items():
            if value is None:
                spark.conf.unset(n)
            else:
                spark.conf.set(n, value)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """For each name one like it that ``df`` has no column of, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def inline(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small driver-made list as a DataFrame, by SQL functions alone."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def n_buckets(spark: SparkSession, buckets: int | None) -> int:
    """Buckets of a hash exchange: as asked, else as many as the session's shuffles have."""
    return buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, everything else unchanged."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
