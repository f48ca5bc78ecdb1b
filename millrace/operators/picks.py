"""Choosing rows of a key: first, best, top, within budgets. Every order given here should end in a total one.

Windows over a key sort that key's rows in one task; where a third of all rows may share a key, ``first_by``
(an aggregate, combined before the shuffle) does it without.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first by ``order`` (ascending, nulls first). Null keys are a key."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order))))
    return df.groupBy(*keys).agg(best.alias("row_")).select(*keys, *(F.col("row_")[c].alias(c) for c in rest))


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank", start: int = 0, most: int | None = None) -> DataFrame:
    """``df`` with each row's place within its key, from ``start``; with ``most``, at most so many rows of a key.

    The bare row number is compared, which Spark recognises: each task then keeps only that many rows of a key before the shuffle."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    if most is not None:
        out = out.where(F.col(name) <= most)
    return out.withColumn(name, F.col(name) - 1 + start)


def top_by(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """At most ``n`` rows of each key, the first by ``order``."""
    return ranked(df, keys, order, "rank_", most=n).drop("rank_")


def within_budget(df: DataFrame, keys: list[str], order: list[Column], amount: Column, budget: float) -> DataFrame:
    """Rows of each key, in order, as long as the amounts add up to no more than ``budget``."""
    running = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("sum_", F.sum(amount).over(running)).where(F.col("sum_") <= budget).drop("sum_")


def content_dedup(df: DataFrame, keys: list[str], text: Column, order: list[Column], chars: int = 2000) -> DataFrame:
    """One row for each different beginning (``chars`` characters) of a text within a key."""
    named = df.withColumn("content_", F.sha2(F.substring(F.coalesce(text, F.lit("")), 1, chars), 256))
    return first_by(named, [*keys, "content_"], order).drop("content_")
