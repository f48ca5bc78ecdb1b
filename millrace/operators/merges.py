"""Tables kept up to date by key: candidates, leads and their children, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import fixed
from millrace.functions.urls import not_blocked, registrable_domain, social_network
from millrace.operators.picks import first_by
from millrace.operators.suffixes import with_registrable_domain


def admissible(batch: DataFrame, blocked: DataFrame, url_col: str = "url", rules: DataFrame | None = None) -> DataFrame:
    """``batch`` with ``domain``, for urls that may be a company's: not blocked, no network's, no service host. Domains follow the public-suffix ``rules``, or a short list where there are none."""
    df = batch.withColumn("domain", registrable_domain(F.col(url_col))) if rules is None else with_registrable_domain(batch, url_col, rules)
    df = df.where(F.contains("domain", F.lit(".")) & social_network(F.col(url_col)).isNull() & ~F.col("domain").rlike(fixed.ADMISSION_PREFIX))
    return not_blocked(df, "domain", blocked)


def merge_candidates(old: DataFrame, batch: DataFrame) -> DataFrame:
    """(domain, hits): new domains with one hit, known ones with one more; a domain counts once for each batch."""
    seen = batch.select(F.col("domain").alias("new")).where("new is not null").distinct()
    return old.join(seen, F.col("domain") == F.col("new"), "full").select(F.coalesce("domain", "new").alias("domain"), (F.coalesce("hits", F.lit(0)) + F.col("new").isNotNull().cast("int")).alias("hits"))


def new_domains(old: DataFrame, batch: DataFrame) -> DataFrame:
    return batch.select("domain").distinct().join(old.select("domain"), "domain", "left_anti")


def merge_emails(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` addresses with the checks of ``old`` ones carried over (``domain, email``)."""
    o = old.groupBy(F.col("domain").alias("od"), F.lower("email").alias("oe")).agg(F.max_by(F.struct("verification", "verified_at"), F.struct("verified_at", "verification")).alias("old_"))
    df = new.join(o, (F.col("domain") == F.col("od")) & (F.lower("email") == F.col("oe")), "left")
    return df.withColumns({"verification": F.coalesce("old_.verification", "verification"), "verified_at": F.col("old_.verified_at")}).drop("od", "oe", "old_")


def merge_agencies(old: DataFrame, new: DataFrame, kept=("notes", "user_status", "created_at"), founder: str = "founder") -> DataFrame:
    """``new`` facts over ``old`` ones, by domain: what people wrote stays, and a founder found earlier where the new page names none."""
    o = old.select(F.col("domain").alias("od"), *(F.col(c).alias(f"old_{c}") for c in (*kept, founder)))
    both = new.join(o, F.col("domain") == F.col("od"), "left").drop("od")
    both = both.withColumns({**{c: F.coalesce(f"old_{c}", c) for c in kept}, founder: F.coalesce(founder, f"old_{founder}")}).select(*new.columns)
    rest = old.join(new.select(F.col("domain").alias("nd")), F.col("domain") == F.col("nd"), "left_anti").select(*new.columns)
    return both.unionByName(rest)


def merge_children(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column], parents: DataFrame) -> DataFrame:
    """Children of ``parents`` (``domain``) replaced by the first of each key of ``new``; others stay."""
    fresh = first_by(new, keys, order).select(*old.columns)
    return old.join(parents.select(F.col("domain").alias("pd")).distinct(), F.col("domain") == F.col("pd"), "left_anti").unionByName(fresh)


def latest(cache: DataFrame, keys: list[str], at: str = "fetched_at") -> DataFrame:
    """The newest entry of each key; of equal times the greatest entry by all its columns of plain type."""
    plain = [F.col(c) for c, t in cache.dtypes if c not in (*keys, at) and not t.startswith(("map", "array", "struct"))]
    rest = [c for c in cache.columns if c not in keys]
    return cache.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(at).alias("at_"), *(c.alias(f"o{i}") for i, c in enumerate(plain)))).alias("row_")).select(*keys, *(F.col("row_")[c].alias(c) for c in rest))


def fresh_entries(cache: DataFrame, now: Column, hours: int, at: str = "fetched_at") -> DataFrame:
    """Entries not older than ``hours``."""
    return cache.where(F.col(at) >= now - F.make_interval(hours=F.lit(hours)))
