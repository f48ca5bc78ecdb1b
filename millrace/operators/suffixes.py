"""Registrable domains by a table of public-suffix rules: plain rules, wildcards (``*.ck``) and exceptions to these (``!www.ck``).

A host's label paths are looked up in the rules by an equi-join: each path from one of its labels to the end, as it is, below a wildcard, and as an exception. So the table may have any number of rules, and each different host
is looked up once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import fixed
from millrace.functions.urls import host_of
from millrace.sources.shared import stored


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """(rule) of a public-suffix file: a rule on each line, ``//`` begins a comment; what follows a blank is none of the rule."""
    lines = spark.read.text(path)
    return lines.where(~F.trim("value").startswith("//")).select(F.lower(F.element_at(F.split(F.trim("value"), r"\s+"), 1)).alias("rule")).where("rule <> ''").distinct()


def bare_host(url_or_host: Column) -> Column:
    s = F.lower(F.trim(url_or_host))
    return F.regexp_replace(F.when(F.contains(s, F.lit("://")), host_of(s)).otherwise(F.regexp_extract(s, r"^([^/:]*)", 1)), r"^\.+|\.+$", "")


def host_suffixes(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, width) of each host (first column) that a rule holds for: the labels of its public suffix.

    An exception wins, and its own suffix is one label shorter than it; else the rule with most labels."""
    h = hosts.select(F.col(hosts.columns[0]).alias("host")).where("host is not null").distinct()
    labels = F.split("host", r"\.")
    n = F.size(labels)
    path = lambda i: F.array_join(F.slice(labels, i, n), ".")
    ways = lambda i: F.array(
        F.struct(path(i).alias("rule"), F.lit(0).alias("exception"), (n - i + 1).alias("width")),
        F.struct(F.when(i < n, F.concat(F.lit("*."), path(i + 1))).alias("rule"), F.lit(0).alias("exception"), (n - i + 1).alias("width")),
        F.struct(F.concat(F.lit("!"), path(i)).alias("rule"), F.lit(1).alias("exception"), (n - i).alias("width")),
    )
    paths = h.select("host", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), n), ways))).alias("w")).select("host", "w.*")
    listed = rules.select(F.lower(F.col(rules.columns[0])).alias("rule")).distinct()
    return paths.join(listed, "rule").groupBy("host").agg(F.max(F.struct("exception", "width")).alias("best")).select("host", F.col("best.width").alias("width"))


def with_registrable_domain(df: DataFrame, url_col: str, rules: DataFrame, name: str = "domain", tenants=fixed.MULTI_TENANT_HOSTS) -> DataFrame:
    """``df`` with the registrable domain of its urls or hosts as ``name``: the public suffix and one label, on hosts of many tenants one label more.

    A host without a rule, a host that is a public suffix, and an address of digits stay whole; a null url is null."""
    keyed = stored(df.withColumn("host_", bare_host(F.col(url_col))), "hosts")
    found = host_suffixes(keyed.select("host_"), rules).withColumnRenamed("host", "found_")
    labels = F.split("host_", r"\.")
    n, width = F.size(labels), F.col("width") + 1
    last = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k), ".")
    own = last(width)
    sub = F.when(n > width, F.get(labels, n - width - 1))
    tenant = own.isin(*tenants) & sub.isNotNull() & ~((sub == "www") & (n == width + 1))
    domain = F.when(F.col("width").isNull() | F.col("host_").rlike(r"^[0-9.]+$"), F.col("host_")).when(tenant, F.concat_ws(".", sub, own)).otherwise(own)
    return keyed.join(found, F.col("host_") == F.col("found_"), "left").select(*df.columns, domain.alias(name))
