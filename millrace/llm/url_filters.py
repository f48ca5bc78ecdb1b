"""URL filters as a sort-merge range join of urls with nested rules.

The host's labels are reversed and each ends in a dot (``www.example.com`` -> ``com.example.www.``),
so that a rule's host and all its subdomains are one interval of keys. Both sides are cut at the
same splitters; inside a range the urls are swept in key order, with a stack of the rules
whose interval is open.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import fresh, lower_ascii, n_buckets, table

#: The rules of the registered query, in the form (host, path, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: So many sampled keys for each range come to the driver; they decide only how evenly the ranges are cut.
SAMPLED_KEYS = 32


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty where there is no host part."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    """The labels from the last to the first, each with a dot behind it."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


class PathRules:
    """The path rules of one host, by length: a path meets at most one lookup for each length that the host has."""

    def __init__(self):
        self.by_path: dict[str, int] = {}
        self.lengths: list[int] = []

    def longest(self, path: str) -> tuple[str, int] | None:
        for n in self.lengths:
            if n <= len(path) and (i := self.by_path.get(path[:n])) is not None:
                return path[:n], i
        return None


def _sweep(keys: pd.Series, paths: pd.Series, rules: pd.DataFrame) -> list[int]:
    """For each page (in order of its key) the index of the longest rule that holds, or -1."""
    hosts: dict[str, PathRules] = {}
    for i, (rhost, path) in enumerate(zip(rules["rhost"], rules["path"], strict=True)):
        hosts.setdefault(rhost, PathRules()).by_path[path] = i
    for own in hosts.values():
        own.lengths = sorted({len(p) for p in own.by_path}, reverse=True)
    starts, at, stack, out = sorted(hosts), 0, [], []
    for rhost, path in zip(keys, paths, strict=True):
        while at < len(starts) and starts[at] <= rhost:
            while stack and not starts[at].startswith(stack[-1]):
                stack.pop()
            stack.append(starts[at])
            at += 1
        while stack and not rhost.startswith(stack[-1]):
            stack.pop()
        best, longest = -1, (-1, -1)
        for host in stack:
            if (own := hosts[host].longest(path)) and (size := (len(host) - 1 + len(own[0]), len(host))) > longest:
                best, longest = own[1], size
        out.append(best)
    return out


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", buckets: int | None = None) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``host``, ``path`` (begins with ``/``) and ``verdict``. A rule holds for its host and all
    subdomains where the url's path starts with the rule's. The longest rule (host and
    path together; on a tie the longer host) decides; where none holds, ``rule`` is null and the
    verdict is ``default``. Rules with the same host and path: the least verdict in string order counts.

    A null url, or one without ``://``, has an empty host and path and meets no rule. A very long url is taken whole. Repeated
    rows are judged one by one, and a host with very many urls is cut into several ranges. Rules with a null host or path are void. An empty side is no
    special case. Columns of ``pages`` named like one of the four new ones are replaced; any others stay, whatever their names.
    """
    spark = pages.sparkSession
    pages = pages.drop(*(c for c in pages.columns if c.lower() in ("host", "path", "rule", "verdict")))
    part, rhost, salt = fresh(pages, "part", "rhost", "salt")
    keyed = pages.withColumns({"host": url_host(F.col(url_col)), "path": url_path(F.col(url_col))}).withColumns({rhost: reversed_host(F.col("host")), salt: F.hex(F.xxhash64(url_col, "path"))})
    # Splitters are pairs (key, salt), so that a host with very many urls is cut into several ranges.
    n = n_buckets(spark, buckets)
    # The key with the least hash in each of so many hash ranges: a sample that every task reduces to its own bound.
    hashed = F.xxhash64(rhost, salt)
    sample = sorted((r["k"][1], r["k"][2]) for r in keyed.groupBy(F.pmod(hashed, F.lit(SAMPLED_KEYS * n))).agg(F.min(F.struct(hashed, rhost, salt)).alias("k")).collect())
    cuts = sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []

    def range_of(keys: pd.Series, salts: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(cuts, x) for x in zip(keys, salts, strict=True)], dtype="int32")

    def ranges_of(keys: pd.Series) -> pd.Series:
        """All ranges that the interval of a rule's host meets: from the host's own key to before its dot's successor."""
        return pd.Series([list(range(bisect_left(cuts, (k,)), bisect_right(cuts, (k[:-1] + "/",)) + 1)) for k in keys])

    keyed = keyed.withColumn(part, F.pandas_udf(range_of, "int")(rhost, salt))
    rules = rules.where("host is not null and path is not null").groupBy(lower_ascii(F.col("host")).alias("host"), "path").agg(F.min("verdict").alias("verdict"))
    spread = rules.withColumn("rhost", reversed_host(F.col("host"))).withColumn("part", F.explode(F.pandas_udf(ranges_of, "array<int>")("rhost")))
    schema = keyed.drop(part, rhost, salt).schema.add("rule", "string").add("verdict", "string")

    def sweep(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values([rhost], kind="stable", ignore_index=True)
        found = _sweep(left[rhost], left["path"], right)
        names = [f"{h}{p}" for h, p in zip(right["host"], right["path"], strict=True)]
        verdicts = list(right["verdict"])
        left["rule"] = pd.Series([names[i] if i >= 0 else None for i in found], dtype=object)
        left["verdict"] = pd.Series([verdicts[i] if i >= 0 else default for i in found], dtype=object)
        return left[[f.name for f in schema]]

    return keyed.drop(salt).groupBy(part).cogroup(spread.groupBy("part")).applyInPandas(sweep, schema)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = r"""
WITH rules(rhost, rpath, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
m AS (
  SELECT page_id, host, path,
         (SELECT max_by(struct_pack(r := rhost || rpath, v := v), length(rhost) * 1000 + length(rpath)) FROM rules
          WHERE (p.host = rhost OR suffix(p.host, '.' || rhost)) AND starts_with(p.path, rpath)) AS best
  FROM p)
SELECT page_id, host, path, best.r AS rule, coalesce(best.v, 'allow') AS verdict FROM m
"""
