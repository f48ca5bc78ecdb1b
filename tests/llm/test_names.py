"""Columns that are named like any helper column or variable of the operators: they neither crash one nor change its result."""

import re
from pathlib import Path

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from millrace.llm.common import stored
from millrace.llm import decontamination, mixing, quality_rules, sharding, simhash_dedup, substring_dedup, suffix_dedup, toxicity, url_filters, warc

ROOT = Path(corpus_pipeline.__file__).parent
#: Every short string in the sources that could be a column's name, the names of results apart.
NAMES = sorted({x.lower() for p in [*(ROOT / "millrace" / "llm").glob("*.py"), ROOT / "corpus_pipeline.py"] for x in re.findall(r"""["'\s(,]([a-z][a-z0-9_]{0,14})["'\s),]""", p.read_text())})


def crowded(df, results=()):
    names = [n for n in NAMES if n not in {c.lower() for c in df.columns} and n not in results]
    return df.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names[:]) if re.fullmatch(r"[a-z][a-z0-9_]*", n))), names


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60").cache()


def rows(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_helper_names(spark, sf, docs):
    bench, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("benchmark", "labels"))
    many, names = crowded(docs)
    assert {"rhost", "bsrc", "one_", "key_", "lid", "label", "row_key", "hits", "part", "size", "copies"} - {"one_", "key_"} <= set(names)
    one = simhash_dedup.drop_near_duplicates(many)
    assert one.columns == many.columns and rows(one, "doc_id") == rows(simhash_dedup.drop_near_duplicates(docs), "doc_id")
    left = decontamination.decontaminate(many, bench)
    assert left.columns == many.columns and rows(left, "doc_id") == rows(decontamination.decontaminate(docs, bench), "doc_id")
    model = toxicity.fit(many, labels)
    assert rows(many.select("doc_id", toxicity.toxicity_score(model, F.col("text")).alias("s")), "doc_id", "s") == rows(docs.select("doc_id", toxicity.toxicity_score(toxicity.fit(docs, labels), F.col("text")).alias("s")), "doc_id", "s")
    assert rows(simhash_dedup.simhash_components(many), "doc_id", "component_id") == rows(simhash_dedup.simhash_components(docs), "doc_id", "component_id")
    for found in (substring_dedup.repeated_passages, suffix_dedup.repeated_bytes):
        assert rows(found(many), "doc_id", "n_removed") == rows(found(docs), "doc_id", "n_removed")
    assert rows(quality_rules.quality_verdicts(many), "doc_id", "kept") == rows(quality_rules.quality_verdicts(docs), "doc_id", "kept")
    assert rows(mixing.mix_sources(many), "doc_id", "taken") == rows(mixing.mix_sources(docs), "doc_id", "taken")
    assert rows(sharding.shard_documents(many), "doc_id", "shard", "slot") == rows(sharding.shard_documents(docs), "doc_id", "shard", "slot")


def test_helper_names_of_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rules = spark.createDataFrame(url_filters.RULES, "host string, path string, verdict string")
    many, _ = crowded(pages)
    judged = url_filters.filter_urls(many, rules)
    assert set(many.columns) <= set(judged.columns) and judged.where("rhost is null or part is null").count() == 0
    assert rows(judged, "page_id", "rule", "verdict") == rows(url_filters.filter_urls(pages, rules), "page_id", "rule", "verdict")
    through = lambda df: warc.read_archives(warc.convert_archives(stored(warc.archive_pages(df), "arcs")))
    assert rows(through(many), "page_id", "record_type") == rows(through(pages), "page_id", "record_type")


def test_mixing_stage_keeps_columns(spark, sf, docs):
    many, names = crowded(docs)
    out = corpus_pipeline.mixing(spark, many, sf)
    assert out.columns == many.columns and out.select(*(F.min(n).alias(n) for n in ("size", "copies", "target", "copy"))).first() == many.select(*(F.min(n).alias(n) for n in ("size", "copies", "target", "copy"))).first()
