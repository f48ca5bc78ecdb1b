"""The corpus pipeline: columns, rows and the registered names."""

from collections import Counter

import corpus_pipeline
from millrace.llm import queries
from millrace.llm.decontamination import contaminated
from millrace.llm.mixing import mix_sources
from millrace.llm.simhash_dedup import simhash_components


def test_stages(spark, sf):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"] for r in docs.collect()}
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf).cache()
        ids = Counter(r["doc_id"] for r in out.select("doc_id").collect())
        assert set(ids) <= before
        if name != "sharding":
            assert out.columns == columns
        if name == "toxicity":
            assert len(before - set(ids)) < 0.2 * len(before)
        if name == "near_duplicates":
            groups = simhash_components(docs, 5, 4, 56, 0.8)
            assert set(ids) == {r["component_id"] for r in groups.collect()} and max(ids.values()) == 1
        if name == "decontamination":
            assert before - set(ids) == {r["doc_id"] for r in contaminated(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
        if name == "mixing":
            assert ids == Counter({r["doc_id"]: len(r["copies"]) for r in mix_sources(docs).collect() if r["copies"]})
        if name == "sharding":
            assert sum(ids.values()) == docs.count() and {"shard", "slot"} <= set(out.columns)
        docs, before = out, set(ids)
    assert toxic


def test_registered():
    q = queries.queries()
    assert [n.split("_")[0] for n in q] == [f"op{i}" for i in range(1, 14)] and set(queries.oracle_sql()) <= set(q)
