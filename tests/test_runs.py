"""A run through its stages, resumed, and stopped early; candidates merged batch by batch as a stream."""

import shutil
from dataclasses import replace

from pyspark.sql import functions as F

from millrace.plans import enrichment, runs
from millrace.plans.pipeline import RunConfig
from millrace.streaming import incremental
from millrace.plans import site_queries
from test_leads import pages_of


def source(spark):
    urls = [(1, "https://harborlane.example/about"), (1, "https://thin.example/"), (1, "https://instagram.com/x"), (2, "https://harborlane.example/"), (3, "https://late.example/")]
    return runs.RunInput(spark.createDataFrame(urls, "batch int, url string"), pages_of(spark), spark.createDataFrame([("blocked.example",)], "domain string"))


def outside(spark):
    empty = lambda ddl: spark.createDataFrame([], ddl)
    hits = "domain string, client_name string, rank int, url string, title string, snippet string"
    people = spark.createDataFrame([("harborlane.example", 1, "https://www.linkedin.com/in/mia-stone", "Mia Stone - Founder - Harbor Lane | LinkedIn", "")], "domain string, rank int, url string, title string, snippet string")
    probes = spark.createDataFrame([("hello@harborlane.example", 250, "ok", False), ("desk@harborlane.example", 550, "no such user", False)], "email string, code int, msg string, is_catch_all boolean")
    return enrichment.Outside(empty(hits), pages_of(spark).limit(0), people, spark.createDataFrame([("harborlane.example", 10, "mx")], "domain string, preference int, exchange string"), probes)


def test_discovery_stops_early(spark):
    s = source(spark)
    none = spark.createDataFrame([], "domain string, hits int")
    every = {r["domain"]: r["hits"] for r in runs.discovered(RunConfig(), s.results, s.blocked, none).collect()}
    assert every == {"harborlane.example": 2, "thin.example": 1, "late.example": 1}
    few = runs.discovered(RunConfig(target=1, candidate_multiplier=2), s.results, s.blocked, none).collect()
    assert {r["domain"] for r in few} == {"harborlane.example", "thin.example"}
    old = spark.createDataFrame([("harborlane.example", 5), ("gone.example", 1)], "domain string, hits int")
    assert {r["domain"]: r["hits"] for r in runs.discovered(RunConfig(), s.results, s.blocked, old).collect()} == {"harborlane.example": 7, "gone.example": 1, "thin.example": 1, "late.example": 1}
    assert {r["domain"]: r["hits"] for r in runs.discovered(RunConfig(target=1, candidate_multiplier=1), s.results, s.blocked, old).collect()} == {"harborlane.example": 5, "gone.example": 1}


def test_run_and_resume(spark, tmp_path):
    config, at, day = RunConfig(target=1, candidate_multiplier=2), f"file://{tmp_path}/runs", F.lit("2024-06-30").cast("date")
    assert runs.run_pipeline(spark, RunConfig(stages=("finalize",)), 7, source(spark), at, day) is None
    given = replace(source(spark), outside=outside(spark))
    done = runs.run_pipeline(spark, config, 7, given, at, day)
    final = {r["domain"]: (r["score"], r["status"]) for r in done.agencies.collect()}
    assert set(final) == {"harborlane.example", "thin.example"} and final["harborlane.example"][0] > final["thin.example"][0]
    marked = {r["domain"]: r["status"] for r in spark.read.parquet(f"{at}/run=7/marked").collect()}
    assert marked == {"harborlane.example": "done", "thin.example": "done"}
    events = spark.read.parquet(f"{at}/events").count()
    lead = done.agencies.where("domain = 'harborlane.example'").first()
    checks = {r["email"]: (r["verification"], r["is_primary"]) for r in done.emails.where("domain = 'harborlane.example'").collect()}
    assert (lead["founder_name"], lead["founder_linkedin"], lead["enrich_stage"]) == ("Mia Stone", "https://www.linkedin.com/in/mia-stone/", "emails_done")
    assert checks["hello@harborlane.example"] == ("smtp_valid", True) and checks["desk@harborlane.example"] == ("invalid", False)
    # A stage whose tables are gone is made again from those before it; the others are read.
    shutil.rmtree(f"{tmp_path}/runs/run=7/emails/emails")
    runs.run_pipeline(spark, config, 7, given, at, day)
    more = spark.read.parquet(f"{at}/events").groupBy("stage").count().where("count > 1").collect()
    assert [r["stage"] for r in more] == ["emails/emails"]
    events = spark.read.parquet(f"{at}/events").count()
    again = runs.run_pipeline(spark, config, 7, given, at, day)
    assert {r["domain"]: (r["score"], r["status"]) for r in again.agencies.collect()} == final and spark.read.parquet(f"{at}/events").count() == events


def test_streamed_candidates_over_batches(spark, tmp_path):
    rows, at = spark.createDataFrame([("a.org",), ("b.org",), ("a.org",)], "domain string"), f"{tmp_path}"
    rows.write.parquet(f"{at}/in/1")
    stream = lambda: spark.readStream.schema("domain string").option("recursiveFileLookup", "true").parquet(f"{at}/in")
    incremental.stream_candidates(stream(), f"{at}/table", f"{at}/log", buckets=3).awaitTermination()
    assert sorted(incremental.newest_version(spark, f"{at}/table", 0).collect()) == [("a.org", 1), ("b.org", 1)]
    spark.createDataFrame([("b.org",), ("c.org",)], "domain string").write.parquet(f"{at}/in/2")
    incremental.stream_candidates(stream(), f"{at}/table", f"{at}/log", buckets=3).awaitTermination()
    assert sorted(incremental.newest_version(spark, f"{at}/table", 1).collect()) == [("a.org", 1), ("b.org", 2), ("c.org", 1)]
    # A batch that is tried again is merged with what was there before it.
    assert sorted(incremental.newest_version(spark, f"{at}/table", 0).collect()) == [("a.org", 1), ("b.org", 1)]


def test_made_up_rows_are_dealt_to_all_tasks(spark, sf):
    rows = site_queries.made_up(spark, sf, "SELECT c_custkey AS k FROM {customer}")
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= spark.sparkContext.defaultParallelism and max(sizes) <= 2 * min(sizes)
