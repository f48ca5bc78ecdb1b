"""Streams with state over several micro-batches, against the batch forms: caches that expire, claims that lapse, engine health."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.streaming import incremental, stateful

OPS = "key string, op_id long, ts timestamp, op string, value string, holder string"


@pytest.fixture(scope="module")
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def ops(n, seed, kinds):
    r, t = random.Random(seed), datetime(2024, 1, 1)
    out = []
    for i in range(n):
        t += timedelta(seconds=r.randint(0, 1500))
        out.append((f"k{r.randrange(5)}", i, t, r.choice(kinds), r.choice([f"v{i}", None, f"w{i}"]), f"run{r.randrange(3)}"))
    return out


def streamed(spark, rows, ddl, make, at, parts=4, mode="append"):
    """What a stream of ``parts`` micro-batches gives, and what a second start with the same checkpoint adds."""
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], ddl).coalesce(1).write.parquet(f"{at}/in/{i}")
    counts = []
    for _ in range(2):
        stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{at}/in")
        query = make(stream).writeStream.outputMode(mode).foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{at}/out/{i}")).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
        query.awaitTermination()
        got = spark.read.option("recursiveFileLookup", "true").parquet(f"{at}/out")
        counts.append(got.count())
    assert counts[0] == counts[1]
    return got


def test_cache_over_batches(rocks, tmp_path):
    rows = ops(240, 1, ["put", "get", "get", "other"])
    want = stateful.cache_reads(rocks.createDataFrame(rows, OPS), 3600).collect()
    got = streamed(rocks, rows, OPS, lambda s: stateful.stream_cache_reads(s, 3600), tmp_path).drop("batch").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == sorted(map(tuple, want), key=lambda r: r[1])
    assert {r.hit for r in want} == {True, False} and any(not r.hit for r in want if r.op_id > 100)


def test_leases_over_batches(rocks, tmp_path):
    rows = ops(200, 2, ["claim", "claim", "claim", "claim", "claim", "claim", "done"])
    want = stateful.lease_outcomes(rocks.createDataFrame(rows, OPS), 1200).collect()
    got = streamed(rocks, rows, OPS, lambda s: stateful.stream_lease_outcomes(s, 1200), tmp_path).drop("batch").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == sorted(map(tuple, want), key=lambda r: r[1])
    kinds = [r.outcome for r in want]
    assert set(kinds) == {"granted", "renewed", "reclaimed", "refused", "done", "void"} and max(sum(r.outcome == "done" for r in want if r.key == k) for k in {r.key for r in want}) == 1


def test_a_killed_batch_is_reclaimed_once(spark):
    at = lambda minute: datetime(2024, 1, 1, 0, minute)
    rows = [("d", 1, at(0), "claim", None, "crashed"), ("d", 2, at(5), "claim", None, "next"), ("d", 3, at(20), "claim", None, "next"), ("d", 4, at(21), "claim", None, "third"), ("d", 5, at(22), "done", None, "crashed"), ("d", 6, at(23), "done", None, "next"), ("d", 7, at(24), "done", None, "next")]
    got = {r.op_id: r.outcome for r in stateful.lease_outcomes(spark.createDataFrame(rows, OPS), 900).collect()}
    assert got == {1: "granted", 2: "refused", 3: "reclaimed", 4: "refused", 5: "void", 6: "done", 7: "void"}
    assert stateful.lease_outcomes(spark.createDataFrame([], OPS)).count() == 0 and stateful.cache_reads(spark.createDataFrame([], OPS)).count() == 0


def test_engine_health_as_a_stream(rocks, tmp_path):
    ddl = "engine string, ts timestamp, outcome string, reason string, n_results int"
    r, t = random.Random(3), datetime(2024, 1, 1)
    rows = [(f"e{r.randrange(3)}", t + timedelta(seconds=7 * i), r.choice(["ok", "ok", "blocked", "failed"]), f"why{i}", r.randrange(9)) for i in range(120)]
    got = streamed(rocks, rows, ddl, incremental.stream_engine_health, tmp_path, mode="update")
    last = got.groupBy("engine").agg(F.max_by(F.struct(*(c for c in got.columns if c not in ("engine", "batch"))), "batch").alias("s")).select("engine", "s.*")
    want = incremental.engine_health(rocks.createDataFrame(rows, ddl))
    columns = want.columns
    assert sorted(map(tuple, last.select(*columns).collect())) == sorted(map(tuple, want.collect()))


def test_a_key_of_many_claims_is_read_in_order_and_never_gathered(spark):
    rows = spark.range(30_000).selectExpr("'d' AS key", "id AS op_id", "timestamp_seconds(id) AS ts", "'claim' AS op", "concat('run', id % 2) AS holder").repartition(4)
    got = stateful.lease_outcomes(rows, 100)
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r.outcome: r["count"] for r in got.groupBy("outcome").count().collect()} == {"granted": 1, "renewed": 14_999, "refused": 15_000}
