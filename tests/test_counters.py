"""Counters kept by deltas equal the counts of all leads, after every batch and after one that is tried again."""

import random

from pyspark.sql import functions as F

from millrace.streaming import counters

DDL = f"{counters.LEAD}, ts int"


def changes(seed, n, at):
    r = random.Random(seed)
    return [(f"d{r.randrange(25)}.org", r.choice(["qualified", "review", "rejected"]), r.choice(["A", "B", None]), r.choice([None, r.randrange(100)]), r.choice(["low_score", None]), at + i) for i in range(n)]


def test_counters_follow_changes(spark, tmp_path):
    at, state = f"file://{tmp_path}/counters", {}
    want = lambda: {tuple(r) for r in counters.counted(spark.createDataFrame([(d, *v) for d, v in state.items()], counters.LEAD)).where("n <> 0").collect()}
    got = lambda n: {tuple(r) for r in counters.lead_counters(spark, at, n).collect()}
    after = []
    for n, size in enumerate((12, 1, 30)):
        rows = changes(n, size, 100 * n)
        state |= {r[0]: r[1:5] for r in rows}
        counters.count_changes(spark.createDataFrame(rows, DDL), n, at, 4)
        after.append(want())
        assert got(n) == after[n]
    # The second batch again: the same, and so are those before it.
    counters.count_changes(spark.createDataFrame(changes(1, 1, 100), DDL), 1, at, 4)
    assert [got(n) for n in range(2)] == after[:2]


def test_as_a_stream(spark, tmp_path):
    rows = changes(7, 40, 0)
    for i in range(2):
        spark.createDataFrame(rows[i * 20 : (i + 1) * 20], DDL).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    for _ in range(2):
        stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        counters.stream_lead_counters(stream, f"file://{tmp_path}/c", f"{tmp_path}/log", 3).awaitTermination()
    leads = {r[0]: r[1:5] for r in rows}
    total = counters.lead_counters(spark, f"file://{tmp_path}/c", 9).where("measure in ('leads', 'score')").select("measure", F.col("n").cast("int")).collect()
    assert {tuple(r) for r in total} == {("leads", len(leads)), ("score", sum(v[2] or 0 for v in leads.values()))}
