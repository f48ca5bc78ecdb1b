"""Work that goes on as rows arrive: candidate merges, engine health, windowed counts, event tails."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from millrace.functions import fixed
from millrace.operators.merges import merge_candidates

HEALTH = "engine string, queries long, results long, blocked long, failures long, disabled boolean, cooldown_until timestamp, last_error string"


class EngineHealth:
    """How an engine's answers change its state: a block cools it down, longer each time; failures in a row switch it off."""

    def __init__(self, cooldown: int = fixed.COOLDOWN_SECONDS, most_failures: int = fixed.MAX_FAILURES):
        self.cooldown, self.most = cooldown, most_failures

    start = (0, 0, 0, 0, False, None, None)

    def step(self, state: tuple, ts, outcome: str, reason: str | None, n: int | None) -> tuple:
        queries, results, blocked, failures, disabled, until, error = state
        if outcome == "ok":
            return (queries + 1, results + int(n or 0), blocked, 0, disabled, until, error)
        failures += 1
        if outcome == "blocked":
            blocked += 1
            until = pd.Timestamp(ts) + pd.Timedelta(seconds=self.cooldown * min(4, blocked))
        return (queries, results, blocked, failures, disabled or failures >= self.most, until, reason)


def engine_health(events: DataFrame, rules: EngineHealth | None = None) -> DataFrame:
    """State of each engine after all its events (``engine, ts, outcome, reason, n_results``), in order of time (ties: outcome, then n_results).

    What needs the order are the failures in a row, a running count of answers that went well, and the number of blocks before the last one; the rest is counted before the
    shuffle. An engine without failures has no error, one without blocks no cooldown; an empty table gives an empty one."""
    rules = rules or EngineHealth()
    ok = F.col("outcome") == "ok"
    along = Window.partitionBy("engine").orderBy("ts", "outcome", "n_results").rowsBetween(Window.unboundedPreceding, 0)
    runs = events.withColumn("run_", F.sum(ok.cast("int")).over(along)).groupBy("engine", "run_").agg(F.sum((~ok).cast("int")).alias("fails"))
    streaks = runs.groupBy(F.col("engine").alias("engine_")).agg(F.max_by("fails", "run_").alias("failures"), (F.max("fails") >= rules.most).alias("disabled"))
    at = F.struct("ts", "outcome", "n_results")
    sums = events.groupBy("engine").agg(
        F.count_if(ok).alias("queries"), F.coalesce(F.sum(F.when(ok, F.coalesce("n_results", F.lit(0)))), F.lit(0)).cast("long").alias("results"), F.count_if(F.col("outcome") == "blocked").alias("blocked"),
        F.max(F.when(F.col("outcome") == "blocked", F.col("ts"))).alias("last_block"), F.max_by("reason", F.when(~ok, at)).alias("last_error"),
    )
    until = F.col("last_block") + F.make_dt_interval(secs=rules.cooldown * F.least(F.lit(4), F.col("blocked")))
    return sums.join(streaks, F.col("engine").eqNullSafe(F.col("engine_"))).select("engine", "queries", "results", "blocked", F.col("failures").cast("long").alias("failures"), "disabled", F.when(F.col("blocked") > 0, until).alias("cooldown_until"), "last_error")


class HealthProcessor(StatefulProcessor):
    """The same state kept over micro-batches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("health", "queries long, results long, blocked long, failures long, disabled boolean, cooldown_until timestamp, last_error string")
        self.rules = EngineHealth()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = tuple(self.state.get()) if self.state.exists() else self.rules.start
        for pdf in rows:
            for r in pdf.sort_values(["ts", "outcome", "n_results"]).itertuples():
                state = self.rules.step(state, r.ts, r.outcome, r.reason, r.n_results)
        self.state.update(tuple(None if x is pd.NaT else x for x in state))
        yield pd.DataFrame([(key[0], *state)], columns=["engine", "queries", "results", "blocked", "failures", "disabled", "cooldown_until", "last_error"])

    def close(self) -> None:
        pass


def stream_engine_health(events: DataFrame) -> DataFrame:
    """``events`` as a stream; needs the RocksDB state store."""
    return events.groupBy("engine").transformWithStateInPandas(HealthProcessor(), HEALTH, "Update", "None")


def stream_candidates(batches: DataFrame, path: str, checkpoint: str, buckets: int = 16) -> StreamingQuery:
    """Merges each micro-batch's domains (``domain``) into a candidate table, kept in ``buckets`` of domains: ``path/bucket=<b>/v=<batch>``.

    A batch rewrites the buckets that it touches, each from its newest older version. A batch that is tried again finds the same older versions and writes its own
    again, so hits are counted once."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        dealt = batch.select("domain", F.pmod(F.xxhash64("domain"), F.lit(buckets)).cast("int").alias("bucket")).persist()
        try:
            for b in sorted(r["bucket"] for r in dealt.select("bucket").distinct().collect()):
                old = newest_version(spark, path, number - 1, b)
                merge_candidates(old, dealt.where(F.col("bucket") == b).select("domain")).write.mode("overwrite").parquet(f"{path}/bucket={b}/v={number}")
        finally:
            dealt.unpersist()

    return batches.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_version(spark: SparkSession, path: str, last: int, bucket: int | None = None) -> DataFrame:
    """The candidate table (domain, hits) after batch ``last``, or one bucket of it: of each bucket the newest version that is not younger."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    none = spark.createDataFrame([], "domain string, hits int")
    try:
        files = found.load(path).select("path", F.regexp_extract("path", r"/bucket=(\d+)/", 1).cast("int").alias("b"), F.regexp_extract("path", r"/v=(\d+)/", 1).cast("int").alias("v")).where(F.col("v") <= last)
        files = files if bucket is None else files.where(F.col("b") == bucket)
        newest = files.join(files.groupBy("b").agg(F.max("v").alias("v")), ["b", "v"]).select("path").collect()
    except AnalysisException:  # nothing has been written yet
        return none
    return spark.read.schema("domain string, hits int").parquet(*(r["path"] for r in newest)) if newest else none


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events and value of each type in tumbling windows, late ones up to ``late``. The plan is the same for streams and tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
