"""Counts over leads, kept as leads change: a batch of changes takes back what each changed lead counted for and adds what it counts for now."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

LEAD = "domain string, status string, tier string, score int, reject_reason string"
COUNTERS = "measure string, key string, n long"


def counted(leads: DataFrame, sign: int = 1) -> DataFrame:
    """COUNTERS of leads: how many of each status, tier and reason of rejection (a null one counts for nothing), their number, and the sum of their scores."""
    each = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(c).alias("key"), F.lit(sign).cast("long").alias("n")) for m, c in (("status", "status"), ("tier", "tier"), ("reason", "reject_reason"))),
                   F.struct(F.lit("leads").alias("measure"), F.lit("all").alias("key"), F.lit(sign).cast("long").alias("n")), F.struct(F.lit("score").alias("measure"), F.lit("sum").alias("key"), (F.coalesce("score", F.lit(0)) * sign).cast("long").alias("n")))
    return leads.select(F.explode(each).alias("c")).select("c.*").where("key is not null").groupBy("measure", "key").agg(F.sum("n").alias("n"))


def _newest(spark: SparkSession, path: str, last: int) -> list[str]:
    """Files of the newest version of each bucket up to batch ``last``."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
        files = files.select("path", F.regexp_extract("path", r"/bucket=(\d+)/", 1).alias("b"), F.regexp_extract("path", r"/v=(\d+)/", 1).cast("int").alias("v")).where(F.col("v") <= last)
        return [r.path for r in files.join(files.groupBy("b").agg(F.max("v").alias("v")), ["b", "v"]).select("path").collect()]
    except AnalysisException:  # nothing has been written yet
        return []


def _read(spark: SparkSession, files: list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def lead_counters(spark: SparkSession, path: str, last: int) -> DataFrame:
    """COUNTERS after batch ``last``."""
    return _read(spark, _newest(spark, f"{path}/counters", last), COUNTERS)


def count_changes(batch: DataFrame, number: int, path: str, buckets: int = 16) -> None:
    """Takes one batch of changed leads (LEAD and ``ts``) into the counters and the leads that they count.

    Of a lead changed twice the later row counts. Leads are kept in buckets of domains; a batch rewrites those it touches, in one job, as a version of its own. It reads older versions only, so a batch that is tried again gives the same."""
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64("domain"), F.lit(buckets)).cast("int")
    columns = [c.split()[0] for c in LEAD.split(", ")]
    new = batch.where("domain is not null").groupBy("domain").agg(F.max_by(F.struct(*columns[1:]), F.struct("ts", *columns[1:])).alias("r")).select("domain", "r.*").withColumn("bucket", bucket).persist()
    try:
        known = _read(spark, _newest(spark, f"{path}/leads", number - 1), LEAD)
        touched = new.select("bucket").distinct()
        old = known.withColumn("bucket", bucket).join(F.broadcast(touched), "bucket", "left_semi")  # as many rows as there are buckets at most
        before = old.join(new.select("domain"), "domain", "left_semi")
        delta = counted(new).unionByName(counted(before, -1)).unionByName(lead_counters(spark, path, number - 1))
        delta.groupBy("measure", "key").agg(F.sum("n").alias("n")).where("n <> 0").coalesce(1).write.mode("overwrite").parquet(f"{path}/counters/v={number}")
        kept = old.join(new.select("domain"), "domain", "left_anti").select(*columns, "bucket")
        kept.unionByName(new.select(*columns, "bucket")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/leads/v={number}")
    finally:
        new.unpersist()


def stream_lead_counters(changes: DataFrame, path: str, checkpoint: str, buckets: int = 16) -> StreamingQuery:
    """Counters of a stream of changed leads."""
    return changes.writeStream.foreachBatch(lambda df, n: count_changes(df, n, path, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
