"""Runs: what a run claims, what it marks as done, its events, state and statistics, and its stages in order.

A run's tables are DataFrames in and out; only ``run_pipeline`` writes, into a folder of its own, and can be called again with the same number: stages whose
result is there are not repeated unless ``force`` is set.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import leads
from millrace.operators.discovery import crawl_queue
from millrace.operators.merges import admissible
from millrace.plans.enrichment import Outside, enriched, opened
from millrace.plans.pipeline import Leads, RunConfig, finalize, process_sites
from millrace.sources.shared import stored

EVENT = "run_id long, ts timestamp, level string, stage string, message string"


def claim(candidates: DataFrame, run_id: int, most: int, force: bool = False) -> DataFrame:
    """``candidates`` (``domain, hits, status, run_id``) of which the first ``most`` new ones, by hits and domain, now belong to the run; with ``force`` also those done before.

    What is claimed by another run stays with it."""
    open_ = ("new", "done") if force else ("new",)
    taken = crawl_queue(candidates, open_, most).select(F.col("domain").alias("taken_"))
    own = F.col("taken_").isNotNull()
    return candidates.join(taken, F.col("domain") == F.col("taken_"), "left").withColumns({"status": F.when(own, "claimed").otherwise(F.col("status")), "run_id": F.when(own, F.lit(run_id)).otherwise(F.col("run_id"))}).drop("taken_")


def mark(candidates: DataFrame, run_id: int, outcomes: DataFrame) -> DataFrame:
    """The run's claims with their ``outcomes`` (``domain, reject_reason``): done, or new again where it came to none. Marking twice changes nothing."""
    o = outcomes.groupBy(F.col("domain").alias("od")).agg(F.min("reject_reason").alias("why"))
    own = (F.col("status") == "claimed") & (F.col("run_id") == run_id)
    df = candidates.join(o, F.col("domain") == F.col("od"), "left")
    status = F.when(own, F.when(F.col("od").isNotNull(), "done").otherwise("new")).otherwise(F.col("status"))
    return df.withColumns({"status": status, "reject_reason": F.when(own & F.col("od").isNotNull(), F.col("why")).otherwise(F.col("reject_reason"))}).select(*candidates.columns)


def append_events(events: DataFrame, path: str) -> None:
    """Appends to an event log; ``sources.tables.event_tail`` reads it from a cursor on."""
    events.write.mode("append").parquet(path)


def run_statistics(candidates: DataFrame, agencies: DataFrame) -> DataFrame:
    """One row for each run: candidates by status, and agencies by status, of those it has claimed."""
    c = candidates.where("run_id is not null").join(agencies.select(F.col("domain").alias("ad"), F.col("status").alias("verdict")), F.col("domain") == F.col("ad"), "left")
    count = lambda cond, name: F.count_if(cond).alias(name)
    return c.groupBy("run_id").agg(F.count("*").alias("claimed"), count(F.col("status") == "done", "done"), count(F.col("verdict") == "qualified", "qualified"), count(F.col("verdict") == "review", "review"), count(F.col("reject_reason").isNotNull(), "rejected"))


def run_list(runs: DataFrame, limit: int = 50) -> DataFrame:
    """The newest runs first (``run_id, state, started_at, finished_at``), with the seconds of those that have ended."""
    seconds = F.unix_timestamp("finished_at") - F.unix_timestamp("started_at")
    return runs.withColumn("seconds", seconds).orderBy(F.desc("run_id")).limit(limit)


def cancelled(runs: DataFrame, run_id: int, at: Column) -> DataFrame:
    """A run that is going on is cancelled; one that has ended stays as it is."""
    going = (F.col("run_id") == run_id) & F.col("state").isin("queued", "running")
    return runs.withColumns({"finished_at": F.when(going, at).otherwise(F.col("finished_at")), "state": F.when(going, "cancelled").otherwise(F.col("state"))})


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as a JSON object, nulls included (``json``)."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def console_lines(df: DataFrame, width: int = 24) -> DataFrame:
    """Each row as one line of columns of equal width, as a terminal shows them; longer values are cut."""
    return df.select(F.rtrim(F.concat_ws(" ", *(F.rpad(F.substring(F.coalesce(F.col(c).cast("string"), F.lit("-")), 1, width), width, " ") for c in df.columns))).alias("line"))


@dataclass(frozen=True)
class RunInput:
    """Stored search results in batches (``batch, url``), stored pages (as for ``process_sites``), domains never taken, and what the outside world answers to the enriching stages."""

    results: DataFrame
    pages: DataFrame
    blocked: DataFrame
    outside: Outside | None = None


def discovered(config: RunConfig, results: DataFrame, blocked: DataFrame, old: DataFrame) -> DataFrame:
    """(domain, hits) after the batches of ``results``, in order, up to the one with which there are enough candidates.

    All batches are admitted in one pass. How many new domains each brings tells where the search stops; a domain's hits are the batches up to there that have it."""
    rows = stored(admissible(results, blocked).select("batch", "domain").distinct(), "admitted")
    first = rows.join(old.select("domain"), "domain", "left_anti").groupBy("domain").agg(F.min("batch").alias("batch"))
    new = {r.batch: r.n for r in first.groupBy("batch").agg(F.count("*").alias("n")).collect()}
    there, used = old.count(), []
    for batch in sorted(r.batch for r in rows.select("batch").distinct().collect()):
        if config.enough(there):
            break
        there += new.get(batch, 0)
        used.append(batch)
    hits = rows.where(F.col("batch").isin(used)).groupBy("domain").agg(F.count("*").alias("n")) if used else rows.limit(0).select("domain", F.lit(0).cast("long").alias("n"))
    return old.join(hits.withColumnRenamed("domain", "found"), F.col("domain") == F.col("found"), "full").select(F.coalesce("domain", "found").alias("domain"), (F.coalesce("hits", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("int").alias("hits"))


#: Tables that each stage writes.
WRITES = {"crawl": ("agencies", "emails", "clients", "profiles", "funnels"), "clients": ("agencies", "clients", "funnels"), "founders": ("agencies",), "emails": ("agencies", "emails")}


def run_pipeline(spark: SparkSession, config: RunConfig, run_id: int, source: RunInput, path: str, as_of: Column) -> Leads | None:
    """The stages of ``config.stages``, in order, with their tables and events under ``path``; returns the leads as far as the run has come, or None before any are there.

    Each stage writes the tables that it changes into a folder of its own and reads those of the stages before it. With ``resume`` a stage whose tables are there is read, not repeated; ``force`` repeats all. The enriching stages need
    ``source.outside``. An early stop of the search follows ``config.enough``."""

    def table(name: str) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{path}/run={run_id}/{name}")
        except AnalysisException:
            return None

    def stage(name: str, make) -> DataFrame:
        have = table(name) if config.resume and not config.force else None
        if have is None:
            make().write.mode("overwrite").parquet(f"{path}/run={run_id}/{name}")
            append_events(spark.range(1).select(F.lit(run_id).cast("long").alias("run_id"), F.current_timestamp().alias("ts"), F.lit("info").alias("level"), F.lit(name).alias("stage"), F.lit("done").alias("message")), f"{path}/events")
            have = table(name)
        return have

    def tables(name: str, make) -> dict[str, DataFrame]:
        """The tables of a stage; all are made again where one is missing."""
        names = [f"{name}/{n}" for n in WRITES[name]]
        made = make() if config.force or not config.resume or any(table(n) is None for n in names) else None
        return {n.split("/")[1]: stage(n, lambda n=n: getattr(made, n.split("/")[1])) for n in names}

    def candidates() -> DataFrame:
        none = spark.createDataFrame([], "domain string, hits int")
        found = discovered(config, source.results, source.blocked, none)
        return claim(found.select("domain", "hits", F.lit("new").alias("status"), F.lit(None).cast("long").alias("run_id"), F.lit(None).cast("string").alias("reject_reason")), run_id, config.target * config.candidate_multiplier)

    if "discover" not in config.stages and table("candidates") is None:
        return None
    claimed = stage("candidates", candidates)
    if "crawl" not in config.stages and table("crawl/agencies") is None:
        return None
    own = source.pages.join(claimed.where("status = 'claimed'").select(F.col("domain").alias("site")), "site", "left_semi")
    got = Leads(**tables("crawl", lambda: opened(process_sites(own, as_of, config))))
    stage("marked", lambda: mark(claimed, run_id, got.agencies.select("domain", "reject_reason")))
    for name in ("clients", "founders", "emails"):
        if name in config.stages and source.outside is not None:
            got = replace(got, **tables(name, lambda name=name, got=got: enriched(got, name, source.outside, config)))
    if "finalize" in config.stages:
        got = replace(got, agencies=stage("final", lambda: finalize(got, got.emails, got.funnels, config)))
    return got


def run_response(agencies: DataFrame, emails: DataFrame, clients: DataFrame, funnels: DataFrame, **filters) -> DataFrame:
    """A page of leads as JSON rows, as a service answers."""
    return json_rows(leads.search_leads(agencies, emails, clients, funnels, **filters))
