"""Registered queries of whole runs: leads made up from ``customer`` go through the enriching stages to their final tier."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import fixed
from millrace.plans import enrichment
from millrace.plans.pipeline import Leads, finalize
from millrace.plans.queries import query
from millrace.plans.runs import WRITES
from millrace.plans.site_queries import made_up
from millrace.sources.shared import shared_dir, stored
from millrace.sources.tables import table
from millrace.streaming import counters, stateful

_AGENCIES = "SELECT c_custkey AS k, 'a' || c_custkey || '.org' AS domain, 'Acme Growth Agency' AS name, CAST(60 + c_custkey % 30 AS INT) AS score, CASE WHEN c_custkey % 5 = 4 THEN 'rejected' ELSE 'qualified' END AS status, CAST(NULL AS STRING) AS tier, CAST(NULL AS STRING) AS reject_reason, CASE WHEN c_custkey % 2 = 0 THEN 'Ann Baker' END AS founder_name, CAST(NULL AS STRING) AS founder_title, CASE WHEN c_custkey % 6 = 0 THEN 'https://linkedin.com/in/known' END AS founder_linkedin, CAST(NULL AS STRING) AS founder_source, CAST(NULL AS DOUBLE) AS founder_confidence, CASE WHEN c_custkey % 11 = 0 THEN 'emails_done' END AS enrich_stage FROM {customer}"
_EMAILS = "SELECT 'a' || c_custkey || '.org' AS domain, 'office@a' || c_custkey || '.org' AS email, 'mailto' AS source, 'https://x' AS page_url, true AS same_domain, CAST(0.9 AS DOUBLE) AS confidence, 1 AS rank, 'unknown' AS verification, false AS is_primary FROM {customer} WHERE c_custkey % 3 <> 0"
_CLIENTS = "SELECT 'a' || c_custkey || '.org' AS domain, 'Dana Whitfield' AS name, 'person' AS kind, CASE WHEN c_custkey % 10 < 5 THEN 'coach' END AS role_title, CAST(NULL AS STRING) AS niche, 'e' AS evidence, 'u' AS evidence_url, CASE WHEN c_custkey % 4 < 2 THEN 'https://danawhitfield' || c_custkey || '.com/' END AS website, CAST(NULL AS STRING) AS website_source, CAST(0.6 AS DOUBLE) AS confidence, 'found' AS status FROM {customer}"
_TALK = "This is the site of a person who lives and works in a town by the sea, and who is glad to hear from you on any day of the year."
_CLIENT_PAGES = f"""
SELECT 'danawhitfield' || c_custkey || '.com' AS site, 0 AS page_ord, 'home' AS kind, 'https://danawhitfield' || c_custkey || '.com/' AS url, 'https://danawhitfield' || c_custkey || '.com/' AS final_url, 200 AS status, CAST(NULL AS STRING) AS error,
  CASE WHEN c_custkey % 4 = 1 THEN '<html><head><title>Dana Whitfield</title></head><body><p>{_TALK}</p></body></html>'
  ELSE '<html><head><title>Dana Whitfield</title></head><body><p>{_TALK}</p><p>A course for every coach. Enroll now and join my program.</p><a href="/free-webinar">Watch the free training</a></body></html>' END AS html FROM {{customer}} WHERE c_custkey % 4 < 3
UNION ALL SELECT 'danawhitfield' || c_custkey || '.com', 1, 'other', 'https://danawhitfield' || c_custkey || '.com/free-webinar', 'https://danawhitfield' || c_custkey || '.com/free-webinar', 200, NULL,
  '<html><head><title>Free webinar</title></head><body><h1>Free webinar: register today</h1><p>{_TALK}</p><form><input type="email" name="email"><input type="tel" name="phone"></form><script src="https://js.stripe.com/v3"></script><iframe src="https://webinarjam.com/x"></iframe></body></html>' FROM {{customer}} WHERE c_custkey % 8 IN (0, 2)
"""
_CLIENT_HITS = "SELECT 'a' || c_custkey || '.org' AS domain, 'Dana Whitfield' AS client_name, 1 AS rank, 'https://danawhitfield' || c_custkey || '.com/home?x=1' AS url, 'Dana Whitfield, coach' AS title, 'course' AS snippet FROM {customer} WHERE c_custkey % 4 <> 3"
_FOUNDER_HITS = "SELECT 'a' || c_custkey || '.org' AS domain, 1 AS rank, 'https://www.linkedin.com/in/ann-baker-77' AS url, 'Ann Baker - Founder - Acme Growth | LinkedIn' AS title, '' AS snippet FROM {customer} WHERE c_custkey % 7 <> 1"
_HOSTS = "SELECT 'a' || c_custkey || '.org' AS domain, 10 AS preference, 'mx' AS exchange FROM {customer} WHERE c_custkey % 7 <> 0"
_PROBES = """
SELECT 'office@a' || c_custkey || '.org' AS email, CASE WHEN c_custkey % 2 = 0 THEN 250 ELSE 550 END AS code, 'no such user' AS msg, false AS is_catch_all FROM {customer}
UNION ALL SELECT 'info@a' || c_custkey || '.org', 250, 'ok', c_custkey % 9 = 0 FROM {customer} UNION ALL SELECT 'hello@a' || c_custkey || '.org', 550, 'gone', false FROM {customer}
"""


def made_up_leads(spark: SparkSession, sf_dir: str) -> tuple[Leads, enrichment.Outside]:
    """Leads and what the outside world answers about them."""
    t = lambda sql: made_up(spark, sf_dir, sql)
    none = spark.createDataFrame([], "domain string, network string, url string")
    leads = Leads(t(_AGENCIES).drop("k"), t(_EMAILS), t(_CLIENTS), none, spark.createDataFrame([], enrichment.FUNNELS))
    return leads, enrichment.Outside(t(_CLIENT_HITS), t(_CLIENT_PAGES), t(_FOUNDER_HITS), t(_HOSTS), t(_PROBES))


_LIVE = "(k % 5 <> 4)"
_TODO = f"({_LIVE} AND k % 11 <> 0)"


@query(f"""
WITH c AS (SELECT c_custkey AS k, 'a' || c_custkey || '.org' AS domain, (60 + c_custkey % 30)::INT AS score FROM customer),
s AS (SELECT *, CASE WHEN NOT {_TODO} THEN 'found' WHEN k % 4 IN (0, 2) THEN 'resolved' WHEN k % 4 = 1 THEN 'not_infopreneur' ELSE 'no_site' END AS client_status,
  CASE WHEN {_TODO} AND k % 2 = 0 THEN 1 + CASE WHEN k % 8 IN (0, 2) THEN 1 ELSE 0 END ELSE 0 END AS funnels,
  CASE WHEN k % 3 = 0 THEN CASE WHEN {_LIVE} AND k % 7 <> 0 THEN CASE WHEN k % 9 = 0 THEN 'catch_all' ELSE 'smtp_valid' END END
       WHEN NOT {_LIVE} THEN 'unknown' WHEN k % 7 = 0 THEN 'no_mx' WHEN k % 2 = 0 THEN 'smtp_valid' ELSE 'invalid' END AS verification FROM c),
f AS (SELECT *, coalesce(verification NOT IN ('no_mx', 'invalid') AND (k % 3 <> 0 OR verification = 'smtp_valid'), false) AS mail, k % 10 < 5 OR client_status = 'resolved' AS coach,
  CASE WHEN k % 3 = 0 THEN 'info@' ELSE 'office@' END || domain AS email FROM s),
r AS (SELECT *, CASE WHEN NOT {_LIVE} THEN NULL WHEN mail AND coach AND (funnels > 0 OR score >= {fixed.MIN_SCORE} + 10) THEN 'A' WHEN mail THEN 'B' ELSE 'C' END AS tier FROM f)
SELECT domain, tier, CASE WHEN NOT {_LIVE} THEN 'rejected' WHEN tier IN ('A', 'B') THEN 'qualified' ELSE 'review' END AS status, CASE WHEN {_LIVE} OR k % 11 = 0 THEN 'emails_done' END AS enrich_stage, client_status,
  CASE WHEN k % 4 < 2 OR client_status = 'resolved' THEN 'https://danawhitfield' || k || '.com/' END AS website, funnels, verification,
  CASE WHEN {_LIVE} AND verification NOT IN ('no_mx', 'invalid') THEN email END AS primary_email,
  CASE WHEN k % 6 = 0 THEN 'https://linkedin.com/in/known' WHEN {_LIVE} AND k % 7 <> 1 THEN 'https://www.linkedin.com/in/ann-baker-77/' END AS founder_linkedin FROM r
""")
def run_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads after the stages clients, founders, emails and finalize: websites checked or searched, funnels, founders' profiles, addresses checked or guessed, and the tier that follows. Rejected leads stay as they are, and clients of leads whose clients are done."""
    leads, outside = made_up_leads(spark, sf_dir)
    for stage in ("clients", "founders", "emails"):
        done = enrichment.enriched(leads, stage, outside)
        leads = replace(done, **{n: stored(getattr(done, n), f"{stage}-{n}") for n in WRITES[stage]})
    final = finalize(leads, leads.emails, leads.funnels)
    c = leads.clients.select("domain", F.col("status").alias("client_status"), "website")
    n = leads.funnels.groupBy("domain").agg(F.count("*").cast("int").alias("funnels"))
    e = leads.emails.groupBy("domain").agg(F.max("verification").alias("verification"), F.max(F.when(F.col("is_primary"), F.col("email"))).alias("primary_email"))
    out = final.join(c, "domain", "left").join(n, "domain", "left").join(e, "domain", "left")
    return out.select("domain", "tier", "status", "enrich_stage", "client_status", "website", F.coalesce("funnels", F.lit(0)).alias("funnels"), "verification", "primary_email", "founder_linkedin")


@query("""
WITH o AS (SELECT event_type || user_id % 50 AS key, event_id AS op_id, ts, CASE WHEN event_id % 4 = 0 THEN 'put' ELSE 'get' END AS op, CASE WHEN event_id % 12 <> 0 THEN 'v' || event_id END AS value FROM events)
SELECT g.key, g.op_id, CASE WHEN p.value IS NOT NULL AND epoch_us(g.ts) - epoch_us(p.ts) <= 7200000000 THEN p.value END AS value, coalesce(p.value IS NOT NULL AND epoch_us(g.ts) - epoch_us(p.ts) <= 7200000000, false) AS hit
FROM (SELECT * FROM o WHERE op = 'get') g LEFT JOIN LATERAL (SELECT p.value, p.ts FROM o p WHERE p.op = 'put' AND p.key = g.key AND (p.ts < g.ts OR p.ts = g.ts AND p.op_id < g.op_id) ORDER BY p.ts DESC, p.op_id DESC LIMIT 1) p ON true
""")
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as puts into and gets from a cache whose entries live for two hours."""
    e = table(spark, sf_dir, "events")
    ops = e.select(F.concat("event_type", F.col("user_id") % 50).alias("key"), F.col("event_id").alias("op_id"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_id") % 4 == 0, "put").otherwise("get").alias("op"), F.when(F.col("event_id") % 12 != 0, F.concat(F.lit("v"), "event_id")).alias("value"))
    return stateful.cache_reads(ops, 7200).drop("ts")


_LEASE_OPS = "SELECT 'd' || user_id % 400 AS key, event_id AS op_id, ts, CASE WHEN event_type = 'purchase' THEN 'done' ELSE 'claim' END AS op, 'run' || event_id % 3 AS holder, row_number() OVER (PARTITION BY user_id % 400 ORDER BY ts, event_id) AS i FROM events"


@query(f"""
WITH RECURSIVE o AS MATERIALIZED ({_LEASE_OPS}),
f(key, i, op_id, holder, outcome, by_, at_, closed) AS (
  SELECT key, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::TIMESTAMP, false FROM (SELECT DISTINCT key FROM o)
  UNION ALL
  SELECT key, i, op_id, holder, outcome, CASE WHEN outcome IN ('granted', 'renewed', 'reclaimed') THEN holder ELSE by_ END, CASE WHEN outcome IN ('granted', 'renewed', 'reclaimed') THEN ts ELSE at_ END, closed OR outcome = 'done'
  FROM (SELECT f.key, o.i, o.op_id, o.ts, o.holder, f.by_, f.at_, f.closed, CASE WHEN o.op = 'done' THEN CASE WHEN f.by_ = o.holder AND NOT f.closed THEN 'done' ELSE 'void' END WHEN f.closed THEN 'void' WHEN f.by_ IS NULL THEN 'granted'
    WHEN f.by_ = o.holder THEN 'renewed' WHEN epoch_us(o.ts) - epoch_us(f.at_) > 3600000000 THEN 'reclaimed' ELSE 'refused' END AS outcome FROM f JOIN o ON o.key = f.key AND o.i = f.i + 1))
SELECT key, op_id, holder, outcome FROM f WHERE i > 0
""")
def lease_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as claims of three runs on domains, and work done: what is granted, renewed, reclaimed after an hour, refused, done once, or void."""
    e = table(spark, sf_dir, "events")
    ops = e.select(F.concat(F.lit("d"), F.col("user_id") % 400).alias("key"), F.col("event_id").alias("op_id"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "purchase", "done").otherwise("claim").alias("op"), F.concat(F.lit("run"), F.col("event_id") % 3).alias("holder"))
    return stateful.lease_outcomes(ops).drop("ts")


_CHANGES = "SELECT 'd' || o_custkey AS domain, CASE o_orderstatus WHEN 'F' THEN 'qualified' WHEN 'O' THEN 'review' ELSE 'rejected' END AS status, CASE WHEN o_orderstatus <> 'P' THEN substr(o_orderpriority, 1, 1) END AS tier, CAST(o_orderkey % 100 AS INT) AS score, CASE WHEN o_orderstatus = 'P' THEN 'low_score' END AS reject_reason, o_orderkey AS ts, CAST(o_orderkey % 3 AS INT) AS batch FROM {orders}"


@query(f"""
WITH l AS (SELECT domain, arg_max({{'status': status, 'tier': tier, 'score': score, 'reason': reject_reason}}, (batch, ts)) AS r FROM ({_CHANGES.replace('{orders}', 'orders')}) GROUP BY domain)
SELECT measure, key, count(*)::BIGINT AS n FROM (SELECT unnest([{{'measure': 'status', 'key': r.status}}, {{'measure': 'tier', 'key': r.tier}}, {{'measure': 'reason', 'key': r.reason}}, {{'measure': 'leads', 'key': 'all'}}], recursive := true) FROM l) WHERE key IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'score', 'sum', sum(r.score)::BIGINT FROM l
""")
def counters_followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of leads after three batches of changes, each taken in by what it changes."""
    path, changes = shared_dir(spark), made_up(spark, sf_dir, _CHANGES)
    for n in range(3):
        counters.count_changes(changes.where(F.col("batch") == n), n, path)
    return counters.lead_counters(spark, path, 2)
