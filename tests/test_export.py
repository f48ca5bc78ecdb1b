"""The export as files: rows in order over all parts, values that need quotes, the header."""

import csv
from pathlib import Path

from pyspark.sql import functions as F

from millrace.operators import leads
from millrace.plans import queries


#: Columns of leads that the driver's tables don't stand for.
LEADS = (
    dict.fromkeys(("website", "founder_title", "founder_source", "city", "booking_url", "last_activity", "description"), "string") | dict.fromkeys(("services", "icp_signals", "tech", "phones"), "array<string>")
    | dict.fromkeys(("socials", "key_pages"), "map<string,string>") | {"pages_crawled": "int"}
)


def test_files_in_order(spark, sf, tmp_path):
    a, e, c, f = queries._lead_tables(spark, sf)
    none = lambda df, kinds: df.withColumns({n: F.lit(None).cast(t) for n, t in kinds.items() if n not in df.columns})
    full = none(a, LEADS).withColumn("name", F.concat("name", F.lit(' "the", one')))
    c, f = none(c, dict.fromkeys(("niche", "website", "evidence", "evidence_url"), "string")), none(f, dict.fromkeys(("platform", "offer", "price_hint"), "string") | {"steps": "array<string>"})
    rows = leads.export_rows(full, e, c, f)
    leads.export_leads(rows, f"file://{tmp_path}/out")
    parts = sorted(Path(f"{tmp_path}/out").glob("part-*.csv"))
    got = [r for p in parts for r in csv.DictReader(p.open(newline=""))]
    want = sorted(full.where("status in ('qualified', 'review') and score >= 0").select("tier", "score", "domain").collect(), key=lambda r: (r.tier is not None, r.tier or "", -r.score, r.domain))
    assert [(r["tier"], r["score"], r["domain"]) for r in got] == [(r.tier or "", str(r.score), r.domain) for r in want] and len(got) > 20
    assert got[0]["agency_name"].endswith(' "the", one') and list(got[0]) == rows.columns
