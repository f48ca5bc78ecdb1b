"""Questions to the table of leads: search, detail, counters, export, changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import fixed
from millrace.operators.picks import first_by

LIVE = ("qualified", "review")
SORTS = {"score": "score", "name": "name", "country": "country", "last_activity": "last_activity", "created_at": "created_at"}


def has_child(df: DataFrame, children: DataFrame, on: Column, wanted: bool | None) -> DataFrame:
    """Rows with (True) or without (False) a child; None keeps all."""
    return df if wanted is None else df.join(children, on, "left_semi" if wanted else "left_anti")


def lead_filter(df: DataFrame, q: str | None = None, status: list[str] | None = None, tier: list[str] | None = None, min_score: int = 0, country: str | None = None, user_status: str | None = None, has_linkedin: bool | None = None, columns=("name", "domain", "tagline", "founder_name")) -> DataFrame:
    """``%`` and ``_`` of ``q`` are wildcards; a backslash stands for itself."""
    out = df.where((F.col("score") >= min_score) & F.col("status").isin(*(status or LIVE)))
    if tier:
        out = out.where(F.col("tier").isin(*tier))
    if q:
        like = F.lit("%" + q.replace("\\", "\\\\") + "%")
        cond = F.lit(False)
        for c in columns:
            cond = cond | F.coalesce(F.ilike(F.col(c), like), F.lit(False))
        out = out.where(cond)
    for c, v in (("country", country), ("user_status", user_status)):
        out = out.where(F.col(c) == v) if v else out
    if has_linkedin is not None:
        out = out.where(F.col("founder_linkedin").isNotNull() if has_linkedin else F.col("founder_linkedin").isNull())
    return out


def search_leads(agencies: DataFrame, emails: DataFrame | None = None, clients: DataFrame | None = None, funnels: DataFrame | None = None, *, has_email: bool | None = None, has_client: bool | None = None, has_funnel: bool | None = None, sort: str = "score", descending: bool = True, offset: int = 0, limit: int = 50, **filters) -> DataFrame:
    """A page of leads; ``DataFrame.count()`` of ``matching_leads`` with the same arguments is the total. An unknown sort key is score; ties by domain, descending; 1 to 500 rows."""
    rows = matching_leads(agencies, emails, clients, funnels, has_email=has_email, has_client=has_client, has_funnel=has_funnel, **filters)
    key = F.col(SORTS.get(sort, "score"))
    return rows.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_first(), F.col("domain").desc()).offset(offset).limit(max(1, min(500, limit)))


def matching_leads(agencies: DataFrame, emails: DataFrame | None = None, clients: DataFrame | None = None, funnels: DataFrame | None = None, *, has_email: bool | None = None, has_client: bool | None = None, has_funnel: bool | None = None, **filters) -> DataFrame:
    rows = lead_filter(agencies, **filters)
    child = lambda df: df.select(F.col("domain").alias("child_"))
    on = F.col("domain") == F.col("child_")
    if has_email is not None:
        rows = has_child(rows, child(emails.where(~F.coalesce("verification", F.lit("")).isin(*fixed.DEAD_VERIFICATIONS))), on, has_email)
    if has_client is not None:
        rows = has_child(rows, child(clients), on, has_client)
    return has_child(rows, child(funnels), on, has_funnel) if has_funnel is not None else rows


def best_clients(clients: DataFrame, funnels: DataFrame) -> DataFrame:
    """(domain, client, funnel): of each domain the best client (resolved first, then with funnels, then confidence) and its best funnel; and how many clients."""
    best = first_by(funnels.withColumns({"fd": F.col("domain"), "fn": F.col("client_name")}).drop("domain", "client_name"), ["fd", "fn"], [-F.col("confidence"), F.col("url")])
    rest = [c for c in best.columns if c not in ("fd", "fn")]
    best = best.select("fd", "fn", F.struct(*rest).alias("funnel"))
    df = clients.join(best, (F.col("domain") == F.col("fd")) & (F.col("name") == F.col("fn")), "left").drop("fd", "fn")
    own = [c for c in clients.columns if c != "domain"]
    order = F.struct(F.when(F.col("status") == "resolved", 0).otherwise(1), F.when(F.col("funnel").isNotNull(), 0).otherwise(1), -F.col("confidence"), F.col("name"))
    return df.groupBy("domain").agg(F.min_by(F.struct(*own), order).alias("client"), F.min_by("funnel", order).alias("funnel"), F.count("*").alias("clients_count"))


def lead_summary(agencies: DataFrame, emails: DataFrame, clients: DataFrame, funnels: DataFrame) -> DataFrame:
    """Leads with their address, best client and funnel. Children come as one row for each domain, so a join multiplies nothing."""
    e = emails.groupBy(F.col("domain").alias("ed")).agg(F.min_by(F.struct("email", "verification", "source"), F.struct(F.when(F.col("is_primary"), 0).otherwise(1), "rank", "email")).alias("primary"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "email"))), lambda x: x["email"]).alias("all_emails"))
    c = best_clients(clients, funnels).withColumnRenamed("domain", "cd")
    return agencies.join(e, F.col("domain") == F.col("ed"), "left").join(c, F.col("domain") == F.col("cd"), "left").drop("ed", "cd").withColumn("clients_count", F.coalesce("clients_count", F.lit(0)))


def lead_detail(agencies: DataFrame, emails: DataFrame, clients: DataFrame, funnels: DataFrame) -> DataFrame:
    """Leads with nested ``emails`` (by rank) and ``clients`` (by confidence), and in these ``funnels`` (by confidence)."""
    nest = lambda df, keys, order: F.transform(F.array_sort(F.collect_list(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), F.struct(*(c for c in df.columns if c not in keys)).alias("row")))), lambda x: x["row"])
    f = funnels.groupBy("domain", "client_name").agg(nest(funnels, ("domain", "client_name"), [-F.col("confidence"), F.col("url")]).alias("funnels"))
    c = clients.join(f.toDF("fd", "fn", "funnels"), (F.col("domain") == F.col("fd")) & (F.col("name") == F.col("fn")), "left").drop("fd", "fn")
    c = c.groupBy(F.col("domain").alias("cd")).agg(nest(c, ("domain",), [-F.col("confidence"), F.col("name")]).alias("clients"))
    e = emails.groupBy(F.col("domain").alias("ed")).agg(nest(emails, ("domain",), [F.col("rank"), F.col("email")]).alias("emails"))
    return agencies.join(e, F.col("domain") == F.col("ed"), "left").join(c, F.col("domain") == F.col("cd"), "left").drop("ed", "cd")


def export_rows(agencies: DataFrame, emails: DataFrame, clients: DataFrame, funnels: DataFrame, statuses=LIVE, tiers: list[str] | None = None, min_score: int = 0) -> DataFrame:
    """The export's columns, one row for each lead, nulls as empty texts, in the order tier (none first), score descending, domain."""
    own = agencies.where(F.col("status").isin(*statuses) & (F.col("score") >= min_score))
    own = own.where(F.col("tier").isin(*tiers)) if tiers else own
    s = lead_summary(own, emails, clients, funnels)
    blank = lambda c: F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(""))
    joined = lambda c, sep: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), sep)
    social = lambda n: blank(F.try_element_at("socials", F.lit(n)))
    pairs = F.array_join(F.transform(F.map_entries(F.coalesce("key_pages", F.create_map().cast("map<string,string>"))), lambda x: F.concat(x["key"], F.lit("="), x["value"])), "; ")
    special = {
        "agency_name": blank("name"), "email": blank("primary.email"), "email_verification": blank("primary.verification"), "email_source": blank("primary.source"), "all_emails": joined("all_emails", "; "),
        "linkedin_company": social("linkedin"), "instagram": social("instagram"), "facebook": social("facebook"), "youtube": social("youtube"),
        "services": joined("services", ", "), "icp_signals": joined("icp_signals", ", "), "tech": joined("tech", ", "), "phone": blank(F.try_element_at("phones", F.lit(1))),
        "client_name": blank("client.name"), "client_role": blank("client.role_title"), "client_niche": blank("client.niche"), "client_website": blank("client.website"), "client_evidence": F.substring(blank("client.evidence"), 1, 300),
        "client_evidence_url": blank("client.evidence_url"), "clients_count": F.col("clients_count"), "funnel_url": blank("funnel.url"), "funnel_type": blank("funnel.funnel_type"), "funnel_platform": blank("funnel.platform"), "funnel_offer": blank("funnel.offer"),
        "funnel_price": blank("funnel.price_hint"), "funnel_steps": F.array_join(F.coalesce(F.col("funnel.steps"), F.array().cast("array<string>")), " → "), "description": F.substring(blank("description"), 1, 500), "key_pages": pairs, "score": F.col("score"), "pages_crawled": F.col("pages_crawled"),
    }
    return s.orderBy(F.col("tier").asc_nulls_first(), F.col("score").desc(), "domain").select(*(special.get(c, blank(c) if c not in special else None).alias(c) for c in fixed.EXPORT_COLUMNS))


def export_leads(rows: DataFrame, path: str) -> None:
    """``export_rows`` as CSV files with a header."""
    rows.write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').csv(path)


def lead_stats(agencies: DataFrame, emails: DataFrame, clients: DataFrame, funnels: DataFrame) -> DataFrame:
    """One row of counters over live leads: total, with email, verified, client and funnel, and the average score to one place."""
    live = agencies.where(F.col("status").isin(*LIVE)).select("domain", "score")
    flag = lambda df, name: df.select(F.col("domain").alias(f"d_{name}")).distinct().withColumn(name, F.lit(1))
    out = live
    for name, df in (("with_email", emails.where(~F.coalesce("verification", F.lit("")).isin(*fixed.DEAD_VERIFICATIONS))), ("with_verified", emails.where("verification = 'smtp_valid'")), ("with_client", clients), ("with_funnel", funnels)):
        out = out.join(flag(df, name), F.col("domain") == F.col(f"d_{name}"), "left").drop(f"d_{name}")
    return out.agg(F.count("*").alias("total"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("with_email", "with_verified", "with_client", "with_funnel")), F.bround(F.coalesce(F.avg("score"), F.lit(0.0)), 1).alias("avg_score"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def reject_reasons(df: DataFrame) -> DataFrame:
    """Counts of the part of the reason before its colon."""
    return df.where("reject_reason is not null").groupBy(F.substring_index("reject_reason", ":", 1).alias("reason")).agg(F.count("*").alias("n"))


def patch_lead(agencies: DataFrame, changes: DataFrame) -> DataFrame:
    """``agencies`` with ``status``, ``user_status`` and ``notes`` from ``changes`` (one row for each domain, null: as it was)."""
    c = changes.select(F.col("domain").alias("cd"), *(F.col(x).alias(f"new_{x}") for x in ("status", "user_status", "notes")))
    out = agencies.join(c, F.col("domain") == F.col("cd"), "left")
    return out.withColumns({x: F.coalesce(f"new_{x}", x) for x in ("status", "user_status", "notes")}).select(*agencies.columns)
