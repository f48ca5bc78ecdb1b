"""The stages that enrich a run's leads: clients' websites and funnels, founders' profiles, addresses.

A stage takes the run's tables and stored answers of the outside world (search results, fetched pages, mail hosts, probes) and gives new tables. Each works on the leads that
``stage_rows`` names, marks them in ``enrich_stage``, and leaves all other rows as they are, so that a stage that is run again has nothing to do unless it is forced.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import fixed
from millrace.functions.names import tokens
from millrace.functions.urls import canonicalize, registrable_domain, social_network
from millrace.operators import contacts, funnels, people
from millrace.operators.crawl import site_texts
from millrace.operators.picks import first_by, top_by
from millrace.plans.pipeline import Leads, RunConfig, flat_pages, stage_rows
from millrace.sources.shared import stored

FUNNELS = "domain string, client_name string, url string, funnel_type string, platform string, offer string, price_hint string, steps array<string>, confidence double"


@dataclass(frozen=True)
class Outside:
    """What the outside world answered, as tables: search results for clients (``domain, client_name, rank, url, title, snippet``) and founders (``domain, rank, url, title, snippet``), pages of clients' sites
    (as for ``process_sites``), mail hosts (``domain, preference, exchange``), probes of addresses (``email, code, msg, is_catch_all``), and whether mail servers could be asked at all."""

    client_results: DataFrame
    client_pages: DataFrame
    founder_results: DataFrame
    mail_hosts: DataFrame
    probes: DataFrame
    smtp_open: bool = True


def opened(leads: Leads) -> Leads:
    """Leads as processing gives them, with the columns that the stages fill: nothing checked, resolved or found yet."""
    spark = leads.agencies.sparkSession
    clients = leads.clients.withColumns({"website_source": F.when(F.col("website").isNotNull(), "outbound_link"), "status": F.lit("found")})
    return replace(leads, agencies=leads.agencies.withColumn("enrich_stage", F.lit(None).cast("string")), emails=leads.emails.withColumns({"verification": F.lit("unknown"), "is_primary": F.lit(False)}), clients=clients, funnels=spark.createDataFrame([], FUNNELS))


def _staged(agencies: DataFrame, stage: str, force: bool) -> tuple[DataFrame, DataFrame]:
    """The domains that a stage works on, and ``agencies`` with the mark that it has."""
    todo = stored(stage_rows(agencies, stage, force).select("domain"), f"todo-{stage}")
    mark = todo.select(F.col("domain").alias("marked_"))
    done = agencies.join(mark, F.col("domain") == F.col("marked_"), "left").withColumn("enrich_stage", F.when(F.col("marked_").isNotNull(), f"{stage}_done").otherwise(F.col("enrich_stage")))
    return todo, done.drop("marked_")


def name_tokens(name: Column) -> Column:
    """A name's tokens of two characters or more, without titles and small words."""
    return F.filter(tokens(F.regexp_replace(name, "'s\\b", ""), 2), lambda t: ~t.isin(*fixed.NAME_FILLERS))


def full_name_in(text: Column, name: Column) -> Column:
    """Whether a text has all of a name's tokens, two at least, side by side."""
    toks = name_tokens(name)
    return F.coalesce((F.size(toks) >= 2) & F.regexp_like(F.lower(text), F.concat(F.lit(r"\b"), F.array_join(toks, r"[\s.\-']{1,3}"), F.lit(r"\b"))), F.lit(False))


def domain_echoes(name: Column, domain: Column) -> Column:
    """Whether a domain has the whole name, or the surname with the first letters of the first name."""
    toks, core = name_tokens(name), F.replace(F.substring_index(domain, ".", 1), F.lit("-"), F.lit(""))
    joined, first, last = F.array_join(toks, ""), F.get(toks, F.lit(0)), F.try_element_at(toks, F.lit(-1))
    return F.coalesce(((F.length(joined) >= 6) & F.contains(core, joined)) | ((F.size(toks) >= 2) & (F.length(last) >= 5) & F.contains(core, last) & F.contains(core, F.substring(first, 1, 3))), F.lit(False))


def checked_websites(clients: DataFrame, results: DataFrame, pages: DataFrame, blocked=fixed.BLOCKED_DOMAINS) -> DataFrame:
    """(site, name, website, website_source, status) of each of ``clients`` (``site, name, kind, niche, website``): ``resolved``, ``not_infopreneur`` or ``no_site``.

    The link that the agency gave is tried first, then the best search results of people with two or three names. A site must be there (``pages``, flat, of clients' sites), carry the name in its domain or its front, or for a given link anywhere
    in its text, and be of the trade. A given link that carries the name but isn't of the trade ends the search."""
    own = clients.select("site", "name", "kind", "niche", "website")
    given = own.where("website is not null").select("site", "name", "kind", F.col("website").alias("url"), F.lit("outbound_link").alias("source"), F.lit(0).alias("try"))
    people_only = own.where((F.col("kind") == "person") & F.size(name_tokens(F.col("name"))).between(2, 3))
    hits = people.client_site_hits(people_only, results).select("site", "name", F.lit("person").alias("kind"), "url", F.lit("search").alias("source"), F.col("place").alias("try"))
    tried = given.unionByName(hits).withColumn("dom", registrable_domain(F.col("url"))).where(social_network(F.col("url")).isNull() & ~F.col("dom").isin(*blocked) & ~F.col("dom").rlike(fixed.NOT_CLIENT_DOMAIN))
    home = pages.where("kind = 'home'").groupBy(F.col("site").alias("dom")).agg(F.min_by(F.struct(F.concat_ws(" ", "title", "meta_description", "og_title", F.array_join(F.slice("headings", 1, 10), " ")).alias("head"), F.col("final_url")), "page_ord").alias("h"))
    texts = site_texts(pages, None, 120_000, "all_text").select(F.col("site").alias("tdom"), "all_text")
    known = home.join(texts, F.col("dom") == F.col("tdom")).select("dom", "h.head", "h.final_url", "all_text", people.infopreneur_site(F.col("all_text")).alias("trade"))
    found = tried.join(known, "dom")
    front = domain_echoes(F.col("name"), F.col("dom")) | full_name_in(F.col("head"), F.col("name"))
    named = front | F.when(F.col("kind") == "person", (F.col("source") == "outbound_link") & full_name_in(F.substring("all_text", 1, 40_000), F.col("name"))).otherwise(F.contains(F.lower("head"), F.lower("name")))
    site = F.coalesce(F.nullif("final_url", F.lit("")), "url")
    judged = found.where(named & (F.col("trade") | (F.col("source") == "outbound_link"))).select("site", "name", site.alias("website"), F.col("source").alias("website_source"), F.when(F.col("trade"), "resolved").otherwise("not_infopreneur").alias("status"), "try")
    best = first_by(judged, ["site", "name"], [F.col("try"), F.col("website")]).drop("try")
    return own.select("site", "name").join(best, ["site", "name"], "left").withColumn("status", F.coalesce("status", F.lit("no_site")))


def client_funnels(pages: DataFrame) -> DataFrame:
    """(site, url, funnel_type, ...) of clients' sites: the fetched pages to which a telling link leads, and front pages."""
    entries = funnels.funnel_candidates(contacts.page_links(pages)).select(F.col("site").alias("es"), canonicalize(F.col("url")).alias("ek"), "anchor", "external")
    led = pages.withColumn("key", canonicalize(F.col("url"))).join(entries, (F.col("site") == F.col("es")) & (F.col("kind") != "home") & (F.col("key") == F.col("ek"))).select(*pages.columns, "anchor", "external", F.lit(False).alias("is_home"))
    front = pages.where("kind = 'home'").select("*", F.lit("").alias("anchor"), F.lit(False).alias("external"), F.lit(True).alias("is_home"))
    return funnels.site_funnels(led.unionByName(front))


def enrich_clients(leads: Leads, outside: Outside, config: RunConfig = RunConfig()) -> Leads:
    """Leads with their clients' websites, statuses and funnels: of each lead in turn the most confident clients."""
    todo, agencies = _staged(leads.agencies, "clients", config.force)
    named = lambda df: df.withColumnRenamed("domain", "site")
    mine = leads.clients.join(todo, "domain", "left_semi").where(F.coalesce("status", F.lit("found")).isin(*(("found",) if not config.force else ("found", "resolved", "no_site", "not_infopreneur"))))
    mine = stored(named(top_by(mine, ["domain"], [-F.col("confidence"), F.col("name")], config.max_clients_per_agency)), "clients-todo")
    pages = stored(flat_pages(outside.client_pages), "client-pages")
    sites = stored(checked_websites(mine, named(outside.client_results), pages), "client-sites")
    news = sites.select(F.col("site").alias("ns"), F.col("name").alias("nn"), F.col("website").alias("new_website"), F.col("website_source").alias("new_source"), F.col("status").alias("new_status"))
    clients = leads.clients.join(news, (F.col("domain") == F.col("ns")) & (F.col("name") == F.col("nn")), "left")
    clients = clients.withColumns({"website": F.coalesce("new_website", "website"), "website_source": F.coalesce("new_source", "website_source"), "status": F.coalesce("new_status", "status")}).select(*leads.clients.columns)
    resolved = sites.where("status = 'resolved'").select(F.col("site").alias("domain"), F.col("name").alias("client_name"), registrable_domain(F.col("website")).alias("dom"))
    found = resolved.join(client_funnels(pages).withColumnRenamed("site", "dom"), "dom").select("domain", "client_name", "url", "funnel_type", "platform", "offer", "price_hint", "steps", "confidence")
    kept = leads.funnels.join(sites.select(F.col("site").alias("domain"), F.col("name").alias("client_name")), ["domain", "client_name"], "left_anti").select(*found.columns)
    return replace(leads, agencies=agencies, clients=clients, funnels=kept.unionByName(found))


def enrich_founders(leads: Leads, outside: Outside, config: RunConfig = RunConfig()) -> Leads:
    """Leads with the profiles of founders who have none, as search results tell them."""
    todo, agencies = _staged(leads.agencies, "founders", config.force)
    mine = leads.agencies.join(todo, "domain", "left_semi").where("founder_linkedin is null").select(F.col("domain").alias("site"), "name", F.col("founder_name"))
    known = mine.where("founder_name is not null").select("site", F.col("founder_name").alias("name"))
    hit = people.founders_from_search(known, outside.founder_results.withColumnRenamed("domain", "site"), mine.select("site", "name")).select(F.col("site").alias("hs"), F.col("name").alias("hit_name"), F.col("linkedin").alias("hit_linkedin"), F.col("confidence").alias("hit_confidence"))
    out = agencies.join(hit, F.col("domain") == F.col("hs"), "left")
    found = F.col("hs").isNotNull()
    new = {"founder_name": F.col("hit_name"), "founder_linkedin": F.col("hit_linkedin"), "founder_source": F.lit("serp"), "founder_confidence": F.col("hit_confidence")}
    return replace(leads, agencies=out.withColumns({k: F.when(found, v).otherwise(F.col(k)) for k, v in new.items()}).select(*agencies.columns))


def enrich_emails(leads: Leads, outside: Outside, config: RunConfig = RunConfig()) -> Leads:
    """Leads with checked addresses, usual addresses of those that gave none, and of each the one to write to (``is_primary``)."""
    todo, agencies = _staged(leads.agencies, "emails", config.force)
    columns = leads.emails.columns
    mine, others = leads.emails.join(todo, "domain", "left_semi"), leads.emails.join(todo, "domain", "left_anti")
    fresh = F.coalesce("verification", F.lit("unknown")) == "unknown"
    checked = contacts.with_checks(mine.where(fresh).drop("verification"), outside.mail_hosts, outside.probes, outside.smtp_open).select(*columns)
    guessed = contacts.guessed_emails(todo.join(leads.emails, "domain", "left_anti").select(F.col("domain").alias("site")), outside.mail_hosts, outside.probes, outside.smtp_open).withColumnRenamed("site", "domain")
    guessed = guessed.withColumns({c: F.lit(None).cast(t) for c, t in leads.emails.dtypes if c not in guessed.columns}).withColumn("same_domain", F.lit(True))
    every = stored(mine.where(~fresh).unionByName(checked).unionByName(guessed.select(*columns)), "emails-checked")
    best = contacts.primary_emails(every.withColumnRenamed("domain", "site")).select(F.col("site").alias("ps"), F.col("email").alias("pe"))
    every = every.join(best, (F.col("domain") == F.col("ps")) & (F.col("email") == F.col("pe")), "left").withColumn("is_primary", F.col("ps").isNotNull()).select(*columns)
    return replace(leads, agencies=agencies, emails=every.unionByName(others))


def enriched(leads: Leads, stage: str, outside: Outside, config: RunConfig = RunConfig()) -> Leads:
    """The leads after one of the three stages."""
    return {"clients": enrich_clients, "founders": enrich_founders, "emails": enrich_emails}[stage](leads, outside, config)
