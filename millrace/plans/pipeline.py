"""The whole way from stored pages to scored leads, as one plan, and the stages that can be run again."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import fixed
from millrace.functions.language import LanguageModel, LanguageTable
from millrace.functions.lexicons import labels_of
from millrace.operators import company, contacts, html, people
from millrace.operators.crawl import admitted_pages, page_ok, site_texts
from millrace.operators.html import parsed_pages
from millrace.operators.scoring import finalized, scored
from millrace.sources.shared import stored

STAGES = ("discover", "crawl", "clients", "founders", "emails", "finalize")


@dataclass(frozen=True)
class RunConfig:
    """Knobs of a run. ``min_score`` 0 is a threshold like any other."""

    target: int = 1000
    countries: tuple[str, ...] = ("us", "uk", "ca", "au")
    engines: tuple[str, ...] = ("google", "bing", "duckduckgo")
    stages: tuple[str, ...] = STAGES
    min_score: int = fixed.MIN_SCORE
    candidate_multiplier: int = 8
    max_pages: int = 14
    max_clients_per_agency: int = 4
    require_named_client: bool = True
    resume: bool = True
    force: bool = False
    bad_email_parts: tuple[str, ...] = field(default=fixed.BAD_EMAIL_PARTS)
    language_model: LanguageModel | LanguageTable | None = None

    def __post_init__(self) -> None:
        if unknown := set(self.stages) - set(STAGES):
            raise ValueError(f"unknown stages: {', '.join(sorted(unknown))}")

    def enough(self, candidates: int) -> bool:
        """Whether discovery may stop between batches."""
        return candidates >= self.target * self.candidate_multiplier


@dataclass(frozen=True)
class Leads:
    """The tables of a run; children refer to agencies by domain."""

    agencies: DataFrame
    emails: DataFrame
    clients: DataFrame
    profiles: DataFrame
    funnels: DataFrame | None = None


def flat_pages(pages: DataFrame) -> DataFrame:
    """Pages (``site, page_ord, kind, url, final_url, status, error, html``) admitted, as plain columns; those that were fetched are parsed, once."""
    df = parsed_pages(pages.where(page_ok(F.col("status"), F.col("error"), F.col("html"))))
    fetched = admitted_pages(df.withColumn("text", F.col("parsed.text")), F.col("text"))
    return fetched.select("site", "page_ord", "kind", "url", "final_url", "html", "text", *(F.col(f"parsed.{c}").alias(c) for c in html.COLUMNS if c != "text"))


def process_sites(pages: DataFrame, as_of: Column, config: RunConfig = RunConfig()) -> Leads:
    """Stored pages to agencies with score and verdict, addresses, clients and profiles. ``pages`` as for ``flat_pages``; ``as_of`` the day that ages are counted from.

    Dead and foreign sites are told apart first; clients and founders are looked for on the others' pages only."""
    # Parsed once, read by every extractor; the same for links and for what several stages need.
    flat = stored(flat_pages(pages), "pages")
    links = stored(contacts.page_links(flat), "links")
    language, alive = stored(company.site_language(flat, config.language_model), "language"), stored(company.site_liveness(flat, as_of), "liveness")
    facts = stored(company.company_facts(flat), "companies")
    english = language.where("language = 'en'").join(alive.where("alive"), "site").select("site")
    own, own_links = flat.join(english, "site", "left_semi"), links.join(english, "site", "left_semi")
    emails = stored(contacts.site_emails(flat, config.bad_email_parts), "emails")
    clients = stored(people.site_clients(own, own_links, facts.select("site", "name"), 25), "clients")
    founder = stored(people.founders(own, own_links), "founders").select("site", *(F.col(c).alias(f"founder_{c}") for c in ("name", "title", "linkedin", "source", "confidence")))
    counts = emails.groupBy("site").agg(F.count("*").alias("n_emails"), F.sum(F.col("same_domain").cast("int")).alias("n_own_emails"))
    shape = flat.withColumn("labels", labels_of(F.substring("html", 1, 600_000), fixed.TECH)).groupBy("site").agg(
        F.bool_or(F.col("kind") == "case_studies").alias("has_case_page"), F.bool_or(F.col("kind") == "clients").alias("has_clients_page"), F.avg((F.col("kind") == "blog").cast("double")).alias("blog_ratio"), F.count("*").alias("pages_crawled"),
        F.max(F.when(F.col("kind") == "home", F.length("text"))).alias("home_chars"), F.min_by(F.concat_ws(" ", "title", "meta_description", "og_title", F.array_join(F.slice("headings", 1, 12), " ")), F.when(F.col("kind") == "home", F.col("page_ord"))).alias("headline"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("tech"),
    )
    first = flat.groupBy("site", "kind").agg(F.min_by("url", "page_ord").alias("url")).groupBy("site").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "url")))).alias("key_pages"))
    core = site_texts(flat, ["home", "services", "industries", "about", "clients", "case_studies"], 150_000, "core_text")
    profiles = contacts.site_profiles(links)
    socials = profiles.groupBy("site").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("network", "url")))).alias("socials"))
    booking, phones = stored(contacts.booking_links(links), "booking"), stored(contacts.site_phones(flat), "phones")
    df = stored(shape, "shape")
    for other in (first, core, language, alive, facts, counts, people.coach_proof(clients), booking, phones, socials, founder, people.company_profiles(links)):
        df = df.join(other, "site", "left")
    df = df.withColumns({"as_of": as_of, "core_text": F.coalesce("core_text", F.lit("")), "dead_reason": F.col("reason"), "home_chars": F.coalesce("home_chars", F.lit(0))}).drop("reason")
    result = scored(stored(df, "facts"), config.min_score, require_client=config.require_named_client).drop("core_text", "headline", "as_of", "dead_reason", "home_chars", "has_case_page", "has_clients_page", "blog_ratio", "n_emails", "n_own_emails", "best_client", "coach_clients")
    return Leads(result.withColumnRenamed("site", "domain"), emails.withColumnRenamed("site", "domain"), clients.withColumnRenamed("site", "domain"), profiles.withColumnRenamed("site", "domain"))


def finalize(leads: Leads, checked_emails: DataFrame, funnels: DataFrame, config: RunConfig = RunConfig()) -> DataFrame:
    """Agencies with their final tier, once addresses are checked (``verification``) and clients' funnels known."""
    return finalized(leads.agencies, checked_emails, leads.clients.withColumn("status", F.lit(None).cast("string")) if "status" not in leads.clients.columns else leads.clients, funnels, config.min_score)


def stage_rows(agencies: DataFrame, stage: str, force: bool = False) -> DataFrame:
    """Agencies that a stage still has to work on, by ``status`` and ``enrich_stage``; ``force`` takes those it has been over too."""
    live = agencies.where(F.col("status").isin("qualified", "review"))
    done = {"clients": ("clients_done", "founders_done", "emails_done"), "founders": ("founders_done",), "emails": ("emails_done",)}[stage]
    return live if force else live.where(F.col("enrich_stage").isNull() | ~F.col("enrich_stage").isin(*done))
