"""What a site says about its company, its language and whether it lives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import fixed
from millrace.functions.text import with_language, years_in
from millrace.operators.crawl import newest_date, site_texts

ORG = "name string, foundingDate string, address struct<addressCountry: string, addressLocality: string>, founder string"


def organisations(pages: DataFrame) -> DataFrame:
    """(site, org): the first linked-data organisation of each site's pages (``jsonld``)."""
    items = pages.select("site", "page_ord", F.posexplode("jsonld").alias("at", "raw"))
    kind = F.lower(F.coalesce(F.get_json_object("raw", "$['@type']"), F.lit("")))
    org = items.where(kind.rlike(rf"(^|\W)({'|'.join(fixed.ORG_TYPES)})(\W|$)"))
    return org.groupBy("site").agg(F.min_by(F.from_json("raw", ORG), F.struct("page_ord", "at")).alias("org"))


def guess_name(org: Column, og_site_name: Column, title: Column, site: Column) -> Column:
    """Linked data, then the site name, then the part of the title that echoes the domain or else the shortest, then the domain."""
    named = F.when(F.length(org["name"]).between(3, 79), F.trim(org["name"]))
    own = F.when(F.length(og_site_name).between(1, 79), og_site_name)
    parts = F.filter(F.transform(F.split(title, r"\s[|\-–—:•·]\s|\s*\|\s*"), lambda x: F.trim(x)), lambda p: (p != "") & ~p.rlike(r"(?i)^(home|homepage|welcome|index|untitled.*)$"))
    token = F.replace(F.substring_index(site, ".", 1), F.lit("-"), F.lit(""))
    echo = F.try_element_at(F.filter(parts, lambda p: F.contains(F.regexp_replace(F.lower(p), "[ -]", ""), token)), F.lit(1))
    # The shortest part, the first of equal ones.
    short = F.array_min(F.transform(parts, lambda p, i: F.struct(F.length(p).alias("n"), i.alias("i"), p.alias("p"))))["p"]
    return F.coalesce(named, own, F.substring(F.coalesce(echo, short), 1, 80), F.initcap(F.replace(F.substring_index(site, ".", 1), F.lit("-"), F.lit(" "))))


def location(org: Column, text: Column, site: Column) -> Column:
    """struct(country, city) by linked data, addresses, "based in", cities, countries, and the domain's end, in this order."""
    low = F.lower(text)
    place = lambda country, city: F.struct((F.lit(country) if isinstance(country, str) else country).cast("string").alias("country"), (city if isinstance(city, Column) else F.lit(city)).cast("string").alias("city"))
    title = lambda c: F.initcap(F.lit(c))
    word = lambda w: w.replace(".", r"\.")
    known = lambda c: F.coalesce(F.when(c.isin("US", "USA"), "United States"), *(F.when(F.lower(c) == w, country) for w, country in fixed.COUNTRY_WORDS), c)
    based = F.regexp_extract(text, fixed.BASED_IN, 1)
    cities = [(c, country) for country, names in fixed.CITIES for c in names.split("|")]
    address = org["address"]
    return F.coalesce(
        F.when(address["addressCountry"].isNotNull() | address["addressLocality"].isNotNull(), place(known(address["addressCountry"]), address["addressLocality"])),
        F.when(text.rlike(fixed.US_ADDRESS), place("United States", F.substring(F.trim(F.regexp_extract(text, fixed.US_ADDRESS, 1)), 1, 40))),
        F.when(text.rlike(fixed.AU_ADDRESS), place("Australia", None)),
        F.when(text.rlike(fixed.UK_POSTCODE) & low.rlike("united kingdom| uk|london"), place("United Kingdom", F.when(F.contains(low, F.lit("london")), "London"))),
        F.when(text.rlike(fixed.CA_POSTCODE) & F.contains(low, F.lit("canada")), place("Canada", None)),
        *(F.when(F.lower(based) == c, place(country, based)) for c, country in cities),
        *(F.when((based != "") & (F.lower(based) == w), place(country, None)) for w, country in fixed.COUNTRY_WORDS),
        *(F.when(low.rlike(rf"\b{c}\b"), place(country, title(c))) for c, country in cities),
        *(F.when(low.rlike(rf"\b{word(w)}\b"), place(country, None)) for w, country in fixed.COUNTRY_WORDS if len(w) > 3),
        *(F.when(site.endswith(end), place(country, None)) for end, country in fixed.COUNTRY_TLD),
        place(F.lit(None), None),
    )


def copyright_year(text: Column) -> Column:
    """The latest year behind a copyright sign, else the latest in the last 3000 characters."""
    marked = F.transform(F.regexp_extract_all(text, F.lit(fixed.COPYRIGHT), F.lit(1)), lambda y: y.cast("int"))
    return F.coalesce(F.array_max(marked), F.array_max(years_in(F.right(text, F.lit(3000)))))


def company_facts(pages: DataFrame) -> DataFrame:
    """(site, name, tagline, description, country, city, founded_year, team_size_hint, copyright_year) of parsed pages."""
    home = pages.where("kind = 'home'").groupBy("site").agg(F.min_by(F.struct("title", "og_title", "og_site_name", "meta_description", "headings", "blocks"), "page_ord").alias("home"))
    texts = site_texts(pages, None, 200_000, "all_text").join(site_texts(pages, ["home", "about", "contact"], 60_000, "place_text"), "site", "left")
    df = texts.join(home, "site", "left").join(organisations(pages), "site", "left")
    h, text = F.col("home"), F.col("all_text")
    filled = lambda c: F.when(c != "", c)
    name = guess_name(F.col("org"), h["og_site_name"], F.coalesce(filled(h["title"]), h["og_title"]), F.col("site"))
    heading = F.try_element_at(F.filter(h["headings"], lambda x: F.length(x).between(9, 159)), F.lit(1))
    block = F.try_element_at(F.filter(h["blocks"], lambda b: F.length(b).between(61, 399) & (F.length(b) - F.length(F.replace(b, F.lit(" "), F.lit(""))) > 8)), F.lit(1))
    founded = F.coalesce(F.regexp_extract(F.col("org.foundingDate"), r"^(\d{4})", 1), F.regexp_extract(text, fixed.FOUNDED, 1))
    team = F.regexp_extract(text, fixed.TEAM_SIZE, 1)
    words = F.lower(F.regexp_extract(text, fixed.SIZE_WORDS, 1))
    df = df.withColumn("name", name).withColumn("loc_", location(F.col("org"), F.coalesce("place_text", F.lit("")), F.col("site")))
    return df.select("site", "name", F.coalesce(heading, F.when(filled(h["og_title"]) != F.col("name"), h["og_title"])).alias("tagline"), F.coalesce(filled(h["meta_description"]), block).alias("description"),
                     "loc_.country", "loc_.city", F.when(founded != "", founded).cast("int").alias("founded_year"), F.when(team != "", F.concat(team, F.lit("+ people"))).when(words != "", words).alias("team_size_hint"), copyright_year(text).alias("copyright_year"))


def site_language(pages: DataFrame, model=None) -> DataFrame:
    """(site, language, language_confidence) from the home, about and services pages, by ``model`` if there is one."""
    attr = pages.where("kind = 'home'").groupBy("site").agg(F.min_by("lang_attr", "page_ord").alias("claim"))
    df = with_language(site_texts(pages, ["home", "about", "services"], 12_000).join(attr, "site", "left"), F.col("text"), F.col("claim"), "l_", model=model)
    return df.select("site", F.col("l_.code").alias("language"), F.bround("l_.confidence", 3).alias("language_confidence"))


def site_liveness(pages: DataFrame, as_of: Column, blocked=fixed.BLOCKED_DOMAINS) -> DataFrame:
    """(site, alive, reason, last_activity, stale) of parsed pages (``site, page_ord, kind, url, final_url, title, text, dates``), as of a day.

    ``reason`` is the first that holds of no_home, thin_content, parked_or_placeholder, redirect_to_..., parked_redirect, else ok."""
    from millrace.functions.urls import registrable_domain, suffixes_of

    home = pages.where("kind = 'home'").groupBy("site").agg(F.min_by(F.struct("title", "text", "final_url"), "page_ord").alias("h"))
    dates = pages.groupBy("site").agg(F.flatten(F.collect_list("dates")).alias("dates"))
    years = site_texts(pages, None, 200_000, "all_text").select("site", copyright_year(F.col("all_text")).alias("year"))
    df = dates.join(home, "site", "left").join(years, "site", "left")
    text, url = F.coalesce("h.text", F.lit("")), F.coalesce("h.final_url", F.lit(""))
    to = registrable_domain(url)
    moved = (url != "") & (to != F.col("site"))
    reason = (
        F.when(F.col("h").isNull(), "no_home")
        .when(F.length(text) < 150, "thin_content")
        .when(F.concat_ws("\n", "h.title", F.substring(text, 1, 4000)).rlike(fixed.PARKED) & (F.length(text) < 2500), "parked_or_placeholder")
        .when(moved & (F.arrays_overlap(suffixes_of(to), F.array(*map(F.lit, blocked))) | to.rlike(fixed.PARKING_HOSTS)), F.concat(F.lit("redirect_to_"), to))
        .when(url.rlike(fixed.PARKING_HOSTS) | url.rlike(r"(?i)/(suspended|expired|parked|forsale|for-sale)\b"), "parked_redirect")
        .otherwise("ok")
    )
    df = df.withColumns({"reason": reason, "last": newest_date(F.col("dates"), as_of)})
    day, this = F.try_to_timestamp(F.col("last")).cast("date"), F.year(as_of)
    stale = F.when(F.col("last").isNotNull(), (F.datediff(as_of, day) > 730) & (F.coalesce("year", F.lit(0)) < this - 1)).otherwise(F.coalesce(F.col("year") < this - 2, F.lit(False)))
    alive = F.col("reason") == "ok"
    return df.select("site", alive.alias("alive"), "reason", F.when(alive, F.col("last")).alias("last_activity"), (alive & F.coalesce(stale, F.lit(False))).alias("stale"))
