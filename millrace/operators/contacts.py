"""Addresses, profiles, booking links and telephones of sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import fixed
from millrace.functions.contacts import booking_score, email_confidence, emails_on_page, local_bucket, phones_in
from millrace.functions.urls import absolutize, registrable_domain, social_network, social_ok
from millrace.operators.picks import first_by, ranked


def site_emails(pages: DataFrame, bad_parts=fixed.BAD_EMAIL_PARTS, most: int = 12) -> DataFrame:
    """(site, email, source, page_url, same_domain, confidence, rank) of pages (``site, page_ord, kind, url, html, text``).

    Of an address found twice the more confident finding counts, then the first. People of the site's own domain come first,
    then general addresses, then others; ``most`` for a site."""
    found = pages.select("site", "page_ord", "kind", F.col("url").alias("page_url"), F.posexplode(emails_on_page(F.col("html"), F.col("text"), bad_parts)).alias("found_ord", "e"))
    found = found.select("*", "e.email", "e.source").drop("e").withColumn("domain_", registrable_domain(F.substring_index("email", "@", -1)))
    same = (F.col("domain_") == F.col("site")) | F.col("site").endswith(F.col("domain_")) | F.col("domain_").endswith(F.col("site"))
    found = found.withColumn("same_domain", same).withColumn("confidence", email_confidence(F.col("kind"), F.col("source"), F.col("same_domain"), F.col("email"), F.col("domain_")))
    best = first_by(found, ["site", "email"], [-F.col("confidence"), F.col("page_ord"), F.col("found_ord")])
    order = [F.when(F.col("same_domain"), 0).otherwise(1), local_bucket(F.col("email")), -F.bround("confidence", 2), F.col("page_ord"), F.col("found_ord"), F.col("email")]
    return ranked(best, ["site"], order, most=most).select("site", "email", "source", "page_url", "same_domain", F.bround("confidence", 3).alias("confidence"), "rank")


def primary_emails(emails: DataFrame) -> DataFrame:
    """The one address of each site to write to (``emails`` with ``verification``): found before guessed, verified before not, own domain first; none where the best is dead."""
    order = F.when(F.col("verification") == "smtp_valid", 0).when(F.col("verification") == "catch_all", 1).when(F.col("verification") == "mx_valid", 2).when(F.col("verification") == "unverified", 3).otherwise(4)
    best = first_by(emails, ["site"], [F.when(F.col("source") == "guessed", 1).otherwise(0), order, F.when(F.col("same_domain"), 0).otherwise(1), F.col("rank"), F.col("email")])
    return best.where(~F.coalesce("verification", F.lit("")).isin(*fixed.DEAD_VERIFICATIONS))


def page_links(pages: DataFrame) -> DataFrame:
    """(site, page_ord, kind, page_url, link_ord, href, anchor, url, domain, network) of pages with ``links``; links that aren't http are left out."""
    out = pages.select("site", "page_ord", "kind", F.col("url").alias("page_url"), F.posexplode("links").alias("link_ord", "l")).select("site", "page_ord", "kind", "page_url", "link_ord", "l.href", "l.anchor")
    out = out.withColumn("url", absolutize(F.col("page_url"), F.col("href"))).where(F.col("url").isNotNull())
    return out.withColumns({"domain": registrable_domain(F.col("url")), "network": social_network(F.col("url"))})


def site_profiles(links: DataFrame) -> DataFrame:
    """(site, network, url): the first proper profile on each network, without its query."""
    net = links.where(F.col("network").isNotNull() & social_ok(F.col("url"), F.col("network")))
    return first_by(net.select("site", "network", "page_ord", "link_ord", F.substring_index("url", "?", 1).alias("url")), ["site", "network"], [F.col("page_ord"), F.col("link_ord")]).select("site", "network", "url")


def booking_links(links: DataFrame) -> DataFrame:
    """(site, booking_url): the link that most likely books a meeting, the first on ties."""
    scored = links.where("network is null").withColumn("score", booking_score(F.col("url"), F.col("anchor"), F.col("domain") == F.col("site"))).where("score > 0")
    return first_by(scored.select("site", "page_ord", "link_ord", "url", "score"), ["site"], [-F.col("score"), F.col("page_ord"), F.col("link_ord")]).select("site", F.col("url").alias("booking_url"))


def site_phones(pages: DataFrame, most: int = 3) -> DataFrame:
    """(site, phones): the first numbers on the home, contact and about pages."""
    own = pages.where(F.col("kind").isin("home", "contact", "about")).select("site", "page_ord", phones_in(F.col("text")).alias("p"))
    every = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page_ord", "p"))), lambda x: x["p"]))
    return own.groupBy("site").agg(F.slice(F.array_distinct(every), 1, most).alias("phones"))


def with_checks(emails: DataFrame, mx_records: DataFrame, probes: DataFrame, smtp_open: bool = True) -> DataFrame:
    """``emails`` with ``verification``, from mail hosts (``domain, preference, exchange``) and probes (``email, code, msg, is_catch_all``)."""
    from millrace.functions.contacts import verification

    hosts = mx_records.groupBy(F.lower("domain").alias("domain_")).agg(F.count("*").alias("hosts_"))
    probed = probes.groupBy(F.lower("email").alias("probe_")).agg(F.max_by(F.struct("code", "msg", "is_catch_all"), F.struct("code", "msg")).alias("p_"))
    out = emails.withColumn("d_", F.lower(F.substring_index("email", "@", -1))).join(hosts, F.col("d_") == F.col("domain_"), "left").join(probed, F.lower("email") == F.col("probe_"), "left")
    verdict = F.when(~F.contains("email", F.lit("@")), "invalid").otherwise(verification(F.col("hosts_"), F.lit(smtp_open), F.col("p_.code"), F.col("p_.msg"), F.col("p_.is_catch_all")))
    return out.withColumn("verification", verdict).drop("d_", "domain_", "hosts_", "probe_", "p_")


def guessed_emails(domains: DataFrame, mx_records: DataFrame, probes: DataFrame, smtp_open: bool = True, locals_=fixed.GUESSED_LOCALS, most: int = 2) -> DataFrame:
    """(site, email, source, verification, confidence, rank): usual addresses of domains (``site``) that have mail hosts.

    With probes only those that answer stay, up to the first where every address would; without, all are kept."""
    tried = domains.select("site", F.posexplode(F.array(*map(F.lit, locals_))).alias("n", "local")).select("site", "n", F.concat("local", F.lit("@"), "site").alias("email"))
    checked = with_checks(tried, mx_records, probes, smtp_open)
    if smtp_open:
        stop = checked.where("verification = 'catch_all'").groupBy(F.col("site").alias("s_")).agg(F.min("n").alias("stop_"))
        checked = checked.join(stop, F.col("site") == F.col("s_"), "left").where(F.col("verification").isin("smtp_valid", "catch_all") & (F.col("stop_").isNull() | (F.col("n") <= F.col("stop_")))).drop("s_", "stop_")
    else:
        checked = checked.where("verification <> 'no_mx'")
    out = ranked(checked, ["site"], [F.col("n")], "r", most=most)
    return out.select("site", "email", F.lit("guessed").alias("source"), "verification", F.when(F.col("verification") == "smtp_valid", 0.35).otherwise(0.2).alias("confidence"), (F.col("r") + 100).alias("rank"))
