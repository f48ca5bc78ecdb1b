"""Registered queries of the lead engine over sites made up from ``customer``: one SQL text makes the input for Spark and for the oracle alike.

What an oracle computes it states itself, by its own expressions or by what the made-up input must give; only word lists and patterns, which are
parameters of the operators, are shared.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import fixed, names, text, urls
from millrace.operators import company, contacts, crawl, funnels, merges, people, scoring
from millrace.operators.html import NODES
from millrace.plans.queries import AS_OF, query
from millrace.sources.shared import stored
from millrace.sources.tables import table


def made_up(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of a query in which ``{customer}`` and the like stand for the driver's tables.

    A narrow table is few row groups, so few tasks would do all the work on its rows: they are dealt to as many as the session's shuffles have, and every core at least."""
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spark.sql(sql, **{t: table(spark, sf_dir, t).repartition(n) for t in set(re.findall(r"\{(\w+)\}", sql))})


def duck(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql)


# --- functions ------------------------------------------------------------------------------------------------------

_URLS = """
SELECT c_custkey AS k, CASE c_custkey % 9
  WHEN 0 THEN 'https://www.linkedin.com/in/Ann-Baker-' || c_custkey || '?x=1' WHEN 1 THEN 'http://facebook.com/groups/' || c_custkey WHEN 2 THEN 'https://m.youtube.com/@chan' || c_custkey
  WHEN 3 THEN 'shop' || c_custkey || '.test/a.PDF?b=1' WHEN 4 THEN '//cdn' || c_custkey || '.test/app.js' WHEN 5 THEN 'HTTPS://User@Blog.Site' || c_custkey || '.test:8080/p'
  WHEN 6 THEN 'https://x.com/intent/tweet?text=' || c_custkey WHEN 7 THEN 'https://linkedin.com/posts/' || c_custkey ELSE '  site' || c_custkey || '.test  ' END AS url FROM {customer}
"""


@query(rf"""
WITH u AS ({duck(_URLS)}), f AS (SELECT k, url, CASE k % 9 WHEN 3 THEN 'https://' || url WHEN 4 THEN 'https:' || url WHEN 8 THEN 'https://' || trim(url) ELSE url END AS full_url FROM u),
h AS (SELECT *, lower(regexp_extract(full_url, '^[^:]+://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host FROM f)
SELECT k, full_url, host, CASE WHEN host LIKE '%facebook.com' THEN 'facebook' WHEN host LIKE '%linkedin.com' THEN 'linkedin' WHEN host LIKE '%youtube.com' THEN 'youtube' WHEN host = 'x.com' THEN 'twitter' END AS network,
  k % 9 IN (3, 4) AS asset, CASE WHEN k % 9 = 0 THEN 'ann-baker-' || k END AS slug, CASE k % 9 WHEN 0 THEN TRUE WHEN 2 THEN TRUE WHEN 1 THEN FALSE WHEN 6 THEN FALSE WHEN 7 THEN FALSE END AS profile, k % 9 = 2 AS tube FROM h
""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = made_up(spark, sf_dir, _URLS)
    full = urls.ensure_scheme(F.col("url"))
    network = urls.social_network(full)
    return u.select("k", full.alias("full_url"), urls.host_of(F.col("url")).alias("host"), network.alias("network"), urls.looks_like_asset(F.col("url")).alias("asset"), urls.profile_slug(F.col("url")).alias("slug"),
                    F.when(network.isNotNull(), urls.social_ok(full, network)).alias("profile"), urls.same_site(full, F.lit("https://youtube.com/")).alias("tube"))


@query("SELECT c_custkey AS k, 'https://t' || c_custkey || '.test/p?x=' || c_custkey || '&y=a b/ü' AS by_code, 'https://t' || c_custkey || '.test/p?x=' || c_custkey || '&y=a b/ü' AS by_parameter, 'https://plain.test/' || c_custkey AS plain FROM customer")
def redirect_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets wrapped as two search engines wrap them, and unwrapped again."""
    c = made_up(spark, sf_dir, "SELECT c_custkey AS k, 'https://t' || c_custkey || '.test/p?x=' || c_custkey || '&y=a b/ü' AS u, 'https://plain.test/' || c_custkey AS plain FROM {customer}")
    code = F.rtrim(F.translate(F.base64(F.encode("u", "UTF-8")), "+/", "-_"), F.lit("="))
    wrapped = F.concat(F.lit("https://search.test/ck/a?p=1&u=a1"), F.regexp_replace(code, "[\r\n]", ""))
    link = F.concat(F.lit("//other.test/l/?uddg="), F.url_encode("u"), F.lit("&amp;rut=1"))
    return c.select("k", urls.decode_search_redirect(wrapped).alias("by_code"), urls.unwrap_redirect(link).alias("by_parameter"), urls.unwrap_redirect(urls.decode_search_redirect(F.col("plain"))).alias("plain"))


_PEOPLE = """
SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'Ann' WHEN 1 THEN 'Bruno' WHEN 2 THEN 'Chloe' ELSE 'Devon' END AS f, CASE c_custkey % 3 WHEN 0 THEN 'Baker' WHEN 1 THEN 'Castillo' ELSE 'Dunmore' END AS l FROM {customer}
"""


@query(rf"""
WITH p AS ({duck(_PEOPLE)})
SELECT k, CASE k % 6 WHEN 0 THEN f || ' ' || l WHEN 1 THEN f || ' ' || l WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN f || ' ' || l ELSE NULL END AS client,
  CASE k % 6 WHEN 0 THEN f || ' ' || l WHEN 4 THEN f || ' ' || l END AS founder, k % 5 IN (0, 1, 3) AS slug_fits, k % 5 IN (0, 1) AS domain_fits,
  CASE k % 4 WHEN 0 THEN 'Founder' WHEN 1 THEN 'CEO of Northwind' WHEN 2 THEN 'co-founder & CEO' END AS title, CASE k % 4 WHEN 0 THEN 'business coach' WHEN 1 THEN 'CEO of' WHEN 2 THEN 'coach' END AS role,
  CASE k % 4 WHEN 0 THEN 'business coaching' WHEN 2 THEN 'coaching' END AS niche FROM p
""")
def people_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as pages print them, cleaned; founders' names, titles, roles and niches; and which slugs and domains fit a name."""
    p = made_up(spark, sf_dir, _PEOPLE).withColumn("name", F.concat_ws(" ", "f", "l"))
    k, n = F.col("k"), F.col("name")
    raw = F.when(k % 6 == 0, n).when(k % 6 == 1, F.concat(F.lit("by "), n, F.lit("'s"))).when(k % 6 == 2, F.concat(F.lit("Dr "), F.col("f"))).when(k % 6 == 3, F.lower(n)).when(k % 6 == 4, F.concat(F.lit(" Meet  "), F.col("f"), F.lit("  "), F.col("l"), F.lit(" - "))).otherwise(F.lit("Our Results"))
    said = F.when(k % 6 == 0, F.concat(F.lit("I'm "), n)).when(k % 6 == 1, F.concat(n, F.lit(" Media"))).when(k % 6 == 2, F.col("f")).when(k % 6 == 3, F.lower(n)).when(k % 6 == 4, F.concat(F.lit("- Coach "), n, F.lit(","))).otherwise(F.lit("Our Story"))
    low = F.lower("f"), F.lower("l")
    slug = F.when(k % 5 == 0, F.concat_ws("-", *low, F.lit("8a7b6c"))).when(k % 5 == 1, F.concat(*low)).when(k % 5 == 2, F.concat(low[0], F.lit("smith"))).when(k % 5 == 3, F.concat(low[1], F.substring(low[0], 1, 3))).otherwise(F.lit("nobody"))
    site = F.when(k % 5 == 0, F.concat(*low, F.lit(".test"))).when(k % 5 == 1, F.concat(low[0], F.lit("-"), low[1], F.lit(".test"))).when(k % 5 == 2, F.concat(low[0], F.lit(".test"))).when(k % 5 == 3, F.lit("media.test")).otherwise(F.lit("x.test"))
    told = F.when(k % 4 == 0, F.concat(n, F.lit(", Founder. A business coach for teams"))).when(k % 4 == 1, F.concat(n, F.lit(" is CEO of Northwind. A course creator"))).when(k % 4 == 2, F.concat(n, F.lit(", co-founder & CEO, and a coach."))).otherwise(F.concat(n, F.lit(" likes walks.")))
    role = names.role_near(told, n)
    return p.select("k", names.clean_name(raw, F.lit("person")).alias("client"), names.ok_founder_name(said).alias("founder"), names.name_matches_slug(n, slug).alias("slug_fits"), names.name_on_domain(n, site).alias("domain_fits"),
                    names.title_in(told).alias("title"), role.alias("role"), names.niche(role, F.lit("")).alias("niche"))


_NEEDLE = "that"


@query(rf"""
WITH d AS (SELECT doc_id, text, lower(text) AS low FROM documents), s AS (SELECT *, strpos(low, '{_NEEDLE}') AS pos FROM d),
w AS (SELECT *, substr(text, greatest(pos - 40, 1), pos - greatest(pos - 40, 1) + 4 + 40) AS part FROM s),
c AS (SELECT doc_id, text, pos, {"".join("replace(" for _ in range(11))}part{"".join(f", '{a}', '{b}')" for a, b in (("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "''"), ("&#x27;", "''"), ("&apos;", "''"), ("&rsquo;", "''"), ("&amp;", "&")))} AS part FROM w)
SELECT doc_id, array_to_string(regexp_extract_all(text, '\b(199\d|20[0-4]\d)\b', 1), ',') AS years,
  CASE WHEN pos = 0 THEN '' ELSE replace(trim(regexp_replace(regexp_replace(regexp_replace(part, '[ \t\r\f\v]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '^\s+|\s+$', '', 'g')), chr(10), ' ') END AS snippet FROM c WHERE text IS NOT NULL
""")
def text_finds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years in texts, and what stands around a word."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.array_join(F.transform(text.years_in(F.col("text")), lambda y: y.cast("string")), ",").alias("years"), text.snippet_around(F.col("text"), F.lit(_NEEDLE), 40).alias("snippet"))


_TITLES = """
SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN 'Top ' || c_custkey % 90 || ' Facebook Ads Agencies for Coaches' WHEN 1 THEN 'Acme Growth: a Meta Ads Agency' WHEN 2 THEN '7 best funnel companies to hire'
  WHEN 3 THEN 'Best 10 cake companies' WHEN 4 THEN 'Agencies for coaches and ads' ELSE 'A page' END AS title, CASE WHEN c_custkey % 12 = 5 THEN 'https://a.test/best-10-ads-agencies' ELSE 'https://a.test/x' END AS url,
  CASE WHEN c_custkey % 2 = 0 THEN 'kajabi wordpress' ELSE 'wix.com calendly' END AS tech FROM {customer}
"""


@query(rf"WITH t AS ({duck(_TITLES)}) SELECT k, k % 6 IN (0, 2, 4) OR k % 12 = 5 AS listicle, CASE WHEN k % 2 = 0 THEN 'kajabi' ELSE 'wix' END AS platform FROM t")
def list_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = made_up(spark, sf_dir, _TITLES)
    return t.select("k", text.is_listicle(F.col("title"), F.lit(""), F.col("url")).alias("listicle"), text.first_of(fixed.FUNNEL_PLATFORMS, text.labels_matching(F.col("tech"), fixed.TECH)).alias("platform"))


_HITS = (("the", "the"), ("and", "and"), ("of", "of"), ("zebra", "zebra"))


@query("WITH n AS (SELECT doc_id, unnest([" + ", ".join(f"struct_pack(label := '{label}', ord := {i}, n := least(30, len(regexp_extract_all(text, '(?i){p}'))))" for i, (label, p) in enumerate(_HITS)) + "], recursive := true) FROM documents WHERE text IS NOT NULL) SELECT doc_id, string_agg(label || ':' || n, ',' ORDER BY n DESC, ord) AS labels FROM n WHERE n > 0 GROUP BY doc_id")
def labels_by_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of each text in the order of their matches, at most 30 of each."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.label_counts(F.col("text"), _HITS).alias("c"))
    return d.where(F.size("c") > 0).select("doc_id", F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["label"], x["n"].cast("string"))), ",").alias("labels"))


# --- scores ---------------------------------------------------------------------------------------------------------

#: Phrases that make up a site's text; which of them a site has follows from its key.
_FACTS = """
WITH c AS (SELECT c_custkey AS k FROM {customer})
SELECT 's' || k || '.test' AS site,
  repeat(CASE k % 5 WHEN 0 THEN 'We run facebook ads and google ads. ' WHEN 1 THEN 'We build sales funnel pages and youtube ads. ' WHEN 2 THEN 'We bake bread. ' WHEN 3 THEN 'Lead generation and media buying with booked calls. ' ELSE 'We do seo and copywriting. ' END, 1 + k % 4)
  || repeat(CASE k % 7 WHEN 0 THEN 'For coaches with an online course business. ' WHEN 1 THEN 'For coaches of football. ' WHEN 2 THEN 'For course creators and webinars. ' WHEN 3 THEN 'For bakers. ' WHEN 4 THEN 'High ticket memberships and masterminds. ' WHEN 5 THEN 'Consultants and experts. ' ELSE 'Infopreneurs. ' END, 1 + k % 3)
  || CASE k % 11 WHEN 0 THEN 'Start free trial. Sign up free. ' WHEN 1 THEN 'Careers at us: open positions. ' WHEN 2 THEN 'The top 10 marketing agencies. ' WHEN 3 THEN 'Find an agency here. ' WHEN 4 THEN 'Hire me. ' WHEN 5 THEN 'Lesson 1. Lesson 2. ' ELSE 'Our clients and our team get results. ' END AS core_text,
  CASE WHEN k % 6 = 0 THEN 'Facebook ads for coaches' WHEN k % 6 = 1 THEN 'Funnels' ELSE 'Welcome' END AS headline,
  CASE WHEN k % 4 = 0 THEN NULL ELSE CAST((k % 10) / 10.0 AS DOUBLE) END AS best_client, CAST(CASE WHEN k % 4 = 0 THEN NULL ELSE k % 3 END AS INT) AS coach_clients, k % 2 = 0 AS has_case_page, k % 3 = 0 AS has_clients_page,
  CASE WHEN k % 5 < 2 THEN 'https://calendly.com/x' END AS booking_url, CASE k % 6 WHEN 0 THEN '2024-01-05' WHEN 1 THEN '2023-02-01' WHEN 2 THEN '2022-03-01' WHEN 3 THEN '2019-01-01' END AS last_activity, k % 13 = 0 AS stale,
  CAST(CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN 2 ELSE 1 END AS INT) AS n_emails, CAST(CASE k % 6 WHEN 1 THEN 1 ELSE 0 END AS INT) AS n_own_emails, CAST(CASE WHEN k % 17 = 0 THEN 30000 ELSE 900 END AS INT) AS home_chars,
  CAST(CASE WHEN k % 9 = 0 THEN 0.75 ELSE 0.25 END AS DOUBLE) AS blog_ratio, k % 23 <> 0 AS alive, 'thin_content' AS dead_reason, CASE WHEN k % 19 = 0 THEN 'fr' ELSE 'en' END AS language, CAST(CASE WHEN k % 29 = 0 THEN 0.5 ELSE 0.9 END AS DOUBLE) AS language_confidence FROM c
"""


def _hits(column: str, lexicon, cap: int = 30) -> str:
    return "[" + ", ".join(f"struct_pack(label := '{label}', n := least({cap}, len(regexp_extract_all({column}, '(?i){p.replace(chr(39), chr(39) * 2)}'))))" for label, p in lexicon) + "]"


def _any(column: str, lexicon, labels) -> str:
    return " OR ".join(f"(list_contains({labels}, '{label}') AND regexp_matches({column}, '(?i){p}'))" for label, p in lexicon)


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_ONLINE = r"(?i)\b(online|digital|program|course|webinar|funnel|high[- ]?ticket|clients|calls)\b"
_SCORES_SQL = f"""
WITH f AS ({duck(_FACTS)}),
h AS (SELECT *, {_hits('core_text', fixed.SERVICES)} AS svc, {_hits('core_text', fixed.ICP)} AS icp, {_hits('core_text', fixed.NON_AGENCY, 5)} AS na, {" + ".join(f"regexp_matches(core_text, '(?i){p}')::INT" for p in fixed.AGENCY_SIGNALS)} AS agency_hits FROM f),
n AS (SELECT *, list_filter(svc, lambda x: x.n > 0 AND list_contains({_list(fixed.ACQUISITION)}, x.label)) AS acq, list_filter(icp, lambda x: x.n > 0 AND list_contains({_list(fixed.CORE_ICP)}, x.label)) AS core,
  list_transform(list_filter(svc, lambda x: x.n > 0), lambda x: x.label) AS svc_names, map_from_entries(list_transform(na, lambda x: struct_pack(k := x.label, v := x.n))) AS bad FROM h),
p AS (SELECT *, least(25.0, len(acq) * 4 + coalesce(list_sum(list_transform(acq, lambda x: least(x.n, 8))), 0) * 0.6) + CASE WHEN {_any('headline', fixed.SERVICES, 'list_transform(acq, lambda x: x.label)')} THEN 6 ELSE 0 END AS s1,
  least(25.0, len(core) * 3.5 + least(12.0, coalesce(list_sum(list_transform(core, lambda x: x.n)), 0) / greatest(1.0, length(core_text) / 1000.0) * 2.5)) + CASE WHEN {" OR ".join(f"regexp_matches(headline, '(?i){p}')" for label, p in fixed.ICP if label in fixed.CORE_ICP)} THEN 8 ELSE 0 END AS s2 FROM n),
q AS (SELECT *, least(25.0, s1) AS services_score, CASE WHEN len(core) = 1 AND core[1].label = 'coaches' AND NOT regexp_matches(core_text, '{_ONLINE}') THEN least(25.0, s2) * 0.4 ELSE least(25.0, s2) END AS icp_score,
  least(25.0, coalesce(best_client, 0) * 20 + CASE WHEN coalesce(coach_clients, 0) >= 2 THEN 5 ELSE 0 END) AS client_score,
  least(10.0, agency_hits * 1.5 + CASE WHEN has_case_page THEN 2 ELSE 0 END + CASE WHEN booking_url IS NOT NULL THEN 1.5 ELSE 0 END + CASE WHEN has_clients_page THEN 1 ELSE 0 END) AS agency_score,
  CASE WHEN stale THEN 0 WHEN last_activity IS NULL THEN 4 WHEN last_activity >= '2023' THEN 10 WHEN last_activity >= '2022' THEN 6 ELSE 2 END AS fresh_score,
  CASE WHEN coalesce(n_own_emails, 0) > 0 THEN 5 WHEN coalesce(n_emails, 0) > 0 THEN 3 ELSE 0 END AS contact_score,
  list_filter([CASE WHEN bad['saas'] >= 2 AND len(acq) = 0 THEN 'saas' END, CASE WHEN bad['job_board'] > 0 THEN 'job_board' END, CASE WHEN bad['listicle'] > 0 AND NOT regexp_matches(core_text, '(?i)our (clients|services|team)') THEN 'listicle' END,
    CASE WHEN bad['directory'] > 0 THEN 'directory' END, CASE WHEN bad['course_platform'] >= 2 AND len(acq) = 0 THEN 'course_platform' END, CASE WHEN contains(core_text, 'Hire me') AND NOT regexp_matches(core_text, '(?i)our team|agency') THEN 'solo' END,
    CASE WHEN home_chars > 25000 AND len(acq) = 0 THEN 'content_site' END, CASE WHEN blog_ratio > 0.5 THEN 'blog_heavy' END], lambda x: x IS NOT NULL) AS flags FROM p),
t AS (SELECT *, coalesce(list_sum(list_transform(flags, lambda x: CASE x WHEN 'listicle' THEN 20 WHEN 'content_site' THEN 10 WHEN 'solo' THEN 5 WHEN 'blog_heavy' THEN 5 ELSE 15 END)), 0) AS penalties FROM q),
v AS (SELECT *, round_even(greatest(0.0, least(100.0, services_score + icp_score + client_score + agency_score + fresh_score + contact_score - penalties)), 0)::INT AS total,
  CASE WHEN len(acq) = 0 THEN 'no_acquisition_services' WHEN len(core) = 0 THEN 'no_infopreneur_icp' WHEN list_has_any(flags, ['listicle', 'directory', 'job_board']) THEN 'not_an_agency:' || array_to_string(flags, ',') WHEN icp_score < 5 THEN 'weak_icp' END AS why,
  CASE WHEN NOT alive THEN 'dead:thin_content' WHEN language <> 'en' OR language_confidence < 0.75 THEN 'language:' || language || ':' || CASE WHEN language_confidence < 0.75 THEN '0.50' ELSE '0.90' END END AS gate,
  coalesce(n_emails, 0) > 0 AS mail, coalesce(best_client, 0) >= 0.5 AS coach FROM t)
SELECT site, CASE WHEN gate IS NULL THEN total ELSE 0 END AS score,
  CASE WHEN gate IS NOT NULL THEN 'rejected' WHEN why IS NOT NULL THEN CASE WHEN total < 40 THEN 'rejected' ELSE 'review' END WHEN total >= 55 THEN CASE WHEN coach OR mail THEN 'qualified' ELSE 'review' END WHEN total >= 40 THEN 'review' ELSE 'rejected' END AS status,
  CASE WHEN gate IS NOT NULL THEN NULL WHEN why IS NOT NULL THEN CASE WHEN total < 40 THEN NULL ELSE 'C' END WHEN total >= 55 THEN CASE WHEN coach AND mail THEN 'A' WHEN mail THEN 'B' ELSE 'C' END WHEN total >= 40 THEN 'C' END AS tier,
  CASE WHEN gate IS NOT NULL THEN gate WHEN why IS NOT NULL THEN why WHEN total < 40 THEN 'low_score' END AS reject_reason, CASE WHEN gate IS NULL THEN round_even(services_score, 1)::DOUBLE END AS services_score, CASE WHEN gate IS NULL THEN round_even(icp_score, 1)::DOUBLE END AS icp_score,
  CASE WHEN gate IS NULL THEN round_even(client_score, 1)::DOUBLE END AS client_score, CASE WHEN gate IS NULL THEN round_even(agency_score, 1)::DOUBLE END AS agency_score, CASE WHEN gate IS NULL THEN fresh_score::INT END AS fresh_score, CASE WHEN gate IS NULL THEN contact_score::INT END AS contact_score,
  CASE WHEN gate IS NULL THEN penalties::INT END AS penalties, CASE WHEN gate IS NULL THEN array_to_string(flags, ',') END AS flags, CASE WHEN gate IS NULL THEN array_to_string(list_sort(svc_names), ',') ELSE '' END AS services FROM v
"""


@query(_SCORES_SQL)
def site_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part of a site's score, the gates before it and the verdict after it."""
    facts = made_up(spark, sf_dir, _FACTS).withColumn("as_of", F.lit(AS_OF).cast("date"))
    s = scoring.scored(facts)
    parts = [F.col(f"breakdown.{c}").cast("double").alias(c) for c in ("services_score", "icp_score", "client_score", "agency_score")] + [F.col(f"breakdown.{c}").alias(c) for c in ("fresh_score", "contact_score", "penalties")]
    return s.select("site", "score", "status", "tier", "reject_reason", *parts, F.array_join("breakdown.flags", ",").alias("flags"), F.array_join(F.array_sort("services"), ",").alias("services"))


# --- merges, queues, texts -------------------------------------------------------------------------------------------

_OLD_NEW = """
SELECT 'c' || c_custkey AS domain, c_custkey AS k, c_custkey % 3 <> 0 AS was, c_custkey % 2 = 0 AS now_, CASE WHEN c_custkey % 5 = 0 THEN 'note ' || c_custkey END AS old_note, CASE WHEN c_custkey % 7 = 0 THEN 'old founder' END AS old_founder,
  CASE WHEN c_custkey % 11 = 0 THEN 'new founder' END AS new_founder FROM {customer}
"""


@query(f"""
WITH x AS ({duck(_OLD_NEW)}) SELECT domain, CASE WHEN now_ THEN 'new name' ELSE 'old name' END AS name, CASE WHEN was THEN old_note END AS notes, CASE WHEN now_ THEN coalesce(new_founder, CASE WHEN was THEN old_founder END) ELSE old_founder END AS founder FROM x WHERE was OR now_
""")
def lead_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New facts over old leads, merged twice: a batch that is tried again changes nothing more."""
    x = made_up(spark, sf_dir, _OLD_NEW)
    old = x.where("was").select("domain", F.lit("old name").alias("name"), F.col("old_note").alias("notes"), F.col("old_founder").alias("founder"))
    new = x.where("now_").select("domain", F.lit("new name").alias("name"), F.lit(None).cast("string").alias("notes"), F.col("new_founder").alias("founder"))
    return merges.merge_agencies(merges.merge_agencies(old, new, kept=("notes",)), new, kept=("notes",))


@query("""
SELECT 'c' || c_custkey AS domain, 'A' || c_custkey || '@M.test' AS email, CASE WHEN c_custkey % 4 = 0 THEN 'unverified' WHEN c_custkey % 3 = 0 THEN 'invalid' ELSE 'smtp_valid' END AS verification, CASE WHEN c_custkey % 4 <> 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END END AS verified_at FROM customer
""")
def email_checks_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of addresses known before stay with them, the newest of several, whatever the case."""
    c = made_up(spark, sf_dir, "SELECT 'c' || c_custkey AS domain, c_custkey AS k FROM {customer}")
    known = c.where("k % 4 <> 0").select("domain", "k", F.concat(F.lit("a"), "k", F.lit("@m.test")).alias("email"))
    old = known.select("domain", "email", F.lit("smtp_valid").alias("verification"), F.lit(1).alias("verified_at")).unionByName(known.where("k % 3 = 0").select("domain", "email", F.lit("invalid").alias("verification"), F.lit(2).alias("verified_at")))
    return merges.merge_emails(old, c.select("domain", F.concat(F.lit("A"), "k", F.lit("@M.test")).alias("email"), F.lit("unverified").alias("verification")))


_SEEN = """
SELECT c_custkey AS k, CASE c_custkey % 7 WHEN 0 THEN 'https://www.firm' || c_custkey || '.test/x' WHEN 1 THEN 'https://instagram.com/f' || c_custkey WHEN 2 THEN 'https://blocked.test/' || c_custkey WHEN 3 THEN 'https://a.b.blocked.test/' || c_custkey
  WHEN 4 THEN 'http://localhost/' || c_custkey WHEN 5 THEN 'https://firm' || c_custkey || '.co.uk' ELSE 'https://ann' || c_custkey || '.mykajabi.com/p' END AS url, CASE WHEN c_custkey % 5 = 0 THEN 'done' ELSE 'new' END AS status FROM {customer}
"""


@query(f"WITH x AS ({duck(_SEEN)}) SELECT k, CASE k % 7 WHEN 0 THEN 'firm' || k || '.test' WHEN 5 THEN 'firm' || k || '.co.uk' ELSE 'ann' || k || '.mykajabi.com' END AS domain FROM x WHERE k % 7 IN (0, 5, 6)")
def candidate_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merges.admissible(made_up(spark, sf_dir, _SEEN), spark.createDataFrame([("blocked.test",)], "domain string")).select("k", "domain")


@query(f"WITH x AS ({duck(_SEEN)}) SELECT 'd' || k AS domain, (k % 13)::INT AS hits FROM x WHERE status = 'new' ORDER BY k % 13 DESC, 'd' || k LIMIT 20")
def crawl_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 candidates to crawl next."""
    from millrace.operators.discovery import crawl_queue

    x = made_up(spark, sf_dir, _SEEN).select(F.concat(F.lit("d"), "k").alias("domain"), (F.col("k") % 13).cast("int").alias("hits"), "status")
    return crawl_queue(x, limit=20).select("domain", "hits")


_STAGES = "SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'qualified' WHEN 1 THEN 'review' ELSE 'rejected' END AS status, CASE c_custkey % 5 WHEN 0 THEN 'clients_done' WHEN 1 THEN 'founders_done' WHEN 2 THEN 'emails_done' END AS enrich_stage FROM {customer}"


@query(f"""
WITH x AS ({duck(_STAGES)}) SELECT 'clients' AS stage, k FROM x WHERE status <> 'rejected' AND enrich_stage IS NULL UNION ALL SELECT 'founders', k FROM x WHERE status <> 'rejected' AND coalesce(enrich_stage, '') <> 'founders_done'
UNION ALL SELECT 'emails', k FROM x WHERE status <> 'rejected' AND coalesce(enrich_stage, '') <> 'emails_done' UNION ALL SELECT 'forced', k FROM x WHERE status <> 'rejected'
""")
def stage_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each stage still has to work on, and what it takes by force."""
    from millrace.plans.pipeline import stage_rows

    x = made_up(spark, sf_dir, _STAGES)
    rows = [stage_rows(x, s).select(F.lit(s).alias("stage"), "k") for s in ("clients", "founders", "emails")] + [stage_rows(x, "clients", force=True).select(F.lit("forced").alias("stage"), "k")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query("""
WITH d AS (SELECT coalesce(source, '-') AS site, doc_id, coalesce(text, '') AS t, CASE WHEN doc_id % 2 = 0 THEN 'about' ELSE 'blog' END AS kind FROM documents), o AS (SELECT site, string_agg(t, chr(10) ORDER BY doc_id) AS t FROM d WHERE kind = 'about' GROUP BY site)
SELECT site, length(substr(t, 1, 5000)) AS chars, md5(substr(t, 1, 5000)) AS digest FROM o
""")
def site_texts_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 5000 characters of each site's pages of one kind, in their order."""
    d = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("-")).alias("site"), F.col("doc_id").alias("page_ord"), F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("doc_id") % 2 == 0, "about").otherwise("blog").alias("kind"))
    return crawl.site_texts(d, ["about"], 5000).select("site", F.length("text").cast("long").alias("chars"), F.md5(F.encode("text", "UTF-8")).alias("digest"))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE '20' || lpad((10 + c_custkey % 14)::VARCHAR, 2, '0') || '-0' || (1 + c_custkey % 9) || '-11' END AS newest FROM customer")
def newest_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest day of a page's dates; those beyond next year and before 2000 don't count, nor what is no day."""
    c = made_up(spark, sf_dir, "SELECT c_custkey AS k, '20' || lpad(CAST(10 + c_custkey % 14 AS STRING), 2, '0') || '-0' || (1 + c_custkey % 9) || '-11' AS day FROM {customer}")
    others = F.array(F.lit("2099-01-01"), F.lit("1998-05-05"), F.lit("soon"), F.lit("2005-02-03T10:00:00Z"))
    dates = F.when(F.col("k") % 4 == 3, F.slice(others, 1, 3)).otherwise(F.concat(others, F.array(F.concat("day", F.lit("T01:02:03")))))
    return c.select("k", crawl.newest_date(dates, F.lit(AS_OF).cast("date")).alias("newest"))


@query("""
WITH s AS (SELECT c_custkey AS k, 'site' || c_custkey || '.test' AS site, CASE WHEN c_custkey % 2 = 0 THEN '2024-03-0' || (1 + c_custkey % 5) ELSE '2024-02-01' END AS newest FROM customer)
SELECT site, 'https://' || site || '/p' || i AS url, newest FROM s, (SELECT unnest([1, 2, 3]) AS i) WHERE k % 3 = 0 OR i < 3
UNION ALL SELECT site, 'https://' || site || '/q' || i, newest FROM s, (SELECT unnest(range(1, 21)) AS i) WHERE k % 5 = 0 AND i <= CASE WHEN k % 3 = 0 THEN 9 ELSE 10 END
""")
def sitemap_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of sitemaps, reached through an index that also names itself, an image map and, for a fifth of the sites, twenty maps more than a dozen visits take in; one map has urls of another site and an asset, and a date with a time."""
    c = made_up(spark, sf_dir, "SELECT 'site' || c_custkey || '.test' AS site, c_custkey AS k FROM {customer}")
    at = lambda path: F.concat(F.lit("https://"), "site", F.lit(path))
    tag = lambda name, inner, mod=None: F.concat(F.lit(f"<{name}><loc>"), inner, F.lit("</loc>"), mod if mod is not None else F.lit(""), F.lit(f"</{name}>"))
    mod = F.when(F.col("k") % 2 == 0, F.concat(F.lit("<lastmod>2024-03-0"), 1 + F.col("k") % 5, F.lit("T10:00:00Z</lastmod>"))).otherwise(F.lit(""))
    more = F.when(F.col("k") % 5 == 0, F.concat(*(tag("sitemap", at(f"/q{i}.xml")) for i in range(1, 21)))).otherwise(F.lit(""))
    index = F.concat(F.lit("<sitemapindex>"), tag("sitemap", at("/map.xml")), tag("sitemap", at("/a.xml")), F.when(F.col("k") % 3 == 0, tag("sitemap", at("/b.xml"))).otherwise(F.lit("")), tag("sitemap", at("/image-map.xml")), more, F.lit("</sitemapindex>"))
    other = tag("url", F.lit("https://other.test/x"), F.lit("<lastmod>2024-02-01</lastmod>"))
    first = F.concat(F.lit("<urlset>"), tag("url", at("/p1"), mod), tag("url", at("/p2")), tag("url", at("/p1")), other, tag("url", at("/i.png")), F.lit("</urlset>"))
    second, image = F.concat(F.lit("<urlset>"), tag("url", at("/p3")), F.lit("</urlset>")), F.concat(F.lit("<urlset>"), tag("url", at("/i9")), F.lit("</urlset>"))
    maps = (("/map.xml", index), ("/a.xml", first), ("/b.xml", second), ("/image-map.xml", image), *((f"/q{i}.xml", F.concat(F.lit("<urlset>"), tag("url", at(f"/q{i}")), F.lit("</urlset>"))) for i in range(1, 21)))
    docs = c.select("site", F.explode(F.array(*(F.struct(at(p).alias("doc_url"), x.alias("xml")) for p, x in maps))).alias("d")).select("site", "d.*")
    return crawl.sitemap_walk(docs, c.select("site", at("/map.xml").alias("doc_url"))).select("site", "url", "newest")


@query("SELECT lower(r_name) AS text, n_name AS country, engine FROM region, nation, (SELECT unnest(['one', 'two']) AS engine)")
def search_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries by countries by engines."""
    from millrace.operators import discovery

    return discovery.search_plan(table(spark, sf_dir, "region").select(F.lower("r_name").alias("text")), table(spark, sf_dir, "nation").select(F.col("n_name").alias("country")), spark.createDataFrame([("one",), ("two",)], "engine string"))


# --- contacts -------------------------------------------------------------------------------------------------------

#: Home, contact and blog pages with addresses in all five channels.
_CONTACT_PAGES = """
WITH c AS (SELECT c_custkey AS k, 's' || c_custkey || '.org' AS site FROM {customer})
SELECT site, k, 1 AS page_ord, 'home' AS kind, 'https://' || site || '/' AS url, '<a href="mailto:Info@' || site || '?subject=x">Mail</a> <script>"email": "press@' || site || '"</script>' AS html, 'Write to ann@' || site || '. Call +1 415 555 ' || CAST(1000 + k % 9000 AS STRING) || ' today.' AS text FROM c
UNION ALL SELECT site, k, 2, 'contact', 'https://' || site || '/contact', '<p>none</p>', 'Write to bob [at] ' || site || ' or ann@' || site || ' or sam@gmail.com or zoe@other' || CAST(k AS STRING) || '.com' FROM c
UNION ALL SELECT site, k, 3, 'blog', 'https://' || site || '/blog', '<p></p>', 'logo@2x.png and noreply@' || site FROM c WHERE k % 2 = 0
"""


@query("""
WITH s AS (SELECT 's' || c_custkey || '.org' AS site, c_custkey AS k FROM customer),
e AS (SELECT site, 'info@' || site AS email, 'mailto' AS source, '/' AS page, TRUE AS same_domain, 0.95 AS confidence, 2 AS bucket, 1 AS page_ord, 0 AS found FROM s
  UNION ALL SELECT site, 'press@' || site, 'jsonld', '/', TRUE, 0.65, 4, 1, 2 FROM s UNION ALL SELECT site, 'ann@' || site, 'text', '/contact', TRUE, 0.95, 0, 2, 0 FROM s
  UNION ALL SELECT site, 'bob@' || site, 'obfuscated', '/contact', TRUE, 0.95, 0, 2, 3 FROM s UNION ALL SELECT site, 'sam@gmail.com', 'text', '/contact', FALSE, 0.7, 0, 2, 1 FROM s UNION ALL SELECT site, 'zoe@other' || k || '.com', 'text', '/contact', FALSE, 0.45, 0, 2, 2 FROM s)
SELECT site, email, source, 'https://' || site || page AS page_url, same_domain, confidence::DOUBLE AS confidence, (row_number() OVER (PARTITION BY site ORDER BY CASE WHEN same_domain THEN 0 ELSE 1 END, bucket, confidence DESC, page_ord, found) - 1)::INT AS rank FROM e
""")
def site_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of sites from all channels, each once with its best finding, ranked."""
    return contacts.site_emails(made_up(spark, sf_dir, _CONTACT_PAGES))


@query("SELECT 's' || c_custkey || '.org' AS site, '+1 415 555 ' || (1000 + c_custkey % 9000)::VARCHAR AS phones FROM customer")
def site_phone_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.site_phones(made_up(spark, sf_dir, _CONTACT_PAGES)).select("site", F.array_join("phones", ";").alias("phones"))


_LINKED = """
WITH c AS (SELECT c_custkey AS k, 's' || c_custkey || '.org' AS site FROM {customer})
SELECT site, 1 AS page_ord, 'home' AS kind, 'https://' || site || '/' AS url, l.link_ord AS link_ord, l.href AS href, l.anchor AS anchor, k FROM c, (SELECT 0 AS link_ord, 'https://www.instagram.com/firm?hl=en' AS href, 'Insta' AS anchor UNION ALL SELECT 1, 'https://instagram.com/second', 'x'
  UNION ALL SELECT 2, 'https://www.facebook.com/sharer.php?u=1', 'Share' UNION ALL SELECT 3, '/book-a-call', 'Book' UNION ALL SELECT 4, 'https://calendly.com/firm/call', 'Talk' UNION ALL SELECT 5, 'https://www.linkedin.com/company/firm/', 'LinkedIn' UNION ALL SELECT 6, 'mailto:x@y.org', 'Mail') l
WHERE NOT (l.link_ord = 4 AND k % 2 = 0) AND NOT (l.link_ord >= 3 AND k % 5 = 0)
"""


@query("""
WITH s AS (SELECT 's' || c_custkey || '.org' AS site, c_custkey AS k FROM customer)
SELECT site, 'https://www.instagram.com/firm' AS instagram, CASE WHEN k % 5 <> 0 THEN 'https://www.linkedin.com/company/firm/' END AS linkedin, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 2 = 0 THEN 'https://' || site || '/book-a-call' ELSE 'https://calendly.com/firm/call' END AS booking_url,
  CASE WHEN k % 5 <> 0 THEN 'https://www.linkedin.com/company/firm/' END AS company_linkedin FROM s
""")
def site_profile_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles, the booking link and the company's page, from the links of a site."""
    pages = made_up(spark, sf_dir, _LINKED).groupBy("site", "page_ord", "kind", "url").agg(F.transform(F.array_sort(F.collect_list(F.struct("link_ord", "href", "anchor"))), lambda x: F.struct(x["href"].alias("href"), x["anchor"].alias("anchor"))).alias("links"))
    links = contacts.page_links(pages)
    own = contacts.site_profiles(links).groupBy("site").agg(*(F.max(F.when(F.col("network") == n, F.col("url"))).alias(n) for n in ("instagram", "linkedin")))
    return own.join(contacts.booking_links(links), "site", "left").join(people.company_profiles(links), "site", "left")


# --- companies ------------------------------------------------------------------------------------------------------

_COMPANY_PAGES = """
WITH c AS (SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 4 THEN 'blue-fox' || c_custkey || '.com.au' ELSE 'firm' || c_custkey || '.com' END AS site FROM {customer})
SELECT site, k, 0 AS page_ord, 'home' AS kind, CASE k % 4 WHEN 0 THEN 'Home | Firm ' || k || ' | Best ads of all' WHEN 1 THEN 'Ads by us - Grow' ELSE 'Welcome' END AS title, CASE WHEN k % 4 = 2 THEN 'Site Name ' || k ELSE '' END AS og_site_name, '' AS og_title, CASE WHEN k % 3 = 0 THEN 'We grow firms' ELSE '' END AS meta_description,
  CASE WHEN k % 4 = 3 THEN 'Data Name ' || k END AS org_name,
  CASE k % 5 WHEN 0 THEN 'We are based in Toronto. ' WHEN 1 THEN 'Visit us: Denver, CO 80202. ' WHEN 2 THEN 'A firm from the netherlands. ' WHEN 3 THEN 'Nothing to see. ' ELSE 'No place. ' END || CASE k % 3 WHEN 0 THEN 'Founded in 2015. ' ELSE '' END || CASE k % 7 WHEN 0 THEN 'A team of 25 people. ' WHEN 1 THEN 'A boutique firm. ' ELSE '' END || CASE WHEN k % 2 = 0 THEN 'Copyright 2019-2023 and © 2021' ELSE 'In 2014 and 2016.' END AS text FROM c
"""


def _company_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.to_json(F.struct(F.lit("Organization").alias("@type"), F.col("org_name").alias("name"), F.lit("2012-05-01").alias("foundingDate"), F.struct(F.lit("US").alias("addressCountry"), F.lit("Reno").alias("addressLocality")).alias("address")))
    jsonld = F.array_compact(F.array(F.when(F.col("org_name").isNotNull(), data)))
    return made_up(spark, sf_dir, _COMPANY_PAGES).withColumns({"jsonld": jsonld, "headings": F.array(F.lit("Short"), F.lit("A heading of good length")), "blocks": F.array(F.lit("A block of text that is long enough to be taken for a description of what the firm does all day."))})


@query(f"""
WITH p AS ({duck(_COMPANY_PAGES)})
SELECT site, CASE k % 4 WHEN 3 THEN 'Data Name ' || k WHEN 2 THEN 'Site Name ' || k WHEN 0 THEN CASE WHEN k % 5 = 4 THEN 'Firm ' || k ELSE 'Firm ' || k END ELSE 'Grow' END AS name, 'A heading of good length' AS tagline,
  CASE WHEN k % 3 = 0 THEN 'We grow firms' ELSE 'A block of text that is long enough to be taken for a description of what the firm does all day.' END AS description,
  CASE WHEN k % 4 = 3 THEN 'United States' ELSE CASE k % 5 WHEN 0 THEN 'Canada' WHEN 1 THEN 'United States' WHEN 2 THEN 'Netherlands' WHEN 4 THEN 'Australia' END END AS country, CASE WHEN k % 4 = 3 THEN 'Reno' ELSE CASE k % 5 WHEN 0 THEN 'Toronto' WHEN 1 THEN 'Denver' END END AS city,
  CASE WHEN k % 4 = 3 THEN 2012 WHEN k % 3 = 0 THEN 2015 END AS founded_year, CASE k % 7 WHEN 0 THEN '25+ people' WHEN 1 THEN 'boutique' END AS team_size_hint, CASE WHEN k % 2 = 0 THEN 2023 ELSE 2016 END AS copyright_year FROM p
""")
def company_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return company.company_facts(_company_pages(spark, sf_dir))


_LIVE_PAGES = """
WITH c AS (SELECT c_custkey AS k, 'firm' || c_custkey || '.com' AS site FROM {customer})
SELECT site, k, 0 AS page_ord, CASE WHEN k % 11 = 0 THEN 'about' ELSE 'home' END AS kind, 'https://' || site || '/' AS url, CASE k % 7 WHEN 1 THEN 'https://www.facebook.com/firm' WHEN 2 THEN 'https://hugedomains.com/x' WHEN 3 THEN 'https://' || site || '/expired' ELSE 'https://' || site || '/' END AS final_url,
  CASE WHEN k % 7 = 4 THEN 'This domain is for sale' ELSE 'Firm' END AS title, CASE WHEN k % 7 = 5 THEN 'Short.' ELSE repeat('We do good work for good people. ', 8) END || CASE WHEN k % 2 = 0 THEN ' Copyright 2018' ELSE ' Copyright 2024' END AS text,
  CASE k % 3 WHEN 0 THEN '2020-01-01' WHEN 1 THEN '2024-02-02' END AS day FROM c
"""


@query(f"""
WITH p AS ({duck(_LIVE_PAGES)}), r AS (SELECT *, CASE WHEN kind <> 'home' THEN 'no_home' WHEN length(text) < 150 THEN 'thin_content' WHEN k % 7 = 4 THEN 'parked_or_placeholder' WHEN k % 7 = 1 THEN 'redirect_to_facebook.com' WHEN k % 7 = 2 THEN 'redirect_to_hugedomains.com' WHEN k % 7 = 3 THEN 'parked_redirect' ELSE 'ok' END AS reason FROM p)
SELECT site, reason = 'ok' AS alive, reason, CASE WHEN reason = 'ok' THEN day END AS last_activity, reason = 'ok' AND CASE WHEN day IS NOT NULL THEN day = '2020-01-01' AND k % 2 = 0 ELSE k % 2 = 0 END AS stale FROM r
""")
def liveness_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The liveness gate itself, with every reason it can give."""
    p = made_up(spark, sf_dir, _LIVE_PAGES).withColumn("dates", F.when(F.col("day").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.concat("day", F.lit("T00:00:00")), F.lit("1999-01-01"))))
    return company.site_liveness(p, F.lit(AS_OF).cast("date"))


# --- funnels --------------------------------------------------------------------------------------------------------

_FUNNEL_LINKS = """
SELECT 's' || c_custkey || '.org' AS site, 1 AS page_ord, l.link_ord AS link_ord, replace(l.url, 'SITE', 's' || c_custkey || '.org') AS url, l.anchor AS anchor, CASE WHEN l.link_ord IN (0, 1, 7) THEN l.dom ELSE 's' || c_custkey || '.org' END AS domain, CAST(NULL AS STRING) AS network FROM {customer},
  (SELECT 0 AS link_ord, 'https://firm.mykajabi.com/free-webinar' AS url, 'Join now' AS anchor, 'firm.mykajabi.com' AS dom UNION ALL SELECT 1, 'https://calendly.com/', 'Book', 'calendly.com' UNION ALL SELECT 2, 'https://SITE/webinar', 'Register today', '' UNION ALL SELECT 3, 'https://SITE/about', 'About', ''
  UNION ALL SELECT 4, 'https://SITE/newsletter', 'Subscribe', '' UNION ALL SELECT 5, 'https://SITE/webinar/', 'more', '' UNION ALL SELECT 6, 'https://SITE/a.pdf', 'Download guide', '' UNION ALL SELECT 7, 'https://elsewhere.test/webinar', 'Register', 'elsewhere.test') l WHERE c_custkey % 3 <> 0 OR l.link_ord <> 0
"""


@query("""
WITH s AS (SELECT 's' || c_custkey || '.org' AS site, c_custkey AS k FROM customer)
SELECT site, 'https://firm.mykajabi.com/free-webinar' AS url, 'Join now' AS anchor, 7.5::DOUBLE AS score, TRUE AS external FROM s WHERE k % 3 <> 0
UNION ALL SELECT site, 'https://' || site || '/webinar', 'Register today', 3.5, FALSE FROM s
""")
def funnel_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that look like a funnel's entry."""
    return funnels.funnel_candidates(made_up(spark, sf_dir, _FUNNEL_LINKS))


_FUNNEL_PAGES = """
WITH c AS (SELECT c_custkey AS k, 's' || c_custkey || '.org' AS site FROM {customer})
SELECT site, k, CASE k % 4 WHEN 0 THEN 'https://firm.mykajabi.com/x' ELSE 'https://' || site || '/x' END AS url, CASE k % 3 WHEN 0 THEN 'Apply' WHEN 1 THEN 'Register' ELSE 'See' END AS anchor, k % 4 = 0 AS external, k % 5 = 0 AS is_home, CASE WHEN k % 2 = 0 THEN 'A title' ELSE '' END AS title, '' AS og_title,
  CASE WHEN k % 4 = 0 THEN 'kajabi' ELSE '' END || CASE WHEN k % 6 < 3 THEN '<video src="x">' ELSE '' END || CASE WHEN k % 7 = 0 THEN 'js.stripe.com' ELSE '' END AS html,
  CASE k % 5 WHEN 0 THEN 'Quiz and assessment for all' WHEN 1 THEN 'Save your seat' ELSE 'Text' END || CASE WHEN k % 2 = 0 THEN ' for $ 49 only' ELSE '' END AS text, CASE WHEN k % 2 = 0 THEN 'input email e mail' ELSE 'input tel phone' END AS field FROM c
"""


@query(f"""
WITH p AS ({duck(_FUNNEL_PAGES)}),
t AS (SELECT *, CASE k % 3 WHEN 0 THEN 'application' WHEN 1 THEN 'webinar' ELSE 'landing_page' END AS funnel_type,
  list_filter([CASE WHEN k % 2 = 0 THEN 'opt-in form (email)' END, CASE WHEN k % 2 = 1 THEN 'phone capture' END, CASE WHEN k % 6 < 3 THEN 'video (VSL / training)' END, CASE WHEN k % 7 = 0 THEN 'checkout / enrollment' END, CASE WHEN k % 5 = 1 THEN 'webinar / training registration' END], lambda x: x IS NOT NULL) AS steps FROM p),
n AS (SELECT *, len(list_filter(steps, lambda x: x <> 'phone capture')) AS strong, funnel_type <> 'landing_page' AS typed FROM t),
c AS (SELECT *, round_even(0.25 + 0.1 * least(3, strong) + CASE WHEN typed THEN 0.15 ELSE 0 END + CASE WHEN external THEN 0.15 ELSE 0 END + CASE WHEN k % 4 = 0 THEN 0.1 ELSE 0 END - CASE WHEN is_home AND NOT typed THEN 0.1 ELSE 0 END, 3)::DOUBLE AS confidence FROM n)
SELECT site, url, funnel_type, CASE WHEN k % 4 = 0 THEN 'kajabi' END AS platform, 'The offer' AS offer, CASE WHEN k % 2 = 0 THEN '$ 49' END AS price_hint, array_to_string(steps, ';') AS steps, confidence FROM c WHERE (typed OR strong >= 2) AND confidence >= 0.5
""")
def funnel_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What fetched funnel pages are: type, platform, offer, price, steps and confidence."""
    p = made_up(spark, sf_dir, _FUNNEL_PAGES).withColumns({"headings": F.array(F.lit("The offer")), "fields": F.array("field")})
    return funnels.site_funnels(p).withColumn("steps", F.array_join("steps", ";"))


_OFFERS = "CASE doc_id % 3 WHEN 0 THEN 'A quiz, an assessment, a scorecard. ' WHEN 1 THEN 'A 5-day challenge, a bootcamp and one more challenge. ' ELSE 'A quiz, an assessment and the same quiz. ' END || coalesce(text, '')"
_TYPES_OF = ", ".join(f"{{'n': len(list_distinct(regexp_extract_all(lower(substr(t, 1, 2500)), '{p.replace(chr(39), chr(39) * 2)}'))), 'type': '{label}'}}" for label, p in fixed.FUNNEL_TYPES)


@query(f"""
WITH d AS (SELECT doc_id, {_OFFERS} AS t FROM documents), s AS (SELECT doc_id, list_filter([{_TYPES_OF}], lambda x: x.n >= 3) AS s FROM d)
SELECT doc_id, CASE WHEN len(s) = 0 THEN 'landing_page' ELSE list_sort(s, 'DESC')[1].type END AS funnel_type FROM s
""")
def funnel_type_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of texts by the words of their beginning, as the operator takes it: three different ones of a type count 3, two only 2."""
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_OFFERS} AS t")
    none = F.lit("")
    return d.select("doc_id", funnels.funnel_type(F.lit("https://a.test/x"), none, none, none, F.col("t")).alias("funnel_type"))


# --- people ---------------------------------------------------------------------------------------------------------

_PEOPLE_PAGES = """
WITH c AS (SELECT c_custkey AS k, 's' || c_custkey || '.org' AS site FROM {customer})
SELECT site, k, 1 AS page_ord, 'about' AS kind, 'https://' || site || '/about' AS url, 'About' AS title, CASE k % 4 WHEN 0 THEN 'Ann Baker, founder. We grow firms.' WHEN 1 THEN 'Founded by Bruno Castillo in a garage.' WHEN 2 THEN 'She says: Chloe Dunmore, founder. A client story.' ELSE 'We are a firm.' END AS text, 'Who we are' AS heading FROM c
UNION ALL SELECT site, k, 2, 'services', 'https://' || site || '/services', 'Services', 'Talk to Erin Novak, media buyer.' || CASE WHEN k % 5 = 0 THEN repeat(' .', 60) || ' Our client Dana Whitfield, owner of a studio, wrote a review.' ELSE '' END, 'Services' FROM c
UNION ALL SELECT site, k, 3, 'case_studies', 'https://' || site || '/case-studies', 'Stories', 'We helped Dana Whitfield, a business coach, to book calls.' || CASE WHEN k % 3 = 0 THEN ' And Erin Novak helped many clients to grow revenue.' ELSE '' END, 'How Dana Whitfield doubled her coaching business' FROM c
"""


def _people_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    data = F.when((F.col("k") % 4 == 3) & (F.col("page_ord") == 1), F.array(F.to_json(F.struct(F.lit("Organization").alias("@type"), F.struct(F.lit("Devon Evans").alias("name"), F.lit("CEO").alias("jobTitle")).alias("founder"))))).otherwise(none)
    link = '[{"pre": 0, "last": 0, "parent": -1, "tag": "a", "cls": "", "value": "https://www.linkedin.com/in/ann-baker?x=1", "start": 0, "end": 3}]'
    nodes = F.from_json(F.when((F.col("k") % 12 == 0) & (F.col("page_ord") == 1), link).otherwise("[]"), NODES)
    return made_up(spark, sf_dir, _PEOPLE_PAGES).withColumns({"jsonld": data, "headings": F.array("heading"), "flow": F.lit("Ann"), "nodes": nodes})


_PEOPLE_LINKS = """
SELECT 's' || c_custkey || '.org' AS site, 1 AS page_ord, 0 AS link_ord, 'https://www.linkedin.com/in/ann-baker?x=1' AS href, 'https://www.linkedin.com/in/ann-baker?x=1' AS url, 'linkedin.com' AS domain, 'linkedin' AS network, 'Ann' AS anchor FROM {customer} WHERE c_custkey % 12 = 0
UNION ALL SELECT 's' || c_custkey || '.org', 3, 0, 'https://danawhitfield.com/?a=1', 'https://danawhitfield.com/?a=1', 'danawhitfield.com', CAST(NULL AS STRING), 'Her site' FROM {customer} WHERE c_custkey % 2 = 0
"""


@query("""
WITH s AS (SELECT 's' || c_custkey || '.org' AS site, c_custkey AS k FROM customer WHERE c_custkey % 4 <> 2)
SELECT site, CASE k % 4 WHEN 0 THEN 'Ann Baker' WHEN 1 THEN 'Bruno Castillo' ELSE 'Devon Evans' END AS name, CASE k % 4 WHEN 0 THEN 'founder' WHEN 1 THEN 'Founder' ELSE 'CEO' END AS title, CASE WHEN k % 12 = 0 THEN 'https://www.linkedin.com/in/ann-baker' END AS linkedin,
  CASE WHEN k % 12 = 0 THEN 'site_link' ELSE 'site_name' END AS source, CASE WHEN k % 12 = 0 THEN 0.9 WHEN k % 4 = 3 THEN 0.7 ELSE 0.6 END::DOUBLE AS confidence FROM s
""")
def site_founders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Founders by title, by verb, and from linked data; one named in a client's story is none."""
    return people.founders(_people_pages(spark, sf_dir), made_up(spark, sf_dir, _PEOPLE_LINKS))


@query("""
SELECT 's' || c_custkey || '.org' AS site, 'Dana Whitfield' AS name, 'person' AS kind, 'business coach' AS role_title, 'business coaching' AS niche, CASE WHEN c_custkey % 5 = 0 THEN 'Our client Dana Whitfield, owner of a studio, wrote a review.' ELSE 'We helped Dana Whitfield, a business coach, to book calls.' END AS evidence,
  CASE WHEN c_custkey % 2 = 0 THEN 'https://danawhitfield.com/' END AS website, (0.79 + CASE WHEN c_custkey % 2 = 0 THEN 0.1 ELSE 0 END + CASE WHEN c_custkey % 5 = 0 THEN 0.04 ELSE 0 END)::DOUBLE AS confidence, 'client_context,heading,sentence' AS signals, 1 AS coach_clients FROM customer
""")
def site_client_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients by headings and sentences; the site's team is kept out, but a client with a title, told of as a client, is no team."""
    pages = stored(_people_pages(spark, sf_dir), "people-pages")
    own = pages.select("site", F.concat(F.lit("Firm "), "k").alias("name")).distinct()
    found = stored(people.site_clients(pages, made_up(spark, sf_dir, _PEOPLE_LINKS), own), "clients")
    proof = people.coach_proof(found).select("site", F.col("coach_clients").cast("int").alias("coach_clients"))
    return found.join(proof, "site").select("site", "name", "kind", "role_title", "niche", "evidence", "website", "confidence", F.array_join("signals", ",").alias("signals"), "coach_clients")


_SEARCHED = """
SELECT 's' || c_custkey || '.org' AS site, c_custkey AS k, 1 AS rank, 'https://www.linkedin.com/in/ann-baker-77' AS url, CASE WHEN c_custkey % 5 = 0 THEN 'Ann Baker - Founder | LinkedIn' ELSE 'Ann Baker - Founder - Acme Growth | LinkedIn' END AS title, '' AS snippet FROM {customer}
UNION ALL SELECT 's' || c_custkey || '.org', c_custkey, 2, 'https://www.linkedin.com/in/someone', 'Some One - Baker | LinkedIn', 'bread' FROM {customer}
"""


@query("""
SELECT 's' || c_custkey || '.org' AS site, 'Ann Baker' AS name, 'https://www.linkedin.com/in/ann-baker-77/' AS linkedin, CASE WHEN c_custkey % 2 = 1 THEN 0.7 WHEN c_custkey % 5 = 0 THEN 0.6 ELSE 0.85 END::DOUBLE AS confidence FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 5 <> 0
""")
def founder_profiles_searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = made_up(spark, sf_dir, _SEARCHED)
    known = x.where("k % 2 = 0").select("site", F.lit("Ann Baker").alias("name")).distinct()
    return people.founders_from_search(known, x.drop("k"), x.select("site", F.lit("Acme Growth Agency").alias("name")).distinct())


_CLIENT_RESULTS = """
SELECT 's' || c_custkey || '.org' AS site, 'Ann Baker' AS client_name, 1 AS rank, 'https://facebook.com/annbaker' AS url, 'Ann Baker coach' AS title, 'coach' AS snippet FROM {customer}
UNION ALL SELECT 's' || c_custkey || '.org', 'Ann Baker', 2, CASE WHEN c_custkey % 3 = 0 THEN 'https://news.test/a' ELSE 'https://annbaker.com/home?x=1' END, CASE WHEN c_custkey % 3 = 0 THEN 'A story' ELSE 'Ann Baker' END, 'words' FROM {customer}
UNION ALL SELECT 's' || c_custkey || '.org', 'Ann Baker', 3, 'https://ann-baker.org/x', 'Ann Baker, coach', 'course' FROM {customer} WHERE c_custkey % 7 = 0
"""


@query("""
SELECT 's' || c_custkey || '.org' AS site, 'Ann Baker' AS name, CASE WHEN c_custkey % 7 = 0 THEN 'https://ann-baker.org/x' ELSE 'https://annbaker.com/home' END AS website FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 7 = 0
""")
def client_sites_searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best search result for clients without a site: the name in the domain, in the title, and the trade."""
    x = made_up(spark, sf_dir, _CLIENT_RESULTS)
    clients = x.select("site", F.col("client_name").alias("name"), F.lit(None).cast("string").alias("niche"), F.lit(None).cast("string").alias("website")).distinct()
    return people.resolved_clients(clients, x)


_SITE_TEXT = "CASE doc_id % 3 WHEN 0 THEN 'A course for every coach. Enroll now. ' WHEN 1 THEN 'Every coach needs a coach. Enroll now. ' ELSE 'Students of a coach. ' END || coalesce(text, '')"


@query(f"WITH d AS (SELECT doc_id, {_SITE_TEXT} AS t FROM documents) SELECT doc_id, len(list_distinct(regexp_extract_all(lower(t), '{names.ICP_EVIDENCE.replace('(?i)', '')}', 1))) >= 2 AND regexp_matches(t, '{fixed.FUNNEL_PATH}') AS trade FROM d")
def trade_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the trade: two different terms of it and an offer, anywhere in the whole text."""
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_SITE_TEXT} AS t")
    return d.select("doc_id", people.infopreneur_site(F.col("t")).alias("trade"))


# --- runs -----------------------------------------------------------------------------------------------------------

_CANDIDATES = """
SELECT 'd' || c_custkey AS domain, c_custkey AS k, CAST(c_custkey % 17 AS INT) AS hits, CASE c_custkey % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'claimed' ELSE 'new' END AS status, CASE WHEN c_custkey % 4 = 1 THEN CAST(1 AS BIGINT) END AS run_id, CAST(NULL AS STRING) AS reject_reason FROM {customer}
"""


@query(f"""
WITH c AS ({duck(_CANDIDATES)}), t AS (SELECT domain FROM c WHERE status = 'new' ORDER BY hits DESC, domain LIMIT 30),
x AS (SELECT c.*, t.domain IS NOT NULL AS own FROM c LEFT JOIN t USING (domain)), y AS (SELECT domain, k, CASE WHEN own THEN 'claimed' ELSE status END AS status, CASE WHEN own THEN 2 ELSE run_id END AS run_id FROM x)
SELECT domain, CASE WHEN status = 'claimed' AND run_id = 2 THEN CASE WHEN k % 5 <> 0 THEN 'done' ELSE 'new' END ELSE status END AS status, run_id, CASE WHEN status = 'claimed' AND run_id = 2 AND k % 5 = 1 THEN 'dead:thin' END AS reject_reason FROM y
""")
def claim_and_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run claims its candidates and marks them, twice: those that came to no outcome are free again."""
    from millrace.plans import runs

    c = made_up(spark, sf_dir, _CANDIDATES)
    outcomes = c.where("k % 5 <> 0").select("domain", F.when(F.col("k") % 5 == 1, "dead:thin").alias("reject_reason"))
    once = runs.mark(runs.claim(c, 2, 30), 2, outcomes)
    return runs.mark(once, 2, outcomes).select("domain", "status", "run_id", "reject_reason")


@query(f"""
WITH c AS ({duck(_CANDIDATES)}) SELECT 1::BIGINT AS run_id, count(*) AS claimed, 0::BIGINT AS done, count(*) FILTER (k % 3 = 0) AS qualified, count(*) FILTER (k % 3 = 1) AS review, 0::BIGINT AS rejected FROM c WHERE run_id IS NOT NULL
""")
def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.plans import runs

    c = made_up(spark, sf_dir, _CANDIDATES)
    return runs.run_statistics(c, c.select("domain", F.when(F.col("k") % 3 == 0, "qualified").when(F.col("k") % 3 == 1, "review").otherwise("rejected").alias("status")))


_RUNS = "SELECT c_custkey AS run_id, CASE c_custkey % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'finished' ELSE 'failed' END AS state, TIMESTAMP '2024-01-01 00:00:00' AS started_at, CASE WHEN c_custkey % 3 <> 0 THEN TIMESTAMP '2024-01-01 00:01:00' END AS finished_at FROM {customer}"


@query(f"""
WITH r AS ({duck(_RUNS)}) SELECT run_id, CASE WHEN run_id = 99 THEN 'cancelled' ELSE state END AS state, CASE WHEN run_id = 99 THEN 3600 WHEN state <> 'running' THEN 60 END::BIGINT AS seconds FROM r ORDER BY run_id DESC LIMIT 100
""")
def runs_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 100 runs, two of which were to be cancelled: one was going on, one had ended."""
    from millrace.plans import runs

    r, at = made_up(spark, sf_dir, _RUNS), F.lit("2024-01-01 01:00:00").cast("timestamp")
    return runs.run_list(runs.cancelled(runs.cancelled(r, 99, at), 100, at), 100).select("run_id", "state", "seconds")


@query("SELECT to_json(struct_pack(domain := 'd' || c_custkey, name := c_name, score := (c_custkey % 50)::INT, tier := CASE WHEN c_custkey % 2 = 0 THEN 'A' END))::VARCHAR AS json FROM customer")
def json_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.plans import runs

    return runs.json_rows(made_up(spark, sf_dir, "SELECT 'd' || c_custkey AS domain, c_name AS name, CAST(c_custkey % 50 AS INT) AS score, CASE WHEN c_custkey % 2 = 0 THEN 'A' END AS tier FROM {customer}"))


@query("SELECT rtrim(rpad('d' || c_custkey, 12, ' ') || ' ' || rpad(substr(c_name, 1, 12), 12, ' ') || ' ' || CASE WHEN c_custkey % 2 = 0 THEN 'A' ELSE '-' END) AS line FROM customer")
def console_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.plans import runs

    return runs.console_lines(made_up(spark, sf_dir, "SELECT 'd' || c_custkey AS domain, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'A' END AS tier FROM {customer}"), 12)


@query("SELECT event_id, event_type AS message FROM (SELECT * FROM events WHERE user_id = 3 AND event_id > 50 ORDER BY event_id DESC LIMIT 40)")
def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended to a log in two batches, and its tail from a cursor on."""
    from millrace.plans import runs
    from millrace.sources.shared import shared_dir
    from millrace.sources.tables import event_tail

    e, at = table(spark, sf_dir, "events"), f"{shared_dir(spark)}/events"
    for half in (0, 1):
        runs.append_events(e.where(F.col("event_id") % 2 == half), at)
    return event_tail(spark.read.parquet(at), 3, 50, 40).select("event_id", F.col("event_type").alias("message"))


# --- more of the way in and out ---------------------------------------------------------------------------------------

_ADDRESSES = """
SELECT 'c' || o_custkey AS site, 'o' || o_orderkey || '@m.test' AS email, CASE WHEN o_orderpriority = '1-URGENT' THEN 'guessed' ELSE 'text' END AS source,
  CASE o_orderkey % 6 WHEN 0 THEN 'smtp_valid' WHEN 1 THEN 'catch_all' WHEN 2 THEN 'mx_valid' WHEN 3 THEN 'unverified' WHEN 4 THEN 'invalid' ELSE 'no_mx' END AS verification, o_orderkey % 3 = 0 AS same_domain, CAST(o_orderkey % 7 AS INT) AS rank FROM {orders}
"""


@query(f"""
WITH e AS ({duck(_ADDRESSES)}), b AS (SELECT site, arg_min(struct_pack(email := email, v := verification), (CASE WHEN source = 'guessed' THEN 1 ELSE 0 END,
  CASE verification WHEN 'smtp_valid' THEN 0 WHEN 'catch_all' THEN 1 WHEN 'mx_valid' THEN 2 WHEN 'unverified' THEN 3 ELSE 4 END, CASE WHEN same_domain THEN 0 ELSE 1 END, rank, email)) AS best FROM e GROUP BY site)
SELECT site, best.email AS email, best.v AS verification FROM b WHERE best.v NOT IN ('invalid', 'no_mx')
""")
def primary_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one address of each site to write to, by all its keys; none where the best is dead."""
    return contacts.primary_emails(made_up(spark, sf_dir, _ADDRESSES)).select("site", "email", "verification")


_ANSWERS = """
SELECT 'query ' || c_custkey AS query, 'us' AS country, p.page AS page, '<ol><li class="b_algo"><h2><a href="https://a' || c_custkey || '.test/' || p.page || '">First <b>hit</b></a></h2><p>About it</p></li><li class="b_algo x"><a href="https://search.test/ck/a?u=' || p.u || '">Second</a><p>More</p></li><li class="b_algo"><a href="/inner">No</a></li></ol>' AS bing,
  '<div class="result results_links"><a class="result__a" href="//d.test/l/?uddg=https%3A%2F%2Fa' || c_custkey || '.test%2F' || p.page || '&amp;r=1">First <b>hit</b></a><a class="result__snippet" href="x">About it</a></div><div class="result result--ad"><a href="https://ad.test/">Ad</a></div><div class="result"><a href="https://two.test/">Second</a><a class="result__snippet">More</a></div>' AS duck
FROM {customer}, (SELECT 1 AS page, 'a1aHR0cHM6Ly90d28udGVzdC8' AS u UNION ALL SELECT 2, 'a1aHR0cHM6Ly90d28udGVzdC8') p
"""


@query("""
WITH q AS (SELECT 'query ' || c_custkey AS query, c_custkey AS k, page, engine FROM customer, (SELECT unnest([1, 2]) AS page), (SELECT unnest(['bing', 'duck']) AS engine))
SELECT engine, query, page::INT AS page, (2 * page - 1)::INT AS rank, 'https://a' || k || '.test/' || page AS url, 'First hit' AS title, 'About it' AS snippet FROM q UNION ALL SELECT engine, query, page, 2 * page, 'https://two.test/', 'Second', 'More' FROM q
""")
def result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result pages of two engines: redirects undone, advertisements and inner links left out, ranks running on over the pages."""
    from millrace.operators.discovery import parsed_results

    a = made_up(spark, sf_dir, _ANSWERS)
    of = lambda column, engine: parsed_results(a.select("query", "country", "page", F.col(column).alias("html")), engine).select(F.lit(column).alias("engine"), "query", "page", "rank", "url", "title", "snippet")
    return of("bing", "bing").unionByName(of("duck", "duckduckgo"))


_FETCHED = """
SELECT 's' || c_custkey % 20 || '.org' AS site, CAST(c_custkey AS INT) AS page_ord, CASE c_custkey % 7 WHEN 0 THEN 404 WHEN 1 THEN 204 ELSE 200 END AS status, CASE WHEN c_custkey % 11 = 0 THEN 'timeout' END AS error, CASE WHEN c_custkey % 13 = 0 THEN '' ELSE '<p>x</p>' END AS html,
  CASE WHEN c_custkey % 5 = 0 THEN 'short' ELSE repeat('text ' || c_custkey % 3 || ' ', 20) END AS text FROM {customer}
"""


@query(f"WITH p AS ({duck(_FETCHED)}) SELECT site, min(page_ord) AS page_ord FROM p WHERE status BETWEEN 200 AND 299 AND error IS NULL AND html <> '' AND length(text) > 80 GROUP BY site, text")
def pages_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.admitted_pages(made_up(spark, sf_dir, _FETCHED), F.col("text")).select("site", "page_ord")


@query("""
SELECT c_custkey AS k, c_custkey % 2 = 0 AND c_custkey % 20 >= 10 AS list_page, c_custkey % 3 = 0 OR (c_custkey % 3 = 1 AND c_custkey % 4 = 0) AS needs_render FROM customer
""")
def page_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages look like lists of companies, and which only a browser would show."""
    from millrace.operators import discovery, html

    c = made_up(spark, sf_dir, "SELECT c_custkey AS k FROM {customer}")
    k = F.col("k")
    agencies = F.repeat(F.lit("An Agency or agencies. "), F.when(k % 2 == 0, 2).otherwise(1))
    body = F.repeat(F.lit("0123456789"), F.when(k % 3 == 0, 40).when(k % 3 == 1, 100).otherwise(200))
    shell = F.when(k % 4 == 0, '<div id="root"></div>').otherwise("<p>x</p>")
    return c.select("k", discovery.looks_like_list(agencies, k % 20).alias("list_page"), html.needs_render(shell, body).alias("needs_render"))


@query("""
SELECT 'd' || c_custkey AS domain, CASE WHEN c_custkey % 3 = 0 THEN 'rejected' ELSE 'review' END AS status, CASE WHEN c_custkey % 6 = 0 THEN 'called' END AS user_status, CASE WHEN c_custkey % 3 = 0 THEN 'old ' || c_custkey ELSE 'old ' || c_custkey END AS notes FROM customer
""")
def lead_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that people make to leads; what a change leaves out stays."""
    from millrace.operators import leads

    c = made_up(spark, sf_dir, "SELECT 'd' || c_custkey AS domain, c_custkey AS k FROM {customer}")
    old = c.select("domain", F.lit("review").alias("status"), F.lit(None).cast("string").alias("user_status"), F.concat(F.lit("old "), "k").alias("notes"))
    changes = c.where("k % 3 = 0").select("domain", F.lit("rejected").alias("status"), F.when(F.col("k") % 6 == 0, "called").alias("user_status"), F.lit(None).cast("string").alias("notes"))
    return leads.patch_lead(old, changes).select("domain", "status", "user_status", "notes")
