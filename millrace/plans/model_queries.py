"""Registered queries of models and rule tables: languages by trigrams, registrable domains by suffix rules, lexicons by one automaton."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import fixed, language, lexicons, text
from millrace.operators import suffixes
from millrace.plans.queries import query
from millrace.sources.tables import table

#: One in so many documents is held out from the language model.
HELD_OUT = 5


@query(rf"""
WITH s AS (SELECT doc_id, lang, trim(regexp_replace(substr(regexp_replace(coalesce(text, ''), '(https?://\S+|\S+@\S+|[\d$€£%]+|[^\p{{L}}\p{{N}}_\s''’.,!?-])', ' ', 'g'), 1, 8000), '\s+', ' ', 'g')) AS t FROM documents),
u AS (SELECT doc_id, lang, t, list_transform(regexp_extract_all(lower(t), '(?s).'), lambda x: unicode(x)::BIGINT) AS u FROM s),
g AS MATERIALIZED (SELECT doc_id, lang, length(t) AS chars, list_transform(range(1, len(u) - 1), lambda i: (u[i] * {language.MIX[0]} + u[i + 1] * {language.MIX[1]} + u[i + 2] * {language.MIX[2]}) % {language.BUCKETS}) AS g FROM u),
counts AS (SELECT lang, b, count(*) AS n FROM (SELECT lang, unnest(g) AS b FROM g WHERE lang IS NOT NULL AND doc_id % {HELD_OUT} <> 0) GROUP BY ALL),
totals AS (SELECT lang, sum(n) AS total FROM counts GROUP BY lang),
weights AS (SELECT lang, b, round(1000 * ln((n + 1) / (total + {language.BUCKETS})))::BIGINT - round(1000 * ln(1 / (total + {language.BUCKETS})))::BIGINT AS w FROM counts JOIN totals USING (lang)),
hits AS (SELECT doc_id, w.lang, sum(w.w * k) AS w FROM (SELECT doc_id, b, count(*) AS k FROM (SELECT doc_id, unnest(g) AS b FROM g) GROUP BY ALL) d JOIN weights w USING (b) GROUP BY ALL),
scores AS (SELECT g.doc_id, t.lang, len(g.g) * round(1000 * ln(1 / (total + {language.BUCKETS})))::BIGINT + coalesce(h.w, 0) AS score FROM g CROSS JOIN totals t LEFT JOIN hits h ON h.doc_id = g.doc_id AND h.lang = t.lang),
best AS (SELECT doc_id, arg_max(lang, (score, -ord)) AS code, max(score) AS top FROM (SELECT *, rank() OVER (ORDER BY lang) AS ord FROM scores) GROUP BY doc_id),
share AS (SELECT doc_id, any_value(code) AS code, 1 / sum(exp((score - top) / {1000 * language.OVERLAP}.0)) AS p FROM scores JOIN best USING (doc_id) GROUP BY doc_id)
SELECT doc_id, g.lang, doc_id % {HELD_OUT} = 0 AS held_out, CASE WHEN chars < 120 THEN 'und' ELSE code END AS code, round_even(CASE WHEN chars < 120 THEN 0.0 ELSE p END, 3) AS confidence FROM g JOIN share USING (doc_id)
""")
def language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language by a model counted from four fifths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    model = language.learn_languages(docs.where(F.col("doc_id") % HELD_OUT != 0))
    d = text.with_language(docs, F.col("text"), F.lit(""), "l", model=model)
    return d.select("doc_id", "lang", (F.col("doc_id") % HELD_OUT == 0).alias("held_out"), F.col("l.code").alias("code"), F.bround("l.confidence", 3).alias("confidence"))


#: Rules of every kind, for the query; ``suffixes.read_rules`` reads a whole list.
RULES = ("com", "org", "net", "uk", "co.uk", "jp", "*.kawasaki.jp", "!city.kawasaki.jp", "*.ck", "!www.ck", "io", "github.io", "br", "com.br", "compute.example.org")
_HOSTS = """
SELECT page_id, CASE page_id % 12 WHEN 0 THEN url WHEN 1 THEN h || '.co.uk/x' WHEN 2 THEN 'https://' || h || '.anything.ck:80/' WHEN 3 THEN 'www.ck' WHEN 4 THEN 'http://shop.www.ck/a' WHEN 5 THEN h || '.city.kawasaki.jp' WHEN 6 THEN h || '.a.kawasaki.jp'
  WHEN 7 THEN 'co.uk' WHEN 8 THEN 'https://u@ann.mykajabi.com/p' WHEN 9 THEN h || '.nowhere' WHEN 10 THEN '10.0.0.' || page_id ELSE 'HTTPS://' || h || '.EU.Compute.Example.ORG./' END AS url FROM (SELECT page_id, url, regexp_extract(url, '^[^:]+://([^/?#]*)', 1) AS h FROM {pages})
"""


@query(f"""
WITH u AS ({_HOSTS.replace('{pages}', 'pages')}), rules AS (SELECT unnest({list(RULES)!r}) AS rule),
h AS (SELECT page_id, url, rtrim(lower(CASE WHEN contains(url, '://') THEN regexp_extract(url, '^[^:]+://(?:[^/?#@]*@)?([^/?#:]*)', 1) ELSE regexp_extract(url, '^([^/:]*)', 1) END), '.') AS host FROM u),
m AS (SELECT DISTINCT host, rule, ltrim(rule, '!*.') AS bare, len(string_split(ltrim(rule, '!*.'), '.')) AS k FROM h, rules),
ok AS (SELECT host, rule, CASE WHEN rule LIKE '!%' THEN k - 1 WHEN rule LIKE '*%' THEN k + 1 ELSE k END AS width FROM m
  WHERE CASE WHEN rule LIKE '*%' THEN ends_with(host, '.' || bare) ELSE host = bare OR ends_with(host, '.' || bare) END),
w AS (SELECT host, arg_max(width, (CASE WHEN rule LIKE '!%' THEN 1 ELSE 0 END, width)) AS width FROM ok GROUP BY host),
d AS (SELECT page_id, url, h.host, width, string_split(h.host, '.') AS l FROM h LEFT JOIN w ON h.host = w.host)
SELECT page_id, CASE WHEN width IS NULL OR regexp_matches(host, '^[0-9.]+$') THEN host WHEN host = 'ann.mykajabi.com' THEN host ELSE array_to_string(l[greatest(1, len(l) - width) : len(l)], '.') END AS domain FROM d
""")
def suffix_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registrable domains of hosts made from the pages' urls: plain, wildcard and exception rules, tenants, hosts without a rule, and addresses."""
    u = spark.sql(_HOSTS, pages=table(spark, sf_dir, "pages"))
    rules = spark.createDataFrame([(r,) for r in RULES], "rule string")
    return suffixes.with_registrable_domain(u, "url", rules).select("page_id", "domain")


_SCRIPTS = """CASE page_id % 7 WHEN 0 THEN '<script src="https://connect.facebook.net/en_US/fbevents.js"></script>' WHEN 1 THEN '<link href="/WP-Content/x.css"><a href="https://calendly.com/me">call</a>' WHEN 2 THEN '<script>gtag( "config" , "AW-1")</script>'
 WHEN 3 THEN '<img src="https://static.wixstatic.com/a.png"> stripe.com checkout' WHEN 4 THEN '<script src="https://js.stripe.com/v3"></script><p>kajabi</p>' WHEN 5 THEN 'Elementor wp-json' ELSE '' END"""


@query(f"""
WITH h AS (SELECT page_id, html || {_SCRIPTS} AS html FROM pages), t AS (SELECT unnest({[label for label, _ in fixed.TECH]!r}) AS label, unnest([{', '.join("'" + p.replace("'", "''") + "'" for _, p in fixed.TECH)}]) AS pattern)
SELECT page_id, label FROM h, t WHERE regexp_matches(html, '(?i)' || pattern)
""")
def tech_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Technologies in the pages' markup, all 47 patterns decided by one automaton."""
    p = table(spark, sf_dir, "pages").selectExpr("page_id", f"html || {_SCRIPTS} AS html")
    return p.select("page_id", F.explode(lexicons.labels_of(F.col("html"), fixed.TECH)).alias("label"))


_TALK = """CASE doc_id % 6 WHEN 0 THEN ' Our Facebook Ads and google ad, meta ads.' WHEN 1 THEN ' A sales funnel, funnels and landing page for course launches' WHEN 2 THEN ' pay-per-click PPC seo' WHEN 3 THEN ' growth partner; scaling your coaching. Split-test' ELSE '' END"""


@query(f"""
WITH d AS (SELECT doc_id, coalesce(text, '') || {_TALK} AS text FROM documents), t AS (SELECT unnest({[label for label, _ in fixed.SERVICES]!r}) AS label, unnest([{', '.join("'" + p.replace("'", "''") + "'" for _, p in fixed.SERVICES)}]) AS pattern)
SELECT doc_id, label, least(30, len(regexp_extract_all(text, '(?i)' || pattern)))::INT AS n FROM d, t WHERE regexp_matches(text, '(?i)' || pattern)
""")
def service_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services that texts speak of, with the number of mentions, 30 at most: one pass decides which of the patterns run."""
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", f"coalesce(text, '') || {_TALK} AS text")
    labels = F.array(*(F.lit(label) for label, _ in fixed.SERVICES))
    counted = d.select("doc_id", F.arrays_zip(labels.alias("label"), lexicons.counts_of(F.col("text"), fixed.SERVICES).alias("n")).alias("z"))
    return counted.select("doc_id", F.explode("z").alias("e")).select("doc_id", F.col("e.label").alias("label"), F.col("e.n").alias("n")).where("n > 0")
