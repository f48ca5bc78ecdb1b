"""The registered queries of the lead engine, each with DuckDB SQL where SQL can express it.

The driver's tables stand in for the engine's: a host for a site, ``pages`` for stored pages, ``customer`` for leads, ``orders`` for their clients
and addresses, ``lineitem`` for funnels, ``events`` for run events. Lexicons are parameters; these queries pass ones that occur in the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import contacts as fc
from millrace.functions import fixed, text, urls
from millrace.operators import contacts, crawl, discovery, funnels, html, leads, merges, picks, scoring
from millrace.plans import pipeline
from millrace.sources.shared import shared_dir
from millrace.sources.tables import event_tail, table
from millrace.streaming import incremental

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Regular expressions that both engines read alike.
HOST = r"^[^:]+://([^/?#]*)"
HREF = r'<a href="([^"]*)"'
BLOCKED = ("example.net",)
BAD_PARTS = tuple(p for p in fixed.BAD_EMAIL_PARTS if p != "example.")
WORD_LEXICON = (("the", r"(^|[^a-z])the([^a-z]|$)"), ("and", r"(^|[^a-z])and([^a-z]|$)"), ("license", r"license"), ("token", r"token"))
MARKUP_LEXICON = (("navigation", r"<nav>"), ("script", r"<script>"), ("advert", r"class=\"ad\""), ("comment", r"<!--"), ("bold", r"<b>"))
AS_OF = "2024-06-30"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def host(url):
    return F.lower(F.regexp_extract(url, HOST, 1))


# --- pages ----------------------------------------------------------------------------------------------------------


@query(r"""
WITH p AS (
  SELECT lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)) AS site, length(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))) AS title_len,
         lower(substr(regexp_extract(html, '(?is)<html[^>]*\slang=["'']?([A-Za-z_-]+)', 1), 1, 10)) AS lang, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS links, length(html) AS chars
  FROM pages),
s AS (
  SELECT site, count(*) AS pages, sum(links)::BIGINT AS links, round_even(avg(title_len), 2) AS avg_title, avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END) AS english, max(chars)::BIGINT AS longest FROM p GROUP BY site)
SELECT site, pages, links, avg_title, round_even(english, 4) AS english, longest, round_even(least(40, 2 * pages) + least(30, links / 10.0) + 30 * english, 0)::INT AS score FROM s
""")
def site_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts and a simple score of every site, in one shuffle."""
    h = F.col("html")
    p = table(spark, sf_dir, "pages").select(
        host(F.col("url")).alias("site"), F.length(html.title_of(h)).alias("title_len"), html.lang_of(h).alias("lang"), F.size(F.regexp_extract_all(h, F.lit(HREF), F.lit(1))).alias("links"), F.length(h).alias("chars"))
    s = p.groupBy("site").agg(F.count("*").alias("pages"), F.sum("links").alias("links"), F.bround(F.avg("title_len"), 2).alias("avg_title"), F.avg((F.col("lang") == "en").cast("double")).alias("english"), F.max("chars").cast("long").alias("longest"))
    score = F.least(F.lit(40), 2 * F.col("pages")) + F.least(F.lit(30), F.col("links") / 10) + 30 * F.col("english")
    return s.select("site", "pages", "links", "avg_title", F.bround("english", 4).alias("english"), "longest", F.bround(score, 0).cast("int").alias("score"))


@query(r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^([^:]+)://', 1) AS scheme, lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)) AS h, regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages),
c AS (SELECT page_id, scheme, h, CASE WHEN length(regexp_replace(path, '/{2,}', '/', 'g')) > 1 THEN regexp_replace(regexp_replace(path, '/{2,}', '/', 'g'), '/$', '') ELSE '/' END AS path,
        list_sort(list_filter(string_split(q, '&'), lambda kv: regexp_matches(kv, '^[^=]*=.+$') AND NOT list_contains(['utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'fbclid', 'gclid', 'msclkid', 'ref', 'referrer', 'mc_cid', 'mc_eid', '_ga', 'yclid', 'igshid', 'si', 'source'], lower(string_split(kv, '=')[1])))) AS kvs FROM p)
SELECT page_id, h AS host, lower(scheme) || '://' || h || path || CASE WHEN len(kvs) > 0 THEN '?' || array_to_string(kvs, '&') ELSE '' END AS canonical FROM c
""")
def url_canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.host_of(u).alias("host"), urls.canonicalize(u).alias("canonical"))


@query(r"""
WITH p AS (SELECT page_id, string_split(lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)), '.') AS l FROM pages)
SELECT page_id, array_to_string(l[greatest(len(l) - 1, 1):], '.') AS domain FROM p
""")
def url_registrable_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.registrable_domain(F.col("url")).alias("domain"))


@query(r"""
SELECT page_id, lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)) AS site FROM pages WHERE NOT regexp_matches(lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)), '(^|\.)example\.net$')
""")
def url_blocked_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocked = spark.createDataFrame([(b,) for b in BLOCKED], "domain string")
    return urls.not_blocked(table(spark, sf_dir, "pages").select("page_id", host(F.col("url")).alias("site")), "site", blocked)


def _kind_sql(path: str) -> str:
    ladder = " ".join(f"WHEN regexp_matches({path}, '(?i){p}') THEN '{k}|{n}'" for k, n, p, _ in sorted(fixed.PAGE_KINDS, key=lambda x: x[1]))
    return f"CASE {ladder} ELSE 'other|' || CASE WHEN length({path}) - length(replace({path}, '/', '')) <= 1 THEN 4 ELSE 6 END END"


@query(f"""
WITH p AS (SELECT page_id, '/' || regexp_replace(regexp_replace(url, '^[^:]*://', ''), '^[^/]*/', '') AS path FROM pages)
SELECT page_id, string_split({_kind_sql('path')}, '|')[1] AS kind, string_split({_kind_sql('path')}, '|')[2]::INT AS priority FROM p
""")
def page_kind_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = urls.classify_url(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", k["kind"].alias("kind"), k["priority"].alias("priority"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all pages by expression."""
    df = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("page_url"), host(F.col("url")).alias("site"), F.posexplode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("link_ord", "href"))
    return df.withColumn("url", urls.absolutize(F.col("page_url"), F.col("href")))


_LINKS_SQL = r"""
raw AS (SELECT page_id, url AS page_url, lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)) AS site, regexp_extract(url, '^([^:]+://[^/?#]*)', 1) AS origin, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hs FROM pages),
links AS (SELECT page_id, page_url, site, i::INT - 1 AS link_ord, hs[i] AS href, origin || hs[i] AS url FROM (SELECT *, unnest(range(1, len(hs) + 1)) AS i FROM raw) WHERE starts_with(trim(hs[i]), '/'))
"""


@query(f"WITH {_LINKS_SQL} SELECT page_id, link_ord, href, url FROM links")
def page_links_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).where("url is not null").select("page_id", "link_ord", "href", "url")


@query(r"""
SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, lower(substr(regexp_extract(html, '(?is)<html[^>]*\slang=["'']?([A-Za-z_-]+)', 1), 1, 10)) AS lang, trim(regexp_extract(html, '(?is)<h1[^>]*>([^<]*)', 1)) AS h1 FROM pages
""")
def page_title_lang_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", html.title_of(h).alias("title"), html.lang_of(h).alias("lang"), html.first_heading(h).alias("h1"))


@query()
def page_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = html.parsed_pages(table(spark, sf_dir, "pages"))
    return p.select("page_id", "parsed.title", "parsed.text", F.size("parsed.links").alias("n_links"), F.size("parsed.blocks").alias("n_blocks"), html.needs_render(F.col("html"), F.col("parsed.text")).alias("needs_render"))


@query(f"""
WITH u AS (SELECT lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)) AS site, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '') AS page, '/' || regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[^:]*://', ''), '^[^/]*/', '') AS path FROM pages),
d AS (SELECT DISTINCT site, page, string_split({_kind_sql('path')}, '|')[1] AS kind, string_split({_kind_sql('path')}, '|')[2]::INT AS priority FROM u),
k AS (SELECT *, row_number() OVER (PARTITION BY site, kind ORDER BY priority, length(page), page) AS r FROM d),
c AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY priority, length(page), page) - 1 AS pick FROM k WHERE r <= CASE kind WHEN 'case_studies' THEN 6 WHEN 'blog' THEN 1 ELSE 2 END)
SELECT site, page AS url, kind, priority, pick::INT AS pick FROM c WHERE pick < 13
""")
def page_budget_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(host(F.col("url")).alias("site"), F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/$", "").alias("url"), urls.classify_url(F.regexp_replace("url", "[?#].*$", "")).alias("k"))
    distinct = p.select("site", "url", F.col("k.kind").alias("kind"), F.col("k.priority").alias("priority")).distinct()
    return crawl.page_budget(distinct)


# --- texts ----------------------------------------------------------------------------------------------------------


@query("SELECT min(doc_id) AS doc_id, lang FROM documents GROUP BY lang, sha256(substr(coalesce(text, ''), 1, 2000))")
def content_prefix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return picks.content_dedup(d.select("doc_id", "lang", "text"), ["lang"], F.col("text"), [F.col("doc_id")]).select("doc_id", "lang")


_GOOD_EMAIL = (
    r"""regexp_full_match(e, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,24}') AND length(e) <= 80 AND """
    + " AND ".join(f"NOT contains(e, '{p}')" for p in BAD_PARTS)
    + r""" AND NOT regexp_matches(split_part(e, '@', 1), '\d{6,}') AND length(split_part(e, '@', 2)) - length(replace(split_part(e, '@', 2), '.', '')) <= 4"""
)
_EMAILS_SQL = rf"""
f AS (SELECT doc_id, unnest(regexp_extract_all(text, '([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,24}})', 1)) AS raw FROM documents),
g AS (SELECT doc_id, lower(regexp_replace(raw, '^[.]+|[.]+$', '', 'g')) AS e FROM f),
emails AS (SELECT doc_id, e AS email FROM g WHERE {_GOOD_EMAIL})
"""


def _emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    found = F.filter(F.transform(F.regexp_extract_all("text", F.lit(f"({fixed.EMAIL})"), F.lit(1)), fc.norm_email), lambda e: fc.valid_email(e, BAD_PARTS))
    return d.select("doc_id", F.explode(found).alias("email"))


@query(f"WITH {_EMAILS_SQL} SELECT doc_id, email, count(*) AS n FROM emails GROUP BY doc_id, email")
def email_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _emails(spark, sf_dir).groupBy("doc_id", "email").agg(F.count("*").alias("n"))


@query(f"""
WITH {_EMAILS_SQL}, d AS (SELECT split_part(email, '@', 2) AS site, email, count(*) AS n FROM emails GROUP BY 1, 2)
SELECT site, email, n, (row_number() OVER (PARTITION BY site ORDER BY n DESC, email) - 1)::INT AS rank FROM d QUALIFY rank < 12
""")
def email_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _emails(spark, sf_dir).groupBy(F.substring_index("email", "@", -1).alias("site"), "email").agg(F.count("*").alias("n"))
    return picks.ranked(d, ["site"], [F.desc("n"), F.col("email")]).where("rank < 12")


@query(f"""
WITH {_EMAILS_SQL}, d AS (SELECT split_part(email, '@', 2) AS site, email, count(*) AS n FROM emails GROUP BY 1, 2)
SELECT site, arg_min(email, (CASE WHEN n > 1 THEN 0 ELSE 1 END, email)) AS email FROM d GROUP BY site
""")
def email_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _emails(spark, sf_dir).groupBy(F.substring_index("email", "@", -1).alias("site"), "email").agg(F.count("*").alias("n"))
    rows = d.select("site", "email", F.lit("text").alias("source"), F.when(F.col("n") > 1, "smtp_valid").otherwise("unverified").alias("verification"), F.lit(True).alias("same_domain"), F.lit(0).alias("rank"))
    return contacts.primary_emails(rows).select("site", "email")


@query("SELECT c_custkey AS i, lower(replace(c_name, '#', '.')) || '@mail' || c_nationkey || '.test' AS email FROM customer")
def cf_email_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses made from the customers' names, protected with a key each, decoded again."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"), F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@mail"), "c_nationkey", F.lit(".test")).alias("plain"))
    key = (F.col("i") % 255 + 1).cast("long")
    two = lambda n: F.lpad(F.lower(F.hex(n)), 2, "0")
    chars = F.transform(F.filter(F.split("plain", ""), lambda x: x != ""), lambda x: two(F.ascii(x).cast("long").bitwiseXOR(key)))
    return c.select("i", fc.decode_protected_email(F.concat(two(key), F.array_join(chars, ""))).alias("email"))


@query(rf"""
WITH f AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '({fixed.PHONE})', 1), lambda x: trim(x)) AS raw FROM documents),
g AS (SELECT doc_id, list_distinct(list_filter(raw, lambda s: length(regexp_replace(s, '\D', '', 'g')) BETWEEN 9 AND 15 AND replace(regexp_replace(s, '\D', '', 'g'), substr(regexp_replace(s, '\D', '', 'g'), 1, 1), '') <> '' AND NOT regexp_matches(s, '(19|20)\d{{2}}[-/.](0?\d|1[0-2])'))) AS p FROM f)
SELECT doc_id, len(p)::INT AS n_phones, array_to_string(list_sort(p), ';') AS phones FROM g WHERE len(p) > 0
""")
def phone_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", fc.phones_in(F.col("text")).alias("p"))
    return d.where(F.size("p") > 0).select("doc_id", F.size("p").alias("n_phones"), F.array_join(F.array_sort("p"), ";").alias("phones"))


@query(r"""
WITH p AS (SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
q AS (SELECT doc_id, unnest(string_split(regexp_replace(trim(line), '([.!?])\s+([A-Z"“(])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS s FROM p),
n AS (SELECT doc_id, count(*) AS n, sum(length(trim(s))) AS c FROM q WHERE trim(s) <> '' GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN text IS NOT NULL THEN coalesce(n, 0) END::INT AS n_sentences, CASE WHEN text IS NOT NULL THEN coalesce(c, 0) END::INT AS chars FROM documents d LEFT JOIN n USING (doc_id)
""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = text.sentences(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(s).alias("n_sentences"), F.aggregate(s, F.lit(0), lambda acc, x: acc + F.length(x)).alias("chars"))


@query("""
SELECT conv_id, turn, role FROM (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING) AS s FROM conversations) WHERE s <= 3000
""")
def char_budget_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picks.within_budget(table(spark, sf_dir, "conversations"), ["conv_id"], [F.col("turn"), F.col("role")], F.length("text"), 3000).select("conv_id", "turn", "role")


_STOP = ", ".join(f"'{w}'" for w in fixed.QUERY_STOP)


@query(rf"""
WITH q AS (SELECT conv_id, text AS q FROM conversations WHERE turn = 0),
t AS (SELECT conv_id, list_filter(regexp_extract_all(regexp_replace(regexp_replace(lower(q), 'site:\S+', ' ', 'g'), '["''()]', ' ', 'g'), '([a-z0-9][a-z0-9.\-]+)', 1), lambda t: length(t) > 2 AND NOT list_contains([{_STOP}], t)) AS terms FROM q),
r AS (SELECT c.conv_id, terms, lower(concat_ws(' ', role, text, '')) AS blob FROM conversations c JOIN t USING (conv_id) WHERE turn > 0)
SELECT conv_id, avg(CASE WHEN len(terms) = 0 OR len(list_filter(terms, lambda x: contains(blob, x))) >= least(2, len(terms)) THEN 1.0 ELSE 0.0 END) AS relevance, count(*) AS n FROM r GROUP BY conv_id
""")
def query_terms_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first turn as query, later turns as its results."""
    c = table(spark, sf_dir, "conversations")
    q = c.where("turn = 0").select(F.col("conv_id").alias("qid"), F.col("text").alias("query"))
    r = c.where("turn > 0").join(q, F.col("conv_id") == F.col("qid")).select("conv_id", "query", F.col("role").alias("title"), F.col("text").alias("snippet"), F.lit("").alias("url"))
    return discovery.relevance(r, ["conv_id"])


def _counts_sql(lexicon, column: str) -> str:
    return ", ".join(f"least(len(regexp_extract_all({column}, '(?i){p}')), 30)::INT AS n_{label}" for label, p in lexicon)


@query(f"SELECT doc_id, {_counts_sql(WORD_LEXICON, 'text')} FROM documents")
def lexicon_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = text.label_counts(F.col("text"), WORD_LEXICON)
    n = lambda label: F.coalesce(F.try_element_at(F.filter("c", lambda x: x["label"] == label), F.lit(1))["n"], F.lit(0)).alias(f"n_{label}")
    return table(spark, sf_dir, "documents").select("doc_id", counts.alias("c")).select("doc_id", *(n(label) for label, _ in WORD_LEXICON))


@query("SELECT page_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(html, '(?i){p}') THEN '{label}' END" for label, p in MARKUP_LEXICON) + "], lambda x: x IS NOT NULL), ',') AS tech FROM pages")
def tech_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(text.labels_matching(F.col("html"), MARKUP_LEXICON), ",").alias("tech"))


@query(r"""
WITH f AS (SELECT doc_id, unnest(regexp_extract_all(text, '([A-Z][a-z]+ [a-z]+ [A-Za-z]+)', 1)) AS s FROM documents),
w AS (SELECT s, list_filter(regexp_extract_all(s, '([A-Za-z][A-Za-z''.-]*)', 1), lambda w: length(w) > 1) AS ws FROM f)
SELECT s AS phrase, count(*) AS n, round_even(max(CASE WHEN len(ws) = 0 THEN 0.0 ELSE len(list_filter(ws, lambda w: regexp_matches(w, '^[A-Z]')))::DOUBLE / len(ws) END), 4) AS ratio FROM w GROUP BY s HAVING count(*) > 1
""")
def titlecase_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"([A-Z][a-z]+ [a-z]+ [A-Za-z]+)"), F.lit(1))).alias("phrase"))
    return f.groupBy("phrase").agg(F.count("*").alias("n"), F.bround(F.max(text.titlecase_ratio(F.col("phrase"))), 4).alias("ratio")).where("n > 1")


def _language_sql() -> str:
    """Function words of each language counted over the words of a cleaned sample."""
    lists = {code: ", ".join(f"'{w}'" for w in words.split()) for code, words in text.FUNCTION_WORDS.items()}
    hits = ", ".join(f"len(list_filter(toks, lambda x: list_contains([{words}], x))) AS n_{code}" for code, words in lists.items())
    best = " ".join(f"WHEN n_{c} = greatest({', '.join(f'n_{x}' for x in lists)}) THEN '{c}'" for c in lists)
    return rf"""
WITH s AS (SELECT doc_id, lang, trim(regexp_replace(substr(regexp_replace(coalesce(text, ''), '(https?://\S+|\S+@\S+|[\d$€£%]+|[^\p{{L}}\p{{N}}_\s''’.,!?-])', ' ', 'g'), 1, 8000), '\s+', ' ', 'g')) AS t FROM documents),
w AS (SELECT doc_id, lang, length(t) AS chars, regexp_split_to_array(lower(t), '[^\p{{L}}]+') AS toks FROM s), h AS (SELECT doc_id, lang, chars, {hits} FROM w),
b AS (SELECT *, {' + '.join(f'n_{c}' for c in lists)} AS total, greatest({', '.join(f'n_{c}' for c in lists)}) AS top, CASE {best} END AS best FROM h),
r AS (SELECT doc_id, lang, CASE WHEN chars < 120 OR total = 0 THEN 'und' ELSE best END AS code, CASE WHEN chars < 120 OR total = 0 THEN 0.0 ELSE top::DOUBLE / total END AS c FROM b)
SELECT doc_id, lang, code, round_even(c, 3) AS confidence, code = 'en' AND c >= 0.75 AS english FROM r
"""


@query(_language_sql())
def language_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = text.with_language(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), F.col("text"), F.lit(""), "l")
    return d.select("doc_id", "lang", F.col("l.code").alias("code"), F.bround("l.confidence", 3).alias("confidence"), ((F.col("l.code") == "en") & (F.col("l.confidence") >= fixed.ENGLISH_CONFIDENCE)).alias("english"))


@query(r"""
WITH p AS (SELECT lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)) AS site, page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|head)[^>]*>.*?</(script|style|head)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM pages),
h AS (SELECT site, arg_min(t, page_id) AS t FROM p GROUP BY site)
SELECT site, CASE WHEN length(t) < 150 THEN 'thin_content' WHEN regexp_matches(substr(t, 1, 4000), '(?i)(coming soon|domain (is )?for sale|under construction)') AND length(t) < 2500 THEN 'parked_or_placeholder' ELSE 'ok' END AS reason FROM h
""")
def liveness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style|head)[^>]*>.*?</(script|style|head)>", " "), "<[^>]*>", " "), r"\s+", " "))
    p = table(spark, sf_dir, "pages").select(host(F.col("url")).alias("site"), "page_id", plain.alias("t"))
    h = p.groupBy("site").agg(F.min_by("t", "page_id").alias("t"))
    reason = F.when(F.length("t") < 150, "thin_content").when(F.substring("t", 1, 4000).rlike(r"(?i)(coming soon|domain (is )?for sale|under construction)") & (F.length("t") < 2500), "parked_or_placeholder").otherwise("ok")
    return h.select("site", reason.alias("reason"))


# --- leads ----------------------------------------------------------------------------------------------------------

_LEADS_SQL = """
agencies AS (SELECT 'c' || c_custkey AS domain, c_name AS name, c_mktsegment AS tagline, CASE WHEN c_custkey % 3 = 0 THEN 'founder ' || c_custkey END AS founder_name, CASE WHEN c_custkey % 5 = 0 THEN 'in/' || c_custkey END AS founder_linkedin,
  floor(c_acctbal / 100)::INT AS score, CASE c_mktsegment WHEN 'BUILDING' THEN 'qualified' WHEN 'MACHINERY' THEN 'review' WHEN 'FURNITURE' THEN 'review' ELSE 'rejected' END AS status,
  CASE WHEN c_acctbal >= 8000 THEN 'A' WHEN c_acctbal >= 6000 THEN 'B' WHEN c_acctbal >= 2000 THEN 'C' END AS tier, c_nationkey::VARCHAR AS country, CASE WHEN c_acctbal < 0 THEN 'dead:thin' WHEN c_mktsegment = 'FURNITURE' THEN 'weak_icp' END AS reject_reason FROM customer),
emails AS (SELECT 'c' || o_custkey AS domain, 'o' || o_orderkey || '@m.test' AS email, CASE WHEN o_orderpriority = '1-URGENT' THEN 'guessed' ELSE 'text' END AS source, CASE o_orderstatus WHEN 'F' THEN 'smtp_valid' WHEN 'O' THEN 'mx_valid' ELSE 'invalid' END AS verification, o_orderkey AS rank FROM orders WHERE o_orderkey % 2 = 0),
clients AS (SELECT 'c' || o_custkey AS domain, 'k' || o_orderkey AS name, round(o_totalprice / 500000, 3) AS confidence, CASE WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 'coach' END AS role_title, CASE WHEN o_orderstatus = 'F' THEN 'resolved' ELSE 'new' END AS status FROM orders WHERE o_orderkey % 2 = 1),
funnels AS (SELECT 'c' || o_custkey AS domain, 'k' || o_orderkey AS client_name, 'f' || l_linenumber || '-' || l_partkey AS url, l_returnflag AS funnel_type, l_discount AS confidence FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 2 = 1 AND l_quantity > 25)
"""


def _lead_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    c, o, li = (table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem"))
    bal, seg = F.col("c_acctbal"), F.col("c_mktsegment")
    agencies = c.select(
        F.concat(F.lit("c"), "c_custkey").alias("domain"), F.col("c_name").alias("name"), seg.alias("tagline"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("founder "), "c_custkey")).alias("founder_name"), F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("in/"), "c_custkey")).alias("founder_linkedin"),
        F.floor(bal / 100).cast("int").alias("score"), F.when(seg == "BUILDING", "qualified").when(seg.isin("MACHINERY", "FURNITURE"), "review").otherwise("rejected").alias("status"),
        F.when(bal >= 8000, "A").when(bal >= 6000, "B").when(bal >= 2000, "C").alias("tier"), F.col("c_nationkey").cast("string").alias("country"), F.when(bal < 0, "dead:thin").when(seg == "FURNITURE", "weak_icp").alias("reject_reason"))
    domain = F.concat(F.lit("c"), "o_custkey").alias("domain")
    verification = F.when(F.col("o_orderstatus") == "F", "smtp_valid").when(F.col("o_orderstatus") == "O", "mx_valid").otherwise("invalid")
    emails = o.where("o_orderkey % 2 = 0").select(domain, F.concat(F.lit("o"), "o_orderkey", F.lit("@m.test")).alias("email"), F.when(F.col("o_orderpriority") == "1-URGENT", "guessed").otherwise("text").alias("source"), verification.alias("verification"), F.col("o_orderkey").alias("rank"), F.lit(False).alias("is_primary"))
    odd = o.where("o_orderkey % 2 = 1")
    name = F.concat(F.lit("k"), "o_orderkey")
    clients = odd.select(domain, name.alias("name"), F.round(F.col("o_totalprice") / 500000, 3).alias("confidence"), F.when(F.col("o_orderpriority").isin("2-HIGH", "3-MEDIUM"), "coach").alias("role_title"), F.when(F.col("o_orderstatus") == "F", "resolved").otherwise("new").alias("status"))
    funnels_ = odd.join(li.where("l_quantity > 25"), F.col("o_orderkey") == F.col("l_orderkey")).select(domain, name.alias("client_name"), F.concat(F.lit("f"), "l_linenumber", F.lit("-"), "l_partkey").alias("url"), F.col("l_returnflag").alias("funnel_type"), F.col("l_discount").alias("confidence"))
    return agencies, emails, clients, funnels_


_LIVE = "status IN ('qualified', 'review')"
_FIELDS = ("domain", "name", "score", "status", "tier", "country")


@query(f"""
WITH {_LEADS_SQL} SELECT domain, name, score, status, tier, country FROM agencies
WHERE {_LIVE} AND score >= 20 AND tier IN ('A', 'B') AND (name ILIKE '%1%' OR domain ILIKE '%1%' OR tagline ILIKE '%1%' OR founder_name ILIKE '%1%') ORDER BY score DESC, domain DESC LIMIT 50
""")
def lead_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, *_ = _lead_tables(spark, sf_dir)
    return leads.search_leads(a, q="1", min_score=20, tier=["A", "B"]).select(*_FIELDS)


@query(f"""
WITH {_LEADS_SQL} SELECT domain, name, score, status, tier, country FROM agencies WHERE {_LIVE} AND country = '3' AND founder_linkedin IS NULL ORDER BY name ASC, domain DESC LIMIT 10 OFFSET 5
""")
def lead_search_page2(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, *_ = _lead_tables(spark, sf_dir)
    return leads.search_leads(a, min_score=-1000, country="3", has_linkedin=False, sort="name", descending=False, offset=5, limit=10).select(*_FIELDS)


@query(f"WITH {_LEADS_SQL} SELECT domain, score FROM agencies WHERE {_LIVE} AND domain IN (SELECT domain FROM emails WHERE verification NOT IN ('invalid', 'no_mx'))")
def has_child_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, e, _, _ = _lead_tables(spark, sf_dir)
    return leads.matching_leads(a, e, has_email=True, min_score=-1000).select("domain", "score")


@query(f"WITH {_LEADS_SQL} SELECT domain, score FROM agencies WHERE {_LIVE} AND domain NOT IN (SELECT domain FROM clients)")
def has_child_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, _, c, _ = _lead_tables(spark, sf_dir)
    return leads.matching_leads(a, None, c, has_client=False, min_score=-1000).select("domain", "score")


@query(f"WITH {_LEADS_SQL} SELECT domain, score FROM agencies WHERE {_LIVE} AND domain IN (SELECT f.domain FROM clients c JOIN funnels f ON c.domain = f.domain AND c.name = f.client_name)")
def has_grandchild_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, _, c, f = _lead_tables(spark, sf_dir)
    under = c.select(F.col("domain").alias("d"), "name").join(f, (F.col("d") == F.col("domain")) & (F.col("name") == F.col("client_name"))).select("domain")
    return leads.matching_leads(a, None, None, under, has_funnel=True, min_score=-1000).select("domain", "score")


@query(f"WITH {_LEADS_SQL} SELECT status, count(*) AS n FROM agencies GROUP BY status")
def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads.histogram(_lead_tables(spark, sf_dir)[0], "status")


@query(f"WITH {_LEADS_SQL} SELECT tier, count(*) AS n FROM agencies GROUP BY tier")
def tier_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads.histogram(_lead_tables(spark, sf_dir)[0], "tier")


@query(f"WITH {_LEADS_SQL} SELECT split_part(reject_reason, ':', 1) AS reason, count(*) AS n FROM agencies WHERE reject_reason IS NOT NULL GROUP BY 1")
def reject_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads.reject_reasons(_lead_tables(spark, sf_dir)[0])


@query(f"""
WITH {_LEADS_SQL}, live AS (SELECT domain, score FROM agencies WHERE {_LIVE})
SELECT count(*) AS total, (SELECT count(DISTINCT domain) FROM live JOIN emails USING (domain) WHERE verification NOT IN ('invalid', 'no_mx')) AS with_email, (SELECT count(DISTINCT domain) FROM live JOIN emails USING (domain) WHERE verification = 'smtp_valid') AS with_verified,
  (SELECT count(DISTINCT domain) FROM live JOIN clients USING (domain)) AS with_client, (SELECT count(DISTINCT domain) FROM live JOIN funnels USING (domain)) AS with_funnel, round_even(coalesce(avg(score), 0), 1) AS avg_score FROM live
""")
def distinct_parent_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads.lead_stats(*_lead_tables(spark, sf_dir))


@query(f"""
WITH {_LEADS_SQL}, k AS (SELECT c.domain, c.name, c.confidence, c.status, EXISTS (SELECT 1 FROM funnels f WHERE f.domain = c.domain AND f.client_name = c.name) AS has_funnel FROM clients c)
SELECT domain, arg_min(name, (CASE WHEN status = 'resolved' THEN 0 ELSE 1 END, CASE WHEN has_funnel THEN 0 ELSE 1 END, -confidence, name)) AS client_name, count(*) AS clients_count FROM k GROUP BY domain
""")
def best_child_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, c, f = _lead_tables(spark, sf_dir)
    return leads.best_clients(c, f).select("domain", F.col("client.name").alias("client_name"), "clients_count")


@query(f"""
WITH {_LEADS_SQL}, f AS (SELECT domain, client_name, string_agg(url, '+' ORDER BY confidence DESC, url) AS fs FROM funnels GROUP BY domain, client_name),
c AS (SELECT c.domain, string_agg(name || '/' || status || '/' || coalesce(fs, ''), ' ' ORDER BY confidence DESC, name) AS clients FROM clients c LEFT JOIN f ON f.domain = c.domain AND f.client_name = c.name GROUP BY c.domain),
e AS (SELECT domain, string_agg(email, ' ' ORDER BY rank, email) AS emails FROM emails GROUP BY domain)
SELECT a.domain, score, coalesce(emails, '') AS emails, coalesce(clients, '') AS clients FROM agencies a LEFT JOIN e USING (domain) LEFT JOIN c USING (domain)
""")
def lead_detail_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested lists of each lead, written out in their order."""
    d = leads.lead_detail(*_lead_tables(spark, sf_dir))
    urls_of = lambda c: F.array_join(F.transform(F.coalesce(c["funnels"], F.array()), lambda f: f["url"]), "+")
    line = lambda c: F.concat(c["name"], F.lit("/"), c["status"], F.lit("/"), urls_of(c))
    return d.select("domain", "score", F.coalesce(F.array_join(F.transform("emails", lambda e: e["email"]), " "), F.lit("")).alias("emails"), F.coalesce(F.array_join(F.transform("clients", line), " "), F.lit("")).alias("clients"))


@query(f"""
WITH {_LEADS_SQL}, e AS (SELECT domain, arg_min(email, (rank, email)) AS email, string_agg(email, ';' ORDER BY rank, email) AS all_emails FROM emails GROUP BY domain),
f AS (SELECT domain, client_name, arg_min(url, (-confidence, url)) AS url FROM funnels GROUP BY domain, client_name), k AS (SELECT c.*, f.url AS funnel FROM clients c LEFT JOIN f ON f.domain = c.domain AND f.client_name = c.name),
c AS (SELECT domain, arg_min(name, (CASE WHEN status = 'resolved' THEN 0 ELSE 1 END, CASE WHEN funnel IS NOT NULL THEN 0 ELSE 1 END, -confidence, name)) AS client, count(*) AS clients_count FROM k GROUP BY domain)
SELECT a.domain, e.email, coalesce(all_emails, '') AS all_emails, client, k.funnel, coalesce(clients_count, 0) AS clients_count FROM agencies a LEFT JOIN e USING (domain) LEFT JOIN c USING (domain) LEFT JOIN k ON k.domain = a.domain AND k.name = c.client
""")
def lead_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = leads.lead_summary(*_lead_tables(spark, sf_dir))
    return s.select("domain", F.col("primary.email").alias("email"), F.coalesce(F.array_join("all_emails", ";"), F.lit("")).alias("all_emails"), F.col("client.name").alias("client"), F.col("funnel.url").alias("funnel"), "clients_count")


@query(f"""
WITH {_LEADS_SQL}, live AS (SELECT * FROM agencies WHERE {_LIVE} AND score >= 0),
e AS (SELECT domain, arg_min(email, (rank, email)) AS email, arg_min(verification, (rank, email)) AS email_verification, string_agg(email, '; ' ORDER BY rank, email) AS all_emails FROM emails GROUP BY domain),
k AS (SELECT c.*, EXISTS (SELECT 1 FROM funnels f WHERE f.domain = c.domain AND f.client_name = c.name) AS has_funnel FROM clients c),
c AS (SELECT domain, arg_min(name, (CASE WHEN status = 'resolved' THEN 0 ELSE 1 END, CASE WHEN has_funnel THEN 0 ELSE 1 END, -confidence, name)) AS client_name, count(*) AS clients_count FROM k GROUP BY domain)
SELECT coalesce(tier, '') AS tier, score, status, name AS agency_name, domain, coalesce(email, '') AS email, coalesce(email_verification, '') AS email_verification, coalesce(all_emails, '') AS all_emails, coalesce(founder_name, '') AS founder_name, country, coalesce(client_name, '') AS client_name, coalesce(clients_count, 0) AS clients_count, coalesce(reject_reason, '') AS reject_reason
FROM live LEFT JOIN e USING (domain) LEFT JOIN c USING (domain)
""")
def lead_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, e, c, f = _lead_tables(spark, sf_dir)
    text_, list_ = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    extra = {k: text_ for k in ("website", "founder_title", "founder_source", "city", "booking_url", "last_activity", "description")} | {k: list_ for k in ("services", "icp_signals", "tech", "phones")}
    a = a.withColumns(extra | {"socials": F.lit(None).cast("map<string,string>"), "key_pages": F.lit(None).cast("map<string,string>"), "pages_crawled": F.lit(0)})
    c = c.withColumns({k: text_ for k in ("niche", "website", "evidence", "evidence_url")})
    f = f.withColumns({"platform": text_, "offer": text_, "price_hint": text_, "steps": list_})
    return leads.export_rows(a, e, c, f).select("tier", "score", "status", "agency_name", "domain", "email", "email_verification", "all_emails", "founder_name", "country", "client_name", "clients_count", "reject_reason")


@query(f"""
WITH {_LEADS_SQL}, x AS (SELECT domain, score, CASE WHEN reject_reason IS NOT NULL THEN CASE WHEN score < 40 THEN 'rejected|-|' ELSE 'review|C|' END || reject_reason
  WHEN score >= 55 THEN CASE WHEN e AND k THEN 'qualified|A|-' WHEN e THEN 'qualified|B|-' WHEN k THEN 'qualified|C|-' ELSE 'review|C|-' END WHEN score >= 40 THEN 'review|C|-' ELSE 'rejected|-|low_score' END AS v
  FROM (SELECT a.*, a.domain IN (SELECT domain FROM emails) AS e, a.domain IN (SELECT domain FROM clients WHERE confidence >= 0.5) AS k FROM agencies a))
SELECT domain, score, split_part(v, '|', 1) AS status, nullif(split_part(v, '|', 2), '-') AS tier, nullif(split_part(v, '|', 3), '-') AS reason FROM x
""")
def score_and_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, e, c, _ = _lead_tables(spark, sf_dir)
    has = e.select(F.col("domain").alias("ed")).distinct().withColumn("e", F.lit(True))
    coach = c.where("confidence >= 0.5").select(F.col("domain").alias("cd")).distinct().withColumn("k", F.lit(True))
    df = a.join(has, F.col("domain") == F.col("ed"), "left").join(coach, F.col("domain") == F.col("cd"), "left")
    v = scoring.verdict(F.col("score"), F.col("reject_reason"), F.coalesce("e", F.lit(False)), F.coalesce("k", F.lit(False)))
    return df.withColumn("v", v).select("domain", "score", "v.status", "v.tier", "v.reason")


@query(f"""
WITH {_LEADS_SQL}, x AS (SELECT a.*, a.domain IN (SELECT domain FROM emails WHERE verification NOT IN ('invalid', 'no_mx') AND (source <> 'guessed' OR verification = 'smtp_valid')) AS e,
  a.domain IN (SELECT domain FROM clients WHERE confidence >= 0.5 AND (role_title IS NOT NULL OR status = 'resolved')) AS k, a.domain IN (SELECT domain FROM funnels) AS f, status = 'qualified' OR (score >= 55 AND reject_reason IS NULL) AS strong FROM agencies a),
t AS (SELECT *, CASE WHEN NOT strong THEN 'C' WHEN e AND k AND f THEN 'A' WHEN e AND k THEN CASE WHEN score >= 65 THEN 'A' ELSE 'B' END WHEN e THEN 'B' ELSE 'C' END AS new FROM x)
SELECT domain, score, CASE WHEN {_LIVE} THEN new ELSE tier END AS tier, CASE WHEN {_LIVE} AND strong THEN CASE WHEN new IN ('A', 'B') THEN 'qualified' ELSE 'review' END ELSE status END AS status FROM t
""")
def tier_finalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.finalized(*_lead_tables(spark, sf_dir)).select("domain", "score", "tier", "status")


# --- discovery ------------------------------------------------------------------------------------------------------


@query("""
WITH s AS (SELECT lower(r_name) || ' ads agency' AS s, r_regionkey < 2 AS sh FROM region), a AS (SELECT lower(n_name) || ' coaches' AS a, n_nationkey < 3 AS ah FROM nation),
c AS (SELECT *, s || ' for ' || a AS base FROM s, a),
t AS (SELECT 'best agencies' AS text, 'listicle' AS kind, 1 AS priority UNION ALL SELECT base, 'matrix', 2 FROM c UNION ALL SELECT base || ' ' || p, 'geo', 4 FROM c, (SELECT unnest(['london', 'sydney']) AS p) WHERE sh AND ah
  UNION ALL SELECT 'best marketing agencies for coaches ' || p, 'geo', 4 FROM (SELECT unnest(['london', 'sydney']) AS p))
SELECT text, kind, priority FROM t
""")
def query_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    services = table(spark, sf_dir, "region").select(F.concat(F.lower("r_name"), F.lit(" ads agency")).alias("term"), (F.col("r_regionkey") < 2).alias("hot"))
    audiences = table(spark, sf_dir, "nation").select(F.concat(F.lower("n_name"), F.lit(" coaches")).alias("term"), (F.col("n_nationkey") < 3).alias("hot"))
    first = spark.createDataFrame([("best  agencies", "listicle", 1), ("Best agencies", "listicle", 1)], "text string, kind string, priority int").withColumn("text", F.lower(F.regexp_replace("text", r"\s+", " ")))
    places = spark.createDataFrame([("london",), (" sydney ",), ("",)], "place string")
    return discovery.query_matrix(first, services, audiences, places=places)


_HOSTS = r"SELECT page_id, lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)) AS domain FROM pages"


@query(f"""
WITH p AS ({_HOSTS}), a AS (SELECT DISTINCT domain FROM p WHERE page_id % 2 = 0), b AS (SELECT DISTINCT domain FROM p WHERE page_id % 2 = 1)
SELECT coalesce(a.domain, b.domain) AS domain, ((a.domain IS NOT NULL)::INT + (b.domain IS NOT NULL)::INT) AS hits FROM a FULL JOIN b ON a.domain = b.domain
""")
def candidate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches, one after the other."""
    p = table(spark, sf_dir, "pages").select("page_id", host(F.col("url")).alias("domain"))
    none = spark.createDataFrame([], "domain string, hits int")
    return merges.merge_candidates(merges.merge_candidates(none, p.where("page_id % 2 = 0")), p.where("page_id % 2 = 1"))


@query(f"WITH p AS ({_HOSTS}) SELECT DISTINCT domain FROM p WHERE page_id % 2 = 1 AND domain NOT IN (SELECT domain FROM p WHERE page_id % 2 = 0)")
def candidate_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", host(F.col("url")).alias("domain"))
    return merges.new_domains(p.where("page_id % 2 = 0"), p.where("page_id % 2 = 1"))


_CODE = "CASE c_custkey % 7 WHEN 0 THEN 250 WHEN 1 THEN 550 WHEN 2 THEN 554 WHEN 3 THEN 450 WHEN 4 THEN NULL ELSE 251 END"


@query(f"""
WITH x AS (SELECT c_custkey, c_nationkey % 5 AS hosts, {_CODE} AS code, CASE WHEN c_custkey % 2 = 0 THEN 'no such user' ELSE 'later' END AS msg, c_custkey % 3 = 0 AS catch_all FROM customer)
SELECT c_custkey, CASE WHEN hosts = 0 THEN 'no_mx' WHEN code IS NULL THEN 'mx_valid' WHEN code BETWEEN 200 AND 299 THEN CASE WHEN catch_all THEN 'catch_all' ELSE 'smtp_valid' END WHEN code IN (550, 551, 553) OR (code = 554 AND msg = 'no such user') THEN 'invalid' ELSE 'mx_valid' END AS verification FROM x
""")
def verification_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 7
    code = F.when(k == 0, 250).when(k == 1, 550).when(k == 2, 554).when(k == 3, 450).when(k == 4, None).otherwise(251)
    msg = F.when(F.col("c_custkey") % 2 == 0, "no such user").otherwise("later")
    return table(spark, sf_dir, "customer").select("c_custkey", fc.verification(F.col("c_nationkey") % 5, F.lit(True), code, msg, F.col("c_custkey") % 3 == 0).alias("verification"))


@query("""
WITH x AS (SELECT 'n' || n_nationkey || '.test' AS site, n_nationkey AS k FROM nation WHERE n_nationkey % 4 <> 0), g AS (SELECT site, k, i, ['hello', 'info', 'contact', 'team', 'hi'][i + 1] || '@' || site AS email FROM x, range(0, 5) t(i)),
v AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'catch_all' WHEN i % 2 = 1 THEN 'smtp_valid' ELSE 'invalid' END AS verification FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY i) - 1 AS r FROM v WHERE verification = 'smtp_valid' OR (verification = 'catch_all' AND i = 0))
SELECT site, email, verification, CASE WHEN verification = 'smtp_valid' THEN 0.35 ELSE 0.2 END::DOUBLE AS confidence, (100 + r)::INT AS rank FROM r WHERE r < 2
""")
def email_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey", F.lit(".test")).alias("site"), F.col("n_nationkey").alias("k"))
    mx = n.where("k % 4 <> 0").select(F.col("site").alias("domain"), F.lit(10).alias("preference"), F.lit("mx").alias("exchange"))
    tried = n.select("site", "k", F.posexplode(F.array(*map(F.lit, fixed.GUESSED_LOCALS))).alias("i", "local"))
    probes = tried.select(F.concat("local", F.lit("@"), "site").alias("email"), F.when((F.col("k") % 3 == 0) | (F.col("i") % 2 == 1), 250).otherwise(550).alias("code"), F.lit("").alias("msg"), (F.col("k") % 3 == 0).alias("is_catch_all"))
    return contacts.guessed_emails(n.select("site"), mx, probes).select("site", "email", "verification", "confidence", "rank")


@query(f"""
WITH {_LINKS_SQL}, d AS (SELECT site, url, page_id, link_ord FROM links)
SELECT site, url, min(page_id) AS page_id FROM d GROUP BY site, url
""")
def serp_merge_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _links(spark, sf_dir).where("url is not null").select("site", "url", "page_id", "link_ord")
    return picks.first_by(d, ["site", "url"], [F.col("page_id"), F.col("link_ord")]).select("site", "url", "page_id")


@query(r"""
WITH o AS (SELECT 'list' || page_id % 10 || '.test' AS site, page_id, regexp_extract(url, '^([^:]+://[^/?#]*)', 1) || '/' AS url, string_split(lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)), '.') AS l FROM pages),
d AS (SELECT *, array_to_string(l[greatest(len(l) - 1, 1):], '.') AS domain FROM o)
SELECT site, domain, arg_min(url, (page_id, url)) AS url, '' AS anchor, 2.0::DOUBLE AS score FROM d WHERE domain <> 'example.net' GROUP BY site, domain
""")
def listicle_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front pages of all urls, as if ten list pages linked them."""
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("list"), F.col("page_id") % 10, F.lit(".test")).alias("site"), F.col("page_id").cast("int").alias("link_ord"), F.concat(F.regexp_extract("url", r"^([^:]+://[^/?#]*)", 1), F.lit("/")).alias("url"), F.lit("").alias("anchor"))
    headings = spark.createDataFrame([], "site string, headings_text string")
    return discovery.list_links(p, headings, spark.createDataFrame([(b,) for b in BLOCKED], "domain string")).select("site", "domain", "url", "anchor", "score")


#: Types in order of preference, as the oracle states them.
_TYPE_ORDER = ["webinar", "vsl", "application", "challenge", "quiz", "lead_magnet", "course_sales", "low_ticket", "book_funnel", "community", "newsletter", "link_in_bio"]


@query(f"""
SELECT page_id, coalesce(arg_max(t, (s, -o)) FILTER (s >= 3), 'landing_page') AS funnel_type FROM (
  SELECT page_id, unnest([{", ".join(f"struct_pack(t := '{t}', o := {_TYPE_ORDER.index(t)}, s := 3 * len(regexp_extract_all(blob, '(?i)({p})', 1)))" for t, p in fixed.FUNNEL_TYPES)}], recursive := true)
  FROM (SELECT page_id, regexp_replace(url, '^[^:]*://', '') || '   ' AS blob FROM pages)) GROUP BY page_id
""")
def funnel_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit("")
    return table(spark, sf_dir, "pages").select("page_id", funnels.funnel_type(F.col("url"), none, none, none, none).alias("funnel_type"))


@query()
def funnel_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = html.parsed_pages(table(spark, sf_dir, "pages"))
    return p.select("page_id", funnels.funnel_steps(F.col("html"), F.col("parsed.text"), F.col("parsed.fields")).alias("steps"))


# --- events ---------------------------------------------------------------------------------------------------------


@query("SELECT event_id, event_type, value FROM (SELECT * FROM events WHERE user_id = 8 AND event_id > 100 ORDER BY event_id DESC LIMIT 50)")
def event_tail_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_tail(table(spark, sf_dir, "events"), 8, 100, 50).select("event_id", "event_type", "value")


def _serp_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("event_type") == "error", "blocked").when(F.col("event_type") == "signup", "failed").otherwise("ok")
    return table(spark, sf_dir, "events").select(F.concat(F.lit("engine"), F.col("user_id") % 40).alias("engine"), F.col("ts").cast("timestamp").alias("ts"), outcome.alias("outcome"), F.col("event_type").alias("reason"), F.col("event_id").cast("int").alias("n_results"))


@query("""
WITH e AS (SELECT 'engine' || user_id % 40 AS engine, CASE event_type WHEN 'error' THEN 'blocked' WHEN 'signup' THEN 'failed' ELSE 'ok' END AS outcome, event_type, ts, event_id FROM events),
w AS (SELECT *, sum((outcome = 'ok')::INT) OVER (PARTITION BY engine ORDER BY ts, outcome, event_id) AS run FROM e), f AS (SELECT engine, run, count(*) FILTER (outcome <> 'ok') AS fails FROM w GROUP BY engine, run)
SELECT engine, count(*) FILTER (outcome = 'ok') AS queries, sum(CASE WHEN outcome = 'ok' THEN event_id ELSE 0 END)::BIGINT AS results, count(*) FILTER (outcome = 'blocked') AS blocked,
  (SELECT fails FROM f WHERE f.engine = e.engine ORDER BY run DESC LIMIT 1) AS failures, (SELECT max(fails) >= 4 FROM f WHERE f.engine = e.engine) AS disabled,
  max(ts) FILTER (outcome = 'blocked') + to_seconds(900 * least(4, count(*) FILTER (outcome = 'blocked'))) AS cooldown_until, arg_max(event_type, (ts, outcome, event_id)) FILTER (outcome <> 'ok') AS last_error FROM e GROUP BY engine
""")
def engine_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.engine_health(_serp_events(spark, sf_dir)).select("engine", "queries", "results", "blocked", "failures", "disabled", F.col("cooldown_until").cast("timestamp_ntz").alias("cooldown_until"), "last_error")


@query("""
WITH l AS (SELECT user_id, max(ts) AS ts FROM events WHERE user_id IS NOT NULL GROUP BY user_id) SELECT user_id, ts FROM l WHERE ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 72 HOUR
""")
def ttl_cache_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest entry of each key, if it is not older than 72 hours."""
    cache = table(spark, sf_dir, "events").where("user_id is not null").select("user_id", "ts", "event_id")
    return merges.fresh_entries(merges.latest(cache, ["user_id"], "ts"), F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"), 72, "ts").select("user_id", "ts")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return incremental.windowed_counts(df).withColumns({"start": F.col("start").cast("timestamp_ntz"), "total": F.round("total", 4)})


@query("SELECT DISTINCT 'u' || user_id AS domain, 1 AS hits FROM events WHERE user_id IS NOT NULL")
def stream_candidate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of one batch, merged into a candidate table."""
    at = f"{shared_dir(spark)}/stream"
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").where("user_id is not null").select(F.concat(F.lit("u"), "user_id").alias("domain"))
    q = incremental.stream_candidates(rows, f"{at}/table", f"{at}/log")
    q.awaitTermination()
    return incremental.newest_version(spark, f"{at}/table", q.lastProgress["batchId"] if q.lastProgress else 0)


# --- whole plan -----------------------------------------------------------------------------------------------------


def _site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    p = table(spark, sf_dir, "pages").select(host(u).alias("site"), "page_id", "url", "html")
    first = p.groupBy(F.col("site").alias("s")).agg(F.min("page_id").alias("first"))
    p = p.join(first, F.col("site") == F.col("s"))
    return p.select("site", F.col("page_id").cast("int").alias("page_ord"), F.when(F.col("page_id") == F.col("first"), "home").otherwise(urls.classify_url(u)["kind"]).alias("kind"), "url", F.col("url").alias("final_url"), F.lit(200).alias("status"), F.lit(None).cast("string").alias("error"), "html")


@query()
def process_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages to scored leads."""
    done = pipeline.process_sites(_site_pages(spark, sf_dir), F.lit(AS_OF).cast("date"))
    return done.agencies.select("domain", "name", "language", "alive", "score", "status", "tier", "reject_reason", "pages_crawled")

