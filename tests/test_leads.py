"""The lead engine: registered queries against DuckDB, functions on literal rows, merges, and a small site from pages to a tier."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.functions import contacts as fc
from millrace.functions import text, urls
from millrace.operators import crawl, discovery, funnels, html, merges, people, picks, scoring
from millrace.plans import model_queries, pipeline, queries, run_queries, site_queries, tree_queries  # noqa: F401

ROOT = Path(__file__).resolve().parents[1]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_sql(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    r = duck.execute(queries.SQL[name])
    columns = [d[0] for d in r.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(repr([plain(x) for x in row]) for row in r.fetchall())
    assert sorted(repr([plain(row[c]) for c in columns]) for row in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL) - {"process_sites"}))
def test_query_without_sql_runs(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_rest_works_without_the_optional_part():
    code = "import sys; sys.modules['millrace.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'lead_search' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


# --- functions ------------------------------------------------------------------------------------------------------


def test_a_funnel_type_reads_its_texts_once(spark):
    t = spark.createDataFrame([("A quiz, an assessment, a scorecard.",), (None,)], "t string").select(F.reverse(F.reverse("t")).alias("t"))
    typed = t.select(funnels.funnel_type(F.lit("https://a.test/x"), F.lit(""), F.lit(""), F.lit(""), F.col("t")).alias("v"))
    assert typed._jdf.queryExecution().optimizedPlan().toString().count("reverse(") == 2 and [r.v for r in typed.collect()] == ["quiz", "landing_page"]


def test_a_protected_code_is_worked_out_once(spark):
    # The code as an expression: were it in the lambda of the decoded letters, it would be made again for each of them.
    coded = spark.createDataFrame([("0b6e6d2a684b67646a62742564796c",), ("zz",), (None,), ("",)], "x string").select(F.reverse(F.reverse(F.concat("x", F.lit("")))).alias("c"))
    plan = coded.select(fc.decode_protected_email(F.col("c")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("reverse(") == 2


@pytest.mark.parametrize(("url", "domain"), [("https://www.shop.co.uk/x?y=1", "shop.co.uk"), ("http://news.acme.org", "acme.org"), ("https://ann.mykajabi.com/p", "ann.mykajabi.com"), ("https://www.acme.org", "acme.org")])
def test_registrable_domain(spark, url, domain):
    assert value(spark, urls.registrable_domain(F.lit(url))) == domain


def test_urls(spark):
    assert value(spark, urls.canonicalize(F.lit("HTTPS://Acme.org/a/?utm_source=x&b=2#part"))) == "https://acme.org/a?b=2"
    assert value(spark, urls.social_network(F.lit("https://www.instagram.com/acme"))) == "instagram"
    assert value(spark, urls.social_network(F.lit("https://acme.org"))) is None
    assert value(spark, urls.absolutize(F.lit("https://acme.org/a/b"), F.lit("../c"))) == "https://acme.org/c"
    assert value(spark, urls.absolutize(F.lit("https://acme.org/a"), F.lit("mailto:x@acme.org"))) is None
    for url, kind in (("https://a.org/case-studies/x", "case_studies"), ("https://a.org/about-us", "about"), ("https://a.org/contact", "contact"), ("https://a.org/blog/p", "blog")):
        assert value(spark, urls.classify_url(F.lit(url))["kind"]) == kind


def test_protected_addresses(spark):
    for key in (0, 0x5A, 255):
        code = bytes([key, *(b ^ key for b in b"ann@acme.org")]).hex()
        assert value(spark, fc.decode_protected_email(F.lit(code))) == "ann@acme.org"
    assert value(spark, fc.decode_protected_email(F.lit("zz"))) is None


def test_null_inputs(spark):
    null = F.lit(None).cast("string")
    for c in (urls.canonicalize(null), urls.registrable_domain(null), urls.host_of(null), text.clean_ws(null), fc.decode_protected_email(null)):
        assert value(spark, c) in (None, "")


def test_listicle(spark):
    none = F.lit("")
    assert value(spark, text.is_listicle(F.lit("Top 12 Facebook Ads Agencies for Coaches in 2025"), none, none))
    assert not value(spark, text.is_listicle(F.lit("Acme Growth - a Meta Ads Agency"), none, none))


def test_language(spark):
    rows = spark.createDataFrame([("en", "We help coaches and course creators to grow their business with ads and funnels. Book a call with us today. " * 3), ("fr", "Nous aidons les coachs et les formateurs à développer leur activité grâce à la publicité et aux tunnels de vente. " * 3)], "want string, t string")
    assert all(r["want"] == r["l"]["code"] for r in text.with_language(rows, F.col("t"), F.lit(""), "l").collect())


def test_parse_html(spark):
    page = '<html lang="en"><head><title>Acme | Ads</title><meta name="description" content="We grow shops"></head><body><h1>We help <b>shops</b> grow</h1><p>One.</p><script>var x=1</script><a href="/about">About us</a>'
    p = html.parsed_pages(spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")).orderBy("page_id").collect()
    one = p[0]["parsed"]
    assert one["title"].startswith("Acme") and one["meta_description"] == "We grow shops" and "We help shops grow" in one["text"] and "var x" not in one["text"]
    assert [(x["href"], x["anchor"]) for x in one["links"]] == [("/about", "About us")] and list(one["headings"]) == ["We help shops grow"]
    assert len(p) == 3 and not p[1]["parsed"]["text"] and not p[2]["parsed"]["links"]


def test_funnel_type_default(spark):
    none = F.lit("")
    assert value(spark, funnels.funnel_type(F.lit("https://a.org/x"), none, none, none, none)) == "landing_page"
    assert "webinar" in value(spark, funnels.funnel_type(F.lit("https://a.org/free-webinar"), F.lit("webinar"), none, none, none))


def test_newest_date(spark):
    dates = F.array(F.lit("2023-05-01"), F.lit("2024-02-03"), F.lit("2099-01-01"), F.lit("1990-01-01"))
    assert value(spark, crawl.newest_date(dates, F.lit("2024-06-30").cast("date"))) == "2024-02-03"


# --- merges and verdicts --------------------------------------------------------------------------------------------


def test_candidates_count_hits(spark):
    none = spark.createDataFrame([], "domain string, hits int")
    a = spark.createDataFrame([("x.org",), ("x.org",), ("y.org",)], "domain string")
    once = merges.merge_candidates(none, a)
    twice = {r["domain"]: r["hits"] for r in merges.merge_candidates(once, a.where("domain = 'x.org'")).collect()}
    assert set(twice) == {"x.org", "y.org"} and twice["x.org"] > twice["y.org"]
    assert merges.new_domains(once, a).count() == 0 and merges.merge_candidates(none, a.limit(0)).count() == 0


def test_verdict_grid(spark):
    def of(score, why, mail, coach):
        v = value(spark, scoring.verdict(F.lit(score), F.lit(why).cast("string"), F.lit(mail), F.lit(coach)))
        return v["status"], v["tier"]

    assert of(80, None, True, True) == ("qualified", "A") and of(80, None, True, False) == ("qualified", "B") and of(80, None, False, True) == ("qualified", "C")
    assert of(80, None, False, False)[0] == "review" and of(45, None, True, True)[0] == "review" and of(10, None, True, True)[0] == "rejected" and of(10, "weak_icp", True, True)[0] == "rejected"


def test_relevance(spark):
    rows = spark.createDataFrame([(1, "ads agency coaches", "Ads agency", "for coaches", ""), (1, "ads agency coaches", "Cooking", "at home", ""), (2, "", "x", "y", "")], "k int, query string, title string, snippet string, url string")
    got = {r["k"]: r["relevance"] for r in discovery.relevance(rows, ["k"]).collect()}
    assert got == {1: 0.5, 2: 1.0}


# --- a site ---------------------------------------------------------------------------------------------------------

CODE = bytes([0x2D, *(b ^ 0x2D for b in b"desk@harborlane.example")]).hex()
SITE = {
    "home": ("/", f"""<html lang="en"><head><title>Harbor Lane | Facebook Ads for Coaches</title><meta name="description" content="Facebook ads and funnels for coaches and course creators">
<meta property="og:site_name" content="Harbor Lane"><script type="application/ld+json">{{"@type": "Organization", "name": "Harbor Lane", "foundingDate": "2017-03-01"}}</script>
<script src="https://connect.facebook.net/en_US/fbevents.js"></script></head><body><nav><a href="/about">About</a><a href="/contact">Contact</a></nav><h1>We run Facebook ads for coaches and course creators</h1>
<p>Our team is a marketing agency. We help coaches, consultants and course creators to book calls with clients through Meta ads, YouTube ads, webinar funnels and landing pages for online programs.</p>
<p>Our clients sell high ticket coaching programs, and our agency does media buying, lead generation and sales funnels for them. {"We are a team of specialists who care about results and honest reporting. " * 4}</p>
<footer><a href="mailto:hello@harborlane.example">Mail</a> <a href="https://calendly.com/harborlane/call">Book a call</a> <a href="https://www.instagram.com/harborlane">Instagram</a> © 2024</footer></body></html>"""),
    "contact": ("/contact", f"""<html lang="en"><head><title>Contact</title></head><body><h1>Contact Harbor Lane</h1><p>Write to us at any time, we answer every message within a day and are glad to hear about your coaching business and its goals.</p>
<a class="__cf_email__" data-cfemail="{CODE}">[email protected]</a></body></html>"""),
}


def pages_of(spark):
    rows = [("harborlane.example", i, kind, f"https://harborlane.example{path}", 200, None, markup) for i, (kind, (path, markup)) in enumerate(SITE.items())]
    rows += [("thin.example", 0, "home", "https://thin.example/", 200, None, "<html><body><p>Nothing here yet, but this page has a little more text than eighty characters, if only just.</p></body></html>")]
    df = spark.createDataFrame(rows, "site string, page_ord int, kind string, url string, status int, error string, html string")
    return df.withColumn("final_url", F.col("url"))


def test_site_to_lead(spark):
    done = pipeline.process_sites(pages_of(spark), F.lit("2024-06-30").cast("date"))
    a = {r["domain"]: r for r in done.agencies.collect()}
    one, thin = a["harborlane.example"], a["thin.example"]
    assert one["name"] == "Harbor Lane" and one["alive"] and one["language"] == "en" and one["score"] > (thin["score"] or 0) and thin["status"] == "rejected"
    mails = {r["email"] for r in done.emails.where("domain = 'harborlane.example'").collect()}
    assert {"hello@harborlane.example", "desk@harborlane.example"} <= mails


def test_registered_names_have_columns(spark, sf):
    assert queries.site_scorecard(spark, sf).columns[0] == "site" and len(queries.QUERIES) >= 50


def test_pages_are_parsed_once(spark):
    plan = pipeline.flat_pages(pages_of(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython") == 1


def test_top_rows_are_limited_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 as k", "id as v")
    top = picks.top_by(df, ["k"], [F.col("v")], 2)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString() and sorted(map(tuple, top.collect())) == [(0, 0), (0, 3), (1, 1), (1, 4), (2, 2), (2, 5)]


def test_clients_are_no_team(spark):
    rows = spark.createDataFrame([("s", "about", "Talk to Erin Novak, media buyer." + " ." * 60 + " Our client Dana Whitfield, owner of a studio, wrote a review.")], "site string, kind string, text string")
    assert [r["member"] for r in people.team_names(rows).collect()] == ["erin novak"]


def test_site_texts_are_cut_before_they_are_joined(spark):
    rows = spark.createDataFrame([("s", 2, "bbbb"), ("s", 1, "aaaa"), ("s", 3, "cccc"), ("t", 1, None)], "site string, page_ord int, text string")
    for n in (3, 7, 100):
        assert {r["site"]: r["text"] for r in crawl.site_texts(rows, None, n).collect()}["s"] == "aaaa\nbbbb\ncccc"[:n]
