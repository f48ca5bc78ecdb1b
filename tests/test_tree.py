"""The document tree and the mentions of people, on literal pages and texts."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions import mentions as M
from millrace.operators import contacts, dom, funnels, html, people
from millrace.plans import tree_queries
from millrace.plans.queries import SQL


def parsed(spark, *markup):
    rows = spark.createDataFrame([(i, f"s{i}", 1, "home", "u", m) for i, m in enumerate(markup)], "page_id long, site string, page_ord int, kind string, url string, html string")
    return html.parsed_pages(rows).select("page_id", "site", "page_ord", "kind", "url", *(F.col(f"parsed.{c}").alias(c) for c in html.COLUMNS))


def test_intervals(spark):
    page = parsed(spark, "<html><body><ul><li>a<li>b<p>c<p>d</ul><div id=x class='y z'>e<br>f<img alt='An image'></div><p>g</body></html>", "", None, "no tags at all").cache()
    nodes = dom.dom_nodes(page).where("page_id = 0").orderBy("pre").collect()
    assert [(n.tag, n.parent_tag, n.depth) for n in nodes] == [("html", None, 0), ("body", "html", 1), ("ul", "body", 2), ("li", "ul", 3), ("li", "ul", 3), ("p", "li", 4), ("p", "li", 4), ("div", "body", 2), ("br", "div", 3), ("img", "div", 3), ("p", "body", 2)]
    assert all(n.pre <= n.last and (n.parent == -1 or nodes[n.parent].pre < n.pre <= n.last <= nodes[n.parent].last) for n in nodes)
    assert (nodes[7].cls, nodes[9].value, nodes[4].last) == ("y z x", "An image", 6)
    texts = page.where("page_id = 0").select(F.transform("nodes", lambda n: dom.node_text(n)).alias("t")).first().t
    assert texts[2] == "a\nb\nc\nd" and texts[4] == "b\nc\nd" and texts[7] == "e\nf" and texts[9] == ""
    assert dom.dom_nodes(page).where("page_id <> 0").count() == 0 and page.where("page_id = 3").first().flow == "no tags at all"


def test_blocks_are_limited_and_cited(spark):
    many = "<div class=review>This is a review that has enough words.<cite>Ann Baker</cite></div>" * 130
    page = parsed(spark, many, "<figure>" + "x" * 2501 + "</figure>", "<p class=quote>Twenty-five letters of text here<p><b>Bo Cole</b>")
    got = dom.client_blocks(page).groupBy("site").agg(F.count("*").alias("n"), F.max("cite").alias("cite")).collect()
    assert {(r.site, r.n, r.cite) for r in got} == {("s0", 120, "Ann Baker"), ("s2", 1, "")}


def test_context_climbs_to_the_text_that_tells(spark):
    page = parsed(spark, "<div>" + "far away words " * 9 + "<ul><li><a href='https://linkedin.com/in/x'>in</a></li></ul></div>", "<body><div><p><b><i><a href='https://linkedin.com/in/y'>in</a></i></b></p></div><p>" + "out of reach " * 9)
    got = {r.site: r.context for r in dom.link_contexts(page, people.PROFILE).collect()}
    assert got["s0"].startswith("far away words") and got["s1"] == "in"


@pytest.mark.parametrize(("text", "found"), [
    ("Ann Baker, founder of Acme Labs.", [("Ann Baker", "founder of Acme Labs", "Acme Labs")]), ("Founder & CEO: Bo Cole", [("Bo Cole", "Founder & CEO", "")]), ("It was started by Cara Dune Lee in May", [("Cara Dune Lee", None, "")]),
    ("Hello, I'm Dan Eve and I built it", [("Dan Eve", None, "")]), ("Hello, I'm Dan Eve. We built it", []), ("I'm Dan Eve, the owner", [("Dan Eve", "owner", "")]), ("Joe Roe is our managing director", [("Joe Roe", "managing director", "")]),
    ("Joe Roe\nfounder", []), ("we met the founder in Paris, Texas", []), ("Meet Joe Roe - CEO", [("Joe Roe", "CEO", "")]), ("", []), ("Été Ça, founder", [("Été Ça", "founder", "")]),
])
def test_founder_mentions(text, found):
    assert [(m.name, m.title, m.org) for m in M.founder_mentions(text)] == found


def test_names_in_lines_and_headings():
    assert M.attributed_names("They are great.\n- Dana Whitfield\nreally", "") == ["Dana Whitfield"] and M.attributed_names("a\nDana Whitfield, a coach of note\nb", "") == ["Dana Whitfield"]
    assert M.attributed_names("a\nDana Whitfield, ok\nb", "") == [] and M.attributed_names("", "Bo Cole | Coach") == ["Bo Cole"]
    assert M.heading_name("How we helped Jane Doe win") == "Jane Doe" and M.heading_name("Meet: Jo") == "Jo" and M.heading_name("We are here") is None
    assert M.result_name("Jane Doe: 40 new leads") == "Jane Doe" and M.result_name("Jane Doe: at home") is None
    assert [m.name for m in M.team_mentions("Bo Cole, our strategist. my name is Ann. Cara Dune, friend")] == ["Bo Cole", "Ann"]


def test_links_meet_clients_by_parts_of_names(spark):
    clients = spark.createDataFrame([("s", n.lower(), n) for n in ("Dana Whitfield", "Bob Lim", "Jonathan Archer", "Nova Institute", "Maximilian Longfellow")], "site string, key string, name string")
    links = spark.createDataFrame([("s", 1, i, f"https://{d}/?q=1", d, None, a) for i, (d, a) in enumerate((("other.com", "Nova Institute"), ("the-dana-whitfield-site.com", ""), ("boblim.org", ""), ("archer-jon.net", ""), ("longfellow.com", ""), ("s", "Bob Lim")))], "site string, page_ord int, link_ord int, url string, domain string, network string, anchor string")
    got = {r.key: r.website for r in people.client_links(clients, links).collect()}
    assert got == {"nova institute": "https://other.com/", "dana whitfield": "https://the-dana-whitfield-site.com/", "bob lim": "https://boblim.org/", "jonathan archer": "https://archer-jon.net/"}
    plan = people.client_links(clients, links)._jdf.queryExecution().optimizedPlan().toString()
    assert "part" in plan.split("Join Inner")[1].split("\n")[0]


def test_article_keeps_references_without_a_semicolon(spark, tmp_path):
    rows = [(1, "https://x", "<article><h1>a &amp; b&amp c &lt</h1><p>&lt;d&gt; &#x27;e&#x27; &quot f</p></article>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = tree_queries.page_articles(spark, str(tmp_path)).first().article
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == con.execute(SQL["page_articles"]).fetchone()[1] == "a & b&amp c &lt <d> 'e' &quot f"


def test_founder_behind_a_long_text(spark):
    long = "a word and one more of it " * 3000
    page = parsed(spark, f"<p>{long}</p><p>Founded by Devon Evans. We like it here.</p><p>It is a place to be, and so on and on and on for a while. <a href='https://linkedin.com/in/devonevans'>in</a></p>")
    got = people.founders(page, contacts.page_links(page)).first()
    assert (got.name, got.linkedin, got.confidence) == ("Devon Evans", "https://linkedin.com/in/devonevans", 0.9)


def test_pages_are_parsed_in_pieces_of_bounded_size():
    sizes = [10, 600_000, 600_000, 3_000_000, 0, 5]
    pages = pd.Series(["x" * n for n in sizes[:-1]] + [None])
    pieces = list(html._parse_batches(iter([pages, pages.iloc[:0]])))
    assert [len(p) for p in pieces] == [2, 1, 3, 0] and [len(t) for p in pieces for t in p["text"]] == [10, 600_000, 600_000, 3_000_000, 0, 0]


def test_steps_behind_long_and_malformed_beginnings(spark):
    late = "<p>Register now</p><p>Last chance</p><p>Book a call</p><p>Submit your application</p><textarea>"
    page = parsed(spark, "<p>" + "a word and one more of it " * 3000 + "</p>" + late, "<![foo bar]>" + late, "<p>a<![ b</p>" + late, f"<input placeholder='{'x' * 300} email'>", "")
    got = {r.site: r.steps for r in page.select("site", funnels.funnel_steps(F.lit(""), F.col("text"), F.col("fields")).alias("steps")).collect()}
    shown = ["application form", "calendar booking (sales call)", "webinar / training registration", "deadline / countdown"]
    assert got == {"s0": shown, "s1": shown, "s2": shown, "s3": ["opt-in form (email)"], "s4": []}


def test_every_client_of_a_site_is_listed(spark):
    last = lambda i: "".join(chr(97 + i // k % 26) for k in (676, 26, 1))
    name = lambda i: f"Dana W{last(i)}ez"
    told = "".join(f"<p>We helped our client {name(i)}, a business coach, to book many more calls than in the year before.</p>" for i in range(1000))
    many = "<p>We helped our clients Ann Abel, Bea Bold, Cid Cole, Dan Dune and Eve Eck, a business coach each, to book calls.</p>"
    quoted = "".join(f"<blockquote>They doubled the sales of my course.<br>— {name(i)}, Business Coach</blockquote>" for i in range(130))
    signed = "<blockquote>They doubled our sales." + "".join(f"<br>— {name(i)}, Business Coach" for i in range(6)) + "</blockquote>"
    page = parsed(spark, told, many, quoted, signed)
    found = people.site_clients(page, contacts.page_links(page), page.select("site", F.lit("Some Firm").alias("name")))
    got = {}
    for r in found.collect():
        got.setdefault(r.site, set()).add(r.name)
    assert got["s0"] == {name(i) for i in range(1000)} and got["s1"] == {"Ann Abel", "Bea Bold", "Cid Cole", "Dan Dune", "Eve Eck"}
    assert got["s2"] == {name(i) for i in range(130)} and got["s3"] == {name(i) for i in range(6)}
