"""Which pages of a site count: links, kinds, budgets, sitemaps, dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import fixed
from millrace.functions.urls import absolutize, canonicalize, classify_url, looks_like_asset, registrable_domain, same_site
from millrace.operators.picks import content_dedup, first_by, ranked
from millrace.sources.shared import stored


def page_ok(status: Column, error: Column, html: Column) -> Column:
    """A page was fetched: no error, a 2xx status, and a body."""
    return error.isNull() & status.between(200, 299) & (F.length(F.coalesce(html, F.lit(""))) > 0)


def admitted_pages(pages: DataFrame, text: Column) -> DataFrame:
    """Fetched pages (``site, page_ord, status, error, html``) with more than 80 characters of text, each beginning of a text once for a site."""
    return content_dedup(pages.where(page_ok(F.col("status"), F.col("error"), F.col("html")) & (F.length(text) > 80)), ["site"], text, [F.col("page_ord")])


def ranked_links(links: DataFrame, site_key=registrable_domain) -> DataFrame:
    """Links (``site, home_url, link_ord, href, anchor``) to other pages of the site: (site, url, kind, priority), each url once, by its lowest priority, then the first."""
    url = absolutize(F.col("home_url"), F.col("href"))
    df = links.withColumn("raw_", url).where(F.col("raw_").isNotNull() & ~looks_like_asset(F.col("raw_")) & ~F.col("raw_").rlike(fixed.SKIPPED_PATH) & (site_key(F.col("raw_")) == site_key(F.col("home_url"))))
    df = df.withColumn("url", canonicalize(F.col("raw_"))).where(F.col("url") != canonicalize(F.col("home_url")))
    df = df.withColumn("k_", classify_url(F.col("url"), F.col("anchor"))).select("site", "url", F.col("k_.kind").alias("kind"), F.col("k_.priority").alias("priority"), "link_ord")
    return first_by(df, ["site", "url"], [F.col("priority"), F.col("link_ord")])


def page_budget(links: DataFrame, max_pages: int = 14, caps: dict[str, int] = fixed.KIND_CAPS) -> DataFrame:
    """Of ``ranked_links``, those a crawl takes: by priority and length of the url, so many of each kind, ``max_pages - 1`` of a site."""
    order = [F.col("priority"), F.length("url"), F.col("url")]
    cap = F.coalesce(*(F.when(F.col("kind") == k, n) for k, n in caps.items()), F.lit(2))
    kept = ranked(links, ["site", "kind"], order, "in_kind", most=max([2, *caps.values()])).where(F.col("in_kind") < cap)
    return ranked(kept, ["site"], order, "pick", most=max_pages - 1).drop("in_kind")


def _numbered_entries(docs: DataFrame) -> DataFrame:
    """(site, doc_url, is_index, pos, url, lastmod) of the stored maps' entries, in the order of the document, those without a place left out."""
    xml = docs.where(F.col("xml").rlike("(?i)<(urlset|sitemapindex)"))
    entries = F.regexp_extract_all("xml", F.lit(r"(?is)<(?:url|sitemap)>(.*?)</(?:url|sitemap)>"), F.lit(1))
    out = xml.select("site", "doc_url", F.col("xml").rlike("(?i)<sitemapindex").alias("is_index"), F.posexplode(entries).alias("pos", "entry_"))
    lastmod = F.substring(F.regexp_extract("entry_", r"(?i)<lastmod>\s*([^<\s]+)\s*</lastmod>", 1), 1, 10)
    return out.select("site", "doc_url", "is_index", "pos", F.regexp_extract("entry_", r"(?i)<loc>\s*([^<\s]+)\s*</loc>", 1).alias("url"), lastmod.alias("lastmod")).where("url <> ''")


def sitemap_walk(docs: DataFrame, roots: DataFrame, fan_out: int = 15, most_docs: int = 12, most_urls: int = 3000) -> DataFrame:
    """(site, url, newest): page urls reached from the root documents (``site, doc_url``) through indexes, and the newest day of the maps read.

    A site's documents are visited breadth first, in the order of the documents that name them, each once, ``most_docs`` in all; of an index the first ``fan_out`` entries count. Each level of the frontier is one join, and the walk ends where a level is empty. A map is read while no more than
    ``most_urls`` urls came before it; urls of other sites and assets are left out. A document that isn't stored uses up its visit."""
    entries = stored(_numbered_entries(docs), "sitemap-entries")
    frontier = roots.select("site", "doc_url", F.struct(F.lit(0).alias("by"), F.lit(0).alias("pos")).alias("at"))
    visited = roots.select("site", "doc_url", F.lit(0).alias("number")).limit(0)
    for _ in range(most_docs):
        new = first_by(frontier, ["site", "doc_url"], [F.col("at.by"), F.col("at.pos")]).join(visited.select("site", "doc_url"), ["site", "doc_url"], "left_anti")
        so_far = visited.groupBy(F.col("site").alias("vs")).agg(F.count("*").alias("n"))
        level = ranked(new, ["site"], [F.col("at.by"), F.col("at.pos"), F.col("doc_url")], "place", start=1, most=most_docs).join(so_far, F.col("site") == F.col("vs"), "left")
        level = stored(level.select("site", "doc_url", (F.coalesce("n", F.lit(0)) + F.col("place")).cast("int").alias("number")).where(F.col("number") <= most_docs), "sitemap-level")
        if level.isEmpty():
            break
        visited = visited.unionByName(level)
        named = entries.where("is_index").join(level, ["site", "doc_url"])
        first = ranked(named, ["site", "number"], [F.col("pos")], "place", start=1, most=fan_out)
        frontier = first.where(~F.col("url").rlike("(?i)(image|video|tag|category|author|attachment)")).select("site", F.col("url").alias("doc_url"), F.struct(F.col("number").alias("by"), "pos").alias("at"))
    pages = entries.where("not is_index").join(visited, ["site", "doc_url"]).withColumn("own", same_site(F.col("url"), F.col("site")) & ~looks_like_asset(F.col("url")))
    sizes = pages.groupBy("site", "number").agg(F.count_if("own").alias("n"))
    before = F.sum("n").over(Window.partitionBy("site").orderBy("number").rowsBetween(Window.unboundedPreceding, -1))  # a dozen rows a site at most
    read = pages.join(sizes.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") <= most_urls).select("site", "number"), ["site", "number"])
    newest = read.groupBy("site").agg(F.max(F.when(F.col("lastmod") != "", F.col("lastmod"))).alias("newest"))
    return read.where("own").select("site", "url").distinct().join(newest, "site")


def newest_date(dates: Column, as_of: Column) -> Column:
    """The greatest ISO day of an array of dates, from 2000 to next year."""
    days = F.filter(F.transform(dates, lambda d: F.regexp_extract(d, r"^(\d{4}-\d{2}-\d{2})", 1)), lambda d: (d >= "2000") & (d < (F.year(as_of) + 2).cast("string")))
    return F.array_max(days)


def site_texts(pages: DataFrame, kinds: list[str] | None = None, chars: int | None = None, name: str = "text") -> DataFrame:
    """(site, text) with the texts of its pages of some kinds, in page order, ``chars`` characters at most.

    Pages beyond that length are left out, and the last one cut, before a site's texts come together."""
    own = (pages.where(F.col("kind").isin(*kinds)) if kinds else pages).select("site", "page_ord", "text")
    if chars:
        # A line break stands between two texts, so a page begins after the lengths before it and one for each.
        before = F.sum(F.length(F.coalesce("text", F.lit(""))) + 1).over(Window.partitionBy("site").orderBy("page_ord").rowsBetween(Window.unboundedPreceding, -1))
        own = own.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < chars).withColumn("text", F.substring("text", F.lit(1), (chars - F.col("before")).cast("int")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_ord", "text"))), lambda x: x["text"]), "\n")
    return own.groupBy("site").agg(joined.alias(name))
