"""The document tree of parsed pages: elements as rows of intervals, and what is found by ancestors, descendants, classes and spans of text.

An element holds those whose ``pre`` lies behind its own and up to its ``last``, and its text is one span of the page's ``flow``. So ancestor and descendant tests are
comparisons within the page's array of elements; only the elements that a test selects become rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import fixed
from millrace.functions.text import any_of, clean_ws

#: Blocks of a page that are looked at, length of a block, images of a wall, length of a description, and the context of a link.
BLOCKS, BLOCK_CHARS, WALL_IMAGES, ALT_CHARS, LEVELS, LEAST_CONTEXT = 120, (25, 2500), (2, 40), (3, 40), 4, 60
WITHOUT_SECTIONS = rf"(?i){any_of(fixed.PRESS_WORDS)}"


def node_text(node: Column, flow: str = "flow") -> Column:
    """An element's text, one line for each text node."""
    return F.trim(F.regexp_replace(clean_ws(F.substring(F.col(flow), node["start"] + 1, node["end"] - node["start"])), r"\s*\n\s*", "\n"))


def inside(node: Column, where: Callable[[Column], Column]) -> Column:
    """The elements within an element, in document order."""
    return F.filter("nodes", lambda x: (x["pre"] > node["pre"]) & (x["pre"] <= node["last"]) & where(x))


def around(node: Column) -> Column:
    """The elements around an element, the nearest first."""
    return F.reverse(F.filter("nodes", lambda x: (x["pre"] < node["pre"]) & (x["last"] >= node["pre"])))


def in_class(node: Column, words: tuple[str, ...]) -> Column:
    return node["cls"].rlike(f"(?i){any_of(words)}")


def dom_nodes(pages: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Every element of the pages as a row: (``keep``, pre, last, parent, parent_tag, depth, tag, cls, value, start, end). ``depth`` counts the elements around it.

    A page without elements has no row. ``pages`` has ``nodes``, as parsed."""
    up = lambda n: F.size(F.filter("nodes", lambda x: (x["pre"] < n["pre"]) & (x["last"] >= n["pre"])))
    parent = lambda n: F.when(n["parent"] >= 0, F.get("nodes", n["parent"])["tag"])
    rows = pages.select(*keep, F.explode(F.transform("nodes", lambda n: F.struct(n["pre"].alias("pre"), n["last"].alias("last"), n["parent"].alias("parent"), parent(n).alias("parent_tag"), up(n).alias("depth"), n["tag"].alias("tag"), n["cls"].alias("cls"), n["value"].alias("value"), n["start"].alias("start"), n["end"].alias("end")))).alias("n"))
    return rows.select(*keep, "n.*")


def client_blocks(pages: DataFrame, most: int | None = BLOCKS) -> DataFrame:
    """(site, page_ord, page_kind, url, pre, text, cite) of the blocks that quote or tell of clients: quotations, figures, and elements of a telling class, the first ``most`` of a page, or all; ``cite`` is the text of the first element inside that names a speaker."""
    telling = lambda n: n["tag"].isin("blockquote", "figure") | in_class(n, fixed.BLOCK_CLASSES)
    names = lambda x: x["tag"].isin(*fixed.CITE_TAGS) | in_class(x, fixed.CITE_CLASSES)
    told = F.transform(F.filter("nodes", telling), lambda n: F.struct(n.alias("node"), node_text(n).alias("text")))
    fitting = F.filter(told, lambda b: F.length(b["text"]).between(*BLOCK_CHARS))
    fitting = fitting if most is None else F.slice(fitting, 1, most)
    speaker = lambda n: F.get(inside(n, names), F.lit(0))
    cited = F.transform(fitting, lambda b: F.struct(b["node"]["pre"].alias("pre"), b["text"].alias("text"), F.coalesce(node_text(speaker(b["node"])), F.lit("")).alias("cite")))
    return pages.select("site", "page_ord", F.col("kind").alias("page_kind"), "url", F.explode(cited).alias("b")).select("site", "page_ord", "page_kind", "url", "b.*")


def logo_walls(pages: DataFrame) -> DataFrame:
    """(site, page_ord, page_kind, url, pre, alt) of the images in sections that show clients' logos: a telling class, 2 to 40 described images, and a heading or class that speaks of clients and not of the press."""
    front = lambda n: F.substring(F.translate(node_text(n), "\n", " "), 1, 200)
    wall = lambda n: (
        n["tag"].isin("section", "div", "ul") & in_class(n, fixed.LOGO_CLASSES) & ~n["cls"].rlike(WITHOUT_SECTIONS) & ~front(n).rlike(WITHOUT_SECTIONS)
        & (front(n).rlike(f"(?i){any_of(fixed.LOGO_HEADINGS)}") | F.contains(F.lower(n["cls"]), F.lit("client")))
        & F.size(inside(n, lambda x: x["tag"] == "img")).between(*WALL_IMAGES)
    )
    images = F.flatten(F.transform(F.filter("nodes", wall), lambda n: inside(n, lambda x: (x["tag"] == "img") & (x["value"] != ""))))
    rows = pages.select("site", "page_ord", F.col("kind").alias("page_kind"), "url", F.explode(F.array_distinct(images)).alias("i"))
    alt = F.trim(F.regexp_replace(F.regexp_replace("i.value", rf"(?i)\b{any_of(fixed.LOGO_NOISE)}\b", ""), r"^[ _|-]+|[ _|-]+$", ""))
    out = rows.select("site", "page_ord", "page_kind", "url", "i.pre", F.when(alt == F.lower(alt), F.initcap(alt)).otherwise(alt).alias("alt"))
    return out.where(F.length("alt").between(*ALT_CHARS) & ~F.col("alt").rlike(r"\d{3}"))


def link_contexts(pages: DataFrame, pattern: str) -> DataFrame:
    """(site, page_ord, page_kind, pre, href, context) of the links whose target matches: the text of the nearest element around, of four at most, that has more than 60 characters, or else of the furthest of them."""
    texts = lambda n: F.transform(F.slice(around(n), 1, LEVELS), lambda x: F.translate(node_text(x), "\n", " "))
    context = lambda n: F.coalesce(F.get(F.filter(texts(n), lambda t: F.length(t) > LEAST_CONTEXT), F.lit(0)), F.try_element_at(texts(n), F.lit(-1)), F.lit(""))
    found = F.transform(F.filter("nodes", lambda n: (n["tag"] == "a") & n["value"].rlike(pattern)), lambda n: F.struct(n["pre"].alias("pre"), n["value"].alias("href"), F.substring(context(n), 1, 400).alias("context")))
    return pages.select("site", "page_ord", F.col("kind").alias("page_kind"), F.explode(found).alias("l")).select("site", "page_ord", "page_kind", "l.*")
