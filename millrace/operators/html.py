"""Html pages to columns: one pass of the standard parser for structure, or built-in expressions for a few facts."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import fixed

NODES = "array<struct<pre: int, last: int, parent: int, tag: string, cls: string, value: string, start: int, end: int>>"
PARSED = (
    "struct<title: string, meta_description: string, og_site_name: string, og_title: string, lang_attr: string, canonical: string, text: string, headings: array<string>, "
    "links: array<struct<href: string, anchor: string>>, jsonld: array<string>, dates: array<string>, blocks: array<string>, fields: array<string>, flow: string, "
    f"nodes: {NODES}>"
)
COLUMNS = ("title", "meta_description", "og_site_name", "og_title", "lang_attr", "canonical", "text", "headings", "links", "jsonld", "dates", "blocks", "fields", "flow", "nodes")
#: Markup of the pages whose facts are in memory at once, about; a longer page is a piece of its own.
PIECE_CHARS = 1 << 20
SILENT, BREAKING, VOID, DATE_META = map(frozenset, (fixed.SILENT_TAGS, fixed.BREAKING_TAGS, fixed.VOID_TAGS, fixed.DATE_NAMES))
#: For a starting tag: the open tags that it ends, and those beyond which it ends nothing.
_ITEMS = {"li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
ENDS = _ITEMS | {"dd": _ITEMS["dt"], "th": _ITEMS["td"]} | {t: (("p",), ("td", "th", "li", "button")) for t in fixed.ENDS_PARAGRAPH}


def tidy(s: str) -> str:
    s = re.sub(r"[ \t\r\f\v]+", " ", s.replace("\xa0", " ").replace("​", "").replace("’", "'"))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", s)).strip()


class PageParser(HTMLParser):
    """Collects what PARSED holds in one pass. Unclosed tags end where the enclosing one does, paragraphs and items where the next one starts.

    ``flow`` is the text of all text nodes, a line feed between two of them. ``nodes`` are the elements in document order (``pre``); ``last`` is the last element inside, ``parent`` the enclosing one
    (-1: none), ``cls`` class and id, ``value`` a link's target or an image's description, and ``start`` and ``end`` the part of ``flow`` inside."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: dict = {k: "" for k in ("title", "meta_description", "og_site_name", "og_title", "lang_attr", "canonical")} | {k: [] for k in ("headings", "links", "jsonld", "dates", "fields", "nodes")}
        self.parts: list[str] = []
        self.open: list[str] = []
        #: Tag, value, and pieces of text of what is being collected.
        self.taking: list[tuple[str, str, list[str]]] = []
        #: Numbers of the open elements, pieces of the flow and its length.
        self.path: list[int] = []
        self.flow: list[str] = []
        self.at = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a, o = {k: v or "" for k, v in attrs}, self.out
        if tag == "html":
            o["lang_attr"] = a.get("lang", "").lower()[:10]
        elif tag == "meta":
            self.meta((a.get("name") or a.get("property") or a.get("itemprop") or "").lower(), a.get("content", ""))
        elif tag == "link" and a.get("rel", "").lower() == "canonical":
            o["canonical"] = o["canonical"] or a.get("href", "")
        elif tag in ("input", "textarea", "select"):
            o["fields"].append(f"{tag} {a.get('type', '')} {a.get('name', '')} {a.get('placeholder', '')}".lower())
        if tag in BREAKING:
            self.parts.append("\n")
            for _, _, pieces in self.taking:
                pieces.append("\n")
        self.end_implied(tag)
        n = len(o["nodes"])
        o["nodes"].append({"pre": n, "last": n, "parent": self.path[-1] if self.path else -1, "tag": tag, "cls": f"{a.get('class', '')} {a.get('id', '')}".strip()[:200], "value": tidy(a.get("alt", ""))[:200] if tag == "img" else a.get("href", ""), "start": self.at, "end": self.at})
        if tag in VOID:
            return
        self.open.append(tag)
        self.path.append(n)
        if tag == "title" or tag in ("h1", "h2", "h3") or (tag == "a" and "href" in a) or (tag == "script" and a.get("type") == "application/ld+json"):
            self.taking.append((tag, a.get("href", ""), []))
        else:
            self.taking.append(("", "", []))

    def meta(self, name: str, content: str) -> None:
        o = self.out
        if name == "description":
            o["meta_description"] = o["meta_description"] or tidy(content)[:600]
        elif name == "og:site_name":
            o["og_site_name"] = tidy(content)[:200]
        elif name == "og:title":
            o["og_title"] = tidy(content)[:300]
        elif content and (name in DATE_META or name.endswith(("modified_time", "published_time"))):
            o["dates"].append(content[:40])
        elif name == "og:locale" and content and not o["lang_attr"]:
            o["lang_attr"] = content.lower()[:10]

    def handle_endtag(self, tag: str) -> None:
        if tag in BREAKING:
            self.parts.append("\n")
        if tag in self.open:
            self.end_from(len(self.open) - 1 - self.open[::-1].index(tag))

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """As the standard parser, but a malformed section is a comment up to its ``>``, as in browsers; the page goes on behind it."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i)

    def end_implied(self, tag: str) -> None:
        ended, beyond = ENDS.get(tag, ((), ()))
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k] in ended:
                self.end_from(k)
                return
            if self.open[k] in beyond:
                return

    def end_from(self, k: int) -> None:
        """Ends the ``k``-th open element and what is open inside it."""
        while len(self.open) > k:
            self.open.pop()
            node = self.out["nodes"][self.path.pop()]
            node["last"], node["end"] = len(self.out["nodes"]) - 1, self.at
            self.finish(*self.taking.pop())

    def finish(self, tag: str, value: str, pieces: list[str]) -> None:
        o, raw = self.out, "".join(pieces)
        if tag == "title":
            o["title"] = o["title"] or tidy(raw)
        elif tag in ("h1", "h2", "h3"):
            if 0 < len(tidy(raw)) < 300:
                o["headings"].append(tidy(raw))
        elif tag == "a":
            o["links"].append({"href": value, "anchor": tidy(raw)[:200]})
        elif tag == "script":
            o["jsonld"] += json_items(raw)

    def handle_data(self, data: str) -> None:
        in_title = "title" in self.open or "script" in self.open
        for tag, _, pieces in self.taking:
            if tag in ("title", "script") or not in_title:
                pieces.append(data)
        if not SILENT.intersection(self.open):
            self.parts.append(data)
            piece = data if self.at == 0 else "\n" + data
            self.flow.append(piece)
            self.at += len(piece)

    def page(self) -> dict:
        self.end_from(0)
        text = tidy("".join(self.parts))
        for item in map(json.loads, self.out["jsonld"]):
            self.out["dates"] += [item[k][:40] for k in ("dateModified", "datePublished") if isinstance(item.get(k), str)]
        return self.out | {"text": text, "flow": "".join(self.flow), "blocks": [b.strip() for b in text.split("\n") if len(b.strip()) > 1]}


def json_items(raw: str) -> list[str]:
    """The objects of a linked-data script, each as JSON; a trailing comma is forgiven, anything else that doesn't parse is left out."""
    for attempt in (raw, re.sub(r",\s*([}\]])", r"\1", raw)):
        try:
            data = json.loads(attempt)
        except ValueError:
            continue
        items = data if isinstance(data, list) else [data]
        items = [y for x in items if isinstance(x, dict) for y in (x["@graph"] if isinstance(x.get("@graph"), list) else [x])]
        return [json.dumps(x) for x in items if isinstance(x, dict)]
    return []


def _parse(html: str | None) -> dict:
    parser = PageParser()
    parser.feed(html or "")
    parser.close()
    return parser.page()


def _parse_batches(html: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Facts of the pages, in pieces of so many characters, so that memory follows neither a batch's pages nor their number."""
    for batch in html:
        ends = batch.fillna("").str.len().cumsum().to_numpy() // PIECE_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(batch)] if len(batch) else [0, 0]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield pd.DataFrame([_parse(x) for x in batch.iloc[a:b]], columns=COLUMNS)


def parse_html(html: Column) -> Column:
    """A page's facts (PARSED). A null or empty page has empty ones.

    Marked as not deterministic, so that a filter on a fact doesn't parse the page a second time."""
    return F.pandas_udf(_parse_batches, PARSED).asNondeterministic()(html)


def parsed_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with the struct ``parsed``."""
    return pages.withColumn("parsed", parse_html(F.col(html_col)))


def title_of(html: Column) -> Column:
    """The title, by expression."""
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def lang_of(html: Column) -> Column:
    return F.lower(F.substring(F.regexp_extract(html, r"(?is)<html[^>]*\slang=[\"']?([A-Za-z_-]+)", 1), 1, 10))


def hrefs_of(html: Column) -> Column:
    """Targets of links, in order, by expression."""
    return F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*href=\"([^\"]*)\""), F.lit(1))


def first_heading(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<h1[^>]*>([^<]*)", 1))


def needs_render(html: Column, text: Column) -> Column:
    """Whether a page has so little text of its own that only a browser would show it."""
    n = F.length(F.coalesce(text, F.lit("")))
    shell = html.rlike(r"(?i)(__NEXT_DATA__|ng-app|id=\"root\"|id=\"app\"|id=\"__next\")")
    return (n < 600) | (F.coalesce(shell, F.lit(False)) & (n < 1500))
