"""People in running text: tokens, runs of capitalised words, and a table of what may stand before or after one.

A text is read once. Known phrases (titles, roles, verbs, greetings) are marked; runs of capitalised words outside them are names. A rule accepts a name by the
kind of mark next to it, on which side, and which few tokens may stand between. The functions on columns hand whole Arrow batches to these small helpers.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import partial
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import fixed

TOKEN = re.compile(r"[^\W\d_](?:\w|[-'.&](?=\w))*|\d+|\n|[^\w\s]")
DASHES = frozenset("-–—")
JOINS = DASHES | frozenset(",|:")


class Token(NamedTuple):
    text: str
    start: int
    end: int

    @property
    def low(self) -> str:
        return self.text.lower()


class Mark(NamedTuple):
    """A marked phrase: its tokens from ``i`` to before ``j``, and the company that a title names."""

    kind: str
    i: int
    j: int
    org: str = ""


class Mention(NamedTuple):
    name: str
    title: str | None
    org: str
    start: int
    end: int


class Rule(NamedTuple):
    """A name counts where a mark of ``kind`` stands on its ``side`` (1 after, -1 before) with at most ``most`` tokens of ``between`` in the middle."""

    side: int
    kind: str
    between: frozenset[str]
    most: int


FOUNDER_RULES = (
    Rule(1, "title", JOINS | {"is", "the", "our", "a"}, 3),
    Rule(-1, "made", frozenset(), 0),
    Rule(-1, "title", JOINS, 1),
)
TEAM_RULES = (Rule(1, "role", JOINS | {"is", "the", "our"}, 3), Rule(-1, "self", frozenset(), 0))
#: How far behind a greeting's name, in characters, a word of the story may stand.
STORY_REACH = 80


def phrases(*words: str) -> dict[str, list[tuple[str, ...]]]:
    """Phrases by their first token, the longest first."""
    out: dict[str, list[tuple[str, ...]]] = {}
    for w in words:
        parts = tuple(t.text for t in map(_token, TOKEN.finditer(w)))
        out.setdefault(parts[0], []).append(parts)
    return {k: sorted(v, key=len, reverse=True) for k, v in out.items()}


def _token(m: re.Match) -> Token:
    return Token(m[0], m.start(), m.end())


FOUNDER_MARKS = {
    "title": phrases(*fixed.FOUNDER_NOUNS), "made": phrases(*(f"{v} by" for v in fixed.FOUNDING_VERBS)),
    "self": phrases(*fixed.SELF_WORDS), "greeting": phrases(*fixed.GREETINGS), "story": phrases(*fixed.STORY_WORDS), "lead": phrases(*fixed.NAME_LEADS),
}
TEAM_MARKS = {"role": phrases(*fixed.TEAM_ROLES), "self": FOUNDER_MARKS["self"], "lead": FOUNDER_MARKS["lead"]}
HEADING_MARKS = {"told": phrases(*fixed.HEADING_LEADS)}


def tokens(text: str) -> list[Token]:
    return [_token(m) for m in TOKEN.finditer(text)]


def marked(toks: list[Token], kinds: dict[str, dict[str, list[tuple[str, ...]]]]) -> list[Mark]:
    """Marks of each kind, in order; within a kind they don't overlap. Titles side by side are one, with the company that follows them."""
    low = [t.low for t in toks]
    out = []
    for kind, known in kinds.items():
        i = 0
        while i < len(low):
            hit = next((p for p in known.get(low[i], ()) if tuple(low[i : i + len(p)]) == p), None)
            if hit:
                out.append(Mark(kind, i, i + len(hit)))
            i += len(hit) if hit else 1
    titles, others = [m for m in out if m.kind == "title"], [m for m in out if m.kind != "title"]
    whole: list[Mark] = []
    for m in titles:
        if whole and whole[-1].j + 1 == m.i and low[m.i - 1] in ("&", "and") and not whole[-1].org:
            m, _ = Mark("title", whole[-1].i, m.j), whole.pop()
        if m.j + 1 < len(toks) and low[m.j] in ("of", "at", "@"):
            end = m.j + 1
            while end < len(toks) and end < m.j + 6 and (toks[end].text[0].isupper() or low[end] == "&"):
                end += 1
            if end > m.j + 1:
                m = Mark("title", m.i, end, " ".join(t.text for t in toks[m.j + 1 : end]))
        whole.append(m)
    return sorted([*whole, *others], key=lambda m: (m.i, m.j))


def runs(text: str, toks: list[Token], taken: Iterable[Mark] = ()) -> list[tuple[int, int]]:
    """Maximal runs of capitalised words with blanks between them, outside the marks, as token ranges."""
    closed = {k for m in taken for k in range(m.i, m.j)}
    out: list[tuple[int, int]] = []
    for k, t in enumerate(toks):
        if k in closed or not t.text[0].isupper():
            continue
        if out and out[-1][1] == k and not text[toks[k - 1].end : t.start].strip(" \t"):
            out[-1] = (out[-1][0], k + 1)
        else:
            out.append((k, k + 1))
    return out


def _words(text: str, toks: list[Token], i: int, j: int) -> str:
    return text[toks[i].start : toks[j - 1].end]


def accepted(text: str, kinds: dict, rules: tuple[Rule, ...], least: int = 2) -> list[Mention]:
    """Names of ``least`` to three words that a rule accepts, in order. Of a longer run the three words next to the mark are the name."""
    toks = tokens(text)
    marks = marked(toks, kinds)
    starts: dict[int, list[Mark]] = {}
    ends: dict[int, list[Mark]] = {}
    for m in marks:
        starts.setdefault(m.i, []).append(m)
        ends.setdefault(m.j, []).append(m)
    out = []
    for i, j in runs(text, toks, marks):
        for rule in rules:
            at, by_edge = (j, starts) if rule.side > 0 else (i, ends)
            for gap in range(rule.most + 1):
                mark = next((m for m in by_edge.get(at + rule.side * gap, ()) if m.kind == rule.kind), None)
                if mark:
                    break
                beyond = at + gap if rule.side > 0 else at - gap - 1
                if not 0 <= beyond < len(toks) or toks[beyond].low not in rule.between:
                    break
            if mark and j - i >= (1 if rule.kind == "self" else least):
                a, b = (max(i, j - 3), j) if rule.side > 0 else (i, min(j, i + 3))
                first, last = min(a, mark.i), max(b, mark.j)
                title = _words(text, toks, mark.i, mark.j) if rule.kind == "title" else None
                out.append(Mention(_words(text, toks, a, b), title, mark.org, toks[first].start, toks[last - 1].end))
                break
        else:
            mention = greeted(text, toks, ends, starts, i, j)
            if mention and "greeting" in kinds:
                out.append(mention)
    return out


def greeted(text: str, toks: list[Token], ends: dict, starts: dict, i: int, j: int) -> Mention | None:
    """A name behind a greeting and "I am", if a word of the founding story follows in the same sentence."""
    me = next((m for m in ends.get(i, ()) if m.kind == "self"), None)
    before = me and (me.i - 1 if me.i and toks[me.i - 1].text == "," else me.i)
    if me is None or not any(m.kind == "greeting" for m in ends.get(before, ())):
        return None
    b = min(j, i + 3)
    for k in range(b, len(toks)):
        if toks[k].text in (".", "\n") or toks[k].start > toks[b - 1].end + STORY_REACH:
            return None
        if any(m.kind == "story" for m in starts.get(k, ())):
            return Mention(_words(text, toks, i, b), None, "", toks[me.i].start, toks[k].end)
    return None


def founder_mentions(text: str) -> list[Mention]:
    return accepted(text, FOUNDER_MARKS, FOUNDER_RULES)


def team_mentions(text: str) -> list[Mention]:
    return accepted(text, TEAM_MARKS, TEAM_RULES)


def person_names(text: str) -> list[str]:
    """Runs of two words or more, of which the first three count."""
    toks = tokens(text)
    return [_words(text, toks, i, min(j, i + 3)) for i, j in runs(text, toks) if j - i > 1]


def heading_name(heading: str) -> str | None:
    """Whom a heading tells of: up to four capitalised words behind what introduces a client."""
    toks = tokens(heading)
    marks = marked(toks, HEADING_MARKS)
    for m in marks:
        at = m.j
        while at < len(toks) and toks[at].text in JOINS:
            at += 1
        for i, j in runs(heading, toks, marks):
            if i == at:
                return _words(heading, toks, i, min(j, i + 4))
    return None


def leading_name(line: str) -> tuple[str, str, str] | None:
    """(dash, name, rest) of a line that begins with two to four capitalised words, behind a dash or not, and ends there or goes on behind a comma, bar, colon or dash."""
    toks = tokens(line)
    dash = toks[0].text if toks and toks[0].text in DASHES | {"~"} else ""
    first = next((r for r in runs(line, toks) if r[0] == len(dash)), None)
    if first is None or not 2 <= first[1] - first[0] <= 4:
        return None
    i, j = first
    if j == len(toks):
        return dash, _words(line, toks, i, j), ""
    return (dash, _words(line, toks, i, j), line[toks[j].end :].strip()) if toks[j].text in JOINS else None


def result_name(heading: str) -> str | None:
    """The name with which a heading begins that goes on to tell a result."""
    found = leading_name(heading)
    return found[1] if found and any(w in found[2].lower() for w in fixed.RESULT_WORDS) else None


def attributed_names(text: str, cite: str, most: int | None = 4) -> list[str]:
    """Names to which a quoted block is ascribed: in its cite, behind a dash, with a role in its first or last lines, or alone on one of these; the first ``most``, or all."""
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    out = [found[1] for found in [leading_name(" ".join(cite.split()))] if found]
    out += [found[1] for line in lines for found in [leading_name(line)] if found and found[0]]
    for line in lines[-4:] + lines[:2]:
        found = leading_name(line)
        # A role behind the name has three characters or more; a name alone is short.
        if found and not found[0] and (3 <= len(found[2]) <= 90 or not found[2] and len(line) < 40):
            out.append(found[1])
    return list(dict.fromkeys(out))[:most]


MENTION = "array<struct<name: string, title: string, org: string, start: int, end: int>>"


def _over_batches(find: Callable, kind: str, two: bool = False):
    def batches(*columns: pd.Series) -> pd.Series:
        return pd.Series([find(*("" if x is None else x for x in row)) for row in zip(*columns, strict=True)], dtype=object)

    if kind == MENTION:
        return F.pandas_udf(lambda s: batches(s).map(lambda found: [m._asdict() for m in found]), kind)
    return F.pandas_udf((lambda s, t: batches(s, t)) if two else (lambda s: batches(s)), kind)


def founder_mentions_in(text: Column) -> Column:
    """What a text says of its founder: array of MENTION; ``start`` and ``end`` count characters from 0. None in a null or empty text."""
    return _over_batches(founder_mentions, MENTION)(text)


def team_mentions_in(text: Column) -> Column:
    """People whom a text presents with a role of the team, or who present themselves."""
    return _over_batches(team_mentions, MENTION)(text)


def person_names_in(text: Column) -> Column:
    return _over_batches(person_names, "array<string>")(text)


def heading_name_in(heading: Column) -> Column:
    return _over_batches(heading_name, "string")(heading)


def result_name_in(heading: Column) -> Column:
    return _over_batches(result_name, "string")(heading)


def attributed_names_in(text: Column, cite: Column, most: int | None = 4) -> Column:
    return _over_batches(partial(attributed_names, most=most), "array<string>", two=True)(text, cite)
