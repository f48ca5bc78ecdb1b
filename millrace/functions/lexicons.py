"""Many patterns over one text: an automaton over the literals that they need decides in one pass which of them can match; only those run.

Of each pattern the literals are taken of which every match holds one, by walking its parsed form: alternatives are put together, the best part of a sequence counts. A pattern without any is always tried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as K
from re import _parser as P

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strings into which a part is spelt out at most, and the shortest literal worth looking for.
SPELT, SHORTEST = 64, 2


def _finite(items) -> set[str] | None:
    """All strings that a sequence matches, in lower case, if they are few."""
    out = {""}
    for op, arg in items:
        if op is K.LITERAL:
            part = {chr(arg).lower()}
        elif op is K.IN and all(o is K.LITERAL for o, _ in arg):
            part = {chr(c).lower() for _, c in arg}
        elif op is K.SUBPATTERN:
            part = _finite(arg[3])
        elif op is K.BRANCH:
            spelt = [_finite(x) for x in arg[1]]
            part = None if None in spelt else set().union(*spelt)
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and arg[1] == 1:
            inner = _finite(arg[2])
            part = inner and (inner if arg[0] else inner | {""})
        elif op is K.AT:
            part = {""}
        else:
            part = None
        if part is None or len(out) * len(part) > SPELT:
            return None
        out = {a + b for a in out for b in part}
    return out


def needed(pattern: str) -> frozenset[str] | None:
    """Literals in lower case of which each match of a pattern holds one at least, whatever the case; None where there are no such."""

    def of(items) -> set[str] | None:
        options, run = [], []
        for item in [*items, None]:
            if item is not None and _finite([*run, item]) is not None:
                run.append(item)
                continue
            options.append(_finite(run))
            run = [item] if item is not None and _finite([item]) is not None else []
            if item is None or run:
                continue
            op, arg = item
            if op is K.SUBPATTERN:
                options.append(of(arg[3]))
            elif op is K.BRANCH:
                parts = [of(x) for x in arg[1]]
                options.append(None if None in parts else set().union(*parts))
            elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and arg[0]:
                options.append(of(arg[2]))
        fit = [o for o in options if o and min(map(len, o)) >= SHORTEST and all(x.isascii() for x in o)]
        return max(fit, key=lambda o: (min(map(len, o)), -len(o)), default=None)

    got = of(list(P.parse(pattern, re.IGNORECASE | re.ASCII)))
    return frozenset(got) if got else None


class Lexicon:
    """Compiled patterns with the automaton that chooses among them."""

    def __init__(self, entries: tuple[tuple[str, str], ...]):
        self.labels = [label for label, _ in entries]
        self.patterns = [re.compile(p, re.IGNORECASE | re.ASCII) for _, p in entries]
        self.always, by = [], {}
        for i, (_, p) in enumerate(entries):
            literals = needed(p)
            if literals is None:
                self.always.append(i)
            for x in literals or ():
                by.setdefault(x, set()).add(i)
        self.automaton = ahocorasick.Automaton()
        for x, ids in by.items():
            self.automaton.add_word(x, ids)
        if by:
            self.automaton.make_automaton()
        self.some = bool(by)

    def possible(self, text: str) -> list[int]:
        """Numbers of the patterns that may match, in order."""
        found = set(self.always)
        if self.some:
            for _, ids in self.automaton.iter(text.lower()):
                found |= ids
        return sorted(found)

    def count(self, text: str, cap: int) -> list[int]:
        """Matches of each pattern, ``cap`` at most."""
        out = [0] * len(self.patterns)
        for i in self.possible(text):
            for _ in self.patterns[i].finditer(text):
                out[i] += 1
                if out[i] == cap:
                    break
        return out


_lexicons: dict[tuple, Lexicon] = {}


def _over(entries: tuple[tuple[str, str], ...], find, kind: pa.DataType):
    """``find`` for each text; one text at a time leaves the Arrow batch, so that a batch is not in memory twice."""

    def batches(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if entries not in _lexicons:  # once for each Python worker
            _lexicons[entries] = Lexicon(entries)
        for s in texts:
            yield pa.array((find(_lexicons[entries], x.as_py() or "") for x in s), pa.list_(kind), size=len(s))

    return batches


def counts_of(text: Column, entries, cap: int = 30) -> Column:
    """Matches of each entry (label, pattern) of a lexicon, whatever the case, ``cap`` at most: an array in the lexicon's order; all 0 for a null or empty text.

    Marked as not deterministic, so that several uses of the counts don't scan the text again."""
    return F.arrow_udf(_over(tuple(entries), lambda lex, x: lex.count(x, cap), pa.int32()), "array<int>").asNondeterministic()(text)


def labels_of(text: Column, entries) -> Column:
    """Labels with a match, in the lexicon's order."""
    return F.arrow_udf(_over(tuple(entries), lambda lex, x: [label for label, n in zip(lex.labels, lex.count(x, 1), strict=True) if n], pa.string()), "array<string>").asNondeterministic()(text)
