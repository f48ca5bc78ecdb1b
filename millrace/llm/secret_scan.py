"""Secrets in texts: patterns of known kinds, and strings that a public vocabulary spells inefficiently.

A byte-pair vocabulary writes prose, names and paths in long tokens; random strings come out in short ones. Runs of letters, digits and ``+/=_-`` that get fewer
than ``EFFICIENCY`` characters a token are taken for secrets, after known digests, numbers and identifiers are excluded. The vocabulary's ranks are read by Spark and broadcast: their number is
fixed by the vocabulary, whatever the table. Every text is scanned whole.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table

# The kinds in order, their patterns, and the least length of what is matched.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Only starts of runs are tried, which finds the same runs as the plain class does.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "token")

#: Rank file and splitting pattern of the vocabulary.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters a token under which a run counts as random: of random strings of 20 characters or more 98 in 100 and more get less.
EFFICIENCY = 1.9
#: Least length and number of different characters of a run; longer runs are spelt in pieces of ``PIECE``, so that the time follows their length.
LEAST, DISTINCT, PIECE = 20, 8, 64
RUN = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{20,}")
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
DIGEST = re.compile(r"(?:(?:md5|sha1|sha224|sha256|sha384|sha512)[-=])?(?:[0-9a-f]+|[0-9A-F]+)", re.IGNORECASE)
#: Hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
#: Parts of an identifier: numbers, and words in one case or with a capital.
NAME_PART = re.compile(r"[0-9]+|[A-Z]?[a-z]+|[A-Z]+")

_encodings: dict[tuple[str, str], tiktoken.Encoding] = {}


def _is_named(run: str) -> bool:
    """A digest of a known length, a UUID, or an identifier: several words and numbers with separators between them."""
    if UUID.fullmatch(run):
        return True
    if DIGEST.fullmatch(run) and len(re.split("[-=]", run)[-1]) in DIGEST_LENGTHS:
        return True
    parts = [p for p in re.split(r"[+/=_-]+", run) if p]
    return run.isdigit() or len(parts) > 1 and all(NAME_PART.fullmatch(p) for p in parts)


def characters_a_token(run: str, encoding: tiktoken.Encoding) -> float:
    return len(run) / sum(len(encoding.encode_ordinary(run[i : i + PIECE])) for i in range(0, len(run), PIECE))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by patterns alone, leftmost and not overlapping within a kind; the kind by its place in ``KINDS``."""
    spans = [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    spans += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return spans + [(2, m.start(), m.end()) for m in HEX.finditer(text)]


def random_spans(text: str, encoding: tiktoken.Encoding, efficiency: float = EFFICIENCY) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the runs that the vocabulary spells inefficiently."""
    runs = ((m[0], m.start(), m.end()) for m in RUN.finditer(text))
    return [(3, a, b) for run, a, b in runs if len(set(run)) >= DISTINCT and not _is_named(run) and characters_a_token(run, encoding) < efficiency]


def all_spans(text: str, encoding: tiktoken.Encoding, efficiency: float = EFFICIENCY) -> list[tuple[int, int, int]]:
    """Spans of all kinds by start, then kind; a random run that overlaps what a pattern found is that find, and adds none."""
    base = sorted(base_spans(text), key=lambda s: (s[1], s[0]))
    starts, ends = [s[1] for s in base], list(accumulate((s[2] for s in base), max))
    # Among the spans that begin before a run's end, the furthest end tells whether any reaches into it.
    more = [s for s in random_spans(text, encoding, efficiency) if not (i := bisect_left(starts, s[2])) or ends[i - 1] <= s[1]]
    return sorted([*base, *more], key=lambda s: (s[1], s[0]))


def read_ranks(spark: SparkSession, vocabulary: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a token in base 64 and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (r[0].split() for r in spark.read.text(vocabulary).where("value <> ''").collect())}


def _scan(ranks, vocabulary: str, pattern: str, efficiency: float):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encodings.get((vocabulary, pattern))
        if encoding is None:  # once for each Python worker
            encoding = _encodings[vocabulary, pattern] = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        for batch in batches:
            found = []
            for text in batch.column(1):
                text = text.as_py() or ""
                found.append([{"kind": KINDS[k], "start": a, "end": b, "secret": text[a:b]} for k, a, b in all_spans(text, encoding, efficiency)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret", pa.string())])))], ["id", "spans"])

    return emit


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN, efficiency: float = EFFICIENCY) -> DataFrame:
    """(id, spans) for each row of ``docs``: every span's kind, start and end in code points, and what it holds.

    One pass without a shuffle. A null or empty text has no span, repeated rows have theirs each, a null id stays null, an empty table gives an empty one; other columns are ignored, whatever their names.
    A very long text, or run, is scanned whole, in time that follows its length. ``vocabulary`` is a rank file that Spark can read.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(spark, vocabulary))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan(ranks, vocabulary, pattern, efficiency), f"id {dict(rows.dtypes)['id']}, spans array<struct<kind string, start long, end long, secret string>>")


def written(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of spans of each pattern, the digest of these, and all spans, of every document."""
    found = secret_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "token")
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
