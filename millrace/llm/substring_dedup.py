"""Substring dedup by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of ``width // 2`` words; any repeat of
``width`` words holds a whole block of the document it repeats. The blocks are indexed by hash bucket and
probed with every rolling window of all documents. Hits are extended over all windows of ``width``
words around them; comparing these by content, across all documents that have them, gives the
maximal exact repeats. A window leaves the document if a document with a smaller id has it too.

Between the steps go only packed arrays: of a chunk of documents, each bucket gets one row with the
distinct window hashes that fall to it. However often a passage occurs, a bucket gets it once a chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import rolling as R
from millrace.llm.anchors import in_parts, keyed_texts, measured, row_key, shared_anchors, with_hits
from millrace.llm.common import LAST_ID, table


def _scan(anchor: int):
    def scan(data: np.ndarray, offs: np.ndarray):
        """Every rolling window of ``anchor`` words; those at multiples of it are the document's reference blocks."""
        starts, ends, first = R.words(data, offs)
        at = R.in_one_text(first, anchor)
        counts = np.maximum(np.diff(first) - anchor + 1, 0)
        return R.window_hashes(R.word_hashes(data, starts, ends), anchor, at), counts, (at - np.repeat(first[:-1], counts)) % anchor == 0

    return scan


def _extended(part: pa.Table, width: int):
    """For each document of ``part`` its bytes, words, and the windows of ``width`` words around its hits with two hashes each."""
    anchor = width // 2
    texts = part.column("text")
    ids = part.column("doc_id").to_pylist()
    hits = part.column("hits").to_pylist()
    for a, b, offs, data in R.text_slices(texts):
        starts, ends, first = R.words(data, offs)
        h = R.word_hashes(data, starts, ends)
        for row in range(a, b):
            lo, hi = int(first[row - a]), int(first[row - a + 1])
            p = np.frombuffer(hits[row], "<u4").astype(np.int64)
            near = R.covered(np.maximum(p - (width - anchor), 0), width - anchor + 1, hi - lo) if hi - lo >= width else np.zeros(0, bool)
            near[max(0, hi - lo - width + 1) :] = False
            at = np.flatnonzero(near)
            words = h[lo:hi]
            one = R.window_hashes(words, width, at)
            two = R.window_hashes(R.mix(words ^ R.U(0xA5A5A5A5A5A5A5A5)), width, at)
            doc = LAST_ID if ids[row] is None else ids[row]
            yield row, doc, data, starts[lo:hi], ends[lo:hi], at, one, (two >> R.U(32)).astype(np.uint32)


PAIR = np.dtype([("a", "<u8"), ("b", "<u4")])


class Keys:
    """Distinct windows by 64 and 32 bits of hash, with the least id that has each."""

    def __init__(self, a: np.ndarray, b: np.ndarray, doc: np.ndarray):
        order = np.argsort(a, kind="stable")
        s = a[order]
        head = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
        if len(head) and (np.minimum.reduceat(b[order], head) != np.maximum.reduceat(b[order], head)).any():
            # Two windows agree in 64 bits but not in 96.
            order = np.lexsort((b, a))
            head = np.flatnonzero(np.concatenate(([True], (np.diff(a[order]) != 0) | (np.diff(b[order].astype(np.int64)) != 0))))
        self.a, self.b = a[order[head]], b[order[head]]
        self.least = np.minimum.reduceat(doc[order], head) if len(head) else np.zeros(0, np.int64)

    def at(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where windows, all of them known, stand."""
        slot = np.searchsorted(self.a, a)
        while len(off := np.flatnonzero(self.b[slot] != b)):
            slot[off] += 1
        return slot


def _keys(part: pa.Table, width: int) -> Keys:
    got = [(one, two, np.full(len(at), doc, dtype=np.int64)) for _, doc, _, _, _, at, one, two in _extended(part, width)]
    if not got:
        return Keys(np.zeros(0, R.U), np.zeros(0, np.uint32), np.zeros(0, np.int64))
    return Keys(*(np.concatenate([x[i] for x in got]) for i in range(3)))


def _packed(a: np.ndarray, b: np.ndarray) -> bytes:
    out = np.zeros(len(a), dtype=PAIR)
    out["a"], out["b"] = a, b
    return out.tobytes()


def _windows(width: int, buckets: int):
    def emit(docs: pa.Table, hits: pa.Table) -> pa.Table:
        k = _keys(with_hits(docs, hits), width)
        bucket = (k.a % R.U(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        group = (docs if docs.num_rows else hits).column("part")[0].as_py()
        rows = [(b, group, _packed(k.a[own], k.b[own]), k.least[own].astype("<i8").tobytes()) for b in range(buckets) if len(own := order[cut[b] : cut[b + 1]])]
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "part", "windows", "least"])

    return emit


def _smaller(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: for each group of documents, the windows that a smaller id outside it has, with that id."""
    h = [np.frombuffer(x, PAIR) for x in pdf["windows"]]
    own = [np.frombuffer(x, "<i8") for x in pdf["least"]]
    k = Keys(np.concatenate([x["a"] for x in h]), np.concatenate([x["b"] for x in h]), np.concatenate(own))
    out = []
    for part, mine, ids in zip(pdf["part"], h, own, strict=True):
        best = k.least[k.at(np.ascontiguousarray(mine["a"]), mine["b"])]
        less = best < ids
        if less.any():
            out.append((part, mine[less].tobytes(), best[less].astype("<i8").tobytes()))
    return pd.DataFrame(out, columns=["part", "windows", "least"])


def _cut(width: int):
    def cut(docs: pa.Table, found: pa.Table) -> pa.Table:
        rows = []
        part = with_hits(docs, found.filter(pc.is_valid(found.column("hits"))))
        smaller = found.filter(pc.is_valid(found.column("windows")))
        if part.num_rows:
            k = _keys(part, width)
            for windows, ids in zip(smaller.column("windows").to_pylist(), smaller.column("least").to_pylist(), strict=True):
                more = np.frombuffer(windows, PAIR)
                k.least[k.at(np.ascontiguousarray(more["a"]), more["b"])] = np.frombuffer(ids, "<i8")
            ids, doc_keys = part.column("doc_id").to_pylist(), part.column("doc_key").to_pylist()
            for row, doc, data, starts, ends, at, one, two in _extended(part, width):
                gone = at[k.least[k.at(one, two)] < doc]
                if not len(gone):
                    continue
                out = R.covered(gone, width, len(starts))
                # The kept words are some whole runs of words, in which only the white space may have to be made one space.
                kept = b" ".join(b" ".join(data[starts[s] : ends[e - 1]].tobytes().split()) for s, e in R.runs(~out))
                rows.append((ids[row], doc_keys[row], int(out.sum()), [{"start": int(s), "end": int(e)} for s, e in R.runs(out)], kept.decode()))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), span, pa.string()), strict=True)], ["doc_id", "doc_key", "n_removed", "spans", "kept_text"])

    return cut


def repeated_passages(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """The documents that repeat a passage of a document with a smaller id: (doc_id, doc_key, n_removed, spans, kept_text).

    ``spans`` are the maximal removed runs of words (start, end), ``kept_text`` the other words joined by
    one space. Windows are judged on the input. ``doc_key`` is ``row_key``; rows equal in id and text give one row.

    Null and empty texts, and texts of fewer than ``width`` words, repeat nothing. A null id stands
    after every other, and null ids don't precede one another. An empty table gives an empty one.
    Other columns are ignored. ``docs`` must give its rows in the same order each time it is read, as files do.
    """
    docs = keyed_texts(docs, id_col, text_col)
    parts, n = (buckets, buckets) if buckets else measured(docs)
    hits = shared_anchors(docs, _scan(width // 2), parts, n, "passages")
    docs = in_parts(docs, parts)
    windows = docs.groupBy("part").cogroup(hits.groupBy("part")).applyInArrow(_windows(width, n), "bucket int, part int, windows binary, least binary")
    smaller = windows.repartitionById(n, "bucket").groupBy("bucket").applyInPandas(_smaller, "part int, windows binary, least binary")
    # Both cogroups read the same exchange of the texts.
    found = hits.unionByName(smaller, allowMissingColumns=True).repartitionById(parts, "part")
    cut = docs.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(_cut(width), "doc_id long, doc_key long, n_removed long, spans array<struct<start: long, end: long>>, kept_text string")
    return cut.dropDuplicates(["doc_id", "doc_key"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        split = [(x.as_buffer().to_pybytes() if x.is_valid else b"").split() for x in pc.cast(batch.column(2), pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in split], pa.int64()), pa.array([hashlib.sha256(b" ".join(x)).hexdigest() for x in split], pa.string())], ["doc_id", "doc_key", "n_words", "whole_sha256"])


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, and a digest of those that no smaller document's passage covers."""
    docs = table(spark, sf_dir, "documents")
    cut = repeated_passages(docs).select(F.col("doc_id").alias("cid"), F.col("doc_key").alias("ckey"), "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("cut_sha256"))
    whole = docs.select("doc_id", row_key("doc_id", "text").alias("doc_key"), "text").mapInArrow(_digest, "doc_id long, doc_key long, n_words long, whole_sha256 string")
    return whole.join(cut, F.col("doc_id").eqNullSafe(F.col("cid")) & (F.col("doc_key") == F.col("ckey")), "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("cut_sha256", "whole_sha256").alias("kept_sha256"))


OP2_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM t),
x AS (SELECT doc_id, i, word, md5(string_agg(word, ' ') OVER a) AS h, count(*) OVER a AS n FROM w WINDOW a AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
m AS (SELECT h, min(doc_id) AS least FROM x WHERE n = 50 GROUP BY h),
s AS (SELECT x.doc_id, x.i, x.word, x.n = 50 AND m.least < x.doc_id AS again FROM x LEFT JOIN m ON m.h = x.h),
c AS (SELECT doc_id, i, word, coalesce(bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), FALSE) AS gone FROM s),
k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM c GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN k USING (doc_id)
"""
