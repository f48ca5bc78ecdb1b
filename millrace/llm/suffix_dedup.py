"""Suffix-array dedup by column-wise construction over many documents.

Strings of ``width`` bytes are compared through the sorted order of suffixes. The order is built
column by column: each round inserts one symbol in front of every document's suffix, which turns the previous
order into the next by one stable counting sort on the inserted symbols (these, in the previous order, are
the collection's Burrows-Wheeler column), and updates the common prefixes of neighbours from range minima of the
previous ones. Neighbours with ``width`` common bytes hold the same string.

Whole texts would need a round for each byte of the longest. But equal strings have equal anchors (their least k-gram by hash),
at the same place within the string. So texts are cut into segments around anchors, segments with the
same anchor meet in one bucket, and in it columns are counted from the anchor: at most
``2 * width`` rounds, and equal strings always begin in the same column. Segments whose anchor
no other document has cannot match and are not sent. Within a bucket the symbols, column by column, and the order and common
prefixes of each round are sequential files, read and written in blocks; the number of buckets follows the input's bytes.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import rolling as R
from millrace.llm.anchors import in_parts, keyed_texts, measured, row_key, shared_anchors, with_hits
from millrace.llm.common import LAST_ID, table

#: Bytes of the k-grams among which a string's anchor is chosen: long enough that unrelated texts seldom share one.
GRAM = 24
TOP = np.uint64(0xFFFFFFFF00000000)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by doubling."""
    have, m = 1, x
    while have < width:
        step = min(have, width - have)
        m = np.minimum(m[: len(m) - step], m[step:])
        have += step
    return m


def anchors(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings (start bytes) of ``width`` bytes that don't cross texts; the anchor of each (its leftmost
    least k-gram); and the k-gram hashes at all positions."""
    if len(data) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, R.U)
    up, down = R.powers(R.BYTE_BASE, len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=R.U)
    np.multiply(R.BYTE_VALUES[data], up[: len(data)], out=total[1:])
    np.cumsum(total[1:], out=total[1:])
    grams = total[GRAM:] - total[:-GRAM]
    grams *= down[: len(grams)]
    order = (grams ^ (grams >> R.U(29))) * R.U(0xBF58476D1CE4E5B9)
    order &= TOP
    order |= np.arange(len(grams), dtype=R.U)
    best = sliding_min(order, width - GRAM + 1)
    at = R.in_one_text(offs, width)
    return at, (best[at] & R.U(0xFFFFFFFF)).astype(np.int64), grams


def segments(at: np.ndarray, anchor: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of strings with the same anchor: the first string of each (index into ``at``, with the end), and its text."""
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)))) if len(at) else np.zeros(0, np.int64)
    return np.append(first, len(at)), np.searchsorted(offs, at[first], "right") - 1


def _scan(width: int):
    def scan(data: np.ndarray, offs: np.ndarray):
        at, anchor, grams = anchors(data, offs, width)
        first, text = segments(at, anchor, offs)
        hashes = R.mix(grams[anchor[first[:-1]]] ^ R.U(0x5851F42D4C957F2D)) if len(at) else np.zeros(0, R.U)
        return hashes, np.bincount(text, minlength=len(offs) - 1), None

    return scan


class Segments:
    """The segments of some documents around their shared anchors, each distinct content once.

    ``slices`` has the texts, a few at a time, with the range of their segments; ``begin`` is in the slice's bytes."""

    def __init__(self, part: pa.Table, width: int):
        ids = part.column("doc_id")
        self.ids = pc.fill_null(ids, LAST_ID).to_numpy() if part.num_rows else np.zeros(0, np.int64)
        hits = part.column("hits").to_pylist()
        self.slices: list[tuple[int, np.ndarray, np.ndarray, int, int]] = []
        got: list[tuple[np.ndarray, ...]] = []
        total = 0
        for a, b, offs, data in R.text_slices(part.column("text")):
            at, anchor, grams = anchors(data, offs, width)
            first, text = segments(at, anchor, offs)
            own = np.searchsorted(text, np.arange(b - a))
            numbers = [np.frombuffer(hits[a + t], "<u4") for t in range(b - a)]
            chosen = np.repeat(own, [len(x) for x in numbers]) + np.concatenate(numbers)
            begin, n, kgram = at[first[chosen]], first[chosen + 1] - first[chosen], anchor[first[chosen]]
            size, ahead = n + width - 1, kgram - at[first[chosen]]
            got.append((_content(data, begin, size, ahead), begin, size, ahead, R.mix(grams[kgram]), a + text[chosen], np.full(len(chosen), len(self.slices))))
            self.slices.append((a, offs, data, total, total + len(chosen)))
            total += len(chosen)
        kinds = (np.int64, np.int64, np.int64, R.U, np.int64, np.int64)
        key = np.concatenate([x[0] for x in got]) if got else np.zeros((0, 2), R.U)
        self.begin, size, ahead, route, self.row, piece = (np.concatenate(x) if got else np.zeros(0, k) for x, k in zip(list(zip(*got, strict=True))[1:] if got else [()] * 6, kinds, strict=True))
        self.strings = size - width + 1
        self.distinct_of, head, self.least = distinct(key, self.ids[self.row])
        self.head, self.size, self.ahead, self.route, self.piece = head, size[head], ahead[head], route[head], piece[head]

    def bytes_of(self, chosen: np.ndarray) -> bytes:
        """Contents of distinct segments; ``chosen`` goes through the slices in order."""
        cut = np.searchsorted(self.piece[chosen], np.arange(len(self.slices) + 1))
        begin = self.begin[self.head]
        return b"".join(self.slices[p][2][R.ranges(begin[own], self.size[own])].tobytes() for p in range(len(self.slices)) if len(own := chosen[cut[p] : cut[p + 1]]))


def distinct(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each item the number of its key (two values), and for each key its first item and least id; keys are numbered in the order of their first items."""
    order = np.argsort(key[:, 0], kind="stable")
    s = key[order]
    if ((s[1:, 0] == s[:-1, 0]) & (s[1:, 1] != s[:-1, 1])).any():
        order = np.lexsort((key[:, 1], key[:, 0]))
        s = key[order]
    head = np.flatnonzero(np.concatenate(([True], (s[1:] != s[:-1]).any(axis=1)))) if len(key) else np.zeros(0, np.int64)
    first, least = order[head], np.minimum.reduceat(doc[order], head) if len(head) else np.zeros(0, np.int64)
    by_first = np.argsort(first, kind="stable")
    number = np.empty(len(first), dtype=np.int64)
    number[by_first] = np.arange(len(first))
    of = np.empty(len(key), dtype=np.int64)
    of[order] = np.repeat(number, np.diff(np.append(head, len(key))))
    return of, first[by_first], least[by_first]


def _content(data: np.ndarray, begin: np.ndarray, length: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """128-bit hashes (two values) of byte ranges of any length, with the length and the anchor's place."""
    out = np.empty((len(begin), 2), dtype=R.U)
    for lane, (base, values) in enumerate(((R.BYTE_BASE, R.BYTE_VALUES), (R.WORD_BASE, R.mix(R.BYTE_VALUES)))):
        up, down = R.powers(base, len(data) + 1)
        total = np.zeros(len(data) + 1, dtype=R.U)
        np.cumsum(values[data] * up[: len(data)], out=total[1:])
        out[:, lane] = R.mix((total[begin + length] - total[begin]) * down[begin] + R.mix((length * 1024 + ahead).astype(R.U)))
    return out


def range_minima(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(x[lo + 1 .. hi]) for each pair of positions lo < hi, from minima over powers of two."""
    out = np.empty(len(lo), dtype=x.dtype)
    gap = hi - lo
    level = np.frexp(gap.astype(np.float64))[1] - 1
    k, m = 0, x
    while len(gap):
        own = np.flatnonzero(level == k)
        out[own] = np.minimum(m[lo[own] + 1], m[hi[own] - (1 << k) + 1])
        if k >= level.max(initial=0):
            return out
        m = np.minimum(m[: len(m) - (1 << k)], m[1 << k :])
        k += 1
    return out


#: Items of a sequential file that are in memory at once.
FILE_BLOCK = 1 << 18
#: A common prefix of no known bound.
ALL = 255


class ColumnOrder:
    """The order of the documents' suffixes that begin in one column, with the common prefix of each and its predecessor, in two sequential files.

    ``insert`` reads them in blocks and writes the files of the column before: one file region for each symbol, filled from its front."""

    def __init__(self, folder: str, block: int):
        self.folder, self.block, self.round, self.n = folder, block, 0, 0

    def _path(self, name: str, number: int) -> str:
        return f"{self.folder}/{name}-{number}"

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not self.n:
            return
        with open(self._path("order", self.round), "rb") as order, open(self._path("prefix", self.round), "rb") as prefix:
            for at in range(0, self.n, self.block):
                m = min(self.block, self.n - at)
                yield np.fromfile(order, "<u4", m), np.fromfile(prefix, np.uint8, m)

    def _with(self, new: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The order, after documents that end here: their suffixes are empty, so they come first and share nothing."""
        for at in range(0, len(new), self.block):
            some = new[at : at + self.block].astype("<u4")
            yield some, np.zeros(len(some), np.uint8)
        for i, (order, prefix) in enumerate(self.blocks()):
            if i == 0:
                prefix[0] = 0
            yield order, prefix

    def insert(self, symbols: np.ndarray, active: np.ndarray, new: np.ndarray) -> None:
        """Puts each active document's symbol in front of its suffix; documents that have none leave."""
        sizes = np.bincount(symbols[active], minlength=256)
        to = np.cumsum(sizes) - sizes
        # For each symbol the least common prefix since its last document.
        since, seen = np.full(256, ALL, np.uint8), np.zeros(256, bool)
        order_fd, prefix_fd = (os.open(self._path(name, self.round + 1), os.O_RDWR | os.O_CREAT) for name in ("order", "prefix"))
        try:
            for order, prefix in self._with(new):
                at = np.flatnonzero(active[order])
                if not len(at):
                    since = np.minimum(since, prefix.min())
                    continue
                s = symbols[order[at]]
                by = np.argsort(s, kind="stable")
                at, s = at[by], s[by]
                head = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
                common = np.empty(len(s), dtype=np.uint8)
                same = np.ones(len(s), bool)
                same[head] = False
                same = np.flatnonzero(same)
                common[same] = np.minimum(range_minima(prefix, at[same - 1], at[same]), 250) + 1
                kinds = s[head]
                upto = np.minimum(since[kinds], np.minimum.accumulate(prefix)[at[head]])
                common[head] = np.where(seen[kinds], np.minimum(upto, 250) + 1, 0)
                ends = np.append(head[1:], len(s)) - 1
                last = at[ends]
                since = np.minimum(since, prefix.min())
                rest = np.append(np.minimum.accumulate(prefix[::-1])[::-1], ALL)
                since[kinds], seen[kinds] = rest[last + 1], True
                moved = order[at]
                for k, a, b in zip(kinds.tolist(), head.tolist(), (ends + 1).tolist(), strict=True):
                    os.pwrite(order_fd, moved[a:b].tobytes(), 4 * int(to[k]))
                    os.pwrite(prefix_fd, common[a:b].tobytes(), int(to[k]))
                    to[k] += b - a
        finally:
            os.close(order_fd)
            os.close(prefix_fd)
        if self.round:
            for name in ("order", "prefix"):
                os.remove(self._path(name, self.round))
        self.round, self.n = self.round + 1, int(sizes.sum())

    def classes(self, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Documents in order, with the number of their class: neighbours of ``width`` common bytes are of one class."""
        number = -1
        for order, prefix in self.blocks():
            own = number + np.cumsum(prefix < width)
            number = int(own[-1])
            yield order, own


def column_classes(data: np.ndarray, begin: np.ndarray, size: np.ndarray, ahead: np.ndarray, least: np.ndarray, width: int, block: int | None = None) -> np.ndarray:
    """For every string of ``width`` bytes of every segment, in order, the least id that any segment with that string has.

    Columns are counted from the anchor; the last is inserted first. The symbols, column by column, and each column's order and common prefixes
    are sequential files in a temporary folder, gone when this returns."""
    n, first_col, end_col = len(size), -ahead, size - ahead
    strings = size - width + 1
    slot = np.cumsum(strings) - strings
    out = np.repeat(least, strings)
    if not n:
        return out
    low, high = int(first_col.min()), int(end_col.max())
    by_end = np.argsort(-end_col, kind="stable")
    entered = np.searchsorted(-end_col[by_end], -np.arange(high, low - 1, -1), "right")
    with tempfile.TemporaryDirectory(prefix="columns-") as folder:
        with open(f"{folder}/symbols", "wb") as f:
            for col in range(high - 1, low - 1, -1):
                column = np.zeros(n, dtype=np.uint8)
                own = np.flatnonzero((first_col <= col) & (col < end_col))
                column[own] = data[begin[own] + (col - first_col[own])]
                column.tofile(f)
        order = ColumnOrder(folder, block or FILE_BLOCK)
        with open(f"{folder}/symbols", "rb") as f:
            for r, col in enumerate(range(high - 1, low - 1, -1)):
                order.insert(np.fromfile(f, np.uint8, n), (first_col <= col) & (col < end_col), by_end[entered[r - 1] if r else 0 : entered[r]])
                if not (end_col - col >= width).any():
                    continue
                best = np.full(order.n, LAST_ID)
                for docs, own in order.classes(width):
                    head = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                    best[own[head]] = np.minimum(best[own[head]], np.minimum.reduceat(least[docs], head))
                for docs, own in order.classes(width):
                    whole = end_col[docs] - col >= width
                    docs = docs[whole]
                    out[slot[docs] + col - first_col[docs]] = best[own[whole]]
    return out


def _send(width: int, buckets: int):
    def send(docs: pa.Table, hits: pa.Table) -> pa.Table:
        part = with_hits(docs, hits)
        s = Segments(part, width)
        bucket = (s.route % R.U(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        group = (docs if docs.num_rows else hits).column("part")[0].as_py()
        pack = zstandard.ZstdCompressor(level=1).compress
        rows = [(b, group, pack(s.bytes_of(own)), s.size[own].astype("<u2").tobytes(), s.ahead[own].astype("u1").tobytes(), s.least[own].astype("<i8").tobytes()) for b in range(buckets) if len(own := order[cut[b] : cut[b + 1]])]
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 6, (pa.int32(), pa.int32(), *[pa.binary()] * 4), strict=True)], ["bucket", "part", "content", "size", "ahead", "least"])

    return send


def _columns(width: int):
    def columns(rows: list[tuple]) -> pa.RecordBatch:
        """All columns of one bucket; goes back to each group of documents: which of its segments have a string
        that a smaller id than their own has, and the least id for each of their strings."""
        sizes = [np.frombuffer(x[3], "<u2").astype(np.int64) for x in rows]
        size, ahead = np.concatenate(sizes), np.concatenate([np.frombuffer(x[4], "u1") for x in rows]).astype(np.int64)
        own = np.concatenate([np.frombuffer(x[5], "<i8") for x in rows])
        data = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(x[2]) for x in rows), np.uint8)
        begin = np.cumsum(size) - size
        # The same content from several groups of documents is one document of the collection.
        key = np.concatenate([_content(data[begin[a] : begin[b - 1] + size[b - 1]], begin[a:b] - begin[a], size[a:b], ahead[a:b]) for a, b in ((a, min(a + 10_000, len(size))) for a in range(0, len(size), 10_000))])
        of, head, least = distinct(key, own)
        best = column_classes(data, begin[head], size[head], ahead[head], least, width)
        strings = size[head] - width + 1
        slot = np.cumsum(strings) - strings
        less = np.minimum.reduceat(best, slot)[of] < own
        out, at = [], 0
        for row, n in zip(rows, map(len, sizes), strict=True):
            mine = np.flatnonzero(less[at : at + n])
            if len(mine):
                which = of[at + mine]
                out.append((row[0], row[1], mine.astype("<u4").tobytes(), best[R.ranges(slot[which], strings[which])].astype("<i8").tobytes()))
            at += n
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 4, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "part", "segments", "least"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows come bucket by bucket."""
        now, rows = None, []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if row[0] != now and rows:
                    yield columns(rows)
                    rows = []
                now = row[0]
                rows.append(row)
        if rows:
            yield columns(rows)

    return emit


def _cut(width: int, buckets: int):
    def cut(docs: pa.Table, found: pa.Table) -> pa.Table:
        rows = []
        part = with_hits(docs, found.filter(pc.is_valid(found.column("hits"))))
        smaller = found.filter(pc.is_valid(found.column("segments")))
        s = Segments(part, width)
        strings = s.size - width + 1
        slot = np.cumsum(strings) - strings
        least = np.repeat(s.least, strings)
        bucket = (s.route % R.U(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        start = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b, which, ids in zip(*(smaller.column(c).to_pylist() for c in ("bucket", "segments", "least")), strict=True):
            own = order[start[b] + np.frombuffer(which, "<u4").astype(np.int64)]
            least[R.ranges(slot[own], strings[own])] = np.frombuffer(ids, "<i8")
        ids, doc_keys = part.column("doc_id").to_pylist(), part.column("doc_key").to_pylist()
        for a, offs, data, lo, hi in s.slices:
            n, of = s.strings[lo:hi], s.distinct_of[lo:hi]
            gone = least[R.ranges(slot[of], n)] < np.repeat(s.ids[s.row[lo:hi]], n)
            if not gone.any():
                continue
            out = R.covered(R.ranges(s.begin[lo:hi], n)[gone], width, len(data))
            removed = np.concatenate(([0], np.cumsum(out)))
            removed = removed[offs[1:]] - removed[offs[:-1]]
            for t in np.flatnonzero(removed).tolist():
                mine = out[offs[t] : offs[t + 1]]
                rows.append((ids[a + t], doc_keys[a + t], int(removed[t]), [{"start": int(x), "end": int(y)} for x, y in R.runs(mine)], data[offs[t] : offs[t + 1]][~mine].tobytes()))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), span, pa.binary()), strict=True)], ["doc_id", "doc_key", "n_removed", "spans", "kept_bytes"])

    return cut


def repeated_bytes(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """The documents that repeat ``width`` bytes of a document with a smaller id: (doc_id, doc_key, n_removed, spans, kept_bytes).

    Texts are UTF-8 bytes; ``spans`` are the maximal removed runs (start, end), ``kept_bytes`` the rest, joined. Strings are judged on
    the input, overlaps count. ``doc_key`` is ``row_key``; rows equal in id and text give one row.

    Null and empty texts, and texts of fewer than ``width`` bytes, repeat nothing. A null id stands
    after every other, and null ids don't precede one another. An empty table gives an empty one. Other columns
    are ignored. ``docs`` must give its rows in the same order each time it is read, as files do.
    """
    if not GRAM < width <= 250:
        raise ValueError(f"width has to be above {GRAM} and at most 250")
    docs = keyed_texts(docs, id_col, text_col)
    parts, n = (buckets, buckets) if buckets else measured(docs)
    hits = shared_anchors(docs, _scan(width), parts, n, "suffixes")
    docs = in_parts(docs, parts)
    sent = docs.groupBy("part").cogroup(hits.groupBy("part")).applyInArrow(_send(width, n), "bucket int, part int, content binary, size binary, ahead binary, least binary")
    smaller = sent.repartitionById(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_columns(width), "bucket int, part int, segments binary, least binary")
    # Both cogroups read the same exchange of the texts.
    found = hits.unionByName(smaller, allowMissingColumns=True).repartitionById(parts, "part")
    cut = docs.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(_cut(width, n), "doc_id long, doc_key long, n_removed long, spans array<struct<start: long, end: long>>, kept_bytes binary")
    return cut.dropDuplicates(["doc_id", "doc_key"])


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes, and a digest of those that no string of a smaller document covers."""
    docs = table(spark, sf_dir, "documents")
    cut = repeated_bytes(docs).select(F.col("doc_id").alias("cid"), F.col("doc_key").alias("ckey"), "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("cut_sha256"))
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    whole = docs.select("doc_id", row_key("doc_id", "text").alias("doc_key"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole_sha256"))
    return whole.join(cut, F.col("doc_id").eqNullSafe(F.col("cid")) & (F.col("doc_key") == F.col("ckey")), "left").select(
        "doc_id", "n_bytes", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_removed", "n_spans")), F.coalesce("cut_sha256", "whole_sha256").alias("kept_sha256"))


OP5_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS bs FROM documents),
w AS (SELECT doc_id, unnest(bs) AS byte, unnest(range(1, len(bs) + 1)) AS i FROM t),
x AS (SELECT doc_id, i, byte, CASE WHEN count(*) OVER a = 50 THEN md5(string_agg(byte, '') OVER a) END AS h FROM w WINDOW a AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
m AS (SELECT h, min(doc_id) AS least FROM x WHERE h IS NOT NULL GROUP BY h),
s AS (SELECT x.doc_id, x.i, x.byte, coalesce(m.least < x.doc_id, FALSE) AS again FROM x LEFT JOIN m ON m.h = x.h),
c AS (SELECT doc_id, i, byte, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM s),
r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS starts FROM c),
k AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans, coalesce(string_agg(byte, '' ORDER BY i) FILTER (NOT gone), '') AS kept FROM r GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_bytes, 0)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM t LEFT JOIN k USING (doc_id)
"""
