"""Benchmark decontamination by SimHash of item-sized windows.

Benchmark items and document windows of an item's length get a 128-bit SimHash of their word shingles; the k-th time that a
shingle occurs it counts as another shingle, so that repeats weigh. A multi-index over eight blocks of 16 bits finds every
item fingerprint within the radius: a pair within ``RADIUS`` bits differs in at most ``RADIUS // 8`` bits of some block, and each
block is looked up at all values that close. Exact weighted-shingle similarity verifies what the index finds.

Windows in which too few shingles are of any benchmark item of their length cannot reach the similarity with one, and
are not fingerprinted: a bound, which loses nothing. Which item a window resembles is found through the index alone.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import rolling as R
from millrace.llm.anchors import row_key
from millrace.llm.common import fresh, table

#: Bits in which the fingerprints of windows of similarity 0.8 may differ. At that similarity about 19
#: of 128 bits differ, with a standard deviation of about 4: one in some 20,000 differs in more.
RADIUS = 36
LANES, BLOCKS = 2, 8
#: Benchmark text that is indexed, and broadcast, at once; a larger benchmark is taken in several such parts.
INDEX_BYTES = 8 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
MATCHES = "array<struct<item_id: long, similarity: double, start: int, end: int>>"
BITMAP = 1 << 20
#: The index that this Python worker has built last, by the name of its broadcast.
_built: dict[str, Index] = {}


def occurrences(hashes: np.ndarray) -> np.ndarray:
    """Which time each hash occurs, from 0, along each row."""
    order = np.argsort(hashes, axis=1, kind="stable")
    s = np.take_along_axis(hashes, order, axis=1)
    at = np.arange(s.shape[1])
    head = np.where(np.concatenate([np.ones((len(s), 1), bool), s[:, 1:] != s[:, :-1]], axis=1), at, 0)
    out = np.empty_like(order)
    np.put_along_axis(out, order, at - np.maximum.accumulate(head, axis=1), axis=1)
    return out


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    """SimHash (rows x LANES) of each row of shingle hashes: a bit is set where over half of the shingles have it."""
    own = R.mix(hashes ^ R.mix(occurrences(hashes).astype(R.U)))
    out = np.empty((len(hashes), LANES), dtype=R.U)
    for lane in range(LANES):
        h = R.mix(own + R.U(lane))
        bits = np.unpackbits(h.view(np.uint8).reshape(*h.shape, 8), axis=2, bitorder="little").sum(axis=1, dtype=np.int32)
        out[:, lane] = np.packbits(bits * 2 > h.shape[1], axis=1, bitorder="little").view(R.U)[:, 0]
    return out


def masks(bits: int) -> np.ndarray:
    """All 16-bit values with at most so many bits set."""
    return np.array([sum(1 << b for b in c) for k in range(bits + 1) for c in combinations(range(16), k)], dtype=np.int64)


class MultiIndex:
    """Fingerprints by each of their blocks."""

    def __init__(self, fps: np.ndarray, radius: int = RADIUS):
        self.fps, self.radius, self.masks = fps, radius, masks(radius // BLOCKS)
        blocks = fps.view(np.uint16).reshape(len(fps), BLOCKS)
        self.order = [np.argsort(blocks[:, b], kind="stable") for b in range(BLOCKS)]
        self.start = [np.searchsorted(blocks[o, b], np.arange((1 << 16) + 1)) for b, o in enumerate(self.order)]

    def near(self, fp: np.ndarray) -> np.ndarray:
        """Numbers of all fingerprints within the radius."""
        got = []
        for b, value in enumerate(fp.view(np.uint16).astype(np.int64)):
            probe = self.masks ^ value
            lo, hi = self.start[b][probe], self.start[b][probe + 1]
            some = hi > lo
            got.append(self.order[b][R.ranges(lo[some], (hi - lo)[some])])
        found = np.unique(np.concatenate(got))
        return found[np.bitwise_count(self.fps[found] ^ fp).sum(axis=1) <= self.radius]


class Index:
    """Shingles and fingerprints of benchmark items."""

    def __init__(self, items: list[tuple[int | None, str]], width: int, similarity: float):
        self.width, self.similarity, self.items, fps = width, similarity, [], []
        shingles: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item, text in items:
            data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
            starts, ends, _ = R.words(data, np.array([0, len(data)]))
            n = len(starts)
            if not n:
                continue
            w = min(width, n)
            h = R.window_hashes(R.word_hashes(data, starts, ends), w, np.arange(n - w + 1))
            self.items.append((item, n, w, Counter(h.tolist())))
            fps.append(fingerprints(h[None, :]))
            shingles.setdefault(w, []).append((h, n))
        self.near = MultiIndex(np.concatenate(fps) if fps else np.zeros((0, LANES), R.U)).near
        self.known = {}
        for w, own in shingles.items():
            # Distinct shingles, with the lengths of the items that have each.
            pairs = np.unique(np.array([np.concatenate([h for h, _ in own]), np.concatenate([np.full(len(h), n, R.U) for h, n in own])]), axis=1)
            keys, first = np.unique(pairs[0], return_index=True)
            marked = np.zeros(BITMAP, dtype=bool)
            marked[(keys % R.U(BITMAP)).astype(np.int64)] = True
            self.known[w] = keys, marked, np.append(first, pairs.shape[1]), pairs[1].astype(np.int64)

    def matches(self, column) -> list[list[dict]]:
        """For each text the items it holds, each with its best window (words ``start`` to ``end``)."""
        out: list[list[dict]] = [[] for _ in range(len(column))]
        for a, b, offs, data in R.text_slices(column):
            data = LOWER[data]
            starts, ends, first = R.words(data, offs)
            if not len(starts):
                continue
            h = R.word_hashes(data, starts, ends)
            for w, (keys, marked, first_length, lengths) in self.known.items():
                at = R.in_one_text(first, w)
                if not len(at):
                    continue
                shingles = R.window_hashes(h, w, at)
                maybe = np.flatnonzero(marked[(shingles % R.U(BITMAP)).astype(np.int64)])
                slot = np.minimum(np.searchsorted(keys, shingles[maybe]), len(keys) - 1)
                true = keys[slot] == shingles[maybe]
                hit, slot = maybe[true], slot[true]
                many = first_length[slot + 1] - first_length[slot]
                n, hit = lengths[R.ranges(first_length[slot], many)], np.repeat(hit, many)
                text = np.searchsorted(first, at[hit], "right") - 1
                order = np.lexsort((hit, n, text))
                text, n, hit = text[order], n[order], hit[order]
                cut = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (n[1:] != n[:-1]), [True]))) if len(hit) else np.zeros(1, np.int64)
                # Windows of a text are consecutive in ``shingles``: position p of text t is at lo[t] + p.
                lo = np.searchsorted(at, first)
                for c, d in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    t = int(text[c])
                    self._windows(w, int(n[c]), shingles[lo[t] : lo[t + 1]], hit[c:d] - lo[t], int(first[t + 1] - first[t]), out[a + t])
        for own in out:
            own.sort(key=lambda m: (m["item_id"] is None, m["item_id"], m["start"]))
        return out

    def _windows(self, w: int, n: int, shingles: np.ndarray, at: np.ndarray, n_words: int, out: list[dict]) -> None:
        """Adds the items of ``n`` words and ``w``-word shingles that one text holds; ``at`` has the places of their shingles."""
        best: dict[int, dict] = {}
        size = min(n, n_words)
        mine, theirs = size - w + 1, n - w + 1
        # Overlap m of windows with ``mine`` and ``theirs`` shingles gives m / (mine + theirs - m).
        need = max(1, int(np.ceil(self.similarity * (mine + theirs) / (1 + self.similarity) - 1e-9)))
        if need > min(mine, len(at)):
            return
        left, right = at[: len(at) - need + 1], at[need - 1 :]
        close = right - left < mine
        lo, hi = np.maximum(right[close] - mine + 1, 0), np.minimum(left[close], n_words - size)
        starts = np.unique(R.ranges(lo[lo <= hi], (hi - lo + 1)[lo <= hi]))
        # Of equal windows the first counts.
        starts = starts[np.sort(np.unique(R.window_hashes(shingles, mine, starts), return_index=True)[1])]
        for some in (starts[i : i + 256] for i in range(0, len(starts), 256)):
            own = shingles[some[:, None] + np.arange(mine)]
            for s, fp, window in zip(some.tolist(), fingerprints(own), own, strict=True):
                counts = None
                for i in self.near(fp).tolist():
                    item, length, width, wanted = self.items[i]
                    if length != n or width != w:
                        continue
                    counts = counts or Counter(window.tolist())
                    both = sum(min(c, wanted[x]) for x, c in counts.items() if x in wanted)
                    alike = both / (mine + theirs - both)
                    if alike >= self.similarity and (i not in best or alike > best[i]["similarity"]):
                        best[i] = {"item_id": item, "similarity": alike, "start": s, "end": s + size}
        out += best.values()


def _finder(name: str, rows, width: int, similarity: float):
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))

    def find(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if name not in _built:
            _built.clear()
            _built[name] = Index(rows.value, width, similarity)
        for x in texts:
            yield pa.array(_built[name].matches(x), kind)

    return find


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, text: Column, width: int = 5, similarity: float = 0.8, item_col: str = "item_id", item_text: str = "text") -> list[Column]:
    """Columns for ``docs``, one for each part of the benchmark: the items that ``text`` holds, as an array of (item_id, similarity, start, end).

    A-Z are lower-cased; a word is a run of anything but ASCII white space. An item is held where a window of as many words as the
    item has (or the whole text, if shorter) reaches ``similarity``: the weighted Jaccard coefficient of
    their ``width``-word shingles, repeats counted. Items of fewer than ``width`` words are one
    shingle and have to occur as they are. Of several windows the most similar counts, then the first. Fingerprints of windows just at the similarity
    lie beyond ``RADIUS`` about once in 20,000 pairs, and such a pair is not found.

    Null and empty texts, and items without a word, match nothing. A very long text is taken whole, in time proportional to its words. Repeated items are found each.
    An empty table, or an empty benchmark, gives no match. The index goes to the executors in parts of at most ``INDEX_BYTES`` of benchmark
    text (one longer item makes a part of its own).
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = total // INDEX_BYTES + 1
    columns = []
    for p in range(parts):
        own = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p)
        rows = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in own.collect()])
        columns.append(F.arrow_udf(_finder(uuid.uuid4().hex, rows, width, similarity), MATCHES)(text))
    return columns


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each document and benchmark item that it holds: (id, item_id, similarity, start, end). See ``benchmark_matches``.

    Null ids and repeated rows are results each; other columns are ignored, whatever their names. Each part of the benchmark is a pass of its own over the texts."""
    slim = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_"))
    found = [slim.select("id_", m.alias("matches_")).select("id_", F.inline_outer("matches_")).where(F.col("start").isNotNull()) for m in benchmark_matches(slim, benchmark, F.col("text_"), **options)]
    return reduce(DataFrame.unionByName, found).withColumnRenamed("id_", id_col)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item. All columns and repeated rows stay, and so do null and empty texts; an empty table gives an empty one."""
    columns = benchmark_matches(docs, benchmark, F.col(text_col), **options)
    found, key, hit, gone = fresh(docs, "matches", "key", "hit", "gone")
    if len(columns) == 1:
        return docs.withColumn(found, columns[0]).where(F.size(found) == 0).drop(found)
    keyed = docs.withColumn(key, row_key(id_col, text_col))
    held = [keyed.select(F.col(id_col).alias(hit), F.col(key).alias(gone), m.alias(found)).where(F.size(found) > 0).drop(found) for m in columns]
    return keyed.join(reduce(DataFrame.unionByName, held), F.col(id_col).eqNullSafe(F.col(hit)) & (F.col(key) == F.col(gone)), "left_anti").drop(key)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and where it stands."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
