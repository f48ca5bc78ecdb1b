"""Which documents may share passages, and where: the exchange of anchors that the dedup operators build on.

An anchor is an item of a document with a hash of its content. The documents of a partition form chunks; of a chunk, each
hash bucket gets one row with the distinct anchor hashes that fall to it, however often the chunk has
them. A bucket finds the anchors that several chunks have; they go back to the chunks as positions, and
from there, by a directory of the chunk, to the documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import rolling as R
from millrace.llm.common import stored

#: Anchors of a chunk, about; a document with more is a chunk of its own.
CHUNK_ANCHORS = 500_000
#: Text of a group of documents, and text whose anchors or windows a hash bucket gets, about. Their numbers follow the input, so that a group's memory does not.
PART_BYTES, BUCKET_BYTES, ROW_BYTES = 6 << 20, 12 << 20, 64
#: Hashes of all anchors of some texts (data, offsets), anchors of each text, and which of them are reference blocks (None: all).
Scan = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray | None]]


def pack_steps(at: np.ndarray) -> tuple[bytes, bytes]:
    """Increasing positions as one or two bytes for each step, and the steps that are too long for that."""
    step = np.diff(at, prepend=0).astype(np.int64)
    kind = np.uint8 if len(at) and at[-1] < 64 * len(at) else np.uint16
    most = np.iinfo(kind).max
    long = np.flatnonzero(step > most)
    head = np.array([len(long), kind().itemsize], dtype="<u4").tobytes()
    return np.minimum(step, most).astype(kind).tobytes(), head + long.astype("<u4").tobytes() + step[long].astype("<i8").tobytes()


def unpack_steps(steps: bytes, rest: bytes) -> np.ndarray:
    n, size = np.frombuffer(rest, "<u4", 2)
    step = np.frombuffer(steps, np.uint8 if size == 1 else np.uint16).astype(np.int64)
    step[np.frombuffer(rest, "<u4", n, 8)] = np.frombuffer(rest, "<i8", n, 8 + 4 * int(n))
    return np.cumsum(step)


class Chunk:
    """Anchors of consecutive documents, numbered through."""

    def __init__(self):
        self.hashes, self.blocks, self.docs, self.n, self.sum = [], [], [], 0, xxhash.xxh64()

    def add(self, ids, keys, hashes: np.ndarray, counts: np.ndarray, blocks: np.ndarray | None) -> None:
        self.sum.update(np.asarray(keys, dtype=np.int64).tobytes())
        self.hashes.append(hashes)
        self.blocks.append(np.ones(len(hashes), bool) if blocks is None else blocks)
        for i, k, c in zip(ids, keys, counts.tolist(), strict=True):
            if c:
                self.docs.append((i, k, self.n, c))
                self.n += c

    def _by_hash(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order of the anchors by hash, their hashes in that order, and where each distinct one begins."""
        h = np.concatenate(self.hashes)
        order = np.argsort(h, kind="stable")
        s = h[order]
        return order, s, np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))

    def key(self) -> int:
        return int(np.array([self.sum.intdigest()], dtype=R.U).view(np.int64)[0])

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, least position and block mark of each distinct anchor."""
        order, s, head = self._by_hash()
        return s[head], order[head], np.logical_or.reduceat(np.concatenate(self.blocks)[order], head)

    def repeated(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the anchors that two documents of this chunk share; least and each further position of the other anchors, those that one
        document has several times, by the further one."""
        order, s, head = self._by_hash()
        doc = np.repeat(np.arange(len(self.docs)), [d[3] for d in self.docs])[order]
        two = np.maximum.reduceat(doc, head) > np.minimum.reduceat(doc, head)
        size = np.diff(np.append(head, len(s)))
        shared = np.sort(order[np.repeat(two, size)])
        further = np.repeat(~two, size)
        further[head] = False
        again = np.column_stack([np.repeat(order[head], size)[further], order[further]])
        return shared, again[np.argsort(again[:, 1], kind="stable")]


def _chunks(batches: Iterator[pa.RecordBatch], scan: Scan) -> Iterator[Chunk]:
    chunk = Chunk()
    for batch in batches:
        ids, keys = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
        for a, b, offs, data in R.text_slices(batch.column(2)):
            chunk.add(ids[a:b], keys[a:b], *scan(data, offs))
            if chunk.n >= CHUNK_ANCHORS:
                yield chunk
                chunk = Chunk()
    if chunk.n:
        yield chunk


def _probes(scan: Scan, buckets: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, scan):
            key, (h, at, block) = chunk.key(), chunk.distinct()
            bucket = (h % R.U(buckets)).astype(np.int32)
            order = np.lexsort((at, bucket))
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            for b in range(buckets):
                own = order[cut[b] : cut[b + 1]]
                if len(own):
                    rows.append((b, key, (h[own] >> R.U(32)).astype("<u4").tobytes(), *pack_steps(at[own]), np.packbits(block[own]).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), *[pa.binary()] * 4), strict=True)], ["bucket", "chunk", "hashes", "steps", "rest", "blocks"])

    return emit


def _directory(scan: Scan):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, scan):
            key, (shared, again) = chunk.key(), chunk.repeated()
            ids, keys, first, n = zip(*chunk.docs, strict=True)
            cut = np.searchsorted(shared, [*first, chunk.n])
            local = [(shared[cut[i] : cut[i + 1]] - first[i]).astype("<u4").tobytes() for i in range(len(first))]
            cut = np.searchsorted(again[:, 1], [*first, chunk.n])
            inner = [(again[cut[i] : cut[i + 1]] - first[i]).astype("<u4").tobytes() for i in range(len(first))]
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(ids), pa.int64()), *(pa.array(c, pa.int64()) for c in (ids, keys, first, n)), pa.array(local, pa.binary()), pa.array(inner, pa.binary())], ["chunk", "doc_id", "doc_key", "first", "n", "local", "inner"])

    return emit


def _match(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: the positions, chunk by chunk, whose anchor is a reference block somewhere and is in another chunk too."""
    h = [np.frombuffer(x, "<u4") for x in pdf["hashes"]]
    sizes = [len(x) for x in h]
    every = np.concatenate(h)
    block = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(pdf["blocks"], sizes, strict=True)]).astype(bool)
    order = np.argsort(every, kind="stable")
    s = every[order]
    head = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    size = np.diff(np.append(head, len(s)))
    hit = (size > 1) & np.logical_or.reduceat(block[order], head)
    found = np.zeros(len(every), dtype=bool)
    found[order[np.repeat(hit, size)]] = True
    out, at = [], 0
    for chunk, steps, rest, n in zip(pdf["chunk"], pdf["steps"], pdf["rest"], sizes, strict=True):
        mine = found[at : at + n]
        if mine.any():
            out.append((chunk, *pack_steps(unpack_steps(steps, rest)[mine])))
        at += n
    return pd.DataFrame(out, columns=["chunk", "steps", "rest"])


def _to_documents(documents: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
    """Hit positions of a chunk, by document. A chunk that wasn't formed twice alike would lose its hits, so it is an error."""
    if not len(documents):
        raise RuntimeError("the documents came in another order when read again; store them first")
    at = np.unique(np.concatenate([unpack_steps(s, r) for s, r in zip(hits["steps"], hits["rest"], strict=True)])) if len(hits) else np.zeros(0, np.int64)
    documents = documents.drop_duplicates(["first"])
    lo, hi = np.searchsorted(at, documents["first"]), np.searchsorted(at, documents["first"] + documents["n"])
    out = []
    for i, k, first, a, b, local, inner in zip(documents["doc_id"], documents["doc_key"], documents["first"], lo, hi, documents["local"], documents["inner"], strict=True):
        if b > a or local:
            own, again = at[a:b] - first, np.frombuffer(inner, "<u4").reshape(-1, 2)
            # A bucket knows the least position of an anchor; the document has the others.
            own = np.concatenate([own, again[np.isin(again[:, 0], own), 1]])
            out.append((i, k, np.union1d(own, np.frombuffer(local, "<u4")).astype("<u4").tobytes()))
    return pd.DataFrame({"doc_id": pd.array([x[0] for x in out], dtype="Int64"), "doc_key": pd.Series([x[1] for x in out], dtype="int64"), "hits": pd.Series([x[2] for x in out], dtype=object)})


def row_key(id_col: str, text_col: str) -> Column:
    """Tells rows of the same id apart; rows equal in both are equal in all results."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, doc_key, text) of the documents."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("doc_key"), F.col(text_col).cast("string").alias("text"))


def measured(docs: DataFrame) -> tuple[int, int]:
    """(groups of documents, hash buckets) for the texts of ``docs``, by their bytes and rows."""
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES)).first()[0] or 0
    return size // PART_BYTES + 1, size // BUCKET_BYTES + 1


def shared_anchors(docs: DataFrame, scan: Scan, parts: int, buckets: int, name: str) -> DataFrame:
    """(doc_id, doc_key, part, hits) of the rows of ``docs`` (as from ``keyed_texts``) with an anchor that another document has too: ``hits``
    are the anchors' numbers in the document (little-endian 32-bit), ``part`` as from ``in_parts``.

    ``docs`` is read twice and must give its rows in the same order each time, as files do;
    where it doesn't, the job fails rather than lose a hit. A third of all rows may share an anchor: its bucket gets it once
    for each chunk.
    """
    probes = docs.mapInArrow(_probes(scan, buckets), "bucket int, chunk long, hashes binary, steps binary, rest binary, blocks binary")
    hits = probes.repartitionById(buckets, "bucket").groupBy("bucket").applyInPandas(_match, "chunk long, steps binary, rest binary")
    directory = docs.mapInArrow(_directory(scan), "chunk long, doc_id long, doc_key long, first long, n long, local binary, inner binary")
    by_doc = directory.repartition(parts, "chunk").groupBy("chunk").cogroup(hits.repartition(parts, "chunk").groupBy("chunk")).applyInPandas(_to_documents, "doc_id long, doc_key long, hits binary")
    return in_parts(stored(by_doc.dropDuplicates(["doc_id", "doc_key"]), f"{name}-hits"), parts)


def in_parts(df: DataFrame, parts: int) -> DataFrame:
    """``df`` with ``part``, one of so many groups of documents by ``doc_key``, and dealt by it."""
    return df.withColumn("part", F.pmod(F.xxhash64("doc_key"), F.lit(parts)).cast("int")).repartitionById(parts, "part")


def with_hits(docs: pa.Table, hits: pa.Table) -> pa.Table:
    """The rows of a group of documents that have hits, with them, in the order of their keys: a shuffle gives rows in any order."""
    known = dict(zip(zip(hits.column("doc_id").to_pylist(), hits.column("doc_key").to_pylist(), strict=True), hits.column("hits").to_pylist(), strict=True))
    keys = docs.column("doc_key").to_pylist()
    own = [known.get(k) for k in zip(docs.column("doc_id").to_pylist(), keys, strict=True)]
    keep = sorted((i for i, x in enumerate(own) if x is not None), key=keys.__getitem__)
    return docs.take(pa.array(keep, pa.int64())).append_column("hits", pa.array([own[i] for i in keep], pa.binary()))
