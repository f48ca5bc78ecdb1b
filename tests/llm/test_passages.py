"""Substring and suffix dedup against brute force."""

import hashlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import substring_dedup, suffix_dedup
from millrace.llm.suffix_dedup import column_classes, range_minima

import numpy as np


def brute(rows, width, split):
    """{(id, text): (items, kept items, removed runs)}; a null id stands after all others."""
    order = {r: split(r[1]) for r in rows}
    least = {}
    for (i, _), items in order.items():
        for k in range(len(items) - width + 1):
            w = tuple(items[k : k + width])
            rank = (i is None, i)
            least[w] = min(least.get(w, rank), rank)
    out = {}
    for (i, t), items in order.items():
        gone = [False] * len(items)
        for k in range(len(items) - width + 1):
            if least[tuple(items[k : k + width])] < (i is None, i):
                gone[k : k + width] = [True] * width
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i, t] = ([x for x, g in zip(items, gone, strict=True) if not g], sum(gone), runs)
    return out


def rows_of(df):
    return {(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()}


@pytest.fixture(params=["odd", "sf"])
def docs(request, spark, sf, odd_docs):
    return odd_docs if request.param == "odd" else spark.read.parquet(f"{sf}/documents.parquet")


def test_passages(docs):
    want = {k: v for k, v in brute(rows_of(docs), 50, lambda t: (t or "").encode().split()).items() if v[1]}
    found = substring_dedup.repeated_passages(docs).collect()
    keys = {r["doc_key"]: (r["doc_id"], r["text"]) for r in docs.select("doc_id", "text", substring_dedup.row_key("doc_id", "text").alias("doc_key")).collect()}
    got = {keys[r["doc_key"]]: (r["kept_text"].encode().split(), r["n_removed"], len(r["spans"])) for r in found}
    assert len(found) == len(got) and got == want


def test_bytes(docs):
    want = {k: v for k, v in brute(rows_of(docs), 50, lambda t: (t or "").encode()).items() if v[1]}
    found = suffix_dedup.repeated_bytes(docs).collect()
    keys = {r["doc_key"]: (r["doc_id"], r["text"]) for r in docs.select("doc_id", "text", suffix_dedup.row_key("doc_id", "text").alias("doc_key")).collect()}
    got = {keys[r["doc_key"]]: (list(r["kept_bytes"]), r["n_removed"], len(r["spans"])) for r in found}
    assert len(found) == len(got) and got == want


def test_queries(spark, sf):
    d = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    words = brute(set(d.items()), 50, lambda t: (t or "").encode().split())
    for r in substring_dedup.op2_substring_dedup(spark, sf).collect():
        kept, removed, _ = words[r["doc_id"], d[r["doc_id"]]]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(d[r["doc_id"]].encode().split()), removed, hashlib.sha256(b" ".join(kept)).hexdigest())
    raw = brute(set(d.items()), 50, lambda t: (t or "").encode())
    for r in suffix_dedup.op5_suffix_dedup(spark, sf).collect():
        kept, removed, runs = raw[r["doc_id"], d[r["doc_id"]]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(d[r["doc_id"]].encode()), removed, runs, hashlib.sha256(bytes(kept)).hexdigest())


def test_empty(no_docs):
    assert substring_dedup.repeated_passages(no_docs).count() == 0
    assert suffix_dedup.repeated_bytes(no_docs).count() == 0


def test_width_is_checked(no_docs):
    with pytest.raises(ValueError):
        suffix_dedup.repeated_bytes(no_docs, width=20)


def test_partitioning_does_not_matter(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    cols = ["doc_id", "n_removed", F.sha2("kept_text", 256).alias("h")]
    one = sorted(substring_dedup.repeated_passages(d, buckets=1).select(*cols).collect())
    assert one == sorted(substring_dedup.repeated_passages(d, buckets=7).select(*cols).collect())


def test_range_minima():
    x = np.array([5, 3, 8, 1, 9, 2], dtype=np.uint8)
    lo, hi = np.array([0, 1, 2, 0, 4]), np.array([1, 4, 3, 5, 5])
    assert range_minima(x, lo, hi).tolist() == [min(x[a + 1 : b + 1]) for a, b in zip(lo, hi, strict=True)]


def test_column_classes():
    texts = [b"xxabcdefgh", b"abcdefghyy", b"zabcdefg", b"qabcXefgh"]
    at = [t.index(b"abc") for t in texts]
    size = np.array([len(t) for t in texts])
    got = column_classes(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, size, np.array(at), np.array([4, 3, 2, 1]), 6)
    least = {}
    for t, d in zip(texts, [4, 3, 2, 1], strict=True):
        for k in range(len(t) - 5):
            least[t[k : k + 6]] = min(d, least.get(t[k : k + 6], 9))
    assert got.tolist() == [least[t[k : k + 6]] for t in texts for k in range(len(t) - 5)]


@pytest.mark.parametrize("block", [1, 3, 7, None])
def test_columns_through_files(block):
    """Equal strings share the least id, however the files are cut into blocks."""
    rng, width = np.random.default_rng(1), 6
    for _ in range(12):
        ahead = rng.integers(0, 5, int(rng.integers(1, 60)))
        texts = [bytes(rng.integers(97, 99, int(a)).tolist()) + b"abc" + bytes(rng.integers(97, 100, int(rng.integers(3, 8))).tolist()) for a in ahead]
        ids, size = rng.integers(0, 50, len(texts)), np.array([len(t) for t in texts])
        least = {}
        for t, a, d in zip(texts, ahead, ids, strict=True):
            for k in range(len(t) - width + 1):
                least[t[k : k + width], k - a] = min(d, least.get((t[k : k + width], k - a), 99))
        got = column_classes(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, size, ahead, ids, width, block)
        assert got.tolist() == [least[t[k : k + width], k - a] for t, a in zip(texts, ahead, strict=True) for k in range(len(t) - width + 1)]
