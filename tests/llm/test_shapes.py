"""Url filters, sharding, quality rules, mixing, toxicity and WARC on small and odd inputs."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm.common import stored
from millrace.llm import mixing, quality_rules, sharding, toxicity, url_filters, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- url filters ----------------------------------------------------------------------------------------------------


def verdict(url, rules):
    host = path = ""
    if url and (m := re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url)):
        host, path = m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]
    hits = [(len(h) + len(p), len(h), f"{h}{p}", v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(hits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


@pytest.mark.parametrize("buckets", [1, 3, 16])
def test_url_filters(spark, buckets):
    hosts = ["com", "example.com", "www.example.com", "notexample.com", "EXAMPLE.com", "a.b.net", "net", "x.net:80", "", "é.com", "com.example"]
    urls = [f"http://{h}{p}{t}" for h in hosts for p in ("", "/", "/en/", "/en/a", "/es/x", "/fr/", "/en") for t in ("", "?q=/en/", "#f")] * 2 + [None, "", "no scheme", "://", "http://", "a://b://c/en/"]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, HOST string, part string")
    rules = [*url_filters.RULES, ("b.net", "/", "block"), ("com", "/en", "block")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.filter_urls(df, spark.createDataFrame([*rules, (None, "/", "block")], "host string, path string, verdict string"), buckets=buckets).collect()}
    assert got == {i: verdict(u, rules) for i, u in enumerate(urls)}


def test_url_filters_empty(spark):
    rules = spark.createDataFrame(url_filters.RULES, "host string, path string, verdict string")
    assert url_filters.filter_urls(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0
    one = url_filters.filter_urls(spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string"), rules.limit(0)).collect()
    assert (one[0]["rule"], one[0]["verdict"]) == (None, "allow")


# --- sharding -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("which", ["odd", "sf", "hot"])
def test_sharding(spark, sf, odd_docs, which):
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1500, "the same text again").otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    docs = {"odd": odd_docs, "sf": spark.read.parquet(f"{sf}/documents.parquet"), "hot": hot}[which]
    rows = sharding.shard_documents(docs, n_shards=10).collect()
    assert len(rows) == docs.count()
    by = defaultdict(list)
    for r in rows:
        size = len((r["text"] or "").encode()) + 16
        assert r["size"] == size and r["text_crc32"] == zlib.crc32((r["text"] or "").encode())
        by[r["shard"]].append((r["slot"], size))
    assert all(sorted(s for s, _ in v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(10))
    share, largest = sum(r["size"] for r in rows) / 10, max(r["size"] for r in rows)
    assert all(abs(sum(n for _, n in by[k]) - share) <= largest + 0.11 * share for k in range(10))
    if which == "sf":
        texts = defaultdict(set)
        for r in rows:
            texts[r["text"]].add(r["shard"])
        assert sum(len(s) > 1 for s in texts.values()) == 0


def test_sharding_is_stable_and_empty(spark, sf, no_docs):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    cut = lambda df: sorted(sharding.shard_documents(df).select("doc_id", "shard", "slot").collect())
    assert cut(d) == cut(d.repartition(5)) and sharding.shard_documents(no_docs).count() == 0


# --- quality --------------------------------------------------------------------------------------------------------


def statistics(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("which", ["odd", "sf"])
def test_quality_statistics(spark, sf, odd_docs, which):
    docs = odd_docs if which == "odd" else spark.read.parquet(f"{sf}/documents.parquet")
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality_rules.quality_verdicts(docs).collect())
    want = Counter()
    for r in docs.collect():
        s = statistics(r["text"])
        want[(r["doc_id"], *s, s[0] < 50 or 100 * s[4] > 50 * s[0])] += 1
    assert got == want


def test_quality_empty(no_docs):
    assert quality_rules.quality_verdicts(no_docs).count() == 0


def test_quality_finds_junk(spark):
    sf = "/root/testdata/sf0.01"
    v = quality_rules.op4_quality_rules(spark, sf).where("not base_failed").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in v}
    assert n.get((1, False), 0) <= 0.01 * n[1, True] and n.get((0, True), 0) <= 0.1 * n[0, False]


# --- mixing ---------------------------------------------------------------------------------------------------------


def test_targets():
    sizes = [("a", 1000), ("b", 10), ("c", 500), (None, 90)]
    t = mixing.targets_of(sizes)
    assert t["b"] == 30 and math.isclose(sum(t.values()), 1600) and all(t[s] <= 3 * n for s, n in sizes)
    free = {s: t[s] / w for s, w in (("a", 5), ("c", 1), (None, 5)) if t[s] < 3 * dict(sizes)[s]}
    assert max(free.values()) - min(free.values()) < 1e-6 and mixing.targets_of([]) == {} and mixing.targets_of([("z", 0)]) == {"z": 0}


def test_tree():
    for quotas, shards in (([10, 0, 7], 4), ([1000, 3], 64), ([0], 3)):
        t = mixing.splitting_tree(quotas, shards, 1)
        assert t.sum(axis=0).tolist() == quotas and t.min() >= 0 and t.sum(axis=1).max() - t.sum(axis=1).min() <= 1


@pytest.mark.parametrize("which", ["odd", "sf"])
def test_mixing(spark, sf, odd_docs, which):
    docs = odd_docs if which == "odd" else spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == docs.count()
    size, taken, target, smallest = Counter(), Counter(), {}, {}
    for r in rows:
        n = len(WORD.findall(r["text"] or ""))
        assert r["size"] == n and r["taken"] in (0, n, 2 * n, 3 * n) and sum(n for _ in r["copies"]) == r["taken"]
        size[r["source"]] += n
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        if not r["taken"] and n:
            smallest[r["source"]] = min(n, smallest.get(r["source"], n))
    want = mixing.targets_of(list(size.items()))
    assert all(math.isclose(target[s], want[s], abs_tol=1e-6) for s in size)
    assert all(r["source_size"] == size[r["source"]] for r in rows)
    if which == "sf":
        assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 5 for s in size)


def test_mixing_again(spark, sf, no_docs):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    cut = lambda df: sorted((r["doc_id"], r["taken"], str(r["copies"])) for r in mixing.mix_sources(df).collect())
    assert cut(d) == cut(d.repartition(7)) and mixing.mix_sources(no_docs).count() == 0
    copies = mixing.mixed_copies(mixing.mix_sources(d)).collect()
    assert len(copies) == sum(len(r["copies"]) for r in mixing.mix_sources(d).collect()) and len({(r["doc_id"], r["copy"]) for r in copies}) == len(copies)


# --- toxicity -------------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = toxicity.op8_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    hit = sum(r["predicted"] and r["toxic"] for r in rows)
    assert hit / sum(r["toxic"] for r in rows) > 0.85 and hit / sum(r["predicted"] for r in rows) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) and (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)


def test_toxicity_odd(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(3, 0), (5, 1), (None, 1), (7, None), (5, 1)], "doc_id long, toxic int")
    for docs, known in ((odd_docs, labels), (odd_docs, labels.limit(0)), (no_docs, labels)):
        model = toxicity.fit(docs, known)
        scores = docs.select(toxicity.toxicity_score(model, F.col("text")).alias("s")).collect()
        assert len(scores) == docs.count() and all(0 <= r["s"] <= 1 for r in scores)
    model = toxicity.fit(no_docs, labels)
    bad = spark.createDataFrame([("you IDIOT, you stupid moron, pathetic worthless clown",), ("a calm and friendly sentence",)], "text string").select(toxicity.toxicity_score(model, F.col("text")).alias("s")).collect()
    assert bad[0]["s"] > 0.7 > bad[1]["s"]


def test_label_model_counts_repeated_votes_once():
    rng = np.random.default_rng(2)
    y = rng.random(2000) < 0.2
    good = ((rng.random(2000) < 0.8) & y) | (rng.random(2000) < 0.02)
    votes = np.column_stack([good, good, good, ((rng.random(2000) < 0.7) & y) | (rng.random(2000) < 0.02), rng.random(2000) < 0.3])
    posterior, accuracy, weight = toxicity.label_model(votes, (y ^ (rng.random(2000) < 0.03)).astype(float))
    assert ((posterior > 0.5) == y).mean() > 0.97 and accuracy[0] > 0.8 > accuracy[4] and weight[0] < 0.4 < weight[4]


# --- WARC -----------------------------------------------------------------------------------------------------------


def test_arc_versions():
    for version in (1, 2):
        head = warc.arc_header(version, "x.arc")
        data = head + warc.arc_capture(version, "x.arc", len(head), "http://a b/\n", b"\r\n\r\nbody\n\n") + warc.arc_capture(version, "x.arc", 0, None, b"")
        got = list(warc.parse_arc(data))
        assert [c["payload"] for c in got] == [b"\r\n\r\nbody\n\n", b""] and [c["url"] for c in got] == ["http://a%20b/%0A", "-"] and len(got[0]) == len(warc.ARC_FIELDS[version]) + 3
        with pytest.raises(ValueError):
            list(warc.parse_arc(data[:-5]))
    with pytest.raises(ValueError):
        list(warc.parse_arc(b"filedesc://x 0.0.0.0 1 text/plain 4\n9 0 \n"))


@pytest.mark.parametrize("least", [0, 3])
def test_warc_round_trip(spark, least):
    html = ["<p>one</p>", "<p>one</p>", None, "", "<p>one</p>", "é\r\n\r\nWARC/1.1\r\n", "x" * 300_000, "ab", "ab", "<p>two</p>", "<p>two</p>"]
    ids = [4, 9, 1, 2, None, 3, 5, 6, 7, 8, 8]
    pages = spark.createDataFrame([(i, "http://a/?b c", h, "r") for i, h in zip(ids, html, strict=True)], "page_id long, url string, html string, record_type string")
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_archives(warc.convert_archives(stored(warc.archive_pages(pages), 'arcs'), least_bytes=least)).collect())
    want, newest = Counter(), {}
    for i, h in zip(ids, html, strict=True):
        if i is not None:
            newest[h or ""] = max(i, newest.get(h or "", i))
    for i, h in zip(ids, html, strict=True):
        b = (h or "").encode()
        first = i == newest.get(h or "") or len(b) < least
        want[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first else "revisit", None if first else newest[h or ""]] += 1
    assert got == want


def test_warc_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.convert_archives(warc.archive_pages(none))).count() == 0
    with pytest.raises(ValueError):
        list(warc.parse_warc(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort"))


def test_legacy_archive_of_many_captures(spark):
    """Given dates, types, addresses and ids decide the records; a DNS capture has no HTTP header."""
    page = b"HTTP/1.0 200 OK\r\nX-Page-Id: %d\r\nContent-Length: 5\r\n\r\nhello"
    one, two, dns = page % 7, page % 12, b"20080101\nexample.com. 1 IN A 1.2.3.4\n"
    lines = [(f"dns:example.com 9.9.9.9 200801020304 text/dns {len(dns)}", dns), (f"http://example.com/a 1.2.3.4 20080102030405 text/html {len(one)}", one), (f"http://example.com/b - 20090102030405 text/html {len(two)}", two)]
    data = warc.arc_header(1, "old.arc") + b"".join(h.encode() + b"\n" + b + b"\n" for h, b in lines)
    files = stored(warc.convert_archives(spark.createDataFrame([("old.arc", bytearray(data)), (None, None)], "name string, content binary")), "warcs")
    assert [(r["archive"], r["records"]) for r in files.collect()] == [("old.arc", 3)]
    got = {r["url"]: r for r in warc.read_archives(files).collect()}
    assert {u: (r["record_type"], r["page_id"], r["refers_to"], r["date"], r["payload_bytes"]) for u, r in got.items()} == {
        "dns:example.com": ("resource", None, None, "2008-01-02T03:04:00Z", len(dns)), "http://example.com/a": ("revisit", 7, 12, "2008-01-02T03:04:05Z", 5), "http://example.com/b": ("response", 12, None, "2009-01-02T03:04:05Z", 5)}
    records = [h for h, _ in warc.parse_warc(bytes(files.first()["content"]))]
    assert [h["warc-type"] for h in records] == ["warcinfo", "resource", "revisit", "response"] and records[1]["content-type"] == "text/dns" and records[1]["warc-ip-address"] == "9.9.9.9" and "warc-ip-address" not in records[3]
    assert records[2]["warc-refers-to"] == records[3]["warc-record-id"] and {h["warc-warcinfo-id"] for h in records[1:]} == {records[0]["warc-record-id"]} and records[0]["warc-filename"] == "old.arc"


def test_archives_are_cut(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"page {i % 3} " * 50) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    arcs = stored(warc.archive_pages(pages.repartition(2, "page_id")), "arcs").collect()
    assert len(arcs) == 2 and sum(len(list(warc.parse_arc(bytes(a["content"])))) for a in arcs) == 40
