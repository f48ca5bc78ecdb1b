"""SimHash components, near-duplicates and decontamination against brute force."""

from collections import Counter

import pytest
import xxhash

from millrace.llm.components import components
from millrace.llm.decontamination import contaminated, decontaminate
from millrace.llm.simhash_dedup import N_PIVOTS, drop_near_duplicates, fingerprint_links, op10_simhash_dedup, pivot_table, simhash_components


def fingerprint(text, width):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(items, linked):
    root = {i: i for i in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    items = list(items)
    for k, a in enumerate(items):
        for b in items[k + 1 :]:
            if linked(a, b):
                root[find(b)] = find(a)
    return {i: find(i) for i in items}


@pytest.mark.parametrize("which", ["odd", "sf"])
def test_components_of_fingerprints(spark, sf, odd_docs, which):
    docs = odd_docs if which == "odd" else spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    fp = {t: fingerprint(t, 4) for _, t in rows}
    root = groups(set(fp.values()), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for i, t in rows:
        if i is not None:
            least[root[fp[t]]] = min(i, least.get(root[fp[t]], i))
    want = Counter((i, f"{fp[t]:016x}", least.get(root[fp[t]])) for i, t in rows)
    got = Counter((r["doc_id"], r["fp"].hex(), r["component_id"]) for r in simhash_components(docs).collect())
    assert got == want


def test_query_columns(spark, sf):
    q = op10_simhash_dedup(spark, sf)
    assert q.columns == ["doc_id", "fingerprint", "component_id"] and all(len(r["fingerprint"]) == 16 for r in q.collect())


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60, 2)] + [(i + 1, i + 2) for i in range(0, 58, 2)] + [(200, 100), (100, 200), (7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(60)} | {100: 100, 200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark, odd_docs, no_docs):
    kept = drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and drop_near_duplicates(no_docs).count() == 0
    ids = Counter(r["doc_id"] for r in kept.collect())
    # Of the copies 14 and 15, the repeated row 3, and the long texts 12 and 13 one stays; 7, 8, 10 and the null text are empty alike; 9 is 17 twice.
    assert ids[14] == 1 and 15 not in ids and ids[3] == 1 and ids[12] == 1 and 13 not in ids and 7 in ids and 8 not in ids and 10 not in ids
    assert {3, 5, 9, 11, 16} <= set(ids) and 17 not in ids and max(ids.values()) == 1 and None not in ids


def test_similarity_decides(spark):
    base = [f"w{i}" for i in range(200)]
    changed = lambda n: " ".join(f"x{i}" if i < n else w for i, w in enumerate(base))
    docs = spark.createDataFrame([(1, " ".join(base)), (2, changed(10)), (3, changed(90))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in drop_near_duplicates(docs).collect()) == [1, 3]


def brute_matches(docs, items):
    out = {}
    cut = lambda w, k: Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
    for d, t in docs:
        w = (t or "").encode().lower().split()
        for i, s in items:
            b = (s or "").encode().lower().split()
            n, k = min(len(b), len(w)), min(5, len(b))
            if not b or n < k:
                continue
            want = cut(b, k)
            for at in range(len(w) - n + 1):
                own = cut(w[at : at + n], k)
                both = sum((own & want).values())
                alike = both / (sum(own.values()) + sum(want.values()) - both)
                if alike >= 0.8 and alike > out.get((d, i), (0,))[0]:
                    out[d, i] = (alike, at, at + n)
    return out


def test_contamination(spark, odd_docs, no_docs):
    passage = next(r["text"] for r in odd_docs.collect() if r["doc_id"] == 17)
    w = passage.split()
    items = [(1, passage), (2, " ".join(w[10:40])), (3, " ".join(w[:20]) + " other words here"), (4, "one two"), (5, None), (6, ""), (7, "la la la la la la"), (8, " ".join(reversed(w))), (None, " ".join(w[5:30]).upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.where("doc_id is not null and doc_id not in (12, 13)").collect()]
    want = brute_matches(docs, items)
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start"], r["end"]) for r in contaminated(odd_docs.where("doc_id is not null and doc_id not in (12, 13)"), bench).collect()}
    assert got == want and {k[1] for k in want} >= {1, 2, 4, 7, None}
    left = decontaminate(odd_docs, bench)
    assert left.columns == odd_docs.columns and {r["doc_id"] for r in left.collect()} == {None, 7, 8, 10, 11, 12, 13}
    assert contaminated(no_docs, bench).count() == 0 and contaminated(odd_docs, bench.limit(0)).count() == 0


def test_contamination_in_parts(spark, sf, monkeypatch):
    from millrace.llm import decontamination

    d, b = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(contaminated(d, b).collect())
    monkeypatch.setattr(decontamination, "INDEX_BYTES", 3000)
    assert sorted(contaminated(d, b).collect()) == whole
    assert {(r["doc_id"], r["item_id"]) for r in whole} == set(brute_matches([(r["doc_id"], r["text"]) for r in d.collect()], [(r["item_id"], r["text"]) for r in b.collect()]))


def test_links_come_through_the_pivot_table(spark):
    fps = [0, 0b1111, 0b11111 << 20, (1 << 64) - 1, (1 << 64) - 8]
    table = pivot_table(spark.createDataFrame([(bytearray(x.to_bytes(8, "big")),) for x in fps], "fp binary"))
    assert all(len(r["pivots"]) == N_PIVOTS for r in table.collect())
    links = {frozenset((int.from_bytes(r["a"], "big"), int.from_bytes(r["b"], "big"))) for r in fingerprint_links(table).collect()}
    assert links == {frozenset((0, 0b1111)), frozenset(((1 << 64) - 1, (1 << 64) - 8))}
    # With other distances in the table, pairs are discarded before they are verified.
    wrong = table.selectExpr("fp", "case when substring(hex(fp), 16, 1) in ('0', '8') then unhex(repeat('00', 8)) else unhex(repeat('30', 8)) end as pivots")
    assert fingerprint_links(wrong).count() == 0


def test_components_plan_little_and_stop_when_settled(spark, monkeypatch):
    """The driver's memory follows the plans: a half round joins once, and links to roots need no round."""
    from millrace.llm import components as G

    kept = []
    monkeypatch.setattr(G, "stored", lambda df, name, write=G.stored: kept.append((name, df._jdf.queryExecution().optimizedPlan().toString().count("Join"))) or write(df, name))
    stars = [(i * 10 + k, i * 10) for i in range(5) for k in range(1, 5)]
    want = {n: n // 10 * 10 for x in stars for n in x}
    assert {r["node"]: r["root"] for r in components(spark.createDataFrame(stars, "a long, b long")).collect()} == want
    assert [n for n, _ in kept] == ["links"]
    path = [(i, i + 1) for i in range(40)] + [(100, 90), (100, 95), (95, 95), (90, 100)]
    assert {r["node"]: r["root"] for r in components(spark.createDataFrame(path, "a long, b long")).collect()} == {**dict.fromkeys(range(41), 0), 90: 90, 95: 90, 100: 90}
    assert len(kept) > 3 and max(j for _, j in kept) == 1
