"""What the mix owes to the splitting tree, its fill against brute force, and columns with clashing names."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(8)
    rows = [(i, " ".join(["w"] * r.randint(1, 60)), s) for i, s in enumerate(["a"] * 2000 + ["b"] * 900 + ["c"] * 3000 + [None] * 70)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").cache()


def test_weights_hold_over_many_blocks(docs):
    rows = mixing.mix_sources(docs).collect()
    taken, target, size = Counter(), {}, Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    total = sum(size.values())
    assert all(abs(taken[s] - target[s]) <= 1 for s in size) and abs(sum(taken.values()) - total) <= 4
    # By code point a, b, c and the null source last weigh 5, 2, 1, 5; what a small source cannot give goes to the others.
    assert target[None] == 3 * size[None]
    free = {s: target[s] / w for s, w in (("a", 5), ("b", 2), ("c", 1)) if target[s] < 3 * size[s]}
    assert len(free) >= 2 and max(free.values()) - min(free.values()) < 1e-6


def test_copies_come_from_the_tree(docs, monkeypatch):
    whole = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(docs, shards=8).collect()}
    tree = mixing.splitting_tree

    def broken(quotas, shards, seed):
        out = tree(quotas, shards, seed)
        out[-1] = 0
        return out

    monkeypatch.setattr(mixing, "splitting_tree", broken)
    rows = mixing.mix_sources(docs, shards=8).collect()
    assert sum(whole.values()) * 0.8 < sum(r["taken"] for r in rows) < sum(whole.values()) * 0.95
    assert all(r["taken"] <= whole[r["doc_id"]] for r in rows) and all(c["shard"] < 7 for r in rows for c in r["copies"])


def test_shards_take_equal_draws_and_every_copy_once(docs):
    mixed = mixing.mix_sources(docs, shards=8).cache()
    copies = mixing.mixed_copies(mixed).collect()
    want = Counter((r["doc_id"], c["copy"], c["shard"]) for r in mixed.collect() for c in r["copies"])
    assert Counter((r["doc_id"], r["copy"], r["out_shard"]) for r in copies) == want and max(want.values()) == 1
    words = defaultdict(int)
    for r in copies:
        words[r["out_shard"]] += r["size"]
    assert len(words) == 8 and max(words.values()) < 1.35 * min(words.values())
    # The local shuffle leaves no order of ids.
    first = [r["doc_id"] for r in copies if r["out_shard"] == copies[0]["out_shard"]]
    assert sum(a < b for a, b in zip(first, first[1:], strict=False)) < 0.65 * len(first)


def test_fill_is_nearest():
    r = random.Random(3)
    for _ in range(200):
        sizes = [r.randint(0, 40) for _ in range(r.randint(1, 9))]
        want = r.randint(0, sum(sizes) + 5)
        best = min(abs(want - sum(c)) for k in range(len(sizes) + 1) for c in combinations(sizes, k))
        assert abs(want - sum(n for n, t in zip(sizes, mixing._fill(sizes, want), strict=True) if t)) == best
    assert mixing._fill([1_000_000], 900_000) == [True] and mixing._fill([1_000_000], 400_000) == [False]


def test_clashing_names(docs):
    names = ("src", "perm", "block", "whole", "rest", "n_blocks", "psrc", "bsrc", "bblock", "csrc", "cperm", "csize", "draws", "want", "one", "piece", "spot", "leaf_of", "n", "ends", "rank", "full")
    odd = docs.withColumns({n: F.lit(n) for n in names})
    rows = mixing.mix_sources(odd)
    assert sorted((r["doc_id"], r["taken"]) for r in rows.collect()) == sorted((r["doc_id"], r["taken"]) for r in mixing.mix_sources(docs).collect())
    one = mixing.mixed_copies(rows).first()
    assert all(one[n] == n for n in names)
