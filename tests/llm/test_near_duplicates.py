"""Near-duplicates of the pipeline stage against exact similarities."""

import random
from itertools import combinations

import pytest

from millrace.llm.simhash_dedup import drop_near_duplicates


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def kept(rows):
    """Ids that stay if all pairs of 0.8 or more are linked."""
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both / (len(sets[a]) + len(sets[b]) - both) >= 0.8:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return sorted(i for i in root if root[i] == i)


def stays(spark, rows):
    return sorted(r["doc_id"] for r in drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def template_rows(n):
    """Rows on one shared passage, alike by less than 0.8; every fifth has a twin that is alike by more."""
    r, passage, rows = random.Random(1), [f"p{i}" for i in range(300)], []
    for i in range(n):
        own = passage + [f"o{i}_{k}" for k in range(r.randint(40, 60))]
        rows.append((2 * i, " ".join(own)))
        if i % 5 == 0:
            rows.append((2 * i + 1, " ".join([*own[:-8], *(f"t{i}_{k}" for k in range(8))])))
    return rows


@pytest.mark.parametrize("block", [None, 5000])
def test_large_group_below_the_similarity(spark, monkeypatch, block):
    if block:
        from millrace.llm import near_duplicates

        monkeypatch.setattr(near_duplicates, "BLOCK", block)
    rows = template_rows(400)
    want = kept(rows)
    assert len(want) == 400
    assert stays(spark, rows) == want


def test_pairs_at_the_similarity_among_many(spark):
    r, rows, want = random.Random(2), [], []
    for i in range(400):
        text = [f"a{i}_{k}" for k in range(204)]
        # A run of n other words changes n + 4 of 200 shingles: 178 of 222 are in both.
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join([*text[:90], *(f"b{i}_{k}" for k in range(18)), *text[108:]]))]
        want.append(2 * i)
    other = [(1000 + i, " ".join(f"c{r.randrange(10**9)}" for _ in range(12))) for i in range(8000)]
    assert len(shingles(rows[0][1]) & shingles(rows[1][1])) == 178
    assert stays(spark, rows + other) == want + [i for i, _ in other]


def test_repeated_line_and_other_words(spark):
    # The line's shingles are so many times in each text that they decide every bit of a SimHash.
    line = " ".join(f"l{k}" for k in range(7))
    rows = [(i, " ".join([*[line] * 400, *(f"d{i}_{k}" for k in range(400))])) for i in range(4)]
    assert stays(spark, rows) == kept(rows) == [0, 1, 2, 3]


@pytest.mark.parametrize("block", [7, 1000])
def test_large_group_of_copies_in_blocks(spark, monkeypatch, block):
    """Copies of one text with edits of their own: alike with some of the others only, and compared by far fewer than all pairs."""
    from millrace.llm import near_duplicates

    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    met, verified = [], near_duplicates.verified

    def counted(pairs, *rest):
        met.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(near_duplicates, "verified", counted)
    r, base, rows = random.Random(3), [f"w{k}" for k in range(200)], []
    for i in range(120):
        own = list(base)
        for k in r.sample(range(0, 200, 8), r.choice((1, 1, 2, 4))):
            own[k] = f"e{i}_{k}"
        rows.append((i, " ".join(own)))
    assert stays(spark, rows) == kept(rows)
    assert sum(met) < 120 * 119 / 4


def test_group_below_the_similarity_gives_few_pairs(spark, monkeypatch):
    """Sets that share most shingles and stay below the similarity are told apart by their sketches, not as rows."""
    from millrace.llm import near_duplicates

    met, verified = [], near_duplicates.verified

    def counted(pairs, *rest):
        met.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(near_duplicates, "verified", counted)
    r, base, rows = random.Random(4), [f"w{k}" for k in range(146)], []
    for i in range(300):
        own = list(base)
        for k in r.sample(range(4, 142, 6), r.choice((1, 2, 3, 3, 4))):
            own[k] = f"e{i}_{k}"
        rows.append((i, " ".join(own)))
    assert stays(spark, rows) == kept(rows)
    assert sum(met) < 300 * 20


def test_sketches_never_differ_more_than_sets():
    import numpy as np

    from millrace.llm.near_duplicates import sketch

    r = np.random.default_rng(5)
    for n in (0, 1, 30, 400, 5000):
        for both in (0, n // 2, n):
            pool = np.unique(r.integers(0, 1 << 64, 2 * n - both, np.uint64))
            x, y = pool[:n], pool[len(pool) - n :]
            apart = int(np.bitwise_count((sketch(x) ^ sketch(y)).view(np.uint64)).sum())
            assert apart <= len(np.setxor1d(x, y)) and (len(np.setxor1d(x, y)) > 60 or apart >= len(np.setxor1d(x, y)) * 0.6)


def test_near_fingerprints_are_linked_through_the_pivot_table(spark):
    from millrace.llm import near_duplicates

    base = [f"w{k}" for k in range(600)]
    rows = [(0, " ".join(base)), (1, " ".join([*base[:-1], "x"])), (2, " ".join(f"v{k}" for k in range(600))), (3, " ".join([*base[:300], *(f"y{k}" for k in range(300))]))]
    found, pairs = [], near_duplicates.simhash_pairs
    try:
        near_duplicates.simhash_pairs = lambda sets: found.append(pairs(sets)) or found[0]
        assert stays(spark, rows) == kept(rows) == [0, 2, 3]
    finally:
        near_duplicates.simhash_pairs = pairs
    assert found[0].distinct().count() == 1


def test_no_join_goes_through_the_driver(spark, monkeypatch):
    from millrace.llm import components, near_duplicates
    from millrace.sources import shared

    plans = []

    def watched(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return shared.stored(df, name)

    monkeypatch.setattr(near_duplicates, "stored", watched)
    monkeypatch.setattr(components, "stored", watched)
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(n, None) for n in names]
    r = random.Random(8)
    text = [r.choice("abcdefgh") * 3 + str(r.randrange(500)) for _ in range(60)]
    docs = spark.createDataFrame([(i, " ".join([*text[: 59 - i % 3], f"x{i}"])) for i in range(12)], "doc_id long, text string")
    rows = near_duplicates.similar_components(docs).collect()
    assert {x["component_id"] for x in rows} == {0}
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
    assert [spark.conf.get(n, None) for n in names] == before
