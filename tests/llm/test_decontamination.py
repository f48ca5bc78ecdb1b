"""The Hamming multi-index, and what the result owes to it."""

from collections import Counter

import numpy as np

from millrace.llm import decontamination as D


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 63, (400, 2), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, (400, 2), dtype=np.uint64)
    near = fps[:200].copy()
    for row, flips in zip(near, rng.integers(20, 45, 200), strict=True):
        for bit in rng.choice(128, flips, replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    index = D.MultiIndex(fps)
    sizes = Counter()
    for fp in near:
        want = np.flatnonzero(np.bitwise_count(fps ^ fp).sum(axis=1) <= D.RADIUS)
        assert index.near(fp).tolist() == want.tolist()
        sizes[len(want)] += 1
    assert sizes[1] > 50 and sizes[0] > 20


def test_windows_at_the_similarity_lie_within_the_radius():
    rng, far = np.random.default_rng(4), 0
    for n in (11, 40, 200) * 300:
        common = int(np.ceil(8 * n / 9))
        a = rng.integers(0, 1 << 62, n, dtype=np.uint64)
        b = np.concatenate([a[:common], rng.integers(0, 1 << 62, n - common, dtype=np.uint64)])
        far += int(np.bitwise_count(D.fingerprints(a[None, :]) ^ D.fingerprints(b[None, :])).sum()) > D.RADIUS
    assert far <= 1


def test_repeats_count_as_others():
    h = np.array([[5, 7, 5, 5, 7], [1, 2, 3, 4, 5]], dtype=np.uint64)
    assert D.occurrences(h).tolist() == [[0, 0, 1, 2, 1], [0] * 5]


def test_items_are_found_through_the_index(monkeypatch):
    text = " ".join(f"w{i}" for i in range(60))
    index = D.Index([(1, " ".join(text.split()[10:40]))], 5, 0.8)
    import pyarrow as pa

    assert [m["item_id"] for m in index.matches(pa.array([text, "other words", None]))[0]] == [1]
    index.near = lambda fp: np.zeros(0, np.int64)
    assert index.matches(pa.array([text])) == [[]]


def test_one_word_very_often():
    import pyarrow as pa

    found = D.Index([(1, "la " * 30)], 5, 0.8).matches(pa.array(["la " * 200_000]))[0]
    assert found == [{"item_id": 1, "similarity": 1.0, "start": 0, "end": 30}]
