"""The minimum covariance determinant, its shrinkage and the verdicts against numpy."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from millrace.llm import quality_rules as Q

NAMES, FLOORS = list(Q.PARTS), np.array(list(Q.PARTS.values()))
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def quantile(step, share):
    values, counts = np.unique(step, return_counts=True)
    upto, want = np.cumsum(counts), share * len(step)
    at = int(np.flatnonzero((upto >= want) & (upto - counts < want))[0])
    return values[at], (want - upto[at] + counts[at]) / counts[at]


def median(x):
    limit, part = quantile(np.floor(x * Q.FINER), 0.5)
    return (limit + part) / Q.FINER


def squared(x, center, cov):
    return np.einsum("ij,jk,ik->i", x - center, np.linalg.inv(cov + np.diag(FLOORS**2)), x - center)


def log_steps(d):
    return np.floor(np.log(d + 1e-6) * Q.FINE)


def determinants(x):
    """Of each start the centre, covariance and log determinant that it ends with."""
    med = np.array([median(c) for c in x.T])
    mad = np.array([median(np.abs(c - m)) for c, m in zip(x.T, med, strict=True)]) * 1.4826
    scale = np.sqrt(mad**2 + FLOORS**2)
    z = (x - med) / scale
    signs = z / np.sqrt((z**2).sum(axis=1) + 1e-9)[:, None]
    out = []
    for center, cov in ((med, np.diag(mad**2)), (x.mean(axis=0), np.cov(x.T, bias=True).reshape(5, 5)), (med, 5 * (signs.T @ signs / len(x)) * scale[:, None] * scale[None, :])):
        before = None
        for r in range(Q.ROUNDS):
            step = log_steps(squared(x, center, cov))
            limit, part = quantile(step, Q.SUPPORT)
            w = np.where(step < limit, 1, np.where(step == limit, part, 0))
            center = (w[:, None] * x).sum(axis=0) / w.sum()
            cov = (w[:, None, None] * x[:, :, None] * x[:, None, :]).sum(axis=0) / w.sum() - np.outer(center, center)
            det = np.linalg.slogdet(cov + np.diag(FLOORS**2))[1]
            if r and before - det <= Q.SETTLED:
                break
            before = det
        out.append((det, center, cov))
    return out


def two_clusters(rng, n):
    x = rng.normal(size=(n, 5)) * [1, 0.2, 1, 1, 0.2] + [5, 1.7, 1, 0, 0.3]
    x[: n // 5] = rng.normal(size=(n // 5, 5)) * 0.3 + [9, 1.2, 5, 4, 0.8]
    return x


def frame(spark, x, groups):
    return spark.createDataFrame([(g, *map(float, v)) for g, v in zip(groups, x, strict=True)], "grp string, " + ", ".join(f"{n} double" for n in NAMES))


def test_least_determinant_of_the_starts(spark):
    rng = np.random.default_rng(5)
    groups = {"a": two_clusters(rng, 400), "b": rng.normal(size=(60, 5)) ** 3, "c": np.ones((3, 5)), "d": np.array([[1.0, 2, 3, 4, 5]])}
    got = {r["grp"]: r for r in Q.minimum_covariance(frame(spark, np.concatenate(list(groups.values())), [g for g, x in groups.items() for _ in x])).collect()}
    for g, x in groups.items():
        ends = determinants(x)
        det, center, cov = min(ends, key=lambda e: e[0])
        assert abs(got[g]["det"] - det) < 1e-6
        assert np.allclose([got[g][f"m_{n}"] for n in NAMES], center, atol=1e-6) and np.allclose([got[g][f"c_{i}_{j}"] for i, j in Q.PAIRS], [cov[i, j] for i, j in Q.PAIRS], atol=1e-6)
    # The starts do not end alike, so that it matters that they are compared.
    assert max(e[0] for e in determinants(groups["b"])) - min(e[0] for e in determinants(groups["b"])) > 1e-3
    # A fifth of the vectors elsewhere do not move the estimate.
    assert abs(got["a"]["m_length"] - 5) < 0.2


def shrink(own, up, n):
    k = Q.PRIOR
    return (n * own[0] + k * up[0]) / (n + k), (n * own[1] + k * up[1]) / (n + k) + n * k / (n + k) ** 2 * np.outer(own[0] - up[0], own[0] - up[0])


def texts():
    r = random.Random(4)
    for i in range(420):
        lang, source = r.choice(["en", "en", "de", None]), r.choice(["a"] * 6 + ["b", None])
        words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(r.randint(40, 200))]
        if i % 25 == 0:
            words = ["#$%&*" * 3 + w for w in words]
        yield i, " ".join(words) + ("\nsame line" * r.randint(0, 2 if i % 40 else 60)), lang, source
    yield 999, "one source alone " + " ".join(f"w{k}" for k in range(60)), "fr", "z"


def test_verdicts(spark):
    rows = list(texts())
    got = {r["doc_id"]: (r["distance2"], r["kept"]) for r in Q.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    x, path = {}, {}
    for i, text, lang, source in rows:
        w = WORD.findall(text)
        grams = defaultdict(list)
        for k in range(len(w) - 2):
            grams[tuple(w[k : k + 3])].append(k)
        repeats = len({j for ks in grams.values() if len(ks) > 1 for k in ks for j in range(k, k + 3)})
        chars, lines = sum(map(len, w)), text.split("\n")
        if len(w) < 50 or 100 * repeats > 50 * len(w):
            assert got[i] == (None, False)
            continue
        x[i] = [np.log(len(w)), np.log(chars / len(w)), np.log1p(1000 * sum(c in Q.SYMBOLS for c in text) / chars), np.log1p(len(lines) - len(set(lines))), repeats / len(w)]
        path[i] = [("all",), ("all", lang), ("all", lang, source)]
    members = defaultdict(list)
    for i, groups in path.items():
        for g in groups:
            members[g].append(i)
    best = {g: min(determinants(np.array([x[i] for i in ids])), key=lambda e: e[0])[1:] for g, ids in members.items()}
    estimate, scale = {}, {}
    for g in sorted(members, key=len):
        own = np.array([x[i] for i in members[g]])
        estimate[g] = shrink(best[g], estimate[g[:-1]], len(own)) if len(g) > 1 else best[g]
    for g in sorted(members, key=len):
        own = np.array([x[i] for i in members[g]])
        limit, part = quantile(log_steps(squared(own, *estimate[g])), 0.5)
        scale[g] = max(1.0, np.exp((limit + part) / Q.FINE) / Q.CHI2_MEDIAN)
        if len(g) > 1:
            scale[g] = (len(own) * scale[g] + Q.PRIOR * scale[g[:-1]]) / (len(own) + Q.PRIOR)
    kept = set()
    for i, groups in path.items():
        g = groups[-1]
        d = squared(np.array([x[i]]), *estimate[g])[0] / scale[g]
        assert got[i][0] == pytest.approx(d, rel=1e-5) and got[i][1] == (d <= Q.CUTOFF)
        kept.add(got[i][1])
    assert kept == {True, False}


def test_label_model_copies_its_votes_twice_at_most():
    import tracemalloc

    import numpy as np

    from millrace.llm.toxicity import label_model

    r = np.random.default_rng(1)
    votes = (r.random((8000, 150)) < 0.03).astype(np.float32)
    tracemalloc.start()
    label_model(votes, (r.random(8000) < 0.1).astype(np.float64), rounds=12)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 3.5 * votes.size * 8


def test_toxicity_fit_makes_few_votes_into_numbers_at_a_time():
    import tracemalloc

    from millrace.llm import toxicity

    r = np.random.default_rng(2)
    given, human = r.random((20_000, 200)) < 0.03, (r.random(20_000) < 0.1).astype(np.float64)
    total, words = given.sum(axis=1).astype(np.float32), np.full(20_000, 90)
    tracemalloc.start()
    posterior, _, _ = toxicity.label_model(given, human, rounds=12)
    toxicity.logistic(lambda part: toxicity.features_of(given[part], total[part], words[part]), posterior, steps=3)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # All votes as numbers of 8 bytes are 32 MB.
    assert most < 12_000_000


def test_toxicity_fit_is_the_same_however_many_rows_at_once(monkeypatch):
    from millrace.llm import toxicity

    r = np.random.default_rng(3)
    given, human = r.random((3000, 40)) < 0.05, (r.random(3000) < 0.1).astype(np.float64)
    total, words = given.sum(axis=1).astype(np.float32), np.full(3000, 90)
    out = []
    for n in (3000, 70):
        monkeypatch.setattr(toxicity, "AT_ONCE", n)
        posterior, accuracy, weight = toxicity.label_model(given, human)
        out.append(np.concatenate([posterior, accuracy, weight, toxicity.logistic(lambda part: toxicity.features_of(given[part], total[part], words[part]), posterior)]))
    assert np.allclose(*out, rtol=1e-9, atol=1e-9)
