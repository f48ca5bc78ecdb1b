"""Collocations against a plain version, exact arithmetic, chunks and ranking in parts."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, longest, least, share, top):
    """Rows of the result for rows (lang, text)."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            totals[lang] += len(w)
            for k in range(1, longest + 1):
                counts[lang].update(w[i : i + k] for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        found = []
        often = [g for g in f if len(g) > 1 and f[g] >= least]
        held = Counter()
        for g in often:
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    held[g[i : i + k]] = max(held[g[i : i + k]], f[g])
        for g in often:
            score, _, left, right = min((1_000_000 * f[g] ** 2 // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            if g not in held or 100 * held[g] < share * f[g]:
                found.append((-score, -f[g], " ".join(g).encode(), left, right))
        out += [(lang, i, g.decode(), -a, left, right, totals[lang], -score) for i, (score, a, g, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(map(repr, out))


def got(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def texts(n, seed):
    r = random.Random(seed)
    vocabulary = ["The", "the", "é", "É", "new", "york", "times", "a", "☃x", "of", "a\x1cb", "\xa0"]
    joins = [" ", "  ", "\t", ", ", ".", "\n", "\x0b", "; ", " ", " ", " "]
    return [(r.choice(["en", "de", None, "und", ""]), "".join(r.choice(vocabulary) + r.choice(joins) for _ in range(r.randint(0, 120)))) for _ in range(n)]


@pytest.mark.parametrize(("longest", "least", "share", "top"), [(2, 1, 50, 50), (3, 3, 50, 2000), (4, 4, 80, 7), (5, 2, 30, 20)])
def test_against_plain(spark, monkeypatch, longest, least, share, top):
    monkeypatch.setattr(C, "GROUP", 2)
    rows = texts(120, longest)
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "lang string, text string, n int, chunk int, phrase string").repartition(4)
    assert got(C.collocations(docs, longest=longest, least=least, share=share, top=top)) == plain(rows, longest, least, share, top)


def test_many_chunks(spark):
    rows = texts(60, 9)
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(1)

    def small(batches):
        yield from C._chunks(batches, 300)

    level = docs.select(F.coalesce("lang", F.lit("und")), F.coalesce("text", F.lit(""))).mapInArrow(small, "chunk long, seq binary, lang array<string>, word array<string>, n array<long>")
    assert level.count() > 20 and level.select("chunk").distinct().count() == level.count()
    words = Counter()
    for r in level.collect():
        words.update({(a, b): n for a, b, n in zip(r.lang, r.word, r.n, strict=True)})
    want = Counter(("und" if lang is None else lang, w) for lang, t in rows for p in re.split(r"[.,;:!?\x0A-\x0D]", t.translate(LOWER)) for w in re.findall(r"[^\x20\x09]+", p))
    assert words == want


def test_scores_are_exact_beyond_64_bits(spark):
    f, left, right = 9_999_999_999_999, 12_345_678_901_234_567, 99_999_999_999_999_999
    cut = spark.createDataFrame([(f, [left, left - 1], [right, right + 7])], "f long, heads array<long>, tails array<long>").select(C.weakest_cut(3).alias("c")).first().c
    a, b = ((1_000_000 * f * f // (x * y), k, x, y) for k, x, y in ((1, left, right + 7), (2, left - 1, right)))
    assert tuple(cut) == min(a, b)


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    rows = [(r.lang, r.text) for r in odd_docs.collect()]
    assert got(C.collocations(odd_docs, least=2)) == plain(rows, 3, 2, 50, 2000)
    assert C.collocations(no_docs).collect() == [] and C.collocations(odd_docs.where("text is null")).collect() == []


def test_ranking_in_parts_is_the_ranking(spark):
    rows = spark.range(20_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 50).alias("score"), F.col("id").cast("string").alias("p"))
    found = C.first_of_groups(rows, "g", [F.desc("score"), F.asc("p")], F.col("p"), 40)
    want = [(g, i, s, p) for g in range(3) for i, (s, p) in enumerate(sorted(((-(x % 50), str(x)) for x in range(20_000) if x % 3 == g))[:40], 1)]
    assert sorted((r.g, r["rank"], -r.score, r.p) for r in found.collect()) == sorted(want)


def test_only_sequences_are_stored_of_pairs(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(C, "stored", lambda df, name, write=C.stored: kept.setdefault(name, write(df, name)))
    rows = texts(60, 5)
    C.phrase_tables(spark.createDataFrame(rows, "lang string, text string"), "lang", "text", 3, 2)
    assert "pairs-2" not in kept and "pairs-3" not in kept
    assert all(kept[f"named-{k}"].groupBy("chunk").count().agg(F.max("count")).first()[0] == 1 for k in (1, 2))


def test_pairs_travel_packed_and_are_never_rows(spark, monkeypatch):
    """Each chunk gives a bucket one row, in one Python pass; the bucket's answers name the chunk's pairs."""
    monkeypatch.setattr(C, "BUCKET_BYTES", 300)
    kept, dealt = {}, []
    monkeypatch.setattr(C, "stored", lambda df, name, write=C.stored: kept.setdefault(name, write(df, name)))
    monkeypatch.setattr(C, "_pair_rows", lambda buckets, rows=C._pair_rows: dealt.append(buckets) or rows(buckets))
    rows = [(lang, t) for lang, t in texts(200, 6) if lang]
    _, tables = C.phrase_tables(spark.createDataFrame(rows, "lang string, text string").repartition(5), "lang", "text", 3, 2)
    want = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text.translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (2, 3):
                want[k].update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    for k in (2, 3):
        assert {(r.lang, *r.words): r.f for r in tables[k - 1].collect()} == {g: f for g, f in want[k].items() if f >= 2}
    assert min(dealt) > 4
    rows = kept["named-1"].mapInArrow(C._pair_rows(dealt[0]), "bucket int, chunk long, pairs binary")
    assert rows.groupBy("chunk", "bucket").count().agg(F.max("count")).first()[0] == 1
    assert rows.count() < sum(len(C._unpack(bytes(r.pairs), 3)[0]) for r in rows.collect())
