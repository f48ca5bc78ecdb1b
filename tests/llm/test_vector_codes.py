"""Vector codes against a plain version, and over odd tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.llm.vector_codes import codebooks_sha256, vector_codes, with_group_sum

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, x int, total int, n int"


def plain(rows, parts, entries, rounds, scale=1024):
    """(id, code, error) of rows (id, vector), and the codebooks, with Python's integers alone."""
    kept = sorted(((i is None, i or 0, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)))
    whole = [(None if null else i, [math.floor(scale * x) for x in v]) for null, i, v in kept]
    width = len(whole[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    book = [[cut(v, p) for _, v in whole[:entries]] for p in range(parts)]

    def best(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), c, strict=True)), j) for j, c in enumerate(book[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            members = [[] for _ in book[p]]
            for _, v in whole:
                members[best(v, p)[1]].append(cut(v, p))
            new.append([[sum(x) // len(m) for x in zip(*m, strict=True)] if m else c for m, c in zip(members, book[p], strict=True)])
        book = new
    out = [(i, "".join(f"{best(v, p)[1]:02x}" for p in range(parts)), sum(best(v, p)[0] for p in range(parts))) for i, v in whole]
    return out, ",".join(str(x) for p in book for c in p for x in c)


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, "c", 1, 2, 3, 4) for i, v, lab in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("scale", [1024, 1 << 20])
def test_against_plain(spark, scale):
    r = random.Random(3)
    rows = [(r.randrange(90), [r.choice([-0.5, -0.001, 0.0, 0.25, r.uniform(-1, 1)]) for _ in range(8)], r.randrange(3)) for _ in range(150)]
    rows += [(7, None, 1), (8, [], 1), (9, [0.1] * 7 + [None], 1), (10, [float("nan")] + [0.0] * 7, 2), (11, [float("inf")] + [0.0] * 7, 2), (None, [0.5] * 8, None), (rows[0][0], rows[0][1], None)]
    f32 = [(i, None if v is None else [x if x is None else float(__import__("numpy").float32(x)) for x in v]) for i, v, _ in rows]
    want, text = plain(f32, 4, 16, 3, scale)
    codes, book = vector_codes(table(spark, rows), parts=4, entries=16, rounds=3, scale=scale)
    assert sorted(map(str, want)) == sorted(str((x.vec_id, x.code, x.error)) for x in codes.collect())
    assert ",".join(map(str, book.ravel().tolist())) == text and len(codebooks_sha256(book)) == 64


def test_group_sums_of_frequent_rare_and_null_groups(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, -1).otherwise(F.col("id")).alias("label"), F.col("id").alias("error"), F.lit(1).alias("n"))
    got = with_group_sum(rows, "label", "error", "label_error")
    assert got.columns == ["label", "error", "n", "label_error"] and got.count() == 5000
    by = {r.label: (r.m, r.k) for r in got.groupBy("label").agg(F.max("label_error").alias("m"), F.countDistinct("label_error").alias("k")).collect()}
    assert by[None] == (sum(range(0, 5000, 3)), 1) and by[-1] == (sum(range(1, 5000, 3)), 1) and by[5] == (5, 1) and len(by) == 2 + len(range(2, 5000, 3))


def test_few_none_and_unequal(spark):
    codes, book = vector_codes(table(spark, [(2, [0.5] * 4, 1), (1, [0.25] * 4, 1), (1, [0.25] * 4, 1)]))
    assert sorted(x.code for x in codes.collect()) == ["00000000", "00000000", "02020202"] and book.shape == (4, 3, 1)
    empty, book = vector_codes(table(spark, [(1, None, 1)]))
    assert empty.columns == ["vec_id", "label", "code", "error"] and empty.count() == 0 and book.size == 0
    for bad in ([(1, [0.5] * 4, 1), (2, [0.5] * 8, 1)], [(1, [0.5] * 6, 1)], [(1, [1e15] * 4, 1)]):
        with pytest.raises(ValueError):
            vector_codes(table(spark, bad))
