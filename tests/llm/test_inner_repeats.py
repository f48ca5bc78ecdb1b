"""Passages that a document holds twice, with the smaller document in another partition."""

from millrace.llm import substring_dedup, suffix_dedup


def words(n, name):
    return " ".join(f"{name}{i}" for i in range(n))


def apart(spark, texts):
    """Each document in a partition of its own."""
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "doc_id long, text string")


def test_inner_repeats(spark):
    p = words(60, "p")
    docs = apart(spark, [f"{words(80, 'q')} {p} {words(80, 'r')}", f"{words(80, 'x')} {p} {words(200, 'y')} {p} {words(80, 'z')}"])
    spans = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in substring_dedup.repeated_passages(docs).collect()}
    assert spans == {1: [(80, 140), (340, 400)]}
    bytes_ = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.repeated_bytes(docs).collect()}
    # Besides the passage, "79 " before it and a space after it are common the first time, "9 " and a space the second.
    assert bytes_ == {1: 2 * len(p) + 4 + 3}
