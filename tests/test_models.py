"""Language model and suffix rules: held-out accuracy, literal cases, odd tables."""

from collections import Counter

import random
import re
import tracemalloc

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.functions import fixed, language, lexicons, text
from millrace.operators import merges, suffixes
from millrace.plans import model_queries
from millrace.plans.queries import SQL


@pytest.fixture(scope="module")
def documents(spark):
    # Short samples, of which word lists know few words.
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 400")
    return d.select("doc_id", "lang", F.expr("substring(text, 100, 170)").alias("text")).cache()


def right(df):
    return df.where("l.code <> 'und'").agg(F.avg((F.col("l.code") == F.col("lang")).cast("double")).alias("a"), F.count("*").alias("n")).first()


def test_held_out_accuracy_against_word_lists(documents):
    model = language.learn_languages(documents.where("doc_id % 5 <> 0"))
    held = documents.where("doc_id % 5 = 0")
    ours, words = (right(text.with_language(held, F.col("text"), F.lit(""), "l", model=m)) for m in (model, None))
    assert ours.n >= words.n > 100 and ours.a >= words.a and ours.a > 0.98


def test_model_is_kept_and_scores_other_scripts(spark, tmp_path):
    rows = [("el", "η γλώσσα των ελλήνων είναι παλιά και όμορφη " * 5), ("en", "the language of the english is plain and old " * 5), ("ru", "язык русских людей старый и красивый " * 5), (None, "nothing"), ("en", None), ("en", "")]
    model = language.learn_languages(spark.createDataFrame(rows, "lang string, text string"))
    model.rows(spark).write.parquet(f"{tmp_path}/model")
    kept = language.LanguageModel.of(spark.read.parquet(f"{tmp_path}/model"))
    assert kept == model and list(model.weights) == ["el", "en", "ru"]
    asked = spark.createDataFrame([("el", "οι έλληνες και η γλώσσα " * 8, ""), ("ru", "люди и русский язык " * 8, "en-GB"), ("en", "short", "EN"), ("und", None, ""), ("und", "1234 " * 50, "")], "want string, text string, attr string")
    got = text.with_language(asked, F.col("text"), F.col("attr"), "l", model=kept).collect()
    assert [(r.want, r.l.code) for r in got] == [(r.want, r.want) for r in got] and got[2].l.confidence == 0.6 and got[0].l.confidence > 0.9
    with pytest.raises(ValueError):
        language.learn_languages(spark.createDataFrame([(None, "x")], "lang string, text string"))


def test_suffix_rules(spark, tmp_path):
    (tmp_path / "list.dat").write_text("// a comment\ncom\nuk\nco.uk  and more\n\n*.ck\n!www.ck\nCOM\n")
    rules = suffixes.read_rules(spark, f"file://{tmp_path}/list.dat")
    assert sorted(r.rule for r in rules.collect()) == ["!www.ck", "*.ck", "co.uk", "com", "uk"]
    cases = {"https://a.b.co.uk/x": "b.co.uk", "x.y.z.ck": "y.z.ck", "www.ck": "www.ck", "a.www.ck": "www.ck", "z.ck": "z.ck", "co.uk": "co.uk", "host": "host", "a.b.zz": "a.b.zz", "1.2.3.4": "1.2.3.4", "ann.mykajabi.com": "ann.mykajabi.com", "www.mykajabi.com": "mykajabi.com", "": "", None: None}
    rows = spark.createDataFrame([(u, 1) for u in cases], "url string, host int")
    got = {r.url: r.domain for r in suffixes.with_registrable_domain(rows, "url", rules).collect()}
    assert got == cases
    assert suffixes.with_registrable_domain(rows.limit(0), "url", rules).count() == 0 and {r.domain for r in suffixes.with_registrable_domain(rows, "url", rules.limit(0)).collect()} >= {"a.b.co.uk", None}
    blocked = spark.createDataFrame([("y.z.ck",)], "domain string")
    kept = merges.admissible(rows.where("url like '%ck'"), blocked, rules=rules)
    assert {r.domain for r in kept.collect()} == {"www.ck", "z.ck"}


def test_literals_that_patterns_need():
    assert lexicons.needed(r"\b(facebook|fb) ads?\b") == {"facebook ads", "facebook ad", "fb ads", "fb ad"} and lexicons.needed(r"kajabi|x\.y") == {"kajabi", "x.y"}
    assert lexicons.needed(r"\d+ (top|best)[a-z]* of") == {" top", " best"} and lexicons.needed(r"a?\w+") is None and lexicons.needed(r"(abc|\d)") is None and lexicons.needed(r"(ab)+c{2}") is not None


def test_every_pattern_is_found_where_it_matches():
    every = tuple((f"{i}", p) for i, (_, p) in enumerate((*fixed.TECH, *fixed.SERVICES, *fixed.ICP, *fixed.NON_AGENCY, *fixed.FUNNEL_TYPES)))
    lex, r = lexicons.Lexicon(every), random.Random(4)
    assert len(lex.always) < len(every) / 10
    words = sorted({w for _, p in every for w in re.findall(r"[a-z]{2,}", p)}) + ["$5k", "10", "-", ".", "'", '"', "(", "&", "É", "ads", "s"]
    for _ in range(400):
        text = "".join(r.choice(words).title() + r.choice([" ", "", "-", ".", "  "]) if r.random() < 0.3 else r.choice(words) + r.choice([" ", "", "-", ".", "/"]) for _ in range(60))
        assert lex.count(text, 30) == [min(30, sum(1 for _ in p.finditer(text))) for p in lex.patterns]


def test_lexicon_columns_with_nulls(spark):
    rows = spark.createDataFrame([("we do Facebook ads and facebook ads",), (None,), ("",)], "t string")
    got = rows.select(lexicons.counts_of(F.col("t"), fixed.SERVICES, 1).alias("n"), lexicons.labels_of(F.col("t"), fixed.SERVICES).alias("l")).collect()
    assert got[0].n[0] == 1 and got[0].l == ["meta ads"] and sum(got[1].n) == 0 and got[2].l == []


def test_trigrams_are_counted_before_they_are_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "fr", "en"]), pa.array(["aaaaaa", "", "aaaab𝔄é"])], ["lang", "sample"])
    got = [r for b in language._counted(iter([batch])) for r in b.to_pylist()]
    want = Counter(sum(ord(c) * m for c, m in zip(t[i : i + 3], language.MIX, strict=True)) % language.BUCKETS for t in ("aaaaaa", "aaaab𝔄é") for i in range(len(t) - 2))
    assert {r["g"]: r["n"] for r in got if r["lang"] == "en"} == want and len(got) == len(want)


def test_a_text_is_scored_by_no_interpreted_fold(spark):
    model = language.LanguageModel({"en": (1,) * language.BUCKETS, "fr": (2,) * language.BUCKETS})
    scored = model.scored(spark.createDataFrame([("abcd",), ("a",), ("",)], "s string"), "s")
    assert "aggregate(" not in scored._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.grams_, r.score_en, r.score_fr) for r in scored.collect()] == [(2, 2, 4), (0, 0, 0), (0, 0, 0)]


def test_a_lexicon_takes_one_text_of_a_batch_at_a_time():
    entries = (("ads", r"\bmeta ads?\b"), ("seo", r"\bseo\b"))
    texts = pa.array([f"Meta ads {i} " + "x" * 4000 for i in range(5000)] + [None, ""])
    tracemalloc.start()
    out = next(lexicons._over(entries, lambda lex, x: lex.count(x, 30), pa.int32())(iter([texts])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.to_pylist() == [[1, 0]] * 5000 + [[0, 0]] * 2
    assert peak < 5e6


def test_more_languages_than_a_task_holds(spark, tmp_path):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "concat(lang, '-', pmod(doc_id, 37)) AS lang", "text")
    d = d.union(d.selectExpr("doc_id + 100000", "nullif(lang, 'de-3')", "concat(text, ' and ', doc_id)")).union(spark.createDataFrame([(-1, None, None), (-2, "", ""), (-3, "xx", "ab"), (-4, "yy", "unlike " * 40)], "doc_id long, lang string, text string"))
    d.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(SQL["language_model"]).fetchall()
    got = [tuple(r) for r in model_queries.language_model(spark, str(tmp_path)).collect()]
    assert len({r[1] for r in want}) > language.LANGUAGES and sorted(got, key=str) == sorted(want, key=str)


def test_a_model_of_many_languages_is_kept(spark, tmp_path):
    rows = [(f"l{i:03}", chr(0x4E00 + i) * 150) for i in range(150)]
    model = language.learn_languages(spark.createDataFrame(rows, "lang string, text string"))
    model.rows(spark).write.parquet(f"{tmp_path}/model")
    kept = language.LanguageModel.of(spark.read.parquet(f"{tmp_path}/model"))
    asked = spark.createDataFrame([*rows, *rows[:1], ("", "short"), ("", None)], "want string, text string")
    got = text.with_language(asked, F.col("text"), F.lit(""), "l", model=kept).collect()
    assert kept.languages == 150 and len(got) == 153 and all(r.l.code == (r.want or "und") for r in got)
    none = text.with_language(asked.limit(0), F.col("text"), F.lit(""), "l", model=kept)
    assert none.count() == 0
