"""Languages by character trigrams: a naive Bayes model counted from a table of texts, scored in one pass over a text.

A trigram is one of ``BUCKETS`` by its three code points, so that a language is an array of whole weights (thousandths of a logarithm), every text a sequence of indices into it, and the score an exact
sum. Any script counts. The model's size is that of its languages, whatever the number of texts it is counted from. Up to ``LANGUAGES`` of them go to the tasks as they are; more stay a table, and blocks of languages meet parts of the texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import language_sample
from millrace.sources.shared import stored

BUCKETS, LANGUAGES = 1 << 14, 64
#: Multipliers of a trigram's code points.
MIX = (7919, 104729, 1299709)
#: Neighbouring trigrams share two letters each, so that a letter is evidence three times.
OVERLAP = 3
#: Texts that meet a block of languages at once.
TEXTS = 1024


def trigrams(sample: str) -> np.ndarray:
    """Buckets of a sample's trigrams, in order; letters as they are."""
    p = np.frombuffer(sample.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return (p[:-2] * MIX[0] + p[1:-1] * MIX[1] + p[2:] * MIX[2]) % BUCKETS


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each language of a batch the buckets of its trigrams and their number, one language at a time."""
    for batch in batches:
        rows = sorted(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), key=itemgetter(0))
        for lang, same in groupby(rows, itemgetter(0)):
            n = np.zeros(BUCKETS, np.int64)
            for _, sample in same:
                np.add.at(n, trigrams(sample), 1)
            g = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int32)), pa.array(n[g])], ["lang", "g", "n"])


def _weighed(counts: pa.Table) -> pa.Table:
    """The weights of a language by bucket, from its counts."""
    g, n = counts["g"].to_numpy(), counts["n"].to_pylist()
    every = sum(n) + BUCKETS
    w = np.full(BUCKETS, round(1000 * math.log(1 / every)), np.int32)
    w[g] = [round(1000 * math.log((k + 1) / every)) for k in n]
    return pa.table({"lang": counts["lang"][:1], "weights": pa.array([w], pa.list_(pa.int32()))})


def _judged(texts: pa.Table, models: pa.Table) -> pa.Table:
    """For each text the best language of a block, its score, and the block's share of the evidence as a multiple of that language's; the first of equals."""
    models = models.sort_by("lang")
    langs, out = models["lang"].to_pylist(), []
    table = np.array(models["weights"].combine_chunks().flatten()).reshape(len(langs), BUCKETS).T.astype(np.int64, order="C")
    for row, sample in zip(texts["row_"].to_pylist(), texts["sample"], strict=True):
        g, k = np.unique(trigrams(sample.as_py()), return_counts=True)
        if langs:
            scores = k @ table[g]
            at = scores.argmax()
            out.append((row, k.sum(), -scores[at], langs[at], np.exp((scores - scores[at]) / (1000 * OVERLAP)).sum()))
    return pa.table([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [()] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()), strict=True)], ["row_", "grams", "neg", "code", "mass"])


@dataclass(frozen=True)
class LanguageModel:
    """For each language its weights by bucket."""

    weights: dict[str, tuple[int, ...]]

    def scored(self, df: DataFrame, sample: str) -> DataFrame:
        """``df`` with ``grams_``, the number of the sample's trigrams, and for each language ``score_``, in one pass over the sample."""
        table = np.array(list(self.weights.values()), np.int64)

        def scores(samples: pd.Series) -> pd.Series:
            found = (trigrams(x) for x in samples)
            return pd.Series([[len(g), *table[:, g].sum(axis=1).tolist()] for g in found], dtype=object)

        # Not deterministic, so that several uses of the scores don't read the sample again.
        scored = F.pandas_udf(scores, "array<long>").asNondeterministic()(F.lower(sample))
        out = df.withColumn("scored_", scored)
        return out.withColumns({"grams_": F.get("scored_", F.lit(0)), **{f"score_{code}": F.get("scored_", F.lit(i)) for i, code in enumerate(self.weights, 1)}})

    def best(self) -> Column:
        """struct(n, code) of the highest score, and of equals the first language."""
        return F.array_max(F.array(*(F.struct(F.col(f"score_{code}").alias("n"), F.lit(-i).alias("at"), F.lit(code).alias("code")) for i, code in enumerate(self.weights))))

    def share(self, best: Column) -> Column:
        """The best language's share of the evidence, 0 to 1."""
        return 1 / sum((F.exp((F.col(f"score_{code}") - best) / (1000 * OVERLAP)) for code in self.weights), F.lit(0.0))

    def judged(self, df: DataFrame, sample: str) -> DataFrame:
        """``df`` with ``grams_``, the number of the sample's trigrams, ``best_`` with the ``code`` of the best language, and ``share_``, its share of the evidence."""
        out = self.scored(df, sample).withColumn("best_", self.best())
        return out.withColumn("share_", self.share(F.col("best_.n")))

    def rows(self, spark: SparkSession) -> DataFrame:
        """The model as a table (lang, weights), to be kept."""
        return spark.createDataFrame([(k, list(v)) for k, v in self.weights.items()], "lang string, weights array<int>")

    @staticmethod
    def of(rows: DataFrame) -> LanguageModel | LanguageTable:
        """The model of a table as ``rows`` gives it."""
        n = rows.count()
        if n > LANGUAGES:
            return LanguageTable(rows, n)
        return LanguageModel({r.lang: tuple(r.weights) for r in rows.orderBy("lang").collect()})


@dataclass(frozen=True)
class LanguageTable:
    """A model of more languages than ``LANGUAGES``: the table (lang, weights) itself, of which tasks hold one block of some ``LANGUAGES`` at a time."""

    table: DataFrame
    languages: int

    def judged(self, df: DataFrame, sample: str) -> DataFrame:
        """As ``LanguageModel.judged``. The rows are stored with a number, and their samples meet every block."""
        blocks = math.ceil(self.languages / LANGUAGES)
        rows = stored(df.withColumn("row_", F.monotonically_increasing_id()), "rows")
        texts = rows.select("row_", F.expr(f"row_ div {TEXTS}").alias("part"), F.lower(sample).alias("sample"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        parts = rows.select(F.expr(f"row_ div {TEXTS}").alias("part")).distinct()
        models = self.table.withColumn("block", F.pmod(F.hash("lang"), F.lit(blocks))).crossJoin(F.broadcast(parts))
        found = texts.groupBy("part", "block").cogroup(models.groupBy("part", "block")).applyInArrow(_judged, "row_ long, grams long, neg long, code string, mass double")
        # The best of each block, the best of all first; what a block's languages have of the evidence is carried over to that one's scale.
        each = found.groupBy("row_").agg(F.max("grams").alias("grams_"), F.array_sort(F.collect_list(F.struct("neg", "code", "mass"))).alias("each_"))
        best = F.get("each_", F.lit(0))
        mass = F.aggregate("each_", F.lit(0.0), lambda acc, x: acc + x["mass"] * F.exp((best["neg"] - x["neg"]) / (1000 * OVERLAP)))
        return rows.join(each.select("row_", "grams_", best.alias("best_"), (1 / mass).alias("share_")), "row_").drop("row_")

    def rows(self, spark: SparkSession) -> DataFrame:
        """The model as a table (lang, weights), to be kept."""
        return self.table


def learn_languages(texts: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel | LanguageTable:
    """A model of all languages, of all rows with a language: one aggregate by language and bucket.

    Null and empty texts add nothing, a repeated row counts as often as it is there. Raises ValueError where there is no text with a language."""
    samples = texts.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.lower(language_sample(F.col(text_col))).alias("sample"))
    counted = samples.mapInArrow(_counted, "lang string, g int, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    weights = stored(counted.groupBy("lang").applyInArrow(_weighed, "lang string, weights array<int>"), "languages")
    model = LanguageModel.of(weights)
    if model == LanguageModel({}):
        raise ValueError("no text with a language")
    return model
