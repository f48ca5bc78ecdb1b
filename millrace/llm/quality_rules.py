"""Quality rules by robust multivariate outliers, with DataFrame functions only.

Statistics of each text are transformed to a vector. For each language and source the minimum covariance determinant estimate
gives the centre and covariance of the most concentrated three quarters of the vectors: from several fixed starts (medians, moments, spatial
signs) concentration steps are taken until the determinant falls no more, and the start that ends with the least determinant
counts. The estimate of a source is shrunk towards its language's, and that towards the estimate of all, the more the fewer texts it has. A text is
rejected if its Mahalanobis distance is too large.

Quantiles are counts of fine steps, so a group of any size is counted before the shuffle in a bounded table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import SPACE, fresh, stored, table

#: The fixed set of symbol characters.
SYMBOLS = "#*$%&|<>"
#: Names of the vector's parts, and the least standard deviation of each: statistics that hardly vary in a group must not reject texts over trifles.
PARTS = {"length": 0.7, "word_length": 0.08, "symbols": 0.8, "dup_lines": 0.8, "repeats": 0.08}
#: Share of a group's vectors that the estimate rests on, and concentration steps at most (they end when no determinant falls any more).
SUPPORT, ROUNDS = 0.75, 40
#: The logarithm of a determinant that falls by less has settled.
SETTLED = 1e-6
#: Steps of a logarithm of squared distance, and of a statistic, between which a quantile is interpolated.
FINE, FINER = 16, 64
#: Files of a table of groups.
SMALL_FILES = 8
#: Median of the chi-square distribution with as many degrees as PARTS, to scale distances by.
CHI2_MEDIAN = 4.3515
#: Squared distance beyond which a text is rejected (chi-square with 5 degrees: about 2 in 10,000).
CUTOFF = 24.0
#: An estimate counts as many texts as its group has, that of the group above it as this many.
PRIOR = 100
PAIRS = [(i, j) for i in range(len(PARTS)) for j in range(i + 1)]
M, C, L = [f"m_{p}" for p in PARTS], [f"c_{i}_{j}" for i, j in PAIRS], [f"l_{i}_{j}" for i, j in PAIRS]


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` and ``n_repeat_words`` (see ``quality_verdicts``)."""
    text, words, lines, grams, spots = fresh(docs, "text_", "words_", "lines_", "grams_", "spots_")
    white = " \t\n\x0b\x0c\r"
    df = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    df = df.withColumns({
        words: F.filter(F.split(text, SPACE), lambda w: w != ""),
        lines: F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "word_chars": F.length(F.translate(text, white, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
    })
    n = F.size(words)
    df = df.withColumns({
        "n_words": n.cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        grams: F.when(n < 3, F.array().cast("array<struct<h: bigint, i: int>>")).otherwise(
            F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))),
    }).drop(words, lines, text)
    # Windows in order of their hash stand beside their equals; where any are equal, their places in order of place.
    ordered = F.array_sort(grams)
    df = df.withColumn(grams, F.when(F.size(F.array_distinct(F.transform(grams, lambda g: g["h"]))) < F.size(grams), ordered).otherwise(F.slice(grams, 1, 0)))
    m = F.size(grams)
    beside = F.zip_with(F.slice(grams, F.lit(1), F.greatest(m - 1, F.lit(0))), F.slice(grams, F.lit(2), F.greatest(m - 1, F.lit(0))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    df = df.withColumn(spots, F.array_sort(F.array_distinct(F.flatten(F.filter(beside, lambda x: x.isNotNull())))))
    # Each place covers its three words, but for those that the next place covers.
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last"))
    return df.withColumn("n_repeat_words", F.coalesce(F.aggregate(spots, start, step, lambda acc: acc["n"]), F.lit(0).cast("long"))).drop(grams, spots)


def vector() -> dict[str, Column]:
    """The transformed statistics of a text with words."""
    n = F.col("n_words").cast("double")
    return {
        "length": F.log(n),
        "word_length": F.log(F.col("word_chars") / n),
        "symbols": F.log1p(1000 * F.col("n_symbols") / F.col("word_chars")),
        "dup_lines": F.log1p(F.col("n_dup_lines").cast("double")),
        "repeats": F.col("n_repeat_words") / n,
    }


def _kept(small: DataFrame, name: str) -> DataFrame:
    """A table of a row or a few for each group, stored in few files: in very many, their footers alone would make it look too large to be sent to all tasks."""
    return stored(small.repartition(SMALL_FILES), name)


def squared_distance() -> Column:
    """Mahalanobis distance of the vector from the centre ``m_*`` by the lower triangular factor ``l_*`` of the covariance."""
    z: list[Column] = []
    for i, p in enumerate(PARTS):
        left = F.col(p) - F.col(f"m_{p}")
        for k in range(i):
            left = left - F.col(f"l_{i}_{k}") * z[k]
        z.append(left / F.col(f"l_{i}_{i}"))
    return sum((x * x for x in z[1:]), z[0] * z[0])


def _factored(estimate: DataFrame) -> DataFrame:
    """``estimate`` with the Cholesky factor ``l_*`` of its covariance ``c_*``, the variances raised by the least ones, and the logarithm of the determinant."""
    floors = list(PARTS.values())
    for j in range(len(floors)):
        own = F.col(f"c_{j}_{j}") + floors[j] ** 2
        for k in range(j):
            own = own - F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}")
        estimate = estimate.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(own, F.lit(floors[j] ** 2 / 100))))
        for i in range(j + 1, len(floors)):
            x = F.col(f"c_{i}_{j}")
            for k in range(j):
                x = x - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            estimate = estimate.withColumn(f"l_{i}_{j}", x / F.col(f"l_{j}_{j}"))
    return estimate.withColumn("det", 2 * sum((F.log(f"l_{j}_{j}") for j in range(1, len(floors))), F.log("l_0_0")))


def _quantiles(steps: DataFrame, by: list[str], share: float) -> DataFrame:
    """For each ``by`` the ``step`` in which the quantile lies (``limit``), and which part of that step's rows is below it (``part``)."""
    along = Window.partitionBy(*by).orderBy("step")
    counts = steps.groupBy(*by, "step").agg(F.count("*").alias("n")).withColumns({"upto": F.sum("n").over(along), "want": share * F.sum("n").over(Window.partitionBy(*by))})
    return counts.where((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("n") < F.col("want"))).select(*by, F.col("step").alias("limit"), ((F.col("want") - F.col("upto") + F.col("n")) / F.col("n")).alias("part"))


def _medians(rows: DataFrame, name: str, values: dict[str, Column]) -> DataFrame:
    """For each ``grp`` the median of each value."""
    long = rows.select("grp", F.explode(F.array(*(F.struct(F.lit(p).alias("which"), F.floor(x * FINER).alias("step")) for p, x in values.items()))).alias("x")).select("grp", "x.*")
    found = _quantiles(long, ["grp", "which"], 0.5).withColumn("at", (F.col("limit") + F.col("part")) / FINER)
    return _kept(found.groupBy("grp").agg(*(F.max(F.when(F.col("which") == p, F.col("at"))).alias(f"{name}_{p}") for p in values)), f"mcd-{name}")


def _moments(weighted: DataFrame, by: list[str]) -> DataFrame:
    """Centre and covariance of rows with a weight ``w``."""
    names = list(PARTS)
    sums = weighted.groupBy(*by).agg(F.sum("w").alias("sw"), *(F.sum(F.col("w") * F.col(p)).alias(f"s_{p}") for p in names), *(F.sum(F.col("w") * F.col(names[i]) * F.col(names[j])).alias(f"s_{i}_{j}") for i, j in PAIRS))
    mean = {p: F.col(f"s_{p}") / F.col("sw") for p in names}
    return sums.select(*by, *(mean[p].alias(f"m_{p}") for p in names), *((F.col(f"s_{i}_{j}") / F.col("sw") - mean[names[i]] * mean[names[j]]).alias(f"c_{i}_{j}") for i, j in PAIRS))


def _starts(rows: DataFrame) -> DataFrame:
    """The estimates that concentration starts from, ``start`` 0 to 2 for each ``grp``."""
    names = list(PARTS)
    medians = _medians(rows, "med", {p: F.col(p) for p in names})
    near = rows.join(medians, "grp")
    spread = _medians(near, "mad", {p: F.abs(F.col(p) - F.col(f"med_{p}")) for p in names})
    scale = {p: F.sqrt((1.4826 * F.col(f"mad_{p}")) ** 2 + floor**2) for p, floor in PARTS.items()}
    center = [F.col(f"med_{p}").alias(f"m_{p}") for p in names]
    by_median = medians.join(spread, "grp").select("grp", F.lit(0).alias("start"), *center, *((scale[names[i]] ** 2 - PARTS[names[i]] ** 2 if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i, j in PAIRS))
    by_moments = _moments(rows.withColumn("w", F.lit(1.0)), ["grp"]).select("grp", F.lit(1).alias("start"), *M, *C)
    # The directions from the medians, whatever the distances.
    z = {p: (F.col(p) - F.col(f"med_{p}")) / scale[p] for p in names}
    signs = near.join(spread, "grp").withColumn("r2", sum((x * x for x in z.values()), F.lit(1e-9)))
    about = [*(f"med_{p}" for p in names), *(f"mad_{p}" for p in names)]
    by_signs = signs.groupBy("grp", *about).agg(*(F.avg(z[names[i]] * z[names[j]] / F.col("r2")).alias(f"u_{i}_{j}") for i, j in PAIRS)).select(
        "grp", F.lit(2).alias("start"), *center, *((len(names) * F.col(f"u_{i}_{j}") * scale[names[i]] * scale[names[j]]).alias(f"c_{i}_{j}") for i, j in PAIRS))
    return by_median.unionByName(by_moments).unionByName(by_signs)


def _distances(rows: DataFrame, estimate: DataFrame, *more: str) -> DataFrame:
    """``rows`` with their squared distance ``d2`` from each estimate of their group, and its logarithm in steps."""
    joined = rows.join(estimate.select("grp", *more, *M, *L), "grp").withColumn("d2", squared_distance())
    return joined.select(*rows.columns, *more, "d2").withColumn("step", F.floor(F.log(F.col("d2") + 1e-6) * FINE))


def minimum_covariance(rows: DataFrame) -> DataFrame:
    """For each ``grp`` of ``rows`` (with the vector's columns) the centre ``m_*``, covariance ``c_*`` and determinant (``det``, its logarithm) of least determinant among the starts.

    The farthest step that the core takes in counts by the part of it that makes the core exactly ``SUPPORT`` of the group."""
    open_ = _kept(_factored(_starts(rows)), "mcd-starts")
    done: list[DataFrame] = []
    for r in range(ROUNDS):
        far = _distances(rows, open_, "start")
        # Stored, its size is known, and if it is small the rows stay where they are.
        limit = _kept(_quantiles(far, ["grp", "start"], SUPPORT), "mcd-limits")
        core = far.join(limit, ["grp", "start"]).withColumn("w", F.when(F.col("step") < F.col("limit"), 1.0).when(F.col("step") == F.col("limit"), F.col("part")).otherwise(0.0)).where("w > 0")
        before = open_.select("grp", "start", F.col("det").alias("before"))
        new = _kept(_factored(_moments(core, ["grp", "start"])).join(before, ["grp", "start"]), "mcd-estimates")
        # The first step may raise the determinant, as that of a start is of no core.
        falls = F.lit(r == 0) | (F.col("before") - F.col("det") > SETTLED)
        done.append(new.where(~falls))
        open_ = new.where(falls)
        if open_.isEmpty():
            break
    else:
        done.append(open_)
    best = reduce(DataFrame.unionByName, done).groupBy("grp").agg(F.min(F.struct("det", "start", *M, *C)).alias("best"))
    return _kept(best.select("grp", "best.*"), "mcd-best")


def _shrunk(own: DataFrame, above: DataFrame | None) -> DataFrame:
    """Estimates (grp, parent, n, centre, covariance) with their parents' counted as ``PRIOR`` texts."""
    if above is None:
        return own
    n, k = F.col("n"), F.lit(PRIOR)
    names = list(PARTS)
    up = above.select(F.col("grp").alias("parent"), *(F.col(c).alias(f"up_{c}") for c in (*M, *C)))
    gap = {p: F.col(f"m_{p}") - F.col(f"up_m_{p}") for p in names}
    mean = lambda c: (n * F.col(c) + k * F.col(f"up_{c}")) / (n + k)
    return own.join(up, "parent").select("grp", "parent", "n", *(mean(c).alias(c) for c in M), *((mean(f"c_{i}_{j}") + n * k / (n + k) ** 2 * gap[names[i]] * gap[names[j]]).alias(f"c_{i}_{j}") for i, j in PAIRS))


def group_estimates(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From rows with ``grp_0`` (all), ``grp_1`` (language), ``grp_2`` (source of a language): the factored estimate of each group and the ``scale`` by which its squared
    distances are divided to have the chi-square median, both shrunk towards the groups above."""
    path = F.array(*(F.struct(F.col(f"grp_{v}").alias("grp"), F.lit(v).alias("level"), (F.col(f"grp_{v - 1}") if v else F.lit(None).cast("string")).alias("parent")) for v in range(3)))
    rows = vectors.select(F.explode(path).alias("g"), *PARTS).select("g.*", *PARTS)
    slim = rows.select("grp", *PARTS)
    groups = _kept(rows.groupBy("grp", "level", "parent").agg(F.count("*").alias("n")), "mcd-groups")
    found = groups.join(minimum_covariance(slim), "grp")
    shrunk: list[DataFrame] = []
    for v in range(3):
        shrunk.append(_kept(_shrunk(found.where(F.col("level") == v).select("grp", "parent", "n", *M, *C), shrunk[-1] if v else None), "mcd-shrunk"))
    estimates = _kept(_factored(reduce(DataFrame.unionByName, shrunk)), "mcd-factored")
    # A group more concentrated than the chi-square distribution is not judged more strictly for it.
    middle = _quantiles(_distances(slim, estimates), ["grp"], 0.5)
    own = _kept(groups.join(middle, "grp").select("grp", "level", "parent", "n", F.greatest(F.exp((F.col("limit") + F.col("part")) / FINE) / CHI2_MEDIAN, F.lit(1.0)).alias("scale")), "mcd-scales")
    scales = own.where("level = 0").select("grp", "scale")
    for v in (1, 2):
        up = scales.select(F.col("grp").alias("parent"), F.col("scale").alias("up"))
        scales = own.where(F.col("level") == v).join(up, "parent").select("grp", ((F.col("n") * F.col("scale") + PRIOR * F.col("up")) / (F.col("n") + PRIOR)).alias("scale"))
    return estimates, _kept(scales, "mcd-scale")


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance2, kept) of every document.

    Words are runs of anything but ASCII white space. ``word_chars`` counts code points in words, ``n_symbols`` the characters
    of ``#*$%&|<>``, ``n_dup_lines`` lines with a word that equal an earlier one, ``n_repeat_words`` words in
    three-word windows that the text has twice or more. ``base_failed``: under 50 words, or over half of them repeated. Others
    are kept unless their squared distance ``distance2`` from their group's estimate exceeds ``cutoff``.

    A null or empty text has no words and fails; a very long text is taken whole. Null languages and sources are values like others. A group of one
    text is judged nearly by its language's estimate, a large group by its own. Null and repeated ids are results each. An empty table
    gives an empty one. Other columns are ignored, whatever their names.
    """
    base = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_"), F.col(lang_col).cast("string").alias("lang_"), F.col(source_col).cast("string").alias("source_"))
    stats = text_statistics(base, "text_").drop("text_")
    stats = stats.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    stats = stored(stats, "quality-statistics")
    # Length-prefixed, so that no two pairs of names give the same group.
    name = lambda c: F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)))
    named = {"grp_0": F.lit("all"), "grp_1": F.concat(F.lit("language "), name("lang_")), "grp_2": F.concat(F.lit("source "), name("lang_"), F.lit(" "), name("source_"))}
    vectors = stored(stats.where(~F.col("base_failed")).withColumns(vector() | named), "quality-vectors")
    estimates, scales = group_estimates(vectors)
    judged = _distances(vectors.withColumnRenamed("grp_2", "grp"), estimates).join(scales, "grp").withColumn("distance2", F.col("d2") / F.col("scale"))
    out = ["id_", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    failed = stats.where("base_failed").select(*out, F.lit(None).cast("double").alias("distance2"), F.lit(False).alias("kept"))
    return judged.select(*out, "distance2", (F.col("distance2") <= cutoff).alias("kept")).unionByName(failed).withColumnRenamed("id_", id_col)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's statistics and verdict."""
    return quality_verdicts(table(spark, sf_dir, "documents")).drop("distance2")
