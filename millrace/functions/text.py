"""Text functions on columns, all from built-in expressions. A null text gives a null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import fixed

#: Entities that markup of running text uses; the parser of whole pages knows all.
ENTITIES = (("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&rsquo;", "'"), ("&amp;", "&"))


def any_of(words) -> str:
    """A pattern that matches any of some plain words, the longest first."""
    return "(?:" + "|".join(sorted(words, key=lambda w: -len(w))) + ")"


def clean_ws(s: Column) -> Column:
    """Entities decoded, blanks collapsed, at most one empty line, trimmed; a null gives an empty text."""
    t = F.coalesce(s, F.lit(""))
    for entity, char in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.regexp_replace(F.translate(t, " ’​", " '"), r"[ \t\r\f\x0B]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, " *\n *", "\n"), "\n{3,}", "\n\n"), r"^\s+|\s+$", ""))


def sentences(text: Column) -> Column:
    """Sentences of every line, in order."""
    split = F.transform(F.split(text, "\n"), lambda p: F.split(F.trim(p), r'(?<=[.!?])\s+(?=[A-Z"“(])'))
    return F.filter(F.transform(F.flatten(split), lambda x: F.trim(x)), lambda s: s != "")


def snippet_around(text: Column, needle: Column, width: int = 160) -> Column:
    """The text around the first occurrence of ``needle``, whatever the case; empty where there is none."""
    at = F.position(F.lower(needle), F.lower(text))
    start = F.greatest(at - width, F.lit(1))
    return F.when(at == 0, "").otherwise(F.replace(clean_ws(F.substring(text, start, at - start + F.length(needle) + width)), F.lit("\n"), F.lit(" ")))


def years_in(text: Column) -> Column:
    """Years from 1990 to 2049, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\b(199\d|20[0-4]\d)\b"), F.lit(1)), lambda y: y.cast("int"))


def titlecase_ratio(s: Column) -> Column:
    """Share of the words of two letters or more that begin with a capital."""
    words = F.filter(F.regexp_extract_all(s, F.lit(r"([A-Za-z][A-Za-z'’.-]*)"), F.lit(1)), lambda w: F.length(w) > 1)
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: w.rlike("^[A-Z]"))) / F.size(words)).otherwise(0.0)


def query_terms(query: Column, stop=fixed.QUERY_STOP) -> Column:
    """Significant terms of a search query, in order."""
    q = F.regexp_replace(F.regexp_replace(F.lower(query), r"\bsite:\S+", " "), r"[\"'()]", " ")
    return F.filter(F.regexp_extract_all(q, F.lit(r"([a-z0-9][a-z0-9.\-]+)"), F.lit(1)), lambda t: (F.length(t) > 2) & ~t.isin(*stop))


def capped_count(text: Column, pattern: str, cap: int = 30) -> Column:
    """Matches of a pattern, whatever the case, ``cap`` at most."""
    return F.least(F.regexp_count(text, F.lit(f"(?i){pattern}")), F.lit(cap))


def label_counts(text: Column, lexicon, cap: int = 30) -> Column:
    """struct(label, n) of every label that matches, by count, ties in the lexicon's order."""
    every = F.array(*(F.struct((-capped_count(text, p, cap)).alias("neg"), F.lit(i).alias("at"), F.lit(label).alias("label")) for i, (label, p) in enumerate(lexicon)))
    return F.transform(F.array_sort(F.filter(every, lambda x: x["neg"] < 0)), lambda x: F.struct(x["label"].alias("label"), (-x["neg"]).alias("n")))


def labels_matching(text: Column, lexicon) -> Column:
    """Labels with a match, in the lexicon's order."""
    return F.array_compact(F.array(*(F.when(text.rlike(f"(?i){p}"), label) for label, p in lexicon)))


def first_of(order, labels: Column) -> Column:
    """The first value of a fixed order that an array holds, or null."""
    return F.try_element_at(F.filter(F.array(*map(F.lit, order)), lambda x: F.array_contains(labels, x)), F.lit(1))


def language_sample(text: Column) -> Column:
    """Without urls, addresses, digits and symbols, at most 8000 characters."""
    s = F.regexp_replace(F.coalesce(text, F.lit("")), r"(https?://\S+|\S+@\S+|[\d$€£%]+|[^\p{L}\p{N}_\s'’.,!?-])", " ")
    return F.trim(F.regexp_replace(F.substring(s, 1, 8000), r"\s+", " "))


#: Frequent short words of each language; the share of a text's words that are among them tells languages apart.
FUNCTION_WORDS = {
    "en": "the and of to a in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so what up said",
    "fr": "le la les de des et un une du en est que qui dans pour pas sur au avec ce il plus par sont ne se aux mais comme ou nous vous leur cette elle être fait ont son ses tout aussi",
    "de": "der die und das ist nicht ein eine zu den mit von sich auf für dem im es an als auch werden aus er hat dass sie nach bei einer um am sind noch wie einem über so zum war haben nur oder",
    "es": "el la los las de y que en un una es por con para no se del su al lo como más pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue era muy",
}


def with_language(df: DataFrame, text: Column, lang_attr: Column, name: str = "language", words=None, model=None) -> DataFrame:
    """``df`` with struct(code, confidence): by ``model`` (as ``language.learn_languages`` gives it), or by function words where there is none, with the page's own claim as a hint.

    A sample of under 120 characters, or without any evidence, takes the claim with 0.6 (0.5), or ``und`` with 0. A claim that agrees adds 0.1; an
    unsure other language on a page that claims English is English with 0.78. Built in steps, so that the sample is split once."""
    out = df.withColumns({"sample_": language_sample(text), "attr_": F.element_at(F.split(F.replace(F.lower(F.coalesce(lang_attr, F.lit(""))), F.lit("_"), F.lit("-")), "-"), 1)})
    out = out.withColumn("chars_", F.length("sample_"))
    if model is None:
        words = words or {k: v.split() for k, v in FUNCTION_WORDS.items()}
        among = lambda listed: lambda t: t.isin(*listed)
        out = out.withColumn("tokens_", F.split(F.lower("sample_"), r"[^\p{L}]+"))
        out = out.withColumns({f"hits_{code}": F.size(F.filter("tokens_", among(w))) for code, w in words.items()})
        out = out.withColumn("best_", F.array_max(F.array(*(F.struct(F.col(f"hits_{code}").alias("n"), F.lit(-i).alias("at"), F.lit(code).alias("code")) for i, code in enumerate(words)))))
        total = sum((F.col(f"hits_{code}") for code in words), F.lit(0))
        out = out.withColumns({"none_": total == 0, "share_": F.when(total > 0, F.col("best_.n") / total)})
    else:
        out = model.judged(out, "sample_").withColumn("none_", F.col("grams_") == 0)
    result = lambda code, conf: F.struct(code.alias("code"), conf.cast("double").alias("confidence"))
    attr, best, share = F.col("attr_"), F.col("best_.code"), F.col("share_")
    claim = lambda conf: result(F.when(attr == "", "und").otherwise(attr), F.when(attr == "", 0.0).otherwise(conf))
    found = (
        F.when(F.col("chars_") < 120, claim(0.6))
        .when(F.col("none_"), claim(0.5))
        .when(best == attr, result(best, F.least(F.lit(1.0), share + 0.1)))
        .when((attr == "en") & (share < 0.9), result(F.lit("en"), F.lit(0.78)))
        .otherwise(result(best, share))
    )
    return out.withColumn(name, found).select(*(c for c in df.columns if c != name), name)


def is_listicle(title: Column, snippet: Column, url: Column) -> Column:
    """By the url's pattern, or a title of a list's shape in a marketing context."""
    title, snippet = F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit(""))
    return F.coalesce(url, F.lit("")).rlike(fixed.LISTICLE_URL) | (title.rlike(fixed.LISTICLE_TITLE) & F.concat_ws(" ", title, snippet).rlike(fixed.LISTICLE_CONTEXT))
