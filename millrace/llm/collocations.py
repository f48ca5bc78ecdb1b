"""Collocations by hierarchical pair naming: phrases that are more frequent together than their parts suggest.

Texts are cut into chunks, and a chunk is a sequence of names. A level counts the names' adjacent pairs over all chunks, gives each frequent pair
a global id by a join, and replaces the pairs of the sequences by these ids: a name of level k stands for k words, and is the pair of the names of its first and its last k - 1 words. A
frequent phrase has only frequent parts, so no phrase is lost. The pair is kept as parent pointers: along the left ones lie the counts of all first parts, along the right ones those
of all last parts, and a phrase lies inside the longer ones that point to it.

A chunk asks, with their numbers, for the ids only of words that a bitmap of fixed size says may be frequent; a join then tells. Its distinct pairs it sends once, packed, one row for each hash bucket; the bucket
adds up their numbers, names the frequent ones and answers each chunk with its pairs' ids in the order sent, so that pairs are never rows of their own. Sequences are stored, pairs are not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import rolling as R
from millrace.llm.common import fresh, n_buckets, stored, table

LONGEST, LEAST, SHARE, TOP = 3, 10, 50, 2000
#: Text of a chunk, about; a longer text is a chunk of its own.
CHUNK_BYTES = 4 << 20
#: Bits of the map of frequent names, and of each of the parts in which it is made.
MAP_BITS, PART_BITS = 1 << 25, 1 << 15
#: Packed sequences whose pairs a hash bucket gets, about. The number of buckets follows the input, so that a bucket's memory does not.
BUCKET_BYTES = 4 << 20
#: A language's candidates are ranked in groups of about so many times the rows that are wanted.
GROUP = 10

#: A chunk: its sequence of the numbers of frequent names, and their ids.
SEQUENCE = pa.schema([("chunk", pa.int64()), ("seq", pa.binary()), ("names", pa.binary())])

#: What a bucket finds: frequent pairs (id, left, right, f), and answers to chunks.
COUNTED = pa.schema([*((c, pa.int64()) for c in ("id", "left", "right", "f", "chunk")), ("bucket", pa.int32()), ("found", pa.binary())])

#: ASCII capitals become small letters, and the signs that end a piece line ends; blanks and tabs part words.
SIGNS = np.arange(256, dtype=np.uint8)
SIGNS[65:91] += 32
SIGNS[list(b".,;:!?")] = 10


def sequence(data: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of some texts, the text of each, and which words are the last of their piece."""
    data = SIGNS[data]
    starts, ends, first = R.words(data, offs)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    ended = np.concatenate(([0], np.cumsum((data >= 10) & (data <= 13))))
    last = np.ones(len(starts), bool)
    last[:-1] = (ended[starts[1:]] > ended[ends[:-1]]) | (doc[1:] > doc[:-1])
    letters = data[~((data == 32) | ((data >= 9) & (data <= 13)))]
    at = np.concatenate(([0], np.cumsum(ends - starts)))
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(letters)), doc, last


def _lists(*columns) -> list[pa.Array]:
    """A row of lists."""
    return [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c if isinstance(c, pa.Array) else pa.array(c)) for c in columns]


def _packed(seq: np.ndarray) -> bytes:
    return zstandard.compress(seq.tobytes())


def _chunks(batches: Iterator[pa.RecordBatch], most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Of each chunk: the sequence of its words (numbers from 1; 0 after each piece), and each distinct word of a language with its number of occurrences."""
    base, made = TaskContext.get().partitionId() << 32, 0

    def chunk():
        words = pa.concat_arrays([p[0] for p in parts]).dictionary_encode()
        langs = pa.concat_arrays([p[1] for p in parts]).dictionary_encode()
        last = np.concatenate([p[2] for p in parts])
        key = langs.indices.to_numpy().astype(np.int64) * len(words.dictionary) + words.indices.to_numpy()
        own, code, n = np.unique(key, return_inverse=True, return_counts=True)
        seq = np.zeros(len(code) + int(last.sum()), "<i4")
        seq[np.arange(len(code)) + np.cumsum(last) - last] = code + 1
        names = [d.dictionary.take(pa.array(i)).cast(pa.string()) for d, i in ((langs, own // len(words.dictionary)), (words, own % len(words.dictionary)))]
        return pa.RecordBatch.from_arrays([pa.array([base + made]), pa.array([_packed(seq)], pa.binary()), *_lists(*names, n)], ["chunk", "seq", "lang", "word", "n"])

    parts, size = [], 0
    for batch in batches:
        lang = batch.column(0)
        for a, b, offs, data in R.text_slices(batch.column(1), min(most, R.SLICE_BYTES)):
            words, doc, last = sequence(data, offs)
            if len(words):
                parts.append((words, lang.slice(a, b - a).take(pa.array(doc)).cast(pa.large_string()), last))
                size += len(data)
            if size >= most:
                yield chunk()
                parts, size, made = [], 0, made + 1
    if parts:
        yield chunk()


def _rows(chunk, seq: bytes, keys: list, n, names: list[str]) -> pa.RecordBatch:
    """A chunk as rows: its sequence (code -1), then its distinct names with their numbers from 0."""
    size = len(n)
    whole = [pa.concat_arrays([pa.nulls(1, k.type), k]) for k in (*keys, n)]
    seqs = pa.concat_arrays([pa.array([seq], pa.binary()), pa.nulls(size, pa.binary())])
    return pa.RecordBatch.from_arrays([pa.array(np.full(size + 1, chunk)), pa.array(np.arange(-1, size, dtype=np.int32)), seqs, *whole], ["chunk", "code", "seq", *names, "n"])


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for one in _chunks(batches):
        lang, word, n = (one.column(k).flatten() for k in (2, 3, 4))
        yield _rows(one.column(0)[0].as_py(), one.column(1)[0].as_py(), [lang, word], n, ["lang", "word"])


def _planes(x: np.ndarray) -> bytes:
    """Integers byte by byte: all lowest bytes, then all second ones, ..., as these compress."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _pack(*columns: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(map(_planes, columns)))


def _unpack(packed: bytes, columns: int) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(columns, 8, -1)
    return [np.ascontiguousarray(x.T).reshape(-1).view("<i8") for x in planes]


def _pairs(seq: bytes, names: bytes) -> tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk's sequence of numbers from 1 (0: not frequent) and the ids of these: where two names stand side by side, the number of each such pair from 0, the length of the sequence, and for each distinct pair both ids and its number of occurrences."""
    now, name = np.frombuffer(zstandard.decompress(seq), "<i4"), np.frombuffer(zstandard.decompress(names), "<i8")
    at = np.flatnonzero((now[:-1] > 0) & (now[1:] > 0))
    own, pair, n = np.unique(now[at].astype(np.int64) * (len(name) + 1) + now[at + 1], return_inverse=True, return_counts=True)
    return at, pair, len(now), *(name[x - 1] for x in (own // (len(name) + 1), own % (len(name) + 1))), n


def _by_bucket(left: np.ndarray, right: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of a chunk's distinct pairs by hash bucket and ids, and where each bucket's begin."""
    bucket = (R.mix(R.mix(left.astype(R.U)) + right.astype(R.U)) % R.U(buckets)).astype(np.int64)
    order = np.lexsort((right, left, bucket))
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _pair_rows(buckets: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct pairs of each chunk with their numbers of occurrences, a row for each bucket."""
        for batch in batches:
            for i in range(batch.num_rows):
                *_, left, right, n = _pairs(batch.column(1)[i].as_py(), batch.column(2)[i].as_py())
                order, cut = _by_bucket(left, right, buckets)
                own = np.flatnonzero(np.diff(cut))
                packed = [_pack(np.diff(left[x], prepend=0), right[x], n[x]) for x in (order[cut[b] : cut[b + 1]] for b in own)]
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(np.full(len(own), batch.column(0)[i].as_py(), np.int64)), pa.array(packed, pa.binary())], ["bucket", "chunk", "pairs"])

    return emit


def _count_pairs(least: int, answers: bool):
    def count(rows: pa.Table) -> pa.Table:
        """Of a bucket: a row for each frequent pair, with its id; if ``answers``, then one for each chunk with frequent pairs, with the places of its pairs' ids in the bucket (from 1; 0: not frequent), in the order sent."""
        bucket = rows["bucket"][0].as_py()
        parts = [_unpack(x.as_py(), 3) for x in rows["pairs"]]
        left, right, n = np.concatenate([np.cumsum(p[0]) for p in parts]), *(np.concatenate([p[k] for p in parts]) for k in (1, 2))
        order = np.lexsort((right, left))
        head = np.ones(len(order), bool)
        head[1:] = (np.diff(left[order]) != 0) | (np.diff(right[order]) != 0)
        f = np.add.reduceat(n[order], np.flatnonzero(head))
        often = f >= least
        first = order[head][often]
        ids = (bucket << 32) + np.arange(len(first))
        out = [pa.table([*(pa.array(x) for x in (ids, left[first], right[first], f[often])), pa.nulls(len(ids), pa.int64()), pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.binary())], schema=COUNTED)]
        if answers:
            place = np.zeros(len(order), np.int64)
            place[order] = np.where(often, np.cumsum(often), 0)[np.cumsum(head) - 1]
            found = [(c, _pack(x)) for c, x in zip(rows["chunk"].to_pylist(), np.split(place, np.cumsum([len(p[0]) for p in parts])[:-1]), strict=True) if x.any()]
            k = len(found)
            out.append(pa.table([*[pa.nulls(k, pa.int64())] * 4, pa.array([x[0] for x in found], pa.int64()), pa.array([bucket] * k, pa.int32()), pa.array([x[1] for x in found], pa.binary())], schema=COUNTED))
        return pa.concat_tables(out)

    return count


def _level(chunk: pa.ChunkedArray, then: np.ndarray, code: np.ndarray, name: np.ndarray) -> pa.Table:
    """A chunk's sequence of the names with these numbers (``then`` has them from 1), and their ids."""
    known = np.zeros(max(int(then.max(initial=0)), int(code.max(initial=-1)) + 1) + 1, "<i4")
    known[code + 1] = np.arange(1, len(code) + 1)
    return pa.table([chunk.slice(0, 1), pa.array([_packed(known[then])], pa.binary()), pa.array([_packed(name.astype("<i8"))], pa.binary())], schema=SEQUENCE)


def _renamed_words(whole: pa.Table, ids: pa.Table) -> pa.Table:
    """One chunk's sequence with the numbers of its frequent words, and their ids, from the sequence before and the ids that its words have."""
    if not (whole.num_rows and ids.num_rows):
        return SEQUENCE.empty_table()
    then = np.frombuffer(zstandard.decompress(whole["seq"][0].as_py()), "<i4")
    return _level(whole["chunk"], then, *(ids[k].to_numpy() for k in ("code", "id")))


def _renamed_pairs(buckets: int):
    def emit(whole: pa.Table, answers: pa.Table) -> pa.Table:
        """One chunk's sequence with the numbers of its frequent pairs, and their ids, from the sequence before and the buckets' answers."""
        if not (whole.num_rows and answers.num_rows):
            return SEQUENCE.empty_table()
        at, pair, size, left, right, _ = _pairs(whole["seq"][0].as_py(), whole["names"][0].as_py())
        order, cut = _by_bucket(left, right, buckets)
        ids = np.full(len(order), -1)
        for b, found in zip(answers["bucket"].to_pylist(), answers["found"].to_pylist(), strict=True):
            (place,) = _unpack(found, 1)
            ids[order[cut[b] : cut[b + 1]]] = np.where(place > 0, (b << 32) + place - 1, -1)
        then = np.zeros(size, "<i4")
        then[at] = pair + 1
        code = np.flatnonzero(ids >= 0)
        return _level(whole["chunk"], then, code, ids[code])

    return emit


def _text_hashes(texts: pa.Array) -> np.ndarray:
    texts = texts.cast(pa.large_binary())
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offs[0] : offs[-1]] if texts.buffers()[2] else np.zeros(0, np.uint8)
    return R.word_hashes(data, offs[:-1] - offs[0], offs[1:] - offs[0])


def _word_bits(lang: pa.Array, word: pa.Array) -> np.ndarray:
    return (R.mix(_text_hashes(lang) + R.mix(_text_hashes(word))) % R.U(MAP_BITS)).astype(np.int64)


def _part_of_map(parts: pd.DataFrame) -> pd.DataFrame:
    bits = np.zeros(PART_BITS, bool)
    bits[parts["bit"].to_numpy() % PART_BITS] = True
    return pd.DataFrame({"part": [parts["bit"].iloc[0] // PART_BITS], "bits": [np.packbits(bits).tobytes()]})


def frequent_map(words: DataFrame):
    """A bitmap in which the bits of all ``words`` are set, broadcast: as large for any number of them."""

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_word_bits(batch.column(0), batch.column(1))))], ["bit"])

    parts = words.select("lang", "word").mapInArrow(set_bits, "bit long").distinct().groupBy(F.expr(f"bit div {PART_BITS}")).applyInPandas(_part_of_map, "part long, bits binary").collect()
    whole = np.zeros(MAP_BITS // 8, np.uint8)
    for r in parts:
        whole[r.part * PART_BITS // 8 : (r.part + 1) * PART_BITS // 8] = np.frombuffer(r.bits, np.uint8)
    return words.sparkSession.sparkContext.broadcast(whole)


def _asked(known):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words, with their chunks and their numbers in these, that may be frequent."""
        for batch in batches:
            if batch.num_rows:
                bit = _word_bits(batch.column(2), batch.column(3))
                yield batch.filter(pa.array((known.value[bit >> 3] >> (7 - (bit & 7)) & 1).astype(bool)))

    return emit


def _frequent_words(rows: DataFrame, least: int) -> DataFrame:
    """(id, lang, word, f) of the words that occur at least so often in all chunks. The ids are written down before they are used."""
    counts = rows.groupBy("lang", "word").agg(F.sum("n").alias("f"))
    return stored(counts.where(F.col("f") >= least).select(F.monotonically_increasing_id().alias("id"), "lang", "word", "f"), "names-1")


def _renamed(whole: DataFrame, ids: DataFrame, by, name: str) -> DataFrame:
    """(chunk, seq, names) of the chunks whose sequences are in ``whole``, by what ``ids`` tells of each. One chunk at a time is in a task's memory."""
    return stored(whole.groupBy("chunk").cogroup(ids.groupBy("chunk")).applyInArrow(by, "chunk long, seq binary, names binary"), name)


def _counted(level: DataFrame, buckets: int, least: int, answers: bool, name: str) -> DataFrame:
    """The frequent pairs of all chunks, as in ``COUNTED``, and with ``answers`` what each chunk is told of its own."""
    pairs = level.mapInArrow(_pair_rows(buckets), "bucket int, chunk long, pairs binary").repartitionById(buckets, "bucket")
    return stored(pairs.groupBy("bucket").applyInArrow(_count_pairs(least, answers), "id long, left long, right long, f long, chunk long, bucket int, found binary"), name)


def phrase_tables(docs: DataFrame, lang_col: str, text_col: str, longest: int, least: int) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) with the number of words of each language, and for 1 to ``longest`` words the frequent phrases: (id, lang, words, f, left, right, heads, tails). ``heads`` are the counts of the first 1, 2, ...
    words, ``tails`` those of the last 1, 2, ... words."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    level = stored(rows.mapInArrow(_word_rows, "chunk long, code int, seq binary, lang string, word string, n long"), "chunks")
    totals = level.where("code >= 0").groupBy("lang").agg(F.sum("n").alias("n"))
    names = _frequent_words(level.where("code >= 0"), least)
    none = F.array().cast("array<long>")
    tables = [names.select("id", "lang", F.array("word").alias("words"), "f", F.lit(None).cast("long").alias("left"), F.lit(None).cast("long").alias("right"), none.alias("heads"), none.alias("tails"))]
    asked = level.where("code >= 0").select("chunk", "code", "lang", "word").mapInArrow(_asked(frequent_map(names)), "chunk long, code int, lang string, word string")
    level = _renamed(level.where("code < 0").select("chunk", "seq"), asked.join(names, ["lang", "word"]).select("chunk", "code", "id"), _renamed_words, "named-1")
    for k in range(2, longest + 1):
        buckets = max(n_buckets(docs.sparkSession, None), (level.agg(F.sum(F.octet_length("seq"))).first()[0] or 0) // BUCKET_BYTES + 1)
        counted = _counted(level, buckets, least, k < longest, f"names-{k}")
        names = counted.where("chunk is null").select("id", "left", "right", "f")
        parent = tables[-1]
        left = parent.select(F.col("id").alias("left"), "lang", F.col("words").alias("first"), F.concat("heads", F.array("f")).alias("heads"))
        right = parent.select(F.col("id").alias("right"), F.element_at("words", -1).alias("last"), F.concat("tails", F.array("f")).alias("tails"))
        whole = names.join(left, "left").join(right, "right")
        tables.append(stored(whole.select("id", "lang", F.concat("first", F.array("last")).alias("words"), "f", "left", "right", "heads", "tails"), f"phrases-{k}"))
        if k < longest:
            # The pairs are made again from the sequences, which are smaller than they.
            level = _renamed(level, counted.where("chunk is not null").select("chunk", "bucket", "found"), _renamed_pairs(buckets), f"named-{k}")
    return totals, tables


def weakest_cut(size: int) -> Column:
    """struct(score, k, l, r) of the cut of a phrase of ``size`` words with the lowest score, the first of equals; in decimals of 38 digits, exactly."""

    def cut(k: int) -> Column:
        wide = {"a": "cast(f as decimal(19, 0))", "l": f"cast(heads[{k - 1}] as decimal(19, 0))", "r": f"cast(tails[{size - k - 1}] as decimal(19, 0))"}
        score = F.expr("({a} * {a} * cast(1000000 as decimal(7, 0))) div ({l} * {r})".format(**wide))
        return F.struct(score.alias("score"), F.lit(k).alias("k"), F.expr(f"heads[{k - 1}]").alias("l"), F.expr(f"tails[{size - k - 1}]").alias("r"))

    return F.array_min(F.array(*(cut(k) for k in range(1, size))))


def first_of_groups(rows: DataFrame, group: str, order: list[Column], key: Column, top: int) -> DataFrame:
    """The first ``top`` rows of each group with their ``rank``. A group of any size is ranked in salted parts, until what their first rows leave fits one part; ``key`` tells a group's rows apart."""
    salt, n = fresh(rows, "salt", "n")
    while True:
        most = rows.groupBy(group).agg(F.count("*").alias(n)).agg(F.max(n)).first()[0] or 0
        if most <= GROUP * top:
            break
        salted = rows.withColumn(salt, F.pmod(F.xxhash64(key), F.lit(most // (GROUP * top) + 1)))
        ranked = salted.withColumn(n, F.row_number().over(Window.partitionBy(group, salt).orderBy(*order)))
        rows = stored(ranked.where(F.col(n) <= top).drop(salt, n), "firsts")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of two to ``longest`` words of each language, by score.

    A phrase that occurs ``a`` times (``least`` or more) scores 1,000,000 a a / (l r), floored, at the cut into two parts (l and r times) where that is lowest. It is left out where a
    longer phrase of at least ``share`` percent of its count holds it. ``n`` counts the language's words. ASCII letters are lower-cased, phrases stay within pieces of ``[.,;:!?]`` and lines.

    Null and empty texts have no words; a null language is ``und``; repeated rows count as often as they are there; ties are ordered by count, then by the phrase's bytes. A text of any length is taken whole, as one chunk. An empty table gives an empty one;
    other columns are ignored. Counts are 64-bit and products decimals of 38 digits; beyond these Spark raises an error.
    """
    totals, tables = phrase_tables(docs, lang_col, text_col, longest, least)
    found = None
    for k, phrases in enumerate(tables[1:], 2):
        if k < longest:
            # Of the phrases that hold this one, those with one word more are the most frequent.
            within = tables[k].select(F.explode(F.array("left", "right")).alias("id"), F.col("f").alias("longer")).groupBy("id").agg(F.max("longer").alias("longer"))
            phrases = phrases.join(within, "id", "left").where(f"longer is null or 100 * longer < {share} * f")
        one = phrases.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), weakest_cut(k).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        found = one if found is None else found.unionByName(one)
    ranked = first_of_groups(stored(found, "candidates"), "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], F.col("phrase"), top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language of ``documents``."""
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents WHERE text IS NOT NULL),
words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS (SELECT lang, w[i : i + k - 1] AS g FROM words, range(1, {LONGEST + 1}) t(k), unnest(range(1, len(w) - k + 2)) u(i)),
counts AS MATERIALIZED (SELECT lang, g, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}),
cuts AS (SELECT c.lang, c.g, c.f AS a, k, l.f AS l, r.f AS r, 1000000::HUGEINT * c.f * c.f // (l.f::HUGEINT * r.f) AS score FROM counts c, unnest(range(1, len(c.g))) t(k) JOIN counts l ON l.lang = c.lang AND l.g = c.g[1 : k] JOIN counts r ON r.lang = c.lang AND r.g = c.g[k + 1 : len(c.g)]),
longer AS (SELECT lang, part AS g, max(f) AS f FROM (SELECT lang, f, unnest([g[1 : len(g) - 1], g[2 : len(g)]]) AS part FROM counts WHERE len(g) > 2) GROUP BY ALL),
best AS (SELECT lang, g, arg_min({{'a': a, 'l': l, 'r': r, 'score': score}}, (score, k)) AS b FROM cuts GROUP BY lang, g),
ranked AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.b.score DESC, b.b.a DESC, array_to_string(b.g, ' ')) AS rank, array_to_string(b.g, ' ') AS phrase, b.b AS b FROM best b LEFT JOIN longer x ON x.lang = b.lang AND x.g = b.g WHERE x.f IS NULL OR 100 * x.f < {SHARE} * b.b.a)
SELECT lang, rank, phrase, b.a AS a, b.l AS l, b.r AS r, n, b.score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}
"""
