"""Near-duplicates by exact Jaccard similarity of shingle sets, whatever the input's size.

The nodes are distinct shingle sets, so texts share one only where their similarity is 1. Two sets of at least the
similarity share a shingle among the first ``n - ceil(similarity * n) + 1`` of each in any one order of all shingles (prefix
filter). The order here is by rarity: first the shingles that no other document has, then by the number of sets that have them. A
set with enough shingles of its own has no candidate and goes no further.

SimHash comes first: the fingerprints of the sets go through a pivot table (``pivots``), and of the pairs within its radius those that have the
similarity join sets. At a similarity of 0.8 some ten of 64 bits differ, so the radius finds a part of the links; the prefixes find the rest, among sets not joined yet.

Two sets are compared only where they share a shingle of their prefixes, what both have from it on is enough for the similarity (sizes and
places tell), and their sketches allow it; only verified links join sets. A sketch is a row of bits, each the parity of the number of shingles that fall to it: a shingle that one set has and the other has not changes one
bit, so sketches differ in no more bits than the sets in shingles. That is a bound and loses no pair. A shingle of few sets gives its pairs. One of many sets compares them with a few of them first, until that links
little; then come the pairs that no link joins so far, the sets cut into blocks. So copies cost what they are in number; sets that share a shingle and stay unlinked still cost a comparison of sketches for each pair, but no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import rolling as R
from millrace.llm.anchors import measured, row_key, shared_anchors
from millrace.llm.common import exchanged_joins, n_buckets, stored
from millrace.llm.components import components
from millrace.llm.pivots import fingerprint_links, majority_bits, pivot_table

#: A shingle of so many sets gives all their pairs; sets of a block of more; sets that all the others of a shingle are compared with in a round.
FEW, BLOCK, STARS = 8, 1000, 4
#: A round must find a link for one in so many of its rows to be followed by another.
WORTH = 10
#: Bits of a sketch.
SKETCH = 512


def shingles(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of some texts, ASCII letters in lower case, and the number each text has; fewer words than ``width`` are one shingle."""
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    starts, ends, first = R.words(data, offs)
    n = np.diff(first)
    counts = np.where(n < width, np.minimum(n, 1), n - width + 1)
    return R.window_hashes(R.word_hashes(data, starts, ends), np.minimum(np.repeat(n, counts), width), R.ranges(first[:-1], counts)), counts


def _scan(width: int):
    def scan(data: np.ndarray, offs: np.ndarray):
        return *shingles(data, offs, width), None

    return scan


def _texts(column, width: int) -> Iterator[np.ndarray]:
    """The shingles' hashes of each text of a column."""
    for _, _, offs, data in R.text_slices(column):
        h, counts = shingles(data, offs, width)
        yield from np.split(h, np.cumsum(counts)[:-1])


def _nodes(width: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [xxhash.xxh3_128_digest(np.unique(h).tobytes()) for h in _texts(batch.column(2), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], ["row", "doc_key", "shingles"])

    return emit


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The parities of the numbers of distinct hashes that fall to each of ``SKETCH`` bits."""
    return np.packbits(np.bincount((hashes % R.U(SKETCH)).astype(np.int64), minlength=SKETCH) & 1).view("<i8")


def _shared_sets(width: int, similarity: float):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each set that may have a candidate: its size, its shingles that other documents have, how many of these its prefix takes (0 or less: not all of its others), its sketch and its SimHash."""
        for batch in batches:
            out, kept = [], [np.zeros(0, R.U)]
            for key, h, hits in zip(batch.column(0).to_pylist(), _texts(batch.column(1), width), batch.column(2).to_pylist(), strict=True):
                every, own = np.unique(h), np.unique(h[np.frombuffer(hits, "<u4")])
                n = len(every)
                prefix = n - int(np.ceil(similarity * n - 1e-9)) + 1
                if n - len(own) < prefix:
                    out.append((key, n, prefix - (n - len(own)), own.view(np.int64), sketch(every)))
                    kept.append(every)
            cols = list(zip(*out, strict=True)) or [[]] * 5
            fps = majority_bits(np.concatenate(kept), np.cumsum([len(x) for x in kept])).astype(">u8")
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((*cols, [x.tobytes() for x in fps]), types, strict=True)], ["node", "size", "takes", "shared", "sketch", "fp"])

    return emit


def _whole(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
    """The columns of a partition."""
    got = list(batches)
    return [np.concatenate([b.column(i).to_numpy() for b in got]) for i in range(got[0].num_columns)] if got else []


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    head = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
    return head, np.diff(np.append(head, len(x)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of shingles that several sets have, with the number of sets; a shingle's rows are all in this partition."""
    for shingle, node, size, rest in [_whole(batches)]:
        order = np.argsort(shingle, kind="stable")
        _, n = _runs(shingle[order])
        n = np.repeat(n, n)
        order, n = order[n > 1], n[n > 1]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shingle[order], node[order], size[order], rest[order], n)], ["shingle", "node", "size", "rest", "sets"])


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of several sets that lie in a set's prefix, the rarest first, with the number of such shingles from each on; a set's rows are all in this partition."""
    for shingle, node, size, rest, sets in [_whole(batches)]:
        order = np.lexsort((shingle, sets, node))
        head, n = _runs(node[order])
        tail = np.repeat(head + n, n) - np.arange(len(order))
        # Shingles that no other set has come before these: the prefix takes so many fewer.
        taken = np.repeat(n, n) - tail < rest[order] + np.repeat(n, n)
        order = order[taken]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shingle[order], node[order], size[order], tail[taken])], ["shingle", "node", "size", "tail"])


def _skip_empty(emit):
    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            yield from emit(iter(got))

    return some


def prefix_rows(sets: DataFrame, buckets: int) -> DataFrame:
    """(node, shingle, size, tail, blocks, own, sketch) of each shingle that the prefixes of several sets have; ``tail`` bounds what the set can share from that shingle on, ``own`` is its block of ``blocks``, 0 of 0 where there are few sets."""
    rows = sets.select(F.explode("shared").alias("shingle"), "node", "size", (F.col("takes") - F.size("shared")).alias("rest"))
    counted = rows.repartition(buckets, "shingle").mapInArrow(_skip_empty(_counted), "shingle long, node long, size long, rest long, sets long")
    prefixes = stored(counted.repartition(buckets, "node").mapInArrow(_skip_empty(_prefixes), "shingle long, node long, size long, tail long"), "prefixes")
    several = prefixes.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.when(F.col("n") <= FEW, 0).otherwise(F.ceil(F.col("n") / BLOCK)).cast("int")
    placed = prefixes.join(several, "shingle").withColumn("blocks", blocks).drop("n").join(sets.select("node", "sketch"), "node")
    return placed.withColumn("own", F.when(F.col("blocks") == 0, 0).otherwise(F.pmod(F.xxhash64("node"), F.col("blocks"))).cast("int"))


def _may_reach(x: str, y: str, similarity: float) -> Column:
    """Whether two sets can have the similarity if the shingle they met by is the first that both have, and by their sketches."""
    sizes = F.col(f"{x}.size") + F.col(f"{y}.size")
    apart = sum((F.bit_count(F.get(f"{x}.sketch", F.lit(i)).bitwiseXOR(F.get(f"{y}.sketch", F.lit(i)))) for i in range(1, SKETCH // 64)), F.bit_count(F.get(f"{x}.sketch", F.lit(0)).bitwiseXOR(F.get(f"{y}.sketch", F.lit(0)))))
    return (F.least(f"{x}.tail", f"{y}.tail") * (1 + similarity) >= sizes * similarity - 1e-6) & (apart * (1 + similarity) <= sizes * (1 - similarity) + 1e-6)


def _pairs_within(rows: DataFrame, keys: list[str], similarity: float) -> DataFrame:
    """The pairs (a, b) of different roots that meet under equal keys and may reach the similarity. Rows of two blocks meet across these only."""
    row = F.struct("node", "size", "tail", "root", "own", "sketch")
    met = rows.select(*keys, row.alias("x")).join(rows.select(*keys, row.alias("y")), keys).where("x.node < y.node and x.root <> y.root")
    if "lo" in keys:
        met = met.where("lo = hi or x.own <> y.own")
    return met.where(_may_reach("x", "y", similarity)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _pairs_with_some(rows: DataFrame, similarity: float, turn: int) -> DataFrame:
    """The pairs (a, b) of different roots of a few sets of each shingle with its others; each block of these is a join's key."""
    row = F.struct("node", "size", "tail", "root", "sketch")
    first = [F.min(F.struct(F.xxhash64("node", F.lit(turn * STARS + i)).alias("h"), row.alias("x"))).alias(f"s{i}") for i in range(STARS)]
    stars = rows.groupBy("shingle", "blocks").agg(*first).select("shingle", F.explode(F.expr("sequence(0, blocks - 1)")).alias("own"), F.array_distinct(F.array(*(f"s{i}.x" for i in range(STARS)))).alias("all"))
    met = rows.select("shingle", "own", row.alias("y")).join(stars, ["shingle", "own"]).select("y", F.explode("all").alias("x")).where("x.root <> y.root").where(_may_reach("x", "y", similarity))
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _pairs_left(rows: DataFrame, similarity: float) -> DataFrame:
    """All pairs (a, b) of different roots that a shingle of many sets has: each block meets each other one, and itself with them."""
    met = rows.withColumn("other", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("own")))))
    return _pairs_within(met.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")), ["shingle", "lo", "hi"], similarity)


def verified(pairs: DataFrame, sets: DataFrame, similarity: float, places: int) -> DataFrame:
    """The ``pairs`` (a, b) whose sets have the similarity. A set of very many pairs is looked up in so many places."""
    there = pairs.withColumn("at_a", F.pmod(F.xxhash64("b"), F.lit(places))).withColumn("at_b", F.pmod(F.xxhash64("a"), F.lit(places)))
    for x in ("a", "b"):
        of = sets.select(F.col("node").alias(x), F.struct("size", "shared").alias(f"set_{x}"))
        there = there.join(pairs_places(pairs, x, places).join(of, x), [x, f"at_{x}"])
    both = F.size(F.array_intersect("set_a.shared", "set_b.shared"))
    return there.select("a", "b", both.alias("both"), (F.col("set_a.size") + F.col("set_b.size")).alias("sizes")).where(F.col("both") / (F.col("sizes") - F.col("both")) >= similarity).select("a", "b")


def pairs_places(pairs: DataFrame, x: str, places: int) -> DataFrame:
    """The places where a set of ``pairs`` is needed, each once."""
    return pairs.select(x, F.pmod(F.xxhash64("b" if x == "a" else "a"), F.lit(places)).alias(f"at_{x}")).distinct()


def simhash_pairs(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets that have the same SimHash, or SimHashes within the radius that the pivot table leaves: each set with one of its fingerprint, and that one with those of near fingerprints."""
    firsts = sets.groupBy("fp").agg(F.min("node").alias("first"))
    near = fingerprint_links(stored(pivot_table(firsts), "pivot-table")).join(firsts.toDF("a", "x"), "a").join(firsts.toDF("b", "y"), "b").select("x", "y")
    same = sets.join(firsts, "fp").select(F.col("first").alias("x"), F.col("node").alias("y")).where("x <> y")
    return near.unionByName(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _joined(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows with the roots that the links so far give them."""
    return rows.join(roots.withColumnRenamed("root", "now"), "node", "left").withColumn("root", F.coalesce("now", "root")).drop("now")


def similar_roots(sets: DataFrame, similarity: float, buckets: int) -> DataFrame:
    """(node, root) of those of ``sets`` (node, size, takes, shared, sketch, fp) that verified links of ``similarity`` or more join; ``root`` is the smallest node so joined. Each step's links go on from the roots of the steps before."""
    roots = components(stored(verified(stored(simhash_pairs(sets), "simhash-pairs"), sets, similarity, buckets), "links-simhash"))
    rows = stored(_joined(prefix_rows(sets, buckets).withColumn("root", F.col("node")), roots), "prefix-rows")
    many = rows.where("blocks > 0")
    pairs = stored(_pairs_within(rows.where("blocks = 0"), ["shingle"], similarity).unionByName(_pairs_with_some(many, similarity, 0)).distinct(), "pairs")
    roots = components(roots.union(stored(verified(pairs, sets, similarity, buckets), "links-0")))
    turn, last = 1, many.isEmpty()
    while not last:
        now = _joined(many, roots)
        apart = now.groupBy("shingle").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("shingle")
        compared, many = many, stored(now.join(apart, "shingle"), "apart")
        # Compared with some of them again, or all that is left.
        last = many.isEmpty() or (turn > 1 and found.count() * WORTH <= compared.count())
        pairs = stored(_pairs_left(many, similarity) if last else _pairs_with_some(many, similarity, turn), "pairs")
        found = stored(verified(pairs, sets, similarity, buckets), f"links-{turn}")
        roots, turn = components(roots.union(found)), turn + 1
    return roots


def similar_components(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_key, component_id, least_key) for each distinct row of ``docs``: documents joined by links of ``similarity`` (Jaccard) or more over their shingle sets.

    No link is missed and none is made without that similarity (but for 64-bit hashes that collide). ``component_id`` is the smallest id of the component, ``least_key`` the ``row_key`` of a row
    with it. Empty and null texts are alike, and so are texts of white space; a very long text is taken whole, a repeated row once. An empty table gives an empty one; other columns are ignored. A null id is never the smallest where there is another. ``docs`` must give its rows in the same order each time it is read, as files do.
    """
    with exchanged_joins(docs.sparkSession):
        keyed = docs.select(F.col(id_col).alias("row"), row_key(id_col, text_col).alias("doc_key"), F.col(text_col).cast("string").alias("text"))
        nodes = stored(keyed.mapInArrow(_nodes(width), f"row {dict(docs.dtypes)[id_col]}, doc_key long, shingles binary"), "shingle-digests")
        first = F.min(F.struct(F.col("row").isNull().alias("no"), F.col("row").alias("row"), F.col("doc_key").alias("key")))
        distinct = stored(nodes.groupBy("shingles").agg(first.alias("least")), "distinct-sets")
        by_key = keyed.select(F.col("doc_key").alias("doc_id"), "doc_key", "text")
        parts, buckets = measured(by_key)
        hits = shared_anchors(by_key, _scan(width), parts, buckets, "shingles")
        # At least the session's partitions, and more as the texts grow.
        n = max(buckets, n_buckets(docs.sparkSession, None))
        chosen = hits.select(F.col("doc_key").alias("node"), "hits").join(distinct.select(F.col("least.key").alias("node")), "node")
        texts = chosen.join(keyed.select(F.col("doc_key").alias("node"), "text"), "node").select("node", "text", "hits")
        sets = stored(texts.mapInArrow(_shared_sets(width, similarity), "node long, size long, takes long, shared array<long>, sketch array<long>, fp binary").dropDuplicates(["node"]), "shared-sets")
        roots = similar_roots(sets, similarity, n)
    by_set = distinct.join(roots, F.col("least.key") == F.col("node"), "left").select("shingles", F.coalesce("root", "least.key").alias("root"), "least")
    least = by_set.groupBy("root").agg(F.min("least").alias("best"))
    named = by_set.join(least, "root").select("shingles", F.col("best.row").alias("component_id"), F.col("best.key").alias("least_key"))
    return nodes.select("doc_key", "shingles").distinct().join(named, "shingles").select("doc_key", "component_id", "least_key")
