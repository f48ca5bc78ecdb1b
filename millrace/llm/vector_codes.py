"""Vector codes: product quantisation with integer codebooks, refined by sums over a reduction tree.

Vectors become integers and are stored once as columnar blocks, one contiguous NumPy row for each dimension. A round is one ``treeAggregate`` of an
RDD of these blocks: distances to all entries of a part's codebook accumulate dimension by dimension, ``np.add.at`` adds the vectors into int64
tensors of sums and counts (parts x entries x dimensions, the same size whatever the number of vectors), and those merge through the tree. The
driver sees nothing else but the first vectors and the codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import fresh, stored, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of a block, and of a tile: a tile's distances to all entries are held at once.
BLOCK, TILE = 4096, 512
#: A label with more than one in so many rows counts as frequent, so there are fewer frequent labels than that.
FREQUENT = 1000


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * value), exactly where the scale is a power of two."""
    return np.floor(values.astype(np.float64) * scale).astype(np.int64)


def nearest(block: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a block (dimensions x vectors) and a codebook (parts x entries x dimensions of a part): the nearest entry of each part (parts x vectors; ties to the lower one), and each vector's squared distances summed over the parts."""
    parts, entries, width = book.shape
    n = block.shape[1]
    codes, error = np.zeros((parts, n), np.int64), np.zeros(n, np.int64)
    for p in range(parts):
        columns = np.ascontiguousarray(book[p].T.astype(block.dtype))
        for at in range(0, n, TILE):
            tile = block[p * width : (p + 1) * width, at : at + TILE]
            distance = np.zeros((tile.shape[1], entries), block.dtype)
            for values, column in zip(tile, columns, strict=True):
                step = values[:, None] - column
                step *= step
                distance += step
            own = codes[p, at : at + TILE] = distance.argmin(axis=1)
            error[at : at + TILE] += distance[np.arange(len(own)), own]
    return codes, error


def _blocks(scale: int, kind: np.dtype):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in (batch.slice(i, BLOCK) for i in range(0, batch.num_rows, BLOCK)):
                n = rows.num_rows
                values = integers(rows.column(2).flatten().to_numpy(), scale).reshape(n, -1).T.astype(kind)
                ends = pa.array([0, n], pa.int32())
                lists = [pa.ListArray.from_arrays(ends, rows.column(i)) for i in range(2)]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([np.ascontiguousarray(values).tobytes()], pa.binary())], ["ids", "labels", "block"])

    return emit


def _codes(book, size: int, kind: np.dtype):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = (batch.column(k).slice(i, 1).flatten() for k in range(2))
                codes, error = nearest(np.frombuffer(batch.column(2)[i].as_py(), kind).reshape(size, -1), book.value)
                text = [bytes(c).hex() for c in np.ascontiguousarray(codes.T.astype(np.uint8))]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(text, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return emit


def refined(blocks, book: np.ndarray, size: int, kind: np.dtype) -> np.ndarray:
    """The codebook after one round: each entry the floor of the mean of the parts nearest to it, unused entries as they were. ``blocks`` is an RDD of the blocks' bytes."""
    shared = blocks.context.broadcast(book)
    width = book.shape[2]

    def add(total, data):
        block = np.frombuffer(data, kind).reshape(size, -1)
        codes, _ = nearest(block, shared.value)
        sums, counts = total or (np.zeros(book.shape, np.int64), np.zeros(book.shape[:2], np.int64))
        for p, own in enumerate(codes):
            np.add.at(counts[p], own, 1)
            for d in range(width):
                np.add.at(sums[p, :, d], own, block[p * width + d].astype(np.int64))
        return sums, counts

    def merge(a, b):
        return a or b if a is None or b is None else (a[0] + b[0], a[1] + b[1])

    sums, counts = blocks.treeAggregate(None, add, merge)
    shared.unpersist()
    return np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], book)


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of each vector, stored, and the codebooks (parts x entries x dimensions of a part).

    Rows whose vector is null, empty, or holds a null or non-finite component are left out. The codebooks begin with the vectors of the smallest ids; null ids come
    last, and rows of one id in the order of their vectors. Of fewer vectors than ``entries`` (256 at most) each begins one. Repeated rows count as often as they are there, a null
    label stays null, an empty table gives an empty one and an empty codebook; other columns are ignored. Raises ValueError where the vectors differ in length, where
    the length is no multiple of ``parts``, and where exact sums might pass 64 bits (components beyond some 370,000 with 16 dimensions a part).
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    kept = rows.where("size(x) > 0 and forall(x, v -> v is not null and not isnan(v) and abs(v) < double('infinity'))")
    n, size, least, most = kept.agg(F.count("*"), F.max(F.size("x")), F.min(F.size("x")), F.max(F.array_max(F.transform("x", F.abs)))).first()
    if not n:
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    if size != least or size % parts or not 0 < entries <= 256:
        raise ValueError(f"vectors of {least} to {size} components can't be cut into {parts} equal parts with {entries} entries of one byte")
    bound = int(most) * scale + scale
    if max(size * 4 * bound**2, n * bound) >= 1 << 63:
        raise ValueError(f"sums over components as large as {most} may pass 64 bits")
    kind = np.dtype(np.int32 if size // parts * 4 * bound**2 < 1 << 31 else np.int64)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    book = integers(np.array([r[0] for r in first]), scale).reshape(len(first), parts, -1).transpose(1, 0, 2)
    label = dict(rows.dtypes)["label"]
    blocks = stored(kept.mapInArrow(_blocks(scale, kind), f"ids array<bigint>, labels array<{label}>, block binary"), "blocks")
    data = blocks.select("block").rdd.map(lambda r: bytes(r[0]))
    for _ in range(rounds):
        book = refined(data, book, size, kind)
    codes = blocks.mapInArrow(_codes(spark.sparkContext.broadcast(book), size, kind), f"vec_id long, label {label}, code string, error long")
    return stored(codes, "codes"), book


def with_group_sum(rows: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows that agree in ``group`` (nulls agree), as ``name``. Frequent groups, fewer than ``FREQUENT``, are broadcast; the others meet their rows in a shuffle, no one of them with many."""
    g, n, total = fresh(rows, "group", "n", "total")
    sums = rows.groupBy(F.col(group).alias(g)).agg(F.count("*").alias(n), F.sum(value).alias(total))
    every = rows.count()
    sums = stored(sums.withColumn(n, F.col(n) * FREQUENT > every), "sums")
    same = F.col(group).eqNullSafe(F.col(g))
    frequent, others = (sums.where(F.col(n) == x).drop(n) for x in (True, False))
    known = rows.join(F.broadcast(frequent), same, "left")
    near = known.where(F.col(total).isNotNull()).drop(g)
    far = known.where(F.col(total).isNull()).drop(g, total).join(others, same).drop(g)
    return near.unionByName(far).withColumnRenamed(total, name)


def codebooks_sha256(book: np.ndarray) -> str:
    """Digest of all entries' components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every vector of ``embeddings``, their errors, and the digest of the codebooks."""
    codes, book = vector_codes(table(spark, sf_dir, "embeddings"))
    out = with_group_sum(codes, "label", "error", "label_error")
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(book)).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds one after the other; distances as dot products of doubles, which hold these integers exactly."""
    near = "SELECT x.id, x.p, min_by(b.j, (x.xx - 2 * list_dot_product(x.x, b.x) + b.xx, b.j)) AS j, min(x.xx - 2 * list_dot_product(x.x, b.x) + b.xx) AS d FROM parts x JOIN book{k} b ON x.p = b.p GROUP BY x.id, x.p"
    steps = [
        f"kept AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS id, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"parts AS MATERIALIZED (SELECT id, vec_id, p, x, list_dot_product(x, x) AS xx FROM (SELECT id, vec_id, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS x FROM kept, range({PARTS}) t(p)) q)",
        f"book0 AS MATERIALIZED (SELECT p, id - 1 AS j, x, xx FROM parts WHERE id <= {ENTRIES})",
    ]
    for k in range(ROUNDS):
        steps += [
            f"near{k} AS MATERIALIZED ({near.format(k=k)})",
            f"mean{k} AS (SELECT p, j, list(m ORDER BY i) AS x FROM (SELECT n.p, n.j, i, floor(sum(x.x[i]) / count(*)) AS m FROM near{k} n JOIN parts x ON n.id = x.id AND n.p = x.p, unnest(range(1, len(x.x) + 1)) t(i) GROUP BY ALL) GROUP BY ALL)",
            f"book{k + 1} AS MATERIALIZED (SELECT p, j, x, list_dot_product(x, x) AS xx FROM (SELECT b.p, b.j, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN mean{k} m ON b.p = m.p AND b.j = m.j))",
        ]
    steps += [
        f"coded AS ({near.format(k=ROUNDS)})",
        "codes AS (SELECT id, string_agg(lower(format('{:02x}', j::INT)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM coded GROUP BY id)",
        f"digest AS (SELECT sha256(string_agg(x[i]::BIGINT::VARCHAR, ',' ORDER BY p, j, i)) AS h FROM book{ROUNDS}, unnest(range(1, len(x) + 1)) t(i))",
    ]
    return f"WITH {', '.join(steps)} SELECT k.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, h AS codebooks_sha256 FROM kept k JOIN codes c USING (id), digest"


OP11_SQL = _sql()
