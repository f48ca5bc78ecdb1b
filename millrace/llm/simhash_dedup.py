"""SimHash near-duplicates: documents joined by few differing bits, through pivot distance tables (see ``pivots``).

Where a similarity of the texts decides, see ``near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import rolling as R
from millrace.llm.anchors import row_key
from millrace.llm.common import fresh, stored, table
from millrace.llm.components import components
from millrace.llm.near_duplicates import similar_components
from millrace.llm.pivots import N_PIVOTS, RADIUS, fingerprint_links, majority_bits, pivot_table

__all__ = ["N_PIVOTS", "drop_near_duplicates", "fingerprint_links", "fingerprints", "op10_simhash_dedup", "pivot_table", "simhash_components"]


def shingle_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 (seed 42) of each shingle of a text whose words are joined by one space."""
    if not text:
        return []
    gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32).tolist()
    starts, ends = [0, *(g + 1 for g in gaps)], [*gaps, len(text)]
    if len(starts) <= width:
        return [xxhash.xxh64_intdigest(text, 42)]
    h = xxhash.xxh64_intdigest
    return [h(text[a:b], 42) for a, b in zip(starts, ends[width - 1 :], strict=False)]


def _fingerprints(width: int, lanes: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, hashes, first = [], [], [0]

            def flush():
                h, runs = np.array(hashes, dtype=R.U), np.array(first)
                out = np.zeros((len(first) - 1, lanes), dtype=">u8")
                for k in range(lanes):
                    out[:, k] = majority_bits(h if k == 0 else R.mix(h ^ R.U(k)), runs)
                fps.extend(x.tobytes() for x in out)

            for x in pc.cast(batch.column(2), pa.binary()):
                hashes += shingle_hashes(b" ".join((x.as_buffer().to_pybytes() if x.is_valid else b"").split()).lower(), width)
                first.append(len(hashes))
                if len(hashes) > 100_000:
                    flush()
                    hashes, first = [], [0]
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.binary())], ["row", "doc_key", "fp"])

    return emit


def fingerprints(docs: DataFrame, width: int = 4, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_key, fp) of every document: its id, ``row_key``, and the SimHash of its shingles, 8 bytes for each of ``lanes``, the highest bit first."""
    return docs.select(F.col(id_col).alias("row"), row_key(id_col, text_col).alias("doc_key"), F.col(text_col).cast("string").alias("text")).mapInArrow(_fingerprints(width, lanes), f"row {dict(docs.dtypes)[id_col]}, doc_key long, fp binary")


def simhash_components(docs: DataFrame, width: int = 4, lanes: int = 1, radius: int = RADIUS, similarity: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, doc_key, fp, component_id, least_key) for every row of ``docs``: documents whose fingerprints are joined by links of at most ``radius`` bits.

    ``component_id`` is the smallest id of the component, ``least_key`` the ``row_key`` of one row with it. Links are for one lane (64 bits) and a radius of four,
    and none is missed. With ``similarity``, documents are joined by links of that Jaccard coefficient over their shingles instead (``similar_components``), at any
    distance of the fingerprints.

    Null and empty texts have fingerprint zero and link like any other; a text of fewer words than a shingle is
    one shingle. A null id is never the smallest; a component of null ids alone has a null
    ``component_id``. Repeated rows are results each. An empty table gives an empty one; other columns are ignored.
    """
    if similarity is not None:
        groups = similar_components(docs, width, similarity, id_col, text_col).withColumnRenamed("doc_key", "key")
        return fingerprints(docs, width, lanes, id_col, text_col).join(groups, F.col("doc_key") == F.col("key")).select(F.col("row").alias(id_col), "doc_key", "fp", "component_id", "least_key")
    fps = stored(fingerprints(docs, width, lanes, id_col, text_col), "fingerprints")
    # Null ids last, so that they represent a component only where it has no other.
    first = F.min(F.struct(F.col("row").isNull().alias("no"), F.col("row").alias("row"), F.col("doc_key").alias("key")))
    distinct = stored(fps.groupBy("fp").agg(first.alias("least")), "distinct-fingerprints")
    links = fingerprint_links(stored(pivot_table(distinct, lanes), "pivot-table"), lanes, radius)
    roots = components(links)
    by_fp = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = by_fp.groupBy("root").agg(F.min("least").alias("best"))
    named = by_fp.join(least, "root").select(F.col("fp").alias("fp2"), F.col("best.row").alias("component_id"), F.col("best.key").alias("least_key"))
    return fps.join(named, F.col("fp") == F.col("fp2")).select(F.col("row").alias(id_col), "doc_key", "fp", "component_id", "least_key")


def drop_near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component: the one with the smallest id. All columns stay, whatever their names.

    Links are all pairs whose five-word shingle sets have a similarity (Jaccard) of 0.8 or more, found by ``similar_components``: first those of near SimHash fingerprints, through a pivot table, then the others.

    Null and empty texts, and texts of white space, are alike. A text of fewer words than a shingle is one shingle; a very long one is taken whole. A null id stays only where its component has
    no other. Of rows that repeat an id and a text one stays, whatever their other columns. An empty table gives an empty one.
    """
    key, stays = fresh(docs, "row_key", "stays")
    groups = similar_components(docs, width, similarity, id_col, text_col)
    stay = groups.select(F.col("least_key").alias(stays)).distinct()
    keyed = docs.withColumn(key, row_key(id_col, text_col))
    return keyed.join(stay, F.col(key) == F.col(stays)).drop(stays).dropDuplicates([key]).drop(key)


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    return simhash_components(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
