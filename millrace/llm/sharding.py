"""Sharding by histogram sort, with DataFrame functions only.

Rows are sorted by (hash of the text, hash of the id). The sort is never run whole: a
histogram over candidate key boundaries gives the exact bytes and rows below each; cells that
hold a wanted splitter, or too many rows, are probed again more finely, until every splitter
meets the tolerance. One exchange then brings each cell's rows together to number them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import fresh, inline, stored, table

#: Probes of each round: which hash, and which of its bits from the top. First 4096 cells, then 256 within each cell that is probed again.
LEVELS = [("h1", 52, 12), *(("h1", s, 8) for s in (44, 36, 28, 20, 12, 4)), ("h1", 0, 4), *(("h2", s, 8) for s in range(56, -1, -8))]
FIRST_H2 = next(i for i, x in enumerate(LEVELS) if x[0] == "h2")


def _digit(level: int, h1: Column, h2: Column) -> Column:
    name, shift, bits = LEVELS[level]
    return F.shiftrightunsigned(h1 if name == "h1" else h2, shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _cells(df: DataFrame, rounds: list[list[dict]], cell: str, h1: str, h2: str) -> DataFrame:
    """``df`` with the cell of each row, after all rounds of refinement (each a small broadcast table)."""
    df = df.withColumn(cell, _digit(0, F.col(h1), F.col(h2)))
    parent, level, base = fresh(df, "parent", "level", "base")
    for made in rounds:
        digit = F.coalesce(*(F.when(F.col(level) == i, _digit(i, F.col(h1), F.col(h2))) for i in sorted({x["level"] for x in made})))
        small = F.broadcast(inline(df.sparkSession, made, "parent bigint, level int, base bigint").toDF(parent, level, base))
        df = df.join(small, F.col(cell) == F.col(parent), "left").withColumn(cell, F.coalesce(F.col(base) + digit, F.col(cell))).drop(parent, level, base)
    return df


def shard_documents(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.005, group_tolerance: float = 0.05) -> DataFrame:
    """``docs`` with ``size``, ``text_crc32``, ``shard`` and ``slot`` (law ``bytes``: shards of near equal size).

    The size of a row is the UTF-8 length of its text (null: 0) plus 16. A splitter is off its
    target by at most ``tolerance`` of a shard, or by half of one row if that is more. Rows of equal
    text stand side by side and share a shard, except where their group holds more than
    ``group_tolerance`` of a shard across a splitter: it is then split by id. ``slot`` numbers
    the rows of a shard from 0 without gaps.

    Nulls: a null text has size 16 and CRC of the empty string; null ids are hashed like any
    value. Rows that repeat get a slot each. An empty table gives an empty one. A column of
    ``docs`` named like one of the four new ones is replaced.
    """
    out = ("size", "text_crc32", "shard", "slot")
    docs = docs.drop(*(c for c in docs.columns if c.lower() in out))
    h1, h2, cell, at, base = fresh(docs, "h1", "h2", "cell", "at", "slot_base")
    text = F.col(text_col)
    keyed = docs.withColumns({
        "size": F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16,
        "text_crc32": F.crc32(F.coalesce(text, F.lit("")).cast("binary")),
        h1: F.xxhash64(text),
        h2: F.xxhash64(F.col(id_col), F.lit("shard")),
    })
    leaves, rounds = _splitters(keyed.select(F.col("size"), F.col(h1).alias("h1"), F.col(h2).alias("h2")), n_shards, tolerance, group_tolerance)
    small = F.broadcast(inline(docs.sparkSession, leaves, "at bigint, shard int, base bigint").toDF(at, "shard", base))
    placed = _cells(keyed, rounds, cell, h1, h2).join(small, F.col(cell) == F.col(at))
    here = Window.partitionBy(cell).orderBy(h1, h2, F.col(id_col))
    return placed.withColumn("slot", F.col(base) + F.row_number().over(here) - 1).drop(h1, h2, cell, at, base)


def _splitters(keys: DataFrame, n_shards: int, tolerance: float, group_tolerance: float) -> tuple[list[dict], list[list[dict]]]:
    """The cells with their shard and first slot, and the rounds that made them. At most 4096
    cells, and 256 more for each cell probed again, come to the driver."""
    keys = stored(keys, "sharding-keys")
    sums = [F.sum("size").alias("bytes"), F.count("*").alias("n"), *(f(h).alias(f"{n}_{h}") for h in ("h1", "h2") for n, f in (("min", F.min), ("max", F.max)))]
    rounds: list[list[dict]] = []
    cells: list[dict] = []
    born, next_id = None, 1 << LEVELS[0][2]
    while True:
        rows = _cells(keys, rounds, "cell", "h1", "h2")
        if born is not None:
            rows = rows.where((F.col("cell") >= born[0]) & (F.col("cell") < born[1]))
        found = rows.groupBy("cell").agg(*sums).collect()
        if born is None:
            cells = [r.asDict() | {"key": (r["cell"],), "level": 0} for r in found]
        else:
            split = {x["base"]: x for x in rounds[-1]}
            for r in found:
                x = split[r["cell"] - (r["cell"] - born[0]) % 256]
                cells.append(r.asDict() | {"key": (*parents[x["parent"]], r["cell"] - x["base"]), "level": x["level"]})
        cells.sort(key=lambda x: x["key"])
        total, rows_all = sum(x["bytes"] for x in cells), sum(x["n"] for x in cells)
        shard, again, below = total / n_shards if cells else 1, [], 0
        for x in cells:
            k = round(below / shard)
            inside = [t * shard for t in range(max(1, k - 1), n_shards) if below < t * shard < below + x["bytes"]] if k < n_shards else []
            off = max((min(t - below, below + x["bytes"] - t) for t in inside), default=0)
            one_text, one_key = x["min_h1"] == x["max_h1"], x["min_h1"] == x["max_h1"] and x["min_h2"] == x["max_h2"]
            crowded = x["n"] > max(10_000, 4 * rows_all / 4096)
            if x["n"] > 1 and not one_key and x["level"] + 1 < len(LEVELS) and (off > (group_tolerance if one_text else tolerance) * shard or crowded or len(inside) > 1):
                again.append(x)
            below += x["bytes"]
        if not again:
            break
        made, parents, first = [], {}, next_id
        for x in again:
            level = max(x["level"] + 1, FIRST_H2 if x["min_h1"] == x["max_h1"] else 0)
            made.append({"parent": x["cell"], "level": level, "base": next_id})
            parents[x["cell"]] = (*x["key"], *[0] * (level - x["level"] - 1))
            next_id += 256
        rounds.append(made)
        born, gone = (first, next_id), {x["cell"] for x in again}
        cells = [x for x in cells if x["cell"] not in gone]
    below, leaves, slots = 0, [], [0] * n_shards
    for x in cells:
        k = min(n_shards - 1, int((below + x["bytes"] / 2) / shard))
        leaves.append({"at": x["cell"], "shard": k, "base": slots[k]})
        slots[k] += x["n"]
        below += x["bytes"]
    return leaves, rounds


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 40, near equal in bytes."""
    return shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
