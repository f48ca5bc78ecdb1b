"""Mixing sources to target weights through a multivariate-hypergeometric splitting tree.

Each source is dealt into blocks by a hash permutation. Its target becomes a quota of block draws:
whole passes over the source, then blocks of one more pass in permuted order. The tree halves the
output shards; at each node the quotas of the left half are one multivariate hypergeometric
draw from the node's. A leaf's quotas name, source by source, a run of the permuted draws that no
other leaf has, and nothing else is taken; so the draws are disjoint and the quotas are met exactly.
"""

from __future__ import annotations

from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import SPACE, fresh, stored, table

#: Weights that sources, ordered by code point, take in turn.
WEIGHTS = (5, 2, 1)
#: A source has at most so many blocks, and about 64 documents a block below that.
MAX_BLOCKS = 16384
#: All sources together have at most so many blocks (and one each), which bounds the schedule that is broadcast.
ALL_BLOCKS = 131_072
#: Per-source totals come to the driver; more sources than this are refused, never dropped.
MAX_SOURCES = 100_000


def n_words(text):
    """Runs of anything but ASCII white space in a text column (null: 0)."""
    return F.coalesce(F.size(F.filter(F.split(text, SPACE), lambda w: w != "")), F.lit(0)).cast("long")


def targets_of(sizes: list[tuple[str | None, int]], weights=WEIGHTS, most: float = 3.0) -> dict[str | None, float]:
    """Words each source should give. Shares follow the weights; a source stops at ``most`` times
    its size, and what it leaves is shared again by weight among the others until none is above."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: float(weights[i % len(weights)]) for i, (s, _) in enumerate(order)}
    size, left, target = dict(order), float(sum(n for _, n in order)), {}
    open_ = [s for s, _ in order]
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > most * size[s]]
        if not full:
            target |= share
            break
        for s in full:
            target[s] = float(most * size[s])
            left -= target[s]
        open_ = [s for s in open_ if s not in full]
    return target


def splitting_tree(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """shards x sources: how many of each source's draws every shard takes. Shards differ by at most
    one draw in all; columns sum to ``quotas``."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def hypergeometric(counts: np.ndarray, take: int, rng) -> np.ndarray:
        got, rest = np.zeros_like(counts), int(counts.sum())
        for i, c in enumerate(counts):
            rest -= int(c)
            got[i] = c if rest == 0 and take >= c else (rng.hypergeometric(int(c), rest, take) if c and take else 0)
            take -= int(got[i])
        return got

    def split(lo: int, hi: int, counts: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = counts
            return
        mid, total = (lo + hi) // 2, int(counts.sum())
        base, extra = divmod(total, hi - lo)
        take = base * (mid - lo) + min(extra, mid - lo)
        rng = np.random.default_rng([seed, lo, hi])
        left = hypergeometric(counts, take, rng)
        split(lo, mid, left)
        split(mid, hi, counts - left)

    split(0, shards, np.asarray(quotas, dtype=np.int64))
    return out


def _stride(n: int) -> int:
    """A step that visits each of ``n`` places once and leaves neighbours far apart."""
    step = max(1, round(n * 0.618))
    while gcd(step, n) > 1:
        step += 1
    return step


#: Documents at the end of a block among which the best sum is sought, and words that may then be missing at most.
TAIL, TAIL_WORDS = 256, 400_000


def _fill(sizes: list[int], want: int) -> list[bool]:
    """Which documents of the last block to take, in their permuted order, to come nearest to ``want``: each that still fits, and
    of the last ones the set whose sum is nearest to what is missing."""
    took, left, k = [False] * len(sizes), want, 0
    while k < len(sizes) and (len(sizes) - k > TAIL or left > TAIL_WORDS):
        took[k] = sizes[k] <= left
        left -= sizes[k] if took[k] else 0
        k += 1
    # Bit s of sums[i] tells whether some of the first i documents of the tail sum to s.
    sums, mask = [1], (1 << (2 * left + 1)) - 1
    for n in sizes[k:]:
        sums.append((sums[-1] | sums[-1] << n) & mask)
    below = (sums[-1] & ((1 << (left + 1)) - 1)).bit_length() - 1
    above = sums[-1] >> (left + 1)
    best = left + (above & -above).bit_length() if above else None
    at = best if best is not None and best - left < left - below else below
    left -= at
    for i in range(len(sums) - 2, -1, -1):
        if not sums[i] >> at & 1:
            took[k + i] = True
            at -= sizes[k + i]
    # Whatever is missing then, one more document may come nearer by going over.
    more = min((abs(left - n), i) for i, n in enumerate([*sizes, 0]) if i == len(sizes) or not took[i])
    if more[1] < len(sizes) and more[0] < left:
        took[more[1]] = True
    return took


def mix_sources(docs: DataFrame, weights=WEIGHTS, shards: int = 64, seed: int = 17, most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with ``size`` (words), ``source_size``, ``target``, ``taken`` and ``copies``, an array of (copy, shard).

    A document is taken whole, ``taken / size`` times (0 to ``most``): as often as leaves of the splitting tree hold a draw of it. The taken words of a source come as near
    to its target as whole documents of its last block allow. Who is taken depends on ids, texts
    and the seed alone, so reruns agree.

    Null sources are one source, the last in order. Null and empty texts have size 0: they ride
    along with their block and add nothing. Null ids are hashed like values; repeated rows are told
    apart by their text only, so equal rows are taken or left alike unless the last block divides
    them. An empty table gives an empty one. Columns named like a new one are replaced.
    """
    spark, out = docs.sparkSession, ("size", "source_size", "target", "taken", "copies")
    docs = docs.drop(*(c for c in docs.columns if c.lower() in out))
    src, perm, block, whole, rest, n_blocks = fresh(docs, "src", "perm", "block", "whole", "rest", "n_blocks")
    psrc, bsrc, bblock, csrc, cperm, csize = fresh(docs, "psrc", "bsrc", "bblock", "csrc", "cperm", "csize")
    draws_, want_ = fresh(docs, "draws", "want")
    sized = docs.withColumns({"size": n_words(F.col(text_col)), perm: F.xxhash64(F.col(id_col), F.xxhash64(text_col), F.lit(seed))})
    slim = stored(sized.select(F.col(source_col).alias("source"), "size", F.col(perm).alias("perm")), "mixing-sizes")
    by_source = slim.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(by_source) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    order = sorted(by_source, key=lambda r: (r["source"] is None, r["source"] or ""))
    target = targets_of([(r["source"], r["size"]) for r in order], weights, most)
    plan = []
    for i, r in enumerate(order):
        times = min(most, int(target[r["source"]] // r["size"])) if r["size"] else 0
        more = round(target[r["source"]] - times * r["size"]) if times < most else 0
        plan.append((r["source"], i, r["size"], target[r["source"]], times, more, max(1, min(MAX_BLOCKS, ALL_BLOCKS // len(order), r["n"] // 64))))
    plans = F.broadcast(spark.createDataFrame(plan, f"{psrc} string, {src} int, source_size long, target double, {whole} int, {rest} long, {n_blocks} int"))

    def in_blocks(df: DataFrame, source: str, p: str) -> DataFrame:
        """Null-safe equality matches the null source, so no stand-in can clash with a real name."""
        return df.join(plans, F.col(source).eqNullSafe(F.col(psrc))).drop(psrc).withColumn(block, F.pmod(F.col(p), F.col(n_blocks)).cast("int"))

    # Exact words of every block; blocks of a source in permuted order, until the rest is used up.
    slim = in_blocks(slim, "source", "perm")
    along = Window.partitionBy(src).orderBy(F.xxhash64(src, block, F.lit(seed)), block)
    before = F.col("upto") - F.col("words")
    blocks = slim.groupBy(src, block, rest).agg(F.sum("size").alias("words")).withColumns({"rank": F.row_number().over(along) - 1, "upto": F.sum("words").over(along)}).select(
        F.col(src).alias(bsrc), F.col(block).alias(bblock), "rank", (F.col("upto") <= F.col(rest)).alias("full"),
        F.when((F.col("upto") > F.col(rest)) & (before < F.col(rest)), F.col(rest) - before).alias(want_))
    blocks = stored(blocks, "mixing-blocks")
    drawn = {r[bsrc]: r for r in blocks.groupBy(bsrc).agg(F.count("*").alias("n"), F.sum((F.col("full") | F.col(want_).isNotNull()).cast("long")).alias("more")).collect()}
    quotas = [p[4] * drawn[p[1]]["n"] + (drawn[p[1]]["more"] if p[4] < most else 0) for p in plan]
    ends = np.cumsum(splitting_tree(quotas, shards, seed), axis=0)
    # Draw c * blocks + rank of a source is copy c of the block, if below the quota. The draws are dealt in the order of a permutation: each falls in the leaf whose
    # run holds it, beyond the last run in none.
    leaves = F.broadcast(spark.createDataFrame([(p[1], drawn[p[1]]["n"], q, _stride(q), [int(x) for x in ends[:, i]]) for i, (p, q) in enumerate(zip(plan, quotas, strict=True))], "leaf_of int, n long, quota long, stride long, ends array<long>"))
    place = lambda c: F.pmod((c * F.col("n") + F.col("rank")) * F.col("stride"), F.greatest("quota", F.lit(1)))
    drawn_copies = F.filter(F.sequence(F.lit(0), F.lit(most - 1)), lambda c: c * F.col("n") + F.col("rank") < F.col("quota"))
    draws = F.filter(F.transform(drawn_copies, lambda c: F.struct(c.alias("copy"), F.size(F.filter("ends", lambda e: e <= place(c))).alias("shard"))), lambda d: d["shard"] < shards)
    sched = stored(blocks.join(leaves, F.col(bsrc) == F.col("leaf_of")).select(bsrc, bblock, want_, draws.alias(draws_)), "mixing-schedule")

    def scheduled(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(sched), (F.col(src) == F.col(bsrc)) & (F.col(block) == F.col(bblock))).drop(bsrc, bblock)

    # The last block of a source is filled document by document; equal rows count as one.
    divided = F.col(want_).isNotNull() & (F.col(whole) < most)
    last = scheduled(slim).where(divided).groupBy(src, F.col(want_).alias("want"), "perm", F.col("size").alias("each")).agg(F.count("*").alias("n"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["perm", "each"], ignore_index=True)
        took = _fill([int(x) for x in pdf["each"] * pdf["n"]], int(pdf["want"].iloc[0]))
        return pdf.loc[took, [src, "perm", "each"]]

    chosen = last.groupBy(src).applyInPandas(fill, f"{src} int, perm long, each long").toDF(csrc, cperm, csize)
    placed = scheduled(in_blocks(sized, source_col, perm))

    def result(df: DataFrame, copies) -> DataFrame:
        return df.select(*docs.columns, "size", "source_size", "target", (F.col("size") * F.size(copies)).alias("taken"), copies.alias("copies"))

    open_ = placed.where(divided).join(chosen, (F.col(src) == F.col(csrc)) & (F.col(perm) == F.col(cperm)) & (F.col("size") == F.col(csize)), "left")
    passed_over = F.slice(draws_, F.lit(1), F.col(whole))
    return result(placed.where(~divided), F.col(draws_)).unionByName(result(open_, F.when(F.col(csrc).isNull(), passed_over).otherwise(F.col(draws_))))


def mixed_copies(mixed: DataFrame, seed: int = 17, pieces: int = 8, id_col: str = "doc_id") -> DataFrame:
    """One row for each copy taken, with ``copy`` and ``out_shard``, in place of ``copies``; rows are shuffled locally, within each of the ``pieces`` of a shard.

    Documents that are not taken give no row. Null ids are ordered like values; repeated rows are rows each; an empty table gives an empty one. Columns
    named like a new one are replaced.
    """
    mixed = mixed.drop(*(c for c in mixed.columns if c.lower() in ("copy", "out_shard")))
    one, piece, spot = fresh(mixed, "one", "piece", "spot")
    rows = mixed.withColumn(one, F.explode("copies")).withColumns({"copy": F.col(f"{one}.copy"), "out_shard": F.col(f"{one}.shard")})
    rows = rows.withColumns({piece: F.pmod(F.xxhash64(id_col, "copy", F.lit(seed + 1)), F.lit(pieces)), spot: F.xxhash64(id_col, "copy", F.lit(seed))})
    return rows.repartition("out_shard", piece).sortWithinPartitions("out_shard", piece, spot).drop(one, piece, spot, "copies")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words in the mix, and the output shard of each copy taken."""
    mixed = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.transform("copies", lambda c: c["shard"]).alias("out_shards"))
