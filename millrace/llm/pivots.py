"""SimHash fingerprints, pivot distance tables, and the links that these leave.

Each distinct fingerprint gets, once, a row of a pivot table: its Hamming distances to fixed reference fingerprints (pivots). By
the triangle inequality two fingerprints within the radius differ by no more than the radius in any of these
distances, so pairs whose largest coordinate difference is more are discarded; survivors are verified.

Pivot tables alone would have to look at every pair: the distances of unrelated fingerprints to a pivot are 32 with a standard deviation of 4, so
that a cut at a pivot's median, with the 4 distances beside it on both sides, leaves as many pairs as before. Pairs are therefore looked at only where they
agree in any three of seven blocks of bits, one choice of which every pair within the radius has in common; the table's rows travel with the fingerprints. In a group
of fingerprints that agree, each one reached is compared with those not reached yet, never all with all: links found so
join the same fingerprints as all links would.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm import rolling as R
from millrace.llm.common import n_buckets

RADIUS = 4
#: Bits of each block of a 64-bit fingerprint, lowest first. Four bits can touch at most four of the seven blocks.
BLOCKS = (9, 9, 9, 9, 9, 9, 10)
#: Groups up to this size are compared side by side at once.
SMALL = 6
#: Fingerprints for each task of the search.
TASK_FINGERPRINTS = 20_000
#: Pivots: unrelated fingerprints pass one in 0.57 of all cases, all of them in about 0.011.
N_PIVOTS = 8
LANES = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], dtype=R.U)


def bit_counts(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each run of hashes (``first`` has the starts, and the end) how many have each bit: runs x 64."""
    out = np.zeros((len(first) - 1, 64), dtype=np.int64)
    if not len(hashes):
        return out
    # Eight counters of eight bits each fit in one word, so they are added at most 255 at a time.
    cuts = np.unique(np.concatenate([np.arange(0, len(hashes), 255), first[:-1][np.diff(first) > 0]]))
    owner = np.searchsorted(first, cuts, "right") - 1
    octets = hashes.view(np.uint8).reshape(-1, 8)
    for i in range(8):
        sums = np.add.reduceat(LANES[octets[:, i]], cuts).view(np.uint8).reshape(-1, 8)
        np.add.at(out[:, 8 * i : 8 * i + 8], owner, sums)
    return out


def majority_bits(hashes: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """The SimHash of each run of hashes (``runs`` has the starts, and the end): the bits that more than half of them have."""
    bits = bit_counts(hashes, runs) * 2 > np.diff(runs)[:, None]
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u8")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def pivot_distances(fp: np.ndarray) -> np.ndarray:
    """Distances (fingerprints x pivots) to reference fingerprints; any would do, these are spread over all bits."""
    lanes = fp.shape[1]
    pivots = R.mix(np.arange(1, N_PIVOTS * lanes + 1, dtype=R.U) * R.U(0x9E3779B97F4A7C15)).reshape(N_PIVOTS, lanes)
    return np.column_stack([_distance(fp, p[None, :]) for p in pivots]).astype(np.uint8)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The largest difference of a coordinate."""
    return np.abs(a.astype(np.int16) - b).max(axis=-1, initial=0)


def linked(fp: np.ndarray, pivots: np.ndarray, group: np.ndarray, radius: int = RADIUS, small: int = SMALL) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links (indices) that connect, within each group (equal neighbours in ``group``), what all links would connect; all links in groups of up to ``small``."""
    head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.append(head, len(group)))
    out = []
    ranks = np.arange(len(group)) - np.repeat(head, size)
    sizes = np.repeat(size, size)
    for d in range(1, small):
        i = np.flatnonzero((ranks + d < sizes) & (sizes <= small))
        i = i[_apart(pivots[i], pivots[i + d]) <= radius]
        i = i[_distance(fp[i], fp[i + d]) <= radius]
        out.append((i, i + d))
    for a, n in zip(head[size > small], size[size > small], strict=True):
        rest = np.arange(a, a + n)
        while len(rest):
            reached, rest = [rest[0]], rest[1:]
            while reached and len(rest):
                x = reached.pop()
                near = np.flatnonzero(_apart(pivots[rest], pivots[x]) <= radius)
                near = near[_distance(fp[rest[near]], fp[x][None, :]) <= radius]
                if len(near):
                    hit = rest[near]
                    out.append((np.full(len(hit), x), hit))
                    reached += hit.tolist()
                    rest = np.delete(rest, near)
    return out


def block_keys(fp: np.ndarray) -> np.ndarray:
    """For each choice of agreeing blocks a key (choices x fingerprints): the choice and the blocks' bits."""
    at = np.concatenate(([0], np.cumsum(BLOCKS)))
    blocks = [(fp[:, 0] >> R.U(at[b])) & R.U((1 << n) - 1) for b, n in enumerate(BLOCKS)]
    out = []
    for c, chosen in enumerate(combinations(range(len(BLOCKS)), len(BLOCKS) - RADIUS)):
        key = np.zeros(len(fp), dtype=R.U)
        for b in chosen:
            key = (key << R.U(BLOCKS[b])) | blocks[b]
        out.append(key | R.U(c << 40))
    return np.stack(out)


def _array(column, lanes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=">u8").astype(R.U).reshape(-1, lanes)


def _pivot_rows(lanes: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pivot_distances(_array(batch.column(0), lanes)) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], ["fp", "pivots"])

    return emit


def pivot_table(distinct: DataFrame, lanes: int = 1) -> DataFrame:
    """(fp, pivots) of distinct fingerprints: a byte for the distance to each pivot."""
    return distinct.select("fp").mapInArrow(_pivot_rows(lanes), "fp binary, pivots binary")


def _keyed(lanes: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = _array(batch.column(0), lanes)
            for key in block_keys(fp):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0), batch.column(1)], ["key", "fp", "pivots"])

    return emit


def _links(lanes: int, radius: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links among the fingerprints of one partition; a key's rows are all in it."""
        got = [(b.column(0).to_numpy(), _array(b.column(1), lanes), np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(-1, N_PIVOTS)) for b in batches]
        if not got:
            return
        key, fp, pivots = (np.concatenate([x[i] for x in got]) for i in range(3))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        order = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        order = order[np.lexsort((*fp[order].T, key[order]))]
        key, fp, pivots = key[order], fp[order], pivots[order]
        if not len(fp):
            return
        found = linked(fp, pivots, key, radius)
        pairs = np.unique(np.column_stack([fp[np.concatenate([x[0] for x in found])], fp[np.concatenate([x[1] for x in found])]]), axis=0)
        if len(pairs):
            a, b = ([x.tobytes() for x in side.astype(">u8")] for side in (pairs[:, :lanes], pairs[:, lanes:]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return emit


def fingerprint_links(pivots: DataFrame, lanes: int = 1, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) among the fingerprints of a pivot table, enough to connect all that are connected."""
    if (lanes, radius) != (1, RADIUS):
        raise ValueError("agreeing blocks are for 64 bits and radius 4")
    # A task holds the copies of this many fingerprints, whatever their number.
    n = max(n_buckets(pivots.sparkSession, None), pivots.count() // TASK_FINGERPRINTS + 1)
    return pivots.mapInArrow(_keyed(lanes), "key long, fp binary, pivots binary").repartition(n, "key").mapInArrow(_links(lanes, radius), "a binary, b binary")
