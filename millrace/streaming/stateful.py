"""State by key over time: a cache that is written and read with a time to live, and claims that lapse. Each has a batch form over a table of events and a stream form that gives the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

#: Lifetimes of pages and of search results, and of a claim, in seconds.
PAGE_TTL, RESULTS_TTL, LEASE = 168 * 3600, 72 * 3600, 3600
READS = "key string, op_id long, ts timestamp, value string, hit boolean"
CLAIMS = "key string, op_id long, ts timestamp, holder string, outcome string"


def cache_reads(ops: DataFrame, ttl: int = PAGE_TTL) -> DataFrame:
    """READS for every ``get`` of ``ops`` (``key, op_id, ts, op, value``): the value of the key's last ``put`` before it, if that is at most ``ttl`` seconds old.

    Events of a key follow one another by time, then number. A put of a null value empties the entry; other operations are passed over; a null key is a key."""
    along = Window.partitionBy("key").orderBy("ts", "op_id").rowsBetween(Window.unboundedPreceding, -1)
    put = F.last(F.when(F.col("op") == "put", F.struct(F.col("ts").alias("at"), F.col("value").alias("was"))), ignorenulls=True).over(along)
    gets = ops.withColumn("put_", put).where("op = 'get'")
    fresh = F.coalesce((F.unix_micros("ts") - F.unix_micros("put_.at") <= ttl * 1_000_000) & F.col("put_.was").isNotNull(), F.lit(False))
    return gets.select("key", "op_id", "ts", F.when(fresh, F.col("put_.was")).alias("value"), fresh.alias("hit"))


def lease_outcomes(ops: DataFrame, lease: int = LEASE) -> DataFrame:
    """CLAIMS for every ``claim`` and ``done`` of ``ops`` (``key, op_id, ts, op, holder``).

    A claim is ``granted`` where the key is free, ``reclaimed`` where another holder's claim is older than ``lease`` seconds, ``renewed`` where it is the holder's own, else ``refused``. Work that is done by who holds the key is ``done`` and closes it; by another, or
    after it is closed, it is ``void``, and so are claims of a closed key: nothing is done twice. A key's events are folded in order of time, then number."""
    own = ops.where("op in ('claim', 'done')").select("key", "op_id", "ts", F.unix_micros("ts").alias("at"), "op", "holder")
    # A task reads its keys one after another, sorted by Spark, and keeps the state of one.
    ordered = own.repartition("key").sortWithinPartitions("key", "at", "op_id", "op", "holder")
    return ordered.mapInArrow(_fold_claims(lease * 1_000_000), CLAIMS)


def _fold_claims(lease: int):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, by, since, closed = object(), None, 0, False
        for batch in batches:
            out = []
            for key, at, op, holder in zip(*(batch.column(k).to_pylist() for k in ("key", "at", "op", "holder")), strict=True):
                if key != now:
                    now, by, since, closed = key, None, 0, False
                mine = by is not None and by == holder
                if op == "done":
                    outcome = "done" if mine and not closed else "void"
                    closed = closed or outcome == "done"
                else:
                    outcome = "void" if closed else "granted" if by is None else "renewed" if mine else "reclaimed" if None not in (at, since) and at - since > lease else "refused"
                    if outcome in ("granted", "renewed", "reclaimed"):
                        by, since = holder, at
                out.append(outcome)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("key", "op_id", "ts", "holder")), pa.array(out, pa.string())], ["key", "op_id", "ts", "holder", "outcome"])

    return fold


class _Keyed(StatefulProcessor):
    """State of one row for each key; events of a batch in order of time, then number."""

    schema, start = "", ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", self.schema)

    def ordered(self, rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(list(rows)).sort_values(["ts", "op_id"])

    def now(self) -> tuple:
        return tuple(self.state.get()) if self.state.exists() else self.start

    def close(self) -> None:
        pass


class CacheProcessor(_Keyed):
    """The cache over micro-batches; a timer drops an entry when its time is over, so that the state holds fresh entries only."""

    schema, start = "at timestamp, value string", (None, None)

    def __init__(self, ttl: int):
        self.ttl = ttl

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, value = self.now()
        out = []
        for r in self.ordered(rows).itertuples():
            if r.op == "put":
                at, value = r.ts, r.value
                self.handle.registerTimer(int(pd.Timestamp(at).timestamp() * 1000) + self.ttl * 1000 + 1)
            elif r.op == "get":
                hit = at is not None and value is not None and pd.Timestamp(r.ts) - pd.Timestamp(at) <= pd.Timedelta(seconds=self.ttl)
                out.append((key[0], r.op_id, r.ts, value if hit else None, hit))
        if at is not None:
            self.state.update((pd.Timestamp(at).to_pydatetime(), value))
        yield pd.DataFrame(out, columns=["key", "op_id", "ts", "value", "hit"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, _ = self.now()
        if at is not None and pd.Timestamp(at).timestamp() * 1000 + self.ttl * 1000 < expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        yield pd.DataFrame([], columns=["key", "op_id", "ts", "value", "hit"])


class LeaseProcessor(_Keyed):
    """Claims over micro-batches."""

    schema, start = "by string, at timestamp, closed boolean", (None, None, False)

    def __init__(self, lease: int):
        self.lease = pd.Timedelta(seconds=lease)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        by, at, closed = self.now()
        out = []
        for r in self.ordered(rows).itertuples():
            if r.op == "claim":
                outcome = "void" if closed else "granted" if by is None else "renewed" if by == r.holder else "reclaimed" if pd.Timestamp(r.ts) - pd.Timestamp(at) > self.lease else "refused"
                if outcome in ("granted", "renewed", "reclaimed"):
                    by, at = r.holder, r.ts
            elif r.op == "done":
                outcome = "done" if by is not None and by == r.holder and not closed else "void"
                closed = closed or outcome == "done"
            else:
                continue
            out.append((key[0], r.op_id, r.ts, r.holder, outcome))
        self.state.update((by, None if at is None else pd.Timestamp(at).to_pydatetime(), closed))
        yield pd.DataFrame(out, columns=["key", "op_id", "ts", "holder", "outcome"])


def stream_cache_reads(ops: DataFrame, ttl: int = PAGE_TTL, late: str = "0 seconds") -> DataFrame:
    """``cache_reads`` of a stream whose rows come in order; needs the RocksDB state store. Entries are dropped once the watermark has passed their time."""
    return ops.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(CacheProcessor(ttl), READS, "Append", "EventTime")


def stream_lease_outcomes(ops: DataFrame, lease: int = LEASE) -> DataFrame:
    """``lease_outcomes`` of a stream whose rows come in order; needs the RocksDB state store."""
    return ops.groupBy("key").transformWithStateInPandas(LeaseProcessor(lease), CLAIMS, "Append", "None")
