"""A cache of results as tables: replay of an access log, expiry, eviction, counters."""

from __future__ import annotations

import heapq
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A hit renews an entry's stamp only if that is older than this part of the time to live, and a second.
RENEW_SHARE, RENEW_LEAST = 0.01, 1.0


@dataclass
class Store:
    """One cache: entries leave `ttl` seconds after their last stamp, and the oldest go above `cap` bytes.

    entries are in order of their stamps: key -> [stamp, size, created, doc_digest, kind].
    """

    ttl: float
    cap: int
    entries: OrderedDict = field(default_factory=OrderedDict)
    total: int = 0
    last: float = float("-inf")

    @property
    def renew_after(self) -> float:
        return max(RENEW_LEAST, RENEW_SHARE * self.ttl)

    def _drop(self, key: str) -> None:
        self.total -= self.entries.pop(key)[1]

    def _expired(self, now: float) -> int:
        """Entries stand in order of their stamps, so the first that is young enough ends the search."""
        gone = 0
        while self.entries and now - self.entries[key := next(iter(self.entries))][0] > self.ttl:
            self._drop(key)
            gone += 1
        return gone

    def apply(self, ts: float, op: str, key: str | None, digest: str | None, kind: str | None, size: int | None) -> tuple[str, int, int]:
        """(outcome, expirations, evictions) of one operation."""
        if op == "get":
            entry = self.entries.get(key)
            if entry is None:
                return "miss", 0, 0
            if ts - entry[0] > self.ttl:
                self._drop(key)
                return "miss", 1, 0
            if ts - entry[0] > self.renew_after:
                entry[0] = ts
                self.entries.move_to_end(key)
            return "hit", 0, 0
        if op == "put":
            if size > self.cap:
                return "refused", 0, 0
            old = self.entries.get(key)
            if old is not None:
                self.total -= old[1]
                digest, kind, created = old[3], old[4], old[2]
            else:
                created = ts
            self.entries[key] = [ts, size, created, digest, kind]
            self.entries.move_to_end(key)
            self.total += size
            expired, evicted = self._expired(ts), 0
            while self.total > self.cap and self.entries:
                self._drop(next(iter(self.entries)))
                evicted += 1
            return "stored", expired, evicted
        if op == "delete":
            gone = [k for k, e in self.entries.items() if e[3] == digest]
            for k in gone:
                self._drop(k)
            return f"deleted {len(gone)}", 0, 0
        if op == "clear":
            gone = len(self.entries)
            self.entries.clear()
            self.total = 0
            return f"deleted {gone}", 0, 0
        raise ValueError(f"unknown operation {op!r}")


OUTCOME = "store string, seq long, ts double, op string, key string, kind string, outcome string, expirations int, evictions int, entries int, total_bytes long"


def _replayed(source: Iterable[pa.RecordBatch], ttl: float, cap: int) -> Iterator[pa.RecordBatch]:
    name, store = None, None
    for batch in source:
        columns = [c.to_pylist() for c in batch.columns]
        out = []
        for s, seq, ts, op, key, digest, kind, size in zip(*columns):
            if store is None or s != name:
                name, store = s, Store(ttl, cap)
            outcome, expired, evicted = store.apply(ts, op, key, digest, kind, size)
            out.append((s, seq, ts, op, key, kind, outcome, expired, evicted, len(store.entries), store.total))
        kinds = (pa.string(), pa.int64(), pa.float64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
        names = [c.split()[0] for c in OUTCOME.split(", ")]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)


def replay(log: DataFrame, ttl: float, cap: int) -> DataFrame:
    """The outcome of every operation of a log (store, seq, ts, op, key, doc_digest, kind, size).

    A store's operations run in order of (ts, seq), as a stream: a task holds the entries of the store at
    hand, which cap bounds, never the log.  Stores run apart.
    """
    rows = log.select("store", "seq", "ts", "op", "key", "doc_digest", "kind", "size")
    rows = rows.repartition("store").sortWithinPartitions("store", "ts", "seq")
    return rows.mapInArrow(partial(_replayed, ttl=ttl, cap=cap), OUTCOME)


def stats(outcomes: DataFrame) -> DataFrame:
    """Per kind: hits, misses, hit_rate (null without traffic), expirations and evictions."""
    hits, misses = F.count_if(F.col("outcome") == "hit"), F.count_if((F.col("op") == "get") & (F.col("outcome") == "miss"))
    rows = outcomes.groupBy("kind").agg(hits.alias("hits"), misses.alias("misses"), F.coalesce(F.sum("expirations"), F.lit(0)).alias("expirations"), F.coalesce(F.sum("evictions"), F.lit(0)).alias("evictions"))
    return rows.withColumn("hit_rate", hit_rate(F.col("hits"), F.col("misses")))


def hit_rate(hits: Column, misses: Column) -> Column:
    return F.round(hits / F.expr("nullif(hits + misses, 0)"), 4)


def sizes(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"))


def last_access(log: DataFrame) -> DataFrame:
    """Snapshot (key, last_accessed, created, doc_digest, kind, size) of what was put: first insert's
    origin, last put's size, last access of either sort."""
    put = F.col("op") == "put"
    return log.where(F.col("op").isin("put", "get")).groupBy("key").agg(
        F.max("ts").alias("last_accessed"),
        F.min(F.when(put, F.col("ts"))).alias("created"),
        F.min_by(F.when(put, F.struct("doc_digest", "kind")), F.when(put, F.struct("ts", "seq"))).alias("first"),
        F.max_by(F.when(put, F.col("size")), F.when(put, F.struct("ts", "seq"))).alias("size"),
    ).where("created is not null").select("key", "last_accessed", "created", "first.doc_digest", "first.kind", "size")


def unexpired(entries: DataFrame, now: Column, ttl: float) -> DataFrame:
    return entries.where(now - F.col("last_accessed") <= ttl)


def lru_keep(entries: DataFrame, cap: int, by: str = "store") -> DataFrame:
    """entries of each store, newest first, as long as their sizes fit in cap together; of equal
    stamps the greater key goes first."""
    newest = Window.partitionBy(by).orderBy(F.col("last_accessed").desc(), "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return entries.withColumn("_held", F.sum("size").over(newest)).where(F.col("_held") <= cap).drop("_held")


def opened(entries: DataFrame, version: int, wanted: int, schema: str = "key string, last_accessed double, created double, doc_digest string, kind string, size long") -> tuple[DataFrame, DataFrame]:
    """(entries that a store of this version may use, rows set aside): all are set aside from a store of another version,
    and otherwise those that no store can have written, without a key, with a negative size or from before their creation."""
    good = F.col("key").isNotNull() & (F.col("size") >= 0) & (F.col("last_accessed") >= F.col("created"))
    good = F.coalesce(good, F.lit(False)) & F.lit(version == wanted)
    names = [c.split()[0] for c in schema.split(", ")]
    return entries.where(good).select(*names), entries.where(~good).select(*names)


def purged(entries: DataFrame, digests: DataFrame) -> DataFrame:
    """(doc_digest, entries, total_bytes) that without_document() takes away, a row for each digest asked for."""
    asked = digests.select("doc_digest").distinct()
    rows = asked.join(entries.select("doc_digest", "size"), "doc_digest", "left").groupBy("doc_digest")
    return rows.agg(F.count("size").alias("entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"))


def lookups(requests: DataFrame, entries: DataFrame, ttl: float) -> DataFrame:
    """requests (key, now) with outcome: hit, expired or miss."""
    rows = requests.join(entries.select("key", "last_accessed"), "key", "left")
    outcome = F.when(F.col("last_accessed").isNull(), "miss").when(F.col("now") - F.col("last_accessed") > ttl, "expired").otherwise("hit")
    return rows.withColumn("outcome", outcome)


def upsert(entries: DataFrame, puts: DataFrame) -> DataFrame:
    """entries after puts (key, doc_digest, kind, size, ts): new sizes and stamps, old origins."""
    old = entries.select("key", "last_accessed", "created", "doc_digest", "kind", "size", F.lit(0).alias("_new"))
    new = puts.select("key", F.col("ts").alias("last_accessed"), F.col("ts").alias("created"), "doc_digest", "kind", "size", F.lit(1).alias("_new"))
    first, last = F.struct("_new", "created"), F.struct("_new", "last_accessed")
    rows = old.unionByName(new).groupBy("key").agg(F.max("last_accessed").alias("last_accessed"), F.min_by(F.struct("created", "doc_digest", "kind"), first).alias("o"), F.max_by("size", last).alias("size"))
    return rows.select("key", "last_accessed", "o.created", "o.doc_digest", "o.kind", "size")


def without_document(entries: DataFrame, digests: DataFrame) -> DataFrame:
    return entries.join(digests.select("doc_digest"), "doc_digest", "left_anti").select(*entries.columns)


def single_flight(requests: DataFrame) -> DataFrame:
    """requests (key, ts, request_id) with leader: the first of its key does the work for all.

    Leaders are found by partial aggregation and joined back, so a request that very many make at once is
    no single task's work; adaptive execution splits the join.
    """
    leaders = requests.groupBy("key").agg(F.min_by("request_id", F.struct("ts", "request_id")).alias("leader"))
    return requests.join(leaders, "key").select(*requests.columns, "leader", (F.col("leader") == F.col("request_id")).alias("leads"))


def shared_outcomes(requests: DataFrame, results: DataFrame) -> DataFrame:
    """requests of single_flight() with the outcome that their leader had: all of a flight get its result or its error.

    results has (leader, result, error).  A leader without a row timed out: status 504, as for an error
    "timeout"; any other error is 500, none 200.
    """
    rows = requests.join(results.select("leader", "result", "error", F.lit(True).alias("_ended")), "leader", "left")
    error = F.when(F.col("_ended").isNull(), F.lit("timeout")).otherwise(F.col("error"))
    rows = rows.withColumn("error", error)
    status = F.when(F.col("error").isNull(), 200).when(F.col("error") == "timeout", 504).otherwise(500)
    return rows.select(*requests.columns, F.when(status == 200, F.col("result")).alias("result"), "error", status.alias("status"))


def admitted(requests: DataFrame, slots: int, waiting: int) -> DataFrame:
    """requests (store, ts, seconds, request_id) with start, end and status: `slots` run at a time, `waiting` more may
    wait, and what comes beyond is refused with 429.

    Each store's requests run in order of (ts, request_id), as a stream: a task holds at most slots and
    waiting times, never the log.
    """
    rows = requests.select("store", "ts", "seconds", "request_id").repartition("store").sortWithinPartitions("store", "ts", "request_id")
    return rows.mapInArrow(partial(_admitted, slots=slots, waiting=waiting), "store string, ts double, seconds double, request_id long, start double, `end` double, status int")


def _admitted(source: Iterable[pa.RecordBatch], slots: int, waiting: int) -> Iterator[pa.RecordBatch]:
    name, running, queued = None, [], []  # ends of the slots in use, starts of those that wait
    for batch in source:
        columns = [c.to_pylist() for c in batch.columns]
        begun, ended, status = [], [], []
        for store, ts, seconds, _ in zip(*columns):
            if store != name:
                name, running, queued = store, [], []
            queued = [s for s in queued if s > ts]
            # With slots free by now a request starts at once, else when the slot that ends first does.
            start = ts if len(running) < slots else max(ts, running[0])
            if start > ts and len(queued) >= waiting:
                begun.append(None), ended.append(None), status.append(429)
                continue
            if len(running) == slots:
                heapq.heappop(running)
            heapq.heappush(running, start + seconds)
            if start > ts:
                queued.append(start)
            begun.append(start), ended.append(start + seconds), status.append(200)
        added = [pa.array(begun, pa.float64()), pa.array(ended, pa.float64()), pa.array(status, pa.int32())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=["store", "ts", "seconds", "request_id", "start", "end", "status"])
