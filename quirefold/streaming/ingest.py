"""Arriving documents as streams: the batch operators per micro-batch, and a cache as keyed state."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quirefold.operators.cache import OUTCOME, Store
from quirefold.sources.adapters import doc_blocks


def arriving_files(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """(path, modificationTime, content, doc_id) of files as they come, a bounded number at a time."""
    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", per_batch).load(folder)
    return rows.withColumn("doc_id", F.sha2("content", 256))


def arriving_rows(spark: SparkSession, folder: str, schema, per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def distinct_documents(rows: DataFrame, time: str = "modificationTime", delay: str = "1 hour") -> DataFrame:
    """Each document once while its first arrival is within the watermark: one conversion serves all."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(["doc_id"])


def streamed_blocks(documents: DataFrame) -> DataFrame:
    return doc_blocks(documents)


def per_batch(rows: DataFrame, convert: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str):
    """Runs a batch plan on every micro-batch and writes its rows under the batch's number, so that a
    batch that is run again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        convert(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


_STATE = "total long, entries string, last double"


def cache_stream(log: DataFrame, ttl: float, cap: int) -> DataFrame:
    """Outcomes of a streamed access log (store, seq, ts, op, key, doc_digest, kind, size): each store's entries are
    its state.  Within a micro-batch a store's operations run in order of (ts, seq)."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        store = Store(ttl, cap)
        if state.exists:
            total, entries, store.last = state.get
            store.total = total
            store.entries.update((k, v) for k, v in json.loads(entries))
        rows = pd.concat(list(frames)).sort_values(["ts", "seq"])
        out = []
        for r in rows.itertuples():
            size = None if pd.isna(r.size_) else int(r.size_)
            outcome, expired, evicted = store.apply(r.ts, r.op, r.key, r.doc_digest, r.kind, size)
            out.append((key[0], r.seq, r.ts, r.op, r.key, r.kind, outcome, expired, evicted, len(store.entries), store.total))
        state.update((store.total, json.dumps(list(store.entries.items())), float(rows["ts"].max())))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTCOME.split(", ")])

    rows = log.withColumnRenamed("size", "size_")
    return rows.groupBy("store").applyInPandasWithState(step, OUTCOME, _STATE, "append", GroupStateTimeout.NoTimeout)
