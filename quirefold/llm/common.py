"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch on its way to a Python worker, unless the session says otherwise; a longer row is a batch alone.
ARROW_BYTES = 4 << 20
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"

_made: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bound_batches(spark: SparkSession) -> None:
    if spark.conf.get(_ARROW, None) is None:
        spark.conf.set(_ARROW, str(ARROW_BYTES))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir.  Where that is unset, a temporary folder stands in if driver
    and executors are one process; on a cluster it would be another one on every machine, so that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='quirefold-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared scratch folder and read it back: the lineage ends there, and what was
    written outlives any executor.  Files stay until discard() or, at the latest, the end of the driver's Python."""
    spark = df.sparkSession
    _bound_batches(spark)
    path = f"{scratch_dir(spark)}/quirefold/{tag}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_remove)
    _made[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quirefold_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what materialise() wrote for these; nothing that is still to be computed may read them."""
    for df in frames:
        _delete(df._quirefold_path)
    for spark in {id(df.sparkSession): df.sparkSession for df in frames}.values():
        collect_driver(spark)


def written() -> set[str]:
    """Paths of all that materialise() wrote and that is still there."""
    return set(_made)


def discard_others(before: set[str], *kept: DataFrame) -> None:
    """Delete what was written since written() gave before, but for kept."""
    for path in written() - before - {df._quirefold_path for df in kept}:
        _delete(path)
    for df in kept[:1]:
        collect_driver(df.sparkSession)


def collect_driver(spark: SparkSession) -> None:
    """The driver's memory of what is over goes back to the system: plans, classes made for them and buffers outlive
    their queries until the JVM collects its garbage, which it puts off by letting its heap grow."""
    gc.collect()
    with contextlib.suppress(Exception):  # only memory is at stake
        spark.sparkContext._jvm.System.gc()
    _hand_back()


def _delete(path: str) -> None:
    spark = _made.pop(path, None)
    if spark is None:
        return
    with contextlib.suppress(Exception):  # at exit the JVM may be gone, and the files with it
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _remove() -> None:
    for path in list(_made):
        _delete(path)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def _hand_back() -> None:
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def _tidied(source: Iterator[pa.RecordBatch], work: Callable) -> Iterator[pa.RecordBatch]:
    """work's batches; at the end of the task the memory that it freed goes back to the system, as the
    worker lives on beside the next ones."""
    try:
        yield from work(source)
    finally:
        _hand_back()


def in_arrow(df: DataFrame, work: Callable, schema) -> DataFrame:
    """df.mapInArrow(work, schema), with memory handed back after each task."""
    return df.mapInArrow(partial(_tidied, work=work), schema)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added to those that a column of df has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def every(df: DataFrame) -> list[Column]:
    return [quoted(c) for c in df.columns]


def batches(columns: dict[str, pa.DataType], rows: Iterable[tuple], size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Record batches of at most size rows from tuples."""
    schema, held = pa.schema(list(columns.items())), []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), columns.values())], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), columns.values())], schema=schema)


def merged(source: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Adjoining batches as one, up to about `size` bytes; for work that is quicker on many rows at once."""
    held: list[pa.RecordBatch] = []
    for batch in source:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def groups(source: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal first `keys` columns from batches sorted by them."""
    held: list[tuple] = []
    last: tuple | None = None
    for batch in source:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != last:
                if held:
                    yield last, held
                last, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield last, held


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()
