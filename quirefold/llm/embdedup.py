"""Near-duplicate embeddings: random-hyperplane tables, exact cosine verification, components."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from quirefold.llm.common import batches, discard_others, groups, in_arrow, materialise, quoted, type_of, written
from quirefold.llm.graph import connected_components
from quirefold.llm.neardup import marked
from quirefold.llm.shingles import mix64

COSINE = 0.98
#: A pair right at the threshold is missed by all tables with this probability.
MISS = 1e-7
#: Bits of a table's code: about as many as the logarithm of the number of vectors, so that unrelated vectors seldom meet.
LEAST_BITS = 8
SEED = 98
#: Rows of a bucket that one block holds; larger buckets are dealt out as pairs of blocks.
BLOCK = 1024
#: Nodes whose links a task sums up before it hands them on.
GATHER = 100_000


def plan(vectors: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """(tables, bits): a bit agrees with probability 1 - angle / pi, a code if all its bits do."""
    bits = max(LEAST_BITS, math.ceil(math.log2(max(2, vectors))))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return math.ceil(math.log(miss) / math.log1p(-agree)), bits


def _vectors(column: pa.Array) -> Iterator[np.ndarray | None]:
    """Each row's vector, None unless finite throughout and not zero."""
    values = column.values.to_numpy(zero_copy_only=False)  # nulls become NaN
    starts = column.offsets.to_numpy()
    for present, a, b in zip(column.is_valid().to_pylist(), starts[:-1], starts[1:]):
        v = values[a:b]
        yield v if present and len(v) and np.isfinite(v).all() and (v != 0).any() else None


def _node(label: str, vector: np.ndarray) -> tuple[int, bytes]:
    """The identity of a vector within its label, and its bytes."""
    body = (vector + vector.dtype.type(0)).tobytes()  # -0.0 becomes 0.0
    return xxhash.xxh3_64_intdigest(f"{label} ".encode() + body) - (1 << 63), body


def _planes(width: int, tables: int, bits: int) -> np.ndarray:
    return np.random.default_rng([SEED, width]).normal(size=(tables * bits, width))


def _identified(source: Iterable[pa.RecordBatch], tables: int, bits: int) -> Iterator[pa.RecordBatch]:
    """(id, label, vector) -> (id, node, salt, signs); salt is a hash of label and width, signs are the packed
    signs of the vector's products with all planes; null for what links with nothing."""
    planes: dict[int, np.ndarray] = {}
    for batch in source:
        found = [(label, v) for label, v in zip(batch.column(1).to_pylist(), _vectors(batch.column(2)))]
        nodes, salts, signs = ([None] * len(found) for _ in range(3))
        usable = [i for i, (label, v) in enumerate(found) if label is not None and v is not None]
        widths = np.array([len(found[i][1]) for i in usable])
        for width in np.unique(widths).tolist():
            at = [usable[k] for k in np.flatnonzero(widths == width)]
            if width not in planes:
                planes[width] = _planes(width, tables, bits)
            x = np.stack([found[i][1] for i in at]).astype(np.float64)
            # Only signs count; the greatest component keeps huge and tiny vectors in range.
            x = x / np.abs(x).max(axis=1, keepdims=True)
            packed = np.packbits(x @ planes[width].T >= 0, axis=1)
            for i, row in zip(at, packed):
                nodes[i] = _node(*found[i])[0]
                salts[i] = xxhash.xxh3_64_intdigest(f"{found[i][0]} {width}") - (1 << 63)
                signs[i] = row.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(salts, pa.int64()), pa.array(signs, pa.binary())], names=["id", "node", "salt", "signs"])


def _bodies(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, vector) -> (node, vector) of what may link."""
    for batch in source:
        found = [_node(label, v) for label, v in zip(batch.column(0).to_pylist(), _vectors(batch.column(1))) if label is not None and v is not None]
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([b for _, b in found], pa.binary())], names=["node", "vector"])


def _codes(signs: list[bytes], tables: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows by tables * bits signs as booleans, rows by tables codes)."""
    packed = np.frombuffer(b"".join(signs), dtype=np.uint8).reshape(len(signs), -1)
    flat = np.unpackbits(packed, axis=1, count=tables * bits).astype(bool)
    return flat, (flat.reshape(len(signs), tables, bits) * (1 << np.arange(bits)).astype(np.uint64)).sum(axis=2).astype(np.uint64)


def _tabled(source: Iterable[pa.RecordBatch], tables: int, bits: int) -> Iterator[pa.RecordBatch]:
    """(node, salt, signs) -> (key, node) for each table: a hash of label, width, table and the table's signs."""
    for batch in source:
        for lo in range(0, batch.num_rows, 2000):
            part = batch.slice(lo, 2000)
            _, codes = _codes(part.column(2).to_pylist(), tables, bits)
            keys = _keys(codes, part.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), tables))], names=["key", "node"])


def _keys(codes: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """The bucket of each row in each table."""
    tables = np.arange(codes.shape[1], dtype=np.uint64)
    return mix64(mix64(codes + np.uint64(1 << 32) * tables) ^ salt.view(np.uint64)[:, None]).view(np.int64)


def _first_here(key: int, salt: int, left: np.ndarray, right: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether pairs (x, y) of rows of left and right, which share the bucket key, share none of an earlier table."""
    table = int(np.flatnonzero(_keys(left[:1], np.array([salt]))[0] == key)[0])
    new = np.ones(len(x), dtype=bool)
    for t in range(table):
        new &= left[x, t] != right[y, t]
    return new


def _cells(source: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """((key, i, j), left, right) of sorted rows (key, i, j, own, ..): the rows of each block or pair of blocks of a bucket."""
    for (key, i, j), rows in groups(source, 3):
        left = [r for r in rows if r[0] == i]
        right = left if i == j else [r for r in rows if r[0] == j]
        if left and right and (i != j or len(left) > 1):
            yield (key, i, j), left, right


def _meeting(source: Iterable[pa.RecordBatch], tables: int, bits: int, most: int) -> Iterator[pa.RecordBatch]:
    """(key, i, j, own, node) of the rows (key, i, j, own, node, salt, signs) that may have a link that is to be counted
    here: their signs differ in no more than `most` places, and they share no bucket of an earlier table."""
    columns = {"key": pa.int64(), "i": pa.int32(), "j": pa.int32(), "own": pa.int32(), "node": pa.int64()}

    def rows() -> Iterator[tuple]:
        for (key, i, j), left, right in _cells(source):
            sides = [_codes([r[3] for r in side], tables, bits) for side in (left, right)]
            x, y = (flat.astype(np.float32) * 2 - 1 for flat, _ in sides)
            near = (tables * bits - x @ y.T) / 2 <= most
            if i == j:
                near = np.triu(near, 1)
            p, q = np.nonzero(near)
            if len(p):
                new = _first_here(key, left[0][2], sides[0][1], sides[1][1], p, q)
                kept = {(left[k][0], left[k][1]) for k in np.unique(p[new]).tolist()} | {(right[k][0], right[k][1]) for k in np.unique(q[new]).tolist()}
                yield from ((key, i, j, own, node) for own, node in sorted(kept))

    yield from batches(columns, rows())


def most_different(tables: int, bits: int, cosine: float) -> int:
    """Signs in which a pair at the threshold differs at most, but for eight standard errors (chance under 1e-10)."""
    n, part = tables * bits, math.acos(cosine) / math.pi
    return math.ceil(n * part + 8 * math.sqrt(n * part * (1 - part)) + 8)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of all rows of a and b in double precision, scaled first so that no square overflows."""
    a, b = (x / np.abs(x).max(axis=1, keepdims=True) for x in (a.astype(np.float64), b.astype(np.float64)))
    return (a @ b.T) / np.sqrt((a * a).sum(axis=1))[:, None] / np.sqrt((b * b).sum(axis=1))[None, :]


def _linked(source: Iterable[pa.RecordBatch], tables: int, bits: int, cosine: float, dtype: str) -> Iterator[pa.RecordBatch]:
    """Per bucket block: (node, null, links) sums of linked vectors and (a, b, 0) edges of a forest.

    Input is sorted by (key, i, j); rows hold own block, node, salt, signs, copies, vector.  A pair counts
    in the first table in which both share a bucket, so each link counts once.
    """
    links: dict[int, int] = {}
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def out() -> pa.RecordBatch:
        edges = [(x, r) for x in parent if (r := root(x)) != x]
        a = [*links, *(e[0] for e in edges)]
        b = [*[None] * len(links), *(e[1] for e in edges)]
        n = [*links.values(), *[0] * len(edges)]
        links.clear()
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "links"])

    for (key, i, j), left, right in _cells(source):
        vectors = [np.frombuffer(b"".join(r[5] for r in side), dtype=dtype).reshape(len(side), -1) for side in (left, right)]
        near = cosines(*vectors) >= cosine
        if i == j:
            near = np.triu(near, 1)
        x, y = np.nonzero(near)
        if not len(x):
            continue
        codes = [_codes([r[3] for r in side], tables, bits)[1] for side in (left, right)]
        new = _first_here(key, left[0][2], *codes, x, y)
        x, y = x[new], y[new]
        copies = [np.array([r[4] for r in side], dtype=np.int64) for side in (left, right)]
        for side, at, gained in ((left, x, copies[1][y]), (right, y, copies[0][x])):
            sums = np.bincount(at, weights=gained, minlength=len(side)).astype(np.int64)
            for k in np.flatnonzero(sums):
                node = side[k][1]
                links[node] = links.get(node, 0) + int(sums[k])
        for p, q in zip(x.tolist(), y.tolist()):
            p, q = root(left[p][1]), root(right[q][1])
            if p != q:
                parent[max(p, q)] = min(p, q)
        if len(links) > GATHER:
            yield out()
    if links:
        yield out()


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """One row per row of vectors: id_col, n_links, component_id, kept.

    Vectors of one non-null label and one length are linked from a cosine of `cosine` on, in double precision; n_links
    counts the other rows linked directly, component_id is the smallest id reachable and kept marks the rows that bear it.
    Vectors that are null, empty or zero, or hold a null or non-finite component, and vectors without a
    label, link with nothing.

    Equal vectors of a label become one node with a count.  plan() tables of random-hyperplane codes put
    nodes into buckets, blocks of at most BLOCK rows, in which the packed signs of all tables are compared
    first: unrelated vectors differ in half of them, so hardly any but linked ones go on.  These
    fetch their vectors and are compared exactly, each pair in one bucket only.  Links are
    summed per node and edges shrunk to forests inside the tasks, so what leaves them is linear in the
    members of the buckets, not in the pairs.  Every row is indexed; a link is missed with probability MISS at most.
    Rows with equal ids are rows of their own; a null id names no component that has another.  Very long vectors are
    compared whole, an empty table gives no rows, and other columns are ignored, whatever their names.
    """
    before = written()
    kind = type_of(vectors, id_col)
    inner = vectors.schema[vector_col].dataType
    dtype = "float32" if isinstance(inner, ArrayType) and isinstance(inner.elementType, FloatType) else "float64"
    listed = quoted(vector_col).cast("array<float>" if dtype == "float32" else "array<double>")
    source = vectors.select(quoted(id_col).alias("id"), quoted(label_col).cast("string").alias("label"), listed.alias("vector"))
    tables, bits = plan(source.count(), cosine)
    shape = {"tables": tables, "bits": bits}
    rows = source.transform(in_arrow, partial(_identified, **shape), f"id {kind}, node long, salt long, signs binary")
    rows = materialise(rows, "signs")
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("least_id"), F.count("*").alias("copies"), F.first("salt").alias("salt"), F.first("signs").alias("signs"))
    nodes = materialise(nodes, "node")

    keyed = nodes.select("node", "salt", "signs").transform(in_arrow, partial(_tabled, **shape), "key long, node long")
    shared = materialise(keyed.groupBy("key").agg(F.count("*").alias("held")).where("held > 1"), "shared")
    members = marked(keyed.select(F.col("key").alias("rid"), "node"), shared.select(F.col("key").alias("rid"))).withColumnRenamed("rid", "key")
    parts = F.ceil(F.col("held") / BLOCK).cast("int")
    cells = members.join(shared, "key").withColumn("own", F.pmod(F.hash("node"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    cells = cells.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node")
    cell = ["key", "i", "j"]
    signed = cells.join(nodes.select("node", "salt", "signs"), "node").select(*cell, "own", "node", "salt", "signs")
    signed = signed.repartition(*cell).sortWithinPartitions(*cell)
    kept = materialise(signed.transform(in_arrow, partial(_meeting, **shape, most=most_different(tables, bits, cosine)), "key long, i int, j int, own int, node long"), "meeting")

    wanted = kept.select("node").distinct()
    bodies = source.select("label", "vector").transform(in_arrow, _bodies, "node long, vector binary")
    bodies = marked(bodies.withColumnRenamed("node", "rid"), wanted.select(F.col("node").alias("rid"))).withColumnRenamed("rid", "node")
    bodies = bodies.groupBy("node").agg(F.first("vector").alias("vector")).join(nodes.select("node", "salt", "signs", "copies"), "node")
    full = kept.join(bodies, "node").select(*cell, "own", "node", "salt", "signs", "copies", "vector")
    full = full.repartition(*cell).sortWithinPartitions(*cell)
    found = materialise(full.transform(in_arrow, partial(_linked, **shape, cosine=cosine, dtype=dtype), "a long, b long, links long"), "links")

    components = connected_components(found.where("b is not null").select("a", "b"))
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    placed = nodes.select("node", "least_id", "copies").join(links, "node", "left").join(components, "node", "left")
    placed = placed.select("node", "least_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    names = placed.groupBy("component").agg(F.min("least_id").alias("component_id"))
    placed = materialise(placed.join(names, "component").select("node", "n_links", "component_id"), "placed")
    discard_others(before, rows, placed)
    out = rows.select("id", "node").join(placed, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(False)).alias("kept"))
