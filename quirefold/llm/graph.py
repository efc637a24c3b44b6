"""Connected components of an edge table, without gathering nodes or edges anywhere."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import discard, in_arrow, materialise

#: Nodes that one task's union-find holds before it hands its forest on (bounds memory only).
FOREST_NODES = 500_000


def _forests(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict = {}

    def root(x):
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def out():
        pairs = [(x, r) for x in parent if (r := root(x)) != x]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], kind), pa.array([p[1] for p in pairs], kind)], names=["u", "v"])

    kind = None
    for batch in source:
        kind = batch.schema.types[0]
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > FOREST_NODES:
            yield out()
    if parent:
        yield out()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every u of edges (u, v), v < u, has one edge and is no v: its v is then the smallest it reaches."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").agg(F.count("*")).first()[0] == 0


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; component is the smallest node reachable.

    edges: two columns of one non-null orderable type, in any direction, repeated or not; a loop
    counts as no edge.  Each task first shrinks its edges to a forest, then large-star and small-star rounds
    run until all that is left are stars.  Each round is written to the shared folder, so that a lost
    executor costs a round at most, and the one before is deleted.  Hubs are aggregated before the shuffle, and the joins are ones
    that adaptive execution may split.
    """
    a, b = edges.columns
    kind = edges.schema[a].dataType.simpleString()
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    stars = materialise(pairs.transform(in_arrow, _forests, f"u {kind}, v {kind}").distinct(), "forest")

    while not _are_stars(stars):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # A node whose neighbours are all smaller keeps its edge to the smallest of them.
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars, old = materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars"), stars
        discard(old)
    out = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = stars.select(F.col("v").alias("node")).distinct()
    return out.unionByName(roots.select("node", F.col("node").alias("component")))
