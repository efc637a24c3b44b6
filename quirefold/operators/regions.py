"""Figure regions from vector drawings: proximity, components, gaps, neighbours."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirefold.functions import geometry as G
from quirefold.functions import text as X
from quirefold.lineage import cut
from quirefold.operators.layout import reading_order_of_tables
from quirefold.operators.tables import filled_share

PAGE = ("doc_id", "page_num")
#: Drawings a page needs; the smallest side and the largest part of the page that a drawing may have.
PAGE_DRAWINGS, LEAST_SIDE, LARGEST_SHARE = 30, 2.0, 0.4
#: Reach between drawings of one cluster, members and solid ones a cluster needs, its least size, and its margin.
REACH, MEMBERS, SOLID, LEAST_WIDTH, LEAST_HEIGHT, PADDING = 3.0, 8, 4, 80.0, 60.0, 6.0
#: A gap that parts a cluster, the reach for captions, and the overlap that makes something a neighbour.
GAP, CAPTION_REACH, NEIGHBOUR, NEIGHBOUR_SPACE = 40.0, 30.0, 0.3, 4.0
#: A grid this full with fewer sloped drawings hides the regions that lie on it by half.
TABLE_FILLED, SLOPED_IN_TABLE, ON_TABLE = 0.45, 3, 0.5
#: Text this far inside a region is its label.
LABEL_SHARE = 0.8
#: Side of the cells by which near drawings find each other.
CELL = 64.0
#: Rows of clusters that a task hands on at once.
BATCH = 10_000


def usable_drawings(drawings: DataFrame, pages: DataFrame) -> DataFrame:
    """Drawings of pages with enough of them, less specks and backgrounds, with solid and sloped.

    Whether a drawing is sloped is settled first, so that paths cross the cluster only if the caller keeps them.
    """
    page = Window.partitionBy(*PAGE)
    rows = drawings.withColumn("sloped", is_sloped(F.col("ops"))).withColumn("_n", F.count(F.lit(1)).over(page)).where(F.col("_n") >= PAGE_DRAWINGS).drop("_n")
    rows = rows.join(pages.select(*PAGE, F.col("width").alias("_w"), F.col("height").alias("_h")), list(PAGE))
    b = G.box()
    thin_w, thin_h = G.width(b) < LEAST_SIDE, G.height(b) < LEAST_SIDE
    rows = rows.where(~(thin_w & thin_h) & (G.width(b) * G.height(b) <= LARGEST_SHARE * F.col("_w") * F.col("_h")))
    return rows.withColumn("solid", ~(thin_w | thin_h)).drop("_w", "_h")


def is_sloped(ops: Column) -> Column:
    """A curve, or a line that is more than a point off both axes."""
    slant = lambda o: (o["op"] == "c") | ((o["op"] == "l") & (F.abs(o["ax"] - o["bx"]) > 1) & (F.abs(o["ay"] - o["by"]) > 1))
    return F.coalesce(F.exists(ops, slant), F.lit(False))


def near_pairs(drawings: DataFrame, slack: float = REACH, cell: float = CELL) -> DataFrame:
    """(doc_id, page_num, a, b): drawings of a page within slack of each other, a < b.

    A self-join on the page and on the cells of a grid that the widened boxes touch, never a cross product.
    Each pair is kept only in the first cell that both touch, so it comes once.
    """
    span = lambda lo, hi: (F.floor((F.col(lo) - slack) / cell), F.floor((F.col(hi) + slack) / cell))
    (left, right), (top, bottom) = span("x0", "x1"), span("y0", "y1")
    rows = drawings.select(*PAGE, "drawing_id", "x0", "y0", "x1", "y1", left.alias("left"), top.alias("top"), bottom.alias("bottom"), F.explode(F.sequence(left, F.greatest(left, right))).alias("across"))
    rows = rows.withColumn("down", F.explode(F.sequence("top", F.greatest("top", "bottom")))).drop("bottom")
    a, b = rows.alias("a"), rows.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in (*PAGE, "across", "down")]
    first = (F.col("a.across") == F.greatest("a.left", "b.left")) & (F.col("a.down") == F.greatest("a.top", "b.top"))
    pairs = a.join(b, [*same, F.col("a.drawing_id") < F.col("b.drawing_id"), first, G.close(G.box("a"), G.box("b"), slack)])
    return pairs.select(F.col("a.doc_id"), F.col("a.page_num"), F.col("a.drawing_id").alias("a"), F.col("b.drawing_id").alias("b"))


def _roots(ids: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """The smallest id that each box of a page reaches over boxes that meet, edges included; ids ascend.

    A sweep along x over a segment tree along y.  cover[v] is the box that spans v and lasts longest, below[v] holds
    the boxes that lie under v; boxes that a later one spans as a whole are one with it, so of them the one that lasts
    longest stands for all.  Each box enters a logarithmic number of lists and leaves them once: n log n steps, however
    many pairs are near.
    """
    n = len(ids)
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(x: int, y: int) -> None:
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)

    for i in np.flatnonzero(ids[1:] == ids[:-1]).tolist():  # rows of one drawing
        join(i, i + 1)
    # Ranks order coordinates as Spark does, NaN above all.
    left, right = np.split(np.unique(np.concatenate([x0, x1]), return_inverse=True)[1], 2)
    top, bottom = np.split(np.unique(np.concatenate([y0, y1]), return_inverse=True)[1], 2)
    proper = (left <= right) & (top <= bottom)
    for i in np.flatnonzero(~proper).tolist():  # turned inside out: near what reaches over both sides
        for k in np.flatnonzero((left <= right[i]) & (right >= left[i]) & (top <= bottom[i]) & (bottom >= top[i])).tolist():
            join(i, k)
    size = 1 << int(max(top.max(), bottom.max())).bit_length()
    cover, below = [-1] * (2 * size), [[] for _ in range(2 * size)]
    order = np.flatnonzero(proper)
    order = order[np.argsort(left[order], kind="stable")].tolist()
    left, right, top, bottom = left.tolist(), right.tolist(), top.tolist(), bottom.tolist()
    for i in order:
        now, until = left[i], right[i]
        lo, hi = top[i] + size, bottom[i] + size
        spanned, a, b = [], lo, hi + 1
        while a < b:
            if a & 1:
                spanned.append(a)
                a += 1
            if b & 1:
                b -= 1
                spanned.append(b)
            a >>= 1
            b >>= 1
        for v in spanned:
            c = cover[v]
            if c >= 0 and right[c] >= now:
                join(c, i)
            if c < 0 or right[c] < until:
                cover[v] = i
            if below[v]:
                alive = [c for c in below[v] if right[c] >= now]
                for c in alive:
                    join(c, i)
                below[v] = [max(alive, key=right.__getitem__)] if alive else []
        a, b = lo >> 1, hi >> 1
        while a:
            for v in (a,) if a == b else (a, b):
                c = cover[v]
                if c >= 0 and right[c] >= now:
                    join(c, i)
                below[v].append(i)
            a >>= 1
            b >>= 1
    return ids[[root(i) for i in range(n)]]


def _pages(source: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray, list[np.ndarray]]]:
    """(page, ids, sides) of each page, ids ascending, from rows sorted by page."""
    held: list[list[np.ndarray]] = []
    last = None

    def whole() -> tuple[tuple, np.ndarray, list[np.ndarray]]:
        ids, *sides = map(np.concatenate, zip(*held))
        held.clear()
        order = np.argsort(ids, kind="stable")
        return last, ids[order], [s[order] for s in sides]

    for batch in source:
        pages = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        columns = [batch.column(k).to_numpy() for k in range(2, 7)]
        starts = [i for i in range(len(pages)) if not i or pages[i] != pages[i - 1]]
        for lo, hi in zip(starts, [*starts[1:], len(pages)]):
            if held and pages[lo] != last:
                yield whole()
            last = pages[lo]
            held.append([c[lo:hi] for c in columns])
    if held:
        yield whole()


def _components(source: Iterable[pa.RecordBatch], slack: float) -> Iterator[pa.RecordBatch]:
    """Boxes sorted by page -> (doc_id, page_num, drawing_id, cluster) of drawings that are not the smallest of
    their cluster, once each."""
    done: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*done)) or [()] * 4
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=[*PAGE, "drawing_id", "cluster"])

    for page, ids, (x0, y0, x1, y1) in _pages(source):
        if len(ids) > 1:
            found = _roots(ids, x0, y0, x1 + slack, y1 + slack)  # within slack of each other: these meet
            other = np.flatnonzero((found != ids) & np.append(True, ids[1:] != ids[:-1]))
            done.extend((*page, i, c) for i, c in zip(ids[other].tolist(), found[other].tolist()))
        if len(done) >= BATCH:
            yield batch()
    yield batch()


def clusters(drawings: DataFrame, slack: float = REACH) -> DataFrame:
    """drawings with cluster, the smallest id of those linked by nearness, as near_pairs() has it.  Pairs are never
    listed: a crowded page has as many as the square of its drawings.  One page's drawings meet in a task: a page is
    bounded by what a page can hold.  Drawings without a page, an id or a side are near nothing."""
    sides = [F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    boxes = drawings.select(*PAGE, "drawing_id", *sides)
    boxes = boxes.where(" and ".join(f"{c} is not null" for c in boxes.columns)).repartition(*PAGE).sortWithinPartitions(*PAGE)
    found = boxes.mapInArrow(partial(_components, slack=slack), "doc_id string, page_num int, drawing_id long, cluster long")
    return drawings.join(found, [*PAGE, "drawing_id"], "left").withColumn("cluster", F.coalesce("cluster", "drawing_id"))


def split_by_gap(rows: DataFrame, keys: list[str], gap: float = GAP) -> DataFrame:
    """rows with part, which goes up where a row starts more than gap below all rows before it."""
    order = Window.partitionBy(*keys).orderBy("y0", "drawing_id")
    reach = F.max("y1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_starts", F.when(F.col("y0") - reach > gap, 1).otherwise(0)).withColumn("part", F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")).drop("_starts")


def raw_regions(drawings: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_num, cluster, part, box, n_drawings) of clusters that are large and solid enough, padded and kept on the page."""
    rows = clusters(usable_drawings(drawings, pages))
    whole = Window.partitionBy(*PAGE, "cluster")
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(whole)).where(F.col("_n") >= MEMBERS).drop("_n")
    rows = split_by_gap(rows, [*PAGE, "cluster"])
    boxes = rows.groupBy(*PAGE, "cluster", "part").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").cast("int").alias("n_drawings"), F.count_if("solid").alias("solid"))
    b = G.box()
    boxes = boxes.where((F.col("n_drawings") >= MEMBERS) & (F.col("solid") >= SOLID) & (G.width(b) >= LEAST_WIDTH) & (G.height(b) >= LEAST_HEIGHT))
    boxes = boxes.join(pages.select(*PAGE, "width", "height"), list(PAGE))
    padded = G.clipped((b[0] - PADDING, b[1] - PADDING, b[2] + PADDING, b[3] + PADDING), F.col("width"), F.col("height"))
    return boxes.select(*PAGE, "cluster", "part", *[c.alias(n) for c, n in zip(padded, ("x0", "y0", "x1", "y1"))], "n_drawings", "width", "height")


def neighbour_limits(regions: DataFrame, height: str = "height") -> DataFrame:
    """regions with y_min and y_max: how far up and down they may grow before the regions above and below."""
    key = [c for c in regions.columns if c in ("cluster", "part", "region_index")]
    a, b = regions.alias("a"), regions.alias("b")
    other = ~F.expr(" and ".join(f"a.{k} = b.{k}" for k in key))
    beside = G.common_width(G.box("a"), G.box("b")) >= NEIGHBOUR * F.least(G.width(G.box("a")), G.width(G.box("b")))
    joined = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in PAGE] + [other, beside], "left")
    above = F.when(F.col("b.y1") <= F.col("a.y0"), F.col("b.y1") + NEIGHBOUR_SPACE)
    below = F.when((F.col("b.y1") > F.col("a.y0")) & (F.col("b.y0") >= F.col("a.y1")), F.col("b.y0") - NEIGHBOUR_SPACE)
    limits = joined.groupBy(*[F.col(f"a.{k}").alias(k) for k in (*PAGE, *key)]).agg(F.max(above).alias("lo"), F.min(below).alias("hi"))
    return regions.join(limits, [*PAGE, *key]).withColumns({"y_min": F.greatest(F.lit(0.0), F.coalesce("lo", F.lit(0.0))), "y_max": F.least(F.col(height), F.coalesce("hi", F.col(height)))}).drop("lo", "hi")


def grown(regions: DataFrame, texts: DataFrame) -> DataFrame:
    """regions (with y_min, y_max) widened to the texts right above and below them."""
    key = [*PAGE, "cluster", "part"]
    a, t = G.box("r"), G.box("t")
    above = (F.col("t.y1") <= F.col("r.y0")) & (F.col("r.y0") - F.col("t.y1") <= CAPTION_REACH) & (F.col("t.y0") >= F.col("r.y_min"))
    below = (F.col("t.y0") >= F.col("r.y1")) & (F.col("t.y0") - F.col("r.y1") <= CAPTION_REACH) & (F.col("t.y1") <= F.col("r.y_max"))
    real = (G.width(t) != 0) & (G.height(t) != 0)
    on = [F.col(f"r.{k}") == F.col(f"t.{k}") for k in PAGE] + [real, G.common_width(a, t) >= NEIGHBOUR * G.width(t), above | below]
    joined = regions.alias("r").join(texts.alias("t"), on, "left")
    reach = joined.groupBy(*[F.col(f"r.{k}").alias(k) for k in key]).agg(*[f(f"t.{c}").alias(f"_{c}") for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])
    rows = regions.join(reach, key)
    return rows.withColumns({c: f(F.col(c), F.coalesce(f"_{c}", c)) for f, c in ((F.least, "x0"), (F.least, "y0"), (F.greatest, "x1"), (F.greatest, "y1"))}).drop("_x0", "_y0", "_x1", "_y1")


def table_like(candidates: DataFrame) -> DataFrame:
    """Candidates that look like a ruled table: rows, columns and filled cells enough."""
    return candidates.where((F.size("cells") >= 3) & (X.grid_width(F.col("cells")) >= 2) & (filled_share(F.col("cells")) >= TABLE_FILLED))


def suppressors(candidates: DataFrame, drawings: DataFrame) -> DataFrame:
    """Table-like candidates with few sloped drawings half inside."""
    t, d = G.box("t"), G.box("d")
    inside = G.common_area(d, t) >= 0.5 * F.greatest(G.area(d), F.lit(1e-9))
    on = [F.col(f"t.{k}") == F.col(f"d.{k}") for k in PAGE] + [F.col("d.sloped"), inside]
    counted = table_like(candidates).alias("t").join(drawings.alias("d"), on, "left").groupBy("t.doc_id", "t.page_num", "t.table_id").agg(F.count("d.drawing_id").alias("_sloped"))
    return candidates.join(counted.where(F.col("_sloped") < SLOPED_IN_TABLE).drop("_sloped"), [*PAGE, "table_id"])


def off_tables(regions: DataFrame, tables: DataFrame, share: float = ON_TABLE) -> DataFrame:
    """regions less those that lie on a table by `share` or more."""
    hit = [F.col(f"r.{k}") == F.col(f"t.{k}") for k in PAGE] + [G.area(G.box("r")) > 0, G.share_inside(G.box("r"), G.box("t")) >= share]
    return regions.alias("r").join(tables.alias("t"), hit, "left_anti")


def find_regions(drawings: DataFrame, pages: DataFrame, texts: DataFrame, candidates: DataFrame) -> DataFrame:
    """(doc_id, page_num, region_index, box, n_drawings) of a page's vector figures in reading order.

    Regions meet themselves and the texts several times, so they, which are few, are written first.
    """
    rows = grown(cut(neighbour_limits(cut(raw_regions(drawings, pages)))), texts)
    rows = rows.withColumns(dict(zip(("x0", "y0", "x1", "y1"), G.clipped(G.box(), F.col("width"), F.col("height")))))
    rows = rows.where((G.width(G.box()) >= 1) & (G.height(G.box()) >= 1))
    rows = off_tables(rows, suppressors(candidates, usable_drawings(drawings, pages)))
    return reading_order_of_tables(rows).select(*PAGE, F.col("pos").alias("region_index"), "x0", "y0", "x1", "y1", "n_drawings")


def without_labels(blocks: DataFrame, regions: DataFrame, share: float = LABEL_SHARE) -> DataFrame:
    """blocks less the texts that lie in a region by `share` or more."""
    hit = [F.col(f"b.{k}") == F.col(f"r.{k}") for k in PAGE] + [F.col("b.kind") == "text", G.area(G.box("b")) > 0, G.share_inside(G.box("b"), G.box("r")) >= share]
    return blocks.alias("b").join(regions.alias("r"), hit, "left_anti")


def as_blocks(regions: DataFrame, blocks: DataFrame) -> DataFrame:
    """blocks and, after them on each page, a diagram block for each region."""
    last = blocks.groupBy(*PAGE).agg(F.max("seq").alias("_last"))
    more = regions.join(last, list(PAGE), "left").select(*PAGE, (F.coalesce("_last", F.lit(-1)) + F.col("region_index")).cast("int").alias("seq"), F.lit("diagram").alias("kind"), "x0", "y0", "x1", "y1", "region_index")
    return blocks.unionByName(more, allowMissingColumns=True)

