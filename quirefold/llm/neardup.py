"""Near-duplicate documents by HyperMinHash, with every link confirmed on full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm import shingles as S
from quirefold.llm.common import discard_others, every, groups, in_arrow, materialise, quoted, type_of, unused, written
from quirefold.llm.graph import connected_components

#: Documents are linked from 75 hundredths of Jaccard similarity.
PERCENT = 75
#: A pair goes to verification from this estimate.  With all 256 registers filled, sets of some 1,000 shingles on, its
#: standard error is at most 0.027, so a pair at the threshold lies more than five of them above.  With k filled
#: registers the error is about 0.43 / sqrt(k), 0.054 at FEW: under three of them, but the registers of small sets are
#: far from independent draws (nearly every one holds one or two shingles), and of the pairs at 0.75 that the tests draw
#: from sets of any size none is lost.  Under FEW the lower bound holds.
ESTIMATE, ESTIMATE_FEW, FEW = 0.60, 0.35, 64
#: Pairs that a task gathers before it deals them out for verification.
GATHER = 200_000
#: Bits of the filters that keep most band keys and texts from crossing the cluster; when one fills up, more
#: cross than are needed, never less.
FILTER_BITS = 1 << 24
#: Rows of a bucket that one block holds; larger buckets are dealt out as pairs of blocks.
BLOCK = 2048
#: Sets that one block of the verification holds, about.
SETS = 4000


def _sketches(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        for lo in range(0, batch.num_rows, 2000):
            part = batch.slice(lo, 2000)
            nodes, sizes, sigs = [], [], []
            for body in part.column(2).to_pylist():
                hashes = S.shingle_set(body)
                sizes.append(len(hashes))
                nodes.append(xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63) if len(hashes) else None)
                sigs.append(S.registers(hashes).tobytes() if len(hashes) else None)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())], names=["id", "rid", "node", "n", "sig"])


def _rows(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), dtype=np.uint16).reshape(-1, S.BUCKETS)


def _bands(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        for lo in range(0, batch.num_rows, 2000):
            part = batch.slice(lo, 2000)
            keys = S.band_keys(_rows(part.column(1).to_pylist()))
            nodes = np.repeat(part.column(0).to_numpy(), S.BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(nodes)], names=["key", "node"])


def _block_of(nodes: np.ndarray, blocks: int) -> np.ndarray:
    return (S.mix64(np.asarray(nodes, dtype=np.int64).view(np.uint64)) % np.uint64(blocks)).astype(np.int64)


def _likely(a: np.ndarray, b: np.ndarray, n_a, n_b) -> np.ndarray:
    filled = ((a | b) != 0).sum(axis=-1)
    return S.estimate(a, b, n_a, n_b) >= np.where(filled < FEW, ESTIMATE_FEW, ESTIMATE)


_TO_VERIFY = "block long, pair int, node long, a array<long>, b array<long>"
_OUT = pa.schema([("block", pa.int64()), ("pair", pa.int32()), ("node", pa.int64()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64()))])


def _dealt(a: np.ndarray, b: np.ndarray, blocks: int) -> pa.RecordBatch:
    """Pairs as one row (block, 1, null, a, b) for each pair of blocks, and rows (block, 0, node) where a set is needed."""
    ha, hb = _block_of(a, blocks), _block_of(b, blocks)
    cell = np.minimum(ha, hb) * blocks + np.maximum(ha, hb)
    order = np.argsort(cell, kind="stable")
    rows = []
    for x in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
        where = int(cell[x[0]])
        rows.append((where, 1, None, a[x].tolist(), b[x].tolist()))
        rows += [(where, 0, node, None, None) for node in np.union1d(a[x], b[x]).tolist()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_OUT.types)], schema=_OUT)


def _estimated(source: Iterable[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    """Keeps pairs (a, n_a, sig_a, b, n_b, sig_b) whose corrected estimate is high enough."""
    for batch in source:
        for lo in range(0, batch.num_rows, 2000):
            part = batch.slice(lo, 2000)
            a, n_a, b, n_b = (part.column(i).to_numpy() for i in (0, 1, 3, 4))
            keep = _likely(_rows(part.column(2).to_pylist()), _rows(part.column(5).to_pylist()), n_a, n_b)
            if keep.any():
                yield _dealt(a[keep], b[keep], blocks)


def _across(source: Iterable[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    """Pairs of different components within each bucket block or pair of blocks.

    Input is sorted by (key, i, j); rows hold node, own block, component, n, sig.  A pair is given
    only in the first band that both share, and from its estimate on.
    """
    held: list[np.ndarray] = []

    def dealt() -> pa.RecordBatch:
        pairs = np.unique(np.concatenate(held), axis=0)
        held.clear()
        return _dealt(pairs[:, 0], pairs[:, 1], blocks)

    for (key, i, j), rows in groups(source, 3):
        nodes = np.array([r[0] for r in rows], dtype=np.int64)
        own = np.array([r[1] for r in rows])
        comp = np.array([r[2] for r in rows], dtype=np.int64)
        n = np.array([r[3] for r in rows], dtype=np.int64)
        regs = _rows([r[4] for r in rows])
        left, right = [], []
        for x in np.flatnonzero(own == i):
            other = (own == j) & (comp != comp[x]) & (100 * np.minimum(n, n[x]) >= PERCENT * np.maximum(n, n[x]))
            if i == j:
                other[: x + 1] = False
            at = np.flatnonzero(other)
            if len(at):
                at = at[_likely(regs[at], regs[x], n[at], n[x])]
                left += [x] * len(at)
                right += at.tolist()
        if not left:
            continue
        keys = S.band_keys(regs)
        band = int(np.flatnonzero(keys[left[0]] == key)[0])
        left, right = np.array(left), np.array(right)
        first = ~(keys[left, :band] == keys[right, :band]).any(axis=1)
        if first.any():
            held.append(np.stack([nodes[left[first]], nodes[right[first]]], axis=1))
        if sum(map(len, held)) > GATHER:
            yield dealt()
    if held:
        yield dealt()


def _sets(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        for lo in range(0, batch.num_rows, 1000):
            part = batch.slice(lo, 1000)
            found = [S.shingle_set(body).tobytes() for body in part.column(0).to_pylist()]
            nodes = [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(found, pa.binary())], names=["node", "hashes"])


def _confirmed(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among sorted rows (block, pair, node, a, b, hashes): sets first, then pairs."""
    sets: dict[int, np.ndarray] = {}
    block = None
    for batch in source:
        links = []
        for where, pair, node, left, right, hashes in zip(*(batch.column(k).to_pylist() for k in range(6))):
            if where != block:
                block = where
                sets.clear()
            if not pair:
                sets[node] = np.frombuffer(hashes, dtype=np.uint64)
                continue
            for a, b in zip(left, right):
                x, y = sets[a], sets[b]
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                if 100 * len(small) < PERCENT * len(large):
                    continue
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                common = int((large[at] == small).sum())
                if 100 * common >= PERCENT * (len(x) + len(y) - common):
                    links.append((a, b))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _verified(dealt: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) of the rows of _TO_VERIFY, checked on full sets, one pair of blocks at a time."""
    wanted = dealt.where("pair = 0").select("block", "node").distinct()
    none = F.lit(None).cast("array<long>")
    shipped = wanted.join(sets, "node").select("block", F.lit(0).alias("pair"), "node", none.alias("a"), none.alias("b"), "hashes")
    pairs = dealt.where("pair = 1").select("*", F.lit(None).cast("binary").alias("hashes"))
    rows = shipped.unionByName(pairs).repartition("block").sortWithinPartitions("block", "pair")
    return materialise(rows.transform(in_arrow, _confirmed, "a long, b long"), "link")


def marked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose rid may be wanted: their bits in a bitmap of FILTER_BITS are set.

    The bitmap is a table of at most FILTER_BITS / 64 rows, which bounds what is broadcast.
    """
    place = F.pmod("rid", F.lit(FILTER_BITS))
    word, bit = F.floor(place / 64).cast("int"), (place % 64).cast("int")
    bitmap = wanted.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits"))
    kept = rows.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(bitmap), "_word").where("getbit(_bits, _bit) = 1")
    return kept.select(*rows.columns)


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(quoted(id_col).cast("string"), quoted(text_col))


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): (id, rid, node, n, sig) of each row, and (node, least_id, component)."""
    before = written()
    kind = type_of(docs, id_col)
    rows = docs.select(quoted(id_col).alias("id"), row_key(id_col, text_col).alias("rid"), quoted(text_col).cast("binary").alias("body"))
    sketches = materialise(rows.transform(in_arrow, _sketches, f"id {kind}, rid long, node long, n long, sig binary"), "sketch")
    nodes = materialise(sketches.where("node is not null").groupBy("node").agg(F.min("id").alias("least_id"), F.min("rid").alias("rid"), F.max("n").alias("n"), F.first("sig").alias("sig")), "node")

    banded = nodes.select("node", "sig").transform(in_arrow, _bands, "key long, node long")
    shared = materialise(banded.groupBy("key").agg(F.count("*").alias("held"), F.min("node").alias("head")).where("held > 1"), "shared")
    # Most keys have one node; the bitmap keeps nearly all of them from crossing the cluster again.
    likely = marked(banded.select(F.col("key").alias("rid"), "node"), shared.select(F.col("key").alias("rid"))).withColumnRenamed("rid", "key")
    members = materialise(likely.join(shared, "key"), "member")

    found = members.select("node").distinct()
    many = found.count()
    blocks = max(4, math.ceil(many / SETS))
    # A node has one rid; the text decides which node it is, so a chance collision does no harm.
    wanted = nodes.join(found, "node", "left_semi").select("rid")
    texts = marked(rows.select("rid", "body"), wanted).join(wanted, "rid").dropDuplicates(["rid"]).select("body")
    sets = materialise(texts.transform(in_arrow, _sets, "node long, hashes binary"), "set")

    sided = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    heads = members.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    heads = heads.join(sided("a"), "a").join(sided("b"), "b").select("a", "n_a", "sig_a", "b", "n_b", "sig_b")
    dealt = materialise(heads.transform(in_arrow, partial(_estimated, blocks=blocks), _TO_VERIFY), "star")
    linked = connected_components(_verified(dealt, sets))
    linked = materialise(linked, "linked")

    placed = members.join(linked, "node", "left").select("key", "node", "held", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    parts = F.ceil(F.col("held") / BLOCK).cast("int")
    cells = placed.join(mixed, "key").withColumn("own", F.pmod(F.hash("node"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    cells = cells.join(nodes.select("node", "n", "sig"), "node")
    cells = cells.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "own", "component", "n", "sig")
    cells = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    dealt = materialise(cells.transform(in_arrow, partial(_across, blocks=blocks), _TO_VERIFY), "across")
    late = _verified(dealt, sets)
    if not late.isEmpty():
        linked = connected_components(late.unionByName(linked.select(F.col("node").alias("a"), F.col("component").alias("b"))))

    named = nodes.select("node", "least_id").join(linked, "node", "left")
    # Written, so that the joins of rows by node read plain exchanges, which adaptive execution can split.
    named = materialise(named.select("node", "least_id", F.coalesce("component", "node").alias("component")), "named")
    discard_others(before, sketches, named)
    return sketches, named


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id, kept.

    Documents are linked when their shingle sets (see shingles.py) have a Jaccard similarity of
    PERCENT hundredths or more.  component_id is the smallest id reachable over links, kept marks
    the rows that bear it.

    1. Every row gets its set's size, identity (a 64-bit hash of the set) and HyperMinHash sketch.
       Equal sets become one node, by partial aggregation, so copies never meet pairwise.
    2. Banded registers put nodes into buckets: 64 bands of 4 densified registers.  A pair
       exactly at the threshold is missed with probability 3e-11, at 0.8 with 2e-15.  Each member is
       paired with its bucket's smallest node, the collision-corrected estimate drops clear misses, and full sets decide.
    3. After the components of those links, the pairs that are left are those within a bucket but
       across components.  They are estimated in blocks and verified likewise, so that no link
       between components is lost, while a large group of near copies, one component by then, costs nothing.

    Texts without words (null, empty, blank) have n_shingles 0 and stand alone.  Rows with equal
    ids are rows of their own that share the id; a null id never names a component unless the
    component has no other, and such rows are not kept.  Columns beside the two named are ignored.
    """
    sketches, named = _grouped(docs, id_col, text_col)
    names = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = named.join(names, "component").select("node", "component_id")
    out = sketches.select("id", "n", "node").join(named, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(False)).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near_duplicates(): that of the smallest id, or with null ids only any one.

    Rows equal in id and text are one document.  Documents without words, null texts among them, all stay; very long
    texts are compared as a whole; an empty table stays empty.  All columns are carried, whatever their names.
    """
    sketches, named = _grouped(docs, id_col, text_col)
    kind = type_of(docs, id_col)
    placed = sketches.where("node is not null").select("id", "rid", "node").join(named.select("node", "component"), "node")
    first = placed.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("first"))
    keep = first.select(F.col("first.id").cast(kind).alias("id"), F.col("first.rid").alias("rid"))
    keep = keep.unionByName(sketches.where("node is null").select("id", "rid")).distinct()
    row, rid, ident = unused(docs, "_row", "_rid", "_id")
    keep = keep.select(F.col("id").alias(ident), F.col("rid").alias(rid))
    keyed = docs.select(*every(docs), row_key(id_col, text_col).alias(row))
    kept = keyed.join(keep, F.col(row).eqNullSafe(F.col(rid)) & quoted(id_col).eqNullSafe(F.col(ident)), "left_semi")
    return kept.dropDuplicates([row, id_col]).select(*every(docs))
