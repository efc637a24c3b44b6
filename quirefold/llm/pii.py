"""Personal data: fixed patterns, and terms that corpus statistics show to reveal what they found.

The patterns give the protected entities.  A term discloses an entity as far as seeing it removes
the surprise of the entity: with IC(e) = -log2 p(e) and PMI(t; e) = log2 p(t, e) / (p(t) p(e)),
PMI / IC is 0 for a term that says nothing and 1 for one that is only found with the entity.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quirefold.llm import neardup
from quirefold.llm.common import batches, discard_others, every, in_arrow, materialise, quoted, type_of, unused, written

KINDS = ("email", "ip", "card", "phone")
#: Spans that the method adds: terms to generalise, and terms to remove.
QUASI, REVEAL = "quasi", "reveal"
#: Shares of an entity's information from which a term is generalised or removed.
GENERALISE, REMOVE = 0.90, 0.98
#: Terms count as seen with an entity if they are among so many next to it on either side, however far off.
WINDOW = 8
#: Different documents, exact and near copies counting once, that a disclosure must rest on.
SUPPORT = 3
#: Bits of the filters that tell tasks which terms to count or mark; when terms fill them, more is
#: counted than needed, never less.
FILTER_BITS = 1 << 22
#: Terms remembered per worker, and the longest that are (bounds its memory, not the result).
CACHE_TERMS, CACHE_CHARS = 200_000, 64
#: Terms whose counts a task holds before it hands them on.
COUNTED = 200_000

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# From inside a run of digits nothing can match that does not match from its start.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
# Runs of three letters or digits, and of two letters of which none is Latin.
_TERM = re.compile(r"[^\W_]{3,}|[^\W\d_A-Za-z\u00AA\u00BA\u00C0-\u024F\u1E00-\u1EFF]{2}(?![^\W_])")
_NOT_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, rank, kind, stop) of the patterns' matches, in order, all in time linear in the text."""
    out = []
    if "@" in text:
        free = 0  # end of the last match
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append((start, 0, "email", m.end()))
                free = m.end()
    if _DIGIT.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
                    out.append((m.start(), 1, "ip", m.end()))
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start() <= 37 and 12 <= len(digits := _NOT_DIGITS.sub("", m[0])) <= 19 and luhn(digits):
                out.append((m.start(), 2, "card", m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGITS.sub("", m[0])) <= 15:
                    out.append((m.start(), 3, "phone", m.end()))
    out.sort()
    return out


def _entity(kind: str, value: str) -> str:
    return f"{kind}:{value.lower() if kind == 'email' else value if kind == 'ip' else _NOT_DIGITS.sub('', value)}"


def _nearby(text: str, spans: list[tuple]) -> tuple[set[str], set[tuple[str, str]]]:
    """(entities, (entity, term) pairs) of a text, each once: the values found and their kinds, and the terms around."""
    entities, near = set(), set()
    free, k = [], 0  # terms outside of all spans
    merged: list[list[int]] = []
    for start, _, _, stop in spans:
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], stop)
        else:
            merged.append([start, stop])
    for m in _TERM.finditer(text):
        while k < len(merged) and merged[k][1] <= m.start():
            k += 1
        if k == len(merged) or m.end() <= merged[k][0]:
            free.append(m)
    starts = [m.start() for m in free]
    for start, _, kind, stop in spans:
        at, after = bisect_left(starts, start), bisect_left(starts, stop)
        own = _entity(kind, text[start:stop]), kind
        entities.update(own)
        near.update((e, m[0].lower()) for m in free[max(0, at - WINDOW) : at] + free[after : after + WINDOW] for e in own)
    return entities, near


_SPANS = "array<struct<start:int,rank:int,kind:string,stop:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("kind", pa.string()), ("stop", pa.int32())]))
_NEAR = "array<struct<entity:string,term:string>>"
_NEAR_TYPE = pa.list_(pa.struct([(c, pa.string()) for c in ("entity", "term")]))


def _as_spans(spans: Iterable[tuple]) -> list[dict]:
    return [dict(zip(("start", "rank", "kind", "stop"), s)) for s in spans]


def _scanned(source: Iterable[pa.RecordBatch], columns: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in source:
            for ident, rid, text in zip(*(c.to_pylist() for c in batch.columns)):
                text = text or ""
                spans = base_spans(text)
                entities, near = _nearby(text, spans) if spans else ((), ())
                # Exact copies of a text count as one by this hash of the whole of it.
                context = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)
                yield ident, rid, _as_spans(spans), sorted(entities), [{"entity": e, "term": t} for e, t in sorted(near)], context

    yield from batches(columns, rows())


class _Wanted(dict):
    """term -> whether a bitmap of hashes has it."""

    def __init__(self, bits: bytes):
        self.bits = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), bitorder="little").astype(bool)

    def __missing__(self, term: str) -> bool:
        value = bool(self.bits[xxhash.xxh64_intdigest(term, seed=42) % FILTER_BITS])
        if len(term) <= CACHE_CHARS:
            if len(self) >= CACHE_TERMS:
                self.clear()
            self[term] = value
        return value


def _counted(source: Iterable[pa.RecordBatch], bits: bytes) -> Iterator[pa.RecordBatch]:
    """(term, documents) of the wanted terms, summed over a task's rows, as far as COUNTED terms go."""
    wanted = _Wanted(bits)

    def rows() -> Iterator[tuple]:
        counts: Counter[str] = Counter()
        for batch in source:
            for text in batch.column(0).to_pylist():
                counts.update(t for t in set(_TERM.findall((text or "").lower())) if wanted[t])
            if len(counts) > COUNTED:
                yield from counts.items()
                counts.clear()
        yield from counts.items()

    yield from batches({"term": pa.string(), "documents": pa.int64()}, rows(), 20_000)


def _marked(source: Iterable[pa.RecordBatch], bits: bytes, columns: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    wanted = _Wanted(bits)

    def rows() -> Iterator[tuple]:
        for batch in source:
            for ident, rid, text in zip(*(c.to_pylist() for c in batch.columns)):
                spans = None
                for m in _TERM.finditer(text or ""):
                    if wanted[term := m[0].lower()]:
                        spans = base_spans(text) if spans is None else spans
                        if not any(a < m.end() and m.start() < b for a, _, _, b in spans):
                            yield ident, rid, term, m.start(), m.end()

    yield from batches(columns, rows())


def _bitmap(terms: DataFrame) -> bytes:
    """A filter of at most FILTER_BITS bits over the terms, gathered as a few fixed-size pieces."""
    # Spark's xxhash64 is XXH64 with seed 42, as in _Wanted.
    place = F.pmod(F.xxhash64("term"), F.lit(FILTER_BITS))
    width = 8 * 4096
    pieces = terms.select(place.alias("p")).groupBy(F.floor(F.col("p") / width).alias("piece")).agg(F.bitmap_construct_agg(F.col("p") % width).alias("bits"))
    out = bytearray(FILTER_BITS // 8)
    for row in pieces.collect():
        out[row["piece"] * 4096 : (row["piece"] + 1) * 4096] = row["bits"]
    return bytes(out)


def _key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(quoted(id_col).cast("string"), quoted(text_col))


def _different(near: DataFrame, told: DataFrame, texts: DataFrame) -> DataFrame:
    """(entity, term, documents): the documents near which the pairs of told stand, near copies, as neardup links
    them, counting once."""
    pair = F.xxhash64("entity", "term")
    # The bitmap lets a few other pairs through, which the caller's join drops.
    held = neardup.marked(near.select(pair.alias("rid"), "entity", "term", "context"), told.select(pair.alias("rid"))).select("entity", "term", "context").distinct()
    held = materialise(held, "held")
    wanted = near.join(held.select("context").distinct(), "context", "left_semi").groupBy("context").agg(F.min("rid").alias("rid"))
    wanted = materialise(wanted, "wanted")
    found = neardup.marked(texts.select("rid", "text"), wanted.select("rid")).join(wanted, "rid").dropDuplicates(["context"])
    merged = neardup.near_duplicates(materialise(found.select("context", "text"), "near_text"), "context")
    return held.join(merged.select("context", "component_id"), "context").groupBy("entity", "term").agg(F.count_distinct("component_id").alias("documents"))


def disclosures(scanned: DataFrame, texts: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, support: int = SUPPORT) -> DataFrame:
    """(term, kind, share): terms that give at least `generalise` of an entity's information, with
    kind REVEAL from `remove` on and QUASI below; share is the greatest PMI / IC over all entities.

    Entities are the values found and, as classes of their own, their kinds.  All probabilities are shares of the
    rows of the whole corpus, p(t, e) of those where t stands near e, so a table and its double give the same.
    A context is a text of its own: a disclosure rests on `support` of them that are no near copies of each
    other; only those of pairs with a share that is high enough are compared.
    """
    total = scanned.count()
    near = scanned.where(F.size("near") > 0).select("rid", "context", F.explode("near").alias("x")).select("rid", "x.entity", "x.term", "context")
    near = materialise(near, "near")
    # Rows of one context first: copies shrink in the tasks, and no count of distinct values is needed.
    alike = near.groupBy("entity", "term", "context").agg(F.count("*").alias("rows"))
    pairs = alike.groupBy("entity", "term").agg(F.sum("rows").alias("both"), F.count("*").alias("contexts"))
    pairs = materialise(pairs.where(F.col("contexts") >= support), "pairs")
    entities = scanned.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("with_entity"))
    bits = _bitmap(pairs)
    counts = texts.select("text").transform(in_arrow, partial(_counted, bits=bits), "term string, documents long").groupBy("term").agg(F.sum("documents").alias("with_term"))
    joined = pairs.join(entities, "entity").join(counts, "term")
    information = -F.log2(F.col("with_entity") / F.lit(total))
    given = F.col("both") / F.col("with_term")
    share = F.when(information > 0, (information + F.log2(given)) / information).otherwise(0.0)
    told = materialise(joined.select("entity", "term", share.alias("share")).where(F.col("share") >= generalise), "told")
    if not told.isEmpty():
        told = told.join(_different(near, told, texts).where(F.col("documents") >= support), ["entity", "term"])
    told = told.groupBy("term").agg(F.max("share").alias("share"))
    return told.select("term", F.when(F.col("share") >= remove, REVEAL).otherwise(QUASI).alias("kind"), "share")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, rid, spans, an array of (start, rank, kind, stop) in code points, by start and rank.

    Base spans come from the patterns; QUASI and REVEAL spans are the places outside of them, in any
    document, of terms in disclosures().  The corpus is read once for the patterns and the terms
    near them, once to count the documents of those terms, once to merge near copies among the documents of likely
    disclosures, and once more if any term is to be marked.  Only bitmaps of a fixed size go through the driver.  Null texts count as empty; rows with equal id and text get equal
    results; other columns are ignored.
    """
    before = written()
    kind, id_type = type_of(docs, id_col), to_arrow_type(docs.schema[id_col].dataType)
    rows = docs.select(quoted(id_col).alias("id"), _key(id_col, text_col).alias("rid"), quoted(text_col).alias("text"))
    columns = {"id": id_type, "rid": pa.int64(), "base": _SPAN_TYPE, "entities": pa.list_(pa.string()), "near": _NEAR_TYPE, "context": pa.int64()}
    scanned = materialise(rows.transform(in_arrow, partial(_scanned, columns=columns), f"id {kind}, rid long, base {_SPANS}, entities array<string>, near {_NEAR}, context long"), "scanned")
    told = materialise(disclosures(scanned, rows), "disclosures")
    discard_others(before, scanned, told)
    base = scanned.select("id", "rid", F.col("base").alias("spans"))
    if told.isEmpty():
        return base.withColumnRenamed("id", id_col)
    columns = {"id": id_type, "rid": pa.int64(), "term": pa.string(), "start": pa.int32(), "stop": pa.int32()}
    places = rows.transform(in_arrow, partial(_marked, bits=_bitmap(told), columns=columns), f"id {kind}, rid long, term string, start int, stop int").join(told, "term")
    rank = F.when(F.col("kind") == QUASI, len(KINDS)).otherwise(len(KINDS) + 1)
    more = places.groupBy("rid").agg(F.collect_set(F.struct("start", rank.alias("rank"), "kind", "stop")).alias("more"))
    joined = base.join(more, "rid", "left")
    spans = F.array_sort(F.concat("spans", F.coalesce("more", F.array().cast(_SPANS))))
    return joined.select(F.col("id").alias(id_col), "rid", spans.alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """n_<kind> counts of the base kinds, base_sha256 and spans as text, in place of rid and spans."""
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda name: F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long")
    own = F.filter("spans", lambda s: s["rank"] < len(KINDS))
    keep = [c for c in found.columns if c not in ("rid", "spans")]
    return found.select(*keep, *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(told(own), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def generalised(term: str) -> str:
    """What stands for a term: its case and rough length."""
    case = "NAME" if term[:1].isupper() else "word"
    return f"<{case}:{'short' if len(term) < 6 else 'long'}>"


def _masked(source: Iterable[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    for batch in source:
        texts = []
        for text, spans in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
            parts, last = [], 0
            for s in spans or ():
                if s["stop"] <= last:
                    continue
                if s["start"] >= last:
                    old = text[s["start"] : s["stop"]]
                    parts += [text[last : s["start"]], generalised(old) if s["kind"] == QUASI else "" if s["kind"] == REVEAL else f"<{s['kind']}>"]
                last = s["stop"]
            texts.append(text if not parts else "".join([*parts, text[last:]]))
        columns = batch.columns[:-1]
        columns[at] = pa.array(texts, batch.schema.types[at])
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with entities replaced by their kinds, REVEAL terms removed and QUASI terms generalised.

    Null and empty texts stay as they are, very long ones are treated whole, repeated rows alike; an empty table stays
    empty.  All columns are carried, whatever their names.
    """
    key, rid, spans = unused(docs, "_key", "_rid", "_spans")
    found = find(docs, id_col, text_col).where(F.size("spans") > 0).select(F.col("rid").alias(rid), F.col("spans").alias(spans)).dropDuplicates([rid])
    keyed = docs.select(*every(docs), _key(id_col, text_col).alias(key))
    joined = keyed.join(found, F.col(key) == F.col(rid), "left").select(*every(docs), F.col(spans))
    return joined.transform(in_arrow, partial(_masked, at=docs.columns.index(text_col)), docs.schema)
