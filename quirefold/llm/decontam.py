"""Benchmark decontamination by pigeonhole piece search and Myers bit-parallel edit distance."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import partial

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quirefold.llm.common import batches, discard, in_arrow, materialise, quoted, type_of

#: Edits allowed, as a share of an item's characters.
BUDGET = 0.10
#: Levels of the tree over an item's pieces that a hit must pass before the whole item is compared.
LEVELS = 2
#: Items with fewer characters are looked for without edits, and only between characters that are neither letters nor digits.
SHORT = 20
#: Items are sent to the tasks in portions of about so many characters; one pass over the documents each.
PORTION_CHARS = 4_000_000


def normalise(text: str | None) -> str:
    """Lower case, runs of white space as one blank."""
    return " ".join((text or "").lower().split())


def budget(length: int, share: float = BUDGET) -> int:
    return int(length * share)


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """edits + 1 adjoining pieces of nearly equal length as (offset, piece): a text within that
    many edits of the item holds at least one of them unchanged."""
    cuts = [len(item) * j // (edits + 1) for j in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Pattern:
    """An item's bit masks for Myers' algorithm, in one machine-independent integer per character."""

    def __init__(self, item: str):
        self.length = len(item)
        self.masks: dict[str, int] = defaultdict(int)
        for i, c in enumerate(item):
            self.masks[c] |= 1 << i
        self.masks = dict(self.masks)

    def scores(self, text: Iterable[str], anchored: bool = False) -> Iterator[int]:
        """After each character, the least edit distance of the item to any suffix read so far
        (anchored: to all that was read)."""
        full, top = (1 << self.length) - 1, 1 << (self.length - 1)
        masks, step = self.masks, int(anchored)
        plus, minus, score = full, 0, self.length
        for c in text:
            same = masks.get(c, 0)
            vertical = same | minus
            horizontal = (((same & plus) + plus) ^ plus) | same
            up = minus | (full & ~(horizontal | plus))
            down = plus & horizontal
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up = (up << 1) | step
            down <<= 1
            plus = full & (down | ~(vertical | up))
            minus = up & vertical & full
            yield score


def occurrences(item: str, text: str, edits: int) -> list[tuple[int, int, int]]:
    """Best (start, end, distance) of each run of ends where text holds item within edits."""
    pattern, backwards = Pattern(item), Pattern(item[::-1])
    found: list[tuple[int, int]] = []  # (distance, end)
    for end, score in enumerate(pattern.scores(text), 1):
        if score <= edits:
            if found and end - found[-1][1] <= max(1, len(item) // 2):
                found[-1] = min(found[-1], (score, end))
            else:
                found.append((score, end))
    out = []
    for score, end in found:
        low = max(0, end - len(item) - edits)
        start = next((end - n for n, s in enumerate(backwards.scores(reversed(text[low:end]), True), 1) if s == score), end)
        out.append((start, end, score))
    return out


def ancestors(count: int) -> list[list[tuple[int, int]]]:
    """For each of count pieces its nodes (first piece, end) in the halving tree, the smallest first, without piece and root.

    A text within m - 1 edits of m adjoining pieces is within m1 - 1 or m2 - 1 of either half, else there were m
    edits or more.  So an occurrence holds a piece all of whose nodes are within their budgets.
    """
    out: list[list[tuple[int, int]]] = [[] for _ in range(count)]

    def halve(lo: int, hi: int) -> None:
        if hi - lo < 2:
            return
        if hi - lo < count:
            for p in range(lo, hi):
                out[p].insert(0, (lo, hi))
        mid = (lo + hi) // 2
        halve(lo, mid)
        halve(mid, hi)

    halve(0, count)
    return out


class Searcher:
    """Finds items, (id, text) with repeats allowed, in whole texts."""

    def __init__(self, items: Iterable[tuple], share: float = BUDGET, short: int = SHORT):
        self.items: list[tuple] = []
        where: dict[str, list[tuple[int, int, list | None]]] = defaultdict(list)
        for ident, text in items:
            text = normalise(text)
            if 0 < len(text) < short:
                where[text].append((len(self.items), 0, None))
                self.items.append((ident, text, 0))
            elif text:
                edits = budget(len(text), share)
                cut = pieces(text, edits)
                nodes: dict[tuple[int, int], tuple[Pattern, int, int]] = {}
                for (at, piece), above in zip(cut, ancestors(len(cut))):
                    for node in above[:LEVELS]:
                        if node not in nodes:
                            start, stop = cut[node[0]][0], cut[node[1] - 1][0] + len(cut[node[1] - 1][1])
                            nodes[node] = Pattern(text[start:stop]), start, node[1] - node[0] - 1
                    where[piece].append((len(self.items), at, [nodes[node] for node in above[:LEVELS]]))
                self.items.append((ident, text, edits))
        self.automaton = None
        if where:
            self.automaton = ahocorasick.Automaton()
            for piece, places in where.items():
                self.automaton.add_word(piece, (len(piece), places))
            self.automaton.make_automaton()

    def __call__(self, text: str | None) -> Iterator[tuple]:
        """(item id, start, end, distance) with word-aligned code points of the original text."""
        if self.automaton is None or not text:
            return
        plain = normalise(text)
        diagonals: dict[int, set[int]] = defaultdict(set)
        exact: list[tuple[int, int]] = []
        for last, (length, places) in self.automaton.iter(plain):
            for item, at, above in places:
                begin = last + 1 - length - at
                if above is None:
                    if not (plain[begin - 1 : begin].isalnum() or plain[last + 1 : last + 2].isalnum()):
                        exact.append((item, begin))
                elif begin not in diagonals[item] and all(_within(plain, begin + start, pattern, edits) for pattern, start, edits in above):
                    diagonals[item].add(begin)
        words: list[tuple[int, int]] = []
        starts: list[int] = []

        def placed(begin: int, end: int) -> tuple[int, int]:
            if not words:
                at = 0
                for m in re.finditer(r"\S+", text):
                    words.append(m.span())
                    starts.append(at)
                    at += len(m[0].lower()) + 1
            return words[bisect_right(starts, begin) - 1][0], words[bisect_right(starts, max(begin, end - 1)) - 1][1]

        for number, begin in exact:
            ident, item, _ = self.items[number]
            yield ident, *placed(begin, begin + len(item)), 0
        for number, begins in sorted(diagonals.items()):
            ident, item, edits = self.items[number]
            for low, high in _spans(sorted(begins), len(item), edits):
                low, high = max(0, low), min(len(plain), high)
                for a, b, score in occurrences(item, plain[low:high], edits):
                    yield ident, *placed(low + a, low + b), score


def _within(text: str, at: int, pattern: Pattern, edits: int) -> bool:
    """Whether text holds the pattern within so many edits about place at."""
    window = text[max(0, at - edits) : at + pattern.length + edits]
    return any(score <= edits for score in pattern.scores(window))


def _spans(begins: list[int], length: int, edits: int) -> Iterator[tuple[int, int]]:
    """Windows around the item's possible begins; those that meet are one, so no hit counts twice."""
    low = high = None
    for b in begins:
        if high is not None and b - edits <= high:
            high = b + length + edits
            continue
        if high is not None:
            yield low, high
        low, high = b - edits, b + length + edits
    if high is not None:
        yield low, high


_kept: dict[int, tuple] = {}


def _searcher(items: list[tuple], share: float, short: int) -> Searcher:
    """One automaton per worker and portion: the last one is kept between tasks."""
    key = hash((tuple(items), share, short))
    if key not in _kept:
        _kept.clear()
        _kept[key] = Searcher(items, share, short)
    return _kept[key]


def _found(source: Iterable[pa.RecordBatch], items: list[tuple], share: float, short: int, columns: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    search = _searcher(items, share, short)

    def rows() -> Iterator[tuple]:
        for batch in source:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for hit in search(text):
                    yield doc, *hit

    yield from batches(columns, rows())


def _portions(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The distinct items, in bounded portions."""
    items = benchmark.select(quoted(item_col).alias("id"), quoted(text_col).alias("text")).where("text is not null").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, math.ceil(chars / PORTION_CHARS))
    for k in range(count):
        part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == k) if count > 1 else items
        yield sorted((tuple(r) for r in part.collect()), key=str)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", share: float = BUDGET, short: int = SHORT, item_text_col: str = "text") -> DataFrame:
    """(id_col, item_col, start, end, distance): every place where a document holds a benchmark
    item within budget() edits, both normalised; start and end are code points of the text, widened to words.

    An item with an error budget of k is cut into k + 1 pieces, of which any occurrence holds one
    unchanged.  One Aho-Corasick pass finds all pieces of all items.  Myers' algorithm then compares
    the piece with its neighbours, two, then four of them within their share of the budget, and where
    that holds the whole item on the window around its possible begin; see ancestors() for why nothing
    within the budget is missed.
    Items under `short` normalised characters are looked for without edits and as words of their own.
    Null, empty and blank texts and items match nothing, very long texts are searched whole, items listed twice are found
    once, and repeated rows of docs give rows each; without rows or items there are none.  Other columns
    are ignored, whatever their names.  Items travel in portions of PORTION_CHARS, whatever their number.
    """
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    columns = {"id": to_arrow_type(rows.schema["id"].dataType), "item_id": to_arrow_type(benchmark.schema[item_col].dataType), "start": pa.int32(), "end": pa.int32(), "distance": pa.int32()}
    schema = f"id {type_of(rows, 'id')}, item_id {type_of(benchmark, item_col)}, start int, `end` int, distance int"
    out = None
    for items in _portions(benchmark, item_col, item_text_col):
        part = rows.transform(in_arrow, partial(_found, items=items, share=share, short=short, columns=columns), schema)
        out = part if out is None else out.unionByName(part)
    return out.withColumnsRenamed({"id": id_col, "item_id": item_col})


def _without(source: Iterable[pa.RecordBatch], items: list[tuple], share: float, short: int, at: int) -> Iterator[pa.RecordBatch]:
    search = _searcher(items, share, short)
    for batch in source:
        yield batch.filter(pa.array([next(search(t), None) is None for t in batch.column(at).to_pylist()], pa.bool_()))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", share: float = BUDGET, short: int = SHORT, item_text_col: str = "text") -> DataFrame:
    """The rows of docs without a leak as leaks() finds it, with all their columns, whatever their names.

    One pass for each portion of items, written before the next, so that no task chains searches.  Null, empty and blank
    texts stay, very long ones are searched whole, repeated rows are treated alike, and an empty table stays empty.
    """
    last = None
    for items in _portions(benchmark, item_col, item_text_col):
        if last is not None:
            docs, old = materialise(last, "portion"), docs
            if hasattr(old, "_quirefold_path") and old is not first:
                discard(old)
        else:
            first = docs
        last = docs.transform(in_arrow, partial(_without, items=items, share=share, short=short, at=docs.columns.index(text_col)), docs.schema)
    return last
