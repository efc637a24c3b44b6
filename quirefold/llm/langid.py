"""Language identification: scripts narrow the candidates, Viterbi over word scores labels spans."""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import batches, in_arrow, merged, quoted, type_of

#: Documents of each language that a model learns from at most (in expectation; by a hash of the id).
SAMPLE = 5_000
#: Buckets of hashed letter pairs and triples.
BUCKETS = 1 << 15
#: Cost of a change of language between words, and most that one word can say against a language (in nats).
SWITCH, WORD_LIMIT = 8.0, 4.0
#: A language is a candidate for a word if this part of its letters is in the word's script.
SCRIPT_SHARE = 0.01
#: Cells of words times languages that are decoded at a time, cells that a worker remembers, and characters of the
#: longest word that it does.
CELLS, CACHE_CELLS, CACHE_CHARS = 2_000_000, 4_000_000, 64
#: Characters of a text, about, that are cut into words at a time.
PIECE = 500_000
#: Bytes of texts, about, that are decoded together: a step of the Viterbi pass costs the same for few texts and many.
TOGETHER = 20 << 20

# Unicode code point ranges of scripts.
SCRIPTS = (
    ("latin", ((0x41, 0x24F), (0x1E00, 0x1EFF), (0xFF21, 0xFF5A))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF))),
    ("armenian", ((0x530, 0x58F),)),
    ("hebrew", ((0x590, 0x5FF),)),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),
    ("devanagari", ((0x900, 0x97F),)),
    ("bengali", ((0x980, 0x9FF),)),
    ("tamil", ((0xB80, 0xBFF),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("georgian", ((0x10A0, 0x10FF),)),
    ("hangul", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF))),
    ("kana", ((0x3040, 0x30FF), (0x31F0, 0x31FF))),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F))),
)
_EDGES = sorted((a, b + 1, k) for k, (_, ranges) in enumerate(SCRIPTS) for a, b in ranges)
_STARTS = np.array([e[0] for e in _EDGES])
_STOPS = np.array([e[1] for e in _EDGES])
_KINDS = np.array([e[2] for e in _EDGES])
OTHER = len(SCRIPTS)


def scripts(codes: np.ndarray) -> np.ndarray:
    """The script number of each code point; OTHER outside of all ranges."""
    at = np.searchsorted(_STARTS, codes, side="right") - 1
    inside = (at >= 0) & (codes < _STOPS[at])
    return np.where(inside, _KINDS[at], OTHER)


def letters(word: str) -> str:
    return "".join(filter(str.isalpha, word))


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, word numbers, script of each word) of all pairs and triples in words of letters, with their edges.

    The words are hashed together, as one array of code points.
    """
    codes = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    owner = np.repeat(np.arange(len(words)), sizes)
    pair = (codes[:-1] * np.uint64(1_000_003) + codes[1:]) * np.uint64(0x9E3779B97F4A7C15)
    triple = ((codes[:-2] * np.uint64(1_000_003) + codes[1:-1]) * np.uint64(1_000_003) + codes[2:] + np.uint64(7)) * np.uint64(0x9E3779B97F4A7C15)
    buckets, owners = [], []
    for value, n in ((pair, 2), (triple, 3)):
        whole = owner[: len(value)] == owner[n - 1 :]
        buckets.append((value[whole] >> np.uint64(49)).astype(np.int64) % BUCKETS)
        owners.append(owner[: len(value)][whole])
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]) + 1
    return np.concatenate(buckets), np.concatenate(owners), scripts(codes[np.minimum(first, len(codes) - 1)].astype(np.int64))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    #: (BUCKETS, languages) log probabilities.
    chances: np.ndarray
    #: (scripts, languages) whether a language is a candidate for words of a script.
    candidates: np.ndarray

    def scores(self, words: list[str]) -> np.ndarray:
        """(words, languages) scores, 0 for the best and WORD_LIMIT below at least; words are of letters."""
        buckets, owners, kinds = _grams(words)
        out = np.stack([np.bincount(owners, weights=self.chances[buckets, k], minlength=len(words)) for k in range(len(self.languages))], axis=1)
        allowed = self.candidates[kinds]
        allowed = allowed | ~allowed.any(axis=1, keepdims=True)
        out = np.where(allowed, out, -np.inf)
        out -= out.max(axis=1, keepdims=True)
        return np.where(allowed, np.maximum(out, -WORD_LIMIT), -2 * WORD_LIMIT).astype(np.float32)


def _counts(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, place, n): counts of gram buckets, and of letters' scripts from BUCKETS on, per task."""
    sums: dict[str, np.ndarray] = {}

    def rows() -> Iterator[tuple]:
        for lang, counts in sums.items():
            for place in np.flatnonzero(counts):
                yield lang, int(place), int(counts[place])
        sums.clear()

    for batch in source:
        seen: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen.setdefault(lang, Counter()).update((text or "").lower().split())
        for lang, counter in seen.items():
            words = Counter()
            for word, n in counter.items():
                if word := letters(word):
                    words[word] += n
            if words:
                times = np.array(list(words.values()))
                buckets, owners, kinds = _grams(list(words))
                counts = sums.setdefault(lang, np.zeros(BUCKETS + OTHER + 1, dtype=np.int64))
                counts += np.bincount(np.concatenate([buckets, BUCKETS + kinds]), weights=np.concatenate([times[owners], times]), minlength=len(counts)).astype(np.int64)
    yield from batches({"lang": pa.string(), "place": pa.int64(), "n": pa.int64()}, rows(), 20_000)


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> Model | None:
    """A model of all languages in lang_col (null: not learnt from); None if there is none.

    Each language gives about `sample` documents at most, those with small hashes of their id, so that rare ones
    count fully.  Counts are summed in the tasks; what reaches the driver is one table of BUCKETS by languages,
    128 KB for each language.
    """
    rows = docs.select(quoted(lang_col).alias("lang"), quoted(text_col).alias("text"), F.xxhash64(quoted(id_col).cast("string")).alias("h")).where("lang is not null and text is not null")
    held = rows.groupBy("lang").count().collect()
    if not held:
        return None
    parts = [part for r in held for part in (F.lit(r["lang"]), F.lit(min(1_000_000, sample * 1_000_000 // r["count"])))]
    rate = F.element_at(F.create_map(*parts), F.col("lang"))
    chosen = rows.where(rate > F.pmod("h", F.lit(1_000_000))).select("lang", "text")
    counted = chosen.transform(in_arrow, _counts, "lang string, place long, n long").groupBy("lang", "place").agg(F.sum("n").alias("n"))
    names = sorted(r["lang"] for r in held)
    at = {name: k for k, name in enumerate(names)}
    sums = np.zeros((BUCKETS + OTHER + 1, len(names)), dtype=np.float32)
    for r in counted.toLocalIterator():
        sums[r["place"], at[r["lang"]]] = r["n"]
    known = sums.sum(axis=0) > 0
    if not known.any():
        return None
    sums, names = sums[:, known], [n for n, k in zip(names, known) if k]
    grams, kinds = sums[:BUCKETS], sums[BUCKETS:]
    grams += np.float32(0.1)
    grams /= grams.sum(axis=0, dtype=np.float64)
    return Model(tuple(names), np.log(grams, out=grams), kinds >= SCRIPT_SHARE * kinds.sum(axis=0))


class _Words(dict):
    """token of a lower-cased text -> its row in `table`; row 0 is of tokens without letters."""

    def __init__(self, model: Model):
        self.model = model
        self.table = np.zeros((1, len(model.languages)), dtype=np.float32)

    def learn(self, tokens: set[str]) -> None:
        if self.table.size > CACHE_CELLS or len(self) > CACHE_CELLS // 16:
            self.clear()
            self.table = self.table[:1].copy()
        new = [t for t in tokens if t not in self]
        bare = [letters(t) for t in new]
        kept = [i for i, b in enumerate(bare) if b]
        for i, b in enumerate(bare):
            if not b:
                self[new[i]] = 0
        if kept:
            rows = self.model.scores([bare[i] for i in kept])
            for k, i in enumerate(kept, len(self.table)):
                self[new[i]] = k
            self.table = np.concatenate([self.table, rows])


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best labels of several sequences laid end to end in scores (rows by labels).

    All sequences advance together, the longest first, so that a step is one array operation over those
    that are that long.
    """
    order = np.argsort(-lengths, kind="stable")
    moved, origin, value, active, start = _forward(scores, lengths[order], (np.cumsum(lengths) - lengths)[order], switch, None)
    return _backward(moved, origin, value.argmax(axis=1), active, start)


def _forward(scores: np.ndarray, length: np.ndarray, start: np.ndarray, switch: float, entry: np.ndarray | None) -> tuple:
    """(whether each label was moved to, from which, last values, sequences longer than t, their starts).

    entry: the values of the words before, where the sequences go on from others.
    """
    longest = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(longest), side="left")  # sequences longer than t
    moved = np.zeros(scores.shape, dtype=bool)
    origin = np.zeros(len(scores), dtype=np.int32)
    value = np.zeros((len(length), scores.shape[1])) if entry is None else entry.copy()
    for t in range(longest):
        n = active[t]
        at = start[:n] + t
        now = value[:n]
        if t or entry is not None:
            best = now.argmax(axis=1)
            jump = now[np.arange(n), best] - switch
            change = jump[:, None] > now
            moved[at] = change
            origin[at] = best
            now = np.where(change, jump[:, None], now)
        value[:n] = now + scores[at]
    return moved, origin, value, active, start


def _backward(moved: np.ndarray, origin: np.ndarray, last: np.ndarray, active: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The labels of sequences that end in last, which becomes the labels before their first words."""
    out = np.zeros(len(origin), dtype=np.int32)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = start[:n] + t
        out[at] = last[:n]
        change = moved[at, last[:n]]
        last[:n] = np.where(change, origin[at], last[:n])
    return out


def _pieces(text: str) -> Iterator[tuple[int, str]]:
    """(offset, piece) of a text cut before white space into pieces of about PIECE characters."""
    start = 0
    while start < len(text):
        stop = start + PIECE
        if stop < len(text):
            gap = re.compile(r"\s").search(text, stop)
            stop = gap.start() if gap else len(text)
        yield start, text[start:stop]
        start = stop


def _tokens(text: str) -> list[str]:
    return text.lower().split()


def _long(text: str, words: _Words) -> tuple[np.ndarray, np.ndarray]:
    """(whether each word has letters, labels) of one long text by the same Viterbi as viterbi(): a pass over its pieces
    keeps the values at their borders, and a second one, backwards, decodes each piece again between them."""
    borders: list[np.ndarray | None] = []
    parts = [piece for _, piece in _pieces(text)]

    def scored(piece: str) -> tuple[np.ndarray, np.ndarray]:
        tokens = _tokens(piece)
        words.learn(set(tokens))
        rows = np.fromiter(map(words.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        return rows > 0, words.table[rows]

    entry = None
    for piece in parts:
        borders.append(entry)
        _, scores = scored(piece)
        if len(scores):
            entry = _forward(scores, np.array([len(scores)]), np.array([0]), SWITCH, entry)[2]
            entry -= entry.max()
    lettered, labels, last = [], [], None
    for piece, entry in zip(reversed(parts), reversed(borders)):
        real, scores = scored(piece)
        lettered.append(real)
        if not len(scores):
            labels.append(np.empty(0, dtype=np.int32))
            continue
        moved, origin, value, active, start = _forward(scores, np.array([len(scores)]), np.array([0]), SWITCH, entry)
        last = value.argmax(axis=1) if last is None else last
        labels.append(_backward(moved, origin, last, active, start))
    return np.concatenate(lettered[::-1]), np.concatenate(labels[::-1])


def _labelled(texts: list[str | None], words: _Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(whether each word has letters, labels) of each text, some texts decoded together, long ones alone."""
    held: list[list[str]] = []

    def decoded() -> Iterator[tuple]:
        words.learn({t for tokens in held for t in tokens})
        rows = [np.fromiter(map(words.__getitem__, tokens), dtype=np.int64, count=len(tokens)) for tokens in held]
        lengths = np.array([len(r) for r in rows])
        full = np.flatnonzero(lengths)
        labels = viterbi(words.table[np.concatenate([rows[i] for i in full])], lengths[full]) if len(full) else np.empty(0, dtype=np.int32)
        ends = np.cumsum(lengths)
        for row, end in zip(rows, ends):
            yield row > 0, labels[end - len(row) : end]
        held.clear()

    count = 0
    for text in texts:
        if text is not None and len(text) > 2 * PIECE:
            yield from decoded() if held else ()
            count = 0
            yield _long(text, words)
            continue
        tokens = _tokens(text or "")
        if held and (count + len(tokens)) * len(words.model.languages) > CELLS:
            yield from decoded()
            count = 0
        held.append(tokens)
        count += len(tokens)
    if held:
        yield from decoded()


def _spans(text: str, lettered: np.ndarray, labels: np.ndarray, names: tuple[str, ...]) -> list[dict]:
    """Runs of words of one label, in code points; tokens without letters join the run they stand in."""
    real = np.flatnonzero(lettered)
    if not len(real):
        return []
    told = labels[real]
    cuts = np.flatnonzero(told[1:] != told[:-1]) + 1
    first, last = real[np.concatenate([[0], cuts])], real[np.concatenate([cuts - 1, [len(real) - 1]])]
    if not len(cuts):  # one run, as in most texts: its ends are near those of the text
        start = next(itertools.islice(re.finditer(r"\S+", text), int(real[0]), None)).start()
        after = len(lettered) - 1 - int(real[-1])
        stop = len(text.rsplit(None, after)[0] if after else text.rstrip())
        return [{"start": start, "stop": stop, "lang": names[int(told[0])]}]
    # Only the words at the ends of runs need their places.
    wanted = sorted({*first.tolist(), *last.tolist()})
    places: dict[int, tuple[int, int]] = {}
    words, number = re.finditer(r"\S+", text), -1
    for want in wanted:
        m = next(itertools.islice(words, want - number - 1, None))
        places[want], number = m.span(), want
    return [{"start": places[a][0], "stop": places[b][1], "lang": names[k]} for a, b, k in zip(first.tolist(), last.tolist(), told[np.concatenate([[0], cuts])].tolist())]


_SPANS = "array<struct<start:int,stop:int,lang:string>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string())]))


def _predicted(source: Iterable[pa.RecordBatch], model: Model, spans: bool) -> Iterator[pa.RecordBatch]:
    words = _Words(model)
    names = model.languages
    for batch in merged(source, TOGETHER):
        texts = batch.column(1).to_pylist()
        langs, scores, found = [], [], []
        for text, (lettered, labels) in zip(texts, _labelled(texts, words)):
            told = labels[lettered]
            if len(told):
                votes = np.bincount(told, minlength=len(names))
                best = int(votes.argmax())  # names are sorted: ties go to the first
                langs.append(names[best])
                scores.append(votes[best] / len(told))
            else:
                langs.append("und")
                scores.append(0.0)
            found.append(_spans(text, lettered, labels, names) if spans and len(told) else [])
        columns = [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())] + ([pa.array(found, _SPAN_TYPE)] if spans else [])
        yield pa.RecordBatch.from_arrays(columns, names=["id", "lang_pred", "score", "spans"][: len(columns)])


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """One row per row of docs: id_col, lang_pred, score, and spans, runs of words of one language as (start, stop, lang).

    Every word of the whole text is scored against the languages that its script allows; Viterbi with a cost
    for each switch labels the words.  lang_pred is the language of most words and score its share of them.
    und with score 0: null text, no letter, or no model.  A very long text is decoded whole, piece by piece; repeated rows
    and ids give rows each, an empty table none.  Other columns are ignored, whatever their names.
    """
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    more = f", spans {_SPANS}" if spans else ""
    if model is None:
        out = rows.select("id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.array().cast(_SPANS).alias("spans"))
        return (out if spans else out.drop("spans")).withColumnRenamed("id", id_col)
    out = rows.transform(in_arrow, partial(_predicted, model=model, spans=spans), f"id {type_of(rows, 'id')}, lang_pred string, score double{more}")
    return out.withColumnRenamed("id", id_col)


def is_held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def told(spans: str) -> Column:
    """Spans as text: lang:start:stop, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["lang"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
