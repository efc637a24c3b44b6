"""Graded document quality by ordinal (cumulative-link) regression on hashed text features."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import collect_driver, discard, in_arrow, materialise, quoted, type_of

#: Hashed weights; words, their beginnings and shapes, and the document's statistics share them.
DIMENSION_BITS = 18
DIMENSIONS = 1 << DIMENSION_BITS
#: Letters of a word's beginning, by which the forms of a word support each other.
STEM = 4
#: Labelled documents that a fit uses at most (in expectation; chosen by a seeded hash of the id).
SAMPLE = 12_000
#: Features, eight bytes each, that the driver holds of them at most; the labelled documents beyond are not fitted to.
SAMPLE_FEATURES = 20_000_000
#: Features that a step of the fit works on at a time.
BLOCK = 1_000_000
#: Steps of the fit, its step size and its pull towards zero.
STEPS, RATE, DECAY = 250, 0.1, 3e-5
#: A document is kept if its probability of the best grade reaches this.
KEEP = 0.7
#: Words remembered per worker, and the longest that are (bounds its memory, not the result).
CACHE_WORDS, CACHE_CHARS = 150_000, 64
#: Values of a shape that all words have, and bound for the norm of the words' part.
_STATISTIC, _PRESENCE = 10.0, 6.0


def grade_of(quality: Column, toxic: Column) -> Column:
    """0 toxic, 1 poor, 2 good; null where a label is missing."""
    return F.when(toxic == 1, 0).when((toxic == 0) & (quality == 0), 1).when((toxic == 0) & (quality == 1), 2)


def _shape(word: str) -> str:
    """Classes of the characters, runs of a class collapsed; a sign twice or more in a row is "R"."""
    out, last = [], ""
    for c in word:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if kind not in "Aa0" and c == last:
            out[-1] = "R"
        elif not out or out[-1] != kind:
            out.append(kind)
        last = c
    return "".join(out)


class _Words(dict):
    """word -> the buckets of the bare lower-cased word, of its beginning and of its shape, packed."""

    def __missing__(self, word: str) -> int:
        bare = "".join(filter(str.isalnum, word.lower())) or word
        value = 0
        for name in (bare, "stem " + bare[:STEM], "shape " + _shape(word)):
            value = value << DIMENSION_BITS | xxhash.xxh3_64_intdigest(name) % DIMENSIONS
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = value
        return value


_words = _Words()


def _bucket(name: str) -> int:
    return xxhash.xxh3_64_intdigest("statistic " + name) % DIMENSIONS


_LEVELS = 16
_STATISTICS = {name: [_bucket(f"{name} {i}") for i in range(_LEVELS + 1)] for name in ("distinct", "repeated", "length", "shape")}


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of a whole text: presence of each word and beginning, share of each shape, and levels of
    the share of distinct words, of words equal to the one before, of the commonest shape, and of the length."""
    words = (text or "").split()
    if not words:
        return np.array([_STATISTICS["length"][0]], dtype=np.int32), np.array([1.0], dtype=np.float32)
    packed = np.fromiter(map(_words.__getitem__, words), dtype=np.int64, count=len(words))
    ids, stems, shapes = packed >> 2 * DIMENSION_BITS, packed >> DIMENSION_BITS & DIMENSIONS - 1, packed & DIMENSIONS - 1
    own = np.unique(ids)
    begun = np.unique(stems)
    kinds, counts = np.unique(shapes, return_counts=True)
    share = counts / len(words)
    levels = {"distinct": len(own) / len(words), "repeated": float((ids[1:] == ids[:-1]).mean()) if len(ids) > 1 else 0.0, "length": min(1.0, np.log2(len(words)) / _LEVELS), "shape": share.max()}
    marks = [_STATISTICS[name][int(x * _LEVELS)] for name, x in levels.items()]
    buckets = np.concatenate([own, begun, kinds, marks])
    weight = min(1.0, _PRESENCE / np.sqrt(len(own)))  # else the many plain words of a long text outweigh all else
    values = np.concatenate([np.full(len(own) + len(begun), weight), _STATISTIC * share, np.ones(len(marks))])
    return buckets.astype(np.int32), values.astype(np.float32)


@dataclass(frozen=True)
class Model:
    """P(grade <= k) = sigmoid(thresholds[k] - weights . x), thresholds ascending."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.., by row."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))


def fit(buckets: list[np.ndarray], values: list[np.ndarray], grades: np.ndarray, classes: int) -> Model:
    """Full-batch Adam on the mean log likelihood; deterministic for the order of its rows.

    buckets and values are emptied, as their rows are packed into BLOCKs that a step goes through, so that the fit
    needs little more memory than its features.
    """
    # Rare buckets can only be learnt by heart.
    seen = np.zeros(DIMENSIONS, dtype=np.int64)
    for b in buckets:
        np.add.at(seen, b, 1)
    blocks: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # first row, last, features, values, lengths, starts
    stop = len(buckets)
    while stop:
        first, held = stop, 0
        while first and (held == 0 or held + len(buckets[first - 1]) <= BLOCK):
            first -= 1
            held += len(buckets[first])
        often = [seen[b] >= 3 for b in buckets[first:]]
        value = np.concatenate([v * k for v, k in zip(values[first:], often)]).astype(np.float32)
        for k in often:
            k[0] = True  # no row is without features, though the first may have no value
        index = np.concatenate([b[k] for b, k in zip(buckets[first:], often)])
        value = value[np.concatenate(often)]
        lengths = np.array([k.sum() for k in often])
        blocks.append((first, stop, index, value, lengths, np.cumsum(lengths) - lengths))
        del buckets[first:], values[first:]
        stop = first
    blocks.reverse()
    share = np.bincount(grades, minlength=classes).cumsum()[:-1] / len(grades)
    share = np.clip(share, 1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(first), 1e-3))
    theta = np.concatenate([first[:1], gaps])
    w = np.zeros(DIMENSIONS)
    moments = [np.zeros(DIMENSIONS + len(theta)) for _ in range(2)]
    for step in range(1, STEPS + 1):
        cuts = np.concatenate([theta[:1], theta[:1] + np.cumsum(np.exp(theta[1:]))])
        score = np.concatenate([np.add.reduceat(w[index] * value, start) for _, _, index, value, _, start in blocks])
        cdf = 1 / (1 + np.exp(np.clip(score[:, None] - cuts[None, :], -50, 50)))
        cdf = np.concatenate([np.zeros((len(score), 1)), cdf, np.ones((len(score), 1))], axis=1)
        rows = np.arange(len(score))
        high, low = cdf[rows, grades + 1], cdf[rows, grades]
        chance = np.maximum(high - low, 1e-12)
        pull = high + low - 1  # of the score
        grad_w = DECAY * w
        for lo, hi, index, value, lengths, _ in blocks:
            grad_w += np.bincount(index, weights=np.repeat(-pull[lo:hi] / len(score), lengths) * value, minlength=DIMENSIONS)
        slope = cdf * (1 - cdf)
        grad_cut = np.array([-(slope[grades == k, k + 1] / chance[grades == k]).sum() + (slope[grades == k + 1, k + 1] / chance[grades == k + 1]).sum() for k in range(classes - 1)]) / len(score)
        after = grad_cut[::-1].cumsum()[::-1]
        grad = np.concatenate([grad_w, after[:1], after[1:] * np.exp(theta[1:])])
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.99 * moments[1] + 0.01 * grad**2
        move = RATE * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-6)
        w -= move[:DIMENSIONS]
        theta -= move[DIMENSIONS:]
    cuts = np.concatenate([theta[:1], theta[:1] + np.cumsum(np.exp(theta[1:]))])
    return Model(w.astype(np.float32), cuts)


def _featured(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        found = [features(t) for t in batch.column(2).to_pylist()]
        columns = [batch.column(0), batch.column(1), pa.array([b.tobytes() for b, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "grade", "buckets", "values"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, most_features: int = SAMPLE_FEATURES) -> Model | None:
    """A model fitted to at most `sample` labelled documents, those with the smallest hashes of their id, and to the
    first of them that have `most_features` features together; None without any.

    labels has id_col, quality and toxic.  A document with several labels counts with its lowest
    grade; rows with a null label or id are no labels.  The sample is bounded, so it is sent to all tasks and read
    back as features; the texts are not shuffled.
    """
    graded = labels.select(quoted(id_col).alias("id"), grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    graded = graded.where("id is not null and grade is not null").groupBy("id").agg(F.min("grade").alias("grade"))
    chosen = graded.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text")).join(F.broadcast(chosen), "id")
    kind = type_of(texts, "id")
    rows = materialise(texts.select("id", "grade", "text").transform(in_arrow, _featured, f"id {kind}, grade int, buckets binary, values binary"), "labelled")
    buckets, values, grades, held = [], [], [], 0
    for row in rows.orderBy(F.xxhash64("id", "buckets"), "id").toLocalIterator():
        held += len(row["buckets"]) // 4
        if held > most_features and grades:
            break
        buckets.append(np.frombuffer(row["buckets"], dtype=np.int32))
        values.append(np.frombuffer(row["values"], dtype=np.float32))
        grades.append(row["grade"])
    discard(rows)
    model = fit(buckets, values, np.array(grades), 3) if grades else None
    collect_driver(docs.sparkSession)
    return model


def _scores(texts: list[str | None], model: Model) -> np.ndarray:
    score = np.empty(len(texts))
    for i, text in enumerate(texts):
        buckets, values = features(text)
        score[i] = float((model.weights[buckets] * values).sum())
    return model.tails(score)


_SCORED = pa.schema([("expected_grade", pa.float64()), ("p_not_toxic", pa.float64()), ("p_good", pa.float64()), ("kept", pa.bool_())])


def _graded(source: Iterable[pa.RecordBatch], model: Model, keep: float) -> Iterator[pa.RecordBatch]:
    for batch in source:
        tails = _scores(batch.column(1).to_pylist(), model)
        columns = [tails.sum(axis=1), *tails.T, tails[:, -1] >= keep]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in columns)], names=["id", *_SCORED.names])


def grade(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """One row per row of docs: id_col, expected_grade (0 to 2), p_not_toxic = P(grade >= 1), p_good = P(grade >= 2), kept.

    kept is p_good >= keep.  Without a model all is kept and the rest is null.  Null, empty and blank
    texts are scored by their length feature and the thresholds alone.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if model is None:
        nulls = [F.lit(None).cast("double").alias(c) for c in _SCORED.names[:3]]
        return rows.select(F.col("id").alias(id_col), *nulls, F.lit(True).alias("kept"))
    schema = f"id {type_of(rows, 'id')}, expected_grade double, p_not_toxic double, p_good double, kept boolean"
    return rows.transform(in_arrow, partial(_graded, model=model, keep=keep), schema).withColumnRenamed("id", id_col)


def _selected(source: Iterable[pa.RecordBatch], model: Model, keep: float, at: int) -> Iterator[pa.RecordBatch]:
    for batch in source:
        yield batch.filter(pa.array(_scores(batch.column(at).to_pylist(), model)[:, -1] >= keep))


def select(docs: DataFrame, model: Model | None, text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """The rows of docs that grade() keeps, with all their columns, whatever their names, in one pass.

    Null, empty and blank texts are judged like any other, very long ones as a whole, repeated rows alike; an
    empty table stays empty.
    """
    if model is None:
        return docs
    return docs.transform(in_arrow, partial(_selected, model=model, keep=keep, at=docs.columns.index(text_col)), docs.schema)
