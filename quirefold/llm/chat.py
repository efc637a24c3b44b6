"""Transcript parsing: a hidden Markov model over lines recovers speakers, turns are rendered alike."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quirefold.llm.common import batches, discard, groups, in_arrow, materialise, quoted, type_of

#: Speaker words of line markers, by the role that they announce; learnt roles announce themselves.
MARKERS = {
    "user": ("user", "human", "customer", "question", "q", "prompter", "visitor", "client"),
    "assistant": ("assistant", "ai", "bot", "agent", "answer", "a", "model", "chatbot", "support"),
    "system": ("system", "instruction", "instructions", "context"),
}
#: Before any is counted, the chances that a line of a role starts with one of its own markers, and with one of another
#: role, and the number of lines that this belief weighs.
OWN_MARKER, OTHER_MARKER, MARKER_LINES = 0.05, 1e-4, 200
#: Chance that the speaker changes between lines of a row without a marker.  It cannot be counted: a labelled row has one role.
DRIFT = 1e-3
#: Conversations that a model learns from at most.
SAMPLE = 20_000
#: Turns counted or decoded together; a longer conversation is a chain of such chunks.
CHUNK = 256

_LISTED = re.compile(r"\s*(?:[-*•]|\d+[.)]|```|>)")
#: Values of each feature; the last value of a feature means that the line does not have it.  The last feature is the
#: line's marker: none, one of the role itself, one of another role.
_SIZES = (2, 8, 20, 20, 2, 2, 4, 3)
_MARKER = len(_SIZES) - 1


@lru_cache(maxsize=64)
def _marks(roles: tuple[str, ...]) -> tuple[re.Pattern, dict[str, str]]:
    """The pattern of markers, whose words may also be the roles, and the roles by their words."""
    named = {r.strip().lower(): r for r in reversed(roles) if r.strip()}
    own = "".join(rf"(?i:{re.escape(w)})(?!\w)|" for w in sorted(named, key=lambda w: (-len(w), w)))
    return re.compile(rf"\s*(?:[#*>\-\[]+\s*)?({own}[A-Za-z][A-Za-z ]{{0,24}}?)\s*(?:\]|\*+)?\s*[:：]\s*(?:\*+)?\s*|\s*<\|(?:im_start\|>)?({own}[A-Za-z]+)(?:\|>)?\s*"), named


def marker(line: str, roles: tuple[str, ...] = ()) -> tuple[str | None, str]:
    """(role that the line's marker announces, rest of the line); each of roles is announced by its own name too."""
    pattern, named = _marks(roles)
    m = pattern.match(line)
    if m:
        word = (m[1] or m[2]).strip().lower()
        if word in named:
            return named[word], line[m.end() :]
        for role, names in MARKERS.items():
            if word in names:
                return role, line[m.end() :]
    return None, line


def features(lines: list[str], number: int, position: int) -> list[int]:
    """Feature values of a row's line; those of the whole row stand on its first line only."""
    line = lines[number]
    length = min(18, len(line).bit_length())
    if number:
        return [0, 7, 19, length, int(line.rstrip().endswith("?")), int(bool(_LISTED.match(line))), 3]
    whole = sum(map(len, lines)) + len(lines) - 1
    # Half steps of the logarithm: the length of a turn says most about who speaks.
    size = min(18, int(2 * math.log2(whole + 1)) - 4) if whole > 3 else 0
    return [1, min(6, len(lines).bit_length()), max(0, size), length, int(line.rstrip().endswith("?")), int(bool(_LISTED.match(line))), min(2, position)]


def encoded(text: str | None, roles: tuple[str, ...]) -> np.ndarray:
    """(lines, 7) numbers, all that the model reads of a row: the role that the line's marker announces (0: none, 1 on:
    a role, beyond: one that was not learnt), and the features that do not depend on the row's place."""
    lines = (text or "").split("\n")
    out = np.empty((len(lines), 7), dtype=np.uint16)
    for number, line in enumerate(lines):
        told, _ = marker(line, roles)
        out[number, 0] = 0 if told is None else roles.index(told) + 1 if told in roles else len(roles) + 1
        out[number, 1:] = features(lines, number, 0)[:6]
    return out


@dataclass(frozen=True)
class Model:
    roles: tuple[str, ...]
    #: Per feature (values, roles) log chances.
    emissions: tuple[np.ndarray, ...]
    #: (roles + 1, roles) log chances at the start of a row or at a marker; the last row is the start.
    turns: np.ndarray

    def steps(self, row: str | np.ndarray | None, position: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(transitions, emissions) of each line of a row, a text or its encoded() form."""
        codes = row if isinstance(row, np.ndarray) else encoded(row, self.roles)
        count = len(self.roles)
        stay = np.full((count + 1, count), math.log(DRIFT / max(1, count - 1)))
        np.fill_diagonal(stay, math.log1p(-DRIFT))
        place = np.full(len(codes), 3)
        place[0] = min(2, position)
        score = self.emissions[6][place]
        for f in range(6):
            score = score + self.emissions[f][codes[:, f + 1]]
        told = codes[:, 0].astype(int)
        marks = self.emissions[_MARKER]
        score = score + np.where((told == 0)[:, None], marks[0], np.where(told[:, None] == np.arange(1, count + 1), marks[1], marks[2]))
        for number in range(len(codes)):
            yield (self.turns if not number or told[number] else stay), score[number]


def _after(matrix: np.ndarray, moves: np.ndarray, score: np.ndarray) -> np.ndarray:
    """The best scores from each entry to each role, one line further."""
    return (matrix[:, :, None] + moves[None, : matrix.shape[1], :]).max(axis=1) + score[None, :]


def transfer(model: Model, rows: Iterable[tuple[str | np.ndarray | None, int]]) -> np.ndarray:
    """(roles + 1, roles): the best score of a chunk's lines by role before it (last: none) and role at its end."""
    matrix = None
    for text, position in rows:
        for moves, score in model.steps(text, position):
            matrix = moves + score[None, :] if matrix is None else _after(matrix, moves, score)
    return matrix


def decode(model: Model, rows: list[tuple[str | np.ndarray | None, int]], entry: int, leave: int | None) -> list[list[int]]:
    """The best role of each line of each row, given the role before the chunk and, unless None, at its end."""
    value, back, sizes = None, [], []
    for text, position in rows:
        size = 0
        for moves, score in model.steps(text, position):
            if value is None:
                value = moves[entry] + score
                back.append(None)
            else:
                paths = value[:, None] + moves[: len(value)]
                back.append(paths.argmax(axis=0))
                value = paths.max(axis=0) + score
            size += 1
        sizes.append(size)
    at = int(value.argmax()) if leave is None else leave
    labels = []
    for pointers in reversed(back):
        labels.append(at)
        if pointers is not None:
            at = int(pointers[at])
    labels.reverse()
    out = []
    for size in sizes:
        out.append(labels[:size])
        labels = labels[size:]
    return out


def render(role: str, content: str) -> str:
    """A turn in canonical form; what looks like a mark of the form is broken up in the content."""
    return f"<|{role}|>\n{content.strip().replace('<|', '< |')}\n<|end|>\n"


def _coded(source: Iterable[pa.RecordBatch], roles: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Rows whose last column is a text become rows with its encoded() form there."""
    for batch in source:
        codes = pa.array([encoded(t, roles).tobytes() for t in batch.columns[-1].to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], codes], names=[*batch.schema.names[:-1], "codes"])


def _numbers(codes: bytes) -> np.ndarray:
    return np.frombuffer(codes, dtype=np.uint16).reshape(-1, 7)


def _counted(source: Iterable[pa.RecordBatch], roles: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Counts (feature, value, role) and, as feature -1, (role before, role) within chunks, of sorted rows
    (conv, wide, turn, mark, role, codes)."""
    number = {r: k for k, r in enumerate(roles)}
    counts: Counter[tuple[int, int, int]] = Counter()
    for (_, wide), rows in groups(source, 2):
        before = None
        for position, (_, _, role, codes) in enumerate(rows):
            k = number[role]
            if before is not None:
                counts[-1, before, k] += 1
            for i, line in enumerate(_numbers(codes).tolist()):
                for f, v in enumerate((*line[1:], 3 if i else min(2, position if wide == 0.0 else 2))):
                    counts[f, v, k] += 1
                counts[_MARKER, 0 if not line[0] else 1 if line[0] == k + 1 else 2, k] += 1
            before = k
    yield from batches({"feature": pa.int32(), "value": pa.int32(), "role": pa.int32(), "n": pa.int64()}, ((*k, n) for k, n in counts.items()))


def _chunked(rows: DataFrame) -> DataFrame:
    """(conv, turn, mark, codes, copies) with spot and the chunk, (wide, at, part), of about CHUNK turns each.

    The order is that of turn (null last) and, within a turn, of a hash of the text, mark.  A
    chunk covers CHUNK numbers of turns; where very many texts share them, turns and ranges of
    marks get chunks of their own.
    """
    far = F.lit(float("inf"))
    rows = rows.withColumn("spot", F.coalesce(F.col("turn").cast("double"), far)).withColumn("wide", F.coalesce(F.floor(F.col("turn").cast("double") / CHUNK).cast("double"), far))
    crowded = rows.groupBy("conv", "wide").agg(F.count("*").alias("held")).where(F.col("held") > 8 * CHUNK)
    rows = rows.alias("r").join(crowded.alias("c"), F.col("r.conv").eqNullSafe(F.col("c.conv")) & (F.col("r.wide") == F.col("c.wide")), "left").select("r.*", "held")
    parts = F.ceil(F.col("held") / CHUNK).cast("double")
    part = F.floor((F.col("mark").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64) * parts).cast("double")
    fine = lambda c: F.when(F.col("held").isNull(), F.lit(0.0)).otherwise(c)
    return rows.select("conv", "wide", fine(F.col("spot")).alias("at"), fine(part).alias("part"), "spot", "turn", "mark", "copies", "codes")


def learn(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", sample: int = SAMPLE) -> Model | None:
    """A model of all roles, from at most `sample` whole conversations, those with the smallest hashes; None without
    roles.  Tasks count chunks of CHUNK turns, whose first and last roles give the changes between them; only
    counts of a fixed number of features leave the tasks."""
    labelled = turns.select(quoted(conv_col).alias("conv"), quoted(turn_col).cast("double").alias("turn"), quoted(role_col).alias("role"), quoted(text_col).alias("text")).where("conv is not null and turn is not null and role is not null")
    names = [r["role"] for r in labelled.select("role").distinct().collect()]
    if not names:
        return None
    roles = tuple(sorted(names))
    chosen = labelled.groupBy("conv").agg(F.min("turn").alias("first")).orderBy(F.xxhash64("conv"), "conv").limit(sample)
    wide = F.floor((F.col("turn") - F.col("first")) / CHUNK).cast("double")
    rows = labelled.join(F.broadcast(chosen), "conv").select("conv", wide.alias("wide"), "turn", F.xxhash64("text").alias("mark"), "role", "text")
    # Only the numbers that the model reads cross the cluster, not the texts.
    shape = f"conv {type_of(labelled, 'conv')}, wide double, turn double, mark long, role string, codes binary"
    rows = materialise(rows.transform(in_arrow, partial(_coded, roles=roles), shape).dropDuplicates(["conv", "turn", "role", "mark"]), "labelled")
    place = F.struct("turn", "mark", "role")
    ends = rows.groupBy("conv", "wide").agg(F.min_by("role", place).alias("enter"), F.max_by("role", place).alias("leave"))
    ends = ends.select("enter", F.lag("leave").over(Window.partitionBy("conv").orderBy("wide")).alias("before")).groupBy("before", "enter").agg(F.count("*").alias("n"))
    placed = rows.repartition("conv", "wide").sortWithinPartitions("conv", "wide", "turn", "mark", "role")
    counted = placed.transform(in_arrow, partial(_counted, roles=roles), "feature int, value int, role int, n long").groupBy("feature", "value", "role").agg(F.sum("n").alias("n"))
    emissions = [np.full((size, len(roles)), 0.5) for size in _SIZES]
    emissions[_MARKER][:] = MARKER_LINES * np.array([[1 - OWN_MARKER - OTHER_MARKER], [OWN_MARKER], [OTHER_MARKER]])
    moves = np.full((len(roles) + 1, len(roles)), 0.5)
    for r in counted.collect():
        (moves if r["feature"] < 0 else emissions[r["feature"]])[r["value"], r["role"]] += r["n"]
    number = {r: k for k, r in enumerate(roles)}
    for r in ends.collect():
        moves[len(roles) if r["before"] is None else number[r["before"]], number[r["enter"]]] += r["n"]
    discard(rows)
    logs = tuple(np.log(e / e.sum(axis=0)) for e in emissions)
    return Model(roles, logs, np.log(moves / moves.sum(axis=1, keepdims=True)))


def _transfers(source: Iterable[pa.RecordBatch], model: Model, columns: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for key, held in groups(source, 4):
            yield *key, transfer(model, [(_numbers(r[2]), _position(key, i)) for i, r in enumerate(held)]).ravel().tolist()

    yield from batches(columns, rows())


def _position(key: tuple, number: int) -> int:
    """The place in the conversation as far as features tell it: only the first rows of a conversation that starts at turn 0 differ."""
    return number if key[1] == 0.0 and key[2] == 0.0 and key[3] == 0.0 else 2


def _chained(source: Iterable[pa.RecordBatch], roles: int, forward: bool, columns: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """One streaming pass over a conversation's chunks with a vector of state.

    Forward, each chunk gets the best scores of the roles before it; the state never holds more than
    the chunk at hand.  Backward, from the best end, each gets the roles before it and at its end.
    """
    last, value, at = object(), None, None

    def rows() -> Iterator[tuple]:
        nonlocal last, value, at
        for batch in source:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                conv, key = row[0], row[1:4]
                matrix = np.array(row[4]).reshape(roles + 1, roles)
                new = (conv,) != last
                last = (conv,)
                if forward:
                    before = np.array([-math.inf] * roles + [0.0]) if new else np.append(value, -math.inf)
                    value = (before[:, None] + matrix).max(axis=0)
                    value -= value.max()
                    yield conv, *key, row[4], before.tolist()
                else:
                    paths = np.array(row[5])[:, None] + matrix
                    leave = int(paths.max(axis=0).argmax()) if new else at
                    at = int(paths[:, leave].argmax())
                    yield conv, *key, at, leave

    yield from batches(columns, rows())


def _decoded(source: Iterable[pa.RecordBatch], model: Model, columns: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (chunk, spot, mark, turn, copies, codes, entry, leave) become (conv, turn, mark, copies, labels)."""

    def rows() -> Iterator[tuple]:
        for key, held in groups(source, 4):
            labels = decode(model, [(_numbers(r[4]), _position(key, i)) for i, r in enumerate(held)], held[0][5], held[0][6])
            for (_, mark, turn, copies, *_), roles in zip(held, labels):
                yield key[0], turn, mark, copies, np.array(roles, dtype=np.uint16).tobytes()

    yield from batches(columns, rows())


def _parsed(source: Iterable[pa.RecordBatch], model: Model, columns: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, turn, text, labels, copies) become turns."""

    def rows() -> Iterator[tuple]:
        for batch in source:
            for conv, turn, text, labels, copies in zip(*(c.to_pylist() for c in batch.columns)):
                roles = np.frombuffer(labels, dtype=np.uint16).tolist()
                yield from ((conv, turn, part, model.roles[k], content, render(model.roles[k], content), copies) for part, (k, content) in enumerate(_parts(text, roles, model.roles)))

    yield from batches(columns, rows(), 2000)


def _parts(text: str | None, roles: list[int], names: tuple[str, ...] = ()) -> Iterator[tuple[int, str]]:
    """Runs of a row's lines: a new one at each marker and where the role changes."""
    held: list[str] = []
    for number, (line, role) in enumerate(zip((text or "").split("\n"), roles)):
        told, rest = marker(line, names)
        if number and (told is not None or role != roles[number - 1]):
            yield roles[number - 1], "\n".join(held)
            held = []
        held.append(rest if told is not None else line)
    yield roles[-1], "\n".join(held)


def parse(turns: DataFrame, model: Model | None, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """One row per recovered turn: conv_col, turn_col, part, role, content, rendered, copies.

    A transcript is the rows of a conversation in order of turn (null last; equal ones by a hash of the text), a
    row may itself hold lines of several speakers.  Viterbi over all lines finds the roles; markers
    are cut off, and rendered is the canonical form.  Rows equal in all three columns are one, counted in
    copies; a null text is one empty line, a null conversation is a conversation.  Roles in the input
    are not read.  Without a model everything has role unknown.

    Each row is first put into the numbers that the model reads of its lines, and these, not the texts, are
    cut into chunks.  The first pass gives each chunk's table of best scores from the
    role before to the role at its end; two streams over these small tables settle the roles at all borders;
    then the chunks are decoded independently.  That equals one Viterbi over the whole
    conversation, however long, and no task holds more than a chunk.  Texts cross the cluster once, to meet their labels.
    Texts of one turn are told apart by a 64-bit hash.  Very long texts are read whole, an empty table gives no rows, and
    other columns are ignored, whatever their names.
    """
    if model is None:
        model = Model(("unknown",), tuple(np.zeros((size, 1)) for size in _SIZES), np.zeros((2, 1)))
    conv, turn = type_of(turns, conv_col), type_of(turns, turn_col)
    conv_type, turn_type = (to_arrow_type(turns.schema[c].dataType) for c in (conv_col, turn_col))
    where = {"conv": conv_type, "wide": pa.float64(), "at": pa.float64(), "part": pa.float64()}
    shape = f"conv {conv}, wide double, at double, part double"
    keys = list(where)
    count = len(model.roles)

    source = turns.select(quoted(conv_col).alias("conv"), quoted(turn_col).alias("turn"), F.xxhash64(quoted(text_col)).alias("mark"), quoted(text_col).cast("string").alias("text"))
    coded = source.transform(in_arrow, partial(_coded, roles=model.roles), f"conv {conv}, turn {turn}, mark long, codes binary")
    coded = coded.groupBy("conv", "turn", "mark").agg(F.count("*").alias("copies"), F.first("codes").alias("codes"))
    rows = materialise(_chunked(materialise(coded, "codes")), "chunk")
    placed = rows.select(*keys, "spot", "mark", "codes").repartition(*keys).sortWithinPartitions(*keys, "spot", "mark")
    tables = placed.transform(in_arrow, partial(_transfers, model=model, columns={**where, "table": pa.list_(pa.float64())}), f"{shape}, `table` array<double>")
    forward = tables.repartition("conv").sortWithinPartitions(*keys)
    columns = {**where, "table": pa.list_(pa.float64()), "before": pa.list_(pa.float64())}
    forward = materialise(forward.transform(in_arrow, partial(_chained, roles=count, forward=True, columns=columns), f"{shape}, `table` array<double>, before array<double>"), "forward")
    backward = forward.repartition("conv").sortWithinPartitions("conv", *[F.col(k).desc() for k in keys[1:]])
    columns = {**where, "entry": pa.int32(), "leave": pa.int32()}
    borders = materialise(backward.transform(in_arrow, partial(_chained, roles=count, forward=False, columns=columns), f"{shape}, entry int, leave int"), "borders")
    discard(forward)

    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    joined = rows.alias("r").join(borders.alias("b"), same).select("r.*", "entry", "leave")
    joined = joined.select(*keys, "spot", "mark", "turn", "copies", "codes", "entry", "leave").repartition(*keys).sortWithinPartitions(*keys, "spot", "mark")
    columns = {"conv": conv_type, "turn": turn_type, "mark": pa.int64(), "copies": pa.int64(), "labels": pa.binary()}
    labelled = joined.transform(in_arrow, partial(_decoded, model=model, columns=columns), f"conv {conv}, turn {turn}, mark long, copies long, labels binary")
    # One aggregation brings texts and labels together; copies of a text shrink to one in the tasks.
    none = lambda kind: F.lit(None).cast(kind)
    met = source.select("conv", "turn", "mark", "text", none("binary").alias("labels"), none("long").alias("copies")).unionByName(labelled.withColumn("text", none("string")))
    met = met.groupBy("conv", "turn", "mark").agg(F.first("text", True).alias("text"), F.first("labels", True).alias("labels"), F.max("copies").alias("copies"))
    columns = {"conv": conv_type, "turn": turn_type, "part": pa.int32(), "role": pa.string(), "content": pa.string(), "rendered": pa.string(), "copies": pa.int64()}
    out = met.select("conv", "turn", "text", "labels", "copies").transform(in_arrow, partial(_parsed, model=model, columns=columns), f"conv {conv}, turn {turn}, part int, role string, content string, rendered string, copies long")
    return out.withColumnsRenamed({"conv": conv_col, "turn": turn_col})
