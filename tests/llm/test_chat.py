import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirefold.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def model(spark):
    return chat.learn(spark.read.parquet("/root/testdata/sf0.1/conversations.parquet").where("conv_id % 4 <> 0"))


def test_held_out_accuracy(spark, model):
    turns = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet").where("conv_id % 4 = 0")
    got = chat.parse(turns.drop("role"), model).where("part = 0").select("conv_id", "turn", F.col("role").alias("found"))
    rows = got.join(turns, ["conv_id", "turn"]).collect()
    assert len(rows) == turns.count()
    assert np.mean([r.found == r.role for r in rows]) > 0.97


def score(model, rows, path):
    """The log chance of a path of roles over all lines of a conversation."""
    at, before, total = 0, len(model.roles), 0.0
    for text, position in rows:
        for moves, emit in model.steps(text, position):
            total += moves[before, path[at]] + emit[path[at]]
            before = path[at]
            at += 1
    return total


@pytest.mark.parametrize("seed", range(4))
def test_decode_equals_all_paths(model, seed):
    rng = np.random.default_rng(seed)
    words = ["hello there", "is it?", "- item", "User: go on", "Assistant: fine", "word " * 60]
    rows = [("\n".join(rng.choice(words, size=rng.integers(1, 3))), i) for i in range(4)]
    labels = [k for row in chat.decode(model, rows, len(model.roles), None) for k in row]
    best = max(itertools.product(range(len(model.roles)), repeat=len(labels)), key=lambda p: score(model, rows, p))
    assert score(model, rows, labels) == pytest.approx(score(model, rows, best))


@pytest.mark.parametrize("chunk", [2, 7])
def test_chunks_equal_one_viterbi(spark, model, monkeypatch, chunk):
    monkeypatch.setattr(chat, "CHUNK", chunk)
    rng = np.random.default_rng(chunk)
    rows = []
    for conv, turns in enumerate([1, 3, 40, 200]):
        for turn in range(turns):
            rows.append((conv, turn, None, " ".join("word" for _ in range(rng.integers(1, 200))) + rng.choice(["", "?", "\nmore lines\nof it", "\nUser: and this"])))
    for k in range(100):  # many texts on one turn
        rows.append((9, 5, None, f"text {k} " * int(rng.integers(1, 90))))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {}
    for r in chat.parse(df, model).orderBy("conv_id", "turn", "part").collect():
        got.setdefault((r.conv_id, r.turn), []).append(r)
    marks = {(r.conv_id, r.turn, r.text): r.h for r in df.withColumn("h", F.xxhash64("text")).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1], marks[r[0], r[1], r[3]]))
        held = [(r[3], i if r[1] < chunk and conv != 9 and len(mine) > 0 else 2) for i, r in enumerate(mine)]
        labels = [k for row in chat.decode(model, held, len(model.roles), None) for k in row]
        if conv == 9:  # parts of texts that share a turn are told apart by what they render
            assert sum(r.copies for r in got[9, 5] if r.part == 0) == 100
            continue
        # Paths may tie, so their chances are compared.
        path = [model.roles.index(r.role) for row in mine for r in got[conv, row[1]] for _ in r.content.split("\n")]
        assert len(path) == len(labels)
        assert score(model, held, path) == pytest.approx(score(model, held, labels))


def test_markers_are_counted(spark, model):
    """Where a role's lines start with its marker, a line without any speaks against it."""
    rows = [(c, t, "user" if t % 2 else "assistant", f"User: word {t}" if t % 2 else f"word {t}") for c in range(200) for t in range(6)]
    own = chat.learn(spark.createDataFrame(rows, SCHEMA))
    user, other = own.roles.index("user"), own.roles.index("assistant")
    marks = np.exp(own.emissions[-1])
    assert marks[1, user] == pytest.approx((200 * 0.05 + 600) / 800) and marks[0, other] > 0.98 and marks[2, other] < 1e-4
    assert marks[1, user] > 40 * np.exp(model.emissions[-1])[1, user]


def test_whole_conversations_equal_brute_force(spark, model):
    """Roles that parse() finds against the best of all paths, scored line by line."""
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = {}
    for r in turns.collect():
        rows.setdefault(r.conv_id, []).append((r.turn, r.text))
    got = {}
    for r in chat.parse(turns.drop("role"), model).orderBy("conv_id", "turn", "part").collect():
        got.setdefault(r.conv_id, []).append(r)
    tried = 0
    for conv, held in rows.items():
        held = [(text, min(2, i)) for i, (_, text) in enumerate(sorted(held))]
        lines = sum(text.count("\n") + 1 for text, _ in held)
        if lines > 9:
            continue
        path = [model.roles.index(r.role) for r in got[conv] for _ in r.content.split("\n")]
        best = max(score(model, held, p) for p in itertools.product(range(len(model.roles)), repeat=lines))
        assert score(model, held, path) == pytest.approx(best)
        tried += 1
    assert tried > 15


def test_markers_split_a_raw_transcript(spark, model):
    text = "System: be brief\nUser: what is this?\nI wonder.\nAssistant: it is a <|end|> test\nwith two lines\nHuman: thanks"
    got = chat.parse(spark.createDataFrame([(1, 0, None, text)], SCHEMA), model).orderBy("part").collect()
    assert [(r.part, r.role) for r in got] == [(0, "system"), (1, "user"), (2, "assistant"), (3, "user")]
    assert got[1].rendered == "<|user|>\nwhat is this?\nI wonder.\n<|end|>\n"
    assert got[2].content == "it is a <|end|> test\nwith two lines" and got[2].rendered == "<|assistant|>\nit is a < |end|> test\nwith two lines\n<|end|>\n"


def test_every_role_is_learnt_and_announces_itself(spark):
    """Twenty roles, and one that speaks only after hundreds of turns."""
    rows = [(c, t, f"role{t % 20}", "some words " * (t % 20 + 1)) for c in range(6) for t in range(40)]
    rows += [(c, 700, "Tool", "late") for c in range(6)] + [(c, 701, "developer", "later?") for c in range(6)]
    model = chat.learn(spark.createDataFrame(rows, SCHEMA))
    assert model.roles == tuple(sorted({r[2] for r in rows})) and len(model.roles) == 22
    tool, dev = model.roles.index("Tool"), model.roles.index("developer")
    assert np.exp(model.turns[tool, dev]) == pytest.approx(6.5 / (6 + 22 / 2))  # counted beyond the first chunk
    before = model.roles.index("role19")
    assert np.exp(model.turns[before, tool]) == pytest.approx(6.5 / (12 + 22 / 2))  # and across a border
    text = "role3: some\nTool: {}\ndeveloper: later?\n<|tool|>\nrole12: x"
    got = chat.parse(spark.createDataFrame([(1, 0, None, text)], SCHEMA), model).orderBy("part").collect()
    assert [r.content.strip() for r in got] == ["some", "{}", "later?", "", "x"]
    assert chat.marker("tool: a", model.roles) == ("Tool", "a") and chat.marker("role1: a", model.roles) == ("role1", "a")
    assert chat.marker("tool: a") == (None, "tool: a") and chat.marker("role100: a", model.roles)[0] is None


def test_edge_cases(spark, model):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, None, "x", "late"), (None, 0, None, None), (None, 1, None, ""), (2, -5, None, "x" * 200_000), (3, 10**15, None, "far"), (3, 0, None, "a\n" * 3000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", part int")
    got = chat.parse(df, model).collect()
    firsts = [r for r in got if r.part == 0]
    assert len(firsts) == 7 and sum(r.copies for r in firsts) == len(rows)
    assert {r.copies for r in firsts if r.conv_id == 1 and r.turn == 0} == {2}
    assert chat.parse(df.limit(0), model).count() == 0
    assert chat.learn(df.where("role is null")) is None
    assert {r.role for r in chat.parse(df, None).collect()} == {"unknown"}


def test_a_repeated_conversation_row_does_not_pile_up(spark, model):
    df = spark.range(5000).selectExpr("7L conv_id", "id % 3 turn", "concat('text ', id % 3) text")
    got = chat.parse(df, model).collect()
    assert sorted(r.copies for r in got) == [1666, 1667, 1667]
