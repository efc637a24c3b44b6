import math

import numpy as np
import pytest

from quirefold.llm import embdedup


def brute(rows):
    usable = []
    for _, v, label in rows:
        ok = v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
        usable.append(np.array(v, dtype=np.float64) if ok else None)
    near = [[] for _ in rows]
    for i, a in enumerate(usable):
        for j in range(i):
            b = usable[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b):
                a_, b_ = a / np.abs(a).max(), b / np.abs(b).max()
                if (a_ @ b_) / (np.linalg.norm(a_) * np.linalg.norm(b_)) >= 0.98:
                    near[i].append(j)
                    near[j].append(i)
    out = []
    for i, row in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        low = min(ids) if ids else None
        out.append((row[0], len(near[i]), low, row[0] is not None and row[0] == low))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("block", [1024, 8])
def test_random_groups_match_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(embdedup, "BLOCK", block)
    rng = np.random.default_rng(7)
    rows = []
    for _ in range(30):
        centre = rng.normal(size=16)
        for _ in range(rng.choice([1, 2, 6, 25])):
            v = centre + rng.normal(size=16) * rng.choice([0, 0.02, 0.1, 0.2])
            rows.append((len(rows), [float(np.float32(x)) for x in v * rng.choice([1e-3, 1, 50])], int(rng.choice([1, 1, 2]))))
    rng.shuffle(rows)
    rows = [(int(a), [float(x) for x in b], int(c)) for a, b, c in rows]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(embdedup.near_duplicates(df)) == brute(rows)


def test_edge_cases(spark):
    v = [1.0, 2.0, 3.0, -1.0]
    rows = [
        (1, v, 1), (2, v, 1), (2, v, 1), (3, v, None), (4, None, 1), (5, [], 1), (6, [0.0] * 4, 1), (7, [1.0, None, 3.0, 1.0], 1), (8, [1.0, float("nan"), 1.0, 1.0], 1),
        (9, [float("inf"), 1.0, 1.0, 1.0], 1), (10, v, 2), (None, v, 2), (None, [5.0, 1.0], 3), (11, [2.0, 4.0, 6.0, -2.0], 1), (12, [-1.0, -2.0, -3.0, 1.0], 1), (13, [1.0, 2.0, 3.0], 1),
        (14, [1e38, 2e38, 3e38, -1e38], 1), (15, [1e-40, 2e-40, 3e-40, -1e-40], 1), (16, [-0.0, 1.0], 4), (17, [0.0, 1.0], 4),
    ]
    df = spark.createDataFrame([(*r, 3) for r in rows], SCHEMA + ", n_links int")
    rows32 = [(i, None if x is None else [None if y is None else float(np.float32(y)) for y in x], k) for i, x, k in rows]
    assert got(embdedup.near_duplicates(df)) == brute(rows32)


def test_doubles_and_empty_table(spark):
    df = spark.createDataFrame([(1, [1.0, 0.1], 1), (2, [1.0, 0.1000001], 1)], "vec_id long, embedding array<double>, label int")
    assert got(embdedup.near_duplicates(df)) == [(1, 1, 1, True), (2, 1, 1, False)]
    assert embdedup.near_duplicates(df.limit(0)).collect() == []


def test_recall_on_the_embeddings_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert got(embdedup.near_duplicates(df)) == brute(rows)
