import random

import pytest

from quirefold.llm import mixing


def waterfill(sizes, weights):
    left, open_, out = 1.5 * sum(sizes.values()), set(sizes), {}
    while open_:
        w = sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * left / w > 2 * sizes[s]}
        if not over:
            return out | {s: weights[s] * left / w for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def check(rows, got):
    sizes, taken, target = {}, {}, {}
    for doc, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = waterfill(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)})
    assert sorted((r.doc_id, r.size) for r in got) == sorted((d, len((t or "").encode().split())) for d, t, _ in rows)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    for s in sizes:
        assert target[s] == pytest.approx(want[s], rel=1e-9)
        assert abs(taken[s] - want[s]) <= max(2, 0.02 * want[s]), (s, taken[s], want[s], sizes[s])


def test_random_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 4000)
    rnd = random.Random(3)
    rows = [(i, " ".join("w" * (1 + i % 3) for _ in range(rnd.choice([0, 1, 7, 80, 300, 2000]))), rnd.choice([None, "", "a", "B", "é", "a", "a", "a"])) for i in range(400)]
    rows += [(401, None, "a"), (402, "x " * 20_000, "B"), (7, "same id other text", "a"), (7, "same id other text", "a")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, target int")
    got = mixing.mix(df).collect()
    check(rows, got)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_tiny_sources(spark):
    rows = [(1, "a b c", "x"), (2, "d", "y"), (3, None, "z"), (4, "", None)]
    check(rows, mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())


def test_no_words_and_empty(spark):
    for rows in ([], [(1, None, "a"), (2, " ", None)]):
        got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
        assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * len(rows)


@pytest.mark.parametrize("seed", range(3))
def test_apportion_is_sainte_lague(spark, seed):
    rnd = random.Random(seed)
    parties = [(g, i, rnd.choice([0, 1, 5, 100, 10_000]) * rnd.randint(1, 9)) for g in range(3) for i in range(rnd.choice([1, 4, 40]))]
    seats = {g: rnd.choice([0, 3, 57, 1000]) for g in range(3)}
    for g in range(3):
        parties.append((g, 99, 3))
    df = spark.createDataFrame([(g, i, v, seats[g]) for g, i, v in parties], "g int, i int, v long, s long")
    got = {(r.g, r.i): r.quota for r in mixing.apportion(df, ["g"], "v", "s", "i").collect()}
    for g in range(3):
        mine = {i: v for h, i, v in parties if h == g}
        won = dict.fromkeys(mine, 0)
        for _ in range(seats[g]):
            won[min((x for x in mine if mine[x]), key=lambda x: (-mine[x] / (2 * won[x] + 1), x))] += 1
        assert {i: got[g, i] for i in mine} == won
