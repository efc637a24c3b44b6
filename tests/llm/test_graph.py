import random

import pytest

from quirefold.llm import graph


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def got(spark, edges, schema="a long, b long", parts=6):
    rows = graph.connected_components(spark.createDataFrame(edges, schema).repartition(parts)).collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.component for r in rows}


def test_path_hub_and_loops(spark):
    path = [(i, i + 1) for i in range(100, 400)]
    random.Random(0).shuffle(path)
    hub = [(1000, i) for i in range(1001, 1300)]
    assert got(spark, path + hub + [(7, 7), (5, 3), (3, 5)]) == brute(path + hub + [(7, 7), (5, 3)])


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed, monkeypatch):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(-200, 200), rnd.randrange(-200, 200)) for _ in range(rnd.choice([30, 150, 260]))]
    assert got(spark, edges) == brute(edges)


def test_strings_and_no_edges(spark):
    assert got(spark, [("b", "a"), ("c", "b")], "a string, b string") == {"a": "a", "b": "a", "c": "a"}
    assert got(spark, []) == {}


def test_no_round_once_all_are_stars(spark, monkeypatch):
    """Rounds cost the driver their plans, stages and tasks: none runs that would change nothing."""
    written = []
    kept = graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, tag: (written.append(tag), kept(df, tag))[1])
    stars = [(i % 7, i) for i in range(7, 300)]
    assert got(spark, stars, parts=1) == brute(stars) and written == ["forest"]
    written.clear()
    assert got(spark, []) == {} and written == ["forest"]


@pytest.mark.parametrize("edges", [[(3, 1), (3, 2)], [(2, 1), (3, 2)], [(5, 1), (5, 1)], [(4, 1), (4, 2), (9, 2)]])
def test_what_is_no_star_goes_on(spark, edges):
    assert got(spark, edges, parts=len(edges)) == brute(edges)
    assert graph._are_stars(spark.createDataFrame(edges, "u long, v long").distinct()) == (len(set(edges)) == 1)
