import random

import pytest

from quirefold.llm import decontam as D


def distance_ends(item, text):
    """Semi-global edit distances by the plain recurrence."""
    col = list(range(len(item) + 1))
    out = []
    for c in text:
        new = [0]
        for i, x in enumerate(item, 1):
            new.append(min(col[i] + 1, new[i - 1] + 1, col[i - 1] + (x != c)))
        col = new
        out.append(col[-1])
    return out


@pytest.mark.parametrize("seed", range(30))
def test_myers_equals_plain_recurrence(seed):
    rnd = random.Random(seed)
    item = "".join(rnd.choice("abcd é") for _ in range(rnd.choice([1, 5, 63, 64, 65, 150])))
    text = "".join(rnd.choice("abcd é") for _ in range(120)) + item[: len(item) // 2] + "x" + item[len(item) // 2 :]
    assert list(D.Pattern(item).scores(text)) == distance_ends(item, text)


def edited(rnd, s, n):
    s = list(s)
    for _ in range(n):
        i = rnd.randrange(len(s))
        kind = rnd.randrange(3)
        if kind == 0:
            s[i] = rnd.choice("qxz")
        elif kind == 1:
            del s[i]
        else:
            s.insert(i, rnd.choice("qxz"))
    return "".join(s)


def test_every_text_within_budget_is_found():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("aeinorst") for _ in range(rnd.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(rnd.choice([5, 20, 45])))) for i in range(30)]
    search = D.Searcher(items)
    for i, item in items:
        k = D.budget(len(item))
        for n in (0, k // 2, k):
            text = "  ".join(word() for _ in range(30)).title() + "\n" + edited(rnd, item, n).upper() + " " + " ".join(word() for _ in range(9))
            hits = [h for h in search(text) if h[0] == i]
            assert len(hits) == 1 and hits[0][3] <= n
            assert D.normalise(text[hits[0][1] : hits[0][2]]) in D.normalise(text)


def test_agrees_with_brute_force(spark):
    rnd = random.Random(8)
    item = "the quick brown fox jumps over the lazy dog and then rests for a while in the sun"
    rows = [(n, "start " + edited(rnd, item, n) + " stop") for n in range(0, 24) for _ in range(3)]
    got = {(r.doc_id) for r in D.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(4, item)], "item_id long, text string")).collect()}
    k = D.budget(len(item))
    docs = [(i, t) for i, t in enumerate(t for _, t in rows)]
    found = {r.doc_id for r in D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(4, item)], "item_id long, text string")).collect()}
    assert found == {i for i, t in docs if min(distance_ends(D.normalise(item), D.normalise(t))) <= k}
    assert 0 in got and 23 not in got


def test_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(D, "PORTION_CHARS", 60)  # several portions
    a, b = "a passage that is long enough to be told", "ein anderer Text, ebenfalls lang genug dafür"
    docs = [(1, f"x {a} y"), (1, f"x {a} y"), (2, None), (3, ""), (4, (b + " ") * 400), (None, a.upper()), (5, "clean text only"), (6, f"{a} and {b}"), (7, "short")]
    df = spark.createDataFrame([(*d, "i", 1) for d in docs], "doc_id long, text string, item_id string, start int")
    items = spark.createDataFrame([("A", a), ("A", a), ("B", b), ("C", None), ("D", ""), (None, "short")], "item_id string, text string")
    got = D.leaks(df, items).collect()
    assert sorted((r.doc_id or 0, r.item_id or "", r.distance) for r in got if r.doc_id != 4) == [(0, "A", 0), (1, "A", 0), (1, "A", 0), (6, "A", 0), (6, "B", 0), (7, "", 0)]
    assert sum(r.doc_id == 4 for r in got) == 400
    one = next(r for r in got if r.doc_id == 1)
    assert (one.start, one.end) == (2, 2 + len(a))
    kept = D.clean(df, items)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 5]
    assert D.leaks(df.limit(0), items).count() == 0 and D.leaks(df, items.limit(0)).count() == 0
    assert D.clean(df, items.limit(0)).count() == len(docs)


def test_planted_items_in_the_documents_table(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    texts, wanted = [(r.doc_id, D.normalise(r.text)) for r in docs.collect()], [(r.item_id, D.normalise(r.text)) for r in items.collect()]
    exact = {(d, i) for d, t in texts for i, x in wanted if x in t}
    got = {(r.doc_id, r.item_id) for r in D.leaks(docs, items).collect()}
    assert exact and exact <= got and len(got - exact) <= len(exact)


def test_short_items_are_found_as_words():
    search = D.Searcher([(1, "Blue Heron"), (2, "42"), (3, " "), (4, "C++")])
    hits = sorted(search("a blue  HERON, 42? blue herons 142 4 2 c++\n(blue\nheron) 42"))
    assert [(i, d) for i, _, _, d in hits] == [(1, 0), (1, 0), (2, 0), (2, 0), (4, 0)]
    text = "a blue  HERON, 42?"
    assert [text[a:b] for _, a, b, _ in sorted(search(text))] == ["blue  HERON,", "42?"]


def test_items_under_another_name(spark):
    docs = spark.createDataFrame([(1, "it says what is there to say about it"), (2, "clean")], "id long, body string")
    items = spark.createDataFrame([(9, "what is there to say about it")], "key long, question string")
    names = {"item_col": "key", "item_text_col": "question"}
    assert [tuple(r)[:2] for r in D.leaks(docs, items, "id", "body", **names).collect()] == [(1, 9)]
    assert [r.id for r in D.clean(docs, items, "body", **names).collect()] == [2]
