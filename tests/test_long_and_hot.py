"""Long lines, hot keys, and operators whose results must not depend on an order that is not stated."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirefold.functions import text as X
from quirefold.operators import cache, describe, evaluation, figures, output, pages, regions


def test_long_lines_take_linear_time(spark):
    long = ["-" * 1_000_000, " " * 1_000_000 + "x", "x" + " " * 500_000 + "y" + " " * 500_000, "– " * 500_000 + "7 –", "1 " * 500_000, "page" + " " * 1_000_000 + "x", "1" * 1_000_000]
    df = spark.createDataFrame([(t,) for t in long], "t string")
    began = time.time()
    got = df.select(X.is_page_number(F.col("t")).alias("n"), F.length(X.strip(F.col("t"))).alias("s"), F.length(X.squeeze(F.col("t"))).alias("q"), F.length(X.language_name(F.col("t"))).alias("l")).collect()
    assert time.time() - began < 20
    assert [r.n for r in got] == [False, False, False, True, False, False, False]
    assert [r.s for r in got] == [1_000_000, 1, 500_002, 1_000_003, 999_999, 1_000_005, 1_000_000]


@pytest.mark.parametrize("text, want", [("12", True), (" - 12 - ", True), ("— Page 3 of 12 —", True), ("3/12", True), ("3 /\t12", True), ("PAGE 7", True), (" 7 ", True), ("12345", False), ("page", False), ("3 of", False), ("7a", False), ("page7", False), ("3of4", False), ("", False), ("٣", True)])
def test_page_numbers(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(X.is_page_number(F.col("t"))).first()[0] is want


def test_strip_takes_all_white_space(spark):
    space = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0        　"
    assert all(c.isspace() for c in space) and all(c in X.SPACES for c in space) and all(c.isspace() for c in X.SPACES)
    assert {chr(i) for i in range(0x110000) if chr(i).isspace()} == set(X.SPACES)
    assert spark.createDataFrame([(f"{space}a{space}b{space}",)], "t string").select(X.strip(F.col("t"))).first()[0] == f"a{space}b"


def test_only_exact_page_marks_split(spark):
    text = "<!-- page 1 -->\n\na <!--page 2--> b <!-- page  3 --> <!-- Page 4 --> c\n\n<!-- page 2 -->\n\nd"
    rows = pages.split_pages(spark.createDataFrame([("d", text)], "doc_id string, markdown string")).orderBy("pos").collect()
    assert [(r["index"], r.markdown) for r in rows] == [(0, "a <!--page 2--> b <!-- page  3 --> <!-- Page 4 --> c"), (1, "d")]


def test_the_last_description_wins(spark):
    images = spark.createDataFrame([("d", 1, 7)], "doc_id string, page_num int, xref int")
    said = [("d", "image", 1, 7, f"text {i}", i) for i in range(50)]
    random.Random(1).shuffle(said)
    df = spark.createDataFrame(said, "doc_id string, kind string, page_num int, ref int, text string, seq int").repartition(7)
    assert figures.described(images, df, "image", "xref").first().description == "text 49"
    assert figures.described(images, df.drop("seq"), "image", "xref").first().description == "text 9"


@pytest.mark.parametrize("seed", range(3))
def test_latencies_equal_sorting(spark, seed):
    rnd = random.Random(seed)
    groups = {"a": [rnd.gauss(0, 50) for _ in range(997)], "b": [rnd.choice([1.0, 2.0, 1e9]) for _ in range(300)], "c": [5.0], "d": [3.0] * 40, "e": [float(i) for i in range(20)]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("f", None), (None, 4.0), (None, 8.0)]
    got = {r.k: r for r in evaluation.latencies(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    groups[None] = [4.0, 8.0]
    assert set(got) == set(groups)
    for k, vs in groups.items():
        vs, n = sorted(vs), len(vs)
        r = got[k]
        assert (r.n, r.median, r.p95, r.longest) == (n, pytest.approx((vs[(n - 1) // 2] + vs[n // 2]) / 2), vs[int(n * 0.95)], vs[-1])


def test_admission(spark):
    """Slots and waiting places against a plain simulation."""
    rnd = random.Random(3)
    rows = [(f"s{i % 3}", float(rnd.randrange(400)), float(rnd.choice([0, 5, 30, 90])), i) for i in range(400)]
    got = {r.request_id: (r.start, r.end, r.status) for r in cache.admitted(spark.createDataFrame(rows, "store string, ts double, seconds double, request_id long"), 2, 3).collect()}
    for name in ("s0", "s1", "s2"):
        ends, starts = [], []
        for _, ts, seconds, ident in sorted((r for r in rows if r[0] == name), key=lambda r: (r[1], r[3])):
            busy = [e for e in ends if e > ts]
            start = ts if len(busy) < 2 else sorted(busy)[-2]
            if start > ts and sum(s > ts for s in starts) >= 3:
                assert got[ident] == (None, None, 429)
                continue
            ends.append(start + seconds), starts.append(start)
            assert got[ident] == (start, start + seconds, 200)


def test_flights_share_results_and_errors(spark):
    led = cache.single_flight(spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 1, 3), ("b", 1, 4), ("c", 1, 5)], "key string, ts int, request_id int"))
    ends = spark.createDataFrame([(1, "done", None), (3, None, "broken")], "leader int, result string, error string")
    got = {r.request_id: (r.result, r.error, r.status) for r in cache.shared_outcomes(led, ends).collect()}
    assert got == {1: ("done", None, 200), 2: ("done", None, 200), 3: (None, "broken", 500), 4: (None, "broken", 500), 5: (None, "timeout", 504)}


def test_structured_answers_fall_back_once():
    asked = []

    def structured(kind, digest, prompt):
        asked.append(digest)
        raise describe.Unsupported

    model = describe.StructuredFirst("host-a", structured, lambda kind, digest, prompt: {"text": f"plain {digest}"})
    assert [model("image", d, "")["text"] for d in "xyz"] == ["plain x", "plain y", "plain z"] and asked == ["x"]
    other = describe.StructuredFirst("host-b", lambda *a: {"text": "{}"}, lambda *a: {"text": "plain"})
    assert other("image", "x", "")["text"] == "{}" and other("diagram", "x", "")["text"] == "plain"


def test_payloads_are_fitted(spark):
    files = spark.createDataFrame([(1, bytearray(10)), (2, bytearray(600_000)), (3, bytearray(900_000)), (4, None)], "id int, content binary")
    encode = lambda content, side, quality: bytes(len(content) * quality // 100)
    got = {r.id: r.content and len(r.content) for r in describe.fitted(files, encode).collect()}
    assert got == {1: 10, 2: 420_000, 3: 495_000, 4: None}
    with pytest.raises(Exception, match="are sent at most"):
        describe.fitted(files, lambda c, side, quality: c, strict=True).collect()


def test_whole_descriptions_replace_truncated_ones(spark):
    known = spark.createDataFrame([("a", "cut", True), ("b", "whole", False)], "key string, text string, truncated boolean")
    new = spark.createDataFrame([("a", "whole now", False), ("b", "cut", True), ("c", " ", False), ("d", "cut", True)], "key string, text string, truncated boolean")
    assert sorted(map(tuple, describe.stored(new, known).collect())) == [("a", "whole now", False), ("b", "whole", False), ("d", "cut", True)]


def test_a_hot_image_is_one_row_per_task(spark):
    jobs = spark.range(20_000).selectExpr("concat('d', id % 90) doc_id", "cast(id % 7 as int) page_num", "id idx", "if(id % 3 = 0, 'logo', concat('k', id)) key")
    plan = describe.representatives(jobs)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_min_by" in plan
    assert describe.representatives(jobs).where("key = 'logo'").first().doc_id == "d0"


def test_response_of_a_long_document(spark):
    blocks = spark.createDataFrame([("d", 1, i, i, "text", 0.0, 0.0, 9.0, 1.0, " " * 50_000 + "x" + " " * 50_000, 10.0, False) for i in range(20)], "doc_id string, page_num int, seq int, pos int, kind string, x0 double, y0 double, x1 double, y1 double, text string, font_size double, bold boolean")
    blocks = blocks.withColumns({"xref": F.lit(None).cast("int"), "region_index": F.lit(None).cast("int"), "cells": F.lit(None).cast("array<array<string>>")})
    sheets = spark.createDataFrame([("d", 1, False, 10.0, 10.0, None)], "doc_id string, page_num int, is_ocr boolean, width double, height double, ocr_text string")
    assert output.to_markdown(blocks, sheets).first().markdown == "<!-- page 1 -->" + "\n\nx" * 20 + "\n"


def test_at_most_words_is_the_count(spark):
    texts = ["", " ", "a", " a\x1cb ", "w " * 18, "w " * 19, " ".join("w" * 18), "w" * 1_000_000, "w " * 500_000, " " * 1_000_000]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    got = rows.select(X.at_most_words(F.col("t"), 18).alias("few"), (X.word_count(F.col("t")) <= 18).alias("counted")).collect()
    assert [r.few for r in got[:-1]] == [r.counted for r in got[:-1]] == [True, True, True, True, True, False, True, True, False, True]
    assert not got[-1].few


def test_a_bullet_needs_a_blank_in_its_line(spark):
    texts = {"•\nx": None, "•\r\nx": None, "• x": None, "• \nx": "- x", "•\xa0x": "- x", "•\tx\ny": "- x y", "•": None, "\n • x": "- x", "•x": None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.list_item(F.col("t")).alias("item")).collect()
    assert {r.t: r.item for r in rows} == texts


def test_components_of_many_pages_in_few_tasks(spark):
    """Pages that share a task, ids that recur on other pages, and a page of one long chain."""
    pages_ = [(f"d{k % 3}", k, i, 10.0 * i if i % 4 else 10.0 * i + 5000 * (k % 2), 0.0) for k in range(40) for i in range(8)]
    chain = [("long", 1, i, 10.0 * i, 0.0) for i in range(25_000)]
    rows = spark.createDataFrame([(d, p, i, x, y, x + 9, y + 9) for d, p, i, x, y in pages_ + chain], "doc_id string, page_num int, drawing_id long, x0 double, y0 double, x1 double, y1 double")
    got = {(r.doc_id, r.page_num, r.drawing_id): r.cluster for r in regions.clusters(rows, slack=2.0).collect()}
    assert len(got) == len(pages_) + len(chain)
    assert all(got["long", 1, i] == 0 for i in range(25_000))
    for k in range(40):
        want = [0, 1, 1, 1, 4, 5, 5, 5] if k % 2 else [0] * 8
        assert [got[f"d{k % 3}", k, i] for i in range(8)] == want


def test_components_of_a_crowded_page(spark):
    """As many pairs as would never end: boxes on one spot, on a diagonal with gaps, and one by itself."""
    spot = [(i, 100.0, 100.0, 110.0, 110.0) for i in range(40_000)]
    steps = [(50_000 + i, 1000.0 + 20 * i, 1000.0 + 20 * i, 1019.0 + 20 * i, 1019.0 + 20 * i) for i in range(20_000) if i % 5_000]
    rows = [("d", 1, *b) for b in [*spot, *steps, (99_999, -50.0, -50.0, -40.0, -40.0), (99_998, None, 0.0, 9.0, 9.0)]]
    df = spark.createDataFrame(rows, "doc_id string, page_num int, drawing_id long, x0 double, y0 double, x1 double, y1 double")
    got = {r.drawing_id: r.cluster for r in regions.clusters(df, slack=2.0).collect()}
    assert len(got) == len(rows) and all(got[i] == 0 for i in range(40_000))
    assert all(got[b[0]] == 50_001 + (b[0] - 50_000) // 5_000 * 5_000 for b in steps)
    assert got[99_999] == 99_999 and got[99_998] == 99_998


def test_roots_equal_all_pairs():
    """Any boxes: on each other's edge, turned inside out, endless, not a number, and several of one id."""
    rnd = random.Random(5)
    reach = lambda a, b: a != a or (b == b and a >= b)
    for _ in range(300):
        n, wide, odd = rnd.randrange(2, 30), rnd.choice([5, 20, 60, 200]), rnd.random() < 0.4
        side = lambda: rnd.choice([float("nan"), float("inf"), -float("inf"), -0.0]) if odd and rnd.random() < 0.05 else float(rnd.randrange(wide))
        more = lambda: rnd.randrange(20) - 8 * (odd and rnd.random() < 0.3)
        ids = sorted(rnd.randrange(40 if odd else 10**6) for _ in range(n))
        boxes = [(x := side(), y := side(), x + more(), y + more()) for _ in range(n)]
        want = list(range(n))
        for i, a in enumerate(boxes):
            for j, b in enumerate(boxes[:i]):
                if ids[i] == ids[j] or (reach(a[2], b[0]) and reach(b[2], a[0]) and reach(a[3], b[1]) and reach(b[3], a[1])):
                    low, high = sorted((want[i], want[j]))
                    want = [low if k == high else k for k in want]
        assert regions._roots(np.array(ids), *np.array(boxes).T).tolist() == [ids[k] for k in want]
