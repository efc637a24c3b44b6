"""Hand-made cases of the operators."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quirefold import schemas
from quirefold.functions import geometry as G
from quirefold.functions import text as X
from quirefold.operators import boilerplate, context, describe, evaluation, figures, layout, ocr, output, pages, regions, structure, tables, usage
from quirefold.sources import adapters, documents, formats


def column(spark, expr, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def block(seq, box, text="t", kind="text", size=10.0, bold=False, page=1, doc="d", **more):
    row = {"doc_id": doc, "page_num": page, "seq": seq, "kind": kind, "x0": float(box[0]), "y0": float(box[1]), "x1": float(box[2]), "y1": float(box[3]), "text": text, "font_size": size, "bold": bold, "xref": None, "region_index": None, "cells": None}
    return tuple((row | more)[f.name] for f in schemas.BLOCKS.fields)


def blocks_of(spark, rows):
    return spark.createDataFrame(rows, schemas.BLOCKS)


def pages_of(spark, numbers, width=595.0, height=800.0, doc="d", ocr_texts=()):
    return spark.createDataFrame([(doc, n, n in dict(ocr_texts), width, height, dict(ocr_texts).get(n)) for n in numbers], schemas.PAGES)


# ---- text


def test_garbled_share(spark):
    assert column(spark, X.garbled_share, ["clean\n\r\t", "", "\ue000" * 50, "ab\ufffdcdefg\x01h", " \n"]) == [0, 0, 1.0, 0.2, 0]


def test_list_items(spark):
    got = column(spark, X.list_item, ["• first point", "– dashed point", "- already a dash", "plain text", "• nbsp  and\nmore", "-no space", "", "  * x"])
    assert got == ["- first point", "- dashed point", "- already a dash", None, "- nbsp and more", None, None, "- x"]


def test_skip_marker(spark):
    assert column(spark, X.is_skip, ["[SKIP]", "  [skip]  ", "[SKIP] logo", "a chart", "", None]) == [True, True, True, False, False, False]


def test_words_split_at_all_white_space(spark):
    texts = ["a\u00a0b\u2003c\x1cd\x85e", "  x  ", "", "\n"]
    assert column(spark, X.words, texts) == [t.split() for t in texts]
    assert column(spark, X.squeeze, texts) == [" ".join(t.split()) for t in texts]
    assert column(spark, lambda c: X.last_words(c, 2), ["a b c", "a", ""]) == ["b c", "a", ""]


def test_page_numbers(spark):
    got = column(spark, X.is_page_number, ["12", "Page 3", "- 4 -", "3 / 10", "3 of 10", "page", "12345", "12 a", "PAGE 7 of 9", "–5–"])
    assert got == [True, True, True, True, True, False, False, False, True, True]


def test_markdown_table(spark):
    grid = [["", "2024", "2025"], ["Net | x", "1"], ["a\nb", None, "3"]]
    got = column(spark, X.markdown_table, [grid, [], [[]], None], "array<array<string>>")
    assert got == ["|  | 2024 | 2025 |\n| --- | --- | --- |\n| Net \\| x | 1 |  |\n| a b |  | 3 |", "", "", ""]


def test_numeric_cells(spark):
    assert column(spark, X.is_numeric_cell, ["1,234.5", "−3", "12 kg", "12 kgs", "", None, "n/a", "(5)"]) == [True, True, True, False, False, False, False, True]
    assert column(spark, X.numeric_tokens, ["a 1,200 and −3.5"]) == [["1200", "-3.5"]]


def test_small_functions(spark):
    assert column(spark, X.language_code, ["Swedish", " GERMAN ", "Latin", None]) == ["sv", "de", None, None]
    assert column(spark, X.language_name, [" English. ", "", "..French"]) == ["English", "", "French"]
    assert column(spark, X.duration, [0.0, 65.9, 3599.0, 3661.0], "double") == ["0:00", "1:05", "59:59", "1:01:01"]
    assert column(spark, X.blockquote, ["a\n\n b \nc"]) == ["> a\n>\n>  b \n> c"]
    import hashlib

    assert column(spark, lambda c: X.fingerprint(c, F.lit("z")), ["é"]) == [hashlib.sha256("é\x1fz".encode()).hexdigest()[:10]]


# ---- layout and structure


def order(spark, boxes, width=595.0):
    df = blocks_of(spark, [block(i, b) for i, b in enumerate(boxes)])
    return [r.seq for r in layout.reading_order(df, pages_of(spark, [1], width)).orderBy("pos").collect()]


def test_reading_order_of_one_and_two_columns(spark):
    assert order(spark, [(50, 300, 500, 320), (50, 100, 500, 120), (50, 200, 500, 220)]) == [1, 2, 0]
    assert order(spark, [(320, 100, 560, 120), (50, 100, 290, 120), (320, 140, 560, 160), (50, 140, 290, 160)]) == [1, 3, 0, 2]


def reference_order(boxes, width):
    """The rules in plain Python."""
    lefts, cuts = sorted(b[0] for b in boxes), []
    if width > 0 and len(boxes) >= 4:
        for a, b in zip(lefts, lefts[1:]):
            n = sum(x[0] < (a + b) / 2 for x in boxes)
            if b - a >= 0.06 * width and 2 <= n <= len(boxes) - 2:
                cuts.append((a + b) / 2)
    return sorted(range(len(boxes)), key=lambda i: (sum(boxes[i][0] >= c for c in cuts), round(boxes[i][1] / 10), boxes[i][0]))


def test_reading_order_equals_the_rules(spark):
    rnd = random.Random(2)
    rows, want = [], {}
    for page in range(25):
        boxes = [(float(rnd.choice([50, 60, 200, 320, 330]) + rnd.choice([0, 0, 7])), rnd.uniform(0, 700), 400.0, 710.0) for _ in range(rnd.randint(1, 14))]
        rows += [block(i, b, page=page) for i, b in enumerate(boxes)]
        want[page] = reference_order(boxes, 595.0)
    got = {}
    for r in layout.reading_order(blocks_of(spark, rows), pages_of(spark, range(25))).orderBy("page_num", "pos").collect():
        got.setdefault(r.page_num, []).append(r.seq)
    assert got == want


def test_body_size_and_headings(spark):
    rows = [block(0, (50, 10, 500, 30), "Big title", size=18.0, bold=True), block(1, (50, 40, 500, 60), "Smaller", size=13.0, bold=True), block(2, (50, 70, 500, 90), "body text " * 20), block(3, (10, 100, 25, 400), "rotated", size=20.0), block(4, (50, 110, 500, 120), "Bold body", bold=True)]
    df = blocks_of(spark, rows).withColumn("pos", F.col("seq"))
    assert structure.body_size(df).first().body == 10.0
    levels = {r.seq: r.level for r in structure.heading_levels(df).collect()}
    assert levels == {0: 1, 1: 2, 2: None, 3: None, 4: 3}
    many = [block(i, (50, 10 * i, 500, 10 * i + 8), f"h{i}", size=30.0 - i) for i in range(9)] + [block(20, (50, 300, 500, 320), "x" * 500)]
    levels = {r.seq: r.level for r in structure.heading_levels(blocks_of(spark, many).withColumn("pos", F.col("seq"))).collect()}
    assert [levels[i] for i in range(9)] == [1, 2, 3, 4, 5, 6, 6, 6, 6] and levels[20] is None


def test_body_size_takes_the_first_of_equals(spark):
    df = blocks_of(spark, [block(0, (0, 0, 9, 9), "abcd", size=12.0), block(1, (0, 0, 9, 9), "efgh", size=9.0), block(2, (0, 0, 9, 9), None, kind="image", size=None, doc="e")])
    assert {r.doc_id: r.body for r in structure.body_size(df.withColumn("pos", F.col("seq"))).collect()} == {"d": 12.0, "e": 0.0}


def test_links(spark):
    df = blocks_of(spark, [block(0, (0, 0, 200, 20), "Visit https://example.com/ for more"), block(1, (0, 40, 200, 60), "see github\ncom now, github com"), block(2, (0, 300, 200, 320), "github com")])
    links = spark.createDataFrame([("d", 1, 0, 0.0, 0.0, 100.0, 20.0, "https://example.com/", "https://example.com/docs"), ("d", 1, 1, 0.0, 40.0, 100.0, 60.0, "github  com", "https://github.com"), ("d", 1, 2, 0.0, 700.0, 9.0, 720.0, "github", "x"), ("d", 1, 3, 0.0, 0.0, 50.0, 20.0, " ", "y")], schemas.LINKS)
    got = [r.text for r in structure.linkify(df, links).orderBy("seq").collect()]
    assert got == ["Visit [https://example.com/](https://example.com/docs) for more", "see [github com](https://github.com) now, github com", "github com"]


# ---- boilerplate and OCR


def report(spark, n):
    rows = []
    for p in range(1, n + 1):
        rows += [block(0, (50, 20, 500, 35), "Monthly  Report" if p % 2 else "monthly report", page=p), block(1, (50, 120, 500, 400), f"Body of page {p}. " * 8, page=p), block(2, (280, 772, 320, 786), str(p), page=p)]
    return rows


def test_boilerplate(spark):
    six = report(spark, 6) + [block(3, (50, 25, 500, 40), "a note found once", page=3)]
    left = boilerplate.strip_boilerplate(blocks_of(spark, six), pages_of(spark, range(1, 7))).collect()
    assert sorted((r.page_num, r.seq) for r in left) == sorted([(p, 1) for p in range(1, 7)] + [(3, 3)])
    short = report(spark, 3)
    assert boilerplate.strip_boilerplate(blocks_of(spark, short), pages_of(spark, range(1, 4))).count() == len(short)


def test_page_decisions(spark):
    sheets = pages_of(spark, [1, 2, 3], 600.0, 800.0)
    texts = spark.createDataFrame([("d", 1, "x" * 60), ("d", 2, " "), ("d", 3, "few chars")], "doc_id string, page_num int, text string")
    draws = spark.createDataFrame([("d", 2, 0, 7, 0.0, 0.0, 600.0, 790.0), ("d", 1, 0, 7, 0.0, 0.0, 600.0, 900.0)], schemas.IMAGE_DRAWS)
    got = {r.page_num: (r.needs_ocr, round(r.coverage, 3)) for r in ocr.page_decisions(sheets, texts, draws).collect()}
    assert got == {1: (False, 1.0), 2: (True, 0.988), 3: (False, 0.0)}


def test_ocr_words(spark):
    rows = [("d", 1, 1, 1, 2, 3, "second", 90.0), ("d", 1, 1, 1, 1, 1, "first", 80.0), ("d", 1, 1, 1, 1, 2, "line", -1.0), ("d", 1, 1, 1, 1, 9, " ", 5.0), ("d", 2, 1, 1, 1, 1, "", 50.0)]
    got = {r.page_num: (r.text, r.mean_confidence, r.fallback) for r in ocr.ocr_pages(spark.createDataFrame(rows, schemas.OCR_WORDS)).collect()}
    assert got == {1: ("first line\nsecond", 85.0, True), 2: ("", 0.0, True)}


# ---- tables

GRID = [["", "2024", "2025", "2026"], ["GDP", "1.2", "1,4", "−0.3"], ["CPI", "2", "3", "4"], ["Rate", "5", "6", "7"]]


def candidates(spark, grids, box=(10.0, 10.0, 290.0, 90.0)):
    return spark.createDataFrame([("d", 1, i, *box, g) for i, g in enumerate(grids)], schemas.TABLE_CANDIDATES)


def region_rows(spark, boxes):
    return spark.createDataFrame([("d", 1, i, *map(float, b)) for i, b in enumerate(boxes)], "doc_id string, page_num int, region_index int, x0 double, y0 double, x1 double, y1 double")


def test_table_gates(spark):
    grids = [GRID, [["only", "a", "caption"]], [[str(i), str(i * 2)] for i in range(5)]]
    none = region_rows(spark, [])
    got = {r.table_id: r.keep for r in tables.gates(candidates(spark, grids), none).collect()}
    assert got == {0: True, 1: False, 2: False}
    assert not tables.gates(candidates(spark, [GRID]), region_rows(spark, [(0, 0, 300, 100)])).first().keep
    assert tables.gates(candidates(spark, [GRID]), region_rows(spark, [(150, 10, 300, 90)])).first().keep  # exactly half
    kept = tables.keep_tables(candidates(spark, grids), none).collect()
    assert len(kept) == 1 and kept[0].pos == 1


def test_text_of_tables_goes(spark):
    df = blocks_of(spark, [block(0, (10, 10, 280, 90)), block(1, (10, 200, 280, 230)), block(2, (0, 50, 300, 150)), block(3, (10, 10, 20, 20), kind="image")])
    table = candidates(spark, [GRID], (0.0, 0.0, 300.0, 100.0))
    assert sorted(r.seq for r in tables.without_table_text(df, table).collect()) == [1, 3]


def test_probe(spark):
    grids = [GRID, [["a"]], [["", "", ""], ["x", "", ""], ["", "", ""]]]
    got = {r.table_id: r.fault for r in tables.probe(candidates(spark, grids), region_rows(spark, [])).collect()}
    assert got == {0: "good", 1: "tiny", 2: "empty"}


# ---- regions


def drawings_of(spark, boxes, op="l"):
    ops = [(op, 0.0, 0.0, 9.0, 9.0)]
    return spark.createDataFrame([("d", 1, i, *map(float, b), ops) for i, b in enumerate(boxes)], schemas.DRAWINGS)


def brute_components(boxes, slack):
    group = list(range(len(boxes)))
    for i, a in enumerate(boxes):
        for j in range(i):
            b = boxes[j]
            if not (a[2] + slack < b[0] or b[2] + slack < a[0] or a[3] + slack < b[1] or b[3] + slack < a[1]):
                x, y = group[i], group[j]
                if x != y:
                    group = [min(x, y) if g in (x, y) else g for g in group]
    return group


@pytest.mark.parametrize("seed", range(3))
def test_clusters_equal_all_pairs(spark, seed):
    rnd = random.Random(seed)
    rows, want = [], {}
    for page in range(8):
        boxes = [(x := rnd.uniform(-50, 500), y := rnd.uniform(-50, 700), x + rnd.uniform(0, 90), y + rnd.uniform(0, 40)) for _ in range(90)]
        rows += [("d", page, i, *b, []) for i, b in enumerate(boxes)]
        want[page] = brute_components(boxes, 4.0 * seed)
    got = regions.clusters(spark.createDataFrame(rows, schemas.DRAWINGS), slack=4.0 * seed).collect()
    assert len(got) == len(rows) and all(r.cluster == want[r.page_num][r.drawing_id] for r in got)


def test_y_gap(spark):
    df = drawings_of(spark, [(0, 0, 9, 50), (0, 10, 9, 20), (0, 90, 9, 95), (0, 135.5, 9, 140)])
    assert [r.part for r in regions.split_by_gap(df, ["doc_id"]).orderBy("y0").collect()] == [0, 0, 0, 1]


def heap(x, y, n=48):
    return [(x + 13 * (i % 8), y + 12 * (i // 8), x + 13 * (i % 8) + 10, y + 12 * (i // 8) + 9) for i in range(n)]


def no_tables(spark):
    return spark.createDataFrame([], schemas.TABLE_CANDIDATES)


def test_regions(spark):
    sheets = pages_of(spark, [1], 595.0, 842.0)
    texts = blocks_of(spark, [block(0, (100, 80, 200, 95), "caption above"), block(1, (100, 30, 200, 40), "far")])
    found = regions.find_regions(drawings_of(spark, heap(100, 110) + heap(100, 400) + [(0, 0, 595, 842), (5, 5, 6, 6)]), sheets, texts, no_tables(spark)).orderBy("region_index").collect()
    assert [(r.region_index, r.n_drawings) for r in found] == [(1, 48), (2, 48)]
    assert (found[0].x0, found[0].y0, found[0].x1, found[0].y1) == (94.0, 80.0, 207.0, 185.0)
    assert regions.find_regions(drawings_of(spark, heap(100, 110, 29)), sheets, texts, no_tables(spark)).count() == 0


def test_region_on_a_table_goes_unless_it_is_sloped(spark):
    sheets = pages_of(spark, [1], 595.0, 842.0)
    texts = blocks_of(spark, [])
    grid = candidates(spark, [GRID], (90.0, 100.0, 220.0, 200.0))
    flat = drawings_of(spark, heap(100, 110)).withColumn("ops", F.expr("transform(ops, o -> named_struct('op', 're', 'ax', 0D, 'ay', 0D, 'bx', 9D, 'by', 9D))"))
    assert regions.find_regions(flat, sheets, texts, grid).count() == 0
    assert regions.find_regions(drawings_of(spark, heap(100, 110)), sheets, texts, grid).count() == 1


def test_off_page_heap_leaves_no_degenerate_region(spark):
    found = regions.find_regions(drawings_of(spark, heap(100, -185) + heap(100, 200)), pages_of(spark, [1], 595.0, 842.0), blocks_of(spark, []), no_tables(spark)).collect()
    assert len(found) == 1 and all(r.x1 - r.x0 >= 1 and r.y1 - r.y0 >= 1 for r in found)


def test_label_texts_go(spark):
    df = blocks_of(spark, [block(0, (150, 150, 250, 170)), block(1, (100, 380, 400, 480)), block(2, (100, 500, 400, 520))])
    assert sorted(r.seq for r in regions.without_labels(df, region_rows(spark, [(100, 100, 400, 400)])).collect()) == [1, 2]


def test_geometry(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0), (20.0, 0.0, 30.0, 10.0), (5.0, 5.0, 15.0, 15.0)], "x0 double, y0 double, x1 double, y1 double")
    b = (F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(10.0))
    got = [tuple(r) for r in df.select(G.common_area(G.box(), b), G.share_inside(G.box(), b), G.meets(G.box(), b), G.close(G.box(), b, 10.0)).collect()]
    assert got == [(100.0, 1.0, True, True), (0.0, 0.0, False, True), (25.0, 0.25, True, True)]


# ---- context


def reference_context(words_by_page, fig_page, above, below, n):
    """words_by_page: {page: words}; above and below: words on the figure's page."""
    before, after = list(above), list(below)
    for p in sorted((p for p in words_by_page if p < fig_page), reverse=True):
        before = words_by_page[p] + before
    for p in sorted(p for p in words_by_page if p > fig_page):
        after = after + words_by_page[p]
    return " ".join(before[-n:] if n else []), " ".join(after[:n])


@pytest.mark.parametrize("n", [0, 1, 5, 13, 400])
def test_context_spills_over_pages(spark, n):
    rnd = random.Random(n)
    rows, words = [], {}
    for page in range(1, 8):
        for seq in range(rnd.randint(0, 4)):
            text = " ".join(f"p{page}b{seq}w{k}" for k in range(rnd.choice([0, 1, 6])))
            rows.append(block(seq, (50, 100 * seq, 500, 100 * seq + 50), text, page=page))
            words.setdefault(page, []).extend(text.split())
    blocks = blocks_of(spark, rows).withColumn("pos", F.col("seq"))
    figs = [("d", page, f, y, y + 100.0) for page in range(1, 8) for f, y in (("a", 60.0), ("b", 150.0))]
    df = spark.createDataFrame(figs, "doc_id string, page_num int, fig string, y0 double, y1 double")
    got = {(r.page_num, r.fig): (r.before, r.after) for r in context.figure_context(df, blocks, n, n).collect()}
    for _, page, f, y0, y1 in figs:
        mine = [r for r in rows if r[1] == page]
        above = [w for r in mine if r[7] <= y0 for w in r[8].split()]
        below = [w for r in mine if r[5] >= y1 for w in r[8].split()]
        assert got[page, f] == reference_context(words, page, above, below, n)


def test_leading_sample(spark):
    def sample(texts, n, scanned=()):
        rows = [block(0, (0, 0, 9, 9), t, page=p) for p, t in enumerate(texts, 1)]
        return context.leading_sample(blocks_of(spark, rows).withColumn("pos", F.col("seq")), pages_of(spark, range(1, len(texts) + 1 + len(scanned)), ocr_texts=scanned), n).first().sample

    assert sample(["one two three", "four five six seven"], 4) == "one two three four"
    assert sample(["a b", "c d e"], 4) == "a b c d"
    assert context.leading_sample(blocks_of(spark, []).withColumn("pos", F.col("seq")), pages_of(spark, [1], ocr_texts=[(1, "scanned words here")]), 2).first().sample == "scanned words"


# ---- figures and descriptions


def test_images_are_judged(spark):
    resources = spark.createDataFrame([("d", 1, 1, 7, 100, 100, "png", b"a"), ("d", 2, 1, 7, 100, 100, "png", b"a"), ("d", 1, 2, 8, 49, 100, None, b"b"), ("d", 3, 1, 9, 500, 500, "jpg", b"c")], schemas.IMAGE_RESOURCES)
    draws = spark.createDataFrame([("d", 1, 1, 7, 5.0, 5.0, 9.0, 9.0), ("d", 1, 0, 7, 1.0, 1.0, 3.0, 3.0), ("d", 1, 2, 8, 0.0, 0.0, 9.0, 9.0), ("d", 3, 0, 9, 0.0, 0.0, 595.0, 700.0)], schemas.IMAGE_DRAWS)
    judged = figures.judged_images(resources, draws, pages_of(spark, [1, 2, 3], ocr_texts=[(3, "t")]))
    got = {(r.page_num, r.idx): (r.drop_reason, r.x0, r.path) for r in judged.collect()}
    assert got == {(1, 1): (None, 1.0, "page-001-img-01.png"), (2, 1): ("not_drawn", None, "page-002-img-01.png"), (1, 2): ("small", 0.0, "page-001-img-02.png"), (3, 1): ("full_page", 0.0, "page-003-img-01.jpg")}
    assert {r.reason: r.n for r in figures.drop_counts(judged).collect()} == {"kept": 1, "not_drawn": 1, "small": 1, "full_page": 1}
    assert figures.kept_images(judged).count() == 1


def test_counts_of_figures(spark):
    rows = [("d", "image", "a chart"), ("d", "image", "[SKIP]"), ("d", "diagram", "[SKIP]"), ("d", "diagram", "flow"), ("d", "image", " "), ("d", "image", None)]
    got = figures.figure_counts(spark.createDataFrame(rows, "doc_id string, kind string, description string")).first()
    assert (got.figure_count, got.skipped_count) == (2, 1)


def test_prompt_sections(spark):
    df = spark.range(1)
    ask = lambda **k: df.select(describe.compose_prompt(F.lit("Do."), **k)).first()[0]
    assert ask() == "Do."
    full = ask(summary=F.lit(" a report "), before=F.lit("up"), after=F.lit(""), significance=True, language=F.lit("French"))
    assert full.index("[Document type]\na report") < full.index("[Text context before the image]\nup") < full.index("[Task]\nDo.") < full.index("[SKIP]") < full.index("Answer in French.")
    assert "after the image" not in full and ask(before=F.lit(" ")) == "Do."


def test_one_call_for_each_content(spark):
    jobs = spark.createDataFrame([("d", p, 1, "image", "k1", "aa1", "p") for p in (1, 2, 3)] + [("d", 4, 1, "image", "k2", "bbf", "p"), ("d", 5, 1, "image", "k3", "cc", "p")], "doc_id string, page_num int, idx int, kind string, key string, digest string, prompt string")
    cache = spark.createDataFrame([("k3", "known")], "key string, text string")
    done = describe.describe(jobs, cache, describe.fake_model)
    got = {r.page_num: (r.text, r.truncated, r.cached) for r in done.collect()}
    assert got == {1: ("image aa1", False, False), 2: ("image aa1", False, False), 3: ("image aa1", False, False), 4: ("image bbf", True, False), 5: ("known", False, True)}
    assert describe.representatives(jobs).count() == 3
    assert {r.key for r in describe.to_share(done).collect()} == {"k1", "k3"}


def test_model_faults(spark):
    calls = []

    def shaky(kind, digest, prompt):
        calls.append(1)
        if len(calls) < 2:
            raise ConnectionError("busy")
        return {"text": "ok"}

    assert describe._attempted(shaky, 3, "image", "d", "p")[0] == "ok" and len(calls) == 2
    with pytest.raises(ValueError):
        describe._attempted(lambda *_: {"text": " "}, 3, "image", "d", "p")
    with pytest.raises(ConnectionError):
        describe._attempted(lambda *_: (_ for _ in ()).throw(ConnectionError()), 1, "diagram", "d", "p")


def test_structured_answers(spark):
    got = column(spark, describe.parsed_answer, ['{"is_figure": true, "kind": "chart", "description": "bars"}', '{"is_figure": false, "kind": "other", "description": ""}', "plain words", '{"kind": 1}'])
    assert got == ["bars", "[SKIP]", "plain words", '{"kind": 1}']


def test_usage_and_cost(spark):
    calls = spark.createDataFrame([("a", 1, 10, 5, 0, True), ("a", 2, 20, 8, 28, True), ("b", 1, None, None, None, False), ("c", 1, 10**6, 10**6, None, True)], schemas.MODEL_CALLS)
    rows = usage.cost(usage.usage(calls), F.lit("0.00000025"), F.lit("0.0000005"))
    got = {r.doc_id: (r.api_calls, r.prompt_tokens, r.completion_tokens, r.total_tokens, r.calls_missing_usage, float(r.estimated_cost)) for r in rows.collect()}
    assert got["a"][:5] == (2, 30, 13, 43, 0) and got["b"][:5] == (1, 0, 0, 0, 1) and got["c"][5] == 0.75
    unknown = usage.cost(usage.usage(calls), F.lit(None).cast("double"), F.lit("1"))
    assert {r.estimated_cost for r in unknown.collect()} == {None}
    assert "cost unknown" in unknown.select(usage.usage_line()).first()[0] and "0.7500 EUR" in rows.where("doc_id = 'c'").select(usage.usage_line("EUR")).first()[0]


# ---- output and pages


def sample(spark):
    rows = [block(0, (50, 10, 500, 30), "Title", size=18.0), block(1, (50, 40, 500, 60), "body text " * 9), block(2, (50, 100, 300, 200), None, kind="image", size=None, xref=42), block(3, (50, 210, 300, 300), None, kind="diagram", size=None, region_index=1), block(4, (50, 310, 300, 400), None, kind="table", size=None, cells=[["a", "b"], ["1", "2"]]), block(5, (50, 420, 500, 440), "• item")]
    said = [("d", "image", 1, 42, "two\n\nparts", False), ("d", "diagram", 1, 1, "flow", False), ("d", "image", 2, 7, "photo", False), ("d", "image", 1, 43, "[SKIP]", False)]
    images = spark.createDataFrame([("d", 1, 1, 42, "page-001-img-01.png", None, None, None, None), ("d", 2, 1, 7, "page-002-img-01.png", 1.0, 2.0, 3.0, 4.0), ("d", 1, 2, 43, "page-001-img-02.png", 1.0, 1.0, 2.0, 2.0)], "doc_id string, page_num int, idx int, xref int, path string, x0 double, y0 double, x1 double, y1 double")
    return blocks_of(spark, rows).withColumn("pos", F.col("seq")), pages_of(spark, [1, 2], ocr_texts=[(2, " scanned ")]), images, spark.createDataFrame(said, schemas.DESCRIPTIONS)


def test_markdown(spark):
    blocks, sheets, images, said = sample(spark)
    got = output.to_markdown(blocks, sheets, images, said).first().markdown
    assert got == "<!-- page 1 -->\n\n# Title\n\n" + ("body text " * 9).strip() + "\n\n![Image, page 1](images/page-001-img-01.png)\n\n> two\n>\n> parts\n\n![Diagram, page 1](diagrams/page-001-diagram-01.png)\n\n> flow\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n- item\n\n<!-- page 2 -->\n\nscanned\n\n![Image, page 2](images/page-002-img-01.png)\n\n> photo\n"
    assert "![" not in output.to_markdown(blocks, sheets, images, said.limit(0)).first().markdown


def test_plain_texts(spark):
    blocks, sheets, images, said = sample(spark)
    got = output.plain_texts(blocks, sheets, images, said).first()
    assert got.raw_text.startswith("--- Page 1 ---\n\nTitle\n\nbody") and "[Image" not in got.raw_text and "| a | b |" in got.raw_text and got.raw_text.endswith("scanned\n")
    assert "[Image: two\n\nparts]\n\n[Diagram: flow]" in got.full_text and got.full_text.endswith("scanned \n\n[Image: photo]\n")


def test_manifest(spark):
    _, _, images, said = sample(spark)
    drawn = spark.createDataFrame([("d", 1, 1, 50.0, 210.0, 300.0, 300.0)], "doc_id string, page_num int, region_index int, x0 double, y0 double, x1 double, y1 double")
    got = [tuple(r)[1:8] for r in figures.manifest(images, drawn, said).orderBy("ord").collect()]
    assert got == [
        ("page-001-img-01", 1, "image", None, "images/page-001-img-01.png", "two\n\nparts", False),
        ("page-001-img-02", 1, "image", [1.0, 1.0, 2.0, 2.0], "images/page-001-img-02.png", "", True),
        ("page-001-diagram-01", 1, "diagram", [50.0, 210.0, 300.0, 300.0], "diagrams/page-001-diagram-01.png", "flow", False),
        ("page-002-img-01", 2, "image", [1.0, 2.0, 3.0, 4.0], "images/page-002-img-01.png", "photo", False),
    ]


def test_split_pages(spark):
    df = spark.createDataFrame([("a", "<!-- page 1 -->\n\none\n\n<!-- page 2 -->\n\ntwo\n"), ("b", " no mark ")], "doc_id string, markdown string")
    got = sorted(map(tuple, pages.split_pages(df).collect()))
    assert got == [("a", 0, 0, "one"), ("a", 1, 1, "two"), ("b", 0, 0, "no mark")]


def test_page_selection():
    assert pages.parse_selection(None) is None
    assert pages.parse_selection([0, 2]) == [0, 2] and pages.parse_selection(["1-2", 0, 0]) == [1, 2, 0, 0] and pages.parse_selection("3-3") == [3]
    for bad in ([], [-1], ["2-1"], ["x"], [True], [1.5], "1"):
        with pytest.raises(ValueError):
            pages.parse_selection(bad)


def test_page_records(spark):
    text = "<!-- page 1 -->\n\nText\n\n![Image, page 1](images/f1)\n\n> cap\n\n<!-- page 2 -->\n\n![Diagram, page 2](diagrams/f2)\n\n> cap2"
    docs = spark.createDataFrame([("d", text)], "doc_id string, markdown string")
    figs = spark.createDataFrame([("d", "f1", 1, [0.5, 1.5, 2.4, 3.6], 100, 100, "image/png", bytearray(b"x"), 1), ("d", "f2", 2, None, 50, 200, "image/png", bytearray(b"y"), 2)], "doc_id string, id string, page int, bbox array<double>, width_px int, height_px int, mime string, content binary, ord int")
    sizes = spark.createDataFrame([("d", 0, 595.2, 841.9)], "doc_id string, index int, width double, height double")
    cut = spark.createDataFrame([("d", 0, 4), ("d", 1, 2)], "doc_id string, index int, original int")
    got = pages.ocr_records(docs, figs, sizes, with_bytes=True, index_map=cut).orderBy("pos").collect()
    assert [r["index"] for r in got] == [4, 2]
    assert got[0].markdown == "Text\n\n![f1](f1)\n\n> cap" and tuple(got[0].dimensions) == (72, 842, 595) and got[1].dimensions is None
    assert tuple(got[0].images[0]) == ("f1", 0, 2, 2, 4, "data:image/png;base64,eA==") and got[1].images[0].top_left_x is None
    for k, want in (({"limit": 0}, 0), ({"least": 101}, 0), ({"least": 100}, 1), ({"limit": 1}, 1)):
        rows = pages.ocr_records(docs, figs, sizes, **k).orderBy("pos").collect()
        assert sum(len(r.images) for r in rows) == want and "cap" in rows[0].markdown and ("![" in rows[0].markdown) == (want == 1)


def test_request_parameters():
    assert pages.validated({"pages": ["0-1"], "image_limit": 3, "bbox_annotation_format": None}) == {"pages": [0, 1], "image_limit": 3}
    for bad in ({"image_limit": -1}, {"image_limit": True}, {"include_image_base64": 1}, {"nope": 1}, {"bbox_annotation_format": {}}):
        with pytest.raises(ValueError):
            pages.validated(bad)


# ---- formats


def zipped(*names, mimetype=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        if mimetype:
            z.writestr("mimetype", mimetype)
        for n in names:
            z.writestr(n, "x")
    return out.getvalue()


def test_sniffing_and_gate(spark):
    cases = [
        ("a.pdf", b"%PDF-1.7", "pdf", None), ("a.epub", zipped("META-INF/x", mimetype="application/epub+zip"), "epub", None), ("a.docx", zipped("word/document.xml"), "docx", None), ("a.xlsx", zipped("xl/workbook.xml"), "xlsx", None),
        ("a.pptx", zipped("ppt/slide.xml"), "pptx", None), ("a.doc", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1rest", "ole", "unsupported"), ("a", b"plain text", None, "unsupported"), ("a.pdf", zipped("x.txt"), None, "mismatch"), ("a.epub", b"PK\x03\x04broken", None, "mismatch"),
        ("a.cbz", zipped("1.JPG", "2.png"), "cbz", None), ("a.xps", zipped("a.fdseq"), "xps", None), ("a.mobi", b"x" * 60 + b"BOOKMOBI", "mobi", None), ("a.fb2", b"<?xml version='1.0'?>" + b" " * 200 + b"<FictionBook>", "fb2", None), ("a.pdf", b"PK\x03\x04", None, "mismatch"), ("b.epub", b"%PDF", "pdf", "mismatch"), ("x.tar.gz", b"%PDF", "pdf", "unsupported"), (".hidden", b"%PDF", "pdf", None),
    ]
    df = spark.createDataFrame([(i, n, bytearray(c), len(c)) for i, (n, c, _, _) in enumerate(cases)], "i int, name string, content binary, size long")
    got = [(r.found, r.refusal) for r in formats.gated(formats.sniffed(df), "name").orderBy("i").collect()]
    assert got == [(f, e) for _, _, f, e in cases]
    big = formats.gated(df.limit(1).withColumn("found", F.lit("pdf")).withColumn("size", F.lit(formats.LARGEST + 1)), "name").first()
    assert (big.refusal, big.status) == ("too_large", 413)


def test_allowlist():
    assert formats.allowlist(["pdf", "EPUB", "pdf"]) == ("pdf", "epub")
    for bad, office in (([], True), (["docx"], False), (["exe"], True)):
        with pytest.raises(ValueError):
            formats.allowlist(bad, office)


def test_data_uris(spark):
    assert column(spark, formats.data_uri_bytes, ["data:image/png;base64,eA==", "data:x;base64,%%", "http://x", None]) == [bytearray(b"x"), None, None, None]


def test_html(spark):
    html = "<!-- <p>no</p> --><script>var t='</p><p>no';</script><h1>Head &amp; more</h1><ul><li><a href='x'>q</a><li><a class=k href=\"/u\">A <b>link</b></a></ul><p>One<br>two<p> <P>Three</p><a href=\"\">x</a><a href=\"/v\"> </a>"
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert [(r.tag, r.text) for r in documents.html_blocks(df).orderBy("pos").collect()] == [("h1", "Head & more"), ("li", "q"), ("li", "A link"), ("p", "One two"), ("p", "Three")]
    assert [(r.uri, r.anchor) for r in documents.html_links(df).collect()] == [("/u", "A link")]


def test_docx_reader(spark):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Some </w:t></w:r><w:r><w:t>{"text " * 20}</w:t></w:r></w:p></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
    files = spark.createDataFrame([("d", bytearray(out.getvalue())), ("bad", bytearray(b"no zip"))], "doc_id string, content binary")

    class Reader(documents.OoxmlProvider):
        def rows(self, table, doc_id, content):
            try:
                yield from super().rows(table, doc_id, content)
            except zipfile.BadZipFile as e:
                raise ValueError(str(e)) from e

    rows = documents.provided(files, Reader(), "blocks", schemas.BLOCKS)
    ordered = layout.reading_order(rows, rows.select("doc_id", "page_num").distinct().selectExpr("*", "false is_ocr", "612D width", "792D height", "string(null) ocr_text"))
    got = output.to_markdown(ordered, adapters.doc_pages(rows)).collect()
    assert len(got) == 1 and got[0].markdown.startswith("<!-- page 1 -->\n\n# Title\n\nSome text")


# ---- metrics


def test_metrics(spark):
    token = lambda ts: spark.createDataFrame([("d", t) for t in ts], "doc_id string, token string")
    r = evaluation.multiset_recall(token("aab"), token("aabbc"), ["doc_id"]).first()
    assert (r.hits, r.truth_n, r.recall) == (3, 5, 0.6)
    p = evaluation.precision_recall(token("abx"), token("abc"), ["doc_id"], "token").first()
    assert (p.true_positives, p.found_n, p.truth_n) == (2, 3, 3)
    texts = spark.createDataFrame([("d", 1, "Figure 1 and Figure 2, Chart 9"), ("d", 2, "see Figure 1, Figurine 4"), ("d", 5, "Figure 3")], "doc_id string, page_num int, text string")
    caps = evaluation.captions(texts)
    assert sorted((r.word, r.number, r.page_num) for r in caps.collect()) == [("Figure", 1, 1), ("Figure", 1, 2), ("Figure", 2, 1), ("Figure", 3, 5)]
    figs = spark.createDataFrame([("d", 2, False), ("d", 5, True)], "doc_id string, page int, skipped boolean")
    got = evaluation.caption_coverage(caps, figs).first()
    assert (got.total, got.covered) == (3, 1)
    assert sorted((r.number, r.pages) for r in evaluation.missed_captions(caps, figs).collect()) == [(2, [1]), (3, [5])]
    v = evaluation.latencies(spark.createDataFrame([("x", float(i)) for i in range(1, 21)], "k string, v double"), "k", "v").first()
    assert (v.median, v.p95, v.longest) == (10.5, 20.0, 20.0)
    zips = spark.createDataFrame([("d", "ppt/media/a.PNG", 5000), ("d", "ppt/media/b.png", 100), ("d", "ppt/x.png", 5000)], "doc_id string, name string, size long")
    assert evaluation.source_images(zips).first().images == 1
