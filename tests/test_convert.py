from pyspark.sql import functions as F

from quirefold import schemas
from quirefold.operators import describe, output
from quirefold.plans import convert
from quirefold.sources.config import Settings, load
from tests.test_operators import GRID, block, blocks_of, heap, pages_of

import pytest


def document(spark):
    rows = []
    for p in range(1, 6):
        rows += [block(0, (50, 10, 300, 22), "Running title", size=9.0, page=p), block(1, (50, 100, 500, 120), f"Words of page {p}. " * 10, page=p), block(5, (280, 790, 300, 800), str(p), size=9.0, page=p)]
        rows.append(block(2, (50, 140, 150, 200), None, kind="image", size=None, xref=7, page=p))
    rows += [block(3, (60, 610, 200, 640), "1.2", page=2), block(4, (110, 420, 190, 430), "axis label", page=1)]
    drawings = [("d", 1, i, *map(float, b), [("l", 0.0, 0.0, 9.0, 9.0)]) for i, b in enumerate(heap(100, 400))]
    resources = [("d", p, 1, 7, 100, 100, "png", bytearray(b"same bytes")) for p in range(1, 6)]
    draws = [("d", p, 0, 7, 50.0, 140.0, 150.0, 200.0) for p in range(1, 6)]
    tables = [("d", 2, 0, 50.0, 600.0, 400.0, 700.0, GRID)]
    make = spark.createDataFrame
    return convert.Document(pages_of(spark, range(1, 6), 595.0, 842.0), blocks_of(spark, rows), make(drawings, schemas.DRAWINGS), make(tables, schemas.TABLE_CANDIDATES), make(resources, schemas.IMAGE_RESOURCES), make(draws, schemas.IMAGE_DRAWS), make([], schemas.FILES))


@pytest.mark.parametrize("partitions", ["2", "7"])
def test_whole_conversion(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        settings = Settings("m", "u", "Describe.", words_before=3, words_after=3)
        none = spark.createDataFrame([], "key string, text string")
        out = convert.convert(document(spark), settings, describe.fake_model, none)
        text = out.markdown.first().markdown
        assert "Running title" not in text and "axis label" not in text and "\n\n3\n\n" not in text
        assert text.count("<!-- page") == 5 and text.count("![Image, page") == 5 and text.count("![Diagram, page 1](diagrams/page-001-diagram-01.png)") == 1
        assert "| GDP | 1.2 |" in text and text.count("1.2") == 1
        assert [(r.kind, r.page) for r in out.figures.orderBy("ord").collect()] == [("image", 1), ("diagram", 1)] + [("image", p) for p in range(2, 6)]
        assert tuple(out.counts.first())[1:] == (6, 0)
        if partitions != "2":
            return
        # Context differs by page, so the same image asks once for each prompt; without context, once in all.
        bare = convert.convert(document(spark), Settings("m", "u", "Describe."), describe.fake_model, none)
        assert bare.results.where("kind = 'image'").select("key").distinct().count() == 1
        known = out.results.select("key", "text").distinct()
        assert convert.convert(document(spark), settings, lambda *_: {"text": ""}, known).results.where(~F.col("cached")).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_records_and_payloads(spark):
    settings = Settings("m", "u", "Describe.", input_token_price=0.001, output_token_price=0.002, currency="EUR")
    doc = document(spark)
    made = spark.createDataFrame
    done = convert.Conversion(made([("d", "<!-- page 1 -->")], "doc_id string, markdown string"), None, made([("d", 6, 0)], "doc_id string, figure_count long, skipped_count long"), None)
    calls = made([("d", 1, 10, 5, 0, True)], schemas.MODEL_CALLS)
    rows = convert.records(doc, done, calls, made([("d", "English")], "doc_id string, language string"), settings)
    r = rows.first()
    assert (r.page_count, r.figure_count, r.language, r.total_tokens, float(r.estimated_cost), r.currency) == (5, 6, "English", 15, 0.02, "EUR")
    back = convert.from_payload(convert.to_payload(rows, settings)).first()
    assert back.asDict() == {k: r[k] for k in back.asDict()}
    for form in ("md", "json", "both"):
        assert "<!-- page 1 -->" in output.response(rows, form).first().payload
    with pytest.raises(ValueError):
        output.response(rows, "xml")


def test_answers_about_documents(spark):
    samples = spark.createDataFrame([("a", "words"), ("b", ""), ("c", "more")], "doc_id string, sample string")
    figs = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    said = lambda text, cut=False: lambda kind, digest, prompt: {"text": text, "truncated": cut}
    got = lambda df: {r.doc_id: tuple(r)[1:] for r in df.collect()}
    assert got(describe.languages(samples, figs, said(" Swedish. "))) == {"a": ("Swedish",), "b": ("",), "c": ("",)}
    assert got(describe.languages(samples, figs, said("The text is", True)))["a"] == ("",)
    assert got(describe.summaries(samples, figs, said("A report", True))) == {"a": ("A report", False), "b": ("", False), "c": ("", False)}


def test_settings(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("api: {model: m, base_url: u, input_token_price: 1.0, output_token_price: 2.0}\nprompts: {image: Describe.}\ncontext: {words_before: 5}\n")
    got = load(path)
    assert (got.model, got.words_before, got.words_after, got.language, got.output_token_price) == ("m", 5, 0, "auto", 2.0)
    assert got.shaping() != Settings("m", "u", "Describe.").shaping()
    for bad in ("api: {model: ' ', base_url: u}\nprompts: {image: x}", "api: {model: m, base_url: u, input_token_price: 1}\nprompts: {image: x}", "{}"):
        path.write_text(bad)
        with pytest.raises(ValueError):
            load(path)


def test_settings_shape_the_key(spark):
    docs = spark.createDataFrame([("abc",)], "doc_id string")
    base = Settings("m", "u", "Describe.")
    key = lambda s, version="1": docs.select(convert.document_key(docs["doc_id"], s, version)).first()[0]
    assert key(base) == key(Settings("m", "u", "Describe.", currency="EUR", input_token_price=1.0, output_token_price=1.0))
    others = [Settings("n", "u", "Describe."), Settings("m", "v", "Describe."), Settings("m", "u", "Say."), Settings("m", "u", "Describe.", language="French"), Settings("m", "u", "Describe.", significance=True), Settings("m", "u", "Describe.", words_before=1), Settings("m", "u", "Describe.", sample_words=5)]
    keys = [key(s) for s in others] + [key(base, "2")]
    assert len({key(base), *keys}) == len(keys) + 1 and all(k.startswith(("doc1-abc-", "doc2-abc-")) for k in keys)


def test_converted_documents_have_links(spark):
    doc = document(spark)
    block = doc.blocks.where("kind = 'text' and length(trim(text)) > 3").orderBy("doc_id", "page_num", "seq").first()
    word = block.text.split()[0]
    doc.links = spark.createDataFrame([(block.doc_id, block.page_num, 0, block.x0, block.y0, block.x1, block.y1, word, "https://a.example")], schemas.LINKS)
    blocks, _ = convert.page_blocks(doc)
    assert blocks.where(f"contains(text, '[{word}](https://a.example)')").count() == 1
