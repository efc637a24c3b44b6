"""Registered queries: each applies operators to a driver table; oracles.py has the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions import geometry as G
from quirefold.functions import text as X
from quirefold.operators import boilerplate, cache, context, describe, evaluation, figures, layout, ocr, output, pages, regions, structure, tables, usage
from quirefold.plans import convert
from quirefold.sources import adapters, documents, formats
from quirefold.sources.config import Settings

_ALL: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f):
    _ALL[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_ALL)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _blocks(spark: SparkSession, sf_dir: str, two_columns: bool = False) -> DataFrame:
    """Blocks in the order of the lines; pos is what reading order gives for one column."""
    return adapters.doc_blocks(read(spark, sf_dir, "documents"), two_columns).withColumn("pos", F.col("seq"))


def _page_texts(blocks: DataFrame) -> DataFrame:
    return output.joined(blocks, ["doc_id", "page_num"], ["pos"], "text", "\n", "text")


# ---- pages and layout


@_query
def doc_stats_scan_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.scan_hints(_page_texts(_blocks(spark, sf_dir)))


@_query
def garble_ratio_by_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.dirty_texts(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", X.garbled_share(F.col("text")).alias("garbled"), X.is_garbled(F.col("text"), 0.001).alias("warn"))


@_query
def column_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _blocks(spark, sf_dir, True)
    return layout.column_boundaries(blocks, adapters.doc_pages(blocks))


@_query
def reading_order_two_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _blocks(spark, sf_dir, True).drop("pos")
    return layout.reading_order(blocks, adapters.doc_pages(blocks)).select("doc_id", "page_num", "seq", "col", "pos")


@_query
def page_ocr_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose only image is a line's box stretched over the page by the line's number."""
    blocks = _blocks(spark, sf_dir)
    draws = blocks.where("seq = 0").select("doc_id", "page_num", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(612.0).alias("x1"), (F.length("text") * 8.0).alias("y1"))
    rows = ocr.page_decisions(adapters.doc_pages(blocks), _page_texts(blocks), draws)
    return rows.select("doc_id", "page_num", "chars", F.round("coverage", 9).alias("coverage"), "needs_ocr")


# ---- typography


@_query
def body_font_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.body_size(_blocks(spark, sf_dir))


@_query
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.heading_levels(_blocks(spark, sf_dir)).where("level is not null").select("doc_id", "page_num", "seq", "level")


@_query
def span_join_dominant_font(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as spans: a customer is a block, its lines the orders by thirds, sizes from the price."""
    orders = read(spark, sf_dir, "orders")
    spans = orders.select(F.lit("d").alias("doc_id"), F.lit(1).alias("page_num"), F.col("o_custkey").alias("block_seq"), (F.col("o_orderkey") % 3).alias("line_no"), F.col("o_orderkey").alias("span_no"), F.concat("o_orderstatus", "o_orderpriority").alias("text"), (F.col("o_totalprice") / 4).alias("size"), (F.col("o_orderkey") % 32).cast("int").alias("flags"))
    return structure.join_spans(spans).select("block_seq", "text", "font_size", "bold")


@_query
def list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third line of the documents as a bullet of a changing sort."""
    blocks = _blocks(spark, sf_dir)
    mark = F.element_at(F.array(*[F.lit(c) for c in "•–*-"]), F.col("seq") % 4 + 1)
    text = F.when(F.col("seq") % 3 == 0, F.concat(mark, F.lit("  "), "text")).otherwise(F.col("text"))
    return blocks.select("doc_id", "page_num", "seq", X.list_item(text).alias("item")).where("item is not null")


@_query
def running_lines_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    blocks = adapters.with_running_lines(_blocks(spark, sf_dir), docs)
    return boilerplate.running_lines(blocks, adapters.doc_pages(blocks))


@_query
def boilerplate_stripped_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    blocks = adapters.with_running_lines(_blocks(spark, sf_dir), docs)
    return boilerplate.strip_boilerplate(blocks, adapters.doc_pages(blocks)).groupBy("doc_id").agg(F.count("*").alias("blocks_left"))


# ---- Markdown and text


@_query
def doc_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _blocks(spark, sf_dir)
    return output.to_markdown(blocks, adapters.doc_pages(blocks))


@_query
def raw_text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _blocks(spark, sf_dir)
    return output.plain_texts(blocks, adapters.doc_pages(blocks)).select("doc_id", "raw_text")


@_query
def split_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.split_pages(doc_markdown(spark, sf_dir))


@_query
def page_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document: pages 2 to 3, then the first again."""
    found = split_pages(spark, sf_dir)
    ids = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"))
    asked = ids.select("doc_id", F.lit(0).alias("item"), F.lit(1).alias("first"), F.lit(2).alias("last")).unionByName(ids.select("doc_id", F.lit(1).alias("item"), F.lit(0).alias("first"), F.lit(0).alias("last")))
    return pages.selected(found, asked).select("doc_id", "pos", "index", F.length("markdown").alias("chars"))


@_query
def pages_out_of_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = adapters.doc_pages(_blocks(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").cast("int").alias("n"))
    asked = counts.select("doc_id", F.lit(1).alias("first"), F.lit(3).alias("last"))
    return pages.out_of_range(asked, counts).select("doc_id", F.array_join(F.col("missing").cast("array<string>"), ",").alias("missing"))


@_query
def markdown_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of a table for each customer, their priority first, ragged by status."""
    orders = read(spark, sf_dir, "orders")
    row = F.when(F.col("o_orderstatus") == "O", F.array("o_orderpriority", "o_orderstatus")).otherwise(F.array("o_orderpriority", F.concat("o_orderstatus", F.lit("|x")), F.col("o_orderkey").cast("string")))
    grids = orders.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("row")))), lambda r: r["row"]).alias("cells"))
    return grids.select("o_custkey", X.markdown_table(F.col("cells")).alias("markdown"))


@_query
def blockquotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", X.blockquote(F.col("text")).alias("quote"))


# ---- tables


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each nation's suppliers: name, size and balance, some of them blank."""
    rows = read(spark, sf_dir, "supplier")
    cells = F.array("s_name", F.when(F.col("s_suppkey") % 5 == 0, F.lit("")).otherwise(F.col("s_suppkey").cast("string")), F.when(F.col("s_nationkey") % 3 == 0, F.lit("n/a")).otherwise(F.format_string("%,.2f", "s_acctbal")))
    grids = rows.groupBy("s_nationkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", cells.alias("row")))), lambda r: r["row"]).alias("cells"))
    k = F.col("s_nationkey")
    return grids.select(F.lit("d").alias("doc_id"), (k % 4).cast("int").alias("page_num"), k.alias("table_id"), (k * 10.0).alias("x0"), (k * 20.0).alias("y0"), (k * 10.0 + 100).alias("x1"), (k * 20.0 + 50).alias("y1"), "cells")


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return read(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.lit("d").alias("doc_id"), (k % 4).cast("int").alias("page_num"), k.cast("int").alias("region_index"), (k * 11.0).alias("x0"), (k * 19.0).alias("y0"), (k * 11.0 + 80).alias("x1"), (k * 19.0 + 60).alias("y1"), F.lit(400.0).alias("height"))


@_query
def table_keep_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.gates(_candidates(spark, sf_dir), _regions(spark, sf_dir)).select("table_id", "n_rows", "n_cols", "numeric", "label", "over_figure", "keep")


@_query
def table_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.probe(_candidates(spark, sf_dir), _regions(spark, sf_dir)).groupBy("fault").agg(F.count("*").alias("n"))


@_query
def text_in_table_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = adapters.boxes(read(spark, sf_dir, "part"), "p_partkey", doc="p_size", page="p_size").withColumn("kind", F.lit("text"))
    texts = texts.withColumn("doc_id", F.lit("d")).withColumn("page_num", (F.col("page_num") % 4).cast("int"))
    return tables.without_table_text(texts, _candidates(spark, sf_dir)).select("page_num", "drawing_id")


# ---- boxes and regions


@_query
def rect_proximity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = adapters.boxes(read(spark, sf_dir, "part").withColumn("one", F.lit(1)), "p_partkey", doc="p_brand", page="one")
    return regions.near_pairs(boxes, slack=3.0)


@_query
def rect_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = adapters.boxes(read(spark, sf_dir, "part").withColumn("one", F.lit(1)), "p_partkey", doc="p_brand", page="one")
    return regions.clusters(boxes, slack=12.0).select("doc_id", "page_num", "drawing_id", "cluster")


@_query
def y_gap_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as boxes on a time axis of minutes."""
    start = F.unix_timestamp("ts").cast("double") / 60
    rows = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("drawing_id"), start.alias("y0"), (start + F.col("event_id") % 300).alias("y1"))
    return regions.split_by_gap(rows, ["user_id"], gap=600.0).select("user_id", F.col("drawing_id").alias("event_id"), "part")


@_query
def region_neighbour_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.neighbour_limits(_regions(spark, sf_dir)).select("region_index", "y_min", "y_max")


@_query
def text_in_region_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = adapters.boxes(read(spark, sf_dir, "part"), "p_partkey", doc="p_size", page="p_size").withColumn("kind", F.lit("text"))
    texts = texts.withColumn("doc_id", F.lit("d")).withColumn("page_num", (F.col("page_num") % 4).cast("int"))
    return regions.without_labels(texts, _regions(spark, sf_dir)).select("page_num", "drawing_id")


@_query
def figure_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as drawings, fifty to a page, in two heaps: the whole detection."""
    items = read(spark, sf_dir, "lineitem")
    k, p = F.col("l_orderkey"), F.col("l_partkey")
    x0, y0 = (p * 13 % 180).cast("double") + 40, (F.col("l_suppkey") * 7 % 120).cast("double") + F.when(k % 2 == 0, 60.0).otherwise(420.0)
    op = F.struct(F.lit("l").alias("op"), x0.alias("ax"), y0.alias("ay"), (x0 + 9).alias("bx"), (y0 + p % 6).alias("by"))
    drawings = items.select(F.expr("l_orderkey div 2000").cast("string").alias("doc_id"), F.expr("l_orderkey div 40 % 50").cast("int").alias("page_num"), (k * 8 + F.col("l_linenumber")).cast("long").alias("drawing_id"), x0.alias("x0"), y0.alias("y0"), (x0 + 9).alias("x1"), (y0 + 1 + p % 6).alias("y1"), F.array(op).alias("ops"))
    sheets = adapters.doc_pages(drawings)
    texts = sheets.select("doc_id", "page_num", F.lit(50.0).alias("x0"), F.lit(20.0).alias("y0"), F.lit(150.0).alias("x1"), F.lit(40.0).alias("y1"))
    none = spark.createDataFrame([], "doc_id string, page_num int, table_id int, x0 double, y0 double, x1 double, y1 double, cells array<array<string>>")
    return regions.find_regions(drawings, sheets, texts, none)


# ---- context


@_query
def context_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty words on either side of every tenth line, taken for a figure."""
    blocks = _blocks(spark, sf_dir)
    figs = blocks.where("(page_num * 12 + seq) % 10 = 3").select("doc_id", "page_num", F.col("seq").alias("fig"), "y0", "y1")
    return context.figure_context(figs, blocks, 20, 20)


@_query
def leading_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _blocks(spark, sf_dir)
    return context.leading_sample(blocks, adapters.doc_pages(blocks), 120)


# ---- figures, model calls, usage


@_query
def image_filter_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as images of a page: sizes in pixels from their size and price, drawn where a line item says so."""
    part = read(spark, sf_dir, "part")
    page = (F.col("p_partkey") % 100).cast("int")
    resources = part.select(F.lit("d").alias("doc_id"), page.alias("page_num"), F.col("p_partkey").cast("int").alias("idx"), F.col("p_partkey").cast("int").alias("xref"), (F.col("p_size") * 4).alias("width"), (F.col("p_partkey") % 200).cast("int").alias("height"), F.lit("png").alias("ext"), F.col("p_name").cast("binary").alias("content"))
    items = read(spark, sf_dir, "lineitem").where("l_partkey % 3 <> 0")
    draws = items.select(F.lit("d").alias("doc_id"), (F.col("l_partkey") % 100).cast("int").alias("page_num"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("draw_seq"), F.col("l_partkey").cast("int").alias("xref"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("l_quantity") * 12).alias("x1"), F.lit(790.0).alias("y1"))
    sheets = resources.select("doc_id", "page_num").distinct().select("doc_id", "page_num", (F.col("page_num") % 2 == 0).alias("is_ocr"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))
    return figures.drop_counts(figures.judged_images(resources, draws, sheets)).select("reason", "n")


@_query
def figure_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as images, suppliers as diagrams, described by a rule that skips some and leaves some out."""
    part, supplier = read(spark, sf_dir, "part"), read(spark, sf_dir, "supplier")
    images = part.select(F.lit("d").alias("doc_id"), F.col("p_size").cast("int").alias("page_num"), F.col("p_partkey").cast("int").alias("idx"), F.col("p_partkey").cast("int").alias("xref"), F.when(F.col("p_partkey") % 2 == 0, 1.0).alias("x0"), F.lit(2.0).alias("y0"), F.lit(3.0).alias("x1"), F.lit(4.0).alias("y1"), F.format_string("page-%03d-img-%02d.png", "p_size", "p_partkey").alias("path"))
    drawn = supplier.select(F.lit("d").alias("doc_id"), (F.col("s_suppkey") % 50 + 1).cast("int").alias("page_num"), F.col("s_suppkey").cast("int").alias("region_index"), F.lit(5.0).alias("x0"), F.lit(6.0).alias("y0"), F.lit(7.0).alias("x1"), F.lit(8.0).alias("y1"))
    told = lambda k, name: F.when(k % 7 == 0, " ").when(k % 5 == 0, " [skip] x").otherwise(name)
    said = part.select(F.lit("d").alias("doc_id"), F.lit("image").alias("kind"), F.col("p_size").cast("int").alias("page_num"), F.col("p_partkey").cast("int").alias("ref"), told(F.col("p_partkey"), F.col("p_name")).alias("text"))
    said = said.unionByName(supplier.select(F.lit("d").alias("doc_id"), F.lit("diagram").alias("kind"), (F.col("s_suppkey") % 50 + 1).cast("int").alias("page_num"), F.col("s_suppkey").cast("int").alias("ref"), told(F.col("s_suppkey"), F.col("s_name")).alias("text")))
    listed = figures.manifest(images, drawn, said)
    return listed.select("id", "page", "kind", F.array_join(F.col("bbox").cast("array<int>").cast("array<string>"), ",").alias("box"), "path", "description", "skipped")


@_query
def figure_counts_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels")
    rows = labels.select((F.col("doc_id") % 10).alias("doc_id"), F.when(F.col("toxic") == 1, "diagram").otherwise("image").alias("kind"), F.when(F.col("quality") == 0, "[SKIP]").otherwise("a figure").alias("description"))
    return figures.figure_counts(rows)


@_query
def image_dedup_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as images by their text: one call for each distinct one."""
    docs = read(spark, sf_dir, "documents").where("text is not null")
    jobs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("page_num"), F.col("doc_id").alias("idx"), describe.cache_key(F.substring(F.sha2("text", 256), 1, 32), F.lit("m"), F.lit("p")).alias("key"))
    jobs = jobs.withColumn("doc_id", F.lit("d"))
    return describe.representatives(jobs).select("idx", "key")


@_query
def cache_hit_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with even ids are known; which of the others share a text with one of them?"""
    docs = read(spark, sf_dir, "documents").where("text is not null")
    jobs = docs.where("doc_id % 2 = 1").select("doc_id", F.sha2("text", 256).alias("key"))
    known = docs.where("doc_id % 2 = 0").select(F.sha2("text", 256).alias("key"), F.lit("t").alias("text"))
    hits, misses = describe.with_known(jobs, known)
    return hits.select("doc_id", F.lit(True).alias("hit")).unionByName(misses.select("doc_id", F.lit(False).alias("hit")))


@_query
def prompts_and_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of conversations: the text before and after, a summary for some, and what their keys are."""
    rows = read(spark, sf_dir, "conversations")
    summary = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("talk "), F.col("conv_id").cast("string")))
    prompt = describe.compose_prompt(F.lit("Describe."), summary, X.last_words(F.col("text"), 5), F.lit(""), True, F.when(F.col("turn") % 2 == 0, "auto").otherwise("French"))
    return rows.select("conv_id", "turn", prompt.alias("prompt"), X.fingerprint(prompt, F.col("role")).alias("key"))


@_query
def model_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' texts described by a model that is a pure function, each distinct text once."""
    docs = read(spark, sf_dir, "documents").where("text is not null")
    jobs = docs.select(F.sha2("text", 256).alias("key")).distinct().select("key", F.lit("image").alias("kind"), F.substring("key", 1, 32).alias("digest"), F.lit("[SKIP]").alias("prompt"))
    said = describe.call_model(jobs, describe.fake_model).select("key", "result.text", "result.truncated")
    return docs.select("doc_id", F.sha2("text", 256).alias("key")).join(said, "key").select("doc_id", "text", "truncated")


@_query
def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    n = F.size(F.split("text", " "))
    calls = rows.select(F.col("conv_id").alias("doc_id"), n.alias("prompt_tokens"), (n % 7).alias("completion_tokens"), F.when(F.col("turn") % 2 == 0, 0).otherwise(n * 2).alias("total_tokens"), (F.col("role") != "system").alias("usage_present"))
    return usage.cost(usage.usage(calls), F.lit("0.00000025"), F.lit("0.0000005")).withColumn("estimated_cost", F.col("estimated_cost").cast("double"))


@_query
def single_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests for their user's daily report: the first of a day leads."""
    rows = read(spark, sf_dir, "events").select(F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd")).alias("key"), F.col("ts"), F.col("event_id").alias("request_id"))
    return cache.single_flight(rows).select("request_id", "leader", "leads")


# ---- cache


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an access log: clicks and views read, the rest writes; a store for each of ten users."""
    e = read(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 10).cast("string").alias("store"), F.col("event_id").alias("seq"), F.unix_timestamp("ts").cast("double").alias("ts"), F.when(F.col("event_id") % 3 == 0, "put").otherwise("get").alias("op"), F.concat(F.lit("k"), (F.col("event_id") % 17).cast("string")).alias("key"), F.concat(F.lit("d"), (F.col("user_id") % 7).cast("string")).alias("doc_digest"), F.when(F.col("user_id") % 2 == 0, "document").otherwise("description").alias("kind"), (F.lit(50) + F.col("event_id") % 100).cast("long").alias("size"))


@_query
def cache_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.replay(_log(spark, sf_dir), ttl=86_400.0, cap=1200)


@_query
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _log(spark, sf_dir)
    rows = e.withColumn("outcome", F.when(F.col("op") == "put", "stored").when(F.col("seq") % 5 == 0, "miss").otherwise("hit")).withColumn("expirations", (F.col("seq") % 11 == 0).cast("int")).withColumn("evictions", (F.col("seq") % 13 == 0).cast("int"))
    return cache.stats(rows)


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.last_access(_log(spark, sf_dir).withColumn("key", F.concat_ws("/", "store", "key"))).withColumn("store", F.split("key", "/")[0])


@_query
def cache_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).select("key", "last_accessed", "created", "doc_digest", "kind", "size")


@_query
def lru_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.lru_keep(_entries(spark, sf_dir), 900).select("key", "size")


@_query
def ttl_expire(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _entries(spark, sf_dir)
    now = entries.agg(F.max("last_accessed").alias("now"))
    return cache.unexpired(entries.join(F.broadcast(now)), F.col("now"), 86_400.0).select("key", "last_accessed")


@_query
def purge_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = spark.createDataFrame([("d3",), ("d5",)], "doc_digest string")
    return cache.without_document(_entries(spark, sf_dir), gone).groupBy("doc_digest").agg(F.count("*").alias("entries"), F.sum("size").alias("total_bytes"))


# ---- formats and HTML


@_query
def format_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: a name from the URL, bytes that begin like one format or another."""
    rows = read(spark, sf_dir, "pages")
    k = F.col("page_id")
    name = F.concat(F.lit("f"), k.cast("string"), F.element_at(F.array(*[F.lit(s) for s in (".pdf", ".PDF", "", ".doc", ".html", ".mobi", ".fb2", ".epub")]), (k % 8 + 1).cast("int")))
    magic = F.element_at(F.array(F.lit("%PDF-1.7 "), F.lit("<?xml version='1.0'?><FictionBook>"), F.lit(""), F.lit("x" * 60 + "BOOKMOBI")), (k % 4 + 1).cast("int"))
    files = rows.select("page_id", name.alias("name"), F.concat(magic, "html").cast("binary").alias("content"))
    files = files.withColumn("size", F.length("content").cast("long"))
    return formats.gated(formats.sniffed(files), "name", formats.NATIVE).select("page_id", "found", "claim", "refusal", "status")


@_query
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.html_blocks(read(spark, sf_dir, "pages"))


@_query
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.html_links(read(spark, sf_dir, "pages"))


@_query
def ocr_words_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as OCR words: an order is a page, confidence from the discount, below 0 for some."""
    items = read(spark, sf_dir, "lineitem")
    words = items.select(F.lit("d").alias("doc_id"), F.col("l_orderkey").alias("page_num"), F.lit(1).alias("block_num"), F.lit(1).alias("par_num"), (F.col("l_linenumber") % 2).alias("line_num"), F.col("l_linenumber").alias("word_pos"), F.when(F.col("l_linenumber") == 3, " ").otherwise(F.concat("l_returnflag", "l_linestatus", F.col("l_partkey").cast("string"))).alias("text"), F.when(F.col("l_quantity") < 10, -1.0).otherwise(F.col("l_quantity") * 2).alias("conf"))
    return ocr.ocr_pages(words).select("page_num", "text", F.round("mean_confidence", 6).alias("mean_confidence"), "fallback")


# ---- metrics


@_query
def latency_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.latencies(read(spark, sf_dir, "events"), "event_type", "value")


@_query
def multiset_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a language's words, counted, the benchmark's words make up."""
    token = lambda df, *by: df.select(*by, F.explode(F.split("text", " ")).alias("token")).where("token <> ''")
    items = read(spark, sf_dir, "benchmark").select(F.lit("en").alias("lang"), "text")
    return evaluation.multiset_recall(token(read(spark, sf_dir, "documents"), "lang"), token(items, "lang"), ["lang"])


@_query
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").withColumn("part", F.col("doc_id") % 5)
    return evaluation.precision_recall(labels.where("quality = 1"), labels.where("toxic = 0"), ["part"], "doc_id")


@_query
def caption_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers as captions, ship months as pages; returned lines are the figures."""
    items = read(spark, sf_dir, "lineitem").withColumn("doc_id", F.col("l_orderkey") % 500)
    found = items.select("doc_id", F.col("l_linenumber").alias("number"), F.month("l_shipdate").alias("page_num")).distinct()
    figs = items.where("l_returnflag = 'R'").select("doc_id", F.month("l_shipdate").alias("page"), (F.col("l_quantity") < 25).alias("skipped"))
    return evaluation.caption_coverage(found, figs).withColumn("pct", F.round("pct", 6))


@_query
def missed_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").withColumn("doc_id", F.col("l_orderkey") % 500)
    found = items.select("doc_id", F.col("l_linenumber").alias("number"), F.month("l_shipdate").alias("page_num")).distinct()
    figs = items.where("l_returnflag = 'R'").select("doc_id", F.month("l_shipdate").alias("page"), (F.col("l_quantity") < 48).alias("skipped"))
    return evaluation.missed_captions(found, figs).select("doc_id", "number", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


@_query
def totals_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("mode"), (F.col("o_orderkey") % 3).alias("covered"), F.lit(3).cast("long").alias("total"))
    return evaluation.totals_by_mode(rows).withColumn("pct", F.round("pct", 6))


@_query
def detection_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select((F.col("o_orderkey") % 7).alias("found"), (F.col("o_custkey") % 5).alias("truth"))
    return evaluation.capped_recall(rows, "found", "truth")


@_query
def distinct_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").where("text is not null").select(F.col("source").alias("doc_id"), F.col("text").cast("binary").alias("content"))
    return evaluation.distinct_images(rows)


@_query
def merged_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("name"), "o_orderstatus")
    return evaluation.merged_results(orders.where("name % 3 <> 0"), orders.where("name % 2 = 0").withColumn("o_orderstatus", F.lit("new")))


@_query
def job_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls: a user's run, seconds from the value."""
    e = read(spark, sf_dir, "events")
    begun = F.unix_timestamp("ts").cast("double")
    jobs = e.select("user_id", F.col("event_id").alias("job_id"), (F.col("event_id") % 60).cast("double").alias("seconds"), begun.alias("started"), (begun + F.col("event_id") % 60).alias("ended"))
    rows = usage.job_summary(jobs, "user_id")
    return rows.select("user_id", "n", F.round("avg_seconds", 6).alias("avg_seconds"), "api_seconds", "elapsed", "took")


@_query
def recent_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return usage.recent(e.select("user_id", F.col("event_id").alias("job_id"), F.col("ts").alias("ended")), "user_id").select("user_id", "job_id", "rank")


@_query
def whitespace_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents")
    return rows.select("doc_id", F.greatest(X.word_count(F.col("text")), F.lit(0)).cast("long").alias("words"), X.first_words(F.col("text"), 3).alias("head"))


@_query
def language_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages asked for the documents that the labels call good, which stand for those with figures."""
    figs = read(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("doc_id"))
    return describe.languages(leading_sample(spark, sf_dir), figs, describe.fake_model)


@_query
def annotation_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = figure_manifest(spark, sf_dir).withColumn("doc_id", F.lit("d")).withColumn("bbox", F.when(F.col("box") != "", F.split("box", ","))).withColumn("ord", F.col("id"))
    return figures.annotations(listed).select("page_num", "kind", "text")


@_query
def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as documents of two pages with a figure each; small figures lose their references."""
    k = F.col("s_suppkey").cast("string")
    ids = read(spark, sf_dir, "supplier")
    docs = ids.select(k.alias("doc_id"), F.concat(F.lit("<!-- page 1 -->\n\nText\n\n![Image, page 1](images/f"), k, F.lit(")\n\n> cap\n\n<!-- page 2 -->\n\n![Diagram, page 2](diagrams/g"), k, F.lit(")\n")).alias("markdown"))
    entry = lambda name, page, size: ids.select(k.alias("doc_id"), F.concat(F.lit(name), k).alias("id"), F.lit(page).alias("page"), F.array(F.lit(0.5), F.col("s_nationkey") + 0.5, F.lit(9.0), F.lit(9.4)).alias("bbox"), size.cast("int").alias("width_px"), F.lit(80).alias("height_px"), F.lit(page).alias("ord"))
    figs = entry("f", 1, F.col("s_suppkey") % 90).unionByName(entry("g", 2, F.col("s_nationkey") * 9))
    sizes = ids.select(k.alias("doc_id"), F.lit(0).alias("index"), F.lit(595.5).alias("width"), F.lit(842.5).alias("height"))
    rows = pages.ocr_records(docs, figs, sizes, least=50)
    first = F.get("images", F.lit(0))
    return rows.select("doc_id", "index", "markdown", F.size("images").alias("n_images"), first["top_left_y"].alias("top"), F.col("dimensions.height").alias("height"))


# ---- keys and payloads


@_query
def document_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of documents under two settings that differ in the prompt."""
    docs = read(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("digest"))
    kinds = [Settings("m", "u", prompt) for prompt in ("Describe.", "Say more.")]
    return docs.select("id", *[convert.document_key(F.col("digest"), k).alias(f"key{i}") for i, k in enumerate(kinds)])


@_query
def payload_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as records of conversions, to JSON and back."""
    k = F.col("s_suppkey")
    none = F.lit(None).cast("decimal(18,8)")
    rows = read(spark, sf_dir, "supplier").select(
        k.cast("string").alias("doc_id"), F.concat("s_name", F.lit("\n\"é\"\n")).alias("markdown"), (k % 9).cast("int").alias("page_count"), (k % 5).alias("figure_count"), (k % 2).alias("skipped_count"), F.lit("English").alias("language"),
        *[(k * i).alias(c) for i, c in enumerate(("prompt_tokens", "completion_tokens", "total_tokens", "api_calls", "calls_missing_usage"))],
        F.when(k % 3 == 0, none).otherwise((k / 100).cast("decimal(18,8)")).alias("estimated_cost"), F.lit("EUR").alias("currency"),
    )
    back = convert.from_payload(convert.to_payload(rows, Settings("m", "u", "p")))
    return back.withColumn("estimated_cost", F.col("estimated_cost").cast("double"))


@_query
def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.col("n_name").alias("markdown"), F.col("n_regionkey").alias("page_count"), (F.col("n_nationkey") % 4).alias("figure_count"))
    both = output.response(rows, "both")
    return both.select("doc_id", "payload", F.col("headers")["X-Page-Count"].alias("pages"), F.col("headers")["X-Figure-Count"].alias("figures"))


@_query
def usage_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    rows = read(spark, sf_dir, "nation").select("n_nationkey", (k * 2).alias("api_calls"), (k * 1000).alias("total_tokens"), (k * 600).alias("prompt_tokens"), (k * 400).alias("completion_tokens"), F.when(k % 2 == 0, (k / 8).cast("decimal(18,8)")).alias("estimated_cost"), (k % 3).alias("calls_missing_usage"))
    return rows.select("n_nationkey", usage.usage_line("EUR").alias("line"))


# ---- links, tables as hiding places, blocks of figures


@_query
def linkified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two words of each page's first line as a link that lies on it."""
    blocks = _blocks(spark, sf_dir).where("seq < 2")
    first = blocks.where("seq = 0").where(X.word_count(F.col("text")) >= 2)
    links = first.select("doc_id", "page_num", F.lit(0).alias("link_seq"), "x0", "y0", "x1", "y1", X.first_words(F.col("text"), 2).alias("anchor"), F.concat(F.lit("u"), F.col("page_num").cast("string")).alias("uri"))
    return structure.linkify(blocks, links).where("seq = 0").select("doc_id", "page_num", "text")


def _grid_drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as drawings on the four pages of the table candidates; every fifth is sloped."""
    rows = adapters.boxes(read(spark, sf_dir, "part"), "p_partkey", doc="p_size", page="p_size").withColumn("doc_id", F.lit("d"))
    return rows.withColumn("page_num", (F.col("page_num") % 4).cast("int")).withColumn("sloped", F.col("drawing_id") % 5 == 0)


@_query
def table_suppressors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.suppressors(_candidates(spark, sf_dir), _grid_drawings(spark, sf_dir)).select("page_num", "table_id")


@_query
def regions_off_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.off_tables(_regions(spark, sf_dir), _candidates(spark, sf_dir)).select("page_num", "region_index")


@_query
def region_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as blocks behind the texts of their pages."""
    texts = _grid_drawings(spark, sf_dir).select("doc_id", "page_num", F.col("drawing_id").cast("int").alias("seq"), F.lit("text").alias("kind"), "x0", "y0", "x1", "y1")
    return regions.as_blocks(_regions(spark, sf_dir).drop("height"), texts).where("kind = 'diagram'").select("page_num", "seq", "region_index")


@_query
def described_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagram blocks with descriptions, of which the last by seq counts, as parts of Markdown."""
    k = F.col("n_nationkey")
    base = read(spark, sf_dir, "nation").select(F.lit("d").alias("doc_id"), (k % 4 + 1).cast("int").alias("page_num"), k.cast("int").alias("region_index"), F.col("n_name").alias("name"))
    blocks = base.select("doc_id", "page_num", F.col("region_index").alias("seq"), F.col("region_index").alias("pos"), F.lit("diagram").alias("kind"), F.lit(None).cast("string").alias("text"), F.lit(0.0).alias("font_size"), F.lit(False).alias("bold"), F.lit(None).cast("int").alias("xref"), "region_index", F.lit(None).cast("array<array<string>>").alias("cells"), *[F.lit(0.0).alias(c) for c in ("x0", "y0", "x1", "y1")])
    told = lambda seq, text: base.select("doc_id", "page_num", F.lit("diagram").alias("kind"), F.col("region_index").alias("ref"), text.alias("text"), F.lit(seq).alias("seq"))
    said = told(2, F.when(F.col("region_index") % 5 == 0, "[skip]").otherwise(F.concat("name", F.lit("\n\nand more")))).unionByName(told(1, F.lit("old")))
    return output.block_parts(blocks, None, said).select("page_num", "region_index", "part")


@_query
def image_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as images of scanned pages, a third of them without a place."""
    k = F.col("p_partkey")
    placed = lambda c: F.when(k % 3 != 0, c.cast("double"))
    rows = read(spark, sf_dir, "part").select(F.lit("d").alias("doc_id"), F.col("p_size").cast("int").alias("page_num"), k.cast("int").alias("idx"), placed(k * 37 % 50).alias("x0"), placed(k * 91 % 70).alias("y0"))
    return layout.ocr_image_order(rows).select("page_num", "idx", "pos")


@_query
def box_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _regions(spark, sf_dir).alias("a").join(_candidates(spark, sf_dir).alias("b"), (F.col("a.page_num") == F.col("b.page_num")) & G.meets(G.box("a"), G.box("b")))
    return rows.select("a.region_index", "b.table_id", *[c.alias(n) for c, n in zip(G.clipped(G.union_of(G.box("a"), G.box("b")), F.lit(300.0), F.lit(400.0)), ("x0", "y0", "x1", "y1"))])


# ---- cache and descriptions beside the replay


@_query
def lookup_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day after half of the log: which keys, and one that was never put, are still there?"""
    entries = _entries(spark, sf_dir)
    now = entries.agg(F.percentile("last_accessed", 0.5).alias("now"))
    asked = entries.select("key").unionByName(entries.select(F.concat("key", F.lit("?")).alias("key")).limit(0))
    asked = asked.unionByName(read(spark, sf_dir, "nation").select(F.concat(F.lit("none"), "n_nationkey").alias("key")))
    rows = asked.join(F.broadcast(now)).withColumn("now", F.col("now") + 86_400)
    return cache.lookups(rows, entries, 86_400.0).select("key", "outcome")


@_query
def cache_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.sizes(_entries(spark, sf_dir))


@_query
def purged_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = read(spark, sf_dir, "nation").select(F.concat(F.lit("d"), "n_nationkey").alias("doc_digest"))
    return cache.purged(_entries(spark, sf_dir), asked)


@_query
def opened_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store some of whose rows cannot be: without a key, too small, or older than themselves."""
    k = F.col("size")
    rows = _entries(spark, sf_dir).withColumn("key", F.when(k % 7 != 0, F.col("key"))).withColumn("last_accessed", F.when(k % 5 == 0, 0.0).otherwise(F.col("last_accessed"))).withColumn("size", F.when(k % 11 == 0, -k).otherwise(k))
    good, bad = cache.opened(rows, 3, 3)
    return good.select("size", F.lit(True).alias("used")).unionByName(bad.select("size", F.lit(False).alias("used")))


@_query
def scoped_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))
    return rows.select("doc_id", *[describe.scoped_key(F.substring("digest", 1, 8), F.col("doc_id").cast("string"), share).alias(n) for n, share in (("shared", True), ("own", False))])


@_query
def stored_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions of customers' orders over those that are known: whole ones replace truncated ones."""
    orders = read(spark, sf_dir, "orders")
    rows = orders.select((F.col("o_custkey") % 500).cast("string").alias("key"), F.when(F.col("o_orderkey") % 13 == 0, " ").otherwise(F.col("o_orderkey").cast("string")).alias("text"), (F.col("o_orderstatus") != "F").alias("truncated"), "o_orderkey")
    return describe.stored(rows.where("o_orderkey % 2 = 0"), rows.where("o_orderkey % 2 = 1 and trim(text) <> ''").groupBy("key").agg(F.min("text").alias("text"), F.lit(True).alias("truncated")))


@_query
def flight_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests get what their leader got: a result, an error, or nothing in time."""
    led = single_flight(spark, sf_dir)
    ends = led.where("leads and leader % 5 <> 0").select("leader", F.concat(F.lit("r"), "leader").alias("result"), F.when(F.col("leader") % 3 == 0, "broken").alias("error"))
    return cache.shared_outcomes(led, ends).select("request_id", "result", "error", "status")


@_query
def admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as conversions of some hours each, two at a time with three waiting, for each of ten users."""
    e = read(spark, sf_dir, "events")
    rows = e.select((F.col("user_id") % 10).cast("string").alias("store"), F.unix_timestamp("ts").cast("double").alias("ts"), (F.col("event_id") % 50 * 3600.0).alias("seconds"), F.col("event_id").alias("request_id"))
    return cache.admitted(rows, 2, 3).select("request_id", "start", "status")


@_query
def document_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    figs = read(spark, sf_dir, "labels").where("toxic = 0").select(F.col("doc_id").cast("string").alias("doc_id"))
    return describe.summaries(leading_sample(spark, sf_dir), figs, describe.fake_model)


# ---- files


@_query
def zip_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What archives with some members are."""
    k = F.col("s_suppkey")
    members = (["!epub", "mimetype"], ["word/document.xml", "a.png"], ["xl/workbook.xml"], ["ppt/slides/slide1.xml"], ["Documents/1/FixedDoc.fdoc", "x.fdseq"], ["01.JPG", "more/", "more/02.webp"], ["01.jpg", "notes.txt"], ["empty/"])
    names = F.element_at(F.array(*[F.array(*map(F.lit, m)) for m in members]), (k % len(members) + 1).cast("int"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", formats.zip_kind(names).alias("kind"))


@_query
def size_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files from small to too large, under names that are right, wrong and missing."""
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.element_at(F.array(*map(F.lit, ("a.pdf", "a.epub", "a", "a.xyz"))), (F.col("c_custkey") % 4 + 1).cast("int")).alias("name"), F.when(F.col("c_custkey") % 3 == 0, "pdf").alias("found"), (F.col("c_custkey") * 100_000).alias("size"))
    return formats.gated(rows, "name", formats.NATIVE).select("c_custkey", "refusal", "status")


@_query
def spreadsheet_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.exploded_sheets(read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id")), 50)


@_query
def data_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To a data URI and back, some of them broken on the way."""
    rows = read(spark, sf_dir, "nation").select("n_nationkey", X.data_uri(F.lit("image/png"), F.col("n_name").cast("binary")).alias("uri"))
    rows = rows.withColumn("uri", F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit("https://host/"), "uri")).otherwise(F.col("uri")))
    return rows.select("n_nationkey", "uri", formats.data_uri_bytes(F.col("uri")).cast("string").alias("bytes"))


@_query
def collected_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures with the files that are there."""
    k = F.col("p_partkey")
    part = read(spark, sf_dir, "part")
    figs = part.select(F.lit("d").alias("doc_id"), k.alias("id"), F.concat(F.lit("images/"), k.cast("string")).alias("path"), (k % 4 == 0).alias("skipped"))
    files = part.where("p_partkey % 3 <> 0").select(F.lit("d").alias("doc_id"), F.concat(F.lit("images/"), k.cast("string")).alias("path"), F.col("p_name").cast("binary").alias("content"), F.col("p_size").alias("width_px"), F.lit(None).cast("int").alias("height_px"))
    return figures.collected_images(figs, files).select("id", F.md5("content").alias("content"), "width_px", "height_px")


# ---- words and cells


@_query
def clean_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "nation").select("n_nationkey", F.array(F.array(F.concat(F.lit(" "), "n_name", F.lit("\u00a0\n x ")), F.lit(None).cast("string")), F.array(F.lit("\t"))).alias("cells"))
    return rows.select("n_nationkey", F.to_json(X.clean_grid(F.col("cells"))).alias("cells"))


@_query
def language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, (" Swedish.", "GERMAN", "french\n", "Klingon", "..", "Portuguese")))
    name = F.element_at(names, (F.col("n_nationkey") % 6 + 1).cast("int"))
    return read(spark, sf_dir, "nation").select("n_nationkey", X.language_name(name).alias("name"), X.language_code(X.language_name(name)).alias("code"))


@_query
def numeric_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in lines of orders, with dashes of any sort for a minus."""
    text = F.concat(F.lit("total "), F.format_string("%,.2f", "o_totalprice"), F.lit(" change −"), F.col("o_custkey").cast("string"), F.lit(" on "), F.date_format("o_orderdate", "yyyy-MM-dd"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(X.numeric_tokens(text), " ").alias("numbers"), X.is_numeric_cell(F.format_string("(%,.2f)", "o_totalprice")).alias("cell"))


@_query
def row_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two readings of the orders that are only in one, counted."""
    orders = read(spark, sf_dir, "orders")
    left = orders.where("o_orderkey % 3 <> 0").select("o_custkey", "o_orderstatus")
    right = orders.where("o_orderkey % 2 = 0").select("o_custkey", "o_orderstatus")
    return evaluation.symmetric_difference(left, right).groupBy("o_custkey", "o_orderstatus", "side").agg(F.count("*").alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_pages, n_blocks, markdown): documents laid out, read in order, structured and rendered."""
    blocks = adapters.doc_blocks(read(spark, sf_dir, "documents"))
    sheets = adapters.doc_pages(blocks)
    ordered = layout.reading_order(blocks, sheets)
    counts = ordered.groupBy("doc_id").agg(F.count_distinct("page_num").alias("n_pages"), F.count("*").alias("n_blocks"))
    return counts.join(output.to_markdown(boilerplate.strip_boilerplate(ordered, sheets), sheets), "doc_id")
