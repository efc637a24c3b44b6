"""The whole conversion: blocks, drawings, images and tables of many documents to Markdown and figures."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions import text as X
from quirefold.lineage import cut
from quirefold.operators import boilerplate, context, describe, figures, layout, output, regions, structure, tables, usage
from quirefold.sources.config import Settings


@dataclass
class Document:
    """The scanned tables (schemas.py) of a set of documents."""

    pages: DataFrame
    blocks: DataFrame
    drawings: DataFrame
    candidates: DataFrame
    resources: DataFrame
    draws: DataFrame
    files: DataFrame
    links: DataFrame | None = None


@dataclass
class Conversion:
    markdown: DataFrame
    figures: DataFrame
    counts: DataFrame
    results: DataFrame


def page_blocks(doc: Document) -> tuple[DataFrame, DataFrame]:
    """(blocks in reading order with the links of their texts, regions).  Label texts go before the table texts, and the order is settled again
    over all blocks at the end; regions also judge the table candidates."""
    texts = doc.blocks.where("kind = 'text'")
    found = regions.find_regions(doc.drawings, doc.pages, texts, doc.candidates)
    rows = regions.without_labels(doc.blocks, found)
    rows = regions.as_blocks(found, rows)
    kept = tables.keep_tables(doc.candidates, found)
    rows = tables.without_table_text(rows, kept)
    last = rows.groupBy("doc_id", "page_num").agg(F.max("seq").alias("_last"))
    more = kept.join(last, ["doc_id", "page_num"], "left").select("doc_id", "page_num", (F.coalesce("_last", F.lit(-1)) + F.col("pos")).cast("int").alias("seq"), F.lit("table").alias("kind"), "x0", "y0", "x1", "y1", "cells")
    rows = rows.unionByName(more, allowMissingColumns=True)
    if doc.links is not None:
        rows = structure.linkify(rows, doc.links)
    return layout.reading_order(rows, doc.pages), found


def figure_jobs(images: DataFrame, found: DataFrame, blocks: DataFrame, settings: Settings, summaries: DataFrame) -> DataFrame:
    """One job per figure with its key and prompt.  Context is taken before running lines are stripped."""
    image = images.where("x0 is not null").select("doc_id", "page_num", F.lit("image").alias("kind"), "idx", F.col("xref").alias("ref"), "digest", "y0", "y1")
    drawn = found.select("doc_id", "page_num", F.lit("diagram").alias("kind"), F.col("region_index").alias("idx"), F.col("region_index").alias("ref"), F.substring(F.sha2(F.concat_ws(",", "doc_id", "page_num", "x0", "y0", "x1", "y1"), 256), 1, 32).alias("digest"), "y0", "y1")
    jobs = image.unionByName(drawn).withColumn("fig", F.concat_ws("-", "kind", "idx"))
    around = context.figure_context(jobs, blocks, settings.words_before, settings.words_after)
    jobs = jobs.join(around, ["doc_id", "page_num", "fig"], "left").join(summaries, "doc_id", "left")
    prompt = describe.compose_prompt(F.lit(settings.prompt), F.col("summary"), F.col("before"), F.col("after"), settings.significance, F.lit(settings.language))
    jobs = jobs.withColumn("prompt", prompt)
    key = describe.cache_key(F.col("digest"), F.col("prompt"), F.col("kind"), *[F.lit(s) for s in settings.shaping()])
    return jobs.withColumn("key", describe.scoped_key(key, F.col("doc_id"), settings.share_descriptions))


def convert(doc: Document, settings: Settings, model: Callable[[str, str, str], dict], cache: DataFrame, summaries: DataFrame | None = None) -> Conversion:
    """Markdown, figure list, counts and call results of all documents.  Sinks are the caller's."""
    blocks, found = page_blocks(doc)
    blocks, found = cut(blocks), cut(found)
    images = figures.kept_images(figures.judged_images(doc.resources, doc.draws, doc.pages))
    if summaries is None:
        summaries = doc.pages.select("doc_id").distinct().withColumn("summary", F.lit(""))
    jobs = figure_jobs(images, found, blocks, settings, summaries).drop("before", "after", "summary", "y0", "y1")
    results = cut(describe.describe(jobs, cache, model).withColumn("text", describe.parsed_answer(F.col("text"))))
    descriptions = results.select("doc_id", "kind", "page_num", "ref", "text", "truncated")
    listed = figures.manifest(images, found, descriptions)
    final = boilerplate.strip_boilerplate(blocks, doc.pages)
    return Conversion(output.to_markdown(final, doc.pages, images, descriptions), listed, figures.figure_counts(results.withColumnRenamed("text", "description")), results)


def records(doc: Document, done: Conversion, calls: DataFrame, languages: DataFrame, settings: Settings) -> DataFrame:
    """One row per document: markdown, counts, language, usage and cost; what a service would answer or store."""
    counts = doc.pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("page_count"))
    prices = [F.lit(p).cast("double") for p in (settings.input_token_price, settings.output_token_price)]
    spent = usage.cost(usage.usage(calls), *prices)
    rows = done.markdown.join(counts, "doc_id").join(done.counts, "doc_id", "left").join(languages, "doc_id", "left").join(spent, "doc_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("figure_count", "skipped_count", "prompt_tokens", "completion_tokens", "total_tokens", "api_calls", "calls_missing_usage")}
    return rows.withColumns({**zero, "language": F.coalesce("language", F.lit("")), "currency": F.lit(settings.currency)})


PAYLOAD = "markdown string, page_count int, figure_count bigint, skipped_count bigint, language string, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint, api_calls bigint, calls_missing_usage bigint, estimated_cost decimal(18,8), currency string"
_FIELDS = [c.split(" ")[0] for c in PAYLOAD.split(", ")]


def document_key(doc_id: Column, settings: Settings, version: str = "1") -> Column:
    """The key of a converted document: its content, the payload's version, and all settings that shape the result."""
    shaped = X.fingerprint(*[F.lit(s) for s in settings.shaping()], length=16)
    return F.concat_ws("-", F.lit(f"doc{version}"), doc_id, shaped)


def to_payload(rows: DataFrame, settings: Settings, version: str = "1") -> DataFrame:
    """(doc_id, key, payload): records as JSON under document_key()."""
    return rows.select("doc_id", document_key(F.col("doc_id"), settings, version).alias("key"), F.to_json(F.struct(*_FIELDS)).alias("payload"))


def from_payload(stored: DataFrame) -> DataFrame:
    """Records of stored payloads; a malformed one gives nulls."""
    return stored.select("doc_id", F.from_json("payload", PAYLOAD, {"mode": "PERMISSIVE"}).alias("r")).select("doc_id", "r.*")
