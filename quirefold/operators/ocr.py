"""When to read a page by OCR, and what its words give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.functions import geometry as G
from quirefold.functions import text as X

PAGE = ("doc_id", "page_num")
#: A page with fewer characters and an image over this part of it is scanned.
PAGE_CHARS, PAGE_COVERAGE = 50, 0.5
#: OCR with less text or less mean confidence is given to the fallback.
OCR_CHARS, OCR_CONFIDENCE = 40, 60.0


def image_coverage(pages: DataFrame, draws: DataFrame) -> DataFrame:
    """(doc_id, page_num, coverage): the part of the page under its largest image, 1 at most."""
    largest = draws.groupBy(*PAGE).agg(F.max(G.area(G.box())).alias("largest"))
    whole = F.col("width") * F.col("height")
    share = F.when(whole > 0, F.least(F.lit(1.0), F.coalesce("largest", F.lit(0.0)) / whole)).otherwise(0.0)
    return pages.join(largest, list(PAGE), "left").select(*PAGE, share.alias("coverage"))


def page_decisions(pages: DataFrame, texts: DataFrame, draws: DataFrame) -> DataFrame:
    """(doc_id, page_num, chars, coverage, needs_ocr, reason); texts has the extracted text of a page."""
    rows = image_coverage(pages, draws).join(texts, list(PAGE), "left")
    chars = F.length(X.strip(F.coalesce("text", F.lit(""))))
    rows = rows.select(*PAGE, chars.alias("chars"), "coverage")
    scanned = (F.col("chars") < PAGE_CHARS) & (F.col("coverage") >= PAGE_COVERAGE)
    count = F.format_string("%d chars", "chars")
    reason = (
        F.when(F.col("chars") >= PAGE_CHARS, F.concat(count, F.lit(": text layer")))
        .when(scanned, F.concat(count, F.format_string(", an image over %.0f%% of the page: scanned", F.col("coverage") * 100)))
        .otherwise(F.concat(count, F.lit(" and no large image: sparse")))
    )
    return rows.select("*", scanned.alias("needs_ocr"), reason.alias("reason"))


def scan_hints(texts: DataFrame, least: int = PAGE_CHARS) -> DataFrame:
    """(doc_id, pages, avg_chars, looks_scanned) from the pages' texts."""
    chars = F.length(X.strip(F.coalesce("text", F.lit(""))))
    rows = texts.groupBy("doc_id").agg(F.count("*").alias("pages"), F.avg(chars).alias("avg_chars"))
    return rows.withColumn("looks_scanned", F.col("avg_chars") < least)


def ocr_pages(words: DataFrame) -> DataFrame:
    """(doc_id, page_num, text, mean_confidence, fallback) from OCR words.

    Text has the non-blank words in their order, a line for each (block, paragraph, line); the
    mean is over those with a confidence of 0 or more.
    """
    real = words.where(X.strip(F.col("text")) != "")
    place = ("block_num", "par_num", "line_num")
    lines = real.groupBy(*PAGE, *place).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_pos", "text"))), lambda w: w["text"]), " ").alias("line"),
        F.sum(F.when(F.col("conf") >= 0, F.col("conf"))).alias("total"),
        F.count(F.when(F.col("conf") >= 0, 1)).alias("sure"),
    )
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*place, "line"))), lambda x: x["line"]), "\n")
    out = lines.groupBy(*PAGE).agg(text.alias("text"), (F.sum("total") / F.sum("sure")).alias("mean"))
    out = words.select(*PAGE).distinct().join(out, list(PAGE), "left")
    out = out.select(*PAGE, F.coalesce("text", F.lit("")).alias("text"), F.coalesce("mean", F.lit(0.0)).alias("mean_confidence"))
    return out.withColumn("fallback", (F.length(X.strip(F.col("text"))) < OCR_CHARS) | (F.col("mean_confidence") < OCR_CONFIDENCE))
