"""Running headers, footers and page numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions import text as X

#: Part of the page's height at either end, pages a document needs, and share of its pages a line must be on.
MARGIN, PAGES, REPEATED, LEAST_REPEATS = 0.12, 4, 0.5, 3


def in_margin(y0: Column, y1: Column, height: Column, margin: float = MARGIN) -> Column:
    # The products must round as stated: (1 - margin) is formed first.
    return (height > 0) & ((y0 < F.lit(margin) * height) | (y1 > F.lit(1 - margin) * height))


def running_lines(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_num, seq) of the margin texts to drop: those on enough pages of a document, white space
    and case apart, and those that look like page numbers.  Scanned pages do not count."""
    text_pages = pages.where(~F.coalesce("is_ocr", F.lit(False))).select("doc_id", "page_num", "height")
    needed = text_pages.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") >= PAGES)
    needed = needed.select("doc_id", F.greatest(F.lit(LEAST_REPEATS), F.bround(F.lit(REPEATED) * F.col("n"))).alias("needed"))
    margin = blocks.where("kind = 'text'").join(text_pages.join(needed, "doc_id"), ["doc_id", "page_num"]).where(in_margin(F.col("y0"), F.col("y1"), F.col("height")))
    margin = margin.select("doc_id", "page_num", "seq", "needed", X.squeeze(F.lower("text")).alias("line"), X.is_page_number(F.col("text")).alias("numbered"))
    often = margin.groupBy("doc_id", "line").agg(F.count_distinct("page_num").alias("on_pages"))
    rows = margin.join(often, ["doc_id", "line"])
    return rows.where((F.col("on_pages") >= F.col("needed")) | F.col("numbered")).select("doc_id", "page_num", "seq")


def strip_boilerplate(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    return blocks.join(running_lines(blocks, pages), ["doc_id", "page_num", "seq"], "left_anti")
