"""Synthetic page geometry over plain text rows, so that the operators run on tables without PDFs.

Twelve lines make a page of 612 by 792 points.  All of it is invented; it exercises operators and
says nothing about documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINES, WIDTH, HEIGHT = 12, 612.0, 792.0


def doc_blocks(documents: DataFrame, two_columns: bool = False) -> DataFrame:
    """Text blocks, one for each non-blank line.  The first line of a document is large if it is short."""
    lines = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("at", "text")).where(F.trim("text") != "")
    line = F.col("at") % LINES
    x0 = F.lit(72.0) + (F.lit(250.0) * (line % 2) if two_columns else F.lit(0.0))
    y0 = F.lit(40.0) + 60.0 * line
    words = F.size(F.split(F.trim("text"), " +"))
    return lines.select(
        "doc_id",
        F.expr(f"at div {LINES} + 1").cast("int").alias("page_num"),
        line.cast("int").alias("seq"),
        F.lit("text").alias("kind"),
        x0.alias("x0"),
        y0.alias("y0"),
        F.least(F.lit(540.0), x0 + 5.0 * F.length("text")).alias("x1"),
        (y0 + 12.0).alias("y1"),
        "text",
        F.when((F.col("at") == 0) & (words <= 18), 14.0).otherwise(10.0).alias("font_size"),
        F.lit(False).alias("bold"),
        F.lit(None).cast("int").alias("xref"),
        F.lit(None).cast("int").alias("region_index"),
        F.lit(None).cast("array<array<string>>").alias("cells"),
    )


def doc_pages(blocks: DataFrame) -> DataFrame:
    return blocks.select("doc_id", "page_num").distinct().select("doc_id", "page_num", F.lit(False).alias("is_ocr"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), F.lit(None).cast("string").alias("ocr_text"))


def with_running_lines(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """blocks with, on every page, a header that names the source and a footer with the page's number."""
    names = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "source")
    pages = blocks.select("doc_id", "page_num").distinct().join(names, "doc_id")
    lines = F.explode(F.array(*[F.struct(F.lit(seq).alias("seq"), F.lit(y).alias("y0"), text.alias("text")) for seq, y, text in ((100, 20.0, F.concat(F.lit("Source "), "source")), (101, 772.0, F.col("page_num").cast("string")))]))
    more = pages.select("doc_id", "page_num", lines.alias("l")).select("doc_id", "page_num", "l.seq", F.lit("text").alias("kind"), F.lit(72.0).alias("x0"), "l.y0", F.lit(300.0).alias("x1"), (F.col("l.y0") + 12).alias("y1"), "l.text", F.lit(9.0).alias("font_size"), F.lit(False).alias("bold"))
    return blocks.unionByName(more, allowMissingColumns=True)


def dirty_texts(documents: DataFrame) -> DataFrame:
    """Every seventh document ends in a replacement, a private use and a control character."""
    return documents.select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("\ufffd\ue001\x01"))).otherwise(F.col("text")).alias("text"))


def boxes(rows: DataFrame, key: str, *, doc: str, page: str) -> DataFrame:
    """Boxes from a table of numbers: key spreads the left edge, page and doc group them."""
    k = F.col(key)
    x0, y0 = (k * 37 % 500).cast("double"), (k * 91 % 700).cast("double")
    return rows.select(F.col(doc).cast("string").alias("doc_id"), F.col(page).cast("int").alias("page_num"), k.cast("long").alias("drawing_id"), x0.alias("x0"), y0.alias("y0"), (x0 + k % 29 + 1).alias("x1"), (y0 + k % 23 + 1).alias("y1"))
