"""Columns and reading order of a page's blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PAGE = ("doc_id", "page_num")
#: A gap between left edges of this part of the page's width starts a column of so many blocks at least.
COLUMN_GAP, COLUMN_BLOCKS = 0.06, 2


def column_boundaries(blocks: DataFrame, pages: DataFrame, gap: float = COLUMN_GAP, least: int = COLUMN_BLOCKS) -> DataFrame:
    """(doc_id, page_num, cut): the middle of each gap that splits a page into columns.  All kinds of blocks count."""
    edges = Window.partitionBy(*PAGE).orderBy("x0")
    rows = blocks.select(*PAGE, "x0").join(pages.select(*PAGE, "width"), list(PAGE))
    rows = rows.select("*", F.lag("x0").over(edges).alias("prev"), (F.row_number().over(edges) - 1).alias("before"), F.count("*").over(Window.partitionBy(*PAGE)).alias("n"))
    wide = (F.col("x0") - F.col("prev") >= F.lit(gap) * F.col("width")) & (F.col("width") > 0)
    return rows.where(wide & (F.col("n") >= 2 * least) & F.col("before").between(F.lit(least), F.col("n") - least)).select(*PAGE, ((F.col("prev") + F.col("x0")) / 2).alias("cut"))


def with_columns(blocks: DataFrame, pages: DataFrame, gap: float = COLUMN_GAP, least: int = COLUMN_BLOCKS) -> DataFrame:
    """blocks with col, the number of boundaries at or left of the block's left edge.

    One pass over the page's blocks in order of their left edges: a boundary lies right before the
    block that starts after it, so a running count of such blocks is the column's index.
    """
    edges = Window.partitionBy(*PAGE).orderBy("x0")
    rows = blocks.join(pages.select(*PAGE, F.col("width").alias("_width")), list(PAGE), "left")
    rows = rows.select("*", F.lag("x0").over(edges).alias("_prev"), (F.row_number().over(edges) - 1).alias("_before"), F.count(F.lit(1)).over(Window.partitionBy(*PAGE)).alias("_n"))
    starts = (F.col("_width") > 0) & (F.col("_n") >= 2 * least) & (F.col("x0") - F.col("_prev") >= F.lit(gap) * F.col("_width")) & F.col("_before").between(F.lit(least), F.col("_n") - least)
    upto = edges.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_starts", F.when(starts, 1).otherwise(0))
    return rows.withColumn("col", F.sum("_starts").over(upto).cast("int")).drop("_width", "_prev", "_before", "_n", "_starts")


def reading_order(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """blocks with pos, from 1 on per page: by column, line of ten points, left edge, and the order they came in."""
    line = F.bround(F.col("y0") / 10)
    order = Window.partitionBy(*PAGE).orderBy("col", line, "x0", "seq")
    return with_columns(blocks, pages).withColumn("pos", F.row_number().over(order).cast("int"))


def reading_order_of_tables(tables: DataFrame) -> DataFrame:
    """Tables or regions of a page, numbered by line and left edge."""
    order = Window.partitionBy(*PAGE).orderBy(F.bround(F.col("y0") / 10), "x0", "y0", "x1", "y1")
    return tables.withColumn("pos", F.row_number().over(order).cast("int"))


def ocr_image_order(images: DataFrame) -> DataFrame:
    """Images of a scanned page, those without a place first."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return images.withColumn("pos", F.row_number().over(Window.partitionBy(*PAGE).orderBy(zero("y0"), zero("x0"), "idx")).cast("int"))
