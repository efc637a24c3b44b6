"""Which table candidates are data tables, and the text they replace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions import geometry as G
from quirefold.functions import text as X

PAGE = ("doc_id", "page_num")
TABLE = (*PAGE, "table_id")
ROWS, COLUMNS = 3, 2
#: A column with so many filled cells is numeric or a label from, or up to, a share of numbers.
FILLED, NUMERIC, LABEL = 2, 0.6, 0.4
NUMERIC_COLUMNS, LABEL_COLUMNS = 2, 1
#: Overlaps with a figure, and with a table, from which a candidate, or a text, goes.
OVER_FIGURE, IN_TABLE = 0.5, 0.5
#: Share of filled cells below which the probe calls a candidate empty.
PROBE_FILLED = 0.6


def cells_of(candidates: DataFrame) -> DataFrame:
    """One row per cell: the table's key, r, c and value."""
    rows = candidates.select(*TABLE, F.posexplode("cells").alias("r", "row"))
    return rows.select(*TABLE, "r", F.posexplode("row").alias("c", "value"))


def column_roles(candidates: DataFrame) -> DataFrame:
    """(table, numeric, label): counts of either kind of column."""
    value = F.coalesce("value", F.lit(""))
    filled = X.strip(X.unified_dashes(value)) != ""
    columns = cells_of(candidates).groupBy(*TABLE, "c").agg(F.count_if(filled).alias("filled"), F.count_if(filled & X.is_numeric_cell(value)).alias("numbers"))
    share = F.try_divide("numbers", "filled")
    usable = F.col("filled") >= FILLED
    return columns.groupBy(*TABLE).agg(F.count_if(usable & (share >= NUMERIC)).alias("numeric"), F.count_if(usable & (share <= LABEL)).alias("label"))


def filled_share(cells: Column) -> Column:
    flat = F.flatten(cells)
    real = F.filter(flat, lambda c: X.strip(F.coalesce(c, F.lit(""))) != "")
    return F.when(F.size(flat) > 0, F.size(real) / F.size(flat)).otherwise(0.0)


def over_regions(candidates: DataFrame, regions: DataFrame, share: float = OVER_FIGURE) -> DataFrame:
    """Keys of candidates of which more than `share` lies in one region."""
    hit = [F.col(f"t.{k}") == F.col(f"g.{k}") for k in PAGE] + [G.share_inside(G.box("t"), G.box("g")) > share]
    return candidates.alias("t").join(regions.alias("g"), hit, "left_semi").select(*TABLE)


def gates(candidates: DataFrame, regions: DataFrame) -> DataFrame:
    """candidates with n_rows, n_cols, numeric, label, over_figure and keep."""
    rows = candidates.join(column_roles(candidates), list(TABLE), "left")
    rows = rows.join(over_regions(candidates, regions).withColumn("over_figure", F.lit(True)), list(TABLE), "left")
    rows = rows.withColumns({"n_rows": F.size("cells"), "n_cols": X.grid_width(F.col("cells")), **{c: F.coalesce(c, F.lit(0)) for c in ("numeric", "label")}, "over_figure": F.coalesce("over_figure", F.lit(False))})
    return rows.withColumn("keep", (F.col("n_rows") >= ROWS) & (F.col("n_cols") >= COLUMNS) & ~F.col("over_figure") & (F.col("numeric") >= NUMERIC_COLUMNS) & (F.col("label") >= LABEL_COLUMNS))


def keep_tables(candidates: DataFrame, regions: DataFrame) -> DataFrame:
    """The data tables, their cells cleaned, numbered in reading order."""
    from quirefold.operators.layout import reading_order_of_tables

    kept = gates(candidates, regions).where("keep").select(*candidates.columns).withColumn("cells", X.clean_grid(F.col("cells")))
    return reading_order_of_tables(kept)


def without_table_text(blocks: DataFrame, tables: DataFrame, share: float = IN_TABLE) -> DataFrame:
    """blocks less the texts of which at least `share` lies in one kept table."""
    hit = [F.col(f"b.{k}") == F.col(f"t.{k}") for k in PAGE] + [F.col("b.kind") == "text", G.area(G.box("b")) > 0, G.share_inside(G.box("b"), G.box("t")) >= share]
    return blocks.alias("b").join(tables.alias("t"), hit, "left_anti")


def probe(candidates: DataFrame, regions: DataFrame) -> DataFrame:
    """candidates with the first fault that holds: tiny, empty, on_diagram, or good."""
    rows = candidates.join(over_regions(candidates, regions).withColumn("_over", F.lit(True)), list(TABLE), "left")
    tiny = (F.size("cells") < ROWS) | (X.grid_width(F.col("cells")) < COLUMNS)
    fault = F.when(tiny, "tiny").when(filled_share(F.col("cells")) < PROBE_FILLED, "empty").when(F.col("_over"), "on_diagram").otherwise("good")
    return rows.withColumn("fault", fault).drop("_over")
