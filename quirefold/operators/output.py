"""Documents as Markdown and plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions import text as X
from quirefold.operators.figures import described, diagram_path
from quirefold.operators.structure import heading_levels, render_text

PAGE = ("doc_id", "page_num")


def figure(kind: str, path: Column, description: Column) -> Column:
    """A figure's link and its description as a quotation."""
    alt = F.concat(F.lit(f"{kind}, page "), F.col("page_num").cast("string"))
    return F.concat(F.lit("!["), alt, F.lit("]("), path, F.lit(")\n\n"), X.blockquote(description))


def joined(rows: DataFrame, by: list[str], order: list[str], part: str, separator: str, name: str) -> DataFrame:
    """Parts of each group that are neither null nor empty, in order.  A group is a document or a page."""
    listed = F.array_sort(F.collect_list(F.when(F.coalesce(F.col(part), F.lit("")) != "", F.struct(*order, F.col(part).alias("_part")))))
    return rows.groupBy(*by).agg(F.array_join(F.transform(listed, lambda x: x["_part"]), separator).alias(name))


def with_descriptions(blocks: DataFrame, descriptions: DataFrame | None) -> DataFrame:
    """blocks with shown, the description of an image or diagram block, empty for none or a skip."""
    if descriptions is None:
        return blocks.withColumn("shown", F.lit(""))
    own = described(blocks, descriptions, "image", "xref").withColumnRenamed("description", "_image")
    own = described(own, descriptions, "diagram", "region_index").withColumnRenamed("description", "_diagram")
    text = F.when(F.col("kind") == "image", F.col("_image")).when(F.col("kind") == "diagram", F.col("_diagram"))
    return own.withColumn("shown", X.shown(text)).drop("_image", "_diagram")


def block_parts(blocks: DataFrame, images: DataFrame | None = None, descriptions: DataFrame | None = None) -> DataFrame:
    """blocks (with pos) with part, the Markdown of each."""
    rows = with_descriptions(heading_levels(blocks), descriptions)
    if images is not None:
        rows = rows.join(images.groupBy(*PAGE, "xref").agg(F.max_by("path", "idx").alias("_path")), [*PAGE, "xref"], "left")
    else:
        rows = rows.withColumn("_path", F.lit(None).cast("string"))
    path = F.concat(F.lit("images/"), F.coalesce("_path", F.format_string("page-%03d-img-xref-%d.png", "page_num", "xref")))
    part = (
        F.when(F.col("kind") == "text", F.when(X.strip(F.col("text")) != "", render_text(F.col("level"), F.col("text"))))
        .when((F.col("kind") == "image") & (F.col("shown") != ""), figure("Image", path, F.col("shown")))
        .when((F.col("kind") == "diagram") & (F.col("shown") != ""), figure("Diagram", F.concat(F.lit("diagrams/"), diagram_path()), F.col("shown")))
        .when(F.col("kind") == "table", X.markdown_table(F.col("cells")))
    )
    return rows.withColumn("part", part).drop("_path")


def ocr_parts(pages: DataFrame, images: DataFrame | None = None, descriptions: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_num, pos, part) of scanned pages: their text, then their described images from the top."""
    scanned = pages.where("is_ocr")
    rows = scanned.select(*PAGE, F.lit(0).alias("pos"), X.strip(F.coalesce("ocr_text", F.lit(""))).alias("part"))
    if images is None or descriptions is None:
        return rows
    from quirefold.operators.layout import ocr_image_order

    shown = described(ocr_image_order(images), descriptions, "image", "xref").withColumn("shown", X.shown(F.col("description"))).where("shown <> ''")
    shown = shown.join(scanned.select(*PAGE), list(PAGE), "left_semi")
    return rows.unionByName(shown.select(*PAGE, "pos", figure("Image", F.concat(F.lit("images/"), "path"), F.col("shown")).alias("part")))


def to_markdown(blocks: DataFrame, pages: DataFrame, images: DataFrame | None = None, descriptions: DataFrame | None = None) -> DataFrame:
    """(doc_id, markdown): page marks, then the parts of each page in reading order, blank lines between, one newline at the end."""
    text_pages = pages.where(~F.coalesce("is_ocr", F.lit(False)))
    parts = block_parts(blocks.join(text_pages.select(*PAGE), list(PAGE), "left_semi"), images, descriptions).select(*PAGE, "pos", "part")
    parts = parts.unionByName(ocr_parts(pages, images, descriptions))
    marks = pages.select(*PAGE, F.lit(-1).alias("pos"), F.concat(F.lit("<!-- page "), F.col("page_num").cast("string"), F.lit(" -->")).alias("part"))
    whole = joined(marks.unionByName(parts), ["doc_id"], ["page_num", "pos"], "part", "\n\n", "markdown")
    return whole.withColumn("markdown", F.concat(X.strip(F.col("markdown")), F.lit("\n")))


def plain_texts(blocks: DataFrame, pages: DataFrame, images: DataFrame | None = None, descriptions: DataFrame | None = None) -> DataFrame:
    """(doc_id, raw_text, full_text): both have texts and tables under page headings, full_text also the descriptions."""
    rows = with_descriptions(blocks, descriptions)
    raw = F.when(F.col("kind") == "text", F.col("text")).when(F.col("kind") == "table", X.markdown_table(F.col("cells")))
    noted = F.when((F.col("kind") == "image") & (F.col("shown") != ""), F.concat(F.lit("[Image: "), "shown", F.lit("]"))).when((F.col("kind") == "diagram") & (F.col("shown") != ""), F.concat(F.lit("[Diagram: "), "shown", F.lit("]")))
    rows = rows.select(*PAGE, "pos", raw.alias("raw"), F.coalesce(raw, noted).alias("full"))
    scanned = pages.where("is_ocr").select(*PAGE, F.lit(0).alias("pos"), F.coalesce("ocr_text", F.lit("")).alias("raw"), F.coalesce("ocr_text", F.lit("")).alias("full"))
    rows = rows.join(pages.where(~F.coalesce("is_ocr", F.lit(False))).select(*PAGE), list(PAGE), "left_semi").unionByName(scanned)
    if images is not None and descriptions is not None:
        from quirefold.operators.layout import ocr_image_order

        shown = described(ocr_image_order(images), descriptions, "image", "xref").withColumn("shown", X.shown(F.col("description"))).where("shown <> ''")
        shown = shown.join(pages.where("is_ocr").select(*PAGE), list(PAGE), "left_semi")
        rows = rows.unionByName(shown.select(*PAGE, "pos", F.lit("").alias("raw"), F.concat(F.lit("[Image: "), "shown", F.lit("]")).alias("full")))
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.coalesce(c, F.lit("")) != "", F.struct("pos", F.col(c).alias("t"))))), lambda x: x["t"]), "\n\n")
    by_page = pages.select(*PAGE).join(rows.groupBy(*PAGE).agg(listed("raw").alias("raw"), listed("full").alias("full")), list(PAGE), "left")
    head = F.format_string("\n\n--- Page %d ---\n\n", "page_num")
    doc = lambda c: F.concat(X.strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_num", F.concat(head, F.coalesce(c, F.lit(""))).alias("t")))), lambda x: x["t"]), "")), F.lit("\n"))
    return by_page.groupBy("doc_id").agg(doc("raw").alias("raw_text"), doc("full").alias("full_text"))


def response(rows: DataFrame, form: str) -> DataFrame:
    """A conversion as one payload column: md is the text, json the record, both has the two."""
    record = F.to_json(F.struct(*[c for c in rows.columns if c != "doc_id"]), {"ignoreNullFields": "false"})
    payload = {"md": F.col("markdown"), "json": record, "both": F.to_json(F.struct("markdown", record.alias("result")))}
    if form not in payload:
        raise ValueError(f"form must be one of {', '.join(payload)}")
    headers = F.create_map(F.lit("X-Page-Count"), F.col("page_count").cast("string"), F.lit("X-Figure-Count"), F.col("figure_count").cast("string"))
    return rows.select("doc_id", payload[form].alias("payload"), headers.alias("headers"))
