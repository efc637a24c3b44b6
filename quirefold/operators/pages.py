"""Pages of a finished document: splitting, selection, and the records of an OCR-style answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirefold.functions import text as X

# Fixed value: the mark before each page, written by output.to_markdown; other comments are text.
_MARK = r"<!-- page (\d+) -->"
_REF = r"!\[[^\]]*\]\((?:images|diagrams)/([^)]+)\)"
DPI = 72


def split_pages(documents: DataFrame) -> DataFrame:
    """(doc_id, pos, index, markdown): a row for each page mark, index from 0; without a mark the whole is page 0."""
    numbers = F.regexp_extract_all("markdown", F.lit(_MARK), 1)
    texts = F.split("markdown", _MARK)
    marked = F.transform(numbers, lambda n, i: F.struct((n.cast("int") - 1).alias("index"), X.strip(F.get(texts, i + 1)).alias("markdown")))
    whole = F.array(F.struct(F.lit(0).alias("index"), X.strip(F.col("markdown")).alias("markdown")))
    rows = documents.select("doc_id", F.posexplode(F.when(F.size(numbers) > 0, marked).otherwise(whole)).alias("pos", "page"))
    return rows.select("doc_id", "pos", "page.index", "page.markdown")


def parse_selection(value: object) -> list[int] | None:
    """0-based pages of a selection: numbers and inclusive "a-b" ranges, order and repeats kept."""
    if value is None:
        return None
    items = [value] if isinstance(value, str) else value
    if not isinstance(items, list) or not items:
        raise ValueError("pages must be a non-empty list of 0-based numbers and 'a-b' ranges")
    out: list[int] = []
    for item in items:
        ends = item.split("-") if isinstance(item, str) else [item, item]
        if isinstance(item, str) and (len(ends) != 2 or not all(e.isdecimal() for e in ends)):
            raise ValueError(f"not a page range: {item!r}")
        if not isinstance(item, (int, str)) or isinstance(item, bool):
            raise ValueError(f"not a page: {item!r}")
        first, last = map(int, ends)
        if first < 0 or last < first:
            raise ValueError(f"not a page range: {item!r}")
        out += range(first, last + 1)
    return out


def selected(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """pages (doc_id, index, ..) in the order of requests (doc_id, first, last, item): ranges are
    unfolded, repeats stay; pos numbers the answer."""
    wanted = requests.select("doc_id", "item", F.posexplode(F.sequence("first", "last")).alias("at", "index"))
    order = Window.partitionBy("doc_id").orderBy("item", "at")
    return wanted.join(pages.drop("pos") if "pos" in pages.columns else pages, ["doc_id", "index"]).withColumn("pos", F.row_number().over(order)).drop("item", "at")


def out_of_range(requests: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc_id, missing): the distinct pages asked for that a document of n pages lacks, sorted."""
    rows = requests.select("doc_id", F.explode(F.sequence("first", "last")).alias("index")).join(counts, "doc_id").where("index >= n")
    return rows.groupBy("doc_id").agg(F.sort_array(F.collect_set("index")).alias("missing"))


def selected_figures(figures: DataFrame, limit: int | None = None, least: int | None = None) -> DataFrame:
    """Figures large enough, the first `limit` of each document by ord."""
    rows = figures
    if least:
        rows = rows.where((F.col("width_px") >= least) & (F.col("height_px") >= least))
    if limit is not None:
        order = Window.partitionBy("doc_id").orderBy("ord")
        rows = rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= limit).drop("_rank")
    return rows


def image_entry(with_bytes: bool) -> Column:
    """A figure as it stands in a page's record; coordinates are whole points."""
    corner = lambda i, name: F.bround(F.get("bbox", F.lit(i))).cast("int").alias(name)
    content = X.data_uri(F.col("mime"), F.col("content")) if with_bytes else F.lit(None).cast("string")
    return F.struct("id", corner(0, "top_left_x"), corner(1, "top_left_y"), corner(2, "bottom_right_x"), corner(3, "bottom_right_y"), content.alias("image_base64"))


def rewritten(markdown: Column, ids: Column) -> Column:
    """References to figures in ids become bare ids, all others vanish."""
    found = F.regexp_extract_all(markdown, F.lit(f"({_REF})"), 1)
    names = F.regexp_extract_all(markdown, F.lit(_REF), 1)
    pairs = F.array_distinct(F.arrays_zip(found.alias("ref"), names.alias("name")))

    def swap(text: Column, pair: Column) -> Column:
        kept = F.concat(F.lit("!["), pair["name"], F.lit("]("), pair["name"], F.lit(")"))
        return F.replace(text, pair["ref"], F.when(F.array_contains(ids, pair["name"]), kept).otherwise(F.lit("")))

    return X.strip(F.aggregate(pairs, markdown, swap))


def ocr_records(documents: DataFrame, figures: DataFrame, sizes: DataFrame, with_bytes: bool = False, limit: int | None = None, least: int | None = None, index_map: DataFrame | None = None) -> DataFrame:
    """(doc_id, pos, index, markdown, images, dimensions) of every page.

    sizes has (doc_id, index, width, height), index_map (doc_id, index, original) for a document that was cut from another.
    """
    chosen = selected_figures(figures, limit, least)
    listed = chosen.groupBy("doc_id", (F.col("page") - 1).alias("index")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", image_entry(with_bytes).alias("image")))), lambda x: x["image"]).alias("images"))
    ids = chosen.groupBy("doc_id").agg(F.collect_set("id").alias("_ids"))
    rows = split_pages(documents).join(ids, "doc_id", "left").join(listed, ["doc_id", "index"], "left").join(sizes, ["doc_id", "index"], "left")
    whole = lambda c: F.bround(c).cast("int").alias(c)
    dimensions = F.when(F.col("width").isNotNull(), F.struct(F.lit(DPI).alias("dpi"), whole("height"), whole("width")))
    index = F.col("index")
    if index_map is not None:
        rows, index = rows.join(index_map, ["doc_id", "index"], "left"), F.coalesce("original", "index")
    images = F.coalesce("images", F.array().cast(listed.schema["images"].dataType))
    return rows.select("doc_id", "pos", index.alias("index"), rewritten(F.col("markdown"), F.coalesce("_ids", F.array().cast("array<string>"))).alias("markdown"), images.alias("images"), dimensions.alias("dimensions"))


#: Parameters of an OCR-style request: those acted on, with their checks, and those known but not offered.
PARAMETERS = {"pages": parse_selection, "include_image_base64": bool, "image_limit": int, "image_min_size": int, "document": dict, "model": str, "id": str}
NOT_OFFERED = ("bbox_annotation_format", "document_annotation_format")


def validated(body: dict) -> dict:
    """The parameters of a request; raises for unknown ones, for ones not offered, and for wrong types."""
    out = {}
    for name, value in body.items():
        if name in NOT_OFFERED:
            if value is not None:
                raise ValueError(f"{name} is not offered")
            continue
        if name not in PARAMETERS:
            raise ValueError(f"unknown parameter {name}")
        kind = PARAMETERS[name]
        if value is None:
            continue
        if kind is parse_selection:
            value = parse_selection(value)
        elif not isinstance(value, kind) or kind is int and (isinstance(value, bool) or value < 0):
            raise ValueError(f"{name} must be {'a non-negative integer' if kind is int else kind.__name__}")
        out[name] = value
    return out
