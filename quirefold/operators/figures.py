"""Images and vector figures: which count, what they are called, how they are listed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirefold.functions import text as X

PAGE = ("doc_id", "page_num")
LEAST_WIDTH, LEAST_HEIGHT, FULL_PAGE = 50, 50, 0.80


def first_draws(draws: DataFrame) -> DataFrame:
    """The first place where each image is drawn on a page."""
    box = F.struct("x0", "y0", "x1", "y1")
    return draws.groupBy(*PAGE, "xref").agg(F.min_by(box, "draw_seq").alias("box")).select(*PAGE, "xref", "box.*")


def judged_images(resources: DataFrame, draws: DataFrame, pages: DataFrame) -> DataFrame:
    """resources with box, drop_reason (null: kept; not_drawn, small or full_page, the first that holds), digest and path."""
    rows = resources.join(first_draws(draws), [*PAGE, "xref"], "left").join(pages.select(*PAGE, "is_ocr", F.col("width").alias("page_width"), F.col("height").alias("page_height")), list(PAGE), "left")
    whole = F.col("page_width") * F.col("page_height")
    covers = F.try_divide(F.greatest(F.lit(0.0), F.col("x1") - F.col("x0")) * F.greatest(F.lit(0.0), F.col("y1") - F.col("y0")), whole)
    reason = (
        F.when(F.col("x0").isNull(), "not_drawn")
        .when((F.col("width") < LEAST_WIDTH) | (F.col("height") < LEAST_HEIGHT), "small")
        .when(F.col("is_ocr") & (whole > 0) & (covers > FULL_PAGE), "full_page")
    )
    path = F.format_string("page-%03d-img-%02d.%s", "page_num", "idx", F.coalesce("ext", F.lit("png")))
    return rows.select(*resources.columns, "x0", "y0", "x1", "y1", reason.alias("drop_reason"), F.substring(F.sha2("content", 256), 1, 32).alias("digest"), path.alias("path"))


def kept_images(judged: DataFrame) -> DataFrame:
    return judged.where("drop_reason is null").drop("drop_reason")


def drop_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy("doc_id", F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def diagram_path(page: str = "page_num", index: str = "region_index"):
    return F.format_string("page-%03d-diagram-%02d.png", page, index)


def described(rows: DataFrame, descriptions: DataFrame, kind: str, ref: str) -> DataFrame:
    """rows with description, that of their kind, page and number, null without one.

    Of several the one with the greatest seq wins, where descriptions number their order so, and of equal
    ones, or without seq, the greatest text: the same on every run.
    """
    order = F.struct("seq", "text") if "seq" in descriptions.columns else F.struct("text")
    own = descriptions.where((F.col("kind") == kind) & F.col("text").isNotNull()).groupBy("doc_id", "page_num", F.col("ref").alias(ref)).agg(F.max_by("text", order).alias("description"))
    return rows.join(own, [*PAGE, ref], "left")


def manifest(images: DataFrame, diagrams: DataFrame, descriptions: DataFrame) -> DataFrame:
    """One row per figure that was ever described: doc_id, id, page, kind, bbox, path, description, skipped, ord.

    Images come before diagrams on a page.  Skipped figures stay, with an empty description.
    """
    box = F.when(F.col("x0").isNotNull(), F.array("x0", "y0", "x1", "y1"))
    image = described(images, descriptions, "image", "xref").select("doc_id", F.col("page_num").alias("page"), F.lit("image").alias("kind"), box.alias("bbox"), F.col("path").alias("name"), F.col("idx").alias("n"), "description")
    drawn = described(diagrams, descriptions, "diagram", "region_index").select("doc_id", F.col("page_num").alias("page"), F.lit("diagram").alias("kind"), box.alias("bbox"), diagram_path().alias("name"), F.col("region_index").alias("n"), "description")
    rows = image.unionByName(drawn).where(X.strip(F.coalesce("description", F.lit(""))) != "")
    order = Window.partitionBy("doc_id").orderBy("page", F.col("kind").desc(), "n")
    return rows.select(
        "doc_id",
        F.regexp_replace("name", r"\.[^.]*$", "").alias("id"),
        "page",
        "kind",
        "bbox",
        F.concat("kind", F.lit("s/"), "name").alias("path"),
        X.shown(F.col("description")).alias("description"),
        X.is_skip(F.col("description")).alias("skipped"),
        F.row_number().over(order).alias("ord"),
    )


def figure_counts(figures: DataFrame) -> DataFrame:
    """(doc_id, figure_count, skipped_count): described figures of either kind; only images count as skipped."""
    real = X.strip(F.coalesce("description", F.lit(""))) != ""
    skip = X.is_skip(F.col("description"))
    return figures.groupBy("doc_id").agg(F.count_if(real & ~skip).alias("figure_count"), F.count_if((F.col("kind") == "image") & skip).alias("skipped_count"))


def annotations(figures: DataFrame) -> DataFrame:
    """What would be noted on the pages: figures with a place and a description that is not a skip, images first."""
    rows = figures.where((F.col("bbox").isNotNull()) & (X.shown(F.col("description")) != "") & ~F.col("skipped"))
    return rows.select("doc_id", F.col("page").alias("page_num"), "bbox", F.col("description").alias("text"), "kind", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("kind").desc(), "ord")).alias("ord"))


def documents_with_figures(documents: DataFrame, figures: DataFrame) -> DataFrame:
    """Only these are worth a summary or a language call."""
    return documents.join(figures.select("doc_id"), "doc_id", "left_semi")


def inside_page(annotated: DataFrame, pages: DataFrame) -> DataFrame:
    """Annotations whose page does not exist: must be none before any is written."""
    return annotated.join(pages, list(PAGE), "left_anti")


def collected_images(figures: DataFrame, files: DataFrame) -> DataFrame:
    """Figures that are not skipped, with the bytes of their files; missing files drop out."""
    return figures.where(~F.col("skipped")).join(files.select("doc_id", "path", "content", "width_px", "height_px"), ["doc_id", "path"])

