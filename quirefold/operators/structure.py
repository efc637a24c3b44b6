"""Headings and list items from typography."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions import geometry as G
from quirefold.functions import text as X

HEADING_WORDS, HEADING_LINES, HEADING_LEVELS = 18, 3, 6


def join_spans(spans: DataFrame) -> DataFrame:
    """(doc_id, page_num, block_seq, text, font_size, bold) of blocks from their spans.

    Spans run together in a line, empty lines vanish; size and weight are those of the longest
    span, the first of equals.
    """
    place = ("doc_id", "page_num", "block_seq")
    main = F.struct(F.length("text").alias("n"), (-F.col("line_no")).alias("l"), (-F.col("span_no")).alias("s"))
    lines = spans.groupBy(*place, "line_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda s: F.coalesce(s["text"], F.lit(""))), "").alias("line"),
        F.max_by(F.struct("size", "flags"), main).alias("font"),
        F.max(main).alias("main"),
    )
    out = lines.groupBy(*place).agg(
        F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"] != ""), lambda x: x["line"]), "\n").alias("text"),
        F.max_by("font", "main").alias("font"),
    )
    return out.select(*place, "text", F.bround(F.coalesce("font.size", F.lit(0.0)), 1).alias("font_size"), (F.coalesce("font.flags", F.lit(0)).bitwiseAND(16) != 0).alias("bold"))


def _is_short() -> Column:
    """Few words and lines, and wider than high: what a heading looks like, whatever its size."""
    lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    b = G.box()
    return F.coalesce((F.col("kind") == "text") & (F.col("font_size") > 0) & (G.width(b) >= G.height(b)) & X.at_most_words(F.col("text"), HEADING_WORDS) & (lines <= HEADING_LINES), F.lit(False))


def typography(blocks: DataFrame) -> DataFrame:
    """(doc_id, body, sizes): the font size of most characters, of equals the one met first, 0 without
    text; and the larger sizes that short texts have, from the largest down.

    A document's blocks are summed up by size before anything is joined, so only short tables move.
    """
    text = (F.col("kind") == "text") & (F.col("font_size") > 0)
    sized = blocks.groupBy("doc_id", "font_size").agg(
        F.sum(F.when(text, F.length("text"))).alias("chars"),
        F.min(F.when(text, F.struct("page_num", "pos"))).alias("first"),
        F.bool_or(_is_short()).alias("short"),
    )
    rank = F.when(F.col("chars").isNotNull(), F.struct("chars", (-F.col("first.page_num")).alias("p"), (-F.col("first.pos")).alias("s")))
    out = sized.groupBy("doc_id").agg(F.coalesce(F.max_by(F.when(F.col("chars").isNotNull(), F.col("font_size")), rank), F.lit(0.0)).alias("body"), F.sort_array(F.collect_set(F.when(F.col("short"), F.col("font_size"))), asc=False).alias("sizes"))
    return out.withColumn("sizes", F.filter("sizes", lambda s: s > F.col("body")))


def body_size(blocks: DataFrame) -> DataFrame:
    return typography(blocks).select("doc_id", "body")


def heading_levels(blocks: DataFrame) -> DataFrame:
    """blocks with body and level (null: no heading): 1 for the largest size of a document's headings, one more
    for each smaller one, bold text of the body's size last, HEADING_LEVELS at most."""
    rows = blocks.join(typography(blocks), "doc_id")
    size, bold = F.col("font_size"), F.coalesce(F.col("bold"), F.lit(False))
    heading = (F.col("body") > 0) & ((size > F.col("body")) | (bold & (size >= F.col("body")))) & _is_short()
    rank = F.when(size > F.col("body"), F.array_position("sizes", size)).otherwise(F.size("sizes") + 1)
    return rows.withColumn("level", F.when(heading, F.least(rank, F.lit(HEADING_LEVELS)).cast("int"))).drop("sizes")


def render_text(level: Column, text: Column) -> Column:
    """A text block as Markdown: heading, list item or paragraph."""
    heading = F.concat(F.repeat(F.lit("#"), level), F.lit(" "), X.squeeze(text))
    return F.when(level.isNotNull(), heading).otherwise(F.coalesce(X.list_item(text), X.strip(text)))


def linkify(blocks: DataFrame, links: DataFrame) -> DataFrame:
    """blocks with the anchors of links that meet them wrapped as Markdown, in the order of the links.

    Only the first place of an anchor is wrapped; white space in it may be of any kind.
    """
    page = ("doc_id", "page_num")
    cleaned = links.withColumn("anchor", X.squeeze(F.col("anchor"))).where("anchor <> '' and uri <> ''")
    hit = [F.col(f"b.{c}") == F.col(f"l.{c}") for c in page] + [G.meets(G.box("b"), G.box("l"))]
    pairs = blocks.where("kind = 'text'").alias("b").join(cleaned.alias("l"), hit)
    found = pairs.groupBy(*[F.col(f"b.{c}").alias(c) for c in (*page, "seq")]).agg(F.array_sort(F.collect_list(F.struct("l.link_seq", "l.anchor", "l.uri"))).alias("_links"))

    def wrap(text: Column, link: Column) -> Column:
        tokens = F.transform(F.split(link["anchor"], " "), lambda t: F.concat(F.lit("\\Q"), F.replace(t, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
        pattern = F.array_join(tokens, f"{X.SPACE}+")
        match = F.regexp_substr(text, pattern)
        at = F.instr(text, match)
        wrapped = F.concat(F.substring(text, F.lit(1), at - 1), F.lit("["), X.squeeze(match), F.lit("]("), link["uri"], F.lit(")"), F.substring(text, at + F.length(match), F.length(text)))
        return F.when(match.isNull() | (at == 0), text).otherwise(wrapped)

    joined = blocks.join(found, [*page, "seq"], "left")
    wrapped = F.aggregate(F.coalesce("_links", F.array().cast(found.schema["_links"].dataType)), F.col("text"), wrap)
    return joined.withColumn("text", wrapped).drop("_links")
