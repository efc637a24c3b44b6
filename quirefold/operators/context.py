"""Words around figures, and leading samples of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirefold.functions import text as X

PAGE = ("doc_id", "page_num")
LANGUAGE_WORDS = 120
#: Words of a document that pages and figures are joined by.
SPAN = 256


def _page_words(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_num, pos, y0, y1, words) of text blocks that have words."""
    rows = blocks.where("kind = 'text'").select(*PAGE, "pos", "y0", "y1", X.words(F.col("text")).alias("words"))
    return rows.where(F.size("words") > 0)


def figure_context(figures: DataFrame, blocks: DataFrame, before: int, after: int) -> DataFrame:
    """figures (doc_id, page_num, fig, y0, y1) with before and after: the nearest words above and below,
    spilling over to earlier and later pages.

    Text beside a figure belongs to neither side.  Other pages are looked at only as far as a quota
    can reach: running sums of a document's words tell which ranges of SPAN words those are, and pages are joined
    by equal ranges, so a figure meets few pages, however long the document.
    """
    words = _page_words(blocks)
    page = words.groupBy(*PAGE).agg(F.sum(F.size("words")).alias("n"))
    doc = Window.partitionBy("doc_id").orderBy("page_num")
    page = page.withColumn("upto", F.sum("n").over(doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    texts = words.groupBy(*PAGE).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "words"))), lambda b: b["words"])).alias("words"))
    texts = texts.join(page, list(PAGE))
    figs = figures.select("doc_id", "page_num", "fig", F.col("y0").alias("top"), F.col("y1").alias("bottom"))

    own = figs.join(words, list(PAGE), "left")
    side = lambda cond: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("pos", "words")))), lambda b: b["words"]))
    own = own.groupBy("doc_id", "page_num", "fig").agg(side(F.col("y1") <= F.col("top")).alias("above"), side(F.col("y0") >= F.col("bottom")).alias("below"))

    reach = own.select("doc_id", "page_num", "fig", (F.lit(before) - F.size("above")).alias("want_before"), (F.lit(after) - F.size("below")).alias("want_after"))
    # Words of the document before each page of texts or figures, and up to its end.
    marks = page.select(*PAGE, "n").unionByName(figs.select(*PAGE, F.lit(0).cast("long").alias("n"))).groupBy(*PAGE).agg(F.sum("n").alias("n"))
    marks = marks.select(*PAGE, F.sum("n").over(doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("through"), "n")
    placed = reach.join(marks.select(*PAGE, (F.col("through") - F.col("n")).alias("prior"), "through"), list(PAGE))
    # A page of texts lies in the ranges of SPAN words that it covers; a figure asks for those that its quotas reach.
    covers = F.sequence(F.floor((F.col("upto") - F.col("n")) / SPAN), F.floor((F.col("upto") - 1) / SPAN))
    ranged = texts.select("doc_id", F.col("page_num").alias("p"), "words", "n", "upto", F.explode(covers).alias("range"))
    low, high = F.greatest(F.lit(0), F.col("prior") - F.greatest(F.lit(0), "want_before")), F.col("through") + F.greatest(F.lit(0), "want_after") - 1
    asked = placed.withColumn("range", F.explode(F.sequence(F.floor(low / SPAN), F.floor(F.greatest(low, high) / SPAN))))
    earlier = (F.col("p") < F.col("page_num")) & (F.col("upto") > F.col("prior") - F.col("want_before"))
    later = (F.col("p") > F.col("page_num")) & (F.col("upto") - F.col("n") < F.col("through") + F.col("want_after"))
    other = asked.join(ranged, ["doc_id", "range"]).where(earlier | later).groupBy("doc_id", "page_num", "fig", "p").agg(F.first("words").alias("words"))
    gather = lambda cond: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("p", "words")))), lambda b: b["words"]))
    spilled = other.groupBy("doc_id", "page_num", "fig").agg(gather(F.col("p") < F.col("page_num")).alias("earlier"), gather(F.col("p") > F.col("page_num")).alias("later"))
    rows = own.join(spilled, ["doc_id", "page_num", "fig"], "left")
    none = F.array().cast("array<string>")
    head = F.concat(F.coalesce("earlier", none), "above")
    tail = F.concat("below", F.coalesce("later", none))
    last = F.when(F.size(head) > before, F.slice(head, -before, before)).otherwise(head) if before else none
    first = F.slice(tail, 1, after) if after else none
    return rows.select("doc_id", "page_num", "fig", F.array_join(last, " ").alias("before"), F.array_join(first, " ").alias("after"))


def leading_sample(blocks: DataFrame, pages: DataFrame, n: int = LANGUAGE_WORDS) -> DataFrame:
    """(doc_id, sample): the first n words of each document, scanned pages by their OCR text.

    A running count of words keeps the pages that the sample reaches; the rest is not gathered.
    """
    texts = blocks.where("kind = 'text'").groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda b: b["text"]), " ").alias("text"))
    rows = pages.join(texts, list(PAGE), "left")
    text = F.when(F.coalesce("is_ocr", F.lit(False)), F.col("ocr_text")).otherwise(F.col("text"))
    rows = rows.select("doc_id", "page_num", X.words(F.coalesce(text, F.lit(""))).alias("words"))
    earlier = Window.partitionBy("doc_id").orderBy("page_num").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("prior", F.coalesce(F.sum(F.size("words")).over(earlier), F.lit(0))).where(F.col("prior") < n)
    cut = rows.select("doc_id", "page_num", F.slice("words", 1, n).alias("words"))
    flat = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page_num", "words"))), lambda p: p["words"]))
    return cut.groupBy("doc_id").agg(F.array_join(F.slice(flat, 1, n), " ").alias("sample"))
