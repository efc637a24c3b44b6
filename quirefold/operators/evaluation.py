"""Quality metrics: multiset recall, set precision, caption coverage, latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirefold.functions import text as X

# Words that captions begin with, and suffixes of image files.
FIGURE_WORDS = ("Chart", "Figure", "Diagram", "Graph", "Exhibit", "Figur")
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".emf", ".wmf", ".gif", ".tif", ".tiff", ".bmp")
#: Office media below this size are icons.
MEDIA_BYTES = 2000
#: Ranges into which the values of a group are counted to find its percentiles.
COARSE = 1000


def multiset_recall(found: DataFrame, truth: DataFrame, by: list[str], item: str = "token") -> DataFrame:
    """by, hits, truth_n, recall: how many of the truth's items, counted, are found."""
    count = lambda df, name: df.groupBy(*by, item).agg(F.count("*").alias(name))
    rows = count(truth, "t").join(count(found, "f"), [*by, item], "left")
    rows = rows.groupBy(*by).agg(F.sum(F.least("t", F.coalesce("f", F.lit(0)))).alias("hits"), F.sum("t").alias("truth_n"))
    return rows.withColumn("recall", F.col("hits") / F.col("truth_n"))


def capped_recall(counts: DataFrame, found: str, truth: str) -> DataFrame:
    """One row (hits, truth_n, recall): finds beyond a page's truth do not make up for others' lacks."""
    rows = counts.agg(F.sum(F.least(found, truth)).alias("hits"), F.sum(truth).alias("truth_n"))
    return rows.withColumn("recall", F.when(F.col("truth_n") > 0, F.col("hits") / F.col("truth_n")))


def precision_recall(found: DataFrame, truth: DataFrame, by: list[str], item: str) -> DataFrame:
    """by, true_positives, found_n, truth_n, precision, recall of sets."""
    f = found.select(*by, item).distinct().withColumn("_f", F.lit(1))
    t = truth.select(*by, item).distinct().withColumn("_t", F.lit(1))
    rows = f.join(t, [*by, item], "full").groupBy(*by).agg(F.count_if(F.col("_f").isNotNull() & F.col("_t").isNotNull()).alias("true_positives"), F.count("_f").alias("found_n"), F.count("_t").alias("truth_n"))
    share = lambda n: F.when(F.col(n) > 0, F.col("true_positives") / F.col(n))
    return rows.withColumns({"precision": share("found_n"), "recall": share("truth_n")})


def captions(pages: DataFrame) -> DataFrame:
    """(doc_id, word, number, page_num): numbered captions by the word that a document numbers most with."""
    each = [pages.select("doc_id", "page_num", F.lit(w).alias("word"), F.lit(i).alias("ord"), F.explode(F.regexp_extract_all("text", F.lit(rf"\b{w}{X.SPACE}{{0,3}}(\d{{1,3}})\b"), 1)).alias("number")) for i, w in enumerate(FIGURE_WORDS)]
    rows = each[0]
    for more in each[1:]:
        rows = rows.unionByName(more)
    rows = rows.withColumn("number", F.col("number").cast("int")).distinct()
    counted = rows.groupBy("doc_id", "word", "ord").agg(F.count_distinct("number").alias("n"))
    best = counted.groupBy("doc_id").agg(F.max_by("word", F.struct("n", -F.col("ord"))).alias("word"))
    return rows.join(best, ["doc_id", "word"]).select("doc_id", "word", "number", "page_num")


def caption_coverage(caption_pages: DataFrame, figures: DataFrame) -> DataFrame:
    """(doc_id, total, covered, pct): a number is covered if any of its pages has a figure that was not skipped."""
    kept = figures.where(~F.col("skipped")).select("doc_id", F.col("page").alias("page_num")).distinct().withColumn("_hit", F.lit(True))
    rows = caption_pages.join(kept, ["doc_id", "page_num"], "left").groupBy("doc_id", "number").agg(F.count("_hit").alias("hit"))
    rows = rows.groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if(F.col("hit") > 0).alias("covered"))
    return rows.withColumn("pct", F.col("covered") / F.col("total") * 100)


def missed_captions(caption_pages: DataFrame, figures: DataFrame) -> DataFrame:
    kept = figures.where(~F.col("skipped")).select("doc_id", F.col("page").alias("page_num"))
    covered = caption_pages.join(kept, ["doc_id", "page_num"], "left_semi").select("doc_id", "number")
    rows = caption_pages.join(covered, ["doc_id", "number"], "left_anti")
    return rows.groupBy("doc_id", "number").agg(F.sort_array(F.collect_set("page_num")).alias("pages"))


def totals_by_mode(scores: DataFrame) -> DataFrame:
    """covered, total and pct per mode and, with a null mode, over all."""
    rows = scores.rollup("mode").agg(F.sum("covered").alias("covered"), F.sum("total").alias("total"))
    return rows.withColumn("pct", F.when(F.col("total") > 0, F.col("covered") / F.col("total") * 100))


def distinct_images(files: DataFrame) -> DataFrame:
    return files.groupBy("doc_id").agg(F.count_distinct(F.md5("content")).alias("images"))


def source_images(members: DataFrame) -> DataFrame:
    """Images of an Office file by its ZIP members (doc_id, name, size), icons left out."""
    suffix = F.lower(F.regexp_extract("name", r"(\.[^./]*)$", 1))
    real = F.col("name").rlike(r"/media/[^/]+$") & suffix.isin(*IMAGE_SUFFIXES) & (F.col("size") >= MEDIA_BYTES)
    return members.groupBy("doc_id").agg(F.count_if(real).alias("images"))


def latencies(samples: DataFrame, by: str, value: str) -> DataFrame:
    """by, n, median, p95, longest.  p95 is the value at place floor(0.95 n) of the sorted ones, from 0.

    Equal values are counted first; then a group's values lie in COARSE ranges between its least and greatest,
    and running sums over the ranges tell which three of them hold the places asked for.  Only the distinct values of
    those are ranked, so no group is sorted as a whole.
    """
    counted = samples.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("by"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("times"))
    ends = counted.groupBy("by").agg(F.min("v").alias("low"), F.max("v").alias("longest"), F.sum("times").alias("n"))
    same = F.col("c.by").eqNullSafe(F.col("e.by"))
    share = F.coalesce(F.try_divide(F.col("v") - F.col("low"), F.col("longest") - F.col("low")), F.lit(0.0))
    ranged = counted.alias("c").join(ends.alias("e"), same).select("c.by", "v", "times", "n", F.least(F.floor(share * COARSE), F.lit(COARSE - 1)).alias("range"))
    sums = ranged.groupBy("by", "range").agg(F.sum("times").alias("held"))
    before = Window.partitionBy("by").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0)))
    places = F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2), F.floor(F.col("n") * F.lit(0.95)))
    wanted = sums.alias("c").join(ends.alias("e"), same).select(F.col("c.by").alias("by"), "range", "before", "held", places.alias("places"))
    wanted = wanted.where(F.exists("places", lambda p: (p >= F.col("before")) & (p < F.col("before") + F.col("held"))))
    near = ranged.alias("c").join(wanted.alias("e"), same & (F.col("c.range") == F.col("e.range"))).select("c.by", "c.range", "v", "times", "before", "places")
    upto = Window.partitionBy("by", "range").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = near.withColumn("stop", F.col("before") + F.sum("times").over(upto))
    at = lambda k: F.max(F.when((F.col("places")[k] < F.col("stop")) & (F.col("places")[k] >= F.col("stop") - F.col("times")), F.col("v")))
    told = near.groupBy("by").agg(((at(0) + at(1)) / 2).alias("median"), at(2).alias("p95"))
    return ends.alias("c").join(told.alias("e"), same).select(F.col("c.by").alias(by), "n", "median", "p95", "longest")


def merged_results(old: DataFrame, new: DataFrame, key: str = "name") -> DataFrame:
    """old results whose name was not run again, and all new ones."""
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
