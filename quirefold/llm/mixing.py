"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirefold.llm.common import materialise

#: Weights dealt to the sources in their order, over and over.
WEIGHTS = (3, 1, 2)
#: The mix holds this part of all words; no source is taken more often than CAP times.
SHARE, CAP = 1.5, 2
SEED = 17
#: A block holds at most BLOCK words, and so few that the smallest source has SOURCE_BLOCKS of them.
BLOCK, SOURCE_BLOCKS = 256, 64
#: A shard holds about so many words; more of them as the square root of the corpus grows.
SHARD_WORDS, SHARD_ROOT = 1 << 16, 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """Adds place (1..), weight and target to (source, source_size).

    Weights go round by code point order of the sources, null last.  share times all words are shared out by weight;
    what exceeds CAP times a source's size is shared among the others by weight until none exceeds it.
    In the order of size per weight a source is capped exactly if its part, with all before it
    capped, reaches its cap, so one running sum replaces the repetition.  Only the table of sources meets in one task.
    """
    lcm = math.lcm(*weights)
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    ranked = sources.withColumn("place", F.row_number().over(order))
    ranked = ranked.withColumn("weight", F.element_at(cycle, (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    whole = Window.partitionBy()
    before = Window.orderBy(F.col("source_size") * F.lit(lcm) / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranked.select(
        "*",
        F.sum("source_size").over(whole).alias("words"),
        F.sum("weight").over(whole).alias("weights"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"),
    )
    left = F.col("words") * F.lit(share) - F.col("size_before") * F.lit(CAP)
    capped = F.col("weight") * left >= F.lit(float(CAP)) * F.col("source_size") * (F.col("weights") - F.col("weight_before"))
    sums = sums.withColumn("capped", capped)
    taken = F.sum(F.when(F.col("capped"), F.col("source_size")).otherwise(0)).over(whole)
    used = F.sum(F.when(F.col("capped"), F.col("weight")).otherwise(0)).over(whole)
    part = F.col("weight") * ((F.col("words") * F.lit(share) - taken * F.lit(CAP)) / (F.col("weights") - used))
    target = F.when(F.col("capped"), F.col("source_size") * F.lit(float(CAP))).otherwise(part)
    return sums.withColumn("target", target.cast("double")).select("source", "source_size", "place", "weight", "target")


def apportion(parties: DataFrame, group: list[str], votes: str, seats: str, order: str) -> DataFrame:
    """Adds quota: the seats of each group dealt to its parties by the highest quotients votes / (2 k + 1).

    Any divisor that gives about as many seats puts a party within its share of the rounding of all
    the others, so only the quotients near a party's proportional part are listed and ranked; all
    below are seats for certain.  Ties go by `order`.  Parties without votes get none.
    """
    whole = Window.partitionBy(*group)
    part = F.col(votes) / F.col("_all")
    span = F.col("_parties") * part + 2
    rows = parties.withColumn("_all", F.sum(votes).over(whole)).withColumn("_parties", F.count(F.lit(1)).over(whole))
    rows = rows.withColumn("_low", F.when(F.col(votes) > 0, F.greatest(F.lit(0), F.floor(F.col(seats) * part - span))).otherwise(0).cast("long"))
    rows = rows.withColumn("_high", F.when(F.col(votes) > 0, F.ceil(F.col(seats) * part + span)).otherwise(0).cast("long"))
    rows = rows.withColumn("_open", F.col(seats) - F.sum("_low").over(whole))
    listed = rows.where("_high > _low").withColumn("_k", F.explode(F.sequence("_low", F.col("_high") - 1)))
    ranking = Window.partitionBy(*group).orderBy((F.col(votes) / (F.col("_k") * 2 + 1)).desc(), order, "_k")
    won = listed.withColumn("_rank", F.row_number().over(ranking)).where("_rank <= _open")
    won = won.groupBy(*group, order).agg(F.count(F.lit(1)).alias("_won"))
    keys = [*group, order]
    joined = rows.alias("r").join(won.alias("w"), [F.col(f"r.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys], "left")
    return joined.select("r.*", (F.col("_low") + F.coalesce("_won", F.lit(0))).alias("quota")).drop("_all", "_parties", "_low", "_high", "_open")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """One row per row of docs: id_col, source, shard, size, source_size, target, taken.

    size counts the words of the text (null: 0).  Each source's words are dealt to shards by a seeded hash of
    the id; in a shard the documents lie one after the other in seeded order and are cut into
    blocks of equal tokens.  Sainte-Lague gives every source its number of blocks in proportion to
    its target, and every shard of the source its integer quota in proportion to its words.  A
    quota above the shard's blocks takes all of them once and the rest again; which ones is settled by systematic
    selection from a seeded start.  taken counts a document's words in the blocks that are taken,
    at most CAP times its size.  The blocks are never listed: how many of the first x are taken is
    a closed form, so a document needs only its place.

    Empty table: no rows.  Sources without words, of null and empty texts, have target 0; very long texts are counted whole
    and cut into blocks like any other.  Rows with equal ids are documents of their own; a null id is one more id, a null
    source one more source.  Other columns are ignored, whatever their names.
    """
    sized = materialise(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "sized")
    sources = materialise(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share), "sources")
    total = sources.agg(F.sum("source_size").alias("words"), F.min(F.when(F.col("source_size") > 0, F.col("source_size"))).alias("least"), F.sum(F.floor(F.col("target") + 0.5)).alias("votes")).first()
    words = int(total["words"] or 0)
    per_shard = max(SHARD_WORDS, SHARD_ROOT * math.isqrt(words))
    # A shard's last block may be short, so blocks are small against shards, too.
    block = max(1, min(BLOCK, int(total["least"] or 0) // SOURCE_BLOCKS, per_shard // 256))
    seats = int(math.floor(int(total["votes"] or 0) / block + 0.5))

    voting = sources.select("*", F.floor(F.col("target") + 0.5).cast("long").alias("votes"), F.lit(seats).cast("long").alias("seats"))
    dealt = apportion(voting, [], "votes", "seats", "place").select("source", "source_size", "place", "target", F.col("quota").alias("source_quota"))
    dealt = materialise(dealt.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / per_shard)).cast("long")), "dealt")

    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))))
    number = F.conv(F.substring(key, 1, 12), 16, 10).cast("long")
    source = F.broadcast(dealt) if dealt_is_small(sources) else dealt
    placed = sized.alias("d").join(source.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.*", "source_size", "target", "place", "source_quota", "shards")
    placed = placed.withColumn("key", key).withColumn("shard", F.pmod(number, F.col("shards")))
    row = Window.partitionBy("source", "shard").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Shards are of one size in all sources, so a large source has many and no window is long.
    quotas = placed.groupBy("place", "source", "shard", "source_quota").agg(F.sum("size").alias("held"))
    placed = placed.withColumn("stop", F.sum("size").over(row))
    quotas = apportion(quotas, ["place"], "held", "source_quota", "shard")
    blocks = F.ceil(F.col("held") / block).cast("long")
    quotas = quotas.withColumn("blocks", blocks).withColumn("quota", F.least(F.col("quota"), F.col("blocks") * CAP))
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("place"), F.lit(":"), F.col("shard"))), 1, 12), 16, 10).cast("long")
    quotas = quotas.where("blocks > 0").select(
        "source", "shard", "blocks",
        F.expr("quota div blocks").alias("rounds"), F.expr("quota % blocks").alias("extra"), F.pmod(start, F.col("blocks")).alias("start"),
    )

    joined = placed.alias("d").join(quotas.alias("q"), F.col("d.source").eqNullSafe(F.col("q.source")) & (F.col("d.shard") == F.col("q.shard")), "left")
    joined = joined.select("d.*", "blocks", "rounds", "extra", "start")

    def upto(words: str) -> str:
        """Words of the extra blocks among the shard's first words."""
        chosen = lambda x: f"(({x} + start) * extra div blocks)"
        at = f"(({words}) div {block})"
        return f"(({chosen(at)} - {chosen('0')}) * {block} + ({chosen(f'{at} + 1')} - {chosen(at)}) * (({words}) % {block}))"

    taken = F.expr(f"coalesce(rounds * size + {upto('stop')} - {upto('stop - size')}, 0)").cast("long")
    return joined.select(F.col("id").alias(id_col), "source", "shard", "size", "source_size", "target", taken.alias("taken"))


def dealt_is_small(sources: DataFrame, rows: int = 10_000) -> bool:
    """Whether the table of sources may be broadcast."""
    return sources.count() <= rows
