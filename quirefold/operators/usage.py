"""Token usage, cost, and what jobs took."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirefold.functions import text as X


def usage(calls: DataFrame, by: str = "doc_id") -> DataFrame:
    """Sums of tokens; a missing or zero total is prompt and completion together; calls without usage count apart."""
    p, c = F.coalesce("prompt_tokens", F.lit(0)), F.coalesce("completion_tokens", F.lit(0))
    total = F.coalesce(F.expr("nullif(total_tokens, 0)"), p + c)
    had = F.col("usage_present")
    part = lambda x: F.coalesce(F.sum(F.when(had, x)), F.lit(0)).cast("long")
    return calls.groupBy(by).agg(part(p).alias("prompt_tokens"), part(c).alias("completion_tokens"), part(total).alias("total_tokens"), F.count("*").alias("api_calls"), F.count_if(~had).alias("calls_missing_usage"))


def cost(rows: DataFrame, price_in: Column, price_out: Column) -> DataFrame:
    """estimated_cost, null unless both prices are known: never a zero that misleads."""
    exact = lambda c: c.cast("decimal(20,12)")
    amount = F.col("prompt_tokens") * exact(price_in) + F.col("completion_tokens") * exact(price_out)
    return rows.withColumn("estimated_cost", amount.cast("decimal(18,8)"))


def usage_line(currency: str = "") -> Column:
    known = F.concat(F.lit("cost about "), F.trim(F.concat(F.format_string("%.4f", F.col("estimated_cost").cast("double")), F.lit(f" {currency}"))))
    line = F.format_string("%d calls, %,d tokens (%,d in, %,d out); ", "api_calls", "total_tokens", "prompt_tokens", "completion_tokens")
    line = F.concat(line, F.when(F.col("estimated_cost").isNull(), F.lit("cost unknown: no prices")).otherwise(known))
    return F.concat(line, F.when(F.col("calls_missing_usage") > 0, F.format_string("; %d calls without usage", "calls_missing_usage")).otherwise(F.lit("")))


def job_summary(jobs: DataFrame, by: str) -> DataFrame:
    """Per run: n, mean seconds, seconds in calls, elapsed and how much faster than one by one."""
    rows = jobs.groupBy(by).agg(F.count("*").alias("n"), F.avg("seconds").alias("avg_seconds"), F.sum("seconds").alias("api_seconds"), (F.max("ended") - F.min("started")).alias("elapsed"))
    rows = rows.withColumn("speedup", F.when(F.col("elapsed") > 0, F.col("api_seconds") / F.col("elapsed")))
    return rows.withColumn("took", X.duration(F.col("elapsed")))


def recent(jobs: DataFrame, by: str, n: int = 5) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.col("ended").desc(), "job_id")
    return jobs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
