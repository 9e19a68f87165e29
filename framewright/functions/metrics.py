"""Metrics as aggregates: histograms, counters, gauges, rates with resets, quantiles interpolated in buckets, text exposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LATENCY = (1, 2, 5, 10, 20, 50, 100, 200, 500, 1000)
BATCH = (1, 2, 4, 8, 16, 32)


def histogram(df: DataFrame, value: Column, *label: str, bounds=LATENCY) -> DataFrame:
    """(label, le, n, total, count): cumulative counts of each bound and +Inf; counted in one aggregation, then laid out in rows."""
    counts = [F.count_if(value <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    g = df.groupBy(*label).agg(F.sum(value).alias("total"), F.count(value).alias("count"), *counts)
    rows = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit(float("inf")).alias("le"), F.col("count").alias("n")))
    return g.select(*label, "total", "count", F.explode(rows).alias("x")).select(*label, "x.le", "x.n", "total", "count")


def quantile(df: DataFrame, value: Column, q: float, *label: str, bounds=LATENCY) -> DataFrame:
    """(label, q): interpolated in the first bucket that reaches the rank, from 0 below the first bound; the largest bound in the +Inf bucket.

    Counts are those of the rows given, without extrapolation to a scrape window."""
    counts = [F.count_if(value <= b).cast("double").alias(f"b{i}") for i, b in enumerate(bounds)]
    g = df.groupBy(*label).agg(F.count(value).cast("double").alias("count"), *counts)
    rank = F.col("count") * q
    out = F.lit(float(bounds[-1]))
    for i in reversed(range(len(bounds))):
        low, before = (float(bounds[i - 1]), F.col(f"b{i - 1}")) if i else (0.0, F.lit(0.0))
        inside = low + (bounds[i] - low) * F.try_divide(rank - before, F.col(f"b{i}") - before)
        out = F.when((F.col(f"b{i}") >= rank) & (F.col(f"b{i}") > 0), F.coalesce(inside, F.lit(low))).otherwise(out)
    return g.select(*label, F.when(F.col("count") > 0, out).alias("q"))


def increase(df: DataFrame, value: str, label: list[str], order: list[str]) -> DataFrame:
    """``df`` with step, how much a counter grew since its series' row before; after a reset it grew by its value."""
    w = Window.partitionBy(*label).orderBy(*order)
    before = F.lag(value).over(w)
    return df.withColumn("step", F.when(before.isNull(), F.lit(None)).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before))


def exposition(metric: str, hist: DataFrame, label: str) -> DataFrame:
    """Text lines of a histogram: buckets, sum and count."""
    le = F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("int").cast("string"))
    bucket = F.format_string(f'{metric}_bucket{{{label}="%s",le="%s"}} %d', label, le, "n")
    ends = F.array(F.format_string(f'{metric}_sum{{{label}="%s"}} %.3f', label, "total"), F.format_string(f'{metric}_count{{{label}="%s"}} %d', label, "count"))
    lines = F.when(F.col("le") == float("inf"), F.concat(F.array(bucket), ends)).otherwise(F.array(bucket))
    return hist.select(F.explode(lines).alias("line"))
