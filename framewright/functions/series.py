"""Scraped series: instant values, sliding range rates with reset correction and extrapolation, bucket quantiles over summed rates.

A series is a DataFrame of samples: label columns, ``t_ms`` (when it was scraped) and ``value``. Every function takes steps of
``step_ms`` (multiples of it since the epoch) and returns the label columns, ``t_ms`` of the step, and ``value``; a step of which
the window holds nothing has no row. The window of step t is (t - range, t].

Samples are dealt by series and slab of time, together with those of the range before a slab. Inside a slab they are summed up by slices, and a step takes the
slices of its window from the last one backwards; so each sample is shuffled once, a long or hot series is spread over its slabs, and each group holds at
most the samples of a slice or the slices of a window. Null values are taken for lost scrapes; of several samples of one time the largest counts.

``value`` may hold the ``width`` counters of one scrape, as those of a histogram, in an array: each is a series of its own and counts, resets
and is carried on by itself, and the result is an array too. An array of another length, or with a null, is a lost scrape.
"""

from __future__ import annotations

from functools import wraps
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: An instant value is the last sample of five minutes.
LOOKBACK_MS = 300_000
#: Windows in a slab of time.
SLAB = 32


def _own_names(f):
    """Gives a series function labels of other names, so that none of them clashes with a column made on the way."""

    @wraps(f)
    def run(samples: DataFrame, labels: list[str], *args, **kw) -> DataFrame:
        inner = [f"label_{i}" for i in range(len(labels))]
        out = f(samples.select(*[F.col(c).alias(i) for c, i in zip(labels, inner)], "t_ms", "value"), inner, *args, **kw)
        return out.select(*[F.col(i).alias(c) for c, i in zip(labels, inner)], "t_ms", "value")

    return run


def _drop(before: Column, after: Column) -> Column:
    """What a counter had before it began anew."""
    return F.when(after < before, before).otherwise(0.0)


def _drops(before: Column, after: Column) -> Column:
    """The :func:`_drop` of each counter, null where none began anew."""
    return F.when(F.exists(F.zip_with(before, after, lambda x, y: y < x), lambda x: x), F.zip_with(before, after, _drop))


def _summed(arrays: Column, width: int) -> Column:
    """The sum of the arrays that are not null, null where there is none."""
    known = F.filter(arrays, lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.array_repeat(F.lit(0.0), width), lambda s, x: F.zip_with(s, x, lambda u, v: u + v)))


def _steps(samples: DataFrame, labels: list[str], range_ms: int, step_ms: int, width: int | None) -> DataFrame:
    """(labels, t_ms, now, held): of each step the last slice of its window, and the count, first sample and losses of all its slices in order."""
    up = lambda c, by: (F.ceil(c / by) * by).cast("bigint")
    down = lambda c, by: (F.floor(c / by) * by).cast("bigint")
    between = lambda a, b, by: F.when(a <= b, F.sequence(a, b, F.lit(by).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    slice_ms, n = gcd(range_ms, step_ms), width or 1
    slab_ms = -(-SLAB * max(range_ms, step_ms) // step_ms) * step_ms
    value = F.col("value").cast("array<double>") if width else F.array(F.col("value").cast("double"))
    rows = samples.select(*labels, F.col("t_ms").cast("bigint").alias("t_ms"), value.alias("value")).where(F.col("t_ms").isNotNull() & (F.size("value") == n) & ~F.exists("value", lambda x: x.isNull()))
    first, last = up(F.col("t_ms"), step_ms), down(F.col("t_ms") + range_ms - 1, step_ms)
    slabs = F.when(first <= last, between(F.floor(first / slab_ms), F.floor(last / slab_ms), 1)).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select(*labels, F.explode(slabs).alias("slab"), "t_ms", "value").repartition(*labels, "slab")
    rows = rows.groupBy(*labels, "slab", "t_ms").agg(F.array(*[F.max(F.get("value", F.lit(i))) for i in range(n)]).alias("value"))
    rows = rows.groupBy(*labels, "slab", up(F.col("t_ms"), slice_ms).alias("slot")).agg(F.sort_array(F.collect_list(F.struct("t_ms", "value"))).alias("x"))
    at = lambda i: F.get("x", i)
    lost = F.when(F.size("x") > 1, _summed(F.transform(F.sequence(F.lit(1), F.size("x") - 1), lambda i: _drops(at(i - 1)["value"], at(i)["value"])), n))
    rows = rows.select(*labels, "slab", "slot", F.size("x").cast("bigint").alias("n"), lost.alias("lost"), at(F.lit(0)).alias("a"), at(F.size("x") - 1).alias("z"))
    w = Window.partitionBy(*labels, "slab").orderBy("slot")
    rows = rows.withColumns({"next": F.lead("slot").over(w), "before": F.lag("z.value").over(w)})
    part = F.struct("slot", "n", "a", "lost", _drops(F.col("before"), F.col("a.value")).alias("fell"))
    rows = rows.select(*labels, "slab", "slot", "next", F.col("z").alias("now"), part.alias("part"))
    rows = rows.withColumn("parts", F.collect_list("part").over(w.rangeBetween(slice_ms - range_ms, 0)))
    first = F.greatest(up(F.col("slot"), step_ms), F.col("slab") * slab_ms)
    last = F.least(down(F.least("next", F.col("slot") + range_ms) - slice_ms, step_ms), (F.col("slab") + 1) * slab_ms - step_ms)  # least passes over null
    rows = rows.select(*labels, F.explode(between(first, last, step_ms)).alias("t_ms"), "now", "parts")
    return rows.select(*labels, "t_ms", "now", F.filter("parts", lambda x: x["slot"] > F.col("t_ms") - range_ms).alias("held"))


def _single(values: DataFrame, width: int | None) -> DataFrame:
    return values if width else values.withColumn("value", F.get("value", F.lit(0)))


@_own_names
def increase(samples: DataFrame, labels: list[str], range_ms: int, step_ms: int, width: int | None = None) -> DataFrame:
    """How much a counter grew in each step's window, carried on to the ends of the window.

    Resets add what was lost. The growth between the first and the last sample is stretched over the time to the window's ends where that is
    less than 1.1 mean gaps, else over half a mean gap; before the first sample never past the time when the counter was 0."""
    w = _steps(samples, labels, range_ms, step_ms, width)
    a = F.get("held", F.lit(0))["a"]
    n = F.aggregate("held", F.lit(0).cast("bigint"), lambda s, x: s + x["n"])
    lost = _summed(F.concat(F.transform("held", lambda x: x["lost"]), F.transform(F.slice("held", F.lit(2), F.size("held")), lambda x: x["fell"])), width or 1)
    w = w.select(*labels, "t_ms", n.alias("n"), lost.alias("lost"), a.alias("a"), F.col("now").alias("z")).where("n > 1")
    grown = F.zip_with("z.value", "a.value", lambda z, a: z - a)
    grown = F.when(F.col("lost").isNull(), grown).otherwise(F.zip_with(grown, "lost", lambda g, x: g + x))
    w = w.select(*labels, "t_ms", "n", F.col("a.value").alias("low"), grown.alias("grown"), (F.col("z.t_ms") - F.col("a.t_ms")).alias("span"), (F.col("a.t_ms") - F.col("t_ms") + range_ms).alias("head"), (F.col("t_ms") - F.col("z.t_ms")).alias("tail"))
    gap = F.col("span") / (F.col("n") - 1)
    near = lambda x: F.when(F.col(x) < gap * 1.1, F.col(x).cast("double")).otherwise(gap / 2)
    w = w.select(*labels, "t_ms", "low", "grown", "span", near("head").alias("head"), near("tail").alias("tail"))

    def carried(low: Column, grown: Column) -> Column:
        to_zero = F.when((grown > 0) & (low >= 0), F.col("span") * F.try_divide(low, grown))
        return grown * (F.col("span") + F.least("head", to_zero) + F.col("tail")) / F.col("span")  # least passes over null

    return _single(w.select(*labels, "t_ms", F.zip_with("low", "grown", carried).alias("value")), width)


def rate(samples: DataFrame, labels: list[str], range_ms: int, step_ms: int, width: int | None = None) -> DataFrame:
    """The :func:`increase` a second."""
    second = lambda x: x / (range_ms / 1000)
    return increase(samples, labels, range_ms, step_ms, width=width).withColumn("value", F.transform("value", second) if width else second(F.col("value")))


@_own_names
def changes(samples: DataFrame, labels: list[str], range_ms: int, step_ms: int) -> DataFrame:
    """How often the value differs from the sample before, inside each step's window."""
    slot = samples.where("value is not null and t_ms is not null").select(*labels, F.col("t_ms").cast("bigint").alias("t_ms"), F.col("value").cast("double").alias("value"))
    one = slot.groupBy(*labels, "t_ms").agg(F.max("value").alias("value"))
    first, last = F.ceil(F.col("t_ms") / step_ms) * step_ms, F.floor((F.col("t_ms") + range_ms - 1) / step_ms) * step_ms
    steps = F.when(first <= last, F.sequence(first, last, F.lit(step_ms).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    rows = one.select(*labels, F.explode(steps).alias("step"), F.struct("t_ms", "value").alias("s")).groupBy(*labels, "step").agg(F.sort_array(F.collect_list("s")).alias("x"))
    moved = F.when(F.size("x") > 1, F.aggregate(F.sequence(F.lit(1), F.size("x") - 1), F.lit(0).cast("bigint"), lambda s, i: s + (F.get("x", i)["value"] != F.get("x", i - 1)["value"]).cast("bigint"))).otherwise(0)
    return rows.select(*labels, F.col("step").alias("t_ms"), moved.cast("double").alias("value"))


@_own_names
def latest(samples: DataFrame, labels: list[str], step_ms: int, lookback_ms: int = LOOKBACK_MS) -> DataFrame:
    """The last sample of each series at each step, if it is no older than ``lookback_ms``."""
    w = _steps(samples, labels, lookback_ms, step_ms, None)
    return w.select(*labels, "t_ms", F.get("now.value", F.lit(0)).alias("value"))


def total(values: DataFrame, *by: str, width: int | None = None) -> DataFrame:
    """The sum of the values of each step by the labels ``by``; of arrays of ``width`` values, that of each place."""
    summed = F.array(*[F.sum(F.get("value", F.lit(i))) for i in range(width)]) if width else F.sum("value")
    return values.groupBy(*by, "t_ms").agg(summed.alias("value"))


def counted(values: DataFrame, *by: str) -> DataFrame:
    """The number of series with a value at each step."""
    return values.groupBy(*by, "t_ms").agg(F.count(F.lit(1)).cast("double").alias("value"))


def matched(left: DataFrame, right: DataFrame, labels: list[str], op) -> DataFrame:
    """``op`` of the values of the series with equal labels at equal steps; series without a partner go.

    Labels are those that both sides have; a null label equals a null one."""
    r = right.select(*[F.col(c).alias(f"_{c}") for c in (*labels, "t_ms")], F.col("value").alias("_value"))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*labels, "t_ms")]
    return left.join(r, on).select(*labels, "t_ms", op(F.col("value"), F.col("_value")).alias("value"))


def or_zero(values: DataFrame, steps: DataFrame) -> DataFrame:
    """``values`` (t_ms, value) with 0 at those ``steps`` (t_ms) that have none."""
    return steps.select("t_ms").distinct().join(values, "t_ms", "left").select("t_ms", F.coalesce("value", F.lit(0.0)).alias("value"))


def histogram_quantile(q: float, buckets: DataFrame, labels: list[str]) -> DataFrame:
    """The ``q`` quantile of cumulative buckets (labels, le, t_ms, value), le a number or +Inf, as text or double.

    The first bucket that reaches the rank is interpolated, from 0 below the first bound if that is above 0; in the last bucket the largest finite bound
    counts. Without a +Inf bucket, with fewer than two buckets or without observations the value is NaN. Counts that fall with le, as
    rates may by rounding, are lifted to those before."""
    b = buckets.withColumn("le", F.when(F.col("le").cast("string").isin("+Inf", "Infinity"), F.lit(float("inf"))).otherwise(F.col("le").cast("double")))
    rows = b.groupBy(*labels, "t_ms").agg(F.sort_array(F.collect_list(F.struct("le", F.col("value").alias("n")))).alias("b"))  # a bucket for each bound at most
    return _interpolated(q, rows, labels)


def array_quantile(q: float, values: DataFrame, labels: list[str], bounds: list[float]) -> DataFrame:
    """:func:`histogram_quantile` of buckets in arrays (labels, t_ms, value), one for each of the rising ``bounds``."""
    les = F.array(*[F.lit(float(x)) for x in bounds])
    return _interpolated(q, values.select(*labels, "t_ms", F.zip_with(les, "value", lambda le, n: F.struct(le.alias("le"), n.alias("n"))).alias("b")), labels)


def _interpolated(q: float, rows: DataFrame, labels: list[str]) -> DataFrame:
    """The quantiles of (labels, t_ms, b), b the buckets (le, n) in order. The first count that reaches the rank is the first lifted one that does, and only the one before it needs lifting."""
    counts = lambda b: F.transform(b, lambda x: x["n"])
    rows = rows.select(*labels, "t_ms", "b", F.struct(F.get("b", F.size("b") - 1)["le"].alias("le"), F.array_max(counts("b")).alias("n")).alias("top"))
    rank = q * F.col("top.n")
    found = F.array_position(F.transform("b", lambda x: ~(x["n"] < rank)), True).cast("int")
    rows = rows.select(*labels, "t_ms", "b", "top", F.when(found > 0, found - 1).otherwise(F.size("b")).alias("at"))
    at = F.col("at")
    hit, before = F.get("b", at), F.get("b", at - 1)
    low = F.when(at > 0, before["le"]).otherwise(0.0)
    under = F.when(at > 0, F.array_max(counts(F.slice("b", F.lit(1), at)))).otherwise(0.0)
    inside = low + (hit["le"] - low) * F.coalesce(F.try_divide(rank - under, hit["n"] - under), F.lit(0.0))
    value = (
        F.when((F.size("b") < 2) | (F.col("top.le") != float("inf")) | ~(F.col("top.n") > 0), F.lit(float("nan")))
        .when(at >= F.size("b") - 1, F.get("b", F.size("b") - 2)["le"])
        .when((at == 0) & (hit["le"] <= 0), hit["le"])
        .otherwise(inside)
    )
    return rows.select(*labels, "t_ms", value.alias("value"))
