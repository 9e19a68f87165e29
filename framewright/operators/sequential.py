"""Rules whose next step depends on the last one's outcome.

Where a window can tell the outcome, the rule is a window (:func:`health`). Else rows are dealt by stream, sorted inside their partition and followed
batch by batch with a small state (:func:`carried`): nothing of a stream is gathered, so memory does not grow with it and time is linear.
Time comes from the events, never from a clock, so results repeat. The streaming forms are in ``framewright.streaming``.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def carried(df: DataFrame, key: str, order: str, inputs: dict[str, Column], start, step: Callable, name: str, kind: str) -> DataFrame:
    """(key, order, name): ``step(state, *inputs)`` gives the next state and the row's value; each key begins with ``start``."""
    rows = df.select(key, order, *[c.alias(n) for n, c in inputs.items()])
    out = df.sparkSession.createDataFrame([], f"`{name}` {kind}").schema[0].dataType
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, `{order}` {rows.schema[order].dataType.simpleString()}, `{name}` {kind}"
    value = to_arrow_type(out)

    def run(batches):
        held, state = object(), start
        for b in batches:
            got = []
            for k, *x in zip(b.column(0).to_pylist(), *(b.column(i).to_pylist() for i in range(2, b.num_columns))):
                if k != held:
                    held, state = k, start
                state, y = step(state, *x)
                got.append(y)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, value)], [key, order, name])

    return rows.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, schema)


def sample_by_time(df: DataFrame, us: Column, gap_us: int, key: str = "stream_id", order: str = "frame_seq") -> DataFrame:
    """(key, order, emitted): the first event, and each that comes ``gap_us`` or more after the last emitted one. Whole microseconds."""

    def step(last, t):
        emit = last is None or t - last >= gap_us
        return t if emit else last, emit

    return carried(df, key, order, {"us": us}, None, step, "emitted", "boolean")


def throttle_step(gap: int, interval: int) -> Callable:
    """The step of :func:`throttle`: its state counts the frames and holds the last fallback's number."""

    def step(state, old):
        n, last = state[0] + 1, state[1]
        if interval <= 1 or n % interval == 1:
            return (n, last), "full"
        if not old:
            return (n, last), "roi"
        return ((n, n), "fallback") if n - last >= gap else ((n, last), "single")

    return step


def throttle(df: DataFrame, stale: Column, gap: int, interval: int, key: str = "stream_id", order: str = "frame_seq") -> DataFrame:
    """(key, order, kind), the pass of each frame: full by cadence, roi where the snapshot is fresh, else a fallback to a full one if ``gap`` frames
    have gone since the last (a stream's first ``gap`` frames have none), else a single tile."""
    return carried(df, key, order, {"stale": stale}, (0, 0), throttle_step(gap, interval), "kind", "string")


def micro_batches(df: DataFrame, us: Column, size: int, delay_us: int, key: str = "stream_id", order: str = "frame_seq") -> DataFrame:
    """(key, order, batch): a group of events ends when it has ``size`` of them or one comes ``delay_us`` or more after its first."""

    def step(state, t):
        batch, n, first = state
        if n == 0 or n >= size or t - first >= delay_us:
            batch, n, first = batch + 1, 0, t
        return (batch, n + 1, first), batch

    return carried(df, key, order, {"us": us}, (0, 0, 0), step, "batch", "int")


def batch_policy(df: DataFrame, failed: Column, cap: int = 16, streak: int = 120, key: str = "stream_id", order: str = "frame_seq") -> DataFrame:
    """(key, order, size): the largest batch after each run, halved by a memory failure (1 at least), doubled after ``streak`` successes (``cap`` at most)."""

    def step(state, bad):
        size, ok = state
        size, ok = (max(1, size // 2), 0) if bad else (size, ok + 1)
        if ok >= streak and size < cap:
            size, ok = min(cap, size * 2), 0
        return (size, ok), size

    return carried(df, key, order, {"bad": failed}, (cap, 0), step, "size", "int")


def health(df: DataFrame, kind: Column, degraded: int, most: int, key: str = "stream_id", order: str = "frame_seq") -> DataFrame:
    """(key, order, state) after each event: CONNECTING, STREAMING, RECONNECTING, DEGRADED, FAILED (final until the stream is added or removed) or STOPPED.

    Failures in a row are counted since the last event that is none; FAILED is tested before DEGRADED, so with equal limits DEGRADED is
    never seen; ``most`` 0 never fails; events of other kinds change nothing."""
    every = Window.partitionBy(key).orderBy(order)
    rows = df.select(key, order, kind.alias("kind")).withColumns({"lost": F.col("kind").isin("dropped", "reconnect_failed"), "back": F.col("kind").isin("opened", "reconnect_ok", "frame"), "new": F.col("kind").isin("added", "removed")})
    upto = every.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("life", F.count_if("new").over(upto)).withColumn("calm", F.count_if(F.col("back") | F.col("new")).over(upto))
    streak = Window.partitionBy(key, "life", "calm").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("failures", F.count_if("lost").over(streak))
    life = Window.partitionBy(key, "life").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    failed = F.max(F.col("lost") & (F.col("failures") >= most)).over(life) if most > 0 else F.lit(False)
    own = F.when(F.col("kind") == "removed", "STOPPED").when(F.col("kind") == "added", "CONNECTING").when(F.col("back"), "STREAMING").when(F.col("lost") & (F.col("failures") >= degraded), "DEGRADED").when(F.col("lost"), "RECONNECTING")
    rows = rows.withColumn("failed", failed).withColumn("own", own)
    state = F.when(F.col("failed"), "FAILED").otherwise(F.coalesce(F.last("own", ignorenulls=True).over(life), F.lit("STOPPED")))
    return rows.select(key, order, state.alias("state"))
