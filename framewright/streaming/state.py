"""Streaming forms: keyed state for rules that need the last outcome, watermarked completion, isolated sinks."""

from __future__ import annotations

import logging
import pickle
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from framewright.operators import sequential
from framewright.operators.tracking import Config, Tracker


def sample_by_time(frames: DataFrame, gap_us: int, idle_ms: int = 60_000) -> DataFrame:
    """Frames (stream_id, frame_seq, ts) that are emitted: the first of a stream, and those ``gap_us`` or more after the last one emitted.

    Events of a batch are taken in order of frame_seq; a stream's state goes after ``idle_ms`` of watermark time."""
    import pandas as pd

    def run(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("frame_seq")
        out = []
        for seq, ts in zip(rows["frame_seq"], rows["ts"]):
            us = int(ts.value // 1000)
            if last is None or us - last >= gap_us:
                last = us
                out.append((key[0], seq, ts))
        state.update((last,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + idle_ms)
        yield pd.DataFrame(out, columns=["stream_id", "frame_seq", "ts"])

    keyed = frames.select("stream_id", "frame_seq", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", "1 minute").groupBy("stream_id")
    return keyed.applyInPandasWithState(run, "stream_id string, frame_seq bigint, ts timestamp", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def follow(rows: DataFrame, step: Callable, start, inputs: list[str], name: str, kind: str, key: str = "stream_id", order: str = "frame_seq", idle_ms: int = 60_000, late: str = "0 seconds") -> DataFrame:
    """``rows`` (a stream with ts) as (key, order, ts, name): the value that a sequential rule gives each row, as :func:`framewright.operators.sequential.carried`
    does for tables.

    ``step(state, *inputs)`` gives the next state and the value. States are kept between micro-batches and restarts and begin anew after ``idle_ms`` without
    rows; a stream's rows must come in order of ``order`` from batch to batch, inside a batch they are sorted."""
    import pandas as pd

    def run(keys, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        held = pickle.loads(state.get[0]) if state.exists else start
        batch = pd.concat(list(batches)).sort_values(order)
        out = []
        for x in batch[inputs].itertuples(index=False):
            held, y = step(held, *x)
            out.append(y)
        state.update((pickle.dumps(held),))
        newest = int(batch["ts"].max().value // 1_000_000)
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame({key: keys[0], order: batch[order].to_numpy(), "ts": batch["ts"].to_numpy(), name: out})

    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, `{order}` {rows.schema[order].dataType.simpleString()}, ts timestamp, `{name}` {kind}"
    keyed = rows.select(key, order, F.col("ts").cast("timestamp").alias("ts"), *[c for c in inputs if c not in (key, order, "ts")]).withWatermark("ts", late).groupBy(key)
    return keyed.applyInPandasWithState(run, schema, "held binary", "append", GroupStateTimeout.EventTimeTimeout)


def throttle(frames: DataFrame, stale: str, gap: int, interval: int, **kw) -> DataFrame:
    """The pass of each frame of a stream, by the rule of :func:`framewright.operators.sequential.throttle`; ``stale`` is a boolean column."""
    return follow(frames, sequential.throttle_step(gap, interval), (0, 0), [stale], "kind", "string", **kw)


def health(events: DataFrame, kind: str, degraded: int, most: int, **kw) -> DataFrame:
    """The state of a source after each of its events, by the rules of :func:`framewright.operators.sequential.health`; ``kind`` is a column."""

    def step(held, event):
        state, failures = held
        if event in ("added", "removed"):
            held = ("CONNECTING" if event == "added" else "STOPPED", 0)
        elif event in ("opened", "reconnect_ok", "frame"):
            held = (state if state == "FAILED" else "STREAMING", 0)
        elif event in ("dropped", "reconnect_failed"):
            failures += 1
            own = "FAILED" if 0 < most <= failures else "DEGRADED" if failures >= degraded else "RECONNECTING"
            held = ("FAILED" if state == "FAILED" else own, failures)
        return held, held[0]

    return follow(events, step, ("STOPPED", 0), [kind], "state", "string", **kw)


def track(dets: DataFrame, config: Config | None = None, idle_ms: int = 60_000, late: str = "0 seconds") -> DataFrame:
    """(stream_id, frame_seq, idx, ts, track_id) of a stream of detections, as :func:`framewright.operators.tracking.track` gives them for a table.

    Tracks of a stream are its state, dropped after ``idle_ms`` without detections; a frame's detections must come in one micro-batch."""
    import pandas as pd

    c, boxes = config or Config(), ["x1", "y1", "x2", "y2"]

    def run(keys, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        tracker = Tracker(c)
        if state.exists:
            vars(tracker).update(pickle.loads(state.get[0]))
        batch = pd.concat(list(batches)).sort_values(["frame_seq", "idx"])
        shown: list = []
        for _, frame in batch.groupby("frame_seq", sort=False):
            shown += tracker.update(frame[boxes].to_numpy(float), frame["conf"].to_numpy(float))
        state.update((pickle.dumps({k: v for k, v in vars(tracker).items() if k != "c"}),))
        newest = int(batch["ts"].max().value // 1_000_000)
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + idle_ms)
        yield batch[["stream_id", "frame_seq", "idx", "ts"]].assign(track_id=pd.array(shown, "Int64"))

    kind = dets.schema["stream_id"].dataType.simpleString()
    keyed = dets.select("stream_id", F.col("frame_seq").cast("bigint").alias("frame_seq"), F.col("idx").cast("bigint").alias("idx"), F.col("ts").cast("timestamp").alias("ts"), "conf", *boxes).withWatermark("ts", late).groupBy("stream_id")
    return keyed.applyInPandasWithState(run, f"stream_id {kind}, frame_seq bigint, idx bigint, ts timestamp, track_id bigint", "held binary", "append", GroupStateTimeout.EventTimeTimeout)


def complete_tiles(tiles: DataFrame, wait: str = "2 seconds") -> DataFrame:
    """Tiles (stream_id, parent_seq, tile_seq, ts, expected) gathered by parent as long as no more than ``wait`` of event time lies between them; parents that stay incomplete are dropped."""
    t = tiles.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", wait)
    g = t.groupBy("stream_id", "parent_seq", F.session_window("ts", wait)).agg(F.count("*").alias("n"), F.max("expected").alias("expected"), F.min("tile_seq").alias("template"))
    return g.where("n >= expected").select("stream_id", "parent_seq", "n", "template")


def latency_windows(frames: DataFrame, size: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """Count and mean latency by stream and window of event time; an extension, with a watermark for late rows."""
    f = frames.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return f.groupBy("stream_id", F.window("ts", size).alias("w")).agg(F.count("*").alias("n"), F.avg("latency_ms").alias("mean"))


def fan_out(sinks: dict[str, Callable[[DataFrame, int], None]]):
    """A foreachBatch function that hands each batch to every sink; a failing one never holds up the others and is logged; if all fail, the batch fails."""

    def run(df: DataFrame, batch: int) -> None:
        failed = {}
        df.persist()
        try:
            for name, sink in sinks.items():
                try:
                    sink(df, batch)
                except Exception as e:  # noqa: BLE001
                    failed[name] = e
                    logging.getLogger(__name__).error("sink %s failed on batch %s: %s", name, batch, e)
        finally:
            df.unpersist()
        if len(failed) == len(sinks) and sinks:
            raise RuntimeError(f"every sink failed: {failed}")

    return run
