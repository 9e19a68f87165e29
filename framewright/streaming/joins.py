"""Joins with a time limit: results met with their envelopes in flight, and secondary answers met with their primary result under a deadline.

Each function takes tables or streams alike. Streams need their times in order of arrival up to the watermark; what comes later than it is dropped,
as is what stays alone.
"""

from __future__ import annotations

import pickle

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

ANSWERS = "array<struct<at: timestamp, idx: bigint, attribute: string, label: string>>"


def in_flight(sent: DataFrame, done: DataFrame, wait: str = "5 seconds", late: str = "1 second") -> DataFrame:
    """Rows of ``sent`` (stream_id, frame_seq, ts, ...) with those of ``done`` (stream_id, frame_seq, done, ...) that end no later than ``wait`` after them.

    In a stream the state of both sides goes when the watermark has passed the limit; orphans on either side are dropped."""
    a, b = sent.withColumn("ts", F.col("ts").cast("timestamp")), done.withColumn("done", F.col("done").cast("timestamp"))
    if a.isStreaming or b.isStreaming:
        a, b = a.withWatermark("ts", late), b.withWatermark("done", late)
    b = b.withColumnRenamed("stream_id", "_stream").withColumnRenamed("frame_seq", "_seq")
    on = (F.col("stream_id") == F.col("_stream")) & (F.col("frame_seq") == F.col("_seq")) & (F.col("done") >= F.col("ts")) & (F.col("done") <= F.col("ts") + F.expr(f"interval {wait}"))
    return a.join(b, on).drop("_stream", "_seq")


def cascade_deadline(results: DataFrame, answers: DataFrame, wait_ms: int = 20) -> DataFrame:
    """(stream_id, frame_seq, emitted, expected, received, answers): each primary result with the answers that it waited for.

    ``results`` have (stream_id, frame_seq, at, expected, n_dets), one row a frame; ``answers`` (stream_id, frame_seq, at, idx, attribute, label). A result is emitted
    with the answer that makes as many as expected, or ``wait_ms`` after it came. Answers before the result, at the deadline or later, and after
    completion are dropped; one whose idx is none of the result's detections counts, but stands nowhere. Nothing expected is emitted at once.
    Equal times are taken in order of idx, attribute and label."""
    if results.isStreaming or answers.isStreaming:
        return _deadline_stream(results, answers, wait_ms)
    keys = ["stream_id", "frame_seq"]
    r = results.select(*keys, F.col("at").cast("timestamp").alias("start"), F.col("expected").cast("bigint"), "n_dets")
    end = F.col("start") + F.expr(f"interval {wait_ms} milliseconds")
    a = answers.select(*keys, F.struct(F.col("at").cast("timestamp").alias("at"), F.col("idx").cast("bigint").alias("idx"), "attribute", "label").alias("a"))
    rows = r.join(a, keys, "left").groupBy(*keys, "start", "expected", "n_dets").agg(F.array_sort(F.collect_list("a")).alias("all"))  # as many as a frame has jobs
    timely = F.filter("all", lambda x: (x["at"] >= F.col("start")) & (x["at"] < end))
    rows = rows.withColumn("got", F.slice(timely, 1, F.greatest(F.col("expected"), F.lit(0)).cast("int")))
    received = F.size("got").cast("bigint")
    emitted = F.when(F.col("expected") <= 0, F.col("start")).when(received >= F.col("expected"), F.get("got", received.cast("int") - 1)["at"]).otherwise(end)
    placed = F.filter("got", lambda x: (x["idx"] >= 0) & (x["idx"] < F.col("n_dets")))
    return rows.select(*keys, emitted.alias("emitted"), "expected", received.alias("received"), placed.cast(ANSWERS).alias("answers"))


def _deadline_stream(results: DataFrame, answers: DataFrame, wait_ms: int) -> DataFrame:
    import pandas as pd

    keys = ["stream_id", "frame_seq"]
    text = [F.lit(None).cast("string").alias(c) for c in ("attribute", "label")]
    r = results.select(*keys, F.col("at").cast("timestamp").alias("at"), F.lit(0).alias("kind"), F.col("expected").cast("bigint"), F.col("n_dets").cast("bigint"), F.lit(None).cast("bigint").alias("idx"), *text)
    none = [F.lit(None).cast("bigint").alias(c) for c in ("expected", "n_dets")]
    a = answers.select(*keys, F.col("at").cast("timestamp").alias("at"), F.lit(1).alias("kind"), *none, F.col("idx").cast("bigint").alias("idx"), "attribute", "label")
    wait = pd.Timedelta(milliseconds=wait_ms)

    def run(key, batches, state):
        start, expected, n_dets, got = pickle.loads(state.get[0]) if state.exists else (None, 0, 0, [])
        emitted = None
        if state.hasTimedOut:
            emitted = start + wait
        else:
            rows = pd.concat(list(batches)).sort_values(["at", "kind", "idx", "attribute", "label"], na_position="first")
            for at, kind, own, n, idx, attribute, label in rows[["at", "kind", "expected", "n_dets", "idx", "attribute", "label"]].itertuples(index=False):
                if kind == 0:
                    start, expected, n_dets = at, int(own), int(n)
                    emitted = at if expected <= 0 else None
                elif start is not None and emitted is None and at < start + wait:
                    got.append((at, int(idx), attribute, label))
                    emitted = at if len(got) >= expected else None
                elif start is not None and emitted is None:
                    emitted = start + wait
        if emitted is not None:
            state.remove()
            placed = [dict(zip(("at", "idx", "attribute", "label"), x)) for x in got if 0 <= x[1] < n_dets]
            yield pd.DataFrame([(*key, emitted, expected, len(got), placed)], columns=[*keys, "emitted", "expected", "received", "answers"])
        elif start is not None:
            state.update((pickle.dumps((start, expected, n_dets, got)),))
            state.setTimeoutTimestamp(max(int(start.value // 1_000_000) + wait_ms, state.getCurrentWatermarkMs() + 1))

    both = r.unionByName(a).withWatermark("at", "0 seconds")
    out = f"stream_id string, frame_seq bigint, emitted timestamp, expected bigint, received bigint, answers {ANSWERS}"
    return both.groupBy(*keys).applyInPandasWithState(run, out, "held binary", "append", GroupStateTimeout.EventTimeTimeout)
