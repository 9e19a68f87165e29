"""Results of frames as sinks send them: the JSON text and the nine-field message.

A result row has stream_id, frame_seq, frame_ts, infer_ts, latency_ms, model_id, frame_local_path, frame_url and detections, an array of structs with
class_id, class_name, conf, x1, y1, x2, y2, track_id (null if not tracked) and attributes (a map of texts).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def result_json(detections: str = "detections") -> Column:
    """The result as one JSON object with its keys in order; a null track number has no key."""
    box = lambda d: F.array(*[d[c] for c in ("x1", "y1", "x2", "y2")])
    one = lambda d: F.struct(d["attributes"].alias("attributes"), box(d).alias("bbox"), d["class_id"].alias("class_id"), d["class_name"].alias("class_name"), d["conf"].alias("confidence"), d["track_id"].alias("track_id"))
    return F.to_json(F.struct(F.transform(detections, one).alias("detections"), "frame_local_path", "frame_seq", "frame_ts", "frame_url", "infer_ts", "latency_ms", "model_id", "stream_id"))


def frame_detections(detections: str = "detections") -> Column:
    """The message's detections: class_id, class_name, confidence, bbox, track_id (0 if not tracked) and attributes."""
    box = lambda d: F.struct(*[d[c].alias(c) for c in ("x1", "y1", "x2", "y2")])
    return F.transform(detections, lambda d: F.struct(d["class_id"].alias("class_id"), d["class_name"].alias("class_name"), d["conf"].alias("confidence"), box(d).alias("bbox"), F.coalesce(d["track_id"], F.lit(0)).alias("track_id"), d["attributes"].alias("attributes")))
