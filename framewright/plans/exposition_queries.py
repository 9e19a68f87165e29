"""The registry's exposition text, and its samples read back from that text."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.functions import exposition as X
from framewright.functions import metrics as M
from framewright.plans.fixtures import WITH_FRAMES, frames
from framewright.plans.registry import query

#: Name, kind, label and help text of the families that frames tell of.
HELP = {
    "e2e_latency_ms": ("histogram", "stream_id", "End-to-end latency (capture to publish) in milliseconds"),
    "infer_batch_size": ("histogram", "model_id", "Distribution of inference batch sizes"),
    "frames_decoded_total": ("counter", "stream_id", "Total frames decoded per stream"),
    "kafka_published_total": ("counter", None, "Total messages successfully produced to Kafka"),
    "frame_archive_queue_depth": ("gauge", None, "Current pending frame archive queue depth"),
    "stream_state": ("gauge", "stream_id", "Current stream state (0=CONNECTING 1=STREAMING 2=RECONNECTING 3=DEGRADED 4=STOPPED)"),
    "stream_last_frame_age_seconds": ("gauge", "stream_id", "Seconds since last decoded frame arrived"),
}


def families(spark, sf) -> list[X.Family]:
    f = frames(spark, sf)
    size = (1 + F.col("event_id") % 20).cast("double")
    rows = {
        "e2e_latency_ms": M.histogram(f, F.col("latency_ms"), "stream_id"),
        "infer_batch_size": M.histogram(f, size, "model_id", bounds=M.BATCH),
        "frames_decoded_total": f.groupBy("stream_id").agg(F.count("*").alias("value")),
        "kafka_published_total": f.where("event_id % 11 <> 0").agg(F.count("*").alias("value")),
        "frame_archive_queue_depth": f.agg(F.max_by(F.col("event_id") % 50, F.struct("ts", "event_id")).alias("value")),
        "stream_state": f.groupBy("stream_id").agg(F.max_by(F.col("event_id") % 5, "frame_seq").alias("value")),
        "stream_last_frame_age_seconds": f.groupBy("stream_id").agg((F.max_by("event_id", "frame_seq") % 100 / 8).alias("value")),
    }
    return [X.Family(name, kind, text, rows[name], label, 3 if name == "stream_last_frame_age_seconds" else 0) for name, (kind, label, text) in HELP.items()]


def _hist(place: int, name: str, label: str, source: str, bounds) -> str:
    bound = ", ".join(f"({float(b)}, '{b}')" for b in bounds) + ", ('inf'::double, '+Inf')"
    return f"""select {place} as family, {label} as label, 0 as part, le, '{name}_bucket{{{label}="' || {label} || '",le="' || t || '"}} ' || count(*) filter (v <= le) as line from {source}, (values {bound}) b(le, t) group by {label}, le, t
union all select {place}, {label}, 1, 'inf'::double, '{name}_sum{{{label}="' || {label} || '"}} ' || printf('%.3f', sum(v)) from {source} group by {label}
union all select {place}, {label}, 2, 'inf'::double, '{name}_count{{{label}="' || {label} || '"}} ' || count(*) from {source} group by {label}"""


def _single(place: int, name: str, label: str | None, value: str) -> str:
    tag = f"'{name}{{{label}=\"' || {label} || '\"}} '" if label else f"'{name} '"
    return f"select {place}, {label or 'null'}, 0, 0.0, {tag} || {value} from frames{f' group by {label}' if label else ''}"


_HEADS = "\nunion all ".join(f"select {i}, null, {p}, 0.0, '{line}'" for i, (n, (k, _, h)) in enumerate(HELP.items()) for p, line in ((-2, f"# HELP {n} {h}"), (-1, f"# TYPE {n} {k}")))
_TEXT = ", e as (select stream_id, latency_ms as v from frames), b as (select model_id, cast(1 + event_id % 20 as double) as v from frames), lines as (" + "\nunion all ".join([
    _hist(0, "e2e_latency_ms", "stream_id", "e", M.LATENCY), _hist(1, "infer_batch_size", "model_id", "b", M.BATCH), _single(2, "frames_decoded_total", "stream_id", "count(*)"),
    _single(3, "kafka_published_total", None, "count(*) filter (event_id % 11 <> 0)"), _single(4, "frame_archive_queue_depth", None, "arg_max(event_id % 50, (ts, event_id))"),
    _single(5, "stream_state", "stream_id", "arg_max(event_id % 5, frame_seq)"), _single(6, "stream_last_frame_age_seconds", "stream_id", "printf('%.3f', arg_max(event_id, frame_seq) % 100 / 8.0)"), _HEADS,
]) + ")"


@query("metrics_exposition", WITH_FRAMES + _TEXT + " select * from lines")
def metrics_exposition(spark, sf):
    """The text's lines with their places: HELP and TYPE, then buckets, sums and counts, counters and gauges."""
    return X.render(families(spark, sf))


@query("metrics_scraped", WITH_FRAMES + _TEXT + r""" select regexp_extract(line, '^([a-z0-9_]+)', 1) as metric, coalesce(label, '') as own, case when part = 0 and le > 0 then regexp_extract(line, 'le="([^"]*)"', 1) else '' end as le, round(regexp_extract(line, ' (\S+)$', 1)::double, 3) as value from lines where part >= 0""")
def metrics_scraped(spark, sf):
    """The samples that a scrape of the text finds."""
    s = X.parse(metrics_exposition(spark, sf).select("line"))
    own = F.coalesce(F.col("labels")["stream_id"], F.col("labels")["model_id"], F.lit(""))
    return s.select("metric", own.alias("own"), F.coalesce(F.col("labels")["le"], F.lit("")).alias("le"), F.round("value", 3).alias("value"))
