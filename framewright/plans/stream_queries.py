"""Queries over frames: sampling, sequential rules, latencies, as-of snapshots, metrics and dashboards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framewright.functions import geometry as G
from framewright.functions import metrics as M
from framewright.functions import text as T
from framewright.operators import results as R
from framewright.operators import sequential as S
from framewright.plans.fixtures import WITH_DETECTIONS, WITH_FRAMES, frames, per_frame
from framewright.plans.registry import query

def seq():
    """A stream's frames in order; built when a query runs, since a window needs a session."""
    return Window.partitionBy("stream_id").orderBy("frame_seq")


def _us(column="ts"):
    return F.unix_micros(F.col(column).cast("timestamp"))


def _recursive(state: str, start: str, step: str) -> str:
    """A rule followed event by event in DuckDB."""
    return f"""with recursive f as materialized (select stream_id, frame_seq, epoch_us(ts) as us, latency_ms, model_id from ({WITH_FRAMES} select * from frames)),
r as (select stream_id, frame_seq, us, {start} from f where frame_seq = 0 union all select f.stream_id, f.frame_seq, f.us, {step} from r join f on f.stream_id = r.stream_id and f.frame_seq = r.frame_seq + 1)
select stream_id, frame_seq, {state} from r"""


@query("frame_count_sample", WITH_FRAMES + "select stream_id, frame_seq from frames where frame_seq % 6 = 0")
def frame_count_sample(spark, sf):
    """Every n-th frame: n is the source's rate over the sample rate, rounded, 1 at least; unknown rates count as 25."""
    fps, want = 30, 5
    every = max(1, round((fps if fps > 0 else 25) / want))
    return frames(spark, sf).where(F.col("frame_seq") % every == 0).select("stream_id", "frame_seq")


@query("time_sample", _recursive("emitted", "true as emitted, us as last", "f.us - r.last >= 300000000, case when f.us - r.last >= 300000000 then f.us else r.last end"))
def time_sample(spark, sf):
    """At most one frame in 300 seconds of event time, counted from the last emitted one."""
    return S.sample_by_time(frames(spark, sf), _us(), 300_000_000)


@query(
    "fallback_throttle",
    _recursive(
        "kind", "'full' as kind, 1 as n, 0 as last",
        "case when (r.n + 1) % 100 = 1 then 'full' when f.latency_ms <= 100 then 'roi' when r.n + 1 - r.last >= 5 then 'fallback' else 'single' end, r.n + 1, case when (r.n + 1) % 100 <> 1 and f.latency_ms > 100 and r.n + 1 - r.last >= 5 then r.n + 1 else r.last end",
    ),
)
def fallback_throttle(spark, sf):
    """Full passes by cadence; stale snapshots fall back to a full pass at most every fifth frame, else to a single tile."""
    return S.throttle(frames(spark, sf), F.col("latency_ms") > 100, 5, 100)


@query("micro_batch", _recursive("batch", "1 as batch, 1 as n, us as first", "case when r.n >= 8 or f.us - r.first >= 900000000 then r.batch + 1 else r.batch end, case when r.n >= 8 or f.us - r.first >= 900000000 then 1 else r.n + 1 end, case when r.n >= 8 or f.us - r.first >= 900000000 then f.us else r.first end"))
def micro_batch(spark, sf):
    """Groups of eight frames, or of what came in 900 seconds."""
    return S.micro_batches(frames(spark, sf), _us(), 8, 900_000_000)


@query("success_streak", _recursive("size", "case when latency_ms > 200 then 8 else 16 end as size, case when latency_ms > 200 then 0 else 1 end as ok", "case when f.latency_ms > 200 then greatest(1, r.size // 2) when r.ok + 1 >= 12 and r.size < 16 then least(16, r.size * 2) else r.size end, case when f.latency_ms > 200 or (r.ok + 1 >= 12 and r.size < 16) then 0 else r.ok + 1 end"))
def success_streak(spark, sf):
    return S.batch_policy(frames(spark, sf), F.col("latency_ms") > 200, 16, 12)


_KIND = "case {f}event_id % 5 when 0 then 'dropped' when 1 then 'reconnect_failed' when 2 then 'reconnect_failed' when 3 then 'reconnect_ok' else 'frame' end"
_LOST = "k in ('dropped', 'reconnect_failed')"


@query(
    "health_fsm",
    f"""with recursive f as materialized (select stream_id, frame_seq, {_KIND.format(f='')} as k from ({WITH_FRAMES} select * from frames)),
r as (select stream_id, frame_seq, case when {_LOST} then 'RECONNECTING' else 'STREAMING' end as state, case when {_LOST} then 1 else 0 end as failures from f where frame_seq = 0
union all select f.stream_id, f.frame_seq, case when r.state = 'FAILED' then 'FAILED' when f.{_LOST} then case when r.failures + 1 >= 5 then 'FAILED' when r.failures + 1 >= 3 then 'DEGRADED' else 'RECONNECTING' end else 'STREAMING' end,
  case when r.state = 'FAILED' then r.failures when f.{_LOST} then r.failures + 1 else 0 end from r join f on f.stream_id = r.stream_id and f.frame_seq = r.frame_seq + 1)
select stream_id, frame_seq, state from r""",
)
def health_fsm(spark, sf):
    """Stream states after each event: degraded from three failures in a row, failed for good from five."""
    return S.health(frames(spark, sf), F.expr(_KIND.format(f="")), 3, 5)


_GRID = [(x, y, 960, 540) for y in (0, 540) for x in (0, 768, 960)]


@query(
    "sahi_schedule",
    _recursive(
        "kind", "'full' as kind, 1 as n, 0 as last",
        "case when (r.n + 1) % 100 = 1 then 'full' when f.latency_ms <= 100 then 'roi' when r.n + 1 - r.last >= 5 then 'fallback' else 'single' end, r.n + 1, case when (r.n + 1) % 100 <> 1 and f.latency_ms > 100 and r.n + 1 - r.last >= 5 then r.n + 1 else r.last end",
    ).replace("with recursive", "with recursive kinds as (with recursive", 1)
    + f"""), g(x, y, w, h) as (values {", ".join(map(str, _GRID))}),
w as (select stream_id, frame_seq, kind, (frame_seq % 10) * 150 as ox, (frame_seq % 4) * 200 as oy from kinds),
t as (select stream_id, frame_seq, kind, x, y, w, h from w, g where kind in ('full', 'fallback')
 union all select stream_id, frame_seq, kind, 0, 0, 1920, 1080 from w where kind = 'single'
 union all select stream_id, frame_seq, kind, greatest(0, ox - 28), greatest(0, oy - 28), least(1920, ox + 228) - greatest(0, ox - 28), least(1080, oy + 228) - greatest(0, oy - 28) from w where kind = 'roi')
select stream_id, frame_seq, kind, cast(row_number() over (partition by stream_id, frame_seq order by y, x) - 1 as bigint) as tile, cast(row_number() over (partition by stream_id order by frame_seq, y, x) as bigint) as tile_seq,
 cast(count(*) over (partition by stream_id, frame_seq) as bigint) as expected, cast(x as int) as x, cast(y as int) as y, cast(w as int) as w, cast(h as int) as h from t""",
)
def sahi_schedule(spark, sf):
    """Frames to tiles: the whole grid on full passes, windows around the snapshot's boxes, or the frame itself as a single tile; tiles are numbered by stream."""
    f = frames(spark, sf)
    kinds = S.throttle(f, F.col("latency_ms") > 100, 5, 100)
    box = F.struct(*[(c.cast("double")).alias(n) for n, c in zip(("x1", "y1", "x2", "y2"), (F.col("frame_seq") % 10 * 150, F.col("frame_seq") % 4 * 200, F.col("frame_seq") % 10 * 150 + 200, F.col("frame_seq") % 4 * 200 + 200))])
    whole = F.array(F.struct(F.lit(0).alias("y"), F.lit(0).alias("x"), F.lit(1920).alias("w"), F.lit(1080).alias("h")))
    grid = G.tiles(1920, 1080, 960, 540, 0.2, 0.0)
    tiles = F.when(F.col("kind").isin("full", "fallback"), grid).when(F.col("kind") == "single", whole).otherwise(F.array(G.roi_window(box, 0.28, 256, 1920, 1080)))
    t = kinds.withColumn("tiles", tiles).withColumn("expected", F.size("tiles").cast("bigint"))
    before = F.coalesce(F.sum("expected").over(seq().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = t.withColumn("before", before).select("stream_id", "frame_seq", "kind", "expected", "before", F.posexplode("tiles").alias("tile", "t"))
    return t.select("stream_id", "frame_seq", "kind", F.col("tile").cast("bigint").alias("tile"), (F.col("before") + F.col("tile") + 1).cast("bigint").alias("tile_seq"), "expected", "t.x", "t.y", "t.w", "t.h")


@query("full_pass_cadence", WITH_FRAMES + "select stream_id, frame_seq from frames where (frame_seq + 1) % 10 = 1")
def full_pass_cadence(spark, sf):
    return frames(spark, sf).where((F.col("frame_seq") + 1) % 10 == 1).select("stream_id", "frame_seq")


@query("write_jitter", WITH_FRAMES + "select stream_id, frame_seq, epoch_us(ts) - epoch_us(lag(ts) over (partition by stream_id order by frame_seq)) as gap_us from frames")
def write_jitter(spark, sf):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return frames(spark, sf).select("stream_id", "frame_seq", (us - F.lag(us).over(seq())).alias("gap_us"))


@query("tile_seq", WITH_FRAMES + "select stream_id, frame_seq, cast(row_number() over (partition by stream_id order by frame_seq) as bigint) as tile_seq from frames where latency_ms > 50")
def tile_seq(spark, sf):
    return frames(spark, sf).where("latency_ms > 50").select("stream_id", "frame_seq", F.row_number().over(seq()).cast("bigint").alias("tile_seq"))


@query("round_robin", WITH_FRAMES + "select stream_id, frame_seq, frame_seq % 3 as worker from frames")
def round_robin(spark, sf):
    return frames(spark, sf).select("stream_id", "frame_seq", F.pmod("frame_seq", F.lit(3)).alias("worker"))


@query("log_every_n", WITH_FRAMES + "select stream_id, count(*) filter ((frame_seq + 1) % 30 = 0) as n30, count(*) filter ((frame_seq + 1) % 200 = 0) as n200 from frames group by 1")
def log_every_n(spark, sf):
    n = F.col("frame_seq") + 1
    return frames(spark, sf).groupBy("stream_id").agg(F.count_if(n % 30 == 0).alias("n30"), F.count_if(n % 200 == 0).alias("n200"))


@query("archive_sample", WITH_FRAMES + "select stream_id, frame_seq, strftime(ts, '%Y%m%d/%H/%M/') || stream_id || '/' || (epoch_us(ts) // 1000) || '_' || frame_seq || '.jpg' as key_ from frames where frame_seq % 2 = 0 and regexp_matches(stream_id, '^[A-Za-z0-9_-]+$')")
def archive_sample(spark, sf):
    """Every second frame of safely named streams, with its object key in UTC."""
    t = F.col("ts").cast("timestamp")
    key = F.concat(F.date_format(t, "yyyyMMdd/HH/mm/"), "stream_id", F.lit("/"), F.unix_millis(t).cast("string"), F.lit("_"), F.col("frame_seq").cast("string"), F.lit(".jpg"))
    return frames(spark, sf).where("frame_seq % 2 = 0").where(F.col("stream_id").rlike("^[A-Za-z0-9_-]+$")).select("stream_id", "frame_seq", key.alias("key_"))


@query("archive_url", WITH_FRAMES + "select stream_id, frame_seq, rtrim('http://frames.example/base//', '/') || '/' || stream_id || '/' || frame_seq as url from frames where frame_seq % 2 = 0")
def archive_url(spark, sf):
    base = F.rtrim(F.lit("http://frames.example/base//"), F.lit("/"))
    return frames(spark, sf).where("frame_seq % 2 = 0").select("stream_id", "frame_seq", F.concat_ws("/", base, "stream_id", F.col("frame_seq").cast("string")).alias("url"))


@query("retention_gc", WITH_FRAMES + ", b as (select distinct stream_id, date_trunc('minute', ts) as bucket from frames), c as (select max(bucket) - interval 3 day as cutoff from b) select stream_id, strftime(bucket, '%Y%m%d%H%M') as bucket from b, c where bucket + interval 1 minute <= cutoff")
def retention_gc(spark, sf):
    """Minute buckets to delete: those that end at or before the cutoff. Only bucket names are read, as partition columns."""
    b = frames(spark, sf).select("stream_id", F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("bucket")).distinct()
    cutoff = b.agg((F.max("bucket") - F.expr("interval 3 days")).alias("cutoff"))
    old = F.col("bucket") + F.expr("interval 1 minute") <= F.col("cutoff")
    return b.join(F.broadcast(cutoff), old).select("stream_id", F.date_format("bucket", "yyyyMMddHHmm").alias("bucket"))


@query("subscribe_filter", WITH_FRAMES + "select stream_id, frame_seq from frames where stream_id in ('cam_01', 'cam_07')")
def subscribe_filter(spark, sf, wanted=("cam_01", "cam_07")):
    """Frames of the subscribed streams; an empty list takes all."""
    f = frames(spark, sf).select("stream_id", "frame_seq")
    return f.where(F.col("stream_id").isin(*wanted)) if wanted else f


@query("maxlen_trim", WITH_FRAMES + "select stream_id, frame_seq from (select *, row_number() over (partition by stream_id order by frame_seq desc) as r from frames) where r <= 100")
def maxlen_trim(spark, sf):
    w = Window.partitionBy("stream_id").orderBy(F.desc("frame_seq"))
    return frames(spark, sf).withColumn("r", F.row_number().over(w)).where("r <= 100").select("stream_id", "frame_seq")


@query("latency_project", WITH_FRAMES + "select stream_id, frame_seq, greatest(0, latency_ms - 5) as queue_ms, round(greatest(0, latency_ms - 5) + case when frame_seq % 7 = 0 then -1 else 6 end, 6) as latency_ms, case when frame_seq % 7 = 0 then -1 else latency_ms end as transit_ms from frames")
def latency_project(spark, sf):
    """Queue and total latency, clamped at 0 on the monotonic clock; unknown parts give -1."""
    queue = F.greatest(F.lit(0.0), F.col("latency_ms") - 5)
    unknown = F.col("frame_seq") % 7 == 0
    return frames(spark, sf).select("stream_id", "frame_seq", queue.alias("queue_ms"), F.round(queue + F.when(unknown, -1).otherwise(6), 6).alias("latency_ms"), F.when(unknown, -1.0).otherwise(F.col("latency_ms")).alias("transit_ms"))


@query("homogeneous_batch", WITH_FRAMES + ", b as (select *, frame_seq // 8 as batch, event_id % 3 as device from frames), x as (select *, first_value(device) over (partition by stream_id, batch order by frame_seq) as want from b) select stream_id, frame_seq, batch from x where device = want")
def homogeneous_batch(spark, sf):
    w = Window.partitionBy("stream_id", "batch").orderBy("frame_seq")
    b = frames(spark, sf).select("stream_id", "frame_seq", F.expr("frame_seq div 8").alias("batch"), (F.col("event_id") % 3).alias("device"))
    return b.withColumn("want", F.first("device").over(w)).where("device = want").select("stream_id", "frame_seq", "batch")


@query("inflight_join", WITH_FRAMES + ", a as (select stream_id, frame_seq, ts from frames where frame_seq % 3 <> 0), r as (select stream_id, frame_seq, ts + interval 2 second * (frame_seq % 5) as done, latency_ms from frames where frame_seq % 4 <> 0) select a.stream_id, a.frame_seq, latency_ms from a join r on a.stream_id = r.stream_id and a.frame_seq = r.frame_seq and done <= ts + interval 5 second")
def inflight_join(spark, sf):
    """Results joined to the envelopes in flight, evicted after five seconds; orphans on either side are dropped."""
    f = frames(spark, sf)
    sent = f.where("frame_seq % 3 <> 0").select("stream_id", "frame_seq", "ts")
    done = f.where("frame_seq % 4 <> 0").select("stream_id", "frame_seq", (F.col("ts") + F.expr("interval 2 seconds") * (F.col("frame_seq") % 5)).alias("done"), "latency_ms")
    return sent.join(done, ["stream_id", "frame_seq"]).where(F.col("done") <= F.col("ts") + F.expr("interval 5 seconds")).select("stream_id", "frame_seq", "latency_ms")


@query("roi_asof", WITH_FRAMES + ", x as (select *, last_value(case when frame_seq % 9 = 0 then frame_seq end ignore nulls) over (partition by stream_id order by frame_seq rows between unbounded preceding and 1 preceding) as roi_seq from frames) select stream_id, frame_seq, roi_seq, coalesce(frame_seq - roi_seq > 6, true) as stale from x")
def roi_asof(spark, sf):
    """The latest snapshot before each frame, stale when it is more than six frames old."""
    w = seq().rowsBetween(Window.unboundedPreceding, -1)
    x = frames(spark, sf).withColumn("roi_seq", F.last(F.when(F.col("frame_seq") % 9 == 0, F.col("frame_seq")), ignorenulls=True).over(w))
    return x.select("stream_id", "frame_seq", "roi_seq", F.coalesce(F.col("frame_seq") - F.col("roi_seq") > 6, F.lit(True)).alias("stale"))


def _hist_sql(source: str, label: str, value: str, bounds, where: str = "") -> str:
    values = ", ".join(f"({float(b)})" for b in bounds)
    return f"select {label}, le, count(*) filter ({value} <= le) as n, round(sum({value}), 3) as total, count(*) as count from {source}, (select unnest([{', '.join(str(float(b)) for b in bounds)}, 'inf'::double]) as le) {where} group by {label}, le" if values else ""


@query("latency_hist", WITH_FRAMES + _hist_sql("frames", "stream_id", "latency_ms", M.LATENCY))
def latency_hist(spark, sf):
    return M.histogram(frames(spark, sf), F.col("latency_ms"), "stream_id").withColumn("total", F.round("total", 3))


@query("batch_hist", WITH_FRAMES + ", b as (select stream_id, cast(1 + event_id % 20 as double) as size from frames) " + _hist_sql("b", "stream_id", "size", M.BATCH))
def batch_hist(spark, sf):
    """Batch sizes in their own bounds: 5 falls under 8, not under 4."""
    b = frames(spark, sf).select("stream_id", (1 + F.col("event_id") % 20).cast("double").alias("size"))
    return M.histogram(b, F.col("size"), "stream_id", bounds=M.BATCH)


@query("metrics_text")
def metrics_text(spark, sf):
    """Exposition text of the latency histogram."""
    return M.exposition("latency_ms", M.histogram(frames(spark, sf), F.col("latency_ms"), "stream_id"), "stream_id")


@query("labeled_counter", WITH_FRAMES + "select stream_id, model_id, count(*) as n from frames group by all")
def labeled_counter(spark, sf):
    return frames(spark, sf).groupBy("stream_id", "model_id").agg(F.count("*").alias("n"))


@query("gauge_last", WITH_FRAMES + "select stream_id, arg_max(latency_ms, frame_seq) as value from frames group by 1")
def gauge_last(spark, sf):
    return frames(spark, sf).groupBy("stream_id").agg(F.max_by("latency_ms", "frame_seq").alias("value"))


_MINUTE = "strftime(date_trunc('minute', ts), '%Y%m%d%H%M')"


def _minute(column="ts"):
    return F.date_format(F.date_trunc("minute", F.col(column).cast("timestamp")), "yyyyMMddHHmm").alias("minute")


#: Quantile panels: name, quantile, label; each over the rows of a minute, as a rate over one minute counts them.
for _name, _q, _label in (("e2e_p99_all", 0.99, None), ("infer_p50_by_model", 0.5, "model_id"), ("infer_p99_by_model", 0.99, "model_id"), ("e2e_p50_by_stream", 0.5, "stream_id"), ("e2e_p90_by_stream", 0.9, "stream_id"), ("e2e_p99_by_stream", 0.99, "stream_id")):
    _g = f"{_label}," if _label else ""
    _counts = ", ".join(f"count(*) filter (latency_ms <= {b})::double as b{i}" for i, b in enumerate(M.LATENCY))
    _case = " ".join(f"when b{i} >= {_q} * n and b{i} > 0 then {float(M.LATENCY[i - 1]) if i else 0.0} + {M.LATENCY[i] - (M.LATENCY[i - 1] if i else 0)} * ({_q} * n - {f'b{i - 1}' if i else 0}) / (b{i} - {f'b{i - 1}' if i else 0})" for i in range(len(M.LATENCY)))

    @query(_name, WITH_FRAMES + f", h as (select {_g} {_MINUTE} as minute, count(*)::double as n, {_counts} from frames group by all) select {_g} minute, round(case {_case} else 1000.0 end, 6) as q from h")
    def _quantile(spark, sf, q=_q, label=_label):
        rows = frames(spark, sf).withColumn("minute", _minute())
        return M.quantile(rows, F.col("latency_ms"), q, *([label] if label else []), "minute").withColumn("q", F.round("q", 6))


_COUNTER = ", c as (select stream_id, frame_seq, ts, model_id, cast(frame_seq % 400 as double) as total from frames), s as (select *, case when lag(total) over w is null then null when total < lag(total) over w then total else total - lag(total) over w end as step from c window w as (partition by stream_id order by frame_seq))"


def counters(spark, sf):
    """A counter a stream that is reset every 400 frames, with its steps."""
    c = frames(spark, sf).select("stream_id", "frame_seq", "ts", "model_id", (F.col("frame_seq") % 400).cast("double").alias("total"))
    return M.increase(c, "total", ["stream_id"], ["frame_seq"])


@query("rate_1m", WITH_FRAMES + _COUNTER + " select stream_id, strftime(date_trunc('minute', ts), '%Y%m%d%H%M') as minute, round(coalesce(sum(step), 0) / 60, 6) as rate from s group by all")
def rate_1m(spark, sf):
    """Growth a second in each minute."""
    return counters(spark, sf).groupBy("stream_id", _minute()).agg(F.round(F.coalesce(F.sum("step"), F.lit(0.0)) / 60, 6).alias("rate"))


@query("increase_2m", WITH_FRAMES + _COUNTER + " select stream_id, epoch_us(ts) // 120000000 as bucket, coalesce(sum(step), 0) as grown from s group by all")
def increase_2m(spark, sf):
    bucket = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 120_000_000).alias("bucket")
    return counters(spark, sf).groupBy("stream_id", bucket).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("grown"))


@query("changes_1m", WITH_FRAMES + ", c as (select stream_id, ts, model_id <> lag(model_id) over (partition by stream_id order by frame_seq) as moved from frames) select stream_id, strftime(date_trunc('minute', ts), '%Y%m%d%H%M') as minute, count(*) filter (moved) as changes from c group by all having count(*) filter (moved) > 0")
def changes_1m(spark, sf):
    moved = F.col("model_id") != F.lag("model_id").over(seq())
    c = frames(spark, sf).select("stream_id", "ts", moved.alias("moved"))
    return c.groupBy("stream_id", _minute()).agg(F.count_if("moved").alias("changes")).where("changes > 0")


@query("state_counts", WITH_FRAMES + ", l as (select stream_id, arg_max(event_id % 6, frame_seq) as state from frames group by 1) select count(*) filter (state = 1) as streaming, count(*) filter (state >= 2) as unhealthy from l")
def state_counts(spark, sf):
    """Streams now streaming, and those in any state beyond, 0 without streams."""
    last = frames(spark, sf).groupBy("stream_id").agg(F.max_by(F.col("event_id") % 6, "frame_seq").alias("state"))
    return last.agg(F.count_if(F.col("state") == 1).alias("streaming"), F.count_if(F.col("state") >= 2).alias("unhealthy"))


@query("decode_rate_sum", WITH_FRAMES + _COUNTER + " select strftime(date_trunc('minute', ts), '%Y%m%d%H%M') as minute, round(coalesce(sum(step), 0) / 60, 6) as rate from s group by all")
def decode_rate_sum(spark, sf):
    return counters(spark, sf).groupBy(_minute()).agg(F.round(F.coalesce(F.sum("step"), F.lit(0.0)) / 60, 6).alias("rate"))


@query("drop_ratio", WITH_FRAMES + "select stream_id, round(count(*) filter (event_id % 11 = 0) / (count(*) + 1e-9), 6) as ratio from frames group by 1")
def drop_ratio(spark, sf):
    """Dropped over dropped and published, safe where both are 0."""
    return frames(spark, sf).groupBy("stream_id").agg(F.round(F.count_if(F.col("event_id") % 11 == 0) / (F.count("*") + F.lit(1e-9)), 6).alias("ratio"))


@query("publish_drop_rates", WITH_FRAMES + f"select model_id, {_MINUTE} as minute, round(count(*) filter (event_id % 11 <> 0) / 60.0, 6) as published, round(count(*) filter (event_id % 11 = 0) / 60.0, 6) as dropped from frames group by all")
def publish_drop_rates(spark, sf):
    """Published and dropped a second, in each minute."""
    drop = F.col("event_id") % 11 == 0
    return frames(spark, sf).groupBy("model_id", _minute()).agg(F.round(F.count_if(~drop) / 60, 6).alias("published"), F.round(F.count_if(drop) / 60, 6).alias("dropped"))


@query("avg_batch", WITH_FRAMES + f"select model_id, {_MINUTE} as minute, round(sum(1 + event_id % 20) / count(*), 6) as size, round(count(*) / 60.0, 6) as batches_s from frames group by all")
def avg_batch(spark, sf):
    """Mean size and number a second of the batches of each minute."""
    return frames(spark, sf).groupBy("model_id", _minute()).agg(F.round(F.sum(1 + F.col("event_id") % 20) / F.count("*"), 6).alias("size"), F.round(F.count("*") / 60, 6).alias("batches_s"))


@query("batch_distribution", WITH_FRAMES + ", b as (select epoch_us(ts) // 120000000 as bucket, 1 + event_id % 20 as size from frames) select bucket, le, count(*) filter (size <= le) as n from b, (select unnest([1.0, 2, 4, 8, 16, 32, 'inf'::double]) as le) group by all")
def batch_distribution(spark, sf):
    bucket = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 120_000_000).alias("bucket")
    b = frames(spark, sf).select(bucket, (1 + F.col("event_id") % 20).alias("size"))
    return M.histogram(b, F.col("size"), "bucket", bounds=M.BATCH).select("bucket", "le", "n")


@query("stream_table", WITH_FRAMES + ", m as (select max(ts) as now from frames) select stream_id, arg_max(event_id % 6, frame_seq) as state, count(*) filter (model_id = 'click') as reconnects, max(event_id % 4) as failures, epoch_us(any_value(now)) - epoch_us(max(ts)) as age_us from frames, m group by 1")
def stream_table(spark, sf):
    """State, reconnects, failures and age of each stream in one row."""
    f = frames(spark, sf)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = f.groupBy("stream_id").agg(F.max_by(F.col("event_id") % 6, "frame_seq").alias("state"), F.count_if(F.col("model_id") == "click").alias("reconnects"), F.max(F.col("event_id") % 4).alias("failures"), F.max(us).alias("last"))
    return rows.join(F.broadcast(f.agg(F.max(us).alias("now"))), F.lit(True)).select("stream_id", "state", "reconnects", "failures", (F.col("now") - F.col("last")).alias("age_us"))


@query("label_values", WITH_FRAMES + "select distinct stream_id, model_id from frames where regexp_full_match(model_id, '.*')")
def label_values(spark, sf):
    return frames(spark, sf).where(F.col("model_id").rlike("^(?:.*)$")).select("stream_id", "model_id").distinct()


@query("stability_ratio", WITH_FRAMES + f", h as (select model_id, count(*)::double as n, {_counts}, sum(1 + event_id % 20) / count(*) as size from frames group by 1) select model_id, round((case {_case} else 1000.0 end) / size, 6) as ratio from h")
def stability_ratio(spark, sf):
    """p99 latency over mean batch size."""
    q = M.quantile(frames(spark, sf), F.col("latency_ms"), 0.99, "model_id")
    size = frames(spark, sf).groupBy("model_id").agg((F.sum(1 + F.col("event_id") % 20) / F.count("*")).alias("size"))
    return q.join(size, "model_id").select("model_id", F.round(F.col("q") / F.col("size"), 6).alias("ratio"))


@query("stream_age_failures", WITH_FRAMES + """, h as (select stream_id, epoch_us(ts) // 3600000000 as hour, max(epoch_us(ts)) as last, arg_max(event_id % 4, frame_seq) as failures from frames group by all),
n as (select *, lead(hour) over (partition by stream_id order by hour) as next from h), s as (select stream_id, unnest(range(hour, coalesce(next, hour + 1))) as hour, last, failures from n) select stream_id, hour, (hour + 1) * 3600000000 - last as age_us, failures from s""")
def stream_age_failures(spark, sf):
    """Age of the last frame and failures of each stream, read at the end of every hour; hours without frames go on with the last ones."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    h = frames(spark, sf).withColumn("us", us).groupBy("stream_id", F.floor(us / 3_600_000_000).alias("hour")).agg(F.max("us").alias("last"), F.max_by(F.col("event_id") % 4, "frame_seq").alias("failures"))
    after = F.coalesce(F.lead("hour").over(Window.partitionBy("stream_id").orderBy("hour")), F.col("hour") + 1)
    rows = h.withColumn("after", after).withColumn("hour", F.explode(F.sequence("hour", F.col("after") - 1)))
    return rows.select("stream_id", "hour", ((F.col("hour") + 1) * 3_600_000_000 - F.col("last")).alias("age_us"), "failures")


@query("archive_rates", WITH_FRAMES + f""", a as (select ts, event_id % 11 = 0 as dropped from frames where frame_seq % 2 = 0), e as (select {_MINUTE} as minute, case when dropped then 'dropped' else 'archived' end as kind from a
union all select strftime(date_trunc('minute', ts) + interval 3 day + interval 1 minute, '%Y%m%d%H%M'), 'deleted' from a where not dropped)
select minute, round(count(*) filter (kind = 'archived') / 60.0, 6) as archived, round(count(*) filter (kind = 'dropped') / 60.0, 6) as dropped, round(count(*) filter (kind = 'deleted') / 60.0, 6) as deleted from e group by 1""")
def archive_rates(spark, sf):
    """Frames archived, dropped and deleted a second, in each minute; a frame is deleted three days after its minute ends."""
    t, keep = F.col("ts").cast("timestamp_ntz"), F.col("event_id") % 11 != 0
    kind = lambda at, name: F.struct(at.alias("at"), F.lit(name).alias("kind"))
    gone = F.date_trunc("minute", t).cast("timestamp_ntz") + F.expr("interval 3 days 1 minute")
    each = F.when(keep, F.array(kind(t, "archived"), kind(gone, "deleted"))).otherwise(F.array(kind(t, "dropped")))
    e = frames(spark, sf).where("frame_seq % 2 = 0").select(F.explode(each).alias("e")).select("e.*")
    return e.groupBy(_minute("at")).agg(*[F.round(F.count_if(F.col("kind") == k) / 60, 6).alias(k) for k in ("archived", "dropped", "deleted")])


@query("archive_queue_depth", WITH_FRAMES + f"select {_MINUTE} as minute, arg_max(event_id % 50, (ts, event_id)) as depth from frames group by 1")
def archive_queue_depth(spark, sf):
    """The archive queue's depth, as last seen in each minute."""
    return frames(spark, sf).groupBy(_minute()).agg(F.max_by(F.col("event_id") % 50, F.struct("ts", "event_id")).alias("depth"))


@query("bucket_parse", WITH_FRAMES + "select event_id, case when event_id % 7 > 2 then epoch_us(date_trunc('minute', ts)) // 1000000 + 60 end as ends from frames")
def bucket_parse(spark, sf):
    """When the minute folders of archived frames end; folders with bad days, hours or minutes have no end."""
    t, n = F.col("ts").cast("timestamp"), F.col("event_id") % 7
    key = F.date_format(t, "yyyyMMdd/HH/mm")
    key = F.when(n == 0, F.regexp_replace(key, "/../", "/24/")).when(n == 1, F.concat(F.lit("x"), F.substring(key, 2, 20))).when(n == 2, F.concat(F.substring(key, 1, 12), F.lit("60"))).otherwise(key)
    part = F.split(key, "/")
    return frames(spark, sf).select("event_id", T.bucket_end(part[0], part[1], part[2]).alias("ends"))


@query("time_text", WITH_FRAMES + "select event_id, case when event_id % 2 = 0 then stream_id || ' ' else '' end || strftime(ts, '%Y-%m-%d %H:%M:%S.%g') as label from frames")
def time_text(spark, sf):
    """Time labels of frames, half of them with their stream."""
    stream = F.when(F.col("event_id") % 2 == 0, F.col("stream_id")).otherwise("")
    return frames(spark, sf).select("event_id", T.time_text(F.col("ts").cast("timestamp"), stream).alias("label"))


@query("stream_pool", "with r as (select event_id, user_id % 40 as stream from events), f as (select stream, min(event_id) as first from r group by 1), l as (select case when count(*) = 16 then max(first) end as full_at from (select first from f order by first limit 16)) select event_id, r.stream, case when event_id > full_at then 'limit' when event_id = first then 'added' else 'duplicate' end as outcome from r join f on r.stream = f.stream, l")
def stream_pool(spark, sf):
    """Requests to open 40 streams where 16 may be open."""
    from framewright.operators.admission import admit
    from framewright.plans.fixtures import table

    return admit(table(spark, sf, "events").select("event_id", (F.col("user_id") % 40).alias("stream")), "stream", "event_id", 16).select("event_id", "stream", "outcome")


_JSON = "'{\"stream_id\":\"' || stream_id || '\",\"frame_seq\":' || frame_seq || ',\"model_id\":\"' || model_id || '\"}'"


@query("kafka_json", WITH_FRAMES + f"select stream_id as key_, {_JSON} as value from frames")
def kafka_json(spark, sf):
    return frames(spark, sf).select(F.col("stream_id").alias("key_"), F.to_json(F.struct("stream_id", "frame_seq", "model_id")).alias("value"))


@query("redis_json", WITH_FRAMES + f"select 'inference:' || stream_id as stream_key, {_JSON} as data from frames")
def redis_json(spark, sf):
    return frames(spark, sf).select(F.concat(F.lit("inference:"), "stream_id").alias("stream_key"), F.to_json(F.struct("stream_id", "frame_seq", "model_id")).alias("data"))


_DETS = """, dets as (select frame_id, string_agg('{"attributes":' || case when idx = 0 then '{"color":"red"}' else '{}' end || ',"bbox":[' || x1 || ',' || y1 || ',' || x2 || ',' || y2 || '],"class_id":' || class_id || ',"class_name":"' || ['car', 'truck', 'bus', 'bike'][class_id + 1]
 || '","confidence":' || conf || case when idx % 2 = 0 then ',"track_id":' || (idx + 1) else '' end || '}', ',' order by idx) as d from detections group by 1)"""


def results(spark, sf):
    """Results of frames: orders as frames of 16 streams, some detections with a track number and attributes."""
    f = per_frame(spark, sf)
    attributes = lambda d: F.when(d["idx"] == 0, F.create_map(F.lit("color"), F.lit("red"))).otherwise(F.create_map().cast("map<string,string>"))
    names = F.array(*[F.lit(n) for n in ("car", "truck", "bus", "bike")])
    dets = F.transform("dets", lambda d: F.struct(attributes(d).alias("attributes"), d["class_id"].alias("class_id"), F.get(names, d["class_id"].cast("int")).alias("class_name"), d["conf"].alias("conf"), d["x1"].alias("x1"), d["y1"].alias("y1"), d["x2"].alias("x2"), d["y2"].alias("y2"), F.when(d["idx"] % 2 == 0, d["idx"] + 1).alias("track_id")))
    at = F.col("frame_id")
    return f.select(F.concat(F.lit("cam_"), (at % 16).cast("string")).alias("stream_id"), at.alias("frame_seq"), (at + 0.5).alias("frame_ts"), (at + 0.75).alias("infer_ts"), F.lit(250.0).alias("latency_ms"), F.lit("yolo").alias("model_id"), F.concat(F.lit("/data/"), at.cast("string"), F.lit(".jpg")).alias("frame_local_path"), F.concat(F.lit("http://a/"), at.cast("string")).alias("frame_url"), dets.alias("detections"))


@query("result_json", WITH_DETECTIONS + _DETS + """ select 'cam_' || frame_id % 16 as key_, '{"detections":[' || d || '],"frame_local_path":"/data/' || frame_id || '.jpg","frame_seq":' || frame_id || ',"frame_ts":' || (frame_id + 0.5)::double || ',"frame_url":"http://a/' || frame_id || '","infer_ts":' || (frame_id + 0.75)::double || ',"latency_ms":250.0,"model_id":"yolo","stream_id":"cam_' || frame_id % 16 || '"}' as value from dets""")
def result_json(spark, sf):
    """The whole result as sinks publish it, keys in order; a track number only where there is one."""
    return results(spark, sf).select(F.col("stream_id").alias("key_"), R.result_json().alias("value"))


@query("frame_message", WITH_DETECTIONS + """ select 'cam_' || frame_id % 16 as stream_id, frame_id as frame_seq, (frame_id + 0.5)::double as frame_ts, (frame_id + 0.75)::double as infer_ts, 250.0::double as latency_ms, 'yolo' as model_id, '/data/' || frame_id || '.jpg' as frame_local_path, 'http://a/' || frame_id as frame_url,
 idx as pos, class_id, ['car', 'truck', 'bus', 'bike'][class_id + 1] as class_name, conf as confidence, x1, y1, x2, y2, case when idx % 2 = 0 then idx + 1 else 0 end as track_id, case when idx = 0 then 'red' end as color from detections""")
def frame_message(spark, sf):
    """The frame message with its nine fields, its detections laid out as rows; track number 0 stands for none."""
    m = results(spark, sf).select("*", F.posexplode(R.frame_detections()).alias("pos", "d")).drop("detections")
    return m.select(*m.columns[:-2], F.col("pos").cast("bigint").alias("pos"), "d.class_id", "d.class_name", "d.confidence", "d.bbox.*", "d.track_id", F.try_element_at("d.attributes", F.lit("color")).alias("color"))


@query("frame_wire", WITH_DETECTIONS + """ select 'cam_' || frame_id % 16 as stream_id, frame_id as frame_seq, (frame_id + 0.5)::double as frame_ts, (frame_id + 0.75)::double as infer_ts, 250.0::double as latency_ms, 'yolo' as model_id, '/data/' || frame_id || '.jpg' as frame_local_path, 'http://a/' || frame_id as frame_url,
 idx as pos, class_id::int as class_id, ['car', 'truck', 'bus', 'bike'][class_id + 1] as class_name, conf::float::double as confidence, x1, y1, x2, y2, case when idx % 2 = 0 then idx + 1 else 0 end as track_id, case when idx = 0 then 'red' end as color from detections""")
def frame_wire(spark, sf):
    """The frame messages as bytes, read back and laid out as rows; confidences went through 32 bits."""
    from framewright.operators.messages import decode, encode

    m = decode(encode(results(spark, sf).withColumn("detections", R.frame_detections())))
    m = m.where("error is null").select("*", F.posexplode("detections").alias("pos", "d")).drop("detections", "error")
    box = [F.col(f"d.bbox.{c}").cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]
    return m.select(*m.columns[:-2], F.col("pos").cast("bigint").alias("pos"), "d.class_id", "d.class_name", F.col("d.confidence").cast("double").alias("confidence"), *box, "d.track_id", F.try_element_at("d.attributes", F.lit("color")).alias("color"))


@query("event_ids", WITH_FRAMES + "select stream_id || ':' || frame_seq as event_id, stream_id || ':' || frame_seq || '#tile' || (frame_seq + 1) as tile_id from frames")
def event_ids(spark, sf):
    event = F.concat_ws(":", "stream_id", F.col("frame_seq").cast("string"))
    return frames(spark, sf).select(event.alias("event_id"), F.concat(event, F.lit("#tile"), (F.col("frame_seq") + 1).cast("string")).alias("tile_id"))


@query("bytetrack")
def bytetrack(spark, sf):
    """Track numbers of detections: orders as frames of 16 streams."""
    from framewright.operators.tracking import track
    from framewright.plans.fixtures import detections

    d = detections(spark, sf).select((F.col("frame_id") % 16).alias("stream_id"), F.col("frame_id").alias("frame_seq"), "idx", "conf", "x1", "y1", "x2", "y2")
    return track(d)


@query("pipeline_graph", WITH_FRAMES + "select stream_id as key, '{\"stream_id\":\"' || stream_id || '\",\"frame_seq\":' || frame_seq || case when frame_seq % 4 = 0 then ',\"frame_url\":\"http://a/' || stream_id || '/' || frame_seq || '\"}' else '}' end as value from frames where frame_seq % 2 = 0 and stream_id in ('cam_01', 'cam_02')")
def pipeline_graph(spark, sf):
    """A declared pipeline: source, sample, stream filter, archive, publish."""
    from framewright.plans.dag import compile_pipeline

    stage = lambda i, t, **w: {"id": i, "type": t, "with": w}
    spec = {"nodes": [stage("in", "source.file"), stage("every", "sample.count", interval="2"), stage("two", "filter.streams", ids="cam_01, cam_02"), stage("keep", "archive.raw", base_url="http://a/", save_interval="4"), stage("out", "sink.publish")], "edges": [{"from": a, "to": b} for a, b in (("in", "every"), ("every", "two"), ("two", "keep"), ("keep", "out"))]}
    return compile_pipeline(spec, {"in": frames(spark, sf).select("stream_id", "frame_seq")})["out"]


_GRAPH_PAYLOAD = "string_agg(name || ':' || color, ';' order by conf desc, idx)"
_GRAPH_SQL = """f as (select 'cam_' || lpad(cast(vec_id % 16 as varchar), 2, '0') as stream_id, cast(vec_id as bigint) as frame_seq from embeddings),
k as (select vec_id as frame_seq, conf, idx, ['car', 'truck', 'bus', 'bike'][class_id + 1] as name, case when class_id in (0, 2) and (vec_id + idx) % 3 <> 0 then case when idx % 2 = 0 then 'red' else 'blue' end else '' end as color from flat),
n(node, publisher, prefix, least) as (values ('all', 'bus', '', 0.0), ('all', 'cache', 'p:', 0.0), ('strong', 'cache', 'p:', 0.9)),
o as (select frame_seq, node, count(*) as n, string_agg(name || ':' || color, ';' order by conf desc, idx) as payload from k, (select distinct node, least from n) m where conf >= least group by all)
select n.node, n.publisher, n.prefix || f.stream_id as key, f.frame_seq, coalesce(o.n, 0) as n, coalesce(o.payload, '') as payload from f cross join n left join o on o.frame_seq = f.frame_seq and o.node = n.node"""


def _graph_oracle() -> str:
    from framewright.plans.detection_queries import _OVER, _V8, _nms_sql

    return f"with {_V8}, {_nms_sql('d8', 'vec_id', _OVER)}, {_GRAPH_SQL}"


@query("declared_graph", _graph_oracle())
def declared_graph(spark, sf):
    """A declared detector graph: two sources united, an engine with a cascade, then all results to every publisher and the strong ones to a cache."""
    from framewright.plans.dag import compile_pipeline
    from framewright.plans.detection_queries import _scaled_tensor
    from framewright.plans.fixtures import tensors
    from framewright.plans.stages import Context

    stream = F.concat(F.lit("cam_"), F.lpad((F.col("vec_id") % 16).cast("string"), 2, "0")).alias("stream_id")
    seq_, tile = F.col("vec_id").cast("bigint").alias("frame_seq"), F.lit(0).cast("bigint").alias("tile")
    t = tensors(spark, sf)
    given = t.select(stream, seq_, tile, _scaled_tensor().alias("tensor"))
    said = t.select(stream, seq_, tile, "vec_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("idx")).where((F.col("vec_id") + F.col("idx")) % 3 != 0)
    answers = said.select("stream_id", "frame_seq", "tile", "idx", F.when(F.col("idx") % 2 == 0, "red").otherwise("blue").alias("label"))
    context = Context(
        models={"det": {"version": "v8", "names": ["car", "truck", "bus", "bike"], "anchors": 8, "cascade": [{"model_id": "color", "triggers": [0, 2], "attribute": "color"}]}, "color": {"version": "v8", "names": []}},
        outputs={"det": given}, answers={"color": answers}, publishers={"bus": {"type": "kafka"}, "cache": {"type": "redis", "prefix": "p"}},
    )
    node = lambda i, t, **w: {"id": i, "type": t, "with": w}
    spec = {
        "nodes": [node("even", "source.file"), node("odd", "source.rtsp"), node("det", "infer.engine", model_id="det"), node("sure", "filter.conf", threshold="0.9"), node("all", "sink.publish"), node("strong", "sink.publish", to="cache")],
        "edges": [{"from": a, "to": b} for a, b in (("even", "det"), ("odd", "det"), ("det", "all"), ("det", "sure"), ("sure", "strong"))],
    }
    f = t.select(stream, seq_, F.lit(1920).alias("width"), F.lit(1080).alias("height"))
    out = compile_pipeline(spec, {"even": f.where("frame_seq % 2 = 0"), "odd": f.where("frame_seq % 2 = 1")}, context)
    rows = out["all"].withColumn("node", F.lit("all")).unionByName(out["strong"].withColumn("node", F.lit("strong")))
    dets = F.from_json("value", "detections array<struct<class_name: string, attributes: map<string, string>>>")["detections"]
    rows = rows.select("node", "publisher", "key", "frame_seq", dets.alias("d"))
    one = lambda d: F.concat(d["class_name"], F.lit(":"), F.coalesce(d["attributes"]["color"], F.lit("")))
    return rows.select("node", "publisher", "key", "frame_seq", F.size("d").cast("bigint").alias("n"), F.array_join(F.transform("d", one), ";").alias("payload"))


@query("cascade_deadline", WITH_FRAMES + """, r as (select stream_id, frame_seq, ts as start, (event_id % 4)::bigint as expected from frames),
a as (select stream_id, frame_seq, start + to_microseconds(((frame_seq + j) % 6 * 5000 - 2000)::bigint) as came, j as idx from r, range(4) t(j) where (frame_seq + j) % 5 <> 0),
t as (select a.*, r.start, r.expected, row_number() over (partition by stream_id, frame_seq order by came, idx) as k from a join r using (stream_id, frame_seq) where a.came >= r.start and a.came < r.start + interval 20 milliseconds),
g as (select stream_id, frame_seq, count(*) as received, max(came) as last, string_agg(idx::varchar, ',' order by came, idx) filter (idx < 3) as answers from t where k <= expected group by 1, 2)
select r.stream_id, r.frame_seq, r.expected, coalesce(g.received, 0) as received, coalesce(answers, '') as answers, epoch_us(case when r.expected = 0 then r.start when g.received >= r.expected then g.last else r.start + interval 20 milliseconds end) - epoch_us(r.start) as waited_us from r left join g using (stream_id, frame_seq)""")
def cascade_deadline(spark, sf):
    """Primary results with the answers that came in 20 ms, emitted when complete or at the deadline."""
    from framewright.streaming.joins import cascade_deadline as merged

    results, answers = cascade_rows(spark, sf)
    out = merged(results, answers, 20).join(results.select("stream_id", "frame_seq", "at"), ["stream_id", "frame_seq"])
    waited = F.unix_micros("emitted") - F.unix_micros("at")
    return out.select("stream_id", "frame_seq", "expected", "received", F.array_join(F.transform("answers", lambda x: x["idx"].cast("string")), ",").alias("answers"), waited.alias("waited_us"))


def cascade_rows(spark, sf):
    """Results that expect up to three answers, and up to four answers each, some too early, some too late, one to no detection."""
    r = frames(spark, sf).select("stream_id", "frame_seq", F.col("ts").cast("timestamp").alias("at"), (F.col("event_id") % 4).cast("bigint").alias("expected"), F.lit(3).cast("bigint").alias("n_dets"))
    j = r.select("stream_id", "frame_seq", "at", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("idx")).where((F.col("frame_seq") + F.col("idx")) % 5 != 0)
    at = F.timestamp_micros(F.unix_micros("at") + (F.col("frame_seq") + F.col("idx")) % 6 * 5000 - 2000)
    return r, j.select("stream_id", "frame_seq", at.alias("at"), "idx", F.lit("color").alias("attribute"), F.lit("red").alias("label"))
