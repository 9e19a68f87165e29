"""Stages of declared pipelines: typed parameters with their checks, and what each stage makes of its rows.

Rows are frames: stream_id, frame_seq, ts, width and height, and whatever a source brings. A scheduler makes tile rows of them (tile, expected,
x, y, w, h); an engine joins the given outputs of its model by (stream_id, frame_seq, tile) and adds ``dets``, an array of detections; trackers,
merges and filters work on ``dets``; sinks end in rows of what would be sent or drawn. The same functions make batch and streaming plans,
where the plan's sources stream; stages that follow a stream's order row by row have a batch form only and say so.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions import geometry as G
from framewright.operators import decode, nms, results
from framewright.operators import sequential as S
from framewright.operators import tracking

TRUE, FALSE = ("true", "1", "yes", "on"), ("false", "0", "no", "off")
_DET = "struct<idx: bigint, class_id: bigint, conf: double, x1: double, y1: double, x2: double, y2: double, class_name: string, track_id: bigint, attributes: map<string, string>>"


@dataclass
class Context:
    """What a pipeline finds around it: models by id, their given outputs (stream_id, frame_seq, tile, tensor), answers of secondary models
    (stream_id, frame_seq, tile, idx, label), and publishers by id, each with its type."""

    models: dict[str, dict] = field(default_factory=dict)
    outputs: dict[str, DataFrame] = field(default_factory=dict)
    answers: dict[str, DataFrame] = field(default_factory=dict)
    publishers: dict[str, dict] = field(default_factory=dict)


@dataclass(frozen=True)
class Param:
    """A parameter given as text: its kind, default (None: it must be given) and check."""

    kind: type
    default: object = None
    check: Callable[[object], bool] = lambda x: True
    rule: str = ""

    def read(self, stage: str, name: str, text) -> object:
        if text is None or text == "":
            if self.default is None:
                raise ValueError(f"{stage} requires with.{name}")
            return self.default
        text = str(text)
        try:
            value = text in TRUE if self.kind is bool else self.kind(text)
        except ValueError:
            raise ValueError(f"{stage} {name}: {text} is no {self.kind.__name__}") from None
        if self.kind is bool and text not in TRUE + FALSE:
            raise ValueError(f"{stage} {name}: {text} is no bool")
        if not self.check(value):
            raise ValueError(f"{stage} {name} must be {self.rule}")
        return value


_POSITIVE = {"check": lambda x: x >= 1, "rule": ">= 1"}
_SHARE = {"check": lambda x: 0 < x <= 1, "rule": "in (0, 1]"}
_SCREEN = {
    "fps": Param(float, 25.0, lambda x: x > 0, "> 0"), "queue_capacity": Param(int, 8, **_POSITIVE), "reconnect_initial_ms": Param(int, 500, **_POSITIVE), "reconnect_max_ms": Param(int, 10_000, **_POSITIVE),
    "draw_conf_thresh": Param(float, 0.0), "line_thickness": Param(int, 2), "draw_timestamp": Param(bool, True), "draw_timestamp_with_stream_id": Param(bool, True),
    "drop_policy": Param(str, "drop_oldest", lambda x: x in ("drop_oldest", "drop_newest"), "one of: drop_oldest, drop_newest"),
}

PARAMS: dict[str, dict[str, Param]] = {}
STAGES: dict[str, Callable[[DataFrame, dict, Context], DataFrame]] = {}
CHECKS: dict[str, Callable[[dict, Context], None]] = {}


def stage(kind: str, check: Callable[[dict, Context], None] | None = None, **params: Param):
    def keep(f):
        PARAMS[kind], STAGES[kind] = params, f
        if check:
            CHECKS[kind] = check
        return f

    return keep


def read_params(kind: str, given: dict, context: Context) -> dict:
    """The parameters of a stage with defaults; ValueError for an unknown stage, a bad value or an unknown model or publisher. Other keys are ignored."""
    if kind not in STAGES:
        raise ValueError(f"unsupported stage type: {kind}")
    out = {name: p.read(kind, name, given.get(name)) for name, p in PARAMS[kind].items()}
    if "reconnect_max_ms" in out and out["reconnect_max_ms"] < out["reconnect_initial_ms"]:
        raise ValueError(f"{kind} reconnect settings invalid")
    if kind in CHECKS:
        CHECKS[kind](out, context)
    return out


def _batch_only(df: DataFrame, kind: str) -> None:
    if df.isStreaming:
        raise ValueError(f"{kind} follows each stream row by row and has no streaming form here")


# sources


@stage("source.rtsp", sample_interval=Param(int, 1, **_POSITIVE))
def _live(df: DataFrame, p: dict, context: Context) -> DataFrame:
    return df.where(F.col("frame_seq") % p["sample_interval"] == 0) if p["sample_interval"] > 1 else df


@stage("source.file", loop=Param(bool, False), epochs=Param(int, 1, **_POSITIVE), frames=Param(int, 0, lambda x: x >= 0, ">= 0"))
def _file(df: DataFrame, p: dict, context: Context) -> DataFrame:
    """With loop, the file's ``frames`` frames come ``epochs`` times with numbers that go on."""
    if not p["loop"]:
        return df
    if not p["frames"]:
        raise ValueError("source.file with loop requires with.frames")
    return df.withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.lit(p["epochs"] - 1)))).withColumn("frame_seq", F.col("frame_seq") + F.col("_epoch") * p["frames"]).drop("_epoch")


# filters and archive


@stage("filter.conf", threshold=Param(float, 0.4))
def _conf(df: DataFrame, p: dict, context: Context) -> DataFrame:
    """Detections of a confidence of ``threshold`` or more; rows that are detections themselves are kept or go."""
    if "dets" in df.columns:
        return df.withColumn("dets", F.filter("dets", lambda d: d["conf"] >= p["threshold"]))
    return df.where(F.col("conf") >= p["threshold"])


@stage("sample.count", interval=Param(int, 1, **_POSITIVE))
def _count(df: DataFrame, p: dict, context: Context) -> DataFrame:
    return df.where(F.col("frame_seq") % p["interval"] == 0)


@stage("sample.time", gap_us=Param(int, 200_000, **_POSITIVE))
def _time(df: DataFrame, p: dict, context: Context) -> DataFrame:
    _batch_only(df, "sample.time")
    kept = S.sample_by_time(df, F.unix_micros(F.col("ts").cast("timestamp")), p["gap_us"])
    last = kept.columns[-1]
    return df.join(kept.where(F.col(last)).select("stream_id", "frame_seq"), ["stream_id", "frame_seq"], "left_semi")


@stage("filter.streams", ids=Param(str, "all", lambda x: True))
def _streams(df: DataFrame, p: dict, context: Context) -> DataFrame:
    names = [] if p["ids"] == "all" else [x for x in p["ids"].replace(" ", "").split(",") if x]
    return df.where(F.col("stream_id").isin(names)) if names else df


@stage("archive.raw", base_url=Param(str, "http://localhost/"), save_interval=Param(int, 1, **_POSITIVE))
def _archive(df: DataFrame, p: dict, context: Context) -> DataFrame:
    at = F.col("frame_seq") % p["save_interval"] == 0
    return df.withColumn("frame_url", F.when(at, F.concat_ws("/", F.rtrim(F.lit(p["base_url"]), F.lit("/")), "stream_id", F.col("frame_seq").cast("string"))))


# engines and cascades


def _known_models(p: dict, context: Context) -> None:
    model = context.models.get(p["model_id"])
    if model is None:
        raise ValueError(f"infer.engine model not found: {p['model_id']}")
    for rule in model.get("cascade", []):
        if rule["model_id"] not in context.models:
            raise ValueError(f"infer.engine cascade secondary model not found: {rule['model_id']}")


def _decoded(model: dict):
    wide, high = model.get("input", (640, 640))
    classes, conf = len(model["names"]), model.get("conf", 0.4)
    if model["version"] == "v5":
        return decode.v5(F.col("tensor"), model["rows"], classes, conf, wide, high)
    if model["version"] == "v26":
        return decode.v26(F.col("tensor"), model["rows"], conf, wide, high)
    return decode.v8(F.col("tensor"), classes, model["anchors"], conf, wide, high)


@stage("infer.engine", _known_models, model_id=Param(str))
def _engine(df: DataFrame, p: dict, context: Context) -> DataFrame:
    """Rows with ``dets``: the model's given outputs are decoded, suppressed, put on the frame's scale and named; rows without an output go.

    Cascade rules send detections of their classes to a secondary model; its answers stand in the detection's attributes."""
    model = context.models[p["model_id"]]
    wide, high = model.get("input", (640, 640))
    if "tile" not in df.columns:
        df = df.withColumn("tile", F.lit(0).cast("bigint"))
    keys = ["stream_id", "frame_seq", "tile"]
    out = df.join(context.outputs[p["model_id"]].select(*keys, "tensor"), keys)
    w, h = (F.col(c) if c in out.columns else F.col(full) for c, full in (("w", "width"), ("h", "height")))
    dets = _decoded(model)
    if model["version"] != "v26":
        dets = nms.suppress(dets, model.get("nms", 0.45))
    out = out.withColumn("dets", dets).drop("tensor")
    names = F.array(*map(F.lit, model["names"]))
    rules = [(r["attribute"], r.get("triggers", []), context.answers[r["model_id"]]) for r in model.get("cascade", []) if r["model_id"] in context.answers]
    attributes = lambda d: F.create_map().cast("map<string, string>")
    if rules:
        said = None
        for attribute, _, answers in rules:
            one = answers.select(*keys, F.struct(F.col("idx").cast("bigint").alias("idx"), F.lit(attribute).alias("attribute"), "label").alias("said"))
            said = one if said is None else said.unionByName(one)
        out = out.join(said.groupBy(*keys).agg(F.collect_list("said").alias("said")), keys, "left")  # as many as a frame has detections and rules

        def meant(d, s):
            fits = F.lit(False)
            for attribute, triggers, _ in rules:
                fits = fits | ((s["attribute"] == attribute) & (d["class_id"].isin(triggers) if triggers else F.lit(True)))
            return (s["idx"] == d["idx"]) & fits

        def attributes(d):
            own = F.filter(F.coalesce("said", F.array().cast("array<struct<idx: bigint, attribute: string, label: string>>")), lambda s: meant(d, s))
            return F.map_from_entries(F.transform(own, lambda s: F.struct(s["attribute"], s["label"])))

    sx, sy = w / float(wide), h / float(high)

    def finished(d):
        return F.struct(d["idx"].alias("idx"), d["class_id"].alias("class_id"), d["conf"].alias("conf"), (d["x1"] * sx).alias("x1"), (d["y1"] * sy).alias("y1"), (d["x2"] * sx).alias("x2"), (d["y2"] * sy).alias("y2"), decode.class_name(names, d["class_id"]).alias("class_name"), F.lit(None).cast("bigint").alias("track_id"), attributes(d).alias("attributes"))

    return out.withColumn("dets", F.transform("dets", finished)).withColumn("model_id", F.lit(p["model_id"])).drop("said")


# tiles


@stage("infer.sahiScheduler", tile_width=Param(int, 640, **_POSITIVE), tile_height=Param(int, 640, **_POSITIVE), overlap_ratio=Param(float, 0.2), full_interval=Param(int, 5, **_POSITIVE), roi_expand_ratio=Param(float, 0.2), max_tiles_per_frame=Param(int, 64, **_POSITIVE), min_roi_width=Param(int, 256), fallback_full_min_gap_frames=Param(int, 5))
def _scheduler(df: DataFrame, p: dict, context: Context) -> DataFrame:
    """Tile rows of each frame: the whole grid on full passes, windows around ``rois`` where the frame has any, else one tile or a throttled full pass."""
    _batch_only(df, "infer.sahiScheduler")
    rois = F.col("rois") if "rois" in df.columns else F.array().cast("array<struct<x1: double, y1: double, x2: double, y2: double>>")
    df = df.withColumn("rois", F.coalesce(rois, F.array().cast(df.schema["rois"].dataType if "rois" in df.columns else "array<struct<x1: double, y1: double, x2: double, y2: double>>")))
    kinds = S.throttle(df, F.size("rois") == 0, p["fallback_full_min_gap_frames"], p["full_interval"])
    kinds = kinds.select("stream_id", "frame_seq", F.col(kinds.columns[-1]).alias("kind"))
    rows = df.join(kinds, ["stream_id", "frame_seq"])
    w, h = F.col("width"), F.col("height")
    whole = F.array(F.struct(F.lit(0).alias("y"), F.lit(0).alias("x"), w.alias("w"), h.alias("h")))
    grid = G.tiles(w, h, p["tile_width"], p["tile_height"], p["overlap_ratio"], p["overlap_ratio"])
    windows = F.transform("rois", lambda b: G.roi_window(b, p["roi_expand_ratio"], p["min_roi_width"], w, h))
    tiles = F.slice(F.when(F.col("kind").isin("full", "fallback"), grid).when(F.col("kind") == "roi", windows).otherwise(whole), 1, p["max_tiles_per_frame"])
    rows = rows.withColumn("tiles", tiles).withColumn("expected", F.size("tiles").cast("bigint"))
    return rows.select(*[c for c in rows.columns if c not in ("tiles", "rois")], F.posexplode("tiles").alias("tile", "_t")).withColumn("tile", F.col("tile").cast("bigint")).select("*", "_t.x", "_t.y", "_t.w", "_t.h").drop("_t")


@stage("post.sahiMerge", merge_iou=Param(float, 0.55, **_SHARE), merge_ios=Param(float, 0.8, **_SHARE), stale_timeout_ms=Param(int, 2000, **_POSITIVE))
def _merge(df: DataFrame, p: dict, context: Context) -> DataFrame:
    """Frames of which every tile came: detections moved to their tile's place and suppressed across tiles. Streams give up on a frame
    when no tile of it came for ``stale_timeout_ms`` of event time."""
    shifted = F.transform("dets", lambda d: G.shifted(d, F.col("x").cast("double"), F.col("y").cast("double")))
    rows = df.withColumn("dets", shifted)
    keys: list = ["stream_id", "frame_seq"]
    if df.isStreaming:
        stale = f"{p['stale_timeout_ms']} milliseconds"
        rows = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", stale)
        keys.append(F.session_window("ts", stale))
    held = F.array_sort(F.collect_list(F.struct("tile", "dets")), lambda a, b: (a["tile"] - b["tile"]).cast("int"))
    rest = [F.first(c).alias(c) for c in ("ts", "width", "height", "model_id", "frame_url") if c in df.columns]
    out = rows.groupBy(*keys).agg(F.count_distinct("tile").alias("n") if not df.isStreaming else F.count(F.lit(1)).alias("n"), F.max("expected").alias("expected"), held.alias("held"), *rest).where("n >= expected")
    flat = F.flatten(F.transform("held", lambda t: t["dets"]))
    numbered = F.transform(flat, lambda d, i: d.withField("idx", i.cast("bigint")))
    return out.withColumn("dets", nms.suppress_tiles(numbered, p["merge_iou"], p["merge_ios"])).drop("held", "n", "expected", "session_window")


# tracking


@stage("track.bytetrack", high_det_thresh=Param(float, 0.5), low_det_thresh=Param(float, 0.1), match_iou_thresh=Param(float, 0.3), min_hits_to_confirm=Param(int, 2), max_lost_frames=Param(int, 30))
def _track(df: DataFrame, p: dict, context: Context) -> DataFrame:
    _batch_only(df, "track.bytetrack")
    config = tracking.Config(**{name: p[k] for k, name in (("high_det_thresh", "high"), ("low_det_thresh", "low"), ("match_iou_thresh", "min_iou"), ("min_hits_to_confirm", "min_hits"), ("max_lost_frames", "max_lost"))})
    flat = df.select("stream_id", "frame_seq", F.explode("dets").alias("d")).select("stream_id", "frame_seq", "d.*")
    numbers = tracking.track(flat, config).groupBy("stream_id", "frame_seq").agg(F.map_from_entries(F.collect_list(F.struct("idx", "track_id"))).alias("_ids"))
    rows = df.join(numbers, ["stream_id", "frame_seq"], "left")
    return rows.withColumn("dets", F.transform("dets", lambda d: d.withField("track_id", F.col("_ids")[d["idx"]]))).drop("_ids")


# sinks


def _known_publishers(p: dict, context: Context) -> None:
    p["to"] = [x for x in p["to"].replace(" ", "").split(",") if x] or list(context.publishers)
    for name in p["to"]:
        if context.publishers and name not in context.publishers:
            raise ValueError(f"sink.publish: unknown publisher id '{name}'")


@stage("sink.publish", _known_publishers, to=Param(str, ",", lambda x: True))
def _publish(df: DataFrame, p: dict, context: Context) -> DataFrame:
    """(publisher, key, value) of each row for each of the publishers ``to``, all by default: the result's JSON for brokers and caches, whose keys have their prefix.

    Without any publishers around, (key, value) with all columns of the row."""
    if not context.publishers:
        return df.select(F.col("stream_id").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))
    lacking = {"dets": f"array<{_DET}>", "frame_local_path": "string", "frame_url": "string", "model_id": "string", "infer_ts": "double", "latency_ms": "double", "frame_ts": "double"}
    for name, kind in lacking.items():
        if name not in df.columns:
            at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 if name == "frame_ts" and "ts" in df.columns else F.lit(None)
            df = df.withColumn(name, at.cast(kind))
    row = df.withColumn("_value", results.result_json("dets"))
    targets = []
    for name in p["to"]:
        own = context.publishers[name]
        key = F.concat(F.lit(own["prefix"] + ":"), "stream_id") if own.get("prefix") else F.col("stream_id")
        targets.append(F.struct(F.lit(name).alias("publisher"), key.alias("key"), F.col("_value").alias("value")))
    return row.select("frame_seq", F.explode(F.array(*targets)).alias("x")).select("x.publisher", "x.key", "frame_seq", "x.value")


def _overlay(df: DataFrame, p: dict, context: Context) -> DataFrame:
    """What a sink of pictures would draw: rectangles in the frame with name and confidence, of detections at ``draw_conf_thresh`` or more."""
    drawn = F.filter("dets", lambda d: d["conf"] >= p["draw_conf_thresh"])
    label = lambda d: F.concat_ws(" ", d["class_name"], F.format_number(d["conf"], 2))
    return df.select("stream_id", "frame_seq", F.transform(drawn, lambda d: F.struct(G.draw_rect(d, F.col("width"), F.col("height")).alias("rect"), label(d).alias("label"))).alias("overlay"))


stage("sink.ffplay", **_SCREEN)(_overlay)


def _safe_url(p: dict, context: Context) -> None:
    if any(c in p["output_url"] for c in "\"'`$;|&<>\\\n\r\t "):
        raise ValueError("sink.stream output_url holds characters that a shell reads")


stage(
    "sink.stream", _safe_url, **_SCREEN, output_url=Param(str), gop=Param(int, 0, lambda x: x >= 0, ">= 0"), bitrate_kbps=Param(int, 4000),
    protocol=Param(str, "rtsp", lambda x: x in ("rtsp", "rtmp"), "one of: rtsp, rtmp"), encoder=Param(str, "ffmpeg_x264", lambda x: x == "ffmpeg_x264", "ffmpeg_x264, the only one without an accelerator"),
)(_overlay)
