"""Queries over detections and model outputs: decoding, gates, geometry, suppression, cascades, tiles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framewright.functions import geometry as G
from framewright.operators import decode, nms
from framewright.plans.fixtures import WITH_DETECTIONS, detections, per_frame, table, tensors
from framewright.plans.registry import query

BOX = ("x1", "y1", "x2", "y2")
NAMES = ["car", "truck", "bus", "bike"]


def names():
    return F.array(*[F.lit(n) for n in NAMES])


def _rounded(df, *keys):
    """One row a detection of column d, its numbers rounded to six places."""
    return df.select(*keys, "d.idx", "d.class_id", *[F.round(f"d.{c}", 6).alias(c) for c in ("conf", *BOX)])


def _each(df):
    """A row for each of a tensor's ``dets``. The outer form adds no filter on their number, which would decode every tensor once more."""
    return df.select("vec_id", F.explode_outer("dets").alias("d")).where("d is not null")


def _scaled_tensor():
    """Signed values to coordinates and scores of a v8 tensor: centres, sizes, class scores."""
    return F.transform("v", lambda x, i: F.abs(x) * F.when(i < 16, 1000.0).when(i < 32, 6000.0).otherwise(3.0))


_V8 = """t as (select vec_id, list_transform(embedding::double[], lambda x, i: abs(x) * case when i <= 16 then 1000.0 when i <= 32 then 6000.0 else 3.0 end) as v from embeddings),
a as (select vec_id, j, v[j + 1] as cx, v[8 + j + 1] as cy, v[16 + j + 1] as w, v[24 + j + 1] as h, [v[32 + j + 1], v[40 + j + 1], v[48 + j + 1], v[56 + j + 1]] as s from t, range(8) r(j)),
d8 as materialized (select vec_id, j as idx, cast(list_position(s, list_max(s)) - 1 as bigint) as class_id, list_max(s) as conf, greatest(0, cx - w / 2) as x1, greatest(0, cy - h / 2) as y1,
  least(640.0, cx + w / 2) as x2, least(640.0, cy + h / 2) as y2 from a where list_max(s) >= 0.4)"""
_OUT = "idx, class_id, round(conf, 6) as conf, round(x1, 6) as x1, round(y1, 6) as y1, round(x2, 6) as x2, round(y2, 6) as y2"
_INTER = "greatest(0.0, least(k.x2, d.x2) - greatest(k.x1, d.x1)) * greatest(0.0, least(k.y2, d.y2) - greatest(k.y1, d.y1))"
_AREA = "({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1)"
_STRUCT = "{'idx': idx, 'class_id': class_id, 'conf': conf, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}"


def _nms_sql(source: str, key: str, test: str) -> str:
    return f"""lists as (select {key}, list({_STRUCT} order by conf desc, idx) as l from {source} group by {key}),
kept as (select {key}, list_reduce(list_transform(l, lambda e: [e]), lambda kept, n: case when len(list_filter(kept, lambda k: ({test.replace("d.", "n[1].")}))) > 0 then kept else list_concat(kept, n) end) as l from lists),
flat as (select {key}, unnest(l, recursive := true) from kept)"""


_OVER = f"({_INTER}) > 0 and ({_INTER}) > 0.45 * ({_AREA.format('k')} + {_AREA.format('d')} - ({_INTER}))"
_TILE = f"k.class_id = d.class_id and ((({_AREA.format('k')} + {_AREA.format('d')} - ({_INTER})) > 0 and ({_INTER}) >= 0.55 * ({_AREA.format('k')} + {_AREA.format('d')} - ({_INTER}))) or (least({_AREA.format('k')}, {_AREA.format('d')}) > 0 and ({_INTER}) >= 0.8 * least({_AREA.format('k')}, {_AREA.format('d')})))"


def v8_detections(spark, sf):
    """The scaled tensor is a column of its own, so that the decoder's accesses read it instead of working it out again."""
    return tensors(spark, sf).select("vec_id", _scaled_tensor().alias("v")).select("vec_id", decode.v8(F.col("v"), 4, 8, 0.4).alias("dets"))


@query("conf_filter_v8", f"with {_V8} select vec_id, {_OUT} from d8")
def conf_filter_v8(spark, sf):
    """Best class probability at the threshold or more."""
    return _rounded(_each(v8_detections(spark, sf)), "vec_id")


@query(
    "conf_filter_v5",
    f"""with t as (select vec_id, list_transform(embedding::double[], lambda x: abs(x) * 3) as v from embeddings),
p as (select *, len(list_filter(range(8), lambda j: greatest(v[j*8+1], v[j*8+2], v[j*8+3], v[j*8+4]) > 1.5)) > 0 as px from t),
a as (select vec_id, j as idx, case when px then 1.0 else 640.0 end as s, v[j*8+1] as cx, v[j*8+2] as cy, v[j*8+3] as w, v[j*8+4] as h, v[j*8+5] as obj, [v[j*8+6], v[j*8+7], v[j*8+8]] as c from p, range(8) r(j)),
d as (select vec_id, idx, cast(list_position(c, list_max(c)) - 1 as bigint) as class_id, obj * list_max(c) as conf, obj, greatest(0, cx*s - w*s/2) as x1, greatest(0, cy*s - h*s/2) as y1, least(640.0, cx*s + w*s/2) as x2, least(640.0, cy*s + h*s/2) as y2 from a)
select vec_id, {_OUT} from d where obj >= 0.4 and conf >= 0.4""",
)
def conf_filter_v5(spark, sf):
    """Objectness gate, then objectness times class."""
    v = tensors(spark, sf).select("vec_id", F.transform("v", lambda x: F.abs(x) * 3).alias("v"))
    return _rounded(_each(v.select("vec_id", decode.v5(F.col("v"), 8, 3, 0.4).alias("dets"))), "vec_id")


@query(
    "conf_filter_v26",
    f"""with t as (select vec_id, list_transform(embedding::double[], lambda x, i: case when (i - 1) % 6 < 4 then x * 2000 when (i - 1) % 6 = 4 then abs(x) * 3 else abs(x) * 20 end) as v from embeddings),
a as (select vec_id, j as idx, cast(round(v[j*6+6]) as bigint) as class_id, v[j*6+5] as conf, least(640.0, greatest(0.0, v[j*6+1])) as x1, least(640.0, greatest(0.0, v[j*6+2])) as y1, least(640.0, greatest(0.0, v[j*6+3])) as x2, least(640.0, greatest(0.0, v[j*6+4])) as y2 from t, range(10) r(j))
select vec_id, {_OUT} from a where conf >= 0.4""",
)
def conf_filter_v26(spark, sf):
    """Six values a row; the gate also drops padding; no suppression."""
    v = tensors(spark, sf).select("vec_id", F.transform("v", lambda x, i: F.when(i % 6 < 4, x * 2000).when(i % 6 == 4, F.abs(x) * 3).otherwise(F.abs(x) * 20)).alias("v"))
    return _rounded(_each(v.select("vec_id", decode.v26(F.col("v"), 10, 0.4).alias("dets"))), "vec_id")


@query("classifier_gate", "with t as (select vec_id, embedding::double[] as v from embeddings) select vec_id, cast(list_position(v, list_max(v)) - 1 as bigint) as class_id, round(list_max(v), 6) as conf from t where list_max(v) >= 0.3")
def classifier_gate(spark, sf):
    """Top class at the threshold or more, else nothing."""
    return tensors(spark, sf).select("vec_id", F.explode(decode.classify(F.col("v"), 0.3)).alias("d")).select("vec_id", "d.class_id", F.round("d.conf", 6).alias("conf"))


@query("argmax_class", "select vec_id, cast(list_position(embedding, list_max(embedding)) - 1 as bigint) as class_id from embeddings")
def argmax_class(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", (F.array_position("embedding", F.array_max("embedding")) - 1).alias("class_id"))


@query("nms", WITH_DETECTIONS + ", " + _nms_sql("detections", "frame_id", _OVER) + " select frame_id, idx, class_id, conf from flat")
def suppressed(spark, sf):
    """Class-agnostic greedy suppression per frame."""
    return per_frame(spark, sf).select("frame_id", F.explode(nms.suppress(F.col("dets"), 0.45)).alias("d")).select("frame_id", "d.idx", "d.class_id", "d.conf")


@query("sahi_nms", WITH_DETECTIONS + ", " + _nms_sql("detections", "frame_id", _TILE) + " select frame_id, idx, class_id, conf from flat")
def suppressed_tiles(spark, sf):
    """Class-aware suppression by IoU or intersection over the smaller box."""
    return per_frame(spark, sf).select("frame_id", F.explode(nms.suppress_tiles(F.col("dets"))).alias("d")).select("frame_id", "d.idx", "d.class_id", "d.conf")


@query(
    "iou_pairs",
    WITH_DETECTIONS
    + f""", p as (select k.frame_id, k.idx as a, d.idx as b, {_INTER} as i, {_AREA.format('k')} as ka, {_AREA.format('d')} as da from detections k join detections d on k.frame_id = d.frame_id and k.idx < d.idx)
select frame_id, a, b, round(case when i = 0 then 0 else i / (ka + da - i) end, 6) as iou, round(i / greatest(ka + da - i, 1e-6), 6) as iou_tracker, round(case when ka + da - i <= 0 then 0 else i / (ka + da - i) end, 6) as iou_tiles, round(case when least(ka, da) <= 0 then 0 else i / least(ka, da) end, 6) as ios from p""",
)
def iou_pairs(spark, sf):
    """Every pair of a frame's detections; pairs stay inside the frame's row, so a frame costs its own square only."""
    f = per_frame(spark, sf)
    pairs = f.select("frame_id", "dets", F.explode("dets").alias("p")).select("frame_id", "p", F.explode(F.filter("dets", lambda d: d["idx"] > F.col("p.idx"))).alias("q"))
    p, q = F.col("p"), F.col("q")
    return pairs.select("frame_id", F.col("p.idx").alias("a"), F.col("q.idx").alias("b"), F.round(G.iou(p, q), 6).alias("iou"), F.round(G.iou(p, q, "tracker"), 6).alias("iou_tracker"), F.round(G.iou(p, q, "tiles"), 6).alias("iou_tiles"), F.round(G.ios(p, q), 6).alias("ios"))


@query("bbox_measures", WITH_DETECTIONS + "select frame_id, idx, x2 - x1 as width, y2 - y1 as height, (x2 - x1) * (y2 - y1) as area from detections")
def bbox_measures(spark, sf):
    b = F.struct(*BOX)
    return detections(spark, sf).select("frame_id", "idx", G.width(b).alias("width"), G.height(b).alias("height"), G.area(b).alias("area"))


@query("scale_boxes", WITH_DETECTIONS + "select frame_id, idx, round(greatest(0.0, x1 * 3), 6) as x1, round(greatest(0.0, y1 * 1.6875), 6) as y1, round(greatest(0.0, x2 * 3), 6) as x2, round(greatest(0.0, y2 * 1.6875), 6) as y2 from detections")
def scale_boxes(spark, sf):
    b = G.scaled(F.col("b"), 1920 / 640, 1080 / 640)
    return detections(spark, sf).select("frame_id", "idx", F.struct(*BOX).alias("b")).select("frame_id", "idx", b.alias("b")).select("frame_id", "idx", *[F.round(f"b.{c}", 6).alias(c) for c in BOX])


@query("tile_offset", WITH_DETECTIONS + "select frame_id, idx, x1 + 960 as x1, y1 + 540 as y1, x2 + 960 as x2, y2 + 540 as y2 from detections")
def tile_offset(spark, sf):
    return detections(spark, sf).select("frame_id", "idx", G.shifted(F.struct(*BOX), 960, 540).alias("b")).select("frame_id", "idx", "b.*")


@query("draw_filter", WITH_DETECTIONS + """, r as (select *, greatest(0, cast(floor(x1) as int)) as x, greatest(0, cast(floor(y1) as int)) as y, least(350, cast(ceil(x2) as int)) - greatest(0, cast(floor(x1) as int)) as w, least(250, cast(ceil(y2) as int)) - greatest(0, cast(floor(y1) as int)) as h from detections where conf >= 0.5)
select frame_id, idx, x, y, w, h from r where w > 0 and h > 0""")
def draw_filter(spark, sf):
    """Confident detections whose rectangle is not empty inside a frame of 350 by 250."""
    return detections(spark, sf).where("conf >= 0.5").select("frame_id", "idx", G.draw_rect(F.struct(*BOX), 350, 250).alias("r")).where("r.w > 0 and r.h > 0").select("frame_id", "idx", "r.*")


@query("conf_split", WITH_DETECTIONS + "select case when conf >= 0.5 then 'high' when conf >= 0.1 then 'low' else 'discard' end as part, count(*) as n from detections group by 1")
def conf_split(spark, sf):
    part = F.when(F.col("conf") >= 0.5, "high").when(F.col("conf") >= 0.1, "low").otherwise("discard")
    return detections(spark, sf).groupBy(part.alias("part")).agg(F.count("*").alias("n"))


@query("class_name_lookup", WITH_DETECTIONS + "select frame_id, idx, case when class_id < 3 then ['car', 'truck', 'bus'][class_id + 1] else '' end as class_name, case when class_id < 3 then ['car', 'truck', 'bus'][class_id + 1] else cast(class_id as varchar) end as classifier_name from detections")
def class_name_lookup(spark, sf):
    three = F.slice(names(), 1, 3)
    return detections(spark, sf).select("frame_id", "idx", decode.class_name(three, F.col("class_id")).alias("class_name"), decode.class_name(three, F.col("class_id"), True).alias("classifier_name"))


@query("draw_label", WITH_DETECTIONS + "select frame_id, idx, case when class_id < 2 then ['car', 'truck'][class_id + 1] else 'cls_' || class_id end || ' ' || cast(trunc(conf * 100) as int) || '%' || case when idx % 2 = 0 then ' #' || frame_id else '' end as label from detections")
def draw_label(spark, sf):
    """Name or class number, whole percent, track number if there is one."""
    name = F.when(F.col("class_id") < 2, F.get(names(), F.col("class_id").cast("int"))).otherwise(F.concat(F.lit("cls_"), F.col("class_id").cast("string")))
    track = F.when(F.col("idx") % 2 == 0, F.concat(F.lit(" #"), F.col("frame_id").cast("string"))).otherwise("")
    return detections(spark, sf).select("frame_id", "idx", F.concat(name, F.lit(" "), (F.col("conf") * 100).cast("int").cast("string"), F.lit("%"), track).alias("label"))


@query("crop_rect", WITH_DETECTIONS + """, e as (select *, (x2 - x1) * 0.1 as dx, (y2 - y1) * 0.1 as dy from detections), c as (select frame_id, idx, greatest(0, least(cast(trunc(x1 - dx) as int), 399)) as x, greatest(0, least(cast(trunc(y1 - dy) as int), 299)) as y, least(400, cast(trunc(x2 + dx) as int)) as r, least(300, cast(trunc(y2 + dy) as int)) as b from e)
select frame_id, idx, x, y, greatest(1, r - x) as w, greatest(1, b - y) as h from c""")
def crop_rect(spark, sf):
    return detections(spark, sf).select("frame_id", "idx", G.crop_rect(F.struct(*BOX), 0.1, 400, 300).alias("r")).select("frame_id", "idx", "r.*")


@query("roi_windows", WITH_DETECTIONS + """, c as (select frame_id, (x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy, greatest((x2 - x1) * 1.5, 256) as w, greatest((y2 - y1) * 1.5, 256) as h from detections where conf >= 0.5),
o as (select frame_id, greatest(0, cast(floor(cx - w / 2) as int)) as x, greatest(0, cast(floor(cy - h / 2) as int)) as y, least(640, cast(ceil(cx + w / 2) as int)) as r, least(480, cast(ceil(cy + h / 2) as int)) as b from c),
d as (select distinct frame_id, x, y, r - x as w, b - y as h from o), n as (select *, row_number() over (partition by frame_id order by y, x, w, h) - 1 as pos from d)
select frame_id, cast(pos as bigint) as pos, x, y, w, h from n where pos < 3""")
def roi_windows(spark, sf):
    """Windows around confident detections: equal ones once, by row, at most three (dedup_tiles, sort_tiles, cap_tiles)."""
    sure = F.filter("dets", lambda d: d["conf"] >= 0.5)
    windows = F.slice(F.array_sort(F.array_distinct(F.transform(sure, lambda d: G.roi_window(d, 0.5, 256, 640, 480)))), 1, 3)
    return per_frame(spark, sf).select("frame_id", F.posexplode(windows).alias("pos", "t")).select("frame_id", F.col("pos").cast("bigint").alias("pos"), "t.x", "t.y", "t.w", "t.h")


@query("tile_grid", """with f as (select n_nationkey as id, 1000 + 170 * n_nationkey as fw, 700 + 90 * n_nationkey as fh from nation),
x as (select id, unnest(list_distinct(list_concat(list_filter(range(0, greatest(fw - 960, 0) + 1, 768), lambda s: s < greatest(fw - 960, 0)), [greatest(fw - 960, 0)]))) as x, fw, fh from f),
y as (select id, unnest(list_distinct(list_concat(list_filter(range(0, greatest(fh - 540, 0) + 1, 540), lambda s: s < greatest(fh - 540, 0)), [greatest(fh - 540, 0)]))) as y from f)
select id, cast(x as int) as x, cast(y as int) as y, cast(least(960, fw - x) as int) as w, cast(least(540, fh - y) as int) as h from x join y using (id)""")
def tile_grid(spark, sf):
    """Full-pass tiles of frames of several sizes, 20 % overlap along x."""
    f = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), (1000 + 170 * F.col("n_nationkey")).cast("int").alias("fw"), (700 + 90 * F.col("n_nationkey")).cast("int").alias("fh"))
    return f.select("id", F.explode(G.tiles(F.col("fw"), F.col("fh"), 960, 540, 0.2, 0.0)).alias("t")).select("id", "t.x", "t.y", "t.w", "t.h")


@query("anchor_count", "select s_suppkey as id, ((32*s_suppkey)//8)*((64*s_suppkey)//8) + ((32*s_suppkey)//16)*((64*s_suppkey)//16) + ((32*s_suppkey)//32)*((64*s_suppkey)//32) as anchors from supplier")
def anchor_count(spark, sf):
    part = lambda s: F.expr(f"((32 * s_suppkey) div {s}) * ((64 * s_suppkey) div {s})")
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (part(8) + part(16) + part(32)).alias("anchors"))


@query("conf_rank", WITH_DETECTIONS + "select frame_id, idx, cast(row_number() over (partition by frame_id order by conf desc, idx) as int) as rank from detections")
def conf_rank(spark, sf):
    w = Window.partitionBy("frame_id").orderBy(F.desc("conf"), "idx")
    return detections(spark, sf).select("frame_id", "idx", F.row_number().over(w).alias("rank"))


@query("sort_conf", WITH_DETECTIONS + "select frame_id, array_to_string(list(idx order by conf desc, idx), ',') as order_ from detections group by frame_id")
def sort_conf(spark, sf):
    return per_frame(spark, sf).select("frame_id", F.array_join(F.transform(nms.ranked(F.col("dets")), lambda d: d["idx"].cast("string")), ",").alias("order_"))


#: Cascade rules: secondary model, classes that trigger it (none: all), attribute.
RULES = [("color", [], "color"), ("plate", [0, 1], "plate"), ("make", [2], "make")]
_RULES = "rules(model, triggers, attribute) as (values ('color', cast([] as bigint[]), 'color'), ('plate', [0, 1], 'plate'), ('make', [2], 'make'))"


def _rules(spark):
    return spark.createDataFrame(RULES, "model string, triggers array<bigint>, attribute string")


def routed(spark, sf):
    """Triggered detections by rule; the rules are a handful of configured rows."""
    d = detections(spark, sf)
    return d.join(F.broadcast(_rules(spark)), (F.size("triggers") == 0) | F.array_contains("triggers", F.col("class_id")))


_ROUTED = WITH_DETECTIONS + f", {_RULES}, routed as (select * from detections join rules on len(triggers) = 0 or list_contains(triggers, class_id)) "


@query("trigger_filter", _ROUTED + "select frame_id, idx, model from routed where attribute <> 'color'")
def trigger_filter(spark, sf):
    return routed(spark, sf).where("attribute <> 'color'").select("frame_id", "idx", "model")


@query("cascade_route", _ROUTED + "select frame_id, idx, model, attribute from routed")
def cascade_route(spark, sf):
    return routed(spark, sf).select("frame_id", "idx", "model", "attribute")


@query("expected_jobs", _ROUTED + "select frame_id, count(*) as jobs from routed group by frame_id")
def expected_jobs(spark, sf):
    """Rule and detection pairs of each frame, counted before any is sent."""

    def met(triggers):
        return F.size("dets") if not triggers else F.size(F.filter("dets", lambda d: d["class_id"].isin(triggers)))

    jobs = sum((met(t) for _, t, _ in RULES), F.lit(0))
    return per_frame(spark, sf).select("frame_id", jobs.cast("bigint").alias("jobs")).where("jobs > 0")


_ANSWERS = "answers as (select *, case when conf >= 0.3 then attribute || '_' || (idx % 3) else '' end as label from routed where (frame_id + idx) % 5 <> 0)"


@query("cascade_merge", _ROUTED + f", {_ANSWERS} select d.frame_id, d.idx, coalesce(string_agg(a.attribute || '=' || a.label, ';' order by a.attribute), '') as attributes from detections d left join answers a using (frame_id, idx) group by all")
def cascade_merge(spark, sf):
    """Secondary labels put into the attributes of their detection; top1's empty label stands where the answer was empty."""
    label = F.when(F.col("conf") >= 0.3, F.concat("attribute", F.lit("_"), (F.col("idx") % 3).cast("string"))).otherwise("")
    answers = routed(spark, sf).where((F.col("frame_id") + F.col("idx")) % 5 != 0).groupBy("frame_id", "idx").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("attribute", label)))).alias("attributes"))
    text = F.array_join(F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return detections(spark, sf).select("frame_id", "idx").join(answers, ["frame_id", "idx"], "left").select("frame_id", "idx", F.coalesce(text, F.lit("")).alias("attributes"))


@query("attr_collect", _ROUTED + f", {_ANSWERS}, e as (select frame_id, count(*) as expected from routed group by 1), r as (select frame_id, count(*) as received from answers group by 1) select frame_id, expected, coalesce(received, 0) as received, coalesce(received, 0) >= expected as complete from e left join r using (frame_id)")
def attr_collect(spark, sf):
    """Answers received against those expected: a pending result is complete once none is missing."""
    got = F.count_if((F.col("frame_id") + F.col("idx")) % 5 != 0)
    return routed(spark, sf).groupBy("frame_id").agg(F.count("*").alias("expected"), got.alias("received")).withColumn("complete", F.col("received") >= F.col("expected"))


@query("tile_complete", WITH_DETECTIONS + """, t as (select frame_id, idx as tile, count(*) over (partition by frame_id) as n, 4 as expected from detections where idx < 4)
select frame_id, count(*) as tiles, min(tile) as template from t group by frame_id having count(*) >= 4""")
def tile_complete(spark, sf):
    """Frames whose four tiles all came; the first one is the template."""
    return detections(spark, sf).where("idx < 4").groupBy("frame_id").agg(F.count("*").alias("tiles"), F.min("idx").alias("template")).where("tiles >= 4")


@query("sahi_merge", WITH_DETECTIONS + f""", t as (select frame_id, idx, class_id, conf, x1 + 200 * (idx % 2) as x1, y1 + 100 * (idx % 4 // 2) as y1, x2 + 200 * (idx % 2) as x2, y2 + 100 * (idx % 4 // 2) as y2 from detections where frame_id in (select frame_id from detections group by 1 having count(*) >= 4)),
{_nms_sql('t', 'frame_id', _TILE)} select frame_id, idx, class_id, conf, x1, y1, x2, y2 from flat""")
def sahi_merge(spark, sf):
    """Complete frames: detections moved to their tile's origin, concatenated and suppressed across tiles."""
    moved = F.transform("dets", lambda d: G.shifted(d, 200 * (d["idx"] % 2), 100 * F.floor((d["idx"] % 4) / 2)))
    return per_frame(spark, sf).where(F.size("dets") >= 4).select("frame_id", F.explode(nms.suppress_tiles(moved)).alias("d")).select("frame_id", "d.*")


@query("detection_payload", f"""with {_V8}, {_nms_sql('d8', 'vec_id', _OVER)},
s as (select *, ['car', 'truck', 'bus', 'bike'][class_id + 1] as name from flat)
select vec_id, count(*) as n, string_agg(name || ':' || cast(round(conf * 100) as int) || ':' || cast(round(x1 * 3) as int) || ':' || cast(round(y1 * 1.6875) as int), ';' order by conf desc, idx) as payload from s group by vec_id""")
def detection_payload(spark, sf):
    """Flagship: decode, gate, suppress, stretch to the frame, name, and pack as one payload a tensor."""
    kept = v8_detections(spark, sf).select("vec_id", F.explode_outer(F.array(nms.suppress(F.col("dets"), 0.45))).alias("kept")).where(F.size("kept") > 0)  # one row each; the filter stays above the suppression
    whole = lambda x: F.round(x).cast("int").cast("string")
    one = lambda d: F.concat_ws(":", F.get(names(), d["class_id"].cast("int")), whole(d["conf"] * 100), whole(d["x1"] * 3), whole(d["y1"] * 1.6875))
    return kept.select("vec_id", F.size("kept").cast("bigint").alias("n"), F.array_join(F.transform("kept", one), ";").alias("payload"))
