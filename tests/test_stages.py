"""Declared pipelines: refused parameters, unions and branches, tiles and tracking, the same graph as a stream; time-limited joins and keyed state as streams."""

import pytest
from pyspark.sql import functions as F

from framewright.operators import sequential as S
from framewright.operators.tracking import Config, track
from framewright.plans import stream_queries as Q
from framewright.plans.dag import check_pipeline, compile_pipeline
from framewright.plans.stages import Context, read_params
from framewright.streaming import joins, state

MODELS = {"det": {"version": "v8", "names": ["car", "bus"], "anchors": 1, "input": (100, 100)}, "bad": {"version": "v8", "names": [], "cascade": [{"model_id": "none"}]}}


def node(name, kind, **w):
    return {"id": name, "type": kind, "with": w}


def edges(*pairs):
    return [{"from": a, "to": b} for a, b in pairs]


@pytest.mark.parametrize(
    "kind, given, why",
    [
        ("sink.stream", {"protocol": "srt", "output_url": "rtsp://x"}, "protocol"),
        ("sink.stream", {}, "requires with.output_url"),
        ("sink.stream", {"output_url": "rtsp://x", "gop": "-1"}, "gop"),
        ("sink.stream", {"output_url": "rtsp://x", "encoder": "none"}, "encoder"),
        ("sink.stream", {"output_url": "rtsp://x", "encoder": "ascend_venc"}, "encoder"),
        ("sink.stream", {"output_url": "rtsp://x;rm"}, "shell"),
        ("sink.ffplay", {"drop_policy": "block"}, "drop_policy"),
        ("sink.ffplay", {"fps": "0"}, "fps"),
        ("sink.ffplay", {"reconnect_initial_ms": "9", "reconnect_max_ms": "8"}, "reconnect"),
        ("source.file", {"loop": "maybe"}, "no bool"),
        ("infer.sahiScheduler", {"full_interval": "0"}, "full_interval"),
        ("infer.sahiScheduler", {"tile_width": "wide"}, "no int"),
        ("post.sahiMerge", {"merge_iou": "1.5"}, "merge_iou"),
        ("post.sahiMerge", {"stale_timeout_ms": "0"}, "stale"),
        ("infer.engine", {}, "requires with.model_id"),
        ("infer.engine", {"model_id": "?"}, "not found"),
        ("infer.engine", {"model_id": "bad"}, "secondary"),
        ("sink.publish", {"to": "bus, ?"}, "unknown publisher"),
        ("no.such", {}, "unsupported"),
    ],
)
def test_parameters_are_refused(kind, given, why):
    with pytest.raises(ValueError, match=why):
        read_params(kind, given, Context(models=MODELS, publishers={"bus": {}}))


def test_parameters_are_read():
    assert read_params("sink.stream", {"output_url": "rtsp://x", "gop": "0"}, Context())["gop"] == 0
    assert read_params("source.file", {"loop": "on"}, Context())["loop"] is True
    assert read_params("sink.publish", {}, Context(publishers={"a": {}, "b": {}}))["to"] == ["a", "b"]


def test_graphs_are_refused():
    ok = [node("a", "source.file"), node("b", "sink.publish")]
    check_pipeline({"nodes": ok, "edges": edges(("a", "b"))})
    for spec, why in (
        ({"nodes": [*ok, node("a", "source.file")], "edges": []}, "duplicate"),
        ({"nodes": ok, "edges": [{"from": "a", "to": "b", "policy": "hope"}]}, "policy"),
        ({"nodes": ok, "edges": [{"from": "a", "to": "b", "capacity": 0}]}, "capacity"),
        ({"nodes": ok, "edges": []}, "no input"),
        ({"nodes": ok, "edges": edges(("a", "b"), ("b", "a"))}, "cycle"),
    ):
        with pytest.raises(ValueError, match=why):
            check_pipeline(spec)


def given_outputs(spark, n=12):
    """Frames of two streams with one box each, of class frame_seq % 2."""
    rows = [(f"cam_{i % 2}", i, 0, [50.0, 50.0, 20.0, 10.0, 0.9 if i % 2 == 0 else 0.1, 0.1 if i % 2 == 0 else 0.6]) for i in range(n)]
    outputs = spark.createDataFrame(rows, "stream_id string, frame_seq bigint, tile bigint, tensor array<double>")
    frames = spark.createDataFrame([(f"cam_{i % 2}", i, 200, 100) for i in range(n)], "stream_id string, frame_seq bigint, width int, height int")
    return frames.withColumn("ts", F.timestamp_seconds(1_700_000_000 + F.col("frame_seq"))), outputs


GRAPH = {"nodes": [node("a", "source.rtsp"), node("b", "source.file"), node("det", "infer.engine", model_id="det"), node("sure", "filter.conf", threshold="0.8"), node("out", "sink.publish", to="bus"), node("draw", "sink.ffplay", draw_conf_thresh="0.7")], "edges": edges(("a", "det"), ("b", "det"), ("det", "sure"), ("sure", "out"), ("det", "draw"))}


def test_union_and_branch_as_table_and_as_stream(spark, tmp_path):
    frames, outputs = given_outputs(spark)
    context = Context(models=MODELS, outputs={"det": outputs}, publishers={"bus": {"type": "redis", "prefix": "p"}})
    low, high = frames.where("frame_seq < 6"), frames.where("frame_seq >= 6")
    out = compile_pipeline(GRAPH, {"a": low, "b": high}, context)
    rows = {r.frame_seq: r for r in out["out"].collect()}
    assert sorted(rows) == list(range(12)) and rows[0].key == "p:cam_0" and rows[0].publisher == "bus"
    assert '"bbox":[80.0,45.0,120.0,55.0]' in rows[0].value and '"class_name":"car"' in rows[0].value and '"detections":[]' in rows[1].value
    drawn = {r.frame_seq: r.overlay for r in out["draw"].collect()}
    assert drawn[1] == [] and drawn[2][0].label == "car 0.90" and drawn[2][0].rect.w == 40
    frames.repartition(1).write.parquet(str(tmp_path / "in"))
    read = spark.readStream.schema(frames.schema).parquet(str(tmp_path / "in"))
    stream = compile_pipeline(GRAPH, {"a": read.where("frame_seq < 6"), "b": read.where("frame_seq >= 6")}, context)["out"]
    run(stream, "graph", tmp_path)
    assert {(r.key, r.frame_seq, r.value) for r in spark.table("graph").collect()} == {(r.key, r.frame_seq, r.value) for r in rows.values()}


def test_tiles_tracks_and_loops(spark):
    frames, _ = given_outputs(spark, 4)
    frames = frames.withColumn("rois", F.when(F.col("frame_seq") == 2, F.array(F.struct(*[F.lit(float(v)).alias(c) for c, v in (("x1", 10), ("y1", 10), ("x2", 30), ("y2", 30))]))))
    spec = {"nodes": [node("a", "source.file"), node("t", "infer.sahiScheduler", tile_width="100", tile_height="100", overlap_ratio="0", min_roi_width="20", full_interval="2"), node("d", "infer.engine", model_id="det"), node("m", "post.sahiMerge"), node("k", "track.bytetrack", min_hits_to_confirm="1")], "edges": edges(("a", "t"), ("t", "d"), ("d", "m"), ("m", "k"))}
    tiles = [(f"cam_{i % 2}", i, t, [50.0, 50.0, 20.0, 10.0, 0.9, 0.1]) for i in range(4) for t in range(2) if (i, t) != (1, 1)]
    outputs = spark.createDataFrame(tiles, "stream_id string, frame_seq bigint, tile bigint, tensor array<double>")
    out = compile_pipeline(spec, {"a": frames}, Context(models=MODELS, outputs={"det": outputs}))
    rows = {}
    for r in out["t"].collect():
        rows.setdefault(r.frame_seq, []).append((r.tile, r.x, r.w, r.expected))
    assert sorted(rows[0]) == [(0, 0, 100, 2), (1, 100, 100, 2)] and len(rows[2]) == 1 and rows[3] == [(0, 0, 200, 1)]
    merged = {r.frame_seq: [(round(d.x1), d.track_id) for d in r.dets] for r in out["k"].collect()}
    assert sorted(merged) == [0, 2, 3]  # a tile of frame 1 has no output
    assert sorted(x for x, _ in merged[0]) == [40, 140] and all(t is not None for _, t in merged[0])
    looped = compile_pipeline({"nodes": [node("a", "source.file", loop="true", epochs="3", frames="4")], "edges": []}, {"a": frames})["a"]
    assert sorted(r.frame_seq for r in looped.collect()) == list(range(12))


def test_tracking_across_batches(spark):
    """Frames cut by Arrow batches of three rows, streams named by text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = [(f"s{s}", f, i, 0.9, 10.0 * f + 200 * i, 0.0, 10.0 * f + 200 * i + 100, 50.0) for s in range(2) for f in range(5) for i in range(4)]
        dets = spark.createDataFrame(rows, "stream_id string, frame_seq bigint, idx bigint, conf double, x1 double, y1 double, x2 double, y2 double")
        got = track(dets, Config(min_hits=1)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 40 and all(r.track_id == r.idx + 1 for r in got)


# streams


def run(stream, name, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return q


def in_files(spark, df, path, order, files=3):
    """``df`` as a stream of several micro-batches in order."""
    rows = df.withColumn("_n", F.ntile(files).over(Q.Window.orderBy(order))).persist()
    for k in range(1, files + 1):
        rows.where(F.col("_n") == k).drop("_n").coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def small(spark, sf="/root/testdata/sf0.001"):
    f = Q.frames(spark, sf).where("frame_seq < 12").withColumn("ts", F.timestamp_millis(F.col("frame_seq") * 400 + F.col("user_id") % 16 + 1_000_000))
    return f.select("stream_id", "frame_seq", "ts", "event_id", "latency_ms")


def test_results_in_flight_as_a_stream(spark, tmp_path):
    f = small(spark)
    sent = f.where("frame_seq % 3 <> 0").select("stream_id", "frame_seq", "ts")
    done = f.where("frame_seq % 4 <> 0").select("stream_id", "frame_seq", (F.col("ts") + F.expr("interval 3 seconds") * (F.col("frame_seq") % 5)).alias("done"), "latency_ms")
    want = {tuple(r) for r in joins.in_flight(sent, done).select("stream_id", "frame_seq", "latency_ms").collect()}
    assert want and len(want) < sent.join(done, ["stream_id", "frame_seq"]).count()
    last = spark.createDataFrame([("end", 0, 90_000)], "stream_id string, frame_seq bigint, s bigint").withColumn("t", F.timestamp_seconds("s"))
    a = in_files(spark, sent.unionByName(last.select("stream_id", "frame_seq", F.col("t").alias("ts"))), tmp_path / "a", "ts")
    b = in_files(spark, done.unionByName(last.select("stream_id", "frame_seq", F.col("t").alias("done"), F.lit(0.0).alias("latency_ms"))), tmp_path / "b", "done")
    q = run(joins.in_flight(a, b, late="20 seconds").select("stream_id", "frame_seq", "latency_ms"), "flight", tmp_path)
    got = {tuple(r) for r in spark.table("flight").collect() if r.stream_id != "end"}
    assert got == want
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4  # only the closing rows are held


def test_cascades_with_a_deadline_as_a_stream(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    results, answers = (d.where("frame_seq < 20") for d in Q.cascade_rows(spark, sf))
    cols = ["stream_id", "frame_seq", "emitted", "expected", "received"]
    want = {(*[r[c] for c in cols], tuple(x.idx for x in r.answers)) for r in joins.cascade_deadline(results, answers).collect()}
    assert len({r[4] for r in want}) > 2 and any(r[3] > r[4] for r in want)
    far = F.timestamp_seconds(F.lit(4_000_000_000))
    end_r = spark.createDataFrame([("end", 0)], "stream_id string, frame_seq bigint").select("stream_id", "frame_seq", far.alias("at"), F.lit(0).cast("bigint").alias("expected"), F.lit(0).cast("bigint").alias("n_dets"))
    end_a = end_r.select("stream_id", "frame_seq", "at", F.lit(0).alias("idx"), F.lit("").alias("attribute"), F.lit("").alias("label"))
    # one micro-batch brings all rows, the next the closing ones, whose watermark ends the waiting
    for name, rows, end in (("r", results, end_r), ("a", answers, end_a)):
        rows.coalesce(1).write.parquet(str(tmp_path / name))
        end.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    read = lambda n, d: spark.readStream.schema(d.schema).parquet(str(tmp_path / n))
    run(joins.cascade_deadline(read("r", results), read("a", answers)), "deadline", tmp_path)
    got = {(*[r[c] for c in cols], tuple(x.idx for x in r.answers)) for r in spark.table("deadline").collect() if r.stream_id != "end"}
    assert got == want


def test_keyed_rules_as_streams_over_a_restart(spark, tmp_path):
    f = small(spark).withColumn("stale", F.col("event_id") % 3 != 0).withColumn("kind", F.element_at(F.array(*map(F.lit, ["added", "frame", "dropped", "reconnect_failed", "reconnect_ok", "dropped", "?"])), (F.col("event_id") % 7 + 1).cast("int")))
    dets = f.select("stream_id", "frame_seq", "ts", F.lit(0).alias("idx"), (0.3 + F.col("event_id") % 7 / 10).alias("conf"), *[(F.col("frame_seq") * 5 + d).cast("double").alias(c) for c, d in (("x1", 0), ("y1", 0), ("x2", 80), ("y2", 80))])
    early, later = f.where("frame_seq < 5"), f.where("frame_seq >= 5")
    want = {
        "throttled": {tuple(r) for r in S.throttle(f, F.col("stale"), 3, 6).collect()},
        "healthy": {tuple(r) for r in S.health(f, F.col("kind"), 2, 4).collect()},
        "tracked": {tuple(r) for r in track(dets).collect()},
    }
    assert len({r[2] for r in want["healthy"]}) > 3
    for name, rule, source in (
        ("throttled", lambda d: state.throttle(d, "stale", 3, 6).select("stream_id", "frame_seq", "kind"), f),
        ("healthy", lambda d: state.health(d, "kind", 2, 4).select("stream_id", "frame_seq", "state"), f),
        ("tracked", lambda d: state.track(d).select("stream_id", "frame_seq", "idx", "track_id"), dets),
    ):
        path, got = tmp_path / name, set()
        for k, half in enumerate((source.where("frame_seq < 5"), source.where("frame_seq >= 5"))):  # the second run goes on from the first one's checkpoint
            half.coalesce(1).write.mode("append").parquet(str(path))
            stream = rule(spark.readStream.schema(source.schema).parquet(str(path)))
            q = stream.writeStream.foreachBatch(lambda d, n, got=got: got.update(tuple(r) for r in d.collect())).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
            q.awaitTermination(180)
            assert q.exception() is None
        assert got == want[name], name
    assert early.count() and later.count()
