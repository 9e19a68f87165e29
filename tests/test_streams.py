"""Golden rows of sequential rules, metrics, tracking, catalog, pipelines; streaming agrees with batch."""

import json
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions import metrics as M
from framewright.functions import text as T
from framewright.operators import sequential as S
from framewright.operators.tracking import Config, Tracker, assign
from framewright.operators.admission import admit
from framewright.sources.catalog import Catalog, read_store, scan_repository
from framewright.streaming import state


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def followed(spark, rule, kind, *values):
    """What a rule says of one stream's values, and of a second stream of the same values."""
    df = spark.createDataFrame([(s, i, v) for s in ("a", "b") for i, v in enumerate(values)], f"stream_id string, frame_seq bigint, v {kind}")
    rows = rule(df, F.col("v")).collect()
    out = [[r[2] for r in sorted(rows, key=lambda r: r.frame_seq) if r.stream_id == s] for s in ("a", "b")]
    assert out[0] == out[1]
    return out[0]


def test_sampling(spark):
    assert followed(spark, lambda d, c: S.sample_by_time(d, c, 200_000), "bigint", 0, 100_000, 200_000, 300_000, 400_000) == [True, False, True, False, True]


def test_health(spark):
    def states(degraded, most, *kinds):
        return followed(spark, lambda d, c: S.health(d, c, degraded, most), "string", *kinds)

    assert states(3, 9, "reconnect_failed", "reconnect_failed", "reconnect_failed") == ["RECONNECTING", "RECONNECTING", "DEGRADED"]
    assert states(2, 9, "dropped", "reconnect_failed", "reconnect_ok")[-1] == "STREAMING"
    assert states(2, 2, "dropped", "dropped", "frame")[-1] == "FAILED"
    assert "DEGRADED" not in states(5, 5, *["dropped"] * 6)
    assert states(2, 2, "?", "added", "frame", "dropped", "dropped", "frame", "added", "dropped", "?", "removed") == ["STOPPED", "CONNECTING", "STREAMING", "RECONNECTING", "FAILED", "FAILED", "CONNECTING", "RECONNECTING", "RECONNECTING", "STOPPED"]


def test_throttle(spark):
    got = followed(spark, lambda d, c: S.throttle(d, c, 5, 10), "boolean", *[True] * 12)
    assert got == ["full", "single", "single", "single", "fallback", "single", "single", "single", "single", "fallback", "full", "single"]
    assert followed(spark, lambda d, c: S.throttle(d, c, 5, 10), "boolean", True, False, True)[1:] == ["roi", "single"]


def test_batches_and_policy(spark):
    assert followed(spark, lambda d, c: S.micro_batches(d, c, 3, 20), "bigint", 0, 1, 2, 3, 50, 51) == [1, 1, 1, 2, 3, 3]
    assert followed(spark, lambda d, c: S.batch_policy(d, c, 16, 3), "boolean", *[True] * 6, *[False] * 3) == [8, 4, 2, 1, 1, 1, 1, 1, 2]


def test_text_rules(spark):
    lit = F.lit
    assert [one(spark, T.fault_of(lit(c))) for c in (2, 101, 201, 46, 0)] == ["oom", "context_lost", "context_lost", "engine_fault", "engine_fault"]
    assert [one(spark, T.enum_of(lit(x), T.VERSIONS)) for x in ("yolo11", "yolov11", "V8")] == ["v11", None, None]
    assert [one(spark, T.enum_of(lit(x), T.BACKENDS)) for x in ("acl", "metal", "CUDA")] == ["ascend", "mps", None]
    assert [one(spark, T.boolean_of(lit(x))) for x in ("on", "0", "On", " on")] == [True, False, None, None]
    assert [one(spark, T.integer_of(lit(x))) for x in (" 12px", "x", "99999999999", "-3")] == [12, None, None, -3]
    assert one(spark, T.float_of(lit("1.5e1z"))) == 15.0


def test_gated_assignment():
    t = Tracker(Config(min_hits=1))
    box = lambda *b: np.array(b, float)
    first, second = t.update(box([0, 0, 100, 100], [60, 0, 160, 100]), np.array([0.9, 0.9]))
    # without the gate the pairs of 0.29 and 0.82 would beat the only lawful one
    assert t.update(box([55, 0, 155, 100]), np.array([0.9])) == [second] and first != second


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 110; from pyspark import SparkContext; assert SparkContext._active_spark_context is None"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


def test_histograms(spark):
    df = spark.createDataFrame([("a", 80.0)], "s string, v double")
    got = {r.le: r.n for r in M.histogram(df, F.col("v"), "s").collect()}
    assert got[50] == 0 and got[100] == 1
    b = spark.createDataFrame([("a", 5.0)], "s string, v double")
    got = {r.le: r.n for r in M.histogram(b, F.col("v"), "s", bounds=M.BATCH).collect()}
    assert got[4] == 0 and got[8] == 1
    assert M.quantile(df, F.col("v"), 0.5, "s").first().q == pytest.approx(75)


def test_counter_reset(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate((5, 9, 2))], "s string, t int, v double")
    assert [r.step for r in M.increase(df, "v", ["s"], ["t"]).orderBy("t").collect()] == [None, 4, 2]


def test_backoff(spark):
    lit = lambda x: F.lit(x).cast("bigint")
    assert 3000 <= one(spark, T.backoff(lit(3000), lit(60000), lit(0), F.lit(1.0))) <= 3301
    assert one(spark, T.backoff(lit(3000), lit(60000), lit(0), F.lit(-1.0))) == 3000
    assert one(spark, T.backoff(lit(3000), lit(60000), lit(40), F.lit(1.0))) <= 66001


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    from itertools import permutations

    for n, m in ((1, 1), (3, 3), (2, 4), (4, 2)):
        c = rng.random((n, m))
        got = sum(c[p] for p in assign(c))
        best = min(sum((c if n <= m else c.T)[i, j] for i, j in enumerate(p)) for p in permutations(range(max(n, m)), min(n, m)))
        assert got == pytest.approx(best)


def test_tracker():
    a = lambda *b: np.array(b, float)
    t = Tracker(Config(min_hits=1))
    first = t.update(a([10, 20, 110, 220]), np.array([0.9]))
    assert t.update(a([12, 22, 112, 222]), np.array([0.92])) == first
    t = Tracker(Config(min_hits=2))
    assert t.update(a([0, 0, 10, 10]), np.array([0.9])) == [None] and t.update(a([0, 0, 10, 10]), np.array([0.2])) == [1]
    t = Tracker(Config(min_hits=1))
    left, right = t.update(a([0, 0, 100, 100], [10, 0, 110, 100]), np.array([0.9, 0.9]))
    assert t.update(a([5, 0, 105, 100], [-53, 0, 47, 100]), np.array([0.9, 0.9])) == [right, left]


def test_catalog(tmp_path):
    c = Catalog({"sources": [{"id": "a"}], "pipelines": [{"id": "p", "nodes": [{"id": "x"}, {"id": "y"}], "edges": [{"from": "x", "to": "y"}]}], "tasks": [{"id": "t", "source_id": "a", "pipeline_id": "p"}]})
    with pytest.raises(ValueError, match="in use"):
        c.remove("sources", "a")
    assert c.command(json.dumps({"cmd": "add_source", "item": {"id": "b"}}))["ok"]
    assert not c.command(json.dumps({"cmd": "add_source", "item": {"id": "b"}}))["ok"]
    assert not c.command(json.dumps({"cmd": "add_pipeline", "item": {"id": "q", "nodes": [{"id": "x"}], "edges": [{"from": "x", "to": "x"}]}}))["ok"]
    c.save(str(tmp_path / "state.json"))
    assert [x["id"] for x in json.load(open(tmp_path / "state.json"))["added_sources"]] == ["b"]


def test_repository(spark, tmp_path):
    for v in ("1", "10", "2"):
        (tmp_path / "m" / v).mkdir(parents=True)
        (tmp_path / "m" / v / "weights.onnx").write_bytes(b"x")
    assert [tuple(r) for r in scan_repository(spark, str(tmp_path)).collect()] == [("m", 10, ["weights.onnx"])]


def test_stream_agrees_with_batch(spark, tmp_path):
    rows = spark.range(60).select(F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("stream_id"), F.col("id").alias("frame_seq"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 7).alias("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = state.sample_by_time(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), 30_000_000)
    q = stream.writeStream.format("memory").queryName("sampled").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.stream_id, r.frame_seq) for r in spark.table("sampled").collect()}
    out = S.sample_by_time(rows, F.unix_micros("ts"), 30_000_000)
    assert got == {(r.stream_id, r.frame_seq) for r in out.where("emitted").collect()}


def test_fan_out(spark, caplog):
    seen = []

    def bad(df, n):
        raise OSError("down")

    state.fan_out({"bad": bad, "good": lambda df, n: seen.append(df.count())})(spark.range(3), 0)
    assert seen == [3] and "sink bad failed" in caplog.text


def test_admission(spark):
    asked = [(1, "a"), (2, "a"), (3, "b"), (4, "a"), (5, "c"), (6, "a")]
    df = spark.createDataFrame(asked, "pos bigint, name string")
    out = lambda most: [r.outcome for r in admit(df, "name", "pos", most).orderBy("pos").collect()]
    assert out(2) == ["added", "duplicate", "added", "limit", "limit", "limit"]
    assert out(9) == ["added", "duplicate", "added", "duplicate", "added", "duplicate"]
    assert out(0) == ["limit"] * 6
    assert admit(df.limit(0), "name", "pos", 2).collect() == []


def test_bucket_names(spark):
    rows = [("19700101", "00", "00", 60), ("20240230", "23", "59", 1709337600), ("20241301", "00", "00", None), ("20240100", "00", "00", None), ("2024010", "00", "00", None), ("20240101", "24", "00", None), ("20240101", "1", "00", None), ("20240101", "00", "60", None), (None, "00", "00", None)]
    df = spark.createDataFrame(rows, "d string, h string, m string, want bigint")
    got = df.select("want", T.bucket_end(F.col("d"), F.col("h"), F.col("m")).alias("got")).collect()
    assert [r.want for r in got] == [r.got for r in got]


def test_store(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"sources": {"a": {"url": "rtsp://x", "n": 1}}, "tasks": {"t": {"create": {"id": "t"}, "running": True}}}))
    got = {(r.kind, r.id, r.running, json.dumps(json.loads(r.spec), sort_keys=True)) for r in read_store(spark, str(tmp_path / "s.json")).collect()}
    assert got == {("sources", "a", None, '{"n": 1, "url": "rtsp://x"}'), ("tasks", "t", True, '{"id": "t"}')}


def test_catalog_models_and_tasks(tmp_path):
    config = {"sources": [{"id": "s"}], "models": [{"id": "m"}], "pipelines": [{"id": "p", "nodes": [{"id": "i", "type": "infer", "with": {"model_id": "m"}}], "edges": []}], "tasks": [{"id": "t", "source_id": "s", "pipeline_id": "p"}]}
    c = Catalog(config, repository=[{"id": "r"}], metrics=lambda: "up 1")
    ask = lambda **r: c.command(json.dumps(r))
    assert ask(cmd="metrics")["data"] == "up 1"
    assert [m["loaded"] for m in ask(cmd="list_repository")["data"]] == [False]
    assert ask(cmd="load_from_repository", id="r")["ok"] and not ask(cmd="load_from_repository", id="r")["ok"] and not ask(cmd="load_from_repository", id="x")["ok"]
    assert [m["loaded"] for m in ask(cmd="list_repository")["data"]] == [True]
    assert ask(cmd="load_model", item={"id": "n"})["ok"] and not ask(cmd="load_model", item={"id": "n"})["ok"]
    assert not ask(cmd="update_task", item={"id": "t", "source_id": "?", "pipeline_id": "p"})["ok"] and c.state["tasks"]["t"]["source_id"] == "s"
    assert ask(cmd="update_task", item={"id": "t", "source_id": "s", "pipeline_id": "p", "sample_fps": 2})["ok"] and c.state["tasks"]["t"]["sample_fps"] == 2
    assert ask(cmd="start_task", id="t")["ok"] and not ask(cmd="update_task", item=c.state["tasks"]["t"])["ok"]
    assert ask(cmd="unload_model", id="m")["in_use"]
    assert ask(cmd="stop_task", id="t")["ok"] and ask(cmd="unload_model", id="m")["ok"] and not ask(cmd="unload_model", id="m")["ok"]
    c.save(str(tmp_path / "d.json"))
    again = Catalog(config)
    again.load(str(tmp_path / "d.json"))
    assert set(again.state["models"]) == {"r", "n"}
    again.load(str(tmp_path / "none.json"))
    (tmp_path / "bad.json").write_text("{")
    again.load(str(tmp_path / "bad.json"))
    assert set(again.state["models"]) == {"r", "n"}


def test_a_stream_prepared_at_once_is_followed_frame_by_frame():
    """Slices of a batch's arrays give what single frames give, over more tracks than the state has room for, and tracks that go (FINDINGS_r03, F4)."""
    import numpy as np

    from framewright.operators.tracking import prepared

    rng = np.random.default_rng(4)
    sizes = [200, 0, 1, *rng.integers(0, 9, 60).tolist(), 150]
    corner = rng.integers(0, 40, (sum(sizes), 2)) * 20.0
    boxes, conf = np.concatenate([corner, corner + rng.integers(20, 60, corner.shape)], 1), rng.random(len(corner))
    whole, single, at, new = Tracker(Config(max_lost=5)), Tracker(Config(max_lost=5)), 0, 0
    dets = prepared(boxes, conf)
    for n in sizes:
        got = whole.step(*dets, at, at + n)
        assert got == single.update(boxes[at : at + n], conf[at : at + n]) and len(got) == n
        shown = [x for x in got if x is not None]
        assert len(set(shown)) == len(shown)
        new, at = max([new, *shown]), at + n
    assert new > 64 and whole.n < whole.next - 1
