"""Model repositories, uploaded archives, deployments, and the frame archive's commit and deletion, on small folders."""

import io
import os
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from framewright.sources import archives, repository
from framewright.streaming import archive


def put(root, path, text="x"):
    full = root / path
    full.parent.mkdir(parents=True, exist_ok=True)
    full.write_text(text)


def test_repository(spark, tmp_path):
    cases = {
        "one": ("backend: cpu\nversion: yolov8\n", ["1/model.onnx"]),
        "older": ("backend: cpu\nactive_version: 1\nweight_file: v1.onnx\n", ["1/v1.onnx", "2/v2.onnx"]),
        "newest": ("backend: mps\n", ["2/a.onnx", "10/b.onnx", "x/c.onnx", "0/d.onnx"]),
        "engine": ("backend: trt\nengine_path: e/m.engine\nid: engine\n", ["1/other.txt"]),
        "om_many": ("backend: acl\nom_paths: {1: a.om, 4: /abs/b.om}\n", ["1/a.om"]),
        "om_one": ("backend: ascend\nbatch_size: 8\n", ["3/k.om"]),
        "no_version": ("backend: cpu\n", ["latest/model.onnx"]),
        "gone": ("backend: cpu\nactive_version: 7\n", ["1/model.onnx"]),
        "two": ("backend: cpu\n", ["1/a.onnx", "1/b.onnx"]),
        "none": ("backend: tensorrt\n", ["1/a.onnx"]),
        "only_onnx": ("backend: tensorrt\nonnx_path: a.onnx\n", ["1/a.onnx"]),
        "misfit": ("backend: tensorrt\nweight_file: a.onnx\n", ["1/a.onnx"]),
        "lost": ("backend: cpu\nweight_file: b.onnx\n", ["1/a.onnx"]),
        "odd_file": ("backend: cpu\nweight_file: a.bin\n", ["1/a.bin"]),
        "renamed": ("id: other\nbackend: cpu\n", ["1/a.onnx"]),
        "listed": ("- 1\n", ["1/a.onnx"]),
        "torn": ("a: [1\n", ["1/a.onnx"]),
        "strange": ("backend: fpga\n", ["1/a.onnx"]),
        "bad.name": ("backend: cpu\n", ["1/a.onnx"]),
    }
    for name, (config, files) in cases.items():
        put(tmp_path, f"{name}/config.yaml", config)
        for f in files:
            put(tmp_path, f"{name}/{f}")
    put(tmp_path, "no_config/1/a.onnx")
    got = {r.model: r for r in repository.resolve_repository(spark, str(tmp_path)).collect()}
    assert set(got) == set(cases) - {"bad.name"}
    weights = {k: {s: p.removeprefix(str(tmp_path)) for s, p in r.weights.items()} for k, r in got.items() if r.weights}
    assert weights == {
        "one": {"onnx": "/one/1/model.onnx"}, "older": {"onnx": "/older/1/v1.onnx"}, "newest": {"onnx": "/newest/10/b.onnx"}, "engine": {"engine": "/engine/1/e/m.engine"},
        "om_many": {"1": "/om_many/1/a.om", "4": "/abs/b.om"}, "om_one": {"8": "/om_one/3/k.om"},
    }
    why = {"no_version": "no numeric", "gone": "active_version 7", "two": "multiple .onnx", "none": "no .engine", "only_onnx": "engine_path is empty", "misfit": "does not fit", "lost": "not found", "odd_file": "unsupported", "renamed": "must match", "listed": "mapping", "torn": "config.yaml", "strange": "unknown backend"}
    assert {k for k, r in got.items() if r.error} == set(why)
    for k, part in why.items():
        assert part in got[k].error, (k, got[k].error)
    assert got["one"].backend == "cpu" and got["engine"].backend == "cuda" and got["om_one"].backend == "ascend"


def test_repository_joins_the_configuration(spark, tmp_path):
    put(tmp_path, "repo_only/config.yaml", "backend: cpu\n")
    put(tmp_path, "repo_only/1/w.onnx")
    rows = repository.resolve_repository(spark, str(tmp_path))
    assert [m["id"] for m in repository.merge_repository({"models": [{"id": "m1"}]}, rows)["models"]] == ["m1", "repo_only"]
    with pytest.raises(ValueError, match="repo_only"):
        repository.merge_repository({"models": [{"id": "repo_only"}]}, rows)
    put(tmp_path, "bad/config.yaml", "backend: cpu\n")
    with pytest.raises(ValueError, match="no numeric"):
        repository.merge_repository({}, repository.resolve_repository(spark, str(tmp_path)))


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def tarred(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, text in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(text)
            t.addfile(info, io.BytesIO(text.encode()))
    return out.getvalue()


def test_archives(spark, tmp_path):
    held = {
        "a.zip": zipped({"top/model_b8.om": "", "top/z.om": "", "top/a.om": "", "top/readme": ""}),
        "b.tar.gz": tarred({"m.onnx": "", "n.onnx": ""}),
        "c.zip": zipped({"m.engine": "", "config.yaml": "backend: cuda"}),
        "d.zip": zipped({"m.engine": "", "x.om": ""}),
        "e.zip": b"no archive",
        "f.zip": zipped({"../m.onnx": ""}),
        "g.tar.gz": tarred({"config.yaml": "a: [", "m.engine": ""}),
        "h.zip": zipped({f"{c}.om": "" for c in "abcdef"}),
        "i.zip": zipped({}),
        "other.txt": b"",
    }
    for name, content in held.items():
        (tmp_path / name).write_bytes(content)
    got = {r.archive.rsplit("/", 1)[1]: r for r in archives.list_archives(spark, str(tmp_path)).collect()}
    assert set(got) == set(held) - {"other.txt"}
    assert got["a.zip"].om_files == {1: "top/a.om", 8: "top/model_b8.om", 4: "top/z.om"} and got["a.zip"].suggested_id == "top" and got["a.zip"].backend == "ascend"
    assert (got["b.tar.gz"].model_file, got["b.tar.gz"].backend, got["b.tar.gz"].suggested_id) == ("m.onnx", "cpu", None)
    assert got["c.zip"].backend == "cuda" and got["g.tar.gz"].backend == "trt" and got["i.zip"].backend is None
    assert "mixed" in got["d.zip"].error and "unreadable" in got["e.zip"].error and "leads out" in got["f.zip"].error
    assert sorted(got["h.zip"].om_files) == [1, 4, 8, 16]


def test_deployments(spark):
    uploads = spark.createDataFrame([("t1", 10), ("t2", 10), ("t3", 99)], "token string, expires_at int")
    models = spark.createDataFrame([("old", 0)], "id string, since int")
    asked = [("t1", "m", 5), ("t2", "m", 6), ("t2", "n", 7), ("t2", "n2", 8), ("t1", "k", 9), ("t3", "old", 11), ("t3", "bad id", 12), ("t3", None, 13), ("t3", "late", 100), ("?", "q", 1), (None, "q", 1)]
    got = {tuple(r) for r in archives.deployments(spark.createDataFrame(asked, "token string, id string, at int"), uploads, models).select("token", "id", "at", "outcome").collect()}
    want = ["deployed", "already_exists", "deployed", "token_expired", "token_expired", "already_exists", "invalid_id", "invalid_id", "token_expired", "token_expired", "token_expired"]
    assert got == {(*a, w) for a, w in zip(asked, want)}


def found(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names if not f.startswith("."))


def test_archive_commits_whole_jobs(spark, tmp_path):
    archive.register(spark)
    root = str(tmp_path / "frames")
    rows = spark.range(40).select(F.concat(F.lit("20240101/00/0"), (F.col("id") % 3).cast("string"), F.lit("/cam/"), F.col("id").cast("string"), F.lit(".jpg")).alias("key"), F.col("id").cast("string").cast("binary").alias("payload"))
    rows = rows.unionByName(spark.createDataFrame([(None, None)], "key string, payload binary")).repartition(4)
    bad = rows.withColumn("payload", F.when(F.col("key").contains("/17.jpg"), F.raise_error(F.lit("torn")).cast("binary")).otherwise(F.col("payload")))
    with pytest.raises(Exception, match="torn"):
        bad.write.format("frame_archive").option("path", root).mode("append").save()
    assert found(root) == []
    rows.write.format("frame_archive").option("path", root).mode("append").save()
    assert len(found(root)) == 40 and (tmp_path / "frames/20240101/00/02/cam/17.jpg").read_bytes() == b"17"
    assert not (tmp_path / "frames" / archive.STAGING).exists()
    placed = archive.with_location(rows.where("key like '%/5.jpg'"), root, "http://a/").first()
    assert placed.frame_local_path == f"{root}/{placed.key}" and placed.frame_url == f"http://a/{placed.key}"


def test_archive_as_a_stream(spark, tmp_path):
    archive.register(spark)
    rows = spark.range(6).select(F.concat(F.lit("d/"), F.col("id").cast("string")).alias("key"), F.lit(b"x").alias("payload"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = stream.writeStream.format("frame_archive").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None and found(tmp_path / "out") == [f"d/{i}" for i in range(6)]


def test_expired_folders_are_deleted_by_name(spark, tmp_path):
    for path in ("20240101/00/00/cam/1.jpg", "20240102/00/00/cam/1.jpg", "20240102/01/00/cam/1.jpg", "20240102/01/29/cam/1.jpg", "20240102/01/30/cam/1.jpg", "20240102/xx/1.jpg", "notes/1.txt", "20241399/00/1.jpg"):
        put(tmp_path, path)
    (tmp_path / "20240102/02").mkdir()
    now = 1704157200 + 31 * 60 + 60 * 60  # 2024-01-02 02:31, an hour is kept: until 01:31
    gone = {r.folder.removeprefix(str(tmp_path) + "/"): r.files for r in archive.delete_expired(spark, str(tmp_path), now - 60, 60).collect()}
    assert gone == {"20240101": 1, "20240102/00": 1, "20240102/01/00": 1, "20240102/01/29": 1}
    assert found(tmp_path) == ["20240102/01/30/cam/1.jpg", "20240102/xx/1.jpg", "20241399/00/1.jpg", "notes/1.txt"]
    assert not (tmp_path / "20240102/02").exists()
    assert archive.delete_expired(spark, str(tmp_path / "none"), now, 60).count() == 0
