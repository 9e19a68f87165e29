"""Frame messages on the wire against a protocol-buffer library, hand-made bytes and the rows that were written."""

import math

import pytest
from pyspark.sql import functions as F

from framewright.operators import messages as M

ROWS_SCHEMA = f"{M._PLAIN}, detections array<struct<class_id:int,class_name:string,confidence:float,bbox:{M._BOX},track_id:bigint,attributes:map<string,string>>>, extra int"
NAMES = ["stream_id", "frame_seq", "frame_ts", "infer_ts", "latency_ms", "model_id", "frame_local_path", "frame_url", "detections", "extra"]
BOX = (0.0, -0.0, 1.5, 1e30)
ROWS = [
    ("cam", 7, 0.5, -1.0, 250.25, "yolo", "/a", "http://a", [(3, "car", 0.05, BOX, 9, {"k": "v"}), (-2, "", 0.0, (0.0, 0.0, 0.0, 0.0), 0, {})], 1),
    ("Straße " * 40, -1, math.inf, 0.0, 0.0, "", "", "", [(2**31 - 1, "ü" * 300, 1.0, None, -(2**63), {"": ""})], 2),
    (None, None, None, None, None, None, None, None, None, None),
    ("x", 2**63 - 1, 0.0, 0.0, 0.0, "m", None, "u", [None, (None,) * 6, (1, "a", None, (None,) * 4, None, {"a": None})], 3),
    ("many", 300, 1.0, 2.0, 3.0, "m", "p", "u", [(i, f"c{i}", i / 7, (1.0, 2.0, 3.0, float(i)), i * 1000, {"n": str(i)}) for i in range(500)], 4),
    ("many", 300, 1.0, 2.0, 3.0, "m", "p", "u", [], 4),
]


def frame_class():
    """The message as a protocol-buffer library builds it from its description."""
    pytest.importorskip("google.protobuf")
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    kinds = descriptor_pb2.FieldDescriptorProto
    file = descriptor_pb2.FileDescriptorProto(name="frames.proto", package="frames", syntax="proto3")
    types = {"s": kinds.TYPE_STRING, "d": kinds.TYPE_DOUBLE, "f": kinds.TYPE_FLOAT, "u": kinds.TYPE_UINT64, "i": kinds.TYPE_INT32, "l": kinds.TYPE_INT64, "m": kinds.TYPE_MESSAGE}

    def message(at, name, numbers, letters, inner=(), repeated=()):
        m = at.add(name=name)
        for (field, number), letter in zip(numbers.items(), letters):
            f = m.field.add(name=field, number=number, type=types[letter], label=3 if field in repeated else 1)
            if letter == "m":
                f.type_name = dict(inner)[field]
        return m

    message(file.message_type, "Box", M.BOX, "ffff")
    d = message(file.message_type, "Detection", M.DETECTION, "isfmlm", {"bbox": ".frames.Box", "attributes": ".frames.Detection.AttributesEntry"}, {"attributes"})
    message(d.nested_type, "AttributesEntry", M.ENTRY, "ss").options.map_entry = True
    message(file.message_type, "Frame", M.FRAME, "sdddsumss", {"detections": ".frames.Detection"}, {"detections"})
    pool = descriptor_pool.DescriptorPool()
    pool.Add(file)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName("frames.Frame"))


def as_library(cls, row):
    m = cls()
    for name, v in zip(NAMES[:8], row):
        if v is not None:
            setattr(m, name, v % 2**64 if name == "frame_seq" else v)
    for d in row[8] or []:
        if d is None:
            continue
        one = m.detections.add()
        for name, v in zip(M.DETECTION, d):
            if v is None:
                continue
            if name == "bbox":
                one.bbox.SetInParent()
                for side, x in zip(M.BOX, v):
                    if x is not None:
                        setattr(one.bbox, side, x)
            elif name == "attributes":
                for k, x in v.items():
                    one.attributes[k] = x or ""
            else:
                setattr(one, name, v)
    return m


@pytest.fixture(scope="module")
def written(spark):
    rows = spark.createDataFrame(ROWS, ROWS_SCHEMA).coalesce(1)
    return [bytes(r["message"]) for r in M.encode(rows).collect()]


def test_bytes_equal_the_librarys(written):
    cls = frame_class()
    assert written == [as_library(cls, r).SerializeToString(deterministic=True) for r in ROWS]


def test_round_trip(spark, written):
    back = M.decode(spark.createDataFrame([(w,) for w in written], "message binary").coalesce(1)).collect()
    assert [r["error"] for r in back] == [None] * len(ROWS)
    assert [r["frame_seq"] for r in back] == [7, -1, 0, 2**63 - 1, 300, 300]
    assert [r["stream_id"] for r in back] == ["cam", "Straße " * 40, "", "x", "many", "many"]
    assert back[1]["frame_ts"] == math.inf and back[0]["infer_ts"] == -1.0
    first = back[0]["detections"]
    assert [d["class_id"] for d in first] == [3, -2] and first[0]["attributes"] == {"k": "v"} and math.copysign(1, first[0]["bbox"]["y1"]) == -1
    assert back[1]["detections"][0]["bbox"] is None and back[1]["detections"][0]["track_id"] == -(2**63) and back[1]["detections"][0]["attributes"] == {"": ""}
    assert back[2]["detections"] == [] and len(back[3]["detections"]) == 2 and back[3]["detections"][1]["attributes"] == {"a": ""}
    assert [d["bbox"]["y2"] for d in back[4]["detections"]] == list(range(500))


def test_bytes_that_are_no_message(spark):
    box, key = b"\x22\x05\x0d" + b"\0\0\x80\x3f", b"\x0a\x01k"
    cases = {
        "empty": b"",
        "cut": b"\x0a\x05ab",
        "long number": b"\x30" + b"\xff" * 11,
        "group": b"\x0b",
        "field zero": b"\x00\x01",
        "not utf-8": b"\x0a\x02\xff\xfe",
        "inner cut": b"\x3a\x02\x12\x09",
        "unknown": b"\x7a\x01z\x31\x01\x02\x03\x04\x05\x06\x07\x08\x0a\x01a",
        "wrong type": b"\x08\x05\x0a\x01b",
        "twice": b"\x0a\x01a\x0a\x01b",
        "boxes": b"\x3a\x0e" + box + b"\x22\x05\x15" + b"\0\0\0\x40",
        "keys": b"\x3a\x10" + b"\x32\x06" + key + b"\x12\x01x" + b"\x32\x06" + key + b"\x12\x01y",
        "null": None,
    }
    rows = spark.createDataFrame(list(cases.items()), "name string, message binary").coalesce(1)
    back = dict(zip(cases, M.decode(rows).collect()))
    wrong = {"cut", "long number", "group", "field zero", "not utf-8", "inner cut"}
    assert {n for n, r in back.items() if r["error"]} == wrong
    assert all(back[n]["stream_id"] is None and back[n]["detections"] is None for n in [*wrong, "null"])
    assert [back[n]["stream_id"] for n in ("empty", "unknown", "wrong type", "twice")] == ["", "a", "b", "b"]
    assert back["boxes"]["detections"][0]["bbox"].asDict() == {"x1": 1.0, "y1": 2.0, "x2": 0.0, "y2": 0.0}
    assert back["keys"]["detections"][0]["attributes"] == {"k": "y"}
    cls = frame_class()
    for name, data in cases.items():
        if data is None:
            continue
        try:
            read = cls.FromString(data).stream_id
        except Exception:
            assert name in wrong
        else:
            assert read == back[name]["stream_id"]


def test_no_rows_and_subscription(spark):
    none = M.decode(M.encode(spark.createDataFrame([], ROWS_SCHEMA)))
    assert none.count() == 0 and none.columns[-2:] == ["detections", "error"]
    sent = M.encode(spark.createDataFrame(ROWS, ROWS_SCHEMA))
    assert M.subscribed(sent, ["x", "cam"]).count() == 2 and M.subscribed(sent, []).count() == len(ROWS)


def test_stream_of_messages(spark, tmp_path):
    spark.createDataFrame(ROWS, ROWS_SCHEMA).write.parquet(str(tmp_path / "rows"))
    stream = M.decode(M.subscribed(M.encode(spark.readStream.schema(ROWS_SCHEMA).parquet(str(tmp_path / "rows"))), ["many"]))
    counts = stream.select(F.size("detections").alias("n"))
    q = counts.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 500]
