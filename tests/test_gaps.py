"""Placeholders and their errors, configuration files, tiles and latencies of streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from framewright.functions import text as T
from framewright.sources.catalog import load_config
from framewright.streaming.state import complete_tiles, latency_windows

CONFIG = """
sources: [{id: s}]
models: [{id: m, cascade: [{model_id: n}]}, {id: n}]
pipelines: [{id: p, nodes: [{id: a}, {id: b}], edges: [{from: a, to: b}]}]
tasks: [{id: t, source_id: s, pipeline_id: p}]
"""


def test_placeholders(spark):
    cases = [
        ("x/{task_id}/{source_id}/{task_id}", "x/{source_id}/S/{source_id}", None),  # a name with braces is not filled in again
        ("plain", "plain", None),
        ("", "", None),
        ("a}b{task_id}", "a}b{source_id}", None),
        ("{task_id}{x}{y", None, "unsupported placeholder {x}"),
        ("{}", None, "unsupported placeholder {}"),
        ("{{task_id}", None, "unsupported placeholder {{task_id}"),
        ("{source_id}\n{task_id", None, "unterminated placeholder"),
        (None, None, None),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "i int, t string")
    got = rows.select("i", T.placeholders(F.col("t"), F.lit("{source_id}"), F.lit("S")).alias("u"), T.placeholder_error(F.col("t")).alias("e")).orderBy("i").collect()
    assert [(r["u"], r["e"]) for r in got] == [c[1:] for c in cases]


@pytest.mark.parametrize(
    "old, new, error",
    [
        ("{id: s}", "{id: s}, {id: s}", "duplicate ids in sources"),
        ("model_id: n", "model_id: z", "names unknown model z"),
        ("source_id: s", "source_id: z", "unknown source or pipeline"),
        ("to: b", "to: z", "unknown node"),
        ("to: b}", "to: b}, {from: b, to: a}", "cycle"),
    ],
)
def test_load_config(tmp_path, old, new, error):
    pytest.importorskip("yaml")
    path = tmp_path / "c.yaml"
    path.write_text(CONFIG)
    assert load_config(str(path))["tasks"][0]["id"] == "t"
    path.write_text(CONFIG.replace(old, new, 1))
    with pytest.raises(ValueError, match=error):
        load_config(str(path))


def test_empty_config(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("")
    assert load_config(str(tmp_path / "c.yaml")) == {}


def streamed(spark, rows, schema, tmp_path, form):
    """What ``form`` emits over a stream of one batch and one that moves the watermark on."""
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = form(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        q.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    return spark.read.parquet(str(tmp_path / "out"))


def test_tiles_of_a_stream(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(seconds=s)
    schema = "stream_id string, parent_seq bigint, tile_seq bigint, ts timestamp, expected int"
    first = [("a", 1, k, at(k / 10), 3) for k in (12, 10, 11)] + [("a", 2, 20, at(1), 2), ("b", 1, 30, at(0), 2), ("b", 1, 31, at(9), 2)]
    out = streamed(spark, [first, [("z", 9, 1, at(60), 5)]], schema, tmp_path, complete_tiles)
    assert [tuple(r) for r in out.collect()] == [("a", 1, 3, 10)]


def test_latencies_of_a_stream(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(seconds=s)
    schema = "stream_id string, ts timestamp, latency_ms double"
    first = [("a", at(1), 10.0), ("a", at(59), 20.0), ("a", at(60), 99.0), ("b", at(2), None)]
    out = streamed(spark, [first, [("a", at(400), 1.0)]], schema, tmp_path, latency_windows)
    got = {(r["stream_id"], r["w"]["start"]): (r["n"], r["mean"]) for r in out.collect()}
    assert got == {("a", at(0)): (2, 15.0), ("b", at(0)): (1, None), ("a", at(60)): (1, 99.0)}
