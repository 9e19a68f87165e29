"""Exposition text with escapes, empty families and odd lines; what is rendered is read back."""

import math

from framewright.functions import exposition as X
from framewright.functions import metrics as M
from pyspark.sql import functions as F


def test_text_is_read_back(spark):
    odd = [('a"b\\n\\', 3.0), ("line\nend", 4.0), ("", 5.0), (None, 6.0)]
    rows = spark.createDataFrame(odd, "cam string, value double")
    hist = M.histogram(spark.createDataFrame([("x", 0.5), ("x", 7.0), ("y", 5000.0)], "cam string, v double"), F.col("v"), "cam")
    one = spark.createDataFrame([(7,)], "value bigint")
    none = one.limit(0)
    families = [X.Family("odd_total", "counter", "Odd\nnames", rows, "cam"), X.Family("wait_ms", "histogram", "Waits", hist, "cam"), X.Family("depth", "gauge", "Depth", one), X.Family("gone", "gauge", "None", none)]
    lines = X.render(families)
    whole = X.text(lines)
    assert whole.splitlines()[:2] == ["# HELP odd_total Odd\\nnames", "# TYPE odd_total counter"]
    assert 'odd_total{cam="a\\"b\\\\n\\\\"} 3\n' in whole and 'wait_ms_bucket{cam="x",le="+Inf"} 2\nwait_ms_sum{cam="x"} 7.500\nwait_ms_count{cam="x"} 2\n' in whole
    assert whole.endswith("# TYPE depth gauge\ndepth 7\n# HELP gone None\n# TYPE gone gauge\n")
    split = spark.createDataFrame([(x, 5) for x in whole.split("\n")], "line string, t_ms bigint")
    got = X.parse(split)
    assert got.columns == ["t_ms", "metric", "labels", "value"]
    assert {(r.labels["cam"], r.value) for r in got.where("metric = 'odd_total'").collect()} == {(a or "", v) for a, v in odd}
    buckets = {(r.labels["cam"], r.labels["le"]): r.value for r in got.where("metric = 'wait_ms_bucket'").collect()}
    assert len(buckets) == 22 and buckets["x", "1"] == 1 and buckets["x", "10"] == 2 and buckets["y", "1000"] == 0
    assert {tuple(r) for r in X.kinds(split).collect()} == {("odd_total", "counter"), ("wait_ms", "histogram"), ("depth", "gauge"), ("gone", "gauge")}


def test_odd_lines(spark):
    lines = ["", "  ", "# a comment", "up 1", "up{} 2", 'x{a="}",b=" 9"} 3 1700000000', "y NaN", "z -Inf", "no value", "9bad 1", "w 1e3", None]
    got = [(r.metric, dict(r.labels), r.value) for r in X.parse(spark.createDataFrame([(x,) for x in lines], "line string")).collect()]
    assert got[:3] == [("up", {}, 1), ("up", {}, 2), ("x", {"a": "}", "b": " 9"}, 3)]
    assert got[3][0] == "y" and math.isnan(got[3][2]) and got[4:] == [("z", {}, float("-inf")), ("w", {}, 1000)]
