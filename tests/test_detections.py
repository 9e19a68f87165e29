"""Golden rows of boxes, suppression, decoders and tiles, and properties of suppression."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framewright.functions import geometry as G
from framewright.operators import decode, nms

DET = "array<struct<idx:bigint,class_id:bigint,conf:double,x1:double,y1:double,x2:double,y2:double>>"


def box(*v):
    return F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v, ("x1", "y1", "x2", "y2"))])


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("other, want", [((0, 0, 10, 10), 1), ((20, 20, 30, 30), 0), ((10, 0, 20, 10), 0), ((5, 5, 15, 15), 25 / 175), ((2, 2, 8, 8), 0.36)])
def test_iou(spark, other, want):
    a, b = box(0, 0, 10, 10), box(*other)
    assert one(spark, *[G.iou(a, b, k).alias(k) for k in ("decoder", "tracker", "tiles")]) == pytest.approx((want,) * 3)


def kept(spark, rows, threshold):
    df = spark.createDataFrame([([(i, 0, c, *map(float, b)) for i, (c, b) in enumerate(rows)],)], f"dets {DET}")
    return [d.idx for d in df.select(nms.suppress(F.col("dets"), threshold).alias("k")).first().k]


def test_suppression(spark):
    assert kept(spark, [(0.9, (0, 0, 10, 10)), (0.8, (1, 1, 11, 11))], 0.3) == [0]
    assert kept(spark, [(0.9, (0, 0, 10, 10)), (0.8, (50, 50, 60, 60))], 0.5) == [0, 1]
    assert kept(spark, [(0.5, (0, 0, 10, 10)), (0.9, (0, 0, 10, 10))], 0.5) == [1]
    assert kept(spark, [(0.9, (0, 0, 1, 1)), (0.8, (5, 5, 6, 6)), (0.7, (9, 9, 10, 10))], 0.0) == [0, 1, 2]
    assert kept(spark, [], 0.5) == []


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 99), st.integers(0, 8), st.integers(0, 8), st.integers(1, 9), st.integers(1, 9)), max_size=12))
def test_kept_boxes_never_overlap_much(spark, raw):
    rows = [(c / 100, (x, y, x + w, y + h)) for c, x, y, w, h in raw]
    ids = kept(spark, rows, 0.45)

    def iou(a, b):
        i = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        return i / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i)

    assert all(iou(rows[a][1], rows[b][1]) <= 0.45 for a in ids for b in ids if a < b)
    assert all(i in ids or any(iou(rows[i][1], rows[k][1]) > 0.45 for k in ids) for i in range(len(rows)))


def values(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def test_decoders(spark):
    v5 = values(0.5, 0.5, 0.2, 0.2, 0.95, 0.1, 0.95, 0, *[0] * 8)
    d = one(spark, decode.v5(v5, 2, 3, 0.4).alias("d")).d
    assert len(d) == 1 and d[0].class_id == 1 and d[0].conf == pytest.approx(0.9025)
    pixel = values(480, 270, 100, 80, 0.95, 0, 0, 0, 0.95)
    d = one(spark, decode.v5(pixel, 1, 4, 0.4, 960, 960).alias("d")).d
    assert (d[0].x1, d[0].y1, d[0].x2, d[0].y2) == (430, 230, 530, 310)
    v8 = values(320, 240, 100, 80, 0.1, 0.9)
    d = one(spark, decode.v8(v8, 2, 1, 0.4).alias("d")).d
    assert (d[0].class_id, d[0].x1, d[0].y1, d[0].x2, d[0].y2) == (1, 270, 200, 370, 280)
    d = one(spark, decode.v26(values(270, -5, 370, 700, 0.91, 6.6, *[0] * 6), 2, 0.4).alias("d")).d
    assert len(d) == 1 and (d[0].class_id, d[0].y1, d[0].y2) == (7, 0, 640)
    d = one(spark, decode.classify(values(0.1, 0.8, 0.3), 0.5).alias("a"), decode.classify(values(0.1, 0.3, 0.2), 0.5).alias("b"))
    assert d.a[0].class_id == 1 and d.b == []


def test_tiles_cover_the_frame(spark):
    t = one(spark, G.tiles(1920, 1144, 960, 1144, 0.0, 0.0).alias("t")).t
    assert [(x.x, x.y, x.w, x.h) for x in t] == [(0, 0, 960, 1144), (960, 0, 960, 1144)]
    t = one(spark, G.tiles(1000, 500, 640, 640, 0.2, 0.2).alias("t")).t
    assert {(x.x, x.w) for x in t} == {(0, 640), (360, 640)} and all(x.h == 500 for x in t)
