"""Raw model outputs to detections, as array expressions: layouts v5 (rows), v8 (columns), v26 (six values), classifier.

Thresholds are compared in double. Scores that are not positive give class 0 with probability 0, as the first maximum from 0.0 does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _best(scores: Column) -> tuple[Column, Column]:
    top = F.greatest(F.lit(0.0), F.array_max(scores))
    return F.when(top > 0, F.array_position(scores, top) - 1).otherwise(F.lit(0).cast("bigint")), top


def _corners(cx: Column, cy: Column, w: Column, h: Column, wide: float, high: float) -> list[Column]:
    """Corners from a centre and a size: the lower bound holds for the first corner, the upper one for the second."""
    return [
        F.greatest(F.lit(0.0), cx - w / 2).alias("x1"),
        F.greatest(F.lit(0.0), cy - h / 2).alias("y1"),
        F.least(F.lit(float(wide)), cx + w / 2).alias("x2"),
        F.least(F.lit(float(high)), cy + h / 2).alias("y2"),
    ]


def v8(v: Column, classes: int, anchors: int, conf: float, wide: float = 640, high: float = 640) -> Column:
    """[4 + classes, anchors], anchor by anchor: best class at ``conf`` or more."""
    at = lambda c, j: F.get(v, c * anchors + j)

    def one(j):
        cls, top = _best(F.array(*[at(4 + c, j) for c in range(classes)]))
        return F.struct(j.cast("bigint").alias("idx"), cls.alias("class_id"), top.alias("conf"), *_corners(at(0, j), at(1, j), at(2, j), at(3, j), wide, high))

    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(anchors - 1)), one), lambda d: d["conf"] >= conf)


def v5(v: Column, rows: int, classes: int, conf: float, wide: float = 640, high: float = 640) -> Column:
    """[rows, 5 + classes]: objectness first, then objectness times class; coordinates are pixels if any of the first 64 rows exceeds 1.5."""
    step = 5 + classes
    at = lambda j, c: F.get(v, j * step + c)
    pixels = F.exists(F.sequence(F.lit(0), F.lit(min(rows, 64) - 1)), lambda j: F.greatest(*[at(j, c) for c in range(4)]) > 1.5)
    sx, sy = F.when(pixels, 1.0).otherwise(float(wide)), F.when(pixels, 1.0).otherwise(float(high))

    def one(j):
        cls, top = _best(F.array(*[at(j, 5 + c) for c in range(classes)]))
        box = _corners(at(j, 0) * sx, at(j, 1) * sy, at(j, 2) * sx, at(j, 3) * sy, wide, high)
        return F.struct(j.cast("bigint").alias("idx"), cls.alias("class_id"), (at(j, 4) * top).alias("conf"), *box, at(j, 4).alias("obj"))

    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), one), lambda d: (d["obj"] >= conf) & (d["conf"] >= conf))


def v26(v: Column, rows: int, conf: float, wide: float = 640, high: float = 640) -> Column:
    """[rows, 6] of corners, confidence and class; no suppression; all corners are clamped and the class rounded half away from zero."""
    at = lambda j, c: F.get(v, j * 6 + c)
    clamp = lambda x, top: F.least(F.lit(float(top)), F.greatest(F.lit(0.0), x))
    one = lambda j: F.struct(j.cast("bigint").alias("idx"), F.round(at(j, 5)).cast("bigint").alias("class_id"), at(j, 4).alias("conf"), clamp(at(j, 0), wide).alias("x1"), clamp(at(j, 1), high).alias("y1"), clamp(at(j, 2), wide).alias("x2"), clamp(at(j, 3), high).alias("y2"))
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), one), lambda d: d["conf"] >= conf)


def classify(scores: Column, conf: float) -> Column:
    """The first largest score as a list of one (class_id, conf), empty below ``conf``."""
    top = F.array_max(scores)
    one = F.struct((F.array_position(scores, top) - 1).alias("class_id"), top.alias("conf"))
    return F.filter(F.array(one), lambda d: d["conf"] >= conf)


def anchor_count(w: int, h: int) -> int:
    return sum((w // s) * (h // s) for s in (8, 16, 32))


def class_name(names: Column, class_id: Column, fallback: bool = False) -> Column:
    """The name of a class inside the list, else empty, or the number as text for classifiers."""
    return F.when((class_id >= 0) & (class_id < F.size(names)), F.get(names, class_id.cast("int"))).otherwise(class_id.cast("string") if fallback else F.lit(""))
