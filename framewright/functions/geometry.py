"""Boxes as expressions: areas, overlaps, crops, tiles, windows of interest, drawing rectangles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def width(b: Column) -> Column:
    return b["x2"] - b["x1"]


def height(b: Column) -> Column:
    return b["y2"] - b["y1"]


def area(b: Column) -> Column:
    return width(b) * height(b)


def intersection(a: Column, b: Column) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    return w * h


def iou(a: Column, b: Column, kind: str = "decoder") -> Column:
    """Intersection over union. Without overlap, the decoder's is 0; the tracker's union is 1e-6 at least; the tile merge's is 0 without a union."""
    i = intersection(a, b)
    union = area(a) + area(b) - i
    if kind == "tracker":
        return i / F.greatest(union, F.lit(1e-6))
    if kind == "tiles":
        return F.when(union <= 0, 0.0).otherwise(F.try_divide(i, union))
    return F.when(i == 0, 0.0).otherwise(F.try_divide(i, union))


def ios(a: Column, b: Column) -> Column:
    """Intersection over the smaller area, 0 where that is not positive."""
    small = F.least(area(a), area(b))
    return F.when(small <= 0, 0.0).otherwise(F.try_divide(intersection(a, b), small))


def scaled(b: Column, sx, sy) -> Column:
    """Stretched to frame size; corners never below 0, unless nothing is scaled."""
    sx, sy = num(sx), num(sy)
    move = lambda v, s: F.when((sx == 1) & (sy == 1), v).otherwise(F.greatest(F.lit(0.0), v * s))
    return b.withField("x1", move(b["x1"], sx)).withField("y1", move(b["y1"], sy)).withField("x2", move(b["x2"], sx)).withField("y2", move(b["y2"], sy))


def shifted(b: Column, dx, dy) -> Column:
    dx, dy = num(dx), num(dy)
    return b.withField("x1", b["x1"] + dx).withField("y1", b["y1"] + dy).withField("x2", b["x2"] + dx).withField("y2", b["y2"] + dy)


def crop_rect(b: Column, expand, w, h) -> Column:
    """The box grown by a share of its size on each side, truncated to whole pixels inside the frame, one pixel at least."""
    e, w, h = num(expand), num(w), num(h)
    dx, dy = width(b) * e, height(b) * e
    left = F.greatest(F.lit(0), F.least((b["x1"] - dx).cast("int"), w - 1))
    top = F.greatest(F.lit(0), F.least((b["y1"] - dy).cast("int"), h - 1))
    right = F.least(w, (b["x2"] + dx).cast("int"))
    bottom = F.least(h, (b["y2"] + dy).cast("int"))
    return F.struct(left.alias("x"), top.alias("y"), F.greatest(F.lit(1), right - left).alias("w"), F.greatest(F.lit(1), bottom - top).alias("h"))


def draw_rect(b: Column, w, h) -> Column:
    """Floor of the least corner, ceiling of the greatest, inside the frame."""
    w, h = num(w), num(h)
    left, top = F.greatest(F.lit(0), F.floor(b["x1"]).cast("int")), F.greatest(F.lit(0), F.floor(b["y1"]).cast("int"))
    right, bottom = F.least(w, F.ceil(b["x2"]).cast("int")), F.least(h, F.ceil(b["y2"]).cast("int"))
    return F.struct(left.alias("x"), top.alias("y"), (right - left).alias("w"), (bottom - top).alias("h"))


def axis_starts(full, tile, overlap) -> Column:
    """Where tiles begin along an axis: steps of the tile less its overlap, the last one ending with the frame."""
    full, tile = num(full), num(tile)
    step = F.greatest(F.lit(1), (tile * (1 - num(overlap))).cast("int"))
    last = full - tile
    return F.when(last <= 0, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(F.filter(F.sequence(F.lit(0), last, step), lambda s: s < last), F.array(last))))


def tiles(full_w, full_h, tile_w, tile_h, overlap_x, overlap_y) -> Column:
    """The grid of tiles, by row."""
    full_w, full_h, tile_w, tile_h = map(num, (full_w, full_h, tile_w, tile_h))
    xs, ys = axis_starts(full_w, tile_w, overlap_x), axis_starts(full_h, tile_h, overlap_y)
    one = lambda x, y: F.struct(y.alias("y"), x.alias("x"), F.least(tile_w, full_w - x).alias("w"), F.least(tile_h, full_h - y).alias("h"))
    return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: one(x, y))))


def roi_window(b: Column, expand, least, w, h) -> Column:
    """A window around a box's centre: its size grown by a share, never below ``least``, clipped to the frame and not moved back."""
    w, h, least = num(w), num(h), num(least)
    cx, cy = (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2
    ww, hh = F.greatest(width(b) * (1 + num(expand)), least), F.greatest(height(b) * (1 + num(expand)), least)
    x, y = F.greatest(F.lit(0), F.floor(cx - ww / 2).cast("int")), F.greatest(F.lit(0), F.floor(cy - hh / 2).cast("int"))
    return F.struct(y.alias("y"), x.alias("x"), (F.least(w, F.ceil(cx + ww / 2).cast("int")) - x).alias("w"), (F.least(h, F.ceil(cy + hh / 2).cast("int")) - y).alias("h"))
