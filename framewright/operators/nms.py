"""Greedy non-maximum suppression as a fold over a frame's detections, best confidence first, ties by index.

The fold stays in the frame's own row: no join between detections and no shuffle beyond the one that made the frame.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framewright.functions.geometry import area, intersection


def ranked(dets: Column) -> Column:
    """Detections by falling confidence, ties by index."""
    return F.array_sort(dets, lambda a, b: F.when(a["conf"] > b["conf"], -1).when(a["conf"] < b["conf"], 1).when(a["idx"] < b["idx"], -1).when(a["idx"] > b["idx"], 1).otherwise(0))


def _fold(dets: Column, suppresses) -> Column:
    best = ranked(dets)
    none = F.slice(best, 1, 0)
    return F.aggregate(best, none, lambda kept, d: F.when(F.exists(kept, lambda k: suppresses(k, d)), kept).otherwise(F.array_append(kept, d)))


def suppress(dets: Column, threshold: float) -> Column:
    """Class-agnostic: a detection goes if it overlaps a kept one by more than ``threshold``."""
    over = lambda k, d: (intersection(k, d) > 0) & (intersection(k, d) > threshold * (area(k) + area(d) - intersection(k, d)))
    return _fold(dets, over)


def suppress_tiles(dets: Column, iou: float = 0.55, ios: float = 0.8) -> Column:
    """Class-aware, for merged tiles: same class and IoU of ``iou`` or more, or intersection over the smaller area of ``ios`` or more."""

    def over(k, d):
        i = intersection(k, d)
        union, small = area(k) + area(d) - i, F.least(area(k), area(d))
        return (k["class_id"] == d["class_id"]) & (((union > 0) & (i >= iou * union)) | ((small > 0) & (i >= ios * small)))

    return _fold(dets, over)
