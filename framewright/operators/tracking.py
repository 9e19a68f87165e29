"""Multi-object tracking: constant-velocity prediction, two-step matching by optimal assignment, keyed by stream.

Each frame: tracks move on by their velocity; confident detections are matched to tracks first, weak ones to the tracks left over; tracks
without a match age and go once they were lost for more than ``max_lost`` frames; unmatched confident detections
start tracks. A track's number is shown once it was hit ``min_hits`` times. Matching maximises total overlap (float64) among pairs of ``min_iou`` or more:
others are priced out before. Unions are 1e-6 at least. Frames are taken in order of frame_seq, whatever order they came in. Classes do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRICED_OUT = 1e6


@dataclass
class Config:
    high: float = 0.5
    low: float = 0.1
    min_iou: float = 0.3
    min_hits: int = 2
    max_lost: int = 30


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, by shortest augmenting paths with potentials."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    nearest = c.argmin(1).tolist()
    if len(set(nearest)) == n:  # each row has its least cost: what the search below would find
        pairs = list(enumerate(nearest))
        return sorted((j, i) for i, j in pairs) if flip else pairs
    rows, u, v, owner = c.tolist(), [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)  # lists: frames are small, calls of NumPy would cost more
    for row in range(1, n + 1):
        owner[0], col = row, 0
        least, back, done, free = [np.inf] * (m + 1), [0] * (m + 1), [0], list(range(1, m + 1))
        while True:
            costs, base, nxt = rows[owner[col] - 1], u[owner[col]], 0
            for j in free:
                reduced = costs[j - 1] - base - v[j]
                if reduced < least[j]:
                    least[j], back[j] = reduced, col
                if not nxt or least[j] < least[nxt]:
                    nxt = j
            step = least[nxt]
            for j in done:
                u[owner[j]] += step
                v[j] -= step
            for j in free:
                least[j] -= step
            free.remove(nxt)
            done.append(nxt)
            col = nxt
            if owner[col] == 0:
                break
        while col:
            owner[col] = owner[back[col]]
            col = back[col]
    pairs = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((b, a) for a, b in pairs) if flip else sorted(pairs)


def prepared(boxes: np.ndarray, conf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[float]]:
    """Corners (4, n), areas, middles (2, n) and confidences of the detections of one or more frames, for :meth:`Tracker.step`."""
    box = np.ascontiguousarray(boxes.T)
    return box, (box[2] - box[0]) * (box[3] - box[1]), (box[:2] + box[2:]) / 2, conf.tolist()


def _match(pairs: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """(track, detection) of least total cost among ``pairs``, which come by detection, then by track; what has no pair takes no part."""
    if len(pairs) < 2:
        return [p[:2] for p in pairs]
    rows, cols = {p[0] for p in pairs}, {p[1] for p in pairs}
    side = len(rows) > len(cols)
    best: dict[int, tuple] = {}
    for p in pairs:
        if (old := best.get(p[side])) is None or p[2] < old[2]:
            best[p[side]] = p
    if len({p[1 - side] for p in best.values()}) == len(best):  # each has its least cost
        return [p[:2] for p in best.values()]
    order, places = sorted(rows), sorted(cols)
    row, col = {t: i for i, t in enumerate(order)}, {d: i for i, d in enumerate(places)}
    cost = np.full((len(order), len(places)), PRICED_OUT)
    cost[[row[p[0]] for p in pairs], [col[p[1]] for p in pairs]] = [p[2] for p in pairs]
    return [(order[i], places[j]) for i, j in assign(cost) if cost[i, j] != PRICED_OUT]


class Tracker:
    """The tracks of one stream: columns of ``state``, of which the first ``n`` are in use. Its rows are four corners, the speed twice, hits, frames lost, number."""

    SPEED, HITS, LOST, NUMBER, ROWS = slice(4, 8), 8, 9, 10, 11

    def __init__(self, config: Config):
        self.c, self.next, self.n = config, 1, 0
        self.state = np.zeros((self.ROWS, 64))

    def update(self, boxes: np.ndarray, conf: np.ndarray) -> list[int | None]:
        """Takes a frame's detections; returns each one's track number, or None."""
        return self.step(*prepared(boxes, conf), 0, len(boxes))

    def step(self, box: np.ndarray, area: np.ndarray, mid: np.ndarray, conf: list[float], i: int, j: int) -> list[int | None]:
        """:meth:`update` with the detections i to j of those that were :func:`prepared`. A frame is small, so few calls of NumPy count most."""
        c, n, k = self.c, self.n, j - i
        t = self.state[:, :n]
        t[:4] += t[self.SPEED]
        side = np.minimum(t[2:4, None], box[2:, i:j, None])
        side -= np.maximum(t[:2, None], box[:2, i:j, None])
        np.maximum(side, 0, out=side)
        near = side[0] * side[1]
        size = (t[2] - t[0]) * (t[3] - t[1])
        near /= np.maximum(size + area[i:j, None] - near, 1e-6)
        near = near.ravel()
        at = (near >= c.min_iou).nonzero()[0]
        sure, weak = [], []
        for x, cost in zip(at.tolist(), (1 - near[at]).tolist()):
            d = x // n
            if (seen := conf[i + d]) >= c.high:
                sure.append((x % n, d, cost))
            elif seen >= c.low:
                weak.append((x % n, d, cost))
        got = _match(sure)
        taken, met = {d for _, d in got}, {r for r, _ in got}
        fresh = [d for d in range(k) if d not in taken and conf[i + d] >= c.high]
        if weak and (weak := [p for p in weak if p[0] not in met]):
            got += _match(weak)
        t[self.LOST] += 1
        shown: list[int | None] = [None] * k
        if got:
            rows, cols = [r for r, _ in got], [i + d for _, d in got]
            m = t[:, rows]
            old = m[:4] - m[self.SPEED]
            m[4:6] = m[6:8] = mid[:, cols] - (old[:2] + old[2:]) / 2
            m[:4] = box[:, cols]
            m[self.HITS] += 1
            m[self.LOST] = 0
            t[:, rows] = m
            for (_, d), hits, number in zip(got, m[self.HITS].tolist(), m[self.NUMBER].tolist()):
                if hits >= c.min_hits:
                    shown[d] = int(number)
        if n and t[self.LOST].max() > c.max_lost:
            kept = t[:, t[self.LOST] <= c.max_lost]
            self.n = kept.shape[1]
            self.state[:, : self.n] = kept
        if fresh:
            new = np.zeros((self.ROWS, len(fresh)))
            new[:4] = box[:, [i + d for d in fresh]]
            new[self.HITS] = 1
            new[self.NUMBER] = numbers = range(self.next, self.next + len(fresh))
            if self.n + len(fresh) > self.state.shape[1]:
                self.state = np.concatenate([self.state[:, : self.n], new, np.zeros((self.ROWS, self.n + 64))], 1)
            self.state[:, self.n : self.n + len(fresh)] = new
            if c.min_hits <= 1:
                for d, number in zip(fresh, numbers):
                    shown[d] = number
            self.n, self.next = self.n + len(fresh), self.next + len(fresh)
        return shown


def track(dets: DataFrame, config: Config | None = None) -> DataFrame:
    """``dets`` (stream_id, frame_seq, idx, conf, x1, y1, x2, y2) with track_id; streams are dealt over tasks, sorted and followed batch by batch.

    Columns stay NumPy arrays and a frame is a slice of them; a frame that a batch cuts in two waits for its rest. There are eight
    parts a core at least, so that streams seldom share a part and free cores take the next one."""
    c, names = config or Config(), ["stream_id", "frame_seq", "idx", "conf", "x1", "y1", "x2", "y2"]

    def run(batches):
        stream, tracker, held = None, None, None

        def follow(rows: pa.Table, last: bool):
            nonlocal stream, tracker
            own = rows.column(0).to_pylist()
            seq, conf = rows.column(1).to_numpy(), rows.column(3).to_numpy()
            dets = prepared(np.stack([rows.column(i).to_numpy() for i in range(4, 8)], 1), conf)
            moved = np.fromiter((a != b for a, b in zip(own, own[1:])), bool, len(own) - 1) | (seq[1:] != seq[:-1])
            edges = [0, *(np.flatnonzero(moved) + 1).tolist(), *[len(own)] * last]
            shown: list = []
            for i, j in zip(edges, edges[1:]):
                if tracker is None or own[i] != stream:
                    stream, tracker = own[i], Tracker(c)
                shown += tracker.step(*dets, i, j)
            n = edges[-1]
            done = rows.slice(0, n).select(names[:3]).append_column("track_id", pa.array(shown, pa.int64()))
            return done.combine_chunks().to_batches(), rows.slice(n)

        for b in batches:
            rows = pa.Table.from_batches([b])
            rows = pa.concat_tables([held, rows]) if held is not None and held.num_rows else rows
            if rows.num_rows:
                out, held = follow(rows, False)
                yield from out
        if held is not None and held.num_rows:
            yield from follow(held, True)[0]

    kind = dets.schema["stream_id"].dataType
    kind = "string" if kind.typeName() == "string" else "bigint"
    spark = dets.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    rows = dets.select(F.col("stream_id").cast(kind), *[F.col(x).cast("bigint") for x in names[1:3]], *[F.col(x).cast("double") for x in names[3:]])
    return rows.repartition(parts, "stream_id").sortWithinPartitions("stream_id", "frame_seq", "idx").mapInArrow(run, f"stream_id {kind}, frame_seq bigint, idx bigint, track_id bigint")
