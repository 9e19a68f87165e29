"""Frame messages on the wire: result rows to bytes and back, in Arrow batches of many rows, for tables and streams.

The message has nine fields, its detections six, a box four floats. Fields of zero, empty texts and empty lists are not written.

Defined results: a null number is zero and a null text is empty; null lists have no detections and null elements are left out; a null
map has no attributes, a null attribute is empty. Of a field that comes twice the last stands, boxes that come twice are put together,
fields of other numbers or wire types are skipped. Bytes that are no message give null columns and a text in ``error``;
null bytes give null columns and no error. Empty bytes are a message of zeros. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions import wire as W

#: Field numbers, fixed values.
FRAME = {"stream_id": 1, "frame_ts": 2, "infer_ts": 3, "latency_ms": 4, "model_id": 5, "frame_seq": 6, "detections": 7, "frame_local_path": 8, "frame_url": 9}
DETECTION = {"class_id": 1, "class_name": 2, "confidence": 3, "bbox": 4, "track_id": 5, "attributes": 6}
BOX = {"x1": 1, "y1": 2, "x2": 3, "y2": 4}
ENTRY = {"key": 1, "value": 2}

_BOX = "struct<x1:float,y1:float,x2:float,y2:float>"
_DETECTIONS = "array<struct<class_id:int,class_name:string,confidence:float,bbox:{box},track_id:bigint,attributes:{attributes}>>"
_ENTRIES = "array<struct<key:string,value:string>>"
_PLAIN = "stream_id string, frame_seq bigint, frame_ts double, infer_ts double, latency_ms double, model_id string, frame_local_path string, frame_url string"
_ARROW_BOX = pa.struct([(c, pa.float32()) for c in BOX])
_ARROW_ENTRIES = pa.list_(pa.struct([(c, pa.string()) for c in ENTRY]))
_ARROW_DETECTION = pa.struct([("class_id", pa.int32()), ("class_name", pa.string()), ("confidence", pa.float32()), ("bbox", _ARROW_BOX), ("track_id", pa.int64()), ("attributes", _ARROW_ENTRIES)])


def _items(lists: pa.Array) -> tuple[dict[str, pa.Array], np.ndarray]:
    """(columns of the list's elements that are not null, the row of each)."""
    size = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    owner, items = np.repeat(np.arange(len(lists)), size), lists.flatten()
    there = items.is_valid()
    items, owner = items.filter(there), owner[there.to_numpy(zero_copy_only=False)]
    return dict(zip([f.name for f in items.type], items.flatten())), owner


def _numbers(column: pa.Array, dtype) -> np.ndarray:
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(dtype)


def _boxes(column: pa.Array) -> W.Ragged:
    sides = dict(zip([f.name for f in column.type], column.flatten()))
    held = W.beside(*[W.reals(n, _numbers(sides[c], "<f4")) for c, n in BOX.items()])
    return W.texts(DETECTION["bbox"], held, column.is_valid().to_numpy(zero_copy_only=False))


def _attributes(column: pa.Array) -> W.Ragged:
    """Entries have both their fields, empty ones too."""
    entries, owner = _items(column)
    every = np.ones(len(owner), bool)
    held = W.beside(*[W.texts(n, W.ragged(entries[c]), every) for c, n in ENTRY.items()])
    return W.gathered(W.texts(DETECTION["attributes"], held, every), owner, len(column))


def _detections(column: pa.Array) -> W.Ragged:
    d, owner = _items(column)
    parts = [
        W.whole_numbers(DETECTION["class_id"], _numbers(d["class_id"], np.int64)),
        W.texts(DETECTION["class_name"], W.ragged(d["class_name"])),
        W.reals(DETECTION["confidence"], _numbers(d["confidence"], "<f4")),
        _boxes(d["bbox"]),
        W.whole_numbers(DETECTION["track_id"], _numbers(d["track_id"], np.int64)),
        _attributes(d["attributes"]),
    ]
    held = W.texts(FRAME["detections"], W.beside(*parts), np.ones(len(owner), bool))
    return W.gathered(held, owner, len(column))


def _written(batch: pa.RecordBatch) -> pa.Array:
    """The messages of a batch; fields stand in order of their numbers."""
    of = lambda c: batch.column(batch.schema.get_field_index(c))
    parts = []
    for c, n in FRAME.items():
        if c == "detections":
            parts.append(_detections(of(c)))
        elif c == "frame_seq":
            parts.append(W.whole_numbers(n, _numbers(of(c), np.int64)))
        else:
            parts.append(W.reals(n, _numbers(of(c), "<f8")) if pa.types.is_floating(of(c).type) else W.texts(n, W.ragged(of(c))))
    flat, size = W.beside(*parts)
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(flat)]).cast(pa.binary())


def encode(results: DataFrame) -> DataFrame:
    """(stream_id, frame_seq, message) of result rows whose detections have the shape of ``results.frame_detections``."""
    entries = lambda d: F.transform(F.map_entries(d["attributes"].cast("map<string,string>")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    one = lambda d: F.when(d.isNotNull(), F.struct(*[d[c].alias(c) for c in list(DETECTION)[:-1]], entries(d).alias("attributes")))
    plain = [F.col(c).cast(t).alias(c) for c, t in (x.split() for x in _PLAIN.split(", "))]
    rows = results.select(*plain, F.transform("detections", one).cast(_DETECTIONS.format(box=_BOX, attributes=_ENTRIES)).alias("detections"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _written(b)], names=["stream_id", "frame_seq", "message"])

    return rows.mapInArrow(run, "stream_id string, frame_seq bigint, message binary")


class _Reader:
    """The fields of one level of messages; faults of a level's texts are marked in ``bad``."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray):
        self.data, self.rows = data, len(begin)
        self.f = W.fields(data, begin, size)
        self.bad = self.f.bad.copy()

    def whole(self, number: int, dtype=np.int64) -> np.ndarray:
        out = np.zeros(self.rows, dtype)
        rows, at = self.f.last(number, W.VARINT)
        out[rows] = self.f.value[at].view(np.int64).astype(dtype)
        return out

    def real(self, number: int, width: int) -> np.ndarray:
        out = np.zeros(self.rows, f"<f{width}")
        rows, at = self.f.last(number, W.FLOAT if width == 4 else W.DOUBLE)
        out[rows] = self.data[self.f.begin[at][:, None] + np.arange(width)].view(f"<f{width}").ravel()
        return out

    def text(self, number: int) -> pa.Array:
        begin, size = np.zeros(self.rows, np.int64), np.zeros(self.rows, np.int64)
        rows, at = self.f.last(number, W.BYTES)
        begin[rows], size[rows] = self.f.begin[at], self.f.size[at]
        out, wrong = W.read_texts(self.data, begin, size)
        self.bad |= wrong
        return out

    def inner(self, number: int) -> tuple["_Reader", np.ndarray]:
        """(messages under a number, the row of each)."""
        of = self.f.of(number, W.BYTES)
        return _Reader(self.data, self.f.begin[of], self.f.size[of]), self.f.row[of]

    def take_faults(self, inner: "_Reader", owner: np.ndarray) -> None:
        self.bad[owner[inner.bad]] = True


def _lists(owner: np.ndarray, rows: int, items: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)), items)


def _read_boxes(d: _Reader) -> pa.Array:
    boxes, owner = d.inner(DETECTION["bbox"])
    d.take_faults(boxes, owner)
    there, sides = np.zeros(d.rows, bool), []
    there[owner] = True
    for n in BOX.values():
        rows, at = boxes.f.last(n, W.FLOAT)
        values, side = boxes.real(n, 4), np.zeros(d.rows, "<f4")
        side[owner[rows]] = values[rows]  # boxes stand in order, so the last that has the side is kept
        sides.append(pa.array(side))
    return pa.StructArray.from_arrays(sides, names=list(BOX), mask=pa.array(~there))


def _read_attributes(d: _Reader) -> pa.Array:
    entries, owner = d.inner(DETECTION["attributes"])
    key, value = (entries.text(n) for n in ENTRY.values())
    d.take_faults(entries, owner)
    latest = {pair: i for i, pair in enumerate(zip(owner.tolist(), key.to_pylist()))}  # the last entry of a key stands
    keep = np.sort(np.fromiter(latest.values(), np.int64, len(latest)))
    items = pa.StructArray.from_arrays([key.take(pa.array(keep)), value.take(pa.array(keep))], names=list(ENTRY))
    return _lists(owner[keep], d.rows, items)


def _read(messages: pa.Array) -> pa.RecordBatch:
    flat, size = W.ragged(messages)
    data = np.concatenate([flat, np.zeros(10, np.uint8)])
    m = _Reader(data, np.cumsum(size) - size, size)
    d, owner = m.inner(FRAME["detections"])
    columns = {
        "class_id": pa.array(d.whole(DETECTION["class_id"], np.int32)),
        "class_name": d.text(DETECTION["class_name"]),
        "confidence": pa.array(d.real(DETECTION["confidence"], 4)),
        "bbox": _read_boxes(d),
        "track_id": pa.array(d.whole(DETECTION["track_id"])),
        "attributes": _read_attributes(d),
    }
    texts = {c: m.text(FRAME[c]) for c in ("stream_id", "model_id", "frame_local_path", "frame_url")}
    m.take_faults(d, owner)
    detections = _lists(owner, m.rows, pa.StructArray.from_arrays([columns[f.name] for f in _ARROW_DETECTION], fields=list(_ARROW_DETECTION)))
    reals = {c: pa.array(m.real(FRAME[c], 8)) for c in ("frame_ts", "infer_ts", "latency_ms")}
    found = texts | reals | {"frame_seq": pa.array(m.whole(FRAME["frame_seq"])), "detections": detections}
    there = pa.array(~m.bad & messages.is_valid().to_numpy(zero_copy_only=False))
    index = pa.array(np.arange(m.rows)).filter(there, null_selection_behavior="drop")
    place = np.full(m.rows, -1)
    place[index.to_numpy()] = index.to_numpy()
    take = pa.array(place, mask=place < 0)
    names = [*(x.split()[0] for x in _PLAIN.split(", ")), "detections"]
    error = pa.array(np.where(m.bad, "not a frame message", ""), mask=~m.bad, type=pa.string())
    return pa.RecordBatch.from_arrays([*(found[c].take(take) for c in names), error], names=[*names, "error"])


def decode(messages: DataFrame, column: str = "message") -> DataFrame:
    """The nine fields of each message, and error; attributes are maps."""

    def run(batches):
        for b in batches:
            yield _read(b.column(0))

    rows = messages.select(F.col(column).cast("binary").alias("message")).mapInArrow(run, f"{_PLAIN}, detections {_DETECTIONS.format(box=_BOX, attributes=_ENTRIES)}, error string")
    one = lambda d: F.struct(*[d[c].alias(c) for c in list(DETECTION)[:-1]], F.map_from_entries(d["attributes"]).alias("attributes"))
    return rows.withColumn("detections", F.transform("detections", one))


def subscribed(messages: DataFrame, stream_ids: list[str]) -> DataFrame:
    """The messages of a subscriber's streams; no names mean all."""
    return messages.where(F.col("stream_id").isin(stream_ids)) if stream_ids else messages
