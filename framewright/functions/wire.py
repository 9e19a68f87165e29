"""Byte columns of many rows at once: fields of the protocol-buffer wire format, written and read in NumPy.

A *ragged* column is a pair: the bytes of all rows end to end, and each row's number of them. Writing sets such columns side by side;
reading goes through all rows in step, one field of each a round, so that a round is a few array operations however many rows there are.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

Ragged = tuple[np.ndarray, np.ndarray]
VARINT, DOUBLE, BYTES, FLOAT = 0, 1, 2, 5  # wire types, fixed values
_PLACES = np.arange(10)


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions begin, begin + 1, ... of each row, ``size`` of them, end to end."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def beside(*parts: Ragged) -> Ragged:
    """Ragged columns put together row by row."""
    total = np.sum([n for _, n in parts], axis=0)
    at, out = np.cumsum(total) - total, np.empty(total.sum(), np.uint8)
    for flat, n in parts:
        out[_spread(at, n)] = flat
        at = at + n
    return out, total


def gathered(part: Ragged, owner: np.ndarray, rows: int) -> Ragged:
    """Items put together by their owner; ``owner`` does not fall."""
    total = np.zeros(rows, np.int64)
    np.add.at(total, owner, part[1])
    return part[0], total


def varints(values: np.ndarray) -> Ragged:
    """Seven bits a byte, the lowest first, the top bit set on all but the last; negative numbers take ten bytes."""
    v = values.astype(np.int64).view(np.uint64)[:, None] >> (7 * _PLACES).astype(np.uint64)
    size = np.maximum((v != 0).sum(1), 1)
    b = (v & np.uint64(127)).astype(np.uint8)
    b[_PLACES < size[:, None] - 1] |= 128
    return b[_PLACES < size[:, None]], size


def _field(number: int, wire: int, keep: np.ndarray, *parts: Ragged) -> Ragged:
    """The field in the rows of ``keep``; numbers are below 16, so that a tag is one byte."""
    flat, n = beside((np.full(len(keep), number << 3 | wire, np.uint8), np.ones(len(keep), np.int64)), *parts)
    return flat[np.repeat(keep, n)], np.where(keep, n, 0)


def whole_numbers(number: int, values: np.ndarray) -> Ragged:
    """A field of whole numbers; zero is not written."""
    return _field(number, VARINT, values != 0, varints(values))


def reals(number: int, values: np.ndarray) -> Ragged:
    """A field of float32 or float64 values; positive zero is not written."""
    width = values.dtype.itemsize
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), width)
    return _field(number, FLOAT if width == 4 else DOUBLE, raw.any(1), (raw.ravel(), np.full(len(values), width)))


def texts(number: int, part: Ragged, keep: np.ndarray | None = None) -> Ragged:
    """A field of bytes, texts or messages; empty ones are not written, unless ``keep`` tells which are."""
    return _field(number, BYTES, part[1] > 0 if keep is None else keep, varints(part[1]), part)


def ragged(column: pa.Array) -> Ragged:
    """The bytes of an Arrow column of texts or bytes; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return flat, np.diff(ends)


class Fields(NamedTuple):
    """Fields in order of row and place: number, wire type, whole-number value, where their bytes begin and how many there are.
    ``bad`` marks the rows that are not well formed; they have none behind the fault."""

    row: np.ndarray
    number: np.ndarray
    wire: np.ndarray
    value: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    bad: np.ndarray

    def of(self, number: int, wire: int) -> np.ndarray:
        """Places of one field; another wire type under the number is an unknown field."""
        return np.flatnonzero((self.number == number) & (self.wire == wire))

    def last(self, number: int, wire: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows that have the field, place of its last occurrence in each)."""
        at = np.full(len(self.bad), -1)
        of = self.of(number, wire)
        np.maximum.at(at, self.row[of], of)
        return np.flatnonzero(at >= 0), at[at >= 0]


def _read_varints(data: np.ndarray, at: np.ndarray, stop: np.ndarray):
    """(value, place behind it, whether it ends before ``stop``) at each place; ``data`` has ten bytes to spare."""
    b = data[at[:, None] + _PLACES]
    more = b >= 128
    size = np.where(more.all(1), 11, more.argmin(1) + 1)
    bits = np.where(_PLACES < size[:, None], b & 127, 0).astype(np.uint64) << (7 * _PLACES).astype(np.uint64)
    return np.bitwise_or.reduce(bits, axis=1), at + size, (size <= 10) & (at + size <= stop)


def fields(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> Fields:
    """All fields of the messages that lie at ``begin`` with ``size`` bytes; ``data`` has ten bytes to spare behind the last."""
    bad, row = np.zeros(len(begin), bool), np.flatnonzero(size > 0)
    at, stop = begin[row], (begin + size)[row]
    rounds = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 2]
    while len(row):
        key, at, ok = _read_varints(data, at, stop)
        number, wire = (key >> np.uint64(3)).astype(np.int64), (key & np.uint64(7)).astype(np.int64)
        value, behind, complete = _read_varints(data, np.minimum(at, stop), stop)
        long = wire == BYTES
        ok &= (number > 0) & np.isin(wire, (VARINT, DOUBLE, BYTES, FLOAT)) & (complete | ~np.isin(wire, (VARINT, BYTES)))
        ok &= ~long | (value <= np.maximum(stop - behind, 0).astype(np.uint64))
        width = np.select([wire == DOUBLE, wire == FLOAT, long & ok], [8, 4, value.astype(np.int64)], 0)
        start = np.where((wire == VARINT) | long, behind, at)
        ok &= start + width <= stop
        bad[row[~ok]] = True
        rounds.append(tuple(x[ok] for x in (row, number, wire, value, start, width)))
        at, going = start + width, ok & (start + width < stop)
        row, at, stop = row[going], at[going], stop[going]
    columns = [np.concatenate(c) for c in zip(*rounds)]
    order = np.argsort(columns[0], kind="stable")
    return Fields(*[c[order] for c in columns], bad)


def read_texts(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(texts at ``begin`` with ``size`` bytes, which of them are not UTF-8); those are empty."""
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    flat = data[_spread(begin, size)]
    raw = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
    try:
        return raw.cast(pa.string()), np.zeros(len(size), bool)
    except pa.ArrowInvalid:  # some text is not UTF-8: find which
        out = []
        for v in raw.to_pylist():
            try:
                out.append(v.decode())
            except UnicodeDecodeError:
                out.append(None)
        held = pa.array(out, pa.string())
        return held.fill_null(""), held.is_null().to_numpy(zero_copy_only=False)
