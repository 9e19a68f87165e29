"""Hierarchical packing of documents into sequences of several context sizes.

A task encodes its documents and gathers pools of about ``POOL`` tokens. A document hands on its whole windows of the longest tier as
they are; what remains of it is routed to the smallest tier that holds it. Tiers are packed from the longest: a window is opened by the
longest piece of its tier, its gap is filled by the longest piece of the shorter tiers that fits, again and again, and where no piece
fits, the longest piece left is cut to the gap's length. So a window that is closed is full. The last open window of
a pool goes into the next pool, that of a task is cut into lengths that are powers of two; nothing is ever padded.

Sequences of a pool are dealt to step groups of about ``STEP`` tokens in which each tier has its share.
Pools belong to tasks, so nothing is shuffled, and no row's place depends on another task's.

Defined results: null text is an empty text, whose ids are the end id alone; null and repeated doc_ids stay, each row is a document of
its own; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import grouped, process_cache, text_batches
from framewright.llm.units import ByteLevel, Memory, cut_texts, joined

#: Context sizes, powers of two; tokens of a pool and of a step group.
TIERS, POOL, STEP = (2048, 1024, 512, 256), 1 << 21, 1 << 17
#: Units remembered in a worker, and bytes of documents encoded at once.
REMEMBER, AT_ONCE = 600_000, 4 << 20

Piece = tuple[int | None, int, np.ndarray, int]  # doc_id, start, ids, tokens of its document


class Pool:
    """Pieces by length; takes out the longest of at most some length."""

    def __init__(self, pieces: list[Piece]):
        self.by_length: dict[int, list[Piece]] = defaultdict(list)
        for p in pieces:
            self.by_length[len(p[2])].append(p)
        self.lengths = sorted(self.by_length)

    def put(self, piece: Piece) -> None:
        n = len(piece[2])
        if not self.by_length[n]:
            bisect.insort(self.lengths, n)
        self.by_length[n].append(piece)

    def take(self, most: int) -> Piece | None:
        i = bisect.bisect_right(self.lengths, most) - 1
        if i < 0:
            return None
        n = self.lengths[i]
        out = self.by_length[n].pop()
        if not self.by_length[n]:
            del self.lengths[i]
        return out


def cut(piece: Piece, n: int) -> tuple[Piece, Piece]:
    doc, start, ids, tokens = piece
    return (doc, start, ids[:n], tokens), (doc, start + n, ids[n:], tokens)


def pack(pieces: list[Piece], tiers: tuple[int, ...] = TIERS) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Full windows (tier, pieces), and the pieces of the one window that could not be filled; no piece is longer than the first tier."""
    pool, out = Pool(pieces), []
    for tier, shorter in zip(tiers, [*tiers[1:], 0]):
        while pool.lengths and pool.lengths[-1] > shorter:
            window, gap = [], tier
            while gap and pool.lengths:
                piece = pool.take(gap)
                if piece is None:
                    piece, rest = cut(pool.take(tiers[0]), gap)
                    pool.put(rest)
                window.append(piece)
                gap -= len(piece[2])
            if gap:
                return out, window
            out.append((tier, window))
    return out, []


def halves(pieces: list[Piece]) -> list[tuple[int, list[Piece]]]:
    """Sequences whose lengths are powers of two, longest first, from pieces of any lengths."""
    out, left = [], list(pieces)
    total = sum(len(p[2]) for p in left)
    while total:
        size = gap = 1 << (total.bit_length() - 1)
        window = []
        while gap:
            piece = left.pop(0)
            if len(piece[2]) > gap:
                piece, rest = cut(piece, gap)
                left.insert(0, rest)
            window.append(piece)
            gap -= len(piece[2])
        out.append((size, window))
        total -= size
    return out


def step_groups(sizes: np.ndarray, step: int) -> np.ndarray:
    """The group of each sequence: groups have about ``step`` tokens each, and sequences of each size are spread evenly over them."""
    place = np.empty(len(sizes))
    for s in np.unique(sizes):
        at = np.flatnonzero(sizes == s)
        place[at] = (np.arange(len(at)) + 0.5) / len(at)
    order = np.lexsort((-sizes, place))
    before = np.cumsum(sizes[order]) - sizes[order]
    groups = max(1, round(int(sizes.sum()) / step))
    out = np.empty(len(sizes), np.int64)
    out[order] = np.minimum(before * groups // max(1, int(sizes.sum())), groups - 1)
    return out


SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, tier int, step bigint"
_KINDS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step", pa.int64())])


class Packer:
    """Follows a task's documents; ``add`` and ``close`` give Arrow batches of pieces."""

    def __init__(self, part: int, tiers: tuple[int, ...], pool: int, step: int):
        self.tiers, self.limit, self.step = tiers, pool, step
        self.sequence = self.group = part << 32
        self.pieces, self.windows, self.tokens = [], [], 0

    def add(self, doc: int | None, ids: np.ndarray):
        longest, n = self.tiers[0], len(ids)
        for start in range(0, n, longest):
            piece = (doc, start, ids[start : start + longest], n)
            if len(piece[2]) == longest:
                self.windows.append((longest, [piece]))
            else:
                self.pieces.append(piece)
            self.tokens += len(piece[2])
            if self.tokens >= self.limit:
                yield from self.flush(False)

    def flush(self, last: bool):
        full, left = pack(self.pieces, self.tiers)
        windows = self.windows + full + (halves(left) if last else [])
        self.pieces, self.windows, self.tokens = [] if last else left, [], 0 if last else sum(len(p[2]) for p in left)
        if windows:
            groups = step_groups(np.array([size for size, _ in windows]), self.step)
            rows = []
            for k, ((size, window), group) in enumerate(zip(windows, groups.tolist())):
                offset = 0
                for doc, start, ids, tokens in window:
                    rows.append((doc, start, len(ids), ids.tobytes(), tokens, self.sequence + k, offset, size, self.group + group))
                    offset += len(ids)
            self.sequence, self.group = self.sequence + len(windows), self.group + int(groups.max()) + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*rows), _KINDS)], schema=_KINDS)

    def close(self):
        yield from self.flush(True)


class DocumentCoder:
    """The ids of documents, from the remembered ids of their units."""

    def __init__(self, model: str):
        self.coder = ByteLevel(model)
        self.spaced = Memory(self.coder, REMEMBER)
        self.heads: dict[str, bytes] = {}

    def encode(self, texts: pa.Array, end: int) -> list[np.ndarray]:
        if len(self.heads) > 100_000:
            self.heads.clear()
        self.spaced.room()
        own, heads, number, edges = cut_texts(texts, bare=True)
        new = [h for h in heads if h not in self.heads]
        self.heads |= {h: np.array(ids, "<u4").tobytes() for h, ids in zip(new, self.coder.ids(new))}
        last = np.uint32(end).tobytes()
        packed = joined(self.spaced.ids_of(own) + list(map(self.heads.__getitem__, heads)), number, edges)
        return [np.frombuffer(p + last, "<u4") for p in packed.to_numpy(zero_copy_only=False)]


def sequences(docs: DataFrame, model_path: str, end: int, tiers: tuple[int, ...] = TIERS, pool: int = POOL, step: int = STEP) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset, tier, step) of each piece; ids are little-endian unsigned 32-bit integers.

    ``tiers`` are powers of two, longest first; a sequence's length is its tier."""
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers), reverse=True):
        raise ValueError("tiers must be powers of two, longest first")
    spark = docs.sparkSession
    text_batches(spark)
    with open(model_path, encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())

    def run(batches):
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder = process_cache(f"units {model_path}", lambda: DocumentCoder(model.value))
        packer = Packer(TaskContext.get().partitionId(), tiers, pool, step)
        for group in grouped(batches, AT_ONCE):
            docs = pa.concat_arrays([b.column(0) for b in group]).to_pylist()
            for doc, ids in zip(docs, coder.encode(pa.concat_arrays([b.column(1) for b in group]), end)):
                yield from packer.add(doc, ids)
        yield from packer.close()

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
