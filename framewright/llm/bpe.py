"""Byte-level BPE: DuckDB recursive queries inside Spark tasks encode, ordered aggregation decodes.

A text is cut by ``public_tokenizers.PATTERN``. The distinct words of a task's texts become token-position rows in an
in-process DuckDB; a recursive query joins neighbouring positions to the merge table and
contracts each word's leftmost pair of least rank until no pair is left. A word that is itself in the
vocabulary is one token, as the tiktoken library has it. The recursion's rows grow with the square of a word's length, so words go to it
in lots of bounded squares, and a word of more than ``LONG`` bytes is contracted by the same rule over a heap of its pairs. Words are remembered in the worker, up to a bound. Decoding joins the
positions of each document's ids to the vocabulary and aggregates their bytes in order.

Defined results: null text is an empty text, with no ids and empty bytes; special tokens are ordinary text; repeated rows give
repeated results; null doc_ids stay; other columns of the input are dropped.
"""

from __future__ import annotations

import base64
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import grouped, process_cache, text_batches
from framewright.llm.units import coded, cut_texts, joined

#: Words and pieces of ids, and units of texts, remembered in a worker, and bytes of documents taken to DuckDB at once.
REMEMBER, UNITS, AT_ONCE = 400_000, 800_000, 1_000_000
#: Bytes of a word that DuckDB contracts at most, and squared bytes of words in one call.
LONG, SQUARES = 256, 4_000_000

_ENCODE = """
with recursive t(k, tok, done) as (
  select k, tok, false from start
  union all
  select p.k, case when p.k = b.at then b.r else p.tok end, b.r is null
  from (select k, tok from t where not done) p
  join (
    select k >> 24 as w, min(r) as r, arg_min(k, own) as at, arg_min(nk, own) as gone
    from (
      select s.k, s.nk, m.r, case when m.r is not null then (m.r::hugeint << 64) + s.k end as own
      from (
        select k, tok, lead(k) over (order by k) as nk, lead(tok) over (order by k) as nt from t where not done
      ) s
      left join merges m on m.a = s.tok and m.b = s.nt and s.k >> 24 = s.nk >> 24
    )
    group by 1
  ) b on b.w = p.k >> 24
  where b.gone is null or p.k <> b.gone
)
select k >> 24 as w, list(tok order by k) as ids from t where done group by 1
"""
_DECODE = "select d, string_agg(h, '' order by pos) as whole from ids join vocab using (id) group by d"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ranks, from a tiktoken file that the driver can open."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Coder:
    """One worker's DuckDB with the vocabulary and the merge table, and the words it has met."""

    def __init__(self, tokens: list[bytes], ids: list[int], pattern: str):
        import duckdb
        import regex

        self.find = regex.compile(pattern).findall
        self.ranks = ranks = dict(zip(tokens, ids))
        self.single = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        self.words: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}
        self.pieces: dict[bytes, bytes] = {}
        self.spaced = np.zeros(max(ids, default=0) + 1, bool)
        self.spaced[[i for t, i in ranks.items() if t[:1] == b" "]] = True
        self.db = duckdb.connect()
        self.db.execute("set threads = 1; set memory_limit = '300MB'; set temp_directory = ''")
        merges = np.array([(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks] or np.zeros((0, 3)), np.int32)
        self.merges, self.pairs = merges, None
        self.db.register("m", pa.table({"a": merges[:, 0], "b": merges[:, 1], "r": merges[:, 2]}))
        self.db.register("v", pa.table({"id": pa.array(ids, pa.int32()), "b": pa.array(tokens, pa.binary())}))
        self.db.execute("create table merges as select * from m; create table vocab as select id, hex(b) as h from v")

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.words]
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        lot, squares = [], 0
        for w, b in zip(new, raw):
            if (r := self.ranks.get(b)) is not None:
                self.words[w] = np.uint32(r).tobytes()
            elif len(b) > LONG:
                self.words[w] = self.contract(b)
            else:
                if lot and squares + len(b) ** 2 > SQUARES:
                    self.ask(lot)
                    lot, squares = [], 0
                lot.append((w, b))
                squares += len(b) ** 2
        if lot:
            self.ask(lot)

    def contract(self, word: bytes) -> bytes:
        """The ids of one long word: its leftmost pair of least rank is contracted until there is none."""
        if self.pairs is None:
            self.pairs = {(a, b): r for a, b, r in self.merges.tolist()}
        tok, n = self.single[np.frombuffer(word, np.uint8)].tolist(), len(word)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, tok[i], tok[i + 1]) for i in range(n - 1) if (r := self.pairs.get((tok[i], tok[i + 1]))) is not None]
        heapify(heap)
        while heap:
            r, i, a, b = heappop(heap)
            j = right[i]
            if j >= n or tok[i] != a or tok[j] != b:
                continue  # one of the two has gone into another token since
            tok[i], tok[j], right[i] = r, None, right[j]
            if right[j] < n:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (new := self.pairs.get((tok[x], tok[y]))) is not None:
                    heappush(heap, (new, x, tok[x], tok[y]))
        return np.array([t for t in tok if t is not None], "<u4").tobytes()

    def ask(self, slow: list[tuple[str, bytes]]) -> None:
        size = np.array([len(b) for _, b in slow])
        every = np.frombuffer(b"".join(b for _, b in slow), np.uint8)
        word = np.repeat(np.arange(len(slow), dtype=np.int64), size)
        pos = np.arange(len(every)) - np.repeat(np.cumsum(size) - size, size)
        self.db.register("start", pa.table({"k": (word << 24) + pos, "tok": self.single[every]}))
        out = self.db.sql(_ENCODE).to_arrow_table()
        column = out["ids"].combine_chunks()
        flat, ends = column.values.to_numpy().astype("<u4"), column.offsets.to_numpy()
        for w, a, b in zip(out["w"].to_pylist(), ends, ends[1:]):
            self.words[slow[w][0]] = flat[a:b].tobytes()
        self.db.unregister("start")

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        return self.packed(pa.array(texts, pa.string())).to_pylist()

    def packed(self, texts: pa.Array) -> pa.BinaryArray:
        """The same for an Arrow array of texts, where nulls are empty. No match of the pattern lies across the units of a text, so it is
        looked for in distinct units, which are remembered too."""
        if len(self.words) > REMEMBER:
            self.words.clear()
        if len(self.units) > UNITS:
            self.units.clear()
        own, heads, number, edges = cut_texts(texts, bare=True)
        every = [" " + u for u in own] + heads
        ids = list(map(self.units.get, every))
        at = [i for i, x in enumerate(ids) if x is None]
        cut = [self.find(every[i]) for i in at]
        self.learn(set().union(*cut))
        for i, words in zip(at, cut):
            ids[i] = self.units[every[i]] = b"".join(map(self.words.__getitem__, words))
        return joined(ids, number, edges)

    def decode(self, packed: pa.Array) -> pa.BinaryArray:
        """The bytes of each id sequence; sequences are cut before tokens that begin with a space, and equal pieces are decoded once."""
        if len(self.pieces) > REMEMBER:
            self.pieces.clear()
        sizes = pc.binary_length(packed).to_numpy()
        edges = np.concatenate([[0], np.cumsum(sizes // 4)]).astype(np.int64)
        raw = b"".join(packed.to_numpy(zero_copy_only=False))
        ids = np.frombuffer(raw, "<u4")
        begins = self.spaced[ids]
        begins[edges[:-1][sizes > 0]] = True
        starts = np.flatnonzero(begins)
        offsets = np.append(4 * starts, len(raw)).astype(np.int32)
        pieces = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        distinct, number = coded(pieces)
        new = [x for x in distinct if x not in self.pieces]
        if new:
            ids = np.frombuffer(b"".join(new), "<u4").astype(np.int32)
            size = np.array([len(x) // 4 for x in new])
            piece = np.repeat(np.arange(len(new), dtype=np.int32), size)
            self.db.register("ids", pa.table({"d": piece, "pos": np.arange(len(ids), dtype=np.int64), "id": ids}))
            rows = self.db.sql(_DECODE).to_arrow_table()
            self.pieces |= dict.fromkeys(new, b"") | {new[d]: bytes.fromhex(x) for d, x in zip(rows["d"].to_pylist(), rows["whole"].to_pylist())}
            self.db.unregister("ids")
        return joined(list(map(self.pieces.__getitem__, distinct)), number, np.searchsorted(starts, edges))


def _coder(spark: SparkSession, path: str, pattern: str):
    """A function that gives a task its worker's Coder; the vocabulary, of fixed size, is broadcast."""
    ranks = read_ranks(path)
    held = spark.sparkContext.broadcast((list(ranks), list(ranks.values()), pattern))
    return lambda: process_cache(f"bpe {path} {pattern}", lambda: Coder(*held.value))


def _grouped(batches, size):
    """Arrow batches in groups of about ``AT_ONCE`` characters or bytes."""
    return grouped(batches, AT_ONCE, size)


def encode(docs: DataFrame, path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids) of each row: ids are little-endian unsigned 32-bit integers; with ``decoded`` also the bytes they decode to."""
    text_batches(docs.sparkSession)
    coder = _coder(docs.sparkSession, path, pattern)

    def run(batches):
        c = coder()
        for group in _grouped(batches, lambda b: b.nbytes):
            doc_id, texts = (pa.concat_arrays([b.column(i) for b in group]) for i in (0, 1))
            packed = c.packed(texts)
            out = {"doc_id": doc_id, "n_tokens": pc.divide(pc.binary_length(packed), 4).cast(pa.int64()), "ids": packed}
            yield pa.RecordBatch.from_pydict(out | ({"decoded": c.decode(packed)} if decoded else {}))

    schema = "doc_id bigint, n_tokens bigint, ids binary" + ", decoded binary" * decoded
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` (doc_id, n_tokens, ids) with the decoded bytes of each row."""
    coder = _coder(encoded.sparkSession, path, pattern)

    def run(batches):
        c = coder()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, c.decode(b.column(2).fill_null(b""))], ["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, decoded binary")


def sha256(column: str) -> Column:
    return F.sha2(F.col(column), 256)
