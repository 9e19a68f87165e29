"""Token ids in sorted-string-table shards: prefix-compressed blocks, a sparse block index, a Bloom filter and a footer.

Documents are range-partitioned by (doc_id, text hash); each task encodes its documents and writes shards of about ``SHARD`` bytes to the
shared folder, each under a temporary name, then renamed, so a lost task leaves no half-written shard. A manifest holds each
shard's count of ids, from which the global start of a document follows.

Shard file, integers little-endian unless said otherwise:
  blocks   entries of about ``BLOCK`` bytes: varints shared, unshared, size; the key's unshared bytes; the value
  index    for each block: its last key's length (1 byte) and bytes, offset (8), size (4)
  bloom    bits of the keys, ``HASHES`` probes each
  footer   offset and size of index and bloom, entries, ids (6 x 8 bytes), bytes an id (1), crc32 of index and bloom (4), magic (8)
Keys are 0x00 for a null doc_id, else 0x01 and the doc_id as 8 bytes big-endian with its sign bit turned. Values are the ids
before the document in its shard (8 bytes) and its ids. In a block the first key is whole.

Defined results: null text is an empty text, whose ids are the end id alone; null doc_ids come first; equal doc_ids are entries of
their own, in the order of their texts' hashes; an empty table is a manifest without shards; other columns are ignored.
"""

from __future__ import annotations

import bisect
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import grouped, new_path, process_cache, text_batches
from framewright.llm.units import coded, joined

BLOCK, BITS, HASHES, MAGIC = 1 << 16, 10, 7, b"FWSSTAB1"
#: Bytes of blocks after which a task begins its next shard.
SHARD = 1 << 28
FOOTER = "<6QBI8s"
#: Words remembered in a worker, and bytes of documents encoded at once.
REMEMBER, AT_ONCE = 1_000_000, 4 << 20
_TAIL = ".,;:!?*%#$&"


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", doc_id + 2**63)


def id_of(key: bytes) -> int | None:
    return None if key[:1] == b"\x00" else struct.unpack(">Q", key[1:])[0] - 2**63


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        c = b[at]
        at += 1
        n |= (c & 127) << shift
        if c < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    return [(h + i * (h >> 64)) % 2**64 % bits for i in range(HASHES)]


class ShardWriter:
    """Builds a shard from documents in key order, a block at a time; ``out`` is a binary file."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.block, self.last, self.at = bytearray(), b"", 0
        self.index, self.keys, self.ids = [], [], 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        value = struct.pack("<Q", self.ids) + ids.astype(f"<u{self.width}").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.ids = key, self.ids + len(ids)
        self.keys.append(key)
        if len(self.block) >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if self.block:
            self.out.write(bytes(self.block))
            self.index.append(bytes([len(self.last)]) + self.last + struct.pack("<QI", self.at, len(self.block)))
            self.at += len(self.block)
            self.block = bytearray()

    def close(self) -> None:
        self.flush()
        bits = max(64, BITS * len(self.keys))
        bloom = np.zeros((bits + 7) // 8 * 8, bool)
        for k in self.keys:
            bloom[_probes(k, bits)] = True
        index, bloom = b"".join(self.index), struct.pack("<Q", bits) + np.packbits(bloom, bitorder="little").tobytes()
        crc = zlib.crc32(bloom, zlib.crc32(index))
        self.out.write(index + bloom + struct.pack(FOOTER, self.at, len(index), self.at + len(index), len(bloom), len(self.keys), self.ids, self.width, crc, MAGIC))


class Shard:
    """Reads a shard through ``read(offset, size)``; lookups touch the Bloom filter, the index and one or two blocks."""

    def __init__(self, read, size: int):
        self.read = read
        *at, self.entries, self.ids, self.width, crc, magic = struct.unpack(FOOTER, read(size - struct.calcsize(FOOTER), struct.calcsize(FOOTER)))
        index, self.bloom = read(at[0], at[1]), read(at[2], at[3])
        if magic != MAGIC or zlib.crc32(self.bloom, zlib.crc32(index)) != crc:
            raise ValueError("not a whole shard")
        self.lasts, self.blocks, i = [], [], 0
        while i < len(index):
            n = index[i]
            self.lasts.append(index[i + 1 : i + 1 + n])
            self.blocks.append(struct.unpack_from("<QI", index, i + 1 + n))
            i += n + 13

    def block(self, k: int):
        """(key, ids before, ids) of each entry of a block."""
        b, i, key = self.read(*self.blocks[k]), 0, b""
        while i < len(b):
            shared, i = _read_varint(b, i)
            own, i = _read_varint(b, i)
            size, i = _read_varint(b, i)
            key = key[:shared] + b[i : i + own]
            i += own
            yield key, struct.unpack_from("<Q", b, i)[0], np.frombuffer(b, f"<u{self.width}", (size - 8) // self.width, i + 8)
            i += size

    def __iter__(self):
        for k in range(len(self.blocks)):
            yield from self.block(k)

    def get(self, doc_id: int | None) -> list[tuple[int, np.ndarray]]:
        """(ids before, ids) of each entry of a doc_id."""
        key, bits = key_of(doc_id), struct.unpack_from("<Q", self.bloom)[0]
        if not all(self.bloom[8 + p // 8] >> p % 8 & 1 for p in _probes(key, bits)):
            return []
        out, k = [], bisect.bisect_left(self.lasts, key)
        while k < len(self.blocks):
            found = [(a, ids) for x, a, ids in self.block(k) if x == key]
            out += found
            if self.lasts[k] != key:
                break
            k += 1
        return out


class WordCoder:
    """The tokenizers library behind a memory of the words met: the pre-tokenizer never joins what ASCII white space parts.

    It also always parts letters from the punctuation behind them, and the normaliser lower-cases, so that words which
    differ only in that share the ids of their parts. A word is cut only if what the normaliser makes of its letters is letters again."""

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.words: dict[str, bytes] = {}
        # words are encoded many at once, parted by a control character that no word holds and that is one token
        mark = self.tokenizer.encode("\x01", add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.width = 2 if self.tokenizer.get_vocab_size() < 1 << 16 else 4

    def parts(self, word: str) -> tuple[str, ...]:
        """Letters, lower-cased where that is plain ASCII, and the punctuation behind them; any other word stays whole."""
        core = word.rstrip(_TAIL)
        if not core.isalpha() or not (core.isascii() or self.tokenizer.normalizer.normalize_str(core).isalpha()):
            return (word,)
        own = core.lower() if core.isascii() else core
        return (own, word[len(core) :]) if len(core) < len(word) else (own,)

    def learn(self, words: list[str]) -> None:
        known = self.words
        parts = {w: self.parts(w) for w in words if w not in known}
        new = list({p for own in parts.values() for p in own if p not in known})
        plain = [w for w in new if self.mark is not None and "\x01" not in w]
        runs = [plain[i : i + 500] for i in range(0, len(plain), 500)]
        for run, e in zip(runs, self.tokenizer.encode_batch_fast([" \x01 ".join(r) for r in runs], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            at, raw = (4 * np.flatnonzero(ids == self.mark)).tolist(), ids.tobytes()
            known.update(zip(run, [raw[a:b] for a, b in zip([0, *(x + 4 for x in at)], [*at, len(raw)])]))
        rest = [w for w in new if w not in known]
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            known[w] = np.array(e.ids, "<u4").tobytes()
        for w, p in parts.items():
            if p != (w,):
                known[w] = b"".join(map(known.__getitem__, p))

    def packed(self, texts: pa.Array) -> pa.BinaryArray:
        """The ids of each text as little-endian unsigned 32-bit integers; nulls are empty texts. Distinct words are looked up once."""
        if len(self.words) > REMEMBER:
            self.words.clear()
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        own, number = coded(lists.flatten())
        self.words[""] = b""  # before white space at a text's begin, and behind that at its end
        self.learn(own)
        edges = lists.offsets.to_numpy()
        return joined(list(map(self.words.__getitem__, own)), number, edges - edges[0])

    def encode(self, texts: list[str], end: int) -> list[np.ndarray]:
        last = np.uint32(end).tobytes()
        return [np.frombuffer(p + last, "<u4") for p in self.packed(pa.array(texts, pa.string())).to_numpy(zero_copy_only=False)]


def _name(shard: int) -> str:
    return f"shard-{shard:010d}.sst"


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write(docs: DataFrame, model_path: str, end: int, directory: str) -> list[dict]:
    """Write the shards of ``docs`` to ``directory``, a folder that executors reach too; returns the manifest, one entry a shard."""
    spark = docs.sparkSession
    text_batches(spark, 500)
    with open(model_path, encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())
    sink, root = _files(directory)
    sink.create_dir(root, recursive=True)

    def run(batches):
        import os
        import uuid

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder = process_cache(f"words {model_path}", lambda: WordCoder(model.value))
        part = TaskContext.get().partitionId()
        files, root = _files(directory)
        last = np.uint32(end).tobytes()

        def documents():
            for group in grouped(batches, AT_ONCE):
                packed = coder.packed(pa.concat_arrays([b.column(1) for b in group]))
                for i, p in zip(pa.concat_arrays([b.column(0) for b in group]).to_pylist(), packed.to_numpy(zero_copy_only=False)):
                    yield key_of(i), np.frombuffer(p + last, "<u4")

        encoded = documents()
        first, k = next(encoded, None), 0
        while first:
            own = f"{root}/_tmp-{part}-{uuid.uuid4().hex}"
            with files.open_output_stream(own) as out:
                w = ShardWriter(out, coder.width)
                w.add(*first)
                first = None
                for first in encoded:
                    if w.at >= SHARD:
                        break
                    w.add(*first)
                    first = None
                w.close()
            shard = part * 10_000 + k
            files.move(own, f"{root}/{_name(shard)}")
            yield pa.RecordBatch.from_pylist([{"shard": shard, "low": id_of(w.keys[0]), "high": id_of(w.last), "docs": len(w.keys), "ids": w.ids}], schema=pa.schema([(c, pa.int64()) for c in ("shard", "low", "high", "docs", "ids")]))
            k += 1

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).withColumn("row", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, "doc_id", "row").sortWithinPartitions("doc_id", "row").drop("row")
    manifest = sorted((r.asDict() for r in rows.mapInArrow(run, "shard bigint, low bigint, high bigint, docs bigint, ids bigint").collect()), key=lambda r: r["shard"])
    start = 0
    for m in manifest:
        m["start"], start = start, start + m["ids"]
    return manifest


def read(spark: SparkSession, directory: str, manifest: list[dict]) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document, from the shard files; ids are little-endian unsigned 32-bit integers."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids binary"
    if not manifest:
        return spark.createDataFrame([], schema)
    kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        files, root = _files(directory)
        for m in (manifest[k] for b in batches for k in b.column(0).to_pylist()):
            with files.open_input_file(f"{root}/{_name(m['shard'])}") as f:
                shard = Shard(lambda at, size, f=f: f.read_at(size, at), f.size())
                for k in range(len(shard.blocks)):  # a block at a time
                    rows = [(id_of(key), m["start"] + before, len(ids), ids.astype("<u4").tobytes()) for key, before, ids in shard.block(k)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*rows), kinds)], schema=kinds)

    return spark.range(0, len(manifest), 1, len(manifest)).mapInArrow(run, schema)


def lookup(keys: DataFrame, directory: str, manifest: list[dict]) -> DataFrame:
    """(doc_id, start, n_tokens) for each row of ``keys`` (doc_id) that the shards hold, by binary search in the shard files."""
    shards = [m for m in manifest]
    highs = [key_of(m["high"]) for m in shards]

    def run(batches):
        files, root = _files(directory)
        for b in batches:
            rows = []
            for i in sorted(b.column(0).to_pylist(), key=key_of):
                k = bisect.bisect_left(highs, key_of(i))
                while k < len(shards) and key_of(shards[k]["low"]) <= key_of(i):
                    with files.open_input_file(f"{root}/{_name(shards[k]['shard'])}") as f:
                        s = Shard(lambda at, size, f=f: f.read_at(size, at), f.size())
                        rows += [{"doc_id": i, "start": shards[k]["start"] + a, "n_tokens": len(ids)} for a, ids in s.get(i)]
                    k += 1
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]))

    return keys.select(F.col("doc_id").cast("bigint")).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint")


def new_directory(spark: SparkSession) -> str:
    return new_path(spark, "shards")
