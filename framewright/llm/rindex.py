"""Repeated passages by a run-length index: a run-compressed Burrows-Wheeler transform with sampled run ends.

Every byte covered by a ``length``-byte string that also starts anywhere else in the corpus is marked.

1. Each window of ``length`` bytes belongs to its anchor, the leftmost position of least hash among its
   strings of a quarter to half the length. Equal windows have equal anchors, so a window repeats only among the
   contexts (runs of windows) of one anchor hash. Contexts are counted by (anchor hash, context hash), combined before the shuffle.
2. A context seen twice repeats as a whole. An anchor hash with a single context, seen once, has no repeats.
3. The other contexts meet by anchor hash, one copy of each. Blocks of them become a suffix order, its
   Burrows-Wheeler transform, and from it the runs with the text positions at both run ends. Only where a run begins
   does the match with the neighbouring suffix have to be measured; between such samples, the match
   at the next position is one shorter. Streaming over the text gives each position's longest match elsewhere.
4. An anchor hash with more than ``GROUP`` contexts is dealt over several blocks by context hash. Windows that no other
   context of their block holds are then compared between blocks: first the bytes that 16 neighbouring windows
   have in common, then, where these come again, those of 4, then single windows. Each count is combined before the shuffle.

Texts are matched byte by byte inside a block; between copies of a context, and between blocks of one large
group, two 64-bit hashes stand for the bytes.

Defined results: null text is an empty text; texts shorter than ``length`` keep all bytes; repeated rows are copies
of each other, with null or equal doc_id too; no match crosses two texts; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import drop_written, free_names, fresh_worker, text_batches, written

LENGTH = 400
#: Contexts of an anchor hash in one block, and bytes indexed at once.
GROUP, BLOCK = 256, 1 << 19
SEPARATOR = 0xFF  # never a byte of UTF-8


def seed_of(length: int) -> int:
    """Bytes of the strings that anchor a window: the largest power of two up to half the length."""
    return 1 << (length // 2).bit_length() - 1


def _anchor_hashes(b: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of all ``seed``-byte strings, by doubling; ``seed`` is a power of two."""
    table = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
    h, size, base = table[b], 1, 0x9E3779B97F4A7C15
    while size < seed:
        h = h[:-size] * np.uint64(base) + h[size:]
        base, size = base * base % 2**64, size * 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def anchors(text: bytes, length: int = LENGTH) -> tuple[list[int], list[int], list[int], list[list[int]]]:
    """The contexts of a text: anchor hashes, context hashes, context lengths and the starts of each."""
    if len(text) < length:
        return [], [], [], []
    seed = seed_of(length)
    h = _anchor_hashes(np.frombuffer(text, np.uint8), seed)
    wide = length - seed + 1
    low, size = h, 1
    while size * 2 <= wide:
        low, size = np.minimum(low[:-size], low[size:]), size * 2
    if rest := wide - size:
        low = np.minimum(low[:-rest], low[rest:])
    begin = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
    end = np.append(begin[1:], len(low)) - 1
    at = np.empty(len(begin), np.int64)
    views = np.lib.stride_tricks.sliding_window_view(h, wide)
    for i in range(0, len(begin), 512):
        at[i : i + 512] = begin[i : i + 512] + views[begin[i : i + 512]].argmin(axis=1)
    found: dict[tuple[int, int], list[int]] = {}
    size_of: dict[tuple[int, int], int] = {}
    signed, digest = h.view(np.int64), xxhash.xxh3_64_intdigest

    def add(p: int, a: int, b: int) -> None:
        key = (int(signed[p]), digest(text[a : b + length]) - 2**63)
        found.setdefault(key, []).append(a)
        size_of[key] = b - a + length

    for a, b, p in zip(begin.tolist(), end.tolist(), at.tolist()):
        if b <= p:
            add(p, a, b)
        else:  # the least hash comes several times: the leftmost one in each window counts
            for p in (a + np.flatnonzero(h[a : b + wide] == h[p])).tolist():
                add(p, a, min(p, b))
                a = p + 1
                if a > b:
                    break
    return [k[0] for k in found], [k[1] for k in found], list(size_of.values()), list(found.values())


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffixes of a byte array (fewer than 2**20) in order, by doubling; ranks and positions are sorted as one integer."""
    n = len(text)
    pos, low = np.arange(n, dtype=np.int64), np.int64((1 << 20) - 1)
    wide = np.concatenate([text, np.zeros(5, np.uint8)]).astype(np.int64)
    key = wide[:n]
    for k in range(1, 5):
        key = (key << 8) | wide[k : n + k]
    size = 5
    while True:
        both = np.sort((key << 20) | pos)
        order = both & low
        both >>= 20
        new = np.concatenate([[0], np.cumsum(both[1:] != both[:-1])])
        if new[-1] == n - 1 or size >= n:
            return order
        rank = np.empty(n + 1, np.int64)
        rank[order] = new + 1
        rank[n] = 0
        key = (rank[:n] << 20) | rank[np.minimum(pos + size, n)]
        size *= 2


class RunIndex:
    """The run-compressed transform of a text: each run's byte and length, and the text positions of its first and last row."""

    def __init__(self, text: np.ndarray):
        order = suffix_order(text)
        last = text[order - 1]
        head = np.concatenate([[True], last[1:] != last[:-1]])
        begin = last == SEPARATOR  # no byte of a context stands before its first one: such rows are runs of their own
        head |= begin
        head[1:] |= begin[:-1]
        self.size = len(text)
        self.byte = last[head]
        starts = np.flatnonzero(head)
        self.length = np.diff(np.append(starts, len(text)))
        self.first = order[starts]
        self.last = order[np.append(starts[1:], len(text)) - 1]


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """How many bytes agree from a and from b on, eight at a time, up to about ``most``."""
    padded = np.concatenate([text, np.zeros(most + 16, np.uint8)])
    words = np.ndarray(len(padded) - 7, "<u8", padded.tobytes(), 0, (1,))
    out = np.full(len(a), most, np.int64)
    live = np.arange(len(a))
    for step in range(0, most, 8):
        x = words[a[live] + step] ^ words[b[live] + step]
        differ = x != 0
        at = x[differ]
        out[live[differ]] = step + (np.log2((at & (~at + np.uint64(1))).astype(np.float64)).astype(np.int64) >> 3)
        live = live[~differ]
        if not len(live):
            break
    return out


def longest_matches(text: np.ndarray, most: int) -> np.ndarray:
    """For each position the end of its longest match that starts at another position, streamed from the run-end samples."""
    index = RunIndex(text)
    end = np.zeros(index.size, np.int64)
    if len(index.first) > 1:
        above, below = index.last[:-1], index.first[1:]  # neighbours in suffix order where a run ends
        same = _common(text, above, below, most)
        for at in (below, above):
            sampled = np.zeros(index.size, np.int64)
            sampled[at] = at + same
            np.maximum(end, np.maximum.accumulate(sampled), out=end)
    return end


def marked(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For each context, which of its bytes lie in a ``length``-byte string that comes again in these contexts; and the windows that do."""
    size = np.array([len(c) for c in contexts])
    text = np.frombuffer(bytes([SEPARATOR]).join(contexts) + bytes([SEPARATOR]), np.uint8)
    stop = np.cumsum(size + 1) - 1
    start = stop - size
    end = np.minimum(longest_matches(text, int(size.max()) + 8), np.repeat(stop, size + 1))
    pos = np.arange(len(text))
    again = end - pos >= length
    cover = np.maximum.accumulate(np.where(again, end, 0)) > pos
    return [(cover[a:b], again[a:b]) for a, b in zip(start, stop)]


def _spans(cover: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], cover.view(np.int8), [0]])))
    return [{"a": int(a), "b": int(b)} for a, b in zip(edge[::2], edge[1::2])]


_CORE = pa.struct([("c", pa.int32()), ("h", pa.int64()), ("at", pa.int32()), ("open", pa.bool_())])
_SPAN = pa.struct([("a", pa.int32()), ("b", pa.int32())])
_FOUND = "seed bigint, ctx bigint, spans array<struct<a:int,b:int>>, body binary, free array<struct<a:int,b:int>>, cores array<struct<c:int,h:bigint,at:int,open:boolean>>"
#: Neighbouring windows compared as one, at each level.
LEVELS = (16, 4, 1)


def _cores(seed: int, body: bytes, free: np.ndarray, length: int, width: int, only: set[int] | None = None) -> list[dict]:
    """For each class of ``width`` windows, by distance from the anchor, the hash of the bytes that all of them hold.

    ``free`` tells which windows found no other copy in their block; ``only`` names the classes to look at."""
    anchor = int(np.flatnonzero(_anchor_hashes(np.frombuffer(body, np.uint8), seed_of(length)).view(np.int64) == seed)[0])
    out = []
    for c in range((anchor - len(free) + 1) // width, anchor // width + 1) if only is None else sorted(only):
        begin = anchor - c * width
        some = free[max(0, begin - width + 1) : begin + 1]
        if begin >= 0 and len(some):
            core = body[begin : begin - width + 1 + length]
            out.append({"c": c, "h": xxhash.xxh3_64_intdigest(core) - 2**63, "at": begin, "open": bool(some.any())})
    return out


def _index_blocks(length: int):
    schema = pa.schema([("seed", pa.int64()), ("ctx", pa.int64()), ("spans", pa.list_(_SPAN)), ("body", pa.binary()), ("free", pa.list_(_SPAN)), ("cores", pa.list_(_CORE))])

    def block(rows):
        out = []
        rows = list({(r["seed"], r["ctx"]): r for r in rows}.values())
        handed: set[tuple] = set()
        for r, (cover, again) in zip(rows, marked([r["body"] for r in rows], length)):
            one = {"seed": r["seed"], "ctx": r["ctx"], "spans": _spans(cover) if r["n"] == 1 else [], "body": None, "free": None, "cores": None}
            if r["dealt"]:
                free = ~again[: len(r["body"]) - length + 1] if r["n"] == 1 else np.zeros(len(r["body"]) - length + 1, bool)
                cores = _cores(r["seed"], r["body"], free, length, LEVELS[0])
                fresh = np.zeros(len(free), bool)  # windows that stand for their copies in this block
                for at in np.flatnonzero(~free).tolist():
                    key = (r["seed"], xxhash.xxh3_64_intdigest(r["body"][at : at + length]))
                    fresh[at] = key not in handed
                    handed.add(key)
                cores = [x for x in cores if x["open"] or fresh[max(0, x["at"] - LEVELS[0] + 1) : x["at"] + 1].any()]
                if cores:
                    one |= {"body": r["body"], "free": _spans(free), "cores": cores}
            if one["spans"] or one["cores"]:
                out.append(one)
        return pa.RecordBatch.from_pylist(out, schema=schema)

    def run(batches):
        fresh_worker()
        rows, total, part = [], 0, None
        for b in batches:
            for r in b.to_pylist():
                if total >= BLOCK and (r["seed"], r["part"]) != part:
                    yield block(rows)
                    rows, total = [], 0
                part = (r["seed"], r["part"])
                rows.append(r)
                total += len(r["body"]) + 1
        if rows:
            yield block(rows)

    return run


def _between_blocks(found: DataFrame, length: int) -> DataFrame:
    """(seed, ctx, a, b): the windows that came again only in another block of their anchor hash."""
    dealt = found.where("body is not null")
    rows = dealt.select("seed", "ctx", F.explode("cores").alias("x")).select("seed", "ctx", "x.*")
    for width in LEVELS[1:]:
        shared = rows.groupBy("seed", "c", "h").agg(F.count("*").alias("m")).where("m > 1").select("seed", "c", "h")
        hit = rows.join(shared, ["seed", "c", "h"]).groupBy("seed", "ctx").agg(F.collect_set("c").alias("classes"))

        def finer(batches, width=width, ratio=LEVELS[LEVELS.index(width) - 1] // width):
            for b in batches:
                out = []
                for r in b.to_pylist():
                    free = np.zeros(len(r["body"]) - length + 1, bool)
                    for x in r["free"]:
                        free[x["a"] : x["b"]] = True
                    only = {c * ratio + k for c in r["classes"] for k in range(ratio)}
                    out.append(_cores(r["seed"], r["body"], free, length, width, only))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(_CORE))], ["seed", "ctx", "cores"])

        asked = dealt.select("seed", "ctx", "body", "free").join(hit, ["seed", "ctx"])
        rows = asked.mapInArrow(finer, "seed bigint, ctx bigint, cores array<struct<c:int,h:bigint,at:int,open:boolean>>")
        rows = written(rows.select("seed", "ctx", F.explode("cores").alias("x")).select("seed", "ctx", "x.*"), "windows")
    shared = rows.groupBy("seed", "c", "h").agg(F.count("*").alias("m")).where("m > 1").select("seed", "c", "h")
    return rows.where("open").join(shared, ["seed", "c", "h"]).select("seed", "ctx", F.struct(F.col("at").alias("a"), (F.col("at") + length).alias("b")).alias("s"))


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(k1, k2, spans) for each text, by its key, that holds repeated passages; spans are structs of starts, an array, and size in bytes; they may overlap.

    ``docs`` has k1, k2 and text."""
    if length < 64:
        raise ValueError("length must be 64 or more")

    def cut(batches):
        fresh_worker()
        kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32()))]
        for b in batches:
            got = list(zip(*[anchors((t.as_py() or "").encode("utf-8", "surrogatepass"), length) for t in b.column(2)])) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(list(x), kind) for x, kind in zip(got, kinds)]], ["k1", "k2", "seed", "ctx", "size", "starts"])

    cuts = docs.select("k1", "k2", "text").mapInArrow(cut, "k1 bigint, k2 bigint, seed array<bigint>, ctx array<bigint>, size array<int>, starts array<array<int>>")
    cuts = written(cuts.where(F.size("seed") > 0), "anchors")
    each = cuts.select("k1", "k2", F.explode(F.arrays_zip("seed", "ctx", "size", "starts")).alias("x")).select("k1", "k2", "x.*")
    first = F.min(F.struct("k1", "k2", F.col("starts")[0].alias("start"), "size")).alias("one")
    groups = written(each.groupBy("seed", "ctx").agg(F.sum(F.size("starts")).alias("n"), first).where("n > 0"), "contexts")
    mixed = groups.groupBy("seed").agg(F.count("*").alias("m"), F.count_if(F.col("n") == 1).alias("open")).where("m > 1 and open > 0").select("seed", "m")
    asked = groups.join(mixed, "seed").select("seed", "ctx", "n", "m", "one.*")
    asked = written(asked, "asked")
    wanted = asked.groupBy("k1", "k2").agg(F.collect_list(F.struct("seed", "ctx", "n", "m", "start", "size")).alias("want"))
    body = F.encode("text", "utf-8")
    rows = docs.select("k1", "k2", "text").join(wanted, ["k1", "k2"]).select(F.explode(F.transform("want", lambda w: F.struct(w["seed"].alias("seed"), w["ctx"].alias("ctx"), w["n"].alias("n"), w["m"].alias("m"), F.substring(body, w["start"] + 1, w["size"]).alias("body")))).alias("x")).select("x.*")
    parts = F.ceil(F.col("m") / F.lit(GROUP)).cast("bigint")
    rows = rows.select("seed", "ctx", "n", (F.col("m") > GROUP).alias("dealt"), F.pmod("ctx", parts).alias("part"), "body")
    found = rows.repartition("seed", "part").sortWithinPartitions("seed", "part").mapInArrow(_index_blocks(length), _FOUND)
    found = written(found, "matches")
    place = asked.where("n = 1").select("seed", "ctx", "k1", "k2", "start")
    near = found.where("size(spans) > 0").select("seed", "ctx", F.explode("spans").alias("s"))
    far = _between_blocks(found, length)
    at = F.array(F.col("start") + F.col("s.a"))
    part = near.unionByName(far).join(place, ["seed", "ctx"]).select("k1", "k2", at.alias("starts"), (F.col("s.b") - F.col("s.a")).alias("size"))
    whole = each.join(groups.where("n > 1").select("seed", "ctx"), ["seed", "ctx"]).select("k1", "k2", "starts", "size")
    return part.unionByName(whole).groupBy("k1", "k2").agg(F.collect_list(F.struct("starts", "size")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, words: int = 0) -> DataFrame:
    """``docs`` with removed array<struct<a,b>> (maximal spans in bytes), n_bytes, kept, the bytes outside the spans, and
    kept_text, those bytes as text without characters that a span cuts in two. Spans of fewer than ``words`` words stay.

    Columns of these names that ``docs`` has already are replaced."""
    text_batches(docs.sparkSession)
    added = ["removed", "n_bytes", "kept", "kept_text"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added])
    k1, k2, spans = free_names(docs, "k1", "k2", "spans")
    keyed = docs.select("*", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias(k1), F.xxhash64(F.coalesce("text", F.lit(""))).alias(k2))
    found = repeated_spans(keyed.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), F.coalesce("text", F.lit("")).alias("text")), length)
    names = docs.columns
    both = keyed.join(found.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("spans").alias(spans)), [k1, k2], "left").select(*names, spans)
    at = names.index("text")

    def cut(batches):
        fresh_worker()
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        for b in batches:
            removed, sizes, kept, texts = [], [], [], []
            for t, s in zip(b.column(at), b.column(len(names))):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                edge = np.zeros(len(raw) + 1, np.int64)
                for x in s.as_py() or []:
                    starts = np.array(x["starts"])
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + x["size"], -1)
                out = [x for x in _spans(np.cumsum(edge[:-1]) > 0) if not words or len(raw[x["a"] : x["b"]].split()) >= words] if s.is_valid else []
                removed.append(out)
                sizes.append(len(raw))
                edges = [0, *(e for x in out for e in (x["a"], x["b"])), len(raw)]
                kept.append(b"".join(raw[i:j] for i, j in zip(edges[::2], edges[1::2])))
                texts.append(kept[-1].decode("utf-8", "ignore") if out else t.as_py())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(removed, kind), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(texts, pa.string())], [*names, *added])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", removed array<struct<a:int,b:int>>, n_bytes bigint, kept binary, kept_text string"
    return both.mapInArrow(cut, schema)
