"""Near-duplicates: SimHash blocks at a Hamming distance, or min-hash bands and the true Jaccard similarity of word shingles.

Exact mode (``max_distance`` 0 to 2): texts become word shingles; a bit of the 64-bit fingerprint is 1 if it is set in over half of the shingles'
hashes. Equal fingerprints are one node. Nodes that share a pigeonhole block are joined and their Hamming distance is checked.
Blocks with more than ``BUCKET`` nodes are not paired: their nodes meet on one-bit neighbours instead. Two fingerprints differ in at most two
bits if and only if some value is within one bit of both, and at most 33 nodes share such a value.

Wide mode (a similarity): equal shingle sets are one node. A node has ``HASHES`` min-hashes; ``BANDS`` bands of ``ROWS`` of them are its blocks, and four bits
of each are its sketch. Two sets at Jaccard similarity s share no block with probability (1 - s**ROWS)**BANDS, 3.2e-6 at 0.8 and less
above. Every node is first checked against the smallest node of each of its blocks. Then, in each block whose nodes are not yet one
component, all pairs of different components are checked, large blocks part by part, so no pair of a block is left out unless its nodes are linked
already; a part hands out the first node of each linked group, never pairs. Pairs whose sizes cannot agree, or whose sketches differ by more than five standard deviations in too many min-hashes (3e-7 of the pairs at the limit), are no
candidates. A link is a shingle similarity of at least the given one, measured on the whole sets.

Defined results: null text is an empty text; a text with fewer words than a shingle is one shingle; texts without words are
one group (in exact mode with fingerprint zero, which links like any other); repeated rows are separate rows of one group; a null
doc_id is kept and never chosen as a group's smallest; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import SALTS, components, drop_written, few, free_names, fresh_worker, grams, mixed, text_batches, word_hashes, written

BUCKET = 64
#: Wide mode: nodes, and shingles, of a block's part, about.
PART, WEIGHT = 512, 1 << 18
WORDS, SIMILARITY = 5, 0.8
#: Exact mode: four blocks of 16 bits; fingerprints at distance 2 or less agree on at least two of them.
PAIRS = list(combinations(range(4), 2))
#: Wide mode: min-hashes, bands of rows, and the factor and offset of each min-hash.
HASHES, BANDS, ROWS = 96, 24, 4
_FACTORS, _OFFSETS = np.random.default_rng(7).integers(0, 2**32, (2, HASHES, 1), np.uint32) | np.array([[[1]], [[0]]], np.uint32)
_NULL = -(2**63)


def sketch_distance(similarity: float) -> int:
    """Min-hashes whose four bits differ, at most, at this similarity: the expected ones and five standard deviations."""
    p = (1 - similarity) * 15 / 16
    return int(HASHES * p + 5 * (HASHES * p * (1 - p)) ** 0.5) + 1


def _hashes(text: str | None, words: int) -> np.ndarray:
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    s = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) > words else [b" ".join(w)]
    return np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in s), np.uint64)


def _bits(h: np.ndarray) -> np.ndarray:
    """How often each bit, the lowest first, is set; in slices, so that long texts need little memory."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        part = np.ascontiguousarray(h[i : i + 8192]).view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return total


def shingles(text: str | None, words: int) -> np.ndarray:
    """The hashes of a text's set of shingles, sorted."""
    h = word_hashes(np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8))
    return np.unique(grams(h, min(words, len(h)))) if len(h) else h


def min_hashes(h: np.ndarray) -> np.ndarray:
    low, x = np.full(HASHES, 2**32 - 1, np.uint32), (h >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 512):
        y = _FACTORS * x[i : i + 512]
        y += _OFFSETS
        np.minimum(low, y.min(axis=1), out=low)
    return low


def sketch(low: np.ndarray) -> np.ndarray:
    """Four bits of each min-hash, as 64-bit words."""
    four = (mixed(low.astype(np.uint64)) >> np.uint64(60)).astype(np.uint8)
    return (four[::2] << 4 | four[1::2]).view(np.int64)


def bands(low: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band."""
    rows, key = low.astype(np.uint64).reshape(BANDS, ROWS), np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return key.view(np.int64)


def fingerprint(text: str | None, words: int) -> np.ndarray:
    """The exact mode's fingerprint, as one 64-bit word."""
    h = _hashes(text, words)
    return np.packbits(_bits(h) * 2 > len(h), bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, row, fp array<bigint>) of each row, row the text's hash; reads doc_id and text only."""

    def run(batches):
        fresh_worker()
        for b in batches:
            fps = [fingerprint(t.as_py(), words).view(np.int64) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.list_(pa.int64()))], ["doc_id", "row", "fp"])

    source = docs.select(F.col("doc_id").cast("bigint"), row_hash().alias("row"), F.col("text").cast("string"))
    return source.mapInArrow(run, "doc_id bigint, row bigint, fp array<bigint>")


def row_hash():
    """A text's hash: with doc_id the key of a row."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def set_keys(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, row, node, fp array<bigint>, keys array<bigint>) of each row: node the shingle set's hash, fp its size and sketch, keys its bands."""

    def run(batches):
        fresh_worker()
        for b in batches:
            nodes, fps, keys = [], [], []
            for t in b.column(2):
                h = shingles(t.as_py(), words)
                low = min_hashes(h)
                nodes.append(xxhash.xxh64_intdigest(h.tobytes()))
                fps.append([len(h), *sketch(low)])
                keys.append(bands(low) if len(h) else [])
            node = pa.array(np.array(nodes, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), node, pa.array(fps, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "row", "node", "fp", "keys"])

    source = docs.select(F.col("doc_id").cast("bigint"), row_hash().alias("row"), F.col("text").cast("string"))
    return source.mapInArrow(run, "doc_id bigint, row bigint, node bigint, fp array<bigint>, keys array<bigint>")


def _sets(docs: DataFrame, used: DataFrame, words: int) -> DataFrame:
    """(node, items array<bigint>): the sorted shingle sets of the nodes ``used`` (node, one): one names a row of ``docs`` by its doc_id and text hash."""

    def run(batches):
        fresh_worker()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.sort(shingles(t.as_py(), words).view(np.int64)) for t in b.column(1)], pa.list_(pa.int64()))], ["node", "items"])

    used = written(used.select("node", F.col("one.k1").alias("k1"), F.col("one.k2").alias("k2")), "used")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NULL)).alias("k1"), row_hash().alias("k2"), F.col("text").cast("string").alias("text"))
    sets = texts.join(few(used), ["k1", "k2"]).select("node", "text").mapInArrow(run, "node bigint, items array<bigint>")
    sets = written(sets.dropDuplicates(["node"]), "sets")  # equal rows of one doc_id
    drop_written(used)
    return sets


def _exact_keys(nodes: DataFrame) -> DataFrame:
    block = [F.shiftrightunsigned(F.col("fp")[0], 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    keys = [F.lit(t << 32) + F.shiftleft(block[i], 16) + block[j] for t, (i, j) in enumerate(PAIRS)]
    return nodes.select("node", "fp", F.array(*keys).alias("keys"))


def _distance(words: int):
    return sum((F.bit_count(F.col("a.fp")[i].bitwiseXOR(F.col("b.fp")[i])) for i in range(words)), F.lit(0))


def links(nodes: DataFrame, max_distance: int) -> DataFrame:
    """Edges (a, b) between nodes (node bigint, fp) at ``max_distance`` or less, which is 2; nodes have distinct fingerprints.

    Finds edges that give the same components as all such pairs would."""
    if max_distance != 2:
        raise ValueError("the exact mode links at 2 bits or fewer, no other distance")
    rows = written(_exact_keys(nodes).select("node", "fp", F.explode("keys").alias("key")), "blocks")
    rows = rows.join(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")
    small, many = rows.where(F.col("n") <= BUCKET), rows.where(F.col("n") > BUCKET)
    near = _distance(1) <= max_distance
    found = small.alias("a").join(small.alias("b"), "key").where(F.col("a.node") < F.col("b.node")).where(near).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
    free = [[1 << b if b < 63 else -(1 << 63) for k in range(4) if k not in p for b in range(16 * k, 16 * k + 16)] for p in PAIRS]
    masks = F.array(*[F.array(*[F.lit(m).cast("bigint") for m in [0, *x]]) for x in free])
    flips = many.select("node", "fp", F.explode(F.element_at(masks, F.shiftright("key", 32).cast("int") + 1)).alias("m")).select("node", F.col("fp")[0].bitwiseXOR(F.col("m")).alias("value")).distinct()
    met = flips.groupBy("value").agg(F.collect_set("node").alias("nodes")).where(F.size("nodes") > 1)  # at most 65 within one bit
    rest = met.select(F.array_min("nodes").alias("a"), F.explode("nodes").alias("b")).where("a <> b")
    return found.unionByName(rest).distinct()


def _candidate(a: str, b: str, similarity: float):
    """Whether the sizes and sketches of ``a`` and ``b`` allow this similarity."""
    differ = F.lit(0)
    for i in range(1, 1 + HASHES // 16):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        for step in (2, 1):  # the lowest bit of each four is set if any of them is
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
        differ = differ + F.bit_count(x.bitwiseAND(0x1111111111111111))
    sizes = (F.col(a)[0] >= similarity * F.col(b)[0]) & (F.col(b)[0] >= similarity * F.col(a)[0])
    return sizes & (differ <= sketch_distance(similarity))


def _alike(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets' Jaccard similarity is ``similarity`` or more."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                shared = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                keep.append(shared >= similarity * (len(x) + len(y) - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = written(pairs, "pairs")
    used = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = _sets(docs, nodes.join(used, "node", "left_semi"), words)
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b").join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
    alike = written(both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint"), "alike")
    drop_written(pairs)
    drop_written(sets)
    return alike


def linked(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """The first member of each set's group, where sets (sorted arrays) link at a Jaccard similarity of ``similarity`` or more."""
    size = np.array([len(x) for x in sets])
    value, count = np.unique(np.concatenate(sets), return_counts=True)
    value = value[count > 1]  # others are in no intersection
    shared = np.zeros((len(sets), len(sets)), np.float32)
    for i in range(0, len(value), 4096):
        part = value[i : i + 4096]
        held = np.zeros((len(sets), len(part)), np.float32)
        for k, x in enumerate(sets):
            x = x[np.searchsorted(x, part[0]) : np.searchsorted(x, part[-1], "right")]
            at = np.minimum(np.searchsorted(part, x), len(part) - 1)
            held[k, at[part[at] == x]] = 1
        shared += held @ held.T
    near = shared >= similarity * (size[:, None] + size[None, :] - shared) - 1e-4
    np.fill_diagonal(near, True)
    low = np.arange(len(sets))
    while ((new := np.where(near, low, len(sets)).min(axis=1)) != low).any():
        low = new
    return low


def _forest(similarity: float):
    """Edges from each node of a block's part to the first of its group."""

    def run(group):
        import pandas as pd

        group = group.drop_duplicates("node")
        node = group["node"].to_numpy()
        low = linked(group["items"].tolist(), similarity)
        some = low != np.arange(len(low))
        return pd.DataFrame({"a": node[low[some]], "b": node[some]})

    return run


def similar(nodes: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(node, component) of the nodes (node bigint, one, fp, keys) that are linked: the components of all pairs at ``similarity`` or more that share a block."""
    every = nodes.select("node", F.explode("keys").alias("key"))
    lows = every.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").drop("high")
    shared = written(every.join(lows, "key"), "shared")
    star = shared.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()
    star = star.join(nodes.select(F.col("node").alias("b"), F.col("fp").alias("y")), "b").join(nodes.select(F.col("node").alias("a"), F.col("fp").alias("x")), "a")
    first = _alike(star.where(_candidate("x", "y", similarity)).select("a", "b"), docs, nodes, words, similarity)
    part = components(first, "a", "b")
    rows = shared.join(part, "node", "left").select("key", "node", F.coalesce("component", "node").alias("part"))
    rows = written(rows.join(nodes.select("node", "fp"), "node"), "parted")
    sizes = rows.groupBy("key").agg(F.min("part").alias("least"), F.max("part").alias("most"), F.count("*").alias("n"), F.sum(F.col("fp")[0]).alias("weight"))
    cut = F.greatest(F.ceil(F.col("n") / PART), F.ceil(F.col("weight") / WEIGHT), F.lit(1)).cast("int").alias("cut")
    rows = rows.join(sizes.where("least < most").select("key", cut), "key")
    # each part of a block meets itself and every other one
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node", "key"), "cut").cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    jobs = written(rows.select("key", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), "own", "node", "fp", "part"), "jobs")
    same = (F.col("a.key") == F.col("b.key")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j"))
    apart = (F.col("a.part") != F.col("b.part")) & ((F.col("a.i") == F.col("a.j")) | (F.col("a.own") != F.col("b.own")))
    asked = written(jobs.alias("a").join(jobs.alias("b"), same & apart & _candidate("a.fp", "b.fp", similarity), "left_semi").select("key", "i", "j", "node"), "asked")
    # the same nodes mostly share several blocks: one of the parts with equal nodes is enough
    h = F.xxhash64("node")
    same_nodes = asked.groupBy("key", "i", "j").agg(F.bit_xor(h).alias("h1"), F.bit_xor(F.xxhash64(h)).alias("h2"), F.count("*").alias("n"))
    chosen = same_nodes.groupBy("h1", "h2", "n").agg(F.min(F.struct("key", "i", "j")).alias("job")).select("job.*")
    sets = _sets(docs, nodes.join(asked.select("node").distinct(), "node", "left_semi"), words)
    second = asked.join(chosen, ["key", "i", "j"], "left_semi").join(sets, "node").groupBy("key", "i", "j").applyInPandas(_forest(similarity), "a bigint, b bigint")
    second = written(second.distinct(), "alike")
    if not second.isEmpty():
        part = components(part.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(second), "a", "b")
    for table in (shared, rows, jobs, asked, sets, first, second):
        drop_written(table)
    return part


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, max_distance: int | None = None) -> DataFrame:
    """One row for each row of ``docs``: (doc_id, row, fp array<bigint>, component_id, component), component_id the
    smallest doc_id of its group, component the group's own number, row the text's hash.

    With ``max_distance`` (0 to 2) 64-bit fingerprints link exactly at that distance. Without, texts link where the Jaccard
    similarity of their shingle sets is ``similarity`` or more.
    """
    wide = max_distance is None
    text_batches(docs.sparkSession)
    one = F.min(F.struct(F.coalesce("doc_id", F.lit(_NULL)).alias("k1"), F.col("row").alias("k2"))).alias("one")
    if wide:
        fps = written(set_keys(docs, words), "fingerprints")
        nodes = written(fps.groupBy("node").agg(F.min("doc_id").alias("low"), one, F.first("fp").alias("fp"), F.first("keys").alias("keys")), "nodes")
        part = similar(nodes, docs, words, similarity)
    else:
        fps = written(fingerprints(docs, words).withColumn("node", F.col("fp")[0]), "fingerprints")
        nodes = written(fps.groupBy("node").agg(F.min("doc_id").alias("low"), F.first("fp").alias("fp")), "nodes")
        part = components(links(nodes.select("node", "fp"), max_distance), "a", "b")
    of = nodes.join(part, "node", "left").select("node", "low", "component")
    linked = of.where("component is not null")
    # a component may hold a third of all nodes: its smallest doc_id is handed to SALTS parts of it
    lows = linked.groupBy("component").agg(F.min("low").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    linked = linked.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(lows, ["component", "salt"])
    single = of.where("component is null").select("node", F.col("low").alias("component_id"), F.col("node").alias("component"))
    of = single.unionByName(linked.select("node", "component_id", "component"))
    return fps.join(of, "node").select("doc_id", "row", "fp", "component_id", "component")


def keep_one(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, that of the smallest doc_id (a null one only if there is no other)."""
    last = F.lit(2**63 - 1)
    k1, k2 = free_names(docs, "k1", "k2")
    groups = near_duplicates(docs, words, similarity).select("component", F.coalesce("doc_id", last).alias(k1), F.col("row").alias(k2))
    groups = written(groups, "groups")
    one = groups.groupBy("component").agg(F.min(F.struct(k1, k2)).alias("one")).select("one.*")
    gone = written(groups.select(k1, k2).join(one, [k1, k2], "left_anti").distinct(), "gone")
    keyed = docs.withColumns({k1: F.coalesce(F.col("doc_id").cast("bigint"), last), k2: row_hash()})
    kept = keyed.join(few(gone), [k1, k2], "left_anti")
    if not groups.groupBy(k1, k2).count().where("count > 1").isEmpty():  # rows of one doc_id and text
        kept = kept.dropDuplicates([k1, k2])
    return kept.select(*docs.columns)
