"""Alignment of two tokenizers: where their tokens end together, which tokens overlap, and how often two ids do so in the corpus.

Python only tokenises: both tokenizers cut a text at the same units (see :mod:`units`), each encoded once, and a text becomes rows of
ids and byte ends in both vocabularies, a row for about ``CHUNK`` characters, cut between units. All else is done by Spark's
array functions on those columns: ``array_intersect`` of the ends cuts a row into groups, a token's number at each byte comes from
repeated numbers, ``transform`` over all ends gives the links, ``sequence`` and ``transform`` write the groups.
Every step is linear in a row's length.

Links are counted over the corpus by one aggregation, and their counts come back by a join, broadcast up to
``COUNTS`` rows, else with salted hot links; documents sum them up.

Defined results: null and empty texts, and texts that either vocabulary does not spell, have no tokens; repeated rows are counted
again; null doc_ids stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import SALTS, arrow_batches, process_cache, written
from framewright.llm.units import ByteLevel, Memory, Pieces, units

#: Characters of text that are cut at once, and of a row; rows that are broadcast at most.
AT_ONCE, CHUNK, COUNTS = 1 << 20, 1 << 16, 1_000_000
_IDS = pa.list_(pa.int32())
_KINDS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("chunk", pa.int32()), ("chunks", pa.int32()), ("a", _IDS), ("a_ends", _IDS), ("b", _IDS), ("b_ends", _IDS)])
_SCHEMA = "row bigint, doc_id bigint, chunk int, chunks int, a array<int>, a_ends array<int>, b array<int>, b_ends array<int>"


def chunks_of(cut: list[str]) -> list[list[str]]:
    """The units of a text in runs of about ``CHUNK`` characters; at least one run, a longer unit has its own."""
    if len(cut) < 2 or (at := np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)) + 1) // CHUNK)[-1] == 0:
        return [cut]
    edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(cut)]
    return [cut[i:j] for i, j in zip(edges, edges[1:])]


class Aligner:
    """Both tokenizers of a worker with the units they have met."""

    def __init__(self, a: str, b: bytes):
        # two memories leave no room for parts of words beside the units
        self.memories = Memory(ByteLevel(a), parts=False), Memory(Pieces(b), parts=False)

    def table(self, docs: list[tuple[int | None, str]], row: int) -> pa.RecordBatch:
        """The rows of ``docs``, numbered from ``row``."""
        cuts = [units(" " + t) if t else [] for _, t in docs]
        every = set().union(*cuts)
        for m in self.memories:
            m.room()
            m.learn(every)
        found = [m.found.__getitem__ for m in self.memories]
        numbers, packed = [], ([], [])
        for k, ((doc, _), cut) in enumerate(zip(docs, cuts)):
            parts = chunks_of(cut)
            try:
                spelt = [[b"".join(map(f, c)) for c in parts] for f in found]
            except TypeError:  # a unit that is not spelt is None
                parts, spelt = [[]], [[b""], [b""]]
            numbers += [(row + k, doc, i, len(parts)) for i in range(len(parts))]
            for held, own in zip(packed, spelt):
                held += own
        columns = [c for m, own in zip(self.memories, packed) for c in self.ids_and_ends(m, own)]
        return pa.RecordBatch.from_arrays([*(pa.array(c, x.type) for c, x in zip(zip(*numbers), _KINDS)), *columns], schema=_KINDS)

    @staticmethod
    def ids_and_ends(memory: Memory, packed: list[bytes]):
        count = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        ids = np.frombuffer(b"".join(packed), "<u4").astype(np.int32)
        at, edges = np.cumsum(memory.size[ids]), np.concatenate([[0], np.cumsum(count)])
        ends = at - np.repeat(np.concatenate([[0], at])[edges[:-1]], count)
        offsets = pa.array(edges.astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.ListArray.from_arrays(offsets, pa.array(ends.astype(np.int32)))


def _tokenised(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    context = docs.sparkSession.sparkContext
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        held = context.broadcast((f.read(), g.read()))

    def run(batches):
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        aligner = process_cache(f"aligned {a_path} {b_path}", lambda: Aligner(*held.value))
        row, some, size = TaskContext.get().partitionId() << 33, [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py() or ""
                if some and size + len(text) > AT_ONCE:
                    yield aligner.table(some, row)
                    row, some, size = row + len(some), [], 0
                some.append((doc, text))
                size += len(text)
        if some:
            yield aligner.table(some, row)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, _SCHEMA)


def _token_at(ends: str):
    """For each byte of a row, the number of the token that holds it."""
    return F.flatten(F.transform(ends, lambda e, k: F.array_repeat(k, e - F.coalesce(F.get(ends, k - 1), F.lit(0)))))


def aligned_rows(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(row, doc_id, chunk, chunks, n_a, n_b, n_groups, links, groups): links as (a id << 32 | b id)."""
    cut = _tokenised(docs, a_path, b_path).withColumns({"a_at": _token_at("a_ends"), "b_at": _token_at("b_ends"), "cuts": F.array_intersect("a_ends", "b_ends")})
    links = F.transform(F.array_union("a_ends", "b_ends"), lambda e: F.get("a", F.get("a_at", e - 1)).cast("bigint") * (1 << 32) + F.get("b", F.get("b_at", e - 1)))

    def side(ids, at, before, end):
        first, last = F.get(at, before), F.get(at, end - 1)  # most groups have one token a side
        several = F.array_join(F.transform(F.sequence(first, last), lambda i: F.get(ids, i).cast("string")), ",")
        return F.when(first == last, F.get(ids, first).cast("string")).otherwise(several)

    def group(end, k):
        before = F.coalesce(F.get("cuts", k - 1), F.lit(0))
        return F.concat(side("a", "a_at", before, end), F.lit("|"), side("b", "b_at", before, end))

    sizes = [F.size(x).cast("bigint").alias(y) for x, y in (("a", "n_a"), ("b", "n_b"), ("cuts", "n_groups"))]
    return cut.select("row", "doc_id", "chunk", "chunks", *sizes, links.alias("links"), F.array_join(F.transform("cuts", group), ";").alias("groups"))


def link_counts(rows: DataFrame) -> DataFrame:
    """(link, n, best): how often each pair of ids is linked, and 1 where no pair with its B id is linked more often."""
    counts = rows.select(F.explode("links").alias("link")).groupBy("link").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts.withColumn("b", F.col("link").bitwiseAND(F.lit((1 << 32) - 1))), "counts")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))  # a row for each id of the vocabulary at most
    return counts.join(F.broadcast(most), "b").select("link", "n", (F.col("n") == F.col("most")).cast("bigint").alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each row; groups is the text `a1,a2|b1;a3|b2,b3` of ids."""
    with arrow_batches(docs.sparkSession, 2000):
        rows = written(aligned_rows(docs, a_path, b_path), "aligned")
    counts = written(link_counts(rows), "links")
    each = rows.select("row", F.explode("links").alias("link"))
    if counts.count() <= COUNTS:
        each = each.join(F.broadcast(counts), "link")
    else:
        salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        each = each.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["link", "salt"])
    sums = written(each.groupBy("row").agg(F.sum("best").alias("n_best"), F.sum("n").alias("count_sum")), "sums")
    sizes = ("n_a", "n_b", "n_groups")
    one = rows.where("chunks = 1").select("row", "doc_id", *sizes, "groups")
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("chunk", "groups"))), lambda x: x["groups"])
    more = rows.where("chunks > 1").groupBy("row", "doc_id").agg(*[F.sum(c).alias(c) for c in sizes], F.array_join(in_order, ";").alias("groups"))
    whole = one.unionByName(more).join(F.broadcast(sums) if sums.count() <= COUNTS else sums, "row", "left")
    n_links = F.col("n_a") + F.col("n_b") - F.col("n_groups")  # one for each place where either has an end
    return whole.select("doc_id", *sizes, n_links.alias("n_links"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")], "groups")
