"""Shared pieces: written tables in the shared folder, and connected components by star contraction."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import tempfile
import types
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the context's; a new one only where neither is set."""
    sc = spark.sparkContext
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own is None:
        found = sc._jsc.sc().getCheckpointDir()
        own = found.get() if found.isDefined() else None
    if own is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="framewright-")
        sc.setCheckpointDir(own)
    return own


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, made of ``names``; Spark compares names without regard to case."""
    held = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def drop_written(df: DataFrame) -> None:
    """Delete a table made by :func:`written` once nothing reads it any more."""
    path = getattr(df, "_written_at", None)
    if path:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


#: Rows that are broadcast at most; more are shuffled.
BROADCAST = 200_000
#: Parts that the rows of a hub or of a hot component are dealt to.
SALTS = 16


def few(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has ``BROADCAST`` rows or less."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def text_batches(spark: SparkSession, rows: int = 500) -> None:
    """Hand Python at most ``rows`` rows, or 32 MB, at once, so that a batch of very long texts fits in a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 32 << 20)


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, rows: int = 10_000, size: int = 32 << 20):
    """Hands Python at most ``rows`` rows or ``size`` bytes at once in what is run inside, and then sets the session back."""
    own = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def grouped(batches, most: int, size=lambda b: b.nbytes):
    """Arrow batches in groups of about ``most`` bytes; a larger batch is a group of its own."""
    held, total = [], 0
    for b in batches:
        n = size(b)
        if held and total + n > most:
            yield held
            held, total = [], 0
        held.append(b)
        total += n
    if held:
        yield held


def _give_back() -> None:
    """What Python, Arrow and the C library have freed goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def process_cache(key: str, make):
    """What ``make()`` built first in this Python worker: later tasks of the same process use it again.

    One value is held at a time: another key drops it, so that a worker never keeps two operators' tables, and memory of earlier tasks is given back."""
    held = sys.modules.setdefault("_framewright_cache", types.ModuleType("_framewright_cache")).__dict__
    if held.get("key") != key:
        held |= {"key": key, "value": None}
        _give_back()
        held["value"] = make()
    return held["value"]


def fresh_worker() -> None:
    """Give back what an earlier operator's tasks held in this Python worker."""
    process_cache("", lambda: None)
    _give_back()


_BYTE = np.random.default_rng(5).integers(0, 2**64, 256, np.uint64) | np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 2**64)
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        each = np.full(max(n, 1 << 16), base, np.uint64)
        each[0] = 1
        held = _powers[base] = each.cumprod(dtype=np.uint64)
    return held[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def plain_bytes(marks: bytes) -> np.ndarray:
    """Byte values for :func:`word_hashes` that take A-Z for a-z and pass over ``marks`` around words."""
    values = _BYTE.copy()
    values[65:91] = values[97:123]
    values[np.frombuffer(marks, np.uint8)] = 0
    return values


def word_hashes(b: np.ndarray, at_once: int = 1 << 16, values: np.ndarray = _BYTE) -> np.ndarray:
    """A 64-bit hash of each word of a byte array, words parted by ASCII white space; equal words have equal hashes.

    Works on about ``at_once`` bytes at a time, or on one word where that is longer."""
    space = _SPACE[b]
    cut, out = 0, []
    while cut < len(b):
        end = min(cut + at_once, len(b))
        if end < len(b):
            back = np.flatnonzero(space[cut:end])
            if len(back):
                end = cut + int(back[-1]) + 1
            else:
                while end < len(b) and not space[end]:
                    ahead = np.flatnonzero(space[end : end + at_once])
                    end = end + int(ahead[0]) if len(ahead) else min(end + at_once, len(b))
        edge = np.diff(np.concatenate([[True], space[cut:end], [True]]).view(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        total, value = np.zeros(end - cut + 1, np.uint64), values[b[cut:end]]
        np.cumsum(value * _power(_STEP, end - cut), out=total[1:])
        sums = total[ends] - total[starts]
        if values is not _BYTE:  # a word counts from its first byte that is no mark
            live = np.flatnonzero(value)
            starts = np.append(live, end - cut)[np.searchsorted(live, starts)]
        out.append(mixed(sums * _power(_BACK, end - cut + 1)[starts]))
        cut = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """The hashes of all runs of ``n`` words."""
    out = h[: max(0, len(h) - n + 1)]
    for i in range(1, n):
        out = out * np.uint64(0xBF58476D1CE4E5B9) + h[i : i + len(out)]
    return mixed(out + np.uint64(n)) if n > 1 else out


def _beside(edges: DataFrame, low: DataFrame, key: str) -> DataFrame:
    """``edges`` (u, v) with the m of ``low`` (key, m) or null; beyond a broadcast, a hub's edges are dealt to ``SALTS`` parts."""
    if low.count() <= BROADCAST:
        return edges.join(F.broadcast(low), key, "left")
    low = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("salt", F.pmod(F.xxhash64("u", "v"), F.lit(SALTS)).cast("int")).join(low, [key, "salt"], "left").drop("salt")


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of the graph with an edge for each row (a, b), both bigint.

    Returns (node, component): component is the smallest node reachable; nodes without an edge
    to another node are absent. Alternates large-star and small-star contraction; each
    round moves at most two rows an edge. Only nodes that are not yet leaf or centre of a star are joined to the edges, so a
    hub's edges stay where they are, and when there are none such the graph is settled. Rows with a null end are ignored.
    """
    e = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges"
    )
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # nodes with smaller and larger neighbours hand the larger ones to their smallest
        between = both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("high")).where("m < u and u < high")
        between = written(between.select(F.col("u").alias("v"), "m"), "between")
        large = _beside(e, between, "v").select("u", F.coalesce("m", "v").alias("v"))
        # nodes with several smaller neighbours hand them to the smallest
        many = large.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("high")).where("m < high")
        many = written(many.select("u", "m"), "many")
        settled = between.isEmpty() and many.isEmpty()
        if not settled:
            ends = F.when(F.col("m").isNull(), F.array(F.struct("u", "v"))).otherwise(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
            small = written(_beside(large, many, "u").select(F.explode(ends).alias("x")).select("x.*").where("u <> v").distinct(), "edges")
            drop_written(e)
            e = small
        drop_written(between)
        drop_written(many)
        if settled:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
