"""Embedding near-duplicates: spherical k-means cells, blocked cosine products inside the cells, one representative a group.

Only rows with equal labels are compared. Equal vectors of a label are one node with a count. A k-means over unit vectors, fitted on a
sample of about ``SAMPLE`` vectors a label, gives each label its cells, more the more nodes it has; every node has a home, the cell of its nearest centroid.
Two linked vectors with different homes have one of the two within half the largest chord of the plane
between the cells, so each node also visits the cells whose plane is that near: no link is lost, whatever
the sample. A large cell is cut into blocks of ``BLOCK`` nodes; homes and visitors meet block by block, and a block pair hands out
counts and one edge a node, never pairs.

Defined results: null, empty or zero vectors, vectors with a null or non-finite component and rows with a null label link with nothing; vectors
of different lengths are never compared; repeated rows link with each other, a repeated vec_id being a vector of its own;
a null vec_id is never a group's smallest; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.common import arrow_batches, components, drop_written, written

COSINE = 0.93
#: Vectors a label that the k-means sees, about; nodes of a block; most cells a label; rounds.
SAMPLE, BLOCK, CELLS, ROUNDS = 4000, 1024, 512, 8
#: A label of N nodes asks for sqrt(N) / ``SPREAD`` cells; where all labels ask for more than ``CENTROIDS``, each gets its share.
SPREAD, CENTROIDS = 3, 20_000


def k_means(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit rows by cosine."""
    c = x[np.random.default_rng(3).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        home = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (own := x[home == j]).size and (n := np.linalg.norm(s := own.sum(axis=0))) > 0:
                c[j] = s / n
    return c


def _fit(group):
    import pandas as pd

    x = np.stack(group["v"].to_numpy())
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = k_means(x, int(group["k"].iloc[0]))
    return pd.DataFrame({"label": group["label"].iloc[0], "dim": group["dim"].iloc[0], "c": list(c)})


def centroids(nodes: DataFrame) -> dict:
    """Centroids by (label, length), for labels with two cells or more; at most ``CENTROIDS`` in all reach the driver.

    A node is in the sample by its hash, so no label passes through one task."""
    asked = F.least(F.floor(F.sqrt("total") / SPREAD), F.lit(CELLS))
    labels = nodes.groupBy("label", "dim").agg(F.count("*").alias("total")).withColumn("k", asked)
    share = min(1.0, CENTROIDS / max(labels.agg(F.sum("k")).first()[0] or 0, 1))
    labels = labels.withColumn("k", F.floor(F.col("k") * share)).where("k > 1")
    drawn = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) * F.col("total") < F.lit(SAMPLE << 30)
    seen = nodes.join(F.broadcast(labels), ["label", "dim"]).where(drawn)
    fitted = seen.select("label", "dim", "v", "k").groupBy("label", "dim").applyInPandas(_fit, "label bigint, dim int, c array<double>")
    out: dict = {}
    for r in fitted.collect():
        out.setdefault((r.label, r.dim), []).append(r.c)
    return {k: np.array(c) for k, c in out.items()}


def _gaps(c: np.ndarray) -> np.ndarray:
    """Distances between centroids, not below the exact ones."""
    size = (c * c).sum(axis=1)
    return np.sqrt(np.maximum(size[:, None] + size - 2 * (c @ c.T), 0) + 1e-12)


def _places(held, cosine: float):
    """Gives each node its cells, the home first."""
    half = np.sqrt(2 - 2 * cosine) / 2 + 1e-9

    def run(batches):
        cells = held.value
        gaps: dict = {}
        for b in batches:
            out, members = [[0]] * b.num_rows, {}
            for i, key in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                if key in cells:
                    members.setdefault(key, []).append(i)
            for key, at in members.items():
                c = cells[key]
                if key not in gaps:
                    gaps[key] = _gaps(c)
                v = b.column(3).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
                near = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ c.T
                homes = near.argmax(axis=1)
                visits = near.max(axis=1)[:, None] - near <= half * gaps[key][homes]
                for i, home, there in zip(at, homes.tolist(), visits):
                    out[i] = [home, *(j for j in np.flatnonzero(there).tolist() if j != home)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int32()))], ["node", "label", "dim", "v", "n", "cells"])

    return run


def _groups(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each node's group under the edges a-b."""
    low = np.arange(size)
    while True:
        least = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _products(cosine: float):
    """Links between the two sides of a block pair: each node's count and its group's first node."""

    def run(group):
        import pandas as pd

        left, right = (group[group["side"] == s].drop_duplicates("node") for s in (0, 1))
        same = bool(group["same"].iloc[0])
        if same:
            right = left
        if not len(left) or not len(right):
            return pd.DataFrame({"node": [], "links": [], "root": []}).astype("int64")
        x, y = (np.stack(t["v"].to_numpy()) for t in (left, right))
        x, y = (t / np.linalg.norm(t, axis=1, keepdims=True) for t in (x, y))
        near = x @ y.T >= cosine
        cell = int(group["cell"].iloc[0])
        home = np.array([c[0] for c in right["cells"]])
        if same:
            np.fill_diagonal(near, False)
        for h in set(home.tolist()) - {cell}:  # a pair that meets in both its homes counts in the lower one
            if h < cell:
                both = np.array([h in c for c in left["cells"]])
                near[np.ix_(both, home == h)] = False
        a, b = np.nonzero(near)
        nodes = np.concatenate([t["node"].to_numpy(np.int64) for t in ((left,) if same else (left, right))])
        links = np.zeros(len(nodes), np.int64)
        links[: len(left)] = near @ right["n"].to_numpy()
        if not same:
            links[len(left) :] = near.T @ left["n"].to_numpy()
            b = b + len(left)
        low, some = _groups(len(nodes), a, b), links > 0
        return pd.DataFrame({"node": nodes[some], "links": links[some], "root": nodes[low[some]]})

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``vectors`` (vec_id, embedding, label)."""
    v = F.col("embedding").cast("array<double>")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.coalesce(F.col("label").isNotNull() & F.col("v").isNotNull() & ~odd & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), v.alias("v"))
    rows = rows.withColumn("node", F.when(good, F.xxhash64("label", "v"))).withColumn("dim", F.size("v"))
    nodes = rows.where("node is not null").groupBy("node", "label", "dim", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"))
    nodes = written(nodes, "vectors")
    with arrow_batches(vectors.sparkSession, 4000):
        held = vectors.sparkSession.sparkContext.broadcast(centroids(nodes))
        placed = nodes.select("node", "label", "dim", "v", "n").mapInArrow(_places(held, cosine), "node bigint, label bigint, dim int, v array<double>, n bigint, cells array<int>")
        placed = written(placed, "cells")
    every = placed.select("*", F.posexplode("cells").alias("visit", "cell")).withColumn("visit", F.col("visit") > 0)
    sizes = every.groupBy("label", "dim", "cell").agg(F.ceil(F.count_if(~F.col("visit")) / BLOCK).alias("homes"), F.ceil(F.count_if("visit") / BLOCK).alias("visits"))
    every = every.join(sizes, ["label", "dim", "cell"])
    own = F.pmod(F.col("node"), F.when(F.col("visit"), F.col("visits")).otherwise(F.col("homes"))).cast("int")
    every = every.withColumn("own", own)
    upto = lambda n: F.sequence(F.lit(0), F.col(n).cast("int") - 1)
    job = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    first = F.transform(upto("homes"), lambda k: job(0, F.least("own", k), F.greatest("own", k), 0))
    # a home block is the left side against itself and later blocks, the right side against earlier ones; it meets all visitors' blocks
    sided = F.transform(first, lambda x: x.withField("side", F.when(x["i"] == F.col("own"), 0).otherwise(1)))
    meets = F.when(F.col("visits") > 0, F.transform(upto("visits"), lambda k: job(1, F.col("own"), k, 0))).otherwise(F.array())
    visits = F.when(F.col("homes") > 0, F.transform(upto("homes"), lambda k: job(1, k, F.col("own"), 1))).otherwise(F.array())
    jobs = every.withColumn("job", F.explode(F.when(F.col("visit"), visits).otherwise(F.concat(sided, meets))))
    jobs = jobs.select("label", "dim", "cell", "job.*", "node", "v", "n", "cells").withColumn("same", F.expr("kind = 0 and i = j"))
    met = jobs.groupBy("label", "dim", "cell", "kind", "i", "j").applyInPandas(_products(cosine), "node bigint, links bigint, root bigint")
    with arrow_batches(vectors.sparkSession, 4000):
        met = written(met, "links")
    drop_written(placed)
    counts = met.groupBy("node").agg(F.sum("links").alias("links"))
    part = components(met, "node", "root")
    of = nodes.select("node", "n", "low").join(counts, "node", "left").join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lows = of.groupBy("component").agg(F.min("low").alias("component_id"))
    of = of.join(lows, "component").select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    # rows that link with nothing are spread by their vec_id instead of meeting at null
    out = rows.select("vec_id", "node", F.coalesce("node", F.xxhash64("vec_id")).alias("at"), F.col("node").isNotNull().alias("known"))
    out = out.join(of.withColumnRenamed("node", "at").withColumn("known", F.lit(True)), ["at", "known"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
