"""Quality classifier: support vectors over n-gram indicators scaled by naive Bayes log-count ratios.

A text's features are the sets of one to three consecutive words, A-Z lower-cased and without the marks around them, hashed into ``WORDS``
slots, and of one to three consecutive word shapes, hashed into ``SHAPES`` further slots. A shape stands for a word's whole form: runs of small letters, of digits and of
other letters than ASCII become one sign, runs of capitals and of equal marks two at most, and a word that repeats the one before is marked. Words are parted by ASCII white space. Spark
counts the slots of all labelled training rows, each task its own first; the log ratio of the smoothed class shares scales each indicator. A
linear hinge-loss model is fitted by dual coordinate descent on at most ``SAMPLE`` labelled rows
(half from each class, those with the smallest hash of doc_id), and a logistic curve over its margins,
weighted to the true class shares, gives scores in 0 to 1.

Defined results: null text is an empty text, whose features are none and whose score is the intercept's; labels with
a null doc_id or a quality other than 0 and 1 are ignored; of several labels for one doc_id the
largest counts; repeated documents are scored alike; a null doc_id is not held out; other columns are ignored. Without
labels of both classes every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import drop_written, few, fresh_worker, grams, plain_bytes, text_batches, word_hashes, written

SHAPES, WORDS = 1 << 18, 1 << 18
SPACE = SHAPES + WORDS
SAMPLE = 6_000
KEEP = 0.7
SMOOTHING, COST, EPOCHS = 1.0, 0.1, 12
_MARKS = b".,;:!?*&$%#|\"')](}[{<>_-"
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = _CLASS[128:] = ord("a")
_CLASS[65:91] = ord("A")
_CLASS[48:58] = ord("9")
_ONE = np.isin(np.arange(256), [ord("a"), ord("9")])
_AGAIN = np.uint64(0x94D049BB133111EB)
_PLAIN = plain_bytes(_MARKS)


def shapes(b: np.ndarray) -> np.ndarray:
    """The shapes of a byte array's words, white space in between."""
    c = _CLASS[b]
    same, one = np.concatenate([[False], c[1:] == c[:-1]]), _ONE[c]
    twice = np.concatenate([[False], same[1:] & same[:-1]])
    return c[~np.where(one, same, twice)]


def indicators(text: str | None) -> np.ndarray:
    """The slots of a text's features, sorted."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(b):
        return np.zeros(0, np.int32)
    w, s = word_hashes(b, values=_PLAIN), word_hashes(shapes(b))
    s[1:][w[1:] == w[:-1]] ^= _AGAIN
    slots = lambda h, n: (np.concatenate([h, grams(h, 2), grams(h, 3)]) >> np.uint64(65 - n.bit_length())).astype(np.int32)
    return np.unique(np.concatenate([slots(s, SHAPES), SHAPES + slots(w, WORDS)]))


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, feats array<int>) of each row."""
    text_batches(docs.sparkSession)

    def run(batches):
        fresh_worker()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([indicators(t.as_py()) for t in b.column(1)], pa.list_(pa.int32()))], ["doc_id", "feats"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, feats array<int>")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: np.ndarray, epochs: int) -> np.ndarray:
    """Weights (the last one the intercept's) of a linear hinge-loss model over indicator rows scaled by ``scale``."""
    w, alpha, order = np.zeros(len(scale) + 1), np.zeros(len(rows)), np.random.default_rng(0)
    norm = np.array([scale[r] @ scale[r] + 1.0 for r in rows])
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(len(rows)):
            r = rows[i]
            x = scale[r]
            g = y[i] * (w[r] @ x + w[-1]) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
            if step := new - alpha[i]:
                w[r] += step * y[i] * x
                w[-1] += step * y[i]
                alpha[i] = new
                worst = max(worst, abs(step))
        if worst < 1e-4:
            break
    return w


def logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve that fits labels to margins, by Newton steps."""
    a, b = 1.0, 0.0
    target = np.where(y > 0, 1 - 1e-3, 1e-3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, h = weight * (p - target), weight * p * (1 - p) + 1e-9
        m = np.array([[h @ margin**2 + 1e-3, h @ margin], [h @ margin, h.sum() + 1e-6]])
        da, db = np.linalg.solve(m, [g @ margin, g.sum()])
        a, b = max(a - da, 1e-3), b - db
        if abs(da) + abs(db) < 1e-6:
            break
    return float(a), float(b)


def _counted(batches):
    """A task's counts of each slot among texts of quality 0 and 1."""
    fresh_worker()
    counts = np.zeros((2, SPACE), np.int64)
    for b in batches:
        for q, t in zip(b.column(0).to_pylist(), b.column(1)):
            counts[q, indicators(t.as_py())] += 1
    some = np.flatnonzero(counts.any(axis=0))
    for i in range(0, len(some), 65536):
        at = some[i : i + 65536]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[0, at]), pa.array(counts[1, at])], ["slot", "n0", "n1"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """(weights, slope, offset), from the labelled rows of ``docs`` that are not held out; None without both classes.

    What reaches the driver is bounded: two counts a slot, and ``sample`` rows."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    known = written(known, "known")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where(~held_out()).join(few(known), "doc_id")
    ids = written(rows.select("doc_id", "quality"), "ids")
    total = {r.quality: r.n for r in ids.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if set(total) != {0, 1}:
        return None
    text_batches(docs.sparkSession)
    each = rows.select("quality", "text").mapInArrow(_counted, "slot int, n0 bigint, n1 bigint")
    found = each.groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    counts = np.full((2, SPACE), SMOOTHING)
    counts[:, found["slot"].to_numpy()] += np.array([found["n0"].to_numpy(), found["n1"].to_numpy()])
    del found
    share = counts / counts.sum(axis=1, keepdims=True)
    scale = np.where(counts.sum(axis=0) > 2 * SMOOTHING, np.log(share[1] / share[0]), 0.0)
    vectors, y = [], []  # what reaches the driver is bounded by the slots and the sample
    for q in (0, 1):
        chosen = ids.where(F.col("quality") == q).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2)
        part = features(rows.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")).dropDuplicates(["doc_id"]).select("feats").toArrow()["feats"]
        vectors += [r for c in part.chunks for r in np.split(c.flatten().to_numpy(), (c.offsets.to_numpy() - c.offsets[0].as_py())[1:-1]) if len(c)]
        y += [2 * q - 1] * len(part)
    y = np.array(y)
    seen = {q: int((y == 2 * q - 1).sum()) for q in (0, 1)}
    w = dual_coordinate_descent(vectors, y, scale, np.full(len(y), COST), EPOCHS)
    drop_written(ids)
    drop_written(known)
    weights = np.append(w[:-1] * scale, w[-1]).astype(np.float32)
    margin = np.array([weights[r].sum() for r in vectors]) + weights[-1]
    a, b = logistic(margin, y, np.where(y > 0, total[1] / seen[1], total[0] / seen[0]))
    return weights, a, b


def _scores(model, texts: list) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    weights, slope, offset = model
    margin = np.array([weights[indicators(t)].sum(dtype=np.float64) for t in texts]) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(slope * margin + offset, -700, 700)))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def run(batches):
        fresh_worker()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scores(model.value, [t.as_py() for t in b.column(1)]), pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``KEEP``; they are scored where they are read, without a shuffle.

    Null and empty texts are judged by the intercept, repeated rows alike, all columns stay; without labels of both classes nothing can be
    judged and all rows are kept."""
    fitted = fit(docs, labels, sample)
    if fitted is None:
        return docs
    model = docs.sparkSession.sparkContext.broadcast(fitted)
    at = docs.columns.index("text")

    def run(batches):
        fresh_worker()
        for b in batches:
            yield b.filter(pa.array(_scores(model.value, [t.as_py() for t in b.column(at)]) >= KEEP))

    return docs.mapInArrow(run, docs.schema)
