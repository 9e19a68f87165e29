"""Spelling variants: words that differ by one inserted, deleted or replaced code point, found by rolling-hash deletions.

The prefix and suffix polynomial hashes of a word give the hash of the word without each of its letters, as NumPy integers for
many words at once. A task deals its keys out by their highest bits (radix), Spark sorts each part, and one pass over a part keeps
the rows whose key meets another: two words without their letter at the same place (a replaced letter), or a whole word and a
longer one without a letter (a deleted one). Strings of what is left then verify each meeting, so equal hashes of different strings
link nothing. A meeting place holds at most one word for each letter of the alphabet and each place of the word, so no pairs are
listed: a place counts its words and finds the most frequent of them once for all.

Defined results: null and empty texts have no words; a null doc_id reads as an empty one; repeated rows count again; an empty table
gives an empty result; other columns are ignored. Words of any length are whole; a word of L letters has L + 1 keys of fixed size.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewright.llm.common import _power, arrow_batches, drop_written, mixed, written

#: Letters of words.
LETTERS = "A-Za-z\u00C0-\u00FF"
#: Words that a task counts before it hands them on; letters hashed at once; keys of a part, about.
COUNTED, AT_ONCE, PART = 300_000, 1 << 19, 2_000_000
#: Bits of a key that count; with few, unlike strings meet in tests.
BITS = 64
_LOWER = {c: c + 32 for c in range(65, 91)}
_LETTER = np.random.default_rng(11).integers(0, 2**64, 1 << 16, np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_BASE, -1, 2**64))


def word_counts(docs: DataFrame, shortest: int = 7, least: int = 2, typo: int = 0) -> DataFrame:
    """(word, n): the runs of letters of all texts in small letters (A-Z only), of ``shortest`` code points and ``least`` occurrences at least.

    With ``typo``, a run loses a letter where typo divides h, the crc32 of "<doc_id>:<run>": the one at h modulo its length."""
    find = re.compile(f"[{LETTERS}]{{{max(1, shortest)},}}").findall

    def run(batches):
        held: Counter = Counter()

        def out():
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                if not text:
                    continue
                before = zlib.crc32(b"" if doc is None else b"%d" % doc)
                before = zlib.crc32(b":", before)
                for w, k in Counter(find(text)).items():
                    w = w.lower() if w.isascii() else w.translate(_LOWER)
                    if typo:
                        h = zlib.crc32(w.encode(), before)
                        if h % typo == 0:
                            i = h % len(w)
                            w = w[:i] + w[i + 1 :]
                    if len(w) >= shortest:
                        held[w] += k
                if len(held) >= COUNTED:
                    yield from out()
        if held:
            yield from out()

    counted = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, word number, place, first) of each word whole (place -1) and without each letter; first is false for a
    letter that equals the one before it, whose deletion gives the same string."""
    size = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    own = np.repeat(np.arange(len(words)), size)
    start = np.cumsum(size) - size
    place = np.arange(len(points)) - start[own]
    value = _LETTER[points & 0xFFFF] * (np.uint64(1) + (points >> 16).astype(np.uint64) * np.uint64(2))
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * _power(_BASE, int(size.max(initial=0)) + 1)[place], dtype=np.uint64)])
        whole = total[start + size] - total[start]
        prefix = total[:-1] - total[start][own]
        suffix = total[start + size][own] - total[1:]
        key = prefix + suffix * _BACK
        keys = mixed(np.concatenate([whole, key]) + np.concatenate([size, size[own] - 1]).astype(np.uint64))
    first = np.ones(len(points), bool)
    first[1:] = (points[1:] != points[:-1]) | (own[1:] != own[:-1])
    return keys, np.concatenate([np.arange(len(words)), own]), np.concatenate([np.full(len(words), -1), place]), np.concatenate([np.ones(len(words), bool), first])


_KEYS = "radix int, key bigint, place int, first boolean, id bigint"
_MET = "key bigint, place int, kind int, id bigint"
#: Kinds of a meeting row: a whole word, a longer word without a letter, words without the letter of one place.
WHOLE, DELETED, REPLACED = 0, 1, 2


def _keys_of(parts: int, bits: int):
    def run(batches):
        for b in batches:
            ids, words = b.column(0).to_numpy(), b.column(1).to_pylist()
            size = np.cumsum([len(w) for w in words])
            cuts = [0, *np.flatnonzero(np.diff(size // AT_ONCE)).tolist(), len(words)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                keys, own, place, first = deletion_keys(words[i:j])
                keys = keys >> np.uint64(64 - bits) << np.uint64(64 - bits)
                radix = (keys >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)
                for k in range(0, len(keys), 1 << 18):
                    s = slice(k, k + (1 << 18))
                    yield pa.RecordBatch.from_arrays([pa.array(radix[s].astype(np.int32)), pa.array(keys[s].view(np.int64)), pa.array(place[s].astype(np.int32)), pa.array(first[s]), pa.array(ids[i:j][own[s]])], ["radix", "key", "place", "first", "id"])

    return run


def _meet(batches):
    """The rows of sorted keys that meet another row; the rows of the last key wait for the next batch."""
    held = None
    for b in batches:
        new = [b.column(c).to_numpy(zero_copy_only=False) for c in range(4)]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        last = int(np.searchsorted(held[0], held[0][-1]))
        if last:
            yield _met([x[:last] for x in held])
            held = [x[last:] for x in held]
    if held is not None:
        yield _met(held)


def _met(rows: list[np.ndarray]) -> pa.RecordBatch:
    key, place, first, ids = rows
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    group = np.cumsum(new_key) - 1
    spot = np.cumsum(new_key | np.concatenate([[True], place[1:] != place[:-1]])) - 1
    whole, deleted = place < 0, (place >= 0) & first
    both = (np.bincount(group, whole) > 0) & (np.bincount(group, deleted) > 0)
    alike = (np.bincount(spot)[spot] > 1) & ~whole
    out = [(np.flatnonzero(mask), kind) for mask, kind in ((whole & both[group], WHOLE), (deleted & both[group], DELETED), (alike, REPLACED))]
    at = np.concatenate([i for i, _ in out])
    kind = np.concatenate([np.full(len(i), k, np.int32) for i, k in out])
    return pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(place[at]), pa.array(kind), pa.array(ids[at])], ["key", "place", "kind", "id"])


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each row of ``words`` (word, n), whose words are distinct.

    Near words differ by one code point; form is the near word of largest n (ties: the first in code-point order) if its n is at least ``ratio``
    times the word's, else null; root follows forms to the last. ``ratio`` is above 1, so that forms lead to ever larger n."""
    if ratio <= 1:
        raise ValueError("ratio must be above 1")
    with arrow_batches(words.sparkSession):
        return _variants(words, ratio)


def _variants(words: DataFrame, ratio: int) -> DataFrame:
    spark = words.sparkSession
    words = written(words.select(F.col("word"), F.col("n").cast("bigint")).where("word is not null").withColumn("id", F.monotonically_increasing_id()), "words")
    keys = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keys // PART))
    dealt = words.select("id", "word").mapInArrow(_keys_of(parts, BITS), _KEYS).repartitionById(parts, F.col("radix"))
    met = dealt.select("key", "place", "first", "id").sortWithinPartitions("key", "place").mapInArrow(_meet, _MET)
    # the strings: equal keys count only where what is left of the words is equal
    rest = F.when(F.col("kind") == WHOLE, F.col("word")).otherwise(F.concat(F.expr("substring(word, 1, place)"), F.expr("substring(word, place + 2)")))
    spot = F.when(F.col("kind") == REPLACED, F.col("place")).otherwise(-1)
    met = met.join(words, "id").select("id", "key", "kind", rest.alias("rest"), spot.alias("spot"), F.struct((-F.col("n")).alias("less"), "word", "id").alias("as"))
    w = Window.partitionBy("key", "rest", "spot")
    of = lambda kind: F.col("kind") == kind
    met = met.select("id", "kind", *(f(F.when(of(k), x)).over(w).alias(f"{name}{k}") for k in (WHOLE, DELETED, REPLACED) for name, f, x in (("count", F.count, F.lit(1)), ("best", F.min, F.col("as")))))
    near = F.when(of(WHOLE), F.col(f"count{DELETED}")).when(of(DELETED), F.col(f"count{WHOLE}")).otherwise(F.col(f"count{REPLACED}") - 1)
    best = F.when(of(WHOLE), F.col(f"best{DELETED}")).when(of(DELETED), F.col(f"best{WHOLE}")).otherwise(F.col(f"best{REPLACED}"))
    # a word that is the best of its own place has no form there, since a form is more frequent
    links = met.select("id", near.alias("near"), best.alias("best")).groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    formed = (-F.col("best.less")) >= ratio * F.col("n")
    out = words.join(links, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *(F.when(formed, F.col("best")[x]).alias(a) for x, a in (("word", "form"), ("id", "form_id"), ("less", "less"))))
    out = written(out, "forms")
    roots = written(out.where("form_id is not null").select("id", F.col("form_id").alias("root")), "roots")
    while True:  # each round doubles the steps that are taken, and each step multiplies n by ratio
        ahead = roots.select(F.col("id").alias("root"), F.col("root").alias("next"))
        longer = written(roots.join(ahead, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop_written(roots)
        roots = longer
        if roots.where("moved").isEmpty():
            break
        roots = roots.drop("moved")
        roots._written_at = longer._written_at
    name = words.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
    last = roots.select("id", "root").join(name, "root").select("id", F.col("root_word").alias("root"))
    return out.join(last, "id", "left").select("word", "n", "n_near", "form", (-F.col("less")).alias("form_n"), F.coalesce("root", "word").alias("root"))
