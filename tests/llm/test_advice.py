"""Cases where an operator once did less than its whole job."""

import random

import pytest

from framewright.llm import decontam, nbsvm, simhash

DOCS = "doc_id bigint, text string"


def shingle_set(text, words=5):
    w = text.lower().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}


def groups(rows, similarity=0.8):
    """The smallest doc_id of each document's group, by comparing all pairs."""
    sets, low = [(i, shingle_set(t)) for i, t in rows], {i: i for i, _ in rows}
    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if low[i] != low[j] and len(x & y) >= similarity * len(x | y):
                a, b = sorted((low[i], low[j]))
                low = {n: a if g == b else g for n, g in low.items()}
    return low


def fresh(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def found(spark, rows):
    return {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}


def test_pairs_near_the_similarity(spark):
    rng, rows = random.Random(11), []
    while len(rows) < 240:
        a = fresh(rng, 300)
        b = list(a)
        for at in rng.sample(range(300), rng.randint(5, 9)):
            b[at] = "edited"
        x, y = shingle_set(" ".join(a)), shingle_set(" ".join(b))
        if 0.76 <= len(x & y) / len(x | y) <= 0.85:
            rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
    want = groups(rows)
    assert 30 < sum(want[i] != i for i in want) < 115
    assert found(spark, rows) == want


def held(spark, rows, items):
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    return {r.doc_id: r["items"] for r in decontam.contaminated(spark.createDataFrame(rows, DOCS), bench).collect()}


def test_names_that_begin_a_sentence(spark):
    item = "Natalia sold 48 clips to her friends in April. Natalia then sold half as many clips in May. How many clips did Natalia sell in all?"
    other = "Then we met Tom at the old mill. Then we saw the long grey road with Tom and went home."
    robert = item.replace("Natalia", "Robert").replace("48", "62")
    rows = [(1, robert), (2, "So here is one. " + robert + " No answer."), (3, robert.replace("did Robert", "did Susan")), (4, other.replace("Then we met", "Now we met")), (5, other.replace("Tom", "Bill")), (6, "Robert went to the sea in May. Nobody sold clips.")]
    got = held(spark, rows, [(1, item), (2, other)])
    assert got == {1: [1], 2: [1], 3: [], 4: [2], 5: [2], 6: []}


def test_items_without_telling_windows(spark):
    items = [(1, "What is 12 + 34?"), (2, "Add 3 and Bob"), (3, "1 2 3 4 5 6 7 8 Anna 9 10"), (4, "the first text of this item has these words"), (4, "a second wording that shares nothing with it at all"), (5, " ... "), (6, None)]
    rows = [(1, "He asked: what is 12 + 34? Nobody knew."), (2, "what is 12 + 35?"), (3, "Please add 3 and bob, then rest"), (4, "so 1 2 3 4 5 6 7 8 anna 9 10 it is"), (5, "1 2 3 4 5 6 7 8 anna 9 11"), (6, "x the first text of this item has these words y"), (7, "x a second wording that shares nothing with it at all y"), (8, None)]
    assert held(spark, rows, items) == {1: [1], 2: [], 3: [2], 4: [3], 5: [], 6: [4], 7: [4], 8: []}


def crowded():
    """Families of texts that share a passage of two thirds: their blocks hold many groups."""
    rng = random.Random(12)
    passage, rows = fresh(rng, 220), []
    for _ in range(60):
        own = fresh(rng, 100)
        for _ in range(3):
            w = passage + own
            w[rng.randrange(220, 320)] = fresh(rng, 1)[0]
            w[rng.randrange(220, 320)] = fresh(rng, 1)[0]
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("bucket", [64, 8])
def test_large_blocks_of_many_groups(spark, monkeypatch, bucket):
    rows = crowded()
    want = groups(rows)
    assert len(set(want.values())) == 60
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    assert found(spark, rows) == want


def test_quality_that_depends_on_vocabulary(spark):
    rng = random.Random(13)
    good, bad = ([f"{k}word{i:02d}" for i in range(40)] for k in ("fine", "spam"))
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad) for _ in range(40)).translate(str.maketrans("0123456789", "abcdefghij"))) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id bigint, quality int")
    got = [r for r in nbsvm.score(spark.createDataFrame(rows, DOCS), labels).collect() if r.held_out]
    assert len(got) > 50 and all(r.predicted == r.doc_id % 2 for r in got)
