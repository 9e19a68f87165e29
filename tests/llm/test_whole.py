"""The pipeline against planted cases, and odd inputs of the coders and the ranks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framewright.llm import bpe, decontam, linkrank, rindex, simhash, sstable

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng, n):
    return [("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(4, 7)))) for _ in range(n)]


def test_pipeline_against_planted_cases(spark, tmp_path):
    rng = random.Random(21)
    clean = {i: " ".join(prose(rng, 120)).capitalize() + "." for i in range(1, 40)}
    passage, item = prose(rng, 52), " ".join(prose(rng, 16))
    assert len(" ".join(passage)) < 400
    rows = dict(clean)
    rows[50], rows[51] = clean[1], clean[2].replace(clean[2].split()[60], "edited")  # an exact and a near copy
    own = {k: (prose(rng, 60), prose(rng, 60)) for k in (60, 61, 62)}
    rows |= {k: " ".join([*a, *passage, *b]) for k, (a, b) in own.items()}
    rows[70] = " ".join([*prose(rng, 50), item, *prose(rng, 50)])
    junk = {100 + k: " ".join(w + "***" for w in prose(rng, 80)) for k in range(30)}
    sf = str(tmp_path)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in {**rows, **junk}.items()], DOCS)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100)) for i in {**rows, **junk}], "doc_id bigint, quality int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == set(clean) | set(own)
    for i, t in clean.items():
        assert got[i].decoded == t
    for k, (a, b) in own.items():
        assert got[k].decoded.split()[: len(a) - 1] == a[:-1] and got[k].decoded.split()[1 - len(b) :] == b[1:] and " ".join(passage[5:45]) not in got[k].decoded


def test_clashing_names(spark):
    rows = [(1, "a b c d e f " * 80, 1, 2, 3, 4), (1, "a b c d e f " * 80, 1, 2, 3, 4), (2, None, 5, 6, 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, k1 int, K2 int, spans int, items int")
    bench = spark.createDataFrame([(9, "a b c d e f a b")], "item_id bigint, text string")
    assert sorted(r.k1 for r in rindex.remove_repeats(docs).collect()) == [1, 1, 5]
    assert sorted((r.K2, r["items"]) for r in decontam.contaminated(docs, bench).collect()) == [(2, [9]), (2, [9]), (6, [])]
    assert sorted((r.k1, r.spans) for r in simhash.keep_one(docs).collect()) == [(1, 3), (5, 7)]


def test_sets_are_linked_as_by_brute_force():
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**62), 2**62, 60)
    sets = [np.unique(np.where(rng.random(60) < 0.1, rng.integers(-(2**62), 2**62, 60), base)) for _ in range(40)] + [rng.integers(0, 9, 1)]
    near = [[len(set(x) & set(y)) >= 0.8 * len(set(x) | set(y)) for y in sets] for x in map(list, sets)]
    low = np.arange(len(sets))
    for _ in sets:
        low = np.array([min(low[j] for j in range(len(sets)) if near[i][j]) for i in range(len(sets))])
    assert simhash.linked(sets, 0.8).tolist() == low.tolist()


def test_very_long_words(spark):
    tiktoken = pytest.importorskip("tiktoken")
    rng = random.Random(22)
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = [(1, "".join(rng.choice("abcdefghijk") for _ in range(100_000))), (2, " ".join("".join(rng.choice("abé") for _ in range(n)) for n in range(200, 300, 7))), (3, "a" * 3000 + " " + "ab" * 500)]
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    got = {r.doc_id: r for r in bpe.encode(spark.createDataFrame(rows, "doc_id bigint, text string"), path, pattern, decoded=True).collect()}
    for i, t in rows:
        assert np.frombuffer(got[i].ids, "<u4").tolist() == own.encode_ordinary(t) and bytes(got[i].decoded) == t.encode()


def test_word_ids_equal_the_library():
    from tokenizers import Tokenizer

    rng, path = random.Random(23), public_tokenizers.path("word_bpe_49k.json")
    own, coder = Tokenizer.from_file(path), sstable.WordCoder(open(path, encoding="utf-8").read())
    signs = "aBcİIıßé̸́̇ΣςÅÅ日本ﬁ.,;:!?*%#$&'=12  \n\x01"
    texts = ["İ*", "İ*. á! Å. Å, ΑΣ."] + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 12))) for _ in range(8000)]
    for t, ids in zip(texts, coder.encode(texts, 2)):
        assert ids.tolist() == own.encode(t, add_special_tokens=False).ids + [2], repr(t)


def test_shards_end_by_size(spark, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(sstable, "SHARD", 1)
    monkeypatch.setattr(sstable, "BLOCK", 16)
    docs = spark.createDataFrame([(i, f"word {i} again") for i in range(60)], "doc_id bigint, text string")
    directory = sstable.new_directory(spark)
    manifest = sstable.write(docs, path, 2, directory)
    got = sorted(sstable.read(spark, directory, manifest).collect(), key=lambda r: r.start)
    assert len(manifest) >= 30 and [r.doc_id for r in got] == list(range(60))
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()


def test_ranks_of_a_cycle_converge(spark):
    link = '<a href="http://{}/">x</a>'
    names = [f"h{i}.com" for i in range(30)]
    rows = [(i, f"http://{n}/p", link.format(names[(i + 1) % 30])) for i, n in enumerate(names)]
    rows += [(100, "http://seed.net/de/1", link.format("h0.com")), (101, "http://bad.org/es/1", ""), (102, "http://h29.com/q", link.format("bad.org"))]
    got = {r.host: (r.trust, r.distrust) for r in linkrank.host_ranks(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    hosts = [*names, "seed.net", "bad.org"]
    at = {h: k for k, h in enumerate(hosts)}
    w = np.zeros((32, 32))
    for i, n in enumerate(names):
        w[at[n], at[names[(i + 1) % 30]]] = 1
    w[at["seed.net"], 0] = w[at["h29.com"], at["bad.org"]] = 1
    along, back = w / np.maximum(1, w.sum(1, keepdims=True)), w / np.maximum(1, w.sum(0, keepdims=True))
    seed = lambda h: 0.15 * np.eye(32)[at[h]]
    trust = np.linalg.solve(np.eye(32) - 0.85 * along.T, seed("seed.net"))
    distrust = np.linalg.solve(np.eye(32) - 0.85 * back, seed("bad.org"))
    assert all(abs(got[h][0] - trust[k]) < 1e-8 and abs(got[h][1] - distrust[k]) < 1e-8 for h, k in at.items())
