"""Operators on small fixtures against brute force, round trips, and odd inputs: nulls, empty and long texts, ties, repeats, empty tables."""

import base64
import collections
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from framewright.llm import bpe, cells, common, consensus, decontam, linkrank, nbsvm, rindex, simhash, sstable, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id bigint, text string, node string, keys string"


def texts(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)


def odd(seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7)))
    base = [" ".join(word() for _ in range(rng.randint(80, 200))) for _ in range(6)]
    rows = [(i, base[i % 6]) for i in range(12)]
    for k in range(12, 24):
        w = base[k % 6].split()
        w[rng.randrange(len(w))] = "edited"
        rows.append((k, " ".join(w)))
    return rows + [(30, None), (31, ""), (32, "ab"), (None, base[0]), (33, "é ü " * 300), (33, "é ü " * 300), (34, "word " * 5000)]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20] + [(90, 90), (None, 3)], "a bigint, b bigint")
    got = {r.node: r.component for r in common.components(edges, "a", "b").collect()}
    assert got == {i: 0 if i <= 20 else 21 for i in range(41)}


def test_components_of_hubs_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST", 0)
    pairs = [(500, 300 + i) for i in range(400)] + [(10 + i % 3, 10 + i % 7) for i in range(40)] + [(-4, 699), (4, None)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(pairs, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {**{i: 10 for i in range(10, 17)}, **{i: -4 for i in [-4, *range(300, 700)]}}
    assert common.components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").isEmpty()


def own_fingerprint(text):
    """The fingerprint by its definition, bit by bit."""
    w = [x for x in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    h = [xxhash.xxh64(" ".join(w[i : i + 3]), 42).intdigest() for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash_matches_brute_force(spark, monkeypatch):
    rows = odd()
    fps = [(i, own_fingerprint(t)) for i, t in rows]
    for bucket in (64, 1):
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        got = simhash.near_duplicates(texts(spark, rows), words=3, max_distance=2).collect()
        group = list(range(len(fps)))
        for a in range(len(fps)):
            for b in range(a):
                if bin(fps[a][1] ^ fps[b][1]).count("1") <= 2:
                    group = [group[b] if g == group[a] else g for g in group]
        low = collections.defaultdict(list)
        for g, (i, _) in zip(group, fps):
            low[g].append(i)
        want = sorted((str(i), min(x for x in low[g] if x is not None)) for g, (i, _) in zip(group, fps))
        assert sorted((str(r.doc_id), r.component_id) for r in got) == want
    assert simhash.near_duplicates(texts(spark, [])).count() == 0


def test_near_duplicates_keep_one(spark):
    rng = random.Random(1)
    docs = [[f"w{rng.randrange(10**6)}" for _ in range(300)] for _ in range(5)]
    near = docs[0][:150] + ["changed"] + docs[0][151:]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)] + [(10, " ".join(near)), (11, " ".join(docs[1]))]
    kept = simhash.keep_one(texts(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4] and kept.columns == ["doc_id", "text", "node", "keys"]


def test_quality(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("etaoinsh") for _ in range(rng.randint(2, 8)))
    clean = [(i, " ".join(word() for _ in range(50)).capitalize() + ".") for i in range(300)]
    junk = [(1000 + i, " ".join(word() + "***" for _ in range(50))) for i in range(100)]
    labels = spark.createDataFrame([(i, 1) for i, _ in clean] + [(i, 0) for i, _ in junk] + [(None, 1), (5, None)], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in nbsvm.score(texts(spark, [*clean, *junk, (None, None), (7000, "")]), labels).collect()}
    right = [got[i].predicted == q for rows, q in ((clean, 1), (junk, 0)) for i, _ in rows if got[i].held_out]
    assert np.mean(right) > 0.95 and 0 <= got[7000].score <= 1 and not got[None].held_out
    assert got[3].held_out == (zlib.crc32(b"3") % 4 == 2)
    assert {r.score for r in nbsvm.score(texts(spark, [(1, "a")]), labels.where("false")).collect()} == {0.5}


def test_repeats_match_brute_force(spark, monkeypatch):
    rows = odd(3)
    raw = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(b[i : i + 400] for b in raw for i in range(len(b) - 399))
    want = []
    for b in raw:
        cover = np.zeros(len(b), bool)
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                cover[i : i + 400] = True
        want.append((len(b), bytes(np.frombuffer(b, np.uint8)[~cover])))
    for group in (256, 2):
        monkeypatch.setattr(rindex, "GROUP", group)
        got = rindex.remove_repeats(texts(spark, rows)).collect()
        assert sorted((r.n_bytes, bytes(r.kept)) for r in got) == sorted(want)
    assert rindex.remove_repeats(texts(spark, [])).count() == 0


def test_block_index_matches_brute_force():
    rng = random.Random(5)
    for _ in range(120):
        base = bytes(rng.choice(b"ab") for _ in range(rng.randint(30, 90)))
        contexts = sorted({base[rng.randint(0, 8) :] * rng.choice([1, 1, 2]) for _ in range(rng.randint(1, 6))})
        length = rng.randint(8, 30)
        seen = collections.Counter(c[i : i + length] for c in contexts for i in range(len(c) - length + 1))
        for c, (cover, _) in zip(contexts, rindex.marked(contexts, length)):
            want = np.zeros(len(c), bool)
            for i in range(len(c) - length + 1):
                if seen[c[i : i + length]] > 1:
                    want[i : i + length] = True
            assert (cover == want).all()


def test_vectors_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(30, 8)), 8, 0) + 0.05 * rng.normal(size=(240, 8))
    x[1] = x[0]
    label = rng.integers(0, 2, 240)
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))]
    bad = [(900, None, 0), (901, [0.0] * 8, 0), (902, [float("nan")] * 8, 0), (903, x[0].tolist(), None), (904, [], 0), (905, [None] * 8, 1)]
    monkeypatch.setattr(cells, "SPREAD", 1)
    monkeypatch.setattr(cells, "BLOCK", 16)
    got = {r.vec_id: r for r in cells.near_vectors(spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>, label int")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    low = np.arange(240)
    while (new := np.minimum(low, np.where(near, low, 10**6).min(1))).tolist() != low.tolist():
        low = new
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum(), low[i], low[i] == i) for i in range(240))
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i, *_ in bad)


def test_text_of_pages(spark):
    page = '<html><body><header>H</header><nav>n</nav><div class="main-{}"><h1>T</h1><p>One &amp; two<p>three <b>bo</b>ld<div class="comments"><p>no, no</p></div></div><div class="ad">buy</div><footer>x</footer>'
    rows = [(i, f"http://a.example/{i}", page.format(i)) for i in range(3)] + [(7, None, None), (8, "http://b.example/", "plain &lt; text"), (9, "http://a.example/", "")]
    got = {r.page_id: r.text for r in consensus.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {0: "T One & two three bold", 1: "T One & two three bold", 2: "T One & two three bold", 7: "", 8: "plain < text", 9: ""}


def test_bpe_round_trip(spark):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = odd(6) + [(50, "I'll   naïve\n\n 12,5 <|endoftext|> 日本語 🙂")]
    ranks = bpe.read_ranks(path)
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = bpe.decode(bpe.encode(texts(spark, rows), path, pattern), path, pattern).collect()
    want = sorted((np.array(own.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for _, t in rows)
    assert sorted((bytes(r.ids), bytes(r.decoded)) for r in got) == want
    assert base64 and bpe.encode(texts(spark, []), path, pattern).count() == 0


def test_decontamination(spark):
    item = "Tom has 3 apples and gives Anna 2 apples so how many apples does Tom hold after 5 km walk"
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (None, item)], "item_id bigint, text string")
    rows = [(1, "x. Well bob said Bill has 7 apples and gives Susan 4 apples so how many apples does Bill hold after 9 km walk"), (2, item.replace("apples", "pears").replace("many", "few")), (3, None), (4, ""), (4, ""), (None, item)]
    got = sorted((str(r.doc_id), r["items"]) for r in decontam.contaminated(texts(spark, rows), bench).collect())
    assert got == [("1", [1]), ("2", []), ("3", []), ("4", []), ("4", []), ("None", [1])]
    assert decontam.contaminated(texts(spark, rows), bench.where("false")).where(F.size("items") > 0).count() == 0


def test_hosts(spark):
    link = '<a href="http://{}/">x</a>'
    rows = [(1, "http://Good.example.net/de/1", link.format("near.org")), (2, "http://near.org/x", ""), (3, "http://bad.com/en/1", ""), (4, "http://farm.org/y", link.format("bad.com") * 3), (5, None, None), (6, "nothing", "x"), (7, "http://example.com/en/7?q", None), (8, "http://farm.org/y", "")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in linkrank.judge(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[1] == ("good.example.net", "/de/1", "net/de/", "allow") and got[2][3] == "allow" and got[3] == ("bad.com", "/en/1", "com/en/", "block")
    assert got[4][3] == "block" and got[8][3] == "block" and got[5] == ("", "", None, "allow") and got[6] == ("", "", None, "allow") and got[7][2:] == ("example.com/en/7", "allow")


def test_revisits(spark):
    rows = [(1, "response", "http://A.com:80/x/?b=1&utm_source=q&a=2#f", 10, "e1", {"ETag": "e1", "Content-Length": "9", "Date": "d1"}), (2, "revisit", "http://a.com/x?a=2&b=1", 20, "W/e1", {"date": "d2", "content-length": "0"}), (3, "revisit", "http://a.com/x?a=2&b=1", 900_000, "e2", {}), (4, "revisit", "http://c.com/", 20, None, None), (5, "revisit", None, 20, None, None), (6, "response", "http://a.com/x?a=2&b=1", 100_000, "e2", {})]
    df = spark.createDataFrame(rows, "record_id bigint, kind string, uri string, t bigint, etag string, headers map<string,string>").select("*", F.timestamp_seconds("t").alias("at"), F.lit(None).cast("string").alias("last_modified"), F.lit(None).cast("string").alias("digest"))
    got = {r.record_id: r for r in warc.resolve(df).collect()}
    assert got[2].response_id == 1 and got[2].headers == {"etag": "e1", "content-length": "9", "date": "d2"}
    assert got[3].response_id == 6 and got[4].status == got[5].status == "missing"


def test_shards(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own, rows = Tokenizer.from_file(path), odd(8)
    directory = sstable.new_directory(spark)
    manifest = sstable.write(texts(spark, rows), path, 2, directory)
    got = sorted(sstable.read(spark, directory, manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    want = sorted(np.array(own.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes() for _, t in rows)
    assert sorted(bytes(r.ids) for r in got) == want
    keys = spark.createDataFrame([(3,), (33,), (777,), (None,)], "doc_id bigint")
    assert sorted((str(r.doc_id), r.start) for r in sstable.lookup(keys, directory, manifest).collect()) == sorted((str(r.doc_id), r.start) for r in got if r.doc_id in (3, 33, None))
    empty = sstable.new_directory(spark)
    assert sstable.read(spark, empty, sstable.write(texts(spark, []), path, 2, empty)).count() == 0
