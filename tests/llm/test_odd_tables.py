"""Empty tables, nulls in any column, repeated rows and clashing names: each operator's stated results."""

import collections

import duckdb
import pytest

from framewright.llm import consensus, decontam, linkrank, nbsvm, warc
from framewright.llm.queries import ORACLE_SQL, QUERIES

PAGES = "page_id bigint, url string, html string, host string, rule string, path string, kind string"
ROWS = [
    (1, "http://a.com/en/x", '<p>one <a href="http://b.org/es/">b</a></p>'),
    (1, "http://a.com/en/x", '<p>one <a href="http://b.org/es/">b</a></p>'),
    (2, "HTTP://Sub.Example.NET/de/8", None),
    (3, None, "<p>two</p>"),
    (3, None, "<p>two</p>"),
    (4, "", ""),
    (5, "no address", "<p>three</p>"),
    (7, "http://sub.example.net:80/de/8", "<p>later</p>"),
    (8, "http://sub.example.net/de/8", None),
    (None, "http://c.com/", "<p>four</p>"),
    (6, "http://c.com/", '<p>' + "word " * 50_000 + '<a href="http://a.com/en/">a</a></p>'),
]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "h", "r", "p", "k") for r in rows], PAGES)


@pytest.mark.parametrize("name", ["op2_hosts", "op4_revisits"])
def test_odd_pages_as_the_sql(spark, tmp_path, name):
    # captures of the same page at the same time are told apart by nothing, so op4's pages are here once
    rows = ROWS if name == "op2_hosts" else list(dict.fromkeys(ROWS))
    pages(spark, rows).select("page_id", "url", "html").write.parquet(str(tmp_path / "pages.parquet"))
    df = QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    found = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    want = [dict(zip(names, r)) for r in found.fetchall()]
    got = [r.asDict() for r in df.collect()]
    keyed = lambda rows: collections.Counter(tuple(r[c] for c in sorted(df.columns)) for r in rows)
    assert keyed(got) == keyed(want) and len(got) == len(rows)


def test_hosts_of_clashing_names_and_no_pages(spark):
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in linkrank.judge(pages(spark)).collect() if r.page_id in (1, 2, 3))
    assert got[0] == got[1] == (1, "a.com", "/en/x", "com/en/", "block")
    assert {g[1:3] for g in got if g[0] == 3} == {("", "")} and len(got) == 5
    assert linkrank.judge(pages(spark, [])).collect() == []


def test_revisits_of_validators_ties_and_no_records(spark):
    schema = "record_id bigint, kind string, uri string, at timestamp, etag string, last_modified string, digest string, headers map<string,string>, span string, canonical string"
    import datetime

    day = lambda d: datetime.datetime(2024, 1, d)
    u = "http://a.com/"
    rows = [
        (1, "response", u, day(1), "e", "m", "d", None),
        (2, "response", u, day(1), "f", "m", "d", {"A": "1"}),  # the same time: the larger record_id is later
        (3, "revisit", u, day(2), "W/f", "other", "other", None),
        (4, "revisit", u, day(2), None, "m", "other", None),
        (5, "revisit", u, day(2), None, None, "x", None),
        (6, "revisit", u, day(2), None, None, None, {"B": "2"}),
        (6, "revisit", u, day(2), None, None, None, {"B": "2"}),
        (7, "revisit", None, day(2), "f", None, None, None),
        (8, "revisit", u, None, "f", None, None, None),
    ]
    got = collections.Counter((r.record_id, r.response_id, r.status, tuple(sorted(r.headers.items()))) for r in warc.resolve(spark.createDataFrame([(*r, "s", "c") for r in rows], schema)).collect())
    assert got == {
        (3, 2, "resolved", (("a", "1"),)): 1, (4, 2, "resolved", (("a", "1"),)): 1, (5, None, "mismatch", ()): 1,
        (6, 2, "resolved", (("a", "1"), ("b", "2"))): 2, (7, None, "missing", ()): 1, (8, None, "missing", ()): 1,
    }
    assert warc.resolve(spark.createDataFrame([], schema)).collect() == []


def test_texts_of_odd_pages(spark):
    got = collections.Counter((r.page_id, len(r.text)) for r in consensus.extract(pages(spark)).collect())
    assert got == {(1, 5): 2, (2, 0): 1, (3, 3): 2, (4, 0): 1, (5, 5): 1, (6, 250_001): 1, (7, 5): 1, (8, 0): 1, (None, 4): 1}
    assert consensus.extract(pages(spark, [])).collect() == []


def test_scores_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "one two", 7), (1, "one two", 7), (2, None, 7), (None, "", 7)], "doc_id bigint, text string, score int")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    got = nbsvm.score(docs, labels).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert nbsvm.score(docs.limit(0), labels).collect() == []
    assert nbsvm.keep(docs, labels).count() == 4
    both = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    assert collections.Counter(r.doc_id for r in nbsvm.keep(docs, both).collect())[1] in (0, 2)
    assert nbsvm.keep(docs.limit(0), both).columns == docs.columns


def test_items_of_odd_documents(spark):
    item = "what is the capital city of the largest country in the world"
    docs = spark.createDataFrame([(1, "so " + item + " then", 5, "h"), (1, "so " + item + " then", 5, "h"), (None, item, 5, "h"), (2, None, 5, "h"), (3, "", 5, "h"), (4, "word " * 30_000 + item, 5, "h")], "doc_id bigint, text string, pos int, items string")
    bench = spark.createDataFrame([(9, item), (9, item), (None, item), (8, None), (7, "")], "item_id bigint, text string")
    got = collections.Counter((r.doc_id, tuple(r["items"])) for r in decontam.contaminated(docs, bench).collect())
    assert got == {(1, (9,)): 2, (None, (9,)): 1, (2, ()): 1, (3, ()): 1, (4, (9,)): 1}
    assert {tuple(r["items"]) for r in decontam.contaminated(docs, bench.limit(0)).collect()} == {()}
    assert decontam.contaminated(docs.limit(0), bench).collect() == []
