"""Pages that take long to scan, header names that differ in case, distances that the exact mode does not have."""

import time

import pytest
from pyspark.sql import functions as F

from framewright.llm import bpe, consensus, decontam, simhash, warc


@pytest.mark.parametrize("unit", ["<a", "<a ", "<a '", '<a "', "<a x=\"'", "<div>", "<p>", "</b>", "<!-", "<b></i>", "<a<", "< a"])
def test_broken_pages_take_linear_time(unit):
    began = time.process_time()
    consensus.blocks("<article><p>text</p>" + unit * (1_000_000 // len(unit)))
    consensus.blocks("<article><p>text</p>" + unit * (1_000_000 // len(unit)) + "'\">")
    assert time.process_time() - began < 8


def test_broken_tags_are_no_text():
    text = lambda html: " ".join(t for _, t, _ in consensus.blocks(html))
    assert text("<p>one</p><p>two <a href='x'>link</a> three<div class=") == "one two link three"
    assert text("<p>1 < 2 and 3 > 2</p>") == "1 < 2 and 3 > 2"
    assert text("<p title='a > b'>kept</p>") == "kept"


def test_header_names_that_differ_in_case(spark):
    """The name that is last in order of its code points stands."""
    rows = [("a", "response", "http://h/x", 0, None, None, None, {"Server": "one", "server": "two", "X": "1"}), ("b", "revisit", "http://h/x", 9, None, None, None, {"DATE": "d", "Date": "e"})]
    r = spark.createDataFrame(rows, "record_id string, kind string, uri string, s bigint, etag string, last_modified string, digest string, headers map<string, string>")
    got = warc.resolve(r.withColumn("at", F.timestamp_seconds("s"))).first()
    assert (got.status, dict(got.headers)) == ("resolved", {"server": "two", "x": "1", "date": "e"})


def test_other_distances_are_refused(spark):
    nodes = spark.createDataFrame([(1, [0]), (2, [1])], "node bigint, fp array<bigint>")
    for d in (0, 1, 3):
        with pytest.raises(ValueError):
            simhash.links(nodes, d)


def test_few_met_texts_are_found_by_broadcast(spark):
    """The texts that met no item are not shuffled (FINDINGS_r03, op9_decontam)."""
    docs = spark.createDataFrame([(1, 2, "one two three four five"), (3, 4, "six")], "k1 bigint, k2 bigint, text string")
    at = spark.createDataFrame([(1, 2, 0, 3)], "k1 bigint, k2 bigint, pos int, readings int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = decontam.slots(at, docs, "k1", "k2", few=True)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert any("BroadcastHashJoin" in x and "LeftSemi" in x for x in plan.splitlines())
        assert [(r.k1, r.width, r.slots) for r in out.collect()] == [(1, 5, ["<num>one", "<num>two", "<num>three", "<num>four", "<num>five"])]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_texts_are_tokenised_in_small_groups():
    """Batches of 600,000 bytes are taken to DuckDB one by one (FINDINGS_r03, pipeline)."""
    assert [len(g) for g in bpe._grouped([600_000] * 3, lambda n: n)] == [1, 1, 1]
