"""WARC revisits: as-of join of not-modified records to the latest earlier full response of the same canonical URL.

Records are rows (record_id, kind 'response' or 'revisit', uri, at timestamp, etag, last_modified, digest, headers map<string,string>). The join
runs in two steps, so that one URL with very many captures is no single task: inside each ``SPAN`` of time of a URL
a window finds the latest earlier response; where there is none, the last response of the URL's earlier
spans, found over one row a span, stands in.

Validators: the revisit's etag (weak form ignored), else its last_modified, else its digest must equal the response's; a revisit
without any of them resolves by position alone. Merged headers are the response's, overwritten by those of the revisit that may be updated: not
those that describe the body (``BODY_HEADERS``). Header names are compared in lower case.

Defined results: a null uri or time never resolves (status missing); captures at the same time order by record_id; repeated
revisits each resolve; null headers are an empty map; other columns of the records are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 86_400
BODY_HEADERS = ("content-encoding", "content-length", "content-range", "content-type", "content-md5", "transfer-encoding", "connection", "keep-alive", "te", "trailer", "upgrade")
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


def canonical_url(uri: Column) -> Column:
    """Lower-case scheme and host, no default port, fragment, tracking parameters or trailing slash; parameters sorted."""
    whole = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
    part = lambda k: F.regexp_extract(uri, whole, k)
    host = F.regexp_replace(F.lower(part(2)), r":(80|443)$", "")
    path = F.regexp_replace(part(3), r"/+$", "")
    query = F.array_sort(F.filter(F.split(F.substring(part(4), 2, 1 << 30), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    tail = F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise("")
    return F.when(uri.rlike(whole), F.concat(F.lower(part(1)), F.lit("://"), host, path, tail)).otherwise(uri)


def resolve(records: DataFrame) -> DataFrame:
    """(record_id, canonical, response_id, status, headers) of each revisit; status is resolved, mismatch or missing."""
    entries = F.array_sort(F.transform(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["key"].alias("name"), e["value"].alias("value"))))
    single = F.filter(entries, lambda e, i: ~F.coalesce(F.get(entries, i + 1)["key"] == e["key"], F.lit(False)))  # of names that differ in case only, the last in order
    lowered = F.map_from_entries(F.transform(single, lambda e: F.struct(e["key"], e["value"])))
    r = records.select("record_id", "kind", canonical_url(F.col("uri")).alias("canonical"), F.unix_micros("at").alias("at"), "etag", "last_modified", "digest", lowered.alias("headers"))
    r = r.withColumn("span", F.floor(F.col("at") / (SPAN * 1_000_000)))
    full = F.when(F.col("kind") == "response", F.struct("record_id", "etag", "last_modified", "digest", "headers"))
    order = ["at", "record_id"]
    inside = Window.partitionBy("canonical", "span").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = r.withColumn("near", F.last(full, ignorenulls=True).over(inside)).where("kind = 'revisit'")
    spans = r.where("kind = 'response' and canonical is not null and at is not null").groupBy("canonical", "span").agg(F.max_by(full, F.struct(*order)).alias("last"))
    # the last response of the spans before: one row for each span that holds a response or a revisit
    asked = near.where("canonical is not null and at is not null").select("canonical", "span").unionByName(spans.select("canonical", "span")).distinct()
    earlier = Window.partitionBy("canonical").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    before = asked.join(spans, ["canonical", "span"], "left").withColumn("before", F.last("last", ignorenulls=True).over(earlier)).select("canonical", "span", "before")
    both = near.join(before, ["canonical", "span"], "left").withColumn("found", F.when(F.col("canonical").isNotNull() & F.col("at").isNotNull(), F.coalesce("near", "before")))
    strong = lambda c: F.regexp_replace(c, "^W/", "")
    agree = F.when(F.col("etag").isNotNull(), strong(F.col("etag")) == strong(F.col("found.etag"))).when(F.col("last_modified").isNotNull(), F.col("last_modified") == F.col("found.last_modified")).when(F.col("digest").isNotNull(), F.col("digest") == F.col("found.digest")).otherwise(F.lit(True))
    status = F.when(F.col("found").isNull(), "missing").when(F.coalesce(agree, F.lit(False)), "resolved").otherwise("mismatch")
    update = F.map_filter("headers", lambda k, v: ~k.isin(*BODY_HEADERS))
    stay = F.map_filter("found.headers", lambda k, v: ~F.map_contains_key(update, k))
    ok = F.col("status") == "resolved"
    return both.withColumn("status", status).select("record_id", "canonical", F.when(ok, F.col("found.record_id")).alias("response_id"), "status", F.when(ok, F.map_concat(stay, update)).otherwise(F.col("headers")).alias("headers"))


def crawl(pages: DataFrame, wait: int = 7 * 86_400) -> DataFrame:
    """Records of a crawl of ``pages``: each page answers in full a minute after the one before, and ``wait`` seconds later as not modified."""
    full = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.length("html").cast("string"), F.lit("ETag"), F.md5("html"), F.lit("Date"), (F.col("page_id") * 60).cast("string"))
    short = F.create_map(F.lit("Content-Length"), F.lit("0"), F.lit("ETag"), F.md5("html"), F.lit("Date"), (F.col("page_id") * 60 + wait).cast("string"), F.lit("Server"), F.lit("cache"))
    row = lambda kind, shift, headers: F.struct(F.lit(kind).alias("kind"), F.timestamp_seconds(F.col("page_id") * 60 + shift).alias("at"), headers.alias("headers"))
    both = pages.select("page_id", "url", F.md5("html").alias("etag"), F.explode(F.array(row("response", 0, full), row("revisit", wait, short))).alias("x"))
    none = F.lit(None).cast("string")
    return both.select(F.col("page_id").cast("bigint").alias("record_id"), "x.kind", F.col("url").alias("uri"), "x.at", "etag", none.alias("last_modified"), none.alias("digest"), "x.headers")


ORACLE = r"""
with cut as (
  select page_id, url, html, regexp_extract(url, '(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$', ['s', 'h', 'p', 'q', 'f']) as u,
    regexp_matches(url, '(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$') as ok from pages),
asked as (select *, list_sort(list_filter(string_split(substr(u.q, 2), '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) as query from cut),
c as materialized (select page_id, html, md5(html) as etag, case when ok then lower(u.s) || '://' || regexp_replace(lower(u.h), ':(80|443)$', '') || regexp_replace(u.p, '/+$', '')
    || case when len(query) > 0 then '?' || array_to_string(query, '&') else '' end else url end as canonical from asked),
r as (select canonical, page_id * 60 + 604800 as t, page_id, etag from c),
f as (select canonical, page_id * 60 as t, page_id as response_id, etag as found, length(html) as n from c where canonical is not null),
j as (select r.*, f.response_id, f.n, f.response_id is not null and (r.etag is null or coalesce(r.etag = f.found, false)) as agrees
  from r asof left join f on r.canonical = f.canonical and r.t > f.t)
select page_id, canonical, case when agrees then response_id end as response_id,
  case when response_id is null then 'missing' when agrees then 'resolved' else 'mismatch' end as status,
  case when agrees then coalesce('content-length=' || n || ';', '') || 'content-type=text/html;' else 'content-length=0;' end
    || coalesce('date=' || t || ';', '') || coalesce('etag=' || etag || ';', '') || 'server=cache' as headers
from j
"""
