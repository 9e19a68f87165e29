"""Queries over catalog-like tables: bindings, validation, deltas, counts, parsing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framewright.functions import text as T
from framewright.plans.fixtures import table
from framewright.plans.registry import query


@query("task_bind", "select o_orderkey as task, c_custkey as source, n_nationkey as pipeline from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey")
def task_bind(spark, sf):
    """Tasks bound to their source and pipeline."""
    t = table(spark, sf, "orders").select(F.col("o_orderkey").alias("task"), F.col("o_custkey").alias("source"))
    s = table(spark, sf, "customer").select(F.col("c_custkey").alias("source"), F.col("c_nationkey").alias("pipeline"))
    p = table(spark, sf, "nation").select(F.col("n_nationkey").alias("pipeline"))
    return t.join(s, "source").join(p, "pipeline").select("task", "source", "pipeline")


@query("task_bind_errors", "select o_orderkey as task from orders where o_custkey % 10 = 0 or not exists (select 1 from customer where c_custkey = o_custkey and c_custkey % 10 <> 0)")
def task_bind_errors(spark, sf):
    """Tasks whose source is missing."""
    s = table(spark, sf, "customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").join(s, "o_custkey", "left_anti").select(F.col("o_orderkey").alias("task"))


@query("model_ref_check", "select distinct l_partkey as model_id from lineitem where l_partkey not in (select p_partkey from part where p_partkey % 7 <> 0)")
def model_ref_check(spark, sf):
    """Cascade references to unknown models."""
    known = table(spark, sf, "part").where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("model_id"))
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("model_id")).join(known, "model_id", "left_anti").distinct()


@query("in_use_check", "select c_custkey as source from customer where c_custkey in (select o_custkey from orders)")
def in_use_check(spark, sf):
    used = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(used, "c_custkey", "left_semi").select(F.col("c_custkey").alias("source"))


@query("repo_loaded", "select p_partkey as model, exists (select 1 from lineitem where l_partkey = p_partkey) as loaded from part")
def repo_loaded(spark, sf):
    loaded = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("there", F.lit(True))
    return table(spark, sf, "part").join(loaded, "p_partkey", "left").select(F.col("p_partkey").alias("model"), F.col("there").isNotNull().alias("loaded"))


@query("health_join", "with h as (select user_id, arg_max(event_type, event_id) as state from events group by 1) select c_custkey as source, coalesce(state, 'STOPPED') as state from customer left join h on user_id = c_custkey")
def health_join(spark, sf):
    """Sources with their latest state; unseen ones are stopped."""
    h = table(spark, sf, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max_by("event_type", "event_id").alias("state"))
    return table(spark, sf, "customer").select("c_custkey").join(h, "c_custkey", "left").select(F.col("c_custkey").alias("source"), F.coalesce("state", F.lit("STOPPED")).alias("state"))


@query(
    "device_affinity",
    """with w(worker, device, state) as (values (0, 0, 'RUNNING'), (1, 1, 'RECOVERING'), (2, 2, 'RUNNING')), b as (select s_suppkey as batch, cast(s_nationkey % 4 as int) as device from supplier),
r as (select batch, worker, row_number() over (partition by batch order by case when w.state = 'RUNNING' and w.device = b.device then 0 when w.state = 'RUNNING' then 1 else 2 end, worker) as r from b, w) select batch, worker from r where r = 1""",
)
def device_affinity(spark, sf):
    """A running worker of the batch's device, else any running one, else a recovering one; the workers are a few configured rows."""
    workers = F.array(*[F.struct(F.lit(i).alias("worker"), F.lit(d).alias("device"), F.lit(s).alias("state")) for i, d, s in ((0, 0, "RUNNING"), (1, 1, "RECOVERING"), (2, 2, "RUNNING"))])
    rank = lambda w: F.struct(F.when((w["state"] == "RUNNING") & (w["device"] == F.col("device")), 0).when(w["state"] == "RUNNING", 1).otherwise(2).alias("rank"), w["worker"].alias("worker"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("batch"), (F.col("s_nationkey") % 4).cast("int").alias("device"))
    return b.select("batch", F.array_min(F.transform(workers, rank))["worker"].alias("worker"))


@query("least_loaded", "with c as (select n_regionkey as grp, n_nationkey as device, (select count(*) from supplier where s_nationkey = n_nationkey) as streams from nation) select grp, arg_min(device, streams * 1000 + device) as device from c group by 1")
def least_loaded(spark, sf):
    """Device of fewest streams, the first one on ties."""
    n = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("streams"))
    c = table(spark, sf, "nation").join(n, "n_nationkey", "left")
    return c.groupBy(F.col("n_regionkey").alias("grp")).agg(F.min_by("n_nationkey", F.struct(F.coalesce("streams", F.lit(0)), "n_nationkey")).alias("device"))


@query("max_version", "select s_nationkey as model, coalesce(max(case when s_suppkey % 17 = 0 then s_suppkey end), max(s_suppkey)) as version from supplier group by 1")
def max_version(spark, sf):
    """The active version if one is named, else the largest."""
    active = F.max(F.when(F.col("s_suppkey") % 17 == 0, F.col("s_suppkey")))
    return table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("model")).agg(F.coalesce(active, F.max("s_suppkey")).alias("version"))


@query("worker_totals", "select l_suppkey % 4 as worker, count(*) as processed, count(*) filter (l_linenumber = 1) as dropped from lineitem group by 1")
def worker_totals(spark, sf):
    return table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 4).alias("worker")).agg(F.count("*").alias("processed"), F.count_if(F.col("l_linenumber") == 1).alias("dropped"))


@query("dashboard_counts", "select count(*) filter (c_nationkey < 10) as streaming, count(*) filter (c_nationkey between 10 and 14) as degraded, (select count(*) from orders where o_orderkey % 2 = 0) as running, sum(c_nationkey % 5) as nodes from customer")
def dashboard_counts(spark, sf):
    c = table(spark, sf, "customer").agg(F.count_if(F.col("c_nationkey") < 10).alias("streaming"), F.count_if(F.col("c_nationkey").between(10, 14)).alias("degraded"), F.sum(F.col("c_nationkey") % 5).alias("nodes"))
    o = table(spark, sf, "orders").agg(F.count_if(F.col("o_orderkey") % 2 == 0).alias("running"))
    return c.join(F.broadcast(o), F.lit(True)).select("streaming", "degraded", "running", "nodes")


@query("distinct_devices", "select distinct unnest(case when s_suppkey % 3 = 0 then [s_nationkey] else [s_nationkey, s_nationkey % 4] end) as device from supplier")
def distinct_devices(spark, sf):
    devices = F.when(F.col("s_suppkey") % 3 == 0, F.array("s_nationkey")).otherwise(F.array(F.col("s_nationkey"), F.col("s_nationkey") % 4))
    return table(spark, sf, "supplier").select(F.explode(devices).alias("device")).distinct()


@query("indegree", "select l_suppkey as node, count(distinct l_partkey) as indegree from lineitem group by 1")
def indegree(spark, sf):
    return table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct().groupBy(F.col("l_suppkey").alias("node")).agg(F.count("*").alias("indegree"))


@query("max_batch_slot", "select p_partkey as id, list_min(list_filter([1, 2, 4, 8, 16, 32], lambda b: b >= p_partkey % 40)) as slot from part")
def max_batch_slot(spark, sf):
    """Smallest compiled batch that holds the request; null where none does."""
    slots = F.array(*[F.lit(b) for b in (1, 2, 4, 8, 16, 32)])
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_min(F.filter(slots, lambda b: b >= F.col("p_partkey") % 40)).alias("slot"))


@query("preferred_batches", "select p_partkey as id, p_partkey % 20 >= list_min([8, 4, 16]) as flush from part")
def preferred_batches(spark, sf):
    """A batch is handed on as soon as it reaches any preferred size, so the smallest decides."""
    sizes = F.sort_array(F.array(F.lit(8), F.lit(4), F.lit(16)), asc=False)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.exists(sizes, lambda b: F.col("p_partkey") % 20 >= b).alias("flush"))


@query("sort_models", "select n_name, cast(row_number() over (order by n_name) as int) as pos from nation")
def sort_models(spark, sf):
    """Repository listing by id; the position is worked out over the few repository rows."""
    return table(spark, sf, "nation").select("n_name", F.row_number().over(Window.orderBy("n_name")).alias("pos"))


@query("limit8", "select n_nationkey as source, (select count(*) from nation) - 8 as more from nation order by n_nationkey limit 8")
def limit8(spark, sf):
    n = table(spark, sf, "nation")
    return n.orderBy("n_nationkey").limit(8).join(F.broadcast(n.agg((F.count("*") - 8).alias("more"))), F.lit(True)).select(F.col("n_nationkey").alias("source"), "more")


@query("top1", "select doc_id, coalesce(string_split(text, ' ')[1], '') as first from documents")
def top1(spark, sf):
    """First entry of a list, else empty."""
    return table(spark, sf, "documents").select("doc_id", F.coalesce(F.get(F.split("text", " ", 2), F.lit(0)), F.lit("")).alias("first"))


@query("apply_delta", "with base as (select c_custkey as id, 'yaml' as origin from customer), removed as (select c_custkey as id from customer where c_custkey % 5 = 0), added as (select o_custkey + 1000 as id, 'added' as origin from orders where o_orderkey % 100 = 0) select id, origin from base where id not in (select id from removed) union all select distinct id, origin from added where id not in (select id from base where id not in (select id from removed))")
def apply_delta(spark, sf):
    """Base without what was removed, and what was added unless it exists."""
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("yaml").alias("origin"))
    kept = base.join(base.where("id % 5 = 0").select("id"), "id", "left_anti")
    added = table(spark, sf, "orders").where("o_orderkey % 100 = 0").select((F.col("o_custkey") + 1000).alias("id"), F.lit("added").alias("origin")).distinct()
    return kept.unionByName(added.join(kept.select("id"), "id", "left_anti"))


@query("merge_models", "select p_partkey as id from part where p_partkey % 2 = 0 union select s_suppkey as id from supplier")
def merge_models(spark, sf):
    a, b = table(spark, sf, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id")), table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    return a.union(b).distinct()


@query("merge_conflicts", "select p_partkey as id from part where p_partkey % 2 = 0 intersect select s_suppkey from supplier")
def merge_conflicts(spark, sf):
    a, b = table(spark, sf, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id")), table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    return a.intersect(b)


@query("dup_ids", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1")
def dup_ids(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("safe_ids", "select p_partkey as id, regexp_matches(p_name, '^[A-Za-z0-9_-]+$') as safe from part")
def safe_ids(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").rlike(T.SAFE).alias("safe"))


@query("task_placeholder", "select o_orderkey as id, case when o_orderkey % 5 = 0 then null else 'rtsp://host/' || o_custkey || '/' || o_orderkey end as url from orders")
def task_placeholder(spark, sf):
    """Filled templates; unknown placeholders give null."""
    template = F.when(F.col("o_orderkey") % 5 == 0, "rtsp://host/{camera}").otherwise("rtsp://host/{source_id}/{task_id}")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), T.placeholders(template, F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")).alias("url"))


@query("output_url_errors", """select o_orderkey as id, case o_orderkey % 5 when 0 then 'unsupported placeholder {camera}' when 1 then 'unterminated placeholder' when 2 then 'unsupported placeholder {' || o_orderstatus || '}' end as error,
 case o_orderkey % 5 when 3 then o_custkey || '/' || o_orderkey || '/' || o_custkey when 4 then 'rtmp://host/' || o_orderstatus end as url from orders""")
def output_url_errors(spark, sf):
    """Addresses of outgoing streams with the reason of each that cannot be filled in."""
    at = F.col("o_orderkey") % 5
    forms = ["rtmp://{source_id}/{camera}", "rtmp://{source_id}/{task_id", F.concat(F.lit("rtmp://{task_id}/{"), "o_orderstatus", F.lit("}{")), "{source_id}/{task_id}/{source_id}", F.concat(F.lit("rtmp://host/"), "o_orderstatus")]
    template = F.coalesce(*[F.when(at == k, f) for k, f in enumerate(forms)])
    url = T.placeholders(template, F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), T.placeholder_error(template).alias("error"), url.alias("url"))


@query("rtsp_transport", "select page_id, case when contains(url, '?') then url || '&rtsp_transport=tcp' else url || '?rtsp_transport=tcp' end as url from pages")
def rtsp_transport(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.with_transport(F.col("url")).alias("url"))


@query("comma_list", "select conv_id, turn, len(list_filter(string_split(replace(text, ' ', ''), ','), lambda x: x <> '')) as n from conversations")
def comma_list(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(T.comma_list(F.col("text"))).cast("bigint").alias("n"))


@query("shell_quote", "select doc_id, md5('''' || replace(text, '''', '''\\''''') || '''') as quoted, regexp_matches(text, '[\\x00-\\x1f\\x7f]') as control from documents")
def shell_quote(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.shell_quote(F.col("text"))).alias("quoted"), T.has_control(F.col("text")).alias("control"))


@query("bool_parse", "select event_id, case event_id % 6 when 0 then true when 1 then true when 2 then false when 3 then false end as flag from events")
def bool_parse(spark, sf):
    text = F.element_at(F.array(*[F.lit(x) for x in ("yes", "on", "0", "false", "FALSE", " on ")]), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", T.boolean_of(text).alias("flag"))


@query("enum_parse", "select event_id, ['v8', 'v5', 'v11', 'v26', null, null][event_id % 6 + 1] as version, ['cuda', 'cuda', 'ascend', 'mps', null, null][event_id % 6 + 1] as backend from events")
def enum_parse(spark, sf):
    pick = lambda *x: F.element_at(F.array(*[F.lit(v) for v in x]), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", T.enum_of(pick("yolov8", "v5", "yolo11", "v26", "yolov11", "V8"), T.VERSIONS).alias("version"), T.enum_of(pick("trt", "tensorrt", "acl", "metal", "tpu", "CUDA"), T.BACKENDS).alias("backend"))


@query("number_parse", "select event_id, case event_id % 4 when 0 then event_id when 1 then -7 end::int as i, case event_id % 4 when 0 then event_id + 0.5 when 1 then -7 when 3 then 0.25 end::float as x from events")
def number_parse(spark, sf):
    """Numbers that texts begin with; null where the text has none."""
    n = F.col("event_id") % 4
    text = F.when(n == 0, F.concat(F.lit(" "), F.col("event_id").cast("string"), F.lit(".5px"))).when(n == 1, "-7").when(n == 2, "x1").otherwise(".25")
    return table(spark, sf, "events").select("event_id", T.integer_of(text).alias("i"), T.float_of(text).alias("x"))


@query("reconnect_backoff", "select event_id, greatest(3000.0, least(3000 * power(2, least(event_id % 10, 6)), 60000) * (1 + ((event_id % 21) - 10) / 10.0 * 0.1)) as wait_ms from events")
def reconnect_backoff(spark, sf):
    """Waits with a jitter taken from the row, so that they repeat."""
    return table(spark, sf, "events").select("event_id", T.backoff(F.lit(3000), F.lit(60000), F.col("event_id") % 10, (F.col("event_id") % 21 - 10) / 10).alias("wait_ms"))


@query("sink_backoff", "select event_id, cast(least(500 * power(2, event_id % 8), 10000) as bigint) as wait_ms from events")
def sink_backoff(spark, sf):
    return table(spark, sf, "events").select("event_id", T.sink_backoff(F.lit(500), F.lit(10000), F.col("event_id") % 8).alias("wait_ms"))


@query("stop_reconnect", "select event_id, case when event_id % 3 = 0 then false else event_id % 9 >= 5 end as stop from events")
def stop_reconnect(spark, sf):
    most = F.when(F.col("event_id") % 3 == 0, 0).otherwise(5)
    return table(spark, sf, "events").select("event_id", T.stop_reconnecting(F.col("event_id") % 9, most).alias("stop"))


@query("fault_type", "select event_id, case when event_id % 250 = 2 then 'oom' when event_id % 250 in (101, 201) then 'context_lost' else 'engine_fault' end as fault from events")
def fault_type(spark, sf):
    return table(spark, sf, "events").select("event_id", T.fault_of(F.col("event_id") % 250).alias("fault"))


@query("dynamic_shape", "select s_suppkey as id, s_nationkey % 3 = 0 as dynamic from supplier")
def dynamic_shape(spark, sf):
    dims = F.array(F.lit(1), F.lit(3), F.when(F.col("s_nationkey") % 3 == 0, -1).otherwise(640))
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.exists(dims, lambda d: d < 0).alias("dynamic"))


@query("attribute_upsert", "select event_id, case when event_id % 2 = 0 then 'new' else 'old' end as color from events")
def attribute_upsert(spark, sf):
    """Attributes with the last write kept."""
    old = F.create_map(F.lit("color"), F.lit("old"))
    new = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("color"), F.lit("new"))).otherwise(F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)
    return table(spark, sf, "events").select("event_id", merged["color"].alias("color"))


@query("command_parse", "select event_id, cast(json_extract(props, '$.k') as bigint) as k, 5 as sample_fps from events")
def command_parse(spark, sf):
    """A JSON request with its defaults."""
    req = F.from_json("props", "k bigint, sample_fps int")
    return table(spark, sf, "events").select("event_id", req["k"].alias("k"), F.coalesce(req["sample_fps"], F.lit(5)).alias("sample_fps"))


@query("batch_file_scan", "select p_partkey as id, case when p_partkey % 4 = 0 then null else p_partkey % 64 end as batch from part")
def batch_file_scan(spark, sf):
    """Batch numbers in weight file names."""
    name = F.when(F.col("p_partkey") % 4 == 0, "weights.onnx").otherwise(F.concat(F.lit("model_b"), (F.col("p_partkey") % 64).cast("string"), F.lit(".om")))
    found = F.regexp_extract(name, r"model_b(\d+)\.om$", 1)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(found != "", found.cast("bigint")).alias("batch"))
