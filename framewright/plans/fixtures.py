"""Frames, detections and tensors derived from the driver's tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAMES = """select 'cam_' || lpad(cast(user_id % 16 as string), 2, '0') as stream_id,
  cast(row_number() over (partition by user_id % 16 order by ts, event_id) - 1 as bigint) as frame_seq,
  ts, event_id, user_id, cast(value as double) as latency_ms, event_type as model_id from events"""
DETECTIONS = """select l_orderkey as frame_id,
  cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as bigint) as idx,
  cast(l_partkey % 4 as bigint) as class_id, cast(5 + cast(floor(l_extendedprice) as bigint) % 95 as double) / 100 as conf,
  cast((l_suppkey % 4) * 100 as double) as x1, cast((l_partkey % 3) * 100 as double) as y1,
  cast((l_suppkey % 4) * 100 + 100 + 4 * l_quantity as double) as x2, cast((l_partkey % 3) * 100 + 100 + 4 * l_quantity as double) as y2
from lineitem"""
#: A DuckDB query starts with these.
WITH_FRAMES = f"with frames as ({FRAMES}) "
WITH_DETECTIONS = f"with detections as materialized ({DETECTIONS}) "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FRAMES.replace("from events", "from {events}"), events=table(spark, sf_dir, "events"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DETECTIONS.replace("from lineitem", "from {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))


def per_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a frame, with its detections as an array in index order."""
    one = F.struct("idx", "class_id", "conf", "x1", "y1", "x2", "y2")
    return detections(spark, sf_dir).groupBy("frame_id").agg(F.array_sort(F.collect_list(one)).alias("dets"))


def tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw model output a row: vec_id and 64 values."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
