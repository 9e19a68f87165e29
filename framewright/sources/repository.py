"""Model repositories: one folder a model with its config.yaml and numbered version folders that hold weight files.

Spark lists the files; configurations are read inside tasks; the rest is a plan, so that a broken model is a row with its error and holds up no other.
A version folder without any file is not seen, since files are listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.text import BACKENDS, VERSIONS, enum_of

_CONFIG = "model string, config struct<id: string, backend: string, version: string, engine_path: string, onnx_path: string, om_paths: map<string, string>, batch_size: int, active_version: bigint, weight_file: string>, broken string"
#: The kind of weight file of each backend.
SUFFIX = {"cuda": "engine", "cpu": "onnx", "mps": "onnx", "ascend": "om"}


def _read_configs(frames):
    import pandas as pd
    import yaml

    def one(content: bytes):
        try:
            c = yaml.safe_load(content)
        except yaml.YAMLError as e:
            return None, f"config.yaml: {str(e).splitlines()[0]}"
        if not isinstance(c, dict):
            return None, "config.yaml must be a mapping"
        text = lambda k, default=None: default if c.get(k) in (None, "") else str(c[k])
        try:
            return {
                "id": text("id"), "backend": text("backend", "tensorrt"), "version": text("version", "yolov8"), "engine_path": text("engine_path"), "onnx_path": text("onnx_path"), "weight_file": text("weight_file"),
                "om_paths": {str(k): str(v) for k, v in (c.get("om_paths") or {}).items()}, "batch_size": int(c.get("batch_size", 16)), "active_version": int(c["active_version"]) if c.get("active_version") is not None else -1,
            }, None
        except (TypeError, ValueError, AttributeError) as e:
            return None, f"config.yaml: {e}"

    for f in frames:
        rows = [(m, *one(bytes(b))) for m, b in zip(f["model"], f["content"])]
        yield pd.DataFrame(rows, columns=["model", "config", "broken"])


def resolve_repository(spark: SparkSession, root: str) -> DataFrame:
    """(model, version, backend, yolo, batch_size, weights, error) of each model folder under ``root`` with a config.yaml.

    The version is active_version, else the largest. ``weights`` maps a slot (engine, onnx, or the batch size of an om file) to its path: weight_file if
    given, else the paths of the configuration, those that are relative inside the version folder, else the only file of the backend's kind. Models with an error have no weights."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^file:/*", "/")
    inside = F.expr("substring(path_, length(base_) + 2)")
    named = files.select("path", "content", F.regexp_replace("path", "^[a-z0-9]+:/*", "/").alias("path_"), base.alias("base_")).withColumn("parts", F.split(inside, "/"))
    model = F.get("parts", F.lit(0))
    named = named.where(model.rlike("^[A-Za-z0-9_-]+$")).withColumn("model", model)
    configs = named.where((F.size("parts") == 2) & (F.get("parts", F.lit(1)) == "config.yaml")).select("model", "content").mapInPandas(_read_configs, _CONFIG)
    number = F.get("parts", F.lit(1))
    held = named.where((F.size("parts") == 3) & number.rlike("^[0-9]{1,18}$")).select("model", number.cast("bigint").alias("version"), number.alias("folder"), F.get("parts", F.lit(2)).alias("file")).where("version > 0")
    versions = held.groupBy("model", "version").agg(F.min("folder").alias("folder"), F.array_sort(F.collect_set("file")).alias("files"))
    versions = versions.groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct("version", F.struct("folder", "files")))).alias("versions"))
    rows = configs.join(versions, "model", "left")
    want = F.when(F.col("config.active_version") >= 0, F.col("config.active_version")).otherwise(F.array_max(F.map_keys("versions")))
    rows = rows.withColumn("version", want).withColumn("own", F.try_element_at("versions", F.col("version")))
    rows = rows.withColumns({"backend": enum_of(F.col("config.backend"), BACKENDS), "yolo": enum_of(F.col("config.version"), VERSIONS)})
    folder = F.concat(base, F.lit("/"), F.col("model"), F.lit("/"), F.col("own.folder"), F.lit("/"))
    placed = lambda p: F.when(p.startswith("/") | p.rlike("^[a-z0-9]+://"), p).otherwise(F.concat(folder, p))
    suffix = F.lit(None).cast("string")
    for name, kind in SUFFIX.items():
        suffix = F.when(F.col("backend") == name, kind).otherwise(suffix)
    rows = rows.withColumn("kind", suffix).withColumn("found", F.filter("own.files", lambda f: f.endswith(F.concat(F.lit("."), F.col("kind")))))
    wf, batch = F.col("config.weight_file"), F.col("config.batch_size").cast("string")
    slot = F.when(F.col("kind") == "om", batch).otherwise(F.col("kind"))
    single = lambda p: F.map_from_arrays(F.array(F.coalesce(slot, F.lit(""))), F.array(placed(p)))
    given = (
        F.when((F.col("kind") == "engine") & F.col("config.engine_path").isNotNull(), single(F.col("config.engine_path")))
        .when((F.col("kind") == "onnx") & F.col("config.onnx_path").isNotNull(), single(F.col("config.onnx_path")))
        .when((F.col("kind") == "om") & (F.size("config.om_paths") > 0), F.transform_values("config.om_paths", lambda k, v: placed(v)))
    )
    ending = F.lower(F.regexp_extract(wf, r"\.([A-Za-z]+)$", 1))
    error = (
        F.when(F.col("broken").isNotNull(), F.col("broken"))
        .when(F.col("config.id").isNotNull() & (F.col("config.id") != F.col("model")), F.concat(F.lit("id in config.yaml must match directory name, got "), F.col("config.id")))
        .when(F.col("versions").isNull(), "no numeric version subdirectories")
        .when(F.col("own").isNull(), F.concat(F.lit("active_version "), F.col("version").cast("string"), F.lit(" not found among version directories")))
        .when(F.col("yolo").isNull(), F.concat(F.lit("unknown version "), F.col("config.version")))
        .when(F.col("backend").isNull(), F.concat(F.lit("unknown backend "), F.col("config.backend")))
        .when(wf.isNotNull() & ~F.array_contains("own.files", wf), F.concat(F.lit("weight_file not found: "), wf))
        .when(wf.isNotNull() & ~ending.isin("onnx", "engine", "om"), F.concat(F.lit("weight_file has unsupported extension: "), ending))
        .when(wf.isNotNull() & (ending != F.col("kind")), F.concat(F.lit("weight_file ."), ending, F.lit(" does not fit backend "), F.col("backend")))
        .when(wf.isNotNull() | given.isNotNull(), None)
        .when((F.col("kind") == "engine") & F.col("config.onnx_path").isNotNull(), "engine_path is empty after scan")
        .when(F.size("found") == 0, F.concat(F.lit("no ."), F.col("kind"), F.lit(" in version "), F.col("version").cast("string")))
        .when(F.size("found") > 1, F.concat(F.lit("multiple ."), F.col("kind"), F.lit(" files in version "), F.col("version").cast("string")))
    )
    weights: Column = F.when(wf.isNotNull(), single(wf)).otherwise(F.coalesce(given, single(F.get("found", F.lit(0)))))
    return rows.withColumn("error", error).select("model", "version", "backend", "yolo", F.col("config.batch_size").alias("batch_size"), F.when(F.col("error").isNull(), weights).alias("weights"), "error")


def merge_repository(config: dict, resolved: DataFrame) -> dict:
    """``config`` with the models of a resolved repository; ValueError for a model with an error and for an id that both have.

    Repositories hold as many models as a server loads, so their rows come to the driver."""
    out = {**config, "models": list(config.get("models", []))}
    held = {m["id"] for m in out["models"]}
    for r in resolved.orderBy("model").collect():
        if r.error:
            raise ValueError(f"model_repository model {r.model}: {r.error}")
        if r.model in held:
            raise ValueError(f"model {r.model} is configured and in the repository")
        out["models"].append({"id": r.model, "backend": r.backend, "version": r.yolo, "batch_size": r.batch_size, "weights": dict(r.weights)})
    return out
