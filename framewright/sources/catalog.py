"""Configuration, model repositories and runtime deltas as tables; small driver-side state rendered as DataFrames."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("sources", "models", "pipelines", "tasks")


def load_config(path: str) -> dict:
    """A YAML configuration with lists of sources, models, pipelines, tasks and publishers; ids must be unique and references known."""
    import yaml

    with open(path, encoding="utf-8") as f:
        config = yaml.safe_load(f) or {}
    validate(config)
    return config


def validate(config: dict) -> None:
    """Raises ValueError for duplicate ids, unknown references, edges to unknown nodes and cycles."""
    ids = {}
    for kind in (*KINDS, "publishers"):
        names = [x["id"] for x in config.get(kind, [])]
        if len(names) != len(set(names)):
            raise ValueError(f"duplicate ids in {kind}")
        ids[kind] = set(names)
    for m in config.get("models", []):
        for c in m.get("cascade", []):
            if c["model_id"] not in ids["models"]:
                raise ValueError(f"model {m['id']} names unknown model {c['model_id']}")
    for t in config.get("tasks", []):
        if t["source_id"] not in ids["sources"] or t["pipeline_id"] not in ids["pipelines"]:
            raise ValueError(f"task {t['id']} names an unknown source or pipeline")
    for p in config.get("pipelines", []):
        order([n["id"] for n in p["nodes"]], [(e["from"], e["to"]) for e in p.get("edges", [])])


def order(nodes: list[str], edges: list[tuple[str, str]]) -> list[str]:
    """The nodes so that every edge leads forward; ValueError for a cycle or an unknown node."""
    left = {n: {a for a, b in edges if b == n} for n in nodes}
    if unknown := {x for e in edges for x in e} - set(nodes):
        raise ValueError(f"edge to unknown node {sorted(unknown)}")
    out: list[str] = []
    while left:
        ready = [n for n in nodes if n in left and not left[n] - set(out)]
        if not ready:
            raise ValueError(f"cycle through {sorted(left)}")
        out += ready
        for n in ready:
            del left[n]
    return out


def scan_repository(spark: SparkSession, root: str) -> DataFrame:
    """(model, version, files): the largest version folder of each model under root, by Spark's file listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    at = F.regexp_extract("path", r"/([^/]+)/(\d+)/([^/]+)$", 1), F.regexp_extract("path", r"/([^/]+)/(\d+)/([^/]+)$", 2), F.regexp_extract("path", r"([^/]+)$", 1)
    rows = files.select(at[0].alias("model"), at[1].alias("version"), at[2].alias("file")).where("model <> '' and version <> ''").withColumn("version", F.col("version").cast("int"))
    versions = rows.groupBy("model", "version").agg(F.array_sort(F.collect_set("file")).alias("files"))
    return versions.groupBy("model").agg(F.max("version").alias("version"), F.max_by("files", "version").alias("files"))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(kind, id, running, spec) of a saved store of models, sources, pipelines and tasks: one JSON document of items by their ids.

    Kinds that the document lacks have no rows; spec is the item's JSON text, for a task that of its creation."""
    kinds = [k for k in KINDS if k != "tasks"]
    schema = ", ".join([f"{k} map<string, string>" for k in kinds] + ["tasks map<string, struct<create: string, running: boolean>>"])
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("d")).select("d.*")

    def rows_of(kind: str):
        def row(e):
            task = kind == "tasks"
            running, spec = (e["value"]["running"], e["value"]["create"]) if task else (F.lit(None).cast("boolean"), e["value"])
            return F.struct(F.lit(kind).alias("kind"), e["key"].alias("id"), running.alias("running"), spec.alias("spec"))

        return F.transform(F.map_entries(kind), row)

    none = F.array().cast("array<struct<kind: string, id: string, running: boolean, spec: string>>")
    return doc.select(F.explode(F.concat(*[F.coalesce(rows_of(k), none) for k in KINDS])).alias("x")).select("x.*")


class Catalog:
    """Sources, models, pipelines and tasks with the rules of their changes; ``deltas`` hold what was added and removed since the configuration.

    ``repository`` holds models that may be loaded, ``metrics`` gives the exposition text that the command metrics returns."""

    def __init__(self, config: dict | None = None, repository: list[dict] | None = None, metrics: Callable[[], str] | None = None):
        config = config or {}
        self.repository = {m["id"]: m for m in repository or []}
        self.metrics = metrics or (lambda: "")
        validate(config)
        self.state = {k: {x["id"]: x for x in config.get(k, [])} for k in KINDS}
        self.base = {k: set(v) for k, v in self.state.items()}
        self.running: set[str] = set()

    def add(self, kind: str, item: dict) -> None:
        if item["id"] in self.state[kind]:
            raise ValueError(f"{kind} has {item['id']} already")
        trial = {k: [*v.values()] for k, v in self.state.items()}
        trial[kind].append(item)
        validate(trial)
        self.state[kind][item["id"]] = item

    def remove(self, kind: str, name: str) -> None:
        if name not in self.state[kind]:
            raise KeyError(name)
        field = {"sources": "source_id", "pipelines": "pipeline_id"}.get(kind)
        used = field and any(t[field] == name for t in self.state["tasks"].values())
        used = used or (kind == "models" and any(c["model_id"] == name for m in self.state["models"].values() for c in m.get("cascade", [])))
        if used or name in self.running:
            raise ValueError(f"{name} is in use")
        del self.state[kind][name]

    def update_pipeline(self, item: dict) -> None:
        if any(t["pipeline_id"] == item["id"] and t["id"] in self.running for t in self.state["tasks"].values()):
            raise ValueError("a running task uses this pipeline")
        old = self.state["pipelines"].pop(item["id"])
        try:
            self.add("pipelines", item)
        except ValueError:
            self.state["pipelines"][item["id"]] = old
            raise

    def update_task(self, item: dict) -> None:
        """Puts ``item`` in the place of the task of its id, which must not run; its source and pipeline must be known."""
        if item["id"] in self.running:
            raise ValueError(f"{item['id']} is running")
        old = self.state["tasks"].pop(item["id"])
        try:
            self.add("tasks", item)
        except ValueError:
            self.state["tasks"][item["id"]] = old
            raise

    def load_from_repository(self, name: str) -> None:
        self.add("models", self.repository[name])

    def unload_model(self, name: str) -> None:
        """Removes a model that no running task's pipeline and no cascade names."""
        used = {t["pipeline_id"] for t in self.state["tasks"].values() if t["id"] in self.running}
        if any(name == str(n.get("with", {}).get("model_id")) for p in used for n in self.state["pipelines"][p]["nodes"]):
            raise ValueError(f"{name} is in use")
        self.remove("models", name)

    def start(self, task: str) -> None:
        self.running.add(self.state["tasks"][task]["id"])

    def stop(self, task: str) -> None:
        self.running.discard(task)

    def deltas(self) -> dict:
        now = {k: set(v) for k, v in self.state.items()}
        return {f"{w}_{k}": ([self.state[k][n] for n in sorted(now[k] - self.base[k])] if w == "added" else sorted(self.base[k] - now[k])) for k in KINDS for w in ("added", "removed")}

    def save(self, path: str) -> None:
        """Writes the deltas under another name first, so that a reader never sees half a file."""
        with tempfile.NamedTemporaryFile("w", dir=os.path.dirname(path) or ".", delete=False, encoding="utf-8") as f:
            json.dump(self.deltas(), f)
        os.replace(f.name, path)

    def load(self, path: str) -> None:
        """Applies deltas that were saved; a missing or malformed file counts as none."""
        try:
            with open(path, encoding="utf-8") as f:
                deltas = json.load(f)
        except (FileNotFoundError, ValueError):
            return
        self.apply(deltas)

    def apply(self, deltas: dict) -> None:
        for k in KINDS:
            for name in deltas.get(f"removed_{k}", []):
                self.state[k].pop(name, None)
            for item in deltas.get(f"added_{k}", []):
                self.state[k].setdefault(item["id"], item)

    def command(self, line: str) -> dict:
        """Answers a request of one JSON line: health, metrics, list_*, add_*, remove_*, update_pipeline, update_task, start_task, stop_task,
        list_repository, load_from_repository, load_model, unload_model."""
        try:
            r = json.loads(line)
            verb, _, kind = r["cmd"].partition("_")
            if r["cmd"] == "health":
                return {"ok": True}
            if r["cmd"] == "metrics":
                return {"ok": True, "data": self.metrics()}
            if r["cmd"] == "list_repository":
                return {"ok": True, "data": [m | {"loaded": m["id"] in self.state["models"]} for m in self.repository.values()]}
            if verb == "list":
                return {"ok": True, kind: [*self.state[kind].values()]}
            if r["cmd"] in ("update_pipeline", "update_task"):
                getattr(self, r["cmd"])(r["item"])
            elif r["cmd"] in ("load_from_repository", "unload_model"):
                getattr(self, r["cmd"])(r["id"])
            elif r["cmd"] == "load_model":
                self.add("models", r["item"])
            elif verb in ("start", "stop") and kind == "task":
                getattr(self, verb)(r["id"])
            elif verb == "add":
                self.add(kind + "s", r["item"])
            elif verb == "remove":
                self.remove(kind + "s", r["id"])
            else:
                return {"ok": False, "error": f"unknown command {r['cmd']}"}
            return {"ok": True}
        except (KeyError, ValueError) as e:
            return {"ok": False, "error": str(e), "in_use": "in use" in str(e)}

    def table(self, spark: SparkSession, kind: str) -> DataFrame:
        rows = [(k, json.dumps(v, sort_keys=True)) for k, v in sorted(self.state[kind].items())]
        return spark.createDataFrame(rows, "id string, spec string")
