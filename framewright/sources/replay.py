"""Replay of a saved store in the order of its dependencies: what becomes of each item, as rows, and its application to a catalog.

Sources come first, then pipelines, then tasks, then the start of tasks that ran; models are not replayed. An item whose own specification is
broken fails by itself; a task fails with the source or pipeline that it needs, and its start fails with it.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.sources.catalog import Catalog, order

#: The steps in order, and what an item of each is applied by.
STEPS = {"sources": 1, "pipelines": 2, "tasks": 3}
_CHECKED = "kind string, id string, running boolean, spec string, source_id string, pipeline_id string, reason string"


def _own_fault(kind: str, name: str | None, spec: str | None) -> tuple[str | None, str | None, str | None]:
    """(source, pipeline, reason) of an item by its specification alone."""
    try:
        item = json.loads(spec or "")
    except ValueError:
        return None, None, "specification is no JSON"
    if not isinstance(item, dict) or item.get("id", name) != name:
        return None, None, "specification is of another id"
    if kind == "tasks":
        missing = [k for k in ("source_id", "pipeline_id") if not item.get(k)]
        return item.get("source_id"), item.get("pipeline_id"), f"requires {missing[0]}" if missing else None
    if kind == "pipelines":
        try:
            order([n["id"] for n in item["nodes"]], [(e["from"], e["to"]) for e in item.get("edges", [])])
        except (KeyError, TypeError, ValueError) as e:
            return None, None, f"graph: {e}"
    return None, None, None


def replay_plan(store: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(step, kind, id, action, outcome, reason, spec) of each item of ``store`` (kind, id, running, spec; see :func:`framewright.sources.catalog.read_store`).

    action is add, update (of a pipeline that ``existing`` (kind, id) has), skip (of a source or task that it has) or start; outcome is ok or failed. Models and
    unknown kinds have no rows."""

    def run(frames):
        for f in frames:
            found = [_own_fault(k, i, s) for k, i, s in zip(f["kind"], f["id"], f["spec"])]
            for n, c in enumerate(("source_id", "pipeline_id", "reason")):
                f[c] = [x[n] for x in found]
            yield f

    rows = store.where(F.col("kind").isin(*STEPS)).select("kind", "id", "running", "spec").mapInPandas(run, _CHECKED)
    held = existing if existing is not None else store.select("kind", "id").limit(0)
    held = held.select("kind", "id").distinct().withColumn("held", F.lit(True))
    rows = rows.join(held, ["kind", "id"], "left")
    good = rows.where("reason is null").select("kind", "id").unionByName(held.select("kind", "id")).distinct()
    known = lambda kind, name: good.where(F.col("kind") == kind).select(F.col("id").alias(f"{name}_id"), F.lit(True).alias(f"has_{name}"))
    rows = rows.join(known("sources", "source"), "source_id", "left").join(known("pipelines", "pipeline"), "pipeline_id", "left")
    lacks = lambda name: F.when(F.col(f"has_{name}").isNull(), F.concat(F.lit(f"{name} "), F.col(f"{name}_id"), F.lit(" is not there")))
    reason = F.coalesce("reason", F.when(F.col("kind") == "tasks", F.coalesce(lacks("source"), lacks("pipeline"))))
    action = F.when(F.col("held").isNull(), "add").when(F.col("kind") == "pipelines", "update").otherwise("skip")
    step = F.when(F.col("kind") == "sources", STEPS["sources"]).when(F.col("kind") == "pipelines", STEPS["pipelines"]).otherwise(STEPS["tasks"])
    one = F.struct(step.alias("step"), action.alias("action"))
    start = F.struct(F.lit(max(STEPS.values()) + 1).alias("step"), F.lit("start").alias("action"))
    actions = F.when((F.col("kind") == "tasks") & F.coalesce("running", F.lit(False)), F.array(one, start)).otherwise(F.array(one))
    out = rows.withColumn("reason", reason).select("kind", "id", "spec", "reason", F.explode(actions).alias("x"))
    return out.select("x.step", "kind", "id", "x.action", F.when(F.col("reason").isNull(), "ok").otherwise("failed").alias("outcome"), "reason", "spec")


def apply_replay(plan: DataFrame, catalog: Catalog, attempts: int = 30, wait_s: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> list[tuple[str, str, str, int, str | None]]:
    """Applies the rows that are ok, in order, and returns (kind, id, action, attempts, error) of each row of the plan, those that failed with no attempt.

    An OSError, as of a server that is not up yet, is tried again up to ``attempts`` times; a refusal is not. A catalog holds as many items as one server runs."""
    out = []
    for r in plan.orderBy("step", "kind", "id").collect():
        if r.outcome == "failed":
            out.append((r.kind, r.id, r.action, 0, r.reason))
            continue
        item, error, n = json.loads(r.spec) | {"id": r.id}, None, 0
        for n in range(1, attempts + 1):
            try:
                if r.action == "add":
                    catalog.add(r.kind, item)
                elif r.action == "update":
                    catalog.update_pipeline(item)
                elif r.action == "start":
                    catalog.start(r.id)
                error = None
            except OSError as e:
                error = str(e)
                if n < attempts:
                    sleep(wait_s)
                continue
            except (KeyError, ValueError) as e:
                error = str(e)
            break
        out.append((r.kind, r.id, r.action, n, error))
    return out
