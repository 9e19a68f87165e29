"""Declared pipelines to Spark plans: one DataFrame a node, in topological order; several edges in are a union, several out share the plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from framewright.plans.stages import STAGES, Context, read_params
from framewright.sources.catalog import order

#: What an edge may do when it is full; plans have no queues, so that the policy is only checked.
POLICIES = ("block", "drop_oldest", "drop_newest")


def check_pipeline(spec: dict, context: Context | None = None) -> dict[str, dict]:
    """The read parameters of each node of ``spec``; ValueError for cycles, unknown nodes, stages, models or publishers, bad parameters or edges."""
    names = [n["id"] for n in spec["nodes"]]
    if len(names) != len(set(names)):
        raise ValueError("duplicate node ids")
    for e in spec.get("edges", []):
        if e.get("policy", "block") not in POLICIES:
            raise ValueError(f"edge policy must be one of: {', '.join(POLICIES)}")
        if int(e.get("capacity", 1)) < 1:
            raise ValueError("edge capacity must be >= 1")
    order(names, [(e["from"], e["to"]) for e in spec.get("edges", [])])
    into = {e["to"] for e in spec.get("edges", [])}
    for n in spec["nodes"]:
        if n["type"].startswith("source.") == (n["id"] in into) and n["type"] in STAGES:
            raise ValueError(f"{n['id']} has {'an' if n['id'] in into else 'no'} input")
    return {n["id"]: read_params(n["type"], n.get("with", {}), context or Context()) for n in spec["nodes"]}


def compile_pipeline(spec: dict, sources: dict[str, DataFrame], context: Context | None = None) -> dict[str, DataFrame]:
    """The DataFrame of each node of ``spec`` (nodes with id, type, with; edges from, to); nodes whose type begins with source. take ``sources``.

    All parameters are checked before any plan is built. Columns that only some of the united inputs have are null in the others."""
    context = context or Context()
    params = check_pipeline(spec, context)
    edges = [(e["from"], e["to"]) for e in spec.get("edges", [])]
    nodes = {n["id"]: n for n in spec["nodes"]}
    out: dict[str, DataFrame] = {}
    for name in order(list(nodes), edges):
        into = [out[a] for a, b in edges if b == name] or [sources[name]]
        df = into[0]
        for other in into[1:]:
            df = df.unionByName(other, allowMissingColumns=True)
        out[name] = STAGES[nodes[name]["type"]](df, params[name], context)
    return out
