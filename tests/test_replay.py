"""Replay of a saved store: order, broken items and those that need them, what is there already, and another try after a server's silence."""

import json

from framewright.sources.catalog import Catalog, read_store
from framewright.sources.replay import apply_replay, replay_plan

PIPE = {"id": "p", "nodes": [{"id": "a", "type": "source.file"}, {"id": "b", "type": "sink.publish"}], "edges": [{"from": "a", "to": "b"}]}
LOOP = {"id": "loop", "nodes": PIPE["nodes"], "edges": [*PIPE["edges"], {"from": "b", "to": "a"}]}


def task(name, source, pipeline):
    return {"id": name, "source_id": source, "pipeline_id": pipeline}


def saved(spark, tmp_path):
    store = {
        "models": {"m": {"id": "m"}},
        "sources": {"s": {"id": "s", "url": "x"}, "old": {"id": "old", "url": "new"}},
        "pipelines": {"p": PIPE, "loop": LOOP},
        "tasks": {
            "good": {"create": task("good", "s", "p"), "running": True},
            "idle": {"create": task("idle", "s", "p"), "running": False},
            "broken": {"create": task("broken", "s", "loop"), "running": True},
            "lost": {"create": task("lost", "?", "p"), "running": False},
            "half": {"create": {"id": "half", "source_id": "s"}, "running": False},
        },
    }
    (tmp_path / "store.json").write_text(json.dumps(store))
    return read_store(spark, str(tmp_path / "store.json"))


def test_plan(spark, tmp_path):
    existing = spark.createDataFrame([("sources", "old"), ("pipelines", "p")], "kind string, id string")
    rows = replay_plan(saved(spark, tmp_path), existing).orderBy("step", "kind", "id").collect()
    got = [(r.step, r.kind, r.id, r.action, r.outcome) for r in rows]
    assert got == [
        (1, "sources", "old", "skip", "ok"), (1, "sources", "s", "add", "ok"), (2, "pipelines", "loop", "add", "failed"), (2, "pipelines", "p", "update", "ok"),
        (3, "tasks", "broken", "add", "failed"), (3, "tasks", "good", "add", "ok"), (3, "tasks", "half", "add", "failed"), (3, "tasks", "idle", "add", "ok"), (3, "tasks", "lost", "add", "failed"),
        (4, "tasks", "broken", "start", "failed"), (4, "tasks", "good", "start", "ok"),
    ]
    why = {(r.id, r.action): r.reason for r in rows if r.reason}
    assert "cycle" in why["loop", "add"] and why["broken", "start"] == why["broken", "add"] == "pipeline loop is not there"
    assert why["lost", "add"] == "source ? is not there" and why["half", "add"] == "requires pipeline_id"
    assert replay_plan(saved(spark, tmp_path).limit(0)).count() == 0


def test_application(spark, tmp_path):
    waits = []

    class Slow(Catalog):
        fails = 2

        def add(self, kind, item):
            if kind == "sources" and self.fails:
                self.fails -= 1
                raise ConnectionError("not up yet")
            super().add(kind, item)

    c = Slow()
    c.state["sources"]["old"] = {"id": "old"}
    existing = spark.createDataFrame([("sources", "old")], "kind string, id string")
    out = apply_replay(replay_plan(saved(spark, tmp_path), existing), c, attempts=3, sleep=waits.append)
    assert [(i, a, n) for _, i, a, n, e in out if e is None] == [("old", "skip", 1), ("s", "add", 3), ("p", "add", 1), ("good", "add", 1), ("idle", "add", 1), ("good", "start", 1)]
    assert waits == [2.0, 2.0] and c.running == {"good"} and set(c.state["tasks"]) == {"good", "idle"}
    again = apply_replay(replay_plan(saved(spark, tmp_path).where("kind = 'sources' and id = 's'")), c)
    assert again[0][3] == 1 and "already" in again[0][4]


def test_odd_specifications(spark):
    rows = [("sources", "a", None, None), ("sources", "b", None, "{"), ("sources", "c", None, '{"id": "d"}'), ("pipelines", "e", None, '{"id": "e"}'), ("models", "m", None, "{}"), ("sources", "f", None, "[]")]
    store = spark.createDataFrame(rows, "kind string, id string, running boolean, spec string")
    assert {(r.id, r.outcome) for r in replay_plan(store).collect()} == {(x, "failed") for x in "abcef"}
