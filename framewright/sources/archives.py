"""Uploaded model archives: their members and what they hold, read inside tasks, and the outcome of deployments by token."""

from __future__ import annotations

import io
import re
import tarfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Batch sizes that files without a number in their name are given, in this order.
SLOTS = (1, 4, 8, 16)
_NUMBERED = re.compile(r"model_b([0-9]+)\.om$")
_SCHEMA = "archive string, files array<string>, backend string, om_files map<int, string>, model_file string, suggested_id string, error string"


def members(name: str, content: bytes) -> dict[str, bytes | None]:
    """The files of a zip or tar.gz archive in order of path, with the content of those named config.yaml; ValueError where a path leads out of it."""
    out: dict[str, bytes | None] = {}

    def keep(path: str, read):
        parts = path.replace("\\", "/").split("/")
        if path.startswith("/") or ".." in parts:
            raise ValueError(f"member {path} leads out of the archive")
        out["/".join(p for p in parts if p not in ("", "."))] = read() if parts[-1] == "config.yaml" else None

    if name.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for m in z.infolist():
                if not m.is_dir():
                    keep(m.filename, lambda m=m: z.read(m))
    else:
        with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as t:
            for m in t:
                if m.isfile():
                    keep(m.name, lambda m=m: t.extractfile(m).read())
    return dict(sorted(out.items(), key=lambda e: e[0].split("/")))


def analyse(name: str, content: bytes) -> tuple:
    """What an archive holds, a row of ``list_archives`` without its path."""
    import yaml

    try:
        held = members(name, content)
    except (ValueError, OSError, EOFError, zipfile.BadZipFile, tarfile.TarError) as e:
        return [], None, {}, None, None, f"unreadable archive: {e}"
    om: dict[int, str] = {}
    model, backend = None, None
    for path, text in held.items():
        base = path.rsplit("/", 1)[-1]
        if base == "config.yaml":
            try:
                said = yaml.safe_load(text)
                backend = str(said["backend"]) if isinstance(said, dict) and said.get("backend") else None
            except yaml.YAMLError:
                backend = None
        elif base.endswith(".om"):
            number = _NUMBERED.search(base)
            slot = int(number[1]) if number else next((s for s in SLOTS if s not in om), None) if len(om) < len(SLOTS) else None
            if slot is not None:
                om[slot] = path
        elif base.endswith((".engine", ".onnx")) and model is None:
            model = path
    tops = {p.split("/")[0] for p in held}
    single = tops.pop() if len(tops) == 1 and all("/" in p for p in held) else None
    backend = backend or ("ascend" if om else None if model is None else "trt" if model.endswith(".engine") else "cpu")
    return list(held), backend, om, model, single, "mixed backend files detected in archive" if om and model else None


def list_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, files, backend, om_files, model_file, suggested_id, error) of each .zip and .tar.gz file under ``path``."""

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = [(p, *analyse(p, bytes(c))) for p, c in zip(f["path"], f["content"])]
            yield pd.DataFrame(rows, columns=["archive", "files", "backend", "om_files", "model_file", "suggested_id", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("path").rlike(r"\.(zip|tar\.gz)$"))
    return files.select("path", "content").mapInPandas(run, _SCHEMA)


def deployments(requests: DataFrame, uploads: DataFrame, models: DataFrame) -> DataFrame:
    """``requests`` (token, id, at) with outcome: token_expired (also unknown ones), invalid_id, already_exists, or deployed.

    ``uploads`` have (token, expires_at), one row a token; ``models`` (id, since): the repository's models. Of several lawful requests for one id the first deploys,
    ties by token. A token that has deployed is spent; later requests with it find it expired."""
    u = uploads.select("token", "expires_at")
    r = requests.join(u, "token", "left").join(models.select("id", "since"), "id", "left")
    state = F.when(F.col("expires_at").isNull() | (F.col("at") > F.col("expires_at")), "token_expired").when(~F.coalesce(F.col("id").rlike("^[A-Za-z0-9_-]+$"), F.lit(False)), "invalid_id").when(F.col("since") <= F.col("at"), "already_exists").otherwise("deployed")
    r = r.withColumn("outcome", state)
    lawful = r.where("outcome = 'deployed'")
    by_id = lawful.groupBy("id").agg(F.min(F.struct("at", "token")).alias("first"))
    win = lawful.join(by_id, "id").where((F.struct("at", "token") == F.col("first"))).groupBy("token").agg(F.min(F.struct("at", "id")).alias("own"))
    r = r.join(by_id, "id", "left").join(win, "token", "left")
    own = F.struct("at", "id") == F.col("own")
    spent = (F.col("outcome") != "token_expired") & F.col("own").isNotNull() & (F.struct("at", "id") > F.col("own"))
    taken = (F.col("outcome") == "deployed") & ~F.coalesce(own, F.lit(False))
    return r.withColumn("outcome", F.when(spent, "token_expired").when(taken, "already_exists").otherwise(F.col("outcome"))).drop("expires_at", "since", "first", "own")
