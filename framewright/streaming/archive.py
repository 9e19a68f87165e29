"""Frame archives: a sink that writes a file a frame and commits them together, and the deletion of expired bucket folders.

The sink is a Python data source: ``df.write.format("frame_archive").option("path", root)`` after :func:`register`, for tables and streams alike. Rows are
(key, payload): the path inside the archive, as ``<day>/<hour>/<minute>/<stream>/<name>``, and its bytes. Each task writes into a staging
folder of its own; the commit moves what successful tasks have staged to its place, a rename a file, and a failed or
aborted job's staging goes, so readers see whole files of whole jobs only.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from framewright.functions import text as T

STAGING = "_staging"


def with_location(frames: DataFrame, root: str, base_url: str, key: str = "key") -> DataFrame:
    """``frames`` with frame_local_path and frame_url of their archive key, null where they are not archived."""
    return frames.withColumns({"frame_local_path": F.concat(F.lit(root.rstrip("/") + "/"), F.col(key)), "frame_url": T.url_join(F.lit(base_url), F.col(key))})


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    files: int


class _Writer:
    def __init__(self, options):
        self.root, self.job = options["path"].rstrip("/"), uuid.uuid4().hex

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root)

    def write(self, rows):
        from pyspark import TaskContext

        files, root = self._files()
        folder = f"{root}/{STAGING}/{self.job}/{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}"
        n, made = 0, set()
        for r in rows:
            if r["key"] is None or r["payload"] is None:
                continue
            if r["key"].startswith("/") or ".." in r["key"].split("/"):
                raise ValueError(f"key {r['key']} leads out of the archive")
            path = f"{folder}/{r['key']}"
            parent = path.rsplit("/", 1)[0]
            if parent not in made:
                files.create_dir(parent, recursive=True)
                made.add(parent)
            with files.open_output_stream(path) as out:
                out.write(bytes(r["payload"]))
            n += 1
        return Staged(folder, n)

    def _place(self, messages):
        from pyarrow import fs

        files, root = self._files()
        for m in messages:
            if m is None or not m.files:
                continue
            found = [f.path for f in files.get_file_info(fs.FileSelector(m.folder, recursive=True)) if f.type == fs.FileType.File]
            for parent in {p[len(m.folder) + 1 :].rsplit("/", 1)[0] for p in found if "/" in p[len(m.folder) + 1 :]}:
                files.create_dir(f"{root}/{parent}", recursive=True)
            with ThreadPoolExecutor(16) as pool:
                list(pool.map(lambda p, m=m: files.move(p, f"{root}/{p[len(m.folder) + 1 :]}"), found))

    def _clear(self):
        from pyarrow import fs

        files, root = self._files()
        for folder in (f"{root}/{STAGING}/{self.job}",):
            if files.get_file_info(folder).type == fs.FileType.Directory:
                files.delete_dir(folder)
        if files.get_file_info(f"{root}/{STAGING}").type == fs.FileType.Directory and not files.get_file_info(fs.FileSelector(f"{root}/{STAGING}")):
            files.delete_dir(f"{root}/{STAGING}")


class ArchiveWriter(_Writer, DataSourceWriter):
    def commit(self, messages):
        self._place(messages)
        self._clear()

    def abort(self, messages):
        self._clear()


class ArchiveStreamWriter(_Writer, DataSourceStreamWriter):
    """A micro-batch that is committed again after a restart moves its files over the same ones."""

    def commit(self, messages, batchId):  # noqa: N803
        self._place(messages)
        self._clear()

    def abort(self, messages, batchId):  # noqa: N803
        self._clear()


class FrameArchive(DataSource):
    @classmethod
    def name(cls):
        return "frame_archive"

    def schema(self):
        return "key string, payload binary"

    def writer(self, schema, overwrite):
        return ArchiveWriter(self.options)

    def streamWriter(self, schema, overwrite):  # noqa: N802
        return ArchiveStreamWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FrameArchive)


def delete_expired(spark: SparkSession, root: str, now: int, max_age_minutes: int) -> DataFrame:
    """(folder, files) of the bucket folders that were deleted: days, hours and minutes that end no later than ``max_age_minutes`` before ``now``.

    Folders are judged by their names; those with other names stay. A day is one task's work; hours and days that are left empty go too."""
    from pyarrow import fs

    files, top = fs.FileSystem.from_uri(root)
    if files.get_file_info(top).type != fs.FileType.Directory:
        return spark.createDataFrame([], "folder string, files bigint")
    days = [(f.path,) for f in files.get_file_info(fs.FileSelector(top)) if f.type == fs.FileType.Directory and len(f.base_name) == 8 and f.base_name.isdigit()]
    cutoff = now - 60 * max_age_minutes

    def run(batches):
        import calendar
        import time

        import pandas as pd

        files, _ = fs.FileSystem.from_uri(root)
        folders = lambda p: [f for f in files.get_file_info(fs.FileSelector(p)) if f.type == fs.FileType.Directory]
        number = lambda f, below: int(f.base_name) if len(f.base_name) == 2 and f.base_name.isdigit() and int(f.base_name) < below else None
        out = []

        def drop(path):
            out.append((path, sum(f.type == fs.FileType.File for f in files.get_file_info(fs.FileSelector(path, recursive=True)))))
            files.delete_dir(path)

        def prune(path):
            if not files.get_file_info(fs.FileSelector(path)):
                files.delete_dir(path)

        for b in batches:
            for day in b["day"]:
                try:
                    start = calendar.timegm(time.strptime(day.rsplit("/", 1)[-1], "%Y%m%d"))
                except ValueError:
                    continue
                if start + 86400 <= cutoff:
                    drop(day)
                    continue
                for hour in folders(day):
                    if (h := number(hour, 24)) is None:
                        continue
                    if start + 3600 * (h + 1) <= cutoff:
                        drop(hour.path)
                        continue
                    for minute in folders(hour.path):
                        if (m := number(minute, 60)) is not None and start + 3600 * h + 60 * (m + 1) <= cutoff:
                            drop(minute.path)
                    prune(hour.path)
                prune(day)
            yield pd.DataFrame(out, columns=["folder", "files"])
            out.clear()

    if not days:
        return spark.createDataFrame([], "folder string, files bigint")
    done = spark.createDataFrame(days, "day string").repartition(min(len(days), 200)).mapInPandas(run, "folder string, files bigint").collect()  # folders, not frames
    return spark.createDataFrame(done, "folder string, files bigint")
