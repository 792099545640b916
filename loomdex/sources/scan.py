"""Scanning file trees on a file system that all executors share.

Spark's file readers pass over names that begin with a dot or an underscore, which sources may, so the
folders are walked by the executors, in rounds: a task lists so many folders, passes files on as it meets them, and hands the folders
that it didn't get to back for the next round, where all tasks share them. So neither a deep tree nor a wide one is one task's, and the driver lists
nothing. Folders that are hidden or excluded are not entered. Contents are read where they are asked for, after the files have been spread anew.
"""

from __future__ import annotations

import hashlib
import os
import posixpath
import re
import stat
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions import scalars as S
from loomdex.sources.tables import written

#: Folders that a task lists before it hands the rest back.
FOLDERS = 2_000


def include_roots(root: str, includes: list[str] | None) -> list[str]:
    """The folders to scan: the root for none, '' and '.'; absolute ones as they are; others below the root. Each once, in order."""
    out = [posixpath.normpath(root if not x or x == "." else x if x.startswith("/") else posixpath.join(root, x)) for x in (includes or ["."])]
    return list(dict.fromkeys(out))


def ignore_patterns(path: str) -> list[str]:
    """The globs of an ignore file: blank lines, comments and negations are skipped, ./ and slashes at the ends dropped, and
    names without a slash match in any folder. None for a file that isn't there."""
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            lines = [x.strip() for x in f]
    except FileNotFoundError:
        return []
    bare = [x.removeprefix("./").strip("/") for x in lines if x and x[0] not in "#!"]
    return [x if "/" in x else f"**/{x}" for x in bare if x]


def scan(spark: SparkSession, root: str, includes: list[str] | None = None, excludes: list[str] | None = None, extensions: list[str] | None = None, hidden: bool = False, content: bool = False) -> DataFrame:
    """(absolute_path, relative_path, extension, size, bytes, hidden, last_modified[, source, hash]) of the files below the roots.

    A path under several roots counts once; what can't be read is passed over. Hidden means below the include root. Excludes are matched against the path and the
    folders above it, relative to the root or absolute. Extensions count in their letter case; none means all.
    """
    rules = [re.compile(S.glob_regex(g)) for g in excludes or []]

    def skipped(path: str) -> bool:
        below = posixpath.relpath(path, root)
        return any(r.match(below) or r.match(path) for r in rules)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = deque((b, p) for batch in batches for b, p in zip(batch.column("base").to_pylist(), batch.column("path").to_pylist(), strict=True))
        rows: list[tuple[str, str, bool]] = []
        for _ in range(FOLDERS):
            if not queue:
                break
            base, folder = queue.popleft()
            for path, is_folder in entries(folder):
                if is_folder:
                    queue.append((base, path))
                else:
                    rows.append((base, path, False))
                if len(rows) >= 10_000:
                    yield listed(rows)
                    rows = []
        yield listed(rows + [(b, p, True) for b, p in queue])

    def listed(rows: list[tuple[str, str, bool]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.bool_()))], names=["base", "path", "folder"])

    def entries(folder: str) -> Iterator[tuple[str, bool]]:
        """The folders and files in a folder that aren't pruned, as they are met; none of one that can't be read."""
        try:
            with os.scandir(folder) as found:
                for x in found:
                    if (hidden or not x.name.startswith(".")) and not skipped(x.path):
                        if x.is_dir(follow_symlinks=False):
                            yield x.path, True
                        elif x.is_file():
                            yield x.path, False
        except OSError:
            return

    n_tasks = spark.sparkContext.defaultParallelism
    todo, files = spark.createDataFrame([(x, x) for x in include_roots(root, includes)], "base string, path string"), None
    while True:
        found = written(todo.mapInArrow(walk, "base string, path string, folder boolean"))
        here = found.where("not folder").select("base", "path")
        files = here if files is None else files.unionByName(here)
        todo = found.where("folder").select("base", "path")
        if not todo.limit(1).count():
            break
        todo = todo.repartition(n_tasks)
    df = read_files(files.repartition(n_tasks), content)
    df = df.withColumn("hidden", F.expr("substring(absolute_path, length(base) + 2)").rlike(r"(^|/)\.[^/]"))
    df = df.drop("base") if len(include_roots(root, includes)) == 1 else df.drop("base").dropDuplicates(["absolute_path"])
    df = df.withColumn("relative_path", F.coalesce(S.relative_path(F.lit(root), F.col("absolute_path")), F.col("absolute_path"))).withColumn("extension", F.regexp_extract("absolute_path", r"\.[^./]*$", 0)).withColumn("size", S.format_bytes(F.col("bytes")))
    df = df if content else df.drop("source", "hash")
    return df.where(F.col("extension").isin(*extensions)) if extensions else df


def read_files(files: DataFrame, content: bool = True) -> DataFrame:
    """(base, absolute_path, bytes, last_modified, source, hash) of the files (base, path) that are there; source and hash are null unless contents are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["base", "absolute_path", "bytes", "last_modified", "source", "hash"]
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for base, path in zip(batch.column("base").to_pylist(), batch.column("path").to_pylist(), strict=True):
                try:
                    about, raw = os.stat(path), b""
                    if not stat.S_ISREG(about.st_mode):
                        continue
                    if content:
                        with open(path, "rb") as f:
                            raw = f.read()
                except OSError:
                    continue
                rows.append((base, path, about.st_size, int(about.st_mtime), raw.decode("utf-8", "replace") if content else None, hashlib.sha256(raw).hexdigest() if content else None))
                size += about.st_size if content else 100
                if size > 8_000_000:
                    yield made(rows)
                    rows, size = [], 0
        yield made(rows)

    return files.select("base", "path").mapInArrow(run, "base string, absolute_path string, bytes long, last_modified long, source string, hash string")


def read_file(root: str, relative: str) -> str:
    """The text of a file below the root; PermissionError for a path that leaves it, FileNotFoundError where there is none."""
    path = posixpath.normpath(posixpath.join(root, relative))
    if path != root.rstrip("/") and not path.startswith(root.rstrip("/") + "/"):
        raise PermissionError(f"{relative} is outside of the project")
    with open(path, encoding="utf-8", errors="replace") as f:
        return f.read()
