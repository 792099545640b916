"""An index of a source tree from end to end: scan, change detection, parse, chunk, embed, store; and its queries."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomdex.functions import scalars as S
from loomdex.operators import semantic
from loomdex.operators import symbols as Y
from loomdex.operators.chunking import line_chunks
from loomdex.operators.embed import Embedder, embed, hashing_embedder
from loomdex.operators.search import clamp_k, search
from loomdex.operators.upserts import changed, resolve_keys, stale
from loomdex.sources.scan import read_file, read_files, scan
from loomdex.sources.store import Store
from loomdex.streaming.debounce import WRITES, debounced, run_updates

TABLES = ("files", "chunks", "symbols", "nodes")
FILES = "path string, hash string, last_modified long, file_id long"


class Index:
    """The index of one project: tables files, chunks, symbols and nodes in a store, cut into buckets by file_id.

    An update evaluates its scan once, into a table of its own, and rewrites only the buckets of files that changed or went.
    ``told``, if given, is called with (project, path, time) for each file indexed.
    """

    def __init__(
        self, spark: SparkSession, root: str, folder: str, config: semantic.Config | None = None, make: Callable[[], Embedder] = hashing_embedder, model_id: str = "hashing-64",
        told: Callable[[str, str, float], None] | None = None, name: str = "index", **scanning,
    ):
        self.spark, self.root, self.store, self.name = spark, root, Store(spark, folder), name
        self.config, self.make, self.model_id, self.told, self.scanning = config or semantic.Config(), make, model_id, told, scanning
        self.progress = {"status": "idle", "total": 0, "processed": 0}

    def update(self) -> dict[str, int]:
        """Brings the index up to date: only files whose hash or time changed are parsed again, and what is gone is removed."""
        return self._apply(scan(self.spark, self.root, content=True, **self.scanning), None)

    def update_paths(self, paths: DataFrame) -> dict[str, int]:
        """The same for some files only (a column ``path``, relative to the root): those that are gone are removed. Excluded and hidden ones aren't indexed."""
        some = paths.select("path").where("path is not null").distinct()
        kept = some.where(~S.excluded(F.col("path"), self.scanning.get("excludes") or [], names=True))
        kept = kept if self.scanning.get("hidden") else kept.where(~S.hidden(F.col("path")))
        now = read_files(kept.select(F.lit(self.root).alias("base"), F.concat(F.lit(self.root.rstrip("/") + "/"), "path").alias("path")))
        if self.scanning.get("extensions"):
            now = now.where(F.regexp_extract("absolute_path", r"\.[^./]*$", 0).isin(*self.scanning["extensions"]))
        return self._apply(now.withColumn("relative_path", S.relative_path(F.lit(self.root.rstrip("/")), F.col("absolute_path"))), some)

    def _apply(self, found: DataFrame, only: DataFrame | None) -> dict[str, int]:
        scratch = self.store.files.child(f"scan-{uuid.uuid4().hex}")
        self.progress = {"status": "scanning", "total": 0, "processed": 0}
        try:
            found.select(F.col("relative_path").alias("path"), "hash", "last_modified", "source").write.parquet(scratch.path)
            now = self.spark.read.parquet(scratch.path)
            known = self.store.read("files") if self.store.versions("files") else self.spark.createDataFrame([], FILES)
            before = known.join(only.select("path"), "path", "left_semi") if only is not None else known
            work = changed(now, before.select("path", "hash", "last_modified"), "path", "hash", "last_modified").where("state <> 'unchanged'").select("path")
            work = work.join(resolve_keys(work, known), "path").select("path", "file_id").cache()
            gone = stale(before, now, ["path"]).select("file_id")
            dirty = work.select("file_id").unionByName(gone).distinct()
            n_work, n_gone = work.count(), gone.count()
            self.progress = {"status": "indexing", "total": n_work, "processed": 0}
            if n_work or n_gone or not self.store.versions("files"):
                fresh = now.join(work, "path").select("path", "hash", "last_modified", "source", "file_id")
                symbols = semantic.symbols(fresh)
                rows = {"chunks": self._chunks(fresh), "symbols": symbols, "nodes": Y.sibling_position(Y.parents(Y.node_ids(symbols)))}
                for name, df in rows.items():
                    self.store.replace(name, df, dirty, "file_id")
                self.store.replace("files", fresh.select("path", "hash", "last_modified", "file_id"), dirty, "file_id")  # last: a failed run is done again
            if self.told:
                for r in work.select("path").toLocalIterator():
                    self.told(self.name, r.path, time.time())
            self.progress = {"status": "idle", "total": n_work, "processed": n_work}
            work.unpersist()
            return {"indexed": n_work, "removed": n_gone, "files": self.store.read("files").count()}
        except Exception:
            self.progress["status"] = "failed"
            raise
        finally:
            scratch.remove()

    def follow(self, events: DataFrame, checkpoint: str, quiet: str = "2 seconds", watermark: str = "10 seconds") -> StreamingQuery:
        """Starts a query that indexes files again when the stream of their events (path, at, event_type) has been quiet: writes and creations count.
        An earlier one of this index's name is stopped. Its progress is the query's own."""
        writes = events.where(F.lower("event_type").isin(*WRITES))

        def update(batch: DataFrame, _: int) -> None:
            scratch = self.store.files.child(f"events-{uuid.uuid4().hex}")  # a batch is of the query's own session
            try:
                batch.select("path").distinct().write.parquet(scratch.path)
                self.update_paths(self.spark.read.parquet(scratch.path))
            finally:
                scratch.remove()

        return run_updates(debounced(writes, "path", "at", quiet, watermark), update, self.name, checkpoint)

    def stop(self) -> bool:
        """Stops following; whether there was anything to stop."""
        running = [q for q in self.spark.streams.active if q.name == self.name]
        for q in running:
            q.stop()
        return bool(running)

    def _chunks(self, files: DataFrame) -> DataFrame:
        parsed = semantic.chunks(files.where(S.supported(F.col("path"))), self.config)
        other = files.where(~S.supported(F.col("path")))
        plain = line_chunks(other.withColumn("key", F.struct("file_id", "path")), "key", "source", self.config.most)
        plain = plain.select("key.file_id", "key.path", S.language(F.col("key.path")).alias("language"), F.col("chunk").alias("ordinal"), *[F.lit(x).alias(n) for n, x in (("symbol_name", ""), ("symbol_kind", "text"))], "line_start", "line_end", "char_start", "char_end", S.token_estimate(F.col("content")).cast("int").alias("token_count"), F.lit("").alias("doc_string"), "content", F.col("content").alias("source_code"))
        rows = parsed.unionByName(plain).withColumn("id", F.substring(F.sha2(F.concat_ws("|", "path", "line_start", "line_end", "ordinal"), 256), 1, 32))
        return embed(rows, "content", self.make, self.model_id)

    def reset(self) -> None:
        """Stops following and removes all tables."""
        self.stop()
        for name in TABLES:
            self.store.drop(name)

    def reindex(self) -> dict[str, int]:
        """Everything anew."""
        self.reset()
        return self.update()

    def search(self, text: str, k: int | None = None) -> DataFrame:
        """The chunks most similar to a text (8 by default, 50 at most); ValueError for a blank one."""
        if not text or not text.strip():
            raise ValueError("the query is blank")
        return search(self.store.read("chunks"), self.make()([text.strip()])[0].tolist(), clamp_k(k, 8, 50))

    def outline(self, path: str, depth: int | None = None) -> DataFrame:
        """A file's symbols as a tree in order, down to a depth if one is given."""
        nodes = self.store.read("nodes").where(F.col("path") == path)
        return Y.outline(nodes, depth).join(nodes.select("pos", "name", "kind", "start_line", "end_line", "node_id"), "pos").orderBy("trail")

    def file_chunks(self, path: str) -> DataFrame:
        """A file's chunks by line; LookupError where it has none."""
        rows = self.store.read("chunks").where(F.col("path") == path).drop("embedding").orderBy("line_start", "ordinal")
        if not rows.limit(1).count():
            raise LookupError(path)
        return rows

    def source_of(self, chunk_id: str, collapse: bool = False) -> str:
        """A chunk's source, or its content where that is blank; LookupError for an unknown id."""
        body = F.coalesce(F.when(F.trim("source_code") != "", F.col("source_code")), F.col("content"))
        row = self.store.read("chunks").where(F.col("id") == chunk_id).select((S.collapse_body(body) if collapse else body).alias("b")).head()
        if row is None:
            raise LookupError(chunk_id)
        return row.b

    def read(self, path: str) -> str:
        return read_file(self.root, path)

    def stats(self) -> DataFrame:
        """One row: files, chunks, symbols, bytes, and the newest change."""
        files, chunks, symbols = (self.store.read(n) for n in ("files", "chunks", "symbols"))
        one = files.agg(F.count("*").alias("n_files"), F.max("last_modified").alias("newest"))
        return one.crossJoin(chunks.agg(F.count("*").alias("n_chunks"), F.sum(F.octet_length("content")).alias("bytes"))).crossJoin(symbols.agg(F.count("*").alias("n_symbols")))  # one row each

    def links(self) -> DataFrame:
        """Which symbols begin in which chunks."""
        return Y.chunk_symbols(self.store.read("chunks").withColumnRenamed("id", "chunk_id"), self.store.read("symbols").select(F.concat_ws(":", "file_id", "pos").alias("symbol_id"), "file_id", F.col("start_line").alias("line")))
