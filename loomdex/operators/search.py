"""Exact vector search: score on the id and the vector alone, keep the best k, and only then fetch the wide columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_K, MOST_K = 10, 50


def clamp_k(k: int | None, default: int = DEFAULT_K, most: int | None = None) -> int:
    """k, or the default where it is null or not positive, at most ``most``."""
    k = default if k is None or k <= 0 else k
    return min(k, most) if most else k


def top_k(vectors: DataFrame, query: list[float], k: int | None = None, key: str = "id", vector: str = "embedding", distinct: bool = False) -> DataFrame:
    """(key, similarity): the k rows most similar to the query, best first, ties by lesser key.

    Null and empty vectors are skipped; vectors of other lengths, zero vectors and such with a null or infinite element score 0 and stay candidates. A query
    without a direction is an error. Vectors are scored as matrices, in double precision; each task keeps its best k, and only those
    meet. With ``distinct``, rows of equal key and similarity count once.
    """
    if not query or not any(query):
        raise ValueError("the query vector has no direction")
    q, k = np.array(query, dtype=np.float64), clamp_k(k)
    q = q / np.linalg.norm(q)
    field = vectors.schema[key]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            column = batch.column(1)
            sizes = np.diff(column.offsets.to_numpy())
            value = np.zeros(batch.num_rows)
            fit = np.flatnonzero(sizes == len(q))
            if len(fit):
                x = column.take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(q))
                with np.errstate(all="ignore"):
                    close = x @ q / np.linalg.norm(x, axis=1)
                value[fit] = np.where(np.isfinite(close), close, 0)
            now = pa.table({key: batch.column(0), "similarity": value})
            held = pa.concat_tables([held, now]) if held is not None else now
            held = held.group_by([key, "similarity"]).aggregate([]).select([key, "similarity"]) if distinct else held
            if held.num_rows > k:
                held = held.take(pc.sort_indices(held, [("similarity", "descending"), (key, "ascending")])[:k])
        if held is not None:
            yield from held.to_batches()

    schema = f"`{key}` {field.dataType.simpleString()}, similarity double"
    few = vectors.where(F.size(vector) > 0).select(key, vector).mapInArrow(best, schema)
    return (few.distinct() if distinct else few).orderBy(F.desc("similarity"), key).limit(k)


def latest_vectors(rows: DataFrame) -> DataFrame:
    """The rows of (id, embedding, updated_at) whose vector is their id's latest; repeated rows stay. Only hashes are shuffled, not the vectors."""
    hashed = rows.select("id", "embedding", "updated_at", F.xxhash64("embedding").alias("h"))
    by = hashed.groupBy("id").agg(F.max_by("h", F.struct("updated_at", "h")).alias("latest"), F.min("h").alias("least"), F.max("h").alias("most"))
    return hashed.join(by.where("least <> most").select("id", "latest"), "id", "left").where("latest is null or latest = h").select("id", "embedding")


def search(chunks: DataFrame, query: list[float], k: int | None = None) -> DataFrame:
    """top_k() over chunks, with the chunks' other columns but the vector; the k winners are joined, not the scan sorted wide."""
    best = top_k(chunks, query, k)
    wide = chunks.drop("embedding")
    return wide.join(F.broadcast(best), "id").orderBy(F.desc("similarity"), "id")  # k rows
