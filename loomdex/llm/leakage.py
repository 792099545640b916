"""Held-out passages in a corpus, by winnowing.

Both sides are reduced to fingerprints: of every window of consecutive k-word hashes
the least is kept (the rightmost of equals). Two texts that share ``span`` words share a
whole window, hence a fingerprint. Hits are then extended in the texts themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.sources.tables import table, written

#: The least shared span, in words, and the words of a fingerprint.
SPAN, GRAM = 12, 6
WORD = re.compile(r"[^\W_]+")
ROWS = 512


def words(text: str | None) -> list[str]:
    """The maximal runs of letters and digits, without case."""
    return [w.casefold() for w in WORD.findall(text)] if text else []


def winnow(codes: np.ndarray, gram: int = GRAM, span: int = SPAN) -> np.ndarray:
    """The distinct fingerprints of a sequence of word hashes; none if it is shorter than ``span``."""
    if len(codes) < span:
        return np.empty(0, dtype=np.uint64)
    n = len(codes) - gram + 1
    h = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(gram):
            h = (h ^ codes[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    windows = np.lib.stride_tricks.sliding_window_view(h, span - gram + 1)
    return np.unique(windows.min(axis=1))  # by value the rightmost of equals is the same as any


def fingerprints(texts: DataFrame, key: str, gram: int = GRAM, span: int = SPAN) -> DataFrame:
    """(key, print): the distinct fingerprints of each row's text, of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                if len(known) > 200_000:
                    known.clear()
                found = []
                for text in part.column(1).to_pylist():
                    codes = [known.get(w) or known.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words(text)]
                    found.append(winnow(np.array(codes, dtype=np.uint64), gram, span))
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found])))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(found).view(np.int64))], names=["key", "print"])

    return texts.select(key, "text").mapInArrow(run, f"key {texts.schema[key].dataType.simpleString()}, print long")


def shared_runs(document: list[str], item: list[str], span: int = SPAN) -> tuple[int, int]:
    """The longest run of words that both have, and how many of the item's words lie in shared runs of at least ``span``."""
    starts: dict[tuple[str, ...], list[int]] = {}
    for k in range(len(item) - span + 1):
        starts.setdefault(tuple(item[k : k + span]), []).append(k)
    longest, covered = 0, np.zeros(len(item) + 1, dtype=bool)
    going: dict[int, int] = {}  # by the item's next position: length of the run so far
    for p in range(len(document) - span + 1):
        now = {}
        for k in starts.get(tuple(document[p : p + span]), ()):
            length = going.get(k, span - 1) + 1
            now[k + 1] = length
            longest = max(longest, length)
            covered[k : k + span] = True
        going = now
    return longest, int(covered[: len(item)].sum())


def leaks(documents: DataFrame, items: DataFrame, gram: int = GRAM, span: int = SPAN) -> DataFrame:
    """(doc_id, item_id, longest_run, item_share): documents that hold at least ``span`` consecutive words of an item.

    ``documents`` has doc_id, text, ``items`` item_id, text. Null, empty and shorter texts hold nothing; rows with a null id
    are left out; a repeated row gives its pair once. Spark sends the items' fingerprints to all executors only if they
    are small at run time, and otherwise joins them by a shuffle.
    """
    documents, items = documents.where("doc_id is not null and text is not null"), items.where("item_id is not null and text is not null")
    theirs = fingerprints(items, "item_id", gram, span).distinct().withColumnRenamed("key", "item_id")
    ours = fingerprints(documents, "doc_id", gram, span).withColumnRenamed("key", "doc_id")
    hits = written(ours.join(theirs, "print").select("doc_id", "item_id").distinct())
    near = hits.join(documents.select("doc_id", "text"), "doc_id").join(items.select("item_id", F.col("text").alias("item")), "item_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            longest, share = [], []
            for text, item in zip(batch.column("text").to_pylist(), batch.column("item").to_pylist(), strict=True):
                w = words(item)
                run, covered = shared_runs(words(text), w, span)
                longest.append(run)
                share.append(round(covered / len(w), 6))
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("item_id"), pa.array(longest, pa.int32()), pa.array(share, pa.float64())], names=["doc_id", "item_id", "longest_run", "item_share"])
            yield out.filter(pa.array(x >= span for x in longest))

    kinds = (documents.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString())
    found = near.select("doc_id", "item_id", "text", "item").mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, longest_run int, item_share double")
    return found.groupBy("doc_id", "item_id").agg(F.max("longest_run").alias("longest_run"), F.max("item_share").alias("item_share"))


def _found(spark, d: str) -> DataFrame:
    held_out = table(spark, d, "eval_items").where(F.col("split").isin("test", "dev"))
    return leaks(table(spark, d, "documents", "doc_id", "text"), held_out.select("item_id", "text"))


def p9_found(spark, d: str) -> DataFrame:
    """Document and held-out item of which it holds at least twelve consecutive words."""
    return _found(spark, d).select("doc_id", "item_id")


def p9_leaked_items(spark, d: str) -> DataFrame:
    """Which held-out items leaked, into how many documents, and how much of them at most."""
    by = _found(spark, d).groupBy("item_id").agg(F.count("*").alias("n_documents"), F.max("longest_run").alias("longest_run"), F.max("item_share").alias("item_share"))
    return by.join(table(spark, d, "eval_items", "item_id", "suite", "split"), "item_id").select("item_id", "suite", "split", "n_documents", "longest_run", "item_share")


QUERIES = {"p9_found": p9_found, "p9_leaked_items": p9_leaked_items}
_GRAMS = lambda source, key: f"SELECT DISTINCT {key}, array_to_string(l[i:i + 11], ' ') AS gram FROM (SELECT {key}, l, unnest(range(1, len(l) - 10)) AS i FROM (SELECT {key}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS l FROM {source}) WHERE len(l) >= 12)"
#: By all twelve-word spans of both sides; no fingerprint is left out.
SQL = {
    "p9_found": f"WITH d AS ({_GRAMS('documents WHERE doc_id IS NOT NULL', 'doc_id')}), i AS ({_GRAMS('eval_items WHERE split IN (' + chr(39) + 'test' + chr(39) + ', ' + chr(39) + 'dev' + chr(39) + ')', 'item_id')}) SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (gram)",
}
