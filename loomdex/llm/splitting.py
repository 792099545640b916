"""Cutting oversized texts at natural boundaries, with a repeated stretch between consecutive pieces.

Prefix sums of the UTF-8 length give the token offset of every character, a
sorted array the offsets at which a cut is natural; the last one under the
limit is found by binary search. Each chunk is read once, whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.sources.tables import latest_by, table

#: Kinds of boundary, from the most natural to the least. The cut is after the match.
BOUNDARIES = [
    re.compile(r"\n[)\]}]+[;,]?[ \t]*\r?\n|\n(?=#{1,6} )|\n\s*\n"),  # the end of a top-level block, before a heading, a blank line
    re.compile(r"[;{}:>]?\r?\n"),  # line ends
    re.compile(r"[.!?;:,](?=\s)\s|[。！？、]"),  # the ends of sentences and clauses
    re.compile(r"\s+|(?<=[,;)\]}])(?=\S)"),  # between words
]
#: A boundary of a better kind is taken if the piece then is at least so full; else the next kind is tried.
LEAST_FILL = (0.5, 0.4, 0.3, 0.1)


def offsets(text: str) -> np.ndarray:
    """Byte offset of each character of text in UTF-8, and of its end."""
    if text.isascii():
        return np.arange(len(text) + 1, dtype=np.int64)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    width = 1 + (points > 0x7F) + (points > 0x7FF).astype(np.int64) + (points > 0xFFFF)
    return np.concatenate([[0], np.cumsum(width)])


def cuts(text: str, limit: int = 800, overlap: int = 40) -> list[tuple[int, int]]:
    """The (start, end) of each piece in characters; a text within the limit is one piece.

    A piece has at most ``limit`` tokens of four bytes. Every piece but the first begins about
    ``overlap`` tokens before the end of the one before, at a line or word start where there is one.
    No character is left out or divided.
    """
    at = offsets(text)
    most, back = 4 * limit + 3, 4 * overlap
    if at[-1] <= most:
        return [(0, len(text))]
    natural = [np.fromiter((m.end() for m in kind.finditer(text)), dtype=np.int64) for kind in BOUNDARIES]
    pieces, start = [], 0
    while at[-1] - at[start] > most:
        hard = int(np.searchsorted(at, at[start] + most, "right")) - 1
        end = hard
        for marks, fill in zip(natural, LEAST_FILL, strict=True):
            k = int(np.searchsorted(marks, hard, "right")) - 1
            if k >= 0 and at[marks[k]] - at[start] >= fill * most:
                end = int(marks[k])
                break
        pieces.append((start, end))
        target = int(np.searchsorted(at, at[end] - back, "right")) - 1
        nearest = target
        for marks, slack in ((natural[1], back // 2), (natural[3], back // 4)):
            k = int(np.searchsorted(marks, target, "right")) - 1
            if k >= 0 and marks[k] > start and at[target] - at[marks[k]] <= slack:
                nearest = int(marks[k])
                break
        start = max(nearest, start + 1)
    pieces.append((start, len(text)))
    return pieces


def oversized(chunks: DataFrame, limit: int = 800) -> DataFrame:
    """(id, source_code) of the chunks over the limit, each id once, whatever token_count and is_collapsed say.

    The filter comes before the only shuffle. Null source_code is never over it. Of an id's rows over
    the limit the latest counts; rows without an id are left out.
    """
    rows = chunks.where(F.col("id").isNotNull() & (F.octet_length("source_code") >= 4 * (limit + 1)))
    return latest_by(rows.select("id", "source_code", "updated_at"), ["id"], "updated_at").select("id", "source_code")


def split(chunks: DataFrame, limit: int = 800, overlap: int = 40) -> DataFrame:
    """(id, piece, n_pieces, char_start, char_end, n_tokens, overlap_tokens, text) of every oversized chunk.

    overlap_tokens is what the piece repeats of the one before (0 for the first).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column("id").to_pylist(), batch.column("source_code").to_pylist(), strict=True):
                at, found = offsets(text), cuts(text, limit, overlap)
                for n, (a, b) in enumerate(found):
                    rows.append((key, n, len(found), a, b, int(at[b] - at[a]) // 4, int(at[found[n - 1][1]] - at[a]) // 4 if n else 0, text[a:b]))
            names = schema.names
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=schema.field(k).type) for k in range(len(names))], schema=schema)

    schema = pa.schema([("id", pa.string()), ("piece", pa.int32()), ("n_pieces", pa.int32()), ("char_start", pa.int32()), ("char_end", pa.int32()), ("n_tokens", pa.int32()), ("overlap_tokens", pa.int32()), ("text", pa.string())])
    return oversized(chunks, limit).mapInArrow(run, "id string, piece int, n_pieces int, char_start int, char_end int, n_tokens int, overlap_tokens int, text string")


def _chunks(spark, d: str) -> DataFrame:
    return table(spark, d, "chunks_new", "id", "source_code", "updated_at")


def p7_found(spark, d: str) -> DataFrame:
    """The chunks that the operator divides."""
    return split(_chunks(spark, d)).where("piece = 0 and n_pieces > 1").select("id")


def p7_pieces(spark, d: str) -> DataFrame:
    """The pieces of every oversized chunk."""
    return split(_chunks(spark, d))


QUERIES = {"p7_found": p7_found, "p7_pieces": p7_pieces}
SQL = {"p7_found": "SELECT DISTINCT id FROM chunks_new WHERE id IS NOT NULL AND strlen(source_code) // 4 > 800"}
