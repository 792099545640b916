"""Symbols and their places: interval joins, containment, outlines as adjacency lists.

All joins have the file as an equality key, so that the ranges are residual conditions within one file.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chunk_symbols(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """(chunk_id, symbol_id): the symbols whose line lies in a chunk of the same file.

    ``chunks`` has chunk_id, file_id, line_start, line_end, ``symbols`` symbol_id, file_id, line. Nulls match nothing.
    """
    c, s = chunks.alias("c"), symbols.alias("s")
    return c.join(s, (F.col("c.file_id") == F.col("s.file_id")) & F.col("s.line").between(F.col("c.line_start"), F.col("c.line_end"))).select("c.chunk_id", "s.symbol_id").distinct()


#: Kinds of symbols that are left out where they strictly contain another.
CONTAINERS = ("element", "script", "style", "rule", "media", "keyframes")


def containers(symbols: DataFrame, kinds: tuple[str, ...] = CONTAINERS) -> DataFrame:
    """The symbols of the given kinds that strictly contain another symbol of their file, and headings below which another symbol names them as its parent.

    Spans are of bytes (start_byte, end_byte, where the table has them) unless a symbol's own bytes are both 0, then of lines. Sorted by their beginnings, a span contains another if
    the least end behind it isn't beyond its own: one window a unit, no pair is formed.
    """
    has_bytes = {"start_byte", "end_byte"} <= set(symbols.columns)
    units = [("start_byte", "end_byte"), ("start_line", "end_line")] if has_bytes else [("start_line", "end_line")]
    marked = symbols.withColumn("__bytes", (F.col("start_byte") != 0) | (F.col("end_byte") != 0) if has_bytes else F.lit(False))
    inner = None
    for first, last in units:
        spans = symbols.select("file_id", first, last).distinct()
        behind = Window.partitionBy("file_id").orderBy(first, F.desc(last)).rowsBetween(1, Window.unboundedFollowing)
        holds = spans.withColumn("__least", F.min(last).over(behind)).where(F.col("__least") <= F.col(last)).drop("__least")
        rows = marked.where(F.col("kind").isin(*kinds) & (F.col("__bytes") == (first == "start_byte"))).join(holds, ["file_id", first, last], "left_semi")
        inner = rows if inner is None else inner.unionByName(rows)
    children = symbols.where("parent <> ''").groupBy("file_id", F.col("parent").alias("name")).agg(F.max("start_line").alias("__line"), F.count("*").alias("__n"))
    heads = marked.where(F.col("kind") == "heading").join(children, ["file_id", "name"]).where((F.col("__line") >= F.col("start_line")) & ((F.col("parent") != F.col("name")) | (F.col("__n") > 1)))
    return inner.unionByName(heads.select(*inner.columns)).drop("__bytes").select(*symbols.columns)


def node_ids(symbols: DataFrame) -> DataFrame:
    """symbols with ``node_id``: path:start:end:name:n, n counting equal ones in order of position."""
    w = Window.partitionBy("file_id", "start_line", "end_line", "name").orderBy("pos")
    return symbols.withColumn("node_id", F.concat_ws(":", "path", "start_line", "end_line", "name", F.row_number().over(w) - 1))


def parents(symbols: DataFrame) -> DataFrame:
    """symbols with ``parent_pos``: the last earlier symbol of the file with the parent's name whose lines contain it; null for the root."""
    c, p = symbols.alias("c"), symbols.select("file_id", F.col("pos").alias("p_pos"), F.col("name").alias("p_name"), F.col("start_line").alias("p_start"), F.col("end_line").alias("p_end")).alias("p")
    at = (F.col("c.file_id") == F.col("p.file_id")) & (F.col("c.parent") == F.col("p_name")) & (F.col("p_pos") < F.col("c.pos")) & (F.col("p_start") <= F.col("c.start_line")) & (F.col("p_end") >= F.col("c.end_line"))
    found = c.join(p, at).groupBy(F.col("c.file_id").alias("file_id"), F.col("c.pos").alias("pos")).agg(F.max("p_pos").alias("parent_pos"))
    return symbols.join(found, ["file_id", "pos"], "left")


def sibling_position(nodes: DataFrame) -> DataFrame:
    """nodes with ``position``: from 0, among the nodes of one parent."""
    w = Window.partitionBy("file_id", "parent_pos").orderBy("pos")
    return nodes.withColumn("position", F.row_number().over(w) - 1)


def outline(nodes: DataFrame, depth: int | None = None) -> DataFrame:
    """(file_id, pos, depth, trail): the nodes, with their levels (from 1) and the positions on the way from the root; down to ``depth`` levels if one is given.

    A file's tree is folded in one pass: a parent comes before its children. Files are groups, so there is one shuffle whatever the depth.
    """
    kind = nodes.schema["file_id"].dataType.simpleString()

    def fold(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("pos", "parent_pos", "position")), strict=True))
        seen: dict[int, tuple[int, str]] = {}
        for pos, parent, position in rows:
            above = seen.get(parent) if parent is not None else None
            seen[pos] = (above[0] + 1, f"{above[1]}/{position:010d}") if above else (1, f"{position:010d}")
        kept = [(p, d, t) for p, (d, t) in seen.items() if depth is None or d <= depth]
        return pa.table({"file_id": pa.array([group.column("file_id")[0].as_py()] * len(kept), group.schema.field("file_id").type), "pos": pa.array([p for p, _, _ in kept], pa.int64()), "depth": pa.array([d for _, d, _ in kept], pa.int32()), "trail": pa.array([t for _, _, t in kept], pa.string())})

    return nodes.select("file_id", F.col("pos").cast("long").alias("pos"), F.col("parent_pos").cast("long").alias("parent_pos"), F.col("position").cast("long").alias("position")).groupBy("file_id").applyInArrow(fold, f"file_id {kind}, pos long, depth int, trail string")


def subtree(tree: DataFrame, node: DataFrame) -> DataFrame:
    """The rows of outline() at and below ``node`` (file_id, trail), found by the way from the root."""
    top = node.select("file_id", F.col("trail").alias("__top"))
    return tree.join(top, "file_id").where((F.col("trail") == F.col("__top")) | F.startswith("trail", F.concat("__top", F.lit("/")))).drop("__top")


def fresher(stored: DataFrame, now: DataFrame) -> DataFrame:
    """(path): outlines whose time now is later than the stored one, or that weren't stored; both have path and at."""
    old = stored.select("path", F.col("at").alias("__at"))
    return now.join(old, "path", "left").where(F.col("__at").isNull() | (F.col("at") > F.col("__at"))).select("path")


def heading_of_line(headings: DataFrame, lines: DataFrame) -> DataFrame:
    """lines with ``heading``: the last one at or before the line in its document; both have doc_id and line."""
    both = headings.select("doc_id", "line", F.col("heading").alias("__h"), F.lit(0).alias("__o")).unionByName(lines.select("doc_id", "line").withColumns({"__h": F.lit(None).cast("string"), "__o": F.lit(1)}))
    w = Window.partitionBy("doc_id").orderBy("line", "__o").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("heading", F.last("__h", ignorenulls=True).over(w)).where("__o = 1").select("doc_id", "line", "heading")
