"""Queries of the index: joins, upserts, deduplication, outlines, set operations. Their SQL is beside them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomdex.functions import scalars as S
from loomdex.operators import symbols as Y
from loomdex.operators import upserts as U
from loomdex.sources.tables import table


def change_detection(spark, d):
    """The current scan against an earlier state, which lacks some files and has others' old hashes."""
    files = table(spark, d, "files_new", "pk", "path", "hash", "last_modified")
    known = files.where("pk % 7 <> 0").withColumn("hash", F.when(F.col("pk") % 11 == 0, "old").otherwise(F.col("hash")))
    return U.changed(files, known, "pk", "hash", "last_modified").select("pk", "state")


def dedupe_last_writer(spark, d):
    rows = table(spark, d, "chunks_new", "file_id", "line_start", "line_end", "id", "updated_at")
    return U.last_writer(rows, ["file_id", "line_start", "line_end"], "updated_at", "id").select("file_id", "line_start", "line_end", "id")


def dedupe_min_id(spark, d):
    rows = table(spark, d, "chunks_new", "file_id", "line_start", "line_end", "id")
    return U.least_id(rows, ["file_id", "line_start", "line_end"], "id").distinct()


def upsert_files(spark, d):
    files = table(spark, d, "files_new", "pk", "path", "hash", "created_at", "updated_at")
    new = files.where("pk % 3 = 0").withColumns({"pk": F.when(F.col("pk") % 2 == 0, F.col("pk")).otherwise(F.col("pk") + 100_000_000), "hash": F.lit("new"), "created_at": F.lit(9).cast("long"), "updated_at": F.lit(9).cast("long")})
    return U.upsert(files, new, "pk")


def stale_files(spark, d):
    """Indexed files that no scan has."""
    files = table(spark, d, "files_new", "pk", "project_id", "path")
    seen = table(spark, d, "file_previews", "project_id", "relative_path").where("relative_path is not null").select("project_id", S.normal_path(F.col("relative_path")).alias("path"))
    return U.stale(files, seen, ["project_id", "path"]).select("pk", "path")


def cascade_delete(spark, d):
    """What is left of each table if the files of the fullest project go."""
    files = table(spark, d, "files_new", "pk", "project_id", "path")
    top = files.groupBy("project_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "project_id").limit(1).select("project_id")
    gone = files.join(F.broadcast(top), "project_id").select("pk", "path")  # one project
    symbols, previews = _symbols(spark, d).select("file_id"), table(spark, d, "file_previews", "relative_path").where("relative_path is not null")
    tables = {"chunks": (table(spark, d, "chunks_new", "file_id"), "file_id", "pk"), "sources": (table(spark, d, "source_files", "file_id"), "file_id", "pk"), "files": (files, "pk", "pk"), "symbols": (symbols, "file_id", "pk"), "previews": (previews, "relative_path", "path")}
    left = {name: U.delete_by(df, gone, column, key) for name, (df, column, key) in tables.items()}
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in left.items()])


def config_overlay(spark, d):
    base = table(spark, d, "embedding_models", "id", "display_name", "max_sequence_length", "cpu_latency_ms")
    name = F.when(F.length("id") % 2 == 0, " ").otherwise(F.upper("display_name"))
    over = base.select("id", name.alias("display_name"), F.when(F.col("max_sequence_length") > 300, 0).otherwise(9).alias("max_sequence_length"), F.lit(0).alias("cpu_latency_ms"))
    return U.overlay(base, over, "id", ["display_name", "max_sequence_length", "cpu_latency_ms"], always=("cpu_latency_ms",))


def kv_upsert(spark, d):
    """A key-value table with later values over earlier ones."""
    events = table(spark, d, "events", "event_id", "user_id", "event_type", "value")
    return U.last_writer(events, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "value")


def _symbols(spark, d) -> DataFrame:
    """Symbols of the newest record of each file, with file and position."""
    path = F.regexp_replace(F.regexp_replace("file_path", r"\\", "/"), r"^(\./)+", "")
    rows = table(spark, d, "parse_results", "project_id", "file_path", "symbols", "parsed_at").where("file_path is not null").withColumn("path", path)
    newest = U.last_writer(rows, ["project_id", "path"], "parsed_at", "file_path")
    files = table(spark, d, "files_new", "pk", "project_id", "path")
    return newest.join(files, ["project_id", "path"]).select(F.col("pk").alias("file_id"), "path", F.posexplode("symbols").alias("pos", "s")).select("file_id", "path", F.col("pos").cast("long").alias("pos"), "s.name", "s.kind", F.coalesce("s.parent", F.lit("")).alias("parent"), "s.start_line", "s.end_line")


_SYMBOLS = r"""WITH newest AS (SELECT *, regexp_replace(replace(file_path, '\', '/'), '^(\./)+', '') AS path FROM parse_results WHERE file_path IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY project_id, regexp_replace(replace(file_path, '\', '/'), '^(\./)+', '') ORDER BY parsed_at DESC, file_path DESC) = 1),
  e AS (SELECT f.pk AS file_id, n.path, unnest(symbols) AS s, generate_subscripts(symbols, 1) - 1 AS pos FROM newest n JOIN files_new f ON f.project_id = n.project_id AND f.path = n.path),
  sym AS (SELECT file_id, path, pos, s.name AS name, s.kind AS kind, coalesce(s.parent, '') AS parent, s.start_line AS start_line, s.end_line AS end_line FROM e)"""


def chunk_symbol_links(spark, d):
    chunks = table(spark, d, "chunks_new", "id", "file_id", "line_start", "line_end").withColumnRenamed("id", "chunk_id")
    rows = _symbols(spark, d).select(F.concat_ws(":", "file_id", "pos").alias("symbol_id"), "file_id", F.col("start_line").alias("line"))
    return Y.chunk_symbols(chunks, rows)


def container_symbols(spark, d):
    """Files, taken as symbols over all their lines, and other symbols that strictly contain another symbol of their file; headings that are named as parents."""
    rows = _symbols(spark, d)
    whole = rows.groupBy("file_id", "path").agg(F.lit(-1).cast("long").alias("pos"), F.first("path").alias("name"), F.lit("file").alias("kind"), F.lit("").alias("parent"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))
    return Y.containers(rows.unionByName(whole), ("file", "class", "struct", "interface")).select("file_id", "pos")


def node_occurrence_ids(spark, d):
    return Y.node_ids(_symbols(spark, d)).select("file_id", "pos", "node_id")


def outline_parents(spark, d):
    return Y.sibling_position(Y.parents(_symbols(spark, d))).select("file_id", "pos", F.coalesce("parent_pos", F.lit(-1)).cast("long").alias("parent_pos"), F.col("position").cast("long").alias("position"))


def outline_tree(spark, d):
    """The whole tree of every file, of any depth."""
    return Y.outline(Y.sibling_position(Y.parents(_symbols(spark, d))))


def outline_depth(spark, d):
    """How many nodes of each file are within two levels, as a cut outline shows them."""
    return Y.outline(Y.sibling_position(Y.parents(_symbols(spark, d))), 2).groupBy("file_id").agg(F.count("*").alias("n"))


def outline_freshness(spark, d):
    """Files whose record was made after their row in the index was last written."""
    path = S.normal_path(F.col("file_path"))
    now = table(spark, d, "parse_results", "project_id", "file_path", "parsed_at").where("file_path is not null").groupBy(F.concat_ws("|", "project_id", path).alias("path")).agg(F.max(F.unix_timestamp("parsed_at")).alias("at"))
    stored = table(spark, d, "files_new", "project_id", "path", "updated_at").select(F.concat_ws("|", "project_id", "path").alias("path"), F.col("updated_at").alias("at"))
    return Y.fresher(stored, now)


def heading_of_lines(spark, d):
    rows = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    heads = rows.where(F.col("t").rlike("^#{1,6} ")).select("doc_id", "line", F.col("t").alias("heading"))
    lines = rows.where(F.col("t").contains("`")).select("doc_id", "line")
    return Y.heading_of_line(heads, lines).select("doc_id", F.col("line").cast("long").alias("line"), "heading")


def union_paths(spark, d):
    paths = [table(spark, d, t).select("project_id", F.col(c).alias("path")) for t, c in (("files_new", "path"), ("file_previews", "relative_path"), ("parse_results", "file_path"))]
    return paths[0].union(paths[1]).union(paths[2]).distinct()


def missing_paths(spark, d):
    seen = table(spark, d, "file_previews").select("project_id", F.col("relative_path").alias("path"))
    return seen.subtract(table(spark, d, "files_new", "project_id", "path"))


def path_set_difference(spark, d):
    a, b = table(spark, d, "files_new", "project_id", "path"), table(spark, d, "parse_results").select("project_id", F.col("file_path").alias("path"))
    return a.subtract(b).withColumn("side", F.lit("files")).union(b.subtract(a).withColumn("side", F.lit("records")))


def folder_tree(spark, d):
    """Every folder and file of the paths, with folders first."""
    parts = F.split("path", "/")
    rows = table(spark, d, "files_new", "project_id", "path").select("project_id", "path", parts.alias("parts"))
    each = rows.select("project_id", "path", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"), "parts")
    node = F.array_join(F.slice("parts", 1, F.col("depth")), "/")
    return each.select("project_id", node.alias("node"), F.col("depth").cast("long").alias("depth"), (F.col("depth") < F.size("parts")).alias("is_folder")).distinct()


def gap_lines(spark, d):
    """Runs of lines between consecutive chunks of a file that no chunk holds."""
    w = Window.partitionBy("file_id").orderBy("line_start", "line_end").rowsBetween(Window.unboundedPreceding, -1)
    rows = table(spark, d, "chunks_new", "file_id", "line_start", "line_end").distinct().withColumn("last", F.max("line_end").over(w))
    return rows.where(F.col("line_start") > F.coalesce("last", F.lit(0)) + 1).select("file_id", (F.coalesce("last", F.lit(0)) + 1).cast("long").alias("gap_start"), (F.col("line_start") - 1).cast("long").alias("gap_end"))


def file_chunks(spark, d):
    """Chunks with their files' paths, in order of lines; nulls as empty values."""
    c, f = table(spark, d, "chunks_new", "id", "file_id", "line_start", "symbol_name", "token_count", "is_collapsed"), table(spark, d, "files_new", "pk", "path")
    return c.join(f, c.file_id == f.pk).select("id", "path", "line_start", F.coalesce("symbol_name", F.lit("")).alias("symbol_name"), F.coalesce("token_count", F.lit(0)).alias("token_count"), F.coalesce("is_collapsed", F.lit(False)).alias("is_collapsed")).orderBy("path", "line_start", "id")


def newest_previews(spark, d):
    """The newest scan of each file, its path cleaned."""
    rows = table(spark, d, "file_previews", "project_id", "relative_path", "scanned_at", "last_modified").where("relative_path is not null").withColumn("path", S.normal_path(F.col("relative_path")))
    return rows.groupBy("project_id", "path").agg(F.unix_micros(F.max("scanned_at")).alias("scanned_us"), F.max_by("last_modified", "scanned_at").alias("last_modified"))


def snippet_source(spark, d):
    """A chunk's source, or its content where the source is null or blank, collapsed."""
    body = F.coalesce(F.when(F.trim("source_code") != "", F.col("source_code")), F.col("content"))
    return table(spark, d, "chunks_new", "id", "content", "source_code").select("id", F.md5(S.collapse_body(body)).alias("body")).distinct()


QUERIES = {f.__name__: f for f in (change_detection, dedupe_last_writer, dedupe_min_id, upsert_files, stale_files, cascade_delete, config_overlay, kv_upsert, chunk_symbol_links, container_symbols, node_occurrence_ids, outline_parents, outline_tree, outline_depth, outline_freshness, heading_of_lines, union_paths, missing_paths, path_set_difference, folder_tree, gap_lines, file_chunks, newest_previews, snippet_source)}
_NORMAL = r"regexp_replace(regexp_replace(replace(trim(relative_path), '\', '/'), '/(\./)*/*', '/', 'g'), '^(\./)+', '')"
_PARENTS = "par AS (SELECT c.file_id, c.pos, max(p.pos) AS parent_pos FROM sym c LEFT JOIN sym p ON p.file_id = c.file_id AND p.name = c.parent AND p.pos < c.pos AND p.start_line <= c.start_line AND p.end_line >= c.end_line GROUP BY 1, 2), nodes AS (SELECT *, row_number() OVER (PARTITION BY file_id, parent_pos ORDER BY pos) - 1 AS position FROM par)"
SQL = {
    "change_detection": "WITH k AS (SELECT pk, CASE WHEN pk % 11 = 0 THEN 'old' ELSE hash END AS hash, last_modified FROM files_new WHERE pk % 7 <> 0) SELECT f.pk, CASE WHEN k.pk IS NULL THEN 'new' WHEN f.hash IS NOT DISTINCT FROM k.hash AND f.last_modified IS NOT DISTINCT FROM k.last_modified THEN 'unchanged' ELSE 'changed' END AS state FROM files_new f LEFT JOIN k USING (pk)",
    "dedupe_last_writer": "SELECT file_id, line_start, line_end, id FROM chunks_new QUALIFY row_number() OVER (PARTITION BY file_id, line_start, line_end ORDER BY updated_at DESC, id DESC) = 1",
    "dedupe_min_id": "SELECT file_id, line_start, line_end, min(id) AS id FROM chunks_new GROUP BY ALL",
    "upsert_files": """WITH n AS (SELECT CASE WHEN pk % 2 = 0 THEN pk ELSE pk + 100000000 END AS pk, path, 'new' AS hash, 9::BIGINT AS created_at, 9::BIGINT AS updated_at FROM files_new WHERE pk % 3 = 0)
        SELECT coalesce(n.pk, o.pk) AS pk, coalesce(n.path, o.path) AS path, coalesce(n.hash, o.hash) AS hash, coalesce(o.created_at, n.created_at) AS created_at, coalesce(n.updated_at, o.updated_at) AS updated_at FROM files_new o FULL JOIN n ON n.pk = o.pk""",
    "stale_files": f"SELECT pk, path FROM files_new f WHERE NOT EXISTS (SELECT 1 FROM file_previews p WHERE p.project_id = f.project_id AND {_NORMAL} = f.path)",
    "cascade_delete": _SYMBOLS + """, top AS (SELECT project_id FROM files_new GROUP BY 1 ORDER BY count(*) DESC, project_id LIMIT 1), gone AS (SELECT pk, path FROM files_new WHERE project_id = (SELECT project_id FROM top))
        SELECT 'chunks' AS name, count(*) AS n FROM chunks_new WHERE file_id NOT IN (SELECT pk FROM gone) UNION ALL SELECT 'sources', count(*) FROM source_files WHERE file_id NOT IN (SELECT pk FROM gone) UNION ALL SELECT 'files', count(*) FROM files_new WHERE pk NOT IN (SELECT pk FROM gone)
        UNION ALL SELECT 'symbols', count(*) FROM sym WHERE file_id NOT IN (SELECT pk FROM gone) UNION ALL SELECT 'previews', count(*) FROM file_previews WHERE relative_path NOT IN (SELECT path FROM gone)""",
    "config_overlay": "SELECT id, CASE WHEN length(id) % 2 = 0 THEN display_name ELSE upper(display_name) END AS display_name, CASE WHEN max_sequence_length > 300 THEN max_sequence_length ELSE 9 END AS max_sequence_length, 0 AS cpu_latency_ms FROM embedding_models",
    "kv_upsert": "SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1",
    "chunk_symbol_links": _SYMBOLS + " SELECT DISTINCT c.id AS chunk_id, s.file_id || ':' || s.pos AS symbol_id FROM chunks_new c JOIN sym s ON s.file_id = c.file_id AND s.start_line BETWEEN c.line_start AND c.line_end",
    "container_symbols": _SYMBOLS + ", a AS (SELECT file_id, pos, kind, start_line, end_line FROM sym UNION ALL SELECT file_id, -1, 'file', min(start_line), max(end_line) FROM sym GROUP BY file_id) SELECT file_id, pos FROM a WHERE kind = 'heading' AND EXISTS (SELECT 1 FROM sym b WHERE b.file_id = a.file_id AND b.pos <> a.pos AND b.parent = (SELECT name FROM sym o WHERE o.file_id = a.file_id AND o.pos = a.pos) AND b.start_line >= a.start_line) OR kind IN ('file', 'class', 'struct', 'interface') AND EXISTS (SELECT 1 FROM a b WHERE b.file_id = a.file_id AND a.start_line <= b.start_line AND a.end_line >= b.end_line AND (a.start_line < b.start_line OR a.end_line > b.end_line))",
    "node_occurrence_ids": _SYMBOLS + " SELECT file_id, pos, concat_ws(':', path, start_line, end_line, name, row_number() OVER (PARTITION BY file_id, start_line, end_line, name ORDER BY pos) - 1) AS node_id FROM sym",
    "outline_parents": _SYMBOLS + ", " + _PARENTS + " SELECT file_id, pos, coalesce(parent_pos, -1) AS parent_pos, position FROM nodes",
    "outline_tree": _SYMBOLS.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _PARENTS + ", t AS (SELECT file_id, pos, 1::INTEGER AS depth, printf('%010d', position) AS trail FROM nodes WHERE parent_pos IS NULL UNION ALL SELECT n.file_id, n.pos, t.depth + 1, t.trail || '/' || printf('%010d', n.position) FROM nodes n JOIN t ON t.file_id = n.file_id AND t.pos = n.parent_pos) SELECT * FROM t",
    "outline_depth": _SYMBOLS.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _PARENTS + ", t AS (SELECT file_id, pos, 1 AS depth FROM nodes WHERE parent_pos IS NULL UNION ALL SELECT n.file_id, n.pos, t.depth + 1 FROM nodes n JOIN t ON t.file_id = n.file_id AND t.pos = n.parent_pos WHERE t.depth < 2) SELECT file_id, count(*) AS n FROM t GROUP BY 1",
    "outline_freshness": rf"SELECT n.path FROM (SELECT project_id || '|' || {_NORMAL.replace('relative_path', 'file_path')} AS path, max(epoch(parsed_at)::BIGINT) AS at FROM parse_results WHERE file_path IS NOT NULL GROUP BY 1) n LEFT JOIN files_new f ON f.project_id || '|' || f.path = n.path WHERE f.pk IS NULL OR n.at > f.updated_at",
    "heading_of_lines": "WITH r AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT - 1 AS line FROM documents) SELECT l.doc_id, l.line, (SELECT arg_max(h.t, h.line) FROM r h WHERE h.doc_id = l.doc_id AND h.line <= l.line AND regexp_matches(h.t, '^#{1,6} ')) AS heading FROM r l WHERE contains(l.t, '`')",
    "union_paths": "SELECT project_id, path FROM files_new UNION SELECT project_id, relative_path FROM file_previews UNION SELECT project_id, file_path FROM parse_results",
    "missing_paths": "SELECT project_id, relative_path AS path FROM file_previews EXCEPT SELECT project_id, path FROM files_new",
    "path_set_difference": "(SELECT *, 'files' AS side FROM (SELECT project_id, path FROM files_new EXCEPT SELECT project_id, file_path FROM parse_results)) UNION ALL (SELECT *, 'records' FROM (SELECT project_id, file_path AS path FROM parse_results EXCEPT SELECT project_id, path FROM files_new))",
    "folder_tree": "SELECT DISTINCT project_id, array_to_string(p[1:n], '/') AS node, n::BIGINT AS depth, n < len(p) AS is_folder FROM (SELECT project_id, p, unnest(range(1, len(p) + 1)) AS n FROM (SELECT project_id, string_split(path, '/') AS p FROM files_new))",
    "gap_lines": "SELECT file_id, (coalesce(last, 0) + 1)::BIGINT AS gap_start, (line_start - 1)::BIGINT AS gap_end FROM (SELECT *, max(line_end) OVER (PARTITION BY file_id ORDER BY line_start, line_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM (SELECT DISTINCT file_id, line_start, line_end FROM chunks_new)) WHERE line_start > coalesce(last, 0) + 1",
    "file_chunks": "SELECT c.id, f.path, line_start, coalesce(symbol_name, '') AS symbol_name, coalesce(token_count, 0) AS token_count, coalesce(is_collapsed, false) AS is_collapsed FROM chunks_new c JOIN files_new f ON f.pk = c.file_id ORDER BY path, line_start, c.id",
    "newest_previews": f"SELECT project_id, {_NORMAL} AS path, epoch_us(max(scanned_at)) AS scanned_us, arg_max(last_modified, scanned_at) AS last_modified FROM file_previews WHERE relative_path IS NOT NULL GROUP BY 1, 2",
    "snippet_source": f"SELECT DISTINCT id, md5(CASE WHEN len(l) > 120 THEN array_to_string(list_concat(list_concat(l[1:60], ['{S.COLLAPSED}']), l[-40:]), chr(10)) ELSE b END) AS body FROM (SELECT id, b, string_split(b, chr(10)) AS l FROM (SELECT id, CASE WHEN trim(source_code, ' ') <> '' THEN source_code ELSE content END AS b FROM chunks_new))",
}
