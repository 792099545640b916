"""Queries of listings, single lookups, keys and what the views show of a row, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomdex.functions import scalars as S
from loomdex.functions import texts as T
from loomdex.operators import upserts as U
from loomdex.sources.tables import table


def catalog_scan(spark, d):
    """The catalog by name without case, each model with its place."""
    rows = table(spark, d, "embedding_models", "id", "display_name", "backend")
    return rows.select("id", T.joined_attributes((F.col("display_name"), "", ""), (F.col("backend"), "on ", "")).alias("label")).orderBy(F.lower("label"), "id")


def catalog_lookup(spark, d):
    """Each model id that chunks name, and whether the catalog has it."""
    used = table(spark, d, "chunks_new", "embedding_model_id").select(F.lower(F.trim("embedding_model_id")).alias("key")).where("key <> ''").distinct()
    catalog = table(spark, d, "embedding_models", "id").select(F.lower("id").alias("key"), "id")
    return used.join(catalog, "key", "left").select("key", F.col("id").isNotNull().alias("found"))


def catalog_upsert(spark, d):
    """The models that chunks name but the catalog lacks, added to it: a blank name is the id, a blank backend onnx; entries that are there stay."""
    catalog = table(spark, d, "embedding_models", "id", "display_name", "backend")
    used = table(spark, d, "chunks_new", "embedding_model_id").select(F.trim("embedding_model_id").alias("id")).where("id <> ''").distinct()
    new = used.join(catalog.select(F.lower("id").alias("k")), F.lower("id") == F.col("k"), "left_anti").select("id", F.lit(None).cast("string").alias("display_name"), F.lit("").alias("backend"))
    filled = new.select("id", F.coalesce(F.nullif(F.trim("display_name"), F.lit("")), "id").alias("display_name"), F.coalesce(F.nullif(F.trim("backend"), F.lit("")), F.lit("onnx")).alias("backend"))
    return U.upsert(catalog, filled, "id", ())


def value_lookup(spark, d):
    """For every user the latest value of each of two kinds of event, and whether there is one."""
    events = table(spark, d, "events", "event_id", "user_id", "event_type", "value")
    latest = U.last_writer(events, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "value")
    wanted = events.select("user_id").distinct().crossJoin(F.broadcast(spark.createDataFrame([("click",), ("refund",)], "event_type string")))  # two rows
    return wanted.join(latest, ["user_id", "event_type"], "left").select("user_id", "event_type", "value", F.col("value").isNotNull().alias("found"))


def resolved_keys(spark, d):
    """The key of every scanned path: a known file's own, and a placeholder for one that was never indexed."""
    files = table(spark, d, "files_new", "pk", "project_id", "path").select(F.concat_ws("|", "project_id", "path").alias("path"), F.col("pk").alias("file_id"))
    seen = table(spark, d, "file_previews", "project_id", "relative_path").where("project_id is not null and relative_path is not null").select(F.concat_ws("|", "project_id", S.normal_path(F.col("relative_path"))).alias("path"))
    keys = U.resolve_keys(seen, files)
    return keys.select("path", "placeholder", F.when(~F.col("placeholder"), F.col("file_id")).alias("pk"))


def watched_folders(spark, d):
    """Folders that a watcher enters: none that a pattern matches by its path or by its own name."""
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    rows = table(spark, d, "files_new", "project_id", "path").select("project_id", folder.alias("folder")).where("folder <> ''").distinct()
    return rows.where(~S.excluded(F.col("folder"), ["vendor", "ledger", "docs/*", "node_modules", ""], names=True))


def shaped_results(spark, d):
    """Chunks as the interface returns them: with a project, and no vector as an empty one."""
    rows = table(spark, d, "chunks_new", "id", "project_id", "embedding")
    shaped = rows.select("id", F.coalesce("project_id", F.lit("")).alias("project_id"), F.coalesce("embedding", F.array().cast("array<float>")).alias("embedding"))
    return shaped.select("id", "project_id", F.size("embedding").alias("n")).distinct()


def chunk_models(spark, d):
    """Chunks without a model take that of their project's settings."""
    chosen = table(spark, d, "project_meta", "id", "config_json").select(F.col("id").alias("project_id"), F.get_json_object("config_json", "$.embeddingModel").alias("chosen"))
    rows = table(spark, d, "chunks_new", "id", "project_id", "embedding_model_id").join(chosen, "project_id", "left")
    return rows.select("id", F.coalesce(F.nullif(F.trim("embedding_model_id"), F.lit("")), "chosen").alias("model")).distinct()


def tools_in_order(spark, d):
    """The kinds of event by name, with those that are switched off left out."""
    off = ["error"]
    return table(spark, d, "events", "event_type").where(~F.col("event_type").isin(off)).groupBy("event_type").agg(F.count("*").alias("calls")).orderBy("event_type")


def highlighted_lines(spark, d):
    """The lines of every chunk's source, with a flag for the first two."""
    rows = table(spark, d, "chunks_new", "id", "source_code", "line_start").where("source_code is not null").distinct()
    lines = rows.select("id", "line_start", F.posexplode(F.split("source_code", "\n")).alias("n", "text"))
    return lines.groupBy("id").agg(F.count("*").alias("n_lines"), F.sum((F.col("line_start") + F.col("n")).between(F.col("line_start"), F.col("line_start") + 1).cast("long")).alias("n_highlighted"))


def similarity_labels(spark, d):
    """Events' values as similarities and sizes, as the views write them."""
    rows = table(spark, d, "events", "event_id", "value")
    x = F.pmod(F.col("event_id"), F.lit(1001)) / 1000
    return rows.select("event_id", T.joined_attributes((S.similarity_percent(x), "", ""), (S.similarity_bucket(x), "", "")).alias("shown"), S.ui_megabytes(F.col("event_id") * 7919).alias("size"))


def line_offsets(spark, d):
    """The byte at which each chunk's first line begins in its file, and the line of that byte again."""
    sources = table(spark, d, "source_files", "file_id", "source").where("source is not null")
    lines = table(spark, d, "chunks_new", "file_id", "line_start").distinct()
    both = lines.join(sources, "file_id").select("file_id", "line_start", "source", T.byte_of_line(F.col("source"), F.col("line_start")).alias("at"))
    return both.where("at is not null").select("file_id", "line_start", "at", T.line_of_byte(F.col("source"), F.col("at")).alias("line"))


QUERIES = {f.__name__: f for f in (catalog_scan, catalog_lookup, catalog_upsert, value_lookup, resolved_keys, watched_folders, shaped_results, chunk_models, tools_in_order, highlighted_lines, similarity_labels, line_offsets)}
_NORMAL = r"regexp_replace(regexp_replace(replace(trim(relative_path), '\', '/'), '/(\./)*/*', '/', 'g'), '^(\./)+', '')"
SQL = {
    "catalog_scan": "SELECT id, concat_ws(' · ', nullif(display_name, ''), 'on ' || nullif(backend, '')) AS label FROM embedding_models ORDER BY lower(label), id",
    "catalog_lookup": "SELECT DISTINCT lower(trim(embedding_model_id)) AS key, EXISTS (SELECT 1 FROM embedding_models m WHERE lower(m.id) = lower(trim(c.embedding_model_id))) AS found FROM chunks_new c WHERE trim(embedding_model_id) <> ''",
    "catalog_upsert": "SELECT id, display_name, backend FROM embedding_models UNION ALL SELECT DISTINCT trim(embedding_model_id), trim(embedding_model_id), 'onnx' FROM chunks_new WHERE trim(embedding_model_id) <> '' AND lower(trim(embedding_model_id)) NOT IN (SELECT lower(id) FROM embedding_models)",
    "value_lookup": "SELECT u.user_id, t.event_type, l.value, l.value IS NOT NULL AS found FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (VALUES ('click'), ('refund')) t(event_type) LEFT JOIN (SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2) l ON l.user_id = u.user_id AND l.event_type = t.event_type",
    "resolved_keys": f"SELECT s.path, f.pk IS NULL AS placeholder, f.pk FROM (SELECT DISTINCT project_id || '|' || {_NORMAL} AS path FROM file_previews WHERE project_id IS NOT NULL AND relative_path IS NOT NULL) s LEFT JOIN files_new f ON f.project_id || '|' || f.path = s.path",
    "watched_folders": r"SELECT DISTINCT project_id, folder FROM (SELECT project_id, regexp_replace(path, '/?[^/]*$', '') AS folder FROM files_new) WHERE folder <> '' AND NOT regexp_matches('/' || folder || '/', '/(vendor|ledger|node_modules)/') AND NOT regexp_matches(folder, '^docs/[^/]+(/|$)')",
    "shaped_results": "SELECT DISTINCT id, coalesce(project_id, '') AS project_id, coalesce(len(embedding), 0)::INTEGER AS n FROM chunks_new",
    "chunk_models": "SELECT DISTINCT c.id, coalesce(nullif(trim(embedding_model_id), ''), m.config_json->>'embeddingModel') AS model FROM chunks_new c LEFT JOIN project_meta m ON m.id = c.project_id",
    "tools_in_order": "SELECT event_type, count(*) AS calls FROM events WHERE event_type <> 'error' GROUP BY 1 ORDER BY 1",
    "highlighted_lines": "SELECT id, len(l) AS n_lines, least(len(l), 2)::BIGINT AS n_highlighted FROM (SELECT DISTINCT id, line_start, string_split(source_code, chr(10)) AS l FROM chunks_new WHERE source_code IS NOT NULL)",
    "similarity_labels": """SELECT event_id, CASE WHEN k = 0 THEN 'N/A' ELSE (k // 10)::VARCHAR || '.' || (k % 10)::VARCHAR || '%' END || ' · ' || CASE WHEN k > 800 THEN 'high' WHEN k > 600 THEN 'medium' ELSE 'low' END AS shown,
        CASE WHEN n <= 0 THEN '' ELSE ((n * 20 + 1048576) // 2097152 // 10)::VARCHAR || '.' || ((n * 20 + 1048576) // 2097152 % 10)::VARCHAR || ' MB' END AS size FROM (SELECT event_id, event_id % 1001 AS k, event_id * 7919 AS n FROM events)""",
    "line_offsets": """SELECT file_id, line_start, (CASE WHEN line_start = 1 THEN 0 ELSE strlen(array_to_string(l[1:line_start - 1], chr(10))) + 1 END)::BIGINT AS at, line_start::BIGINT AS line FROM (SELECT DISTINCT c.file_id, c.line_start, string_split(s.source, chr(10)) AS l FROM chunks_new c JOIN source_files s ON s.file_id = c.file_id WHERE s.source IS NOT NULL) WHERE line_start BETWEEN 1 AND len(l)""",
}
