"""Queries of the projects, the model catalog and single lookups, with their SQL."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomdex.sources.tables import shared_folder, table
from loomdex.streaming.debounce import debounced


def model_attributes(spark, d):
    """A model's attributes in one line; those that are null or zero are left out."""
    part = lambda c, text: F.when(F.coalesce(F.col(c), F.lit(0)) != 0, text)
    text = F.concat_ws(" · ", part("dimension", F.concat("dimension", F.lit(" dims"))), part("cpu_latency_ms", F.concat(F.lit("~"), "cpu_latency_ms", F.lit(" ms"))), F.col("backend"))
    return table(spark, d, "embedding_models").select("id", text.alias("attributes"))


def model_selection(spark, d):
    """The model of each project: its own choice where the catalog has it, else the default; and whether its chunks were made with another."""
    c = F.from_json("config_json", "embeddingModel string")["embeddingModel"]
    catalog = table(spark, d, "embedding_models", "id").select(F.col("id").alias("model"))
    chosen = table(spark, d, "project_meta", "id", "config_json").select("id", F.trim(c).alias("choice"))
    picked = chosen.join(catalog, F.lower("choice") == F.lower("model"), "left").select("id", F.coalesce("model", F.lit("default")).alias("model"))
    used = table(spark, d, "chunks_new", "project_id", "embedding_model_id").where("trim(embedding_model_id) <> ''").groupBy("project_id", F.lower(F.trim("embedding_model_id")).alias("used")).agg(F.count("*").alias("n"))
    both = picked.join(used, F.col("id") == F.col("project_id"), "left")
    return both.groupBy("id", "model").agg(F.coalesce(F.sum(F.when(F.col("used") != F.lower("model"), F.col("n"))), F.lit(0)).alias("n_other"))


def config_validation(spark, d):
    """Which of the settings' rules a project breaks."""
    c = F.from_json("config_json", "chunkSizeMin int, chunkSizeMax int, includePaths array<string>, excludePatterns array<string>")
    rows = table(spark, d, "project_meta", "id", "name", "config_json").withColumn("c", c)
    broken = F.concat_ws(",", F.when(F.col("c.chunkSizeMin") < 10, "least"), F.when(F.col("c.chunkSizeMax") < F.col("c.chunkSizeMin"), "most"), F.when(F.trim("name") == "", "name"))
    default = F.array_sort("c.excludePatterns").eqNullSafe(F.array(F.lit("dist"), F.lit("node_modules")))
    return rows.select("id", broken.alias("broken"), default.alias("default_excludes"), F.size("c.includePaths").cast("long").alias("n_includes"))


def project_listing(spark, d):
    """Projects, newest first, with labels; a null description is empty."""
    rows = table(spark, d, "project_meta", "id", "name", "description", "created_at")
    label = F.when(F.trim("name") == "", F.col("id")).otherwise(F.concat("name", F.lit(" ("), "id", F.lit(")")))
    return rows.select("id", label.alias("label"), F.coalesce("description", F.lit("")).alias("description"), "created_at").orderBy(F.desc("created_at"), "id")


def update_projects(spark, d):
    """New values over old ones: blank ones keep the old, and only changed rows get a new time."""
    old = table(spark, d, "project_meta", "id", "name", "updated_at")
    new = old.select("id", F.when(F.length("id") % 3 == 0, " ").when(F.length("id") % 3 == 1, F.col("name")).otherwise(F.upper("name")).alias("new_name"))
    both = old.join(new, "id").withColumn("kept", F.coalesce(F.when(F.trim("new_name") != "", F.col("new_name")), F.col("name")))
    return both.select("id", F.col("kept").alias("name"), F.when(F.col("kept") == F.col("name"), F.col("updated_at")).otherwise(F.lit(1735800000)).alias("updated_at"))


def chunk_by_id(spark, d):
    """The first chunk by id, with its file's path: a point lookup, its filter pushed to the scan."""
    chunks = table(spark, d, "chunks_new", "id", "file_id", "symbol_name", "line_start")
    first = chunks.agg(F.min("id").alias("i")).head()["i"]
    return chunks.where(F.col("id") == first).join(table(spark, d, "files_new", "pk", "path"), F.col("file_id") == F.col("pk")).select("id", "path", F.coalesce("symbol_name", F.lit("")).alias("symbol_name"), "line_start").distinct()


def reselect_chunks(spark, d):
    """After a refresh, the chunk to show for each earlier one: that of the same id, else of the same first line, else the file's first."""
    rows = table(spark, d, "chunks_new", "id", "file_id", "line_start").distinct()
    now = rows.where(F.ascii(F.substring("id", -1, 1)) % 3 != 0)
    first = now.groupBy("file_id").agg(F.min_by("id", F.struct("line_start", "id")).alias("first"))
    by_line = now.groupBy("file_id", "line_start").agg(F.min("id").alias("by_line"))
    found = rows.join(now.select("id", F.lit(True).alias("same")), "id", "left").join(by_line, ["file_id", "line_start"], "left").join(first, "file_id", "left")
    return found.select("id", F.coalesce(F.when(F.col("same"), F.col("id")), "by_line", "first").alias("shown"))


def section_ranges(spark, d):
    """Each heading's section: to the line before the next heading of its level or above, or the text's end."""
    lines = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.size(F.split("text", "\n")).alias("n"), F.posexplode(F.split("text", "\n")).alias("line", "t"))
    heads = lines.where(F.col("t").rlike(r"^#{1,6} ")).select("doc_id", "n", (F.col("line") + 1).alias("line"), F.length(F.regexp_extract("t", "^#+", 0)).alias("level"))
    a, b = heads.alias("a"), heads.alias("b")
    ends = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("b.line") > F.col("a.line")) & (F.col("b.level") <= F.col("a.level")), "left")
    return ends.groupBy("a.doc_id", "a.line", "a.n").agg(F.min("b.line").alias("next")).select("doc_id", F.col("line").cast("long").alias("line"), F.coalesce(F.col("next") - 1, F.col("n")).cast("long").alias("last_line"))


def byte_lines(spark, d):
    """The line on which the byte at a third of a text lies, and the byte at which its third line begins."""
    rows = table(spark, d, "source_files", "file_id", "source").where("octet_length(source) > 0").withColumn("bytes", F.encode("source", "UTF-8"))
    at = F.floor(F.length("bytes") / 3).cast("int")
    line = F.size(F.split(F.decode(F.substring("bytes", F.lit(1), at), "ISO-8859-1"), "\n"))
    third = F.aggregate(F.slice(F.split("source", "\n"), 1, 2), F.lit(0), lambda s, x: s + F.octet_length(x) + 1)
    return rows.select("file_id", line.cast("long").alias("line"), F.when(F.size(F.split("source", "\n")) > 2, third).cast("long").alias("third"))


def progress(spark, d):
    """How far indexing is in each project: files with a known hash of all."""
    rows = table(spark, d, "files_new", "project_id", "hash").groupBy("project_id").agg(F.count("*").alias("total"), F.sum((F.col("hash") != "unknown").cast("long")).alias("done"))
    return rows.select("project_id", "total", "done", F.floor(F.col("done") * 100 / F.col("total") + 0.5).cast("long").alias("percent"))


def file_order(spark, d):
    """The entries of each project's top folder: folders first, then by name without case."""
    path = F.col("path")
    rows = table(spark, d, "files_new", "project_id", "path").select("project_id", F.substring_index(path, "/", 1).alias("name"), path.contains("/").alias("is_folder")).distinct()
    w = Window.partitionBy("project_id").orderBy(F.desc("is_folder"), F.lower("name"), "name")
    return rows.select("project_id", "name", "is_folder", F.row_number().over(w).cast("long").alias("position"))


def markdown_chunk_links(spark, d):
    """Chunks that hold links to other files, from the exact and the external ones apart."""
    links = F.regexp_extract_all("source_code", F.lit(r"\]\(([^)\s]+)\)"), F.lit(1))
    rows = table(spark, d, "chunks_new", "id", "source_code").select("id", links.alias("links")).where(F.size("links") > 0)
    outside = F.filter("links", lambda x: F.rlike(x, F.lit("^https?://")))
    return rows.select("id", F.size(outside).cast("long").alias("n_external"), (F.size("links") - F.size(outside)).cast("long").alias("n_local")).distinct()


def stream_debounce(spark, d):
    """The debounced write events of a stream that has come to its end; runs still open at the watermark aren't given yet.

    The events are read as a stream, all that is there, and each run is given once.
    """
    source = f"{d}/events.parquet"
    schema = spark.read.parquet(source).schema
    at = F.col("ts").cast("timestamp")  # watermarks need an instant
    stream = spark.readStream.schema(schema).parquet(source if os.path.isdir(source) else source + "*").where(F.col("event_type").isin("click", "purchase")).withColumn("ts", at)
    runs = debounced(stream, "user_id", "ts", "1 hour", "10 minutes")
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = runs.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", out + "-state").trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.schema(runs.schema).parquet(out)
    return found.select("user_id", *(F.col(c).cast(schema["ts"].dataType).alias(c) for c in ("first_event", "last_event")), "n_events")


QUERIES = {f.__name__: f for f in (model_attributes, model_selection, config_validation, project_listing, update_projects, chunk_by_id, reselect_chunks, section_ranges, byte_lines, progress, file_order, markdown_chunk_links, stream_debounce)}
SQL = {
    "model_attributes": "SELECT id, concat_ws(' · ', CASE WHEN coalesce(dimension, 0) <> 0 THEN dimension || ' dims' END, CASE WHEN coalesce(cpu_latency_ms, 0) <> 0 THEN '~' || cpu_latency_ms || ' ms' END, backend) AS attributes FROM embedding_models",
    "model_selection": """WITH p AS (SELECT m.id, coalesce(e.id, 'default') AS model FROM project_meta m LEFT JOIN embedding_models e ON lower(e.id) = lower(trim(m.config_json->>'embeddingModel'))),
        u AS (SELECT project_id, lower(trim(embedding_model_id)) AS used, count(*) AS n FROM chunks_new WHERE trim(embedding_model_id) <> '' GROUP BY 1, 2)
        SELECT p.id, p.model, coalesce(sum(CASE WHEN used <> lower(model) THEN n END), 0)::BIGINT AS n_other FROM p LEFT JOIN u ON u.project_id = p.id GROUP BY 1, 2""",
    "config_validation": """SELECT id, concat_ws(',', CASE WHEN (config_json->>'chunkSizeMin')::INT < 10 THEN 'least' END, CASE WHEN (config_json->>'chunkSizeMax')::INT < (config_json->>'chunkSizeMin')::INT THEN 'most' END, CASE WHEN trim(name) = '' THEN 'name' END) AS broken,
        list_sort(from_json(config_json->'excludePatterns', '["VARCHAR"]')) IS NOT DISTINCT FROM ['dist', 'node_modules'] AS default_excludes, json_array_length(config_json->'includePaths')::BIGINT AS n_includes FROM project_meta""",
    "project_listing": "SELECT id, CASE WHEN trim(name) = '' THEN id ELSE name || ' (' || id || ')' END AS label, coalesce(description, '') AS description, created_at FROM project_meta ORDER BY created_at DESC, id",
    "update_projects": "SELECT id, k AS name, CASE WHEN k = name THEN updated_at ELSE 1735800000 END AS updated_at FROM (SELECT *, CASE WHEN length(id) % 3 = 2 THEN upper(name) ELSE name END AS k FROM project_meta)",
    "chunk_by_id": "SELECT DISTINCT c.id, f.path, coalesce(symbol_name, '') AS symbol_name, line_start FROM chunks_new c JOIN files_new f ON f.pk = c.file_id WHERE c.id = (SELECT min(id) FROM chunks_new)",
    "reselect_chunks": """WITH r AS (SELECT DISTINCT id, file_id, line_start FROM chunks_new), n AS (SELECT * FROM r WHERE ascii(id[-1:]) % 3 <> 0)
        SELECT r.id, coalesce((SELECT max(n.id) FROM n WHERE n.id = r.id), (SELECT min(n.id) FROM n WHERE n.file_id = r.file_id AND n.line_start = r.line_start), (SELECT arg_min(n.id, (n.line_start, n.id)) FROM n WHERE n.file_id = r.file_id)) AS shown FROM r""",
    "byte_lines": """SELECT file_id, (len(string_split(decode(encode(source)[1:strlen(source) // 3], 'replace'), chr(10))))::BIGINT AS line, CASE WHEN len(l) > 2 THEN strlen(l[1]) + strlen(l[2]) + 2 END::BIGINT AS third FROM (SELECT *, string_split(source, chr(10)) AS l FROM source_files WHERE strlen(source) > 0)""",
    "section_ranges": r"""WITH h AS (SELECT doc_id, n, line, length(regexp_extract(t, '^#+')) AS level FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) WHERE regexp_matches(t, '^#{1,6} '))
        SELECT a.doc_id, a.line::BIGINT AS line, coalesce(min(b.line) - 1, a.n)::BIGINT AS last_line FROM h a LEFT JOIN h b ON b.doc_id = a.doc_id AND b.line > a.line AND b.level <= a.level GROUP BY a.doc_id, a.line, a.n""",
    "progress": "SELECT project_id, count(*) AS total, sum(CASE WHEN hash <> 'unknown' THEN 1 ELSE 0 END)::BIGINT AS done, floor(sum(CASE WHEN hash <> 'unknown' THEN 1 ELSE 0 END) * 100 / count(*) + 0.5)::BIGINT AS percent FROM files_new GROUP BY 1",
    "file_order": "SELECT project_id, name, is_folder, row_number() OVER (PARTITION BY project_id ORDER BY is_folder DESC, lower(name), name) AS position FROM (SELECT DISTINCT project_id, split_part(path, '/', 1) AS name, contains(path, '/') AS is_folder FROM files_new)",
    "markdown_chunk_links": r"""SELECT DISTINCT id, len(list_filter(l, lambda x: regexp_matches(x, '^https?://')))::BIGINT AS n_external, (len(l) - len(list_filter(l, lambda x: regexp_matches(x, '^https?://'))))::BIGINT AS n_local FROM (SELECT id, regexp_extract_all(source_code, '\]\(([^)\s]+)\)', 1) AS l FROM chunks_new) WHERE len(l) > 0""",
    "stream_debounce": """WITH w AS (SELECT * FROM events WHERE event_type IN ('click', 'purchase')), e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER x IS NULL OR ts - lag(ts) OVER x > INTERVAL 1 HOUR THEN 1 ELSE 0 END AS b FROM w WINDOW x AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts, b DESC ROWS UNBOUNDED PRECEDING) AS g FROM e) SELECT user_id, min(ts) AS first_event, max(ts) AS last_event, count(*) AS n_events FROM s GROUP BY user_id, g HAVING max(ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM w) - INTERVAL 10 MINUTE""",
}
