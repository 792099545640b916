"""Queries of the scalar functions over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomdex.functions import scalars as S
from loomdex.functions import texts as T
from loomdex.sources.tables import table

NOW = 1735800000  # a fixed "now", so that results can be compared


def content_hash(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", S.content_hash(F.col("text")).alias("hash"))


def token_estimate(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", S.token_estimate(F.col("text")).alias("tokens"))


def slugify(spark, d):
    return table(spark, d, "part", "p_partkey", "p_name", "p_type").select("p_partkey", S.slug(F.concat("p_name", F.lit(" _"), "p_type", F.lit("__2.0 "))).alias("slug"))


def ui_slugify(spark, d):
    """The slug of every line of every text."""
    lines = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return lines.select("doc_id", F.col("line").cast("long").alias("line"), S.ui_slug(F.col("text")).alias("slug"))


def format_bytes(spark, d):
    return table(spark, d, "orders", "o_orderkey", "o_totalprice").select("o_orderkey", S.format_bytes(F.floor("o_totalprice") * F.element_at(F.array(*[F.lit(1024**k) for k in range(5)]), (F.col("o_orderkey") % 5 + 1).cast("int")) * (F.col("o_orderkey") % 9)).alias("size"))


def number_suffix(spark, d):
    n = F.floor(F.col("o_totalprice") * (F.col("o_orderkey") % 13)).cast("long")
    return table(spark, d, "orders", "o_orderkey", "o_totalprice").select("o_orderkey", S.number_suffix(n).alias("n"), S.token_suffix(F.col("o_orderkey") % 5000).alias("tokens"))


def dates_and_uptime(spark, d):
    rows = table(spark, d, "files_new", "pk", "updated_at", "last_modified")
    return rows.select("pk", S.relative_date(F.col("updated_at"), F.lit(NOW)).alias("updated"), S.relative_date(F.col("last_modified"), F.lit(NOW)).alias("modified"), S.uptime(F.pmod("updated_at", F.lit(9000))).alias("uptime"))


def extension_language(spark, d):
    path = F.col("path")
    return table(spark, d, "files_new", "pk", "path").select("pk", S.extension(path).alias("extension"), S.language(path).alias("language"), S.supported(path).alias("supported"))


def normalize_paths(spark, d):
    rows = table(spark, d, "file_previews", "project_id", "relative_path").where("relative_path is not null")
    sibling = S.normal_path(F.concat("relative_path", F.lit("/.././x/../z")))
    return rows.select("project_id", "relative_path", S.normal_path(F.col("relative_path")).alias("path"), sibling.alias("sibling")).distinct()


def relative_paths(spark, d):
    root, path = F.concat(F.lit("/srv/code/"), "project_id"), F.col("absolute_path")
    return table(spark, d, "file_previews", "project_id", "absolute_path").where("absolute_path is not null and project_id is not null").select("project_id", "absolute_path", S.within(root, path).alias("inside"), S.relative_path(root, path).alias("relative")).distinct()


def model_folders(spark, d):
    return table(spark, d, "embedding_models", "id", "display_name", "backend").select("id", S.model_folder(F.concat(F.lit(" "), "backend", F.lit("/../"), "display_name", F.lit("\\v1 "))).alias("folder"))


def visibility(spark, d):
    seen = T.visibility(F.col("language"), F.col("symbol_name"), F.col("source_code"))
    return table(spark, d, "chunks_new", "id", "language", "symbol_name", "source_code").where("symbol_name is not null").select("id", seen.alias("visibility")).distinct()


def enriched_content(spark, d):
    chunks = table(spark, d, "chunks_new", "id", "file_id", "language", "symbol_name", "doc_string", "source_code").where("source_code is not null")
    files = table(spark, d, "files_new", "pk", "path")
    text = S.enriched_content(F.col("path"), F.col("language"), F.array().cast("array<struct<name:string,kind:string>>"), F.col("symbol_name"), F.col("doc_string"), F.col("source_code"))
    return chunks.join(files, F.col("file_id") == F.col("pk")).select("id", F.sha2(text, 256).alias("hash"), F.octet_length(text).cast("long").alias("bytes")).distinct()


def strip_comments(spark, d):
    return table(spark, d, "source_files", "file_id", "source").where("source is not null").select("file_id", F.md5(S.strip_comment_lines(F.col("source"))).alias("code"))


def semantic_groups(spark, d):
    return table(spark, d, "chunks_new", "symbol_kind").groupBy(S.semantic_group(F.col("symbol_kind")).alias("semantic_group")).agg(F.count("*").alias("n"))


def markdown_links(spark, d):
    links = T.link_targets(F.col("source"))
    return table(spark, d, "source_files", "file_id", "source").select("file_id", F.explode(links).alias("target")).groupBy("file_id", "target").agg(F.count("*").alias("n")).withColumn("external", T.external(F.col("target")))


def headings(spark, d):
    lines = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).where(F.col("text").rlike(r"^#{1,6} +\S"))
    return lines.select("doc_id", (F.col("line") + 1).cast("long").alias("line"), T.heading_level(F.col("text")).alias("level"), T.heading_text(F.col("text")).alias("heading"))


def collapse_body(spark, d):
    return table(spark, d, "source_files", "file_id", "source").where("source is not null").select("file_id", F.md5(S.collapse_body(F.col("source"))).alias("body"))


def line_slices(spark, d):
    return table(spark, d, "source_files", "file_id", "source").where("source is not null").select("file_id", S.line_slice(F.col("source"), 3, 7).alias("lines"))


def line_counts(spark, d):
    return table(spark, d, "chunks_new", "id", "line_start", "line_end").select("id", (F.col("line_end") - F.col("line_start") + 1).cast("long").alias("n_lines")).distinct()


def project_ids(spark, d):
    return table(spark, d, "project_meta", "id").select("id", T.id_of_url(F.concat(F.lit("/mcp/"), "id", F.lit("/tools"))).alias("from_url"), T.id_of_file(F.concat(F.lit("project-"), "id", F.lit(".db"))).alias("from_file"))


def visible_files(spark, d):
    """Scan filters: not hidden, not excluded, an allowed extension, each path once."""
    rows = table(spark, d, "files_new", "project_id", "path")
    keep = ~S.hidden(F.col("path")) & ~S.excluded(F.col("path"), ["node_modules", "*/vendor", "src/*/ledger", "docs"]) & F.regexp_extract("path", r"\.[^./]*$", 0).isin(".go", ".py", ".ts")
    return rows.where(keep).dropDuplicates(["project_id", "path"])


QUERIES = {f.__name__: f for f in (content_hash, token_estimate, slugify, ui_slugify, format_bytes, number_suffix, dates_and_uptime, extension_language, normalize_paths, relative_paths, model_folders, visibility, enriched_content, strip_comments, semantic_groups, markdown_links, headings, collapse_body, line_slices, line_counts, project_ids, visible_files)}
_T = lambda n, u, even: f"(({n}) * 10 // {u}) + CASE WHEN (({n}) * 10 % {u}) * 2 > {u} OR (({n}) * 10 % {u}) * 2 = {u} AND {'((' + n + ') * 10 // ' + str(u) + ') % 2 = 1' if even else 'true'} THEN 1 ELSE 0 END"
_F = lambda n, u, even: f"(({_T(n, u, even)}) // 10)::VARCHAR || '.' || (({_T(n, u, even)}) % 10)::VARCHAR"
SQL = {
    "content_hash": "SELECT doc_id, sha256(text) AS hash FROM documents",
    "token_estimate": "SELECT doc_id, (coalesce(strlen(text), 0) // 4)::BIGINT AS tokens FROM documents",
    "slugify": "SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' _' || p_type || '__2.0 '), '[ _]', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '-') AS slug FROM part",
    "ui_slugify": r"SELECT doc_id, line, trim(regexp_replace(regexp_replace(regexp_replace(lower(t), '[\s_]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '-') AS slug FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT - 1 AS line FROM documents)",
    "format_bytes": "SELECT o_orderkey, CASE WHEN n < 1024 THEN n::VARCHAR || ' B' " + " ".join(f"WHEN n < {1024 ** (k + 1)}::HUGEINT THEN {_F('n', f'{1024**k}::HUGEINT', True)} || ' {u}'" for k, u in enumerate(("KB", "MB", "GB", "TB", "PB"), 1))
    + f" ELSE {_F('n', f'{1024**6}::HUGEINT', True)} || ' EB' END AS size FROM (SELECT o_orderkey, floor(o_totalprice)::HUGEINT * [1, 1024, 1048576, 1073741824, 1099511627776][o_orderkey % 5 + 1] * (o_orderkey % 9) AS n FROM orders)",
    "number_suffix": f"""SELECT o_orderkey, CASE WHEN n >= 1000000 THEN {_F('n', 1000000, False)} || 'M' WHEN n >= 1000 THEN {_F('n', 1000, False)} || 'K' ELSE n::VARCHAR END AS n,
        CASE WHEN t = 0 THEN '' WHEN t < 1000 THEN t::VARCHAR || 't' ELSE {_F('t', 1000, False)} || 'kt' END AS tokens FROM (SELECT o_orderkey, floor(o_totalprice * (o_orderkey % 13))::BIGINT AS n, o_orderkey % 5000 AS t FROM orders)""",
    "dates_and_uptime": f"""WITH r AS (SELECT pk, updated_at AS u, last_modified AS m, updated_at % 9000 AS s FROM files_new)
        SELECT pk, {{u}} AS updated, {{m}} AS modified, CASE WHEN s = 0 THEN 'Not running' WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm ' || (s % 60) || 's' WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS uptime FROM r""".format(
        **{c: f"CASE WHEN coalesce({c}, 0) = 0 THEN 'Never' WHEN {NOW} - {c} < 60 THEN 'just now' WHEN {NOW} - {c} < 3600 THEN (({NOW} - {c}) // 60) || 'm ago' WHEN {NOW} - {c} < 86400 THEN (({NOW} - {c}) // 3600) || 'h ago' WHEN {NOW} - {c} < 604800 THEN (({NOW} - {c}) // 86400) || 'd ago' ELSE strftime(make_timestamp({c} * 1000000), '%Y-%m-%d %H:%M:%S') END" for c in "um"}
    ),
    "extension_language": r"""SELECT pk, e AS extension, coalesce(CASE e """ + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in S.LANGUAGES.items()) + r""" END, 'unknown') AS language, e IN (""" + ", ".join(f"'{e}'" for e in S.SUPPORTED) + r""") AS supported
        FROM (SELECT pk, lower(regexp_extract(path, '\.[^./]*$')) AS e FROM files_new)""",
    "normalize_paths": r"""SELECT *, regexp_replace(path, '[^/]*$', '') || 'z' AS sibling FROM (SELECT DISTINCT project_id, relative_path, regexp_replace(regexp_replace(replace(trim(relative_path), '\', '/'), '/(\./)*/*', '/', 'g'), '^(\./)+', '') AS path FROM file_previews WHERE relative_path IS NOT NULL)""",
    "relative_paths": """SELECT DISTINCT project_id, absolute_path, absolute_path = r OR starts_with(absolute_path, r || '/') AS inside, CASE WHEN absolute_path = r THEN '.' WHEN starts_with(absolute_path, r || '/') THEN substr(absolute_path, length(r) + 2) END AS relative
        FROM (SELECT *, '/srv/code/' || project_id AS r FROM file_previews WHERE absolute_path IS NOT NULL AND project_id IS NOT NULL)""",
    "model_folders": r"""SELECT id, replace(replace(replace(trim(' ' || backend || '/../' || display_name || '\v1 '), '..', ''), '/', '-'), '\', '-') AS folder FROM embedding_models""",
    "visibility": r"""SELECT DISTINCT id, CASE WHEN language = 'go' THEN CASE WHEN regexp_matches(symbol_name, '^[A-Z]') THEN 'public' ELSE 'private' END WHEN language = 'python' THEN CASE WHEN starts_with(symbol_name, '__') THEN 'private' WHEN starts_with(symbol_name, '_') THEN 'protected' ELSE 'public' END WHEN language = 'typescript' THEN coalesce(nullif(regexp_extract(source_code, '^\s*(?:(?:static|async|override|readonly|abstract)\s+)*(public|private|protected)\b', 1), ''), 'public') ELSE 'public' END AS visibility
        FROM chunks_new WHERE symbol_name IS NOT NULL""",
    "enriched_content": """SELECT DISTINCT id, sha256(t) AS hash, strlen(t)::BIGINT AS bytes FROM (SELECT c.id, '# File: ' || path || ' (' || coalesce(language, '') || ')' || chr(10) || CASE WHEN coalesce(symbol_name, '') <> '' THEN '# Symbol: ' || symbol_name || chr(10) ELSE '' END || chr(10)
        || CASE WHEN coalesce(doc_string, '') <> '' THEN array_to_string(list_transform(string_split(doc_string, chr(10)), lambda x: '// ' || trim(x, ' ')), chr(10)) || chr(10) || chr(10) ELSE '' END || source_code AS t FROM chunks_new c JOIN files_new f ON f.pk = c.file_id WHERE source_code IS NOT NULL)""",
    "strip_comments": r"""SELECT file_id, md5(array_to_string(list_filter(string_split(source, chr(10)), lambda x: NOT regexp_matches(x, '^\s*($|//|#|/\*|<!--)')), chr(10))) AS code FROM source_files WHERE source IS NOT NULL""",
    "semantic_groups": "SELECT CASE WHEN symbol_kind = 'element' THEN 'template' WHEN symbol_kind IN ('style', 'rule', 'media', 'keyframes') THEN 'style' ELSE 'code' END AS semantic_group, count(*) AS n FROM chunks_new GROUP BY 1",
    "markdown_links": r"""SELECT file_id, target, count(*) AS n, regexp_matches(target, '^https?://') AS external FROM (SELECT file_id, unnest(regexp_extract_all(source, '\[([^\]]+)\]\(([^)]+)\)', 2)) AS target FROM source_files) GROUP BY 1, 2""",
    "headings": r"""SELECT doc_id, line, length(regexp_extract(text, '^#+'))::BIGINT AS level, trim(regexp_replace(regexp_replace(text, '^#+\s*', ''), '\s+#+\s*$', ''), ' ') AS heading FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS line FROM documents) WHERE regexp_matches(text, '^#{1,6} +\S')""",
    "collapse_body": f"""SELECT file_id, md5(CASE WHEN len(l) > 120 THEN array_to_string(list_concat(list_concat(l[1:60], ['{S.COLLAPSED}']), l[-40:]), chr(10)) ELSE source END) AS body FROM (SELECT file_id, source, string_split(source, chr(10)) AS l FROM source_files WHERE source IS NOT NULL)""",
    "line_slices": "SELECT file_id, array_to_string(string_split(source, chr(10))[3:7], chr(10)) AS lines FROM source_files WHERE source IS NOT NULL",
    "line_counts": "SELECT DISTINCT id, (line_end - line_start + 1)::BIGINT AS n_lines FROM chunks_new",
    "project_ids": "SELECT id, id AS from_url, id AS from_file FROM project_meta",
    "visible_files": r"""SELECT DISTINCT project_id, path FROM files_new WHERE NOT regexp_matches(path, '(^|/)\.[^/]') AND NOT regexp_matches(path, '^(node_modules|[^/]*/vendor|src/[^/]*/ledger|docs)(/|$)') AND regexp_extract(path, '\.[^./]*$') IN ('.go', '.py', '.ts')""",
}
