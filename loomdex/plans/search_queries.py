"""Queries of vector search, chunking, debouncing and statistics, with their SQL."""

from __future__ import annotations


from pyspark.sql import functions as F

from loomdex.functions import scalars as S
from loomdex.operators.chunking import line_chunks as fold_lines
from loomdex.operators.search import latest_vectors, top_k
from loomdex.sources.tables import table
from loomdex.streaming.debounce import debounced


def _query(spark, d) -> list[float]:
    return list(table(spark, d, "embeddings", "vec_id", "embedding").where("vec_id = 0").select("embedding").head()[0])


def search_topk(spark, d):
    found = top_k(table(spark, d, "embeddings", "vec_id", "embedding"), _query(spark, d), 10, "vec_id")
    return found.select("vec_id", F.round("similarity", 9).alias("similarity"))


def search_dim_mismatch(spark, d):
    """Shortened vectors score 0 and stay; empty ones are skipped."""
    v = F.when(F.col("vec_id") % 5 == 1, F.slice("embedding", 1, 32)).when(F.col("vec_id") % 5 == 2, F.slice("embedding", 1, 0)).otherwise(F.col("embedding"))
    rows = table(spark, d, "embeddings", "vec_id", "embedding").withColumn("embedding", v)
    q = F.array(*map(F.lit, _query(spark, d)))
    return rows.where(F.size("embedding") > 0).select("vec_id", F.round(S.cosine(F.col("embedding"), q), 9).alias("similarity"))


def search_chunks(spark, d):
    """The chunks most similar to a given one, each id once, with their wide columns."""
    rows = table(spark, d, "chunks_new", "id", "embedding", "language", "symbol_name", "updated_at")
    usable = rows.where(F.size("embedding") == 64)
    q = usable.orderBy("id", F.desc("updated_at")).limit(1).select("embedding").head()
    best = top_k(latest_vectors(usable), list(q[0]), 8, distinct=True)
    wide = rows.drop("embedding", "updated_at").join(F.broadcast(best), "id").distinct()  # k rows
    return wide.select("id", "language", "symbol_name", F.round("similarity", 9).alias("similarity"))


def vector_l2_normalize(spark, d):
    return table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", F.posexplode(S.l2_normal(F.col("embedding"))).alias("n", "x")).select("vec_id", F.col("n").cast("long").alias("n"), F.round("x", 9).alias("x"))


def similarity_buckets(spark, d):
    q = F.array(*map(F.lit, _query(spark, d)))
    return table(spark, d, "embeddings", "embedding").select(S.similarity_bucket(S.cosine(F.col("embedding"), q)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def line_chunks(spark, d):
    rows = fold_lines(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")
    return rows.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.md5("content").alias("content"), *(F.col(c).cast("long").alias(c) for c in ("line_start", "line_end", "char_start", "char_end")))


def debounce_sessions(spark, d):
    """Runs of write events of a user with gaps of at most an hour."""
    events = table(spark, d, "events", "user_id", "ts", "event_type").where(F.col("event_type").isin("click", "purchase"))
    return debounced(events, "user_id", "ts", "1 hour").select("user_id", "first_event", "last_event", "n_events")


def event_windows(spark, d):
    """Tumbling hourly counts; the same expression runs on a stream with a watermark."""
    return table(spark, d, "events", "ts", "event_type", "value").groupBy(F.window("ts", "1 hour")["start"].alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def project_stats(spark, d):
    """Files, chunks, bytes and the last change of each project."""
    files = table(spark, d, "files_new", "pk", "project_id", "updated_at").groupBy("project_id").agg(F.count("*").alias("n_files"), F.max("updated_at").alias("last_indexed"))
    chunks = table(spark, d, "chunks_new", "project_id", "content").groupBy("project_id").agg(F.count("*").alias("n_chunks"), F.sum(F.octet_length("content")).cast("long").alias("bytes"))
    return files.join(chunks, "project_id", "full_outer").select("project_id", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("bytes", F.lit(0)).alias("bytes"), "last_indexed")


def all_projects_stats(spark, d):
    one = project_stats(spark, d)
    return one.agg(F.count("*").alias("n_projects"), F.sum("n_files").alias("n_files"), F.sum("n_chunks").alias("n_chunks"), F.sum("bytes").alias("bytes"), F.max("last_indexed").alias("last_indexed"))


def model_usage_share(spark, d):
    """Chunks by model, blank as unknown, with the share in percent."""
    name = F.when(F.trim(F.coalesce("embedding_model_id", F.lit(""))) == "", "unknown").otherwise(F.col("embedding_model_id"))
    by = table(spark, d, "chunks_new", "embedding_model_id").groupBy(name.alias("model")).agg(F.count("*").alias("n"))
    total = by.agg(F.sum("n").alias("total"))
    return by.crossJoin(F.broadcast(total)).select("model", "n", F.floor(F.col("n") * 100 / F.col("total") + 0.5).cast("long").alias("percent"))  # the total is one row


def model_consistency(spark, d):
    """Whether all chunks of a project were made with one model, whatever its letter case."""
    rows = table(spark, d, "chunks_new", "project_id", "embedding_model_id").where("embedding_model_id is not null")
    return rows.groupBy("project_id").agg((F.min(F.lower("embedding_model_id")) == F.max(F.lower("embedding_model_id"))).alias("consistent"))


def model_lookup(spark, d):
    """Models in use with their catalog entry, or a default where they have none."""
    used = table(spark, d, "chunks_new", "embedding_model_id").where("embedding_model_id is not null").groupBy(F.lower("embedding_model_id").alias("key")).agg(F.count("*").alias("n"))
    catalog = table(spark, d, "embedding_models", "id", "display_name", "backend").withColumn("key", F.lower("id"))
    return used.join(catalog, "key", "left").select("key", "n", F.coalesce("display_name", "key").alias("display_name"), F.coalesce("backend", F.lit("onnx")).alias("backend"))


def latest_symbols(spark, d):
    """A row for each symbol of the newest record of each file."""
    path = F.regexp_replace(F.regexp_replace("file_path", r"\\", "/"), r"^(\./)+", "")
    rows = table(spark, d, "parse_results", "project_id", "file_path", "symbols", "parsed_at").where("file_path is not null").withColumn("path", path)
    newest = rows.groupBy("project_id", "path").agg(F.max_by("symbols", F.struct("parsed_at", "file_path")).alias("symbols"))
    return newest.select("project_id", "path", F.explode("symbols").alias("symbol"))


def averages_per_file(spark, d):
    """Chunks and symbols a file of each project, with one decimal; 'N/A' for a project without files."""
    files = table(spark, d, "files_new", "pk", "project_id").groupBy("project_id").agg(F.count("*").alias("files"))
    chunks = table(spark, d, "chunks_new", "project_id").groupBy("project_id").agg(F.count("*").alias("chunks"))
    symbols = latest_symbols(spark, d).groupBy("project_id").agg(F.count("*").alias("symbols"))
    names = table(spark, d, "project_meta", "id").withColumnRenamed("id", "project_id")
    rows = names.join(files, "project_id", "left").join(chunks, "project_id", "left").join(symbols, "project_id", "left")
    return rows.select("project_id", *[S.average(F.col(c), F.col("files")).alias(f"{c}_per_file") for c in ("chunks", "symbols")])


def wrong_chunk_counts(spark, d):
    """Files whose recorded chunk_count isn't the number of their chunks."""
    chunks = table(spark, d, "chunks_new", "id", "file_id").groupBy("file_id").agg(F.countDistinct("id").alias("n"))
    files = table(spark, d, "files_new", "pk", "chunk_count")
    return files.join(chunks, files.pk == chunks.file_id, "left").select("pk", "chunk_count", F.coalesce("n", F.lit(0)).alias("n")).where("not (chunk_count <=> n)")


def extensions(spark, d):
    return table(spark, d, "files_new", "project_id", "path").groupBy("project_id").agg(F.array_join(F.array_sort(F.collect_set(S.extension(F.col("path")))), ",").alias("extensions"))


def catalog_groups(spark, d):
    return table(spark, d, "embedding_models", "id", "backend", "display_name").groupBy("backend").agg(F.array_join(F.array_sort(F.collect_list("display_name")), ", ").alias("models"), F.count("*").alias("n"))


def outline_max_timestamp(spark, d):
    path = F.regexp_replace(F.regexp_replace("file_path", r"\\", "/"), r"^(\./)+", "")
    return table(spark, d, "parse_results", "project_id", "file_path", "parsed_at").where("file_path is not null").groupBy("project_id", path.alias("path")).agg(F.max(F.unix_micros("parsed_at")).alias("parsed_us"))


def tool_metrics(spark, d):
    return table(spark, d, "events", "event_type", "value").groupBy("event_type").agg(F.count("*").alias("calls"), F.round(F.avg("value"), 6).alias("mean_ms"))


def symbol_summary(spark, d):
    """Names and kinds of a file's symbols in one text, in order."""
    rows = table(spark, d, "parse_results", "project_id", "file_path", "symbols", "parsed_at")
    text = F.array_join(F.transform("symbols", lambda s: F.concat(s["name"], F.lit(" ("), s["kind"], F.lit(")"))), ", ")
    return rows.select("project_id", "file_path", F.unix_micros("parsed_at").alias("us"), F.md5(text).alias("summary"))


def project_config(spark, d):
    """Settings from the projects' JSON, with defaults, newest project first."""
    c = F.from_json("config_json", "chunkSizeMin int, chunkSizeMax int, embeddingModel string, includePaths array<string>")
    rows = table(spark, d, "project_meta", "id", "config_json", "is_indexing", "created_at").withColumn("c", c)
    return rows.select("id", F.coalesce("c.chunkSizeMin", F.lit(100)).alias("least"), F.coalesce("c.chunkSizeMax", F.lit(800)).alias("most"), F.coalesce("c.embeddingModel", F.lit("")).alias("model"), (F.coalesce("c.chunkSizeMax", F.lit(800)) >= F.coalesce("c.chunkSizeMin", F.lit(100))).alias("valid"), (F.col("is_indexing") != 0).alias("indexing")).orderBy(F.desc("id"))


QUERIES = {f.__name__: f for f in (search_topk, search_dim_mismatch, search_chunks, vector_l2_normalize, similarity_buckets, line_chunks, debounce_sessions, event_windows, project_stats, all_projects_stats, model_usage_share, model_consistency, model_lookup, averages_per_file, wrong_chunk_counts, extensions, catalog_groups, outline_max_timestamp, tool_metrics, symbol_summary, project_config)}
_COS = lambda a, b: f"list_sum(list_transform(list_zip({a}::DOUBLE[], {b}::DOUBLE[]), lambda x: x[1] * x[2])) / (sqrt(list_sum(list_transform({a}::DOUBLE[], lambda x: x * x))) * sqrt(list_sum(list_transform({b}::DOUBLE[], lambda x: x * x))))"
_AVERAGE = lambda c: f"CASE WHEN f = 0 THEN 'N/A' ELSE (({c} * 20 + f) // (2 * f) // 10)::BIGINT::VARCHAR || '.' || (({c} * 20 + f) // (2 * f) % 10)::BIGINT::VARCHAR END"
_PROJECTS = """(SELECT coalesce(f.project_id, c.project_id) AS project_id, coalesce(n_files, 0) AS n_files, coalesce(n_chunks, 0) AS n_chunks, coalesce(bytes, 0) AS bytes, last_indexed FROM (SELECT project_id, count(*) AS n_files, max(updated_at) AS last_indexed FROM files_new GROUP BY 1) f
    FULL JOIN (SELECT project_id, count(*) AS n_chunks, sum(strlen(content))::BIGINT AS bytes FROM chunks_new GROUP BY 1) c ON c.project_id = f.project_id)"""
SQL = {
    "search_topk": f"SELECT e.vec_id, round({_COS('e.embedding', 'q.embedding')}, 9) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {_COS('e.embedding', 'q.embedding')} DESC, e.vec_id LIMIT 10",
    "search_dim_mismatch": f"SELECT e.vec_id, CASE WHEN e.vec_id % 5 = 1 THEN 0.0::DOUBLE ELSE round({_COS('e.embedding', 'q.embedding')}, 9) END AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id % 5 <> 2",
    "search_chunks": f"""WITH o AS (SELECT id, arg_max(embedding, updated_at) AS e, any_value(language) AS language, any_value(symbol_name) AS symbol_name FROM chunks_new WHERE len(embedding) = 64 GROUP BY id), q AS (SELECT e FROM o ORDER BY id LIMIT 1)
        SELECT id, language, symbol_name, round(s, 9) AS similarity FROM (SELECT o.*, CASE WHEN list_sum(list_transform(o.e::DOUBLE[], lambda x: x * x)) = 0 OR len(list_filter(o.e, lambda x: x IS NOT NULL AND isfinite(x))) < 64 THEN 0 ELSE {_COS('o.e', 'q.e')} END AS s FROM o, q) ORDER BY s DESC, id LIMIT 8""",
    "vector_l2_normalize": "SELECT vec_id, (i - 1)::BIGINT AS n, round(v / sqrt(s), 9) AS x FROM (SELECT vec_id, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS i, list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) AS s FROM embeddings)",
    "similarity_buckets": f"SELECT CASE WHEN s > 0.8 THEN 'high' WHEN s > 0.6 THEN 'medium' ELSE 'low' END AS bucket, count(*) AS n FROM (SELECT {_COS('e.embedding', 'q.embedding')} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) GROUP BY 1",
    "line_chunks": """WITH RECURSIVE l AS (SELECT doc_id, string_split(regexp_replace(text, '\\n\\z', ''), chr(10)) AS ls FROM documents WHERE length(text) > 0),
        x AS (SELECT doc_id, unnest(ls) AS t, generate_subscripts(ls, 1) AS n FROM l),
        r AS (SELECT x.doc_id, x.n, 0::BIGINT AS chunk, strlen(x.t) + 1 AS size, 0::BIGINT AS start FROM x WHERE x.n = 1
          UNION ALL SELECT x.doc_id, x.n, r.chunk + CASE WHEN r.size + strlen(x.t) > 800 THEN 1 ELSE 0 END, CASE WHEN r.size + strlen(x.t) > 800 THEN strlen(x.t) + 1 ELSE r.size + strlen(x.t) + 1 END, CASE WHEN r.size + strlen(x.t) > 800 THEN r.start + r.size ELSE r.start END FROM r JOIN x ON x.doc_id = r.doc_id AND x.n = r.n + 1)
        SELECT doc_id, chunk, md5(string_agg(t, chr(10) ORDER BY n) || chr(10)) AS content, min(n)::BIGINT AS line_start, CASE WHEN chunk = max(chunk) OVER (PARTITION BY doc_id) THEN -1 ELSE max(n) END::BIGINT AS line_end, min(start)::BIGINT AS char_start, (min(start) + sum(strlen(t) + 1))::BIGINT AS char_end
        FROM r JOIN x USING (doc_id, n) GROUP BY doc_id, chunk""",
    "debounce_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 1 HOUR THEN 1 ELSE 0 END AS b FROM events WHERE event_type IN ('click', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts, b DESC ROWS UNBOUNDED PRECEDING) AS g FROM e) SELECT user_id, min(ts) AS first_event, max(ts) AS last_event, count(*) AS n_events FROM s GROUP BY user_id, g""",
    "event_windows": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "project_stats": f"SELECT * FROM {_PROJECTS}",
    "all_projects_stats": f"SELECT count(*) AS n_projects, sum(n_files)::BIGINT AS n_files, sum(n_chunks)::BIGINT AS n_chunks, sum(bytes)::BIGINT AS bytes, max(last_indexed) AS last_indexed FROM {_PROJECTS}",
    "model_usage_share": "SELECT model, n, floor(n * 100 / sum(n) OVER () + 0.5)::BIGINT AS percent FROM (SELECT CASE WHEN trim(coalesce(embedding_model_id, '')) = '' THEN 'unknown' ELSE embedding_model_id END AS model, count(*) AS n FROM chunks_new GROUP BY 1)",
    "model_consistency": "SELECT project_id, count(DISTINCT lower(embedding_model_id)) = 1 AS consistent FROM chunks_new WHERE embedding_model_id IS NOT NULL GROUP BY 1",
    "model_lookup": "SELECT u.key, u.n, coalesce(m.display_name, u.key) AS display_name, coalesce(m.backend, 'onnx') AS backend FROM (SELECT lower(embedding_model_id) AS key, count(*) AS n FROM chunks_new WHERE embedding_model_id IS NOT NULL GROUP BY 1) u LEFT JOIN embedding_models m ON lower(m.id) = u.key",
    "averages_per_file": rf"""WITH n AS (SELECT p.id AS project_id, (SELECT count(*) FROM files_new f WHERE f.project_id = p.id) AS f, (SELECT count(*) FROM chunks_new c WHERE c.project_id = p.id) AS c, coalesce(y.n, 0) AS s FROM project_meta p
        LEFT JOIN (SELECT project_id, sum(len(symbols)) AS n FROM (SELECT *, row_number() OVER (PARTITION BY project_id, regexp_replace(replace(file_path, '\', '/'), '^(\./)+', '') ORDER BY parsed_at DESC, file_path DESC) AS k FROM parse_results WHERE file_path IS NOT NULL) WHERE k = 1 GROUP BY 1) y ON y.project_id = p.id)
        SELECT project_id, {_AVERAGE('c')} AS chunks_per_file, {_AVERAGE('s')} AS symbols_per_file FROM n""",
    "wrong_chunk_counts": "SELECT pk, chunk_count, coalesce(n, 0) AS n FROM files_new LEFT JOIN (SELECT file_id, count(DISTINCT id) AS n FROM chunks_new GROUP BY 1) c ON c.file_id = pk WHERE chunk_count IS DISTINCT FROM coalesce(n, 0)",
    "extensions": r"SELECT project_id, array_to_string(list_sort(list(DISTINCT lower(regexp_extract(path, '\.[^./]*$')))), ',') AS extensions FROM files_new GROUP BY 1",
    "catalog_groups": "SELECT backend, array_to_string(list_sort(list(display_name)), ', ') AS models, count(*) AS n FROM embedding_models GROUP BY 1",
    "outline_max_timestamp": r"SELECT project_id, regexp_replace(replace(file_path, '\', '/'), '^(\./)+', '') AS path, max(epoch_us(parsed_at)) AS parsed_us FROM parse_results WHERE file_path IS NOT NULL GROUP BY 1, 2",
    "tool_metrics": "SELECT event_type, count(*) AS calls, round(avg(value), 6) AS mean_ms FROM events GROUP BY 1",
    "symbol_summary": "SELECT project_id, file_path, epoch_us(parsed_at) AS us, md5(array_to_string(list_transform(symbols, lambda s: s.name || ' (' || s.kind || ')'), ', ')) AS summary FROM parse_results",
    "project_config": "SELECT id, coalesce((config_json->>'chunkSizeMin')::INT, 100) AS least, coalesce((config_json->>'chunkSizeMax')::INT, 800) AS most, coalesce(config_json->>'embeddingModel', '') AS model, coalesce((config_json->>'chunkSizeMax')::INT, 800) >= coalesce((config_json->>'chunkSizeMin')::INT, 100) AS valid, is_indexing <> 0 AS indexing FROM project_meta",
}
