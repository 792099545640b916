"""Queries of the parsers, the semantic chunker and embeddings. SQL can express counts of what stands at the beginnings of lines, and the pairs of JSON; the rest is tested by facts and invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomdex.operators import semantic
from loomdex.operators.embed import embed, hashing_embedder
from loomdex.sources.tables import table


def _files(spark, d):
    files = table(spark, d, "files_new", "pk", "path")
    return table(spark, d, "source_files", "file_id", "source").join(files, F.col("file_id") == files.pk).select("file_id", "path", "source")


def parse_symbols(spark, d):
    """The symbols of every file."""
    return semantic.symbols(_files(spark, d))


def symbol_kinds(spark, d):
    """How many symbols of each kind the files of each extension have."""
    return parse_symbols(spark, d).groupBy(F.lower(F.regexp_extract("path", r"\.[^./]*$", 0)).alias("extension"), "kind").agg(F.count("*").alias("n"))


def semantic_chunks(spark, d):
    """The chunks of every file that has a parser."""
    return semantic.chunks(_files(spark, d))


def chunk_embeddings(spark, d):
    """The chunks with vectors of the hashing embedder."""
    return embed(semantic_chunks(spark, d).select("file_id", "ordinal", "content"), "content", hashing_embedder, "hashing-64").drop("content")


def json_symbols(spark, d):
    """How many pairs of name and value each valid JSON file has, at any depth, and in its top object."""
    files = _files(spark, d).where(F.lower("path").endswith(".json") & F.try_parse_json("source").isNotNull())
    found = semantic.symbols(files)
    return found.groupBy("file_id").agg(F.count("*").alias("n"), F.sum((F.col("parent") == "").cast("long")).alias("n_top"))


def go_functions(spark, d):
    """The functions and methods that begin a line of each Go file."""
    found = semantic.symbols(_files(spark, d).where(F.lower("path").endswith(".go"))).where(F.col("kind").isin("function", "method"))
    return found.groupBy("file_id").agg(F.sum((F.col("kind") == "method").cast("long")).alias("n_methods"), F.sum((F.col("kind") == "function").cast("long")).alias("n_functions"))


def sql_statements(spark, d):
    """The CREATE TABLE statements of each SQL file, by table."""
    found = semantic.symbols(_files(spark, d).where(F.lower("path").endswith(".sql"))).where(F.col("name").startswith("CREATE TABLE "))
    return found.select("file_id", F.substring_index("name", " ", -1).alias("created"), F.col("start_line").cast("long").alias("line"))


QUERIES = {f.__name__: f for f in (parse_symbols, symbol_kinds, semantic_chunks, chunk_embeddings, json_symbols, go_functions, sql_statements)}
_FILES = "SELECT s.file_id, f.path, s.source FROM source_files s JOIN files_new f ON f.pk = s.file_id WHERE s.source IS NOT NULL"
SQL = {
    "json_symbols": f"""WITH f AS (SELECT file_id, source FROM ({_FILES}) WHERE lower(path) LIKE '%.json' AND json_valid(source)), t AS (SELECT f.file_id, x.id, x.parent, x.type FROM f, json_tree(f.source) x)
        SELECT c.file_id, count(*) AS n, sum(CASE WHEN p.parent IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_top FROM t c JOIN t p ON p.file_id = c.file_id AND p.id = c.parent WHERE p.type = 'OBJECT' GROUP BY 1""",
    "go_functions": rf"""SELECT file_id, m AS n_methods, n - m AS n_functions FROM (SELECT file_id, len(regexp_extract_all(source, '(?m)^func +\(')) AS m, len(regexp_extract_all(source, '(?m)^func +(?:\([^)]*\) *)?\w+ *(?:\[[^\]]*\])?\(')) AS n FROM ({_FILES}) WHERE lower(path) LIKE '%.go') WHERE n > 0""",
    "sql_statements": rf"""SELECT file_id, regexp_extract(l, '(?i)^\s*create table (?:if not exists )?(\w+)', 1) AS created, line FROM (SELECT file_id, unnest(string_split(source, chr(10))) AS l, generate_subscripts(string_split(source, chr(10)), 1)::BIGINT AS line FROM ({_FILES}) WHERE lower(path) LIKE '%.sql') WHERE regexp_matches(l, '(?i)^\s*create table (?:if not exists )?\w+')""",
}
