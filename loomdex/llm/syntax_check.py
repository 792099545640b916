"""Source files that do not parse.

Each file is recognised by generalised LL parsing with a graph-structured stack, all that a
bracket may hold in its language running together, dialect by dialect (code of modules and of scripts) (see syntax/gll.py); a file is
flagged if every dialect that its extension stands for rejects it. Only syntax counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm.syntax import css, golang, jsontext, python3, script, sql
from loomdex.sources.tables import table

# By extension the language and its dialects.
LANGUAGES: dict[str, tuple[str, tuple[Callable[[str], bool], ...]]] = {
    "go": ("go", (golang.valid,)),
    "py": ("python", (python3.valid,)),
    "js": ("javascript", (script.SCRIPT.valid, script.SLOPPY_SCRIPT.valid)),
    "ts": ("typescript", (script.TYPESCRIPT.valid,)),
    "json": ("json", (jsontext.valid,)),
    "css": ("css", (css.valid,)),
    "sql": ("sql", (sql.valid,)),
}


def parses(source: str, extension: str) -> bool | None:
    """Whether some dialect of the extension's language accepts the whole text; None if a text is nested too deep to be told. An empty text is valid but in JSON and Go."""
    said: bool | None = False
    for accept in LANGUAGES[extension][1]:
        try:
            if accept(source):
                return True
        except RecursionError:  # templates in templates, formats in formats
            said = None
    return said


def check(files: DataFrame) -> DataFrame:
    """(file_id, project_id, language, valid): every file whose source isn't null and whose extension stands for a language.

    ``files`` has file_id, project_id, path, source. The extension counts in any letter case; other extensions, .md among
    them, and null paths leave a file out. Repeated rows of a file give one row: invalid if one of them is. valid is null where no verdict could be reached.
    """
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    rows = files.where(F.col("file_id").isNotNull() & F.col("source").isNotNull()).withColumn("extension", extension).where(F.col("extension").isin(*LANGUAGES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(lo, 500) for whole in batches for lo in range(0, whole.num_rows, 500)):
            good = [parses(s, e) for s, e in zip(batch.column("source").to_pylist(), batch.column("extension").to_pylist(), strict=True)]
            names = [LANGUAGES[e][0] for e in batch.column("extension").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("file_id"), batch.column("project_id"), pa.array(names, pa.string()), pa.array(good, pa.bool_())], names=["file_id", "project_id", "language", "valid"])

    kind = files.schema["file_id"].dataType.simpleString()
    seen = rows.select("file_id", "project_id", "source", "extension").mapInArrow(run, f"file_id {kind}, project_id string, language string, valid boolean")
    return seen.groupBy("file_id").agg(F.min("project_id").alias("project_id"), F.min("language").alias("language"), F.bool_and("valid").alias("valid"))


def _files(spark, d: str) -> DataFrame:
    files = table(spark, d, "files_new", "pk", "project_id", "path")
    return table(spark, d, "source_files", "file_id", "source").join(files, F.col("file_id") == files.pk).select("file_id", "project_id", "path", "source")


def p4_found(spark, d: str) -> DataFrame:
    """The files that no dialect of their language accepts."""
    return check(_files(spark, d)).where("not valid").select("file_id")


def rates(checked: DataFrame) -> DataFrame:
    """(project_id, language, n_files, n_invalid, share): invalid files by project and language."""
    by = checked.groupBy("project_id", "language").agg(F.count("*").alias("n_files"), F.coalesce(F.sum((~F.col("valid")).cast("long")), F.lit(0)).alias("n_invalid"))
    return by.withColumn("share", F.round(F.col("n_invalid") / F.col("n_files"), 6))


def p4_rates(spark, d: str) -> DataFrame:
    """The share of invalid files by project and language."""
    return rates(check(_files(spark, d)))


def p4_against_earlier(spark, d: str) -> DataFrame:
    """By language: how the last earlier run's recorded errors agree with the parse. An absent, null or empty record counts as no error."""
    records = table(spark, d, "parse_results", "project_id", "file_path", "errors", "parsed_at")
    path = F.regexp_replace(F.regexp_replace("file_path", r"\\", "/"), r"^(?:\./)+", "")
    newest = records.withColumn("path", path).groupBy("project_id", "path").agg(F.max_by(F.coalesce(F.size("errors"), F.lit(0)) > 0, "parsed_at").alias("had_errors"))
    files = table(spark, d, "files_new", "pk", "project_id", "path").join(newest, ["project_id", "path"], "left").select(F.col("pk").alias("file_id"), F.coalesce("had_errors", F.lit(False)).alias("had_errors"))
    both = check(_files(spark, d)).join(files, "file_id")
    return both.groupBy("language").agg(F.count("*").alias("n_files"), *(F.sum((F.col("valid") == v).cast("int") * (F.col("had_errors") == h).cast("int")).alias(n) for n, v, h in (("newly_invalid", False, False), ("still_invalid", False, True), ("no_longer_invalid", True, True))))


QUERIES = {"p4_found": p4_found, "p4_rates": p4_rates, "p4_against_earlier": p4_against_earlier}
SQL: dict[str, str] = {}
