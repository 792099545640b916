"""Functions of texts, names and labels as Column expressions. Null arguments give null unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_of_line(text: Column, line: Column) -> Column:
    """The byte at which a line (from 1) begins; null beyond the text's last line."""
    lines = F.split(text, "\n")
    before = F.aggregate(F.slice(lines, 1, F.greatest(line - 1, F.lit(0))), F.lit(0).cast("long"), lambda s, x: s + F.octet_length(x) + 1)
    return F.when((line >= 1) & (line <= F.size(lines)), before)


def line_of_byte(text: Column, at: Column) -> Column:
    """The line (from 1) on which a byte lies."""
    return F.size(F.split(F.decode(F.substring(F.encode(text, "UTF-8"), F.lit(1), at.cast("int")), "ISO-8859-1"), "\n")).cast("long")


def link_targets(text: Column) -> Column:
    """The targets of the Markdown links of a text, in order."""
    return F.regexp_extract_all(text, F.lit(r"\[([^\]]+)\]\(([^)]+)\)"), F.lit(2))


def external(target: Column) -> Column:
    return target.rlike("^https?://")


def heading_level(line: Column) -> Column:
    """1 to 6 for a heading, 0 for other lines."""
    return F.length(F.regexp_extract(line, r"^(#{1,6})\s", 1)).cast("long")


def heading_text(line: Column) -> Column:
    """A heading without its signs on either side."""
    return F.trim(F.regexp_replace(F.regexp_replace(line, r"^#+\s*", ""), r"\s+#+\s*$", ""))


def unquoted(text: Column) -> Column:
    """Without blanks, url( ) and one pair of quotes around it."""
    bare = F.regexp_replace(F.trim(text), r"(?i)^url\(\s*(.*?)\s*\)$", "$1")
    return F.regexp_replace(bare, r"""^(["'`])(.*)\1$""", "$2")


def visibility(language: Column, name: Column, source: Column) -> Column:
    """public, protected or private: in Go by the first letter, in Python by underscores, in TypeScript by a modifier before the name; others are public."""
    typed = F.regexp_extract(source, r"^\s*(?:(?:static|async|override|readonly|abstract)\s+)*(public|private|protected)\b", 1)
    return (
        F.when(language == "go", F.when(name.rlike(r"^\p{Lu}"), "public").otherwise("private"))
        .when(language == "python", F.when(name.startswith("__"), "private").when(name.startswith("_"), "protected").otherwise("public"))
        .when((language == "typescript") & (F.coalesce(typed, F.lit("")) != ""), typed).otherwise("public")
    )


def id_of_url(path: Column) -> Column:
    """The id in /mcp/<id>; '' where there is none."""
    return F.regexp_extract(path, "^/mcp/([^/]+)", 1)


def id_of_file(name: Column) -> Column:
    """The id in project-<id>.db; '' for other names."""
    return F.regexp_extract(name, r"^project-(.+)\.db$", 1)


def label(name: Column, key: Column) -> Column:
    """'name (id)', or the id alone for a null or blank name."""
    return F.when(F.trim(F.coalesce(name, F.lit(""))) == "", key).otherwise(F.concat(name, F.lit(" ("), key, F.lit(")")))


def joined_attributes(*parts: tuple[Column, str, str]) -> Column:
    """(value, before, after) joined by ' · '; what is null, 0 or blank is left out."""
    return F.concat_ws(" · ", *[F.when(~F.coalesce(v.cast("string"), F.lit("")).isin("", "0"), F.concat(F.lit(a), v.cast("string"), F.lit(b))) for v, a, b in parts])
