"""Scalar functions as Column expressions; all stay inside whole-stage code generation.

Null arguments give null unless a function says otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by extension; rust and java are known but have no parser.
LANGUAGES = {
    ".go": "go", ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".html": "html", ".htm": "html", ".css": "css",
    ".scss": "scss", ".sass": "sass", ".vue": "vue", ".md": "markdown", ".markdown": "markdown", ".json": "json", ".sql": "sql", ".rs": "rust", ".java": "java",
}
SUPPORTED = tuple(e for e in LANGUAGES if e not in (".rs", ".java"))
#: What stands for the lines left out of a collapsed body.
COLLAPSED = "... [body collapsed for brevity] ..."


def content_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, in hex."""
    return F.sha2(text, 256)


def token_estimate(text: Column) -> Column:
    """floor(bytes / 4); 0 for null."""
    return F.floor(F.coalesce(F.octet_length(text), F.lit(0)) / 4).cast("long")


def slug(text: Column, blanks: str = "[ _]") -> Column:
    """Lower case, blanks and underscores to hyphens, other signs dropped, hyphens squeezed and trimmed."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), blanks, "-"), "[^a-z0-9-]", "")
    return F.regexp_replace(F.regexp_replace(out, "-+", "-"), "^-|-$", "")


def ui_slug(text: Column) -> Column:
    """slug(), with any run of white space as one blank."""
    return slug(text, r"[\s_]+")


def _tenths(n: Column, unit: int, half_even: bool) -> Column:
    """n / unit with one decimal, in whole numbers of 38 digits, so that ties round alike everywhere and nothing overflows."""
    one = F.lit(unit).cast("decimal(20,0)")
    ten = n.cast("decimal(20,0)") * F.lit(10).cast("decimal(3,0)")
    r = F.pmod(ten, one)
    q = ((ten - r) / one).cast("decimal(20,0)")
    up = (r * 2 > one) | ((r * 2 == one) & ((q % 2 == 1) if half_even else F.lit(True)))
    t = (q + F.when(up, 1).otherwise(0)).cast("long")
    return F.concat(F.floor(t / 10).cast("string"), F.lit("."), F.pmod(t, F.lit(10)).cast("string"))


def format_bytes(n: Column) -> Column:
    """'N B' below 1024, else with one decimal in KB to EB."""
    n = n.cast("long")
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for k, unit in enumerate(("KB", "MB", "GB", "TB", "PB")):
        out = out.when(n < 1024 ** (k + 2), F.concat(_tenths(n, 1024 ** (k + 1), True), F.lit(f" {unit}")))
    return out.when(n.isNotNull(), F.concat(_tenths(n, 1024**6, True), F.lit(" EB")))


def ui_megabytes(n: Column) -> Column:
    """Whole bytes as megabytes with one decimal; '' for null and nothing."""
    return F.when(F.coalesce(n, F.lit(0)) > 0, F.concat(_tenths(n.cast("long"), 1024**2, False), F.lit(" MB"))).otherwise("")


def similarity_percent(x: Column) -> Column:
    """'87.5%'; 'N/A' for null and 0."""
    return F.when(F.coalesce(x, F.lit(0.0)) == 0, "N/A").otherwise(F.concat(F.round(x * 100, 1).cast("decimal(10,1)").cast("string"), F.lit("%")))


def ui_bytes(n: Column) -> Column:
    """'0 Bytes' for nothing, null or less, else up to two decimals, in Bytes to GB."""
    n = F.coalesce(n.cast("long"), F.lit(0))
    sized = lambda k, unit: F.concat(F.regexp_replace((F.floor(n * 100 / 1024**k + 0.5) / 100).cast("decimal(20,2)").cast("string"), r"\.?0+$", ""), F.lit(f" {unit}"))
    return F.when(n <= 0, "0 Bytes").when(n < 1024, F.concat(n.cast("string"), F.lit(" Bytes"))).when(n < 1024**2, sized(1, "KB")).when(n < 1024**3, sized(2, "MB")).otherwise(sized(3, "GB"))


def average(total: Column, n: Column) -> Column:
    """total / n with one decimal, halves up; 'N/A' where n is null or 0; a null total is 0."""
    tenths = F.floor((F.coalesce(total, F.lit(0)) * 20 + n) / (2 * n)).cast("long")
    return F.when(F.coalesce(n, F.lit(0)) == 0, "N/A").otherwise(F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string")))


def number_suffix(n: Column) -> Column:
    """1.2K, 3.4M; plain below a thousand."""
    return F.when(n >= 1_000_000, F.concat(_tenths(n, 1_000_000, False), F.lit("M"))).when(n >= 1000, F.concat(_tenths(n, 1000, False), F.lit("K"))).otherwise(n.cast("string"))


def token_suffix(n: Column) -> Column:
    """'' for null or 0, 12t, 1.2kt."""
    return F.when(F.coalesce(n, F.lit(0)) == 0, "").when(n < 1000, F.concat(n.cast("string"), F.lit("t"))).otherwise(F.concat(_tenths(n, 1000, False), F.lit("kt")))


def relative_date(then: Column, now: Column) -> Column:
    """How long before ``now`` (both epoch seconds): just now, minutes, hours, days; 'Never' for null or 0; a date beyond a week."""
    s = now - then
    return (
        F.when(F.coalesce(then, F.lit(0)) == 0, "Never").when(s < 60, "just now").when(s < 3600, F.concat(F.floor(s / 60), F.lit("m ago"))).when(s < 86400, F.concat(F.floor(s / 3600), F.lit("h ago")))
        .when(s < 7 * 86400, F.concat(F.floor(s / 86400), F.lit("d ago"))).otherwise(F.date_format(F.timestamp_seconds(then), "yyyy-MM-dd HH:mm:ss"))
    )


def uptime(s: Column) -> Column:
    """Hours, minutes and seconds; 'Not running' for 0."""
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    return F.when(s == 0, "Not running").when(h > 0, F.concat(h, F.lit("h "), m, F.lit("m "), r, F.lit("s"))).when(m > 0, F.concat(m, F.lit("m "), r, F.lit("s"))).otherwise(F.concat(r, F.lit("s")))


def similarity_bucket(x: Column) -> Column:
    """high over 0.8, medium over 0.6, else low; null and 0 are low."""
    return F.when(x > 0.8, "high").when(x > 0.6, "medium").otherwise("low")


def extension(path: Column) -> Column:
    """The last extension with its dot, in lower case; '' if there is none."""
    return F.lower(F.regexp_extract(path, r"\.[^./]*$", 0))


def language(path: Column) -> Column:
    """The language that a path's extension stands for, else 'unknown'."""
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, extension(path)), F.lit("unknown"))


def supported(path: Column) -> Column:
    """Whether there is a parser for the path's extension, in any letter case."""
    return extension(path).isin(*SUPPORTED)


def normal_path(path: Column) -> Column:
    """Trimmed, with forward slashes, without '.', repeated slashes and a slash at the end; 'a/..' is resolved. '.' for what is left empty."""
    p = F.regexp_replace(F.trim(path), r"\\", "/")
    parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    rooted = p.startswith("/")

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        back = (x == "..") & last.isNotNull() & (last != "..")
        return F.when(back, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when((x == "..") & rooted & last.isNull(), acc).otherwise(F.concat(acc, F.array(x)))

    out = F.concat(F.when(rooted, "/").otherwise(""), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))
    return F.when(out == "", ".").otherwise(out)


def within(root: Column, path: Column) -> Column:
    """Whether a path is its root or below it."""
    return (path == root) | F.startswith(path, F.concat(F.regexp_replace(root, "/$", ""), F.lit("/")))


def relative_path(root: Column, path: Column) -> Column:
    """The path below its root, '.' for the root, null outside of it."""
    base = F.regexp_replace(root, "/$", "")
    return F.when(path == base, ".").when(within(base, path), F.substring(path, F.length(base) + 2, F.length(path)))


def model_folder(name: Column) -> Column:
    """A model's name as a safe folder name; 'model' for what is left empty."""
    out = F.regexp_replace(F.regexp_replace(F.trim(name), r"\.\.", ""), r"[/\\]", "-")
    return F.when(out == "", "model").otherwise(out)


def enriched_content(path: Column, lang: Column, symbols: Column, name: Column, doc: Column, source: Column) -> Column:
    """A chunk's text with its context: file, symbols (an array of name and kind, or else one name), documentation, source. Nulls count as empty."""
    text = lambda c: F.coalesce(c, F.lit(""))
    entries = F.array_join(F.transform(symbols, lambda s: F.when(text(s["name"]) != "", F.concat(s["name"], F.lit(" ("), text(s["kind"]), F.lit(")"))).otherwise(text(s["kind"]))), ", ")
    head = F.when(F.coalesce(F.size(symbols), F.lit(0)) > 0, F.concat(F.lit("# Symbols: "), entries, F.lit("\n"))).when(text(name) != "", F.concat(F.lit("# Symbol: "), name, F.lit("\n"))).otherwise("")
    docs = F.when(text(doc) != "", F.concat(F.array_join(F.transform(F.split(doc, "\n"), lambda x: F.concat(F.lit("// "), F.trim(x))), "\n"), F.lit("\n\n"))).otherwise("")
    return F.concat(F.lit("# File: "), text(path), F.lit(" ("), text(lang), F.lit(")\n"), head, F.lit("\n"), docs, text(source))


def strip_comment_lines(source: Column) -> Column:
    """Without blank lines and lines that begin as comments."""
    return F.array_join(F.filter(F.split(source, "\n"), lambda x: ~F.rlike(x, F.lit(r"^\s*($|//|#|/\*|<!--)"))), "\n")


def semantic_group(kind: Column) -> Column:
    """template, style or code, by a symbol's kind; null is code."""
    return F.when(kind == "element", "template").when(kind.isin("style", "rule", "media", "keyframes"), "style").otherwise("code")


def collapse_body(source: Column, most: int = 120, head: int = 60, tail: int = 40) -> Column:
    """Of a source over ``most`` lines the head and the tail, with a marker between; others as they are."""
    if head + tail >= most:
        head, tail = most // 2, most - most // 2
    lines = F.split(source, "\n")
    return F.when(F.size(lines) > most, F.array_join(F.concat(F.slice(lines, 1, head), F.array(F.lit(COLLAPSED)), F.slice(lines, -tail, tail)), "\n")).otherwise(source)


def line_slice(text: Column, first: int, last: int) -> Column:
    """Lines first to last, counted from 1 and clamped to the text."""
    return F.array_join(F.slice(F.split(text, "\n"), max(first, 1), max(last - max(first, 1) + 1, 0)), "\n")


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for unequal lengths and zero norms; null for a null vector."""
    wide = lambda v: F.transform(v, lambda x: x.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(wide(x), wide(y), lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) != F.size(b), 0.0).when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def l2_normal(v: Column) -> Column:
    """The vector at length one, in double precision; a zero vector stays."""
    wide = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm == 0, wide).otherwise(F.transform(wide, lambda x: x / norm))


def glob_regex(pattern: str) -> str:
    """The regular expression of a path glob: * and ? stop at slashes, [..] is a class; null-safe use is up to the caller."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        end = pattern.find("]", k + 2) if c == "[" else -1
        if end > 0:
            out, k = out + "[" + pattern[k + 1 : end].replace("\\", "\\\\") + "]", end + 1
            continue
        out, k = out + {"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if not c.isalnum() and c not in "/_-" else c), k + 1
    return f"^{out}$"


def excluded(path: Column, patterns: list[str], names: bool = False) -> Column:
    """Whether a pattern matches the path or a folder above it; with ``names`` also the last name of one of these, as a watcher has it. Blank patterns match nothing."""
    parts = F.split(path, "/")
    if not (patterns := [x for x in patterns if x]):
        return F.lit(False)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))

    def hit(rule: str) -> Column:
        whole = F.exists(prefixes, lambda p: F.rlike(p, F.lit(rule)))
        return whole | F.exists(parts, lambda p: F.rlike(p, F.lit(rule))) if names else whole

    return reduce(lambda a, b: a | b, map(hit, map(glob_regex, patterns)), F.lit(False))


def hidden(path: Column) -> Column:
    """Whether some part of a relative path begins with a dot, '.' and '..' aside."""
    return F.coalesce(path.rlike(r"(^|/)\.[^/.][^/]*|(^|/)\.\.[^/]+"), F.lit(False))
