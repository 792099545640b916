"""Which source files were not written by hand in their project: generated, minified, vendored, or data saved as code.

Attribute files mark generated and vendored paths by globs; the deepest folder's file wins, and in it the last
line. Below all of them lies a list of customary patterns, in the same notation. What is declared, and what files' texts say of
themselves, is mined for equivalent patterns (folders and endings whose files are nearly all marked), which are applied to repositories that declare nothing.
The text itself tells by its markers, by banners of other projects, by the shape of its lines, and the scanned size where there is no text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.sources.tables import table, written

# Customary patterns, in the notation of attribute files; letter case doesn't count.
VENDORED_FOLDERS = (
    "vendor", "third_party", "third-party", "thirdparty", "node_modules", "bower_components", "jspm_packages", "site-packages", "dist-packages", "godeps",
    "extern", "external", "externals", "deps", "packagecache", "carthage", "pods", "eggs", ".eggs", "web_modules", ".yarn", ".venv", "venv",
)
GENERATED_FOLDERS = ("gen", "autogen", "__generated__", "generated", "generated-sources", "generated_sources", "_generated", ".next", ".nuxt")
GENERATED_ENDINGS = ("pb", "pb2", "pb2_grpc", "pb.gw", "gen", "generated", "autogen", "grpc.pb")
BUILT_FOLDERS, BUILT = ("dist", "out"), ("js", "css", "mjs", "cjs", "map")
CUSTOMARY = "\n".join(
    [f"**/{x}/** linguist-vendored" for x in VENDORED_FOLDERS] + [f"**/{x}/** linguist-generated" for x in GENERATED_FOLDERS]
    + [f"*{sign}{x}.* linguist-generated" for x in GENERATED_ENDINGS for sign in "._-"] + ["*.g.* linguist-generated", "*.designer.* linguist-generated", "zz_generated*.* linguist-generated", "*_string.gen.* linguist-generated"]
    + [f"*{end} -linguist-generated" for end in (".md", ".markdown", ".txt", ".rst")]
    + [f"*{sign}min.{x} linguist-minified" for x in ("js", "css", "mjs", "cjs") for sign in "._-"] + [f"*{sign}{word}.{x} linguist-minified" for word in ("bundle", "chunk") for x in ("js", "css") for sign in ".-"]
    + [f"**/{folder}/**/*.{x} linguist-minified" for folder in BUILT_FOLDERS for x in BUILT]
)
#: What such a comment says: that no hand wrote it, that none should change it, whose it is, from where and which release.
MADE = re.compile(r"@generated\b|\b(?:auto|machine)(?:matically)?[- ]?(?:generated|written|created|produced)\b|\bcode generated by\b|\b(?:this|the) (?:file|code|module|source)\b.{0,30}\b(?:generated|produced)\b", re.I)
GENERATED_BY = re.compile(r"\bgenerated (?:by|from|with|using)\b|\b(?:output|product) of\b", re.I)
HANDS_OFF = re.compile(r"\b(?:do not|don't|never) (?:edit|modify|change|touch)\b|\bedit .{1,80}\binstead\b|\b(?:edits|changes|modifications)\b.{0,40}\b(?:lost|overwritten|discarded)\b", re.I)
OWNED = re.compile(r"\bcopyright\b|\(c\)|\u00a9|\ball rights reserved\b", re.I)
LICENSED = re.compile(r"\blicen[cs]ed? |\blicen[cs]e\b|\blicen[cs]ed?-|\breleased under\b|\bspdx-license", re.I)
RELEASE = re.compile(r"(?<!licen[cs]e )(?<!licen[cs]e, )(?<!version )(?:\bv|\brelease |\bversion )\d+(?:\.\d+)+", re.I)
TAKEN = re.compile(r"\b(?:imported|copied|vendored|taken|forked|mirrored|ported|adapted|synced) (?:\w+ )?from\b|\bvendored copy\b", re.I)
UPSTREAM = re.compile(r"\bupstream\b|\bvendored\b|\bdistribution\b|\bthird[- ]party\b", re.I)
#: A marker that a whole line of comment makes counts anywhere in the text, not only in the comment at its top.
ANYWHERE = re.compile(r"^(?://|#|--|/\*)\s*(?:code generated\b.{0,200}\bdo not (?:edit|modify)\b.*|@generated\b.*)$", re.I | re.M)
#: A file is minified if so many of its characters are in lines this long, and data if one literal, or one shape of at least so many lines, makes as much of it.
LONG_LINE, MOSTLY, FEWEST_LINES, LITERAL = 500, 0.8, 15, 500
#: A banner is a project's own, and no sign of another's, if at least so many and so large a share of its files have it.
OWN_FILES, OWN_SHARE = 3, 0.2
#: Of a file without a text, sources over so many bytes are data: nobody writes so much by hand in one file.
HUGE = 1 << 20
#: A mined folder or ending needs so many files, and so large a share that is marked.
MINED_FILES, MINED_SHARE = 8, 0.9
CODE = ("go", "py", "ts", "tsx", "js", "jsx", "mjs", "cjs", "css", "scss", "sql", "java", "rs", "c", "h", "cc", "cpp", "cs", "rb", "php", "kt", "swift", "html", "vue", "sh")

COMMENT = re.compile(r"\s*(?://|#|/\*|\*|--|<!--|;|'''|\"\"\"|'use strict'|$)")
STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`", re.S)


def top(text: str) -> str:
    """The comment that opens a file: all its first lines that are comment or blank."""
    end, inside, at = len(text), False, 0
    for m in re.finditer(r"[^\n]*\n?", text):
        line = m.group()
        if not line:
            break
        if not inside and not COMMENT.match(line):
            end = m.start()
            break
        at = line.rfind("/*")
        if at >= 0 and "*/" not in line[at:]:
            inside = True
        elif "*/" in line:
            inside = False
    return text[:end]


def is_minified(text: str) -> bool:
    """Most characters lie in very long lines, and these are code, not one literal."""
    long = [x for x in text.splitlines() if len(x) >= LONG_LINE]
    return bool(long) and sum(map(len, long)) >= MOSTLY * len(text) and not is_data(text)


def is_data(text: str) -> bool:
    """Literals make the file: one literal most of its characters, or one shape of literal rows most of its lines."""
    strings = STRING.findall(text)
    if strings and max(map(len, strings)) >= max(LITERAL, MOSTLY * len(text)):
        return True
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    if len(lines) >= FEWEST_LINES:
        shapes: dict[str, int] = {}
        for x in lines:
            shape = re.sub(r"0x[0-9a-fA-F]+|[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?", "9", STRING.sub("S", x))
            shape = re.sub(r"((?:9|S|true|false|null|None|NULL)\s*,\s*)+", "9,", shape)
            shapes[shape] = shapes.get(shape, 0) + 1
        most = max(shapes, key=shapes.__getitem__)
        named = set(re.findall(r"[A-Za-z_]\w*", most.replace("S", "")))
        if shapes[most] >= MOSTLY * len(lines) and re.search(r"[9S]", most) and (len(named) <= 6 and (re.match(r"[\[({\w\"'.-]*[\[({9S]", most) or re.match(r"(?i)insert\s+into\b", most))) and not re.search(r"[=;]\s*$|\breturn\b|:\s*9?[a-z%]*;$", most.replace(";", "", 1) if re.match(r"(?i)insert", most) else most):
            return True
    dense = re.sub(r"\s+", "", STRING.sub("9", text))
    numbers = sum(map(len, re.findall(r"(?:0x[0-9a-fA-F]+|-?\d+(?:\.\d+)?|9),", dense)))
    return len(dense) >= LITERAL and numbers >= MOSTLY * len(dense)


def says_generated(comment: str) -> bool:
    """Whether a comment says that a tool made the file: plainly, or by two of: made by something, not to be edited, changes get lost."""
    return bool(MADE.search(comment)) or bool(GENERATED_BY.search(comment)) and bool(HANDS_OFF.search(comment))


def banner(comment: str) -> str | None:
    """The line of a comment that tells of another project, its digits left out: at least two of: owner, licence, release, that it was taken, that there is an upstream. None if no line does."""
    for line in comment.splitlines():
        if len(line) > 2 and sum(x.search(line) is not None for x in (OWNED, LICENSED, RELEASE, TAKEN, UPSTREAM)) >= 2:
            return re.sub(r"\d+", "", " ".join(line.split())).lower()
    return None


def text_evidence(text: str | None, extension: str) -> tuple[str | None, str | None]:
    """What a text says by itself: 'generated', 'minified' or 'data', or 'vendored' with the banner that says so. (None, None) for null, empty and hand-written text."""
    if not text:
        return None, None
    head = top(text)
    if says_generated(head) or ANYWHERE.search(STRING.sub('""', text[len(head) :]) if "enerated" in text else ""):
        return "generated", None
    if whose := banner(head):
        return "vendored", whose
    if extension not in CODE:
        return None, None
    if extension != "css" and is_data(text):
        return "data", None
    return ("minified", None) if is_minified(text) else (None, None)


def folders(path: Column) -> Column:
    """The lower-case folder names of a path."""
    return F.transform(F.filter(F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1), lambda x: x != ""), F.lower)


def clean_path(path: Column) -> Column:
    """A path with forward slashes, without ./ and repeated slashes."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(path), r"\\", "/"), r"/(?:\./)*/*", "/"), r"^(?:\./)+", "")


def glob_regex(pattern: str) -> str:
    """The regular expression of an attribute pattern, to be found at the start of a path below the file's folder.

    A pattern without a slash, but for one at its end, matches in any folder below; * and ? stop at slashes, ** does not;
    unlike in ignore files a folder's pattern doesn't cover what is in it.
    """
    anchored = "/" in pattern.rstrip("/")
    pattern, out, k = pattern.lstrip("/"), "", 0
    while k < len(pattern):
        if pattern[k : k + 3] == "**/":
            out, k = out + "(?:[^/]+/)*", k + 3
        elif pattern[k : k + 2] == "**":
            out, k = out + ".*", k + 2
        elif pattern[k] == "[" and (end := pattern.find("]", k + 2)) > 0:
            out, k = out + "[" + pattern[k + 1 : end].replace("!", "^", 1).replace("\\", "\\\\") + "]", end + 1
        else:
            out, k = out + {"*": "[^/]*", "?": "[^/]"}.get(pattern[k], re.escape(pattern[k])), k + 1
    return ("" if anchored else "(?:.*/)?") + out + "$"


def parse_attributes(text: str) -> list[tuple[int, str, str, bool | None]]:
    """(line, regex, kind, value) of each line that sets, unsets (False) or leaves unspecified (None) generated, vendored or minified.

    Patterns may be quoted; [attr] lines name groups of attributes, which later lines may use.
    """
    out, macros = [], {}
    for n, line in enumerate(text.splitlines()):
        line = line.strip()
        quoted = re.match(r'"((?:[^"\\]|\\.)*)"\s+(.*)', line)
        pattern, rest = (re.sub(r"\\(.)", r"\1", quoted[1]), quoted[2]) if quoted else ((line.split() or [""])[0], " ".join(line.split()[1:]))
        if line.startswith("[attr]"):
            macros[pattern.removeprefix("[attr]")] = rest.split()
            continue
        if not rest or not quoted and pattern.startswith(("#", "!")):
            continue
        for a in (x for a in rest.split() for x in macros.get(a, [a])):
            name, _, value = a.lstrip("-!").partition("=")
            kind = {"linguist-generated": "generated", "linguist-vendored": "vendored", "linguist-minified": "minified"}.get(name)
            if kind:
                out.append((n, glob_regex(pattern), kind, None if a[0] == "!" else not (a[0] == "-" or value.lower() in ("false", "0", "no"))))
    return out


def customary(path: Column) -> Column:
    """The kind that the customary patterns give a path, or null; of each kind the last line that matches counts."""
    rules = parse_attributes(CUSTOMARY)
    lower = F.lower(path)

    def said(kind: str) -> Column:
        one = lambda value: "^(?:" + "|".join(r for _, r, k, v in rules if k == kind and v is value) + ")"
        no = one(False)
        yes = F.rlike(lower, F.lit(one(True)))
        return yes & ~F.rlike(lower, F.lit(no)) if no != "^(?:)" else yes

    versioned = F.rlike(lower, F.lit(r"(?:^|/)[\w.@-]+-v?\d+\.\d+(?:\.\d+)*/"))  # the folder of a library's release
    return F.when(said("vendored") | versioned, "vendored").when(said("generated"), "generated").when(said("minified"), "minified")


def declared(files: DataFrame, texts: DataFrame) -> DataFrame:
    """(file_id, kind, declared): what attribute files say of each file; the deepest folder wins, in it the last line.

    ``files`` has file_id, project_id, path (clean), ``texts`` file_id, text_path, text. Only projects that have attribute files are joined, by project and folder,
    each file with the rules of the folders above it; of texts only those of attribute files are read on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, f, *rule) for p, f, t in zip(*(batch.column(c).to_pylist() for c in ("project_id", "path", "text")), strict=True) for rule in parse_attributes(t)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["project_id", "path", "line", "rule", "kind", "value"])

    named = files.where(F.col("path").rlike(r"(?:^|/)\.gitattributes$"))
    # The text's own path keeps other texts out of the join at the scan.
    sources = named.join(texts.where(F.col("text_path").rlike(r"(?:^|[/\\])\.gitattributes$") & F.col("text").isNotNull()), "file_id")
    rules = sources.select("project_id", "path", "text").mapInArrow(run, "project_id string, path string, line int, rule string, kind string, value boolean").withColumn("folder", F.regexp_replace("path", r"[^/]*$", "")).drop("path")
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))))
    spread = files.join(rules.select("project_id").distinct(), "project_id", "left_semi").select("file_id", "project_id", "path", F.explode(above).alias("folder"))
    below = F.expr("substring(path, length(folder) + 1)")
    hit = spread.join(rules, ["project_id", "folder"]).where(F.rlike(below, F.concat(F.lit("^"), F.col("rule"))))
    return hit.groupBy("file_id", "kind").agg(F.max_by("value", F.struct(F.length("folder"), "line")).alias("declared")).where("declared is not null")


def classify(files: DataFrame, texts: DataFrame, mined_files: int = MINED_FILES, mined_share: float = MINED_SHARE) -> DataFrame:
    """(file_id, kind, evidence): every file that was not written by hand, once.

    ``files`` has file_id (unique), project_id, path and bytes (the scanned size, or null), ``texts`` file_id, path, text. Evidence is 'attributes', 'text', 'path', 'mined'
    or 'size'. A null text leaves the path and the size, a null path the text. An attribute that says a file is not of a kind
    cancels evidence of that kind alone. Texts are judged where they are scanned; only what they say is shuffled. Repeated rows of a text count once.
    """
    clean = files.select("file_id", "project_id", clean_path(F.col("path")).alias("path"), "bytes")
    kind = files.schema["file_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                said = [text_evidence(t, e or "") for t, e in zip(part.column("text").to_pylist(), part.column("extension").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("file_id"), pa.array([k for k, _ in said], pa.string()), pa.array([w for _, w in said], pa.string())], names=["file_id", "by_text", "whose"])

    extension = lambda path: F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    read = texts.where("file_id is not null and text is not null").select("file_id", "text", extension(F.col("path")).alias("extension"))
    told = read.mapInArrow(run, f"file_id {kind}, by_text string, whose string").groupBy("file_id").agg(F.min("by_text").alias("by_text"), F.min("whose").alias("whose"), F.lit(True).alias("has_text"))
    seen = written(clean.join(told, "file_id", "left").withColumn("by_path", customary(F.col("path"))))

    # A banner that many files of the project have is its own.
    sizes = seen.groupBy("project_id").agg(F.count("*").alias("n_files"))
    banners = seen.where("whose is not null").groupBy("project_id", "whose").agg(F.count("*").alias("n")).join(sizes, "project_id")
    own = banners.where((F.col("n") >= OWN_FILES) & (F.col("n") >= OWN_SHARE * F.col("n_files"))).select("project_id", "whose", F.lit(True).alias("own"))
    seen = seen.join(own, ["project_id", "whose"], "left").withColumn("by_text", F.when(F.col("own"), None).otherwise(F.col("by_text"))).drop("own", "whose")

    said = declared(clean.select("file_id", "project_id", "path"), texts.select("file_id", F.col("path").alias("text_path"), "text"))
    yes = lambda k: F.bool_or((F.col("kind") == k) & F.col("declared"))
    no = lambda k: F.bool_or((F.col("kind") == k) & ~F.col("declared"))
    said = said.groupBy("file_id").agg(*[f(k).alias(f"{name}_{k}") for name, f in (("is", yes), ("not", no)) for k in ("generated", "vendored", "minified")])
    marked = seen.join(said, "file_id", "left")
    by_attribute = F.when(F.col("is_vendored"), "vendored").when(F.col("is_generated"), "generated").when(F.col("is_minified"), "minified")

    # Mined: folders and endings of which nearly all files are declared or say so, over all projects.
    marked = marked.withColumn("mark", F.coalesce(by_attribute, F.when(F.col("by_text").isin("generated", "vendored"), F.col("by_text"))))
    name = F.element_at(F.split("path", "/"), -1)
    traits = F.array_distinct(F.concat(F.transform(F.coalesce(folders(F.col("path")), F.array().cast("array<string>")), lambda x: F.concat(F.lit("folder "), x)), F.array(F.concat(F.lit("ending "), F.lower(F.regexp_extract(name, r"[._-]([A-Za-z]{2,12}(?:\.[A-Za-z]{2,12})?\.[A-Za-z0-9]{1,5})$", 1))))))
    each = marked.where("path is not null").select("file_id", "mark", F.explode(traits).alias("trait")).where("trait <> 'ending '")
    mined = each.groupBy("trait").agg(F.count("*").alias("n"), F.count("mark").alias("told"), F.mode("mark").alias("kind")).where((F.col("n") >= mined_files) & (F.col("told") >= mined_share * F.col("n"))).select("trait", "kind")
    by_mined = each.where("mark is null").join(mined, "trait").groupBy("file_id").agg(F.min("kind").alias("by_mined"))

    last = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    by_size = F.when(F.col("has_text").isNull() & last.isin(*CODE) & (F.col("bytes") >= HUGE), "data")
    holds = lambda c: F.when(~F.coalesce(F.when(c == "generated", F.col("not_generated")).when(c == "vendored", F.col("not_vendored")).when(c == "minified", F.col("not_minified")), F.lit(False)), c)
    ways = [("attributes", by_attribute), ("text", holds(F.col("by_text"))), ("path", holds(F.col("by_path"))), ("mined", holds(F.col("by_mined"))), ("size", by_size)]
    evidence = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in ways])
    found = marked.join(by_mined, "file_id", "left").select("file_id", F.coalesce(*[c for _, c in ways]).alias("kind"), evidence.alias("evidence"))
    return found.where("kind is not null")


def bytes_of(size: Column) -> Column:
    """The bytes that a human-readable size stands for, null where it stands for none."""
    number, unit = F.expr("try_cast(regexp_extract(size, '([0-9]+(?:[.][0-9]+)?)', 1) as double)"), F.upper(F.regexp_extract(size, r"([A-Za-z])[A-Za-z]*\s*$", 1))
    return (number * F.when(unit == "K", 1024.0).when(unit == "M", 1024.0**2).when(unit == "G", 1024.0**3).when(unit == "T", 1024.0**4).otherwise(1.0)).cast("long")


def project_files(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """files and texts for classify(): files_new with the newest preview of the same path and its size; a file without a path has the text's."""
    files = table(spark, d, "files_new", "pk", "project_id", "path").where("pk is not null").groupBy(F.col("pk").alias("file_id")).agg(F.min("project_id").alias("project_id"), F.min("path").alias("path"))
    texts = table(spark, d, "source_files", "file_id", "path", "source").withColumnRenamed("source", "text")
    previews = table(spark, d, "file_previews", "project_id", "relative_path", "size", "scanned_at").where("relative_path is not null").withColumn("clean", clean_path(F.col("relative_path")))
    sizes = previews.groupBy("project_id", "clean").agg(F.max_by("size", "scanned_at").alias("size"), F.max_by("relative_path", "scanned_at").alias("relative_path"))
    named = texts.where("path is not null").groupBy("file_id").agg(F.min("path").alias("text_path"))
    files = files.join(named, "file_id", "left").withColumn("path", F.coalesce("path", "text_path")).withColumn("clean", clean_path(F.col("path")))
    return files.join(sizes, ["project_id", "clean"], "left").select("file_id", "project_id", F.coalesce("path", "relative_path").alias("path"), bytes_of(F.col("size")).alias("bytes"), "size"), texts


def p2_found(spark, d: str) -> DataFrame:
    """The files not written by hand."""
    return classify(*project_files(spark, d)).select("file_id")


def p2_kinds(spark, d: str) -> DataFrame:
    """The kind and the evidence of each file not written by hand, with its path and its newest preview's size."""
    files, texts = project_files(spark, d)
    return classify(files, texts).join(files.select("file_id", "project_id", "path", "size"), "file_id")


QUERIES = {"p2_found": p2_found, "p2_kinds": p2_kinds}
SQL: dict[str, str] = {}
