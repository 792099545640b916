"""Cutting a parsed file into chunks for embedding: enrich, merge, split, fill the gaps.

The folds are sequential within a file, so they run in Python, a file at a time; files are
independent, so the operator is a map over the files without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame

from loomdex.functions.parsers import Parsed, Symbol, parse

CONTAINERS = frozenset(("element", "script", "style", "rule", "media", "keyframes"))
STYLES = frozenset(("style", "rule", "media", "keyframes"))
#: A chunk under so many tokens is tiny; a chunk's header is taken to need as many.
TINY = HEADER = 50


@dataclass(frozen=True)
class Config:
    """Sizes in tokens."""

    most: int = 800
    least: int = 100
    merge: bool = True
    comments: bool = True

    @property
    def preferred(self) -> int:
        size = self.most if self.most > 0 else 800
        return max(size // 2 or size, self.least, 100)


@dataclass(frozen=True)
class Piece:
    """A chunk. ``symbols`` are (name, kind); with several, name and kind are made of them."""

    path: str
    language: str
    first: int
    last: int
    source: str
    symbols: tuple[tuple[str, str], ...] = ()
    label: str = ""
    sort: str = ""
    doc: str = ""
    start_byte: int = 0
    end_byte: int = 0
    parent: str = ""
    signature: str = ""
    visibility: str = ""
    comments: bool = True

    @property
    def entries(self) -> str:
        return ", ".join(f"{n} ({k})" if n else k for n, k in self.symbols)

    @property
    def name(self) -> str:
        return self.label if not self.symbols else self.symbols[0][0] if len(self.symbols) == 1 else self.entries

    @property
    def kind(self) -> str:
        return self.sort if not self.symbols else self.symbols[0][1] if len(self.symbols) == 1 else "group"

    @property
    def content(self) -> str:
        head = f"# Symbols: {self.entries}\n" if self.symbols else f"# Symbol: {self.label}\n" if self.label else ""
        docs = "".join(f"// {x.strip()}\n" for x in self.doc.split("\n")) + "\n" if self.comments and self.doc else ""
        return f"# File: {self.path} ({self.language})\n{head}\n{docs}{self.source}"

    @property
    def tokens(self) -> int:
        return len(self.content.encode("utf-8", "surrogatepass")) // 4

    @property
    def group(self) -> str:
        kinds = {k for _, k in self.symbols} | {self.kind}
        return "template" if "element" in kinds else "style" if kinds & STYLES else "code"


def joined(a: str, b: str) -> str:
    """Two texts with a blank line between; a blank one gives way."""
    if not a.strip() or not b.strip():
        return b if not a.strip() else a
    return a.rstrip("\n") + "\n\n" + b.lstrip("\n")


def comment_only(lines: list[str]) -> bool:
    """Whether the lines are blank or comment, by their beginnings; what follows the end of a block comment is code."""
    close = ""
    for line in map(str.strip, lines):
        if not line:
            continue
        if not close:
            if line.startswith(("//", "#")) or line.startswith("*"):
                continue
            close = "*/" if line.startswith("/*") else "-->" if line.startswith(("<!--", "-->")) else ""
            if not close:
                return False
        if close in line:
            if line[line.index(close) + len(close) :].strip():
                return False
            close = ""
    return True


def containing(symbols: list[Symbol]) -> list[bool]:
    """Of each symbol whether it strictly contains another: by bytes, or by lines where its own bytes are both 0. One sweep for each of the two."""
    out = [False] * len(symbols)
    for by_bytes in (True, False):
        span = (lambda s: (s.start_byte, s.end_byte)) if by_bytes else (lambda s: (s.start_line, s.end_line))
        least: float = float("inf")  # the least end of the spans that begin at this one's start or later, but for its own like
        order = sorted(range(len(symbols)), key=lambda k: (-span(symbols[k])[0], span(symbols[k])[1]))
        at = 0
        while at < len(order):
            begin, end = span(symbols[order[at]])
            stop = at
            while stop < len(order) and span(symbols[order[stop]]) == (begin, end):
                if least <= end and by_bytes == bool(symbols[order[stop]].start_byte or symbols[order[stop]].end_byte):
                    out[order[stop]] = True
                stop += 1
            least, at = min(least, end), stop
    return out


def eligible(symbols: list[Symbol]) -> list[Symbol]:
    """The symbols that become chunks: no links, no containers of others, no local variables or constants."""
    last_child: dict[str, list[int]] = {}
    for s in symbols:
        last_child.setdefault(s.parent, []).append(s.start_line)
    latest = {name: max(lines) for name, lines in last_child.items()}
    out = []
    for s, contains in zip(symbols, containing(symbols), strict=True):
        inner = s.kind in CONTAINERS and contains
        # A heading that names itself as parent is none of its own children.
        section = s.kind == "heading" and s.name in latest and (latest[s.name] >= s.start_line if s.parent != s.name else any(o is not s and o.parent == s.name and o.start_line >= s.start_line for o in symbols))
        if not (s.kind == "link" or inner or section or s.kind in ("variable", "constant") and s.parent):
            out.append(s)
    return out


def enrich(path: str, parsed: Parsed, config: Config) -> list[Piece]:
    return [
        Piece(path, parsed.language, s.start_line, s.end_line, s.source, ((s.name, s.kind),), doc=s.doc, start_byte=s.start_byte, end_byte=s.end_byte, parent=s.parent, signature=s.signature, visibility=s.visibility, comments=config.comments)
        for s in eligible(parsed.symbols)
    ]


def merge_two(a: Piece, b: Piece) -> Piece:
    """One chunk over both; a start byte of 0 counts as unknown. Without comments, those of gap texts are left out."""
    text = lambda p: "\n".join(x for x in p.source.split("\n") if not re.match(r"\s*($|//|#|/\*|<!--)", x)) if not p.comments and p.kind == "text" else p.source
    return replace(
        a, symbols=a.symbols + b.symbols, first=min(a.first, b.first), last=max(a.last, b.last), start_byte=b.start_byte if not a.start_byte else min(a.start_byte, b.start_byte),
        end_byte=max(a.end_byte, b.end_byte), source=joined(text(a), text(b)), doc="\n".join(x for x in (a.doc, b.doc) if x),
    )


def may_join(a: Piece, grown: bool, b: Piece, config: Config) -> bool:
    """Whether b may be joined to its predecessor a, which is joined already if ``grown``: they are alike and fit, a isn't large yet, and one of them is small enough to ask for it."""
    like = (a.path, a.language, a.group) == (b.path, b.language, b.group)
    asks = max(a.tokens, b.tokens) < config.least or b.tokens < TINY or (a.tokens < TINY and not grown)
    return like and asks and a.tokens < config.preferred and a.tokens + b.tokens <= config.most


def merge_small(pieces: list[Piece], config: Config) -> list[Piece]:
    """Joins neighbours as may_join() allows, in one fold: what can't be joined to its predecessor waits for its successor."""
    if not config.merge:
        return pieces

    def step(done: list[tuple[Piece, bool]], p: Piece) -> list[tuple[Piece, bool]]:
        return [*done[:-1], (merge_two(done[-1][0], p), True)] if done and may_join(*done[-1], p, config) else [*done, (p, False)]

    done: list[tuple[Piece, bool]] = []
    for p in pieces:
        done[-1:] = step(done[-1:], p)
    return [p for p, _ in done]


def line_groups(lines: list[str], room: int) -> list[tuple[int, list[str]]]:
    """Lines in groups of at most ``room`` tokens, each with the number of its first; a longer line is a group by itself."""
    out: list[tuple[int, list[str]]] = []
    left = -1
    for n, line in enumerate(lines):
        size = len(line.encode("utf-8", "surrogatepass")) // 4
        if size > left or not out:
            out.append((n, []))
            left = room
        out[-1][1].append(line)
        left -= size
    return out


def split_piece(p: Piece, target: int, config: Config) -> list[Piece]:
    """The piece cut at line ends, so that each part and its header keep to the target; a part that is still over the most is
    cut to half the target, down to 20. A line is never cut."""
    most = config.most if config.most > 0 else target * 2
    out = []
    for n, lines in line_groups(p.source.split("\n"), max((target if target > 0 else 400) - HEADER, 10)):
        first, last = p.first + n, p.first + n + len(lines) - 1
        part = replace(p, source="\n".join(lines), first=first, last=last, label=f"{p.name}[{first}-{last}]", sort=p.kind, start_byte=0, end_byte=0)
        out += split_piece(part, max(target // 2, 20), config) if part.tokens > most and target > 20 else [part]
    return out


def split_large(pieces: list[Piece], config: Config) -> list[Piece]:
    return [x for p in pieces for x in (split_piece(p, config.preferred, config) if p.tokens > config.preferred else [p])]


def gap_name(lines: list[str], first: int, last: int) -> str:
    """A gap's first heading or code fence, else its line numbers."""
    for line in map(str.strip, lines):
        if line.startswith("#") and line.lstrip("# "):
            return line.lstrip("# ")
        if line.startswith("```"):
            return f"code:{line[3:]}" if line[3:] else "code"
        if line.startswith("<h") and len(line) > 3:
            return "html-heading"
    return f"L{first}" if first == last else f"L{first}-{last}"


def fill_gaps(pieces: list[Piece], source: str, path: str, language: str, config: Config) -> list[Piece]:
    """Covers the lines between the pieces: comments go to the next piece, or else to the one before; other text is taken in by
    a piece before that is under the preferred size, and is a piece of its own otherwise. No pieces at all give one for the file."""
    lines = source.split("\n")
    if not pieces:
        return [Piece(path, language, 1, len(lines), source, label="file-content", sort="file", end_byte=len(source.encode("utf-8", "surrogatepass")), comments=config.comments)]
    out: list[Piece] = []

    def gap(first: int, last: int) -> None:
        text = lines[first - 1 : last]
        if not text or last > len(lines) or comment_only(text):
            return
        new = Piece(path, language, first, last, "\n".join(text), label=gap_name(text, first, last), sort="text", comments=config.comments)
        if out and out[-1].tokens > config.preferred and out[-1].last >= first - 1:
            parts = split_piece(out[-1], config.preferred, config)
            if len(parts) > 1:
                out[-1:] = parts
                out.append(new)
                return
        if out and out[-1].tokens < config.preferred:
            out[-1] = replace(out[-1], source=joined(out[-1].source, new.source), last=last, end_byte=0)
        else:
            out.append(new)

    ends = 0
    for p in sorted(pieces, key=lambda p: p.first):
        own_end = p.last
        if p.first > ends + 1:
            first, last = ends + 1, p.first - 1
            text = lines[first - 1 : last]
            if text and comment_only(text):
                p = replace(p, source=joined("\n".join(text), p.source), first=first, start_byte=len("\n".join(lines[: first - 1]).encode("utf-8", "surrogatepass")) + (first > 1))
            else:
                gap(first, last)
        out.append(p)
        ends = own_end
    if out[-1].last < len(lines):
        first = out[-1].last + 1
        text = lines[first - 1 :]
        if comment_only(text):
            out[-1] = replace(out[-1], source=joined(out[-1].source, "\n".join(text)), last=len(lines), end_byte=0)
        else:
            gap(first, len(lines))
    return out


def chunk_file(path: str, source: str, config: Config = Config(), gaps: bool = True) -> tuple[list[Piece], Parsed]:  # noqa: B008
    """All stages for one file, or those but for the filling of gaps; ValueError for an extension without a parser."""
    parsed = parse(path, source)
    pieces = split_large(merge_small(enrich(path, parsed, config), config), config)
    if not gaps:
        return pieces, parsed
    pieces = fill_gaps(pieces, source, path, parsed.language, config)
    return split_large(merge_small(pieces, config), config), parsed


SYMBOLS = "file_id long, path string, pos int, name string, kind string, start_line int, end_line int, start_byte int, end_byte int, signature string, parent string, visibility string, doc string"
CHUNKS = "file_id long, path string, language string, ordinal int, symbol_name string, symbol_kind string, line_start int, line_end int, char_start int, char_end int, token_count int, doc_string string, content string, source_code string"


def _rows(files: DataFrame, schema: str, make) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    types = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(lo, 200) for whole in batches for lo in range(0, whole.num_rows, 200)):
            rows = [r for i, p, s in zip(*(batch.column(c).to_pylist() for c in ("file_id", "path", "source")), strict=True) for r in make(i, p, s)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return files.where("path is not null and source is not null").select("file_id", "path", "source").mapInArrow(run, schema)


def symbols(files: DataFrame) -> DataFrame:
    """The symbols of each file (file_id, path, source); files of other languages, and null paths or sources, have none."""

    def make(i, p, s):
        try:
            found = parse(p, s).symbols
        except ValueError:
            return
        for n, x in enumerate(found):
            yield (i, p, n, x.name, x.kind, x.start_line, x.end_line, x.start_byte, x.end_byte, x.signature, x.parent, x.visibility, x.doc)

    return _rows(files, SYMBOLS, make)


def chunks(files: DataFrame, config: Config = Config()) -> DataFrame:  # noqa: B008
    """The chunks of each file (file_id, path, source) whose language has a parser; others are for line_chunks()."""

    def make(i, p, s):
        try:
            pieces, _ = chunk_file(p, s, config)
        except ValueError:
            return
        for n, x in enumerate(pieces):
            yield (i, p, x.language, n, x.name, x.kind, x.first, x.last, x.start_byte, x.end_byte, x.tokens, x.doc, x.content, x.source)

    return _rows(files, CHUNKS, make)
