"""From source text to symbols, a parser for each language, on the standard library alone.

Each gives symbols in order of position, imports and errors. Literals and comments are masked
first, with their lengths kept, so that declarations are found by patterns and their ends by
counting brackets. Broken text gives what can be told and an error; it never raises.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from html.parser import HTMLParser
from itertools import accumulate

from loomdex.functions.scalars import LANGUAGES, SUPPORTED


@dataclass(frozen=True)
class Symbol:
    """A named piece of a file. Lines count from 1, bytes from 0; the end byte is exclusive."""

    name: str
    kind: str
    start_line: int
    end_line: int
    start_byte: int
    end_byte: int
    source: str
    signature: str = ""
    parent: str = ""
    visibility: str = ""
    doc: str = ""


@dataclass
class Parsed:
    """What a parser found in a file."""

    language: str
    symbols: list[Symbol] = field(default_factory=list)
    imports: list[str] = field(default_factory=list)
    errors: list[tuple[int, int, str]] = field(default_factory=list)


class Text:
    """A source with its line starts and byte offsets, and a masked copy of equal length."""

    def __init__(self, source: str, mask: re.Pattern[str] | None = None):
        self.source = source
        self.masked = mask.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), source) if mask else source
        self.starts = [0, *(m.end() for m in re.finditer("\n", source))]
        self.ascii = source.isascii()
        self.bytes = self._bytes()

    def _bytes(self) -> list[int]:
        """The byte offset of each line's start; of an ASCII text that of its letters."""
        if self.ascii:
            return self.starts
        ends = [*self.starts[1:], len(self.source)]
        return [0, *accumulate(len(self.source[a:b].encode("utf-8", "surrogatepass")) for a, b in zip(self.starts, ends, strict=True))]

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def byte(self, at: int) -> int:
        if self.ascii:
            return at
        n = self.line(at) - 1
        return self.bytes[n] + len(self.source[self.starts[n] : at].encode("utf-8", "surrogatepass"))

    def symbol(self, name: str, kind: str, a: int, b: int, **more: str) -> Symbol:
        return Symbol(name, kind, self.line(a), self.line(max(a, b - 1)), self.byte(a), self.byte(b), self.source[a:b], **more)

    def close(self, at: int) -> int:
        """The place after the bracket that closes the one at ``at``; the text's end if none does."""
        depth = 0
        for m in re.compile(r"[(\[{]|[)\]}]").finditer(self.masked, at):
            depth += 1 if m.group() in "([{" else -1
            if not depth:
                return m.end()
        return len(self.source)

    def unbalanced(self) -> list[tuple[int, int, str]]:
        """An error for the first bracket that doesn't match."""
        open_: list[tuple[str, int]] = []
        for m in re.finditer(r"[()\[\]{}]", self.masked):
            if m.group() in "([{":
                open_.append((m.group(), m.start()))
            elif not open_ or open_.pop()[0] + m.group() not in ("()", "[]", "{}"):
                return [self.error(m.start(), f"unexpected {m.group()}")]
        return [self.error(open_[0][1], f"{open_[0][0]} is not closed")] if open_ else []

    def error(self, at: int, message: str) -> tuple[int, int, str]:
        n = self.line(at)
        return n, at - self.starts[n - 1] + 1, message

    def comment_above(self, at: int, line_sign: str) -> str:
        """The comment that ends above the line of ``at``, its signs left out; blank lines between are passed over."""
        lines, n, out = self.source.split("\n"), self.line(at) - 2, []
        while n >= 0 and not lines[n].strip():
            n -= 1
        if n >= 0 and lines[n].rstrip().endswith("*/"):
            while n >= 0:
                out.append(re.sub(r"^\s*(?:/\*+|\*(?!/))?\s?|\s*\*/\s*$", "", lines[n]))
                if "/*" in lines[n]:
                    break
                n -= 1
        else:
            while n >= 0 and lines[n].lstrip().startswith(line_sign):
                out.append(lines[n].strip().lstrip(line_sign[0]).strip())
                n -= 1
        return "\n".join(reversed(out)).strip("\n")


C_LIKE = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|`[^`]*(?:`|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?", re.S)


def parse_go(source: str) -> Parsed:
    """Functions, methods (parent: the receiver's type), types and top-level or local constants and variables."""
    t, out = Text(source, C_LIKE), Parsed("go")
    code = t.masked
    seen = lambda n: "public" if n[:1].isupper() else "private"
    spans: list[tuple[int, int, str]] = []
    found: list[tuple[int, Symbol]] = []
    for m in re.finditer(r"^[ \t]*func\b[ \t]*(\([^)]*\))?[ \t]*([^\W\d]\w*)[ \t]*(?:\[[^\]]*\])?(?=\()", code, re.M):
        end = t.close(code.index("(", m.end()))
        result = re.match(r"[ \t]*(\([^)]*\)|[\w.*\[\]]+(?:\{\})?)?", code[end:])
        signature = source[m.end() : end] + ((" " + result.group(1)) if result and result.group(1) else "")
        body = code.find("{", end)
        stop = t.close(body) if body >= 0 and "\n" not in code[end:body] else end
        a = m.start() + len(m.group()) - len(m.group().lstrip())
        receiver = re.search(r"\*?\s*([^\W\d]\w*)\s*(?:\[[^\]]*\])?\s*\)$", m.group(1) or "")
        found.append((a, t.symbol(m.group(2), "method" if m.group(1) else "function", a, stop, signature=signature, parent=receiver.group(1) if receiver else "", visibility=seen(m.group(2)), doc=t.comment_above(a, "//"))))
        spans.append((a, stop, m.group(2)))
    inside = lambda at: next((n for a, b, n in reversed(spans) if a < at < b), "")
    for m in re.finditer(r"^([ \t]*)(type|const|var)\b[ \t]*(\()?", code, re.M):
        if m.group(3):
            stop = t.close(m.end() - 1)
            rows = re.finditer(r"^[ \t]*([^\W\d]\w*(?:\s*,\s*[^\W\d]\w*)*)([^\n]*)", code[m.end() : stop - 1], re.M)
            items = [(m.end() + r.start() + len(r.group()) - len(r.group().lstrip()), r.group(1), r.group(2)) for r in rows]
        else:
            r = re.match(r"[ \t]*([^\W\d]\w*(?:\s*,\s*[^\W\d]\w*)*)([^\n]*)", code[m.end() :])
            items = [(m.start() + len(m.group(1)), r.group(1), r.group(2))] if r else []
        last = 0
        for a, names, rest in items:
            if a < last:
                continue
            line_end = code.find("\n", a)
            line_end = len(code) if line_end < 0 else line_end
            brace = re.compile(r"[({\[]").search(code, a, line_end)
            last = max(line_end, t.close(code.index("{", a)) if "{" in code[a:line_end] else line_end) if brace else line_end
            stop = last if last > line_end else len(code[:line_end].rstrip())
            for name in re.split(r"\s*,\s*", names):
                kind = {"const": "constant", "var": "variable"}.get(m.group(2)) or ("struct" if re.match(r"(?:\[[^\]]*\])?\s*struct\b", rest.strip()) else "interface" if re.match(r"(?:\[[^\]]*\])?\s*interface\b", rest.strip()) else "type_alias")
                found.append((a, t.symbol(name, kind, a, stop, parent=inside(a) if m.group(2) != "type" else "", visibility=seen(name), doc=t.comment_above(a, "//"))))
    out.symbols = [s for _, s in sorted(found, key=lambda x: x[0])]
    for m in re.finditer(r"^import\b\s*(?:\(([^)]*)\)|[^\n]*)", source, re.M):
        out.imports += re.findall(r"[\"`]([^\"`\n]+)[\"`]", m.group())
    out.errors = t.unbalanced()
    return out


def parse_python(source: str) -> Parsed:
    """Functions, methods (first parameter self or cls) and classes at any depth, decorated ones too; docstrings; imports without aliases.

    A source that doesn't parse gives an error and what its lines and their indentation tell.
    """
    t, out = Text(source), Parsed("python")
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        out.errors = [(getattr(e, "lineno", None) or 1, getattr(e, "offset", None) or 1, str(getattr(e, "msg", e)))]
        _python_by_lines(source, out)
        return out

    def place(line: int, column: int) -> int:
        start = t.starts[line - 1]
        return start + (column if t.ascii else len(source[start:].split("\n", 1)[0].encode()[:column].decode("utf-8", "ignore")))

    def walk(node: ast.AST, parent: str) -> None:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                a, b = place(x.lineno, x.col_offset), place(x.end_lineno or x.lineno, x.end_col_offset or 0)
                is_class = isinstance(x, ast.ClassDef)
                first = "" if is_class else next((p.arg for p in [*x.args.posonlyargs, *x.args.args]), "")
                kind = "class" if is_class else "method" if first in ("self", "cls") else "function"
                seen = _seen_python(x.name)
                signature = "" if is_class else "(" + ast.unparse(x.args) + ")" + (f" -> {ast.unparse(x.returns)}" if x.returns else "")
                out.symbols.append(t.symbol(x.name, kind, a, b, signature=signature, parent=parent, visibility=seen, doc=ast.get_docstring(x) or ""))
                walk(x, x.name)
            else:
                if isinstance(x, ast.Import):
                    out.imports += [n.name for n in x.names if not n.asname]
                elif isinstance(x, ast.ImportFrom):
                    out.imports.append("." * x.level + (x.module or ""))
                walk(x, parent)

    walk(tree, "")
    return out


PYTHON = re.compile(r"#[^\n]*|\"\"\".*?(?:\"\"\"|\Z)|\'\'\'.*?(?:\'\'\'|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?", re.S)


def _seen_python(name: str) -> str:
    return "private" if name.startswith("__") else "protected" if name.startswith("_") else "public"


def _python_by_lines(source: str, out: Parsed) -> None:
    """The symbols and imports of a source that doesn't parse: a definition lasts as long as its lines are indented further."""
    t = Text(source, PYTHON)
    lines, opened, found = t.masked.split("\n"), [], []

    def close(upto: int, last: int) -> None:
        while opened and opened[-1][0] >= upto:
            _, at, name, kind, parent, signature = opened.pop()
            end = t.starts[last] + len(lines[last].rstrip())
            body = re.compile(r"[^\n]*\n\s*(?:\"\"\"(.*?)\"\"\"|\'\'\'(.*?)\'\'\')", re.S).match(source, at, end)
            doc = "\n".join(x.strip() for x in (body[1] or body[2] or "").strip().split("\n")) if body else ""
            found.append((at, t.symbol(name, kind, at, max(end, at + 1), signature=signature, parent=parent, visibility=_seen_python(name), doc=doc)))

    last = 0
    for n, line in enumerate(lines):
        if not line.strip():
            continue
        width = len(line) - len(line.lstrip())
        close(width, last)
        last = n
        m = re.match(r"\s*(?:async\s+)?(def|class)\s+([^\W\d]\w*)\s*(\(?)", line)
        if m:
            end = t.close(t.starts[n] + m.end() - 1) if m[3] else t.starts[n] + m.end()
            signature = source[t.starts[n] + m.end() - 1 : end] if m[3] and m[1] == "def" else ""
            kind = "class" if m[1] == "class" else "method" if re.match(r"\(\s*(?:self|cls)\b", signature) else "function"
            opened.append((width, t.starts[n] + width, m[2], kind, opened[-1][2] if opened else "", signature))
        elif m := re.match(r"\s*import\s+([\w., ]+)", line):
            out.imports += [x.strip() for x in m[1].split(",") if x.strip() and " as " not in x]
        elif m := re.match(r"\s*from\s+([.\w]+)\s+import\b", line):
            out.imports.append(m[1])
    close(0, last)
    out.symbols = [s for _, s in sorted(found, key=lambda x: x[0])]


def parse_script(source: str, language: str = "typescript") -> Parsed:
    """Functions, classes, methods, arrow functions with a name, inline arrows named after the call that takes them, and others by their line."""
    t, out = Text(source, C_LIKE), Parsed(language)
    code, found, classes = t.masked, {}, []

    def body(at: int) -> int:
        """The end of what follows a parameter list: a block, or an expression to the end of its line."""
        m = re.compile(r"\s*(?::\s*[^={;\n]+(?:\{[^}]*\})?[^={;\n]*)?\s*(?:=>\s*)?").match(code, at)
        k = m.end() if m else at
        if code[k : k + 1] in ("{", "("):
            return t.close(k)
        depth = 0
        for x in re.compile(r"[(\[{]|[)\]}]|[;,\n]").finditer(code, k):
            depth += (x.group() in "([{") - (x.group() in ")]}")
            if depth < 0 or not depth and x.group() in ";,\n":
                return k + len(code[k : x.start()].rstrip())
        return len(code.rstrip())

    for m in re.finditer(r"\bclass\s+([A-Za-z_$][\w$]*)[^{;\n]*\{", code):
        end = t.close(m.end() - 1)
        classes.append((m.end(), end, m.group(1)))
        found[m.start()] = t.symbol(m.group(1), "class", m.start(), end, visibility="public", doc=t.comment_above(m.start(), "//"))
    # The innermost class at each place where one begins or ends.
    edges, names, open_ = [0], [""], []
    for at, _, name in sorted([(a, 1, n) for a, _, n in classes] + [(b, 0, "") for _, b, _ in classes]):
        open_.append(name) if name else open_.pop()
        edges.append(at)
        names.append(open_[-1] if open_ else "")
    of = lambda at: names[bisect_right(edges, at) - 1]
    braces = [0, *accumulate((c == "{") - (c == "}") for c in code)]
    for m in re.finditer(r"(?:\basync\s+)?\bfunction\b\s*\*?\s*([A-Za-z_$][\w$]*)\s*(?:<[^(]*>)?\s*(?=\()", code):
        end = t.close(m.end())
        found[m.start()] = t.symbol(m.group(1), "function", m.start(), body(end), signature=source[m.end() : end], parent=of(m.start()), visibility="public", doc=t.comment_above(m.start(), "//"))
    arrow = r"(?:async\s*)?(?:<[^>\n]*>\s*)?(?:\((?:[^()]|\([^()]*\))*\)\s*(?::\s*[^=;{\n]+?)?|[A-Za-z_$][\w$]*)\s*=>"
    for m in re.finditer(r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=\s*(?=" + arrow + r"|(?:async\s+)?function\b)", code):
        a = code.find("=>", m.end()) if not re.match(r"(?:async\s+)?function\b", code[m.end() :]) else code.find("(", m.end())
        end = body(a) if code[a : a + 2] == "=>" else body(t.close(a))
        found[m.start()] = t.symbol(m.group(1), "function", m.start(), end, parent=of(m.start()), visibility="public", doc=t.comment_above(m.start(), "//"))
    for a, b, name in classes:
        for m in re.compile(r"^[ \t]*((?:(?:public|private|protected|static|async|override|readonly|abstract|get|set)\s+)*)\*?\s*(#?[A-Za-z_$][\w$]*)\s*(?:<[^(\n]*>)?\s*(?=\()", re.M).finditer(code, a, b):
            end = t.close(m.end())
            if m.group(2) in ("if", "for", "while", "switch", "catch", "return", "function", "super") or of(m.start(2)) != name or not re.match(r"\s*(?::[^{;\n]*)?\{", code[end:]) or braces[a] != braces[m.start(2)]:
                continue
            at = m.start() + len(m.group()) - len(m.group().lstrip())
            seen = next((w for w in ("private", "protected") if w in m.group(1)), "public")
            found[at] = t.symbol(m.group(2), "method", at, body(end), signature=source[m.end() : end], parent=name, visibility=seen, doc=t.comment_above(at, "//"))
    functions, calls = {x.start_line for x in found.values() if x.kind == "function"}, []
    for m in re.finditer(r"([A-Za-z_$][\w$.]*)\s*\((?=(?:[^()]*,\s*)?" + arrow + ")", code):
        if t.line(m.start()) not in functions and m.group(1) not in ("if", "while", "for", "switch", "function"):
            end = t.close(m.end() - 1)
            found.setdefault(m.start(), t.symbol(f"{m.group(1)} callback", "function", m.start(), end, visibility="public"))
            calls.append((m.start(), end))
    named = {m.end() for m in re.finditer(r"\b(?:const|let|var)\s+[A-Za-z_$][\w$]*\s*(?::[^=\n]+)?=\s*(?=" + arrow + ")", code)}
    # What begins after these is a value; a type may look like an arrow, but isn't followed so.
    for m in re.finditer(r"(?:(?<=[=?[])|(?<=\bdefault)|(?<=\breturn)|(?<=&&)|(?<=\|\||\?\?)|(?<=\w:)(?=[^\n]*=>\s*\{))\s*(?=" + arrow + ")", code):
        at = m.end()
        if at in named or at in found or re.search(r"\btype\s+[\w$<>, ]+=\s*$", code[max(0, m.start() - 80) : m.end()]):
            continue
        if any(a < at < b and code[a:at].rstrip().endswith(("(", ",")) for a, b in calls[-3:]):
            continue
        begin = code.find("=>", at)
        found[at] = t.symbol(f"arrow@L{t.line(at)}", "function", at, body(begin), parent=of(at), visibility="public")
    out.symbols = [found[k] for k in sorted(found)]
    out.imports = re.findall(r"^\s*(?:import|export)\b[^'\"\n;]*?(?:from\s*)?['\"]([^'\"\n]+)['\"]", source, re.M) + re.findall(r"\brequire\(\s*['\"]([^'\"\n]+)['\"]", source)
    out.errors = t.unbalanced()
    return out


class _Elements(HTMLParser):
    VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
    #: A start tag that ends open elements of these names.
    IMPLIED = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

    def __init__(self, t: Text):
        super().__init__(convert_charrefs=False)
        self.t, self.open, self.done, self.imports = t, [], [], []

    def at(self) -> int:
        n, column = self.getpos()
        return self.t.starts[n - 1] + column

    def end(self, k: int, at: int) -> None:
        while len(self.open) > k:
            name, tag, a, signature, parent = self.open.pop()
            kind = {"script": "script", "style": "style"}.get(tag, "element")
            self.done.append((a, self.t.symbol(name, kind, a, at, signature=signature, parent="" if kind != "element" else parent)))

    def handle_starttag(self, tag, attrs) -> None:
        a, values = self.at(), dict(attrs)
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][1] not in self.IMPLIED.get(tag, ()):
                break
            self.end(k, a)
        name = f"{tag}#{values['id']}" if values.get("id") else tag
        signature = " ".join(k if v is None else f"{k}='{v}'" for k, v in attrs)
        if tag == "link" and values.get("href") or tag == "script" and values.get("src"):
            self.imports.append(values.get("href") if tag == "link" else values.get("src"))
        self.open.append((name, tag, a, signature, self.open[-1][0] if self.open else ""))
        if tag in self.VOID:
            self.end(len(self.open) - 1, a + len(self.get_starttag_text() or ""))

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in self.VOID:
            self.end(len(self.open) - 1, self.at() + len(self.get_starttag_text() or ""))

    def handle_endtag(self, tag) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][1] == tag:
                close = self.t.source.find(">", self.at())
                self.end(k + 1, self.at())
                self.end(k, close + 1 if close >= 0 else len(self.t.source))
                return


def parse_html(source: str) -> Parsed:
    """Every element with a start tag, named tag or tag#id, with its attributes; scripts and styles; elements left open end where implied."""
    t, out = Text(source), Parsed("html")
    p = _Elements(t)
    try:
        p.feed(source)
        p.close()
    except Exception as e:  # the parser's own limits
        out.errors.append((1, 1, str(e)))
    p.end(0, len(source))
    out.symbols = [s for _, s in sorted(p.done, key=lambda x: (x[0], -x[1].end_byte))]
    out.imports = p.imports
    return out


def parse_css(source: str) -> Parsed:
    """Rules by selector, media queries and keyframes; nested ones too; imports."""
    t, out = Text(source, re.compile(r"/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?", re.S)), Parsed("css")
    for m in re.finditer(r"[^{};]*\{", t.masked):
        lead = len(m.group()) - len(m.group().lstrip())
        a, b = m.start() + lead, t.close(m.end() - 1)
        name = " ".join(source[a : m.end() - 1].split())
        kind = "media" if name.startswith("@media") else "keyframes" if re.match(r"@(?:-\w+-)?keyframes", name) else "rule"
        if name and not (name[0] == "@" and kind == "rule") and not re.fullmatch(r"(?:from|to|[\d.]+%)(?:\s*,\s*(?:from|to|[\d.]+%))*", name):
            out.symbols.append(t.symbol(name, kind, a, b))
    out.imports = [m[1] for m in re.finditer(r"@import\s+(?:url\(\s*)?['\"]?([^'\")\s;]+)", source)]
    out.errors = t.unbalanced()
    return out


def parse_markdown(source: str) -> Parsed:
    """Headings with their sections, code blocks and links; the parent is the heading above, by level."""
    t, out = Text(source), Parsed("markdown")
    lines, offsets = source.split("\n"), t.starts
    heads: list[tuple[int, int, str, str]] = []  # line index, level, name, parent
    above: list[tuple[int, str]] = []
    fence: tuple[int, str, str] | None = None
    extra: list[tuple[int, Symbol]] = []
    for n, line in enumerate(lines):
        mark = re.match(r"\s{0,3}(```+|~~~+)\s*([\w+-]*)", line)
        if fence:
            if mark and mark.group(1)[:3] == fence[1][:3]:
                a = offsets[fence[0]]
                extra.append((a, t.symbol(f"code:{fence[2]}" if fence[2] else "code", "code_block", a, offsets[n] + len(line), parent=above[-1][1] if above else "")))
                fence = None
            continue
        if mark:
            fence = (n, mark.group(1), mark.group(2))
        elif h := re.match(r"(#{1,6})\s+(.*?)\s*#*\s*$", line):
            level = len(h.group(1))
            while above and above[-1][0] >= level:
                above.pop()
            heads.append((n, level, h.group(2), above[-1][1] if above else ""))
            above.append((level, h.group(2)))
        else:
            for m in re.finditer(r"\[([^\]]+)\]\(([^)]+)\)", line):
                extra.append((offsets[n] + m.start(), t.symbol(m.group(1), "link", offsets[n] + m.start(), offsets[n] + m.end(), signature=m.group(2), parent=above[-1][1] if above else "")))
                if not re.match(r"https?://", m.group(2)):
                    out.imports.append(m.group(2))
    found = list(extra)
    for k, (n, level, name, parent) in enumerate(heads):
        until = next((m for m, other, _, _ in heads[k + 1 :] if other <= level), len(lines))
        found.append((offsets[n], t.symbol(name, "heading", offsets[n], offsets[until] if until < len(lines) else len(source), signature=f"h{level}", parent=parent)))
    out.symbols = [s for _, s in sorted(found, key=lambda x: (x[0], -x[1].end_byte))]
    return out


#: The statements that are named, by their verbs and what these act on; of others the verb is the name.
SQL_VERBS = {
    "CREATE": ("TABLE", "MATERIALIZED VIEW", "VIEW", "INDEX", "DATABASE", "SCHEMA", "FUNCTION", "PROCEDURE", "TYPE", "ROLE", "SEQUENCE", "EXTENSION", "TRIGGER"),
    "DROP": ("TABLE", "VIEW", "INDEX", "TYPE", "SCHEMA", "DATABASE", "ROLE", "SEQUENCE", "EXTENSION", "FUNCTION", "TRIGGER"), "ALTER": ("TABLE",),
}
_OBJECT = r"((?:\"[^\"]*\"|`[^`]*`|[\w$]+)(?:\s*\.\s*(?:\"[^\"]*\"|`[^`]*`|[\w$]+))*)"
_ACTS_ON = {"SELECT": r"\bfrom\s+", "WITH": r"\bfrom\s+", "INSERT": r"\binto\s+", "UPDATE": r"\bupdate\s+(?:only\s+)?", "DELETE": r"\bfrom\s+", "MERGE": r"\binto\s+", "TRUNCATE": r"\btruncate\s+(?:table\s+)?", "COPY": r"\bcopy\s+"}


def _sql_statements(masked: str) -> list[tuple[int, int]]:
    """Where statements begin and end. Semicolons in the body of a trigger, function or procedure don't end it."""
    out, begin, depth, body = [], 0, 0, False
    for m in re.finditer(r";|\b(?:begin|case|end|create)\b", masked, re.I):
        word = m.group().lower()
        if word == "create" and not masked[begin : m.start()].strip():
            body = bool(re.match(r"create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:constraint\s+)?(?:trigger|function|procedure)\b", masked[m.start() :], re.I))
        elif word in ("begin", "case"):
            depth += body
        elif word == "end":
            depth -= body and depth > 0
        elif word == ";" and not depth:
            out.append((begin, m.end()))
            begin, body = m.end(), False
    return [*out, (begin, len(masked))]


def _sql_name(body: str) -> str:
    """The verb and the object of a statement."""
    word = body.split(None, 1)[0].upper().strip("(")
    if word in SQL_VERBS:
        for what in SQL_VERBS[word]:
            m = re.match(rf"{word}\s+(?:or\s+replace\s+)?(?:(?:temp|temporary|unique|global|local|unlogged|constraint)\s+)*{what.replace(' ', chr(92) + 's+')}\s+(?:concurrently\s+)?(?:if\s+(?:not\s+)?exists\s+)?{_OBJECT}?", body, re.I)
            if m:
                return " ".join(x for x in (word, what, (m[1] or "").replace('"', "").replace("`", "")) if x)
        return word
    if word in _ACTS_ON:
        outer, inner = body, ""
        while outer != inner:  # what stands in parentheses comes after what doesn't
            inner, outer = outer, re.sub(r"\([^()]*\)", lambda m: " " * len(m.group()), outer)
        m = re.search(_ACTS_ON[word] + _OBJECT, outer, re.I) or re.search(_ACTS_ON[word] + _OBJECT, body, re.I)
        return " ".join(x for x in ("SELECT" if word == "WITH" and not re.search(r"\)\s*(?:insert|update|delete)\b", body, re.I) else word, m[1].replace('"', "").replace("`", "") if m else "") if x)
    return word


def parse_sql(source: str) -> Parsed:
    """One symbol a statement, named by its verb and object; a transaction is one too, and the parent of its statements."""
    t, out = Text(source, re.compile(r"--[^\n]*|/\*.*?(?:\*/|\Z)|'(?:[^']|'')*'?|\$(\w*)\$.*?(?:\$\1\$|\Z)", re.S)), Parsed("sql")
    found: list[tuple[int, int, Symbol]] = []
    begun: int | None = None
    for a, b in _sql_statements(t.masked):
        text = t.masked[a:b]
        begin, body = a + len(text) - len(text.lstrip()), text.strip().rstrip(";").strip()
        if not body:
            continue
        end = a + len(text.rstrip())
        word = body.split(None, 1)[0].upper()
        if re.fullmatch(r"(?:begin|start)(?:\s+(?:transaction|work))?", body, re.I) and begun is None:
            begun = begin
        elif word in ("COMMIT", "ROLLBACK", "END") and begun is not None:
            found.append((begun, -end, t.symbol("TRANSACTION", "sql_statement", begun, end, signature=source[begun:end].strip(), visibility="public")))
            begun = None
        else:
            found.append((begin, -end, t.symbol(_sql_name(body), "sql_statement", begin, end, signature=source[begin:end].strip(), visibility="public", parent="TRANSACTION" if begun is not None else "")))
    out.symbols = [s for *_, s in sorted(found, key=lambda x: x[:2])]
    out.errors = t.unbalanced()
    return out


def parse_json(source: str) -> Parsed:
    """A variable for each pair at any depth; the parent is the enclosing key, the signature the value's text."""
    t, out = Text(source), Parsed("json")
    tokens = list(re.finditer(r'"(?:[^"\\]|\\.)*"|[{}\[\]:,]|[^\s{}\[\]:,"]+', source))
    keys: list[tuple[str, int, int, str]] = []  # name, start, first value token, parent
    stack: list[tuple[str, tuple | None]] = []
    owner: list[str] = [""]
    waiting: tuple[str, int, str] | None = None
    for k, m in enumerate(tokens):
        x = m.group()
        if x[0] == '"' and k + 1 < len(tokens) and tokens[k + 1].group() == ":" and stack and stack[-1][0] == "{":
            waiting = (x[1:-1], m.start(), owner[-1])
        elif x == ":" and waiting:
            keys.append((waiting[0], waiting[1], k + 1, waiting[2]))
        elif x in "{[":
            stack.append((x, None))
            owner.append(waiting[0] if waiting and keys and keys[-1][2] == k else owner[-1])
        elif x in "}]" and stack:
            stack.pop()
            owner.pop()
    masked = Text(source, re.compile(r'"(?:[^"\\]|\\.)*"'))
    for name, a, k, parent in keys:
        if k >= len(tokens):
            continue
        v = tokens[k]
        end = masked.close(v.start()) if v.group() in "{[" else v.end()
        out.symbols.append(t.symbol(name, "variable", a, end, signature=source[v.start() : end], parent=parent))
    out.errors = masked.unbalanced()
    return out


def parse_vue(source: str) -> Parsed:
    """The first template, script and style section, each with what its own language's parser finds, moved to its place."""
    t, out = Text(source), Parsed("vue")
    for tag in ("template", "script", "style"):
        m = re.search(rf"<{tag}\b([^>]*)>(.*?)</{tag}>", source, re.S)
        if not m:
            continue
        out.symbols.append(t.symbol(tag, {"template": "element"}.get(tag, tag), m.start(), m.end(), signature=m.group(1).strip()))
        inner = {"template": parse_html, "script": parse_script, "style": parse_css}[tag](m.group(2))
        line, byte = t.line(m.start(2)) - 1, t.byte(m.start(2))
        out.symbols += [replace(s, start_line=s.start_line + line, end_line=s.end_line + line, start_byte=s.start_byte + byte, end_byte=s.end_byte + byte, parent=s.parent or tag) for s in inner.symbols]
        out.imports += inner.imports
    return out


PARSERS: dict[str, Callable[[str], Parsed]] = {
    "go": parse_go, "python": parse_python, "typescript": parse_script, "javascript": lambda s: parse_script(s, "javascript"), "html": parse_html, "css": parse_css, "scss": parse_css, "sass": parse_css, "vue": parse_vue,
    "markdown": parse_markdown, "sql": parse_sql, "json": parse_json,
}


def parse(path: str, source: str) -> Parsed:
    """What the parser of the path's extension, in any letter case, finds; ValueError for an extension without one."""
    m = re.search(r"\.[^./]*$", path or "")
    extension = m.group().lower() if m else ""
    if extension not in SUPPORTED:
        raise ValueError(f"unsupported file extension: {extension}")
    out = PARSERS[LANGUAGES[extension]](source)
    out.language = LANGUAGES[extension]
    return out
