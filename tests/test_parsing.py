"""Parsers, the chunker and the index from end to end."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomdex.functions.parsers import parse
from loomdex.operators import semantic as C
from loomdex.plans.engine import Index
from loomdex.sources import scan as scanning


def found(path, source):
    return {(s.name, s.kind): s for s in parse(path, source).symbols}


def test_go():
    src = 'package a\n\nimport "fmt"\n\n// Sum gives a sum.\nfunc Sum(a, b int) int {\n\treturn a + b // }\n}\n\n// Box holds.\ntype Box struct {\n\tn int\n}\n\nfunc (b *Box) Grow(x int) (int, error) {\n\tconst k = 2\n\treturn b.n * x, nil\n}\n\nconst (\n\tMost = 3\n\tleast = "{"\n)\n'
    s = found("a.go", src)
    assert parse("a.go", src).imports == ["fmt"] and s["Sum", "function"].doc == "Sum gives a sum." and s["Sum", "function"].end_line == 8 and s["Sum", "function"].visibility == "public"
    assert s["Grow", "method"].parent == "Box" and s["Box", "struct"].end_line == 13 and s["k", "constant"].parent == "Grow" and s["least", "constant"].parent == "" and s["Most", "constant"].start_line == 21
    assert parse("a.go", "package a\nfunc f( {\n").errors and parse("A.GO", src).language == "go"


def test_python():
    src = 'import os\nfrom math import pi\n\n@wraps\ndef f(a: int = 1) -> int:\n    """Says a lot."""\n    def inner():\n        pass\n\nclass K:\n    "Doc"\n    def __m(self): pass\n    async def _n(cls): pass\n'
    s = found("a.py", src)
    assert s["f", "function"].doc == "Says a lot." and s["inner", "function"].parent == "f" and s["__m", "method"].visibility == "private" and s["_n", "method"].visibility == "protected" and s["K", "class"].doc == "Doc"
    assert parse("a.py", src).imports == ["os", "math"] and parse("a.py", "def f(:").errors


def test_script():
    src = 'import { a } from "react";\nconst fs = require("fs");\n/** Adds. */\nexport function add(a: number): number { return a }\nconst mul = (a: number, b = "}"): number => a * b;\nclass K extends B {\n  constructor(x) { super(x) }\n  /** Divides. */\n  private async div<T>(a: T): Promise<T> { return a }\n}\nwatch(x, () => { go() });\n'
    s = found("a.ts", src)
    assert s["add", "function"].doc == "Adds." and ("mul", "function") in s and s["div", "method"].parent == "K" and s["div", "method"].visibility == "private" and ("watch callback", "function") in s and s["K", "class"].end_line == 10
    assert parse("a.js", src).imports == ["react", "fs"]


def test_markup_and_styles():
    html = '<html><head><script src="app.js"></script><style>a{}</style></head><body id="b"><p class="c">one<p>two<br></body></html>'
    s = found("a.html", html)
    assert s["body#b", "element"].signature == "id='b'" and sum(n == "p" for n, _ in [(x.name, 0) for x in parse("a.html", html).symbols]) == 2 and ("script", "script") in s and parse("a.html", html).imports == ["app.js"]
    css = '@import url("base.css");\n.a, #b { c: "}" }\n@media (x) { .d { e: f } }\n@keyframes k { from { a: b } to { c: d } }\n'
    assert [(x.name, x.kind) for x in parse("a.css", css).symbols] == [(".a, #b", "rule"), ("@media (x)", "media"), (".d", "rule"), ("@keyframes k", "keyframes")] and parse("a.css", css).imports == ["base.css"]
    vue = "<template>\n<div id='x'></div>\n</template>\n<script>\nimport a from 'vue'\nfunction f() {}\n</script>\n"
    v = found("a.vue", vue)
    assert v["div#x", "element"].start_line == 2 and v["f", "function"].start_line == 6 and v["f", "function"].parent == "script" and parse("a.vue", vue).imports == ["vue"]


def test_markdown_sql_json():
    md = "# Top\ntext [a](b.md) [c](https://d)\n## Under\n```go\n# no heading\n```\n# Next\n"
    s = found("a.md", md)
    assert s["Top", "heading"].end_line == 6 and s["Under", "heading"].parent == "Top" and s["code:go", "code_block"].parent == "Under" and s["Top", "heading"].signature == "h1" and parse("a.md", md).imports == ["b.md"] and ("no heading", "heading") not in s
    names = [x.name for x in parse("a.sql", "CREATE TABLE users (id int);\nINSERT INTO users VALUES (';');\nSELECT * FROM users;\n-- x;\nDROP TABLE users").symbols]
    assert names == ["CREATE TABLE users", "INSERT users", "SELECT users", "DROP TABLE users"]
    j = parse("a.json", '{"a": 1, "b": {"c": [true, {"d": "x:y"}]}, "e": null}')
    assert [(x.name, x.parent, x.signature) for x in j.symbols] == [("a", "", "1"), ("b", "", '{"c": [true, {"d": "x:y"}]}'), ("c", "b", '[true, {"d": "x:y"}]'), ("d", "c", '"x:y"'), ("e", "", "null")]
    with pytest.raises(ValueError):
        parse("a.xyz", "")


def piece(source, n=1, kind="function", **more):
    lines = source.count("\n")
    return C.Piece("a.go", "go", n, n + lines, source, ((f"f{n}", kind),), **more)


def test_merge_and_split():
    config = C.Config()
    a, b, big = piece("x = 1", 1), piece("y = 2", 3), piece("z" * 2000, 6)
    merged = C.merge_small([a, b, big], config)
    assert len(merged) == 2 and merged[0].name == "f1 (function), f3 (function)" and merged[0].kind == "group" and (merged[0].first, merged[0].last) == (1, 3) and merged[1] == big
    assert len(C.merge_small([a, piece("<p>", 3, "element")], config)) == 2 and len(C.merge_small([a, b], C.Config(merge=False))) == 2 and C.merge_small([], config) == []
    long = C.Piece("a.go", "go", 1, 100, "\n".join(["line of code"] * 100), label="big", sort="function")
    parts = C.split_piece(long, 50, C.Config(most=50, least=10))
    assert len(parts) > 1 and all(p.tokens <= 50 for p in parts) and parts[0].label.startswith("big[1-") and "\n".join(p.source for p in parts) == long.source
    assert C.split_large([a], config) == [a]


def test_gaps():
    pieces, _ = C.chunk_file("m.go", "package math\n\nvar x = 1\n\n// Add adds.\nfunc Add() {}\n")
    assert len(pieces) == 1 and "package math" in pieces[0].source and "func Add" in pieces[0].source
    pieces, _ = C.chunk_file("m.go", "// only\n// comments\nfunc F() {\n}\n")
    assert pieces[0].first == 1 and pieces[0].source.startswith("// only")
    pieces, _ = C.chunk_file("e.json", "[]")
    assert [(p.name, p.kind, p.first) for p in pieces] == [("file-content", "file", 1)]
    assert C.comment_only(["/* a", "b */", "", "// c", "* d"]) and not C.comment_only(["/* a */ x"]) and not C.comment_only(["<!-- a", "--> b"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["func f%d() {\n\treturn\n}", "var v%d = 1", "// note %d", "", "type T%d struct {\n\tx int\n}"]), st.integers(1, 9)), max_size=12))
def test_no_code_is_lost(parts):
    source = "package a\n" + "\n".join(t % n if "%d" in t else t for t, n in parts) + "\n"
    pieces, _ = C.chunk_file("a.go", source)
    have = "\n".join(p.source for p in pieces)
    for line in source.split("\n"):
        assert line.startswith("//") or line.strip() in have  # comments between merged pieces live on as documentation


def test_scan_and_index(spark, tmp_path):
    root = tmp_path / "code"
    (root / ".hid").mkdir(parents=True)
    (root / "vendor").mkdir()
    for name, text in {"a.go": "package a\n\n// Add adds numbers.\nfunc Add() {}\n", "b.txt": "some text\nand more\n", ".hid/x.go": "package x\n", "vendor/v.go": "package v\n", "c.py": "def search_tree(node):\n    return node\n"}.items():
        (root / name).write_text(text)
    (root / ".ign").write_text("# c\n\n!keep\n./build/\n*.log\n")
    paths = lambda **k: sorted(r.relative_path for r in scanning.scan(spark, str(root), **k).collect())
    assert paths() == ["a.go", "b.txt", "c.py", "vendor/v.go"] and paths(excludes=["vendor"], extensions=[".go"]) == ["a.go"] and ".hid/x.go" in paths(hidden=True) and paths(includes=["vendor", "."]) == paths()
    assert scanning.ignore_patterns(str(root / ".ign")) == ["**/build", "**/*.log"]
    index = Index(spark, str(root), str(tmp_path / "store"), excludes=["vendor"])
    assert index.update() == {"indexed": 3, "removed": 0, "files": 3} and index.update()["indexed"] == 0
    assert index.search("search tree node", 1).head().path == "c.py" and [r.name for r in index.outline("a.go").collect()] == ["Add"]
    assert index.read("b.txt").startswith("some text") and index.file_chunks("b.txt").head().line_end == -1
    first = index.file_chunks("a.go").head().id
    assert "func Add" in index.source_of(first) and index.stats().head().n_files == 3 and index.links().count() == 2
    (root / "a.go").write_text("package a\n\nfunc Sub() {}\n")
    (root / "c.py").unlink()
    assert index.update() == {"indexed": 1, "removed": 1, "files": 2} and [r.name for r in index.outline("a.go").collect()] == ["Sub"]
    for bad in ("../x", "/etc/passwd"):
        with pytest.raises(PermissionError):
            index.read(bad)
    with pytest.raises(ValueError):
        index.search(" ")
    with pytest.raises(LookupError):
        index.source_of("none")
    with pytest.raises(FileNotFoundError):
        index.read("none")


def test_broken_python_gives_what_its_lines_tell():
    broken = 'import os\nfrom a.b import c\n\nclass A:\n    """Doc of A."""\n    def f(self, x:\n        return x\n\n    async def g(self):\n        return 1\n\ndef _h(a):\n    return a +\n'
    p = parse("a.py", broken)
    assert p.errors and p.imports == ["os", "a.b"]
    assert [(s.name, s.kind, s.parent, s.start_line, s.end_line, s.visibility) for s in p.symbols] == [("A", "class", "", 4, 10, "public"), ("f", "method", "A", 6, 7, "public"), ("g", "method", "A", 9, 10, "public"), ("_h", "function", "", 12, 13, "protected")]
    assert p.symbols[0].doc == "Doc of A."


def test_arrows_without_a_name():
    found = parse("a.ts", "export default () => 1\nconst add = (a: number) => a\ntype F = (a: string) => void\nwatch(() => { x() })\nconst o = { a: (x) => { return 1 }, b: 2 }\nfunction f() { return (y) => y + 1 }\ninterface I { g: (a: number) => void }\n").symbols
    assert [(s.name, s.start_line) for s in found] == [("arrow@L1", 1), ("add", 2), ("watch callback", 4), ("arrow@L5", 5), ("f", 6), ("arrow@L6", 6)] and found[5].source == "(y) => y + 1"


def test_sql_bodies_and_transactions():
    text = "CREATE TRIGGER t AFTER INSERT ON users BEGIN DELETE FROM d; UPDATE x SET a = CASE WHEN 1 THEN 2 END; END;\nBEGIN;\nDELETE FROM a;\nCOMMIT;\nCREATE OR REPLACE FUNCTION f() RETURNS int AS $x$ BEGIN; END; $x$;\nCREATE MATERIALIZED VIEW mv AS SELECT 1;\nTRUNCATE TABLE q;\nWITH a AS (SELECT 1 FROM b) SELECT (SELECT 2 FROM z) FROM a;\nMERGE INTO m USING n ON 1=1;\nVACUUM"
    assert [(s.name, s.parent) for s in parse("a.sql", text).symbols] == [
        ("CREATE TRIGGER t", ""), ("TRANSACTION", ""), ("DELETE a", "TRANSACTION"), ("CREATE FUNCTION f", ""), ("CREATE MATERIALIZED VIEW mv", ""), ("TRUNCATE q", ""), ("SELECT a", ""), ("MERGE m", ""), ("VACUUM", ""),
    ]


def test_byte_offsets_of_letters_beyond_ascii():
    text = "é = 1\n\ndef ß():\n    return '日本'\n"
    s = parse("a.py", text).symbols[0]
    raw = text.encode()
    assert raw[s.start_byte : s.end_byte].decode() == s.source == "def ß():\n    return '日本'"


def test_containing_equals_all_pairs():
    import random
    from dataclasses import replace

    from loomdex.functions.parsers import Symbol
    from loomdex.operators.semantic import containing

    rng = random.Random(2)
    for _ in range(200):
        symbols = []
        for k in range(rng.randrange(9)):
            a, b = sorted((rng.randrange(6), rng.randrange(6)))
            s = Symbol(f"s{k}", "element", a + 1, b + 1, 0, 0, "")
            symbols.append(replace(s, start_byte=a * 10, end_byte=b * 10 + 5) if rng.random() < 0.6 else s)

        def inside(x, y):
            span = (lambda s: (s.start_byte, s.end_byte)) if x.start_byte or x.end_byte else (lambda s: (s.start_line, s.end_line))
            return span(x)[0] <= span(y)[0] and span(x)[1] >= span(y)[1] and span(x) != span(y)

        assert containing(symbols) == [any(inside(x, y) for y in symbols if y is not x) for x in symbols]
