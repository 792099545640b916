"""The operators on small tables: nulls, empty and repeated rows, ties, empty tables, further columns, and brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomdex.llm import docpairs, encoding, handwritten, leakage, letters, mojibake, neardup, neighbours, packing, splitting, syntax_check

CHUNK = "id string, embedding_model_id string, token_count int, content string, updated_at long, tokens string, capacity string, size string"


def test_packing(spark):
    rows = [(f"c{i:03}", m, 1 + i * 7 % 60, "x", 1, "a", "b", "c") for i in range(150) for m in ("big",)] + [
        ("long", "small", 250, "x", 1, None, None, None), ("long", "small", 1, "x", 0, None, None, None), ("zero", None, None, None, None, None, None, None), ("bytes", None, -3, "é" * 10, 1, None, None, None), ("full", "small", 200, "x", 1, None, None, None), (None, "big", 5, "x", 1, None, None, None),
    ]
    models = spark.createDataFrame([("big", 64), ("small", 100), (None, 3), ("off", None)], "id string, max_sequence_length int")
    sized = packing.sized_chunks(spark.createDataFrame(rows, CHUNK), models, 512)
    pieces = packing.pack(sized, slices=3).collect()
    tokens = {}
    for p in pieces:
        tokens[p.id] = tokens.get(p.id, 0) + p.n_tokens
    assert tokens == {f"c{i:03}": 1 + i * 7 % 60 for i in range(150)} | {"long": 250, "zero": 0, "bytes": 5, "full": 200}
    held = {}
    for p in pieces:
        held[p.embedding_model_id, p.container] = held.get((p.embedding_model_id, p.container), 0) + p.n_tokens
        assert p.n_tokens <= p.capacity == {"big": 64, "small": 100, None: 512}[p.embedding_model_id]
    assert all(n <= {"big": 64, "small": 100, None: 512}[m] for (m, _), n in held.items())
    assert sorted(p.n_tokens for p in pieces if p.id == "long") == [50, 100, 100] and len({(p.id, p.piece) for p in pieces}) == len(pieces)
    assert packing.pack(sized.limit(0)).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(12, 8)).repeat(30, 0) + 0.2 * rng.normal(size=(360, 8))).astype(np.float32)
    x[10] = x[11] = x[12]
    x[20:29] = x[20]
    rows = [(f"v{i:03}", v.tolist(), 1, "x") for i, v in enumerate(x)] + [("v000", x[0].tolist(), 1, "x"), ("v000", x[1].tolist(), 0, "x"), ("null", None, 1, "x"), ("short", [1.0], 1, "x"), ("zero", [0.0] * 8, 1, "x"), ("nan", [float("nan")] * 8, 1, "x"), ("hole", [None] + [1.0] * 7, 1, "x"), (None, x[3].tolist(), 1, "x")]
    vectors = neighbours.usable(spark.createDataFrame(rows, "id string, embedding array<float>, updated_at long, node string"), 8)
    assert vectors.count() in (360, 361)  # a repeated row may stay
    for sample, sizes in ((200, {}), (40_000, {"cell_size": 100, "block": 50, "asks": 60})):  # whole cells of a tree grown further, and cells that are cut both ways
        found = {}
        rows, recall = neighbours.searched(vectors, 5, 8, sample_size=sample, leaf_size=20, **sizes)
        assert recall >= 0.98
        for r in rows.collect():
            found.setdefault(r.id, []).append((r.neighbour, r.similarity))
        assert {len(v) for v in found.values()} == {5} and set(found) == {f"v{i:03}" for i in range(360)}
        assert {n for n, _ in found["v028"]} == {f"v{i:03}" for i in range(20, 25)} and {n for n, _ in found["v022"]} == {f"v{i:03}" for i in (20, 21, 23, 24, 25)}
        u = neighbours.unit(x)
        close = u @ u.T
        np.fill_diagonal(close, -1)
        least = np.sort(close, axis=1)[:, -5]
        right = [s >= least[int(i[1:])] - 1e-9 for i, v in found.items() for _, s in v]
        assert np.mean(right) > 0.97
    assert neighbours.neighbours(vectors.limit(0), 5, 8).count() == 0
    assert neighbours.neighbours(vectors.orderBy("id").limit(2).distinct(), 5, 8).count() in (0, 2)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randrange(60, 160))]
        texts.append(base)
        for _ in range(rng.randrange(4)):
            other = list(base)
            for _ in range(rng.randrange(7)):
                other[rng.randrange(len(other))] = rng.choice(words)
            texts.append(other)
    rows = [(f"t{i:03}", " ".join(t), 1) for i, t in enumerate(texts)]
    rows += [("t000", "changed since", 0), ("copy", rows[0][1], 1), ("null", None, 1), ("short", "a b c", 1), (None, rows[0][1], 1), ("empty", "", None)]
    df = spark.createDataFrame(rows, "id string, text string, version long")
    kept = {r[0]: r[1].split() for r in rows if r[0] and r[1] and r[2] == 1 and len(r[1].split()) >= 60}
    triples = {i: {*zip(w, w[1:], w[2:])} for i, w in kept.items()}
    true = {(a, b) for a in triples for b in triples if a < b and len(triples[a] & triples[b]) >= 0.7 * len(triples[a] | triples[b])}
    near = neardup.NearDuplicates(df)
    pairs = [tuple(r) for r in near.pairs().collect()]
    assert set(pairs) == true and len(pairs) == len(true) and ("copy", "t000") in true
    # Crowded branches lead to longer prefixes in more trees, and at the last to blocks.
    known = {frozenset(r) for r in near.verified().select("a", "b").collect()}
    for crowded, block in ((200, 2000), (2, 3), (4, 1000)):
        deeper = {frozenset(r) for r in near.candidates(crowded, block).collect()}
        assert len(known - deeper) <= 1
    root = {i: i for i in kept}
    for _ in range(len(kept)):
        for a, b in true:
            root[a] = root[b] = min(root[a], root[b])
    assert {r.id: r.group_id for r in near.groups().collect()} == root
    none = neardup.NearDuplicates(df.limit(0))
    assert none.pairs().count() == none.groups().count() == 0


def test_splitting(spark):
    rows = [("a", "x" * 3204, 5, False, "e"), ("a", "x" * 3204, 6, False, "e"), ("b", "x" * 3203, None, None, None), ("c", None, 9999, True, None), ("d", "日本 " * 2000, 0, True, ""), (None, "x" * 9999, 1, None, None), ("e", "", None, None, None)]
    df = spark.createDataFrame(rows, "id string, source_code string, updated_at long, is_collapsed boolean, text string")
    pieces = splitting.split(df).collect()
    assert {p.id for p in pieces} == {"a", "d"} and all(p.n_tokens <= 800 for p in pieces)
    whole = "".join(p.text[(0 if not i else prev.char_end - p.char_start) :] for i, (prev, p) in enumerate(zip([None, *[q for q in pieces if q.id == "d"]], [q for q in pieces if q.id == "d"], strict=False)))
    assert whole == "日本 " * 2000
    assert splitting.split(df.limit(0)).count() == 0


def test_encoding(spark):
    df = spark.createDataFrame([(1, "hello"), (1, "hello"), (2, ""), (3, None), (None, "hello"), (4, "<|endoftext|>")], "doc_id long, text string").withColumn("ids", F.lit("x"))
    out = encoding.encode(spark, df, "doc_id", "text")
    rows = sorted(((r.doc_id, tuple(r.ids)) for r in out.collect()), key=str)
    assert out.columns == ["doc_id", "ids"] and rows.count((1, (31373,))) == 2 and (2, ()) in rows and (3, ()) in rows and (None, (31373,)) in rows and (4, (50256,)) not in rows
    assert encoding.encode(spark, df.limit(0), "doc_id", "text").count() == 0


def test_leakage(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = [(1, f"so: {item.upper().replace(' ', ', ')}!"), (1, f"so: {item}"), (2, " ".join(f"w{i}" for i in range(5, 17))), (3, " ".join(f"w{i}" for i in range(5, 16))), (4, None), (5, ""), (None, item), (6, "w1 " * 50), (7, ("zz " * 3000) + item)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit(1))
    items = spark.createDataFrame([(9, item), (9, item), (8, "w1 w2"), (7, None), (None, item)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): (r.longest_run, r.item_share) for r in leakage.leaks(df, items).collect()}
    assert found == {(1, 9): (30, 1.0), (2, 9): (12, 0.4), (7, 9): (30, 1.0)}
    assert leakage.leaks(df.limit(0), items).count() == leakage.leaks(df, items.limit(0)).count() == 0


def test_garbled(spark):
    plain = ["Der nächste Durchlauf hält den Zähler für später zurück", "Größere Änderungen führen über viele Wörter", "La sesión envió señales después del mediodía", "L’étape évite déjà un délai où l’on répète", "Ошибка появляется после обновления таблицы"]
    rows = [(i, plain[i % 5] + f" {i % 7}", "clean") for i in range(400)]
    rows += [(1000 + i, (plain[i % 5] + " x").encode().decode("cp1252", "replace") if i % 5 < 4 else plain[4].encode("cp1251").decode("latin-1"), "bad") for i in range(10)]
    rows += [(3000 + i, f"Das Lager schließt zu früh, führt {i % 3} Wörter", "clean") for i in range(60)]
    rows += [(2000, None, "a"), (2001, "", None), (2002, "   ", "a"), (None, "fÃ¼r", "a"), (2003, "plain ASCII", "a"), (2004, "f�r", None), (2005, "À Á Â Ã are letters", "a")]
    found = {r.doc_id: r.restored for r in mojibake.garbled(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("key", F.lit("z"))).collect()}
    assert set(found) == {*range(1000, 1010), 2004} and found[2004] is None
    assert found[1000] == plain[0] + " x" and found[1004] == plain[4]
    assert mojibake.garbled(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_garbled_by_pages_of_dos_and_iso(spark):
    plain = ["A versão número 4 não encontrou o batch após a migração, sem interrupção", "Nenhuma sessão está à exceção da verificação, então põe fim às posições", "Każdy parcel rozpocznie następną próbę, wcześniejsze żądanie się kończy", "Proszę usunąć stary moduł i ponownie włączyć filter, jeśli łączy błąd"]
    rows = [(i, plain[i % 4] + f" {i % 7}", "clean") for i in range(400)]
    rows += [(1000 + i, plain[i % 2].encode("cp850").decode("latin-1"), "bad") for i in range(2)] + [(1000 + i, plain[i].encode().decode("cp852"), "bad") for i in (2, 3)]
    found = {r.doc_id: r.restored for r in mojibake.garbled(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert found == {1000 + i: plain[i] for i in range(4)}


def test_letters_are_counted_over_all_documents(spark):
    df = spark.createDataFrame([("zq zé",), ("zq",), ("日本",), ("",)], "text string").repartition(3)
    pairs, singles = letters.counts(df)
    slot = lambda a, b: int(letters.SYMBOL[ord(a)]) * letters.N + int(letters.SYMBOL[ord(b)])
    assert singles[ord("z")] == 3 and singles[ord("日")] == 1 and pairs[slot("z", "q")] == 2 and pairs[slot("z", "é")] == 1 and pairs[slot("q", "z")] == 0


POLISH = ["Zażółć gęślą jaźń, ponieważ każdy użytkownik może zgłosić błąd", "Proszę usunąć stary moduł, gdyż następna próba się nie powiedzie", "Książka leży na stole, a jej treść jest dostępna także wieczorem"]


@pytest.mark.parametrize("read_as", ["cp1252", "cp1250", "cp852", "cp1257", "cp1255"])
def test_garbled_in_a_language_that_the_corpus_lacks(spark, read_as):
    plain = ["Der nächste Durchlauf hält den Zähler für später zurück", "La sesión envió señales después del mediodía", "L’étape évite déjà un délai où l’on répète", "Nenhuma sessão está à exceção da verificação"]
    rows = [(i, plain[i % 4] + f" {i % 7}", "clean") for i in range(300)]
    rows += [(1000 + i, "".join(mojibake.page(read_as)[b] for b in POLISH[i].encode()), "bad") for i in range(3)]
    found = {r.doc_id: r.restored for r in mojibake.garbled(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert found == {1000 + i: POLISH[i] for i in range(3)}


def test_clean_text_in_a_language_that_the_corpus_lacks(spark):
    plain = ["Der nächste Durchlauf hält den Zähler für später zurück", "La sesión envió señales después del mediodía", "L’étape évite déjà un délai où l’on répète", "Nenhuma sessão está à exceção da verificação"]
    other = ["Příliš žluťoučký kůň úpěl ďábelské ódy", "Každý uživatel může změnit své heslo v nastavení účtu", "Árvíztűrő tükörfúrógép és más hosszú szavak", "Žodžių skaičius šiame įraše yra didesnis už ankstesnį", *POLISH]
    rows = [(i, plain[i % 4] + f" {i % 7}", "clean") for i in range(300)] + [(1000 + i, other[i % 7] + f" {i}.", "other") for i in range(28)]
    assert mojibake.garbled(spark.createDataFrame(rows, "doc_id long, text string, source string")).count() == 0


def test_a_cipher_that_no_page_gives(spark):
    plain = ["Der nächste Durchlauf hält den Zähler für später zurück", "Größere Änderungen führen über viele Wörter", "Das Lager schließt zu früh, führt dann Wörter", "Zwölf große Läufer hören früh", "Später wählen Schüler ähnliche Gänge"]
    swap = str.maketrans({"ä": "☂", "ö": "⚑", "ü": "♞", "ß": "⌘"})
    rows = [(i, plain[i % 5] + f" {i % 7}", "clean") for i in range(400)] + [(1000 + i, (plain[i % 5] + f" und {i}").translate(swap), "odd") for i in range(12)]
    rows += [(2000, "a ☂ b ☂ c, x☂y", "clean"), (2001, "The sign '�' (�) is shown for lost letters.", "clean")]
    found = {r.doc_id: (r.key, r.restored) for r in mojibake.garbled(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert found == {1000 + i: (mojibake.OPEN, plain[i % 5] + f" und {i}") for i in range(12)}


def test_docpairs(spark):
    schema = "id string, project_id string, language string, parent string, symbol_kind string, symbol_name string, doc_string string, source_code string, updated_at long, tells string"
    rows = [
        ("base", "p", "ts", None, "class", "Base", None, "class Base {}", 1, "x"), ("mid", "p", "ts", None, "class", "Mid", None, "class Mid extends Base {", 1, "x"), ("sub", "p", "ts", None, "class", "Sub", None, "class Sub extends Mid implements I {", 1, "x"),
        ("loop1", "p", "ts", None, "class", "L1", None, "class L1 extends L2 {", 1, "x"), ("loop2", "p", "ts", None, "class", "L2", None, "class L2 extends L1 {", 1, "x"),
        ("m1", "p", "ts", "Base", "method", "run", "Runs all of the jobs.", "run() {}", 1, "x"), ("m2", "p", "ts", "Sub", "method", "run", "TODO", "run() {}", 1, "x"), ("m3", "p", "ts", "L1", "method", "run", None, "run() {}", 1, "x"),
        ("f1", None, None, None, "function", "f", " ", "# Counts the open rows.\ndef f():\n    pass", 1, None), ("f1", None, None, None, "function", "f", " ", "# Counts the open rows.\ndef f():\n    pass", 2, None), ("f2", None, None, None, "function", None, "Says a lot of things", "x", None, None),
        ("f3", None, None, None, "function", "f", "Says a lot of things", None, 1, None), ("f4", None, None, None, None, "f", "Says a lot of things", "x", 1, None), (None, None, None, None, "function", "f", "Says a lot of things", "x", 1, None),
    ]
    df = spark.createDataFrame(rows, schema).withColumn("file_id", F.lit(None).cast("long")).withColumn("package_name", F.lit(None).cast("string"))
    assert sorted(map(tuple, docpairs.told(df).collect()), key=str) == [("f1", "f"), ("f2", None), ("m1", "run")]
    pairs = {r.id: (r.origin, r.documentation) for r in docpairs.pairs(df).collect()}
    assert pairs["m2"] == ("inherited", "Runs all of the jobs.") and pairs["m1"][0] == "own" and "m3" not in pairs
    assert docpairs.told(df.limit(0)).count() == docpairs.pairs(df.limit(0)).count() == 0


FILES, TEXTS = "file_id long, project_id string, path string, bytes long", "file_id long, path string, text string"


def test_classes_of_one_name_are_told_apart(spark):
    schema = "id string, project_id string, file_id long, package_name string, language string, parent string, symbol_kind string, symbol_name string, doc_string string, source_code string, updated_at long"
    rows = []
    for file, package, doc in ((1, "a", "Runs all of the jobs."), (2, "b", "Opens the first door again.")):
        rows += [(f"base{file}", "p", file, package, "ts", None, "class", "Base", None, "class Base {}", 1), (f"run{file}", "p", file, package, "ts", "Base", "method", "run", doc, "run() {}", 1)]
    rows += [("s1", "p", 1, "a", "ts", None, "class", "Sub", None, "class Sub extends Base {", 1), ("m1", "p", 1, "a", "ts", "Sub", "method", "run", None, "run() {}", 1)]  # by its file
    rows += [("s3", "p", 3, "b", "ts", None, "class", "Sub3", None, "class Sub3 extends Base {", 1), ("m3", "p", 3, "b", "ts", "Sub3", "method", "run", None, "run() {}", 1)]  # by its package
    rows += [("s4", "p", 4, "c", "ts", None, "class", "Sub4", None, "class Sub4 extends Base {", 1), ("m4", "p", 4, "c", "ts", "Sub4", "method", "run", None, "run() {}", 1)]  # by neither: unresolved
    rows += [("s5", "p", 5, "c", "ts", None, "class", "Sub5", None, "class Sub5 extends Sub3 {", 1), ("m5", "p", 5, "c", "ts", "Sub5", "method", "run", None, "run() {}", 1)]  # the only one in the project
    found = {r.id: r.documentation for r in docpairs.pairs(spark.createDataFrame(rows, schema)).where("origin = 'inherited'").collect()}
    assert found == {"m1": "Runs all of the jobs.", "m3": "Opens the first door again.", "m5": "Opens the first door again."}


def classified(spark, rows, **sizes):
    files = spark.createDataFrame([(i, p, path, sizes.get(f"f{i}")) for i, p, path, _ in rows], FILES).withColumn("kind", F.lit("x"))
    texts = spark.createDataFrame([(i, path, t) for i, _, path, t in rows], TEXTS).withColumn("evidence", F.lit(1))
    return {r.file_id: (r.kind, r.evidence) for r in handwritten.classify(files, texts).collect()}


def test_handwritten(spark):
    long = "def f(x):\n    return x\n\n" * 60
    rows = [
        (1, "p", "vendor/a/b.go", "package b"), (2, "p", "src/vendors/b.go", "package b"), (3, "p", "./src\\gen//x.py", None), (4, "p", "a/x_pb2.py", long), (5, "p", None, "# @generated by x compiler\n"), (6, "p", "a.py", long),
        (7, "q", "lib/.gitattributes", "*.py linguist-generated\nown.py -linguist-generated\n[attr]theirs linguist-vendored\n\"odd name.js\" theirs\nlib/*.ts theirs\n*.go -linguist-vendored\n"),
        (8, "q", "lib/deep/z.py", long), (9, "q", "lib/own.py", "# Code generated by x. DO NOT EDIT.\n"), (10, "p", "lib/z.py", long), (11, None, "", ""), (12, "p", "pkg-1.2.3/a.js", "a()"), (13, "q", "lib/odd name.js", "a()"),
        (14, "q", "lib/vendor/v.go", "package v"), (15, "q", "lib/g.go", "// Code generated by x. DO NOT EDIT.\npackage g"), (16, "p", "src/big.sql", None), (17, "p", "src/small.sql", None), (18, "p", "Vendor/c.js", None), (19, "p", "docs/x.gen.md", "Some prose."), (5, "p", None, None),
    ]
    found = classified(spark, rows, f16=3 << 20, f17=3 << 10)
    assert found == {
        1: ("vendored", "path"), 3: ("generated", "path"), 4: ("generated", "path"), 5: ("generated", "text"), 8: ("generated", "attributes"), 12: ("vendored", "path"), 13: ("vendored", "attributes"), 15: ("generated", "text"), 16: ("data", "size"), 18: ("vendored", "path"),
    }
    assert handwritten.classify(spark.createDataFrame([], FILES), spark.createDataFrame([], TEXTS)).count() == 0
    sizes = spark.createDataFrame([("1.5 KB",), ("2mb",), ("770b",), ("",), (None,), ("odd",)], "size string").select(handwritten.bytes_of(F.col("size")))
    assert [r[0] for r in sizes.collect()] == [1536, 2 << 20, 770, None, None, None]


def test_mined_patterns(spark):
    rows = [(i, "p", f"x/odd{i % 2}/f{i}.py", "# Code generated by x. DO NOT EDIT.\n" if i >= 2 else "x = 1\n") for i in range(40)]
    found = classified(spark, rows)
    assert found[0][1] == found[1][1] == "mined" and found[2][1] == "text" and len(found) == 40
    # What one repository declares holds in another that declares nothing.
    rows = [(100, "p", ".gitattributes", "/made/* linguist-generated\n")] + [(i, "p", f"made/f{i}.py", "x = 1\n") for i in range(20)] + [(50, "q", "src/made/f.py", "x = 1\n"), (51, "q", "src/own/f.py", "x = 1\n")]
    found = classified(spark, rows)
    assert found[0] == ("generated", "attributes") and found[50] == ("generated", "mined") and 51 not in found and 100 not in found


def test_a_banner_that_is_the_projects_own(spark):
    own = "// Copyright (c) 2024 the Acme authors. Licensed under the Apache License, Version 2.0.\n\nvar a;\n"
    rows = [(i, "p", f"src/f{i}.js", own.replace("2024", str(2020 + i))) for i in range(8)] + [(9, "p", "src/g.js", "// Copyright (c) the Zeta contributors. Released under terms in LICENSE-zeta.\n\nvar a;\n")]
    assert classified(spark, rows) == {9: ("vendored", "text")}


def test_syntax(spark):
    rows = [(1, "p", "a.py", "def f(:\n"), (2, "p", "a.PY", "x = 1\n"), (3, "p", "a.md", "{{"), (4, "p", None, "x"), (5, "p", "a.json", None), (6, None, "a.json", ""), (7, "p", "b.css", ""), (7, "p", "b.css", "a {"), (None, "p", "a.py", "def"), (8, "p", "noext", "x")]
    df = spark.createDataFrame(rows, "file_id long, project_id string, path string, source string").withColumn("valid", F.lit(1))
    checked = syntax_check.check(df)
    assert {r.file_id: (r.language, r.valid) for r in checked.collect()} == {1: ("python", False), 2: ("python", True), 6: ("json", False), 7: ("css", False)}
    assert {(r.project_id, r.language): r.share for r in syntax_check.rates(checked).collect()}["p", "python"] == 0.5
    assert syntax_check.check(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["p1_coverage", "p6_found", "p7_found", "p8_counts", "p9_found"])
def test_registered_sql(spark, name):
    import os

    import duckdb

    from loomdex.llm import queries

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{folder}/{f}')")
    said = c.execute(queries.SQL[name])
    columns = [x[0] for x in said.description]
    assert sorted(map(str, said.fetchall())) == sorted(str(tuple(r[x] for x in columns)) for r in queries.QUERIES[name](spark, folder).collect())
