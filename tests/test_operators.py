"""Facts about single operators on small inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomdex.functions import scalars as S
from loomdex.operators import search, symbols, upserts
from loomdex.operators.chunking import line_chunks
from loomdex.sources.tables import latest_by
from loomdex.streaming.debounce import debounced, run_updates, snapshot_changes


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(r,) for r in rows], f"x {kind}")
    return [r[0] for r in df.select(column(F.col("x"))).collect()]


def test_slug(spark):
    said = {"My Project": "my-project", "Project 2.0": "project-20", "!!!": "", "a__b  c": "a-b-c", "-x-": "x", "Ünï": "n", None: None}
    assert values(spark, S.slug, list(said)) == list(said.values())


def test_format_bytes(spark):
    said = {0: "0 B", 1023: "1023 B", 1024: "1.0 KB", 1536: "1.5 KB", 1280: "1.2 KB", 1048576: "1.0 MB", 1073741824: "1.0 GB", 1 << 40: "1.0 TB", 1 << 50: "1.0 PB", 1 << 60: "1.0 EB", (1 << 60) - 1: "1024.0 PB", 1234567890123456789: "1.1 EB", (1 << 63) - 1: "8.0 EB", None: None}
    assert values(spark, S.format_bytes, list(said), "long") == list(said.values())


def test_paths(spark):
    said = {"a//b/./c": "a/b/c", "./x": "x", "a\\b": "a/b", "a/../b": "b", "../b": "../b", "/..": "/", "": ".", None: None}
    assert values(spark, S.normal_path, list(said)) == list(said.values())
    assert values(spark, S.hidden, ["a/.git/x", "a/b", ".x", "../a", None]) == [True, False, True, False, False]


def test_numbers(spark):
    assert values(spark, S.number_suffix, [0, 999, 1250, 3_400_000], "long") == ["0", "999", "1.3K", "3.4M"]
    assert values(spark, S.uptime, [0, 59, 61, 3661], "long") == ["Not running", "59s", "1m 1s", "1h 1m 1s"]
    assert values(spark, S.ui_bytes, [0, 512, 1536, None], "long") == ["0 Bytes", "512 Bytes", "1.5 KB", "0 Bytes"]


def test_cosine_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, []), (5, None), (6, [2.0, 0.0])], "id int, embedding array<float>")
    assert [(r.id, r.similarity) for r in search.top_k(df, [1.0, 0.0], 10).collect()] == [(1, 1.0), (6, 1.0), (2, 0.0), (3, 0.0)]
    with pytest.raises(ValueError):
        search.top_k(df, [0.0, 0.0])
    assert [search.clamp_k(k, 8, 50) for k in (None, 0, 5, 99)] == [8, 8, 5, 50]


def test_line_chunks(spark):
    df = spark.createDataFrame([(1, "aaaa\nbb\ncccccc\n"), (2, ""), (3, None), (4, "x" * 30), (5, "é\né")], "id int, t string")
    rows = {(r.id, r.chunk): r for r in line_chunks(df, "id", "t", 8).collect()}
    assert [(k, r.content, r.line_start, r.line_end, r.char_start, r.char_end) for k, r in sorted(rows.items())] == [
        ((1, 0), "aaaa\nbb\n", 1, 2, 0, 8), ((1, 1), "cccccc\n", 3, -1, 8, 15), ((4, 0), "x" * 30 + "\n", 1, -1, 0, 31), ((5, 0), "é\né\n", 1, -1, 0, 6),
    ]


def test_upserts(spark):
    old = spark.createDataFrame([("a", "1", 1), ("b", "2", 2)], "path string, hash string, created_at int")
    new = spark.createDataFrame([("b", "3", 9), ("c", "4", 9)], "path string, hash string, created_at int")
    assert sorted(map(tuple, upserts.upsert(old, new, "path").collect())) == [("a", "1", 1), ("b", "3", 2), ("c", "4", 9)]
    assert {r.path: r.state for r in upserts.changed(new, old, "path", "hash").collect()} == {"b": "changed", "c": "new"}
    assert {(r.path, r.state) for r in snapshot_changes(old, new, "path", "hash").collect()} == {("a", "removed"), ("b", "changed"), ("c", "new")}
    assert upserts.delete_by(old, old.limit(0), "path").count() == 2


def test_latest_by_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "b", 5), (1, "c", None), (None, "d", 1)], "id int, v string, at int")
    assert sorted(map(tuple, latest_by(df, ["id"], "at").collect()), key=str) == [(1, "b", 5), (None, "d", 1)]


def test_outline(spark):
    rows = [(1, 0, "A", "class", "", 1, 10), (1, 1, "m", "method", "A", 2, 4), (1, 2, "x", "method", "gone", 5, 6), (1, 3, "n", "method", "A", 7, 9)]
    df = spark.createDataFrame(rows, "file_id int, pos int, name string, kind string, parent string, start_line int, end_line int").withColumn("path", F.lit("p"))
    nodes = symbols.sibling_position(symbols.parents(df))
    assert {r.pos: (r.parent_pos, r.position) for r in nodes.collect()} == {0: (None, 0), 1: (0, 0), 2: (None, 1), 3: (0, 1)}
    assert {r.pos: r.depth for r in symbols.outline(nodes, 1).collect()} == {0: 1, 2: 1}
    assert [r.pos for r in symbols.containers(df, ("class",)).collect()] == [0]


def test_debounce_merges_at_the_gap(spark):
    at = lambda s: dt.datetime(2025, 1, 1, 0, 0, s)
    df = spark.createDataFrame([("a", at(0)), ("a", at(2)), ("a", at(5)), ("b", at(0)), (None, at(0))], "path string, ts timestamp")
    assert sorted((r.path, r.n_events) for r in debounced(df, "path", "ts", "2 seconds").collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_stream_of_updates(spark, tmp_path):
    source, seen = tmp_path / "in", []
    df = spark.createDataFrame([("a", dt.datetime(2025, 1, 1)), ("b", dt.datetime(2025, 1, 2))], "path string, ts timestamp")
    df.write.parquet(str(source))
    stream = spark.readStream.schema(df.schema).parquet(str(source))
    query = run_updates(debounced(stream, "path", "ts", "2 seconds", "1 second"), lambda b, _: seen.extend(r.path for r in b.collect()), "t", str(tmp_path / "c"), "0 seconds")
    query.processAllAvailable()
    query.stop()
    assert seen == ["a"]  # the last run isn't quiet yet


def test_stale_files(spark):
    known = spark.createDataFrame([(1, "p", "a"), (2, "p", "b"), (3, "q", "a"), (4, "p", None), (5, "p", "c")], "pk int, project_id string, path string")
    seen = spark.createDataFrame([("p", "a"), ("p", "a"), ("q", "z"), (None, "b")], "project_id string, path string")
    assert sorted(r.pk for r in upserts.stale(known, seen, ["project_id", "path"]).collect()) == [2, 3, 4, 5]
    there = upserts.stale(known, seen, ["project_id", "path"], lambda left: left.where("path = 'c'"))  # c is on the disk after all
    assert sorted(r.pk for r in there.collect()) == [2, 3, 4]
    assert upserts.stale(known.limit(0), seen, ["project_id", "path"]).count() == 0


def test_outline_of_any_depth(spark):
    rows = [(1, k, k - 1 if k else None, 0) for k in range(40)] + [(1, 40, None, 1), (2, 0, None, 0), (2, 1, 0, 0), (2, 2, 0, 1)]
    nodes = spark.createDataFrame(rows, "file_id long, pos long, parent_pos long, position long")
    tree = {(r.file_id, r.pos): (r.depth, r.trail) for r in symbols.outline(nodes).collect()}
    assert len(tree) == 44 and tree[1, 39][0] == 40 and tree[1, 40] == (1, "0000000001") and tree[2, 2] == (2, "0000000000/0000000001")
    assert {k for k, v in tree.items() if v[0] <= 2} == {(r.file_id, r.pos) for r in symbols.outline(nodes, 2).collect()}
    top = symbols.outline(nodes).where("file_id = 1 and depth = 38").select("file_id", "trail")
    assert sorted(r.pos for r in symbols.subtree(symbols.outline(nodes), top).collect()) == [37, 38, 39]
    assert symbols.outline(nodes.limit(0)).count() == 0


def test_fresher_outlines(spark):
    stored = spark.createDataFrame([("a", 5), ("b", 5)], "path string, at long")
    now = spark.createDataFrame([("a", 5), ("b", 6), ("c", 1)], "path string, at long")
    assert sorted(r.path for r in symbols.fresher(stored, now).collect()) == ["b", "c"]


def test_containers(spark):
    rows = [(1, "div", "element", "", 1, 9, 10, 90), (1, "span", "element", "div", 1, 9, 20, 30), (1, "s", "script", "", 3, 5, 0, 0), (1, "f", "function", "", 4, 4, 0, 0), (1, "T", "heading", "", 1, 2, 0, 5), (1, "U", "heading", "T", 2, 2, 6, 9), (2, "x", "rule", "", 1, 9, 10, 90)]
    df = spark.createDataFrame(rows, "file_id int, name string, kind string, parent string, start_line int, end_line int, start_byte int, end_byte int")
    assert sorted(r.name for r in symbols.containers(df).collect()) == ["T", "div", "s"]


def test_latest_vectors(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0], 1), ("a", [0.0, 1.0], 2), ("b", [1.0, 0.0], 1), ("b", [1.0, 0.0], 9), ("c", [float("nan"), 1.0], 1)], "id string, embedding array<float>, updated_at long")
    found = search.top_k(search.latest_vectors(df), [1.0, 0.0], 5, distinct=True).collect()
    assert [(r.id, r.similarity) for r in found] == [("b", 1.0), ("a", 0.0), ("c", 0.0)]
