"""Projects, settings, the catalog, the store's versions and buckets, and updates of single files."""

import json

import pytest
from pyspark.sql import functions as F

from loomdex.functions import scalars as S
from loomdex.operators import embed, upserts
from loomdex.plans.engine import Index
from loomdex.plans.workspace import Workspace, slug
from loomdex.sources import tables
from loomdex.sources.store import Conflict, Store


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(40)] + [(None, "null")], "file_id long, v string")
    store.write("t", rows, "file_id")
    kept = store.read("t")
    old = {r.v for r in kept.collect()}
    dirty = spark.createDataFrame([(3,), (99,)], "file_id long")
    assert 1 <= store.replace("t", spark.createDataFrame([(3, "new"), (99, "more")], "file_id long, v string"), dirty, "file_id") <= 2
    now = {(r.file_id, r.v) for r in store.read("t").collect()}
    assert (3, "new") in now and (99, "more") in now and (3, "v3") not in now and (None, "null") in now and len(now) == 42
    assert {r.v for r in kept.collect()} == old  # a reader keeps its version
    before = json.loads(store.files.child(store._manifests("t")[-2]).read())
    with pytest.raises(Conflict):
        store._commit("t", before, {}, rows.schema, "file_id")
    store.replace("t", rows.limit(0), rows.select("file_id").unionByName(dirty), "file_id")
    assert {r.v for r in store.read("t").collect()} == {"null"} and len(store.versions("t")) == 2
    store.drop("t")
    assert store.names() == [] and store.files.names() == []
    with pytest.raises(KeyError):
        store.read("t")


def test_single_files_are_indexed_again(spark, tmp_path):
    root = tmp_path / "code"
    root.mkdir()
    for n in range(4):
        (root / f"f{n}.py").write_text(f"def f{n}():\n    return {n}\n")
    told = []
    index = Index(spark, str(root), str(tmp_path / "i"), excludes=["skip*"], told=lambda *x: told.append(x[1]))
    index.update()
    assert sorted(told) == ["f0.py", "f1.py", "f2.py", "f3.py"] and index.progress["status"] == "idle"
    (root / "f1.py").write_text("def g():\n    return 1\n")
    (root / "f2.py").unlink()
    (root / "f3.py").write_text("def h():\n    return 1\n")
    (root / "skip.py").write_text("x = 1\n")
    paths = spark.createDataFrame([("f1.py",), ("f2.py",), ("skip.py",), (".hid",), (None,)], "path string")
    assert index.update_paths(paths) == {"indexed": 1, "removed": 1, "files": 3}
    assert [r.name for r in index.outline("f1.py").collect()] == ["g"] and [r.name for r in index.outline("f3.py").collect()] == ["f3"] and index.outline("f2.py").count() == 0


def test_events_are_followed(spark, tmp_path):
    import datetime as dt

    root, events = tmp_path / "code", str(tmp_path / "events")
    root.mkdir()
    (root / "a.py").write_text("def f():\n    return 1\n")
    index = Index(spark, str(root), str(tmp_path / "i"), name="followed")
    at = dt.datetime(2024, 1, 1, 12)
    rows = [("a.py", at, "write"), ("a.py", at + dt.timedelta(seconds=1), "write"), ("b.py", at, "remove"), ("z.py", at + dt.timedelta(hours=1), "write")]  # the last moves the watermark on
    schema = "path string, at timestamp, event_type string"
    spark.createDataFrame(rows, schema).write.parquet(events)
    query = index.follow(spark.readStream.schema(schema).parquet(events), str(tmp_path / "state"))
    query.processAllAvailable()
    assert [r.path for r in index.store.read("files").collect()] == ["a.py"]
    assert index.stop() and not index.stop()


def test_workspace(spark, tmp_path):
    root = tmp_path / "code"
    root.mkdir()
    (root / "a.py").write_text("def f():\n    return 1\n")
    w = Workspace(spark, str(tmp_path / "w"))
    assert w.value("k") == (None, False) and w.save_model(id="hashing-64", backend="hashing", dimension=64).display_name == "hashing-64"
    w.save_model(id="Zed")
    w.save_model(id="alpha", display_name="alpha model", created_at=5)
    assert [r.id for r in w.models().collect()] == ["alpha", "hashing-64", "Zed"] and w.model("ZED").backend == "onnx" and w.model("zed").download_status == "pending"
    assert w.save_model(id="alpha", display_name="b").created_at == 5 and w.chosen_model("zed").id == w.chosen_model(" ").id == "hashing-64"
    p = w.create("My Project", str(root))
    assert p.id == "my-project" and w.create("My Project", str(root)).id.startswith("my-project-") and json.loads(p.config_json)["includePaths"] == ["."]
    q = w.change(p.id, description="new", config={"rootPath": " ", "excludePaths": ["b*"]})
    assert q.description == "new" and q.created_at == p.created_at and w.config(p.id)["rootPath"] == str(root) and w.config(p.id)["embeddingModel"] == "hashing-64"
    w.select(p.id)
    assert w.selected().id == p.id
    w.keep_indexed(p.id, True)
    assert w.model_agrees(p.id) and w.resume() == {p.id: ""}
    w.delete(p.id)
    assert w.selected() is None
    for bad in (lambda: w.project("none"), lambda: w.model("none"), lambda: w.select("none")):
        with pytest.raises(LookupError):
            bad()
    with pytest.raises(ValueError):
        w.create(" ", str(root))
    with pytest.raises(ValueError):
        w.create("x", str(tmp_path / "none"))
    assert slug("Project 2.0") == "project-20" and slug("!!!") == ""


def test_keys_and_excludes(spark):
    known = spark.createDataFrame([("a", 7), ("b", 8)], "path string, file_id long")
    got = {r.path: (r.file_id, r.placeholder) for r in upserts.resolve_keys(spark.createDataFrame([("a",), ("c",), ("c",), (None,)], "path string"), known).collect()}
    assert got["a"] == (7, False) and got["c"][1] and set(got) == {"a", "c"}
    clash = spark.createDataFrame([("x", got["c"][0])], "path string, file_id long")
    again = upserts.resolve_keys(spark.createDataFrame([("c",)], "path string"), clash).head()
    assert again.file_id != got["c"][0] and again.placeholder
    df = spark.createDataFrame([("src/node_modules/x",), ("a.log",), ("src/b",)], "p string")
    assert [r[0] for r in df.select(S.excluded(F.col("p"), ["node_modules", "", "*.log"], names=True)).collect()] == [True, True, False]
    assert [r[0] for r in df.select(S.excluded(F.col("p"), ["node_modules"])).collect()] == [False, False, False]


def test_vectors_and_models(spark):
    raw = embed.encode_vector([1.5, -2.0])
    assert len(raw) == 8 and embed.decode_vector(raw) == [1.5, -2.0]
    with pytest.raises(ValueError):
        embed.decode_vector(raw[:-1])
    df = spark.createDataFrame([(1, bytearray(raw)), (2, bytearray(raw[:3])), (3, None)], "id int, v binary")
    assert [r.v for r in embed.decode_vectors(df, "v").orderBy("id").collect()] == [[1.5, -2.0], None, None]
    assert embed.built_in_model("FastEmbed/gte-small ") == "all-minilm-l6-v2" and embed.built_in_model(None) == "bge-small-en-v1.5"
    with pytest.raises(ValueError):
        embed.built_in_model("other")
    assert embed.client({"id": "h", "backend": "hashing"}) is embed.client({"id": "H", "backend": "hashing"})
    with pytest.raises(FileNotFoundError):
        embed.client({"id": "o", "backend": "onnx", "local_path": "/none"})


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        tables.shared_folder(Session())
    before = len(tables._written)
    tables.written(spark.range(3))
    assert len(tables._written) == before + 1 and tables.forget(spark) == before + 1
