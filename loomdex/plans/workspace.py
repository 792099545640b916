"""Projects, their settings, the model catalog and single values, as tables of a store. What an update leaves blank keeps its value."""

from __future__ import annotations

import json
import os
import re
import time
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from loomdex.operators.embed import artifact_state
from loomdex.operators.upserts import upsert
from loomdex.plans.engine import Index
from loomdex.sources.store import Store

PROJECTS = "id string, name string, description string, config_json string, is_indexing int, created_at long, updated_at long"
MODELS = "id string, display_name string, backend string, dimension int, max_sequence_length int, cpu_latency_ms int, local_path string, tokenizer_local_path string, download_status string, created_at long, updated_at long"
VALUES = "key string, value string"
SELECTED, TRIES = "selected_project", 10


def slug(name: str) -> str:
    """A name as an id: lower case, blanks and underscores to hyphens, other signs dropped."""
    return re.sub("-+", "-", re.sub("[^a-z0-9-]", "", re.sub("[ _]", "-", name.lower()))).strip("-")


class Workspace:
    """The tables projects, models and values below a folder. ``default`` is the model of projects that name none, or one that the catalog lacks or that can't run here."""

    def __init__(self, spark: SparkSession, folder: str, default: str = "hashing-64"):
        self.spark, self.folder, self.store, self.default = spark, folder.rstrip("/"), Store(spark, folder), default

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.store.read(name) if self.store.versions(name) else self.spark.createDataFrame([], schema)

    def _put(self, name: str, schema: str, key: str, rows: list[dict]) -> None:
        names = [x.split()[0] for x in schema.split(", ")]
        new = self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)
        self.store.write(name, upsert(self._table(name, schema), new, key, ("created_at",) if "created_at" in names else ()))

    # Single values.
    def value(self, key: str) -> tuple[str | None, bool]:
        """The value of a key, and whether there is one."""
        row = self._table("values", VALUES).where(F.col("key") == key).head()
        return (row.value, True) if row else (None, False)

    def set_value(self, key: str, value: str) -> None:
        self._put("values", VALUES, "key", [{"key": key, "value": value}])

    def clear_value(self, key: str) -> None:
        self.store.delete("values", self.spark.createDataFrame([(key,)], "key string"), "key")

    # The catalog.
    def models(self) -> DataFrame:
        """The catalog by name, whatever the letter case."""
        return self._table("models", MODELS).orderBy(F.lower("display_name"), "id")

    def model(self, model_id: str) -> Row:
        """A catalog entry; LookupError where there is none."""
        row = self._table("models", MODELS).where(F.lower("id") == model_id.strip().lower()).head()
        if row is None:
            raise LookupError(model_id)
        return row

    def save_model(self, **fields) -> Row:
        """Adds or changes an entry: a blank name is the id, a blank backend onnx; the time it was made is kept. Its files are looked for."""
        if not (fields.get("id") or "").strip():
            raise ValueError("a model needs an id")
        now = int(time.time())
        row = {**fields, "display_name": fields.get("display_name") or fields["id"], "backend": fields.get("backend") or "onnx", "created_at": fields.get("created_at") or now, "updated_at": now}
        row["download_status"] = "ready" if row["backend"] == "hashing" else artifact_state(row)
        self._put("models", MODELS, "id", [row])
        return self.model(fields["id"])

    def remove_model(self, model_id: str) -> None:
        self.store.delete("models", self.spark.createDataFrame([(self.model(model_id).id,)], "id string"), "id")

    def chosen_model(self, model_id: str | None) -> Row | None:
        """The entry that a project's choice comes to: the default's for a blank or unknown one and for one whose files aren't there; None if the catalog lacks that too."""
        for wanted in ((model_id or "").strip(), self.default):
            try:
                if wanted and (row := self.model(wanted)).download_status == "ready":
                    return row
            except LookupError:
                continue
        return None

    # Projects.
    def projects(self) -> DataFrame:
        """All projects, the newest first."""
        return self._table("projects", PROJECTS).orderBy(F.desc("created_at"), "id")

    def project(self, project_id: str) -> Row:
        """A project; LookupError where there is none."""
        row = self._table("projects", PROJECTS).where(F.col("id") == project_id).head()
        if row is None:
            raise LookupError(project_id)
        return row

    def config(self, project_id: str) -> dict:
        return json.loads(self.project(project_id).config_json or "{}")

    def free_id(self, base: str) -> str:
        """base, or where that is taken base with eight random digits."""
        taken = {r.id for r in self._table("projects", PROJECTS).where((F.col("id") == base) | F.col("id").startswith(f"{base}-")).select("id").toLocalIterator()}
        for n in range(TRIES):
            candidate = (base or "project") if not n else f"{base or 'project'}-{uuid.uuid4().hex[:8]}"
            if candidate not in taken:
                return candidate
        raise RuntimeError(f"no free id for {base}")

    @staticmethod
    def _root(path: str | None) -> str:
        if not (path or "").strip() or not os.path.isdir(path.strip()):
            raise ValueError(f"{path!r} is no folder")
        return os.path.realpath(path.strip())

    def create(self, name: str, root: str, description: str = "", project_id: str | None = None) -> Row:
        if not name.strip():
            raise ValueError("a project needs a name")
        now, new_id = int(time.time()), self.free_id(project_id or slug(name))
        model = self.chosen_model(None)
        config = {"rootPath": self._root(root), "includePaths": ["."], "embeddingModel": model.id if model else self.default}
        self._put("projects", PROJECTS, "id", [{"id": new_id, "name": name, "description": description, "config_json": json.dumps(config), "is_indexing": 0, "created_at": now, "updated_at": now}])
        return self.project(new_id)

    def change(self, project_id: str, name: str | None = None, description: str | None = None, config: dict | None = None, is_indexing: bool | None = None) -> Row:
        """Changes what is given and differs. Of the settings a blank root and a blank model keep their values, and no include paths are the root."""
        old = self.project(project_id)
        row = old.asDict() | {k: v for k, v in (("name", name), ("description", description), ("is_indexing", None if is_indexing is None else int(is_indexing))) if v is not None}
        if config is not None:
            before = json.loads(old.config_json or "{}")
            model = self.chosen_model((config.get("embeddingModel") or "").strip() or before.get("embeddingModel"))
            root = self._root(config["rootPath"]) if (config.get("rootPath") or "").strip() else before.get("rootPath")
            row["config_json"] = json.dumps({**before, **config, "rootPath": root, "includePaths": config.get("includePaths") or ["."], "embeddingModel": model.id if model else self.default})
        if row != old.asDict():
            self._put("projects", PROJECTS, "id", [row | {"updated_at": int(time.time())}])
        return self.project(project_id)

    def delete(self, project_id: str) -> None:
        """Removes a project and its index; a selection of it is cleared."""
        self.project(project_id)
        self.index(project_id).reset()
        self.store.delete("projects", self.spark.createDataFrame([(project_id,)], "id string"), "id")
        if self.value(SELECTED)[0] == project_id:
            self.clear_value(SELECTED)

    def select(self, project_id: str) -> None:
        self.set_value(SELECTED, self.project(project_id).id)

    def selected(self) -> Row | None:
        found, there = self.value(SELECTED)
        return self.project(found) if there else None

    # Indexes.
    def index(self, project_id: str) -> Index:
        config = self.config(project_id)
        return Index(self.spark, config["rootPath"], f"{self.folder}/index-{project_id}", name=project_id, model_id=config.get("embeddingModel") or self.default, includes=config.get("includePaths"), excludes=config.get("excludePaths"))

    def model_agrees(self, project_id: str) -> bool:
        """Whether all chunks of the index were made with the project's model, whatever the letter case; an empty index agrees."""
        index = self.index(project_id)
        if not index.store.versions("chunks"):
            return True
        other = F.lower(F.trim("embedding_model_id")) != (self.config(project_id).get("embeddingModel") or "").strip().lower()
        return not index.store.read("chunks").where(other).limit(1).count()

    def keep_indexed(self, project_id: str, enabled: bool) -> Index:
        """Marks a project as one that is kept up to date; an index made with another model is emptied first."""
        index = self.index(project_id)
        if enabled and not self.model_agrees(project_id):
            index.reset()
        self.change(project_id, config={**self.config(project_id), "continuousIndexing": enabled}, is_indexing=enabled)
        if enabled:
            index.update()
        else:
            index.stop()
        return index

    def resume(self) -> dict[str, str]:
        """Brings all projects that are kept up to date there; what went wrong with each that couldn't be, and '' for the others."""
        out = {}
        for r in self.projects().where("is_indexing <> 0").select("id").collect():  # projects are few
            try:
                self.index(r.id).update()
                out[r.id] = ""
            except Exception as e:
                out[r.id] = str(e)
        return out
