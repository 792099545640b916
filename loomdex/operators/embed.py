"""Embedding columns: batches of texts to vectors, in Python workers, with the model loaded once a worker.

The hashing embedder needs no model file. It is deterministic and useful for tests and offline runs;
its vectors are not those of a trained model.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

BATCH = 64
Embedder = Callable[[list[str]], np.ndarray]


def pad_or_trim(ids: list[int], length: int, filler: int = 0) -> list[int]:
    """Token ids at a fixed length."""
    return (ids + [filler] * (length - len(ids)))[:length]


def mean_pool(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The mean of the token states (batch, tokens, dimension) where the mask is set; zero where it never is."""
    m = mask[..., None].astype(np.float32)
    return (states * m).sum(1) / np.maximum(m.sum(1), 1e-9)


def normalized(x: np.ndarray) -> np.ndarray:
    """Rows at length one; zero rows stay."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(n > 0, x / np.where(n > 0, n, 1), 0).astype(np.float32)


def hashing_embedder(dimension: int = 64) -> Embedder:
    """Words hashed to signed dimensions, counted and normalised."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension), dtype=np.float32)
        for row, text in enumerate(texts):
            for w in re.findall(r"\w+", text.lower()):
                h = xxhash.xxh3_64_intdigest(w)
                out[row, h % dimension] += 1 if h >> 63 else -1
        return normalized(out)

    return embed


def onnx_embedder(model: str, tokenizer: str, length: int = 512) -> Embedder:
    """A model file run by onnxruntime, its last states mean-pooled and normalised; two-dimensional output is taken as it is."""
    import onnxruntime
    from tokenizers import Tokenizer

    session, encoder = onnxruntime.InferenceSession(model), Tokenizer.from_file(tokenizer)
    wanted = {x.name for x in session.get_inputs()}

    def embed(texts: list[str]) -> np.ndarray:
        encoded = encoder.encode_batch(texts)
        feed = {"input_ids": [e.ids for e in encoded], "attention_mask": [e.attention_mask for e in encoded], "token_type_ids": [e.type_ids for e in encoded]}
        feed = {k: np.array([pad_or_trim(list(x), length) for x in v], dtype=np.int64) for k, v in feed.items()}
        states = session.run(None, {k: v for k, v in feed.items() if k in wanted})[0]
        return normalized(mean_pool(states, feed["attention_mask"]) if states.ndim == 3 else states)

    return embed


def encode_vector(vector: list[float]) -> bytes:
    """A vector as little-endian single precision, the form in which stores of other make keep it."""
    return np.asarray(vector, dtype="<f4").tobytes()


def decode_vector(raw: bytes) -> list[float]:
    """The vector of encode_vector(); ValueError for a length that isn't whole."""
    if len(raw) % 4:
        raise ValueError(f"{len(raw)} bytes are no vector")
    return np.frombuffer(raw, dtype="<f4").tolist()


def decode_vectors(df: DataFrame, column: str) -> DataFrame:
    """df with a binary column of such vectors as an array; null for null and for lengths that aren't whole."""
    fields = [f"`{f.name}` {'array<float>' if f.name == column else f.dataType.simpleString()}" for f in df.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            vectors = [None if x is None or len(x) % 4 else np.frombuffer(x, dtype="<f4") for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(vectors, pa.list_(pa.float32())) if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    return df.mapInArrow(run, ", ".join(fields))


# Other names of the built-in models.
ALIASES = {
    "fast-bge-small-en-v1.5": "bge-small-en-v1.5", "fast-bge-small-en": "bge-small-en", "fast-bge-base-en-v1.5": "bge-base-en-v1.5", "fast-bge-base-en": "bge-base-en",
    "gte-small": "all-minilm-l6-v2", "fast-bge-small-zh-v1.5": "bge-small-zh-v1.5",
}
BUILT_IN = ("bge-small-en-v1.5", "bge-small-en", "bge-base-en-v1.5", "bge-base-en", "all-minilm-l6-v2", "bge-small-zh-v1.5")


def built_in_model(model_id: str | None) -> str:
    """The built-in model that an id, in any letter case and with or without its maker's prefix, stands for; the first for null; ValueError for others."""
    if model_id is None:
        return BUILT_IN[0]
    key = model_id.strip().lower().removeprefix("fastembed/")
    key = ALIASES.get(key, key)
    if key not in BUILT_IN:
        raise ValueError(f"{model_id} is not built in")
    return key


_clients: dict[tuple, Embedder] = {}


def client(model: dict) -> Embedder:
    """The embedder of a catalog entry (id, backend, local_path, tokenizer_local_path, max_sequence_length, dimension), made once a process.

    Backend 'hashing' needs no file; others run the model file with onnxruntime, and FileNotFoundError says that there is none yet.
    """
    backend = (model.get("backend") or "onnx").lower()
    key = (model["id"].lower(), backend, model.get("local_path"))
    if key not in _clients:
        if backend == "hashing":
            _clients[key] = hashing_embedder(model.get("dimension") or 64)
        elif backend in ("onnx", "fastembed"):
            if artifact_state(model) != "ready":
                raise FileNotFoundError(f"{model['id']} has no model file")
            _clients[key] = onnx_embedder(model["local_path"], model["tokenizer_local_path"], model.get("max_sequence_length") or 512)
        else:
            raise ValueError(f"backend {backend} is not supported")
    return _clients[key]


def artifact_state(model: dict) -> str:
    """'ready' if the model's file and its tokenizer's are there, 'partial' if one is, else 'pending'. Nothing is fetched: there is no network."""
    there = [bool(model.get(x)) and os.path.exists(model[x]) for x in ("local_path", "tokenizer_local_path")]
    return "ready" if all(there) else "partial" if any(there) else "pending"


def embed(df: DataFrame, text: str, make: Callable[[], Embedder], model_id: str, column: str = "embedding") -> DataFrame:
    """df with a vector of each text and the model's id; a null or blank text has an empty vector, a blank id is 'unknown'."""
    fields = [f for f in df.schema.fields if f.name not in (column, "embedding_model_id")]
    df = df.select(*[f.name for f in fields])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{column}` array<float>", "embedding_model_id string"])
    name = (model_id or "").strip() or "unknown"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for batch in (whole.slice(lo, BATCH) for whole in batches for lo in range(0, whole.num_rows, BATCH)):
            texts = batch.column(text).to_pylist()
            rows = [k for k, t in enumerate(texts) if t and t.strip()]
            vectors: list = [[] for _ in texts]
            if rows:
                for k, v in zip(rows, model([texts[k] for k in rows]), strict=True):
                    vectors[k] = v
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float32())), pa.array([name] * len(texts))], names=[*batch.schema.names, column, "embedding_model_id"])

    return df.mapInArrow(run, schema)
