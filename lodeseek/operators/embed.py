"""Text to vector: a protocol, and two embedders that need no model files."""

from __future__ import annotations

import os
import zlib
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Texts of one run of an encoder.
RUN_TEXTS = 64
QUERY_PROMPT = "Represent this sentence for searching relevant passages: "


class Embedder(Protocol):
    dim: int
    max_len: int

    def embed(self, texts: list[str]) -> np.ndarray:
        """Unit vectors, one row a text."""
        ...


class HashEmbedder:
    """Deterministic feature hashing: each term of the first max_len ones adds a signed bucket; mean, then unit length."""

    def __init__(self, dim: int = 64, full_dim: int = 256, max_len: int = 512, query_prompt: str = QUERY_PROMPT):
        if not 1 <= dim <= full_dim:
            raise ValueError(f"dim must lie in 1..{full_dim}")
        self.dim, self.full_dim, self.max_len, self.query_prompt = dim, full_dim, max_len, query_prompt

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in enumerate(texts):
            words = (text or "").split()[: self.max_len]
            for w in words:
                h = zlib.crc32(w.lower().encode())
                if (bucket := (h >> 1) % self.full_dim) < self.dim:
                    out[row, bucket] += 1.0 if h & 1 else -1.0
            out[row] /= max(len(words), 1)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class EmbedError(RuntimeError):
    """What an embedder can't do. kind: io (a file is missing), runtime (the model fails), tokens (the tokenizer fails), weights (the dense layer
    can't be read), json (a configuration is broken) or shape (parts that don't fit together)."""

    def __init__(self, kind: str, message: str):
        super().__init__(f"{kind}: {message}")
        self.kind = kind


class PrecomputedEmbedder:
    """Stands in where vectors come with the data; texts can't be embedded."""

    def __init__(self, dim: int):
        self.dim, self.full_dim, self.max_len, self.query_prompt = dim, dim, 0, ""

    def embed(self, texts: list[str]) -> np.ndarray:
        raise EmbedError("runtime", "vectors must be supplied")


class OnnxEmbedder:
    """A slot for an encoder exported to ONNX: token states are mean-pooled under the mask, projected, cut to dim, scaled to unit length.

    The files are looked for at once; session and tokenizer are made once a worker, warmed up by one short text, and their shapes are checked.
    """

    def __init__(self, model_path: str, tokenizer_path: str, dim: int | None = None, max_len: int = 512, dense: tuple[np.ndarray, np.ndarray] | None = None, query_prompt: str = QUERY_PROMPT, threads: int = 4, full_dim: int | None = None):
        for path in (model_path, tokenizer_path):
            if not os.path.exists(path):
                raise EmbedError("io", f"{path} is missing")
        if dense is not None:
            weight, bias = dense
            if weight.ndim != 2 or bias.ndim != 1 or len(weight) != len(bias):
                raise EmbedError("shape", f"a dense layer of {weight.shape} with a bias of {bias.shape}")
            full_dim = len(weight)
        if dim is not None and (dim < 1 or full_dim is not None and dim > full_dim):
            raise ValueError(f"dim must lie in 1..{full_dim}")
        self.model_path, self.tokenizer_path, self.model_dir = model_path, tokenizer_path, os.path.dirname(model_path)
        self.full_dim, self.dim, self.max_len, self.dense, self.query_prompt, self.threads = full_dim, dim or full_dim, max_len, dense, query_prompt, threads
        self._session = self._tokenizer = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_session": None, "_tokenizer": None}

    def _open(self) -> None:
        import onnxruntime
        from tokenizers import Tokenizer

        options = onnxruntime.SessionOptions()
        options.graph_optimization_level = onnxruntime.GraphOptimizationLevel.ORT_ENABLE_ALL
        options.intra_op_num_threads = max(1, min(self.threads, os.cpu_count() or 1))
        try:
            self._session = onnxruntime.InferenceSession(self.model_path, options)
        except Exception as e:
            raise EmbedError("runtime", str(e)) from e
        try:
            self._tokenizer = Tokenizer.from_file(self.tokenizer_path)
        except Exception as e:
            raise EmbedError("tokens", str(e)) from e
        self._tokenizer.enable_truncation(self.max_len)
        self._tokenizer.enable_padding()
        width = self._pooled(["warm up"]).shape[1]
        if self.dense is not None and self.dense[0].shape[1] != width:
            raise EmbedError("shape", f"the encoder gives {width} numbers, the dense layer takes {self.dense[0].shape[1]}")
        if self.dense is None and self.dim is not None and self.dim > width:
            raise EmbedError("shape", f"dim {self.dim} of an encoder with {width}")
        self.dim = self.dim or width

    def _pooled(self, texts: list[str]) -> np.ndarray:
        coded = self._tokenizer.encode_batch(texts)
        mask = np.array([e.attention_mask for e in coded], dtype=np.int64)
        feed = {"input_ids": np.array([e.ids for e in coded], dtype=np.int64), "attention_mask": mask}
        names = {i.name for i in self._session.get_inputs()}
        try:
            states = self._session.run(None, {k: x for k, x in feed.items() if k in names})[0]
        except Exception as e:
            raise EmbedError("runtime", str(e)) from e
        if states.ndim != 3 or states.shape[:2] != mask.shape:
            raise EmbedError("shape", f"states of {states.shape} for tokens of {mask.shape}")
        return mean_pool(states, mask)

    def embed(self, texts: list[str]) -> np.ndarray:
        if self._session is None:
            self._open()
        return finish(self._pooled(texts), self.dense, self.dim)


def mean_pool(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return (states * mask[:, :, None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1)


def finish(pooled: np.ndarray, dense: tuple[np.ndarray, np.ndarray] | None, dim: int | None) -> np.ndarray:
    """Project (only the first dim outputs), cut, then normalise."""
    if dense is not None:
        weight, bias = dense
        pooled = pooled @ weight[:dim].T + bias[:dim]
    if dim is not None and dim > pooled.shape[1]:
        raise EmbedError("shape", f"dim must lie in 1..{pooled.shape[1]}")
    cut = pooled[:, :dim]
    return cut / np.maximum(np.linalg.norm(cut, axis=1, keepdims=True), 1e-12)


def prompted(text: Column, prompt: str = QUERY_PROMPT) -> Column:
    return F.concat(F.lit(prompt), F.coalesce(text, F.lit("")))


def embed_column(df: DataFrame, embedder: Embedder, key: str | None, text: str = "text", out: str = "v") -> DataFrame:
    """(key, out): vectors of a text column; key None keeps all columns. Texts go to the embedder in runs of RUN_TEXTS, sorted by length, so that a
    padded run wastes little and a batch's activations stay bounded. The embedder loads its state once a worker."""
    kept = df.columns if key is None else [key]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches):
        for b in batches:
            if b.num_rows:
                texts = [t or "" for t in b[text].to_pylist()]
                order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
                x = np.empty((len(texts), embedder.dim), dtype=np.float32)
                for at in range(0, len(order), RUN_TEXTS):
                    rows = order[at : at + RUN_TEXTS]
                    x[rows] = embedder.embed([texts[i] for i in rows])
                v = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*[b[c] for c in kept], v], [*kept, out])

    return df.select(*dict.fromkeys([*kept, text])).mapInArrow(run, f"{schema}, `{out}` array<float>")


def pool_groups(df: DataFrame, by: str, v: str = "v") -> DataFrame:
    """(by, v): the mean of each component over a group, scaled to unit length."""
    flat = df.where(F.col(v).isNotNull()).select(by, F.posexplode(v).alias("i", "x"))
    mean = flat.groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vectors = mean.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(v))
    from lodeseek.functions.vectors import normalize

    return vectors.select(by, normalize(F.col(v)).alias(v))
