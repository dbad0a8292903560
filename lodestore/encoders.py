"""Encoders: payload text to vectors, as column functions."""

from __future__ import annotations

import zlib
from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions import metrics


class Encoder(ABC):
    """Turns columns of texts into columns of vectors with `dim` components."""

    dim: int
    takes_vectors = False  # else payloads that are vectors already stay as they are

    @abstractmethod
    def items(self, data: Column) -> Column:
        """Vectors of items to store."""

    def queries(self, data: Column) -> Column:
        """Vectors of queries; as items, unless an encoder tells them apart."""
        return self.items(data)


class HashingEncoder(Encoder):
    """A deterministic encoder without a model: signed hashes of words and of their letter triples, normalised."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def items(self, data: Column) -> Column:
        dim = self.dim

        @F.arrow_udf("array<float>")
        def encoded(text: pa.Array) -> pa.Array:
            out = np.zeros((len(text), dim), np.float32)
            for row, t in enumerate(text.to_pylist()):
                for word in (t or "").lower().split():
                    for part in (word, *(f" {word} "[i : i + 3] for i in range(len(word)))):
                        h = zlib.crc32(part.encode())
                        out[row, h % dim] += 1 if h >> 31 else -1
            out /= np.linalg.norm(out, axis=1, keepdims=True) + metrics.EPSILON
            return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * dim, pa.int32()), pa.array(out.ravel()))

        return encoded(data)


class PassthroughEncoder(Encoder):
    """Vectors that come as vectors: checked for their length and, if asked, normalised."""

    takes_vectors = True

    def __init__(self, dim: int, normalize: bool = True) -> None:
        self.dim, self.normalize = dim, normalize

    def items(self, data: Column) -> Column:
        fine = metrics.require_dim(data.cast("array<float>"), self.dim)
        return metrics.normalize(fine) if self.normalize else fine


class TransformerEncoder(Encoder):
    """Mean-pooled states of a transformer model, cut or filled to dim; the libraries load on the executors."""

    def __init__(self, model: str, dim: int, max_tokens: int = 512, batch: int = 32, normalize: bool = True) -> None:
        try:
            import torch  # noqa: F401
            import transformers  # noqa: F401
        except ImportError as e:
            raise RuntimeError("TransformerEncoder needs torch and transformers") from e
        self.model, self.dim, self.max_tokens, self.batch, self.normalize = model, dim, max_tokens, batch, normalize

    def items(self, data: Column) -> Column:
        model, max_tokens, size = self.model, self.max_tokens, self.batch

        @F.arrow_udf("array<float>")
        def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            import torch
            from transformers import AutoModel, AutoTokenizer

            tokenizer, net = AutoTokenizer.from_pretrained(model), AutoModel.from_pretrained(model).eval()
            for texts in batches:
                found = []
                for i in range(0, len(texts), size):
                    part = tokenizer([t or "" for t in texts[i : i + size].to_pylist()], padding=True, truncation=True, max_length=max_tokens, return_tensors="pt")
                    with torch.no_grad():
                        states = net(**part).last_hidden_state
                    mask = part["attention_mask"][..., None].to(states.dtype)
                    found += ((states * mask).sum(1) / mask.sum(1).clamp(min=1e-6)).tolist()
                yield pa.array(found, pa.list_(pa.float32()))

        fitted = metrics.fit_dim(encoded(data), self.dim)
        return metrics.normalize(fitted) if self.normalize else fitted
