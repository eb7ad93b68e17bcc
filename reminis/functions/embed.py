"""Embedding and reranking plug points.

An embedder is any picklable object with ``embed(texts) -> list of vectors`` and a ``name``. It travels with each task; one
whose model takes long to load travels as ``Loaded``: only how to load it is sent, and a Python worker loads it once. The
default adds up a random direction for each token, seeded by the token's hash, which
needs no model file and gives the same vector everywhere.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERY_PREFIX = "query: "
RESULT = "fact_id long, embedding array<float>, error string"


class Embedder(Protocol):
    name: str
    size: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    def __init__(self, size: int = 64):
        self.size, self.name = size, f"hashing-{size}"

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.size), np.float32)
        for i, text in enumerate(texts):
            if text is None:
                raise ValueError("nothing to embed")
            for token in re.findall(r"[a-z0-9]+", text.lower()):
                out[i] += np.random.default_rng(zlib.crc32(token.encode())).standard_normal(self.size).astype(np.float32)
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()


#: The models that this Python process has loaded.
_MODELS: dict[tuple, Embedder] = {}


class Loaded:
    """The embedder that ``load`` (picklable, such as a function of a module) returns for ``arguments``, loaded at the first
    text in each Python process and kept there for all later tasks."""

    def __init__(self, load: Callable[..., Embedder], *arguments: object, name: str, size: int):
        self.load, self.arguments, self.name, self.size = load, arguments, name, size

    def embed(self, texts: list[str]) -> list[list[float]]:
        # Looked up through the module: what a task brings along has no part in it.
        models = sys.modules[__name__]._MODELS
        key = (self.load.__module__, self.load.__qualname__, self.arguments)
        if key not in models:
            models[key] = self.load(*self.arguments)
        return models[key].embed(texts)


def embed_query(embedder: Embedder | None, text: str, size: int = 64) -> list[float]:
    """The vector of a query; all zeros without a model."""
    if embedder is None:
        return [0.0] * size
    return embedder.embed([QUERY_PREFIX + text])[0]


def warm_up(embedder: Embedder) -> bool:
    """Load the model before the first text comes; whether it could. A failure shows with the texts."""
    try:
        embedder.embed([QUERY_PREFIX + "warm-up"])
    except Exception:  # noqa: BLE001  whatever the plugged-in model raises
        return False
    return True


def embed_facts(facts: DataFrame, embedder: Embedder) -> DataFrame:
    """fact_id, embedding, error of fact_id, content: a text that cannot be embedded fails alone."""

    def one(text: str | None) -> tuple[list[float] | None, str | None]:
        try:
            return embedder.embed([text])[0], None
        except Exception as e:  # noqa: BLE001
            return None, str(e)[:200]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["content"].tolist()
            try:
                found = [(v, None) for v in embedder.embed(texts)] if texts else []
            except Exception:  # noqa: BLE001  whatever the plugged-in model raises: now each text by itself
                found = [one(text) for text in texts]
            yield pd.DataFrame({"fact_id": batch["fact_id"], "embedding": [v for v, _ in found], "error": [e for _, e in found]})

    return facts.select("fact_id", "content").mapInPandas(run, RESULT)


def no_rerank(query: Column, text: Column) -> Column:
    """The disabled reranker: equal scores, so the fused order stays."""
    return F.lit(0.0)


def reranker(score) -> object:
    """A reranker for ``exchanges.search`` from a function (query texts, texts) -> scores over whole batches."""

    def run(query: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series(score(query.tolist(), text.tolist()), dtype="float64")

    return F.pandas_udf(run, T.DoubleType())
