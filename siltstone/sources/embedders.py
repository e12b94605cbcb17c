"""Embedding connectors: batched, retried and checked inside an iterator pandas function; the client is injected."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.vectors import hash_embedding

Client = Callable[[list[str]], list[tuple[int, list[float]]]]


@dataclass(frozen=True)
class Limits:
    batch: int = 10
    runes: int = 8192
    attempts: int = 4
    pause_s: float = 0.1


def with_retries(call: Callable[[], list], limits: Limits, sleep: Callable[[float], None] = time.sleep) -> list:
    """Up to ``attempts`` calls, the pause growing by the attempt."""
    for attempt in range(1, limits.attempts + 1):
        try:
            return call()
        except Exception:
            if attempt == limits.attempts:
                raise
            sleep(limits.pause_s * attempt)
    return []


def ordered(answer: list[tuple[int, list[float]]], n: int, dim: int | None = None) -> list[list[float]]:
    """Vectors in order of their index: each once, none missing or empty, all of one length."""
    out: list[list[float] | None] = [None] * n
    for index, vector in answer:
        if not 0 <= index < n:
            raise ValueError(f"index {index} is out of range")
        if out[index] is not None:
            raise ValueError(f"index {index} comes twice")
        if not vector:
            raise ValueError(f"vector {index} is empty")
        out[index] = vector
    if any(v is None for v in out):
        raise ValueError("a vector is missing")
    if len({len(v) for v in out} | ({dim} if dim else set())) > 1:
        raise ValueError("vectors differ in length")
    return out


def embed_batch(client: Client, texts: list[str], limits: Limits = Limits(), dim: int | None = None, sleep: Callable[[float], None] = time.sleep) -> list[list[float]]:
    out: list[list[float]] = []
    for at in range(0, len(texts), limits.batch):
        some = [t[: limits.runes] for t in texts[at : at + limits.batch]]
        out += ordered(with_retries(lambda some=some: client(some), limits, sleep), len(some), dim)
    if len({len(v) for v in out}) > 1:
        raise ValueError("vectors differ in length")
    return out


def embedder(make_client: Callable[[], Client], limits: Limits = Limits(), dim: int | None = None):
    """Column function over texts; one client for each Python worker."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = make_client()
        for texts in batches:
            yield pd.Series(embed_batch(client, [t or "" for t in texts], limits, dim))

    return lambda column, _dim=None: embed(column)


def openai_client(base_url: str, key: str, model: str, timeout: float = 60) -> Callable[[], Client]:
    """An OpenAI-compatible endpoint; a key is required."""
    if not key:
        raise ValueError("an API key is required")

    def make() -> Client:
        def call(texts: list[str]) -> list[tuple[int, list[float]]]:
            request = urllib.request.Request(f"{base_url.rstrip('/')}/embeddings", json.dumps({"model": model, "input": texts}).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
            with urllib.request.urlopen(request, timeout=timeout) as r:
                return [(d["index"], d["embedding"]) for d in json.load(r)["data"]]

        return call

    return make


def ollama_client(base_url: str, model: str, timeout: float = 120) -> Callable[[], Client]:
    def make() -> Client:
        def call(texts: list[str]) -> list[tuple[int, list[float]]]:
            request = urllib.request.Request(f"{base_url.rstrip('/')}/api/embed", json.dumps({"model": model, "input": texts}).encode(), {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=timeout) as r:
                return list(enumerate(json.load(r)["embeddings"]))

        return call

    return make


def make_embedder(provider: str, *, dim: int = 1024, base_url: str = "", key: str = "", model: str = "") -> tuple[Callable[..., Column], str]:
    """The Column function of a provider and the model's name: hash, openai, openai-compatible or ollama.

    Hash vectors have ``dim`` numbers; how many a service's have is its own affair, only all must have as many.
    """
    if provider == "hash":
        return (lambda column, d=None: hash_embedding(column, dim)), f"hash-{dim}"
    if provider in ("openai", "openai-compatible"):
        return embedder(openai_client(base_url, key, model)), model
    if provider == "ollama":
        return embedder(ollama_client(base_url, model), Limits(batch=1 << 30)), model
    raise ValueError(f"unsupported embedding provider {provider!r}")
