"""A remote vector store behind an injected client: one collection for all namespaces, metadata as columns, filters as text.

The client is made anew in each Python worker by a function that is sent there, so it needs no pickling itself. It has
``describe()`` (dimension and field names, or null where there is no collection), ``create(dim, fields)``,
``insert(columns)``, ``delete(expression)``, ``search(vector, limit, expression, fields)`` (scores and columns) and
``count(expression)``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import string_literal
from siltstone.operators.search import SearchOptions, file_filter_text, filter_text, recall_limit, rerank, validate
from siltstone.schema import CHUNKS, PROMOTED
from siltstone.sources.store import COUNT_CAP, ChunkStore, checked_vectors, from_columns, remote_rows

FIELDS = tuple(c.split(" ")[0] for c in CHUNKS.split(", ") if not c.startswith("metadata ")) + PROMOTED
BATCH, PATHS = 500, 100


class Client(Protocol):
    def describe(self) -> tuple[int, list[str]] | None: ...
    def create(self, dim: int, fields: list[str]) -> None: ...
    def insert(self, columns: dict[str, list]) -> None: ...
    def delete(self, expression: str) -> None: ...
    def search(self, vector: list[float], limit: int, expression: str, fields: list[str]) -> tuple[list[float], dict[str, list]]: ...
    def count(self, expression: str) -> int: ...


def dimension(rows: DataFrame) -> int | None:
    """The one length of all vectors, null without rows; an empty or missing vector or mixed lengths are an error."""
    size = F.coalesce(F.size("vector"), F.lit(0))
    low, high = rows.agg(F.min(size), F.max(size)).first()
    if low is None:
        return None
    if low <= 0 or low != high:
        raise ValueError("vectors are empty or differ in length")
    return high


def batch_rows(scores: list[float], columns: dict[str, list], fields: tuple[str, ...] = FIELDS) -> pd.DataFrame:
    """Column batches of a search as rows; a column that is missing or shorter than the scores is an error."""
    for name in fields:
        if name not in columns or len(columns[name]) != len(scores):
            raise ValueError(f"column {name} has {len(columns.get(name, []))} values for {len(scores)} scores")
    return pd.DataFrame({**{n: columns[n] for n in fields}, "semantic_score": scores})


class RemoteStore:
    """The calls of ``ChunkStore`` over a client."""

    def __init__(self, spark: SparkSession, make_client: Callable[[], Client]):
        self.spark, self.make_client, self.client = spark, make_client, make_client()

    def ensure(self, dim: int) -> None:
        """Creates the collection, or checks that it has all fields and vectors of the same length."""
        there = self.client.describe()
        if there is None:
            self.client.create(dim, list(FIELDS))
            return
        known, names = there
        if known != dim:
            raise ValueError(f"the collection holds vectors of {known} numbers, not {dim}")
        if missing := set(FIELDS) - set(names):
            raise ValueError(f"the collection lacks {sorted(missing)}")

    def _insert(self, rows: DataFrame) -> None:
        dim = dimension(rows)
        if dim is None:
            return
        self.ensure(dim)
        make = self.make_client

        def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            client, n = make(), 0
            for pdf in batches:
                for at in range(0, len(pdf), BATCH):
                    some = pdf.iloc[at : at + BATCH]
                    client.insert({c: [list(map(float, v)) for v in some[c]] if c == "vector" else some[c].tolist() for c in FIELDS})
                    n += len(some)
            yield pd.DataFrame({"n": [n]})

        remote_rows(checked_vectors(rows, dim)).select(*FIELDS).mapInPandas(send, "n bigint").agg(F.sum("n")).collect()

    def _of(self, namespace: str) -> str:
        return f"namespace == {string_literal(validate('namespace', namespace))}"

    def put(self, rows: DataFrame, namespace: str) -> None:
        self.clear(namespace)
        self._insert(rows)

    def replace_files(self, namespace: str, paths: DataFrame, new: DataFrame) -> None:
        listed = [r["relative_path"] for r in paths.select("relative_path").distinct().toLocalIterator()]
        for at in range(0, len(listed), PATHS):
            self.client.delete(file_filter_text(namespace, listed[at : at + PATHS]))
        self._insert(new)

    def search(self, namespace: str, vector: list[float], options: SearchOptions) -> DataFrame:
        """The most similar candidates from the store, fused with keyword scores over them alone."""
        limit = options.limit if options.limit > 0 else len(vector)
        found = batch_rows(*self.client.search(vector, recall_limit(limit, options.query), filter_text(namespace, options), [f for f in FIELDS if f != "vector"]), tuple(f for f in FIELDS if f != "vector"))
        types = {c.split(" ")[0]: c.split(" ", 1)[1] for c in CHUNKS.split(", ") if not c.startswith("metadata ")}
        schema = ", ".join(f"{f} {types.get(f, 'string')}" for f in FIELDS if f != "vector") + ", semantic_score double"
        rows = self.spark.createDataFrame(found.astype(object).where(found.notna(), None).values.tolist(), schema)
        return rerank(from_columns(rows), SearchOptions(**{**options.__dict__, "limit": limit}))

    def clear(self, namespace: str) -> None:
        if self.client.describe() is not None:
            self.client.delete(self._of(namespace))

    def count(self, namespace: str, capped: bool = True) -> int:
        n = self.client.count(self._of(namespace)) if self.client.describe() is not None else 0
        return min(n, COUNT_CAP) if capped else n


def open_store(spark: SparkSession, root: str, kind: str = "local", *, dim: int | None = None, make_client: Callable[[], Client] | None = None) -> ChunkStore | RemoteStore:
    """The store of a kind: ``local`` (tables under ``root``) or ``remote`` (over a client)."""
    if kind == "local":
        return ChunkStore(spark, root, dim)
    if kind == "remote" and make_client is not None:
        return RemoteStore(spark, make_client)
    raise ValueError(f"unsupported store {kind!r}" if kind != "remote" else "a remote store needs a client")
