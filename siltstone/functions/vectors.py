"""Cosine similarity and the hash embedding as Columns."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.text import embed_tokens

DEFAULT_DIM = 1024


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is null, empty, zero, holds a number that isn't finite, or the lengths differ."""
    na, nb = norm(a), norm(b)
    inf = float("inf")
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (na > 0) & (nb > 0) & (na < inf) & (nb < inf), dot(a, b) / (na * nb)), F.lit(0.0))


def cosine_to(v: Column, query: list[float]) -> Column:
    """Cosine to a fixed vector, its norm folded in beforehand."""
    size = sum(float(x) ** 2 for x in query) ** 0.5
    if not query or size == 0:
        return F.lit(0.0)
    q = F.array(*(F.lit(float(x) / size) for x in query))
    n = norm(v)
    return F.coalesce(F.when((F.size(v) == len(query)) & (n > 0) & (n < float("inf")), dot(v, q) / n), F.lit(0.0))


def token_bucket(token: Column, dim: int) -> tuple[Column, Column]:
    """Index and sign a token adds to a hash embedding."""
    h = F.sha2(token, 256)
    index = (F.conv(F.left(h, F.lit(8)), 16, 10).cast("bigint") % dim).cast("int")
    odd = F.conv(F.substring(h, 9, 2), 16, 10).cast("int") % 2
    return index, F.when(odd == 0, -1).otherwise(1)


def sparse_embedding(text: Column, dim: int = 256) -> Column:
    """array<struct<index, value>> before normalisation, one entry per token."""
    index = lambda t: token_bucket(t, dim)
    return F.transform(embed_tokens(text), lambda t: F.struct(index(t)[0].alias("index"), index(t)[1].alias("value")))


def hash_embedding(text: Column, dim: int = 256) -> Column:
    """Signed token counts by hashed index, scaled to length 1, as floats. Vectorised in numpy: densifying by Column functions takes dim steps a token."""
    dim = dim if dim > 0 else 256

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, tuple[int, int]] = {}
        for texts in batches:
            yield pd.Series([embed_text(t or "", dim, known) for t in texts])

    return embed(text)


_EMBED = re.compile(r"[A-Za-z0-9_\u4e00-\u9fa5]+")


def embed_text(text: str, dim: int, known: dict[str, tuple[int, int]] | None = None) -> np.ndarray:
    known = {} if known is None else known
    v = np.zeros(dim, np.float32)
    for t in _EMBED.findall(text.lower()) or [""]:
        at = known.get(t)
        if at is None:
            h = hashlib.sha256(t.encode()).digest()
            at = int.from_bytes(h[:4], "big") % dim, -1 if h[4] % 2 == 0 else 1
            if len(known) < 200_000:
                known[t] = at
        v[at[0]] += at[1]
    n = np.float32(np.sqrt((v.astype(np.float64) ** 2).sum()))
    return v / n if n > 0 else v


def embed_query(text: str, dim: int = 256) -> list[float]:
    """The hash embedding of one query, on the driver."""
    return embed_text(text, dim).tolist()
