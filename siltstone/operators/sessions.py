"""Session de-duplication of ranked hits.

The exact form is an ordered fold over one session's few hits (at most three times the limit per searched namespace). The
set form is a plan without Python, valid where result keys are unique within a response.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fold(keys: list[str], hashes: list[str], limit: int, seen_keys: set[str], seen_hashes: set[str]) -> tuple[list[int], int]:
    """Positions emitted and the number of hits dropped as seen before, counted past the limit too.

    A dropped hit records nothing, nor does one left out because the limit is reached. Limit 0 or less emits every new hit.
    """
    out, dropped = [], 0
    for i, (k, h) in enumerate(zip(keys, hashes)):
        if k in seen_keys or h and h in seen_hashes:
            dropped += 1
        elif limit <= 0 or len(out) < limit:
            out.append(i)
            seen_keys.add(k)
            if h:
                seen_hashes.add(h)
    return out, dropped


def dedup_sessions(hits: DataFrame, seen: DataFrame, limit: int, *, session: str = "session_id", order: str = "rank", key: str = "result_key", content_hash: str = "content_hash") -> DataFrame:
    """``hits`` that each session has not returned yet, with new_rank and deduped_count.

    ``seen`` has session_id, kind (key or hash) and value. A session's hits are a bounded response, so its group is small.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema) + ", new_rank int, deduped_count int"

    def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a = a.sort_values([order], kind="stable")
        keys, hashes = set(b.loc[b["kind"] == "key", "value"]), set(b.loc[b["kind"] == "hash", "value"])
        at, dropped = fold(a[key].tolist(), a[content_hash].tolist(), limit, keys, hashes)
        out = a.iloc[at].copy()
        out["new_rank"], out["deduped_count"] = range(1, len(out) + 1), dropped
        return out

    return hits.groupBy(session).cogroup(seen.withColumnRenamed("session_id", session).groupBy(session)).applyInPandas(one, schema)


def dedup_sets(hits: DataFrame, seen: DataFrame, limit: int, *, session: str = "session_id", order: str = "rank", key: str = "result_key", content_hash: str = "content_hash") -> DataFrame:
    """The same for unique keys, by anti-joins and windows: hits with new_rank."""
    known = lambda kind, col: seen.where(F.col("kind") == kind).select(F.col("session_id").alias(session), F.col("value").alias(col))
    fresh = hits.join(known("key", key), [session, key], "left_anti").join(known("hash", content_hash), [session, content_hash], "left_anti")
    w = Window.partitionBy(session, content_hash).orderBy(order)
    first = fresh.withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) | (F.col(content_hash) == "")).drop("_n")
    ranked = first.withColumn("new_rank", F.row_number().over(Window.partitionBy(session).orderBy(order)))
    return ranked.where(F.col("new_rank") <= limit) if limit > 0 else ranked


def distinct_contents(df: DataFrame, content_hash: str, order: str) -> DataFrame:
    """The first row of each content, by ``order``: a two-phase aggregate, so copies leave before the shuffle."""
    return df.groupBy(content_hash).agg(F.min(order).alias(order)).join(df, [content_hash, order])


def remember(returned: DataFrame, *, session: str = "session_id", key: str = "result_key", content_hash: str = "content_hash") -> DataFrame:
    """Rows to append to the session table for what was returned."""
    return returned.select(F.col(session).alias("session_id"), F.inline(F.array(F.struct(F.lit("key").alias("kind"), F.col(key).alias("value")), F.struct(F.lit("hash").alias("kind"), F.col(content_hash).alias("value"))))).where("value <> ''")
