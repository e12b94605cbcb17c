"""Continuous forms: a file stream that keeps a chunk table current, and stateful session de-duplication."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.changes import Manifest
from siltstone.operators.sessions import fold


def stream_documents(spark: SparkSession, path: str, schema: str, per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def keep_current(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Each micro-batch goes to ``write(rows, batch_id)``, which must replace what an earlier attempt at the batch left."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batch_writer(out_dir: str) -> Callable[[DataFrame, int], None]:
    """Idempotent by batch identifier: a repeated batch overwrites its own folder."""

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/batch_id={batch_id}")

    return write


def changed_files(spark: SparkSession, root: str, listing: DataFrame) -> DataFrame:
    """What a trigger of a listing has to process: the listing anti-joined against the committed manifest."""
    return Manifest(spark, root).pending(listing)


STATE = "keys array<string>, hashes array<string>"


def dedup_stream(hits: DataFrame, limit: int):
    """Streamed responses (session_id, rank, result_key, content_hash) without what their session returned before.

    State is one row of seen keys and hashes for each session; it times out after a day without a response. A session's rows of
    one micro-batch are one response, or one for each ``response_id`` where there is such a column, however the rows are
    framed; ``limit`` holds for each response.
    """
    parted = "response_id" in hits.columns


    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        keys, hashes = (set(x) for x in state.get) if state.exists else (set(), set())
        whole = pd.concat(list(frames))
        for _, pdf in whole.groupby("response_id", sort=True, dropna=False) if parted else [(None, whole)]:
            pdf = pdf.sort_values("rank", kind="stable")
            at, dropped = fold(pdf["result_key"].tolist(), pdf["content_hash"].tolist(), limit, keys, hashes)
            out = pdf.iloc[at].copy()
            out["deduped_count"] = dropped
            yield out[["session_id", "rank", "result_key", "content_hash", "deduped_count"]]
        state.update((sorted(keys), sorted(hashes)))
        state.setTimeoutDuration(86_400_000)

    schema = "session_id string, rank int, result_key string, content_hash string, deduped_count int"
    rows = hits.select(F.col("session_id").cast("string").alias("session_id"), "rank", "result_key", "content_hash", *(["response_id"] if parted else []))
    return rows.groupBy("session_id").applyInPandasWithState(step, schema, STATE, "append", "ProcessingTimeTimeout")
