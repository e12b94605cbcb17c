"""Filling containers of fixed capacity with texts, measured in tokens.

A global histogram of lengths (at most ``capacity`` rows, however many texts) is all that the driver sees. A dynamic program
over it chooses the length buckets that minimise padding. From the bucket of the longest texts to that of the shortest, the
batches of longer buckets that still have room are merged with texts of the bucket, each text into the smallest room it fits;
what the bucket has left forms token-budget batches inside it, longest fit first. The plan says for each length which
containers take how many of it, so it has a few thousand rows for any number of texts; texts find their container by their
rank among texts of their length.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.runtime import materialise

CAPACITY, BUCKETS, SALTS = 2048, 32, 64
#: A vocabulary file is sent to the executors, so its size has a bound.
VOCABULARY_LIMIT = 64 << 20


def _vocabulary(path: str | None, pattern: str | None) -> tuple[bytes, str]:
    """Ranks (lines of base64 and number) and splitting pattern of a tokenizer; without a path the installed public one."""
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    with open(path, "rb") as f:
        raw = f.read(VOCABULARY_LIMIT + 1)
    if len(raw) > VOCABULARY_LIMIT:
        raise ValueError(f"{path} is larger than {VOCABULARY_LIMIT} bytes")
    return raw, pattern


def token_counts(spark: SparkSession, path: str | None = None, pattern: str | None = None):
    """Column function: tokens of each text; null counts as 0. The driver reads the vocabulary, executors get it sent."""
    raw, pattern = _vocabulary(path, pattern)
    shared = spark.sparkContext.broadcast(raw)

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        e = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            yield pd.Series([len(e.encode_ordinary(t)) if isinstance(t, str) else 0 for t in b], dtype="int64")

    return F.pandas_udf(count, "int")


def optimal_buckets(counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most ``buckets`` length buckets with the least padding; ``counts[l]`` is the number of items of length l."""
    lengths = np.flatnonzero(counts)
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return []
    n = counts[lengths].astype(np.float64)
    k, m = min(buckets, len(lengths)), len(lengths)
    items, tokens = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * lengths)])
    # waste[i, j]: lengths i..j padded to length j
    waste = lengths[None, :] * (items[None, 1:] - items[:-1, None]) - (tokens[None, 1:] - tokens[:-1, None])
    waste[np.tril_indices(m, -1)] = np.inf
    best = waste[0].copy()
    back = []
    for _ in range(1, k):
        prev = np.concatenate([[np.inf], best[:-1]])
        total = prev[:, None] + waste
        choice = total.argmin(0)
        back.append(np.where(total[choice, np.arange(m)] < best, choice, -1))
        best = np.minimum(best, total[choice, np.arange(m)])
    bounds, j = [], m - 1
    for step in reversed(back):
        if step[j] < 0:
            continue
        bounds.append(int(lengths[j]))
        j = int(step[j]) - 1
        if j < 0:
            break
    if j >= 0:
        bounds.append(int(lengths[j]))
    return sorted(set(bounds))


@dataclass
class Plan:
    """Per length: rank ranges, the first container of each range and how many items of the length a container takes."""

    ranges: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    buckets: list[int]
    containers: int


class _Rooms:
    """Batches with room left, by how much: runs of containers of one content."""

    def __init__(self):
        self.sizes: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def add(self, room: int, first: int, times: int) -> None:
        if room and times:
            if room not in self.runs:
                bisect.insort(self.sizes, room)
                self.runs[room] = []
            self.runs[room].append((first, times))

    def take(self, least: int) -> tuple[int, int, int] | None:
        """A run of the smallest room of at least ``least``: room, first container, number of containers."""
        i = bisect.bisect_left(self.sizes, least)
        if i == len(self.sizes):
            return None
        room = self.sizes[i]
        run = self.runs[room].pop()
        if not self.runs[room]:
            del self.runs[room], self.sizes[i]
        return room, *run


def plan(counts: np.ndarray, capacity: int = CAPACITY, buckets: int = BUCKETS) -> Plan:
    """Containers for ``counts[l]`` items of each length l, bucket by bucket from the longest."""
    bounds = optimal_buckets(counts, buckets)
    left = counts.astype(np.int64).copy()
    left[0] = 0
    used = np.zeros(len(left), np.int64)
    out: dict[int, list[tuple[int, int, int]]] = {}
    rooms, base = _Rooms(), 0

    def put(length: int, first: int, times: int, each: int) -> None:
        out.setdefault(length, []).append((int(used[length]), first, each))
        used[length] += each * times
        left[length] -= each * times

    for low, high in reversed(list(zip([0, *bounds[:-1]], bounds))):
        own = [n for n in range(high, low, -1) if left[n]]
        for n in own:  # batches of longer buckets take what fits them
            while left[n] and (run := rooms.take(n)):
                room, first, times = run
                each = min(room // n, int(left[n]))
                some = min(times, int(left[n]) // each)
                put(n, first, some, each)
                rooms.add(room, first + some, times - some)
                rooms.add(room - each * n, first, some)
        alive = sorted(n for n in own if left[n])
        while alive:  # batches inside the bucket: one pattern, repeated until one of its lengths is used up
            room, pattern = capacity, {}
            while room > 0:
                i = bisect.bisect_right(alive, room) - 1
                while i >= 0 and pattern.get(alive[i], 0) >= left[alive[i]]:
                    i -= 1
                if i < 0:
                    break
                each = min(room // alive[i], int(left[alive[i]]) - pattern.get(alive[i], 0))
                pattern[alive[i]] = pattern.get(alive[i], 0) + each
                room -= each * alive[i]
            times = min(int(left[n]) // each for n, each in pattern.items())
            for n, each in pattern.items():
                put(n, base, times, each)
            rooms.add(room, base, times)
            base += times
            alive = [n for n in alive if left[n]]
    return Plan({n: tuple(np.array(c, np.int64) for c in zip(*r)) for n, r in out.items()}, bounds, base)


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY, tokenizer: str | None = None, pattern: str | None = None, buckets: int = BUCKETS, salts: int = SALTS) -> DataFrame:
    """id, piece_no, token_start, n_tokens, bucket, container_id: every text, or piece of a text longer than ``capacity`` tokens, in a container.

    Only longer texts are cut, into full pieces and a rest. Null and empty texts have no tokens, piece 1 and a null container. Rows
    repeated under one id are packed as often as they occur; an empty table gives no rows. ``tokenizer`` is the path of a file of
    byte-pair ranks and ``pattern`` how texts are split before them; without them the installed public ones serve.
    """
    counted = materialise(df.select(F.col(id_col).alias("id"), token_counts(df.sparkSession, tokenizer, pattern)(F.col(text_col)).alias("n")))
    parts = F.greatest(F.ceil(F.col("n") / capacity), F.lit(1)).cast("int")
    items = counted.select("id", "n", F.posexplode(F.sequence(F.lit(1), parts)).alias("p", "piece_no"))
    items = items.select("id", "piece_no", ((F.col("piece_no") - 1) * capacity).alias("token_start"), F.least(F.col("n") - (F.col("piece_no") - 1) * capacity, F.lit(capacity)).cast("int").alias("n_tokens"))
    histogram = items.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("c")).toPandas()  # at most capacity + 1 rows
    counts = np.zeros(capacity + 1, np.int64)
    counts[histogram["n_tokens"].to_numpy(np.int64)] = histogram["c"].to_numpy(np.int64)
    p = plan(counts, capacity, buckets)
    bounds, ranges = np.array(p.buckets or [0]), p.ranges
    # Rank among items of one length: within a salt, plus the sizes of the salts before. A length may hold any share of the rows.
    salted = items.withColumn("salt", F.pmod(F.xxhash64("id", "piece_no"), F.lit(salts)).cast("int"))
    salted = salted.withColumn("r", F.row_number().over(Window.partitionBy("n_tokens", "salt").orderBy("id", "piece_no")) - 1)
    sizes = salted.groupBy("n_tokens", "salt").agg(F.count(F.lit(1)).alias("c"))  # at most (capacity + 1) x salts rows
    before = Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c")

    @F.pandas_udf("struct<bucket:int,container_id:bigint>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        l, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        box = np.full(len(l), -1, np.int64)
        for one in np.unique(l):
            if one in ranges:
                start, first, each = ranges[one]
                at = np.flatnonzero(l == one)
                k = np.searchsorted(start, r[at], "right") - 1
                box[at] = first[k] + (r[at] - start[k]) // each[k]
        bucket = bounds[np.minimum(np.searchsorted(bounds, l), len(bounds) - 1)]
        return pd.DataFrame({"bucket": bucket.astype(np.int32), "container_id": box})

    placed = salted.join(sizes, ["n_tokens", "salt"]).withColumn("at", place("n_tokens", (F.col("before") + F.col("r")).cast("bigint")))
    some = F.col("n_tokens") > 0
    return placed.select("id", "piece_no", F.col("token_start").cast("bigint").alias("token_start"), "n_tokens", F.when(some, F.col("at.bucket")).alias("bucket"), F.when(some, F.col("at.container_id")).alias("container_id"))


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """containers, tokens, mean and least fill, what of the mean the batches had inside their own bucket (the rest was merged
    into them from shorter ones), and the fewest containers any packing needs."""
    some = packed.where("container_id is not null")
    # Sums by container and bucket first: a container has few buckets, and its own is the greatest.
    parts = some.groupBy("container_id", "bucket").agg(F.sum("n_tokens").alias("t")).groupBy("container_id").agg(F.sum("t").alias("t"), F.max(F.struct("bucket", "t"))["t"].alias("inside"))
    return parts.agg(
        F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("largest"), F.round(F.avg("t") / capacity, 6).alias("mean_fill"),
        F.round(F.avg("inside") / capacity, 6).alias("inside_fill"), F.round(F.min("t") / capacity, 6).alias("least_fill"), F.ceil(F.sum("t") / capacity).alias("fewest"),
    )
