"""Stored tables: chunk rows partitioned by namespace, catalog, snapshots and session records, all parquet.

Chunk rows carry promoted copies of their filterable metadata, so that filters on them reach the scan. Writes replace whole
partitions; small tables are written aside and swapped in by a rename.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import ids
from siltstone.functions.text import truncate_utf8
from siltstone.operators.indexing import replace_files, upsert
from siltstone.runtime import materialise
from siltstone.schema import CATALOG, CHUNKS, FILE_STATES, PROMOTED, SESSION, SNAPSHOTS, STATUSES

COUNT_CAP = 16384  # of the remote store's count; off by default
#: Byte limits of the remote store's columns.
BYTE_LIMITS = {"id": 128, "namespace": 128, "version": 128, "tool_name": 128, "relative_path": 2048, "absolute_path": 2048, "heading_path": 2048, "command": 2048, "tags": 2048, "file_extension": 32, "language": 64, "domain_path": 256, "document_id": 256, "section_id": 512, "symbol_name": 512, "symbol_kind": 64, "chunk_kind": 64, "knowledge_kind": 64, "node_kind": 64, "experience_kind": 64, "role": 64, "status": 64, "content": 65535}


class Files:
    """The few file-system calls the tables need, on whatever file system the path names."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}"))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def rename(self, old: str, new: str) -> None:
        self._fs.rename(self._path(f"{self.root}/{old}"), self._path(f"{self.root}/{new}"))


def promote(rows: DataFrame) -> DataFrame:
    return rows.select("*", *(F.col("metadata")[k].alias(k) for k in PROMOTED if k not in rows.columns))


def to_columns(rows: DataFrame) -> DataFrame:
    """The metadata bag as columns; entries without a column are lost, as in the remote store."""
    return rows.select(*[c for c in rows.columns if c != "metadata" and c not in PROMOTED], *(F.coalesce(F.col("metadata")[k], F.lit("")).alias(k) for k in PROMOTED))


def from_columns(rows: DataFrame) -> DataFrame:
    """Columns back into the bag, empty ones dropped."""
    bag = F.map_filter(F.create_map(*(x for k in PROMOTED for x in (F.lit(k), F.col(k)))), lambda _, v: v.isNotNull() & (v != ""))
    return rows.select(*[c for c in rows.columns if c not in PROMOTED], bag.alias("metadata"))


def remote_rows(rows: DataFrame) -> DataFrame:
    """Rows as the remote store takes them: metadata as columns, each text cut to its column's bytes between characters."""
    flat = to_columns(rows)
    return flat.select(*(truncate_utf8(c, BYTE_LIMITS[c]).alias(c) if c in BYTE_LIMITS else F.col(c) for c in flat.columns))


def checked_vectors(rows: DataFrame, dim: int) -> DataFrame:
    """An empty vector or one of another length is an error."""
    ok = F.coalesce(F.size("vector") == dim, F.lit(False))
    return rows.withColumn("vector", F.when(ok, F.col("vector")).otherwise(F.raise_error(F.lit(f"a vector doesn't have {dim} numbers"))))


#: Parts of a namespace by the hash of the path: replacing a few files rewrites only the parts they lie in.
PARTS = 16


class ChunkStore:
    """Put, replace_files, read, clear, count over one table partitioned by namespace and part.

    With ``dim``, rows whose vector has another length are an error.
    """

    def __init__(self, spark: SparkSession, root: str, dim: int | None = None):
        self.spark, self.files, self.path, self.dim = spark, Files(spark, root), f"{root.rstrip('/')}/chunks", dim

    def _stored(self, namespaces: list[str] | None) -> DataFrame:
        columns = f"{CHUNKS}, {', '.join(f'{k} string' for k in PROMOTED)}, part int"
        if not self.files.exists("chunks"):
            return self.spark.createDataFrame([], columns)
        rows = self.spark.read.schema(columns).parquet(self.path)
        return rows.where(F.col("namespace").isin(namespaces)) if namespaces is not None else rows

    def read(self, namespaces: list[str] | None = None) -> DataFrame:
        return self._stored(namespaces).drop("part")

    def _prepared(self, rows: DataFrame) -> DataFrame:
        rows = promote(checked_vectors(rows, self.dim) if self.dim else rows)
        return rows.withColumn("part", F.pmod(F.xxhash64("relative_path"), F.lit(PARTS)).cast("int"))

    def put(self, rows: DataFrame, namespace: str) -> None:
        """All rows of a namespace: what it held before goes, also where ``rows`` is empty."""
        self.clear(namespace)
        self._prepared(rows).write.mode("append").partitionBy("namespace", "part").parquet(self.path)

    def replace_files(self, namespace: str, paths: DataFrame, new: DataFrame) -> None:
        """Rows of the files ``paths`` replaced by ``new``, which lie in the same files."""
        paths = paths.select("relative_path").distinct()
        touched = [r["part"] for r in paths.select(F.pmod(F.xxhash64("relative_path"), F.lit(PARTS)).cast("int").alias("part")).distinct().collect()]  # at most PARTS
        old = self._stored([namespace]).where(F.col("part").isin(touched))
        # The parts are read and overwritten: the new state is made durable first.
        rows = materialise(replace_files(old, paths, self._prepared(new).select(*old.columns)))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("namespace", "part").parquet(self.path)
        left = {r["part"] for r in rows.select("part").distinct().collect()}
        for part in set(touched) - left:
            self.files.delete(f"chunks/namespace={namespace}/part={part}")

    def search(self, namespace: str, vector: list[float], options) -> DataFrame:
        from siltstone.operators.search import search_namespace

        return search_namespace(self.read([namespace]), namespace, vector, options)

    def clear(self, namespace: str) -> None:
        self.files.delete(f"chunks/namespace={namespace}")

    def count(self, namespace: str, capped: bool = False) -> int:
        rows = self.read([namespace])
        return rows.limit(COUNT_CAP).count() if capped else rows.count()


class SmallTable:
    """A table of few rows: read, upserted by key and swapped in."""

    def __init__(self, spark: SparkSession, root: str, name: str, schema: str, key: list[str]):
        self.spark, self.files, self.name, self.schema, self.key = spark, Files(spark, root), name, schema, key

    @property
    def path(self) -> str:
        return f"{self.files.root}/{self.name}"

    def read(self) -> DataFrame:
        if not self.files.exists(self.name) and self.files.exists(f"{self.name}.old"):
            self.files.rename(f"{self.name}.old", self.name)  # a swap that broke off
        return self.spark.read.schema(self.schema).parquet(self.path) if self.files.exists(self.name) else self.spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame) -> None:
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}.new")
        self.files.delete(f"{self.name}.old")
        if self.files.exists(self.name):
            self.files.rename(self.name, f"{self.name}.old")
        self.files.rename(f"{self.name}.new", self.name)

    def upsert(self, rows: DataFrame) -> None:
        old = self.read()
        self.write(upsert(old, rows.select(*old.columns), self.key))

    def delete(self, condition: Column) -> None:
        self.write(self.read().where(~F.coalesce(condition, F.lit(False))))


def snapshots(spark: SparkSession, root: str) -> SmallTable:
    return SmallTable(spark, root, "snapshots", SNAPSHOTS, ["namespace"])


def index_meta(spark: SparkSession, root: str) -> SmallTable:
    return SmallTable(spark, root, "meta", "model string, dim int", ["model"])


class FileStates:
    """What the last run saw of each file, partitioned by namespace: a run reads and writes its own namespace's rows only."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files, self.path = spark, Files(spark, root), f"{root.rstrip('/')}/file_states"

    def read(self, namespace: str) -> DataFrame:
        at = f"{self.path}/namespace={namespace}"
        columns = ", ".join(c for c in FILE_STATES.split(", ") if not c.startswith("namespace "))
        return self.spark.read.schema(columns).parquet(at) if self.files.exists(f"file_states/namespace={namespace}") else self.spark.createDataFrame([], columns)

    def write(self, namespace: str, rows: DataFrame) -> None:
        """``rows`` must not be read from the table lazily."""
        rows.select(*self.read(namespace).columns).write.mode("overwrite").parquet(f"{self.path}/namespace={namespace}")

    def delete(self, namespace: str) -> None:
        self.files.delete(f"file_states/namespace={namespace}")


def sessions(spark: SparkSession, root: str) -> SmallTable:
    return SmallTable(spark, root, "sessions", SESSION, ["id"])


class Catalog(SmallTable):
    """Sources by scope and identity."""

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark, root, "catalog", f"key string, namespace string, {CATALOG}", ["key"])

    @staticmethod
    def entries(manifests: DataFrame) -> DataFrame:
        """Manifest rows as entries: key and namespace from the identity, status indexed and time now where unset."""
        scope = (F.col("scope.scope_type"), F.col("scope.scope_id"), F.col("source.source_type"), F.col("source.source_id"))
        return manifests.withColumns({
            "key": ids.catalog_key(*scope), "namespace": ids.source_namespace(*scope),
            "status": F.coalesce(F.nullif("status", F.lit("")), F.lit("indexed")), "indexed_at": F.coalesce("indexed_at", F.current_timestamp()),
        })

    def put(self, manifests: DataFrame) -> None:
        bad = ~F.col("status").isin(list(STATUSES)) | (F.least("document_count", "memory_count", "knowledge_count") < 0)
        rows = self.entries(manifests)
        self.upsert(rows.withColumn("status", F.when(bad, F.raise_error(F.lit("unsupported status or negative count"))).otherwise(F.col("status"))))

    def find(self, **wanted: str | None) -> DataFrame:
        """Entries equal in every given part: scope_type, scope_id, source_type, source_id, tool_name, status; in order of the key."""
        rows = self.read()
        for name, value in wanted.items():
            if value:
                where = "scope" if name.startswith("scope") else "source" if name in ("source_type", "source_id", "tool_name") else None
                rows = rows.where(F.col(f"{where}.{name}" if where else name) == value)
        return rows.orderBy("key")

    def searchable(self) -> DataFrame:
        return self.read().select("key", "namespace", F.col("source.source_type").alias("source_type"), F.col("source.source_id").alias("source_id"), "status")
