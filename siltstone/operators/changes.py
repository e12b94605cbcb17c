"""Processing only new or changed records.

Two forms. ``changes_by_run`` answers, for a recorded history of full scans, which files each run has to process: the run's
listing is anti-joined against the manifest that the latest earlier successful run left. ``Manifest`` does the work live: it
keeps the processed files with size and checksum, anti-joins a new listing against it, records the batch before anything is
written, writes the output under the batch's identifier, and commits the manifest last. A batch that broke off is discarded
whole before the next begins, whatever the listing looks like by then, and readers see only what a committed batch wrote
last for each file, so every file's records appear exactly once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.runtime import materialise

MANIFEST_SCHEMA = "relative_path string, size bigint, checksum string, batch_id string"
#: After so many commits a snapshot of the whole manifest is written; between, each commit writes its own files only.
COMPACT_EVERY = 16


def clean_path(path: Column) -> Column:
    """Slashes only, no leading ``./``."""
    return F.regexp_replace(F.regexp_replace(path, r"\\+", "/"), r"^(?:\./+)+", "")


def clean_digest(digest: Column) -> Column:
    """One spelling per digest: no blanks, lower case, no algorithm prefix; blank is null."""
    bare = F.regexp_replace(F.lower(F.trim(digest)), r"^sha-?256[:=]\s*", "")
    return F.when(bare != "", bare)


def run_outcomes(snapshots: DataFrame) -> DataFrame:
    """namespace, run_no, ok, prev_ok (latest earlier successful run). The latest report of a run counts; at equal times a final one."""
    rank = F.when(F.col("status") == "indexed", 2).when(F.col("status") == "failed", 1).otherwise(0)
    last = snapshots.where("namespace is not null and run_no is not null").groupBy("namespace", "run_no").agg(F.max(F.struct("updated_at", rank.alias("r"))).alias("m"))
    last = last.select("namespace", "run_no", (F.coalesce(F.col("m.r"), F.lit(0)) == 2).alias("ok"))
    before = Window.partitionBy("namespace").orderBy("run_no").rowsBetween(Window.unboundedPreceding, -1)
    return last.withColumn("prev_ok", F.last(F.when(F.col("ok"), F.col("run_no")), ignorenulls=True).over(before))


def changes_by_run(file_states: DataFrame, snapshots: DataFrame) -> DataFrame:
    """namespace, run_no, relative_path, change (added, changed, removed) for each run with an earlier successful one.

    Of rows for one file and run the latest recorded counts, at equal times the one with a hash. A null hash leaves the file as
    it was at the last successful run. Rows without namespace, path or run number, and runs without a report, take no part.
    Empty tables give no rows.
    """
    runs = run_outcomes(snapshots)
    rows = file_states.select("namespace", clean_path(F.col("relative_path")).alias("relative_path"), "run_no", "recorded_at", clean_digest(F.col("hash")).alias("hash"))
    rows = rows.where("namespace is not null and relative_path is not null and run_no is not null")
    listing = rows.groupBy("namespace", "relative_path", "run_no").agg(F.max(F.struct("recorded_at", "hash")).alias("m"))
    # A path's own history is as long as there are runs; it is folded in the executor that holds it.
    history = listing.groupBy("namespace", "relative_path").agg(F.map_from_entries(F.collect_list(F.struct("run_no", F.coalesce("m.hash", F.lit("")).alias("hash")))).alias("seen"))
    good = runs.where("ok").groupBy("namespace").agg(F.array_sort(F.collect_list("run_no")).alias("good"))
    # What a successful run left of a file: its hash, the one before where it was unreadable, nothing where it was absent.
    left = lambda acc, r: F.when(F.col("seen")[r].isNull(), F.lit("")).when(F.col("seen")[r] == "", acc).otherwise(F.col("seen")[r])
    start = F.struct(F.lit("").alias("now"), F.array().cast("array<struct<run_no:int,hash:string>>").alias("all"))
    step = lambda acc, r: F.struct(left(acc["now"], r).alias("now"), F.concat(acc["all"], F.array(F.struct(r.cast("int").alias("run_no"), left(acc["now"], r).alias("hash")))).alias("all"))
    manifest = history.join(good, "namespace").select("namespace", "relative_path", F.inline(F.aggregate("good", start, step)["all"]))
    manifest = materialise(manifest.where("hash <> ''").select("namespace", "relative_path", F.col("run_no").alias("prev_ok"), F.col("hash").alias("old")))
    due = runs.where("prev_ok is not null").select("namespace", "run_no", "prev_ok")
    now = listing.select("namespace", "relative_path", "run_no", F.col("m.hash").alias("hash")).join(due, ["namespace", "run_no"])
    keys = ["namespace", "relative_path", "prev_ok"]
    fresh = now.where("hash is not null").join(manifest.withColumnRenamed("old", "hash"), [*keys, "hash"], "left_anti")
    fresh = fresh.join(manifest, keys, "left").select("namespace", "run_no", "relative_path", F.when(F.col("old").isNull(), "added").otherwise("changed").alias("change"))
    gone = manifest.join(due, ["namespace", "prev_ok"]).join(now.select("namespace", "relative_path", "run_no"), ["namespace", "relative_path", "run_no"], "left_anti")
    return fresh.unionByName(gone.select("namespace", "run_no", "relative_path", F.lit("removed").alias("change")))


class Manifest:
    """Processed files under ``root``, as a log of commits.

    ``open/<batch>`` is written before a batch's output and names its folder; ``d<n>`` holds the files that commit n added,
    changed or removed, ``s<n>`` every file as of commit n, and each counts once its ``.done`` marker is there. Markers are
    created only where there is none, so of two runs that commit the same number one fails.

    A run: ``pending = m.pending(listing)``; ``m.write(make(pending), out, pending)``; ``m.commit(pending, m.removed(listing))``;
    ``process_new`` does all of it. Listings have relative_path, size and checksum; a null checksum or path is never pending
    (the file could not be read and is tried again next time). Other columns of a listing are ignored.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str = "") -> list[str]:
        at = self._path(f"{self.root}/{folder}" if folder else self.root)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _numbers(self, kind: str) -> list[int]:
        return sorted(int(n[1:-5]) for n in self._names() if n.startswith(kind) and n.endswith(".done"))

    def _mark(self, name: str, text: str = "") -> None:
        """Creates a file that must not exist yet."""
        stream = self._fs.create(self._path(f"{self.root}/{name}"), False)
        try:
            stream.write(text.encode())
        finally:
            stream.close()

    def _text(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def read(self) -> DataFrame:
        """relative_path, size, checksum, batch_id of every processed file: the last snapshot and the commits after it."""
        snapshots, commits = self._numbers("s"), self._numbers("d")
        base = snapshots[-1] if snapshots else 0
        schema = f"{MANIFEST_SCHEMA}, gone boolean"
        parts = [self.spark.read.schema(schema).parquet(f"{self.root}/{k}{n}").withColumn("n", F.lit(n)) for k, n in ([("s", base)] if base else []) + [("d", n) for n in commits if n > base]]
        if not parts:
            return self.spark.createDataFrame([], MANIFEST_SCHEMA)
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        if len(parts) > 1:
            rows = rows.groupBy("relative_path").agg(F.max_by(F.struct("size", "checksum", "batch_id", "gone"), "n").alias("m")).select("relative_path", "m.*")
        return rows.where("not gone").select("relative_path", "size", "checksum", "batch_id")

    def pending(self, listing: DataFrame) -> DataFrame:
        """Files of ``listing`` that the manifest doesn't hold with the same size and checksum.

        A path counts once: equal rows are one, of several versions in one listing that with the greatest checksum counts.
        """
        rows = listing.select(clean_path(F.col("relative_path")).alias("relative_path"), F.col("size").cast("bigint").alias("size"), clean_digest(F.col("checksum")).alias("checksum"))
        rows = rows.where("relative_path is not null and checksum is not null").groupBy("relative_path").agg(F.max(F.struct("checksum", "size")).alias("m")).select("relative_path", "m.size", "m.checksum")
        old = self.read()
        same = (rows["relative_path"] == old["relative_path"]) & rows["size"].eqNullSafe(old["size"]) & (rows["checksum"] == old["checksum"])
        return materialise(rows.join(old, same, "left_anti"))

    def removed(self, listing: DataFrame) -> DataFrame:
        """Files the manifest holds that the listing lacks."""
        there = listing.select(clean_path(F.col("relative_path")).alias("relative_path"))
        return materialise(self.read().join(there, "relative_path", "left_anti"))

    # A batch: begun, written, committed or discarded

    def recover(self) -> list[str]:
        """Ends what earlier runs left open: the output of a batch without commit is deleted. Returns the discarded batches."""
        committed = {b for n in self._numbers("d") for b in [self._text(f"d{n}.done")] if b}
        discarded = []
        for batch in self._names("open"):
            if batch.startswith("."):
                continue
            if batch not in committed:
                self._delete(self._text(f"open/{batch}"))
                discarded.append(batch)
            self._delete(f"{self.root}/open/{batch}")
        return discarded

    def begin(self, out_dir: str) -> str:
        """Discards what broke off and records a new batch, before anything of it is written. Returns its identifier."""
        self.recover()
        batch = uuid.uuid4().hex
        self._mark(f"open/{batch}", f"{out_dir.rstrip('/')}/batch_id={batch}")
        return batch

    def write(self, output: DataFrame, out_dir: str, pending: DataFrame) -> str:
        """Begins a batch and writes its output, which has relative_path, to the batch's own folder. Returns the folder."""
        if "relative_path" not in output.columns:
            raise ValueError("the output needs the column relative_path, so that a changed file's older rows can be told")
        self.batch = self.begin(out_dir)
        to = f"{out_dir.rstrip('/')}/batch_id={self.batch}"
        output.write.mode("overwrite").parquet(to)
        return to

    def commit(self, pending: DataFrame, removed: DataFrame | None = None) -> None:
        """The batch of the last ``write``, if any, counts from here on; so do the files removed."""
        batch = getattr(self, "batch", None)
        n = max([0, *self._numbers("d"), *self._numbers("s")]) + 1
        rows = pending.select("relative_path", "size", "checksum", F.lit(batch).alias("batch_id"), F.lit(False).alias("gone"))
        if removed is not None:
            rows = rows.unionByName(removed.select("relative_path", "size", "checksum", "batch_id", F.lit(True).alias("gone")))
        rows.write.mode("overwrite").parquet(f"{self.root}/d{n}")
        self._mark(f"d{n}.done", batch or "")  # the commit
        self.batch = None
        self.recover()
        if n % COMPACT_EVERY == 0:
            self.compact(n)

    def compact(self, n: int) -> None:
        """A snapshot as of commit n. Older logs stay; readers begin at the snapshot once it is whole."""
        self.read().withColumn("gone", F.lit(False)).write.mode("overwrite").parquet(f"{self.root}/s{n}")
        self._mark(f"s{n}.done")

    def output(self, out_dir: str) -> DataFrame | None:
        """The current rows: of each file what the batch wrote that the manifest names; null before the first commit."""
        live = self.read().where("batch_id is not null").select("relative_path", "batch_id")
        kept = [r["batch_id"] for r in live.select("batch_id").distinct().collect()]  # one row a batch that still holds a file
        if not kept:
            return None
        rows = self.spark.read.option("basePath", out_dir.rstrip("/")).parquet(*(f"{out_dir.rstrip('/')}/batch_id={b}" for b in kept))
        key = clean_path(F.col("relative_path"))
        live = live.select(F.col("relative_path").alias("_path"), F.col("batch_id").alias("_batch"))
        return rows.join(live, (key == F.col("_path")) & (F.col("batch_id") == F.col("_batch")), "left_semi")

    def vacuum(self, out_dir: str) -> list[str]:
        """Deletes the folders of batches that hold no file any more, and the open ones of broken runs. Not beside a running batch."""
        self.recover()
        kept = {f"batch_id={r['batch_id']}" for r in self.read().where("batch_id is not null").select("batch_id").distinct().collect()}
        at = self._path(out_dir)
        old = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        gone = [n for n in old if n.startswith("batch_id=") and n not in kept]
        for name in gone:
            self._delete(f"{out_dir.rstrip('/')}/{name}")
        return gone


def process_new(spark: SparkSession, listing: DataFrame, root: str, out_dir: str, make: Callable[[DataFrame], DataFrame]) -> int:
    """One incremental run: ``make(pending)`` gives the output (with relative_path) for the pending files. Returns how many there were.

    After a failure at any step the next run discards what was begun and starts from its own listing; read the result by
    ``Manifest(spark, root).output(out_dir)``.
    """
    m = Manifest(spark, root)
    m.recover()
    pending, gone = m.pending(listing), m.removed(listing)
    n = pending.count()
    if n:
        m.write(make(pending), out_dir, pending)
    if n or not gone.isEmpty():
        m.commit(pending, gone)
    return n
