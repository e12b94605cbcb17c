"""Indexing files: change sets against the last snapshot, chunks, rows, replacement by file, and the index's life cycle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import ids
from siltstone.functions.text import language_of, overlay, trim_space
from siltstone.functions.vectors import hash_embedding
from siltstone.operators import domain
from siltstone.operators.chunking import line_chunks, syntax_chunks


def diff_files(previous: DataFrame, current: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The keys (relative_path), hash, change: one full outer join. ``added``, ``modified``, ``removed``, ``touched`` (other time, same bytes) or ``unchanged``.

    Both sides have the keys, hash, size, mod_time_ns. Equal size and time make a file unchanged without its hash; a
    current hash that is null (not read yet) with other size or time is ``modified``.
    """
    keys = keys or ["relative_path"]
    p = previous.select(*keys, F.col("hash").alias("old_hash"), F.col("size").alias("old_size"), F.col("mod_time_ns").alias("old_time"))
    c = current.select(*keys, "hash", "size", "mod_time_ns")
    both = p.withColumn("_p", F.lit(True)).join(c.withColumn("_c", F.lit(True)), keys, "full_outer")
    still = (F.col("size") == F.col("old_size")) & (F.col("mod_time_ns") == F.col("old_time"))
    same = F.coalesce(F.col("hash") == F.col("old_hash"), F.lit(False))
    change = F.when(F.col("_p").isNull(), "added").when(F.col("_c").isNull(), "removed").when(F.coalesce(still, F.lit(False)), "unchanged").when(same, "touched").otherwise("modified")
    return both.select(*keys, F.coalesce("hash", "old_hash").alias("hash"), change.alias("change"))


def diff_hashes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """The same by hash alone, for snapshots that keep no file states; files without a hash take no part."""
    p, c = (x.where("hash is not null and hash <> ''").select("relative_path", F.col("hash").alias(n)) for x, n in ((previous, "old"), (current, "new")))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "unchanged").otherwise("modified")
    return p.join(c, "relative_path", "full_outer").select("relative_path", F.coalesce("new", "old").alias("hash"), change.alias("change"))


def stats(changes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return changes.groupBy(*keys).agg(*(F.count_if(F.col("change") == k).alias(k) for k in ("added", "modified", "removed", "touched", "unchanged")), F.count_if(F.col("change") != "removed").alias("files"))


def replace_files(rows: DataFrame, paths: DataFrame, new: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows of other files and the new ones: an anti-join and a union, one shuffle of the old rows' keys at most."""
    return rows.join(paths, keys or ["relative_path"], "left_anti").unionByName(new)


def upsert(rows: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(new.select(*key), key, "left_anti").unionByName(new)


@dataclass(frozen=True)
class ChunkOptions:
    max_lines: int = 120
    overlap: int = 20
    syntax: bool = True


def chunk_rows(files: DataFrame, namespace: Column, *, dim: int = 256, options: ChunkOptions = ChunkOptions(), embed=hash_embedding) -> DataFrame:
    """Stored rows of files (absolute_path, relative_path, extension, content string): chunked, embedded and tagged in one pass, no shuffle."""
    files = files.withColumn("language", language_of(F.col("extension")))
    if options.syntax:
        parts = syntax_chunks(files.withColumn("_f", F.struct("absolute_path", "relative_path", "extension", "language")), "_f", max_lines=options.max_lines, overlap=options.overlap)
        parts = parts.select("_f.*", "content", "start_line", "end_line", "metadata")
    else:
        parts = line_chunks(files, max_lines=options.max_lines, overlap=options.overlap).drop("content").withColumnRenamed("chunk_content", "content").withColumn("metadata", F.create_map().cast("map<string,string>"))
    own = F.create_map(F.lit("absolute_path"), F.col("absolute_path"))
    rows = parts.select(
        ids.chunk_id(F.col("relative_path"), F.col("start_line"), F.col("end_line"), F.col("content")).alias("id"), namespace.alias("namespace"), embed(F.col("content"), dim).alias("vector"), "content",
        "relative_path", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), F.col("extension").alias("file_extension"), "language",
        F.map_concat(own, F.map_filter("metadata", lambda k, _: k != "absolute_path")).alias("metadata"),
    )
    return domain.tag(rows)


def memory_metadata(source_type: Column, source_id: Column, absolute_path: Column, source_metadata: Column) -> Column:
    """Metadata of an imported record: base, then the source's, then the record's entries, then its own fields; later ones win, blank fields are left out."""
    empty = F.create_map().cast("map<string,string>")
    base = F.create_map(F.lit("absolute_path"), absolute_path, F.lit("source_type"), source_type, F.lit("source_id"), source_id)
    kind = F.coalesce(F.when(trim_space(F.col("experience_kind")) != "", F.col("experience_kind")), F.when(source_type == "experience", F.lit("general")))
    pairs = {
        "record_id": F.col("id"), "summary": F.col("summary"), "role": F.col("role"), "conversation_id": F.col("conversation_id"), "message_id": F.col("message_id"), "tool_name": F.col("tool_name"), "created_at": F.col("created_at"), "updated_at": F.col("updated_at"),
        "importance": F.when(F.col("importance") > 0, F.regexp_replace(F.col("importance").cast("string"), r"\.0$", "")), "tags": F.when(F.size("tags") > 0, F.array_join("tags", ",")), "domain_path": F.col("domain_path"), "experience_kind": kind,
    }
    own = F.map_filter(F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), v))), lambda _, v: v.isNotNull() & (trim_space(v) != ""))
    return overlay(overlay(overlay(base, F.coalesce(source_metadata, empty)), F.coalesce(F.col("metadata"), empty)), own)


def memory_rows(records: DataFrame, namespace: Column, source_type: str, source_id: str, absolute_path: str, *, dim: int = 256, position: str | None = None, embed=hash_embedding) -> DataFrame:
    """Stored rows of memory records with content; ids from the record's id, else from its position (``position`` column) and content."""
    kind, sid = F.lit(source_type), F.lit(source_id)
    records = records.where(F.coalesce(trim_space(F.col("content")) != "", F.lit(False)))
    own = ids.stable_id("memory", namespace, kind, sid, F.col("id"))
    by_place = ids.stable_id("memory", namespace, kind, sid, F.col(position) if position else F.lit("0"), F.col("content"))
    name = F.regexp_extract(F.lit(absolute_path), r"([^/]*)$", 1)
    rows = records.select(
        F.when(F.coalesce("id", F.lit("")) != "", own).otherwise(by_place).alias("id"), namespace.alias("namespace"), embed(F.col("content"), dim).alias("vector"), "content",
        F.coalesce(F.nullif("relative_path", F.lit("")), name).alias("relative_path"), F.coalesce("line", F.lit(0)).alias("start_line"), F.coalesce("line", F.lit(0)).alias("end_line"),
        F.regexp_extract(F.lit(absolute_path), r"(\.[^./]*)$", 1).alias("file_extension"), F.lit("memory").alias("language"), memory_metadata(kind, sid, F.lit(absolute_path), F.lit(None).cast("map<string,string>")).alias("metadata"),
    )
    return domain.tag(rows.withColumn("_ext", F.lit("")), extension="_none", overwrite=False).drop("_ext")


def source_checksum(rows: DataFrame, by: list[str]) -> DataFrame:
    """Manifest numbers per source: rows and an order-independent checksum of (id, path, content), text.

    An ordered hash over all rows would gather a whole source in one task. Number, sum and exclusive-or of the row hashes are a
    two-phase aggregate; the sum tells repeated rows, which cancel in the exclusive-or.
    """
    part = ids.checksum_part(F.col("id"), F.col("relative_path"), F.col("content"))
    first, second = F.xxhash64(part), F.xxhash64(part, F.lit("2"))
    n, x, s = F.count(F.lit(1)), F.bit_xor(first), F.sum(second.cast("decimal(38,0)"))
    text = F.concat_ws("-", n.cast("string"), F.coalesce(x, F.lit(0)).cast("string"), F.coalesce(s, F.lit(0)).cast("string"))
    return rows.groupBy(*by).agg(n.alias("n_rows"), F.concat(F.lit("mix:"), F.sha2(text, 256)).alias("checksum"))


def ordered_checksum(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The ordered form, ``sha256:`` over the rows' parts, for sources small enough for one task each."""
    part = ids.checksum_part(F.col("id"), F.col("relative_path"), F.col("content"))
    listed = F.array_sort(F.collect_list(F.struct(*order, part.alias("_part"))))
    return rows.groupBy(*by).agg(F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.transform(listed, lambda x: x["_part"]), ""), 256)).alias("checksum"))
