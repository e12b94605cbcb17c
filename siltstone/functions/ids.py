"""Deterministic identities: namespaces, row ids, content hashes and checksums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.text import collapse_space, or_empty


def _joined(*parts: Column) -> Column:
    return F.concat_ws("\0", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def code_namespace(absolute_path: Column) -> Column:
    return F.concat(F.lit("code_chunks_"), F.left(F.md5(absolute_path), F.lit(8)))


def source_namespace(scope_type: Column, scope_id: Column, source_type: Column, source_id: Column) -> Column:
    return F.concat(F.lit("source_"), source_type, F.lit("_"), F.left(F.sha2(_joined(scope_type, scope_id, source_type, source_id), 256), F.lit(16)))


def scope_namespace(scope_type: Column, scope_id: Column) -> Column:
    return F.concat(F.lit("context_"), scope_type, F.lit("_"), F.left(F.sha2(scope_id, 256), F.lit(16)))


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{prefix.strip() or 'doc'}_"), F.left(F.sha2(_joined(*parts), 256), F.lit(16)))


def chunk_id(path: Column, start: Column, end: Column, content: Column) -> Column:
    return F.concat(F.lit("chunk_"), F.left(F.sha2(F.concat_ws(":", path, start.cast("string"), end.cast("string"), content), 256), F.lit(16)))


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def content_hash(content: Column) -> Column:
    """Hash of the content with white space collapsed."""
    return F.concat(F.lit("sha256:"), F.sha2(collapse_space(or_empty(content)), 256))


def result_key(namespace: Column, row_id: Column) -> Column:
    return F.concat_ws("\0", namespace, row_id)


def catalog_key(scope_type: Column, scope_id: Column, source_type: Column, source_id: Column) -> Column:
    return _joined(scope_type, scope_id, source_type, source_id)


def checksum_part(row_id: Column, path: Column, content: Column) -> Column:
    """What one row adds to its source's checksum."""
    return F.concat(*(F.concat(or_empty(x), F.lit("\0")) for x in (row_id, path, content)))
