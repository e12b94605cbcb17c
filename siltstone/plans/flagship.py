"""The minimum slice end to end: documents, line chunks, tokens, BM25 and hash-embedding cosine, fusion, top rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.vectors import embed_query
from siltstone.operators import indexing, search
from siltstone.runtime import materialise, spread, table

QUERY = "which retry keeps the splitter budget"


def flagship(spark: SparkSession, sf_dir: str, query: str = QUERY, limit: int = 20) -> DataFrame:
    """The best chunks of all documents for one query, each source a namespace."""
    docs = spread(table(spark, sf_dir, "documents")).where("text is not null")
    files = docs.select(F.concat_ws("/", "source", "doc_id").alias("absolute_path"), F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("relative_path"), F.lit(".md").alias("extension"), F.col("text").alias("content"), "source")
    # The index is a stored table: the statistics and the scores read it, they don't build it twice.
    chunks = materialise(indexing.chunk_rows(files, F.lit("documents"), dim=256, options=indexing.ChunkOptions(max_lines=5, overlap=1, syntax=False)))
    options = search.SearchOptions(query=query, limit=limit, profile="knowledge", semantic=0.7, keyword=0.3)
    hits = search.search_namespace(chunks, "documents", embed_query(query, 256), options)
    return hits.select("id", "relative_path", "start_line", "end_line", F.round("semantic_score", 6).alias("semantic"), F.round("keyword_score", 6).alias("keyword"), F.round("score", 6).alias("score"))
