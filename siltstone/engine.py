"""The engine's calls: index, sync, search, import, sources, status, clear, evaluate."""

from __future__ import annotations

import os
import posixpath
import re
import secrets
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import ids
from siltstone.functions.text import language_of
from siltstone.functions.vectors import embed_query
from siltstone.operators import domain, evaluation, indexing, markdown, search, sessions
from siltstone.operators.chunking import node_chunks
from siltstone.runtime import absolute, importable, materialise
from siltstone.sources import store
from siltstone.sources.config import Config
from siltstone.sources.embedders import make_embedder
from siltstone.sources.files import read_files, read_markdown, scan_files
from siltstone.sources.records import checked_cases, memory_type, read_cases, read_memory

SESSION_ID = re.compile(r"[A-Za-z0-9_-]{1,128}")


class NotIndexed(ValueError):
    pass


class Engine:
    """One root folder, on any file system Spark knows: chunk rows, catalog, snapshots, file states, sessions.

    Texts and queries are embedded by the configured provider, or by ``embed`` (a function of a Column and a dimension) named
    ``model``. A root remembers whose vectors it holds and takes no others.
    """

    def __init__(self, spark: SparkSession, root: str, config: Config = Config(), embed=None, model: str = "custom"):
        importable(spark)
        self.spark, self.config = spark, config
        self.root = absolute(root)
        self._hashed = embed is None and config.provider == "hash"
        if embed is None:
            embed, model = make_embedder(config.provider, dim=config.dim, base_url=config.base_url, key=os.environ.get("SILTSTONE_API_KEY", ""), model=config.model)
        self._embed, self.model = embed, model
        self.chunks = store.ChunkStore(spark, self.root, config.dim if self._hashed else None)
        self.catalog, self.snapshots = store.Catalog(spark, self.root), store.snapshots(spark, self.root)
        self.states, self.sessions = store.FileStates(spark, self.root), store.sessions(spark, self.root)
        self.meta = store.index_meta(spark, self.root)

    def _query_vectors(self, queries: list[str]) -> list[list[float]]:
        """Vectors of queries, from where those of the texts come."""
        if self._hashed:
            return [embed_query(q, self.config.dim) for q in queries]
        rows = self.spark.createDataFrame(list(enumerate(queries)), "i int, q string").coalesce(1)
        return [list(map(float, r["v"])) for r in sorted(rows.select("i", self._embed(F.col("q"), self.config.dim).alias("v")).collect())]

    def _check_model(self) -> None:
        """The first write names the model and its dimension; another is an error."""
        known = self.meta.read().first()
        mine = (self.model, self.config.dim if self._hashed else len(self._query_vectors(["dimension"])[0]))
        if known is None:
            self.meta.upsert(self.spark.createDataFrame([mine], "model string, dim int"))
        elif (known["model"], known["dim"]) != mine:
            raise ValueError(f"{self.root} holds vectors of {known['model']} with {known['dim']} numbers, not of {mine[0]} with {mine[1]}")

    # Indexing

    def namespace(self, path: str) -> str:
        return self.spark.range(1).select(ids.code_namespace(F.lit(absolute(path))).alias("n")).first()["n"]

    def _report(self, path: str, namespace: str, status: str, files: int = 0, chunks: int = 0, error: str = "") -> None:
        row = [(absolute(path), namespace, status, files, chunks, error)]
        rows = self.spark.createDataFrame(row, "path string, namespace string, status string, indexed_files int, total_chunks int, error_message string").withColumn("updated_at", F.current_timestamp())
        self.snapshots.upsert(rows)

    def _last(self, namespace: str):
        return self.snapshots.read().where(F.col("namespace") == namespace).first()

    def index(self, path: str) -> dict:
        """Full the first time and after a failure; otherwise only what changed. Returns the counts."""
        namespace, last = self.namespace(path), None
        last = self._last(namespace)
        whole = last is None or last["status"] != "indexed"
        self._report(path, namespace, "indexing")
        try:
            self._check_model()
            root, rules = absolute(path), {"extensions": self.config.extensions, "names": self.config.ignored_names, "patterns": self.config.ignored_patterns}
            old = self.states.read(namespace)
            old = materialise(old.limit(0) if whole else old)
            listing = materialise(scan_files(self.spark, root, content=False, **rules))
            # Files of the size and time seen before keep their hash and aren't read.
            fresh = indexing.diff_files(old, listing.withColumn("hash", F.lit(None).cast("string"))).where(F.col("change").isin("added", "modified"))
            if whole:
                read = scan_files(self.spark, root, **rules).select("absolute_path", "relative_path", "extension", "content", "hash")
            else:
                read = read_files(self.spark, root, listing.join(fresh.select("relative_path"), "relative_path", "left_semi").select("absolute_path", "relative_path", "extension"), **rules)
            read = materialise(read)
            kept = listing.join(fresh.select("relative_path"), "relative_path", "left_anti").join(old.select("relative_path", "hash"), "relative_path")
            found = kept.select("relative_path", "hash", "size", "mod_time_ns").unionByName(listing.join(read.select("relative_path", "hash"), "relative_path").select("relative_path", "hash", "size", "mod_time_ns"))
            found = materialise(found)
            changes = materialise(indexing.diff_files(old, found))
            stats = indexing.stats(changes).first().asDict()
            todo = changes.where(F.col("change").isin("added", "modified")).select("relative_path")
            options = indexing.ChunkOptions(self.config.max_lines, self.config.overlap)
            new = indexing.chunk_rows(read.join(todo, "relative_path", "left_semi"), F.lit(namespace), dim=self.config.dim, options=options, embed=self._embed)
            if whole:
                self.chunks.put(new, namespace)
            elif stats["added"] + stats["modified"] + stats["removed"]:
                self.chunks.replace_files(namespace, changes.where(F.col("change").isin("added", "modified", "removed")), new)
            self.states.write(namespace, found)
            total = self.chunks.count(namespace)
            self._report(path, namespace, "indexed", stats["files"], total)
            return stats | {"chunks": total, "full": whole}
        except Exception as e:
            self.states.delete(namespace)  # the next run is a full one
            self._report(path, namespace, "failed", error=str(e)[:512])
            raise

    def sync(self, path: str | None = None) -> dict[str, dict]:
        """Re-indexes one indexed path, or all of them in order; the first error ends it."""
        known = [r for r in self.snapshots.read().orderBy("path", "namespace").collect() if r["path"] and r["status"] != "indexing"]
        if path is not None:
            known = [r for r in known if r["path"] == absolute(path)]
            if not known:
                raise NotIndexed(f"{path} is not indexed")
        return {r["path"]: self.index(r["path"]) for r in known}

    def status(self, path: str) -> dict:
        row = self._last(self.namespace(path))
        return row.asDict() if row else {"path": absolute(path), "status": "not_indexed"}

    def clear(self, path: str) -> None:
        namespace = self.namespace(path)
        self.chunks.clear(namespace)
        self.states.delete(namespace)
        self.snapshots.delete(F.col("namespace") == namespace)

    # Imports

    def _register(self, scope: tuple[str, str], source: tuple[str, str], rows: DataFrame, column: str) -> str:
        """Replaces what the source held, by nothing if ``rows`` is empty. While it is replaced the source isn't searched."""
        namespace = self.spark.range(1).select(self._source_namespace(scope, source).alias("n")).first()["n"]
        self._check_model()
        self._enter(scope, source, "indexing", 0, "", column)
        self.chunks.put(rows, namespace)
        total = indexing.source_checksum(rows, []).first()
        self._enter(scope, source, "indexed", total["n_rows"], total["checksum"], column)
        return namespace

    def _enter(self, scope: tuple[str, str], source: tuple[str, str], status: str, n: int, checksum: str, column: str) -> None:
        counts = {c: F.lit(n if c == column else 0).cast("int") for c in ("document_count", "memory_count", "knowledge_count")}
        empty = F.lit(None).cast("map<string,string>")
        entry = self.spark.range(1).select(
            F.struct(F.lit(scope[0]).alias("scope_type"), F.lit(scope[1]).alias("scope_id")).alias("scope"), F.struct(F.lit(source[0]).alias("source_type"), F.lit(source[1]).alias("source_id"), F.lit("").alias("tool_name"), empty.alias("metadata")).alias("source"),
            F.lit(int(time.time())).cast("bigint").alias("version"), F.lit(checksum).alias("checksum"), F.current_timestamp().alias("indexed_at"), F.lit(status).alias("status"),
            *(v.alias(k) for k, v in counts.items()), empty.alias("metadata"),
        )
        self.catalog.put(entry)

    def _source_namespace(self, scope: tuple[str, str], source: tuple[str, str]):
        return ids.source_namespace(*(F.lit(x) for x in (*scope, *source)))

    def import_knowledge(self, path: str, source_id: str | None = None, external: bool = False) -> str:
        """Markdown files under ``path`` as one source; replaces what the source held."""
        path = absolute(path)
        scope, source = ("workspace", path), ("external_knowledge" if external else "document", source_id or posixpath.basename(path).rsplit(".", 1)[0] or "documents")
        nodes = markdown.parse_documents(read_markdown(self.spark, path).select("absolute_path", "relative_path", "extension", "content"))
        parts = node_chunks(nodes, max_lines=self.config.max_lines, overlap=self.config.overlap)
        heading = F.array_join("heading_path", " > ")
        fixed = markdown.storage_metadata(F.col("metadata"), F.col("document_id"), F.col("section_id"), heading, F.col("knowledge_kind"), F.col("kind"))
        base = F.create_map(F.lit("absolute_path"), F.col("absolute_path"), F.lit("scope_type"), F.lit(scope[0]), F.lit("scope_id"), F.lit(scope[1]), F.lit("source_type"), F.lit(source[0]), F.lit("source_id"), F.lit(source[1]))
        namespace = self._source_namespace(scope, source)
        rows = parts.select(
            ids.stable_id("knowledge", namespace, F.col("relative_path"), F.col("start_line"), F.col("content")).alias("id"), namespace.alias("namespace"), self._embed(F.col("content"), self.config.dim).alias("vector"), "content", "relative_path",
            F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), F.col("extension").alias("file_extension"), language_of(F.col("extension")).alias("language"), F.map_concat(base, fixed).alias("metadata"),
        )
        return self._register(scope, source, materialise(domain.tag(rows)), "knowledge_count")

    def import_memory(self, path: str, kind: str, source_id: str | None = None) -> str:
        """Memory records of one file as one source of the given kind."""
        path = absolute(path)
        scope, source = ("workspace", posixpath.dirname(path)), (memory_type(kind), source_id or posixpath.basename(path).rsplit(".", 1)[0])
        records = read_memory(self.spark, path)
        # Positions only tell rows without an id apart; the order of a file read as one split is its order of lines.
        records = records.withColumn("_at", F.monotonically_increasing_id().cast("string"))
        rows = indexing.memory_rows(records, self._source_namespace(scope, source), source[0], source[1], path, dim=self.config.dim, position="_at", embed=self._embed)
        return self._register(scope, source, materialise(rows), "memory_count")

    def sources(self, **wanted: str | None) -> DataFrame:
        return self.catalog.find(**wanted)

    def clear_sources(self, **wanted: str | None) -> int:
        found = self.catalog.find(**wanted).select("key", "namespace").collect()
        for row in found:
            self.chunks.clear(row["namespace"])
        self.catalog.delete(F.col("key").isin([r["key"] for r in found]))
        return len(found)

    # Search

    def search(self, path: str | None, query: str, *, limit: int | None = None, types: str | None = None, session: str | None = None) -> dict:
        """Ranked results over the code of ``path`` and the catalog's sources; with a session, without what it returned before."""
        limit = self.config.limit if limit is None else limit
        labels, _ = search.select_types(types)
        domains = domain.domain_filters(self.spark, query)
        vector = self._query_vectors([query])[0]
        wide = limit * search.OVERFETCH if session and limit > 0 else limit
        hits = search.search_all(self.chunks.read(), self.catalog.searchable(), query, vector, limit=wide, types=types, code_namespace=self.namespace(path) if path else None, domains=domains, weights=self.config.weights)
        rows = [r.asDict(recursive=True) for r in search.result_rows(search.ranked(hits)).orderBy("rank").collect()]  # the response: at most the limit, or all where none is set
        dropped = 0
        if session:
            rows, dropped = self._remember(session, rows, limit)
        for i, r in enumerate(rows, 1):
            r["rank"] = i
        return {"query": query, "types": labels, "domain_filters": domains, "results": rows, "result_count": len(rows), "deduped_count": dropped, "session_id": session or ""}

    def new_session(self) -> str:
        return secrets.token_hex(16)

    def _remember(self, session: str, rows: list[dict], limit: int) -> tuple[list[dict], int]:
        if not SESSION_ID.fullmatch(session):
            raise ValueError("invalid session id")
        old = self.sessions.read().where(F.col("id") == session).first()
        keys, hashes = set(old["returned_result_keys"] if old else ()), set(old["returned_content_hashes"] if old else ())
        at, dropped = sessions.fold([f"{r['namespace']}\0{r['result_id']}" for r in rows], [r["content_hash"] for r in rows], limit, keys, hashes)
        row = [(session, sorted(keys), sorted(hashes))]
        new = self.spark.createDataFrame(row, "id string, returned_result_keys array<string>, returned_content_hashes array<string>")
        self.sessions.upsert(new.withColumns({"created_at": F.lit(old["created_at"]) if old else F.current_timestamp(), "updated_at": F.current_timestamp()}))
        return [rows[i] for i in at], dropped

    # Evaluation

    def evaluate(self, path: str | None, cases_path: str, *, limit: int = 0, types: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Per-case rows and the summary row for a file of cases."""
        cases = checked_cases(read_cases(self.spark, cases_path))
        expected = evaluation.expectations(cases)
        plain = cases.select(evaluation.case_id(F.col("id"), F.col("instance_id")).alias("case_id"), evaluation.query_text(F.col("query"), F.col("problem_statement")).alias("q"), "limit", evaluation.type_list(F.col("search_types"), F.col("types"), types or "all").alias("t"))
        answers, schema, latency = [], None, []
        listed = plain.collect()  # a held-out set of cases, a response of at most ``limit`` rows each
        chunks, catalog, namespace = self.chunks.read(), self.catalog.searchable(), self.namespace(path) if path else None
        for c, vector in zip(listed, self._query_vectors([c["q"] for c in listed])):
            start = time.time()
            n = next((x for x in (limit, c["limit"] or 0, self.config.limit) if x > 0), 8)
            hits = search.search_all(chunks, catalog, c["q"], vector, limit=n, types=c["t"], code_namespace=namespace, domains=domain.domain_filters(self.spark, c["q"]), weights=self.config.weights)
            rows = search.result_rows(search.ranked(hits)).withColumn("case_id", F.lit(c["case_id"]))
            answers, schema = answers + rows.collect(), rows.schema
            latency.append((c["case_id"], (time.time() - start) * 1000))
        results = self.spark.createDataFrame(answers, schema)
        per_case = evaluation.evaluate(results, expected).join(self.spark.createDataFrame(latency, "case_id string, latency_ms double"), "case_id", "left")
        p95 = evaluation.nearest_rank(per_case.withColumn("_", F.lit(1)), "latency_ms", ["_"]).select(F.col("p").alias("p95_latency_ms"))
        return per_case, evaluation.summarize(per_case).crossJoin(p95)  # one row each
