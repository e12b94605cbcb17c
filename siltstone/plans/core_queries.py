"""Queries over the core operators and the equal SQL."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import ids, scoring, text, vectors
from siltstone.operators import chunking, domain, evaluation, indexing, markdown, search, sessions
from siltstone.operators.changes import changes_by_run
from siltstone.runtime import spread, table
from siltstone.sources.files import matches_any
from siltstone.sources.store import Catalog, from_columns, to_columns

QUERY = "splitter budget of the go test panic in the retry channel"
TOKENS = search.query_tokens(QUERY)
VECTOR = [round(math.sin(i + 1), 4) for i in range(64)]
TOP = 25
DOMAINS = ("programming/go", "database", "database/milvus", "search/ranking")
PATTERNS = ["docs/**", "*.json", "/cmd/*_1*", "testdata/**", "in?ernal/*/log_*"]
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def wide(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spread(table(spark, d, name))


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Fixed values as the SQL knows them, written out a second time: a slip in the tables of the operators shows as a difference.

_SQL_WEIGHTS = {
    "code": "content 1.0 relative_path 2.0 file_extension 0.4 language 0.4 other 0.5 symbol_name 3.0 symbol_kind 1.2 chunk_kind 0.5 domain_path 0.8 experience_kind 0.4",
    "knowledge": "content 1.0 relative_path 0.6 file_extension 0.2 language 0.2 other 0.4 heading_path 2.0 document_id 1.0 section_id 0.8 knowledge_kind 0.6 node_kind 0.3 version 0.2",
    "conversation": "content 1.0 relative_path 0.1 file_extension 0 language 0 other 0.2 role 0.2 domain_path 0.4",
    "experience": "content 1.0 relative_path 0.2 file_extension 0 language 0 other 0.4 domain_path 1.4 experience_kind 1.2 tags 1.0",
    "preference": "content 1.2 relative_path 0.1 file_extension 0 language 0 other 0.3 domain_path 0.8 tags 0.6",
    "tool_history": "content 1.0 relative_path 0.2 file_extension 0 language 0 other 0.4 tool_name 1.5 command 0.8 status 0.8 domain_path 0.6",
    "fact": "content 1.1 relative_path 0.1 file_extension 0 language 0 other 0.4 domain_path 0.8",
    "default": "content 1.0 relative_path 0.4 file_extension 0.1 language 0.1 other 0.3",
}
_SQL_STRATEGIES = {"default": (0.75, 0.25), "code": (0.3, 0.7), "knowledge": (0.7, 0.3), "conversation": (0.85, 0.15), "experience": (0.75, 0.25), "preference": (0.55, 0.45), "tool_history": (0.8, 0.2), "fact": (0.65, 0.35)}
_SQL_PROFILE_OF = {"document": "knowledge", "external_knowledge": "knowledge", "conversation": "conversation", "experience": "experience", "preference": "preference", "tool_history": "tool_history", "fact": "fact"}
_SQL_RULES = """programming/go: go, golang, goroutine, channel, gofmt, go test, go mod, panic, defer; .go
database/milvus: milvus, vector database, vector store, collection, embedding, topk, hybrid search;
infrastructure/kubernetes: kubernetes, k8s, pod, deployment, container, helm, kubectl, namespace; .yaml, .yml
programming/frontend: frontend, react, vue, typescript, javascript, css, tailwind, vite, webpack; .ts, .tsx, .js, .jsx, .css, .html
database/sql: database, sql, mysql, postgres, redis, transaction, index, query; .sql
programming/testing: test, unit test, coverage, mock, assert, fixture, go test; _test.go
devops/deployment: deploy, release, build, ci, pipeline, docker, makefile, rollback; dockerfile, makefile"""
_SQL_PROFILES = """programming/go: programming/go; Go 语言开发、goroutine、channel、go test、go mod、panic、defer、接口和性能分析相关经验; go; golang; goroutine; channel; go test; go mod; Go 单元测试失败如何排查; goroutine 泄漏分析; panic 和 recover 使用边界
database/milvus: database/milvus; Milvus、向量数据库、collection、index、load、search、TopK、embedding 和 hybrid search 相关经验; milvus; vector database; vector store; collection; embedding; hybrid search; Milvus collection not loaded; vector search returns empty result; hybrid search ranking problem
infrastructure/kubernetes: infrastructure/kubernetes; Kubernetes、k8s、pod、deployment、container、helm、kubectl 和 namespace 相关经验; kubernetes; k8s; pod; deployment; container; helm; kubectl; Pod CrashLoopBackOff 排查; Kubernetes deployment 发布失败; kubectl 查看 namespace 下资源"""
_SQL_KINDS = [("troubleshooting", "troubleshoot faq error 错误 排障 故障"), ("example", "example sample 示例 例子"), ("api", "api function parameter 接口 参数 配置项"), ("rule", "must should rule 禁止 必须 应该 规范 规则")]
#: Expressions that PATTERNS stand for, by hand.
_SQL_GLOBS = ["^(?:.*/)?docs(?:/.*)?$", r"^(?:.*/)?[^/]*\.json(?:/.*)?$", "^cmd/.*_1.*$", "^(?:.*/)?testdata(?:/.*)?$", "^in.ernal/.*/log_.*$"]


# Change detection between runs.

_CHANGES = r"""
WITH o AS (SELECT namespace, run_no, status = 'indexed' AS ok FROM snapshots QUALIFY row_number() OVER (PARTITION BY namespace, run_no ORDER BY updated_at DESC, CASE status WHEN 'indexed' THEN 2 WHEN 'failed' THEN 1 ELSE 0 END DESC) = 1),
runs AS (SELECT *, max(CASE WHEN ok THEN run_no END) OVER (PARTITION BY namespace ORDER BY run_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_ok FROM o),
f AS (SELECT namespace, regexp_replace(replace(relative_path, chr(92), '/'), '^(\./)+', '') AS relative_path, run_no, recorded_at, nullif(regexp_replace(lower(trim(hash)), '^sha-?256[:=]\s*', ''), '') AS hash FROM file_states),
l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY namespace, relative_path, run_no ORDER BY recorded_at DESC, hash DESC NULLS LAST) = 1),
p AS (SELECT DISTINCT namespace, relative_path FROM l),
g AS (SELECT p.namespace, p.relative_path, runs.run_no, CASE WHEN l.run_no IS NULL THEN '' ELSE l.hash END AS v FROM p JOIN runs ON runs.namespace = p.namespace AND runs.ok LEFT JOIN l ON l.namespace = p.namespace AND l.relative_path = p.relative_path AND l.run_no = runs.run_no),
m AS (SELECT namespace, relative_path, run_no, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY namespace, relative_path ORDER BY run_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS left_hash FROM g),
c AS (SELECT runs.namespace, runs.run_no, m.relative_path, left_hash, l.run_no IS NOT NULL AS there, l.hash
  FROM runs JOIN m ON m.namespace = runs.namespace AND m.run_no = runs.prev_ok LEFT JOIN l ON l.namespace = m.namespace AND l.relative_path = m.relative_path AND l.run_no = runs.run_no),
x AS (SELECT namespace, run_no, relative_path, CASE WHEN NOT there THEN 'removed' WHEN left_hash = '' THEN 'added' ELSE 'changed' END AS change
  FROM c WHERE (there AND hash IS NOT NULL AND hash <> left_hash) OR (NOT there AND left_hash <> ''))
"""


@query(_CHANGES + "SELECT namespace, run_no, relative_path FROM x")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return changes_by_run(table(spark, d, "file_states"), table(spark, d, "snapshots")).select("namespace", "run_no", "relative_path")


@query(_CHANGES + "SELECT namespace, run_no, change, count(*) AS n_files FROM x GROUP BY ALL")
def p6_kinds(spark: SparkSession, d: str) -> DataFrame:
    """How many files each run has to process, by kind of change."""
    return changes_by_run(table(spark, d, "file_states"), table(spark, d, "snapshots")).groupBy("namespace", "run_no", "change").count().withColumnRenamed("count", "n_files")


# Chunking and identities.

_LINES = r"SELECT doc_id, relative_path, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS l FROM documents WHERE text IS NOT NULL"
_WINDOWS = rf"""
WITH t AS ({_LINES}),
s AS (SELECT doc_id, relative_path, l, unnest(generate_series(0, greatest(0, ceil((len(l) - 5) / 4.0)::INT) * 4, 4)) AS s FROM t),
c AS (SELECT doc_id, relative_path, array_to_string(l[s + 1:s + 5], chr(10)) AS content, (s + 1)::INT AS start_line, least(s + 5, len(l))::INT AS end_line FROM s)
"""
_FILLED = r"regexp_replace(content, '[\s\p{Z}\x{85}\x{1C}-\x{1F}]+', '', 'g') <> ''"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "relative_path", "text")
    return chunking.line_chunks(docs, "text", max_lines=5, overlap=1)


@query(_WINDOWS + f"SELECT doc_id, start_line, end_line, md5(content) AS content_md5 FROM c WHERE {_FILLED}")
def line_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("doc_id", "start_line", "end_line", F.md5("chunk_content").alias("content_md5"))


@query(_WINDOWS + f"SELECT 'chunk_' || left(sha256(relative_path || ':' || start_line || ':' || end_line || ':' || content), 16) AS id FROM c WHERE {_FILLED}")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select(ids.chunk_id(F.col("relative_path"), F.col("start_line"), F.col("end_line"), F.col("chunk_content")).alias("id"))


_SPACE = r"[\s\p{Z}\x{85}\x{1C}-\x{1F}]+"


@query(rf"SELECT doc_id, 'sha256:' || sha256(trim(regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g'))) AS content_hash FROM documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", ids.content_hash(F.col("text")).alias("content_hash"))


@query(rf"SELECT content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, 'sha256:' || sha256(trim(regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g'))) AS content_hash FROM documents) GROUP BY 1")
def distinct_content(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(ids.content_hash(F.col("text")).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("""SELECT DISTINCT namespace, 'source_document_' || left(sha256('workspace' || chr(0) || namespace || chr(0) || 'document' || chr(0) || namespace), 16) AS source_ns,
  'code_chunks_' || left(md5('/srv/' || namespace), 8) AS code_ns, 'context_workspace_' || left(sha256(namespace), 16) AS scope_ns, 'doc_' || left(sha256(namespace || chr(0) || 'x'), 16) AS stable FROM chunks""")
def namespaces(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("namespace")
    return table(spark, d, "chunks").select("namespace").distinct().select(
        "namespace", ids.source_namespace(F.lit("workspace"), n, F.lit("document"), n).alias("source_ns"), ids.code_namespace(F.concat(F.lit("/srv/"), n)).alias("code_ns"),
        ids.scope_namespace(F.lit("workspace"), n).alias("scope_ns"), ids.stable_id(" ", n, F.lit("x")).alias("stable"),
    )


@query(r"""WITH r AS (SELECT namespace, relative_path, start_line, end_line, id, max(end_line) OVER (PARTITION BY namespace, relative_path ORDER BY start_line, end_line DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m
FROM chunks WHERE start_line > 0 AND end_line >= start_line) SELECT id FROM r WHERE m IS NULL OR end_line > m""")
def outer_ranges(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").select("namespace", "relative_path", "start_line", "end_line", F.col("id").alias("kind"))
    return chunking.keep_outer_ranges(rows, ["namespace", "relative_path"]).select(F.col("kind").alias("id"))


@query()
def syntax_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Declarations of the Go and C++ chunks, line windows of all others."""
    rows = wide(spark, d, "chunks").withColumn("language", text.language_of(F.col("file_extension")))
    return chunking.syntax_chunks(rows, "id", max_lines=20, overlap=4).select("id", "start_line", "end_line", F.col("metadata")["symbol_kind"].alias("symbol_kind"), F.col("metadata")["symbol_name"].alias("symbol_name"))


_HEADS = rf"""
WITH t AS ({_LINES}),
u AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS line, len(l) AS n FROM t),
f AS (SELECT *, trim(x, E' \t\r\f\x0b　 ') AS tx, sum(CASE WHEN regexp_matches(trim(x, E' \t　 '), '^(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS fences FROM u),
h AS (SELECT doc_id, line, n, tx FROM f WHERE fences % 2 = 0 AND regexp_matches(tx, '^#{{1,6}} .*\S'))"""


_SLUG = r"coalesce(nullif(regexp_replace(regexp_replace(translate(lower(trim({x})), '_ ', '--'), '[^\p{{L}}\p{{N}}\-]+', '', 'g'), '^-+|-+$', '', 'g'), ''), 'document')"
_KIND = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower({{x}}), '{w}')" for w in words.split()) + f" THEN '{kind}'" for kind, words in _SQL_KINDS) + " ELSE 'concept' END"


@query(_HEADS + rf""",
g AS (SELECT doc_id, line, n, length(regexp_extract(tx, '^(#+)', 1)) AS lv, trim(regexp_replace(tx, '^#+ ', '')) AS hd FROM h),
e AS (SELECT *, coalesce(lead(line) OVER (PARTITION BY doc_id ORDER BY line), n + 1) AS nx FROM g),
a AS (SELECT i.doc_id, i.line, list(j.hd ORDER BY j.lv) AS path FROM e i JOIN e j ON j.doc_id = i.doc_id AND j.line <= i.line AND j.lv <= i.lv
  WHERE NOT EXISTS (SELECT 1 FROM e m WHERE m.doc_id = i.doc_id AND m.line > j.line AND m.line <= i.line AND m.lv <= j.lv) GROUP BY 1, 2),
q AS (SELECT t.doc_id, len(l) AS n, min(e.line) AS fh FROM t LEFT JOIN e ON e.doc_id = t.doc_id WHERE {_FILLED.replace('content', "array_to_string(l, '')")} GROUP BY t.doc_id, l),
s AS (SELECT doc_id, line AS a, nx - 1 AS b, path FROM e JOIN a USING (doc_id, line) UNION ALL SELECT doc_id, 1, coalesce(fh - 1, n), [] FROM q WHERE fh IS NULL OR fh > 1),
v AS (SELECT s.doc_id, s.a, min(f.line) AS line FROM s JOIN f ON f.doc_id = s.doc_id AND f.line BETWEEN s.a + (len(path) > 0)::INT AND s.b AND f.tx <> '' GROUP BY 1, 2),
y AS (SELECT v.doc_id, v.a, v.line, CASE WHEN tx LIKE '>%' THEN trim(substr(tx, 2)) WHEN regexp_matches(lower(tx), '^(summary:|abstract:)') THEN trim(substr(tx, strpos(tx, ':') + 1)) WHEN regexp_matches(tx, '^摘要[：:]') THEN trim(substr(tx, 4)) END AS summary FROM v JOIN f ON f.doc_id = v.doc_id AND f.line = v.line),
o AS (SELECT doc_id, a, path, 'title' AS kind, a AS x, a AS z, 'concept' AS know FROM s WHERE len(path) > 0
  UNION ALL SELECT s.doc_id, s.a, path, 'summary', y.line, y.line, {_KIND.format(x="array_to_string(path, ' ') || ' ' || summary")} FROM s JOIN y ON y.doc_id = s.doc_id AND y.a = s.a WHERE summary IS NOT NULL
  UNION ALL SELECT s.doc_id, s.a, path, 'body', s.a, s.b, {_KIND.format(x="array_to_string(path, ' ') || ' ' || array_to_string(l[s.a:s.b], chr(10))")} FROM s JOIN t ON t.doc_id = s.doc_id)
SELECT o.doc_id, kind, {_SLUG.format(x=r"regexp_replace(regexp_extract(relative_path, '([^/]*)$', 1), '\.[^.]*$', '')")} AS document_id, CASE WHEN len(path) = 0 THEN 'root' ELSE array_to_string(list_transform(path, lambda p: {_SLUG.format(x='p')}), '/') END AS section_id,
  array_to_string(path, ' > ') AS heading, know AS knowledge_kind, x::INT AS start_line, z::INT AS end_line FROM o JOIN t ON t.doc_id = o.doc_id""")
def markdown_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes = markdown.parse_markdown(wide(spark, d, "documents").select("doc_id", "relative_path", F.col("text").alias("content")))
    return nodes.select("doc_id", "kind", "document_id", "section_id", F.array_join("heading_path", " > ").alias("heading"), "knowledge_kind", "start_line", "end_line")


@query()
def markdown_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Bodies windowed without cutting fences or tables."""
    nodes = markdown.parse_markdown(wide(spark, d, "documents").select("doc_id", "relative_path", F.col("text").alias("content")))
    return chunking.node_chunks(nodes, max_lines=6, overlap=1, extender=chunking.markdown_boundary).select("doc_id", "kind", "section_id", "start_line", "end_line", F.md5("content").alias("content_md5"))


@query(_HEADS + r"""
SELECT doc_id, line::INT AS line, length(regexp_extract(tx, '^(#+)', 1))::INT AS level, trim(regexp_replace(tx, '^#+ ', '')) AS heading, coalesce(lead(line) OVER (PARTITION BY doc_id ORDER BY line), n + 1)::INT AS next_line FROM h""")
def heading_lines(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.col("text").alias("content"))
    return markdown.heading_lines(docs, "doc_id").withColumnRenamed("path", "doc_id")


# Tokens and vectors.

_TOKENS = r"list_filter(list_transform(regexp_extract_all(regexp_replace(coalesce({x}, ''), '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g'), '[\p{{L}}\p{{Nd}}]+'), lambda x: lower(x)), lambda x: length(x) > 1)"
_EMBED = r"regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z0-9_一-龥]+')"


@query(f"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest({_TOKENS.format(x='text')}) AS token FROM documents) GROUP BY 1")
def keyword_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = wide(spark, d, "documents").select("doc_id", F.explode(text.keyword_tokens("text")).alias("token"))
    return rows.groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("c")).groupBy("token").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_docs"))


@query(f"SELECT doc_id, len({_EMBED}) AS n, md5(array_to_string(CASE WHEN len({_EMBED}) = 0 THEN [''] ELSE {_EMBED} END, ' ')) AS tokens_md5 FROM documents")
def embed_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = text.embed_tokens("text")
    return table(spark, d, "documents").select("doc_id", F.when(t[0] == "", 0).otherwise(F.size(t)).cast("bigint").alias("n"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


@query(f"""WITH t AS (SELECT doc_id, unnest(CASE WHEN len({_EMBED}) = 0 THEN [''] ELSE {_EMBED} END) AS t FROM documents),
h AS (SELECT doc_id, sha256(t) AS h FROM t)
SELECT doc_id, (('0x' || left(h, 8))::BIGINT % 256)::INT AS idx, sum(CASE WHEN ('0x' || substr(h, 9, 2))::INT % 2 = 0 THEN -1 ELSE 1 END)::BIGINT AS value FROM h GROUP BY 1, 2""")
def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    rows = wide(spark, d, "documents").select("doc_id", F.explode(vectors.sparse_embedding(F.col("text"), 256)).alias("p"))
    return rows.groupBy("doc_id", F.col("p.index").alias("idx")).agg(F.sum("p.value").cast("bigint").alias("value"))


@query(f"""WITH t AS (SELECT doc_id, unnest(CASE WHEN len({_EMBED}) = 0 THEN [''] ELSE {_EMBED} END) AS t FROM documents),
h AS (SELECT doc_id, sha256(t) AS h FROM t),
v AS (SELECT doc_id, (('0x' || left(h, 8))::BIGINT % 64)::INT AS idx, sum(CASE WHEN ('0x' || substr(h, 9, 2))::INT % 2 = 0 THEN -1 ELSE 1 END)::DOUBLE AS v FROM h GROUP BY 1, 2)
SELECT doc_id, idx, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 4) AS value FROM v WHERE v <> 0""")
def hash_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The vectors as they are stored: dense, of length 1."""
    rows = wide(spark, d, "documents").select("doc_id", F.posexplode(vectors.hash_embedding(F.col("text"), 64)).alias("idx", "value"))
    return rows.where("value <> 0").select("doc_id", "idx", F.round(F.col("value").cast("double"), 4).alias("value"))


_QV = "[" + ", ".join(f"{x}::DOUBLE" for x in VECTOR) + "]"
_GOOD = "len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0"
_COS = f"CASE WHEN {_GOOD} THEN list_cosine_similarity(vector::DOUBLE[], {_QV}) ELSE 0.0 END"
_TIE = "relative_path NULLS FIRST, start_line NULLS FIRST, end_line NULLS FIRST, id"


@query(f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_QV}), 6) AS similarity FROM embeddings ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], {_QV}), 12) DESC, vec_id LIMIT {TOP}")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", vectors.cosine_to(F.col("embedding"), VECTOR).alias("s"))
    return rows.orderBy(F.round("s", 12).desc(), "vec_id").limit(TOP).select("vec_id", F.round("s", 6).alias("similarity"))


# Keyword and hybrid search.


def _keyword_sql(profile: str, source: str = "chunks", where: str = "true") -> str:
    """CTEs rows, cos and kw: candidates, their cosine and unsaturated BM25 by namespace."""
    words = _SQL_WEIGHTS[profile].split()
    w = dict(zip(words[::2], map(float, words[1::2])))
    base = " UNION ALL ".join(f"SELECT id, {c} AS t, {w[c]} AS w FROM rows" for c in ("content", "relative_path", "file_extension", "language") if w[c] > 0)
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in w.items() if k not in ("content", "relative_path", "file_extension", "language", "other"))
    weight = f"CASE e.key {cases} ELSE {w['other']} END" if cases else str(w["other"])
    wanted = ", ".join(f"'{t}'" for t in TOKENS)
    return f"""rows AS (SELECT * FROM {source} WHERE {where}),
f AS ({base} UNION ALL SELECT id, e.value AS t, {weight} AS w FROM (SELECT id, unnest(map_entries(metadata)) AS e FROM rows WHERE metadata IS NOT NULL)),
tok AS (SELECT id, w, unnest({_TOKENS.format(x='t')}) AS token FROM f),
len AS (SELECT id, sum(w) AS dl FROM tok GROUP BY id),
st AS (SELECT namespace, count(*) AS n, avg(coalesce(dl, 0)) AS al FROM rows LEFT JOIN len USING (id) GROUP BY namespace),
tf AS (SELECT id, token, sum(w) AS tf FROM tok WHERE token IN ({wanted}) GROUP BY 1, 2),
df AS (SELECT namespace, token, count(*) AS df FROM tf JOIN rows USING (id) GROUP BY 1, 2),
kw AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / al))) AS raw FROM tf JOIN rows USING (id) JOIN len USING (id) JOIN df USING (namespace, token) JOIN st USING (namespace) GROUP BY id),
scored AS (SELECT r.*, {_COS} AS sem, CASE WHEN raw > 0 THEN raw / (raw + 1) ELSE 0.0 END AS key FROM rows r LEFT JOIN kw USING (id))"""


def _options(profile: str, fusion: str = "linear", **more) -> search.SearchOptions:
    s, k = scoring.STRATEGIES[profile]
    return search.SearchOptions(query=QUERY, profile=profile, semantic=s, keyword=k, fusion=fusion, limit=TOP, **more)


def _out(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.round("semantic_score", 6).alias("semantic"), F.round("keyword_score", 6).alias("keyword"), F.round("score", 6).alias("score"))


def _fused_sql(profile: str, fusion: str, where: str = "true") -> str:
    s, k = _SQL_STRATEGIES[profile]
    if fusion == "rrf":
        ranks = f"""row_number() OVER (PARTITION BY namespace ORDER BY round(sem, 12) DESC, {_TIE}) AS rs, CASE WHEN key > 0 THEN row_number() OVER (PARTITION BY namespace ORDER BY (key > 0) DESC, round(key, 12) DESC, {_TIE}) END AS rk"""
        return f"WITH {_keyword_sql(profile, where=where)}, r AS (SELECT *, {ranks} FROM scored), z AS (SELECT *, {s} / (60 + rs) + coalesce({k} / (60 + rk), 0) AS score FROM r)"
    return f"WITH {_keyword_sql(profile, where=where)}, z AS (SELECT *, sem * {s} + key * {k} AS score FROM scored)"


_TOP_SQL = f" SELECT id, round(sem, 6) AS semantic, round(key, 6) AS keyword, round(score, 6) AS score FROM z ORDER BY round(score, 12) DESC, {_TIE} LIMIT {TOP}"


def _profile_query(profile: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = scoring.bm25(scoring.term_weights(wide(spark, d, "chunks").drop("vector"), TOKENS, profile), TOKENS, ["namespace"])
        return rows.select("id", F.round("keyword_score", 6).alias("keyword")).where("keyword > 0")

    QUERIES[f"bm25_{profile}"] = run
    ORACLES[f"bm25_{profile}"] = f"WITH {_keyword_sql(profile)} SELECT id, round(key, 6) AS keyword FROM scored WHERE round(key, 6) > 0"


for _p in scoring.FIELD_WEIGHTS:
    _profile_query(_p)


@query(_fused_sql("conversation", "linear") + _TOP_SQL)
def fuse_linear(spark: SparkSession, d: str) -> DataFrame:
    return _out(search.top(search.score(wide(spark, d, "chunks"), VECTOR, _options("conversation")), TOP))


@query(_fused_sql("code", "rrf") + _TOP_SQL)
def fuse_rrf(spark: SparkSession, d: str) -> DataFrame:
    return _out(search.top(search.score(wide(spark, d, "chunks"), VECTOR, _options("code", "rrf")), TOP))


_FILTER = "file_extension IN ('.go', '.py') AND coalesce(metadata['domain_path'], '') IN (" + ", ".join(f"'{x}'" for x in DOMAINS) + ")"


@query(_fused_sql("knowledge", "linear", _FILTER) + _TOP_SQL)
def filtered_search(spark: SparkSession, d: str) -> DataFrame:
    """Statistics are those of the rows that pass the filters."""
    options = _options("knowledge", extensions=(".go", ".py"), filters={"domain_path": DOMAINS})
    return _out(search.top(search.score(wide(spark, d, "chunks"), VECTOR, options), TOP))


@query(_fused_sql("fact", "linear") + f" SELECT namespace, id, rn::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY round(score, 12) DESC, {_TIE}) AS rn FROM z) WHERE rn <= 6")
def namespace_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = search.score(wide(spark, d, "chunks"), VECTOR, _options("fact"))
    w = Window.partitionBy("namespace").orderBy(F.round("score", 12).desc(), *search.TIEBREAK)
    return rows.withColumn("rank", F.row_number().over(w)).where("rank <= 6").select("namespace", "id", "rank")


def _rerank_sql() -> str:
    s, k = _SQL_STRATEGIES["default"]
    pick = f"(SELECT id, 'all' AS namespace, vector, content, relative_path, start_line, end_line, file_extension, language, metadata FROM chunks ORDER BY round({_COS}, 12) DESC, {_TIE} LIMIT {3 * TOP})"
    return f"WITH {_keyword_sql('default', source=pick)}, z AS (SELECT *, sem * {s} + key * {k} AS score FROM scored)" + _TOP_SQL


@query(_rerank_sql())
def rerank_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Two phases: the most similar candidates, then keyword statistics over them alone."""
    chunks = wide(spark, d, "chunks").withColumn("namespace", F.lit("all"))
    return _out(search.remote_search(chunks, "all", VECTOR, _options("default")))


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    names = wide(spark, d, "chunks").select("namespace").distinct().where("namespace like 'source%'")
    return names.select("namespace", F.regexp_extract("namespace", "^source_(.+)_[0-9a-f]+$", 1).alias("source_type"), F.col("namespace").alias("source_id"), F.lit("indexed").alias("status"), F.col("namespace").alias("key"))


def _merged_sql() -> str:
    parts = []
    types = "SELECT namespace, source_type, row_number() OVER (ORDER BY namespace) AS ord FROM (SELECT DISTINCT namespace, regexp_extract(namespace, '^source_(.+)_[0-9a-f]+$', 1) AS source_type FROM chunks WHERE namespace LIKE 'source%')"
    for t, profile in _SQL_PROFILE_OF.items():
        s, k = _SQL_STRATEGIES[profile]
        inner = f"WITH {_keyword_sql(profile, where=f'''namespace IN (SELECT namespace FROM types WHERE source_type = '{t}')''')} SELECT id, namespace, relative_path, start_line, end_line, sem * {s} + key * {k} AS score FROM scored"
        parts.append(f"SELECT '{t}' AS source_type, * FROM ({inner})")
    union = " UNION ALL ".join(parts)
    return f"""WITH types AS ({types}), h AS ({union}),
r AS (SELECT h.*, ord, row_number() OVER (PARTITION BY namespace ORDER BY round(score, 12) DESC, {_TIE}) AS nr FROM h JOIN types USING (namespace, source_type) QUALIFY nr <= {3 * TOP})
SELECT id, source_type, round(score, 6) AS score FROM r ORDER BY round(score, 12) DESC, ord, nr LIMIT {TOP}"""


@query(_merged_sql())
def merged_search(spark: SparkSession, d: str) -> DataFrame:
    """All sources but code: each by its own strategy, merged by score."""
    hits = search.search_all(wide(spark, d, "chunks"), _catalog(spark, d), QUERY, VECTOR, limit=TOP, types="doc")
    return hits.select("id", "source_type", F.round("score", 6).alias("score"))


_CODE_NAMESPACE = "min(namespace) FILTER (namespace NOT LIKE 'source%')"


def _mixed_sql() -> str:
    s, k = _SQL_STRATEGIES["code"]
    code = f"""SELECT *, {s} / (60 + row_number() OVER (ORDER BY round(sem, 12) DESC, {_TIE})) + CASE WHEN key > 0 THEN {k} / (60 + row_number() OVER (ORDER BY (key > 0) DESC, round(key, 12) DESC, {_TIE})) ELSE 0 END AS score FROM scored"""
    code = f"WITH {_keyword_sql('code', where=f'namespace = (SELECT {_CODE_NAMESPACE} FROM chunks)')} SELECT id, namespace, relative_path, start_line, end_line, score FROM ({code})"
    whole = _merged_sql().replace("AS (SELECT h.*, ord,", f"AS (SELECT h.*, coalesce(ord, 0) AS ord,").replace("FROM h JOIN types", f"FROM (SELECT * FROM h UNION ALL SELECT 'codebase', * FROM ({code})) h LEFT JOIN types")
    return whole.replace(f"QUALIFY nr <= {3 * TOP}", "").replace(f"LIMIT {TOP}", "")


@query(_mixed_sql())
def mixed_search(spark: SparkSession, d: str) -> DataFrame:
    """Code by reciprocal ranks beside all other sources by weighted sums, merged by score alone; without a limit, every row."""
    chunks = wide(spark, d, "chunks")
    code = table(spark, d, "chunks").where("namespace not like 'source%'").agg(F.min("namespace")).first()[0]
    hits = search.search_all(chunks, _catalog(spark, d), QUERY, VECTOR, limit=0, types="all", code_namespace=code)
    return hits.select("id", "source_type", F.round("score", 6).alias("score"))


# Sessions, indexing, imports.


@query(rf"""WITH RECURSIVE h AS (SELECT search_id AS s, rank, namespace || chr(0) || result_id AS k, 'sha256:' || sha256(trim(regexp_replace(coalesce(content, ''), '{_SPACE}', ' ', 'g'))) AS c FROM ranked_hits),
o AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY rank, k, c) AS i FROM h),
f AS (SELECT s, 0::BIGINT AS i, 0 AS rank, list(k) FILTER (rank = 1) AS ks, list(c) FILTER (rank = 1) AS cs, 0 AS n, 0 AS dropped, false AS hit FROM o GROUP BY s
  UNION ALL SELECT s, i, rank, CASE WHEN hit THEN list_append(ks, k) ELSE ks END, CASE WHEN hit THEN list_append(cs, c) ELSE cs END, n + hit::INT, dropped + old::INT, hit FROM (
    SELECT s, o.i, o.rank, k, c, coalesce(ks, []) AS ks, coalesce(cs, []) AS cs, n, dropped, old, NOT old AND n < 5 AS hit FROM (
      SELECT f.s, o.i, o.rank, o.k, o.c, f.ks, f.cs, f.n, f.dropped, list_contains(coalesce(f.ks, []), o.k) OR list_contains(coalesce(f.cs, []), o.c) AS old FROM f JOIN o ON o.s = f.s AND o.i = f.i + 1) o))
SELECT s AS session_id, rank, n AS new_rank, (max(dropped) OVER (PARTITION BY s))::INT AS deduped_count FROM f QUALIFY hit""")
def session_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Each search of the recorded hits as a response of a session that has seen rank 1 before."""
    hits = table(spark, d, "ranked_hits").select(F.col("search_id").alias("session_id"), "rank", ids.result_key(F.col("namespace"), F.col("result_id")).alias("result_key"), ids.content_hash(F.col("content")).alias("content_hash"))
    seen = sessions.remember(hits.where("rank = 1"))
    return sessions.dedup_sessions(hits, seen, 5).select("session_id", "rank", "new_rank", "deduped_count")


@query(rf"""WITH h AS (SELECT DISTINCT search_id AS session_id, rank, namespace || chr(0) || result_id AS k, 'sha256:' || sha256(trim(regexp_replace(coalesce(content, ''), '{_SPACE}', ' ', 'g'))) AS c FROM ranked_hits),
s AS (SELECT * FROM h WHERE rank = 1),
f AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.session_id = h.session_id AND (s.k = h.k OR s.c = h.c))),
u AS (SELECT session_id, c, min(rank) AS rank FROM f GROUP BY 1, 2)
SELECT session_id, rank, row_number() OVER (PARTITION BY session_id ORDER BY rank)::INT AS new_rank FROM u QUALIFY new_rank <= 5""")
def session_dedup_sets(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "ranked_hits").select(F.col("search_id").alias("session_id"), "rank", ids.result_key(F.col("namespace"), F.col("result_id")).alias("result_key"), ids.content_hash(F.col("content")).alias("content_hash")).distinct()
    return sessions.dedup_sets(hits, sessions.remember(hits.where("rank = 1")), 5).select("session_id", "rank", "new_rank")


_STATES = r"(SELECT namespace || '/' || relative_path AS relative_path, run_no, arg_max(struct_pack(hash, size, mod_time_ns), recorded_at::VARCHAR || coalesce(hash, '') || size || mod_time_ns) AS s FROM file_states GROUP BY 1, 2)"


def _replaced(spark: SparkSession, d: str, states: DataFrame) -> DataFrame:
    paths = states.select("namespace", "relative_path").distinct()
    new = paths.select(ids.chunk_id(F.col("relative_path"), F.lit(1), F.lit(1), F.col("namespace")).alias("id"), "namespace", "relative_path", F.lit("new").alias("origin")).distinct()
    old = table(spark, d, "chunks").select("id", "namespace", "relative_path", F.lit("old").alias("origin"))
    return indexing.replace_files(old, paths, new, ["namespace", "relative_path"]).select("id", "origin")


_RUN_CHANGES = f"""WITH n AS (SELECT run_no, lead(run_no) OVER (ORDER BY run_no) AS next FROM (SELECT DISTINCT run_no FROM file_states WHERE run_no IS NOT NULL)),
p AS (SELECT relative_path, next AS run_no, s FROM {_STATES} JOIN n USING (run_no) WHERE next IS NOT NULL), c AS (SELECT relative_path, run_no, s FROM {_STATES} WHERE run_no > (SELECT min(run_no) FROM n)),
x AS (SELECT coalesce(p.run_no, c.run_no) AS run_no, coalesce(p.relative_path, c.relative_path) AS relative_path, CASE WHEN p.s IS NULL THEN 'added' WHEN c.s IS NULL THEN 'removed' WHEN c.s.size = p.s.size AND c.s.mod_time_ns = p.s.mod_time_ns THEN 'unchanged' WHEN c.s.hash = p.s.hash THEN 'touched' ELSE 'modified' END AS change
FROM p FULL JOIN c ON p.relative_path = c.relative_path AND p.run_no = c.run_no)"""


def _run_changes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "file_states").where("run_no is not null")
    order = F.concat(F.date_format("recorded_at", "yyyy-MM-dd HH:mm:ss"), F.coalesce("hash", F.lit("")), F.col("size").cast("string"), F.col("mod_time_ns").cast("string"))
    last = rows.groupBy("run_no", F.concat_ws("/", "namespace", "relative_path").alias("relative_path")).agg(F.max_by(F.struct("hash", "size", "mod_time_ns"), order).alias("s"))
    last = last.select("run_no", "relative_path", "s.hash", "s.size", "s.mod_time_ns")
    runs = rows.select("run_no").distinct().withColumn("next", F.lead("run_no").over(Window.orderBy("run_no"))).where("next is not null")  # one row a run
    before = last.join(runs, "run_no").drop("run_no").withColumnRenamed("next", "run_no")
    return indexing.diff_files(before, last.join(runs.select(F.col("next").alias("run_no")), "run_no"), ["run_no", "relative_path"])


@query(_RUN_CHANGES + " SELECT run_no, relative_path, change FROM x")
def file_diff(spark: SparkSession, d: str) -> DataFrame:
    """Every run against the one before it."""
    return _run_changes(spark, d).select("run_no", "relative_path", "change")


@query(_RUN_CHANGES + """ SELECT run_no, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'modified') AS modified, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'touched') AS touched, count(*) FILTER (change = 'unchanged') AS unchanged, count(*) FILTER (change <> 'removed') AS files FROM x GROUP BY run_no""")
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    return indexing.stats(_run_changes(spark, d), ("run_no",))


@query("""WITH p AS (SELECT DISTINCT namespace, relative_path FROM file_states)
SELECT id, 'old' AS origin FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.namespace = c.namespace AND p.relative_path = c.relative_path)
UNION ALL SELECT DISTINCT 'chunk_' || left(sha256(relative_path || ':1:1:' || namespace), 16), 'new' FROM p""")
def replace_files(spark: SparkSession, d: str) -> DataFrame:
    """The table after all runs: a file's new chunk has the same id in each, so one replacement by the paths of all is the same."""
    return _replaced(spark, d, table(spark, d, "file_states"))


_HELD = r"regexp_replace({x}, '[\s\p{{Z}}\x{{85}}\x{{1C}}-\x{{1F}}]+', '', 'g') <> ''"
_MEMORY = rf"""
WITH r AS (SELECT *, CASE WHEN {_HELD.format(x="coalesce(experience_kind, '')")} THEN experience_kind ELSE 'general' END AS kind FROM memory_records WHERE content IS NOT NULL AND {_HELD.format(x='content')}),
own AS (SELECT row_number() OVER () AS n, metadata, [
  struct_pack(k := 'record_id', v := id), struct_pack(k := 'summary', v := summary), struct_pack(k := 'role', v := role), struct_pack(k := 'conversation_id', v := conversation_id), struct_pack(k := 'message_id', v := message_id),
  struct_pack(k := 'tool_name', v := tool_name), struct_pack(k := 'created_at', v := created_at), struct_pack(k := 'updated_at', v := updated_at), struct_pack(k := 'tags', v := array_to_string(tags, ',')), struct_pack(k := 'domain_path', v := domain_path), struct_pack(k := 'experience_kind', v := kind),
  struct_pack(k := 'importance', v := CASE WHEN importance > 0 THEN regexp_replace(importance::VARCHAR, '\.0$', '') END)] AS es FROM r),
m AS (SELECT n, e.k, e.v FROM (SELECT n, unnest(es) AS e FROM own) WHERE e.v IS NOT NULL AND {_HELD.format(x='e.v')}),
b AS (SELECT n, e.key AS k, e.value AS v FROM (SELECT n, unnest(map_entries(metadata)) AS e FROM own WHERE metadata IS NOT NULL)),
z AS (SELECT k, v FROM m UNION ALL SELECT k, v FROM b WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.n = b.n AND m.k = b.k)
  UNION ALL SELECT unnest(['absolute_path', 'source_type', 'source_id']), unnest(['/srv/m.jsonl', 'experience', 'memory']) FROM own)
SELECT k AS key, count(*) AS n, count(DISTINCT v) AS n_values, min(v) AS least, max(v) AS greatest FROM z GROUP BY 1"""


@query(_MEMORY)
def memory_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Every entry that imported records carry."""
    rows = wide(spark, d, "memory_records").where(F.coalesce(text.trim_space("content") != "", F.lit(False)))
    bag = indexing.memory_metadata(F.lit("experience"), F.lit("memory"), F.lit("/srv/m.jsonl"), F.lit(None).cast("map<string,string>"))
    entries = rows.select(F.explode(bag).alias("key", "value"))
    return entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("n_values"), F.min("value").alias("least"), F.max("value").alias("greatest"))


@query(rf"""SELECT 'memory_' || left(sha256('source_experience_x' || chr(0) || 'experience' || chr(0) || 'memory' || chr(0) || id), 16) AS id, count(*) AS n FROM memory_records WHERE content IS NOT NULL AND {_HELD.format(x='content')} AND coalesce(id, '') <> '' GROUP BY 1""")
def memory_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "memory_records").where("coalesce(id, '') <> ''")
    return indexing.memory_rows(rows, F.lit("source_experience_x"), "experience", "memory", "/srv/m.jsonl", dim=8).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query()
def memory_import(spark: SparkSession, d: str) -> DataFrame:
    rows = indexing.memory_rows(wide(spark, d, "memory_records"), F.lit("source_conversation_x"), "conversation", "memory", "/srv/m.jsonl", dim=32)
    return rows.select("id", "relative_path", "start_line", F.size("vector").alias("dim"), F.col("metadata")["domain_path"].alias("domain_path"), F.col("metadata")["experience_kind"].alias("experience_kind"))


@query("""WITH e AS (SELECT 'workspace' || chr(0) || coalesce(source_id, '') || chr(0) || coalesce(source_type, '') || chr(0) || coalesce(source_id, '') AS key, source_id, count(*) AS n, max(search_id) AS version FROM ranked_hits GROUP BY ALL)
SELECT key, 'indexed' AS status, CASE WHEN max(version) % 3 = 0 THEN -1 ELSE sum(n)::BIGINT END AS n_rows, max(version) AS version FROM e GROUP BY key""")
def catalog_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Sources of the recorded hits, two thirds of them entered anew: the later entry of a key wins, the others stay."""
    hits = table(spark, d, "ranked_hits").groupBy("source_type", "source_id").agg(F.count(F.lit(1)).alias("n_rows"), F.max("search_id").alias("version"))
    rows = hits.select(
        F.struct(F.lit("workspace").alias("scope_type"), F.col("source_id").alias("scope_id")).alias("scope"), F.struct("source_type", "source_id", F.lit("").alias("tool_name"), F.lit(None).cast("map<string,string>").alias("metadata")).alias("source"),
        F.lit("").alias("status"), F.lit(None).cast("timestamp").alias("indexed_at"), "n_rows", "version",
    )
    entries = Catalog.entries(rows)
    stale = entries.withColumn("n_rows", F.lit(-1).cast("bigint"))
    return indexing.upsert(stale, entries.where("version % 3 <> 0"), ["key"]).select("key", "status", "n_rows", "version")


@query(r"""SELECT namespace, count(*) AS n_rows, 'sha256:' || sha256(string_agg(id || chr(0) || coalesce(relative_path, '') || chr(0) || coalesce(content, '') || chr(0), '' ORDER BY id)) AS checksum FROM chunks GROUP BY 1""")
def source_manifest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks")
    counts = indexing.source_checksum(rows, ["namespace"]).select("namespace", "n_rows")
    return indexing.ordered_checksum(rows, ["namespace"], ["id"]).join(counts, "namespace").select("namespace", "n_rows", "checksum")


# Domains and kinds.


def _contains(x: str, words: list[str]) -> str:
    return " + ".join(f"CASE WHEN contains({x}, '{w}') THEN 1 ELSE 0 END" for w in words)


def _rule_sql(source: str) -> str:
    cols = [f"struct_pack(d := '{dom}', s := ({_contains('t', words)}) + {'CASE WHEN ext IN (' + ', '.join(repr(e) for e in exts) + ') THEN 1.5 ELSE 0 END' if exts else '0'})" for dom, words, exts in ((a, b.split(", "), [e for e in c.strip().split(", ") if e]) for a, b, c in re.findall(r"(.+?): (.+?);(.*)", _SQL_RULES))]
    return f"""s AS (SELECT id, unnest([{', '.join(cols)}]) AS x FROM {source}),
b AS (SELECT id, x.d AS d, least(x.s / 4.0, 1) AS c FROM s WHERE x.s > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY x.s DESC, x.d) = 1)"""


_DOC_TEXT = r"d AS (SELECT doc_id AS id, lower(regexp_replace(coalesce(text, ''), '^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$', '', 'g')) AS t, '' AS ext FROM documents)"


@query(f"WITH {_DOC_TEXT}, {_rule_sql('d')} SELECT d.id AS doc_id, CASE WHEN c >= 0.35 THEN b.d ELSE '' END AS domain, round(CASE WHEN c >= 0.35 THEN c ELSE 0 END::DOUBLE, 6) AS confidence, CASE WHEN c >= 0.75 THEN 65 WHEN c >= 0.35 THEN 50 ELSE 0 END AS domain_percent FROM d LEFT JOIN b ON b.id = d.id")
def domain_classify(spark: SparkSession, d: str) -> DataFrame:
    rows = wide(spark, d, "documents").select("doc_id", domain.classify(domain.input_text(F.col("text"))).alias("r"))
    return rows.select("doc_id", "r.domain", F.round("r.confidence", 6).alias("confidence"), "r.budget.domain_percent")


_CHUNK_TEXT = r"""d AS (SELECT id, lower(regexp_replace(coalesce(content, '') || '  ' || coalesce(array_to_string(flatten(list_transform(list_sort(map_entries(metadata)), lambda e: [e.key, coalesce(e.value, '')])), ' '), ''), '^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$', '', 'g')) AS t,
  lower(trim(coalesce(file_extension, ''))) AS ext, list_filter(list_transform(string_split(lower(coalesce(metadata['domain_path'], '')), '/'), lambda p: replace(trim(p), ' ', '-')), lambda p: p <> '') AS lv FROM chunks)"""
_EXPLICIT_D = "CASE WHEN ext = '.go' THEN 'programming/go' WHEN ext = '.sql' THEN 'database/sql' WHEN ext IN ('.ts', '.tsx', '.js', '.jsx') THEN 'programming/frontend' END"
_PROFILE_SQL = " UNION ALL ".join(f"SELECT id, '{dom}' AS d, least(({_contains('t', terms)}) / 3.0, 1) * 0.35 AS s FROM d" for dom, terms in ((line.split(": ", 1)[0], [x.lower() for x in line.split(": ", 1)[1].split("; ")]) for line in _SQL_PROFILES.split("\n")))


@query(f"""WITH {_CHUNK_TEXT}, {_rule_sql('d')},
e AS (SELECT id, array_to_string(lv, '/') AS d, 0.35 AS s FROM d WHERE len(lv) BETWEEN 1 AND 2 UNION ALL SELECT id, {_EXPLICIT_D}, CASE WHEN ext IN ('.go', '.sql') THEN 0.8 ELSE 0.65 END * 0.35 FROM d WHERE {_EXPLICIT_D} IS NOT NULL
  UNION ALL {_PROFILE_SQL} UNION ALL SELECT id, d, c * 0.1 FROM b WHERE c >= 0.35),
g AS (SELECT id, d, round(sum(s)::DOUBLE, 12) AS s FROM e WHERE s > 0 GROUP BY 1, 2), w AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, d) = 1)
SELECT d.id, CASE WHEN s >= 0.35 THEN w.d ELSE '' END AS domain, CASE WHEN s >= 0.35 AND contains(w.d, '/') THEN split_part(w.d, '/', 1) ELSE '' END AS parent_domain, round(CASE WHEN s >= 0.35 THEN least(s, 1) ELSE 0 END, 6) AS confidence FROM d LEFT JOIN w ON w.id = d.id""")
def domain_resolve(spark: SparkSession, d: str) -> DataFrame:
    rows = wide(spark, d, "chunks").select("id", domain.resolve(F.col("content"), metadata=F.col("metadata"), extension=F.col("file_extension")).alias("r"))
    return rows.select("id", "r.domain", "r.parent_domain", F.round("r.confidence", 6).alias("confidence"))


@query("""SELECT namespace, d AS domain, round(count(*) / total::DOUBLE, 6) AS share FROM (SELECT namespace, coalesce(metadata['domain_path'], '') AS d, count(*) OVER (PARTITION BY namespace) AS total FROM chunks) WHERE d <> '' GROUP BY namespace, d, total""")
def domain_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Shares of each namespace's domains, blanks counting in the denominator: counted before anything is gathered."""
    rows = table(spark, d, "chunks").groupBy("namespace", text.meta("metadata", "domain_path").alias("domain")).agg(F.count(F.lit(1)).alias("n"))
    total = rows.groupBy("namespace").agg(F.sum("n").alias("total"))
    return rows.join(total, "namespace").where("domain <> ''").select("namespace", "domain", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("""WITH h AS (SELECT search_id, coalesce(domain_path, '') AS d, count(*) OVER (PARTITION BY search_id) AS n FROM ranked_hits)
SELECT search_id, d AS domain, round(count(*) / max(n)::DOUBLE, 6) AS share FROM h WHERE d <> '' GROUP BY 1, 2""")
def domain_memories(spark: SparkSession, d: str) -> DataFrame:
    """The signal of each search's memories: a response is a bounded list."""
    hits = table(spark, d, "ranked_hits").groupBy("search_id").agg(F.collect_list(F.coalesce("domain_path", F.lit(""))).alias("ds"))
    return hits.select("search_id", F.inline(domain.memory_signal(F.col("ds")))).select("search_id", "domain", F.round("score", 6).alias("share"))


@query("SELECT doc_id, CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(coalesce(text, '')), '{w}')" for w in words.split()) + f" THEN '{kind}'" for kind, words in _SQL_KINDS) + " ELSE 'concept' END AS kind FROM documents")
def knowledge_kind(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.knowledge_kind("text").alias("kind"))


@query(r"""SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(translate(lower(trim(regexp_extract(regexp_replace(relative_path, '\.[^./]*$', ''), '([^/]*)$', 1))), '_ ', '--'), '[^\p{L}\p{N}\-]+', '', 'g'), '^-+|-+$', '', 'g'), ''), 'document') AS document_id,
  round(length(coalesce(text, '')), 0)::BIGINT AS characters, ((length(regexp_replace(coalesce(text, ''), '^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$', '', 'g')) + 3) // 4)::BIGINT AS tokens FROM documents""")
def document_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.document_id("relative_path").alias("document_id"), text.characters("text").cast("bigint").alias("characters"), text.estimated_tokens("text").cast("bigint").alias("tokens"))


# Evaluation: search n of the recorded hits answers case n.

_CASES = r"""
WITH c AS (SELECT id AS case_id, CASE WHEN len(expected) > 0 THEN expected ELSE list_transform(CASE WHEN len(oracle_files) > 0 THEN list_filter(list_transform(oracle_files, lambda p: regexp_replace(trim(p), '^/', '')), lambda p: p <> '')
  ELSE list_distinct(list_transform(regexp_extract_all(coalesce(patch, ''), '(?m)^--- a/(.+)$', 1), lambda p: regexp_replace(trim(p), '^/', ''))) END, lambda p: struct_pack(relative_path := p, start_line := NULL::INT, end_line := NULL::INT, content_contains := NULL::VARCHAR)) END AS xs FROM eval_cases),
x AS (SELECT case_id, unnest(xs) AS e, generate_subscripts(xs, 1) AS no FROM c WHERE xs IS NOT NULL),
r AS (SELECT DISTINCT ON (search_id, rank) 'case-' || CASE WHEN search_id < 10000 THEN lpad(search_id::VARCHAR, 4, '0') ELSE search_id::VARCHAR END AS case_id, rank, content, location.relative_path AS p, location.start_line AS s, location.end_line AS t FROM ranked_hits ORDER BY search_id, rank, result_id),
m AS (SELECT r.case_id, r.rank, x.no, min(r.rank) OVER (PARTITION BY r.case_id, x.no) AS first FROM r JOIN x ON r.case_id = x.case_id
  WHERE (coalesce(e.relative_path, '') = '' OR regexp_replace(trim(e.relative_path), '^/', '') = regexp_replace(trim(coalesce(p, '')), '^/', ''))
  AND (coalesce(nullif(e.start_line, 0), e.end_line, 0) <= 0 OR (coalesce(s, 0) > 0 AND coalesce(nullif(e.start_line, 0), e.end_line) <= coalesce(nullif(t, 0), s) AND s <= coalesce(nullif(e.end_line, 0), e.start_line)))
  AND (coalesce(e.content_contains, '') = '' OR coalesce(contains(content, e.content_contains), false))),
h AS (SELECT case_id, count(DISTINCT rank) AS mr, count(DISTINCT no) AS me, min(rank) AS fr FROM m GROUP BY 1),
g AS (SELECT case_id, sum(1 / log2(rank + 1)) AS dcg FROM (SELECT DISTINCT case_id, rank FROM m WHERE rank = first) GROUP BY 1),
n AS (SELECT case_id, count(*) AS rc, sum(length(coalesce(content, ''))) AS chars, list_distinct(list(regexp_replace(trim(p), '^/', '')) FILTER (coalesce(p, '') <> '')) AS files FROM r GROUP BY 1),
k AS (SELECT case_id, count(*) AS ec, list_distinct(list(regexp_replace(trim(e.relative_path), '^/', '')) FILTER (coalesce(e.relative_path, '') <> '')) AS oracle FROM x GROUP BY 1),
v AS (SELECT k.case_id, ec, coalesce(me, 0) AS me, coalesce(mr, 0) AS mr, coalesce(rc, 0) AS rc, coalesce(fr, 0) AS fr, coalesce(dcg, 0) AS dcg, coalesce(chars, 0) AS chars, coalesce(files, []) AS files, coalesce(oracle, []) AS oracle FROM k LEFT JOIN n USING (case_id) LEFT JOIN h USING (case_id) LEFT JOIN g USING (case_id)),
z AS (SELECT *, CASE WHEN rc > 0 THEN mr / rc::DOUBLE ELSE 0 END AS pr, me / ec::DOUBLE AS re, CASE WHEN fr > 0 THEN 1.0 / fr ELSE 0 END AS rr, CASE WHEN least(ec, rc) > 0 THEN dcg / list_sum(list_transform(generate_series(1, least(ec, rc)), lambda i: 1 / log2(i + 1))) ELSE 0 END AS nd,
  CASE WHEN len(files) > 0 THEN len(list_intersect(files, oracle)) / len(files)::DOUBLE ELSE 0 END AS fp, CASE WHEN len(oracle) > 0 THEN len(list_intersect(files, oracle)) / len(oracle)::DOUBLE ELSE 0 END AS fre FROM v)
"""


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("search_id", "rank").orderBy("result_id")
    hits = table(spark, d, "ranked_hits").withColumn("_n", F.row_number().over(w)).where("_n = 1")
    number = F.col("search_id").cast("string")
    results = hits.withColumn("case_id", F.concat(F.lit("case-"), F.lpad(number, F.greatest(F.length(number), F.lit(4)), F.lit("0"))))
    return evaluation.evaluate(results, evaluation.expectations(table(spark, d, "eval_cases")))


@query(_CASES + "SELECT case_id, ec AS expected_count, me AS matched_expected, mr AS matched_results, rc AS result_count, fr::INT AS first_hit_rank, round(pr, 6) AS prec, round(re, 6) AS recall, round(rr, 6) AS mrr, round(nd, 6) AS ndcg, chars::BIGINT AS characters FROM z")
def recall_eval_cases(spark: SparkSession, d: str) -> DataFrame:
    r = lambda c, name=None: F.round(c, 6).alias(name or c)
    return _evaluated(spark, d).select("case_id", "expected_count", "matched_expected", "matched_results", "result_count", "first_hit_rank", r("precision", "prec"), r("recall"), r("mrr"), r("ndcg"), F.col("result_characters").alias("characters"))


@query(_CASES + "SELECT case_id, round(fp, 6) AS file_precision, round(fre, 6) AS file_recall, round(CASE WHEN fp + fre > 0 THEN 2 * fp * fre / (fp + fre) ELSE 0 END, 6) AS file_f1 FROM z")
def file_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _evaluated(spark, d).select("case_id", *(F.round(c, 6).alias(c) for c in ("file_precision", "file_recall", "file_f1")))


@query(_CASES + """SELECT count(*) AS case_count, count(*) FILTER (fr > 0) AS passed_count, count(*) FILTER (fr = 0) AS failed_count, round(avg(CASE WHEN fr > 0 THEN 1 ELSE 0 END), 6) AS hit_rate, round(avg(pr), 6) AS mean_precision, round(avg(re), 6) AS mean_recall,
  round(avg(rr), 6) AS mrr, round(avg(nd), 6) AS mean_ndcg, count(*) FILTER (len(oracle) > 0) AS file_metric_cases, round(coalesce(avg(fr) FILTER (fr > 0), 0), 6) AS average_hit_rank, sum(chars)::BIGINT AS total_characters FROM z""")
def recall_eval_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.summarize(_evaluated(spark, d)).select("case_count", "passed_count", "failed_count", "hit_rate", "mean_precision", "mean_recall", "mrr", "mean_ndcg", "file_metric_cases", "average_hit_rank", "total_characters")


@query("SELECT event_type, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def latency_p95(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.nearest_rank(table(spark, d, "events"), "value", ["event_type"]).withColumnRenamed("p", "p95")


@query(r"""SELECT id, coalesce(list_sort(list_filter(list_distinct(list_transform(regexp_extract_all(coalesce(patch, ''), '(?m)^--- a/(.+)$', 1), lambda p: regexp_replace(trim(p), '^/', ''))), lambda p: p <> '')), []) AS files FROM eval_cases""")
def patch_oracles(spark: SparkSession, d: str) -> DataFrame:
    """Of every case, also where the patch changes several files; the list is sorted."""
    return table(spark, d, "eval_cases").select("id", F.array_sort(evaluation.patch_files(F.col("patch"))).alias("files"))



_GLOBS = " OR ".join(f"regexp_matches(p, '{x}')" for x in _SQL_GLOBS)


@query(f"""WITH t AS (SELECT DISTINCT relative_path, string_split(relative_path, '/') AS s FROM chunks WHERE relative_path IS NOT NULL),
x AS (SELECT relative_path, unnest(list_transform(generate_series(1, len(s)), lambda n: array_to_string(s[1:n], '/'))) AS p FROM t)
SELECT relative_path, bool_or({_GLOBS}) AS ignored FROM x GROUP BY 1""")
def glob_ignore(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").select("relative_path").where("relative_path is not null").distinct()
    return rows.select("relative_path", matches_any(F.col("relative_path"), PATTERNS).alias("ignored"))


@query("""SELECT doc_id, strlen(left(text, n))::INT AS n_bytes, md5(left(text, n)) AS cut_md5 FROM (SELECT doc_id, text, list_max(list_filter(range(0, 101), lambda n: strlen(left(text, n)) <= 100)) AS n FROM documents)""")
def utf8_truncate(spark: SparkSession, d: str) -> DataFrame:
    cut = text.truncate_utf8("text", 100)
    return table(spark, d, "documents").select("doc_id", F.octet_length(cut).alias("n_bytes"), F.md5(cut).alias("cut_md5"))


@query(r"""SELECT search_id, rank, result_id, document IS NOT NULL AS has_document, location.relative_path AS relative_path FROM ranked_hits""")
def result_rows(spark: SparkSession, d: str) -> DataFrame:
    """Recorded hits rebuilt from flat rows: the document part is null where all six of its fields are empty."""
    names = ("document_id", "section_id", "heading_path", "knowledge_kind", "node_kind", "version")
    bag = F.create_map(*(x for k in names for x in (F.lit(k), F.coalesce(F.col(f"document.{k}"), F.lit("")))))
    flat = table(spark, d, "ranked_hits").select("search_id", "rank", F.col("result_id").alias("id"), "category", "source_type", "source_id", "namespace", "score", "location.*", "content", bag.alias("metadata"))
    return search.result_rows_of(flat).select("search_id", "rank", "result_id", F.col("document").isNotNull().alias("has_document"), F.col("location.relative_path").alias("relative_path"))


@query(_HEADS + rf""", w AS (SELECT h.doc_id, heading, line, l[line:next_line - 1] AS p, unnest(generate_series(0, greatest(0, ceil((next_line - line - 6) / 4.0)::INT) * 4, 4)) AS s
  FROM (SELECT doc_id, line, trim(regexp_replace(tx, '^#+ ', '')) AS heading, coalesce(lead(line) OVER (PARTITION BY doc_id ORDER BY line), n + 1) AS next_line FROM h) h JOIN t USING (doc_id)),
c AS (SELECT doc_id, heading, (line + s)::INT AS start_line, (line + least(s + 6, len(p)) - 1)::INT AS end_line, array_to_string(p[s + 1:s + 6], chr(10)) AS content FROM w)
SELECT doc_id, heading, start_line, end_line, md5(content) AS content_md5 FROM c WHERE {_FILLED}""")
def range_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Sections of the documents as line ranges, long ones windowed."""
    docs = wide(spark, d, "documents").where("text is not null").select("doc_id", F.col("text").alias("content"))
    heads = markdown.heading_lines(docs, "doc_id").select(F.col("path").alias("doc_id"), F.col("line").alias("start_line"), (F.col("next_line") - 1).alias("end_line"), F.lit("section").alias("kind"), F.create_map(F.lit("heading"), F.col("heading")).alias("metadata"))
    return chunking.range_chunks(docs, heads, "doc_id", max_lines=6, overlap=2).select("doc_id", F.col("metadata")["heading"].alias("heading"), "start_line", "end_line", F.md5("content").alias("content_md5"))


@query("""SELECT id, array_to_string(list_transform(list_sort(list_filter(['absolute_path', 'chunk_kind', 'command', 'document_id', 'domain_path', 'experience_kind', 'heading_path', 'knowledge_kind', 'node_kind', 'role', 'section_id', 'status', 'symbol_kind', 'symbol_name', 'tags', 'tool_name', 'version'],
  lambda k: coalesce(metadata[k], '') <> '')), lambda k: k || '=' || metadata[k]), chr(10)) AS entries FROM chunks""")
def column_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Metadata pivoted to columns and back: only entries that have a column and a value are kept."""
    rows = from_columns(to_columns(table(spark, d, "chunks").select("id", "metadata")))
    return rows.select("id", F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "\n").alias("entries"))
