"""Queries over the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.abuse import rates, score_documents
from siltstone.llm.conversations import clean_messages, clock_offsets, rebuild_conversations
from siltstone.llm.credentials import find_credentials, redact
from siltstone.llm.knn import exact_knn, knn
from siltstone.llm.leaks import leaks
from siltstone.llm.markup import clean_markup
from siltstone.llm.neardup import near_duplicates
from siltstone.llm.packing import fill_report, pack
from siltstone.llm.splitting import split_oversized
from siltstone.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = split_oversized(table(spark, d, "chunks").select("id", "content", "start_line"), only_oversized=True)
    return pieces.where((F.col("piece.piece_no") == 1) & (F.col("n_pieces") > 1)).select("id")


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    pieces = split_oversized(table(spark, d, "chunks").select("id", "content", "start_line"))
    return pieces.select("id", "n_pieces", "piece.piece_no", "piece.content", "piece.start_line", "piece.end_line")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    best = knn(table(spark, d, "chunks"), min_similarity=0.92 - 1e-9)
    return best.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p2_top5(spark: SparkSession, d: str) -> DataFrame:
    """The five best neighbours of every vector, at whatever similarity."""
    return knn(table(spark, d, "chunks")).withColumn("similarity", F.round("similarity", 6))


def p2_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall against brute force over all rows, for the chunks whose id, read as a hexadecimal number, is divisible by 20.

    top5: the search of p2_top5 against all five true neighbours, together and by similarity. near: the search of p2_found
    against those at 0.92 or more, all that it promises.
    """
    chunks = table(spark, d, "chunks")
    digits = F.regexp_replace("id", "^chunk_", "")
    # 16 hexadecimal digits: the number modulo 20 from its two halves; 16**8 leaves 16 when divided by 20.
    number = F.pmod(F.conv(F.left(digits, F.lit(8)), 16, 10).cast("bigint") * 16 + F.conv(F.right(digits, F.lit(8)), 16, 10).cast("bigint"), F.lit(20))
    base = chunks.select("id", F.col("vector").cast("array<double>").alias("v"))
    true = exact_knn(base.where(number == 0), base)
    return recall_by_band(true, knn(chunks), "top5").unionByName(recall_by_band(true.where("similarity >= 0.92"), knn(chunks, min_similarity=0.92 - 1e-9), "near"))


#: Lower bounds of the bands of similarity that recall is told by.
BANDS = (0.92, 0.9, 0.8, 0.7, 0.6, 0.5)


def recall_by_band(true: DataFrame, found: DataFrame, search: str) -> DataFrame:
    """search, band, n_true, n_found, recall: how many of the true neighbours were found, in all and from each lower bound to the next."""
    band = F.coalesce(*(F.when(F.col("similarity") >= b, F.lit(f">= {b}")) for b in BANDS), F.lit(f"< {BANDS[-1]}"))
    both = true.join(found.select("id", "neighbour", F.lit(1).alias("hit")), ["id", "neighbour"], "left")
    rows = both.select("hit", F.explode(F.array(F.lit("all"), band)).alias("band")).groupBy("band")
    rows = rows.agg(F.count(F.lit(1)).alias("n_true"), F.count("hit").alias("n_found"))
    return rows.select(F.lit(search).alias("search"), "band", "n_true", "n_found", F.round(F.col("n_found") / F.col("n_true"), 6).alias("recall"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    clean = clean_markup(table(spark, d, "nodes").select("node_id", "content", "heading_path"))
    fields = F.filter(F.array(F.when(F.size("clean.content_kinds") > 0, "content"), F.when(F.size("clean.heading_kinds") > 0, "heading_path")), lambda x: x.isNotNull())
    return clean.select("node_id", F.explode(fields).alias("field"))


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    clean = clean_markup(table(spark, d, "nodes"))
    return clean.select("node_id", "kind", "clean.content", "clean.heading_path")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return rebuild_conversations(table(spark, d, "memory_records")).select("conversation_id", "turn_no", "message_id")


def p4_turns(spark: SparkSession, d: str) -> DataFrame:
    return rebuild_conversations(table(spark, d, "memory_records"))


def p4_clocks(spark: SparkSession, d: str) -> DataFrame:
    """Least-squares clock offsets of every conversation that alternates, in seconds, and whether its constraints can be met."""
    fix = clock_offsets(clean_messages(table(spark, d, "memory_records")), derive=True)
    return fix.select("conversation_id", "speaker", (F.col("offset") / 1e6).alias("seconds"), "feasible")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates(table(spark, d, "chunks"), threshold=0.7, width=3).pairs()


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates(table(spark, d, "chunks"), threshold=0.7, width=3).groups()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    spans = find_credentials(table(spark, d, "chunks").select("id", "content"))
    return spans.where("starts").select("id", "line_no").distinct()


def p7_redacted(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks")
    return chunks.select("id", "relative_path", redact(chunks).alias("content"))


def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    return pack(table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(pack(table(spark, d, "documents")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_cases")).where("n_exact > 0").select("doc_id", "case_id")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Leaks with re-parameterised ones: windows whose placeholders hold other, consistently renamed words."""
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_cases"))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    scored = score_documents(table(spark, d, "documents"), table(spark, d, "labels"))
    return scored.select("doc_id", "source", "language", F.round("abuse_score", 6).alias("abuse_score"), "is_abusive", "calibrated")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return score_documents(table(spark, d, "documents"), table(spark, d, "labels")).where("is_abusive").select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return rates(score_documents(table(spark, d, "documents"), table(spark, d, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p2_found": p2_found,
    "p2_top5": p2_top5,
    "p2_recall": p2_recall,
    "p3_found": p3_found,
    "p3_clean": p3_clean,
    "p4_found": p4_found,
    "p4_turns": p4_turns,
    "p4_clocks": p4_clocks,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p7_found": p7_found,
    "p7_redacted": p7_redacted,
    "p8_packing": p8_packing,
    "p8_fill": p8_fill,
    "p9_found": p9_found,
    "p9_report": p9_report,
    "p10_found": p10_found,
    "p10_scores": p10_scores,
    "p10_rates": p10_rates,
}

_ISO = r"""^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.]\d+)?)?)?(Z|[+-]\d{2}:\d{2})?$"""


def _micros(column: str) -> str:
    """SQL: microseconds of a time written in one of the notations of the test data."""
    return rf"""CASE WHEN regexp_full_match(trim({column}), '\d{{12,14}}') THEN trim({column})::BIGINT * 1000 WHEN regexp_full_match(trim({column}), '\d{{9,11}}') THEN trim({column})::BIGINT * 1000000
  WHEN regexp_matches(trim({column}), '{_ISO}') THEN epoch_us(try_cast(trim({column}) AS TIMESTAMPTZ)) END"""


_TURNS = rf"""
WITH r AS (SELECT nullif(regexp_replace(conversation_id, '^\s+|\s+$', '', 'g'), '') AS c, nullif(regexp_replace(message_id, '^\s+|\s+$', '', 'g'), '') AS m, content, {_micros('created_at')} AS t, {_micros('updated_at')} AS u,
  CASE WHEN lower(trim(role)) IN ('user', 'human', 'customer', 'client', 'end_user', 'end-user', 'enduser', 'visitor') THEN 'user'
       WHEN lower(trim(role)) IN ('assistant', 'ai', 'bot', 'model', 'agent', 'chatbot', 'gpt', 'llm') THEN 'assistant'
       WHEN lower(trim(role)) IN ('system', 'developer') THEN 'system'
       WHEN lower(trim(role)) IN ('tool', 'function', 'tool_result', 'tool_response', 'function_call', 'plugin') THEN 'tool' END AS s FROM memory_records),
l AS (SELECT * FROM r WHERE c IS NOT NULL QUALIFY row_number() OVER (PARTITION BY c, m ORDER BY u DESC NULLS LAST, t DESC NULLS LAST, content DESC NULLS LAST, s DESC NULLS LAST) = 1),
g AS (SELECT * FROM l WHERE c NOT IN (SELECT c FROM l WHERE m IS NULL OR s IS NULL OR t IS NULL) AND trim(coalesce(content, ''), E' \t\r\n') <> ''),
n AS (SELECT *, row_number() OVER w AS turn FROM g WINDOW w AS (PARTITION BY c ORDER BY t, m)),
h AS (SELECT c, arg_min(s, turn) AS head FROM n WHERE s <> 'system' GROUP BY c),
a AS (SELECT c, s, lead(s) OVER (PARTITION BY c ORDER BY turn) AS nxt FROM n WHERE s IN ('user', 'assistant'))"""
_KEPT = """
WHERE c IN (SELECT c FROM h WHERE head = 'user') AND c NOT IN (SELECT c FROM a WHERE s = 'user' AND coalesce(nxt, '') <> 'assistant')"""

_SIMILAR = """
WITH v AS (SELECT id, vector::DOUBLE[] AS v FROM chunks WHERE len(vector) = 64
  AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
s AS (SELECT a.id, b.id AS o, list_cosine_similarity(a.v, b.v) AS s FROM v a JOIN v b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, o) AS r FROM s)"""

ORACLES: dict[str, str] = {
    "p4_found": f"{_TURNS} SELECT c AS conversation_id, turn::INT AS turn_no, m AS message_id FROM n {_KEPT}",
    "p4_turns": f"{_TURNS} SELECT c AS conversation_id, turn::INT AS turn_no, m AS message_id, s AS speaker, content, t AS at FROM n {_KEPT}",
    "p5_groups": r"""
WITH w AS (SELECT id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS w FROM chunks WHERE content IS NOT NULL),
g AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
k AS (SELECT id, count(*) AS n, md5(string_agg(s, '|' ORDER BY s)) AS k FROM g GROUP BY id),
r AS (SELECT id, n, min(id) OVER (PARTITION BY k) AS rep FROM k),
h AS (SELECT g.* FROM g JOIN r USING (id) WHERE id = rep),
c AS (SELECT a.id, b.id AS other, count(*) AS c FROM h a JOIN h b ON a.s = b.s AND a.id <> b.id GROUP BY 1, 2),
l AS (SELECT c.id, count(*) AS links FROM c JOIN r x ON x.id = c.id JOIN r y ON y.id = c.other WHERE c >= 0.7 * (x.n + y.n - c) - 1e-9 GROUP BY 1)
SELECT r.id AS doc_id, r.rep AS class_id, coalesce(l.links, 0) AS n_links FROM r LEFT JOIN l ON l.id = r.rep""",
    "p9_found": r"""
WITH z AS (SELECT '[\x{00AD}\x{034F}\x{061C}\x{180E}\x{FEFF}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}]' AS p),
c AS (SELECT id AS case_id, regexp_extract_all(lower(regexp_replace(t, p, '', 'g')), '[\p{L}\p{N}]+') AS w FROM (SELECT id, unnest([problem_statement, query]) AS t FROM eval_cases), z WHERE t IS NOT NULL),
d AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, p, '', 'g')), '[\p{L}\p{N}]+') AS w FROM documents, z WHERE text IS NOT NULL),
cw AS (SELECT DISTINCT case_id, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT case_id, w, unnest(range(1, len(w) - 11)) AS i FROM c)),
dw AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d))
SELECT DISTINCT doc_id, case_id FROM dw JOIN cw USING (k)""",
    "p1_found": r"""SELECT id FROM chunks WHERE strlen(content) > 4000 OR len(regexp_split_to_array(content, '\r\n|\n|\r')) > 120""",
    "p2_found": f"{_SIMILAR} SELECT DISTINCT least(id, o) AS id_a, greatest(id, o) AS id_b FROM r WHERE r <= 5 AND s >= 0.92",
    "p2_top5": f"{_SIMILAR} SELECT id, o AS neighbour, round(s, 6) AS similarity, r::INT AS rank FROM r WHERE r <= 5",
    "p5_found": r"""
WITH w AS (SELECT id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS w FROM chunks WHERE content IS NOT NULL),
g AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
c AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2)
SELECT id_a, id_b FROM c JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE c >= 0.7 * (x.n + y.n - c) - 1e-9""",
}
