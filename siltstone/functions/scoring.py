"""Keyword and fused scores: weighted term frequencies, saturated BM25, linear and reciprocal-rank fusion, strategies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import keyword_tokens
from siltstone.runtime import materialise

K1, B, RRF_K = 1.2, 0.75, 60

#: Weight of each searchable field by keyword profile; ``other`` is any other metadata value.
FIELD_WEIGHTS: dict[str, dict[str, float]] = {
    "code": {"content": 1.0, "relative_path": 2.0, "file_extension": 0.4, "language": 0.4, "other": 0.5, "symbol_name": 3.0, "symbol_kind": 1.2, "chunk_kind": 0.5, "domain_path": 0.8, "experience_kind": 0.4},
    "knowledge": {"content": 1.0, "relative_path": 0.6, "file_extension": 0.2, "language": 0.2, "other": 0.4, "heading_path": 2.0, "document_id": 1.0, "section_id": 0.8, "knowledge_kind": 0.6, "node_kind": 0.3, "version": 0.2},
    "conversation": {"content": 1.0, "relative_path": 0.1, "file_extension": 0.0, "language": 0.0, "other": 0.2, "role": 0.2, "domain_path": 0.4},
    "experience": {"content": 1.0, "relative_path": 0.2, "file_extension": 0.0, "language": 0.0, "other": 0.4, "domain_path": 1.4, "experience_kind": 1.2, "tags": 1.0},
    "preference": {"content": 1.2, "relative_path": 0.1, "file_extension": 0.0, "language": 0.0, "other": 0.3, "domain_path": 0.8, "tags": 0.6},
    "tool_history": {"content": 1.0, "relative_path": 0.2, "file_extension": 0.0, "language": 0.0, "other": 0.4, "tool_name": 1.5, "command": 0.8, "status": 0.8, "domain_path": 0.6},
    "fact": {"content": 1.1, "relative_path": 0.1, "file_extension": 0.0, "language": 0.0, "other": 0.4, "domain_path": 0.8},
    "default": {"content": 1.0, "relative_path": 0.4, "file_extension": 0.1, "language": 0.1, "other": 0.3},
}

#: Semantic and keyword weight of each search strategy.
STRATEGIES: dict[str, tuple[float, float]] = {
    "default": (0.75, 0.25), "code": (0.30, 0.70), "knowledge": (0.70, 0.30), "conversation": (0.85, 0.15), "experience": (0.75, 0.25),
    "preference": (0.55, 0.45), "tool_history": (0.80, 0.20), "fact": (0.65, 0.35), "external_knowledge": (0.70, 0.30),
}


@dataclass(frozen=True)
class Strategy:
    """How one kind of source is searched: reciprocal ranks for code, a weighted sum elsewhere."""

    profile: str
    semantic: float
    keyword: float
    fusion: str


def normalize_weights(semantic: float, keyword: float, fallback: tuple[float, float] = STRATEGIES["default"]) -> tuple[float, float]:
    """Not negative, summing to 1; the fallback where neither is positive."""
    s, k = max(semantic, 0.0), max(keyword, 0.0)
    return (s / (s + k), k / (s + k)) if s + k > 0 else fallback


def search_weights(query: str, semantic: float, keyword: float) -> tuple[float, float]:
    """A blank query is purely semantic."""
    return (1.0, 0.0) if not query.strip() else normalize_weights(semantic, keyword)


def strategy_for(source_type: str, weights: dict[str, tuple[float, float]] | None = None) -> Strategy:
    """Strategy of a source type; ``codebase`` is code, external knowledge is knowledge."""
    name = {"codebase": "code", "document": "knowledge", "external_knowledge": "knowledge"}.get(source_type, source_type)
    name = name if name in FIELD_WEIGHTS else "default"
    s, k = normalize_weights(*((weights or STRATEGIES).get(name, STRATEGIES[name])))
    return Strategy(name, s, k, "rrf" if name == "code" else "linear")


def category_for(source_type: str) -> str:
    return {"codebase": "code", "document": "knowledge", "external_knowledge": "knowledge", "preference": "user_preference"}.get(source_type, source_type)


def _fields_of(profile: Column) -> Column:
    """The same where each row names its own profile: its weights are looked up once a row."""
    table = F.create_map(*(x for p, w in FIELD_WEIGHTS.items() for x in (F.lit(p), F.create_map(*(F.lit(y) for kv in w.items() for y in kv)))))

    def of(w: Column) -> Column:
        base = [F.struct(F.coalesce(F.col(c), F.lit("")).alias("text"), w[c].alias("weight")) for c in ("content", "relative_path", "file_extension", "language")]
        entries = F.map_entries(F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>")))
        own = F.array(*(F.lit(c) for c in ("content", "relative_path", "file_extension", "language", "other")))
        weight = lambda e: F.when(F.array_contains(own, e["key"]), w["other"]).otherwise(F.coalesce(w[e["key"]], w["other"]))
        rest = F.transform(entries, lambda e: F.struct(F.coalesce(e["value"], F.lit("")).alias("text"), weight(e).alias("weight")))
        return F.filter(F.concat(F.array(*base), rest), lambda f: f["weight"] > 0)

    return F.transform(F.array(F.coalesce(table[profile], table["default"])), of)[0]


def fields(profile: str | Column) -> Column:
    """array<struct<text, weight>> of a row's searchable fields, weight 0 left out."""
    if isinstance(profile, Column):
        return _fields_of(profile)
    w = FIELD_WEIGHTS.get(profile, FIELD_WEIGHTS["default"])
    base = [F.struct(F.coalesce(F.col(c), F.lit("")).alias("text"), F.lit(w[c]).alias("weight")) for c in ("content", "relative_path", "file_extension", "language") if w[c] > 0]
    listed = {k: v for k, v in w.items() if k not in ("content", "relative_path", "file_extension", "language", "other")}
    table = F.create_map(*(F.lit(x) for kv in listed.items() for x in kv)) if listed else F.create_map().cast("map<string,double>")
    entries = F.map_entries(F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>")))
    of = F.transform(entries, lambda e: F.struct(F.coalesce(e["value"], F.lit("")).alias("text"), F.coalesce(table[e["key"]], F.lit(w["other"])).alias("weight")))
    return F.concat(F.array(*base), F.filter(of, lambda f: f["weight"] > 0))


def term_weights(rows: DataFrame, tokens: list[str], profile: str | Column) -> DataFrame:
    """``rows`` with doc_len (sum of weights of all tokens) and tf (array of the query tokens' weighted frequencies).

    One pass over each row's own text: no token rows, so no shuffle.
    """
    weighted = F.transform(fields(profile), lambda f: F.struct(keyword_tokens(f["text"]).alias("tokens"), f["weight"].alias("weight")))
    rows = rows.withColumn("_fields", weighted)
    length = F.aggregate("_fields", F.lit(0.0), lambda s, f: s + F.size(f["tokens"]) * f["weight"])
    frequency = lambda t: F.aggregate("_fields", F.lit(0.0), lambda s, f: s + F.size(F.filter(f["tokens"], lambda x: x == t)) * f["weight"])
    tf = [frequency(t) for t in tokens]
    return rows.withColumn("doc_len", length).withColumn("tf", F.array(*tf) if tf else F.array().cast("array<double>")).drop("_fields")


def bm25(rows: DataFrame, tokens: list[str], by: list[str]) -> DataFrame:
    """``rows`` (doc_len, tf) with ``keyword_score`` in [0, 1): BM25 over the candidates of each group, saturated by s/(s+1).

    Statistics are one row per group, so the second pass joins a table as small as the number of groups.
    """
    if not tokens:
        return rows.withColumn("keyword_score", F.lit(0.0)).drop("tf", "doc_len")
    stats = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.avg("doc_len").alias("_avg"), F.array(*(F.count_if(F.col("tf")[i] > 0) for i in range(len(tokens)))).alias("_df"))
    rows = rows.join(stats, by) if by else rows.crossJoin(stats)
    part = [
        F.when(F.col("tf")[i] > 0, F.log1p((F.col("_n") - F.col("_df")[i] + 0.5) / (F.col("_df")[i] + 0.5)) * F.col("tf")[i] * (K1 + 1)
               / (F.col("tf")[i] + K1 * (1 - B + B * F.col("doc_len") / F.when(F.col("_avg") > 0, F.col("_avg")).otherwise(1.0)))).otherwise(0.0)
        for i in range(len(tokens))
    ]
    raw = sum(part, F.lit(0.0))
    return rows.withColumn("_raw", raw).withColumn("keyword_score", F.when(F.col("_raw") > 0, F.col("_raw") / (F.col("_raw") + 1)).otherwise(0.0)).drop("_raw", "_n", "_avg", "_df", "tf", "doc_len")


TIEBREAK = ("relative_path", "start_line", "end_line", "id")


def rank_over(rows: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``name``, the row number from 1 in ``order`` within each group, no group gathered in one task.

    Rows are parted by ranges of the order, numbered within a part, and moved on by the sizes of the parts before.
    """
    parted = materialise(rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a part
    sizes = parted.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_size"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    inside = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))
    return parted.withColumn("_n", inside).join(sizes, [*by, "_part"]).withColumn(name, F.col("_before") + F.col("_n")).drop("_before", "_n", "_part")


def reciprocal_ranks(rows: DataFrame, semantic: float, keyword: float, by: list[str]) -> DataFrame:
    """``rows`` with ``score`` from the ranks of both scores; a row without a keyword score has no keyword rank."""
    s, k = F.round("semantic_score", 12), F.round("keyword_score", 12)
    rows = rank_over(rows, by, [s.desc(), *(F.col(c).asc() for c in TIEBREAK)], "_s")
    rows = rank_over(rows, by, [F.desc(F.col("keyword_score") > 0), k.desc(), *(F.col(c).asc() for c in TIEBREAK)], "_k")
    score = F.lit(semantic) / (RRF_K + F.col("_s")) + F.when(F.col("keyword_score") > 0, F.lit(keyword) / (RRF_K + F.col("_k"))).otherwise(0.0)
    return rows.withColumn("score", score).drop("_s", "_k")


def fuse(rows: DataFrame, strategy: Strategy, by: list[str], has_query: bool) -> DataFrame:
    """``rows`` (semantic_score, keyword_score) with ``score``.

    Ranks order scores rounded to 12 digits, ties by path, lines and id. Every row has a semantic rank, only rows with a positive
    keyword score a keyword rank.
    """
    if not has_query:
        return rows.withColumn("score", F.col("semantic_score") * F.lit(strategy.semantic))
    if strategy.fusion != "rrf":
        return rows.withColumn("score", F.col("semantic_score") * F.lit(strategy.semantic) + F.col("keyword_score") * F.lit(strategy.keyword))
    return reciprocal_ranks(rows, strategy.semantic, strategy.keyword, by)
