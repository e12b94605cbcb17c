"""Hybrid search: filters, exact cosine, BM25 over the filtered candidates, fusion, merge over namespaces."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.ids import content_hash
from siltstone.functions.scoring import TIEBREAK, Strategy, bm25, category_for, fuse, rank_over, reciprocal_ranks, search_weights, strategy_for, term_weights
from siltstone.functions.text import string_literal
from siltstone.functions.vectors import cosine_to
from siltstone.runtime import materialise
from siltstone.schema import FILTERED, SOURCE_TYPES

OVERFETCH = 3
DOC_TYPES = tuple(t for t in SOURCE_TYPES if t != "codebase")
#: Names a search type goes by.
ALIASES: dict[str, tuple[str, tuple[str, ...]]] = {
    "code": ("code", ("codebase",)),
    **dict.fromkeys(("doc", "non_code", "non-code"), ("doc", DOC_TYPES)),
    **dict.fromkeys(("knowledge", "knowledge_document", "document", "documents", "docs"), ("knowledge", ("document", "external_knowledge"))),
    **dict.fromkeys(("conversation", "history", "chat", "historical_conversation"), ("conversation", ("conversation",))),
    **dict.fromkeys(("experience", "experiences"), ("experience", ("experience",))),
    **dict.fromkeys(("preference", "preferences", "user_preference", "user_preferences"), ("user_preference", ("preference",))),
    **dict.fromkeys(("tool", "tool_history"), ("tool_history", ("tool_history",))),
    **dict.fromkeys(("fact", "facts"), ("fact", ("fact",))),
}
_WORD = re.compile(r"[^\W_]+")


def split_types(arg: str | None) -> list[str]:
    return [v for v in (p.strip().lower() for p in re.split(r"[,|]", arg or "")) if v]


def is_type_list(arg: str) -> bool:
    values = split_types(arg)
    return bool(values) and all(v == "all" or v in ALIASES for v in values)


def select_types(arg: str | None) -> tuple[list[str], set[str]]:
    """Labels and source types; nothing or ``all`` selects every one."""
    values = split_types(arg)
    if not values or "all" in values:
        return ["all"], set(SOURCE_TYPES)
    unknown = [v for v in values if v not in ALIASES]
    if unknown:
        raise ValueError(f"unsupported search type {unknown[0]!r}")
    return sorted({ALIASES[v][0] for v in values}), {t for v in values for t in ALIASES[v][1]}


def query_tokens(query: str) -> list[str]:
    """The distinct keyword tokens of a query, on the driver."""
    out: dict[str, None] = {}
    for run in _WORD.findall(query):
        word = ""
        for prev, c in zip([""] + list(run), run):
            if prev.islower() and c.isupper():
                out[word.lower()] = None
                word = ""
            word += c
        out[word.lower()] = None
    return [t for t in out if len(t) > 1]


@dataclass(frozen=True)
class SearchOptions:
    """Eight IN lists (an empty one passes all), limit (not positive: all), query, weights and profile."""

    query: str = ""
    limit: int = 8
    extensions: tuple[str, ...] = ()
    filters: dict[str, tuple[str, ...]] = field(default_factory=dict)
    semantic: float = 0.0
    keyword: float = 0.0
    profile: str = "default"
    fusion: str = "linear"

    def strategy(self) -> Strategy:
        s, k = search_weights(self.query, self.semantic, self.keyword)
        return Strategy(self.profile, s, k, "rrf" if self.fusion.lower() == "rrf" else "linear")


def predicate(options: SearchOptions, columns: list[str]) -> Column:
    """Conjunction of the IN lists, on a promoted column where the table has it; a missing value never passes a list."""
    out = F.lit(True)
    if options.extensions:
        out = F.col("file_extension").isin(list(options.extensions))
    for name in FILTERED:
        values = [v for v in options.filters.get(name, ()) if v]
        if values:
            out = out & (F.col(name) if name in columns else F.col("metadata")[name]).isin(values)
    return out


_ALPHABETS = {"namespace": r"[\w&&[^\d]]\w*", "extension": r"\.[\w-]+", "domain_path": r"[\w/-]+", "metadata": r"[\w./ >-]+", "path": r"[\w./ -]+", "token": r"\w+"}


def validate(kind: str, value: str) -> str:
    """Values of the remote filter language come from small alphabets; anything else is an error."""
    pattern = _ALPHABETS[kind].replace(r"[\w&&[^\d]]", r"[^\W\d]")
    if not re.fullmatch(pattern, value):
        raise ValueError(f"invalid {kind} value {value!r}")
    return value


def filter_text(namespace: str, options: SearchOptions) -> str:
    """The filter as text of the remote filter language."""
    lists = [("file_extension", "extension", options.extensions)] + [(n, "domain_path" if n == "domain_path" else "metadata", options.filters.get(n, ())) for n in FILTERED]
    parts = [f"namespace == {string_literal(validate('namespace', namespace))}"]
    parts += [f"{name} in [{', '.join(string_literal(validate(kind, v)) for v in values)}]" for name, kind, values in lists if values]
    return " and ".join(parts)


def file_filter_text(namespace: str, paths: list[str]) -> str:
    if not paths:
        raise ValueError("no paths")
    return f"namespace == {string_literal(validate('namespace', namespace))} and relative_path in [{', '.join(string_literal(validate('path', p)) for p in paths)}]"


def recall_limit(limit: int, query: str) -> int:
    """Candidates fetched by similarity before a rerank: three times the limit where the query has tokens."""
    return limit * OVERFETCH if limit > 0 and query_tokens(query) else limit


def score(chunks: DataFrame, query_vector: list[float], options: SearchOptions, by: list[str] | None = None) -> DataFrame:
    """``chunks`` that pass the filters, with semantic_score, keyword_score and score. Statistics are those of the candidates of each group."""
    by = ["namespace"] if by is None else by
    s, tokens = options.strategy(), query_tokens(options.query)
    rows = chunks.where(predicate(options, chunks.columns)).withColumn("semantic_score", cosine_to(F.col("vector"), query_vector)).drop("vector")
    rows = bm25(term_weights(rows, tokens, s.profile), tokens, by) if tokens else rows.withColumn("keyword_score", F.lit(0.0))
    return fuse(rows, s, by, bool(tokens))


def top(rows: DataFrame, limit: int) -> DataFrame:
    order = [F.round("score", 12).desc(), *TIEBREAK]
    return rows.orderBy(*order).limit(limit) if limit > 0 else rows.orderBy(*order)


def search_namespace(chunks: DataFrame, namespace: str, query_vector: list[float], options: SearchOptions) -> DataFrame:
    return top(score(chunks.where(F.col("namespace") == namespace), query_vector, options), options.limit)


def rerank(candidates: DataFrame, options: SearchOptions) -> DataFrame:
    """Keyword and fused scores over an already fetched candidate set (with semantic_score)."""
    tokens, s = query_tokens(options.query), options.strategy()
    if not tokens:
        return top(candidates.withColumn("keyword_score", F.lit(0.0)).withColumn("score", F.col("semantic_score")), options.limit)
    return top(fuse(bm25(term_weights(candidates, tokens, s.profile), tokens, []), s, [], True), options.limit)


def remote_search(chunks: DataFrame, namespace: str, query_vector: list[float], options: SearchOptions) -> DataFrame:
    """Two phases: the most similar candidates, then a rerank of them alone. A limit that isn't positive is the vector's length."""
    limit = options.limit if options.limit > 0 else len(query_vector)
    rows = chunks.where((F.col("namespace") == namespace) & predicate(options, chunks.columns)).withColumn("semantic_score", cosine_to(F.col("vector"), query_vector)).drop("vector")
    first = rows.orderBy(F.round("semantic_score", 12).desc(), *TIEBREAK).limit(recall_limit(limit, options.query))
    return rerank(first, replace(options, limit=limit))


def search_all(chunks: DataFrame, catalog: DataFrame, query: str, query_vector: list[float], *, limit: int = 8, types: str | None = None, code_namespace: str | None = None,
               domains: list[str] | None = None, weights: dict[str, tuple[float, float]] | None = None, normalized: bool = False) -> DataFrame:
    """Ranked hits over all selected namespaces: chunk columns, scores, source_type, category, source_id, namespace_order, rank.

    ``catalog`` has namespace, source_type, source_id, status and key; only indexed rows of the selected types are searched, code
    first, then in order of the key. Each source type is scored by its own strategy (ranks for code, weighted sums elsewhere),
    three times the limit is kept of each namespace, and the union is ordered by score alone, ties by namespace order and rank inside the namespace. Scores of different
    fusions are not on one scale; ``normalized`` divides each by its namespace's best.
    """
    _, chosen = select_types(types)
    filters = SearchOptions(query=query, filters={"domain_path": tuple(domains)} if domains else {})
    order = Window.orderBy("key")  # over the catalog: one row per source
    names = catalog.where(F.col("status") == "indexed").withColumn("namespace_order", F.row_number().over(order))
    names = names.where(F.col("source_type").isin([t for t in SOURCE_TYPES if t in chosen and t != "codebase"])).select("namespace", "source_type", "source_id", "namespace_order")
    if code_namespace and "codebase" in chosen:
        names = names.unionByName(catalog.sparkSession.createDataFrame([(code_namespace, "codebase", "code", 0)], "namespace string, source_type string, source_id string, namespace_order int"))
    elif chosen == {"codebase"}:
        raise ValueError("nothing to search")
    tokens, kinds = query_tokens(query), {t: strategy_for(t, weights) for t in sorted(chosen)}
    kinds = {t: replace(s, **dict(zip(("semantic", "keyword"), search_weights(query, s.semantic, s.keyword)))) for t, s in kinds.items()}
    of = lambda value: F.create_map(*(F.lit(x) for t, s in kinds.items() for x in (t, value(s))))[F.col("source_type")]
    # One scan: each row's terms are counted under its own source's weights. What statistics, scores and ranks need is kept
    # narrow; contents are fetched for the hits alone.
    rows = chunks.where(predicate(filters, chunks.columns)).join(names, "namespace").withColumn("semantic_score", cosine_to(F.col("vector"), query_vector))
    rows = term_weights(rows, tokens, of(lambda s: s.profile)) if tokens else rows
    rows = materialise(rows.select("namespace", "source_type", "source_id", "namespace_order", *TIEBREAK, "semantic_score", *(["tf", "doc_len"] if tokens else [])))
    rows = bm25(rows, tokens, ["namespace"]) if tokens else rows.withColumn("keyword_score", F.lit(0.0))
    linear = F.col("semantic_score") * of(lambda s: s.semantic) + (F.col("keyword_score") * of(lambda s: s.keyword) if tokens else F.lit(0.0))
    ranks = [t for t, s in kinds.items() if s.fusion == "rrf"] if tokens else []
    hits = rows.where(~F.col("source_type").isin(ranks)).withColumn("score", linear) if ranks else rows.withColumn("score", linear)
    for t in ranks:
        if t != "codebase" or code_namespace:
            hits = hits.unionByName(reciprocal_ranks(rows.where(F.col("source_type") == t), kinds[t].semantic, kinds[t].keyword, ["namespace"]))
    if normalized:
        best = hits.groupBy("namespace").agg(F.max("score").alias("_best"))
        hits = hits.join(best, "namespace").withColumn("score", F.col("score") / F.col("_best")).drop("_best")
    if limit > 0:
        w = Window.partitionBy("namespace").orderBy(F.round("score", 12).desc(), *TIEBREAK)
        hits = hits.withColumn("namespace_rank", F.row_number().over(w)).where(F.col("namespace_rank") <= limit * OVERFETCH)
    else:
        hits = rank_over(hits, ["namespace"], [F.round("score", 12).desc(), *(F.col(c).asc() for c in TIEBREAK)], "namespace_rank")
    final = [F.round("score", 12).desc(), "namespace_order", "namespace_rank"]
    if limit > 0:
        hits = hits.orderBy(*final).limit(limit)
    hits = materialise(hits.withColumn("category", F.create_map(*(F.lit(x) for t in kinds for x in (t, category_for(t))))[F.col("source_type")]))
    # A row repeated under one id has one content.
    found = chunks.drop("vector", *TIEBREAK[:3]).join(hits.select("namespace", "id").distinct(), ["namespace", "id"], "left_semi").dropDuplicates(["namespace", "id"])
    hits = hits.join(found, ["namespace", "id"])
    return hits.orderBy(*final)


def ranked(hits: DataFrame) -> DataFrame:
    """``rank`` from 1 over a limited result."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.round("score", 12).desc(), "namespace_order", "namespace_rank")))


def result_rows(hits: DataFrame) -> DataFrame:
    """Hits in the form they are returned in: location, document (null where all of its fields are empty), metadata."""
    return result_rows_of(hits).drop(*(c for c in hits.columns if c.startswith("_")))


def result_rows_of(hits: DataFrame) -> DataFrame:
    m = lambda k: F.coalesce(F.col("metadata")[k], F.lit(""))
    names = ("document_id", "section_id", "heading_path", "knowledge_kind", "node_kind", "version")
    some = F.concat(*(m(k) for k in names)) != ""
    kept = [c for c in ("search_id", "session_id", "case_id") if c in hits.columns]
    return hits.select(
        *kept, "rank", F.col("id").alias("result_id"), content_hash(F.col("content")).alias("content_hash"), "category", "source_type", "source_id", "namespace", "score",
        F.struct("relative_path", "start_line", "end_line", "file_extension", "language").alias("location"),
        F.when(some, F.struct(*(m(k).alias(k) for k in names))).alias("document"), m("experience_kind").alias("experience_kind"), m("domain_path").alias("domain_path"), "content", "metadata",
    )
