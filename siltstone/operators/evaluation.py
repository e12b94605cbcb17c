"""Recall evaluation: expectations, matches, per-case metrics and their summary, all cases at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import estimated_tokens, evaluation_path, first_filled, or_empty, trim_space

LOCATION = ("relative_path", "start_line", "end_line")


def patch_files(patch: Column) -> Column:
    """Distinct files a patch changes, in order of appearance."""
    found = F.transform(F.regexp_extract_all(or_empty(patch), F.lit(r"(?m)^--- a/(.+)$"), F.lit(1)), evaluation_path)
    return F.array_distinct(F.filter(found, lambda p: p != ""))


def query_text(query: Column, problem: Column) -> Column:
    return F.when(trim_space(or_empty(query)) != "", query).otherwise(or_empty(problem))


def case_id(identifier: Column, instance: Column) -> Column:
    return F.when(trim_space(or_empty(identifier)) != "", identifier).otherwise(or_empty(instance))


def type_list(search_types: Column, types: Column, fallback: str = "all") -> Column:
    return F.when(F.size(search_types) > 0, F.array_join(search_types, ",")).when(trim_space(or_empty(types)) != "", types).otherwise(fallback)


def expectations(cases: DataFrame) -> DataFrame:
    """case_id, expected_no, expected (struct): from ``expected``, else the oracle files, else the files of the patch."""
    kind = dict(cases.dtypes)["expected"]
    fields = cases.schema["expected"].dataType.elementType.fieldNames()
    of_path = lambda p: F.struct(*(p.alias(f) if f == "relative_path" else F.lit(None).alias(f) for f in fields))
    oracle = F.filter(F.transform("oracle_files", evaluation_path), lambda p: p != "")
    paths = F.when(F.size("oracle_files") > 0, oracle).otherwise(patch_files(F.col("patch")))
    rows = F.when(F.size("expected") > 0, F.col("expected")).otherwise(F.transform(paths, of_path).cast(kind))
    return cases.select(case_id(F.col("id"), F.col("instance_id")).alias("case_id"), F.posexplode(rows).alias("expected_no", "expected"))


def lines_overlap(result_start: Column, result_end: Column, start: Column, end: Column) -> Column:
    """Closed intervals overlap; an unset end mirrors its start; an unset expectation matches anything, a result without lines nothing."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    es, ee = F.when(zero(start) > 0, start).otherwise(zero(end)), F.when(zero(end) > 0, end).otherwise(zero(start))
    rs, re_ = zero(result_start), F.when(zero(result_end) > 0, result_end).otherwise(zero(result_start))
    return (es <= 0) | ((rs > 0) & (es <= re_) & (rs <= ee))


def same_if_set(expected: Column, actual: Column) -> Column:
    return (or_empty(expected) == "") | (or_empty(expected) == or_empty(actual))


def contains_entries(actual: Column, wanted: Column) -> Column:
    """Every entry of ``wanted`` is in ``actual``; a null map wants nothing."""
    return wanted.isNull() | F.forall(F.map_entries(wanted), lambda e: F.coalesce(actual[e["key"]], F.lit("")) == or_empty(e["value"]))


def matches(fields: list[str]) -> Column:
    """Condition that hit ``r`` (result row) meets expectation ``x.expected``, for the expectation fields there are."""
    e, out = (lambda f: F.col(f"x.expected.{f}")), F.lit(True)
    plain = {"result_id": "result_id", "content_hash": "content_hash", "category": "category", "source_type": "source_type", "source_id": "source_id", "namespace": "namespace", "domain_path": "domain_path"}
    for f in fields:
        if f in plain:
            out = out & same_if_set(e(f), F.col(f"r.{plain[f]}"))
        elif f in ("document_id", "section_id", "heading_path", "knowledge_kind", "node_kind", "version"):
            out = out & same_if_set(e(f), F.col(f"r.document.{f}"))
    if "relative_path" in fields:
        out = out & ((or_empty(e("relative_path")) == "") | (evaluation_path(or_empty(e("relative_path"))) == evaluation_path(or_empty(F.col("r.location.relative_path")))))
    if "start_line" in fields:
        out = out & lines_overlap(F.col("r.location.start_line"), F.col("r.location.end_line"), e("start_line"), e("end_line"))
    if "content_contains" in fields:
        out = out & ((or_empty(e("content_contains")) == "") | F.contains(F.col("r.content"), or_empty(e("content_contains"))))
    if "metadata" in fields:
        out = out & contains_entries(F.col("r.metadata"), e("metadata"))
    return F.coalesce(out, F.lit(False))


def evaluate(results: DataFrame, expected: DataFrame) -> DataFrame:
    """One row per case with hit, precision, recall, f1, mrr, ndcg, file metrics, characters and tokens.

    ``results`` has case_id, rank and the result columns; ``expected`` case_id, expected_no, expected. A result gains only where
    it is the first to meet some expectation. Cases without results count with zeros.
    """
    fields = expected.schema["expected"].dataType.fieldNames()
    pairs = results.alias("r").join(expected.alias("x"), (F.col("r.case_id") == F.col("x.case_id")) & matches(fields)).select(F.col("r.case_id").alias("case_id"), F.col("r.rank").alias("rank"), F.col("x.expected_no").alias("no"))
    first = F.min("rank").over(Window.partitionBy("case_id", "no"))
    hit = pairs.withColumn("gain", F.col("rank") == first).groupBy("case_id").agg(
        F.countDistinct("rank").alias("matched_results"), F.countDistinct("no").alias("matched_expected"), F.min("rank").alias("first_hit_rank"), F.collect_set(F.when(F.col("gain"), F.col("rank"))).alias("gains")
    )
    per_case = results.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("result_count"), F.sum(F.char_length(or_empty("content"))).alias("result_characters"), F.sum(estimated_tokens("content")).alias("result_tokens"),
        F.collect_set(F.when(or_empty("location.relative_path") != "", evaluation_path("location.relative_path"))).alias("hit_files"),
    )
    per_expected = expected.groupBy("case_id").agg(F.count(F.lit(1)).alias("expected_count"), F.collect_set(F.when(or_empty("expected.relative_path") != "", evaluation_path("expected.relative_path"))).alias("oracle_files"))
    rows = per_expected.join(per_case, "case_id", "left").join(hit, "case_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    f1 = lambda p, r: F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    none = F.array().cast("array<string>")
    files, oracle = F.coalesce("hit_files", none), F.coalesce("oracle_files", none)
    both = F.size(F.array_intersect(files, oracle))
    gains = F.coalesce("gains", F.array().cast("array<int>"))
    dcg = F.aggregate(gains, F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    ideal = F.least(n("expected_count"), n("result_count"))
    idcg = F.when(ideal > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(ideal, F.lit(1)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1)))
    rows = rows.withColumns({
        "precision": ratio(n("matched_results"), n("result_count")), "recall": ratio(n("matched_expected"), n("expected_count")), "mrr": F.coalesce(1 / F.col("first_hit_rank"), F.lit(0.0)),
        "ndcg": F.coalesce(dcg / idcg, F.lit(0.0)), "file_precision": ratio(both, F.size(files)), "file_recall": ratio(both, F.size(oracle)),
    })
    return rows.select(
        "case_id", n("expected_count").alias("expected_count"), n("matched_expected").alias("matched_expected"), n("matched_results").alias("matched_results"), n("result_count").alias("result_count"),
        (n("first_hit_rank") > 0).alias("matched"), n("first_hit_rank").cast("int").alias("first_hit_rank"), "precision", "recall", f1(F.col("precision"), F.col("recall")).alias("f1"), "mrr", "ndcg",
        "file_precision", "file_recall", f1(F.col("file_precision"), F.col("file_recall")).alias("file_f1"), (F.size(oracle) > 0).alias("has_files"),
        F.coalesce("result_characters", F.lit(0)).alias("result_characters"), F.coalesce("result_tokens", F.lit(0)).alias("result_tokens"),
    )


def summarize(cases: DataFrame) -> DataFrame:
    """One row: means over all cases, file means over cases with files, mean rank over cases with a hit."""
    mean = lambda c: F.round(F.avg(c), 6)
    of_files = lambda c: F.round(F.coalesce(F.avg(F.when(F.col("has_files"), F.col(c))), F.lit(0.0)), 6)
    return cases.agg(
        F.count(F.lit(1)).alias("case_count"), F.count_if("matched").alias("passed_count"), F.count_if(~F.col("matched")).alias("failed_count"), mean(F.col("matched").cast("int")).alias("hit_rate"),
        mean("precision").alias("mean_precision"), mean("recall").alias("mean_recall"), mean("f1").alias("mean_f1"), mean("mrr").alias("mrr"), mean("ndcg").alias("mean_ndcg"),
        F.count_if("has_files").alias("file_metric_cases"), of_files("file_precision").alias("mean_file_precision"), of_files("file_recall").alias("mean_file_recall"), of_files("file_f1").alias("mean_file_f1"),
        F.round(F.coalesce(F.avg(F.when(F.col("matched"), F.col("first_hit_rank"))), F.lit(0.0)), 6).alias("average_hit_rank"), F.sum("result_characters").alias("total_characters"), F.sum("result_tokens").alias("total_tokens"),
        F.sum("result_count").alias("total_results"), mean("result_characters").alias("mean_characters"), mean("result_tokens").alias("mean_tokens"), mean("result_count").alias("mean_results"),
    )


def nearest_rank(df: DataFrame, value: str, by: list[str], p: float = 0.95) -> DataFrame:
    """The nearest-rank percentile: the value at position ceil(p n), exactly, by an aggregate."""
    return df.groupBy(*by).agg(F.percentile_disc(value, p).alias("p") if hasattr(F, "percentile_disc") else F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias("p"))


def fallback_limit(*limits: Column) -> Column:
    """The first positive limit, else 0."""
    return F.coalesce(*(F.when(x > 0, x) for x in limits), F.lit(0))


def label(*names: Column) -> Column:
    return first_filled(*names)
