"""Domains of texts: rule classifier, signals and their fusion, as Columns over one row.

Rules and profiles are a handful of literals, so each is unrolled into ``contains`` expressions of the row's own projection;
nothing is joined or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import metadata_text, normalize_domain, normalize_extension, normalized_text, or_empty, overlay

#: Domain, keywords found as substrings, extensions.
RULES: list[tuple[str, list[str], list[str]]] = [
    ("programming/go", ["go", "golang", "goroutine", "channel", "gofmt", "go test", "go mod", "panic", "defer"], [".go"]),
    ("database/milvus", ["milvus", "vector database", "vector store", "collection", "embedding", "topk", "hybrid search"], []),
    ("infrastructure/kubernetes", ["kubernetes", "k8s", "pod", "deployment", "container", "helm", "kubectl", "namespace"], [".yaml", ".yml"]),
    ("programming/frontend", ["frontend", "react", "vue", "typescript", "javascript", "css", "tailwind", "vite", "webpack"], [".ts", ".tsx", ".js", ".jsx", ".css", ".html"]),
    ("database/sql", ["database", "sql", "mysql", "postgres", "redis", "transaction", "index", "query"], [".sql"]),
    ("programming/testing", ["test", "unit test", "coverage", "mock", "assert", "fixture", "go test"], ["_test.go"]),
    ("devops/deployment", ["deploy", "release", "build", "ci", "pipeline", "docker", "makefile", "rollback"], ["dockerfile", "makefile"]),
]
#: Terms of the domain profiles: domain, description, aliases, examples. A term counts where the text holds it, lower case.
PROFILES: list[tuple[str, list[str]]] = [
    (
        "programming/go",
        ["programming/go", "Go 语言开发、goroutine、channel、go test、go mod、panic、defer、接口和性能分析相关经验", "go", "golang", "goroutine", "channel", "go test", "go mod", "Go 单元测试失败如何排查", "goroutine 泄漏分析", "panic 和 recover 使用边界"],
    ),
    (
        "database/milvus",
        ["database/milvus", "Milvus、向量数据库、collection、index、load、search、TopK、embedding 和 hybrid search 相关经验", "milvus", "vector database", "vector store", "collection", "embedding", "hybrid search", "Milvus collection not loaded", "vector search returns empty result", "hybrid search ranking problem"],
    ),
    (
        "infrastructure/kubernetes",
        ["infrastructure/kubernetes", "Kubernetes、k8s、pod、deployment、container、helm、kubectl 和 namespace 相关经验", "kubernetes", "k8s", "pod", "deployment", "container", "helm", "kubectl", "Pod CrashLoopBackOff 排查", "Kubernetes deployment 发布失败", "kubectl 查看 namespace 下资源"],
    ),
]
#: Score of an explicit extension.
EXPLICIT = {".go": ("programming/go", 0.8), ".sql": ("database/sql", 0.8), **dict.fromkeys((".ts", ".tsx", ".js", ".jsx"), ("programming/frontend", 0.65))}
WEIGHTS = {"explicit": 0.35, "profile": 0.35, "memory": 0.20, "rule": 0.10}
FULL_SCORE, MEDIUM, STRONG = 4.0, 0.35, 0.75
EVIDENCE = "array<struct<source:string,domain:string,score:double>>"


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once: an expression named twice would be copied into the plan twice."""
    return F.transform(F.array(value), use)[0]


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def best_domain(scored: Column) -> Column:
    """Of array<struct<domain, score>> the one with the highest score, ties by name; null where none is positive."""
    key = F.transform(F.filter(scored, lambda s: s["score"] > 0), lambda s: F.struct((-s["score"]).alias("score"), s["domain"].alias("domain")))
    return let(F.array_min(key), lambda b: F.when(b.isNotNull(), F.struct(b["domain"].alias("domain"), (-b["score"]).alias("score"))))


def budget(confidence: Column) -> Column:
    pick = lambda strong, medium, general: F.when(confidence >= STRONG, strong).when(confidence >= MEDIUM, medium).otherwise(general)
    return F.struct(pick(65, 50, 0).alias("domain_percent"), pick(25, 30, 30).alias("project_tool_percent"), pick(10, 20, 70).alias("general_percent"))


def input_text(query: Column, tool: Column | None = None, metadata: Column | None = None) -> Column:
    empty = F.lit("")
    return normalized_text(F.concat_ws(" ", or_empty(query), or_empty(tool) if tool is not None else empty, metadata_text(metadata) if metadata is not None else empty))


def _count(text: Column, terms: list[str]) -> Column:
    return sum((F.when(text.contains(t), 1).otherwise(0) for t in terms), F.lit(0))


def rule_scores(text: Column, extension: Column | None = None) -> Column:
    ext = normalize_extension(extension) if extension is not None else F.lit("")
    score = lambda words, exts: (_count(text, words) + (F.when(ext.isin(exts), 1.5).otherwise(0.0) if exts else F.lit(0.0))).cast("double")
    return F.array(*(F.struct(F.lit(d).alias("domain"), score(w, e).alias("score")) for d, w, e in RULES))


def classify(text: Column, extension: Column | None = None) -> Column:
    """struct<domain, confidence, experience_kind, budget> by rules alone."""

    def of(best: Column) -> Column:
        confidence = F.when(best.isNotNull(), F.least(best["score"] / FULL_SCORE, F.lit(1.0))).otherwise(0.0)
        sure = confidence >= MEDIUM
        return F.struct(
            F.when(sure, best["domain"]).otherwise("").alias("domain"), F.when(sure, confidence).otherwise(0.0).alias("confidence"),
            F.when(sure, "domain").otherwise("general").alias("experience_kind"), budget(F.when(sure, confidence).otherwise(0.0)).alias("budget"),
        )

    return let(text, lambda t: let(best_domain(rule_scores(t, extension)), of))


def explicit_signal(metadata: Column | None, extension: Column | None) -> Column:
    out = []
    if metadata is not None:
        d = normalize_domain(or_empty(metadata["domain_path"]))
        out.append(F.when(d.isNotNull(), F.struct(F.lit("explicit").alias("source"), d.alias("domain"), F.lit(1.0).alias("score"))))
    if extension is not None:
        ext = normalize_extension(extension)
        names = F.create_map(*(F.lit(x) for k, (d, _) in EXPLICIT.items() for x in (k, d)))
        values = F.create_map(*(F.lit(x) for k, (_, v) in EXPLICIT.items() for x in (k, v)))
        out.append(F.when(names[ext].isNotNull(), F.struct(F.lit("explicit").alias("source"), names[ext].alias("domain"), values[ext].alias("score"))))
    return F.filter(F.array(*out), lambda e: e.isNotNull()) if out else F.array().cast(EVIDENCE)


def profiles_of(profiles: DataFrame, limit: int = 1000) -> list[tuple[str, list[str]]]:
    """Profiles from a table of domain, description, aliases and examples. They become expressions, so more than ``limit`` are an error."""
    rows = profiles.select("domain", "description", "aliases", "examples").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} profiles")
    return [(r["domain"], [x for x in (r["domain"], r["description"], *(r["aliases"] or ()), *(r["examples"] or ())) if x]) for r in sorted(rows, key=lambda r: r["domain"])]


def profile_signal(text: Column, profiles: list[tuple[str, list[str]]] = PROFILES) -> Column:
    of = [F.struct(F.lit("profile").alias("source"), F.lit(d).alias("domain"), clamp01(_count(text, [x.strip().lower() for x in terms if x.strip()]) / 3.0).alias("score")) for d, terms in profiles]
    return F.filter(F.array(*of), lambda e: e["score"] > 0)


def memory_signal(domains: Column) -> Column:
    """Share of each domain in a list of memories' domains; blanks count in the denominator alone."""
    some = F.array_distinct(F.filter(domains, lambda d: d.isNotNull() & (d != "")))
    share = lambda d: F.size(F.filter(domains, lambda x: x == d)) / F.size(domains)
    return F.coalesce(F.transform(some, lambda d: F.struct(F.lit("memory").alias("source"), d.alias("domain"), share(d).alias("score"))), F.array().cast(EVIDENCE))


def rule_signal(text: Column, extension: Column | None) -> Column:
    found = let(classify(text, extension), lambda r: F.struct(F.lit("rule").alias("source"), r["domain"].alias("domain"), r["confidence"].alias("score")))
    return F.filter(F.array(found), lambda e: (e["domain"] != "") & (e["score"] > 0))


def decide(evidence: Column, weights: dict[str, float] = WEIGHTS) -> Column:
    """struct<domain, parent_domain, confidence, experience_kind, budget, evidence> from array<struct<source, domain, score>>.

    Scores are clamped, weighted by their source (1 where ``weights`` lacks it) and summed per domain.
    """
    table = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)) if weights else F.create_map().cast("map<string,double>")

    def scored(live: Column) -> Column:
        total = lambda d: F.aggregate(F.filter(live, lambda e: e["domain"] == d), F.lit(0.0), lambda s, e: s + e["score"] * F.coalesce(table[e["source"]], F.lit(1.0)))
        names = F.array_distinct(F.transform(live, lambda e: e["domain"]))
        return best_domain(F.transform(names, lambda d: F.struct(d.alias("domain"), F.round(total(d), 12).alias("score"))))

    def of(live: Column, best: Column) -> Column:
        confidence = F.when(best.isNotNull(), clamp01(best["score"])).otherwise(0.0)
        sure = confidence >= MEDIUM
        order = F.transform(F.filter(live, lambda e: e["domain"] == best["domain"]), lambda e, i: F.struct((-e["score"]).alias("k"), i.alias("i"), e.alias("e")))
        top = F.transform(F.slice(F.array_sort(order), 1, 8), lambda x: x["e"])
        return F.struct(
            F.when(sure, best["domain"]).otherwise("").alias("domain"), F.when(sure & best["domain"].contains("/"), F.split(best["domain"], "/")[0]).otherwise("").alias("parent_domain"),
            F.when(sure, confidence).otherwise(0.0).alias("confidence"), F.when(sure, "domain").otherwise("general").alias("experience_kind"),
            budget(F.when(sure, confidence).otherwise(0.0)).alias("budget"), F.when(sure, top).otherwise(live).alias("evidence"),
        )

    live = F.transform(F.filter(evidence, lambda e: (e["domain"] != "") & (e["score"] > 0)), lambda e: F.struct(e["source"].alias("source"), e["domain"].alias("domain"), clamp01(e["score"]).alias("score")))
    return let(live, lambda v: let(scored(v), lambda b: of(v, b)))


Signal = Callable[[Column], Column]


def resolve(query: Column, *, tool: Column | None = None, metadata: Column | None = None, extension: Column | None = None, memory_domains: Column | None = None,
            profiles: list[tuple[str, list[str]]] = PROFILES, signals: list[Signal] | None = None) -> Column:
    """The decision from all four signals, or from ``signals`` of one's own, each of weight 1.

    A signal is a function of the normalised text that gives array<struct<source, domain, score>>.
    """

    def evidence(text: Column) -> Column:
        if signals is not None:
            return F.concat(*(s(text) for s in signals)) if signals else F.array().cast(EVIDENCE)
        parts = [explicit_signal(metadata, extension), profile_signal(text, profiles)]
        if memory_domains is not None:
            parts.append(memory_signal(memory_domains))
        return F.concat(*parts, rule_signal(text, extension))

    return decide(let(input_text(query, tool, metadata), evidence), WEIGHTS if signals is None else {})


def domain_filters(spark, query: str) -> list[str]:
    """Domain and parent that a query is confined to; none where no domain is sure."""
    row = spark.range(1).select(resolve(F.lit(query)).alias("d")).first()["d"]
    return [d for d in (row["domain"], row["parent_domain"]) if d]


def tag(df: DataFrame, content: str = "content", extension: str = "file_extension", metadata: str = "metadata", overwrite: bool = True) -> DataFrame:
    """Rows with the decision in their metadata: overwriting what is there, or only filling blanks."""
    d = resolve(F.col(content), metadata=F.col(metadata), extension=F.col(extension) if extension in df.columns else None)
    df = df.withColumn("_d", d)
    empty = F.create_map().cast("map<string,string>")
    m = F.coalesce(F.col(metadata), empty)
    put = F.create_map(F.lit("domain_path"), F.col("_d.domain"), F.lit("experience_kind"), F.col("_d.experience_kind"))
    put = F.map_filter(put, lambda k, v: (v != "") & (F.lit(True) if overwrite else (or_empty(m[k]) == "")))
    return df.withColumn(metadata, overlay(m, put)).drop("_d")
