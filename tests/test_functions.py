import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import ids, text, vectors
from siltstone.functions.scoring import normalize_weights, search_weights, strategy_for
from siltstone.operators.search import SearchOptions, file_filter_text, filter_text, is_type_list, query_tokens, recall_limit, select_types


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_tokens(spark):
    r = one(spark, text.keyword_tokens(F.lit("getHTTPServer foo2Bar a Élan_x 配置 x1")), text.query_tokens(F.lit("go Go test")), text.embed_tokens(F.lit("")), text.embed_tokens(F.lit("Élan a_b")))
    assert r[0] == ["get", "httpserver", "foo2bar", "élan", "配置", "x1"]
    assert r[1] == ["go", "test"] and r[2] == [""] and r[3] == ["lan", "a_b"]
    assert query_tokens("getHTTPServer foo2Bar a Élan_x") == ["get", "httpserver", "foo2bar", "élan"]


def test_truncate_and_paths(spark):
    r = one(spark, text.truncate_utf8(F.lit("你好abc"), 7), text.evaluation_path(F.lit(" /a/b ")), text.slug(F.lit(" Go_Guide  x! ")), text.document_id(F.lit("d/go_guide.md")), text.section_id(F.array(F.lit("Guide"), F.lit(""), F.lit("API Usage"))), text.section_id(F.array().cast("array<string>")))
    assert list(r) == ["你好a", "a/b", "go-guide--x", "go-guide", "guide/api-usage", "root"]


def test_extension_and_domain(spark):
    ext = [text.normalize_extension(F.lit(x)) for x in ("go", ".TSX", "/tmp/Dockerfile", "handler_test.go", "")]
    assert list(one(spark, *ext)) == [".go", ".tsx", "dockerfile", "handler_test.go", ""]
    r = one(spark, text.normalize_domain(F.lit(" Programming / Go ")), text.normalize_domain(F.lit("a/b/c")), text.domain_matches(F.lit("a/b"), F.lit("A")), text.domain_parent(F.lit("a/b")), text.domain_depth(F.lit("a")))
    assert list(r) == ["programming/go", None, True, "a", 1]
    with pytest.raises(Exception):
        one(spark, text.normalize_domain(F.lit("a/b/c"), strict=True))


def test_kind_language_sizes(spark):
    r = one(spark, text.knowledge_kind(F.lit("An API error")), text.knowledge_kind(F.lit("例子")), text.knowledge_kind(F.lit("x")), text.language_of(F.lit(".H")), text.language_of(F.lit(".rs")), text.estimated_tokens(F.lit(" abcde ")), text.first_filled(F.lit(""), F.lit(None), F.lit("z")))
    assert list(r) == ["troubleshooting", "example", "concept", "cpp", "text", 2, "z"]


def test_ids(spark):
    r = one(spark, ids.code_namespace(F.lit("/a")), ids.source_namespace(*(F.lit(x) for x in "abcd")), ids.content_hash(F.lit(" a \n b ")), ids.stable_id("", F.lit("x")), ids.chunk_id(F.lit("p"), F.lit(1), F.lit(2), F.lit("c")))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert r[0] == "code_chunks_" + hashlib.md5(b"/a").hexdigest()[:8]
    assert r[1] == "source_c_" + sha("a\0b\0c\0d")[:16]
    assert r[2] == "sha256:" + sha("a b") and r[3] == "doc_" + sha("x")[:16] and r[4] == "chunk_" + sha("p:1:2:c")[:16]


def test_vectors(spark):
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<float>")
    r = one(spark, vectors.cosine(a(1.0, 0.0), a(1.0, 1.0)), vectors.cosine(a(1.0), a(1.0, 2.0)), vectors.cosine(a(0.0, 0.0), a(1.0, 1.0)), vectors.cosine_to(a(3.0, 4.0), [3.0, 4.0]), vectors.cosine(F.lit(None).cast("array<float>"), a(1.0)), vectors.cosine_to(a(float("nan"), 1.0), [1.0, 1.0]))
    assert [round(x, 6) for x in r] == [0.707107, 0, 0, 1, 0, 0]
    v = spark.createDataFrame([("go test go",), ("",), (None,)], "t string").select(vectors.hash_embedding(F.col("t"), 64).alias("v"), vectors.sparse_embedding(F.col("t"), 64).alias("s")).collect()
    for row in v:
        dense = np.zeros(64)
        for p in row["s"]:
            dense[p["index"]] += p["value"]
        assert np.allclose(row["v"], dense / np.linalg.norm(dense), atol=1e-6)
    assert np.allclose(vectors.embed_query("go test go", 64), v[0]["v"])


def test_weights_and_options():
    assert normalize_weights(2, 1) == (2 / 3, 1 / 3) and normalize_weights(-1, 0) == (0.75, 0.25)
    assert search_weights(" ", 0.2, 0.8) == (1.0, 0.0)
    assert strategy_for("codebase").fusion == "rrf" and strategy_for("external_knowledge").profile == "knowledge" and strategy_for("preference").keyword == 0.45
    assert recall_limit(5, "order writer") == 15 and recall_limit(5, "") == 5
    assert select_types("docs|fact")[1] == {"document", "external_knowledge", "fact"} and select_types(None)[0] == ["all"] and is_type_list("code, chat") and not is_type_list("code,x")
    with pytest.raises(ValueError):
        select_types("nope")
    assert filter_text("code_chunks_abc123", SearchOptions(extensions=(".go", ".md"))) == 'namespace == "code_chunks_abc123" and file_extension in [".go", ".md"]'
    for bad in (lambda: filter_text('a" or 1', SearchOptions()), lambda: filter_text("a", SearchOptions(extensions=('.g"',))), lambda: filter_text("a", SearchOptions(filters={"version": ('v"1',)})), lambda: file_filter_text("a", [])):
        with pytest.raises(ValueError):
            bad()
