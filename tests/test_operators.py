import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import chunking, domain, evaluation, indexing, markdown, search, sessions
from siltstone.schema import CHUNKS, METADATA
from siltstone.sources.files import matches_any


def chunk(i, vector, content="", path="", metadata=None, start=1, end=1):
    return (i, "n", vector, content, path, start, end, path[path.rfind(".") :] if "." in path else "", "go", metadata or {})


def table(spark, rows):
    return spark.createDataFrame(rows, CHUNKS)


def hits(spark, rows, query, vector, limit=10, **more):
    return [r["id"] for r in search.search_namespace(table(spark, rows), "n", vector, search.SearchOptions(query=query, limit=limit, **more)).collect()]


def test_filters(spark):
    rows = [chunk("a", [1.0, 0.0], metadata={"domain_path": "programming/go"}), chunk("b", [1.0, 0.0], metadata={"domain_path": "database/milvus"}), chunk("c", [1.0, 0.0])]
    assert hits(spark, rows, "", [1.0, 0.0], filters={"domain_path": ("database/milvus", "")}) == ["b"]
    assert hits(spark, rows, "", [1.0, 0.0], limit=0) == ["a", "b", "c"]


def test_keyword_lift_and_fusion(spark):
    rows = [chunk("a", [1.0, 0.0], "plain"), chunk("b", [1.0, 0.0], "plain", "internal/order/repository.go", {"symbol_name": "OrderRepository"})]
    got = search.search_namespace(table(spark, rows), "n", [1.0, 0.0], search.SearchOptions(query="OrderRepository")).collect()
    assert [r["id"] for r in got] == ["b", "a"] and got[0]["score"] > got[1]["score"] and 0 <= got[0]["keyword_score"] < 1
    rows = [chunk("sem", [1.0, 0.0], "other"), chunk("sym", [0.0, 1.0], "x", metadata={"symbol_name": "OrderWriter"})]
    assert hits(spark, rows, "OrderWriter", [1.0, 0.0], semantic=0.6, keyword=0.4, profile="code", fusion="rrf")[0] == "sym"
    rows = [chunk("sem", [1.0, 0.0], "talk"), chunk("key", [0.0, 1.0], "order order order")]
    assert hits(spark, rows, "order", [1.0, 0.0], semantic=0.85, keyword=0.15, profile="conversation")[0] == "sem"


def test_ties_and_odd_vectors(spark):
    rows = [chunk("b", [1.0], path="p", start=2), chunk("a", [1.0], path="p", start=2), chunk("c", [1.0], path="p", start=1), chunk("d", [1.0, 1.0], path="o")]
    assert hits(spark, rows, "", [1.0]) == ["c", "a", "b", "d"]


def test_line_chunks_match_a_plain_loop(spark):
    r = random.Random(2)
    texts = ["", "a\n", "a\r\nb\rc", *("\n".join(r.choice(["x", "", " y"]) for _ in range(r.randint(1, 14))) for _ in range(30))]
    for m, o in ((3, 1), (4, 0), (5, 9)):
        got = chunking.line_chunks(spark.createDataFrame(list(enumerate(texts)), "k int, content string"), max_lines=m, overlap=o).collect()
        want = [(k, *c) for k, t in enumerate(texts) for c in chunking.body_windows(t.replace("\r\n", "\n").replace("\r", "\n"), 1, m, o)]
        assert sorted((x["k"], x["chunk_content"], x["start_line"], x["end_line"]) for x in got) == sorted(want)


def test_syntax_ranges():
    go = "package sample\n\nimport \"fmt\"\n\ntype Service struct{}\n\nfunc NewService() *Service {\n\treturn &Service{}\n}\n\nfunc (s *Service) Run() {\n\tfmt.Println(\"}\")\n}\n"
    assert [r[:4] for r in chunking.syntax_ranges(go, "go")] == [(1, 1, "package", "sample"), (3, 3, "import", ""), (5, 5, "type", "Service"), (7, 9, "function", "NewService"), (11, 13, "method", "Run")]
    cpp = "#include <x>\n\nnamespace demo {\nclass A {\n public:\n  int f() { return 1; }\n};\nint g() {\n  return 2;\n}\n}\n"
    assert [r[:3] for r in chunking.syntax_ranges(cpp, "cpp")] == [(1, 1, "include"), (3, 11, "namespace")]
    assert chunking.syntax_ranges("package a\nfunc broken( {\n", "go") is None


def test_boundaries():
    lines = ["# T", "```", "a", "b", "c", "d", "```", "x"]
    assert chunking.body_windows("\n".join(lines), 1, 4, 0, chunking.markdown_boundary)[0][1:] == (1, 7)
    table_lines = ["t", "", "| a |", "|---|", "| b |", "| c |", "end"]
    assert chunking.body_windows("\n".join(table_lines), 1, 4, 0, chunking.markdown_boundary)[0][2] == 6


def test_markdown_nodes(spark):
    text = "# Guide\n> A summary\n\n## API Usage\ntext\n"
    rows = markdown.parse_markdown(spark.createDataFrame([("go_guide.md", text), ("e.md", " \n"), ("f.md", None)], "relative_path string, content string")).collect()
    assert [(r["kind"], r["start_line"]) for r in rows] == [("title", 1), ("summary", 2), ("body", 1), ("title", 4), ("body", 4)]
    last = rows[-1]
    assert (last["document_id"], last["section_id"], last["heading_path"], last["knowledge_kind"]) == ("go-guide", "guide/api-usage", ["Guide", "API Usage"], "api")
    fenced = markdown.sections("# Real\n```\n# Not\n```\n## Child\n### Deep\n## Next")
    assert [s["path"] for s in fenced] == [["Real"], ["Real", "Child"], ["Real", "Child", "Deep"], ["Real", "Next"]]
    heads = markdown.heading_lines(spark.createDataFrame([("p", "# Real\n```\n# Not\n```\n## Child\nx")], "relative_path string, content string")).collect()
    assert [(h["line"], h["level"], h["heading"], h["next_line"]) for h in heads] == [(1, 1, "Real", 5), (5, 2, "Child", 7)]


def test_domains(spark):
    d = lambda **k: spark.createDataFrame([(1,)], "x int").select(domain.resolve(**k).alias("d")).first()["d"]
    r = d(query=F.lit("x"), metadata=F.create_map(F.lit("domain_path"), F.lit("database/milvus")))
    assert (r["domain"], r["parent_domain"]) == ("database/milvus", "database")
    r = d(query=F.lit("summarize previous discussion"))
    assert r["domain"] == "" and r["experience_kind"] == "general" and r["budget"]["general_percent"] == 70
    assert domain.domain_filters(spark, "milvus collection vector store") == ["database/milvus", "database"]
    only = spark.range(1).select(domain.decide(domain.memory_signal(F.array(F.lit("programming/go"), F.lit("programming/go"), F.lit("database/milvus"))), {}).alias("d")).first()["d"]
    assert only["domain"] == "programming/go"
    c = spark.range(1).select(domain.classify(domain.input_text(F.lit("go test panic in goroutine channel")), F.lit(".go")).alias("c")).first()["c"]
    assert c["domain"] == "programming/go" and c["budget"]["domain_percent"] == 65
    r = d(query=F.lit("view"), extension=F.lit(".ts"))
    assert r["domain"] == ""


def test_session_fold(spark):
    assert sessions.fold(["k1", "k2"], ["h1", "h2"], 10, set(), set()) == ([0, 1], 0)
    keys, hashes = set(), set()
    sessions.fold(["k1", "k2"], ["h", "h"], 10, keys, hashes)
    assert sessions.fold(["k1", "k2"], ["h", "h"], 10, keys, hashes) == ([], 2)
    assert sessions.fold(["a", "b", "a"], ["1", "2", "1"], 1, set(), set()) == ([0], 1)
    assert sessions.fold(["k1", "k1", "k2"], ["h1", "h2", "h2"], 9, set(), set()) == ([0, 2], 1)
    r = random.Random(4)
    rows = [(s, i, f"k{s}-{i}", f"h{r.randint(0, 4)}") for s in range(6) for i in range(8)]
    df = spark.createDataFrame(rows, "session_id int, rank int, result_key string, content_hash string")
    seen = spark.createDataFrame([(0, "hash", "h1"), (1, "key", "k1-3")], "session_id int, kind string, value string")
    a = {(x["session_id"], x["rank"], x["new_rank"]) for x in sessions.dedup_sessions(df, seen, 3).collect()}
    assert a == {(x["session_id"], x["rank"], x["new_rank"]) for x in sessions.dedup_sets(df, seen, 3).collect()}


def test_evaluation(spark):
    result = f"case_id string, rank int, result_id string, content string, location struct<relative_path:string,start_line:int,end_line:int>, metadata {METADATA}"
    exp = f"case_id string, expected_no int, expected struct<relative_path:string,start_line:int,end_line:int,content_contains:string,metadata:{METADATA}>"
    res = spark.createDataFrame([("c", 1, "a", "four", ("x.go", 10, 20), {"k": "v"}), ("c", 2, "b", "other", ("y.go", 1, 2), {}), ("d", 1, "a", "q", ("x.go", 0, 0), {})], result)
    want = spark.createDataFrame([("c", 0, ("/x.go", 15, 16, None, {"k": "v"})), ("c", 1, ("x.go", None, None, "four", None)), ("d", 0, ("x.go", 3, None, None, None)), ("e", 0, ("z", None, None, None, None))], exp)
    rows = {r["case_id"]: r for r in evaluation.evaluate(res, want).collect()}
    c = rows["c"]
    assert (c["precision"], c["recall"], c["mrr"], c["file_precision"], c["file_recall"], c["result_characters"]) == (0.5, 1.0, 1.0, 0.5, 1.0, 9)
    assert c["ndcg"] == pytest.approx(1 / (1 + 1 / 1.584962500721156))  # one result meets both expectations: one gain
    assert rows["d"]["first_hit_rank"] == 0 and rows["e"]["result_count"] == 0
    s = evaluation.summarize(evaluation.evaluate(res, want)).first()
    assert s["case_count"] == 3 and s["passed_count"] == 1
    p = evaluation.nearest_rank(spark.range(1, 22).withColumn("g", F.lit(1)).withColumnRenamed("id", "v"), "v", ["g"]).first()["p"]
    assert p == 20
    assert spark.range(1).select(evaluation.patch_files(F.lit("--- a/x/y.py\n+++ b/x/y.py\n--- a/x/y.py\n"))).first()[0] == ["x/y.py"]


def test_diff_and_replace(spark):
    f = "relative_path string, hash string, size bigint, mod_time_ns bigint"
    old = spark.createDataFrame([("a", "1", 1, 1), ("b", "2", 2, 2), ("t", "5", 1, 1), ("u", "6", 1, 1)], f)
    new = spark.createDataFrame([("a", "9", 1, 7), ("c", "3", 3, 3), ("t", "5", 1, 9), ("u", None, 1, 1)], f)
    assert {(r[0], r[2]) for r in indexing.diff_files(old, new).collect()} == {("a", "modified"), ("b", "removed"), ("c", "added"), ("t", "touched"), ("u", "unchanged")}
    assert indexing.stats(indexing.diff_files(old, new)).first()["files"] == 4
    assert {(r[0], r[2]) for r in indexing.diff_hashes(old, new).collect()} == {("a", "modified"), ("b", "removed"), ("c", "added"), ("t", "unchanged"), ("u", "removed")}
    rows = spark.createDataFrame([("a", 1), ("b", 1)], "relative_path string, v int")
    got = indexing.replace_files(rows, rows.where("relative_path = 'a'").select("relative_path"), spark.createDataFrame([("a", 2)], rows.schema))
    assert {tuple(r) for r in got.collect()} == {("a", 2), ("b", 1)}


def test_globs(spark):
    cases = [("generated/**", "generated/x.go", True), ("generated/**", "a/generated/x", True), ("/generated/**", "a/generated/x", False), ("*.tmp", "a/b.tmp", True), ("a/*.go", "a/x/y.go", True), ("docs", "x/docs/y", True), ("do?s", "docs", True), ("", "x", False), ("/x.go", "a/x.go", False)]
    for pattern, path, want in cases:
        assert spark.range(1).select(matches_any(F.lit(path), [pattern])).first()[0] is want, (pattern, path)
