from datetime import datetime

from siltstone.plans.core_queries import QUERIES, _evaluated


def test_every_run_is_compared(spark, tmp_path):
    at = datetime(2026, 1, 1)
    rows = [("n", "a", "h1", 1, 1, 1, at), ("n", "b", "h1", 1, 1, 1, at), ("n", "a", "h2", 2, 2, 2, at), ("n", "a", "h2", 2, 3, 4, at), ("n", "c", "h3", 1, 1, 4, at)]
    spark.createDataFrame(rows, "namespace string, relative_path string, hash string, size bigint, mod_time_ns bigint, run_no int, recorded_at timestamp").write.parquet(str(tmp_path / "file_states.parquet"))
    spark.createDataFrame([("x", "n", "c"), ("y", "n", "d")], "id string, namespace string, relative_path string").write.parquet(str(tmp_path / "chunks.parquet"))
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    want = {(2, "n/a", "modified"), (2, "n/b", "removed"), (4, "n/a", "touched"), (4, "n/c", "added")}
    assert {tuple(r) for r in run("file_diff")} == want and len(run("file_diff")) == 4
    assert {tuple(r) for r in run("index_stats")} == {(2, 0, 1, 1, 0, 0, 1), (4, 1, 0, 0, 1, 0, 2)}
    got = run("replace_files")
    assert [r["id"] for r in got if r["origin"] == "old"] == ["y"] and sum(r["origin"] == "new" for r in got) == 3


def test_cases_beyond_240_have_their_hits(spark, tmp_path):
    where = "struct<relative_path:string,start_line:int,end_line:int>"
    hits = [(s, 1, "r", "text", ("a.py", 1, 2)) for s in (1, 241, 10001)]
    spark.createDataFrame(hits, f"search_id int, rank int, result_id string, content string, location {where}").write.parquet(str(tmp_path / "ranked_hits.parquet"))
    e = "array<struct<relative_path:string,start_line:int,end_line:int,content_contains:string>>"
    cases = [(i, i, [("a.py", 1, 2, None)], [], None) for i in ("case-0001", "case-0241", "case-1000", "case-10001")]
    spark.createDataFrame(cases, f"id string, instance_id string, expected {e}, oracle_files array<string>, patch string").write.parquet(str(tmp_path / "eval_cases.parquet"))
    got = {r["case_id"]: r["result_count"] for r in _evaluated(spark, str(tmp_path)).collect()}
    assert got == {"case-0001": 1, "case-0241": 1, "case-1000": 0, "case-10001": 1}


def test_patches_of_several_files(spark, tmp_path):
    patch = "--- a/z.py\n+++ b/z.py\n@@ -1 +1 @@\n--- a/m/a.py\n+++ b/m/a.py\n--- a/z.py\n"
    spark.createDataFrame([("two", patch), ("none", None)], "id string, patch string").write.parquet(str(tmp_path / "eval_cases.parquet"))
    assert {r["id"]: r["files"] for r in QUERIES["patch_oracles"](spark, str(tmp_path)).collect()} == {"two": ["m/a.py", "z.py"], "none": []}
