import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import scoring
from siltstone.operators import indexing, search
from siltstone.operators.chunking import body_windows, markdown_boundary
from siltstone.operators.sessions import fold
from siltstone.schema import CHUNKS
from siltstone.sources.store import remote_rows
from siltstone.streaming.sync import batch_writer


def rows(seed, n=60):
    r = random.Random(seed)
    words = ["retry", "queue", "token", "index", "orderRepo", "x"]
    return [(f"id{i:03}", r.choice(["n1", "n2"]), [r.gauss(0, 1), r.gauss(0, 1)], " ".join(r.choices(words, k=r.randint(0, 9))), f"p{r.randint(0, 5)}.go", r.randint(1, 3), 9, ".go", "go", {"symbol_name": r.choice(words)}) for i in range(n)]


def test_input_order_does_not_matter_and_scores_are_bounded(spark):
    data = rows(1)
    options = search.SearchOptions(query="retry the queue", limit=0, profile="code", semantic=0.3, keyword=0.7, fusion="rrf")
    out = []
    for order in (data, data[::-1], random.Random(5).sample(data, len(data))):
        got = search.score(spark.createDataFrame(order, CHUNKS), [1.0, 0.5], options)
        out.append({(x["id"], round(x["score"], 9)) for x in got.collect()})
        assert all(0 <= x["keyword_score"] < 1 for x in got.select("keyword_score").collect())
    assert out[0] == out[1] == out[2]


def test_empty_candidates_and_queries_without_tokens(spark):
    none = spark.createDataFrame([], CHUNKS)
    assert search.score(none, [1.0], search.SearchOptions(query="retry")).count() == 0
    got = search.search_namespace(spark.createDataFrame(rows(2), CHUNKS), "n1", [1.0, 0.0], search.SearchOptions(query="x", limit=3))
    assert got.count() == 3 and got.agg(F.max("keyword_score")).first()[0] == 0


def test_replacing_files_equals_a_full_rebuild(spark):
    old, new = rows(3, 30), rows(4, 30)
    changed = {"p1.go", "p3.go"}
    before = spark.createDataFrame(old, CHUNKS)
    fresh = spark.createDataFrame([x for x in new if x[4] in changed], CHUNKS)
    paths = spark.createDataFrame([(p,) for p in changed], "relative_path string")
    got = indexing.replace_files(before, paths, fresh).select("id", "relative_path", "content")
    want = [x for x in old if x[4] not in changed] + [x for x in new if x[4] in changed]
    assert sorted(tuple(x) for x in got.collect()) == sorted((x[0], x[4], x[3]) for x in want)


def test_remote_rows_fit_their_columns(spark):
    row = ("i" * 200, "n", [1.0], "漢" * 30_000, "p", 1, 1, ".go", "go", {"symbol_name": "é" * 400})
    got = remote_rows(spark.createDataFrame([row], CHUNKS)).first()
    assert len(got["id"]) == 128 and len(got["content"].encode()) == 65535 and len(got["symbol_name"].encode()) == 512


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    write = batch_writer(str(tmp_path / "o"))
    for _ in range(2):
        write(spark.range(5), 7)
    assert spark.read.parquet(str(tmp_path / "o")).count() == 5


@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 4)), max_size=20), st.integers(0, 6))
def test_folding_twice_returns_nothing_new(hits, limit):
    keys, hashes = set(), set()
    k, h = [f"k{a}" for a, _ in hits], [f"h{b}" for _, b in hits]
    at, dropped = fold(k, h, limit, keys, hashes)
    assert len(set(k[i] for i in at)) == len(at) and dropped <= len(hits)
    again, _ = fold([k[i] for i in at], [h[i] for i in at], limit, keys, hashes)
    assert again == []


@settings(max_examples=200)
@given(st.lists(st.sampled_from(["a", "", "```", "| x |", "# t"]), max_size=30), st.integers(1, 7), st.integers(-1, 9))
def test_windows_cover_every_line(lines, size, overlap):
    text = "\n".join(lines)
    got = body_windows(text, 1, size, overlap, markdown_boundary)
    covered = {n for _, a, b in got for n in range(a, b + 1)}
    assert {i for i, x in enumerate(text.split("\n"), 1) if x.strip()} <= covered


@given(st.floats(-2, 2), st.floats(-2, 2))
def test_weights_sum_to_one(s, k):
    a, b = scoring.normalize_weights(s, k)
    assert a >= 0 and b >= 0 and abs(a + b - 1) < 1e-9
