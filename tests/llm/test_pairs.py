import random

import numpy as np

from siltstone.llm import knn as knn_module
from siltstone.llm.knn import exact_knn, index_shape, knn
from siltstone.llm.neardup import near_duplicates
from siltstone.llm.queries import p2_recall, recall_by_band


def brute_topk(rows, k):
    ok = {i: np.array(v, float) for i, v in rows if v and len(v) == 8 and np.isfinite(v).all() and any(v)}
    out = {}
    for i, a in ok.items():
        s = sorted(((-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9), j) for j, b in ok.items() if j != i))
        out[i] = [(j, -x) for x, j in s[:k]]
    return out


def vectors(n, dim, seed):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n // 4, dim))
    return [(i, (base[i % len(base)] + 0.03 * r.normal(size=dim)).tolist()) for i in range(n)]


def pairs(df, least):
    return {(r["id"], r["neighbour"]) for r in df.collect() if r["similarity"] >= least}


def test_near_vectors_are_found(spark):
    rows = vectors(200, 8, 1) + [(900, None), (901, []), (902, [0.0] * 8), (903, [float("nan")] * 8), (904, [1.0] * 7), (905, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "id int, vector array<double>")
    true = {(i, j) for i, best in brute_topk(rows, 5).items() for j, s in best if s >= 0.92}
    got = pairs(knn(df, dim=8), 0.92)
    assert len(true & got) >= 0.97 * len(true) and len(got - true) <= 0.03 * len(true)
    assert max(r["rank"] for r in knn(df, dim=8).collect()) <= 5


def test_crowded_keys_and_copies(spark):
    r = np.random.default_rng(2)
    one = r.normal(size=8)
    rows = [(i, (one + 0.001 * r.normal(size=8)).tolist()) for i in range(120)] + [(200 + i, one.tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, vector array<double>")
    got = knn(df, dim=8, hot=32).collect()
    assert len(got) == 150 * 5
    copies = {x["id"]: sorted(y["neighbour"] for y in got if y["id"] == x["id"]) for x in got if x["id"] >= 200}
    assert copies[200] == [201, 202, 203, 204, 205] and copies[229] == [200, 201, 202, 203, 204]
    true = brute_topk([(i, v) for i, v in rows if i < 120], 1)
    best = {x["id"]: x["similarity"] for x in got if x["rank"] == 1}
    assert all(best[i] >= true[i][0][1] - 1e-6 for i in range(120))


def test_all_five_are_found_at_any_similarity(spark, monkeypatch):
    monkeypatch.setattr(knn_module, "CELL", 100)
    monkeypatch.setattr(knn_module, "BLOCK", 60)
    x = np.random.default_rng(4).normal(size=(700, 64))  # nothing is near: the best lie at about 0.4
    for kind in ("float", "double"):
        got = {(r["id"], r["neighbour"]) for r in knn(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"id int, vector array<{kind}>")).collect()}
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        s = u @ u.T - 3 * np.eye(len(u))
        assert got == {(i, int(j)) for i, row in enumerate(s) for j in np.argsort(-row)[:5]}


def test_hashing_of_crowded_keys(spark):
    r = np.random.default_rng(2)
    one = r.normal(size=8)
    df = spark.createDataFrame([(i, (one + 0.001 * r.normal(size=8)).tolist()) for i in range(120)], "id int, vector array<double>")
    assert knn(df, dim=8, hot=32, min_similarity=0.9).count() == 120 * 5


def test_the_size_of_a_crowd_changes_no_row(spark):
    rows = vectors(400, 8, 8)
    r = np.random.default_rng(3)
    rows += [(1000 + i, (np.array(rows[0][1]) + 0.01 * r.normal(size=8)).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, vector array<double>")
    few, many = ({(x["id"], x["neighbour"], x["rank"]) for x in knn(df, dim=8, hot=h, min_similarity=0.92).collect()} for h in (32, 10**9))
    assert few == many and len(few) > 1000


def test_index_shape_follows_the_number_of_vectors():
    shapes = [index_shape(n, 0.92) for n in (900, 90_000, 90_000_000)]
    assert [s[0] for s in shapes] == [10, 16, 26] and all(64 // w * r * (1 - np.arccos(0.92) / np.pi) ** w >= np.log(1 / 0.12) for w, r, _ in shapes)
    assert shapes[2][1] * (64 // 26) < 90 and shapes[0][2] <= 21


def test_far_blocks_do_not_meet(spark, monkeypatch):
    monkeypatch.setattr(knn_module, "CELL", 40)
    monkeypatch.setattr(knn_module, "BLOCK", 50)
    rows = vectors(400, 8, 12)
    got = {(r["id"], r["neighbour"]) for r in knn(spark.createDataFrame(rows, "id int, vector array<double>"), dim=8).collect()}
    assert got == {(i, j) for i, best in brute_topk(rows, 5).items() for j, _ in best}


def test_recall_counts_far_neighbours(spark):
    true = spark.createDataFrame([(1, 2, 0.95), (1, 3, 0.55), (1, 4, 0.51), (1, 5, 0.3)], "id int, neighbour int, similarity double")
    found = spark.createDataFrame([(1, 2), (1, 4), (1, 9)], "id int, neighbour int")
    got = {r["band"]: (r["n_true"], r["n_found"], r["recall"]) for r in recall_by_band(true, found, "x").collect()}
    assert got == {"all": (4, 2, 0.5), ">= 0.92": (1, 1, 1.0), ">= 0.5": (2, 1, 0.5), "< 0.5": (1, 0, 0.0)}


def test_recall_query_measures_all_five(spark, tmp_path):
    r = np.random.default_rng(6)
    rows = [(f"chunk_{i:016x}", r.normal(size=64).tolist()) for i in range(200)]
    spark.createDataFrame(rows, "id string, vector array<float>").write.parquet(str(tmp_path / "chunks.parquet"))
    got = {(x["search"], x["band"]): x for x in p2_recall(spark, str(tmp_path)).collect()}
    assert got["top5", "all"]["n_true"] == got["top5", "all"]["n_found"] == 10 * 5


def test_empty_vectors(spark):
    assert knn(spark.createDataFrame([], "id int, vector array<float>")).count() == 0
    assert knn(spark.createDataFrame([(1, None)], "id int, vector array<float>")).count() == 0
    base = spark.createDataFrame(vectors(50, 64, 3), "id int, v array<double>")
    assert exact_knn(base.where("id % 20 = 0"), base).count() == 15


def jaccard(a, b, w):
    import re

    s = [{tuple(x[i : i + w]) for i in range(len(x) - w + 1)} for x in (re.findall(r"[^\W_]+", t.lower()) for t in (a, b))]
    return len(s[0] & s[1]) / len(s[0] | s[1]) if s[0] and s[1] else 0


def test_near_duplicates_match_brute_force(spark):
    r = random.Random(7)
    rows = []
    for g in range(25):
        words = [f"w{r.randint(0, 400)}" for _ in range(r.randint(10, 80))]
        for k in range(4):
            w = list(words)
            for _ in range(k):
                w[r.randrange(len(w))] = f"e{r.randint(0, 99)}"
            rows.append((len(rows), r.choice([" ", ", ", "\n"]).join(w)))
    rows += [(500, None), (501, "  "), (502, "two words"), (503, rows[0][1].upper()), (503, rows[0][1].upper()), (None, "a b c d"), (504, "x y z " * 2000)]
    df = spark.createDataFrame(rows, "id int, content string")
    for t, w in ((0.7, 3), (0.8, 5)):
        d = near_duplicates(df, threshold=t, width=w)
        got = [(p["id_a"], p["id_b"]) for p in d.pairs().collect()]
        live = [(i, c) for i, c in dict((i, c) for i, c in rows if i is not None and c).items()]
        true = {(a, b) for a, x in live for b, y in live if a < b and jaccard(x, y, w) >= t}
        assert len(got) == len(set(got)) and set(got) == true
        groups = {g["doc_id"]: g for g in d.groups().collect()}
        assert groups[503]["class_id"] == 0 and groups[503]["n_links"] == sum(1 for a, b in true if 0 in (a, b) and 503 not in (a, b))
    assert near_duplicates(df.limit(0), threshold=0.7, width=3).pairs().count() == 0


def test_a_hot_group_loses_no_link(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[:30] + [f"edit{i}"] + words[30:])) for i in range(40)]
    got = near_duplicates(spark.createDataFrame(rows, "id int, content string"), threshold=0.7, width=3).pairs()
    assert got.count() == 40 * 39 // 2


def test_crowded_blocks_give_the_same_links(spark):
    """Texts of many lengths that all begin alike: their blocks are crowded, and few of them are linked."""
    r = random.Random(8)
    head = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(150):
        tail = [f"t{r.randint(0, 9999)}" for _ in range(r.choice([3, 10, 25, 60]))]
        rows.append((2 * i, " ".join(head + tail)))
        tail[r.randrange(len(tail))] = "edit"
        rows.append((2 * i + 1, " ".join(head + tail)))
    df = spark.createDataFrame(rows, "id int, content string")
    for t, w in ((0.7, 3), (0.8, 5)):
        links = lambda crowd: {(p["id_a"], p["id_b"]) for p in near_duplicates(df, threshold=t, width=w, crowd=crowd).pairs().collect()}
        whole, split = links(10**9), links(20)
        assert whole == split == {(a, b) for a, x in rows for b, y in rows if a < b and jaccard(x, y, w) >= t}


def test_a_block_of_twenty_thousand_texts(spark):
    """No task does more than a few times the middle one's work, and no link is lost."""
    from siltstone.llm import neardup

    r = np.random.default_rng(5)
    n = 20_000
    sets = [np.unique(r.integers(0, 2**63, 60, dtype=np.uint64)) for _ in range(n // 2)]
    sets += [np.append(s[:-1], np.uint64(7 + i)) for i, s in enumerate(sets)]  # one shingle of about 60 differs
    rows = spark.createDataFrame([(i, len(s), 1) for i, s in enumerate(sets)], "rep bigint, n int, block bigint")
    odd = spark.createDataFrame([(i, neardup._odd(s)) for i, s in enumerate(sets)], "rep bigint, odd binary")
    got = {(x["a"], x["b"]) for x in neardup._crowded(rows, odd, 0.7, neardup.CROWD).collect()}
    assert got >= {(i, i + n // 2) for i in range(n // 2)} and len(got) < n
