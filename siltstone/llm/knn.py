"""Most similar vectors: near ones by multi-index hashing, all true neighbours by an exact blocked search.

From a least similarity of ``NEAR`` on, hashing serves. Rotations are learned on a bounded sample (iterative quantisation:
rotate so that signs lose least), each gives a code of 64 bits, cut into substrings; every substring is an index of its own.
A substring has about log2 n bits, so that a key is shared by a few rows whatever n is. By the pigeonhole principle codes
that differ in fewer bits than there are substrings agree on one; vectors at the least similarity differ in more, and agree
on a given substring with the probability (1 - angle / pi) to the power of its bits. There are as many rotations as it takes
for such a pair to miss every index with a probability of at most ``MISS`` (0.12 at the least similarity itself, soon below
0.001 above it), about n ** 0.2 of them. Pairs within a Hamming radius of the first code are reranked by their floats.

Without a threshold neighbours lie at any similarity (in the test data mostly near 0.5, where codes agree on nothing), so
every vector meets every other once, in blocks. Blocks are cells of a clustering: a vector's best within its own block give a
floor, two blocks too far apart for any pair above a floor don't meet, and of the others only pairs above a floor are kept.
The time grows with the square of the distinct vectors where they have no structure.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.runtime import materialise

BITS, MISS, SAMPLE, HOT = 64, 0.12, 4096, 2048
#: Least similarity from which hashing finds nearly all; rows of a cell and a block, most cells.
NEAR, CELL, BLOCK, CELLS = 0.9, 2048, 4096, 512


def valid_vector(v: Column, dim: int) -> Column:
    """Of length ``dim``, every number finite, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(rows) -> np.ndarray:
    x = np.stack([np.asarray(r, np.float64) for r in rows])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def index_shape(n: int, min_similarity: float, miss: float = MISS) -> tuple[int, int, int]:
    """Bits of a substring, number of rotations and Hamming radius in one code for ``n`` vectors."""
    apart = math.acos(max(-1.0, min(1.0, min_similarity))) / math.pi
    width = min(30, max(8, round(math.log2(max(2, n)))))
    tables = math.log(1 / miss) / (1 - apart) ** width
    radius = math.ceil(BITS * apart + 4.5 * math.sqrt(BITS * apart * (1 - apart)))
    return width, max(1, math.ceil(tables / (BITS // width))), radius


def learn_rotations(x: np.ndarray, rotations: int, bits: int = BITS, rounds: int = 25, seed: int = 5) -> np.ndarray:
    """Projection matrix (dim x rotations*bits) fitted by iterative quantisation on unit vectors.

    Not centred: differing bits then follow the angle, also where all vectors lie in one narrow cone.
    """
    dim, rng = x.shape[1], np.random.default_rng(seed)
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1]
    out = []
    for _ in range(rotations):
        base = axes[:, np.arange(bits) % dim]
        y, r = x @ base, np.linalg.qr(rng.normal(size=(bits, bits)))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(y @ r >= 0, 1.0, -1.0).T @ y)
            r = (u @ vt).T
        out.append(base @ r)
    return np.hstack(out)


def sampled(df: DataFrame, vector: str, sample: int = SAMPLE) -> np.ndarray:
    """Unit vectors of at most ``sample`` rows, those with the smallest hash, to learn on."""
    v = df.select(F.col(vector).alias("v"), F.xxhash64(vector).alias("x"))
    parts = max(1, v.count() // (2 * sample))  # so that the tasks together send about twice the sample
    rows = v.where(F.pmod("x", F.lit(parts)) == 0).orderBy(F.xxhash64("x")).limit(sample).toPandas()["v"].tolist()
    if not rows:
        raise ValueError("no valid vector")
    return _unit(rows)


def centres(x: np.ndarray, cells: int, rounds: int = 15, seed: int = 5) -> np.ndarray:
    """Unit centres of at most ``cells`` clusters of unit vectors."""
    out = x[np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = (x @ out.T).argmax(1)
        for j in range(len(out)):
            m = x[own == j].sum(0)
            if l := np.linalg.norm(m):
                out[j] = m / l
    return out


def knn(df: DataFrame, id_col: str = "id", vector: str = "vector", *, k: int = 5, dim: int = 64, sample: int = SAMPLE, min_similarity: float = -1.0, hot: int = HOT) -> DataFrame:
    """id, neighbour, similarity, rank: for each vector its ``k`` most similar ones of at least ``min_similarity``.

    Exact below a ``min_similarity`` of ``NEAR``; from there on by hashing (see the module).

    Null, empty, zero, non-finite vectors and those of another length take no part; an input without a valid vector gives
    no rows. Ties go to the smaller id. Equal vectors form a class that is searched once; a member's copies come first. Keys
    shared by more than ``hot`` rows are searched in pairs of blocks of that size within the same radius, each row keeping its
    best ``k`` per pair of blocks, so that ``hot`` never changes the rows. A row repeated under one id counts once.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & valid_vector(F.col("v"), dim))
    rows = rows.withColumn("c", F.xxhash64("v"))
    try:
        some = sampled(rows, "v", sample)
    except ValueError:
        return df.sparkSession.createDataFrame([], f"id {dict(df.dtypes)[id_col]}, neighbour {dict(df.dtypes)[id_col]}, similarity double, rank int")
    # One row for each distinct vector with its smallest ids; more of them can't be among anyone's k.
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy("id"))).where(F.col("r") <= k + 1)
    heads = materialise(ranked.groupBy("c").agg(F.min_by("v", "id").alias("v"), F.array_sort(F.collect_set("id")).alias("ids")))
    if min_similarity < NEAR:
        other = _exact_pairs(heads, some, k, "<f4" if dict(df.dtypes)[vector] == "array<float>" else "<f8").where(F.col("s") >= min_similarity)
    else:
        other = _hashed_pairs(heads, some, k, hot, min_similarity)
    ids = heads.select(F.col("c").alias("o"), "ids")
    target = other.join(ids, "o").unionByName(heads.where(F.size("ids") > 1).select(F.lit(None).cast("bigint").alias("o"), "c", F.lit(1.0).alias("s"), "ids").select("o", "c", "s", "ids"))
    target = target.select("c", "s", F.explode("ids").alias("neighbour"))
    best = target.withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("s"), "neighbour"))).where(F.col("r") <= k + 1)
    mine = rows.select("id", "c").distinct().join(best, "c").where("id <> neighbour")
    w = Window.partitionBy("id").orderBy(F.desc("s"), "neighbour")
    return mine.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("id", "neighbour", F.col("s").alias("similarity"), "rank")


def _hashed_pairs(heads: DataFrame, some: np.ndarray, k: int, hot: int, min_similarity: float) -> DataFrame:
    """c, o, s in both directions: pairs that share a substring of a code, with their similarity."""
    width, rotations, radius = index_shape(heads.count(), min_similarity)
    projection = learn_rotations(some, rotations)

    @F.pandas_udf("array<bigint>")
    def encode(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        bits = np.packbits((_unit(v) @ projection) >= 0, axis=1, bitorder="little")
        return pd.Series(list(bits.view("<i8")))

    # The codes are kept, not the index: it is many times as long and made from them in the JVM.
    codes = materialise(heads.select("c", encode("v").alias("h")))
    mask, per = F.lit((1 << width) - 1).cast("bigint"), BITS // width
    keys = [F.shiftrightunsigned(F.col("h")[i], width * j).bitwiseAND(mask) + F.lit((i * per + j) << width) for i in range(rotations) for j in range(per)]
    index = codes.select("c", F.col("h")[0].alias("code"), F.explode(F.array(*keys)).alias("key"))
    crowd = index.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    shared, busy = crowd.where((F.col("n") > 1) & (F.col("n") <= hot)).select("key"), crowd.where(F.col("n") > hot)
    cold = index.join(shared, "key", "left_semi")
    apart = F.bit_count(F.col("a.code").bitwiseXOR(F.col("b.code")))
    near = cold.alias("a").join(cold.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.c") < F.col("b.c")) & (apart <= radius)).select(F.col("a.c").alias("a"), F.col("b.c").alias("b"))
    near = near.unionByName(_hot_pairs(index, busy, heads, k, radius, hot)).distinct()
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    unit = heads.select("c", "v", norm(F.col("v")).alias("l"))
    both = near.join(unit.select(F.col("c").alias("a"), F.col("v").alias("va"), F.col("l").alias("la")), "a").join(unit.select(F.col("c").alias("b"), F.col("v").alias("vb"), F.col("l").alias("lb")), "b")
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    both = both.select("a", "b", F.least(dot / (F.col("la") * F.col("lb")), F.lit(1.0)).alias("s")).where(F.col("s") >= min_similarity)
    return both.select(F.col("a").alias("c"), F.col("b").alias("o"), "s").unionByName(both.select(F.col("b").alias("c"), F.col("a").alias("o"), "s"))


def _above(s: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of at least the row's floor; of a crowd the row's ``k + 16`` best."""
    m = s >= floor[:, None]
    if np.count_nonzero(m) > len(s) * (k + 16) and s.shape[1] > k + 16:
        top = np.argpartition(-s, k + 15, axis=1)[:, : k + 16]
        few = np.zeros_like(m)
        np.put_along_axis(few, top, np.take_along_axis(m, top, 1), 1)
        m = few
    return np.divmod(np.flatnonzero(m), s.shape[1])


def _exact_pairs(heads: DataFrame, some: np.ndarray, k: int, kind: str) -> DataFrame:
    """c, o, s: for each distinct vector its best ``k`` others (more where equal), every vector compared with every other."""
    spark, slack = heads.sparkSession, 2e-6  # more than single precision loses in a product
    middle = centres(some, min(CELLS, -(-heads.count() // CELL)))

    def cells(v: pd.Series) -> np.ndarray:
        return (_unit(v) @ middle.T).argmax(1)

    cell = F.pandas_udf(lambda v: pd.Series(cells(v) if len(v) else [], dtype="int32"), "int")
    sizes = heads.groupBy(cell("v").alias("cell")).count().toPandas()  # at most CELLS rows
    blocks = np.ones(len(middle), np.int64)
    blocks[sizes["cell"]] = -(-sizes["count"] // BLOCK)
    first, total = np.cumsum(blocks) - blocks, int(blocks.sum())

    def place(batches):
        for pdf in batches:
            if len(pdf):
                own = cells(pdf["v"])
                x = [np.asarray(v).astype(kind).tobytes() for v in pdf["v"]]
                yield pd.DataFrame({"c": pdf["c"], "block": first[own] + pdf["c"].to_numpy() % blocks[own], "x": x})

    def vectors(raw: bytes, n: int) -> np.ndarray:
        return _unit(np.frombuffer(raw, kind).reshape(n, -1))

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        c, raw = pdf["c"].to_numpy(), b"".join(pdf["x"])
        u = vectors(raw, len(c))
        f, floor, found = u.astype(np.float32), np.full(len(c), -2.0, np.float32), []
        for at in range(0, len(c), 512):
            s = f[at : at + 512] @ f.T
            s[np.arange(len(s)), np.arange(at, at + len(s))] = -3
            if len(c) > k:
                floor[at : at + 512] = -np.partition(-s, k - 1, axis=1)[:, k - 1] - slack
            i, j = _above(s, floor[at : at + 512], k)
            found.append((c[at + i], c[j], np.einsum("ij,ij->i", u[at + i], u[j])))
        a, b, s = (np.concatenate(x) for x in zip(*found))
        mid = u.sum(0)
        mid = mid / l if (l := np.linalg.norm(mid)) else u[0]
        wide = float(np.arccos(np.clip(u @ mid, -1, 1)).max())
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "cs": [c.tobytes()], "xs": [raw], "floors": [floor.tobytes()], "mid": [mid], "wide": [wide], "least": [float(floor.min())], "a": [a], "b": [b], "s": [s]})

    parts = min(total, max(2 * spark.sparkContext.defaultParallelism, total // 4))
    packs = heads.select("c", "v").mapInPandas(place, "c bigint, block int, x binary").repartition(parts, "block")
    packs = materialise(packs.groupBy("block").applyInPandas(own, "block int, cs binary, xs binary, floors binary, mid array<double>, wide double, least double, a array<bigint>, b array<bigint>, s array<double>"))
    near = packs.select(F.inline(F.arrays_zip("a", "b", "s"))).toDF("c", "o", "s")

    def meet(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                ca, cb = np.frombuffer(r.ca, np.int64), np.frombuffer(r.cb, np.int64)
                fa, fb = np.frombuffer(r.fa, np.float32), np.frombuffer(r.fb, np.float32)
                ua, ub = vectors(r.xa, len(ca)), vectors(r.xb, len(cb))
                right = ub.astype(np.float32).T
                for at in range(0, len(ca), 512):
                    s = ua[at : at + 512].astype(np.float32) @ right
                    i, j = _above(s, fa[at : at + 512], k)
                    yield pd.DataFrame({"c": ca[at + i], "o": cb[j], "s": np.einsum("ij,ij->i", ua[at + i], ub[j])})
                    j, i = _above(np.ascontiguousarray(s.T), fb, k)
                    yield pd.DataFrame({"c": cb[j], "o": ca[at + i], "s": np.einsum("ij,ij->i", ua[at + i], ub[j])})

    side = lambda x: packs.select(*(F.col(a).alias(b + x) for a, b in (("block", "n"), ("cs", "c"), ("xs", "x"), ("floors", "f"), ("mid", "m"), ("wide", "w"), ("least", "l"))))
    # Two blocks meet if their nearest points could lie within the lower floor (triangle inequality of angles).
    clamp = lambda c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))
    angle = F.acos(clamp(F.aggregate(F.zip_with("ma", "mb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)))
    close = angle - F.col("wa") - F.col("wb") <= F.acos(clamp(F.least("la", "lb"))) + 1e-6
    both = side("a").join(side("b").hint("shuffle_replicate_nl"), (F.col("na") < F.col("nb")) & close).drop("ma", "mb", "wa", "wb", "la", "lb")
    pairs = near.unionByName(both.mapInPandas(meet, "c bigint, o bigint, s double")).withColumn("s", F.least("s", F.lit(1.0)))
    return pairs.withColumn("r", F.rank().over(Window.partitionBy("c").orderBy(F.desc("s")))).where(F.col("r") <= k).drop("r")


def _hot_pairs(index: DataFrame, busy: DataFrame, heads: DataFrame, k: int, radius: int, hot: int) -> DataFrame:
    """Candidate pairs under crowded keys: rows salted into blocks, each pair of blocks one unit of work. The radius is that
    of all keys; of a row's partners in a unit only the best ``k`` can be among its best, so no crowd is written out."""
    n = F.ceil(F.col("n") / hot).cast("int")
    rows = index.join(busy, "key").withColumn("blocks", n).withColumn("own", F.pmod(F.xxhash64("c", "key"), F.col("blocks")).cast("int"))
    units = rows.select("key", "c", "code", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    units = units.select("key", "c", "code", "own", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi")).join(heads.select("c", "v"), "c")

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        u, c, own = _unit(pdf["v"]).astype(np.float32), pdf["c"].to_numpy(), pdf["own"].to_numpy()
        code = pdf["code"].to_numpy(np.int64).view(np.uint64)
        same = pdf["lo"].iloc[0] == pdf["hi"].iloc[0]
        out = []
        for at in range(0, len(u), 512):
            s = u[at : at + 512] @ u.T
            s[np.bitwise_count(code[at : at + 512, None] ^ code[None, :]) > radius] = -2
            if not same:
                s[own[at : at + 512, None] == own[None, :]] = -2
            s[np.arange(len(s)), np.arange(at, at + len(s))] = -2
            m = min(k + 1, s.shape[1])
            floor = -np.partition(-s, m - 1, axis=1)[:, m - 1] - np.float32(2e-6)  # single precision may turn near ties round
            i, j = np.nonzero((s >= floor[:, None]) & (s > -1.5))
            out.append(pd.DataFrame({"a": c[at + i], "b": c[j]}))
        p = pd.concat(out)
        return pd.DataFrame({"a": np.minimum(p["a"], p["b"]), "b": np.maximum(p["a"], p["b"])}).drop_duplicates()

    return units.groupBy("key", "lo", "hi").applyInPandas(best, "a bigint, b bigint")


QUERIES_AT_ONCE = 20_000


def exact_knn(queries: DataFrame, base: DataFrame, *, k: int = 5, dim: int = 64, block: int = 500, at_once: int = QUERIES_AT_ONCE) -> DataFrame:
    """Brute force: a stated query set (id, v) against all rows (id, v). To measure recall with; ids are distinct.

    Queries go out about ``at_once`` at a time, so what is broadcast has a bound whatever their number; each turn scans all rows.
    """
    spark = base.sparkSession
    q = queries.where(valid_vector(F.col("v"), dim)).select("id", "v")
    base = base.where(valid_vector(F.col("v"), dim)).select("id", "v")
    schema = f"id {dict(queries.dtypes)['id']}, neighbour {dict(base.dtypes)['id']}, similarity double"
    w = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    turns = -(-q.count() // at_once)
    out = spark.createDataFrame([], schema)
    for turn in range(turns):
        some = q.where(F.pmod(F.xxhash64("id"), F.lit(turns)) == turn).toPandas()
        if some.empty:
            continue
        ids, shared = some["id"].to_numpy(), spark.sparkContext.broadcast(_unit(some["v"]).astype(np.float32))

        def scan(batches, ids=ids, shared=shared):
            for pdf in batches:
                if pdf.empty:
                    continue
                u, other = _unit(pdf["v"]).astype(np.float32), pdf["id"].to_numpy()
                place = pd.Index(other).get_indexer(ids)
                for at in range(0, len(ids), block):
                    s = shared.value[at : at + block] @ u.T
                    own = np.flatnonzero(place[at : at + block] >= 0)
                    s[own, place[at : at + block][own]] = -2
                    m = min(k, s.shape[1])
                    floor = -np.partition(-s, m - 1, axis=1)[:, m - 1]
                    i, j = np.nonzero((s >= floor[:, None]) & (s > -1.5))
                    yield pd.DataFrame({"id": ids[at + i], "neighbour": other[j], "similarity": s[i, j].astype(float)})

        best = base.mapInPandas(scan, schema).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")
        out = out.unionByName(materialise(best))
        shared.unpersist()
    return out
