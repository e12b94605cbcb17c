"""Near-duplicate records with small edits: pivot distance tables over shingle fingerprints.

The fingerprint of a text is the indicator of its set of word shingles, so that the Hamming distance of two fingerprints is
the size of the symmetric difference. A table holds its distances to many reference fingerprints: the empty one and fixed
pseudo-random halves of the shingle space. By the triangle inequality no coordinate of two texts differs by more than their
distance, and a Jaccard similarity of t bounds that distance by (|A|+|B|)(1-t)/(1+t): a pair whose largest coordinate
difference exceeds the bound is discarded without loss. Survivors are verified on their whole shingle sets.

Reference distances alone don't enumerate pairs in less than quadratic time, so the references come in blocks: in each
block, the references are the permutations' minimal shingles, and two texts meet in a block when their distance to its
nearest references vanishes, i.e. when all minima of the block agree. With 24 blocks of 4 a pair at a similarity of 0.7
meets with a probability of 99.9 %, at 0.75 of 99.99 %.

A block that more than ``CROWD`` different texts share (a common preamble) is split: its texts are parted by size into
geometric cells, since sizes of a linked pair differ by no more than the factor t, and each cell is salted into parts of at
most ``CROWD`` texts. Two parts of one cell or of neighbouring cells are one unit of work of a bounded size. In a unit the
table's further references count: they split the shingle space into 1,024 classes, a text's coordinate is whether it holds an
odd number of a class, and each shingle in which two texts differ turns one coordinate, so that pairs with more different
coordinates than the bound are discarded without loss there too.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.words import WordHashes, mix, shingle_set
from siltstone.runtime import materialise

BLOCKS, PER_BLOCK, REFERENCES = 24, 4, 16
CROWD, CLASSES = 1024, 1024
_RNG = np.random.default_rng(20)
_A = _RNG.integers(1, 2**63, BLOCKS * PER_BLOCK, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 2**63, BLOCKS * PER_BLOCK, dtype=np.uint64)
_SALT = _RNG.integers(0, 2**63, BLOCKS, dtype=np.uint64)
_HALF = 32768
TABLE = "struct<k1:bigint,k2:bigint,n:int,blocks:array<bigint>,d0:bigint,d1:bigint,d2:bigint,d3:bigint,odd:binary>"


def _coordinates(s: np.ndarray) -> tuple[int, int, int, int]:
    """Distances to the references less their own size, 16 bits each: the empty one, then 15 halves of the shingle space."""
    bits = np.unpackbits(s.astype("<u8").view(np.uint8).reshape(len(s), 8)[:, :2], axis=1).sum(0, dtype=np.int64)
    d = len(s) - 2 * bits
    d[0] = len(s)
    v = (np.clip(d, -_HALF, _HALF - 1) + _HALF).astype(np.uint64).reshape(4, 4)
    packed = v[:, 0] | v[:, 1] << np.uint64(16) | v[:, 2] << np.uint64(32) | v[:, 3] << np.uint64(48)
    return tuple(packed.astype(np.int64).tolist())


def table_row(text: str | None, known: WordHashes, width: int):
    if not isinstance(text, str):
        return None
    s = shingle_set(text, known, width)
    if not len(s):
        return None
    low = np.concatenate([(s[i : i + 512, None] * _A + _B).min(0, keepdims=True) for i in range(0, len(s), 512)]).min(0)
    b = mix(low).reshape(BLOCKS, PER_BLOCK)
    acc = _SALT.copy()
    for j in range(PER_BLOCK):
        acc = mix(acc + b[:, j])
    k1, k2 = (int(x) for x in np.array([np.bitwise_xor.reduce(mix(s)), mix(s + np.uint64(7)).sum(dtype=np.uint64)], np.uint64).astype(np.int64))
    d = _coordinates(s)
    return {"k1": k1, "k2": k2, "n": len(s), "blocks": acc.astype(np.int64), "d0": d[0], "d1": d[1], "d2": d[2], "d3": d[3], "odd": _odd(s)}


def _odd(s: np.ndarray) -> bytes:
    """One bit for each class of shingles: whether the set holds an odd number of it."""
    return np.packbits(np.bincount((s >> np.uint64(40)).astype(np.int64) & (CLASSES - 1), minlength=CLASSES).astype(np.uint8) & 1).tobytes()


def _far(a: str, b: str) -> Column:
    """Largest difference of a packed coordinate."""
    at = lambda side, i: F.shiftrightunsigned(F.col(f"{side}.d{i // 4}"), 16 * (i % 4)).bitwiseAND(F.lit(0xFFFF))
    return F.greatest(*(F.abs(at(a, i) - at(b, i)) for i in range(REFERENCES)))


def _crowded(rows: DataFrame, odd: DataFrame, threshold: float, crowd: int) -> DataFrame:
    """Pairs a, b under crowded blocks (rep, n, block), in units of at most two parts of about ``crowd`` texts."""
    # A size is linked to sizes down to threshold times its own, so to the same cell or the one below.
    cell = F.floor(F.log(F.col("n").cast("double")) / float(1e-6 - np.log(threshold))).cast("int") if threshold < 1 else F.col("n")
    rows = rows.withColumn("cell", cell)
    parts = rows.groupBy("block", "cell").agg(F.ceil(F.count(F.lit(1)) / crowd).cast("int").alias("parts"))
    below = parts.select("block", (F.col("cell") + 1).alias("cell"), F.col("parts").alias("below"))
    above = parts.select("block", (F.col("cell") - 1).alias("cell"), F.col("parts").alias("above"))
    rows = rows.join(parts, ["block", "cell"]).join(below, ["block", "cell"], "left").join(above, ["block", "cell"], "left")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep", "block"), F.col("parts")).cast("int"))
    # A unit: cell and part of the one side, cell and part of the other, the greater first; a text goes to all units of its part.
    unit = lambda c1, p1, c2, p2, side: F.struct(c1.alias("c1"), p1.alias("p1"), c2.alias("c2"), p2.alias("p2"), side.alias("side"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    c, own = F.col("cell"), F.col("own")
    same = F.transform(upto(F.col("parts")), lambda p: unit(c, F.greatest(own, p), c, F.least(own, p), (own < p).cast("int")))
    down = F.transform(upto(F.coalesce("below", F.lit(0))), lambda p: unit(c, own, c - 1, p, F.lit(0)))
    up = F.transform(upto(F.coalesce("above", F.lit(0))), lambda p: unit(c + 1, p, c, own, F.lit(1)))
    units = rows.select("rep", "n", "block", F.inline(F.concat(same, down, up))).join(odd, "rep")
    share = (1 - threshold) / (1 + threshold)
    kind = dict(rows.dtypes)["rep"]

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        one, bits = pdf["c1"].iloc[0] == pdf["c2"].iloc[0] and pdf["p1"].iloc[0] == pdf["p2"].iloc[0], np.stack([np.frombuffer(x, np.uint64) for x in pdf["odd"]])
        n, rep, side = pdf["n"].to_numpy(np.int64), pdf["rep"].to_numpy(), pdf["side"].to_numpy()
        left, right = (np.arange(len(n)),) * 2 if one else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        out_a, out_b = [], []
        for at in range(0, len(left), 128):
            i = left[at : at + 128]
            apart = np.zeros((len(i), len(right)), np.int64)
            for k in range(bits.shape[1]):
                apart += np.bitwise_count(bits[i, k][:, None] ^ bits[right, k][None, :])
            x, y = np.nonzero(apart <= (n[i][:, None] + n[right][None, :]) * share + 1e-9)
            out_a.append(rep[i[x]])
            out_b.append(rep[right[y]])
        a, b = (np.concatenate(o) if o else np.empty(0, rep.dtype) for o in (out_a, out_b))
        ok = a < b if one else a != b
        a, b = a[ok], b[ok]
        turn = a > b
        return pd.DataFrame({"a": np.where(turn, b, a), "b": np.where(turn, a, b)})

    return units.groupBy("block", "c1", "p1", "c2", "p2").applyInPandas(compare, f"a {kind}, b {kind}")


class NearDuplicates:
    """Classes of equal shingle sets and the links between them.

    ``classes``: doc_id, k1, k2 (the class), rep (smallest id of the class). ``links``: a, b (representatives, a < b), similarity.
    Texts that are null, blank or too short for a shingle take no part. Rows repeated under one id count once.
    """

    def __init__(self, df: DataFrame, id_col: str, text_col: str, threshold: float, width: int, crowd: int = CROWD):
        texts = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")

        @F.pandas_udf(TABLE)
        def rows(text: pd.Series) -> pd.DataFrame:
            known = WordHashes()
            empty = dict.fromkeys(("k1", "k2", "n", "blocks", "d0", "d1", "d2", "d3", "odd"))
            return pd.DataFrame([table_row(t, known, width) or empty for t in text], dtype=object)

        base = materialise(texts.select("doc_id", rows.asNondeterministic()("text").alias("t")).select("doc_id", "t.*").where("n is not null"))
        reps = base.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("n", "blocks", "d0", "d1", "d2", "d3", "odd")))
        self.classes = base.join(reps.select("k1", "k2", "rep"), ["k1", "k2"]).select("doc_id", "k1", "k2", "rep").distinct()
        met = reps.select("rep", "n", "d0", "d1", "d2", "d3", F.explode("blocks").alias("block"))
        # Most blocks hold one text; they leave before the join.
        sizes = met.groupBy("block").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        met = materialise(met.join(sizes, "block"))
        few, many = met.where(F.col("c") <= crowd), met.where(F.col("c") > crowd)
        bound = (F.col("a.n") + F.col("b.n")) * ((1 - threshold) / (1 + threshold)) + 1e-9
        pairs = few.alias("a").join(few.alias("b"), (F.col("a.block") == F.col("b.block")) & (F.col("a.rep") < F.col("b.rep")) & (_far("a", "b") <= bound))
        pairs = pairs.select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"))
        if not many.isEmpty():
            pairs = pairs.unionByName(_crowded(many.select("rep", "n", "block"), reps.select("rep", "odd"), threshold, crowd))
        pairs = materialise(pairs.distinct())

        @F.pandas_udf("array<bigint>")
        def full(text: pd.Series) -> pd.Series:
            known = WordHashes()
            return pd.Series([shingle_set(t, known, width).astype(np.int64) for t in text])

        needed = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        sets = texts.join(needed, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", full.asNondeterministic()("text").alias("s"))
        both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
        both = both.withColumn("common", F.size(F.array_intersect("sa", "sb")))
        sim = F.col("common") / (F.size("sa") + F.size("sb") - F.col("common"))
        self.links = materialise(both.select("a", "b", sim.alias("similarity")).where(F.col("similarity") >= threshold - 1e-12))

    def groups(self) -> DataFrame:
        """One row per document: its class and the class's number of links to other texts."""
        n = self.links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
        return self.classes.join(n, "rep", "left").select("doc_id", F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))

    def pairs(self) -> DataFrame:
        """Every pair of documents, smaller id first: links between classes spread over their members, and copies."""
        c = self.classes
        linked = self.links.join(c.select(F.col("rep").alias("a"), F.col("doc_id").alias("x")), "a").join(c.select(F.col("rep").alias("b"), F.col("doc_id").alias("y")), "b").select("x", "y")
        many = c.groupBy("rep").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("rep")
        own = c.join(many, "rep", "left_semi")
        copies = own.alias("p").join(own.alias("q"), (F.col("p.rep") == F.col("q.rep")) & (F.col("p.doc_id") < F.col("q.doc_id"))).select(F.col("p.doc_id").alias("x"), F.col("q.doc_id").alias("y"))
        return linked.unionByName(copies).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def near_duplicates(df: DataFrame, id_col: str = "id", text_col: str = "content", *, threshold: float = 0.8, width: int = 5, crowd: int = CROWD) -> NearDuplicates:
    """Groups of texts whose sets of ``width`` neighbouring words overlap by at least ``threshold`` of their union.

    Blocks of more than ``crowd`` different texts are compared in bounded units; the links are the same for any ``crowd``.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    return NearDuplicates(df, id_col, text_col, threshold, width, crowd)
