"""Evaluation texts leaking into training text, by template canonicalisation.

Numbers, units and names become typed placeholders; every window of 13 words of a case is a template, hash-joined with the
templates of every window of the corpus. Where a template matches, the slots decide: equal words in every slot are an exact
leak, a consistent renaming (equal slots stay equal, different ones different) is a re-parameterised question. Equal windows
have equal templates, so exact leaks are never lost to the templates. Names beyond ``NAME_LIMIT`` are kept as hashes in a
bitmap: none is missed, and a word taken for a name by chance is a slot on both sides.
"""

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.words import WORD, mix

WINDOW = 13
#: Up to so many template hashes (8 bytes each) of the cases are sent to the executors; beyond, a bitmap of 32 MB of them, which
#: lets every window that may match pass, and a join by shuffle decides.
SHARED_LIMIT, TEMPLATE_BITS = 2_000_000, 1 << 28
NAME_LIMIT = 200_000
#: Bits that more names than NAME_LIMIT are hashed to, 8 MB for any number; 32,768 a row on their way to the driver.
NAME_BITS, BITMAP = 1 << 26, 1 << 15
#: Words of measure.
UNITS = frozenset("ms s sec secs second seconds min mins minute minutes hour hours day days week weeks month months year years b kb mb gb tb byte bytes bit bits row rows line lines token tokens percent px cm mm m km kg g usd eur dollars euros".split())
_INVISIBLE = {c: None for c in [0xAD, 0x34F, 0x61C, 0x180E, 0xFEFF, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), *range(0xE0000, 0xE0080), 0x115F, 0x1160, 0x17B4, 0x17B5]}
NAME = r"(?<=[a-z0-9,;] )([A-Z][\p{L}\p{N}]+)"
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)


def plain(text: str) -> str:
    """Lower case, without invisible characters, in composed form."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKC", text.translate(_INVISIBLE)).lower().translate(_INVISIBLE)


def bitmap(places: DataFrame, bits: int) -> np.ndarray:
    """The bits ``at`` (0 to ``bits`` - 1) of all rows, 8 to a byte: each executor sends what it set, the driver a fixed size."""
    row = F.floor(F.col("at") / BITMAP).cast("int")
    rows = places.groupBy(row.alias("row")).agg(F.bitmap_construct_agg(F.col("at") % BITMAP).alias("bits")).toPandas()
    out = np.zeros((max(1, bits // BITMAP), BITMAP // 8), np.uint8)
    for at, some in zip(rows["row"], rows["bits"]):
        out[at] = np.frombuffer(some, np.uint8)
    return out.reshape(-1)


class HashedNames:
    """A set of names in a bitmap of fixed size: holds every name, and a few words besides (as many as the bits set)."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @classmethod
    def of(cls, names: DataFrame) -> "HashedNames":
        """From the column n."""
        return cls(bitmap(names.select(F.pmod(F.xxhash64("n"), F.lit(NAME_BITS)).alias("at")), NAME_BITS))

    def __contains__(self, word: str) -> bool:
        at = xxhash.xxh64_intdigest(word, seed=42) % NAME_BITS  # Spark's xxhash64
        return bool(self.bits[at >> 3] >> (at & 7) & 1)


class Vocabulary:
    """Numbers words; keeps each word's hash and its placeholder's hash."""

    def __init__(self, names: frozenset[str] | HashedNames, limit: int = 400_000):
        self.names, self.limit = names, limit
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.exact, self.typed = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)

    def number(self, words: list[str]) -> np.ndarray:
        if len(self.ids) > self.limit:
            self.clear()
        ids = self.ids
        for w in set(words).difference(ids):
            k = len(ids)
            if k == len(self.exact):
                self.exact, self.typed = np.append(self.exact, np.zeros(k, np.uint64)), np.append(self.typed, np.zeros(k, np.uint64))
            ids[w] = k
            kind = "\0number" if w[0].isdigit() else "\0unit" if w in UNITS else "\0name" if w in self.names else w
            self.exact[k], self.typed[k] = xxhash.xxh64_intdigest(w), xxhash.xxh64_intdigest(kind)
        return np.fromiter(map(ids.__getitem__, words), np.int64, len(words))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of each window, from prefix sums."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(_INVERSE, len(h)), dtype=np.uint64)])
    return mix((total[width:] - total[:-width]) * _powers(_BASE, n))


def _slots(ids: np.ndarray, exact: np.ndarray, typed: np.ndarray) -> int:
    """Hash of which slots of a window hold equal words."""
    first: dict[int, int] = {}
    return xxhash.xxh64_intdigest(bytes(first.setdefault(int(i), len(first)) for i in ids if exact[i] != typed[i])) >> 1


def _windows(texts: list, vocabulary: Vocabulary, width: int):
    """Of all texts at once: text number, position, template hash, exact hash of each window; word ids."""
    words: list[str] = []
    sizes = []
    for t in texts:
        w = WORD.findall(plain(t)) if isinstance(t, str) else []
        sizes.append(len(w))
        words += w
    ids = vocabulary.number(words)
    own = np.repeat(np.arange(len(texts)), sizes)
    n = max(0, len(words) - width + 1)
    inside = own[:n] == own[width - 1 :] if n else np.zeros(0, bool)
    return ids, own, inside, rolling(vocabulary.typed[ids], width), rolling(vocabulary.exact[ids], width)


HIT = "array<struct<t:bigint,e:bigint,s:bigint>>"


def _lists(k: np.ndarray, rows: list[dict], n: int) -> pd.Series:
    out: list[list] = [[] for _ in range(n)]
    for i, r in zip(k.tolist(), rows):
        out[i].append(r)
    return pd.Series(out)


def _window_udf(names: frozenset[str] | HashedNames, width: int, wanted):
    """Windows of each text; of a corpus only those whose template is ``wanted``: a broadcast sorted array, or a bitmap of low bits."""

    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = Vocabulary(names)
        exact = wanted is not None and wanted.value.dtype == np.uint64
        if exact:
            table = wanted.value
            door = np.zeros(1 << 22, bool)
            door[(table & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        for texts in batches:
            parts = []
            values = texts.tolist()
            for at in range(0, len(values), 256):
                some = values[at : at + 256]
                ids, own, ok, t, e = _windows(some, vocabulary, width)
                if exact and len(t):
                    ok &= door[(t & np.uint64((1 << 22) - 1)).astype(np.int64)]
                elif wanted is not None and len(t):
                    low = (t & np.uint64(len(wanted.value) * 8 - 1)).astype(np.int64)
                    ok &= (wanted.value[low >> 3] >> (low & 7).astype(np.uint8) & 1).astype(bool)
                pos = np.flatnonzero(ok)
                if exact and len(pos):
                    j = np.minimum(np.searchsorted(table, t[pos]), len(table) - 1)
                    pos = pos[table[j] == t[pos]]
                rows = [
                    {"t": a, "e": b, "s": _slots(ids[p : p + width], vocabulary.exact, vocabulary.typed)}
                    for p, a, b in zip(pos.tolist(), t[pos].astype(np.int64).tolist(), e[pos].astype(np.int64).tolist())
                ]
                parts.append(_lists(own[pos], rows, len(some)))
            yield pd.concat(parts, ignore_index=True) if parts else pd.Series([], dtype=object)

    return F.pandas_udf(udf, HIT)


def leaks(docs: DataFrame, cases: DataFrame, *, doc_id: str = "doc_id", text: str = "text", case_id: str = "id", case_texts: tuple[str, ...] = ("problem_statement", "query"), width: int = WINDOW) -> DataFrame:
    """doc_id, case_id, n_exact, n_reparameterised: windows of each corpus document that match a case's, for pairs with any.

    Words are runs of letters and digits; case, punctuation, spacing, line breaks and invisible characters don't count. Null and
    short texts have no windows; an empty side gives no rows; repeated rows count once.
    """
    spark = docs.sparkSession
    texts = cases.select(F.col(case_id).alias("case_id"), F.explode(F.array(*case_texts)).alias("x")).where("x is not null and case_id is not null")

    capitals = F.transform(F.regexp_extract_all("x", F.lit(NAME), F.lit(1)), F.lower)
    distinct = texts.select(F.explode(capitals).alias("n")).distinct()
    found = distinct.limit(NAME_LIMIT + 1).toPandas()["n"].tolist()
    names = frozenset(found) if len(found) <= NAME_LIMIT else HashedNames.of(distinct)
    table = texts.select("case_id", F.inline(_window_udf(names, width, None)("x"))).distinct()
    n = table.select("t").distinct()
    few = n.limit(SHARED_LIMIT + 1).toPandas()["t"].to_numpy()
    if not len(few):
        return spark.createDataFrame([], f"doc_id {dict(docs.dtypes)[doc_id]}, case_id {dict(cases.dtypes)[case_id]}, n_exact bigint, n_reparameterised bigint")
    small = len(few) <= SHARED_LIMIT
    wanted = spark.sparkContext.broadcast(np.sort(few.astype(np.int64).astype(np.uint64)) if small else bitmap(n.select(F.pmod("t", F.lit(TEMPLATE_BITS)).alias("at")), TEMPLATE_BITS))
    hits = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("x")).where("x is not null and doc_id is not null").select("doc_id", F.inline(_window_udf(names, width, wanted)("x"))).distinct()
    met = hits.alias("d").join(table.alias("c"), "t").where("d.e = c.e or d.s = c.s")
    exact = F.col("d.e") == F.col("c.e")
    return met.groupBy("doc_id", "case_id").agg(
        F.countDistinct(F.when(exact, F.col("d.e"))).alias("n_exact"), F.countDistinct(F.when(~exact, F.col("d.e"))).alias("n_reparameterised")
    )
