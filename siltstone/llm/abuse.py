"""Abusive, hateful or sexually explicit language: a convolutional text classifier in numpy.

Words are normalised (case, invisible characters, look-alike letters and digits, stretched and dotted spellings, spaced
letters), hashed into a table of embeddings, and read by filters of several widths; each filter's maximum over the whole text
feeds a logistic output. Trained on at most ``TRAIN_LIMIT`` labelled rows of ``WORDS_LIMIT`` words together; scores of rows a
model didn't see calibrate a threshold for each language. With fewer than ``LEAST_POSITIVES`` labels of 1, or where those scores
reach no precision of ``LEAST_PRECISION`` (as a lower bound), nothing is flagged and ``calibrated`` is false: so few labels
don't support a decision. Every document is scored over its whole text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.runtime import materialise

BITS, DIM, WIDTHS, FILTERS = 15, 16, (1, 2, 3, 5), 16
#: A label is doubted where the score of a model that didn't see it lies this near the other one; words of fewer documents aren't learned.
DOUBT, LEAST_DOCUMENTS = 0.12, 3
#: At most so many labelled rows are fitted on: those with the smallest hash of their id, labels of 1 first up to a half.
TRAIN_LIMIT = 6000
#: Beyond so many words in all of them (2 bytes each on their way to the driver), further rows in order of that hash are left out.
WORDS_LIMIT = 20_000_000
LEAST_POSITIVES, LEAST_PRECISION = 40, 0.6
PAD = 1 << BITS
#: Characters that stand for letters in disguised words.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t", "€": "e"})
#: Letters of other alphabets that look like Latin ones.
LOOKALIKE = str.maketrans({
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ո": "n", "є": "e",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
})
_WORD = re.compile(r"[^\W_]+")
_DISGUISED = re.compile(r"[a-z@$!|€][a-z0-9@$!|+€]*[0-9@$!|+€][a-z0-9@$!|+€]*[a-z0-9]?$|[@$0-9!]+[a-z][a-z0-9@$!|+€]*$")
_DOTTED = re.compile(r"^(?:[^\W\d_][.\-_*·~]){2,}[^\W\d_]$")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
_EDGE = ".,;:?!()[]{}<>\"'`*_~#/\\|“”‘’«»…-–—=&%^"
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]+")
_INVISIBLE = {c: None for c in [0xAD, 0x34F, 0x180E, 0xFEFF, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10)]}


def _bucket(word: str) -> int:
    return xxhash.xxh32_intdigest(word) & (PAD - 1)


def _of_chunk(chunk: str) -> tuple[int, ...]:
    """Buckets of the words of one run of non-blank characters; a lone letter is minus its code."""
    core = chunk.strip(_EDGE)
    if len(core) <= 1:
        return (-ord(core),) if core.isalpha() and not _CJK.match(core) else (_bucket(core),) if core else ()
    if not core.isascii():
        folded = core.translate(LOOKALIKE)
        core = folded if folded != core and any("a" <= c <= "z" for c in core) else core
    if _DOTTED.match(core):
        core = re.sub(r"[.\-_*·~]", "", core)
    lead = chunk.lstrip(".,;:?!()[]{}<>\"'`*_~#/")
    lead = lead.rstrip(".,;:?()[]{}<>\"'`*_~#/")
    if _DISGUISED.match(lead) and sum(c.isalpha() for c in lead) >= 2 or _DISGUISED.match(core) and sum(c.isalpha() for c in core) >= 2:
        form = lead if _DISGUISED.match(lead) else core
        core = form.rstrip("!").translate(LEET)
    core = _STRETCHED.sub(r"\1", core)
    out: list[int] = []
    for word in _WORD.findall(core):
        if _CJK.search(word):
            for run in _CJK.findall(word):
                out += [_bucket(run[i : i + 2]) for i in range(max(1, len(run) - 1))]
            out += [_bucket(w) for w in _WORD.findall(_CJK.sub(" ", word))]
        elif word[0].isdigit():
            out.append(_bucket("0"))
        else:
            out.append(_bucket(word))
    return tuple(out)


class _Chunks(dict):
    def __missing__(self, chunk: str) -> tuple[int, ...]:
        value = _of_chunk(chunk)
        if len(chunk) < 40:
            if len(self) > 400_000:
                self.clear()
            self[chunk] = value
        return value


def encode(text: str | None, known: _Chunks) -> np.ndarray:
    """Word buckets of one text."""
    if not isinstance(text, str):
        return np.empty(0, np.int32)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_INVISIBLE)
    ids = np.fromiter(chain.from_iterable(map(known.__getitem__, text.lower().split())), np.int32)
    lone = ids < 0
    if lone.any():
        at = np.flatnonzero(lone)
        runs = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1)
        keep = np.ones(len(ids), bool)
        for r in runs:
            letters = "".join(chr(-c) for c in ids[r].tolist())
            if len(r) >= 3:  # spaced letters are one word
                ids[r[0]], keep[r[1:]] = _bucket(_STRETCHED.sub(r"\1", letters)), False
            else:
                ids[r] = [_bucket(c) for c in letters]
        ids = ids[keep]
    return ids


@dataclass
class Model:
    table: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5
    calibrated: bool = True


def _join(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All texts behind one another, pads between them; where each begins."""
    gap = np.full(max(WIDTHS), PAD, np.int32)
    parts = [np.concatenate([d, gap]) for d in docs]
    start = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]]).astype(np.int64)
    return np.concatenate([*parts, gap]), start


def _convolve(model: Model, ids: np.ndarray, start: np.ndarray, positions: bool):
    """Each filter's maximum in each text, and where it is."""
    x = model.table[ids]
    n = int(len(ids) - max(WIDTHS))
    highs, wheres = [], []
    for w, f, b in zip(WIDTHS, model.filters, model.bias):
        y = x[:n] @ f[:DIM]
        for k in range(1, w):
            y += x[k : k + n] @ f[k * DIM : (k + 1) * DIM]
        high = np.maximum.reduceat(y, start, axis=0)
        if positions:
            ends = np.append(start[1:], n)
            wheres.append(np.stack([y[a:e].argmax(0) + a for a, e in zip(start, ends)]))
        highs.append(np.maximum(high + b, 0))
    return np.hstack(highs), wheres


def scores(model: Model, docs: list[np.ndarray], words_at_once: int = 60_000) -> np.ndarray:
    out, at = np.zeros(len(docs)), 0
    while at < len(docs):
        end, size = at, 0
        while end < len(docs) and (end == at or size + len(docs[end]) <= words_at_once):
            size += len(docs[end])
            end += 1
        pooled, _ = _convolve(model, *_join(docs[at:end]), False)
        out[at:end] = 1 / (1 + np.exp(-(pooled @ model.out + model.out_bias)))
        at = end
    return out


def train(docs: list[np.ndarray], labels: np.ndarray, *, epochs: int = 12, batch: int = 32, rate: float = 0.05, drop: float = 0.3, forget: float = 0.15, seed: int = 1) -> Model:
    rng = np.random.default_rng(seed)
    epochs = int(np.clip(600 * batch / max(1, len(docs)), epochs, 60))  # a few hundred rows need more rounds
    m = Model(
        (rng.normal(0, 0.02, (PAD + 1, DIM))).astype(np.float32), [rng.normal(0, 1 / np.sqrt(w * DIM), (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), float(np.log((labels.mean() + 0.01) / (1.01 - labels.mean()))),
    )
    seen = np.zeros(PAD + 1, np.int64)
    for d in docs:
        seen[np.unique(d)] += 1
    live_words = seen >= (LEAST_DOCUMENTS if len(docs) >= 500 else 1)
    live_words[PAD] = False
    m.table[~live_words] = 0
    acc = [np.full(PAD + 1, 1e-2, np.float32), [np.full_like(f, 1e-2) for f in m.filters], [np.full_like(b, 1e-2) for b in m.bias], np.full_like(m.out, 1e-2), 1e-2]
    weight = np.where(labels == 1, np.clip((labels == 0).sum() / max(1, (labels == 1).sum()), 1, 4), 1.0)
    for epoch in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            ids, start = _join([docs[i] for i in some])
            ids = np.where(rng.random(len(ids)) < forget, PAD, ids)
            pooled, wheres = _convolve(m, ids, start, True)
            mask = (rng.random(pooled.shape) >= drop) / (1 - drop)
            h = pooled * mask
            p = 1 / (1 + np.exp(-(h @ m.out + m.out_bias)))
            # Labels hold a few per cent of errors: soft targets.
            g = (weight[some] * (p - (0.03 + 0.94 * labels[some])) / len(some)).astype(np.float32)
            grad_out, grad_h = h.T @ g + 1e-4 * m.out, (g[:, None] * m.out) * mask * (pooled > 0)
            rows, values = [], []
            for j, w in enumerate(WIDTHS):
                gh = grad_h[:, j * FILTERS : (j + 1) * FILTERS].astype(np.float32)
                where = wheres[j]
                grad_f = np.empty_like(m.filters[j])
                for k in range(w):
                    word = ids[where + k]
                    e = m.table[word]
                    fk = m.filters[j][k * DIM : (k + 1) * DIM]
                    grad_f[k * DIM : (k + 1) * DIM] = np.einsum("bfd,bf->df", e, gh)
                    rows.append(word.ravel())
                    values.append((gh[:, :, None] * fk.T[None]).reshape(-1, DIM))
                grad_b = gh.sum(0)
                acc[1][j] += grad_f**2
                acc[2][j] += grad_b**2
                m.filters[j] -= rate * grad_f / np.sqrt(acc[1][j])
                m.bias[j] -= rate * grad_b / np.sqrt(acc[2][j])
            r, v = np.concatenate(rows), np.concatenate(values)
            live = live_words[r] & (np.abs(v).sum(1) > 0)
            r, inverse = np.unique(r[live], return_inverse=True)
            total = np.zeros((len(r), DIM), np.float32)
            np.add.at(total, inverse, v[live])
            acc[0][r] += (total**2).mean(1)
            m.table[r] -= rate * total / np.sqrt(acc[0][r])[:, None]
            m.table[PAD] = 0
            acc[3] += grad_out**2
            m.out -= rate * grad_out / np.sqrt(acc[3])
            acc[4] += float(g.sum()) ** 2
            m.out_bias -= rate * float(g.sum()) / np.sqrt(acc[4])
    return m


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold of greatest F1, half way to the next score."""
    order = np.argsort(-p)
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + max(1, y.sum()))
    k = int(f1.argmax())
    nxt = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float(np.clip((p[order[k]] + nxt) / 2, 0.05, 0.95))


def language(lang: Column) -> Column:
    """Two lower-case letters, ``und`` where unknown."""
    code = F.lower(F.regexp_extract(F.trim(lang), r"^([A-Za-z]{2})(?:[-_].*)?$", 1))
    return F.when(code != "", code).otherwise("und")


def fit(docs: DataFrame, labels: DataFrame, *, limit: int = TRAIN_LIMIT, words: int = WORDS_LIMIT) -> Model | None:
    """Classifier from labelled rows (doc_id, toxic); null without rows of both classes. Repeated labels of one document: the greatest.

    Texts are turned into word buckets where they lie; only these reach the driver.
    """
    y = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    key = F.xxhash64("doc_id")
    pos, neg = y.where("toxic = 1").orderBy(key).limit(limit // 2), y.where("toxic = 0").orderBy(key).limit(limit - limit // 2)

    @F.pandas_udf("binary")
    def buckets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _Chunks()
        for texts in batches:
            yield pd.Series([encode(t, known).astype("<i2").tobytes() for t in texts], dtype=object)

    rows = docs.select("doc_id", "text", language(F.col("lang")).alias("lang")).join(pos.unionByName(neg), "doc_id").where("text is not null")
    rows = materialise(rows.select("doc_id", "toxic", "lang", buckets.asNondeterministic()("text").alias("w")))
    size = F.coalesce(F.octet_length("w"), F.lit(0)) / 2
    if (rows.agg(F.sum(size)).first()[0] or 0) > words:
        rows = rows.withColumn("_sum", F.sum(size).over(Window.orderBy(key, "w")))  # at most ``limit`` rows
        rows = rows.where(F.col("_sum") <= words).drop("_sum")
    pdf = rows.toPandas().drop_duplicates("doc_id").sort_values("doc_id", ignore_index=True)
    if pdf.empty or pdf["toxic"].nunique() < 2:
        return None
    return fit_rows([np.frombuffer(w, "<i2").astype(np.int32) for w in pdf["w"]], pdf["toxic"].to_numpy(np.float32), pdf["lang"].to_numpy(), docs.sparkSession)


def _held_out(docs: list[np.ndarray], y: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Scores of the rows ``h`` by a model of the others."""
    if not 0 < y[~h].sum() < (~h).sum():
        return np.zeros(int(h.sum()))
    return scores(train([d for d, x in zip(docs, ~h) if x], y[~h]), [d for d, x in zip(docs, h) if x])


def fit_rows(docs: list[np.ndarray], y: np.ndarray, lang: np.ndarray, spark: SparkSession | None = None) -> Model:
    """Two halves score each other, as two tasks where there is a session. Labels that the other half's model firmly contradicts
    are left out of the final fit (a few per cent are wrong, and a model that learns them learns names); thresholds come from
    the halves' scores."""
    half = np.zeros(len(docs), bool)  # every other one of each class
    for one in (0, 1):
        half[np.flatnonzero(y == one)[1::2]] = True
    p = np.zeros(len(docs))
    if y.sum() < LEAST_POSITIVES or spark is None:
        for h in (half, ~half):
            p[h] = _held_out(docs, y, h)
    else:
        shared = spark.sparkContext.broadcast((docs, y, half))

        def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for one in pdf["id"]:
                    d, labels, h = shared.value
                    got = _held_out(d, labels, h == bool(one))
                    yield pd.DataFrame({"id": [one], "p": [got.tobytes()]})

        for row in spark.range(0, 2, 1, 2).mapInPandas(fold, "id bigint, p binary").collect():
            p[half == bool(row["id"])] = np.frombuffer(row["p"])
        shared.unpersist()
    sure = ~(((y == 1) & (p < DOUBT)) | ((y == 0) & (p > 1 - DOUBT))) if y.sum() >= 100 else np.ones(len(docs), bool)
    model = train([d for d, s in zip(docs, sure) if s], y[sure])
    all_p, all_y = p, y
    p, y, lang = p[sure], y[sure], lang[sure]
    model.threshold = best_threshold(p, y) if y.sum() >= 3 else 0.5
    model.calibrated = bool(all_y.sum() >= LEAST_POSITIVES and precision_bound(all_p, all_y, model.threshold) >= LEAST_PRECISION)
    for one in np.unique(lang):
        at = lang == one
        n = y[at].sum()
        if n >= 10:  # shrunk towards the common threshold by the number of positives
            model.thresholds[str(one)] = float((n * best_threshold(p[at], y[at]) + 30 * model.threshold) / (n + 30))
    return model


def precision_bound(p: np.ndarray, y: np.ndarray, threshold: float) -> float:
    """Lower end of the 95 % interval (Wilson's) of the share of right ones among scores of at least the threshold; 0 where there are none."""
    at = p >= threshold
    n = int(at.sum())
    if not n:
        return 0.0
    share, z = float(y[at].mean()), 1.96
    return (share + z * z / (2 * n) - z * np.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def score_documents(docs: DataFrame, labels: DataFrame, *, limit: int = TRAIN_LIMIT) -> DataFrame:
    """``docs`` (doc_id, text, lang, source) with abuse_score in [0, 1], is_abusive and calibrated.

    Null and blank texts score 0. Without labels of both classes every score is null and nothing is flagged; where the labels
    are too few (see the module) scores are given, calibrated is false and nothing is flagged either.
    """
    model = fit(docs, labels, limit=limit)
    base = docs.select("doc_id", "source", language(F.col("lang")).alias("language"), "text")
    if model is None:
        return base.drop("text").withColumns({"abuse_score": F.lit(None).cast("double"), "is_abusive": F.lit(False), "calibrated": F.lit(False)})
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: the table and the filters

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _Chunks()
        for texts in batches:
            ids = [encode(t, known) for t in texts]
            p = scores(shared.value, ids) if ids else np.empty(0)
            yield pd.Series([float(s) if len(d) else 0.0 for s, d in zip(p, ids)], dtype="float64")

    limits = F.create_map(*(F.lit(x) for kv in model.thresholds.items() for x in kv)) if model.thresholds else None
    cut = F.coalesce(limits[F.col("language")], F.lit(model.threshold)) if limits is not None else F.lit(model.threshold)
    flag = (F.col("abuse_score") >= cut) & F.lit(model.calibrated)
    return base.withColumn("abuse_score", score.asNondeterministic()("text")).withColumns({"is_abusive": flag, "calibrated": F.lit(model.calibrated)}).drop("text")


def rates(scored: DataFrame) -> DataFrame:
    """Documents, flagged ones and their share per source, and whether flags rest on enough labels; a null source is a group of its own."""
    return scored.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if("is_abusive").alias("n_abusive"), F.round(F.avg(F.col("is_abusive").cast("int")), 6).alias("rate"), F.round(F.avg("abuse_score"), 6).alias("mean_score"), F.bool_or("calibrated").alias("calibrated")
    )
