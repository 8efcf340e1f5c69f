"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

One weight vector w over hashed text features and K-1 ordered thresholds b_1 < b_2 < ... give

    P(grade >= k | x) = sigmoid(w.x - b_k),   E[grade] = sum_k P(grade >= k).

The thresholds are parametrised as b_1 and positive increments exp(d_k), so they stay ordered while training.

Features of a text, hashed into 2**bits buckets, in three families of fixed norm, so that a long text dilutes none: its
distinct white-space words by presence; the shapes of all its words (letter case and punctuation pattern, runs squeezed;
a word of over RUNS runs has a shape for every RUNS of them, so that unsegmented scripts and code aren't one shape)
by the square root of their share; and a step of the share of words equal to the one before. The whole text is read.

Defined cases: null, empty or blank text has only the bias bucket, and is scored like any text; very long texts and words are
read whole; null grades and null ids in the ratings are ignored; several grades for one document all count; with no usable
rating every document scores the prior 0.5 and is kept; a score at the threshold is kept; an empty table gives an empty result;
a repeated document row is scored and returned as often as it occurs; other columns of the input pass through
``select_quality`` unchanged, and a column that has the name of a result column is not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, h64, table

BITS = 18
MAX_RATED = 8000
# norms of the families: words are many, and would learn single texts by heart before the shapes are learned
OF_WORDS, OF_SHAPES, OF_REPEATS = 0.3, 2.0, 2.0
RUNS, LONG = 24, 200
_BIAS = 0


def shapes(word: str) -> list[str]:
    """``Word,`` -> ``Aa,``; runs are squeezed, so that ``***`` and ``*****`` look alike but ``*`` does not. One for every RUNS runs."""
    out, last, run = [], "", 0
    for c in word:
        k = ("A" if c.isupper() else "a") if c.isalpha() else "9" if c.isdigit() else c
        if k == last:
            run += 1
            if run == 2 and k not in "Aa9":
                out[-1] += "+"
            continue
        out.append(k)
        last, run = k, 1
    return ["".join(out[i : i + RUNS]) for i in range(0, len(out), RUNS)]


def word_buckets(word: str, bits: int = BITS) -> tuple[int, ...]:
    """Bucket of the word, and those of its shapes."""
    mask = (1 << bits) - 1
    return (h64("w:" + word) & mask, *(h64("s:" + s) & mask for s in shapes(word)))


def make_featurizer(bits: int = BITS):
    """text -> float32 array of two rows: distinct bucket ids, and their values."""
    mask = (1 << bits) - 1
    memo = Memo(lambda w: word_buckets(w, bits))
    rep = [h64(f"r:{k}") & mask for k in range(6)]

    def features(text: str | None) -> np.ndarray:
        words = text.split() if text else []
        n = len(words)
        if not n:
            return np.array([[_BIAS], [1.0]], dtype=np.float32)
        counts = Counter(words)
        found = [memo[w] if len(w) < LONG else word_buckets(w, bits) for w in counts]
        times = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
        held = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        flat = np.fromiter(chain.from_iterable(found), dtype=np.int64, count=int(held.sum()))
        first = np.cumsum(held) - held
        own = np.zeros(len(flat), dtype=bool)
        own[first] = True
        of_word = np.unique(flat[own])
        of_shape, inverse = np.unique(flat[~own], return_inverse=True)
        times = np.repeat(times, held - 1)
        share = np.sqrt(np.bincount(inverse, times) / times.sum())
        r = sum(map(eq, words, words[1:])) / n
        ids = np.concatenate([of_word, of_shape, [_BIAS, rep[min(5, int(r * 20))]]])
        values = np.concatenate([np.full(len(of_word), OF_WORDS / np.sqrt(len(of_word))), OF_SHAPES * share, [1.0, OF_REPEATS]])
        u, inverse = np.unique(ids, return_inverse=True)
        return np.stack([u, np.bincount(inverse, values)]).astype(np.float32)

    return features


@dataclass
class OrdinalModel:
    """``weights`` by bucket, ordered ``thresholds`` and the sorted ``grades`` (grades[0] lies below every threshold)."""

    weights: np.ndarray
    thresholds: np.ndarray
    grades: list[float]
    bits: int = BITS

    def latent(self, rows: list[np.ndarray]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        flat = np.concatenate(rows, axis=1)
        starts = np.concatenate([[0], np.cumsum([r.shape[1] for r in rows])[:-1]])
        return np.add.reduceat(self.weights[flat[0].astype(np.int64)] * flat[1], starts)

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade >= grades[k]) for k = 1.., one row per text."""
        return _sigmoid(z[:, None] - self.thresholds[None, :])

    def expected(self, tails: np.ndarray) -> np.ndarray:
        return self.grades[0] + tails @ np.diff(np.array(self.grades, dtype=float))


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def link_gradient(z: np.ndarray, y: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(-log P(grade), its derivative by z, derivatives of their sum by the thresholds b) for latent values z and grade numbers y.

    P(grade = k) is the difference of the sigmoids at the two thresholds that enclose it.
    """
    ends = np.concatenate([[-np.inf], b, [np.inf]])
    lo, hi = ends[y], ends[y + 1]
    s_lo = np.where(np.isinf(lo), 1.0, _sigmoid(z - lo))
    s_hi = np.where(np.isinf(hi), 0.0, _sigmoid(z - hi))
    p = np.maximum(s_lo - s_hi, 1e-9)
    dlo = np.where(np.isinf(lo), 0.0, s_lo * (1 - s_lo)) / p
    dhi = np.where(np.isinf(hi), 0.0, s_hi * (1 - s_hi)) / p
    db = np.zeros(len(b) + 2)
    np.add.at(db, y, dlo)
    np.add.at(db, y + 1, -dhi)
    return -np.log(p), dhi - dlo, db[1:-1]


def fit_ordinal(rows: list[np.ndarray], grades, bits: int = BITS, epochs: int = 30, rate: float = 0.5, l2: float = 1e-5, seed: int = 7, batch: int = 64) -> OrdinalModel:
    """Maximum likelihood by AdaGrad on mini-batches."""
    levels = sorted(set(grades))
    y = np.searchsorted(levels, grades)
    k1 = len(levels) - 1
    w = np.zeros(1 << bits)
    if k1 < 1:
        return OrdinalModel(w, np.zeros(0), levels or [0.0], bits)
    tail = np.array([(y >= k).mean() for k in range(1, k1 + 1)])
    b = -np.log(np.clip(tail, 1e-4, 1 - 1e-4) / np.clip(1 - tail, 1e-4, 1))
    b = np.maximum.accumulate(b + 1e-3 * np.arange(k1))
    first, inc = b[0], np.log(np.maximum(np.diff(b), 1e-3))
    gw, gb, gi = np.full(1 << bits, 1e-8), 1e-8, np.full(k1 - 1, 1e-8)
    rng = np.random.default_rng(seed)
    sizes = np.array([r.shape[1] for r in rows], dtype=np.int64)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            pick = order[at : at + batch]
            flat, x = np.concatenate([rows[i] for i in pick], axis=1)
            flat, n = flat.astype(np.int64), sizes[pick]
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])
            z = np.add.reduceat(w[flat] * x, starts)
            _, dz, db = link_gradient(z, y[pick], first + np.concatenate([[0.0], np.cumsum(np.exp(inc))]))
            u, inv = np.unique(flat, return_inverse=True)
            gu = np.bincount(inv, np.repeat(dz, n) * x, len(u)) + l2 * len(pick) * w[u]
            gw[u] += gu * gu
            w[u] -= rate * gu / np.sqrt(gw[u])
            g0 = db.sum()
            gb += g0 * g0
            first -= 0.1 * g0 / np.sqrt(gb)
            if k1 > 1:
                gk = np.cumsum(db[::-1])[::-1][1:] * np.exp(inc)
                gi += gk * gk
                inc = np.clip(inc - 0.1 * gk / np.sqrt(gi), -7, 7)
    return OrdinalModel(w, first + np.concatenate([[0.0], np.cumsum(np.exp(inc))]), [float(x) for x in levels], bits)


def rated_sample(docs: DataFrame, ratings: DataFrame, grade: str, max_rated: int, make=make_featurizer) -> tuple[list[bytes], np.ndarray]:
    """Features, as the bytes of what ``make()`` gives, and grades of at most ``max_rated`` rated documents, those lowest by a hash of the id.

    The chosen ids are bounded by the parameter, hence broadcast; texts become bucket ids on the executors.
    """
    picked = (
        ratings.where(F.col("doc_id").isNotNull() & F.col(grade).isNotNull())
        .select(F.col("doc_id").cast("long").alias("__id"), F.col(grade).cast("double").alias("__grade"))
        .distinct()
        .orderBy(F.xxhash64("__id"), "__id", "__grade")
        .limit(max_rated)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").alias("__text")).join(F.broadcast(picked), "__id")

    def extract(batches):
        features = make()
        for b in batches:
            yield pd.DataFrame({"id": b["__id"], "grade": b["__grade"], "x": [features(t).tobytes() for t in b["__text"]]})

    got = rows.mapInPandas(extract, "id long, grade double, x binary").toPandas()
    got = got.sort_values(["id", "grade"], kind="stable").reset_index(drop=True)
    return list(got["x"]), got["grade"].to_numpy()


def train_quality(docs: DataFrame, ratings: DataFrame, grade: str = "grade", max_rated: int = MAX_RATED) -> OrdinalModel:
    """Fit on at most ``max_rated`` rated documents, whatever the size of the corpus."""
    rows, y = rated_sample(docs, ratings, grade, max_rated)
    return fit_ordinal([np.frombuffer(x, dtype=np.float32).reshape(2, -1) for x in rows], y)


def _apply(docs: DataFrame, model: OrdinalModel):
    """A pandas UDF (text -> struct of expected grade and lowest tail); the model travels as one broadcast of fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds, model.grades, model.bits))

    @F.pandas_udf("expected_grade double, p_keep double")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = OrdinalModel(*shared.value)
        f = make_featurizer(m.bits)
        for texts in batches:
            rows = [f(t) for t in texts]
            if len(m.thresholds):
                t = m.tails(m.latent(rows))
                e, p = m.expected(t), t[:, 0]
            else:
                e, p = np.full(len(rows), m.grades[0]), np.full(len(rows), 0.5)
            yield pd.DataFrame({"expected_grade": e, "p_keep": p})

    return udf


def score_quality(docs: DataFrame, model: OrdinalModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, p_keep = P(grade above the lowest) and selected, one row per input row."""
    s = _apply(docs, model)(F.col("text"))
    return (
        docs.select("doc_id", s.alias("__q"))
        .select("doc_id", F.col("__q.expected_grade").alias("expected_grade"), F.col("__q.p_keep").alias("p_keep"))
        .withColumn("selected", F.col("p_keep") >= F.lit(threshold))
    )


def select_quality(docs: DataFrame, model: OrdinalModel, threshold: float = 0.5) -> DataFrame:
    """The input rows, all columns as they are, whose P(grade above the lowest) reaches ``threshold``."""
    return docs.where(_apply(docs, model)(F.col("text"))["p_keep"] >= F.lit(threshold))


def ratings_of(labels: DataFrame) -> DataFrame:
    """Three grades out of the two label columns: 0 poor; 1 well written but toxic; 2 well written and not toxic."""
    return labels.select("doc_id", (F.col("quality") * (F.lit(2) - F.col("toxic"))).alias("grade"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train_quality(docs, ratings_of(table(spark, sf_dir, "labels"))))
