"""Toxicity: a factorization machine over hashed terms.

    s(x) = b + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2],   P(toxic) = sigmoid(s)

The pairwise part learns that two terms are toxic together (an insult with the mention of a group) though neither is by
itself, which a linear model can't. Terms are the distinct lower-cased words of the whole text without outer punctuation,
and their first letters (inflected forms share a stem) with how many different words have them, up to LEVELS: one form of
a stem may be harmless where three aren't. Terms are hashed into 2**bits buckets; x is presence.

Three screens choose the buckets that take part; all others are frozen at zero, so that a long clean text does not gather
noise: (1) the document frequency differs between the classes by more than chance (chi-square); (2) it does so among the rated
texts that have a bucket of the first screen, where a group's name may tell what it doesn't tell elsewhere; (3) two
buckets interact: of the log odds of texts with both, with one and with none, l11 - l10 - l01 + l00 is not zero by more
than chance, nor small in shares (``effect``), whatever each tells alone. The third one looks at all pairs of the ``PAIRED``
most frequent buckets of the rated sample and takes the ``PAIRS`` strongest, bounds of fitting like the sample itself.

Defined cases: null or blank text has no term and scores the bias, so it is kept; very long texts are read whole; null labels
and ids are ignored; with labels of one class only or without any, nothing is learned and every document is kept; an empty
table gives an empty result; equal scores are treated alike; repeated document rows are scored and returned as often as they
occur; other columns pass through ``select_clean`` unchanged, and none but doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, h64, table
from .quality import _sigmoid, rated_sample

BITS = 20
FACTORS = 8
MAX_LABELLED = 12000
STEMS = (4, 5, 6)
LEVELS = 3
PAIRED, PAIRS = 2048, 32
THRESHOLD = 0.4


def bare(word: str) -> str:
    """In lower case, without outer punctuation."""
    w = word.lower()
    if w.isalnum():
        return w
    i, j = 0, len(w)
    while i < j and not w[i].isalnum():
        i += 1
    while j > i and not w[j - 1].isalnum():
        j -= 1
    return w[i:j]


def stem_bucket(stem: str, bits: int = BITS) -> int:
    return h64(f"{len(stem)}:{stem}") & ((1 << bits) - 1)


def level(stem: int, k: int, bits: int = BITS) -> int:
    """Bucket of a stem that k different words share."""
    return (stem + k * 0x9E3779B1) & ((1 << bits) - 1)


def make_terms(bits: int = BITS, keep: np.ndarray | None = None):
    """text -> sorted distinct buckets; with ``keep`` only those buckets, renumbered by their place in it."""
    mask = (1 << bits) - 1
    place = None if keep is None else {int(b): i for i, b in enumerate(keep)}

    def stem(s):
        b = stem_bucket(s, bits)
        return b if place is None or any(level(b, k, bits) in place for k in range(1, LEVELS + 1)) else -1

    stem_of = Memo(stem, 300_000)

    def buckets(word):
        """None for a word that has no bucket, nor a stem that has one."""
        w = bare(word)
        if not w:
            return None
        own = h64("w:" + w) & mask
        own = own if place is None else place.get(own, -1)
        stems = [s for n in STEMS if len(w) >= n and (s := stem_of[w[:n]]) >= 0]
        return (w, own, stems) if own >= 0 or stems else None

    memo = Memo(buckets, 300_000)

    def terms(text: str | None) -> np.ndarray:
        out: set[int] = set()
        forms: dict[int, set] = {}
        for word in set(text.split()) if text else ():
            found = memo[word]
            if found is None:
                continue
            w, own, stems = found
            if own >= 0:
                out.add(own)
            for s in stems:
                forms.setdefault(s, set()).add(w)
        for s, f in forms.items():
            for k in range(1, min(len(f), LEVELS) + 1):
                b = level(s, k, bits)
                if place is None:
                    out.add(b)
                elif b in place:
                    out.add(place[b])
        return np.array(sorted(out), dtype=np.int32)

    return terms


@dataclass
class FactorizationMachine:
    """``keep``: the buckets that take part; ``linear`` and ``factors`` are by place in it."""

    bias: float
    keep: np.ndarray
    linear: np.ndarray
    factors: np.ndarray
    bits: int = BITS

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        """Score of rows of places, as make_terms(keep=...) gives them."""
        n = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        out = np.full(len(rows), self.bias)
        some = n > 0
        if some.any():
            flat = np.concatenate(rows)
            starts = np.concatenate([[0], np.cumsum(n[some])[:-1]])
            v = self.factors[flat]
            s = np.add.reduceat(v, starts, axis=0)
            q = np.add.reduceat((v * v).sum(axis=1), starts)
            out[some] += np.add.reduceat(self.linear[flat], starts) + 0.5 * ((s * s).sum(axis=1) - q)
        return out

    def probability(self, rows: list[np.ndarray]) -> np.ndarray:
        return _sigmoid(self.raw(rows))


def screen(rows: list[np.ndarray], y: np.ndarray, bits: int = BITS, chi2: float = 24.0, support: int = 3) -> np.ndarray:
    """Buckets with a significant difference in document frequency between the classes."""
    size = 1 << bits
    n1, n0 = float((y > 0).sum()), float((y <= 0).sum())
    if not n1 or not n0:
        return np.zeros(0, dtype=np.int64)
    a = np.bincount(np.concatenate([r for r, t in zip(rows, y) if t > 0]).astype(np.int64), minlength=size).astype(float)
    b = np.bincount(np.concatenate([r for r, t in zip(rows, y) if t <= 0]).astype(np.int64), minlength=size).astype(float)
    n = n1 + n0
    d = (a + b) * (n - a - b) * n1 * n0
    stat = np.divide(n * (a * (n0 - b) - b * (n1 - a)) ** 2, d, out=np.zeros(size), where=d > 0)
    return np.flatnonzero((stat >= chi2) & (a + b >= support))


def interacting(rows: list[np.ndarray], y: np.ndarray, bits: int = BITS, most: int = PAIRED, least: int = 8, z2: float = 40.0, effect: float = 0.25, pairs: int = PAIRS) -> np.ndarray:
    """Buckets of pairs whose effect on the log odds isn't the sum of their own; each of the four cells of a pair has ``least`` texts at least."""
    if not len(rows):
        return np.zeros(0, dtype=np.int64)
    df = np.bincount(np.concatenate(rows).astype(np.int64), minlength=1 << bits)
    often = np.flatnonzero((df >= 2 * least) & (df <= len(rows) - 2 * least))
    often = np.sort(often[np.argsort(-df[often], kind="stable")[:most]])
    if len(often) < 2:
        return np.zeros(0, dtype=np.int64)
    at = np.full(1 << bits, -1, dtype=np.int64)
    at[often] = np.arange(len(often))
    both, toxic = np.zeros((len(often), len(often)), dtype=np.float32), np.zeros((len(often), len(often)), dtype=np.float32)
    for k in range(0, len(rows), 1000):
        x = np.zeros((len(rows[k : k + 1000]), len(often)), dtype=np.float32)
        for i, r in enumerate(rows[k : k + 1000]):
            p = at[r.astype(np.int64)]
            x[i, p[p >= 0]] = 1
        both += x.T @ x
        bad = x[y[k : k + 1000] > 0]
        toxic += bad.T @ bad
    found: list[tuple[float, int, int]] = []
    n, t, all_n, all_t = np.diag(both).astype(float), np.diag(toxic).astype(float), float(len(rows)), float((y > 0).sum())
    for i in range(len(often)):
        n11, t11 = both[i].astype(float), toxic[i].astype(float)
        cells = [(n11, t11), (n[i] - n11, t[i] - t11), (n - n11, t - t11), (all_n - n[i] - n + n11, all_t - t[i] - t + t11)]
        odds = [np.log((b + 0.5) / (a - b + 0.5)) for a, b in cells]
        var = sum(1 / (b + 0.5) + 1 / (a - b + 0.5) for a, b in cells)
        p = [b / np.maximum(a, 1) for a, b in cells]
        size = (odds[0] - odds[1] - odds[2] + odds[3]) ** 2 / var
        ok = np.logical_and.reduce([a >= least for a, _ in cells]) & (np.abs(p[0] - p[1] - p[2] + p[3]) >= effect) & (size >= z2)
        found += [(-float(size[j]), i, int(j)) for j in np.flatnonzero(ok[:i])]
    return np.unique([often[x] for _, i, j in sorted(found)[:pairs] for x in (i, j)]).astype(np.int64)


def choose(rows: list[np.ndarray], y: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The buckets of all three screens."""
    if not len(rows):
        return np.zeros(0, dtype=np.int64)
    alone = screen(rows, y, bits)
    known = np.zeros(1 << bits, dtype=bool)
    known[alone] = True
    near = np.array([known[r].any() for r in rows], dtype=bool)
    among = screen([r for r, x in zip(rows, near) if x], y[near], bits)
    return np.unique(np.concatenate([alone, among, interacting(rows, y, bits)]))


def fit_fm(rows: list[np.ndarray], y: np.ndarray, keep: np.ndarray, bits: int = BITS, factors: int = FACTORS, epochs: int = 100, rate: float = 0.3, l2: float = 1e-6, l2v: float = 1e-2, seed: int = 11, batch: int = 64) -> FactorizationMachine:
    """Logistic loss by AdaGrad; rows hold bucket ids, of which only those in ``keep`` are used."""
    m = len(keep)
    rng = np.random.default_rng(seed)
    w, v = np.zeros(m), rng.normal(0, 0.05, (m, factors))
    share = float(np.clip((y > 0).mean(), 0.01, 0.99)) if len(y) else 0.01
    b = float(np.log(share / (1 - share)))
    if not m:
        return FactorizationMachine(min(b, -1.0), keep, w, v, bits)
    at = np.full(1 << bits, -1, dtype=np.int64)
    at[keep] = np.arange(m)
    rows = [(p := at[r.astype(np.int64)])[p >= 0] for r in rows]
    t = (y > 0).astype(float)
    gw, gv, gb = np.full(m, 1e-6), np.full((m, factors), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(rows), batch):
            pick = order[k : k + batch]
            n = np.array([len(rows[i]) for i in pick])
            flat = np.concatenate([rows[i] for i in pick])
            doc = np.repeat(np.arange(len(pick)), n)
            ww = np.bincount(doc, w[flat], len(pick))
            vf = v[flat]
            s = np.zeros((len(pick), factors))
            np.add.at(s, doc, vf)
            z = b + ww + 0.5 * ((s * s).sum(axis=1) - np.bincount(doc, (vf * vf).sum(axis=1), len(pick)))
            e = _sigmoid(z) - t[pick]
            g = e.sum()
            gb += g * g
            b -= rate * g / np.sqrt(gb)
            if not len(flat):
                continue
            u, inv = np.unique(flat, return_inverse=True)
            gu = np.bincount(inv, e[doc], len(u)) + l2 * len(pick) * w[u]
            gw[u] += gu * gu
            w[u] -= rate * gu / np.sqrt(gw[u])
            gf = np.zeros((len(u), factors))
            np.add.at(gf, inv, e[doc][:, None] * (s[doc] - vf))
            gf += l2v * len(pick) * v[u]
            gv[u] += gf * gf
            v[u] -= rate * gf / np.sqrt(gv[u])
    return FactorizationMachine(b, keep, w, v, bits)


def train_toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> FactorizationMachine:
    """Fit on at most ``max_labelled`` labelled documents, those lowest by a hash of the id."""
    rows, y = rated_sample(docs, labels, "toxic", max_labelled, make_terms)
    rows = [np.frombuffer(x, dtype=np.int32) for x in rows]
    return fit_fm(rows, y, choose(rows, y))


def _apply(docs: DataFrame, model: FactorizationMachine):
    """A pandas UDF text -> P(toxic); the model (fixed size) is broadcast once."""
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.keep, model.linear, model.factors, model.bits))

    @F.pandas_udf("double")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = FactorizationMachine(*shared.value)
        f = make_terms(m.bits, m.keep)
        for texts in batches:
            yield pd.Series(m.probability([f(t) for t in texts]), dtype="float64")

    return udf


def score_toxicity(docs: DataFrame, model: FactorizationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, p_toxic and toxic (p_toxic >= threshold), one row per input row."""
    return docs.select("doc_id", _apply(docs, model)(F.col("text")).alias("p_toxic")).withColumn("toxic", F.col("p_toxic") >= F.lit(threshold))


def select_clean(docs: DataFrame, model: FactorizationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """The input rows, all columns as they are, with P(toxic) below ``threshold``."""
    return docs.where(_apply(docs, model)(F.col("text")) < F.lit(threshold))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))
