import random

import numpy as np
import pytest

from corpusmill.llm import toxicity as X


def texts(n, seed):
    """Toxic where an insult and a group are both there; neither alone is."""
    r = random.Random(seed)
    plain = ["".join(r.choice("klmnopqrst") for _ in range(5)) for _ in range(200)]
    out = []
    for _ in range(n):
        w = r.choices(plain, k=30)
        a, b = r.random() < 0.5, r.random() < 0.5
        if a:
            w.insert(r.randrange(30), "fool")
        if b:
            w.insert(r.randrange(30), "elves")
        out.append((" ".join(w), int(a and b)))
    return out


def fit(data, **k):
    f = X.make_terms()
    rows, y = [f(t) for t, _ in data], np.array([c for _, c in data])
    keep = X.choose(rows, y)
    return X.fit_fm(rows, y, keep, **k), keep


def test_interaction_is_learned():
    m, keep = fit(texts(600, 1))
    f, test = X.make_terms(m.bits, keep), texts(300, 2)
    p = m.probability([f(t) for t, _ in test])
    assert ((p >= X.THRESHOLD) == np.array([c == 1 for _, c in test])).mean() > 0.98
    both, one, other = (m.raw([f(x)])[0] for x in ("fool elves", "fool", "elves"))
    assert both > 0 > max(one, other)


def pair_alone(n, seed):
    """Toxic where both words are there or neither is: no single term tells anything."""
    r = random.Random(seed)
    plain = ["".join(r.choice("klmnopqrst") for _ in range(5)) for _ in range(200)]
    out = []
    for _ in range(n):
        a, b = r.random() < 0.5, r.random() < 0.5
        w = r.choices(plain, k=20) + ["grum"] * a + ["quidlar"] * b
        r.shuffle(w)
        out.append((" ".join(w), int(a == b)))
    return out


def rare_names(n, seed):
    """Toxic where an insult meets one of 16 names that are frequent in clean texts."""
    r = random.Random(seed)
    plain = ["".join(r.choice("klmnopqrst") for _ in range(5)) for _ in range(200)]
    out = []
    for _ in range(n):
        a, b = r.random() < 0.3, r.random() < 0.5
        w = r.choices(plain, k=20) + ["vilerat"] * a + [f"{'abcd'[k % 4]}{'uvwx'[k // 4]}pe" for k in [r.randrange(16)]] * b
        r.shuffle(w)
        out.append((" ".join(w), int(a and b)))
    return out


@pytest.mark.parametrize("make,n", [(pair_alone, 1000), (rare_names, 3000)])
def test_terms_that_matter_in_pairs_are_kept(make, n):
    m, keep = fit(make(n, 1))
    data = make(1000, 2)
    y = np.array([c for _, c in data])
    f = X.make_terms(m.bits, keep)
    assert ((m.probability([f(t) for t, _ in data]) >= 0.5) == (y == 1)).mean() > 0.95
    if make is pair_alone:  # where additive weights stay at chance
        linear, _ = fit(make(n, 1), factors=0)
        assert abs(((linear.probability([f(t) for t, _ in data]) >= 0.5) == (y == 1)).mean() - 0.5) < 0.1


def test_scores_equal_plain_loops(spark, odd_docs):
    """The query's scores, from the model's parameters on: terms and pairs one by one."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    r = np.random.default_rng(0)
    keep = np.unique(np.concatenate([X.make_terms()(t["text"]).astype(np.int64)[:9] for t in odd_docs.select("text").collect()]))
    m = X.FactorizationMachine(-0.3, keep, r.normal(0, 0.3, len(keep)), r.normal(0, 0.3, (len(keep), 3)))
    got = sorted((str(x["doc_id"]), x["p_toxic"]) for x in X.score_toxicity(odd_docs, m).collect())
    want, place = [], {int(b): i for i, b in enumerate(keep)}
    for x in odd_docs.select("doc_id", "text").collect():
        terms, forms = set(), {}
        for w in {X.bare(w) for w in (x["text"] or "").split()} - {""}:
            terms.add(X.h64("w:" + w) & (2**X.BITS - 1))
            for n in X.STEMS:
                if len(w) >= n:
                    forms[w[:n]] = forms.get(w[:n], 0) + 1
        terms |= {X.level(X.stem_bucket(s), k) for s, n in forms.items() for k in range(1, min(n, X.LEVELS) + 1)}
        at = sorted(place[t] for t in terms if t in place)
        z = m.bias + sum(m.linear[i] for i in at) + sum(float(m.factors[i] @ m.factors[j]) for k, i in enumerate(at) for j in at[k + 1 :])
        want.append((str(x["doc_id"]), 1 / (1 + np.exp(-np.clip(z, -40, 40)))))
    assert [a for a, _ in got] == [a for a, _ in sorted(want)] and np.allclose([p for _, p in got], [p for _, p in sorted(want)])
    assert X.train_toxicity(odd_docs, labels).bits == X.BITS


def test_pairwise_part_by_hand():
    m = X.FactorizationMachine(0.5, np.arange(3), np.array([1.0, -2.0, 3.0]), np.array([[1.0, 2.0], [3.0, -1.0], [0.5, 0.5]]))
    rows = [np.array([0, 2]), np.array([], dtype=int), np.array([0, 1, 2])]
    v = m.factors
    want = [0.5 + 4 + v[0] @ v[2], 0.5, 0.5 + 2 + v[0] @ v[1] + v[0] @ v[2] + v[1] @ v[2]]
    assert np.allclose(m.raw(rows), want)


def test_forms_of_a_stem_count():
    f = X.make_terms()
    one, two = set(f("abcdxx other").tolist()), set(f("abcdxx abcdyy other").tolist())
    stem = X.stem_bucket("abcd")
    assert X.level(stem, 1) in one and X.level(stem, 2) not in one and X.level(stem, 2) in two


def test_odd_rows_pass(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    m = X.train_toxicity(odd_docs, labels)
    s = X.score_toxicity(odd_docs, m)
    assert s.columns == ["doc_id", "p_toxic", "toxic"] and s.count() == odd_docs.count() and s.where("p_toxic is null").count() == 0
    assert X.select_clean(odd_docs, m).columns == odd_docs.columns
    assert X.score_toxicity(no_docs, m).count() == 0
    for none in (X.train_toxicity(no_docs, labels), X.train_toxicity(odd_docs, labels.where("toxic = 1"))):
        assert X.select_clean(odd_docs, none).count() == odd_docs.count()


def test_real_labels_held_out():
    import pandas as pd

    d = "/root/testdata/sf0.1"
    m = pd.read_parquet(f"{d}/labels.parquet").merge(pd.read_parquet(f"{d}/documents.parquet"), on="doc_id").sort_values("doc_id")[:2000]
    data = list(zip(m.text, m.toxic))
    model, keep = fit(data[::2])
    f = X.make_terms(model.bits, keep)
    p = model.probability([f(t) for t, _ in data[1::2]])
    y = np.array([c for _, c in data[1::2]])
    assert (p[y == 1] >= X.THRESHOLD).mean() > 0.8 and (p[y == 0] >= X.THRESHOLD).mean() < 0.01
