import math
import random

import numpy as np

from corpusmill.llm import quality as Q


def texts(n, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    out = []
    for _ in range(n):
        g = r.randint(0, 2)
        w = [word() for _ in range(r.randint(5, 80))]
        if g == 0:
            w = [x.upper() + "!!" for x in w]
        if g == 2:
            w = [x + "," if r.random() < 0.3 else x for x in w]
        out.append((" ".join(w), g))
    return out


def test_held_out_order_and_accuracy():
    f = Q.make_featurizer()
    train, test = texts(400, 1), texts(200, 2)
    m = Q.fit_ordinal([f(t) for t, _ in train], [g for _, g in train])
    assert (np.diff(m.thresholds) > 0).all()
    t = m.tails(m.latent([f(x) for x, _ in test]))
    assert ((t[:, 0] >= 0.5) == np.array([g >= 1 for _, g in test])).mean() > 0.97
    assert (t[:, 0] >= t[:, 1]).all()
    e = m.expected(t)
    assert e.min() >= 0 and e.max() <= 2


def test_gradient_matches_differences():
    r = np.random.default_rng(0)
    z, y, b, h = r.normal(0, 2, 40), r.integers(0, 4, 40), np.array([-1.0, 0.3, 1.7]), 1e-6
    _, dz, db = Q.link_gradient(z, y, b)
    for i in range(40):
        e = np.eye(40)[i] * h
        assert abs((Q.link_gradient(z + e, y, b)[0].sum() - Q.link_gradient(z - e, y, b)[0].sum()) / (2 * h) - dz[i]) < 1e-5
    for k in range(3):
        e = np.eye(3)[k] * h
        assert abs((Q.link_gradient(z, y, b + e)[0].sum() - Q.link_gradient(z, y, b - e)[0].sum()) / (2 * h) - db[k]) < 1e-4


def plain_features(text, bits=Q.BITS):
    """bucket -> value, by the words of the docstring."""
    mask, out = (1 << bits) - 1, {0: 1.0}
    words = (text or "").split()
    if not words:
        return out
    add = lambda b, v: out.__setitem__(b, out.get(b, 0.0) + v)
    own = {Q.h64("w:" + w) & mask for w in words}
    for b in own:
        add(b, Q.OF_WORDS / len(own) ** 0.5)
    seen, n = {}, 0
    for w in words:
        runs = []
        for c in w:
            k = ("A" if c.isupper() else "a") if c.isalpha() else "9" if c.isdigit() else c
            if runs and runs[-1][0] == k:
                runs[-1][1] += 1
            else:
                runs.append([k, 1])
        form = [k + ("+" if m > 1 and k not in "Aa9" else "") for k, m in runs]
        for i in range(0, len(form), Q.RUNS):
            b = Q.h64("s:" + "".join(form[i : i + Q.RUNS])) & mask
            seen[b], n = seen.get(b, 0) + 1, n + 1
    for b, k in seen.items():
        add(b, Q.OF_SHAPES * (k / n) ** 0.5)
    again = sum(a == b for a, b in zip(words, words[1:])) / len(words)
    add(Q.h64(f"r:{min(5, int(again * 20))}") & mask, Q.OF_REPEATS)
    return out


def test_scores_equal_plain_loops(spark, odd_docs):
    """The query's scores, from the model's weights on."""
    m = Q.train_quality(odd_docs, spark.createDataFrame([(i, float(i % 3)) for i in range(40)], "doc_id long, grade double"))
    w = m.weights.astype(np.float32)
    got = sorted((str(r["doc_id"]), round(r["p_keep"], 4), round(r["expected_grade"], 4)) for r in Q.score_quality(odd_docs, m).collect())
    want = []
    for r in odd_docs.select("doc_id", "text").collect():
        z = sum(float(w[b]) * v for b, v in plain_features(r["text"]).items())
        tails = [1 / (1 + math.exp(t - z)) for t in m.thresholds]
        want.append((str(r["doc_id"]), round(tails[0], 4), round(m.grades[0] + sum(t * (b - a) for t, a, b in zip(tails, m.grades, m.grades[1:])), 4)))
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 2e-3 and abs(a[2] - b[2]) < 4e-3 for a, b in zip(got, sorted(want))) and len(got) == len(want)


def test_words_are_read_to_their_end():
    a, b = "x1" * 40 + "A!", "x1" * 40 + "?b"
    assert Q.shapes(a) != Q.shapes(b) and Q.shapes(a)[:3] == Q.shapes(b)[:3] and Q.shapes("***Word,,") == ["*+Aa,+"]
    f = Q.make_featurizer()
    assert f(a).tolist() != f(b).tolist()


def test_odd_rows_pass(spark, odd_docs, no_docs):
    ratings = spark.createDataFrame([(i, float(i % 3)) for i in range(40)] + [(None, 1.0), (3, None), (5, 0.0)], "doc_id long, grade double")
    m = Q.train_quality(odd_docs, ratings)
    n = odd_docs.count()
    s = Q.score_quality(odd_docs, m)
    assert s.columns == ["doc_id", "expected_grade", "p_keep", "selected"] and s.where("p_keep is null").count() == 0 and s.count() == n
    kept = Q.select_quality(odd_docs, m)
    assert kept.columns == odd_docs.columns and kept.count() == s.where("selected").count()
    assert Q.score_quality(no_docs, m).count() == 0
    none = Q.train_quality(no_docs, ratings)
    assert Q.select_quality(odd_docs, none).count() == n


def test_one_grade_keeps_all(spark, odd_docs):
    m = Q.train_quality(odd_docs, spark.createDataFrame([(i, 2.0) for i in range(9)], "doc_id long, grade double"))
    assert Q.select_quality(odd_docs, m).count() == odd_docs.count()


def test_real_labels_held_out():
    import pandas as pd

    d = "/root/testdata/sf0.1"
    m = pd.read_parquet(f"{d}/labels.parquet").merge(pd.read_parquet(f"{d}/documents.parquet"), on="doc_id").sort_values("doc_id")[:2000]
    f = Q.make_featurizer()
    rows, g = [f(t) for t in m.text], (m.quality * (2 - m.toxic)).to_numpy()
    odd = np.arange(len(m)) % 2 == 1
    fit = Q.fit_ordinal([r for r, o in zip(rows, odd) if o], g[odd])
    keep = fit.tails(fit.latent([r for r, o in zip(rows, odd) if not o]))[:, 0] >= 0.5
    truth = m.quality.to_numpy()[~odd] == 1
    assert keep[truth].mean() >= 0.98 and keep[~truth].mean() <= 0.05
