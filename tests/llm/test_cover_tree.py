import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import cover_tree as C


def brute(ids, x, k):
    out = {}
    for i, v in zip(ids, x):
        d = np.sqrt(((x - v) ** 2).sum(axis=1))
        o = [(a, b) for a, b in sorted(zip(d.tolist(), ids.tolist())) if b != i][:k]
        out[int(i)] = o
    return out


def clustered(n, dim, seed):
    r = np.random.default_rng(seed)
    c = r.normal(0, 5, (8, dim))
    return c[r.integers(0, 8, n)] + r.normal(0, 1, (n, dim))


@pytest.mark.parametrize("n,dim", [(1, 3), (2, 3), (500, 2), (700, 16), (300, 64)])
def test_tree_is_sound(n, dim):
    x = clustered(n, dim, n)
    if n > 400:
        x[100:140] = x[100]  # copies
    t = C.CoverTree(x, leaf=16)
    assert sorted(t.order.tolist()) == list(range(n))
    for m in range(len(t.centre)):
        below = t.order[t.begin[m] : t.end[m]]
        assert np.sqrt(((x[below] - t.centre[m]) ** 2).sum(axis=1)).max() <= t.radius[m] + 1e-9
        assert len(below) <= 16 if not t.kids[m] else sorted(i for k in t.kids[m] for i in t.order[t.begin[k] : t.end[k]]) == sorted(below)
    back = C.CoverTree.load(x, t.save())
    assert back.kids == t.kids and (back.order == t.order).all() and (back.centre == t.centre).all()


@pytest.mark.parametrize("n,dim", [(400, 2), (300, 16)])
def test_levels_cover_and_separate(n, dim):
    x = clustered(n, dim, n)
    x[50:60] = x[50]
    order, gap, level, parent = C.farthest_first(x)
    assert sorted(order.tolist()) == list(range(n))
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for i in sorted(set(level[(level > -(10**6)) & (level < 10**6)].tolist())):
        centres = np.flatnonzero(level >= i)
        d = apart[np.ix_(centres, centres)]
        assert d[~np.eye(len(centres), dtype=bool)].min() > 2.0**i * (1 - 1e-9)  # separation
        assert apart[:, centres].min(axis=1).max() <= 2.0**i * (1 + 1e-9)
        for p in np.flatnonzero(level == i):  # covering by the level above, nested
            assert level[parent[p]] > i and apart[p, parent[p]] <= 2.0 ** (i + 1) * (1 + 1e-9)
    assert all(apart[p, parent[p]] == 0 for p in np.flatnonzero(level == -(10**6)))


def test_pruning_saves_work():
    x = clustered(3000, 3, 1)
    t, best, ids = C.CoverTree(x, leaf=32), C.TopK(3000, 5), np.arange(3000)
    done = C.dual_search(t, ids, t, ids, best)
    leaves = sum(not k for k in t.kids)
    assert done < leaves * leaves / 3
    want = brute(ids, x, 5)
    assert all(np.allclose(best.d[i], [d for d, _ in want[i]]) for i in range(3000))


def test_clusters_are_pruned_in_many_dimensions():
    """Far clusters of 64 dimensions: leaf pairs across them aren't computed."""
    r = np.random.default_rng(3)
    c = r.normal(0, 20, (12, 64))
    x = c[np.arange(1200) % 12] + r.normal(0, 1, (1200, 64))
    t, best, ids = C.CoverTree(x, leaf=64), C.TopK(1200, 5), np.arange(1200)
    leaves = sum(not k for k in t.kids)
    assert C.dual_search(t, ids, t, ids, best) < leaves * leaves / 3


def as_dict(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["distance"], r["neighbor_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("cell", [40, 5000])
def test_equals_brute_force(spark, cell):
    x = clustered(400, 8, 2)
    x[50:60] = x[50]  # ties
    ids = np.arange(400) * 3
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got, want = as_dict(C.top_k(df, k=7, cell=cell)), brute(ids, x, 7)
    assert got.keys() == want.keys()
    for i in got:
        assert [b for _, b in got[i]] == [b for _, b in want[i]]
        assert np.allclose([a for a, _ in got[i]], [a for a, _ in want[i]])


def test_queries_of_another_table(spark):
    x, q = clustered(300, 8, 5), clustered(40, 8, 6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(1000 + i, v.tolist()) for i, v in enumerate(q)] + [(7, x[7].tolist())], "vec_id long, embedding array<double>")
    got = as_dict(C.top_k(df, k=4, cell=30, queries=asked))
    x = x.astype(np.float32).astype(float)
    assert len(got) == 41 and 7 not in [b for _, b in got[7]]
    for i, v in enumerate(q):
        d = np.sqrt(((x - v) ** 2).sum(axis=1))
        assert [b for _, b in got[1000 + i]] == np.argsort(d, kind="stable")[:4].tolist()


def test_hot_vector(spark):
    """A third of all rows are one vector."""
    x = clustered(600, 4, 9)
    x[:200] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got, want = as_dict(C.top_k(df, k=3, cell=20, queries=df.where("vec_id % 7 = 0"))), brute(np.arange(600), x, 3)
    assert got.keys() == {i for i in range(600) if i % 7 == 0}
    assert all([b for _, b in got[i]] == [b for _, b in want[i]] for i in got)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 0.0]), (2, [0.0, 3.0]), (3, [4.0, 0.0]), (None, [1.0, 1.0]), (4, None), (5, [1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, []), (9, [None, 1.0]), (1, [0.0, 0.0]), (2, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash")).withColumn("cell", F.lit(1)).withColumn("v", F.lit(2))
    assert as_dict(C.top_k(df, k=5)) == {1: [(3.0, 2), (4.0, 3)], 2: [(3.0, 1), (5.0, 3)], 3: [(4.0, 1), (5.0, 2)]}
    assert C.top_k(df.limit(0)).count() == 0 and C.top_k(df.where("vec_id = 3")).count() == 0
