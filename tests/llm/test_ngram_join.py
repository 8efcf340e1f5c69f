import random

import numpy as np
import pytest

from corpusmill.llm import ngram_join as J
from corpusmill.llm.components import connected_components, local_components

from .conftest import doc


def ngrams(text, n=J.N):
    w = [x for x in ("".join(c for c in t.lower() if c.isalnum() or c == "_") for t in (text or "").split()) if x]
    k = min(n, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def find(parent, x):
    while parent.setdefault(x, x) != x:
        x = parent[x]
    return x


def brute(rows, t=J.THRESHOLD):
    """id -> (class, links), over all pairs of distinct (id, set)."""
    nodes = sorted({(r[0], ngrams(r[1])) for r in rows if r[0] is not None}, key=lambda x: x[0])
    parent, links = {}, dict.fromkeys((i for i, _ in nodes), 0)
    for x, (i, a) in enumerate(nodes):
        for j, b in nodes[x + 1 :]:
            if a and b and min(len(a), len(b)) >= t * max(len(a), len(b)) - 1e-9 and len(a & b) / len(a | b) >= t - 1e-12:
                links[i] += 1
                links[j] += 1
                p, q = find(parent, i), find(parent, j)
                parent[max(p, q)] = min(p, q)
    return {i: (find(parent, i), n) for i, n in links.items()}


def corpus(seed, groups=25, alone=40):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(150)]
    rows, i = [], 0
    for _ in range(groups):
        base = r.choices(words, k=r.randint(3, 60))
        for _ in range(r.randint(2, 7)):
            w = list(base)
            for _ in range(r.choice((0, 0, 1, 1, 2, 4))):
                w[r.randrange(len(w))] = r.choice(words)
            rows.append(doc(i, " ".join(w)))
            i += 1
    for _ in range(alone):
        rows.append(doc(i, " ".join(r.choices(words, k=r.randint(1, 60)))))
        i += 1
    r.shuffle(rows)
    return rows


def got(df):
    rows = df.collect()
    assert len(rows) == len({r["doc_id"] for r in rows})
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows}


@pytest.mark.parametrize("t,cell,chunk", [(0.6, 4096, 2_000_000), (0.8, 4, 500), (0.35, 3, 2_000)])
def test_equals_brute_force(docs_of, t, cell, chunk):
    rows = corpus(int(t * 100))
    assert got(J.ngram_jaccard_join(docs_of(rows), t, cell=cell, chunk=chunk)) == brute(rows, t)


def test_pairs_and_members_are_all_links(docs_of):
    rows = corpus(3)
    pairs, member = J.ngram_pairs(docs_of(rows), 0.6, cell=5)
    of = {}
    for r in member.collect():
        of.setdefault(r["set_id"], set()).add(r["doc_id"])
    have = {frozenset((x, y)) for r in pairs.collect() for x in of[r["doc_a"]] for y in of[r["doc_b"]]} | {frozenset((x, y)) for m in of.values() for x in m for y in m if x != y}
    sets = {r[0]: ngrams(r[1]) for r in rows}
    assert have == {frozenset((i, j)) for i in sets for j in sets if i < j and sets[i] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.6 - 1e-12}


def test_odd_rows(odd_docs, no_docs, docs_of):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert got(J.ngram_jaccard_join(odd_docs)) == brute(rows)
    assert J.ngram_jaccard_join(no_docs).count() == 0
    kept = J.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and kept.where("doc_id is null").count() == 1
    # ids with several sets, which join two classes, or are linked to themselves
    rows = [doc(1, "a b c d e f g"), doc(5, "a b c d e f g"), doc(5, "q r s t u v w"), doc(3, "q r s t u v w"), doc(9, "k l m n o p"), doc(9, "k l m n o p"), doc(9, "k l m n o p k l"), doc(7, None), doc(8, "?!")]
    assert got(J.ngram_jaccard_join(docs_of(rows))) == brute(rows)


def test_one_of_each_group_stays(docs_of):
    rows = [doc(7, "a b c d e f g h i j"), doc(3, "a b c d e f g h i j"), doc(9, "A, b c! d e f g h i j"), doc(5, "k l m n o p"), doc(6, "")]
    assert {r["doc_id"] for r in J.drop_near_duplicates(docs_of(rows)).collect()} == {3, 5, 6}


def test_template_is_no_candidate(spark, docs_of):
    """Texts of one template with words of their own share prefix elements, but too late in the order."""
    common = " ".join(f"t{k}" for k in range(62))
    rows = [doc(i, common + " " + " ".join(f"w{i}_{k}" for k in range(38))) for i in range(300)]
    member, low, cells = J._candidates(docs_of(rows), 0.6, J.N, J.CELL, J.CHUNK)
    assert member.count() == 0 and low.count() == 0 and cells.count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_links_join_all_that_pass(seed):
    r = np.random.default_rng(seed)
    m, t = 120, 0.6
    doc, tok, size = np.arange(m), r.integers(0, 6, m).astype(np.uint64), r.integers(5, 40, m)
    left = np.minimum(size, r.integers(1, 40, m))
    low, node = local_components(*J.links_of(doc, tok, size, left, t))
    of = dict(zip(node.tolist(), low.tolist()))
    want = {}
    for i in range(m):
        for j in range(i):
            if tok[i] == tok[j] and size[i] + size[j] <= min(left[i], left[j]) * (1 + t) / t + 1e-9:
                p, q = find(want, i), find(want, j)
                want[max(p, q)] = min(p, q)
    assert {i: of.get(i, i) for i in range(m)} == {i: find(want, i) for i in range(m)}


def test_no_session_changes_a_hash():
    x = np.random.default_rng(0).integers(0, 2**64, 1000, dtype=np.uint64)
    for bits in (0, 5, 8, 13, 16, 24):
        b = x >> np.uint64(64 - bits) if bits else np.zeros(1000, np.uint64)
        for k in (0, 1, 2, 3):
            same = b == b[k]
            assert (J._unpack(J._pack(x[same], bits), bits, int(b[k])) == x[same]).all()


def test_bad_threshold(no_docs):
    with pytest.raises(ValueError):
        J.ngram_jaccard_join(no_docs, 0)


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(5, 5), (None, 3), (4, None)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(parent, a), find(parent, b)
            parent[max(x, y)] = min(x, y)
    out = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {(x["node"], x["component"]) for x in out.collect()} == {(n, find(parent, n)) for n in list(parent)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    sound = [e for e in edges if None not in e]
    low, node = local_components(*map(np.array, zip(*sound)))
    assert all(find(parent, n) == x for x, n in zip(low.tolist(), node.tolist()))
