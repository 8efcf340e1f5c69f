"""Exact top-k search with dual cover trees.

Queries and data are indexed together: both are dealt to cells around the same pivots, and a cell has a cover tree of its data
and one of its queries. A tree comes from farthest-first traversal: the centres of level i are those that were further than
2**i from all before them, so that levels are nested, centres of a level lie more than 2**i apart, and each point within 2**i
of one; the parent of a point is the nearest centre of the level above. Subtrees of at most LEAF points are leaves; small
siblings share one (by the nearest of as many of them as make leaves). Nodes keep the exact covering radius of their points.

A pair of nodes is pruned when d(centres) - radius_q - radius_d exceeds the worst k-th distance among the queries below
the query node; at leaves distances are computed in one matrix product, and those within the bound again by differences,
so that ties are exact. Rounds: every query group (a leaf of a query tree) searches its own cell, then its NEAR nearest
cells, then all cells that the bounds so far leave. Query groups travel to the cells, with their best so far; the data is
dealt once and shuffled once a round. A cell that many groups ask for is worked on in parts.

Results are exact: pivots and cells only set the speed. Broadcast are the pivots, and a centre and radius for each cell:
at most BROADCAST bytes; cells grow beyond CELL vectors when there would be more.

Rows: query id, rank 1..k, neighbour id, distance (Euclidean, of the vectors as they are). A query's own id is not its
neighbour. Defined cases: rows with null id or vector, another dimension than most rows of the data have (the lower one on a
tie), or a null, NaN or infinite element are neither query nor data; equal distances rank by neighbour id; rows that repeat
an id count once, with the lowest vector; with fewer than k other vectors there are fewer rows; vectors of any length are
taken whole; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

K = 10
CELL = 2048
LEAF = 128
QUERY_LEAF = 64
NEAR = 3
GROUPS = 512
MAX_CELLS = 16384
BROADCAST = 32 << 20


def farthest_first(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, distance to the centres before, level, parent); order begins with 0. Copies of a centre come last, at level None (-10**6)."""
    n = len(x)
    sq = (x * x).sum(axis=1)
    order, gap = np.zeros(n, dtype=np.int64), np.zeros(n)
    level, parent = np.full(n, -(10**6), dtype=np.int64), np.full(n, -1, dtype=np.int64)
    near, dist = np.zeros(n, dtype=np.int64), ((x - x[0]) ** 2).sum(axis=1)
    zero = 1e-24 * max(1e-300, float(sq.max()))
    snapshot, now, left = near, None, np.ones(n, dtype=bool)
    gap[0], left[0], dist[0] = np.inf, False, -1
    level[0] = 10**6
    for k in range(1, n):
        p = int(dist.argmax())
        if dist[p] <= zero:  # what is left are copies
            rest = np.flatnonzero(left)
            order[k:], parent[rest] = rest, near[rest]
            break
        g = float(np.sqrt(dist[p]))
        at = int(np.ceil(np.log2(g))) - 1
        if at != now:
            snapshot, now = near.copy(), at
        order[k], gap[p], level[p], parent[p], left[p] = p, g, at, snapshot[p], False
        d = sq + sq[p] - 2 * (x @ x[p])
        close = d < 1e-9 * (sq + sq[p])  # where the product has lost too many digits
        d[close] = ((x[close] - x[p]) ** 2).sum(axis=1)
        closer = left & (d < dist)
        dist[closer], near[closer] = d[closer], p
        dist[p] = -1
    return order, gap, level, parent


class CoverTree:
    """Nodes in arrays; node i covers the points order[begin[i]:end[i]] within radius[i] of centre[i], and has the nodes kids[i]."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x, self.leaf = x, leaf
        self.centre, self.radius, self.begin, self.end, self.kids = [], [], [], [], []
        self.order = np.zeros(0, dtype=np.int64)
        if len(x):
            self._build()
        self.centre = np.array(self.centre).reshape(len(self.radius), x.shape[1] if x.ndim == 2 else 0)
        self.radius, self.begin, self.end = np.array(self.radius), np.array(self.begin), np.array(self.end)

    def _build(self) -> None:
        first, _, level, parent = farthest_first(self.x)
        below: list[list[int]] = [[] for _ in range(len(self.x))]
        for p in first[1:]:
            below[parent[p]].append(int(p))  # by level, the highest first
        size = np.ones(len(self.x), dtype=np.int64)
        for p in first[:0:-1]:
            size[parent[p]] += size[p]
        order: list[int] = []

        def points(p: int, kids: list[int]) -> list[int]:
            out, todo = [p], list(kids)
            while todo:
                q = todo.pop()
                out.append(q)
                todo += below[q]
            return out

        def node(c: np.ndarray) -> int:
            for a, v in ((self.centre, c), (self.radius, 0.0), (self.begin, len(order)), (self.end, 0), (self.kids, [])):
                a.append(v)
            return len(self.centre) - 1

        def close(i: int) -> None:
            self.end[i] = len(order)
            own = self.x[order[self.begin[i] :]]
            self.radius[i] = float(np.sqrt(((own - self.centre[i]) ** 2).sum(axis=1).max()))

        def leaves(me: int, pool: list[list[int]]) -> None:
            """Small siblings together in leaves of at most ``leaf`` points (or one subtree of copies)."""
            heads = np.array([q[0] for q in pool])
            parts = max(1, -(-sum(map(len, pool)) // self.leaf))
            c = self.x[heads[:parts]]
            to = ((c * c).sum(axis=1) - 2 * self.x[heads] @ c.T).argmin(axis=1)
            held: list[int] = []
            for j in np.argsort(to, kind="stable"):
                own = pool[j]
                if held and (len(held) + len(own) > self.leaf or to[j] != last and 2 * len(held) > self.leaf):
                    leaf(me, held)
                    held = []
                held = held + own
                last = to[j]
            leaf(me, held)

        def leaf(me: int, own: list[int]) -> None:
            for a in range(0, len(own), self.leaf):
                part = own[a : a + self.leaf]
                i = node(self.x[part].mean(axis=0))
                order.extend(part)
                close(i)
                self.kids[me].append(i)

        # (point, its children not yet placed, node or None, whether done); a stack, since levels may be many
        stack: list[tuple] = [(int(first[0]), below[int(first[0])], None, False)]
        while stack:
            p, kids, up, done = stack.pop()
            if done:
                close(up)
                continue
            me = node(self.x[p])
            if up is not None:
                self.kids[up].append(me)
            if 1 + sum(int(size[q]) for q in kids) <= self.leaf:
                order.extend(points(p, kids))
                close(me)
                continue
            top = level[kids[0]]
            here = [q for q in kids if level[q] == top]
            later = kids[len(here) :]
            big = [q for q in here if size[q] > self.leaf]
            pool = [points(q, below[q]) for q in here if size[q] <= self.leaf]
            rest = 1 + sum(int(size[q]) for q in later)
            if rest <= self.leaf:
                pool.insert(0, points(p, later))
            if pool:
                leaves(me, pool)
            stack.append((p, kids, me, True))
            stack += [(q, below[q], me, False) for q in big]
            if rest > self.leaf:
                stack.append((p, later, me, False))
        self.order = np.array(order, dtype=np.int64)

    def save(self) -> dict:
        kids = np.array([j for k in self.kids for j in k], dtype="<i4")
        shape = np.stack([self.begin, self.end, [len(k) for k in self.kids]]).astype("<i4")
        return {"centre": self.centre.astype("<f8").tobytes(), "radius": self.radius.astype("<f8").tobytes(), "shape": shape.tobytes(), "kids": kids.tobytes(), "order": self.order.astype("<i4").tobytes()}

    @classmethod
    def load(cls, x: np.ndarray, s) -> CoverTree:
        t = cls.__new__(cls)
        t.x, t.radius = x, np.frombuffer(s["radius"], "<f8")
        t.centre = np.frombuffer(s["centre"], "<f8").reshape(len(t.radius), -1)
        t.begin, t.end, n = np.frombuffer(s["shape"], "<i4").astype(np.int64).reshape(3, -1)
        t.order = np.frombuffer(s["order"], "<i4").astype(np.int64)
        ends = np.cumsum(n)
        t.kids = [k.tolist() for k in np.split(np.frombuffer(s["kids"], "<i4"), ends[:-1])] if len(n) else []
        return t


class TopK:
    """The k best (distance, id) of each query so far."""

    def __init__(self, n: int, k: int):
        self.d, self.i = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def offer(self, rows: np.ndarray, dist: np.ndarray, ids: np.ndarray) -> None:
        """Candidates one by one: query place, distance and id of each."""
        k = self.d.shape[1]
        used = np.unique(rows)
        r = np.concatenate([np.repeat(used, k), rows])
        d, i = np.concatenate([self.d[used].ravel(), dist]), np.concatenate([self.i[used].ravel(), ids])
        o = np.lexsort((i, d, r))
        first = np.searchsorted(r[o], used)
        pick = o[first[:, None] + np.arange(k)]
        self.d[used], self.i[used] = d[pick], i[pick]


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a and b, never too long by more than rounding."""
    return np.sqrt(np.maximum(0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T))


def dual_search(q: CoverTree, qid: np.ndarray, d: CoverTree, did: np.ndarray, best: TopK) -> int:
    """Improves ``best`` with the points of d; gives the number of leaf pairs computed."""
    if not len(q.x) or not len(d.x):
        return 0
    qq, dd = (q.x * q.x).sum(axis=1), (d.x * d.x).sum(axis=1)
    tol = 1e-12 * (float(qq.max()) + float(dd.max()))
    slack = np.sqrt(tol)
    low = _apart(q.centre, d.centre) - q.radius[:, None] - d.radius[None, :] - slack
    heap, done = [(low[0, 0], 0, 0)], 0
    while heap:
        least, a, b = heapq.heappop(heap)
        rows = q.order[q.begin[a] : q.end[a]]
        if least > best.d[rows, -1].max():
            continue
        ka, kb = q.kids[a], d.kids[b]
        if ka and (not kb or q.radius[a] >= d.radius[b]):
            for y in ka:
                heapq.heappush(heap, (low[y, b], y, b))
        elif kb:
            for y in kb:
                heapq.heappush(heap, (low[a, y], a, y))
        else:
            done += 1
            cols = d.order[d.begin[b] : d.end[b]]
            x, y = q.x[rows], d.x[cols]
            d2 = qq[rows][:, None] + dd[cols] - 2 * (x @ y.T)
            ok = d2 <= best.d[rows, -1][:, None] ** 2 + tol
            ok &= qid[rows][:, None] != did[cols][None, :]
            r, c = np.nonzero(ok)
            for at in range(0, len(r), 100_000):
                rr, cc = r[at : at + 100_000], c[at : at + 100_000]
                best.offer(rows[rr], np.sqrt(((x[rr] - y[cc]) ** 2).sum(axis=1)), did[cols[cc]])
    return done


def _nearest(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out, sq, step = np.empty(len(x), dtype=np.int64), (pivots**2).sum(axis=1), max(1, (4 << 20) // len(pivots))
    for a in range(0, len(x), step):
        out[a : a + step] = (sq - 2 * x[a : a + step] @ pivots.T).argmin(axis=1)
    return out


def _clean(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v without what is neither query nor data; a row for each id. A plain array compares element by element."""
    kind = "array<float>" if df.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    v = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("v")).where("id is not null and v is not null and size(v) > 0")
    v = v.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))))
    return v.groupBy("id").agg(F.min("v").alias("v"))


def _fresh(df: DataFrame) -> DataFrame:
    """The same columns under new identities, for a cogroup of what comes from one table."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _floats(x: np.ndarray) -> tuple[int, bytes]:
    """As four bytes each where that loses nothing."""
    with np.errstate(over="ignore"):
        short = x.astype("<f4")
    return (4, short.tobytes()) if (short == x).all() else (8, x.astype("<f8").tobytes())


def _matrix(wide: int, raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<f{wide}").astype(np.float64).reshape(n, -1)


_TREE = "centre binary, radius binary, shape binary, kids binary, order binary"
_CELL = f"kind int, cell int, grp long, ids binary, wide int, x binary, middle array<double>, reach double, worst double, bd binary, bi binary, seen array<int>, {_TREE}"
_NAMES = [c.split()[0] for c in _CELL.split(", ")]
_BEST = "grp long, bd binary, bi binary"


def top_k(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, cell: int = CELL, queries: DataFrame | None = None) -> DataFrame:
    """query_id, rank, neighbor_id, distance: for the vectors of ``queries`` (by default all) the nearest ones of ``vectors``."""
    out = "query_id long, rank int, neighbor_id long, distance double"
    spark = vectors.sparkSession
    v = materialize(_clean(vectors, key, vector))
    asked = v if queries is None else _clean(queries, key, vector)
    sizes = v.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], out)
    dim, n = sizes[0]["dim"], sizes[0]["count"]
    v, asked = v.where(F.size("v") == dim), asked.where(F.size("v") == dim)
    cell = max(cell, -(-n // max(1, min(MAX_CELLS, BROADCAST // (8 * dim)))))
    pivots = np.array([r["v"] for r in v.orderBy(F.xxhash64("id"), "id").limit(-(-n // cell)).collect()], dtype=float)
    shared = spark.sparkContext.broadcast(pivots)

    @F.pandas_udf("int")
    def pivot_of(col: pd.Series) -> pd.Series:
        return pd.Series(_nearest(np.stack(col.to_numpy()).astype(float), shared.value), dtype="int32")

    dealt = v.withColumn("pivot", pivot_of("v"))
    # a row for each pivot, of which there are no more than fit in BROADCAST
    room = dealt.groupBy("pivot").agg(F.ceil(F.count("*") / F.lit(2 * cell)).cast("int").alias("parts"))
    place = (F.col("pivot") + F.lit(MAX_CELLS) * F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")).alias("cell")
    dealt, asked = (df.join(F.broadcast(room), "pivot", "left").select(place, "id", "v") for df in (dealt, asked.withColumn("pivot", pivot_of("v"))))

    def index(keys, data: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        """A row with the data of the cell and its tree, and one for each group of its queries, with the best of the cell."""
        ids, x = data["id"].to_numpy(), np.stack(data["v"].to_numpy()).astype(float) if len(data) else np.zeros((0, dim))
        order = np.argsort(ids)
        ids, x = ids[order], x[order]
        tree, rows = CoverTree(x), []
        if len(ids):
            middle = x.mean(axis=0)
            wide, raw = _floats(x)
            rows.append({"kind": 0, "grp": -1, "ids": ids.astype("<i8").tobytes(), "wide": wide, "x": raw, "middle": middle, "reach": float(np.sqrt(((x - middle) ** 2).sum(axis=1).max())), "worst": 0.0, "bd": b"", "bi": b"", "seen": []} | tree.save())
        qid, q = ask["id"].to_numpy(), np.stack(ask["v"].to_numpy()).astype(float) if len(ask) else np.zeros((0, dim))
        order = np.argsort(qid)
        qid, q = qid[order], q[order]
        qt = CoverTree(q, QUERY_LEAF)
        for i in range(len(qt.radius)):
            if qt.kids[i]:
                continue
            own = qt.order[qt.begin[i] : qt.end[i]]
            gt, best = CoverTree(q[own], QUERY_LEAF), TopK(len(own), k)
            dual_search(gt, qid[own], tree, ids, best)
            wide, raw = _floats(q[own])
            rows.append({"kind": 1, "grp": int(qid[own].min()), "ids": qid[own].astype("<i8").tobytes(), "wide": wide, "x": raw, "middle": qt.centre[i], "reach": float(qt.radius[i]), "worst": float(best.d[:, -1].max()), "bd": best.d.astype("<f8").tobytes(), "bi": best.i.astype("<i8").tobytes(), "seen": [keys[0]], "centre": b"", "radius": b"", "shape": b"", "kids": b"", "order": b""})
        return pd.DataFrame([r | {"cell": keys[0]} for r in rows], columns=_NAMES)

    indexed = materialize(dealt.groupBy("cell").cogroup(_fresh(asked).groupBy("cell")).applyInPandas(index, _CELL))
    cells = indexed.where("kind = 0").select("cell", "ids", "wide", "x", *[c.split()[0] for c in _TREE.split(", ")])
    stats = indexed.where("kind = 0").select("cell", "middle", "reach").toPandas()
    around = spark.sparkContext.broadcast((stats["cell"].to_numpy(), stats["reach"].to_numpy(), np.stack(stats["middle"].to_numpy())))

    def asks(most: int | None):
        """(cell, grp) for the cells that a group still has to search: all, or the nearest."""

        def run(batches):
            other, r, c = around.value
            for b in batches:
                for g, middle, reach, worst, seen in zip(b["grp"], b["middle"], b["reach"], b["worst"], b["seen"]):
                    d = np.sqrt(((c - np.asarray(middle)) ** 2).sum(axis=1))
                    ok = np.flatnonzero((d - r - reach <= worst + 1e-9 * (d + 1)) & ~np.isin(other, np.asarray(seen)))
                    ok = ok[np.argsort(d[ok], kind="stable")[:most]]
                    yield pd.DataFrame({"cell": other[ok], "grp": g})

        return run

    def search(keys, data: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(ask):
            return pd.DataFrame({"grp": [], "bd": [], "bi": []})
        row = data.iloc[0]
        did = np.frombuffer(row["ids"], "<i8")
        tree, found = CoverTree.load(_matrix(row["wide"], row["x"], len(did)), row), []
        for g, ids, wide, x, bd, bi in zip(ask["grp"], ask["ids"], ask["wide"], ask["x"], ask["bd"], ask["bi"]):
            ids = np.frombuffer(ids, "<i8")
            best = TopK(len(ids), k)
            best.d[:], best.i[:] = np.frombuffer(bd, "<f8").reshape(-1, k), np.frombuffer(bi, "<i8").reshape(-1, k)
            dual_search(CoverTree(_matrix(wide, x, len(ids)), QUERY_LEAF), ids, tree, did, best)
            if best.d.tobytes() != bd or best.i.tobytes() != bi:
                found.append((g, best.d.astype("<f8").tobytes(), best.i.astype("<i8").tobytes()))
        return pd.DataFrame(found, columns=["grp", "bd", "bi"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        d = np.stack([np.frombuffer(x, "<f8").reshape(-1, k) for x in pdf["bd"]], axis=1)
        i = np.stack([np.frombuffer(x, "<i8").reshape(-1, k) for x in pdf["bi"]], axis=1)
        best = TopK(len(d), k)
        for a in range(len(d)):  # what several cells give contains what they began with
            pair = sorted(set(zip(d[a].ravel().tolist(), i[a].ravel().tolist())))[:k]
            best.d[a, : len(pair)], best.i[a, : len(pair)] = [x for x, _ in pair], [y for _, y in pair]
        head = pdf[pdf["ids"].notna()].iloc[:1].copy()
        head["bd"], head["bi"], head["worst"] = [best.d.astype("<f8").tobytes()], [best.i.astype("<i8").tobytes()], float(best.d[:, -1].max())
        return head

    state = ["grp", "ids", "wide", "x", "middle", "reach", "worst", "bd", "bi", "seen"]
    groups = indexed.where("kind = 1").select(*state)
    kinds = ", ".join(f"{c} {groups.schema[c].dataType.simpleString()}" for c in state)
    for most in (NEAR, None):
        pairs = materialize(groups.select("grp", "middle", "reach", "worst", "seen").mapInPandas(asks(most), "cell int, grp long"))
        parts = pairs.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(GROUPS)).cast("int").alias("parts"))  # a row for each cell
        visit = pairs.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("grp"), F.col("parts")).cast("int")).drop("parts")
        held = cells.join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        better = held.groupBy("cell", "part").cogroup(_fresh(visit.join(groups, "grp")).groupBy("cell", "part")).applyInPandas(search, _BEST)
        seen = pairs.groupBy("grp").agg(F.collect_list("cell").alias("also")).withColumnRenamed("grp", "__g") if most else None
        after = groups.select(*state).unionByName(better, allowMissingColumns=True).groupBy("grp").applyInPandas(merge, kinds)
        if most:
            after = after.join(seen, after["grp"] == seen["__g"], "left").withColumn("seen", F.concat("seen", F.coalesce("also", F.array().cast("array<int>")))).select(*state)
        groups = materialize(after) if most else after

    def result(batches):
        for b in batches:
            for ids, bd, bi in zip(b["ids"], b["bd"], b["bi"]):
                ids, d, i = np.frombuffer(ids, "<i8"), np.frombuffer(bd, "<f8").reshape(-1, k), np.frombuffer(bi, "<i8").reshape(-1, k)
                r, c = np.nonzero(np.isfinite(d))
                yield pd.DataFrame({"query_id": ids[r], "rank": (c + 1).astype(np.int32), "neighbor_id": i[r, c], "distance": d[r, c]})

    return groups.select("ids", "bd", "bi").mapInPandas(result, out)


EVERY = 50


def op4_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of all vectors to those whose id is divisible by EVERY."""
    v = table(spark, sf_dir, "embeddings")
    return top_k(v, queries=v.where(F.col("vec_id") % EVERY == 0)).withColumn("distance", F.round("distance", 6))


SQL = f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, list_distance(a.e, b.e) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, neighbor_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, neighbor_id, round(d, 6) AS distance FROM r WHERE rank <= {K}
"""
