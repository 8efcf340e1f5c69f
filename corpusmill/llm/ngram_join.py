"""N-gram Jaccard self-join with filters under several global token orders.

Two documents are linked when their sets of word n-grams have a Jaccard similarity of at least ``threshold``; exact up to
equality of 64-bit n-gram hashes. Prefix filter: in any global order of the n-grams, two such sets of n and m elements must
share an element among the first n - ceil(t n) + 1 and m - ceil(t m) + 1. This holds for every order, so a pair is verified
only if it shares prefix elements under all of ``ORDERS`` (their candidate sets are intersected). Each order puts rare n-grams
first, with frequencies counted over the whole corpus and kept in eighths of an octave (one byte), and breaks ties in its own way:

    0: eighth of an octave, then hash;  1: octave, then a second hash;  2: two octaves, then a third one.

An n-gram of one document only comes first in each of them and can't be shared, so it is only counted.

Positional filter: with r elements of a set from a shared prefix element on, the pair shares at most the lesser r, so both
sizes together are at most min(r, r') (1 + t) / t. Texts of a common template that differ in their own words end here: they
share elements, but too late in the order.

Plan, linear in the input but for the pairs of different sets that are verified within a class:
 1. every text -> set of hashes; a chunk of documents is cut into buckets by hash and shuffled as packed blocks;
 2. per bucket: frequencies; what occurs twice goes back to its chunk with its frequency;
 3. per chunk: prefixes under order 0; documents with a shareable prefix are written with their shareable n-grams;
 4. per bucket of prefix elements: a spanning forest of the documents that share one and pass the filters of size and place;
 5. connected components of these links: no qualifying pair crosses them;
 6. in a component, equal sets collapse to one with their number; the rest is joined under all orders, intersected and
    verified. Components of over CELL sets or ROOM n-grams are cut into a grid of blocks, so that no task holds all of one.
    What leaves a task are the number of links of each set and the forest of its classes, not pairs.

Rows: doc_id, class_id, n_links for every document: n_links is the number of other documents that it is linked to, copies
one by one; class_id the lowest id of those that a chain of links joins with it, its own if there is none. The result grows
with the documents, though links grow with the squares of the classes. ``ngram_pairs`` gives the links between different
sets one by one, and each set's documents.

Defined cases: the words of a text are its white-space tokens, lower-cased, with all but letters, digits and underscores
removed; a text of fewer than n words has one element, all its words together; null texts and texts without a word have
the empty set and no link; rows with null id are ignored; rows that repeat an id and its set count once; an id with
several sets is one row, whose links are those of all its sets, between themselves too; very long texts are taken whole;
an empty table gives no row; the result has no other columns of the input.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, drop_ids, fits, h64, materialize, mix, parallelism, table
from .components import connected_components, local_components

N = 3
THRESHOLD = 0.6
ORDERS = 3
CHUNK = 2_000_000
CELL = 4096
ROOM = 8_000_000
LEAST_BITS = 8
_JUNK = re.compile(r"[^\w]+")


def word_hash(word: str) -> int:
    """0 for a token without letter, digit or underscore."""
    w = _JUNK.sub("", word.lower())
    return (h64(w) or 1) if w else 0


def make_sets(n: int = N):
    """text -> sorted distinct 64-bit hashes of its word n-grams."""
    memo = Memo(word_hash)

    def ngrams(text: str | None) -> np.ndarray:
        words = text.split() if text else ()
        a = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))
        a = a[a != 0]
        if not len(a):
            return a
        k = min(n, len(a))
        h = mix(a[: len(a) - k + 1], 1)
        for i in range(1, k):
            h = mix(h + a[i : len(a) - k + 1 + i], i + 1)
        h.sort()
        return h[np.concatenate([[True], h[1:] != h[:-1]])]

    return ngrams


def prefix_length(n: np.ndarray, t: float) -> np.ndarray:
    return n - np.ceil(t * n - 1e-9).astype(np.int64) + 1


def level_of(df: np.ndarray) -> np.ndarray:
    """Document frequency in eighths of an octave, one byte."""
    return np.minimum(255, np.floor(8 * np.log2(df) + 1e-9)).astype(np.uint8)


def order_key(order: int, token: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(major, minor) sort key of tokens in a global order."""
    if order == 0:
        return level, token
    return level // (8 if order == 1 else 16), mix(token, 100 + order)


def _pack(tokens: np.ndarray, bits: int) -> bytes:
    """The bits below the ``bits`` of the bucket, in whole bytes: with the bucket they are all 64."""
    wide = 8 - bits // 8
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide]).tobytes()


def _unpack(block: bytes, bits: int, bucket: int) -> np.ndarray:
    wide = 8 - bits // 8
    raw = np.zeros((len(block) // wide, 8), dtype=np.uint8)
    raw[:, :wide] = np.frombuffer(block, np.uint8).reshape(-1, wide)
    return raw.view("<u8").ravel() | (np.uint64(bucket << (64 - bits)) if bits else np.uint64(0))


def _small(counts: np.ndarray) -> bytes:
    """Counts as bytes where all fit, else as 32-bit numbers; _counts tells by the number of them."""
    return counts.astype(np.uint8 if not len(counts) or counts.max() < 256 else "<u4").tobytes()


def _counts(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint8 if len(raw) == n else "<u4").astype(np.int64)


_BLOCK = "bucket long, chunk long, sizes binary, tokens binary, extra binary"


def _emit_chunk(chunk: int, ids: list[int], sets: list[np.ndarray], bits: int) -> Iterator[pd.DataFrame]:
    """One header (bucket -1 - chunk) with ids, set sizes and signatures, and a packed block for each bucket."""
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    flat = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), sizes)
    bucket = (flat >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(flat), dtype=np.int64)
    order = np.argsort(bucket.astype(np.int32) if bits <= 31 else bucket, kind="stable")
    flat, doc, ends = flat[order], doc[order], np.cumsum(np.bincount(bucket, minlength=1 << bits))
    sig = b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets)
    rows = [(-1 - chunk, chunk, sizes.astype("<i4").tobytes(), np.array(ids, dtype="<i8").tobytes(), sig)]
    start = 0
    for b, end in enumerate(ends):
        if end > start:
            rows.append((b, chunk, _small(np.bincount(doc[start:end], minlength=len(sets))), _pack(flat[start:end], bits), np.int32(len(sets)).tobytes()))
        start = end
    yield pd.DataFrame(rows, columns=["bucket", "chunk", "sizes", "tokens", "extra"])


def _chunks(n: int, bits: int, room: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ngrams, ids, sets, held, k = make_sets(n), [], [], 0, 0
        first = TaskContext.get().partitionId() << 24
        for batch in batches:
            for i, text in zip(batch["doc_id"], batch["text"]):
                s = ngrams(text)
                if not len(s):
                    continue
                ids.append(int(i))
                sets.append(s)
                held += len(s)
                if held >= room:
                    yield from _emit_chunk(first + k, ids, sets, bits)
                    ids, sets, held, k = [], [], 0, k + 1
        if sets:
            yield from _emit_chunk(first + k, ids, sets, bits)

    return run


def _frequencies(bits: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Blocks of one bucket -> per chunk the shareable tokens, the levels of their frequency and how many each document has."""
        if pdf["bucket"].iloc[0] < 0:
            return pdf
        blocks = [_unpack(x, bits, b) for b, x in zip(pdf["bucket"], pdf["tokens"])]
        flat = np.concatenate(blocks)
        order = np.argsort(flat)
        s = flat[order]
        start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        count = np.diff(np.concatenate([start, [len(s)]]))
        df = np.empty(len(s), dtype=np.int64)
        df[order] = np.repeat(count, count)
        out, at = [], 0
        for b, c, per, size, block in zip(pdf["bucket"], pdf["chunk"], pdf["sizes"], pdf["extra"], blocks):
            d = df[at : at + len(block)]
            at += len(block)
            per = _counts(per, int(np.frombuffer(size, "<i4")[0]))
            some = d > 1
            if some.any():
                doc = np.repeat(np.arange(len(per)), per)[some]
                out.append((b, c, _small(np.bincount(doc, minlength=len(per))), _pack(block[some], bits), level_of(d[some]).tobytes()))
        return pd.DataFrame(out, columns=["bucket", "chunk", "sizes", "tokens", "extra"])

    return run


_RECORD = "kind int, key long, doc_id long, n long, sig binary, tokens binary, level binary, place binary"


def _prefixes(t: float, bits: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf[pdf["bucket"] < 0].iloc[0]
        n = np.frombuffer(head["sizes"], "<i4").astype(np.int64)
        ids = np.frombuffer(head["tokens"], "<i8")
        body = pdf[pdf["bucket"] >= 0]
        names = [c.split()[0] for c in _RECORD.split(", ")]
        if not len(body):
            return pd.DataFrame(columns=names)
        docs, toks, levels = [], [], []
        for b, per, tok, level in zip(body["bucket"], body["sizes"], body["tokens"], body["extra"]):
            docs.append(np.repeat(np.arange(len(n)), _counts(per, len(n))))
            toks.append(_unpack(tok, bits, b))
            levels.append(np.frombuffer(level, np.uint8))
        doc, tok, level = np.concatenate(docs), np.concatenate(toks), np.concatenate(levels)
        major, minor = order_key(0, tok, level)
        order = np.lexsort((minor, major, doc))
        doc, tok, level = doc[order], tok[order], level[order]
        held = np.bincount(doc, minlength=len(n))
        room = np.maximum(0, prefix_length(n, t) - (n - held))
        start = np.concatenate([[0], np.cumsum(held)])
        rank = np.arange(len(doc)) - start[doc]
        chosen = rank < room[doc]
        out = []
        for i in np.flatnonzero((room > 0) & (held > 0)):
            a, z = start[i], start[i + 1]
            out.append((0, 0, int(ids[i]), int(n[i]), head["extra"][16 * i : 16 * i + 16], tok[a:z].astype("<u8").tobytes(), level[a:z].tobytes(), b""))
        left = (held[doc] - rank)[chosen]
        doc, tok = doc[chosen], tok[chosen]
        bucket = (mix(tok, 7) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(tok), dtype=np.int64)
        order = np.argsort(bucket, kind="stable")
        doc, tok, left, bucket = doc[order], tok[order], left[order], bucket[order]
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
        for a, z in zip(cut, [*cut[1:], len(bucket)]):
            d, per = np.unique(doc[a:z], return_counts=True)
            o = np.argsort(doc[a:z], kind="stable")
            out.append((1, int(bucket[a]), 0, 0, ids[d].astype("<i8").tobytes(), tok[a:z][o].astype("<u8").tobytes(), np.stack([per, n[d]]).astype("<i4").tobytes(), left[o + a].astype("<i4").tobytes()))
        return pd.DataFrame(out, columns=names)

    return run


def links_of(doc: np.ndarray, tok: np.ndarray, size: np.ndarray, left: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join all postings of a token that pass both filters, as many as postings at most.

    A posting reaches sizes up to ``left * (1 + t) / t - size``; a pair passes if each reaches the other. Those that reach
    their own size are joined, in order of size, to the one before them of furthest reach, as far as that goes; the others
    reach only smaller ones, which then all reach each other, so that one of these is enough.
    """
    reach = np.floor(left * (1 + t) / t + 1e-9).astype(np.int64) - size
    group = np.unique(tok, return_inverse=True)[1].astype(np.int64)
    order = np.lexsort((doc, size, group))
    doc, size, reach, group = doc[order], size[order], reach[order], group[order]
    wide = int(max(size.max(initial=0), reach.max(initial=0))) + 2
    own = reach >= size
    far = np.maximum.accumulate(group * wide + np.where(own, reach + 1, 0))
    best = np.maximum.accumulate(np.where(own & (far == group * wide + reach + 1), np.arange(len(doc)), -1))
    # the last posting that may be the partner: the one before, or for short reaches the last that is small enough
    upto = np.searchsorted(group * wide + size, group * wide + np.minimum(np.maximum(reach, 0), size), side="right")
    upto = np.minimum(upto - 1, np.arange(len(doc)) - 1)
    b = np.where(upto >= 0, best[np.maximum(upto, 0)], -1)
    ok = (b >= 0) & (group[b] == group) & (reach[b] >= size) & (doc[b] != doc)
    return doc[ok], doc[b[ok]]


def _links(t: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        doc, tok, size, left = [], [], [], []
        for ids, tokens, shape, place in zip(pdf["sig"], pdf["tokens"], pdf["level"], pdf["place"]):
            per, n = np.frombuffer(shape, "<i4").reshape(2, -1)
            doc.append(np.repeat(np.frombuffer(ids, "<i8"), per))
            size.append(np.repeat(n, per).astype(np.int64))
            tok.append(np.frombuffer(tokens, "<u8"))
            left.append(np.frombuffer(place, "<i4").astype(np.int64))
        a, b = links_of(np.concatenate(doc), np.concatenate(tok), np.concatenate(size), np.concatenate(left), t)
        low, node = local_components(a, b)
        return pd.DataFrame({"a": low, "b": node})

    return run


def _local_pairs(n: np.ndarray, toks: list[np.ndarray], levels: list[np.ndarray], side: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Verified pairs (i, j, jaccard) among few sets; side: the block of each, and pairs of one block are skipped if there are two."""
    held = np.fromiter(map(len, toks), dtype=np.int64, count=len(toks))
    flat, level = np.concatenate(toks), np.concatenate(levels)
    doc = np.repeat(np.arange(len(toks)), held)
    _, local = np.unique(flat, return_inverse=True)
    room = np.minimum(held, np.maximum(0, prefix_length(n, t) - (n - held)))
    start = np.concatenate([[0], np.cumsum(held)])
    prefixes = []
    for k in range(ORDERS):
        major, minor = order_key(k, flat, level)
        order = np.lexsort((minor, major, doc))
        chosen = (np.arange(len(doc)) - start[doc]) < room[doc]
        prefixes.append((doc[order][chosen], local[order][chosen]))
    width = int(local.max()) + 1
    both = len(np.unique(side)) > 1
    # order 0 as an inverted index, sorted by token and set size; the other orders as marks of one set at a time
    d0, l0 = prefixes[0]
    o = np.lexsort((n[d0], l0))
    d0, l0 = d0[o], l0[o]
    first = np.searchsorted(l0, np.arange(width + 1))
    at = [np.searchsorted(d, np.arange(len(toks) + 1)) for d, _ in prefixes]
    mark = np.zeros(width, dtype=np.int64)
    for i in range(len(toks)):
        mine = prefixes[0][1][at[0][i] : at[0][i + 1]]
        if not len(mine):
            continue
        cand = np.unique(np.concatenate([d0[first[x] : first[x + 1]] for x in mine]))
        # the larger set of a pair finds the smaller one; of equal sizes, the later finds the earlier
        ok = ((n[cand] < n[i]) | ((n[cand] == n[i]) & (cand < i))) & (n[cand] >= t * n[i] - 1e-9)
        if both:
            ok &= side[cand] != side[i]
        cand = cand[ok]
        for k in range(1, ORDERS):
            if not len(cand):
                break
            p = prefixes[k][1]
            mark[p[at[k][i] : at[k][i + 1]]] = 1
            cand = cand[_gather(mark, p, at[k][cand], at[k][cand + 1]) > 0]
            mark[p[at[k][i] : at[k][i + 1]]] = 0
        if not len(cand):
            continue
        own = local[start[i] : start[i + 1]]
        mark[own] = 1
        common = _gather(mark, local, start[cand], start[cand + 1])
        mark[own] = 0
        j = common / (n[i] + n[cand] - common)
        good = j >= t - 1e-12
        if good.any():
            yield np.full(int(good.sum()), i), cand[good], j[good]


def _gather(mark: np.ndarray, values: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Sums of mark[values[a_k:z_k]]."""
    n = z - a
    out = np.zeros(len(a), dtype=np.int64)
    some = n > 0
    if some.any():
        n, a = n[some], a[some]
        begin = np.concatenate([[0], np.cumsum(n)[:-1]])
        where = np.arange(n.sum()) + np.repeat(a - begin, n)
        out[some] = np.add.reduceat(mark[values[where]], begin)
    return out


def _cells(t: float, pairs: bool):
    """Verified pairs of the sets of each cell, or what they amount to: links of each set and a forest of their classes."""
    names = ["a", "b", "jaccard"] if pairs else ["doc_id", "sig", "root", "links"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for (_, i, j), g in pdf.groupby(["component", "i", "j"], sort=False):
            if len(g) < 2 or i != j and g["side"].nunique() < 2:  # pairs within a block are found in its own cell
                continue
            g = g.drop_duplicates(["doc_id", "sig"]).sort_values(["doc_id", "sig"], kind="stable")
            ids, copies = g["doc_id"].to_numpy(), g["copies"].to_numpy()
            toks = [np.frombuffer(x, "<u8") for x in g["tokens"]]
            levels = [np.frombuffer(x, np.uint8) for x in g["level"]]
            a, b, jac, links = [], [], [], np.zeros(len(g), dtype=np.int64)
            for x, y, s in _local_pairs(g["n"].to_numpy(), toks, levels, g["side"].to_numpy(), t):
                links[x[0]] += copies[y].sum()
                links[y] += copies[x[0]]
                a.append(x)
                b.append(y)
                jac.append(s)
            if not a:
                continue
            a, b = ids[np.concatenate(a)], ids[np.concatenate(b)]
            if pairs:
                found.append(pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "jaccard": np.concatenate(jac)}))
                continue
            low, node = local_components(a, b)
            at = np.flatnonzero(links)
            found.append(pd.DataFrame({"doc_id": ids[at], "sig": g["sig"].to_numpy()[at], "root": low[np.searchsorted(node, ids[at])], "links": links[at]}))
        return pd.concat(found) if found else pd.DataFrame({c: pd.Series(dtype=object if c == "sig" else float if c == "jaccard" else np.int64) for c in names})

    return run


def _candidates(docs: DataFrame, threshold: float, n: int, cell: int, chunk: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(member: component, doc_id, sig;  low: component, sig, its lowest doc_id, copies;  cells of the sets that may be linked)."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    width = parallelism(docs.sparkSession)
    bits = min(24, max(LEAST_BITS, math.ceil(math.log2(width))))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")

    blocks = docs.mapInPandas(_chunks(n, bits, chunk), _BLOCK)
    shareable = blocks.groupBy("bucket").applyInPandas(_frequencies(bits), _BLOCK)
    records = materialize(shareable.groupBy("chunk").applyInPandas(_prefixes(threshold, bits), _RECORD))

    posts = records.where("kind = 1").select("key", "sig", "tokens", "level", "place")
    component = materialize(connected_components(posts.groupBy("key").applyInPandas(_links(threshold), "a long, b long")))

    # who meets whom is settled on ids and signatures; token sets are joined once, to the cells
    sets = records.where("kind = 0").select("doc_id", "n", "sig", "tokens", "level")
    held = sets.select("doc_id", "sig", F.length("level").alias("held"))
    # an id with several sets meets itself, though no other document
    own = held.groupBy("doc_id").agg(F.countDistinct("sig").alias("k")).where("k > 1").select(F.col("doc_id").alias("node"), F.col("doc_id").alias("component"))
    component = component.union(own.join(component.select("node"), "node", "left_anti"))
    member = materialize(held.join(component, held["doc_id"] == component["node"]).select("component", "doc_id", "sig", "held").distinct())
    low = materialize(member.groupBy("component", "sig").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.max("held").alias("held")))
    size = F.ceil(F.greatest(F.count("*") / F.lit(cell), F.sum("held") / F.lit(ROOM))).cast("int")
    blocks_of = low.groupBy("component").agg(F.count("*").alias("k"), size.alias("nb")).where("k > 1").select("component", "nb")
    cells = materialize(
        low.join(blocks_of, "component")
        .withColumn("side", F.pmod(F.xxhash64("doc_id", "sig"), F.col("nb")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .select("component", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "doc_id", "sig", "copies")
    )
    wanted = materialize(cells.select("doc_id").distinct())
    if fits(wanted):  # sets that meet no other aren't shuffled; beyond this size they are
        sets = sets.join(F.broadcast(wanted), "doc_id", "left_semi")
    bin_ = F.when(F.col("i") + F.col("j") > 0, F.xxhash64("component", "i", "j")).otherwise(F.pmod(F.xxhash64("component"), F.lit(4 * width)))
    return member, low, cells.join(sets, ["doc_id", "sig"]).withColumn("bin", bin_)


def ngram_pairs(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, cell: int = CELL, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(doc_a < doc_b, jaccard: the links of different sets, each by its lowest id;  set_id, doc_id: whose set is that of set_id)."""
    member, low, cells = _candidates(docs, threshold, n, cell, chunk)
    pairs = cells.groupBy("bin").applyInPandas(_cells(threshold, True), "a long, b long, jaccard double").where("a <> b")
    of = member.select("component", "sig", F.col("doc_id").alias("d")).join(low, ["component", "sig"]).select(F.col("doc_id").alias("set_id"), F.col("d").alias("doc_id"))
    return pairs.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"), "jaccard"), of


def _classes(docs: DataFrame, threshold: float, n: int, cell: int, chunk: int) -> DataFrame:
    """doc_id, class_id, n_links of the documents that have a link."""
    member, low, cells = _candidates(docs, threshold, n, cell, chunk)
    met = materialize(cells.groupBy("bin").applyInPandas(_cells(threshold, False), "doc_id long, sig binary, root long, links long"))
    by_set = met.groupBy("doc_id", "sig").agg(F.min("root").alias("root"), F.sum("links").alias("links"))
    sets = low.join(by_set, ["doc_id", "sig"], "left").select("component", "sig", F.coalesce("root", "doc_id").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    of = materialize(member.select("component", "sig", "doc_id").join(sets, ["component", "sig"]).groupBy("doc_id").agg(F.min("root").alias("root"), F.collect_set("root").alias("roots"), F.sum("links").alias("n_links")).where("n_links > 0"))
    # classes that meet in another cell of a grid, or through an id with several sets
    crossing = met.join(by_set.select("doc_id", "sig", F.col("root").alias("a")), ["doc_id", "sig"]).select("a", F.col("root").alias("b")).where("a <> b")
    crossing = crossing.union(of.where(F.size("roots") > 1).select(F.col("root").alias("a"), F.explode("roots").alias("b")))
    merged = connected_components(crossing)
    return of.join(merged, of["root"] == merged["node"], "left").select("doc_id", F.coalesce("component", "root").alias("class_id"), "n_links")


def ngram_jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, cell: int = CELL, chunk: int = CHUNK) -> DataFrame:
    """doc_id, class_id and n_links of every document, as described above."""
    found = _classes(docs, threshold, n, cell, chunk).withColumnRenamed("doc_id", "__id")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    return ids.join(found, ids["doc_id"] == found["__id"], "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """The input rows, all columns as they are, without the documents of a class other than the one of lowest id; null ids stay."""
    found = _classes(docs, threshold, n, CELL, CHUNK)
    return drop_ids(docs, materialize(found.where("doc_id <> class_id").select("doc_id")))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


_W = "list_filter(list_transform(string_split_regex(lower(text), '\\s+'), lambda w: regexp_replace(w, '[^\\p{L}\\p{N}_]', '', 'g')), lambda w: w <> '')"
SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_W} AS w FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < {N} THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - {N} + 2), lambda i: array_to_string(w[i:i + {N} - 1], ' ')) END) AS g FROM w WHERE len(w) > 0),
s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
p AS (SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE c / (x.n + y.n - c)::DOUBLE >= {THRESHOLD}),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id, doc_id AS x FROM documents WHERE doc_id IS NOT NULL UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.x)
SELECT r.doc_id, min(r.x) AS class_id, (SELECT count(*) FROM e WHERE e.a = r.doc_id)::BIGINT AS n_links FROM r GROUP BY r.doc_id
"""
