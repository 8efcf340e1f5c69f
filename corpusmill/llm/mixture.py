"""Mixing sources to target weights.

1. Pack: every text becomes its tokenizer's ids, with the ids of ``EOD`` behind it; they are written once. A source's documents
   are dealt by a hash of the id into groups of about ``group_tokens`` ids; in a group, in order of the id, the ids run on and
   are cut into blocks of exactly ``block_tokens``. What is left over at the end of the groups runs on from group to group,
   into further blocks. So all blocks of a source have the same length, but for its last one, which may be shorter.
   Blocks of a source are numbered 0 .. N_s - 1: those within groups first.
2. Draw: every output shard of ``shard_slots`` slots draws its counts by source from a multinomial with the target
   weights, seeded by (seed, shard) alone.
3. Map: the k-th slot that a source gets in all shards takes block perm_{s,e}(k mod N_s) with e = k div N_s, where perm is
   a Feistel permutation of 0 .. N_s - 1 keyed by (seed, source, e): no block repeats before all of them were used.
4. Join slots and blocks by index. Slots go to the group that holds their index, where the blocks are cut and handed
   out, so ids are shuffled once.

Weights: given by source, or else the source's ids to the power ``alpha``. By default there are as many slots as
blocks. The driver holds one row for each source of the mixture, as the multinomial needs its whole weight vector; groups are
planned in tables, as many as there are.

Texts of blocks are cut between characters: one that a block's end would divide goes to the block in which it begins. Texts of a
source's blocks in one group concatenate to its documents, white space included.

Defined cases: null text and text without a visible character yield nothing; a null source is a source of its own; documents
with null id are dealt by a hash of their text and come first in their group; equal ids follow that hash; repeated rows are
packed as often as they occur; very long texts run through as many blocks as they fill; sources without an id or with weight 0
get no slot; weights of unknown sources are ignored; no id at all gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import TOKENIZER, load_ranks, text_encoder
from .common import fits, h64, materialize, mix, table

BLOCK_TOKENS = 512
SHARD_SLOTS = 256
GROUP_TOKENS = 1_000_000
ALPHA = 0.7
EOD = "\n\n"
STRIDE = 1024
_SCHEMA = "shard long, slot int, source string, block long, n_tokens int, doc_ids array<long>, lang string, ids array<int>, text string"
_COLUMNS = [c.split()[0] for c in _SCHEMA.split(", ")]
_PIECE = "source string, tail long, at long, n int, doc_ids array<long>, lang string, ids binary, text string"


def key_of(*parts) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(repr, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def permute(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """Pseudorandom permutation of 0..n-1: four Feistel rounds on the least even number of bits, walking back into range."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    x = i.astype(np.uint64)
    todo = np.ones(len(x), dtype=bool)
    while todo.any():
        left, right = x[todo] >> np.uint64(half), x[todo] & mask
        for r in range(4):
            left, right = right, left ^ (mix(right ^ np.uint64(key), r + 1) & mask)
        x[todo] = (left << np.uint64(half)) | right
        todo = x >= n
    return x.astype(np.int64)


def shard_counts(seed: int, shard: int, slots: int, p: np.ndarray) -> np.ndarray:
    return np.random.default_rng([seed, shard]).multinomial(slots, p)


def places_of(doc_ids: list, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes that deal the documents, hashes of their texts), signed 64-bit."""
    t = np.fromiter(map(h64, texts), dtype=np.uint64, count=len(texts))
    own = np.array([0 if d is None else d for d in doc_ids], dtype=np.int64).view(np.uint64)
    h = mix(np.where(np.array([d is None for d in doc_ids], dtype=bool), t, own), 9)
    return h.view(np.int64), t.view(np.int64)


def id_type(tokenizer: str) -> str:
    return "<u2" if max(load_ranks(tokenizer).values()) < 65536 else "<u4"


def groups_of(n: int, group_tokens: int) -> int:
    """The number of groups of a source of n ids, a power of two."""
    return 1 << max(0, (-(-n // group_tokens) - 1).bit_length())


def _encode(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, wide = text_encoder(tokenizer), id_type(tokenizer)
        eod = encode(EOD)
        for b in batches:
            for a in range(0, b.num_rows, 1000):
                part = b.slice(a, 1000)
                docs, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                some = [i for i, t in enumerate(texts) if t and not t.isspace()]
                ids = [np.array(encode(texts[i]) + eod, dtype=wide) for i in some]
                h, th = places_of([docs[i] for i in some], [texts[i] for i in some])
                at = pa.array(some, pa.int64())
                n = pa.array(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(2).take(at), part.column(3).take(at), pa.array(h), pa.array(th), n, pa.array([x.tobytes() for x in ids], pa.binary())], names=["doc_id", "source", "lang", "h", "th", "n", "ids"])

    return run


class _Stream:
    """The ids of a group's documents, run together in order; those before id ``begin`` may be left out."""

    def __init__(self, docs: pa.Table, wide: str, by_id: np.ndarray | None, begin: int = 0):
        null = docs["doc_id"].is_null().to_numpy()
        ids = docs["doc_id"].fill_null(0).to_numpy()
        sizes = docs["n"].to_numpy()
        order = np.lexsort((docs["th"].to_numpy(), ids, ~null))
        ends = np.cumsum(sizes[order])
        order, self.ends = order[ends > begin], ends[ends > begin]
        self.doc, self.null, at = ids[order], null[order], pa.array(order)
        self.base = int(self.ends[0] - sizes[order[0]]) if len(order) else 0
        self.size, self.lang = int(ends[-1]), docs["lang"].take(at).to_pylist()
        self.flat = np.frombuffer(b"".join(docs["ids"].take(at).to_pylist()), wide)
        self.by_id = by_id
        if by_id is not None:
            pieces = by_id[self.flat]
            self.bytes = b"".join(pieces)
            self.byte = np.concatenate([[0], np.cumsum(np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)))])

    def ids(self, a: int, z: int) -> np.ndarray:
        return self.flat[a - self.base : z - self.base]

    def docs(self, a: int, z: int) -> tuple[list[int], str | None]:
        """Ids of the documents with an id in [a, z), and the language of the first."""
        i, j = np.searchsorted(self.ends, a, side="right"), np.searchsorted(self.ends, z - 1, side="right")
        return list(dict.fromkeys(int(d) for d, null in zip(self.doc[i : j + 1], self.null[i : j + 1]) if not null)), self.lang[i]

    def text(self, a: int, z: int) -> str | None:
        if self.by_id is None:
            return None
        i, j = self.byte[a - self.base], self.byte[z - self.base]
        while i < len(self.bytes) and self.bytes[i] & 0xC0 == 0x80:
            i += 1
        while j < len(self.bytes) and self.bytes[j] & 0xC0 == 0x80:
            j += 1
        return self.bytes[i:j].decode("utf-8", "replace")


_TYPES = pa.schema([("shard", pa.int64()), ("slot", pa.int32()), ("source", pa.string()), ("block", pa.int64()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lang", pa.string()), ("ids", pa.list_(pa.int32())), ("text", pa.string())])
_PIECES = pa.schema([("source", pa.string()), ("tail", pa.int64()), ("at", pa.int64()), ("n", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lang", pa.string()), ("ids", pa.binary()), ("text", pa.string())])


def _rows(source, right: pa.Table, got: list[tuple], with_text: bool) -> pa.Table:
    """right: shard, slot, block; got: (ids, doc ids, language, text) of each."""
    n = np.fromiter((len(x[0]) for x in got), dtype=np.int32, count=len(got))
    flat = np.concatenate([x[0] for x in got]).astype(np.int32)
    ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat))
    columns = {"shard": right["shard"], "slot": right["slot"], "source": pa.array([source] * len(got), pa.string()), "block": right["block"], "n_tokens": pa.array(n), "doc_ids": pa.array([x[1] for x in got], pa.list_(pa.int64())), "lang": pa.array([x[2] for x in got], pa.string()), "ids": ids}
    if with_text:
        columns["text"] = pa.array([x[3] for x in got], pa.string())
    return pa.table(columns)


def mix_sources(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block_tokens: int = BLOCK_TOKENS, slots: int | None = None, shard_slots: int = SHARD_SLOTS, alpha: float = ALPHA, seed: int = 0, group_tokens: int = GROUP_TOKENS, tokenizer: str = TOKENIZER, with_text: bool = False) -> DataFrame:
    """One row per slot: shard, slot, source, block, n_tokens, doc_ids (in order, of documents with an id in the block), lang (of its first document), ids and, if asked for, text."""
    spark = docs.sparkSession
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"), lang.alias("lang"))
    coded = materialize(docs.mapInArrow(_encode(tokenizer), "doc_id long, source string, lang string, h long, th long, n long, ids binary"), "none", packed="ids")

    held = [(r["source"], r["n"]) for r in coded.groupBy("source").agg(F.sum("n").alias("n")).collect()]
    held.sort(key=lambda x: (x[0] is not None, x[0]))
    sources = spark.createDataFrame([(s, groups_of(n, group_tokens)) for s, n in held], "s string, groups long")
    sources = F.broadcast(sources) if fits(sources) else sources
    dealt = coded.join(sources, coded["source"].eqNullSafe(sources["s"])).withColumn("g", F.col("h").bitwiseAND(F.col("groups") - 1)).drop("s", "groups", "h")
    # whole blocks of a group and what it leaves over; the first block of each, and where its rest begins among the rests
    per = materialize(dealt.groupBy("source", "g").agg(F.sum("n").alias("n")).selectExpr("source", "g", f"n div {block_tokens} as whole", f"n % {block_tokens} as rest"))
    upto = "over (partition by source order by g rows between unbounded preceding and 1 preceding)"
    per = materialize(per.selectExpr("*", f"coalesce(sum(whole) {upto}, 0) as first", f"coalesce(sum(rest) {upto}, 0) as rest_at"))
    total = {r["source"]: (r["w"], r["r"]) for r in per.groupBy("source").agg(F.sum("whole").alias("w"), F.sum("rest").alias("r")).collect()}
    names = [s for s, _ in held]
    p = np.array([n**alpha if weights is None else max(0.0, float(weights.get(s, 0.0))) for s, n in held], dtype=float)
    if not len(names) or not p.sum():
        return spark.createDataFrame([], _SCHEMA).select(*[c for c in _COLUMNS if with_text or c != "text"])
    p /= p.sum()
    whole = np.array([total[s][0] for s in names])
    blocks = whole + np.array([-(-total[s][1] // block_tokens) for s in names])
    slots = int(blocks.sum()) if slots is None else int(slots)
    shards = -(-slots // shard_slots)

    def draws(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for a in range(0, len(b), 256):
                k = b["id"].to_numpy()[a : a + 256]
                c = np.stack([shard_counts(seed, int(i), min(shard_slots, slots - int(i) * shard_slots), p) for i in k])
                i, s = np.nonzero(c)
                yield pd.DataFrame({"shard": k[i], "s": s, "c": c[i, s]})

    # how many slots a source got in earlier shards: sums over ranges of shards on the driver would grow with the output,
    # so a window within each range and one over the few ranges give it
    drawn = spark.range(shards).mapInPandas(draws, "shard long, s int, c long").withColumn("r", F.expr(f"shard div {max(1, int(shards**0.5))}"))
    per_range = drawn.groupBy("s", "r").agg(F.sum("c").alias("rc"))
    before = per_range.selectExpr("s", "r", "coalesce(sum(rc) over (partition by s order by r rows between unbounded preceding and 1 preceding), 0) as base")
    counts = drawn.selectExpr("shard", "s", "r", "c", "coalesce(sum(c) over (partition by s, r order by shard rows between unbounded preceding and 1 preceding), 0) as inner").join(before, ["s", "r"]).selectExpr("shard", "s", "c", "inner + base as start")
    within = counts.selectExpr("shard", "s", "c", "start", "coalesce(sum(c) over (partition by shard order by s rows between unbounded preceding and 1 preceding), 0) as place")

    def slots_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s, rows in b.groupby("s"):
                name, n = names[s], int(blocks[s])
                c = rows["c"].to_numpy()
                step = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                k = np.repeat(rows["start"].to_numpy(), c) + step
                index = np.empty(len(k), dtype=np.int64)
                for e in np.unique(k // n):
                    at = k // n == e
                    index[at] = permute(k[at] % n, n, key_of(seed, name, int(e)))
                yield pd.DataFrame({"source": pd.Series([name] * len(k), dtype=object), "block": index, "tail": index - int(whole[s]), "shard": np.repeat(rows["shard"].to_numpy(), c), "slot": np.repeat(rows["place"].to_numpy(), c) + step})

    placed = materialize(within.mapInPandas(slots_of, "source string, block long, tail long, shard long, slot int"))
    # the group that holds a block: groups are spread over strides of block numbers, so that this is an equi-join
    spread = per.where("whole > 0").select(F.col("source").alias("s"), "g", "first", (F.col("first") + F.col("whole")).alias("last"), F.explode(F.expr(f"sequence(first div {STRIDE}, (first + whole - 1) div {STRIDE})")).alias("stride"))
    spread = F.broadcast(spread) if fits(per) else spread
    inside = placed.where("tail < 0").withColumn("stride", F.expr(f"block div {STRIDE}"))
    inside = inside.join(spread, inside["source"].eqNullSafe(spread["s"]) & (inside["stride"] == spread["stride"]) & (inside["block"] >= spread["first"]) & (inside["block"] < spread["last"])).select("source", "g", "shard", "slot", "block", "first")

    shared = spark.sparkContext.broadcast(_by_id(tokenizer) if with_text else None)
    names_out = [c for c in _COLUMNS if with_text or c != "text"]

    none, wide = pa.schema([f for f in _TYPES if f.name in names_out]).empty_table(), id_type(tokenizer)

    def cut(keys, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return none
        s, got = _Stream(left, wide, shared.value), []
        for b in (right["block"].to_numpy() - right["first"].to_numpy()).tolist():
            a, z = b * block_tokens, (b + 1) * block_tokens
            got.append((s.ids(a, z), *s.docs(a, z), s.text(a, z)))
        return _rows(keys[0].as_py(), right, got, with_text)

    def rests(keys, left: pa.Table, right: pa.Table) -> pa.Table:
        """What is left over behind the whole blocks of a group, as pieces of the source's further blocks."""
        if not len(left) or not len(right):
            return _PIECES.empty_table()
        a, at = sum(left["n"].to_pylist()) // block_tokens * block_tokens, right["rest_at"][0].as_py()
        s, out = _Stream(left, wide, shared.value, a), []
        while a < s.size:
            z = min(s.size, a + block_tokens - at % block_tokens)
            ids, lang_ = s.docs(a, z)
            out.append((keys[0].as_py(), at // block_tokens, at % block_tokens, z - a, ids, lang_, s.ids(a, z).astype("<i4").tobytes(), s.text(a, z)))
            a, at = z, at + z - a
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), _PIECES)], schema=_PIECES)

    def join_pieces(keys, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return none
        left = left.sort_by("at").to_pylist()
        ids = np.frombuffer(b"".join(x["ids"] for x in left), "<i4")
        one = (ids, list(dict.fromkeys(d for x in left for d in x["doc_ids"])), left[0]["lang"], "".join(x["text"] for x in left) if with_text else None)
        return _rows(keys[0].as_py(), right, [one] * len(right), with_text)

    schema = ", ".join(c for c in _SCHEMA.split(", ") if c.split()[0] in names_out)
    full = dealt.groupBy("source", "g").cogroup(inside.groupBy("source", "g")).applyInArrow(cut, schema)
    at = per.where("rest > 0").select("source", "g", "rest_at")
    pieces = dealt.groupBy("source", "g").cogroup(at.groupBy("source", "g")).applyInArrow(rests, _PIECE)  # the same shuffle of ids
    further = pieces.groupBy("source", "tail").cogroup(placed.where("tail >= 0").groupBy("source", "tail")).applyInArrow(join_pieces, schema)
    return full.union(further)


def _by_id(tokenizer: str) -> np.ndarray:
    ranks = load_ranks(tokenizer)
    out = np.full(max(ranks.values()) + 1, b"", dtype=object)
    for piece, i in ranks.items():
        out[i] = piece
    return out


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The slots as rows of ``documents``: doc_id = position of the slot in the output, n_chars = length of the text."""
    size = options.get("shard_slots", SHARD_SLOTS)
    m = mix_sources(docs, with_text=True, **options)
    return m.select((F.col("shard") * F.lit(size) + F.col("slot")).alias("doc_id"), "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))
