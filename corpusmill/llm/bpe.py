"""Byte-level BPE through a table of distinct words.

Encoding: texts are split into words by the tokenizer's own pattern. A partition of the input numbers its distinct words
in order of occurrence (a segment); the words of all segments are grouped, each distinct word is encoded once, and its ids
go back to (segment, number). The ids, packed, form a table in the shared folder: segments are dealt to a bounded number of
folders, sorted within, and a task reads the row group that holds its own. A second pass over the texts splits them again, numbers the words alike and joins ids back by position. Texts are never
shuffled, only distinct words are; no driver holds or broadcasts a vocabulary of the corpus. If a partition comes back
with other rows (an input that isn't deterministic), a word's check hash differs and the word is encoded on the spot.

Decoding: of a group of neighbouring rows the distinct ids, a row each, are joined with the id-to-piece table of the tokenizer, whose
size is fixed (and measured before it is broadcast); the group itself travels in the row behind its ids, and the pieces go back
to their places there. A broadcast join leaves rows in order in their partition, so that nothing is shuffled; with a table too
large for that, groups are dealt by partition and sorted. ``op3_bpe`` does both: its text comes from its ids.

Defined cases: null text has null ids and null n_tokens; empty text has no ids and n_tokens 0; text is ordinary text, also
where it spells a special token; very long texts and words are encoded whole, in time that grows as n log n; repeated rows and
null ids are encoded as they are; an empty table gives no row; other columns are kept, but for columns named ``ids`` or
``n_tokens``, which the result replaces. In decoding, null ids give null text and no ids the empty text; an id that the table
lacks, or null, gives the replacement character, as do bytes that are no UTF-8; ``decode`` keeps no other columns than the key,
and ``encode_with_text`` replaces a column named ``text`` too.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.storage import shared_folder
from .common import Memo, fits, parallelism, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEGMENT_WORDS = 1_000_000
PACKED_WORDS = 500_000
FOLDERS = 4096
TOGETHER = 500_000
NARROW = 1 << 22
GROUPS = "__id int, rows binary"
REPLACEMENT = "\ufffd".encode()


def load_ranks(path: str = TOKENIZER) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class WordEncoder:
    """Merges of one word: the pair of lowest rank first, leftmost on ties; pairs wait in a heap."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __call__(self, word: bytes) -> list[int]:
        ranks = self.ranks
        if word in ranks:
            return [ranks[word]]
        n = len(word)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # part i is word[i:end[i]]; 0 where a merge took it
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, z = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or not end[j] or end[j] != z:  # one of the two has changed since
                continue
            end[i], end[j] = z, 0
            if z < n:
                before[z] = i
                if (r := ranks.get(word[i : end[z]])) is not None:
                    heapq.heappush(heap, (r, i, end[z]))
            h = before[i]
            if h >= 0 and (r := ranks.get(word[h:z])) is not None:
                heapq.heappush(heap, (r, h, z))
        return [ranks[word[i : end[i]]] for i in range(n) if end[i]]


def word_encoder(path: str):
    """bytes -> ids; the library's merge loop where it is installed, else the one above; same ids."""
    ranks = load_ranks(path)
    try:
        import tiktoken
    except ImportError:
        return WordEncoder(ranks)
    t = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = WordEncoder(ranks)

    def encode(word: bytes) -> list[int]:
        try:
            s = word.decode("utf-8")
        except UnicodeDecodeError:
            return whole(word)
        return t.encode_ordinary(s)

    return encode


def text_encoder(path: str):
    """text -> list of ids, word by word in one call of the library where it is installed; same ids as the table of distinct words gives."""
    try:
        import tiktoken
    except ImportError:
        encode, split = word_encoder(path), regex.compile(PATTERN).findall
        memo = Memo(lambda w: encode(w.encode("utf-8", "surrogatepass")), 400_000)
        return lambda text: [i for w in split(text) for i in memo[w]]
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=load_ranks(path), special_tokens={}).encode_ordinary


class _Segments:
    """Numbers the words of a partition; both passes use it, so that they number alike."""

    def __init__(self, room: int):
        self.room, self.split, self.segment = room, regex.compile(PATTERN).findall, 0
        self.number: dict[str, int] = {}

    def words(self, text: str) -> list[int]:
        number = self.number
        return [number.setdefault(w, len(number)) for w in self.split(text)]

    def full(self) -> bool:
        return len(self.number) >= self.room


def _segment_words(room: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seg = _Segments(room)

        def out():
            words = list(seg.number)
            key = (part << 20) | seg.segment
            for a in range(0, len(words), 200_000):
                w = words[a : a + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array([x.encode("utf-8", "surrogatepass") for x in w], pa.binary()), pa.array(np.full(len(w), key)), pa.array(np.arange(a, a + len(w), dtype=np.int32))], names=["word", "segment", "number"])
            seg.segment, seg.number = seg.segment + 1, {}

        for b in batches:
            for text in b.column(0).to_pylist():
                if text:
                    seg.words(text)
                    if seg.full():
                        yield from out()
        if seg.number:
            yield from out()

    return run


def _gathered(ids: np.ndarray, n: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Ids of words that lie one behind the other, with the words in another order."""
    start, per = np.cumsum(n) - n, n[order]
    ends = np.cumsum(per)
    return ids[np.arange(ends[-1]) + np.repeat(start[order] - (ends - per), per)]


def _encode_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(path)
        last, ids, check = None, [], 0
        segments, numbers, flat, sizes, checks = [], [], array("I"), array("I"), array("I")

        def out():
            """A row for each segment: its words' numbers, counts of ids, ids and checks, packed."""
            segment, number = np.concatenate(segments), np.concatenate(numbers).astype("<u4")
            n, order = np.array(sizes, np.int64), np.argsort(segment, kind="stable")
            got, segment, number, n = _gathered(np.array(flat, "<u4"), n, order), segment[order], number[order], n[order]
            check_, ends = np.array(checks, "<u4")[order], np.concatenate([[0], np.cumsum(n)])
            cuts = [0, *(np.flatnonzero(np.diff(segment)) + 1).tolist(), len(segment)]
            spans = list(zip(cuts, cuts[1:]))
            packed = [[number[a:z].tobytes() for a, z in spans], [n[a:z].astype("<u4").tobytes() for a, z in spans], [got[ends[a] : ends[z]].tobytes() for a, z in spans], [check_[a:z].tobytes() for a, z in spans]]
            return pa.RecordBatch.from_arrays([pa.array(segment[cuts[:-1]], pa.int64()), *(pa.array(x, pa.binary()) for x in packed)], names=["segment", "number", "n", "ids", "check"])

        for b in batches:  # sorted by word: each distinct one is encoded once
            for w in b.column(0).to_pylist():
                if w != last:
                    last, check, ids = w, xxhash.xxh32_intdigest(w), encode(w)
                flat.extend(ids)
                sizes.append(len(ids))
                checks.append(check)
            segments.append(b.column(1).to_numpy())
            numbers.append(b.column(2).to_numpy())
            if len(sizes) >= PACKED_WORDS or len(flat) >= 8 * PACKED_WORDS:
                yield out()
                segments, numbers, flat, sizes, checks = [], [], array("I"), array("I"), array("I")
        if len(sizes):
            yield out()

    return run


def _tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by folder and segment -> one row a segment, in order of number: counts of ids, ids and checks, packed."""
    now, folder, parts = None, None, []

    def close():
        number, n, ids, check = (np.frombuffer(b"".join(x for g in parts for x in g[c]), "<u4") for c in ("number", "n", "ids", "check"))
        order = np.argsort(number)
        ids = _gathered(ids, n.astype(np.int64), order)
        wide = 4 if ids.max() > 65535 else 2
        return pd.DataFrame({"folder": [folder], "segment": [now], "wide": [wide], "n": [n[order].tobytes()], "ids": [ids.astype(f"<u{wide}").tobytes()], "check": [check[order].tobytes()]})

    for b in batches:
        for s, g in b.groupby("segment", sort=False):
            if s != now and parts:
                yield close()
                parts = []
            now, folder = s, g["folder"].iloc[0]
            parts.append(g)
    if parts:
        yield close()


def _folder(key: int, folders: int) -> int:
    return ((key >> 20) + 7919 * (key & 0xFFFFF)) % folders


def _read_segment(path: str, key: int, folders: int):
    fs, base = pafs.FileSystem.from_uri(path)
    listed = fs.get_file_info(pafs.FileSelector(f"{base}/folder={_folder(key, folders)}", allow_not_found=True))
    for p in (f.path for f in listed if f.path.endswith(".parquet")):
        with fs.open_input_file(p) as f:
            file = pq.ParquetFile(f)
            at = file.schema_arrow.names.index("segment")
            for g in range(file.num_row_groups):
                span = file.metadata.row_group(g).column(at).statistics
                if span is not None and span.has_min_max and not span.min <= key <= span.max:
                    continue
                r = file.read_row_group(g).filter(pc.field("segment") == key).to_pylist()
                if r:
                    n = np.frombuffer(r[0]["n"], "<u4").astype(np.int64)
                    return n, np.concatenate([[0], np.cumsum(n)]), np.frombuffer(r[0]["ids"], f"<u{r[0]['wide']}").astype(np.int32), np.frombuffer(r[0]["check"], "<u4")
    return np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)


def _join_ids(path: str, folders: int, tokenizer: str, room: int, at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seg, state, slow = _Segments(room), None, None

        def load():
            return [*_read_segment(path, (part << 20) | seg.segment, folders), 0]

        def verified():
            """Checks words numbered since the last call; what has no or another entry is encoded here."""
            nonlocal slow
            n, start, ids, check, done = state
            fresh = list(seg.number)[done:] if done else list(seg.number)
            own = np.fromiter((xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass")) for w in fresh), dtype=np.uint32, count=len(fresh))
            there = check[done : done + len(fresh)]
            if len(there) == len(own) and (there == own).all():
                state[4] = done + len(fresh)
                return
            slow = slow or word_encoder(tokenizer)
            all_ids = [np.array(slow(w.encode("utf-8", "surrogatepass")), dtype=np.int32) for w in seg.number]
            n = np.fromiter(map(len, all_ids), dtype=np.int64, count=len(all_ids))
            checks = np.fromiter((xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass")) for w in seg.number), dtype=np.uint32, count=len(n))
            state[:] = [n, np.concatenate([[0], np.cumsum(n)]), np.concatenate(all_ids), checks, len(n)]

        def flush(numbers, sizes):
            if state is not None:
                verified()
            flat = np.array(numbers, dtype=np.int64)
            if not len(flat):
                return np.zeros(0, np.int32), np.zeros(len(sizes), np.int64)
            n, start, ids = state[0], state[1], state[2]
            per = n[flat]
            ends = np.cumsum(per)
            where = np.arange(ends[-1]) + np.repeat(start[flat] - (ends - per), per)
            total = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
            return ids[where], np.diff(total)

        for b in batches:
            for a in range(0, b.num_rows, 500):
                piece = b.slice(a, 500)
                texts = piece.column(at).to_pylist()
                values, counts, numbers, sizes = [], [], [], []
                for text in texts:
                    if not text:
                        sizes.append(0)
                        continue
                    if state is None:
                        state = load()
                    got = seg.words(text)
                    numbers += got
                    sizes.append(len(got))
                    if seg.full():
                        v, c = flush(numbers, sizes)
                        values.append(v)
                        counts.append(c)
                        numbers, sizes = [], []
                        seg.segment, seg.number, state = seg.segment + 1, {}, None
                v, c = flush(numbers, sizes)
                counts = np.concatenate([*counts, c]).astype(np.int32)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                missing = np.array([t is None for t in texts])
                offs = pa.array(offsets, mask=np.concatenate([missing, [False]])) if missing.any() else pa.array(offsets)
                lists = pa.ListArray.from_arrays(offs, pa.array(np.concatenate([*values, v])))
                keep = [piece.column(i) for i, n in enumerate(piece.schema.names) if n in names]
                yield pa.RecordBatch.from_arrays([*keep, lists, pa.array(counts, mask=missing)], names=[*[n for n in piece.schema.names if n in names], "ids", "n_tokens"])

    return run


def _encoding(docs: DataFrame, text: str, keep: list[str], tokenizer: str, room: int):
    """Makes the table of encoded words; the texts and the Arrow step over them that joins the ids."""
    spark = docs.sparkSession
    docs = docs.select(*dict.fromkeys([*keep, text]))
    path = shared_folder(spark)
    words = docs.select(text).mapInArrow(_segment_words(room), "word binary, segment long, number int")
    coded = words.repartition("word").sortWithinPartitions("word").mapInArrow(_encode_words(tokenizer), "segment long, number binary, n binary, ids binary, check binary")
    folders = min(FOLDERS, parallelism(spark))
    coded = coded.withColumn("folder", ((F.shiftright("segment", 20) + F.lit(7919) * (F.col("segment").bitwiseAND(0xFFFFF))) % folders).cast("int"))
    tables = coded.repartition("folder").sortWithinPartitions("folder", "segment").mapInPandas(_tables, "folder int, segment long, wide int, n binary, ids binary, check binary")
    # a row is a segment's table; small row groups let a task read its own
    tables.write.partitionBy("folder").option("compression", "zstd").option("parquet.block.size", 1 << 20).option("parquet.enable.dictionary", "false").parquet(path)
    return docs, _join_ids(path, folders, tokenizer, room, docs.columns.index(text), keep)


def encode(docs: DataFrame, text: str = "text", keep: list[str] | None = None, tokenizer: str = TOKENIZER, room: int = SEGMENT_WORDS) -> DataFrame:
    """``keep`` columns (default: all others, with the text), ids array<int> and n_tokens int; one row per input row."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("ids", "n_tokens")]
    docs, step = _encoding(docs, text, keep, tokenizer, room)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep)
    schema = (kinds + ", " if kinds else "") + "ids array<int>, n_tokens int"
    return docs.mapInArrow(step, schema)


def pieces(spark: SparkSession, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id int, piece binary), as large as the tokenizer's vocabulary."""
    return spark.createDataFrame(pd.DataFrame(list(load_ranks(tokenizer).items()), columns=["piece", "id"])[["id", "piece"]], "id int, piece binary")


def _distinct_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys and lists of ids -> for every group of rows its distinct ids, a row each, and then one row that holds the group."""
    held, n, rows = [], 0, 0

    def out():
        group = pa.Table.from_batches(held).combine_chunks()
        values = group.column(group.num_columns - 1).combine_chunks().flatten().drop_null().to_numpy()
        low, high = (int(values.min()), int(values.max())) if len(values) else (0, 0)
        if high - low < NARROW:
            there = np.zeros(high - low + 1, bool)
            there[values - np.int32(low)] = True
            ids = np.flatnonzero(there) + low
        else:
            ids = np.unique(values)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, group.schema) as w:
            w.write_table(group)
        return pa.RecordBatch.from_arrays([pa.array(np.append(ids, 0).astype(np.int32), mask=np.arange(len(ids) + 1) == len(ids)), pa.concat_arrays([pa.nulls(len(ids), pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())])], names=["__id", "rows"])

    for b in batches:
        sizes = pc.fill_null(pc.list_value_length(b.column(b.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
        cuts = (np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // TOGETHER)) + 1).tolist()
        for a, z in zip([0, *cuts], [*cuts, b.num_rows]):
            held.append(b.slice(a, z - a))
            n, rows = n + int(sizes[a:z].sum()), rows + z - a
            if n >= TOGETHER or rows >= 10_000:
                yield out()
                held, n, rows = [], 0, 0
    if rows:
        yield out()


def _texts(lists: pa.ListArray, ids: np.ndarray, piece: pa.Array) -> pa.Array:
    """Lists of ids -> bytes; ``ids``, with their pieces, in ascending order. A null id or piece gives the replacement character."""
    values = lists.flatten()  # without what lies under null lists
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    known = pa.concat_arrays([piece.fill_null(REPLACEMENT), pa.array([REPLACEMENT], piece.type)])
    low = int(ids[0]) if len(ids) else 0
    given = values.fill_null(low).to_numpy(zero_copy_only=False)
    if len(ids) and int(ids[-1]) - low < NARROW:
        place = np.zeros(int(ids[-1]) - low + 1, np.int32)
        place[ids - low] = np.arange(len(ids))
        where = place[given - np.int32(low)]
    else:
        where = np.searchsorted(ids, given)
    if values.null_count:
        where[values.is_null().to_numpy(zero_copy_only=False)] = len(ids)
    sizes = np.concatenate([[0], np.cumsum(pc.binary_length(known).to_numpy()[where], dtype=np.int64)])[ends]
    data = known.take(pa.array(where)).buffers()[2]  # taken pieces lie one behind the other: a text is a span of them
    return pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(sizes), data if data is not None else pa.py_buffer(b"")])


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids with their pieces, and behind them the group of rows that has these ids -> the group's rows with number of ids and text."""
    ids, pieces_ = [], []
    for b in batches:
        rows, at = b.column("rows"), 0
        for i in np.flatnonzero(rows.is_valid().to_numpy(zero_copy_only=False)).tolist():
            ids.append(b.column("id").slice(at, i - at))
            pieces_.append(b.column("piece").slice(at, i - at))
            group = pa.ipc.open_stream(rows[i].as_buffer()).read_all().combine_chunks()
            *keys, lists = (c.combine_chunks() for c in group.columns)
            text = _texts(lists, pa.concat_arrays(ids).to_numpy(), pa.concat_arrays(pieces_).cast(pa.large_binary()))
            yield pa.RecordBatch.from_arrays([*keys, lists, pc.list_value_length(lists), text.cast(pa.binary())], names=[*(f"__k{i}" for i in range(len(keys))), "ids", "n_tokens", "bytes"])
            ids, pieces_, at = [], [], i + 1
        if at < b.num_rows:
            ids.append(b.column("id").slice(at))
            pieces_.append(b.column("piece").slice(at))


def _with_text(groups: DataFrame, keep: list[T.StructField], tokenizer: str) -> DataFrame:
    """Distinct ids and groups -> ``keep`` columns, ids, n_tokens and text."""
    table_ = pieces(groups.sparkSession, tokenizer)
    if fits(table_):  # a broadcast join leaves rows where they are and in order, another doesn't
        joined = groups.join(F.broadcast(table_), groups["__id"] == table_["id"], "left")
    else:
        groups = groups.withColumn("__at", F.monotonically_increasing_id())
        joined = groups.join(table_, groups["__id"] == table_["id"], "left").repartition(F.shiftright("__at", 33)).sortWithinPartitions("__at")
    kinds = [T.StructField(f"__k{i}", f.dataType) for i, f in enumerate(keep)]
    kinds += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.IntegerType()), T.StructField("bytes", T.BinaryType())]
    out = joined.select(F.col("__id").alias("id"), "piece", "rows").mapInArrow(_put_together, T.StructType(kinds))
    text = F.when(F.col("n_tokens").isNotNull(), F.make_valid_utf8(F.col("bytes").cast("string")))
    return out.select(*[F.col(f"__k{i}").alias(f.name) for i, f in enumerate(keep)], "ids", "n_tokens", text.alias("text"))


def with_text(coded: DataFrame, keep: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """``keep`` columns, ids, n_tokens and the text that the ids stand for, one row per input row."""
    groups = coded.select(*keep, F.col("ids").cast("array<int>").alias("__ids")).mapInArrow(_distinct_ids, GROUPS)
    return _with_text(groups, [coded.schema[c] for c in keep], tokenizer)


def encode_with_text(docs: DataFrame, text: str = "text", keep: list[str] | None = None, tokenizer: str = TOKENIZER, room: int = SEGMENT_WORDS) -> DataFrame:
    """``with_text`` of ``encode``, where the ids stay in one Python worker till they are grouped."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("ids", "n_tokens", "text")]
    docs, step = _encoding(docs, text, keep, tokenizer, room)
    kinds = [f for f in docs.schema if f.name in keep]
    names = [*(f.name for f in kinds), "ids"]
    return _with_text(docs.mapInArrow(lambda batches: _distinct_ids(b.select(names) for b in step(batches)), GROUPS), kinds, tokenizer)


def decode(coded: DataFrame, key: str = "doc_id", tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, text): ids joined with their pieces, and the pieces of a row brought together in order."""
    out = with_text(coded.select(F.col(key).alias("__key"), "ids"), ["__key"], tokenizer)
    return out.select(F.col("__key").alias(key), "text")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and the text decoded from the ids: both halves of the method."""
    return encode_with_text(table(spark, sf_dir, "documents"), keep=["doc_id"])


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode(encode(table(spark, sf_dir, "documents"), keep=["doc_id"]))


ROUND_TRIP_SQL = "SELECT doc_id, text FROM documents"
