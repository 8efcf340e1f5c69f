import random

import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from corpusmill.llm import bpe as B


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=B.PATTERN, mergeable_ranks=B.load_ranks(), special_tokens={})


@pytest.mark.parametrize("room", [1_000_000, 50])
def test_equals_the_library(odd_docs, library, room):
    out = B.encode(odd_docs, room=room).collect()
    assert len(out) == odd_docs.count()
    for r in out:
        if r["text"] is None:
            assert r["ids"] is None and r["n_tokens"] is None
        else:
            assert list(r["ids"]) == library.encode_ordinary(r["text"]) and r["n_tokens"] == len(r["ids"])


def test_columns(odd_docs):
    e = B.encode(odd_docs)
    assert e.columns == [c for c in odd_docs.columns if c not in ("ids", "n_tokens")] + ["ids", "n_tokens"]
    assert B.encode(odd_docs, keep=["source"]).columns == ["source", "ids", "n_tokens"]


def test_own_merges_equal_the_library(library):
    w = B.WordEncoder(B.load_ranks())
    for s in ("hello", " tokenization", "aaaaaaaaaaaa", "naïveté", "漢字", "x" * 300):
        assert w(s.encode()) == library.encode_ordinary(s)


def test_own_merges_on_odd_texts(odd_docs, library):
    w, split = B.WordEncoder(B.load_ranks()), regex.compile(B.PATTERN).findall
    r = random.Random(2)
    texts = [x["text"] for x in odd_docs.select("text").collect() if x["text"]]
    texts += ["".join(chr(r.choice((r.randrange(32, 127), r.randrange(0xA0, 0x250), r.randrange(0x4E00, 0x9FFF), 0x1F642))) for _ in range(200)) for _ in range(30)]
    texts += ["ab" * 20_000 + "c" * 20_000, "\n" * 5000 + " " * 5000]
    for t in texts:
        assert [i for x in split(t) for i in w(x.encode())] == library.encode_ordinary(t)


def test_few_folders_hold_all_segments(odd_docs, library):
    """More segments than folders, whose keys have parts and numbers of all kinds."""
    assert {B._folder((p << 20) | k, 4) for p in range(8) for k in range(8)} == set(range(4))
    out = B.encode(odd_docs.repartition(7), room=20).select("text", "ids").collect()
    assert all(r["text"] is None or list(r["ids"]) == library.encode_ordinary(r["text"]) for r in out)


def test_round_trip(odd_docs, no_docs):
    d = B.decode(B.encode(odd_docs, keep=["doc_id"]))
    assert sorted(map(str, d.collect())) == sorted(map(str, odd_docs.select("doc_id", "text").collect()))
    assert B.encode(no_docs).count() == 0 and B.decode(B.encode(no_docs)).count() == 0


def test_unknown_id(spark):
    d = spark.createDataFrame([(1, [50256, -1, 10**6]), (2, []), (3, None), (None, [31373, None]), (4, [31373, 31373]), (4, [31373, 31373])], "doc_id long, ids array<int>").withColumn("id", F.lit("clash")).withColumn("piece", F.lit("clash"))
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in B.decode(d).collect())
    assert got == [("1", "�" * 3), ("2", ""), ("3", "None"), ("4", "hellohello"), ("4", "hellohello"), ("None", "hello�")]


def test_query_encodes_and_decodes(spark, library):
    """The query's text comes from its ids by a join with the id-to-piece table."""
    folder = "/root/testdata/sf0.001"
    out = B.op3_bpe(spark, folder)
    assert out.columns == ["doc_id", "ids", "n_tokens", "text"]
    assert "Join" in out._jdf.queryExecution().executedPlan().toString()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = out.collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["text"] == texts[r["doc_id"]] and list(r["ids"]) == library.encode_ordinary(r["text"]) and r["n_tokens"] == len(r["ids"])


@pytest.mark.parametrize("small", [True, False])
def test_text_beside_ids(spark, odd_docs, monkeypatch, small):
    """With a broadcast table of pieces and with one that is too large for it; texts of one row over many batches."""
    monkeypatch.setattr(B, "fits", lambda df: small)
    e = B.encode(odd_docs, keep=["doc_id", "source"])
    want = [(r["doc_id"], r["source"], r["ids"], r["n_tokens"]) for r in e.collect()]
    for out in (B.with_text(e, ["doc_id", "source"]), B.encode_with_text(odd_docs, keep=["doc_id", "source"], room=50)):
        got = out.collect()
        assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["source"], r["ids"], r["n_tokens"])) for r in got)
        assert sorted(str((r["doc_id"], r["text"])) for r in got) == sorted(str((r["doc_id"], r["text"])) for r in odd_docs.collect())


@pytest.mark.parametrize("together", [1, 7, 10_000])
def test_groups_cut_anywhere(monkeypatch, together):
    """Groups of any size, in batches cut anywhere, against a plain loop."""
    monkeypatch.setattr(B, "TOGETHER", together)
    r = random.Random(4)
    lists = [r.choice([None, [], [None], [r.choice((0, 5, 7, -2, 2**31 - 1)) for _ in range(r.randint(1, 40))], [None, 3]]) for _ in range(200)]
    piece = {0: b"zero", 3: b"\xe6\xbc", 5: b"", 7: b"seven "}
    rows = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), pa.array(lists, pa.list_(pa.int32()))], names=["__k0", "ids"])
    t = pa.Table.from_batches(B._distinct_ids(iter([rows.slice(0, 0), rows.slice(0, 90), rows.slice(90)]))).combine_chunks()
    t = t.add_column(1, "piece", pa.array([piece.get(i) for i in t.column(0).to_pylist()], pa.binary())).rename_columns(["id", "piece", "rows"])
    cuts = [0, *sorted(r.sample(range(t.num_rows), 3)), t.num_rows]
    batches = [b for a, z in zip(cuts, cuts[1:]) for b in t.slice(a, z - a).to_batches()]
    got = pa.Table.from_batches(B._put_together(iter(batches))).to_pylist()
    assert [(x["__k0"], x["ids"], x["n_tokens"]) for x in got] == [(i, v, None if v is None else len(v)) for i, v in enumerate(lists)]
    assert [x["bytes"] for x in got] == [b"".join(piece.get(i, B.REPLACEMENT) for i in v or []) for v in lists]
    assert list(B._put_together(iter([]))) == []
