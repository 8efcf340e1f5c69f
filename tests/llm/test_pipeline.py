import numpy as np
import pytest
import tiktoken

import corpus_pipeline as P
from corpusmill.llm import bpe, mixture, quality, toxicity

from .test_mixture import brute as mixed
from .test_ngram_join import brute as near

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before each stage and after the last, by plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = [tuple(r) for r in docs.select(*COLUMNS).collect()]
    out = [rows]
    q = quality.train_quality(docs, quality.ratings_of(labels))
    f = quality.make_featurizer(q.bits)
    keep = q.tails(q.latent([f(r[1]) for r in rows]))[:, 0] >= 0.5
    rows = [r for r, k in zip(rows, keep) if k]
    out.append(rows)
    kept = spark.createDataFrame(rows, docs.schema)
    x = toxicity.train_toxicity(kept, labels)
    t = toxicity.make_terms(x.bits, x.keep)
    rows = [r for r, p in zip(rows, x.probability([t(r[1]) for r in rows])) if p < toxicity.THRESHOLD]
    out.append(rows)
    gone = {i for i, (low, _) in near([(r[0], r[1]) for r in rows]).items() if low != i}
    rows = [r for r in rows if r[0] not in gone]
    out.append(rows)
    m = mixed([(r[0], r[1], r[2], r[3]) for r in rows], block=mixture.BLOCK_TOKENS, shard=mixture.SHARD_SLOTS, seed=0)
    out.append([(k * mixture.SHARD_SLOTS + slot, text, lang, source, len(text)) for k, slot, source, _, _, _, lang, text in m])
    return out


def test_names():
    assert [n for n, _ in P.STAGES] == ["quality", "toxicity", "near_duplicates", "mixture", "bpe"]


@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_stage(spark, stages, k):
    docs = spark.createDataFrame(stages[k], "doc_id long, text string, lang string, source string, n_chars long")
    got = P.STAGES[k][1](spark, docs, SF)
    assert got.columns == COLUMNS
    assert sorted(tuple(r) for r in got.collect()) == sorted(stages[k + 1])
    assert len(stages[k + 1]) > 0


def test_run(spark, stages):
    e = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load_ranks(), special_tokens={})
    got = {r["doc_id"]: (r["source"], list(r["ids"]), r["n_tokens"]) for r in P.run(spark, SF).collect()}
    want = {r[0]: (r[3], i, len(i)) for r in stages[4] for i in [e.encode_ordinary(r[1])]}
    assert got == want


def test_odd_and_no_documents(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in P.STAGES:
            docs = stage(spark, docs, SF)
            assert np.all([c in docs.columns for c in (["doc_id", "text", "source"] if name != "bpe" else ["doc_id", "ids"])])
        docs.count()
