"""What is counted, numbered, coded and merged in slices equals what rows give, and no row for each token is shuffled."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import corpus, index, packed, phrases, tokens, vocab
from corpusmill.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sents(spark):
    r = random.Random(7)
    rows = [(9 - i % 10, i // 10, [r.choice(["a", "b", "É", "x-y", "<unk>", "d e"]) for _ in range(r.randrange(8))]) for i in range(90)] + [(11, 0, None), (12, 0, [])]
    return spark.createDataFrame(rows, "doc_id long, sent int, tokens array<string>").repartition(5)


def rows(df):
    return sorted(str(sorted(r.asDict().items())) for r in df.collect())


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(packed.gathered, "__defaults__", ("tokens", 20))


@pytest.mark.parametrize("words, bigrams", [(True, False), (True, True), (False, True)])
def test_counts(sents, words, bigrams):
    assert rows(index.sentence_frequency(sents, words, bigrams)) == rows(index.document_frequency(index.terms_of(sents, words, bigrams)))
    every = [t for r in sents.collect() if r["tokens"] for t in ([(x, None) for x in r["tokens"]] if words else []) + (list(zip(r["tokens"], r["tokens"][1:])) if bigrams else [])]
    assert {(r["a"], r["b"]): r["n"] for r in packed.term_counts(sents, "n", words, bigrams).collect()} == dict(Counter(every))


def test_lists(sents):
    s = sents.withColumn("sent_id", F.col("doc_id") * 100 + F.col("sent"))
    t = index.terms_of(s.select("sent_id", "tokens"), True, True).groupBy("a", "b", F.expr("sent_id div 64").alias("part")).agg(F.array_sort(F.collect_set("sent_id")).alias("sent_ids"))
    assert rows(index.posting_lists(s, True, True, 64)) == rows(t)


def test_vocabulary_and_codes(sents):
    long = sents.select("doc_id", "sent", F.posexplode("tokens").alias("pos", "word"))
    v = vocab.build_vocab(long).cache()
    assert rows(vocab.vocab_of_rows(sents)) == rows(v)
    some = v.where("word <> 'b'")
    assert rows(vocab.code_rows(sents, some, ["doc_id", "sent"])) == rows(vocab.encode_tokens(long, some).select("doc_id", "sent", "pos", "word", "token_id"))
    assert rows(vocab.decode_rows(sents, some, ["doc_id", "sent"])) == rows(vocab.decode_ids(vocab.encode_tokens(long, some), some).select("doc_id", "sent", "pos", "word"))


def test_corpus_of_repeated_documents(spark):
    docs = spark.createDataFrame([(2, "A b. C"), (1, "D. E. F"), (2, "G. H"), (3, None), (0, " ")], "doc_id long, text string")
    c = corpus.build_corpus(docs, lower=True).orderBy("sent_id").collect()
    assert [r["sent_id"] for r in c] == list(range(7)) and [(r["doc_id"], r["sent"]) for r in c] == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 0), (2, 1), (2, 1)]
    assert c[0]["tokens"] == ["d."] and "explode(tokens" not in str(c)


def test_null_lists_stay(spark, sents, monkeypatch):
    p = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "a")], "a string, b string")
    got = rows(phrases.merge_phrases(sents, p, ["doc_id", "sent"]))
    assert sum("None" in x for x in got) == 1
    monkeypatch.setattr(phrases, "BROADCAST_BYTES", 0)
    assert rows(phrases.merge_phrases(sents, p, ["doc_id", "sent"])) == got


@pytest.mark.parametrize("name", ["inverted_index", "index_bigrams", "encode_corpus_tokens", "decode_corpus_ids", "extend_vocab", "npmi_candidates", "collapse_phrases", "merge_bigrams"])
def test_tokens_are_not_shuffled(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(regexp_extract_all" not in plan and "explode(tokens" not in plan and "explode(transform" not in plan and "explode(array_distinct" not in plan
