"""Steps over slices of sentences give what the steps over rows give, and shuffle nothing."""

from itertools import product

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import chunks, packed, spans, tokens
from corpusmill.plans.queries import QUERIES

ODD = ["The", "green", "ORDER", "of", "'s", "3a", ".5", "x-y", "É", "ich", "\"", "\\", "\x01", "İz", "a.", "_", "ǅ", "running"]
SENTS = [(1, 0, ODD), (1, 1, []), (2, 0, ["Big"]), (2, 1, ODD[::-1] * 3), (2, 1, ["the", "Dog", "of", "the", "king"]), (3, 0, None)]


@pytest.fixture(scope="module")
def sents(spark):
    return spark.createDataFrame(SENTS, "doc_id long, sent int, words array<string>").where("not (doc_id = 2 and sent = 1 and size(words) = 5)")


def rows(df):
    return sorted(str(sorted(r.asDict().items())) for r in df.collect())


def shuffles(spark, name):
    return QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().count("Exchange")


def long(sents):
    return sents.select("doc_id", "sent", F.posexplode("words").alias("pos", "word")).withColumn("tag", T.tag_of(F.col("word")))


def test_features(sents):
    assert rows(chunks.feature_rows(sents, ["doc_id", "sent"], tags=None)) == rows(chunks.crf_features(long(sents), ["doc_id", "sent"]).select("doc_id", "sent", "pos", "features"))


def test_wide_features(spark, sents):
    want = chunks.crf_features_wide(long(sents), ["doc_id", "sent"]).withColumn("features", F.to_json("features"))
    assert rows(chunks.wide_feature_rows(sents, ["doc_id", "sent"])) == rows(want)
    assert shuffles(spark, "crf_features_wide") == 0


def test_chunks(sents):
    assert rows(chunks.chunks_of(sents, ["doc_id", "sent"])) == rows(chunks.np_chunks(long(sents), ["doc_id", "sent"]))


def test_votes_of_rows(spark):
    cases = [(list(v), t) for n in range(6) for v in product(("B-NP", "I-NP", "O"), repeat=n) for t in ("S,", "A=", "V")]
    d = spark.createDataFrame(cases, "v array<string>, t string")
    assert all(r["got"] == chunks.pick_of(r["v"], r["t"]) for r in d.withColumn("got", chunks.pick_tag(F.col("v"), F.col("t"))).collect())


def test_votes_are_looked_at_once(spark):
    """The votes' expression is not repeated for each place that uses it."""
    d = spark.createDataFrame([("a",)], "w string").select(chunks.pick_tag(F.array(F.md5("w"), F.lit("O")), F.lit("V")).alias("t"))
    assert d._jdf.queryExecution().analyzed().toString().count("md5(") == 1


def test_spans_of_texts(spark):
    docs = spark.createDataFrame([(1, "The Old dog. New"), (2, ""), (3, None), (4, "a😀b Cé")], "doc_id long, text string")
    sp = spark.createDataFrame([(1, 0, 7, "x"), (1, 0, 5, None), (1, 4, 7, "x"), (1, 7, 4, "x"), (2, 0, 1, "x"), (3, 0, 1, "x"), (9, 0, 1, "x"), (4, 4, 6, "y"), (4, 1, 2, "y"), (4, None, 2, "y")], "doc_id long, start int, end int, label string")
    assert rows(spans.token_spans_of_texts(docs, sp)) == rows(spans.token_spans(tokens.token_offsets(docs), sp, ["doc_id"]))
    assert "Window" not in (p := QUERIES["token_spans"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()) and "word#" not in p


def test_tags_of_texts(spark):
    sents = spark.createDataFrame([(1, 0, "a b c d e f"), (1, 1, ""), (2, 0, "x y"), (3, 0, "z")], "doc_id long, sent int, text string")
    sp = spark.createDataFrame([(1, 0, 0, 2, "p"), (1, 0, 0, 3, "q"), (1, 0, 2, 4, "r"), (1, 0, 5, 6, None), (2, 0, 1, 2, "s"), (2, 0, 7, 9, "s"), (1, 1, 0, 1, "t"), (8, 0, 0, 1, "t"), (3, 0, None, 1, "t")], "doc_id long, sent int, first int, last int, label string")
    t = sents.select("doc_id", "sent", F.posexplode(T.tokens_of(F.col("text"))).alias("pos", "word"))
    assert rows(spans.biluo_encode_texts(sents, sp, ["doc_id", "sent"])) == rows(spans.biluo_encode(t, sp, ["doc_id", "sent"]))
    assert "Window" not in QUERIES["biluo_encode_long"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_iob_of_slices(spark):
    """No aggregate walks over the tags with a list of the runs so far."""
    assert "aggregate(" not in QUERIES["iob_to_biluo"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
