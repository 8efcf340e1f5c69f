import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import tokens as K

LINE = "\rThis is usually how I do it." "\tНо лучше не повторять." "\n   Ciao."


def words(spark, text, pattern=T.TOKEN):
    return spark.createDataFrame([(text,)], "t string").select(T.tokens_of(F.col("t"), pattern)).first()[0]


def test_golden_tokens(spark):
    assert words(spark, LINE) == "This is usually how I do it . Но лучше не повторять . Ciao .".split()


def test_token_cases(spark):
    cases = {"S.W.A.T.": ["S.", "W.", "A.", "T."], "3.14": ["3.", "14"], "state-of-the-art": ["state-of-the-art"], "it's": ["it", "'", "s"], "": [], "www.x.com": ["www", ".", "x.", "com"], "see http://a.b/c_(d)?e=1, ok": ["see", "http://a.b/c_(d)?e=1", ",", "ok"]}
    assert {t: words(spark, t) for t in cases} == cases


def test_nulls(spark):
    d = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert K.tokenize(d).count() == K.token_offsets(d).count() == K.sentences(d).count() == 0
    assert d.select(T.deaccent("text").alias("x")).collect()[0]["x"] is None


def test_deaccent(spark):
    cases = {"aulón": "aulon", "Агноёстици́зм": "Агноестицизм", "ἄγνωστος": "αγνωστος", "непознанный": "непознанныи", "漢字": "漢字"}
    d = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.deaccent("t").alias("x"))
    assert {r["t"]: r["x"] for r in d.collect()} == cases
    assert T.strip_marks("é".encode()) == "e"


def test_offsets_spell_the_text(spark):
    texts = [LINE, "  a  b ć d ", "x", " ", "tail  "]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in K.token_offsets(d).collect():
        assert texts[r["doc_id"]][r["start"] : r["start"] + r["length"]] == r["word"]
    back = {r["doc_id"]: r for r in K.token_offsets(d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("word").alias("text"), "tailspace"))).alias("t")).select("doc_id", T.detokenize(F.col("t")).alias("x"), T.doc_string(F.col("t")).alias("y")).collect()}
    assert back[4]["x"] == "tail" and back[0]["y"].startswith("This is usually how I do it. Но")


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet="ab-_. 1é'\n\t(/:", max_size=30))
def test_pieces_concatenate(spark, text):
    assert "".join(words(spark, text, T.PIECES)) == text


def test_sentences(spark):
    d = spark.createDataFrame([(1, "It is nice here. It's true.\n\nNo end  ! ? x.y")], "doc_id int, text string")
    assert [r["text"] for r in K.sentences(d).orderBy("sent").collect()] == ["It is nice here.", "It's true.", "No end  !", "?", "x.y"]


def test_apostrophe(spark):
    d = K.tokenize(spark.createDataFrame([(1, "the cat's s ’s '")], "doc_id int, text string"))
    assert [r["word"] for r in K.merge_apostrophe_s(d, ["doc_id"]).orderBy("pos").collect()] == ["the", "cat", "'s", "s", "'s", "'"]


def test_shapes(spark):
    cases = {"3rd": "number", ".5": "number", "...": "punct", "Ab": "upcase", "A": "upcase", "ab1": "downcase", "aB": "mixedcase", "AB": "mixedcase", "_": "mixedcase", "a-b": "other"}
    d = spark.createDataFrame([(k,) for k in cases], "w string").select("w", T.word_shape(F.col("w")).alias("s"))
    assert {r["w"]: r["s"] for r in d.collect()} == cases


def test_hashes(spark):
    import hashlib

    ws = ["abc", "", "é", "x" * 100]
    d = spark.createDataFrame([(w,) for w in ws], "w string").select("w", T.record_id(F.col("w")).alias("r"), T.hash_bucket(F.col("w"), 500_000).alias("b"), T.hash_bucket(F.col("w"), 999_999_937).alias("c"))
    for r in d.collect():
        n = int(hashlib.md5(r["w"].encode()).hexdigest(), 16)
        assert (r["r"], r["b"], r["c"]) == (n % 2**60, n % 500_000, n % 999_999_937)


def test_phrases(spark):
    d = spark.createDataFrame([([1, 1, 1, 2], [1, 1, 2]), ([1, 2], [2, 1]), ([], [1]), ([3], [])], "a array<int>, p array<int>")
    assert [r[0] for r in d.select(T.contains_phrase(F.col("a"), F.col("p"))).collect()] == [True, False, False, True]


def test_stopwords():
    assert len(T.STOPWORDS) == len(set(T.STOPWORDS)) == 127
    assert all(unicodedata.normalize("NFC", w) == w for w in T.STOPWORDS)
