"""Mappers, incremental records, stored search, plugged-in models, and sources of both line ends."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import subword as S
from corpusmill.operators import chunks, corpus, encode, index, mappers, mapreduce, phrases, search, spans, tokens, vocab
from corpusmill.plans import storage
from corpusmill.sources import readers

TEXTS = [
    ("Ada L. Byron (1815–1852) wrote notes on an engine.", [(0, 12, "person"), (40, 49, "thing")], "one"),
    ("It ran well.", [], "two"),
    ("The mill in the old town ground 3.5 tons of flour on a good day.", [(0, 8, "thing"), (16, 24, "place")], "one"),
    ("No one knows.", [(0, 6, "who"), (1, 4, "unaligned")], "two"),
    ("After that, nothing was the same.", [], None),
]


@pytest.fixture(scope="module")
def records(spark):
    return mappers.labelled_tokens(spark.createDataFrame([(i, t, e, c) for i, (t, e, c) in enumerate(TEXTS)], f"doc_id long, text string, ents {mappers.ENTS}, cats string"))


def test_labelled_tokens(records):
    r = {x["doc_id"]: x for x in records.collect()}
    assert r[0]["tokens"][:3] == ["Ada", "L.", "Byron"] and r[0]["tags"][:4] == ["B-person", "I-person", "L-person", "O"] and r[0]["tags"][-3:] == ["B-thing", "L-thing", "O"]
    assert r[2]["tags"].count("O") == len(r[2]["tags"]) - 4 and r[3]["tags"] == ["B-who", "L-who", "O", "O"] and set(r[1]["tags"]) == {"O"}


def test_batches_of_encoded_records(spark, records):
    """Shortest first, two to a batch, padded with the defaults: the real tokens and tags of the first batch, and the number of batches."""
    words = encode.value_codes(records.select(F.explode("tokens").alias("w")), "w")
    tags = encode.value_codes(records.select(F.explode("tags").alias("t")), "t")
    size = words.count()
    specs = [mappers.word_mapper(words, size), mappers.tag_mapper(tags), mappers.MapperSpec("cats", "label", encode.value_codes(records, "cats"), "item"), mappers.MapperSpec("n_tokens", "half", kind=lambda c: c / 2, dtype="double"), mappers.MapperSpec("absent", "x", words)]
    coded = mappers.apply_mappers(records, specs)
    b = encode.pad_batches(encode.length_batches(coded, 2, 256), "tok_ids", size).collect()
    assert {r["batch"] for r in b} == {0, 1, 2}
    first = [r for r in b if r["batch"] == 0]
    assert {r["doc_id"] for r in first} == {1, 3} and sum(i != size for r in first for i in r["tok_ids"]) == 8
    o = tags.where("value = 'O'").first()["code"]
    assert sum(t != o for r in first for t in r["tags"]) == 2
    by = {r["value"]: r["code"] for r in words.collect()}
    kept = {r["doc_id"]: r for r in coded.collect()}
    assert all(list(kept[r["doc_id"]]["tok_ids"]) == [by[w] for w in r["tokens"]] for r in records.collect())
    assert [kept[i]["label"] for i in range(5)] == [0, 1, 0, 1, None] and kept[1]["half"] == 2.0 and "x" not in coded.columns


def test_mappers_that_join(spark, records, monkeypatch):
    few = spark.createDataFrame([("the", 7), ("one", 8)], "value string, code long")
    spec = [mappers.MapperSpec("tokens", "ids", few, default=9, preproc=F.lower)]
    want = {r["doc_id"]: list(r["ids"]) for r in mappers.apply_mappers(records, spec).collect()}
    monkeypatch.setattr(mappers, "BROADCAST_BYTES", 0)
    assert {r["doc_id"]: list(r["ids"]) for r in mappers.apply_mappers(records, spec).collect()} == want and want[3][:2] == [9, 8]
    with pytest.raises(ValueError):
        mappers.apply_mappers(records, [mappers.MapperSpec("tokens", "x", few, "other")])


def test_one_text(spark):
    r = mappers.annotate(spark, "Big Ben rings", [(0, 7, "bell")], [mappers.MapperSpec("tokens", "n", spark.createDataFrame([("Ben", 1)], "value string, code long"), default=0)]).first()
    assert r["tags"] == ["B-bell", "L-bell", "O"] and r["n"] == [0, 1, 0]
    assert mappers.signature({"a": 1, "b": [2]}) == mappers.signature({"b": [2], "a": 1}) != mappers.signature({"a": 2, "b": [2]})


def test_incremental_records(spark):
    old = spark.createDataFrame([(1, "x"), (2, None)], "doc_id int, text string")
    new = spark.createDataFrame([(5, "y"), (4, "y"), (6, "x"), (7, None)], "doc_id int, text string")
    assert [r["doc_id"] for r in encode.new_records(new, old).collect()] == [4]
    c = encode.union_values(encode.value_codes(old, "text"), new, "text")
    assert {r["value"]: r["code"] for r in c.collect()} == {"x": 0, "y": 1}


def test_codes_and_phrases_are_kept(spark, tmp_path):
    c = spark.createDataFrame([("é", 0), ("b c", 1)], "value string, code long")
    readers.write_codes(c, str(tmp_path / "c"))
    assert sorted(map(tuple, readers.read_codes(spark, str(tmp_path / "c")).collect())) == sorted(map(tuple, c.collect()))
    p = spark.createDataFrame([("a", "b", 3, 0.5), ("c", "d", 1, None)], "a string, b string, count long, npmi double")
    readers.write_bigrams(p, str(tmp_path / "p"))
    assert sorted(map(str, readers.read_bigrams(spark, str(tmp_path / "p")).collect())) == sorted(map(str, p.collect()))
    v = vocab.extend_vocab(spark.createDataFrame([(0, "a", 1)], "id long, word string, count long"), p)
    readers.write_extension(v, str(tmp_path / "e"), 1)
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "e")).collect()) == ["1\ta b\t3", "2\tc d\t1"]


def test_both_line_ends(spark, tmp_path):
    lines = ["# id", "\t".join(["1", "Hi"] + ["_"] * 7 + ["SpaceAfter=No"]), "\t".join(["2", "!"] + ["_"] * 8), "", "\t".join(["1", "Yo"] + ["_"] * 8), ""]
    for end in ("\n", "\r\n"):
        (tmp_path / "a.conllu").write_bytes(end.join(lines).encode())
        assert [(r["pos"], r["form"], r["space_after"]) for r in readers.read_conllu(spark, str(tmp_path / "a.conllu")).orderBy("sent", "pos").collect()] == [(0, "Hi", False), (1, "!", True), (0, "Yo", True)]
        (tmp_path / "k.txt").write_bytes(end.join(["a DT B-NP", "b NN I-NP", "", "c VB O"]).encode())
        assert readers.read_chunks(spark, str(tmp_path / "k.txt")).select("sent").distinct().count() == 2


def test_sentences_may_hold_any_character(spark):
    d = spark.createDataFrame([(1, "A\x01b c. D?\n\ne  f!\tg.h")], "doc_id int, text string")
    assert [r["text"] for r in tokens.sentences(d).orderBy("sent").collect()] == ["A\x01b c.", "D?", "e  f!", "g.h"]


def test_folds_of_any_type(spark):
    d = spark.createDataFrame([(i % 3, float(i)) for i in range(50)], "k int, v double").repartition(5)
    got = mapreduce.map_fold(d, lambda r: [(r["k"], [r["v"]])] if r["k"] else [], lambda acc, v: sorted((acc or []) + list(v)), "key int, value array<double>")
    assert {r["key"]: r["value"] for r in got.collect()} == {k: [float(i) for i in range(50) if i % 3 == k] for k in (1, 2)}


def test_stored_search_and_hooks(spark, tmp_path):
    r = random.Random(1)
    docs = spark.createDataFrame([(i, ". ".join(" ".join(r.choices("sun moon sea sand the tree".split(), k=4)) for _ in range(3))) for i in range(30)], "doc_id long, text string")
    c = corpus.build_corpus(docs, lower=True)
    index.save_postings(index.posting_lists(c, width=16), str(tmp_path / "p"))
    stored, of = index.load_postings(spark, str(tmp_path / "p")), c.select("doc_id", "sent_id")
    q = spark.createDataFrame([(0, "sun moon"), (1, "The sea"), (2, "tree tree sand"), (3, "none"), (4, "sun none")], "query_id long, text string")
    a, terms = tokens.sentence_arrays(docs, lower=True), search.query_terms(q)
    rows = lambda d: sorted(map(tuple, d.select("query_id", "doc_id", "score").collect()))
    assert rows(search.ranked_stored(terms, stored, of)) == rows(search.ranked(terms, a)) == rows(search.query(q, a))
    assert rows(search.exact_stored(terms, stored, of)) == rows(search.exact(terms, a)) == rows(search.query(q, a, exact_=True))
    right = lambda d: d.withColumn("text", F.regexp_replace("text", "sunn", "sun"))
    typo = spark.createDataFrame([(0, "sunn moon")], "query_id long, text string")
    assert rows(search.query(typo, a, spellcheck=right)) == [x for x in rows(search.ranked(terms, a)) if x[0] == 0]
    assert len(rows(search.query(q.where("query_id = 1"), a, remove_stopwords=False, idf=True))) >= len(rows(search.query(q.where("query_id = 1"), a)))


def test_phrases_that_do_not_fit_are_joined(spark, monkeypatch):
    r = random.Random(3)
    d = spark.createDataFrame([(i, r.choices("abc", k=r.randrange(12))) for i in range(60)], "i int, tokens array<string>")
    p = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "c")], "a string, b string")
    for right in (True, False):
        want = sorted(map(str, phrases.merge_phrases(d, p, ["i"], "_", right).collect()))
        with monkeypatch.context() as m:
            m.setattr(phrases, "BROADCAST_BYTES", 0)
            assert sorted(map(str, phrases.merge_phrases(d, p, ["i"], "_", right).collect())) == want


def test_rows_equal_windows(spark):
    """What is done within a row against the long form."""
    r = random.Random(4)
    words = "the old Big mill of a man in Town runs 's 12 , quickly".split()
    rows = [(i, [r.choice(words) for _ in range(r.randrange(9))]) for i in range(40)]
    d = spark.createDataFrame(rows, "s int, words array<string>").withColumn("tags", F.transform("words", lambda w: F.when(w.isin("the", "a"), "DET").when(w.isin("of", "in"), "ADP").when(w == "old", "ADJ").when(w == "runs", "VERB").otherwise("NOUN")))
    long = d.select("s", F.posexplode(F.arrays_zip("words", "tags")).alias("pos", "t")).select("s", "pos", F.col("t.words").alias("word"), F.col("t.tags").alias("tag"))
    rows_ = lambda x: sorted(map(str, x.collect()))
    assert rows_(chunks.feature_rows(d, ["s"])) == rows_(chunks.crf_features(long, ["s"]))
    letters = d.withColumn("letters", F.transform(F.arrays_zip("words", "tags"), lambda x: chunks.tag_letter(x["words"], x["tags"])))
    assert rows_(chunks.chunk_rows(letters, ["s"])) == rows_(chunks.np_chunks(long, ["s"]))
    iob = spark.createDataFrame([(i, r.choices(["B-NP", "I-NP", "O", "PRT"], k=r.randrange(7))) for i in range(40)], "s int, t array<string>")
    a = iob.select("s", F.posexplode(spans.iob_tags_to_biluo(F.col("t"))).alias("pos", "biluo"))
    b = spans.iob_rows_to_biluo(iob.select("s", F.posexplode("t").alias("pos", "iob")), ["s"]).select("s", "pos", "biluo")
    assert rows_(a) == rows_(b)


def test_repair_from_left_to_right(spark):
    r = random.Random(6)
    rows = [(i, r.choices(["B-NP", "I-NP", "B-NP*", "O"], k=r.randrange(8))) for i in range(150)]

    def one_by_one(tags):
        out = []
        for t in tags:
            inside = bool(out) and out[-1] in ("B-NP", "I-NP")
            out.append(t if not out else "I-NP" if t == "B-NP*" and inside else "B-NP" if t == "B-NP*" or t == "I-NP" and not inside else t)
        return out

    got = spark.createDataFrame(rows, "i int, t array<string>").select("i", chunks.repair_tags(F.col("t")).alias("t")).collect()
    assert {x["i"]: x["t"] for x in got} == {i: one_by_one(t) for i, t in rows}


def test_plugged_in_model(spark):
    d = spark.createDataFrame([(0, ["The", "Mill", "runs"], ["DET", "NOUN", "VERB"]), (1, ["x"], ["VERB"])], "s int, words array<string>, tags array<string>")
    got = chunks.parse_with(d, lambda: lambda fs: ["B-NP" if f[4] == "DET" else "I-NP" if f[4] == "NOUN" else "O" for f in fs], ["s"])
    assert [tuple(x) for x in got.collect()] == [(0, 0, 2, "NP")]


def test_wordpieces(spark):
    d = spark.createDataFrame([(["hel", "##lo", "[UNK]", "!"], "Hello wörld!")], "p array<string>, t string")
    assert [tuple(x) for x in d.select(S.align("wordpiece", lower=True)("p", "t")).first()[0]] == [(0, 3), (3, 5), (6, 11), (11, 12)]


def test_shuffled_order(spark):
    d = spark.createDataFrame([(i,) for i in range(200)], "doc_id long")
    a, b, c = ([r[0] for r in encode.shuffled(d.repartition(k), s).collect()] for k, s in ((3, 1), (5, 1), (3, 2)))
    assert a == b != c and sorted(a) == sorted(c) == list(range(200))


def test_shared_folder(spark, monkeypatch):
    assert storage.shared_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    class Elsewhere:
        conf = {}
        sparkContext = type("C", (), {"master": "spark://host:7077"})
    with pytest.raises(ValueError):
        storage.shared_folder(Elsewhere())
