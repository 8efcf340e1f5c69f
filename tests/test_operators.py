import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import subword as S
from corpusmill.operators import chunks, corpus, encode, fuzzy, index, mapreduce, phrases, scoring, search, spans, tokens, vocab
from corpusmill.plans.storage import dense_ids
from corpusmill.sources import readers
from corpusmill.streaming import wordcount

ABALONE = [(0, "Abalone is a common name for sea snails. Abalone is eaten."), (1, "It is nice here. It's true.")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ABALONE, "doc_id long, text string")


def col(df, order, c):
    return [r[c] for r in df.orderBy(order).collect()]


# --- numbering and vocabulary
def test_dense_ids(spark):
    r = np.random.default_rng(0).integers(0, 50, 500).tolist()
    d = dense_ids(spark.createDataFrame([(i, int(v)) for i, v in enumerate(r)], "i int, v int"), ["v", "i"], "n", 5)
    assert [x["n"] for x in d.orderBy("v", "i").collect()] == list(range(5, 505))
    assert dense_ids(spark.createDataFrame([], "v int"), ["v"], "n").count() == 0


def test_vocabulary(spark, docs):
    v = vocab.build_vocab(tokens.sentence_tokens(docs))
    rows = [tuple(r) for r in v.orderBy("id").collect()]
    assert rows[:6] == [(0, "<Lua heritage>", 1), (1, "<pad>", 1), (2, "</s>", 1), (3, "<unk>", 1), (4, "Abalone", 2), (5, "is", 3)]
    assert [r["id"] for r in v.orderBy("id").collect()] == list(range(len(rows)))
    t = spark.createDataFrame([("is",), ("zzz",)], "word string")
    e = vocab.encode_tokens(t, v)
    assert {r["word"]: r["token_id"] for r in e.collect()} == {"is": 5, "zzz": 3}
    assert {r["word"] for r in vocab.decode_ids(e.drop("word"), v).collect()} == {"is", "<unk>"}
    assert [r["word"] for r in vocab.unknown(t, v).collect()] == ["zzz"] and [r["word"] for r in vocab.known(t, v).collect()] == ["is"]
    assert vocab.most_common(v, 1).first()["word"] == "."
    assert abs(sum(r["prob"] for r in vocab.probabilities(v).collect()) - 1) < 1e-9


def test_sample(spark):
    v = spark.createDataFrame([(0, "a", 1), (1, "b", 3), (2, "c", 96), (70_000, "d", 100)], "id long, word string, count long")
    n = {r["word"]: r["count"] for r in vocab.sample_words(v, 4000, seed=3).groupBy("word").count().collect()}
    assert sum(n.values()) == 4000 and abs(n["d"] / 4000 - 0.5) < 0.04 and abs(n["c"] / 4000 - 0.48) < 0.04
    low = {r["word"] for r in vocab.sample_words(v, 200, limit_top=2).collect()}
    assert low <= {"a", "b"}


# --- corpus, index, search
def test_corpus(spark, docs, tmp_path):
    c = corpus.build_corpus(docs)
    assert col(c, "sent_id", "sent_id") == [0, 1, 2, 3] and col(corpus.get_slice(c, 1, None, 2), "sent_id", "sent_id") == [1, 3]
    assert corpus.get_many(c, spark.createDataFrame([(2,), (2,), (9,)], "sent_id long")).count() == 1
    assert {r["doc_id"]: r["found"] for r in corpus.documents_with(c, ["is", "nice"]).collect()} == {0: False, 1: True}
    corpus.save_corpus(c, str(tmp_path / "c"), lower=False)
    back, params = corpus.load_corpus(spark, str(tmp_path / "c"))
    assert sorted(map(str, back.collect())) == sorted(map(str, c.collect())) and params == {"lower": False}


def test_search(spark, docs, tmp_path):
    a = tokens.sentence_arrays(docs, lower=True)
    q = spark.createDataFrame([(0, "Abalone"), (1, "It's true."), (2, "nothing known"), (3, "the"), (4, "abalone abalone snails")], "query_id long, text string")
    r = search.top_k(search.ranked(search.query_terms(q), a), 1)
    assert {(x["query_id"], x["doc_id"]) for x in r.collect()} >= {(0, 0), (1, 1), (4, 0)}
    s = {(x["query_id"], x["doc_id"]): x["score"] for x in search.ranked(search.query_terms(q), a).collect()}
    assert s[0, 0] == 2 and s[4, 0] == 5 and not any(k[0] in (2, 3) for k in s)
    e = {(x["query_id"], x["doc_id"]): x["score"] for x in search.exact(search.query_terms(q, bigrams=True), a, bigrams=True).collect()}
    assert e == {(0, 0): 2.0, (1, 1): 1.0}
    p = index.posting_lists(corpus.build_corpus(docs, lower=True))
    index.save_postings(p, str(tmp_path / "p"))
    assert {r["a"]: r["sent_ids"] for r in index.load_postings(spark, str(tmp_path / "p")).collect()}["is"] == [0, 1, 2]


def test_hooks(spark, docs):
    q = spark.createDataFrame([(0, ["snails"])], "query_id long, text array<string>")
    t = search.query_terms(q, expand=lambda d: d.union(d.withColumn("a", F.lit("nice"))))
    assert {x["doc_id"] for x in search.ranked(t, tokens.sentence_arrays(docs, lower=True)).collect()} == {0, 1}


# --- phrases and fuzzy words
def greedy(tokens_, pairs, sep, right):
    out = list(tokens_)
    if right:
        i = len(out) - 1
        while i > 0:
            if (out[i - 1], out[i]) in pairs:
                out[i - 1 : i + 1] = [out[i - 1] + sep + out[i]]
                i -= 2
            else:
                i -= 1
        return out
    done, i = [], 0
    while i < len(out):
        if i + 1 < len(out) and (out[i], out[i + 1]) in pairs:
            done.append(out[i] + sep + out[i + 1])
            i += 2
        else:
            done.append(out[i])
            i += 1
    return done


@pytest.mark.parametrize("right", [True, False])
def test_merge_equals_greedy(spark, right):
    r = np.random.default_rng(5)
    sents = [(i, ["abc"[k] for k in r.integers(0, 3, r.integers(0, 14))]) for i in range(120)]
    pairs = {("a", "a"), ("a", "b"), ("b", "c")}
    d = spark.createDataFrame(sents, "i int, tokens array<string>")
    got = phrases.merge_phrases(d, spark.createDataFrame(list(pairs), "a string, b string"), ["i"], "_", right)
    assert {r["i"]: r["tokens"] for r in got.collect()} == {i: greedy(t, pairs, "_", right) for i, t in sents}


def test_rounds(spark):
    d = spark.createDataFrame([(i, "new york city is x{0} y{0}".format(i).split()) for i in range(8)], "i int, tokens array<string>")
    out, found = phrases.detect_phrases(d, ["i"])
    assert found.count() and any("_" in w for w in out.first()["tokens"])
    v = vocab.build_vocab(d.select("i", F.posexplode("tokens").alias("pos", "word")), ("i", "pos"))
    s, v2 = phrases.extend_by_rounds(d, v, ["i"])
    assert v2.count() > v.count() and [r["id"] for r in v2.orderBy("id").collect()] == list(range(v2.count()))
    one = spark.createDataFrame([(0, ["a", "b"])], "i int, tokens array<string>")
    assert phrases.score_bigrams(one).first()["npmi"] is None


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("k", [1, 2])
def test_fuzzy_equals_brute_force(spark, k):
    r = np.random.default_rng(k)
    words = sorted({"".join("abé"[c] for c in r.integers(0, 3, r.integers(1, 6))) for _ in range(70)})
    got = {(x["a"], x["b"]): x["distance"] for x in fuzzy.fuzzy_pairs(spark.createDataFrame([(w,) for w in words + words[:3]], "word string"), k).collect()}
    want = {(a, b): distance(a, b) for i, a in enumerate(words) for b in words[i + 1 :]}
    assert {tuple(sorted(p)): d for p, d in got.items()} == {tuple(sorted(p)): d for p, d in want.items() if d <= k}


# --- spans and tags
def brute_biluo(tags):
    out, start, label = [], None, None
    for i, t in enumerate(tags):
        kind, _, name = t.partition("-")
        if start is None:
            if kind == "U":
                out.append((i, i + 1, name))
            elif kind == "B":
                start, label = i, name
        elif kind in "IL" and name == label:
            if kind == "L":
                out.append((start, i + 1, label))
                start = None
        else:
            start = None
    return out


def test_parse_biluo(spark):
    r = np.random.default_rng(2)
    names = ["O", "B-x", "I-x", "L-x", "U-x", "B-y", "I-y", "L-y"]
    rows = [(i, [names[k] for k in r.choice(8, r.integers(0, 12))]) for i in range(200)]
    d = spark.createDataFrame(rows, "i int, t array<string>").select("i", spans.parse_biluo(F.col("t")).alias("s"))
    assert {x["i"]: [tuple(y) for y in x["s"]] for x in d.collect()} == {i: brute_biluo(t) for i, t in rows}


def test_golden_biluo(spark):
    text = "This is a first entity, then aa one and an other x ."
    d = spark.createDataFrame([(1, text)], "doc_id int, text string")
    t = tokens.token_offsets(d)
    s = spark.createDataFrame([(1, 10, 22, "ent1"), (1, 29, 31, "ent2"), (1, 11, 15, "bad")], "doc_id int, start int, end int, label string")
    got = spans.token_spans(t, s, ["doc_id"])
    assert {(r["label"], r["first"], r["last"], r["aligned"]) for r in got.collect()} == {("ent1", 3, 5, True), ("ent2", 7, 8, True), ("bad", None, None, False)}
    assert col(spans.biluo_encode(t, got.where("aligned"), ["doc_id"]), "pos", "tag") == ["O", "O", "O", "B-ent1", "L-ent1", "O", "O", "U-ent2"] + ["O"] * 6


def test_iob(spark):
    iob = ["B-NP", "I-NP", "I-NP", "B-NP", "O", "PRT", "B-NP"]
    d = spark.createDataFrame([(0, i, t) for i, t in enumerate(iob)], "s int, pos int, iob string")
    b = spans.iob_rows_to_biluo(d, ["s"])
    assert col(b, "pos", "biluo") == ["B-NP", "I-NP", "L-NP", "U-NP", "O", "O", "U-NP"]
    assert col(b.select("pos", spans.biluo_to_iob(F.col("biluo")).alias("x")), "pos", "x") == ["B-NP", "I-NP", "I-NP", "B-NP", "O", "O", "B-NP"]


def test_np_chunks(spark):
    t = "the/DET big/ADJ dog/NOUN of/ADP a/DET man/NOUN in/ADP town/NOUN runs/VERB fast/ADJ".split()
    d = spark.createDataFrame([(0, i, *x.split("/")) for i, x in enumerate(t)], "s int, pos int, word string, tag string")
    got = {(r["first"], r["last"], r["label"], r["chunk"]) for r in chunks.np_chunks(d, ["s"]).collect()}
    assert got == {(0, 6, "NP_of", "the_big_dog_of_a_man"), (7, 8, "NP", "town")}
    assert {r["chunk"] for r in chunks.np_chunks(d, ["s"], exceptions=("man",)).collect()} == {"the_big_dog", "town"}


def test_votes(spark):
    rows = [(["O"] * 3 + ["B-NP"] * 2, "S,x", "O"), (["O", "O", "B-NP", "B-NP", "I-NP"], "V", "O"), (["O", "O", "B-NP", "B-NP", "I-NP"], "A=", "B-NP"), (["B-NP", "B-NP", "I-NP", "I-NP", "O"], "V", "B-NP*"), (["I-NP", "I-NP"], "V", "I-NP"), ([], "V", None)]
    d = spark.createDataFrame(rows, "v array<string>, t string, want string")
    assert all(r["got"] == r["want"] for r in d.withColumn("got", chunks.pick_tag(F.col("v"), F.col("t"))).collect())
    f = spark.createDataFrame([(["O", "I-NP", "B-NP*", "O", "B-NP*", "I-NP"],)], "t array<string>").select(chunks.repair_tags(F.col("t"))).first()[0]
    assert f == ["O", "B-NP", "I-NP", "O", "B-NP", "I-NP"]


def test_features(spark):
    d = spark.createDataFrame([(0, 0, "The", "DT"), (0, 1, "Dogs", "NNS-x"), (0, 2, "ran", "VBD")], "s int, pos int, word string, tag string")
    f = {r["pos"]: r["features"] for r in chunks.crf_features(d, ["s"]).collect()}
    assert f[1] == ["upcase", "4", "dog", "ogs", "NNS", "Dogs", "DT", "vbd", "the", "ran", "", "", "dogs+vbd", "dogs+", "dogs+DT", "dogs+", "NNS+vbd", "NNS+", "NNS+DT", "NNS+"]
    w = chunks.crf_features_wide(d, ["s"]).where("pos = 1").first()["features"]
    assert w["word.2.posfix"] == "do+NNS+gs" and w["pword.shape"] == "downcase" and w["ppword.shape"] == "other" and w["nword.3.pref"] == ""


def test_plugged_in_tagger(spark):
    d = spark.createDataFrame([(0, 1, "b"), (0, 0, "a"), (1, 0, "c")], "s int, pos int, word string")
    got = chunks.tag_with(d, lambda: lambda ws: [w.upper() + str(len(ws)) for w in ws], ["s"])
    assert {(r["s"], r["pos"], r["tag"]) for r in got.collect()} == {(0, 0, "A2"), (0, 1, "B2"), (1, 0, "C1")}


# --- encoders, scoring, map and reduce
def test_batches(spark):
    n = [3, 9, 1, 4, 4, 20, 2]
    d = spark.createDataFrame([(i, k, list(range(k))) for i, k in enumerate(n)], "doc_id int, n_tokens int, ids array<long>")
    b = encode.length_batches(d, 2, 20)
    assert [(r["doc_id"], r["batch"]) for r in b.orderBy("n_tokens", "doc_id").collect()] == [(2, 0), (6, 0), (0, 1), (3, 1), (4, 2), (1, 2)]
    p = {r["doc_id"]: r for r in encode.pad_batches(b, max_len=5).collect()}
    assert p[2]["ids"] == [0, 1] and p[2]["mask"] == [True, False] and p[1]["ids"] == [0, 1, 2, 3, 4] and p[4]["ids"] == [0, 1, 2, 3, 1]
    assert encode.batch_count(d, 2, 20).first()[0] == 3


def test_codes(spark):
    d = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "b")], "i int, v string")
    c = encode.value_codes(d, "v")
    assert {r["value"]: r["code"] for r in c.collect()} == {"a": 0, "b": 1}
    assert {r["value"]: r["code"] for r in encode.first_seen_codes(d, "v", ["i"]).collect()} == {"b": 0, "a": 1}
    e = encode.encode_values(d, c, "v", default=9)
    assert col(e, "i", "code") == [1, 0, 9, 1] and col(encode.decode_values(e, c), "i", "value") == ["b", "a", None, "b"]


def test_dedup(spark):
    d = spark.createDataFrame([(3, "x", 1), (1, "x", 2), (2, None, 3), (0, None, 4)], "doc_id int, text string, extra int")
    assert sorted((r["doc_id"], r["extra"]) for r in encode.dedup_by_content(d).collect()) == [(0, 4), (1, 2)]


def test_scores(spark):
    d = spark.createDataFrame([(1, 1, True), (1, 0, True), (0, 1, True), (0, 1, False), (None, 1, True)], "t int, g int, m boolean")
    r = scoring.prf1(d, F.col("t") == 1, F.col("g") == 1, F.col("m")).first()
    assert (r["tp"], r["fp"], r["fn"]) == (1, 2, 1) and abs(r["precision"] - 1 / 3) < 1e-6 and abs(r["f1"] - 0.4) < 1e-6
    assert scoring.prf1(d.limit(0), F.col("t") == 1, F.col("g") == 1).first()["f1"] == 0


def test_fold(spark):
    d = spark.createDataFrame([("a b a",), ("b",), (None,)], "t string")
    got = mapreduce.map_fold(d, lambda r: [(w, 1) for w in (r["t"] or "").split()] + [(None, 5)], lambda acc, v: int((acc or 0) + v), "key string, value long")
    assert {r["key"]: r["value"] for r in got.collect()} == {"a": 2, "b": 2}


# --- subwords, readers, streams
def test_alignment(spark):
    text = "Hello  wörld again"
    assert [text[a:z] for a, z in S.align_surface(["▁Hel", "lo", "▁wör", "ld", "▁", "again"], text)] == ["Hel", "lo", "wör", "ld", "", "again"]
    assert [text[a:z] for a, z in S.align_wordpiece([("hello", ["hel", "##lo"]), ("wörld", ["[UNK]"]), ("again", ["again"])], text, lower=True)] == ["Hel", "lo", "wörld", "again"]
    assert [text[a:z] for a, z in S.align_bytes(["Hello", "Ġ", "ĠwÃ¶r", "ld", "Ġagain"], text)] == ["Hello", "", "wör", "ld", "again"]
    d = spark.createDataFrame([(["▁Hel", "lo"], "Hello"), (None, "x")], "p array<string>, t string")
    assert [r["s"] and [tuple(x) for x in r["s"]] for r in d.select(S.align()("p", "t").alias("s")).collect()] == [[(0, 3), (3, 5)], None]
    j = spark.createDataFrame([(["▁Hel", "lo", "▁you"], ["hel", "##lo", "you"])], "a array<string>, b array<string>").select(S.join_pieces(F.col("a")), S.join_wordpieces(F.col("b"))).first()
    assert tuple(j) == ("Hello you", "hello you")
    t = S.tokenize_with(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id int, text string"), lambda: lambda ts: [x.split() for x in ts])
    assert {r["doc_id"]: r["pieces"] for r in t.collect()} == {1: ["a", "b"], 2: None}


def test_readers(spark, tmp_path):
    p = lambda n: str(tmp_path / n)
    (tmp_path / "a.jsonl").write_text(json.dumps(["Text é", {"ents": [[0, 4, "x"], [5, 6, None]], "cats": "c"}]) + "\n\n" + json.dumps(["b", {}]) + "\nbroken\n")
    r = readers.read_jsonl(spark, p("a.jsonl")).collect()
    assert len(r) == 3 and r[0]["text"] == "Text é" and tuple(r[0]["ents"][0]) == (0, 4, "x") and r[0]["cats"] == "c" and r[1]["ents"] is None
    (tmp_path / "w/AA").mkdir(parents=True)
    (tmp_path / "w/AA/wiki_00").write_text('{"text": "one"}\n\n{"text": "two"}\n')
    (tmp_path / "w/AA/.hidden").write_text('{"text": "no"}\n')
    assert sorted(r["text"] for r in readers.read_wiki(spark, p("w")).collect()) == ["one", "two"]
    (tmp_path / "c.conllu").write_text("# id\n" + "\n".join("\t".join([str(i), w] + ["_"] * 7 + [m]) for i, (w, m) in enumerate([("Hi", "SpaceAfter=No"), ("!", "_")])) + "\n\n" + "\t".join(["1", "Yo"] + ["_"] * 8) + "\n")
    assert [(r["form"], r["space_after"]) for r in readers.read_conllu(spark, p("c.conllu")).orderBy("sent", "pos").collect()] == [("Hi", False), ("!", True), ("Yo", True)]
    (tmp_path / "k.txt").write_text("a DT B-NP\nb NN I-NP\n\nc VB O\n")
    assert [(r["token"], r["tag"], r["iob"]) for r in readers.read_chunks(spark, p("k.txt")).orderBy("sent", "pos").collect()] == [("a", "DT", "B-NP"), ("b", "NN", "I-NP"), ("c", "VB", "O")]
    (tmp_path / "v.txt").write_text("3 2\na 1 2\nb 3 4\na 5 6.5\n")
    assert {r["word"]: (r["idx"], r["vector"]) for r in readers.read_vectors(spark, p("v.txt")).collect()} == {"a": (2, [5.0, 6.5]), "b": (1, [3.0, 4.0])}
    (tmp_path / "bad.txt").write_text("1 2\na 1 2 3\n")
    with pytest.raises(Exception):
        readers.read_vectors(spark, p("bad.txt")).collect()
    (tmp_path / "i.txt").write_text("1 2 3\n\n4\n")
    assert sorted(r["ids"] for r in readers.read_ids(spark, p("i.txt")).collect()) == [[1, 2, 3], [4]]
    (tmp_path / "p.txt").write_text("w 3\nx\ny z 4\nq 5\n")
    assert sorted(tuple(r) for r in readers.read_pairs(spark, p("p.txt")).collect()) == [("q", 5), ("w", 3)]
    (tmp_path / "l.txt").write_text("a b\n c\n")
    assert sorted(r["word"] for r in readers.read_words(spark, p("l.txt")).collect()) == ["a", "b", "c"]
    assert readers.read_documents(spark, p("l.txt")).count() == 2
    readers.write_mapping({"a": [1, "é"]}, p("m.json"))
    assert readers.read_mapping(p("m.json")) == {"a": [1, "é"]}
    readers.write_counts(spark.createDataFrame([("a", 2)], "word string, count long"), p("counts"))
    assert spark.read.text(p("counts")).first()["value"] == "a\t2"


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("One two. two\nthree\n")
    q = wordcount.streaming_word_count(wordcount.read_lines(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("wc").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {r["word"]: r["count"] for r in spark.table("wc").collect()} == {"One": 1, "two": 2, ".": 1, "three": 1}
    (tmp_path / "docs").mkdir()
    src = spark.readStream.schema("doc_id long, text string").json(str(tmp_path / "docs"))
    (tmp_path / "docs/a.json").write_text('{"doc_id": 1, "text": "A b. C d."}\n')
    q = wordcount.append_to_corpus(src, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_windows_in_event_time(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a.json").write_text('{"ts": "2024-01-01T00:01:00Z", "text": "a a"}\n{"ts": "2024-01-01T00:07:00Z", "text": "a"}\n')
    src = spark.readStream.schema("ts timestamp, text string").json(str(tmp_path / "s"))
    q = wordcount.windowed_word_count(src).writeStream.format("memory").queryName("win").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["start"].minute, r["count"]) for r in spark.table("win").collect()) == [(0, 2), (5, 1)]
