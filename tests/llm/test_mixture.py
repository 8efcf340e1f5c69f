import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import tiktoken

from corpusmill.llm import bpe
from corpusmill.llm import mixture as M

from .conftest import doc


ENCODE = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load_ranks(), special_tokens={})


PIECE = {i: b for b, i in bpe.load_ranks().items()}


def char_bytes(ids):
    """The bytes of each id, those of a character at the id where it begins."""
    out = []
    for t in ids:
        own = PIECE[t]
        lead = 0
        while lead < len(own) and own[lead] & 0xC0 == 0x80:
            lead += 1
        if lead:
            k = max(k for k in range(len(out)) if out[k])
            out[k] += own[:lead]
        out.append(own[lead:])
    return out


def brute(rows, slots=None, weights=None, block=8, shard=4, seed=3, group_tokens=M.GROUP_TOKENS):
    """The same mixture with plain loops. rows: (doc_id, text, lang, source). Gives (shard, slot, source, block, ids, doc_ids, lang, text)."""
    by, eod = {}, ENCODE.encode_ordinary(M.EOD)
    for i, text, lang, source in rows:
        if text and text.strip():
            h, t = (int(x[0]) for x in M.places_of([i], [text]))
            by.setdefault(source, []).append((h, (i is not None, i or 0, t), i, lang, ENCODE.encode_ordinary(text) + eod))
    names, blocks, size = sorted(by, key=lambda s: (s is not None, s)), {}, {}
    for s in names:
        size[s] = n = sum(len(x[4]) for x in by[s])
        groups = 1
        while groups * group_tokens < n:
            groups *= 2
        whole, rest = [], []
        for g in range(groups):
            run = [(t, i, lang, b) for _, _, i, lang, ids in sorted((x for x in by[s] if x[0] % groups == g), key=lambda x: x[1]) for t, b in zip(ids, char_bytes(ids))]
            k = len(run) // block * block
            whole += [run[a : a + block] for a in range(0, k, block)]
            rest += run[k:]
        blocks[s] = whole + [rest[a : a + block] for a in range(0, len(rest), block)]
    slots = sum(map(len, blocks.values())) if slots is None else slots
    p = np.array([size[s] ** M.ALPHA if weights is None else weights.get(s, 0) for s in names], dtype=float)
    p /= p.sum()
    used, out = Counter(), []
    for k in range(-(-slots // shard)):
        c = np.random.default_rng([seed, k]).multinomial(min(shard, slots - k * shard), p)
        place = 0
        for s, n in zip(names, c):
            for _ in range(n):
                m = len(blocks[s])
                e, at = divmod(used[s], m)
                b = int(M.permute(np.array([at]), m, M.key_of(seed, s, e))[0])
                used[s] += 1
                got = blocks[s][b]
                out.append((k, place, s, b, [x[0] for x in got], [i for i in dict.fromkeys(x[1] for x in got) if i is not None], got[0][2], b"".join(x[3] for x in got).decode()))
                place += 1
    return out


def rows_of(df):
    rows = df.collect()
    assert all(r["n_tokens"] == len(r["ids"]) for r in rows)
    return sorted(((r["shard"], r["slot"], r["source"], r["block"], list(r["ids"]), list(r["doc_ids"]), r["lang"], *([r["text"]] if "text" in df.columns else [])) for r in rows), key=repr)


def texts(n=40):
    r = random.Random(n)
    words = ["naïve", "漢字", "🙂🙂", "the", "  two", "line\n", "\tx", "straße", "of", "blocks"]
    return [doc(i, " ".join(r.choices(words, k=i % 13)), "abcd"[i % 4 if i % 3 else 0], "en" if i % 2 else "de") for i in range(n)] + [doc(90, None, "a"), doc(91, " ", "c"), doc(92, "alone", "e"), doc(93, "alone", "e")]


@pytest.mark.parametrize("weights,group,slots", [(None, 10**6, None), (None, 30, 157), ({"a": 1.0, "b": 3.0, "zzz": 9.0}, 50, 57)])
def test_equals_brute_force(docs_of, weights, group, slots):
    """One group a source, and several, with more slots than blocks."""
    rows = texts() + [doc(None, "no id", "a"), doc(None, "none here", "a"), doc(3, "the same id", "a"), doc(3, "the same id", "a")]
    got = rows_of(M.mix_sources(docs_of(rows), weights, block_tokens=8, slots=slots, shard_slots=4, seed=3, group_tokens=group, with_text=True))
    assert got == sorted(brute([r[:4] for r in rows], slots, weights, group_tokens=group), key=repr)


def test_permutation_is_one():
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        assert sorted(M.permute(np.arange(n), n, 12345).tolist()) == list(range(n))


@pytest.mark.parametrize("group", [40, 10**6])
def test_blocks_lose_nothing(docs_of, group):
    """In one epoch every id comes once, all blocks of a source but one at most have the same length, and texts are the documents'."""
    rows = [doc(i, f" {i}\t漢字🙂 " * (1 + i % 5) + "\n", "st"[i % 2]) for i in range(60)]
    r = M.mix_sources(docs_of(rows), {"s": 1, "t": 1}, block_tokens=16, group_tokens=group, slots=100_000, shard_slots=100_000, with_text=True).select("source", "block", "n_tokens", "ids", "text", "doc_ids").dropDuplicates(["source", "block"]).collect()
    for s in "st":
        own = [x for x in r if x["source"] == s]
        assert sorted(x["block"] for x in own) == list(range(len(own))) and sum(x["n_tokens"] != 16 for x in own) <= 1
        assert sorted(t for x in own for t in x["ids"]) == sorted(t for d in rows if d[3] == s for t in ENCODE.encode_ordinary(d[1]) + ENCODE.encode_ordinary(M.EOD))
        assert Counter("".join(x["text"] for x in own)) == Counter("".join(d[1] + M.EOD for d in rows if d[3] == s))
        assert not any("\ufffd" in x["text"] for x in own)
    assert {i for x in r for i in x["doc_ids"]} == set(range(60))
    if group > 40:  # one group: the blocks in order are the documents in order of the id
        for s in "st":
            assert "".join(x["text"] for x in sorted((x for x in r if x["source"] == s), key=lambda x: x["block"])) == "".join(d[1] + M.EOD for d in rows if d[3] == s)


def test_counts_follow_weights(docs_of):
    rows = [doc(i, "a b c d e f g h", "xy"[i % 2]) for i in range(200)]
    c = Counter(r["source"] for r in M.mix_sources(docs_of(rows), {"x": 1, "y": 4}, block_tokens=8, slots=4000).collect())
    assert abs(c["y"] / 4000 - 0.8) < 0.03


def test_odd_rows(odd_docs, no_docs, docs_of):
    assert M.mix_sources(no_docs).count() == 0
    assert M.mix_sources(docs_of([doc(1, None), doc(2, "")])).count() == 0
    r = M.mix_sources(odd_docs).toPandas()
    assert len(r) and "text" not in r and (r.n_tokens > 0).all() and (r.n_tokens <= M.BLOCK_TOKENS).all()
    nulls = M.mix_sources(odd_docs, {None: 1.0, "s0": 1.0}, slots=50).toPandas()
    assert pd.isna(nulls.source).any() and set(nulls.source.dropna()) == {"s0"}  # a null source is a source
    d = M.mixed_documents(odd_docs)
    assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"] and d.select("doc_id").distinct().count() == len(r)
