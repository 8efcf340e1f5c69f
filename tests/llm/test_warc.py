import base64
import gzip
import hashlib
import io
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import warc as W


def sha(x):
    return "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()


def raw(block=b"hello", **h):
    h = {"WARC-Type": "resource", "WARC-Block-Digest": sha(block), "Content-Length": str(len(block))} | h
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in h.items() if v is not None).encode() + b"\r\n" + block + b"\r\n\r\n"


class Slow:
    """Gives few bytes at a time."""

    def __init__(self, data, n):
        self.f, self.n = io.BytesIO(data), n

    def read(self, n):
        return self.f.read(min(n, self.n))


@pytest.mark.parametrize("n", [1, 7, 1000, 1 << 20])
@pytest.mark.parametrize("packed", [True, False])
def test_any_read_size(n, packed):
    r = random.Random(n)
    blocks = [bytes(r.randrange(256) for _ in range(r.choice((0, 1, 50, 3000)))) for _ in range(8)]
    data = b"".join(gzip.compress(raw(b)) if packed else raw(b) for b in blocks)
    rows = list(W.read_records(Slow(data, n)))
    assert [x["payload"] for x in rows] == blocks and all(x["block_digest_ok"] and x["error"] is None for x in rows)
    assert rows[0]["offset"] == 0


def test_damage_costs_one_record():
    good = gzip.compress(raw(b"good" * 50))
    bad = bytearray(good)
    bad[30] ^= 0xFF
    for middle in (bytes(bad), good[: len(good) // 2], gzip.compress(b"no warc\r\n\r\n"), gzip.compress(raw(b"x", **{"Content-Length": "ten"})), gzip.compress(raw(b"abc", **{"Content-Length": "99"}))):
        rows = list(W.read_records(io.BytesIO(good + middle + good)))
        assert [x["error"] is None for x in rows].count(True) == 2, rows
        assert any(x["error"] for x in rows)
    cut = list(W.read_records(io.BytesIO(good + good[:-9])))
    assert cut[0]["error"] is None and cut[-1]["error"]


@pytest.mark.parametrize("n", [1, 7, 1 << 20])
def test_records_in_one_member(n):
    blocks = [b"a" * 3000, b"", b"b\r\n", b"c"]
    one, last = gzip.compress(b"".join(map(raw, blocks))), gzip.compress(raw(b"d"))
    rows = list(W.read_records(Slow(one + last, n)))
    assert [x["payload"] for x in rows] == [*blocks, b"d"] and all(x["block_digest_ok"] and x["error"] is None for x in rows)
    assert [x["offset"] for x in rows] == [0] * 4 + [len(one)]
    rows = list(W.read_records(Slow(gzip.compress(raw(b"a") + b"no record") + last, n)))
    assert [(x["payload"], x["error"] is None) for x in rows] == [(b"a", True), (None, False), (b"d", True)]


@pytest.mark.parametrize("n", [1, 7, 1000, 1 << 20])
def test_every_undamaged_record_comes_out(n):
    r = random.Random(5)
    good = [gzip.compress(raw(bytes(r.randrange(256) for _ in range(200)) + b"%d" % i)) for i in range(4)]
    plain = [raw(b"plain %d" % i) for i in range(3)]
    spoiled = bytearray(gzip.compress(raw(bytes(r.randrange(256) for _ in range(5000)))))
    spoiled[2000:2040] = b"\x00" * 40
    short = raw(b"abc", **{"Content-Length": "2"})
    long = raw(b"abc", **{"Content-Length": "90"})
    beyond = raw(b"abc", **{"Content-Length": "99999"})
    none = raw(b"abc", **{"Content-Length": None})
    cases = [
        ([good[0], b"garbage bytes", good[1], good[2]], 3),
        ([plain[0].replace(b"Content-Length", b"Nothing"), good[0], good[1]], 2),
        ([none, plain[0], plain[1]], 2),
        ([short, plain[0], good[0]], 2),
        ([long, plain[0], plain[1]], 2),
        ([beyond, plain[0], good[0], plain[1]], 3),
        ([good[0], bytes(spoiled), good[1], bytes(spoiled)[:3000], good[2], plain[0]], 4),
        ([bytes(spoiled)[:3000], b"\n", plain[0], good[0]], 2),
        ([gzip.compress(raw(b"x") + raw(b"y", **{"Content-Length": "z"}) + raw(b"w")), good[0]], 3),
        ([b"\x1f\x8b\x08\x00rubbish\n", plain[0], b"WARC", good[0], b"no end"], 2),
    ]
    for parts, want in cases:
        rows = list(W.read_records(Slow(b"".join(parts), n)))
        assert sum(x["error"] is None and x["block_digest_ok"] for x in rows) == want, parts
        assert any(x["error"] for x in rows)
    rows = list(W.read_records(Slow(good[0] + b"garbage" * 50_000 + good[1], max(n, 1000))))
    assert [x["error"] is None for x in rows] == [True, False, True]


def test_headers_without_end():
    rows = list(W.read_records(io.BytesIO(b"WARC/1.0\r\n" + b"a: b\r\n" * 400_000 + raw(b"ok"))))
    assert [x["error"] is None for x in rows] == [False, True]


def test_digests():
    rows = list(W.read_records(io.BytesIO(raw(b"a") + raw(b"a", **{"WARC-Block-Digest": sha(b"b")}) + raw(b"a", **{"WARC-Block-Digest": None}) + raw(b"a", **{"WARC-Block-Digest": "sha256:" + hashlib.sha256(b"a").hexdigest()}) + raw(b"a", **{"WARC-Block-Digest": "crc:1"}))))
    assert [x["block_digest_ok"] for x in rows] == [True, False, None, True, None]


def test_http_payload_and_headers():
    body = b"<html>\xff</html>"
    block = b"HTTP/1.1 404 Not Found\r\nA: b\r\n\r\n" + body
    r = next(W.read_records(io.BytesIO(gzip.compress(raw(block, **{"content-type": "application/http; msgtype=response", "WARC-Payload-Digest": sha(body), "warc-target-uri": "http://x/\r\n y"})))))
    assert r["http_status"] == 404 and r["payload"] == body and r["payload_digest_ok"] and r["target_uri"] == "http://x/ y"


def test_empty():
    assert not list(W.read_records(io.BytesIO(b""))) and not list(W.read_records(io.BytesIO(b"\r\n\r\n")))


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a", "<p>é 漢 🙂</p>"), (2, None, ""), (3, "http://b\nc", None), (None, "http://d", "x" * 300_000), (1, "http://a", "<p>é 漢 🙂</p>"), (4, "u", "\x00\r\n\r\n")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).withColumn("name", F.lit("clash"))


def test_round_trip(spark, pages):
    r = W.read_warc(W.write_warc(pages))
    got = r.select(F.regexp_extract("record_id", r"page:(\d+)", 1).try_cast("long").alias("i"), "target_uri", F.decode("payload", "UTF-8").alias("h")).collect()
    want = [(p["page_id"], p["url"] and p["url"].replace("\n", "%0A"), p["html"]) for p in pages.collect()]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert r.where("error is not null or not block_digest_ok or not payload_digest_ok").count() == 0
    assert W.read_warc(W.write_warc(pages.limit(0))).count() == 0
    assert W.read_warc(spark.createDataFrame([(None, "n")], "content binary, name string")).count() == 0


def test_files(spark, pages, tmp_path):
    for r in W.write_warc(pages.repartition(2)).collect():
        (tmp_path / f"{abs(hash(r['content']))}.warc.gz").write_bytes(r["content"])
    files = [(str(p),) for p in tmp_path.iterdir()] + [(None,)]
    assert W.read_warc_files(spark.createDataFrame(files, "path string")).count() == pages.count()
    again = W.read_warc_files(W.write_warc_files(pages, str(tmp_path / "more")))
    assert again.count() == pages.count() and again.where("error is not null").count() == 0
