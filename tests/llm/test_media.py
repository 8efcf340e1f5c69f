import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import media as M


def film(levels, lengths, rate=10, side=16, index=True, seed=0):
    r = np.random.default_rng(seed)
    f = np.concatenate([np.clip(v + r.normal(0, 6, (n, side, side)), 0, 255) for v, n in zip(levels, lengths)]).astype(np.uint8)
    return f, M.write_avi(M.encode_grey(f), side, side, rate, index)


@pytest.mark.parametrize("h,w", [(8, 8), (16, 24), (40, 8)])
def test_decoder_inverts_encoder(h, w):
    y, x = np.mgrid[0:h, 0:w]
    planes = np.stack([(128 + 100 * np.sin(x / 5 + k) * np.cos(y / 7)).astype(np.uint8) for k in range(3)])
    for p, j in zip(planes, M.encode_grey(planes)):
        d = M.decode_luma(j)
        assert d.shape == p.shape and np.abs(d.astype(int) - p).mean() < 4


def codes(counts, symbols):
    code, length = M._codes(counts, symbols)
    return {x: f"{code[x]:0{length[x]}b}" for x in symbols}


def subsampled(pad, levels=(100, 140, 60, 200)):
    """A 4:2:0 colour frame with restart markers, whose blocks are flat: luma 100, 140, 60 and 200 in the four 8x8 fields of each of two MCUs."""
    dc, ac, dc1, ac1 = codes(*M._DC0), codes(*M._AC0), codes(*M._DC1), codes(*M._AC1)
    bits = lambda v: f"{v if v > 0 else v + (1 << abs(v).bit_length()) - 1:0{abs(v).bit_length()}b}" if v else ""
    body = b""
    for mcu in range(2):
        s, last = "", 0
        for level in levels:
            v = level - 128  # 8 * (level - 128) / quantiser 8
            s += dc[abs(v - last).bit_length()] + bits(v - last) + ac[0]
            last = v
        s += (dc1[0] + ac1[0]) * 2
        s += "1" * (-len(s) % 8)
        body += int(s, 2).to_bytes(len(s) // 8, "big").replace(b"\xff", b"\xff\x00") + (b"\xff\xd0" if mcu == 0 else b"")
    q = b"\xff\xdb\x00\x43\x00" + bytes([8] * 64)
    sof = b"\xff\xc0\x00\x11\x08" + struct.pack(">HH", 16, 32) + b"\x03\x01\x22\x00\x02\x11\x00\x03\x11\x00"
    return b"\xff\xd8" + q + b"\xff\xdd\x00\x04\x00\x01" + sof + b"\xff\xda\x00\x0c\x03\x01\x00\x02\x11\x03\x11\x00\x3f\x00" + body + pad


@pytest.mark.parametrize("pad", [b"\xff\xd9", b"", b"\xff\xd9junk"])
def test_colour_sampling_and_restarts(pad):
    y = M.decode_luma(subsampled(pad))
    assert y.shape == (16, 32)
    for mcu in (0, 16):
        assert [int(y[r, mcu + c]) for r in (2, 10) for c in (2, 10)] == [100, 140, 60, 200]


def test_side_by_side_equals_one_by_one():
    """Noise of all strengths, and colour frames with restarts; some frames are damaged."""
    r = np.random.default_rng(7)
    noise = np.clip(128 + r.normal(0, 1, (60, 24, 16)) * np.linspace(0, 120, 60)[:, None, None], 0, 255).astype(np.uint8)
    colour = [subsampled(b"\xff\xd9", tuple(int(x) for x in r.integers(8, 248, 4))) for _ in range(40)]
    for frames in (M.encode_grey(noise), colour):
        for i in (3, 11, 20, 21):
            f = bytearray(frames[i])
            at = len(f) - int(r.integers(4, 20))
            f[at:] = r.integers(0, 256, len(f) - at, dtype=np.uint8).tobytes() if i != 3 else b""
            frames[i] = bytes(f)
        planes, good = M.decode_alike(frames, M._header(frames[0]))
        assert 30 < good.sum() < len(frames)
        for f, p, ok in zip(frames, planes, good):
            try:
                assert (M.decode_luma(f) == p).all() and ok
            except ValueError:
                assert not ok


def test_nested_lists_are_no_danger(spark):
    deep = b""
    for _ in range(3000):
        deep = b"LIST" + struct.pack("<I", len(deep) + 4) + b"movi" + deep
    a = b"RIFF" + struct.pack("<I", len(deep) + 4) + b"AVI " + deep
    assert M.clips_of([a])[0][0][-1] == "no video stream"
    r = M.detect_clips(spark.createDataFrame([(1, bytearray(a)), (2, bytearray(film([60, 180], [4, 4])[1]))], "vec_id long, avi binary")).collect()
    assert sorted((x["vec_id"], x["clip"]) for x in r if x["clip"] is not None) == [(2, 0), (2, 1)] and len(r) == 3


def test_bad_frames():
    j = M.encode_grey(np.full((1, 8, 8), 90, np.uint8))[0]
    for bad in (b"", b"no", j[:20], j.replace(b"\xff\xc0", b"\xff\xc2"), j[:60] + j[-2:]):
        with pytest.raises((ValueError, IndexError)):
            M.decode_luma(bad)


@pytest.mark.parametrize("index", [True, False])
def test_shots(index):
    _, a = film([60, 150, 90, 200], [5, 7, 4, 9], index=index)
    got = M.clips_of([a])[0]
    assert [c[:3] for c in got] == [(0, 0, 4), (1, 5, 11), (2, 12, 15), (3, 16, 24)]
    assert [c[3:5] for c in got] == [(0.0, 0.5), (0.5, 1.2), (1.2, 1.6), (1.6, 2.5)] and all(c[6] == 0 for c in got)


def test_steady_movement_is_no_cut():
    ramp = np.stack([np.full((16, 16), 20 + 20 * k, np.uint8) for k in range(11)])
    assert M.shot_starts(M.histograms(M.encode_grey(ramp))[0]) == [0]


def test_index_kinds():
    f, a = film([60, 180], [4, 4])
    want = M.parse_avi(a)[1]
    at = a.index(b"idx1")
    movi = a.index(b"movi")
    n = int.from_bytes(a[at + 4 : at + 8], "little")
    absolute = bytearray(a)
    for i in range(at + 8, at + 8 + n, 16):
        absolute[i + 8 : i + 12] = struct.pack("<I", int.from_bytes(a[i + 8 : i + 12], "little") + movi)
    assert M.parse_avi(bytes(absolute))[1] == want
    wild = bytearray(a)
    wild[at + 16 : at + 20] = b"\xff\xff\xff\x7f"
    assert M.parse_avi(bytes(wild))[1] == want  # the index is wrong, the list is walked
    assert len(M.parse_avi(a[: at - 300])[1]) >= 4  # cut short
    places, p = [], movi + 4
    while a[p : p + 4] == b"00dc":
        size = int.from_bytes(a[p + 4 : p + 8], "little")
        places.append((p + 8, size))
        p += 8 + size + (size & 1)
    body = struct.pack("<HBBI4sQI", 2, 0, 1, len(places), b"00dc", 0, 0) + b"".join(struct.pack("<II", *x) for x in places)
    assert M.parse_avi(a[:at] + b"ix00" + struct.pack("<I", len(body)) + body)[1] == want


def test_index_of_the_first_segment_only():
    f, a = film([60, 180], [4, 4])
    _, b = film([90, 200], [5, 3], seed=1)
    want = M.parse_avi(a)[1] + M.parse_avi(b)[1]
    movi = b[b.index(b"movi") - 8 : b.index(b"idx1")]
    two = a + b"RIFF" + struct.pack("<I", 4 + len(movi)) + b"AVIX" + movi
    assert M.parse_avi(two)[1] == want
    assert [c[1:3] for c in M.clips_of([two])[0]] == [(0, 3), (4, 7), (8, 12), (13, 15)]
    at = a.index(b"idx1")
    short = a[: at + 4] + struct.pack("<I", 16 * 3) + a[at + 8 : at + 8 + 16 * 3]
    assert M.parse_avi(short)[1] == M.parse_avi(a)[1]  # an index of three of the eight frames
    first = two.index(b"00dc") + 8
    body = struct.pack("<HBBI4sQI", 2, 0, 1, 1, b"00dc", 0, 0) + struct.pack("<II", first, len(want[0]))
    assert M.parse_avi(two + b"ix00" + struct.pack("<I", len(body)) + body)[1] == want  # neither index is whole


def test_odd_rows(spark):
    _, a = film([60, 180], [4, 4])
    broken = bytearray(a)
    p = a.index(b"00dc", a.index(b"movi")) + 8
    broken[p : p + 2] = b"xx"
    films = [(1, a), (None, a), (1, a), (2, None), (3, b""), (4, b"RIFF"), (5, M.write_avi([], 8, 8)), (6, bytes(broken)), (7, M.write_avi([M.encode_grey(np.full((1, 8, 8), 9, np.uint8))[0], b""], 8, 8))]
    df = spark.createDataFrame(films, "vec_id long, avi binary").withColumn("key", F.lit("clash")).withColumn("clip", F.lit(3))
    r = M.detect_clips(df).collect()
    by = {}
    for x in r:
        by.setdefault(x["vec_id"], []).append(x)
    assert len(by[1]) == 4 and len(by[None]) == 2
    assert all(len(by[k]) == 1 and by[k][0]["error"] and by[k][0]["clip"] is None for k in (2, 3, 4, 5))
    assert by[6][0]["bad_frames"] == 1 and by[7][0]["n_frames"] == 2 and by[7][0]["bad_frames"] == 0
    assert M.detect_clips(df.limit(0)).count() == 0


def test_planted_shots_of_odd_vectors(spark):
    rows = [(0, [0.0] * 64), (1, []), (2, None), (None, [1.0]), (3, [float("nan"), float("inf")])]
    out = M.detect_clips(M.videos_of(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))).collect()
    assert {x["vec_id"]: x["error"] for x in out if x["error"]} == {2: "no content", None: "no content"}
    assert [sum(x["vec_id"] == i for x in out) for i in (0, 1, 3)] == [2, 3, 2]
