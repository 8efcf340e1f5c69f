"""Media columns: AVI motion-JPEG to timed clip rows.

The RIFF tree of an AVI is walked for the header (frame rate) and the index: ``idx1`` with offsets from ``movi`` or from
the start of the file, or the OpenDML ``ix##`` chunks, or, where neither is sound, the chunks of ``movi`` in order. An index is taken only
if it covers every frame chunk found in the ``movi`` lists of all segments (``AVI `` and ``AVIX``); else its sound entries and the
chunks found are taken together, by place. Every
frame is an intra frame: a baseline JPEG (grey or colour, any sampling, restart markers, default Huffman tables where the
file leaves them out), of which the luma plane is decoded. Frames with the same header, of whatever film, are decoded side by side, a
symbol of each restart interval at a time. Consecutive luma histograms are compared by the earth mover's
distance, as a share of the full range; a cut is where it reaches FLOOR and exceeds the median of its neighbourhood
by SPREAD median deviations and by its own height, so the bar follows the movement in the scene. Of cuts less than MIN_SHOT frames apart the
strongest stays, the earlier on a tie.

Rows: key, clip (0, 1, ..), first_frame, last_frame, start_s, end_s, n_frames, bad_frames, error.
Defined cases: null or empty content, content that is no AVI, and an AVI without a frame of its video stream give one row
with ``error`` and null clip; a frame that can't be decoded takes the histogram of the frame before it and counts in
``bad_frames``; an empty frame chunk repeats the frame before it (a dropped frame) and isn't bad; a file cut short gives the frames that are
there; lists may be nested to any depth; a frame rate of zero counts as 25; very long films are decoded in parts; of equal
differences the earlier is the cut; an empty table gives no row; repeated rows give their clips again; null keys are kept; other
columns are not read.
"""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BINS = 64
FLOOR = 0.06
SPREAD = 6.0
WINDOW = 12
MIN_SHOT = 3
ROOM, PIXELS, SIDE_BY_SIDE = 16 << 20, 4 << 20, 16
_ZIGZAG = np.array([0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63])
# the tables of annex K of the JPEG standard: code counts by length and symbols
_DC0 = (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12)))
_DC1 = (bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]), bytes(range(12)))
_AC0 = (bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]), bytes.fromhex("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"))
_AC1 = (bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]), bytes.fromhex("0001020311040521310612415107617113223281081442 91a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa".replace(" ", "")))
_QUANT = np.array([16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99])
_k = np.arange(8)
_DCT = np.cos((2 * _k[None, :] + 1) * _k[:, None] * np.pi / 16) * np.where(_k == 0, np.sqrt(1 / 8), 0.5)[:, None]
_INVERSE = np.kron(_DCT, _DCT)[_ZIGZAG]  # coefficients in zigzag order @ this = the block's pixels


@functools.lru_cache(64)
def _lookup(counts: bytes, symbols: bytes) -> list[int]:
    """16 bits ahead -> code length << 8 | symbol; 0 where no code begins."""
    out, code, at = [0] * 65536, 0, 0
    for n, c in enumerate(counts, 1):
        for _ in range(c):
            a = code << (16 - n)
            if a + (1 << (16 - n)) > 65536 or at >= len(symbols):
                raise ValueError("bad Huffman table")
            out[a : a + (1 << (16 - n))] = [n << 8 | symbols[at]] * (1 << (16 - n))
            code, at = code + 1, at + 1
        code <<= 1
    return out


class _Bits:
    """Entropy-coded bytes of one restart interval, without stuffing."""

    def __init__(self, data: bytes):
        self.data, self.at, self.acc, self.n = data + b"\xff" * 8, 0, 0, 0
        self.end = len(data) + 8

    def fill(self) -> None:
        if self.at >= self.end:
            raise ValueError("scan cut short")
        more = self.data[self.at : self.at + 6]
        self.acc = (self.acc & ((1 << self.n) - 1)) << (8 * len(more)) | int.from_bytes(more, "big")
        self.n += 8 * len(more)
        self.at += len(more)

    def block(self, out: list[int], dc: list[int], ac: list[int], before: int) -> int:
        """Coefficients of one block in zigzag order; gives its DC value."""
        k, table_ = 0, dc
        while k < 64:
            if self.n < 32:
                self.fill()
            x = table_[(self.acc >> (self.n - 16)) & 65535]
            if not x:
                raise ValueError("bad code")
            self.n -= x >> 8
            x &= 255
            size, run = (x, 0) if not k else (x & 15, x >> 4)
            if k and not size:
                if run != 15:
                    break
                k += 16
                continue
            k += run
            if k > 63 or size > 15:
                raise ValueError("bad run")
            v = 0
            if size:
                self.n -= size
                v = (self.acc >> self.n) & ((1 << size) - 1)
                if v < 1 << (size - 1):
                    v -= (1 << size) - 1
            if not k:
                v += before
                before, table_ = v, ac
            out[k] = v
            k += 1
        return before


class _Header(NamedTuple):
    """All that precedes the scan of a frame: sizes in blocks, (blocks in a unit, tables) of the components, luma first."""

    at: int
    height: int
    width: int
    down: int  # luma blocks of a unit, down and across
    across: int
    rows: int
    cols: int
    restart: int
    comps: tuple
    scale: np.ndarray


_KNOWN: dict[bytes, _Header] = {}


def _header(data: bytes) -> _Header:
    """Headers are kept by their bytes, as the frames of a film share one."""
    k = data.find(b"\xff\xda")
    head = data[: k + 2 + int.from_bytes(data[k + 2 : k + 4], "big")] if k > 0 else b""
    if head in _KNOWN:
        return _KNOWN[head]
    found = _parse_header(data)
    if len(_KNOWN) > 500:
        _KNOWN.clear()
    _KNOWN[data[: found.at]] = found
    return found


def _parse_header(data: bytes) -> _Header:
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    quant, dc, ac = {}, {0: _DC0, 1: _DC1}, {0: _AC0, 1: _AC1}
    at, frame, restart = 2, None, 0
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 4 > len(data):
            raise ValueError("no scan")
        kind = data[at + 1]
        if kind in (0xFF, 0, 1) or 0xD0 <= kind <= 0xD8:
            at += 1 if kind == 0xFF else 2
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        part, at = data[at + 4 : at + 2 + size], at + 2 + max(size, 2)
        if kind == 0xDB:
            while part:
                wide = 2 if part[0] >> 4 else 1
                q = np.frombuffer(part[1 : 1 + 64 * wide], ">u2" if wide == 2 else "u1").astype(np.float64)
                if len(q) < 64:
                    raise ValueError("bad quantisation table")
                quant[part[0] & 15], part = q, part[1 + 64 * wide :]
        elif kind == 0xC4:
            while len(part) > 16:
                n = sum(part[1:17])
                (ac if part[0] >> 4 else dc)[part[0] & 15] = (part[1:17], part[17 : 17 + n])
                _lookup(part[1:17], part[17 : 17 + n])
                part = part[17 + n :]
        elif kind in (0xC0, 0xC1):
            if len(part) < 6 or part[0] != 8 or len(part) < 6 + 3 * part[5]:
                raise ValueError("not an 8-bit baseline frame")
            h, w = struct.unpack(">HH", part[1:5])
            frame = [(part[6 + 3 * i], part[7 + 3 * i] >> 4, part[7 + 3 * i] & 15, part[8 + 3 * i]) for i in range(part[5])]
            if not h or not w or not frame or any(not a or not b or a > 4 or b > 4 for _, a, b, _ in frame):
                raise ValueError("no size")
        elif kind in (0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise ValueError("not baseline")
        elif kind == 0xDD:
            restart = int.from_bytes(part[:2], "big")
        elif kind == 0xDA:
            break
        elif kind == 0xD9:
            raise ValueError("no scan")
    if frame is None or len(part) < 1 or len(part) < 1 + 2 * part[0] or part[0] != len(frame):
        raise ValueError("scan without all components")
    chosen = {part[1 + 2 * i]: (part[2 + 2 * i] >> 4, part[2 + 2 * i] & 15) for i in range(part[0])}
    hm, vm = max(f[1] for f in frame), max(f[2] for f in frame)
    if len(frame) == 1:  # a lone component isn't interleaved
        frame, hm, vm = [(frame[0][0], 1, 1, frame[0][3])], 1, 1
    try:
        comps = tuple((a * b, dc[chosen[c][0]], ac[chosen[c][1]]) for c, a, b, _ in frame)
        scale = quant[frame[0][3]]
    except KeyError:
        raise ValueError("missing table") from None
    a, b = frame[0][1], frame[0][2]
    return _Header(at, -(-h * b // vm), -(-w * a // hm), b, a, -(-h // (8 * vm)), -(-w // (8 * hm)), restart, comps, scale)


def _intervals(data: bytes, h: _Header) -> list[tuple[bytes, int]]:
    """(bytes without stuffing, units) of the restart intervals of a frame; ValueError if there are too few."""
    body = data[h.at :]
    end = _MARKER.search(body)
    body, total = body[: end.start()] if end else body, h.rows * h.cols
    parts = _RESTART.split(body) if h.restart else [body]
    step = h.restart or total
    if len(parts) < -(-total // step):
        raise ValueError("scan cut short")
    return [(parts[i].replace(b"\xff\x00", b"\xff"), min(step, total - i * step)) for i in range(-(-total // step))]


_MARKER, _RESTART = re.compile(rb"\xff[^\x00\xd0-\xd7]"), re.compile(rb"\xff[\xd0-\xd7]")


def _pixels(blocks: np.ndarray, h: _Header) -> np.ndarray:
    """Luma planes (frames, height, width) out of coefficients (frames * blocks, 64) in zigzag order."""
    y = np.clip(np.rint((blocks * h.scale) @ _INVERSE + 128), 0, 255).astype(np.uint8)
    y = y.reshape(-1, h.rows, h.cols, h.down, h.across, 8, 8).transpose(0, 1, 3, 5, 2, 4, 6)
    return y.reshape(len(y), h.rows * h.down * 8, h.cols * h.across * 8)[:, : h.height, : h.width]


def decode_luma(data: bytes) -> np.ndarray:
    """Luma plane (uint8) of a baseline JPEG; ValueError if it can't be decoded. Symbol by symbol: for few frames."""
    h = _header(data)
    comps = [(n, _lookup(*d), _lookup(*e)) for n, d, e in h.comps]
    luma = []
    for part, units in _intervals(data, h):
        bits, last = _Bits(part), [0] * len(comps)
        for _ in range(units):
            for i, (n, d, e) in enumerate(comps):
                for _ in range(n):
                    out = [0] * 64
                    last[i] = bits.block(out, d, e, last[i])
                    if not i:
                        luma.append(out)
        if 8 * bits.at - bits.n > 8 * len(part):
            raise ValueError("scan cut short")
    return _pixels(np.array(luma, dtype=np.float64), h)[0]


@functools.lru_cache(64)
def _tables(comps: tuple) -> np.ndarray:
    """Look-up tables of all components, DC and AC in turn."""
    return np.array([_lookup(*t) for _, d, e in comps for t in (d, e)], dtype=np.int32)


def decode_alike(frames: list[bytes], h: _Header) -> tuple[np.ndarray, np.ndarray]:
    """(luma planes, whether each could be decoded) of frames of one header: all restart intervals go on side by side."""
    parts, of, units, first = [], [], [], []
    good, per = np.ones(len(frames), dtype=bool), h.down * h.across
    for f, data in enumerate(frames):
        try:
            done = 0
            for part, n in _intervals(data, h):
                parts.append(part + b"\xff" * 8)
                of.append(f)
                units.append(n)
                first.append((f * h.rows * h.cols + done) * per)
                done += n
        except ValueError:
            good[f] = False
    coef = np.zeros((len(frames) * h.rows * h.cols * per, 64), dtype=np.int32)
    if not parts:
        return _pixels(coef, h), good
    size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    begin, buf = np.cumsum(size) - size, np.frombuffer(b"".join(parts) + b"\xff" * 8, np.uint8).astype(np.uint64)
    comp_of = np.repeat(np.arange(len(h.comps)), [n for n, _, _ in h.comps])  # of the blocks of a unit
    wide, table_ = len(comp_of), _tables(h.comps)
    of, units, luma = np.array(of), np.array(units), np.array(first)
    at, end, lane = begin * 8, (begin + size - 8) * 8, np.arange(len(parts))
    k, block, before = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64), np.zeros((len(parts), len(h.comps)), np.int64)
    final = np.zeros(len(parts), dtype=np.int64)
    broken = np.zeros(len(parts), dtype=bool)
    while len(lane):
        byte = np.minimum(at >> 3, len(buf) - 5)
        w = buf[byte] << np.uint64(32) | buf[byte + 1] << np.uint64(24) | buf[byte + 2] << np.uint64(16) | buf[byte + 3] << np.uint64(8) | buf[byte + 4]
        v = (w >> (8 - (at & 7)).astype(np.uint64)).astype(np.int64) & 0xFFFFFFFF
        c = comp_of[block % wide]
        is_dc = k == 0
        x = table_[2 * c + ~is_dc, v >> 16]
        length, x = x >> 8, x & 255
        bits = np.where(is_dc, x, x & 15)
        run = np.where(is_dc, 0, x >> 4)
        bad = (length == 0) | (bits > 15)
        bits = np.minimum(bits, 15)
        value = (v >> (32 - length - bits)) & ((1 << bits) - 1)
        value = np.where((bits > 0) & (value < (1 << bits >> 1)), value - (1 << bits) + 1, value)
        at = at + length + bits
        stop, skip = ~is_dc & (bits == 0) & (run != 15), ~is_dc & (bits == 0) & (run == 15)
        k = k + np.where(skip, 16, run)
        put = ~stop & ~skip
        bad |= put & (k > 63)
        d = np.flatnonzero(is_dc)
        before[d, c[d]] += value[d]
        value[d] = before[d, c[d]]
        s = np.flatnonzero(put & ~bad & (c == 0))
        coef[luma[s] + block[s] // wide * per + block[s] % wide, k[s]] = value[s]
        k = k + put
        done = stop | (k >= 64)
        block, k = block + done, np.where(done, 0, k)
        out = bad | (done & (block >= units * wide)) | (at > end + 64)
        if out.any():
            broken[lane[out]], final[lane[out]] = bad[out], at[out] - end[out]
            on = ~out
            at, end, lane, k, block, units, luma, before = at[on], end[on], lane[on], k[on], block[on], units[on], luma[on], before[on]
    good[of[broken | (final > 0)]] = False
    return _pixels(coef.astype(np.float64), h), good


def _tree(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes, int, int]]:
    """(id, list kind, begin, end) of the chunks in data[at:end], those of lists before the lists' own contents."""
    todo = [(at, end)]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            kind, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            stop, begin = min(at + 8 + size, end), at
            at += 8 + size + (size & 1)
            if kind in (b"RIFF", b"LIST"):
                yield kind, data[begin + 8 : begin + 12], begin + 12, stop
                todo.append((at, end))
                at, end = begin + 12, stop
            else:
                yield kind, b"", begin + 8, stop


def parse_avi(data: bytes) -> tuple[float, list[bytes]]:
    """(frames per second, frame bytes in order) of the first video stream."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI")
    rate, stream, video, movi, idx1, ix, found = 25.0, -1, -1, None, None, [], []
    for kind, sub, a, z in _tree(data, 0, len(data)):
        if kind == b"avih" and z - a >= 4:
            us = int.from_bytes(data[a : a + 4], "little")
            rate = 1e6 / us if us else rate
        elif kind == b"strh":
            stream += 1
            if video < 0 and data[a : a + 4] == b"vids":
                video = stream
                if z - a >= 28:
                    scale, r = struct.unpack("<II", data[a + 20 : a + 28])
                    rate = r / scale if scale and r else rate
        elif kind == b"LIST" and sub == b"movi" and movi is None:
            movi = a - 4
        elif kind == b"idx1":
            idx1 = (a, z)
        elif kind[:2] == b"ix" and kind[2:].isdigit():
            ix.append((kind, a, z))
        elif movi is not None and kind[:2].isdigit() and kind[2:] in (b"dc", b"db"):
            found.append((kind, a, z))
    if video < 0:
        raise ValueError("no video stream")
    wanted = (b"%02ddc" % video, b"%02ddb" % video)
    there = {a: z - a for k, a, z in found if k in wanted}
    short: list[tuple[int, int]] = []
    if idx1:
        raw = data[idx1[0] : idx1[1]]
        rows = [(raw[i : i + 4], *struct.unpack("<II", raw[i + 8 : i + 16])) for i in range(0, len(raw) - 15, 16)]
        rows = [r for r in rows if r[0] in wanted]
        for base in (movi, 0) if movi is not None else ():
            if rows and all(data[base + o : base + o + 4] == k and int.from_bytes(data[base + o + 4 : base + o + 8], "little") == n for k, o, n in rows):
                short = [(base + o + 8, n) for _, o, n in rows]
                break
    entries = short if there.keys() <= {o for o, _ in short} else []
    if not entries:
        parts: list[tuple[int, int]] = []
        for kind, a, z in ix:
            if kind == b"ix%02d" % video and z - a >= 24:
                n, base = int.from_bytes(data[a + 4 : a + 8], "little"), int.from_bytes(data[a + 12 : a + 20], "little")
                part = data[a + 24 : min(z, a + 24 + 8 * n)]
                parts += [(base + o, s & 0x7FFFFFFF) for o, s in struct.iter_unpack("<II", part[: len(part) // 8 * 8])]
        parts = [] if any(o + n > len(data) for o, n in parts) else parts
        if there.keys() | {o for o, _ in short} <= {o for o, _ in parts}:
            entries = parts
        else:
            sound = [(o, n) for o, n in parts if o >= 8 and data[o - 8 : o - 4] in wanted and int.from_bytes(data[o - 4 : o], "little") == n]
            entries = sorted((there | dict(sound) | dict(short)).items())
    if not entries:
        raise ValueError("no frame")
    return rate, [data[o : o + n] for o, n in entries]


def _count(planes: np.ndarray) -> np.ndarray:
    """Normalised luma histogram of each plane."""
    n = planes[0].size
    flat = (planes // (256 // BINS)).reshape(len(planes), -1).astype(np.int64) + np.arange(len(planes))[:, None] * BINS
    return np.bincount(flat.ravel(), minlength=len(planes) * BINS).reshape(-1, BINS) / n


def histograms(frames: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(normalised luma histogram of each frame, whether it was decoded; an empty frame is, as nothing)."""
    out, good, alike = np.zeros((len(frames), BINS)), np.zeros(len(frames), dtype=bool), {}
    for i, f in enumerate(frames):
        try:
            if f:
                alike.setdefault(id(h := _header(f)), (h, []))[1].append(i)
            else:
                good[i] = True
        except (ValueError, IndexError):
            pass
    for h, at in alike.values():
        step = max(1, PIXELS // (64 * h.rows * h.cols * h.down * h.across))
        for a in range(0, len(at), step):
            some = at[a : a + step]
            if len(some) >= SIDE_BY_SIDE:
                planes, ok = decode_alike([frames[i] for i in some], h)
                out[some], good[some] = np.where(ok[:, None], _count(planes), 0), ok
                continue
            for i in some:
                try:
                    out[i], good[i] = _count(decode_luma(frames[i])[None])[0], True
                except (ValueError, IndexError):
                    pass
    return out, good


def shot_starts(h: np.ndarray, floor: float = FLOOR, spread: float = SPREAD, window: int = WINDOW, min_shot: int = MIN_SHOT) -> list[int]:
    """First frames of the shots of a histogram sequence."""
    n = len(h)
    d = np.abs(np.diff(np.cumsum(h, axis=1), axis=0)).sum(axis=1) / BINS
    cuts: list[int] = []
    for t in range(n - 1):
        if d[t] < floor:
            continue
        near = np.delete(d[max(0, t - window) : t + window + 1], min(t, window))
        middle = float(np.median(near)) if len(near) else 0.0
        apart = float(np.median(np.abs(near - middle))) if len(near) else 0.0
        if d[t] <= middle + max(middle, spread * apart):
            continue
        if cuts and t - cuts[-1] < min_shot:
            if d[t] > d[cuts[-1]]:
                cuts[-1] = t
            continue
        cuts.append(t)
    return [0] + [t + 1 for t in cuts]


_CLIPS = "clip int, first_frame int, last_frame int, start_s double, end_s double, n_frames int, bad_frames int, error string"


def clips_of(films: list[bytes | None]) -> list[list[tuple]]:
    """Clip rows of each film; the frames of all are decoded together."""
    parsed: list = []
    for data in films:
        try:
            if not data:
                raise ValueError("no content")
            parsed.append(parse_avi(data))
        except (ValueError, struct.error) as e:
            parsed.append(str(e)[:200])
    h, good = histograms([f for p in parsed if not isinstance(p, str) for f in p[1]])
    out, at = [], 0
    for p in parsed:
        if isinstance(p, str):
            out.append([(None, None, None, None, None, None, None, p)])
            continue
        rate, frames = p
        own, ok = h[at : at + len(frames)], good[at : at + len(frames)]
        at += len(frames)
        for i, f in enumerate(frames):  # empty and bad frames repeat the one before
            if i and (not f or not ok[i]):
                own[i] = own[i - 1]
        starts = shot_starts(own)
        bad = int((~ok).sum())
        out.append([(k, a, z - 1, a / rate, z / rate, z - a, bad, None) for k, (a, z) in enumerate(zip(starts, [*starts[1:], len(frames)]))])
    return out


def _pieces(films: pd.Series) -> Iterator[pd.Series]:
    """Runs of films of about ROOM bytes."""
    held = films.map(lambda x: len(x) if x else 0).cumsum() // ROOM
    for _, part in films.groupby(held, sort=False):
        yield part


def detect_clips(videos: DataFrame, key: str = "vec_id", content: str = "avi") -> DataFrame:
    """key and the clip columns: a row for each shot of each AVI."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _CLIPS.split(", ")]
        for b in batches:
            found = [rows for part in _pieces(b["content"]) for rows in clips_of(part.tolist())]
            out = pd.DataFrame([r for f in found for r in f], columns=names)
            for c in ("clip", "first_frame", "last_frame", "n_frames", "bad_frames"):
                out[c] = out[c].astype("Int32")
            out.insert(0, "key", b["key"].repeat([len(f) for f in found]).to_numpy())
            yield out

    kind = videos.schema[key].dataType.simpleString()
    return videos.select(F.col(key).alias("key"), F.col(content).alias("content")).mapInPandas(run, f"key {kind}, {_CLIPS}").withColumnRenamed("key", key)


@functools.lru_cache(4)
def _codes(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(code, length) by symbol."""
    codes, lengths, code, at = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    for n, c in enumerate(counts, 1):
        for _ in range(c):
            codes[symbols[at]], lengths[symbols[at]], code, at = code, n, code + 1, at + 1
        code <<= 1
    return codes, lengths


def _width(v: np.ndarray) -> np.ndarray:
    """Bits of the absolute values."""
    return np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int64)


def encode_grey(planes: np.ndarray) -> list[bytes]:
    """Baseline grey JPEGs of (frames, height, width) uint8 planes whose sides are multiples of 8, without Huffman tables."""
    n, h, w = planes.shape
    x = planes.reshape(n, h // 8, 8, w // 8, 8).transpose(0, 1, 3, 2, 4).reshape(-1, 64) - 128.0
    c = np.rint(x @ _INVERSE.T / _QUANT[_ZIGZAG]).astype(np.int64).reshape(n, -1, 64)
    each = c.shape[1]
    dc = np.diff(c[:, :, 0], axis=1, prepend=0).reshape(-1)
    c = c.reshape(-1, 64)
    row, k = np.nonzero(c[:, 1:])
    k += 1
    gap = k - np.concatenate([[0], np.where(row[1:] == row[:-1], k[:-1], 0)]) - 1 if len(k) else k
    v = c[row, k]
    last = np.zeros(len(c), np.int64)
    np.maximum.at(last, row, k)
    zero, short = np.repeat(np.arange(len(k)), gap // 16), np.flatnonzero(last < 63)
    # symbols by (block, place): code and value bits in one
    (d0, dn), (a0, an) = _codes(*_DC0), _codes(*_AC0)
    sym = lambda codes, lengths, s, val, size: (codes[s] << size | np.where(val < 0, val + (1 << size) - 1, val), lengths[s] + size)
    runs = [(np.arange(len(c)) * 256, *sym(d0, dn, _width(dc), dc, _width(dc))), (row * 256 + 4 * k - 1, *sym(a0, an, gap % 16 << 4 | _width(v), v, _width(v)))]
    runs += [(row[zero] * 256 + 4 * k[zero] - 2, np.full(len(zero), a0[0xF0]), np.full(len(zero), an[0xF0])), (short * 256 + 255, np.full(len(short), a0[0]), np.full(len(short), an[0]))]
    place, code, bits = (np.concatenate(r) for r in zip(*runs))
    order = np.argsort(place, kind="stable")
    code, bits, frame = code[order], bits[order], place[order] // (256 * each)
    ends = np.cumsum(bits)
    per = np.bincount(frame, bits, n).astype(np.int64)
    size = -(-per // 8)
    begin = np.cumsum(size) - size
    at = ends - bits - (np.cumsum(per) - per)[frame] + begin[frame] * 8
    out = np.zeros(int(size.sum()) + 8, dtype=np.uint8)
    shifted = code << (40 - bits - (at & 7))
    for j in range(5):
        np.add.at(out, (at >> 3) + j, (shifted >> (32 - 8 * j) & 255).astype(np.uint8))
    out[begin + size - 1] |= ((1 << (8 * size - per)) - 1).astype(np.uint8)  # ones to the byte's end
    raw = out.tobytes()
    head = b"\xff\xd8\xff\xdb\x00\x43\x00" + bytes(_QUANT[_ZIGZAG].tolist()) + b"\xff\xc0\x00\x0b\x08" + struct.pack(">HH", h, w) + b"\x01\x01\x11\x00\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00"
    return [head + raw[a : a + m].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for a, m in zip(begin.tolist(), size.tolist())]


def write_avi(frames: list[bytes], width: int, height: int, rate: int = 10, index: bool = True) -> bytes:
    """An AVI with one motion-JPEG stream."""
    chunk = lambda kind, data: kind + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    avih = struct.pack("<14I", 1_000_000 // rate, 0, 0, 16 if index else 0, len(frames), 0, 1, 0, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIiI4H", 0, 0, 0, 0, 1, rate, 0, len(frames), 0, -1, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    movi, idx, at = [], [], 4
    for f in frames:
        movi.append(chunk(b"00dc", f))
        idx.append(b"00dc" + struct.pack("<III", 16, at, len(f)))
        at += len(movi[-1])
    body = b"AVI " + hdrl + chunk(b"LIST", b"movi" + b"".join(movi)) + (chunk(b"idx1", b"".join(idx)) if index else b"")
    return chunk(b"RIFF", body)


SIDE = 16
RATE = 10


def scene_frames(vec_id: int, v: np.ndarray) -> np.ndarray:
    """Frames of the video of one vector: 2 + id mod 3 shots, the j-th of 4 + (7 id + 5 j) mod 5 frames.

    A shot has one brightness, four fields shaded by elements of the vector, and a ripple that moves.
    """
    v = np.clip(np.nan_to_num(v.astype(float)), -1, 1) if len(v) else np.zeros(1)
    j = np.arange(2 + vec_id % 3)
    level = np.where(j % 2 == 0, 70, 170) + (31 * vec_id + 17 * j) % 30
    shade = level[:, None, None] + 20 * v[(4 * j[:, None, None] + _FIELD) % len(v)]
    shots = np.repeat(j, 4 + (7 * vec_id + 5 * j) % 5)
    return np.clip(np.rint(shade[shots] + _RIPPLE[(_SUM + np.arange(len(shots))[:, None, None]) % 8]), 0, 255).astype(np.uint8)


_y, _x = np.mgrid[0:SIDE, 0:SIDE]
_FIELD, _SUM, _RIPPLE = (_y // 8) * 2 + _x // 8, _x + _y, 6 * np.sin(2 * np.pi * np.arange(8) / 8)


def videos_of(vectors: DataFrame) -> DataFrame:
    """(vec_id, avi): the tables hold no films, so each vector is made into a small one with known shots."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for a in range(0, len(b), 500):
                part = b.iloc[a : a + 500]
                scenes = [None if v is None or pd.isna(i) else scene_frames(int(i), np.asarray(v)) for i, v in zip(part["vec_id"], part["embedding"])]
                some = [x for x in scenes if x is not None]
                frames = iter(encode_grey(np.concatenate(some)) if some else [])
                yield pd.DataFrame({"vec_id": part["vec_id"], "avi": [None if x is None else write_avi([next(frames) for _ in x], SIDE, SIDE, RATE) for x in scenes]})

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInPandas(run, "vec_id long, avi binary")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_clips(videos_of(table(spark, sf_dir, "embeddings")))


SQL = """
WITH s AS (SELECT vec_id, unnest(range(0, (2 + vec_id % 3)::BIGINT)) AS j FROM embeddings),
n AS (SELECT vec_id, j, 4 + (7 * vec_id + 5 * j) % 5 AS n FROM s),
c AS (SELECT vec_id, j, n, sum(n) OVER (PARTITION BY vec_id ORDER BY j) AS z FROM n)
SELECT vec_id, j::INTEGER AS clip, (z - n)::INTEGER AS first_frame, (z - 1)::INTEGER AS last_frame, (z - n) / 10.0::DOUBLE AS start_s,
       z / 10.0::DOUBLE AS end_s, n::INTEGER AS n_frames, 0::INTEGER AS bad_frames, NULL::VARCHAR AS error FROM c
"""
