"""WARC: a sequential reader, and the writer that its round trip needs.

A file is a run of gzip members with one record or more in each (plain, uncompressed records are read too). The reader takes the
stream in small pieces, inflates incrementally, parses a record's headers as soon as they are there, takes exactly
Content-Length bytes as its block, and checks the block digest and, for HTTP messages, the payload digest (sha1, sha256 or
md5, in base32 or hex). It never holds more than one record and never seeks, so files of any size and object stores work.

Damage: a member that can't be inflated, a record cut short, headers without an end within HEADERS bytes and a bad length give
one row with ``error`` and whatever headers were read. Reading goes on at the next gzip magic or line that begins with
``WARC/``, from the byte after the one where the bad record began: raw bytes are kept only from a magic within the member at
hand on. So each undamaged record comes out, also those that a wrong length or a damaged member would swallow. Bytes
that are no record give one row with ``error``, however long they are.

Defined cases: a digest that is missing or of an unknown kind gives null, a wrong one false; a block with a wrong digest that
isn't followed by a line break has a wrong length; records that share a member have its offset; records of any length are
taken whole; an empty file gives no row; header names match in any case, the first of repeated ones counts; null content gives
no row, an empty table none; repeated files are read again; columns other than name and content are not read. In writing, null
html is marked as truncated and comes back as null, empty html comes back as empty; line breaks in a url are percent-encoded;
a null url has no header and comes back as null; repeated rows are repeated records.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import shared_folder
from .common import materialize, parallelism, table

PIECE = 1 << 16
BLOB = 4 << 20
LEVEL = 5
SCHEMA = "file string, offset long, warc_type string, record_id string, target_uri string, date string, content_type string, content_length long, truncated string, http_status int, payload binary, block_digest_ok boolean, payload_digest_ok boolean, error string"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
HEADERS = 1 << 20
_MAGIC = b"\x1f\x8b\x08"
_SYNC = re.compile(rb"\x1f\x8b\x08|(?<![^\n])WARC/")
_LINE = re.compile(rb"\nWARC/")


class _Stream:
    """Raw bytes in pieces, with a place to give bytes back to; ``offset`` is that of the next byte."""

    def __init__(self, raw):
        self.raw, self.held, self.offset = raw, b"", 0

    def read(self) -> bytes:
        out, self.held = self.held or self.raw.read(PIECE), b""
        self.offset += len(out)
        return out

    def back(self, data: bytes) -> None:
        if data:
            self.held = data + self.held
            self.offset -= len(data)

    def peek(self, n: int) -> bytes:
        while len(self.held) < n and (more := self.raw.read(PIECE)):
            self.held += more
        return self.held[:n]

    def resync(self) -> None:
        """On to the next place where a record may begin, the byte at hand included."""
        tail = b""
        while new := self.read():
            data = tail + new
            found = _SYNC.search(data, 1 if tail else 0)
            if found:
                self.back(data[found.start() :])
                return
            tail = data[-7:]


class _Plain:
    """The stream itself as the bytes of records; ``taken`` are those of the record at hand."""

    def __init__(self, stream: _Stream):
        self.stream, self.buffer, self.taken, self.ended = stream, b"", [], False

    def more(self) -> bool:
        data = b"" if self.ended else self.stream.read()
        self.ended |= not data
        self.buffer += data
        return bool(data)

    def until(self, mark: bytes, most: int) -> bytes:
        at = 0
        while (found := self.buffer.find(mark, at)) < 0:
            at = max(0, len(self.buffer) - len(mark))
            if len(self.buffer) > most or not self.more():
                raise ValueError("no end of headers")
        return self.exactly(found + len(mark))

    def exactly(self, n: int) -> bytes:
        parts, have = [self.buffer[:n]], min(n, len(self.buffer))
        self.buffer = self.buffer[n:]
        while have < n:
            if not self.more():
                self.taken += parts
                raise ValueError(f"block has {have} of {n} bytes")
            parts.append(self.buffer[: n - have])
            have += len(parts[-1])
            self.buffer = self.buffer[len(parts[-1]) :]
        self.taken += parts
        return b"".join(parts)

    def ahead(self, n: int) -> bytes:
        while len(self.buffer) < n and self.more():
            pass
        return self.buffer[:n]

    def strip_breaks(self) -> None:
        while True:
            self.buffer = self.buffer.lstrip(b"\r\n")
            if self.buffer or not self.more():
                return

    def next(self) -> bool:
        """Behind a record: the rest goes back to the stream."""
        self.taken = []
        self.stream.back(self.buffer)
        return False

    def recover(self) -> bool:
        """Behind damage: on from the second byte of the record."""
        self.stream.back(self.buffer)
        self.stream.back(b"".join(self.taken)[1:])
        if not self.taken:
            self.stream.back(self.stream.read()[1:])
        self.stream.resync()
        return False


class _Member(_Plain):
    """The inflated bytes of one gzip member."""

    def __init__(self, stream: _Stream):
        super().__init__(stream)
        self.z, self.tail, self.kept = zlib.decompressobj(31), b"", b""

    def more(self) -> bool:
        if self.ended:
            return False
        data = self.stream.read()
        if not data:
            self.ended = True
            raise zlib.error("gzip member cut short")
        if self.kept:
            self.kept += data
        else:
            seen = self.tail + data
            found = _SYNC.search(seen, 1)
            self.kept = seen[found.start() :] if found else b""
            self.tail = (seen if self.tail else seen[1:])[-7:]
        self.buffer += self.z.decompress(data)
        if self.z.eof:
            self.ended, self.kept = True, b""
            self.stream.back(self.z.unused_data)
        return True

    def next(self) -> bool:
        """Behind a record: whether more than line breaks follow in the member."""
        self.taken = []
        self.strip_breaks()
        return bool(self.buffer)

    def recover(self) -> bool:
        """Behind a bad record: whether the member has a line with which another one may begin."""
        self.buffer, self.taken = (b"".join(self.taken) + self.buffer)[1:], []
        while True:
            found = _LINE.search(self.buffer)
            if found:
                self.buffer = self.buffer[found.end() - 5 :]
                return True
            self.buffer = self.buffer[-6:]
            if not self.more():
                return False

    def abandon(self) -> None:
        """Behind bytes that can't be inflated: on from the next magic within the member, or behind it."""
        self.stream.back(self.kept or self.tail)
        self.stream.resync()


def digest_matches(digest: str | None, data: bytes) -> bool | None:
    if not digest or ":" not in digest:
        return None
    kind, _, value = digest.partition(":")
    kind = kind.strip().lower().replace("-", "")
    if kind not in ("sha1", "sha256", "md5"):
        return None
    own, value = hashlib.new(kind, data).digest(), value.strip()
    return value.lower() == own.hex() or value.upper().rstrip("=") == base64.b32encode(own).decode().rstrip("=")


def _headers(raw: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = raw.decode("utf-8", "replace").split("\r\n")
    out: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            k, _, v = line.partition(":")
            last = k.strip().lower()
            out.setdefault(last, v.strip())
    return first, out


def _record(m: _Plain, row: dict) -> None:
    """Fills in the row of the record that m is at."""
    m.strip_breaks()
    if m.ahead(5) != b"WARC/":
        raise ValueError("not a WARC record")
    _, h = _headers(m.until(b"\r\n\r\n", HEADERS))
    row |= {"warc_type": h.get("warc-type"), "record_id": h.get("warc-record-id"), "target_uri": h.get("warc-target-uri"), "date": h.get("warc-date"), "content_type": h.get("content-type"), "truncated": h.get("warc-truncated")}
    length = h.get("content-length", "")
    if not (length.isascii() and length.isdigit() and len(length) < 19):
        raise ValueError("bad Content-Length")
    row["content_length"] = int(length)
    block = m.exactly(int(length))
    row["block_digest_ok"] = digest_matches(h.get("warc-block-digest"), block)
    if row["block_digest_ok"] is False and m.ahead(1)[:1] not in (b"\r", b"\n", b""):
        raise ValueError("Content-Length and digest are wrong")
    payload = block
    if (row["content_type"] or "").startswith("application/http"):
        http, sep, body = block.partition(b"\r\n\r\n")
        if sep:
            status = http.split(b"\r\n", 1)[0].split()
            row["http_status"] = int(status[1]) if len(status) > 1 and status[0].startswith(b"HTTP/") and re.fullmatch(rb"[0-9]{1,9}", status[1]) else None
            payload = body
    row["payload_digest_ok"] = digest_matches(h.get("warc-payload-digest"), payload)
    row["payload"] = None if row["truncated"] and not block else payload


def read_records(raw, file: str = "") -> Iterator[dict]:
    """Rows of SCHEMA out of a binary stream with ``read(n)``."""
    stream, lost = _Stream(raw), False
    while start := stream.peek(3):
        if start[:1] in b"\r\n":
            stream.back(stream.read().lstrip(b"\r\n"))
            continue
        at, more = stream.offset, True
        m = _Member(stream) if start[:2] == _MAGIC[:2] else _Plain(stream)
        while more:
            row = dict.fromkeys(_NAMES) | {"file": file, "offset": at}
            try:
                _record(m, row)
                lost = False
                yield row
                more = m.next()
            except (ValueError, zlib.error) as e:
                if not lost or row["record_id"] or row["warc_type"]:
                    yield row | {"error": str(e)[:200], "payload": None}
                lost = True
                if isinstance(e, ValueError):
                    try:
                        more = m.recover()
                        continue
                    except zlib.error:
                        pass
                m.abandon()
                more = False


def _batched(rows: Iterator[dict]) -> Iterator[pd.DataFrame]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r["payload"] or b"") + 500
        if size > BLOB:
            yield _frame(held)
            held, size = [], 0
    if held:
        yield _frame(held)


def _frame(rows: list[dict]) -> pd.DataFrame:
    f = pd.DataFrame(rows, columns=_NAMES).astype({"content_length": "Int64", "http_status": "Int32"})
    return f.astype({"block_digest_ok": "boolean", "payload_digest_ok": "boolean"})


def read_warc(files: DataFrame, content: str = "content", name: str = "name") -> DataFrame:
    """Records of WARC files given as rows (name, content), as ``binaryFile`` or ``write_warc`` make them."""

    def run(batches):
        for b in batches:
            for f, data in zip(b["f"], b["c"]):
                if data is not None:
                    yield from _batched(read_records(io.BytesIO(data), f))

    return files.select(F.col(name).alias("f"), F.col(content).alias("c")).mapInPandas(run, SCHEMA)


def read_warc_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Records of WARC files given by path or URI, each streamed by one task and never held whole; null paths give nothing."""

    def run(batches):
        for b in batches:
            for p in b["path"]:
                if p is not None:
                    fs, at = pafs.FileSystem.from_uri(p if "://" in p else "file://" + p)
                    with fs.open_input_stream(at, compression=None) as s:
                        yield from _batched(read_records(s, p))

    return files.select(F.col(path).alias("path")).repartition(parallelism(files.sparkSession)).mapInPandas(run, SCHEMA)


def record(page_id, url: str | None, html: str | None, level: int = LEVEL) -> bytes:
    """One response record as a gzip member."""
    body = b"" if html is None else html.encode("utf-8", "replace")
    block = b"" if html is None else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    sha = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    lines = ["WARC/1.1", "WARC-Type: response", f"WARC-Record-ID: <urn:page:{'' if page_id is None else int(page_id)}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if html is None:
        lines.append("WARC-Truncated: unspecified")
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Block-Digest: {sha(block)}", f"WARC-Payload-Digest: {sha(body)}", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def write_warc(pages: DataFrame) -> DataFrame:
    """(name, content): WARC files of about BLOB bytes out of page_id, url and html."""

    def run(batches):
        k = 0
        for b in batches:
            held, size = [], 0
            for p, u, h in zip(b["page_id"], b["url"], b["html"]):
                held.append(record(None if pd.isna(p) else p, u, h))
                size += len(held[-1])
                if size > BLOB:
                    yield pd.DataFrame({"name": [f"part-{k}.warc.gz"], "content": [b"".join(held)]})
                    held, size, k = [], 0, k + 1
            if held:
                yield pd.DataFrame({"name": [f"part-{k}.warc.gz"], "content": [b"".join(held)]})
                k += 1

    return pages.select("page_id", "url", "html").mapInPandas(run, "name string, content binary")


def write_warc_files(pages: DataFrame, folder: str) -> DataFrame:
    """(path): WARC files in a folder; a file for every row of write_warc. Paths of tasks that failed aren't among the rows."""

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
        fs.create_dir(base, recursive=True)
        for b in batches:
            for content in b["content"]:
                name = f"{uuid.uuid4().hex}.warc.gz"
                with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
                    out.write(content)
                yield pd.DataFrame({"path": [f"{folder}/{name}"]})

    return materialize(write_warc(pages).mapInPandas(run, "path string"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through WARC files in the shared folder and back."""
    r = read_warc_files(write_warc_files(table(spark, sf_dir, "pages"), shared_folder(spark)))
    return r.select(F.regexp_extract("record_id", r"urn:page:(\d+)", 1).try_cast("long").alias("page_id"), F.col("target_uri").alias("url"), F.decode("payload", "UTF-8").alias("html"), "http_status", "block_digest_ok", "payload_digest_ok")


SQL = "SELECT page_id, url, html, 200::INTEGER AS http_status, TRUE AS block_digest_ok, TRUE AS payload_digest_ok FROM pages"
