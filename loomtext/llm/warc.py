"""WARC archives: one gzip member for each record, written, and read sequentially.

An archive is a run of gzip members, the first a warcinfo record.  The reader feeds bytes to an incremental
zlib decompressor, takes a member's end from it, frames the record by its Content-Length and verifies the
digests of the block and of the payload (SHA-1, SHA-2 or MD5, in hex or base32).  Archives are rows (archive,
content), of ``archive_bytes`` or little more, so that they can be written wherever Spark writes; ``read_files``
reads the files of others as streams, whatever their size.

A record that is broken in any way (a member that is cut off or does not unpack, no header, no length, another
length or digest than told) is a row that is not ``valid``, never a failed job; reading goes on at the next member.

Of records with equal payloads of ``least`` bytes or more, that with the smallest id is a response, the others
are revisits that refer to it and hold only the HTTP headers.  The headers tell the full payload's length.

Nulls: a null payload is empty; a null URL has no WARC-Target-URI; a record with a null id is a response.
Rows that repeat the smallest id are responses all.  Empty input: no archives, no records.  Extra columns
are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import opened, opens
from .scratch import Scratch

RECORD = "id long, record_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, refers_to_id string, payload binary, valid boolean"
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.bool_()]
BROKEN = (None,) * 9 + (False,)
_MAGIC = b"\x1f\x8b\x08"
_BLANK = re.compile(rb"\r?\n\r?\n")
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x1f\x7f]")


def _urn(i: int | None) -> str:
    return f"<urn:loomtext:record:{'' if i is None else i}>"


def member(kind: str, headers: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """One record as one gzip member."""
    head = [("WARC-Type", kind), ("WARC-Date", DATE), *headers, ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()), ("Content-Length", str(len(block)))]
    raw = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw.encode() + block + b"\r\n\r\n") + z.flush()


def page_member(i: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    head = [("WARC-Record-ID", _urn(i)), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", "sha256:" + digest)]
    if url is not None:
        head.insert(1, ("WARC-Target-URI", _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        return member("response", head, http + payload)
    return member("revisit", [*head, ("WARC-Refers-To", _urn(refers_to)), ("WARC-Profile", _PROFILE)], http)


def members(chunks: Iterable[bytes]) -> Iterator[bytes | None]:
    """The content of each gzip member of a byte stream, whatever its division in chunks; None for what is broken or cut off."""
    z, out, raw, seek, left = None, [], [], False, b""
    for data in chunks:
        while data:
            if z is None:
                if seek:
                    data = left + data
                    at = data.find(_MAGIC)
                    if at < 0:
                        left = data[-2:]
                        break
                    data, left, seek = data[at:], b"", False
                elif not (data := data.lstrip(b"\0")):
                    break
                z, out, raw = zlib.decompressobj(31), [], []
            raw.append(data)
            try:
                out.append(z.decompress(data))
            except zlib.error:
                yield None
                z, seek, data = None, True, b"".join(raw)[1:]
                continue
            data = b""
            if z.eof:
                yield b"".join(out)
                data, z = z.unused_data, None
    if z is not None:
        yield None


def _head(raw: bytes, at: int) -> tuple[str, dict[str, str], int] | None:
    """First line, headers by lower-case name (continued lines joined), and where what follows begins; None without an end."""
    end = _BLANK.search(raw, at)
    if end is None:
        return None
    first, *lines = re.sub(r"\r?\n[ \t]+", " ", raw[at : end.start()].decode("utf-8", "replace")).splitlines() or [""]
    pairs = (line.partition(":") for line in lines)
    return first, {k.strip().lower(): v.strip() for k, _, v in pairs}, end.end()


def _id(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:loomtext:record:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"[0-9]{1,18}", text) else None


def _digest(told: str | None) -> tuple[str, bytes] | None:
    """Algorithm and value of a digest as told; None if there is none or it cannot be understood."""
    name, _, value = (told or "").partition(":")
    name, value = name.strip().lower().replace("-", ""), value.strip()
    if name not in ("sha1", "sha256", "sha384", "sha512", "md5"):
        return None
    size = hashlib.new(name).digest_size
    try:
        got = bytes.fromhex(value) if len(value) == 2 * size else base64.b32decode(value.rstrip("=").upper() + "=" * (-len(value.rstrip("=")) % 8))
    except ValueError:
        return name, b""
    return name, got


def _agrees(told: str | None, data: bytes) -> bool:
    d = _digest(told)
    return d is None or hashlib.new(d[0], data).digest() == d[1]


def record(raw: bytes, at: int = 0) -> tuple[tuple | None, int]:
    """The record that begins at ``at``, as a row (None for types other than response and revisit), and where the next begins."""
    head = _head(raw, at)
    if head is None or not head[0].startswith("WARC/"):
        return BROKEN, len(raw)
    _, head, start = head
    size = _number(head.get("content-length"))
    end = len(raw) if size is None else start + size
    block = raw[start:end]
    valid = size is not None and len(block) == size and raw[end : end + 4] == b"\r\n\r\n" and _agrees(head.get("warc-block-digest"), block)
    after = min(end + 4, len(raw)) if size is not None else len(raw)
    kind = head.get("warc-type", "").lower()
    if kind not in ("response", "revisit"):
        return (None if kind else BROKEN), after
    told, name, url = head.get("warc-payload-digest"), head.get("warc-record-id"), head.get("warc-target-uri")
    http = _head(block, 0) if block.startswith(b"HTTP/") else None
    if kind == "revisit":
        d = _digest(told)
        digest = None if d is None else d[1].hex() if d[0] == "sha256" else f"{d[0]}:{d[1].hex()}"
        refers = head.get("warc-refers-to")
        return (_id(name), name, url, _number(http[1].get("content-length")) if http else None, digest, kind, _id(refers), refers, None, valid), after
    # A block that is no HTTP message, such as a DNS answer, is its own payload; one that ends in its headers has none.
    payload = block[http[2] :] if http else b"" if block.startswith(b"HTTP/") else block
    return (_id(name), name, url, len(payload), hashlib.sha256(payload).hexdigest(), kind, None, None, payload, valid and _agrees(told, payload)), after


def records(chunks: Iterable[bytes]) -> Iterator[tuple]:
    """The rows of an archive given in chunks."""
    for raw in members(chunks):
        if raw is None:
            yield BROKEN
            continue
        at = 0
        while at < len(raw):
            row, at = record(raw, at)
            if row is not None:
                yield row


def _write(archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, n = [], 0, 0

        def close() -> pa.RecordBatch:
            name = f"part-{TaskContext.get().partitionId():05d}-{n:05d}.warc.gz"
            info = member("warcinfo", [("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([info + b"".join(out)], pa.binary())], names=["archive", "content"])

        for batch in batches:
            for i, url, html, digest, refers in zip(*batch.columns, strict=True):
                out.append(page_member(i.as_py(), url.as_py(), (html.as_py() or "").encode(), digest.as_py(), refers.as_py()))
                size += len(out[-1])
                if size >= archive_bytes:
                    yield close()
                    out, size, n = [], 0, n + 1
        if out:
            yield close()

    return run


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100, archive_bytes: int = 1 << 22) -> DataFrame:
    """(archive, content): all rows of ``pages`` as records."""
    scratch = Scratch(pages.sparkSession, "warc")
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("html"), F.sha2(payload, 256).alias("digest"))
    large = rows.filter((F.octet_length("html") >= least) & F.col("id").isNotNull()).select("id", "digest")
    firsts = large.groupBy("digest").agg(F.min("id").alias("refers_to"), F.max("id").alias("last")).filter("refers_to < last").select("digest", "refers_to")
    # Only the revisits meet the pages again: a table of ids, none of payloads.
    revisits = scratch.keep(large.join(firsts, "digest").filter("id > refers_to").distinct().select("id", "digest", "refers_to"))
    return rows.join(revisits, ["id", "digest"], "left").select("id", "url", "html", "digest", "refers_to").mapInArrow(_write(archive_bytes), "archive string, content binary")


def _batches(archives: Iterable[Iterable[bytes]]) -> Iterator[pa.RecordBatch]:
    """The rows of archives, a few MB at a time."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    rows, size = [], 0

    def closed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=names)

    for chunks in archives:
        for row in records(chunks):
            rows.append(row)
            size += 256 + len(row[8] or b"")
            if size > 1 << 22:
                yield closed()
                rows, size = [], 0
    if rows:
        yield closed()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def cut(content: pa.Scalar) -> Iterator[bytes]:
        data = memoryview(content.as_buffer())
        return (data[i : i + 65536].tobytes() for i in range(0, len(data), 65536))

    yield from _batches(cut(x) for batch in batches for x in batch.column("content") if x.is_valid)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of .warc.gz files, each read as a stream by one task. Spark lists them; a store that Arrow cannot open is read in whole files, of 2 GB at most."""
    files = spark.read.format("binaryFile").load(path)
    if not opens(files):
        return read_archives(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream(uri: str) -> Iterator[bytes]:
            with opened(uri) as f:
                while data := f.read(1 << 20):
                    yield data

        yield from _batches(stream(x.as_py()) for batch in batches for x in batch.column("path"))

    return files.select("path").mapInArrow(run, RECORD)


def read_archives(archives: DataFrame) -> DataFrame:
    """Responses and revisits in archives: id (of our own records), record_id, url, payload_bytes, payload_digest (of a revisit as told,
    with its algorithm unless SHA-256), record_type, refers_to, refers_to_id, payload (null for revisits), valid. A null content holds none."""
    return archives.select("content").mapInArrow(_read, RECORD)


def round_trip(pages: DataFrame, **how) -> DataFrame:
    """The records of ``pages``, read back from written archives."""
    return read_archives(Scratch(pages.sparkSession, "archives").finish(write_archives(pages, **how)))
