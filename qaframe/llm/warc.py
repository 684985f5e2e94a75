"""WARC records in ZIP packages, read by their directories (operator 9).

Writing: payloads of at least `min_bytes` that are equal are stored once, by the
row with the smallest id (response); the others become revisit records that
refer to it.  Duplicates are found on digests, by partial aggregation.  Every task
streams its records into ZIP packages of bounded size; a package stores (never
compresses) a WARC member and an index member with a line per record.

Reading: a package is opened by its end record, its ZIP64 records if there are
any, and its central directory; the stored index and WARC members are located
through their local headers, and records are range-read in bounded blocks, never
extracted.  Every payload is checked against its digest.

Defined results: a null payload is empty.  Rows with a null id are always
responses.  Repeated rows of the smallest id are all responses.  Payloads are kept
whole, however long.  An empty table gives an empty manifest and no records.  Only
the id, URL and payload columns are read.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaframe.llm.common import shuffle_width, stage, workdir
from qaframe.llm.files import RangeReader, write_file

WARC_MEMBER, INDEX_MEMBER = "archive/data.warc", "indexes/index.jsonl"
DATE = "1970-01-01T00:00:00Z"          # the pages carry no capture time
BROADCAST_REVISITS = 200_000


# ------------------------------------------------------------------ records

def record_id(page: int | None, part: int, n: int) -> str:
    return f"<urn:x-page:{page}>" if page is not None else f"<urn:x-row:{part}-{n}>"


def warc_record(rid: str, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit record whose block has the HTTP head only.
    The head's Content-Length is that of the full payload in both."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {rid}",
            f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {record_id(refers_to, 0, 0)}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(text: bytes) -> dict[str, str]:
    out = {}
    for line in text.split(b"\r\n")[1:]:
        k, _, v = line.decode("utf-8", "surrogatepass").partition(": ")
        out[k.lower()] = v
    return out


def parse_record(data: bytes) -> dict:
    """A whole record: its headers, the payload (None in a revisit) and the full
    payload's size; raises when lengths or digest do not agree."""
    cut = data.index(b"\r\n\r\n")
    head = _headers(data[:cut])
    size = int(head["content-length"])
    block, end = data[cut + 4:cut + 4 + size], data[cut + 4 + size:]
    if len(block) != size or end != b"\r\n\r\n":
        raise ValueError("record length does not agree with its header")
    http_cut = block.index(b"\r\n\r\n")
    full = int(_headers(block[:http_cut])["content-length"])
    payload = block[http_cut + 4:] if head["warc-type"] == "response" else None
    digest = head["warc-payload-digest"].removeprefix("sha256:")
    if payload is not None and (len(payload) != full or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("payload does not agree with its digest")
    return {"type": head["warc-type"], "id": head["warc-record-id"], "url": head.get("warc-target-uri"),
            "digest": digest, "payload": payload, "payload_bytes": full, "refers_to": head.get("warc-refers-to")}


def _page(urn: str | None) -> int | None:
    return int(urn[len("<urn:x-page:"):-1]) if urn and urn.startswith("<urn:x-page:") else None


# ------------------------------------------------------------------ ZIP packages

class ZipPackage:
    """Stored members of a ZIP file, by range reads."""

    def __init__(self, reader: RangeReader):
        self.r = reader
        tail_at = max(0, reader.size - 65_557)          # end record and longest comment
        tail = reader.read(tail_at, reader.size - tail_at)
        at = tail.rfind(b"PK\x05\x06", 0, len(tail) - 18)     # the record has 22 bytes at least
        while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
            at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("no end of central directory")
        n, size, offset = struct.unpack_from("<HII", tail, at + 10)
        if n == 0xFFFF or size == 0xFFFFFFFF or offset == 0xFFFFFFFF:
            locator = reader.read(tail_at + at - 20, 20)
            if locator[:4] != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            end64 = reader.read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if end64[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            n, size, offset = struct.unpack_from("<QQQ", end64, 32)
        self.members: dict[str, tuple[int, int, int]] = {}     # name -> method, size, local header
        directory = reader.read(offset, size)
        at = 0
        for _ in range(n):
            if directory[at:at + 4] != b"PK\x01\x02":
                raise ValueError("bad central directory entry")
            method, = struct.unpack_from("<H", directory, at + 10)
            packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, at + 20)
            local, = struct.unpack_from("<I", directory, at + 42)
            name = directory[at + 46:at + 46 + n_name].decode("utf-8")
            extra = directory[at + 46 + n_name:at + 46 + n_name + n_extra]
            x = 0
            while x + 4 <= len(extra):
                tag, length = struct.unpack_from("<HH", extra, x)
                if tag == 1:                                    # ZIP64: only the fields that overflow
                    y = x + 4
                    if full == 0xFFFFFFFF:
                        full, y = struct.unpack_from("<Q", extra, y)[0], y + 8
                    if packed == 0xFFFFFFFF:
                        packed, y = struct.unpack_from("<Q", extra, y)[0], y + 8
                    if local == 0xFFFFFFFF:
                        local = struct.unpack_from("<Q", extra, y)[0]
                x += 4 + length
            self.members[name] = (method, full, local)
            at += 46 + n_name + n_extra + n_comment

    def locate(self, name: str) -> tuple[int, int]:
        """(offset, size) of a stored member's bytes in the package."""
        method, size, local = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed; only stored members can be range-read")
        head = self.r.read(local, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("bad local header")
        n_name, n_extra = struct.unpack_from("<HH", head, 26)
        return local + 30 + n_name + n_extra, size


class WarcPackage:
    """Records of a package: by index position, or all of them in bounded blocks."""

    def __init__(self, uri: str):
        self.r = RangeReader(uri)
        self.zip = ZipPackage(self.r)
        self.base, self.size = self.zip.locate(WARC_MEMBER)

    def index(self, block: int = 1 << 20) -> Iterator[dict]:
        at, size = self.zip.locate(INDEX_MEMBER)
        held, end = b"", at + size
        while at < end:
            n = min(block, end - at)
            *lines, held = (held + self.r.read(at, n)).split(b"\n")
            at += n
            yield from map(json.loads, lines)

    def record(self, offset: int, length: int) -> dict:
        return parse_record(self.r.read(self.base + offset, length))

    def records(self, block: int = 4 << 20) -> Iterator[dict]:
        """Consecutive index entries share a range read of about `block` bytes."""
        held: list[tuple[int, int]] = []
        for e in self.index():
            if held and (e["offset"] != sum(held[-1]) or e["offset"] + e["length"] - held[0][0] > block):
                yield from self._block(held)
                held = []
            held.append((e["offset"], e["length"]))
        if held:
            yield from self._block(held)

    def _block(self, spans: list[tuple[int, int]]) -> Iterator[dict]:
        first = spans[0][0]
        data = self.r.read(self.base + first, sum(spans[-1]) - first)
        for offset, length in spans:
            yield parse_record(data[offset - first:offset - first + length])

    def close(self) -> None:
        self.r.close()


class PackageWriter:
    """Streams records into a package; index lines are held until it is closed."""

    def __init__(self, out):
        self.zip = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(zipfile.ZipInfo(WARC_MEMBER), "w", force_zip64=True)
        self.lines: list[bytes] = []
        self.at = 0

    def add(self, record: bytes, entry: dict) -> None:
        self.member.write(record)
        self.lines.append(json.dumps(entry | {"offset": self.at, "length": len(record)}).encode() + b"\n")
        self.at += len(record)

    def close(self) -> None:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX_MEMBER), b"".join(self.lines))
        self.zip.close()


# ------------------------------------------------------------------ Spark jobs

MANIFEST = "path string, n_records long, n_bytes long"


def _writer(folder: str, package_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, piece, n = TaskContext.get().partitionId(), 0, 0
        held = buffer = None
        done: list[dict] = []

        def close() -> None:
            nonlocal held, buffer, piece
            records = len(held.lines)
            held.close()
            path = f"{folder}/package-{part:06d}-{piece:04d}.wacz"
            done.append({"path": path, "n_records": records, "n_bytes": write_file(path, [buffer.getbuffer()])})
            held, buffer, piece = None, None, piece + 1

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                for page, url, html, refers_to in zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns)):
                    payload = (html or "").encode("utf-8", "surrogatepass")
                    digest = hashlib.sha256(payload).hexdigest()
                    if held is None:
                        buffer = io.BytesIO()
                        held = PackageWriter(buffer)
                    rid = record_id(page, part, n)
                    n += 1
                    held.add(warc_record(rid, url, payload, digest, refers_to),
                             {"id": rid, "digest": digest, "type": "response" if refers_to is None else "revisit"})
                    if held.at >= package_bytes:
                        close()
        if held is not None:
            close()
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema(
            [("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))
    return run


def revisits(pages: DataFrame, min_bytes: int, id_col: str, payload_col: str, path: str) -> DataFrame:
    """(id, digest, refers_to) of rows whose payload an earlier id stores."""
    body = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    digests = stage(pages.select(F.col(id_col).cast("long").alias("id"), F.octet_length(body).alias("n"),
                                 F.sha2(body, 256).alias("digest"))
                    .where(F.col("id").isNotNull() & (F.col("n") >= min_bytes)).drop("n"), f"{path}/digests")
    firsts = digests.groupBy("digest").agg(F.min("id").alias("refers_to"), F.max("id").alias("last")).where("refers_to <> last")
    return digests.join(firsts.drop("last"), "digest").where("id <> refers_to").distinct()


def write_packages(pages: DataFrame, folder: str | None = None, min_bytes: int = 100, package_bytes: int = 16 << 20,
                   id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write all rows as records; returns the manifest (path, n_records, n_bytes)."""
    spark = pages.sparkSession
    folder = folder or workdir(spark, "warc")
    again = stage(revisits(pages, min_bytes, id_col, payload_col, folder), f"{folder}/revisits")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"),
                        F.col(payload_col).alias("html"))
    digest = F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)
    # revisit rows are narrow; payloads move only when there are too many of them to broadcast
    if again.count() <= BROADCAST_REVISITS:
        again = F.broadcast(again)
    marked = rows.withColumn("digest", digest).join(again, ["id", "digest"], "left")
    written = marked.select("id", "url", "html", "refers_to").mapInArrow(_writer(folder, package_bytes), MANIFEST)
    return stage(written, f"{folder}/manifest")


RECORD = ("id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, "
          "refers_to long")


def _reader(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
        names = ["id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                package = WarcPackage(path)
                rows, size = [], 0
                for r in package.records():
                    rows.append((_page(r["id"]), r["url"], r["type"], r["payload"] if payloads else None,
                                 r["payload_bytes"], r["digest"], _page(r["refers_to"])))
                    size += len(r["payload"] or b"") + 200
                    if size >= 4 << 20:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)
                package.close()
    return run


def read_packages(manifest: DataFrame, payloads: bool = True, id_col: str = "page_id") -> DataFrame:
    """All records of the packages, a row each."""
    spark = manifest.sparkSession
    files = manifest.select("path").repartition(shuffle_width(spark), "path")
    return files.mapInArrow(_reader(payloads), RECORD).withColumnRenamed("id", id_col)
