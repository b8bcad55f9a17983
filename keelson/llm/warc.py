"""Web archives in ZIP packages: written by partition, read back by range without extraction.

Writing: rows become WARC/1.1 records, each its own gzip member, gathered in stored ZIP members
archive/data-N.warc.gz; indexes/index.cdxj holds the page, member, offset and length of every record. Of records with
equal payloads the one with the largest page_id is the response, the others revisit it. The groups are
found by a partial aggregation on digests and a hash join that adaptive execution can split, so
a payload that a third of all pages share is no single task's.

Reading: the end record, the ZIP64 locator and record where needed, and the central directory are parsed from the
package's tail; local headers give where stored members begin; each record is one range read that the
index names. Nothing is unpacked to disk.

Files go to the shared folder through pyarrow's file systems, under names of their own for each attempt; only
packages named in the manifest of finished tasks are read.

Edge cases: null html is an empty payload; rows with null page_id are responses, without an identifier that
others could refer to; repeated page_ids with equal payloads are all responses; very long payloads are members of their own size, past
4 GB by ZIP64; further columns are left out; an empty table writes no package.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import fresh_path, materialize

MEMBER_BYTES = 8_000_000
PACKAGE_BYTES = 256_000_000
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class ZipWriter:
    """A ZIP package of stored members on a forward-only stream; ZIP64 fields where sizes, offsets or counts need them."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.at, self.entries, self.zip64 = out, 0, [], zip64

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> int:
        """Writes a stored member; returns the offset of its data."""
        raw, crc, big = name.encode(), zlib.crc32(data), self.zip64 or len(data) >= 0xFFFFFFFF
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if big else b""
        size = 0xFFFFFFFF if big else len(data)
        self.entries.append((raw, crc, len(data), self.at))
        self._write(struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45 if big else 20, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra)) + raw + extra)
        start = self.at
        self._write(data)
        return start

    def close(self) -> None:
        start = self.at
        for raw, crc, size, offset in self.entries:
            big = self.zip64 or size >= 0xFFFFFFFF or offset >= 0xFFFFFFFF
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset) if big else b""
            s, o = (0xFFFFFFFF, 0xFFFFFFFF) if big else (size, offset)
            self._write(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45 if big else 20, 45 if big else 20, 0x800, 0, 0, 33, crc, s, s, len(raw), len(extra), 0, 0, 0, 0, o) + raw + extra)
        size, n = self.at - start, len(self.entries)
        if self.zip64 or n >= 0xFFFF or size >= 0xFFFFFFFF or start >= 0xFFFFFFFF:
            end = self.at
            self._write(struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, size, start))
            self._write(struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1))
            n, size, start = 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF
        self._write(struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, n, n, size, start, 0))
        self.out.close()


def directory(file, length: int) -> dict[str, tuple[int, int, int]]:
    """Members of a package by name: (local header offset, size, method), from its central directory."""
    tail_at = max(0, length - 65_557)
    tail = file.read_at(length - tail_at, tail_at)
    i = tail.rfind(b"PK\x05\x06")
    while i >= 0 and i + 22 + struct.unpack_from("<H", tail, i + 20)[0] != len(tail):
        i = tail.rfind(b"PK\x05\x06", 0, i)
    if i < 0:
        raise ValueError("no end of central directory: not a ZIP package")
    n, size, start = struct.unpack_from("<HII", tail, i + 10)
    if n == 0xFFFF or size == 0xFFFFFFFF or start == 0xFFFFFFFF:
        where = tail_at + i - 20
        magic, _, at, _ = struct.unpack("<4sIQI", file.read_at(20, where)) if where >= 0 else (b"", 0, 0, 0)
        if magic == b"PK\x06\x07":
            head = struct.unpack("<4sQHHIIQQQQ", file.read_at(56, at))
            if head[0] != b"PK\x06\x06":
                raise ValueError("damaged ZIP64 end record")
            n, size, start = head[7], head[8], head[9]
    data, at, out = file.read_at(size, start), 0, {}
    for _ in range(n):
        if data[at : at + 4] != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        method, packed, plain = struct.unpack_from("<H", data, at + 10)[0], *struct.unpack_from("<II", data, at + 20)
        k, m, c = struct.unpack_from("<HHH", data, at + 28)
        offset = struct.unpack_from("<I", data, at + 42)[0]
        name, extra = data[at + 46 : at + 46 + k].decode(), data[at + 46 + k : at + 46 + k + m]
        e = 0
        while e + 4 <= len(extra):
            tag, width = struct.unpack_from("<HH", extra, e)
            if tag == 1:
                fields = iter(struct.unpack_from(f"<{width // 8}Q", extra, e + 4))
                plain = next(fields) if plain == 0xFFFFFFFF else plain
                packed = next(fields) if packed == 0xFFFFFFFF else packed
                offset = next(fields) if offset == 0xFFFFFFFF else offset
            e += 4 + width
        out[name] = (offset, packed, method)
        at += 46 + k + m + c
    return out


def data_offset(file, offset: int) -> int:
    """Where a stored member's bytes begin, from its local header."""
    head = file.read_at(30, offset)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no local header where the directory points")
    k, m = struct.unpack_from("<HH", head, 26)
    return offset + 30 + k + m


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers: int | None) -> bytes:
    """A WARC record as a gzip member; a revisit keeps the HTTP head and leaves out the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers is None else b"")
    name = f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {name}", f"WARC-Target-URI: {(url or 'urn:none').replace(chr(13), '').replace(chr(10), '')}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def parse_record(data: bytes) -> dict:
    """Headers and block of one record; checks its length and, for responses, its digest."""
    plain = gzip.decompress(data)
    cut = plain.index(b"\r\n\r\n")
    lines = plain[:cut].decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC record")
    head = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
    block = plain[cut + 4 : cut + 4 + int(head["content-length"])]
    end = block.index(b"\r\n\r\n")
    http = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in block[:end].decode().split("\r\n")[1:])}
    payload, digest = block[end + 4 :], head["warc-payload-digest"].removeprefix("sha1:")
    refers = head.get("warc-refers-to")
    if head["warc-type"] == "response" and (base32_sha1(payload) != digest or len(payload) != int(http["content-length"])):
        raise ValueError("payload does not match its digest")
    of = lambda x: int(x[len("<urn:page:") : -1]) if x and x.startswith("<urn:page:") else None
    return {"page_id": of(head["warc-record-id"]), "url": head["warc-target-uri"], "payload_bytes": int(http["content-length"]), "payload_digest": digest, "record_type": head["warc-type"], "refers_to": of(refers), "payload": payload}


def write_packages(pages: DataFrame, path: str, least_bytes: int = 0, zip64: bool = False) -> DataFrame:
    """Writes pages (page_id, url, html) as packages under path; returns their manifest: package, n_records, n_bytes."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.unhex(F.sha1("html")))
    shared = pages.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    rows = pages.join(shared.hint("shuffle_hash"), "digest", "left")
    rows = rows.select("page_id", "url", "html", F.when((F.col("first") != F.col("page_id")) & (F.octet_length("html") >= least_bytes), F.col("first")).alias("refers"))
    schema = pa.schema([("package", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(path)
        fs.create_dir(root, recursive=True)
        made = []
        zipped, name = None, ""
        buffer, index, waiting, size, n = [], [], [], 0, 0

        def flush() -> None:
            nonlocal buffer, waiting, size
            if buffer:
                member = f"archive/data-{len(zipped.entries):05d}.warc.gz"
                zipped.add(member, b"".join(buffer))
                index.extend(json.dumps(x | {"filename": member}) for x in waiting)
                buffer, waiting, size = [], [], 0

        def finish() -> None:
            nonlocal zipped, index, n
            flush()
            zipped.add("indexes/index.cdxj", "\n".join(index).encode())
            zipped.add("datapackage.json", json.dumps({"profile": "data-package", "records": n}).encode())
            zipped.close()
            made.append((name, n, zipped.at))
            zipped, index, n = None, [], 0

        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                for r in batch.slice(part, 256).to_pylist():
                    if zipped is None:
                        name = f"part-{uuid.uuid4().hex}.wacz"
                        zipped = ZipWriter(fs.open_output_stream(f"{root}/{name}"), zip64)
                    payload = r["html"].encode()
                    data = record(r["page_id"], r["url"], payload, base32_sha1(payload), r["refers"])
                    waiting.append({"page": r["page_id"], "offset": size, "length": len(data)})
                    buffer.append(data)
                    size, n = size + len(data), n + 1
                    if size >= MEMBER_BYTES:
                        flush()
                        if zipped.at >= PACKAGE_BYTES:
                            finish()
        if zipped is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], f.type) for i, f in enumerate(schema)], schema=schema)

    return materialize(rows.mapInArrow(write, "package string, n_records long, n_bytes long"), "manifest")


def read_package(uri: str) -> Iterator[dict]:
    """Records of one package, by its directory and index, one range read each."""
    fs, path = file_system(uri)
    with fs.open_input_file(path) as f:
        members = directory(f, f.size())
        if any(method for _, _, method in members.values()):
            raise ValueError("a member is compressed; only stored members can be read by range")
        base = {name: data_offset(f, offset) for name, (offset, _, _) in members.items()}
        lines = f.read_at(members["indexes/index.cdxj"][1], base["indexes/index.cdxj"]).decode()
        for line in lines.split("\n") if lines else []:
            x = json.loads(line)
            yield parse_record(f.read_at(x["length"], base[x["filename"]] + x["offset"]))


def read_packages(manifest: DataFrame, path: str) -> DataFrame:
    """One row a record of the packages that the manifest names."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                for r in read_package(f"{path}/{name}"):
                    rows.append({k: r[k] for k in schema.names})
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    n = max(1, manifest.count())
    return manifest.select("package").repartition(n).mapInArrow(read, RESULT)


def archive_round_trip(pages: DataFrame, least_bytes: int = 0, zip64: bool = False) -> DataFrame:
    """Writes pages to packages in the shared folder and reads every record back."""
    path = fresh_path(pages.sparkSession, "warc")
    return read_packages(write_packages(pages, path, least_bytes, zip64), path)
