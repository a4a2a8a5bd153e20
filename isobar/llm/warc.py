"""WARC records in ZIP packages: writing archives and reading them by ranges, without extraction.

An archive is a ZIP64 package with two stored members: ``archive/data.warc.gz`` (one gzip member per record) and
``indexes/index.cdxj`` (one line per record: place, length, id). Every task writes one archive through Spark's text
writer, so the commit protocol guards it against lost executors. That writer ends each row with a line feed; the byte
stream is therefore cut at bytes that are line feeds anyway, and the last one is the package's one-byte comment.

Reading takes the end of each archive, the ZIP64 locator, the central directory, the local headers and the index, then
fetches runs of records by range. ``open_at`` opens local paths and whatever public file systems pyarrow knows.

Payloads of at least ``min_bytes`` that repeat are stored once: the record with the smallest id is the response, the
others are ``revisit`` records with the response's HTTP headers, so their length and digest are still known.

Nulls: a null payload is empty, a null id or URI is left out of the record and read back as null. Rows with the
smallest id of their payload are all responses, also if that id repeats; a group in which no row has an id is all
responses. An empty table gives no archives and an empty result. Control characters in a URI are percent-encoded.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DATA_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
#: Bytes that a written row or a range read holds at most, long records aside.
ROW_BYTES, RANGE_BYTES = 1 << 20, 4 << 20
DATE = "2000-01-01T00:00:00Z"
STREAMED = 0x0808  # sizes follow the data; names are UTF-8


# --- writing ----------------------------------------------------------------------------------------------


def assign_records(pages: DataFrame, record_id: Column, uri: Column, payload: Column, min_bytes: int = 100) -> DataFrame:
    """Rows (id, uri, payload, payload_bytes, payload_digest, refers_to) with repeated payloads referred to their first.

    Payload groups are aggregated in the tasks before the shuffle; only groups of at least two rows are joined back.
    """
    body = F.coalesce(payload.cast("binary"), F.lit(b""))
    rows = pages.select(
        record_id.cast("long").alias("id"), uri.cast("string").alias("uri"), body.alias("payload"),
        F.octet_length(body).cast("long").alias("payload_bytes"), F.sha2(body, 256).alias("payload_digest"),
    )
    first = (
        rows.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest")
        .agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
    )
    revisit = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    joined = rows.join(first, "payload_digest", "left").withColumn("refers_to", F.when(revisit, F.col("first_id")))
    return joined.select(
        "id", "uri", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
        "refers_to",
    )


def record_name(number: int | None) -> str:
    return f"<urn:record:{'' if number is None else number}>"


def warc_record(number, uri, payload: bytes, payload_bytes: int, digest: str, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    lines += [f"WARC-Record-ID: {record_name(number)}", f"WARC-Date: {DATE}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        lines.append(f"WARC-Refers-To: {record_name(refers_to)}")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines.append("Content-Type: application/http; msgtype=response")
    block = http + payload
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class PackageWriter:
    """Bytes of one package, given out as pieces that stop before a line feed."""

    def __init__(self):
        self.buffer, self.position, self.entries = bytearray(), 0, []

    def put(self, data: bytes) -> None:
        self.buffer += data
        self.position += len(data)

    def lines(self) -> Iterator[bytes]:
        if len(self.buffer) >= ROW_BYTES and (cut := self.buffer.rfind(b"\n")) >= 0:
            yield bytes(self.buffer[:cut])
            del self.buffer[: cut + 1]

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.entries.append([raw, self.position, 0, 0])
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self.put(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, STREAMED, 0, 0, 0x21, 0, 2**32 - 1, 2**32 - 1, len(raw), len(extra)) + raw + extra)

    def write(self, data: bytes) -> None:
        entry = self.entries[-1]
        entry[2], entry[3] = zlib.crc32(data, entry[2]), entry[3] + len(data)
        self.put(data)

    def end(self) -> None:
        _, _, crc, size = self.entries[-1]
        self.put(struct.pack("<IIQQ", 0x08074B50, crc, size, size))

    def close(self) -> bytes:
        start = self.position
        for raw, offset, crc, size in self.entries:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset)
            self.put(
                struct.pack(
                    "<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, STREAMED, 0, 0, 0x21, crc, 2**32 - 1, 2**32 - 1, len(raw), len(extra),
                    0, 0, 0, 0, 2**32 - 1,
                ) + raw + extra
            )
        size, at, n = self.position - start, self.position, len(self.entries)
        self.put(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, size, start))
        self.put(struct.pack("<IIQI", 0x07064B50, 0, at, 1))
        self.put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, n, n, 2**32 - 1, 2**32 - 1, 1))
        return bytes(self.buffer)  # the writer's line feed is the comment


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    package, index = None, []

    def row(data: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["value"])

    for batch in batches:
        columns = [batch.column(name) for name in ("id", "uri", "payload", "payload_bytes", "payload_digest", "refers_to")]
        for i in range(batch.num_rows):
            number, uri, payload, size, digest, refers_to = (column[i].as_py() for column in columns)
            if package is None:
                package = PackageWriter()
                package.begin(DATA_MEMBER)
            packer = zlib.compressobj(4, zlib.DEFLATED, 31)
            data = packer.compress(warc_record(number, uri, payload or b"", size, digest, refers_to)) + packer.flush()
            index.append(json.dumps({"filename": DATA_MEMBER, "offset": package.entries[0][3], "length": len(data), "id": number}))
            package.write(data)
            for line in package.lines():
                yield row(line)
    if package is not None:
        package.end()
        package.begin(INDEX_MEMBER)
        for i in range(0, len(index), 1000):
            package.write("".join(f"{line}\n" for line in index[i : i + 1000]).encode())
            for line in package.lines():
                yield row(line)
        package.end()
        yield row(package.close())


def write_archives(records: DataFrame, path: str) -> None:
    """One archive per task under ``path``, a folder that all executors reach."""
    records.mapInArrow(_pack, "value binary").select(F.col("value").cast("string").alias("value")).write.text(path, lineSep="\n")


# --- reading ----------------------------------------------------------------------------------------------


def open_at(uri: str):
    """A seekable file of a URI."""
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return open(unquote(parsed.path), "rb")  # noqa: SIM115 - the caller closes it
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def read_range(file, start: int, size: int) -> bytes:
    file.seek(start)
    return file.read(size)


def central_directory(file, length: int) -> tuple[int, int, int]:
    """Place, size and number of entries of the central directory, 32 or 64 bits."""
    begin = max(0, length - 65_557 - 20)
    tail = read_range(file, begin, length - begin)
    at = len(tail)
    while (at := tail.rfind(b"PK\5\6", 0, at)) >= 0:
        if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
    if at < 0:
        raise ValueError("no end of central directory record")
    n, size, start = struct.unpack_from("<HII", tail, at + 10)
    if at >= 20 and tail[at - 20 : at - 16] == b"PK\6\7":
        record = read_range(file, struct.unpack_from("<Q", tail, at - 12)[0], 56)
        if record[:4] != b"PK\6\6":
            raise ValueError("ZIP64 locator without record")
        n, size, start = struct.unpack_from("<QQQ", record, 32)
    return start, size, n


def zip64_values(extra: bytes, values: list[int]) -> list[int]:
    """``values`` (sizes and offset) with those that are all ones taken from the ZIP64 extra field."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            wide = iter(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
            return [next(wide) if v == 2**32 - 1 else v for v in values]
        at += 4 + size
    return values


def members(file, length: int) -> Iterator[dict]:
    """Name, method, sizes, checksum and data place of every member; the directory is read in steps."""
    start, size, n = central_directory(file, length)
    buffer, read = b"", 0
    for _ in range(n):
        while True:
            if len(buffer) >= 46:
                total = 46 + sum(struct.unpack_from("<HHH", buffer, 28))
                if len(buffer) >= total:
                    break
            more = read_range(file, start + read, min(ROW_BYTES, size - read))
            if not more:
                raise ValueError("the central directory ends early")
            buffer, read = buffer + more, read + len(more)
        if buffer[:4] != b"PK\1\2":
            raise ValueError("no central directory entry")
        method, crc, stored, plain, names, extras = struct.unpack_from("<H4xIIIHH", buffer, 10)
        plain, stored, offset = zip64_values(buffer[46 + names : 46 + names + extras], [plain, stored, struct.unpack_from("<I", buffer, 42)[0]])
        local = read_range(file, offset, 30)
        if local[:4] != b"PK\3\4":
            raise ValueError("no local header")
        data = offset + 30 + sum(struct.unpack_from("<HH", local, 26))
        yield {"name": buffer[46 : 46 + names].decode(), "method": method, "crc": crc, "stored": stored, "bytes": plain, "start": data}
        buffer = buffer[total:]


def archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where("length > 0").select("path", "length")


MEMBER_SCHEMA = "path string, name string, method int, crc long, stored long, bytes long, start long"


def list_members(found: DataFrame) -> DataFrame:
    """One row per member of every archive (path, length)."""

    def read(batches):
        for batch in batches:
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
                with open_at(path) as file:
                    rows = [{"path": path, **m} for m in members(file, length)]
                yield pa.RecordBatch.from_pylist(
                    rows, pa.schema([("path", pa.string()), ("name", pa.string()), ("method", pa.int32()), ("crc", pa.int64()),
                                     ("stored", pa.int64()), ("bytes", pa.int64()), ("start", pa.int64())]))

    return found.mapInArrow(read, MEMBER_SCHEMA)


RANGE_SCHEMA = pa.schema([("path", pa.string()), ("start", pa.int64()), ("lengths", pa.list_(pa.int64()))])


def record_ranges(found: DataFrame) -> DataFrame:
    """Runs of adjoining records (path, start, lengths) from the stored indexes of the archives (path, length)."""

    def read(batches):
        for batch in batches:
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
                with open_at(path) as file:
                    yield from one(path, file, {m["name"]: m for m in members(file, length) if m["method"] == 0})

    def one(path, file, stored):
        start = end = None
        lengths: list[int] = []
        for name, index in stored.items():
            if not name.startswith("indexes/"):
                continue
            left, at = b"", 0
            while at < index["stored"] or left:
                more = read_range(file, index["start"] + at, min(ROW_BYTES, index["stored"] - at))
                at += len(more)
                *lines, left = (left + more).split(b"\n")
                if not more and left:
                    lines, left = [*lines, left], b""
                for line in filter(None, lines):
                    entry = json.loads(line[line.index(b"{") :])
                    place = stored[entry["filename"]]["start"] + entry["offset"]
                    if lengths and (place != end or end - start >= RANGE_BYTES):
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([start], pa.int64()), pa.array([lengths], pa.list_(pa.int64()))], schema=RANGE_SCHEMA)
                        lengths = []
                    if not lengths:
                        start = place
                    lengths.append(entry["length"])
                    end = place + entry["length"]
        if lengths:
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([start], pa.int64()), pa.array([lengths], pa.list_(pa.int64()))], schema=RANGE_SCHEMA)

    return found.mapInArrow(read, "path string, start long, lengths array<long>")


def parse_record(data: bytes) -> dict:
    """Headers and payload of one WARC record; the payload's digest is checked against the header."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    digest = headers["warc-payload-digest"].removeprefix("sha256:")
    revisit = headers["warc-type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {headers['warc-record-id']} differs from its header")

    def number(name: str) -> int | None:
        digits = re.search(r"record:(-?\d+)>", headers.get(name, ""))
        return int(digits[1]) if digits else None

    return {
        "id": number("warc-record-id"), "uri": headers.get("warc-target-uri"), "record_type": headers["warc-type"],
        "refers_to": number("warc-refers-to"), "payload_bytes": size, "payload_digest": digest, "payload": None if revisit else payload,
    }


RECORD_TYPES = {
    "id": ("long", pa.int64()), "uri": ("string", pa.string()), "record_type": ("string", pa.string()), "refers_to": ("long", pa.int64()),
    "payload_bytes": ("long", pa.int64()), "payload_digest": ("string", pa.string()), "payload": ("binary", pa.binary()),
}


def read_archives(spark: SparkSession, path: str, columns: tuple[str, ...] = tuple(RECORD_TYPES)) -> DataFrame:
    """All records of the archives under ``path``, fetched by range."""
    schema = pa.schema([(c, RECORD_TYPES[c][1]) for c in columns])

    def fetch(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with open_at(row["path"]) as file:
                    data = read_range(file, row["start"], sum(row["lengths"]))
                at, out = 0, []
                for length in row["lengths"]:
                    record = parse_record(zlib.decompress(data[at : at + length], 31))
                    out.append({c: record[c] for c in columns})
                    at += length
                yield pa.RecordBatch.from_pylist(out, schema)

    spread = record_ranges(archives(spark, path)).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spread.mapInArrow(fetch, ", ".join(f"{c} {RECORD_TYPES[c][0]}" for c in columns))


def archive_path(root: str, name: str) -> str:
    return os.path.join(root, "isobar", name)
