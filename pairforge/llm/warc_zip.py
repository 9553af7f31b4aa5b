"""Web archives packaged in ZIP files: a writer, and a reader that range-reads records.

An archive is a ZIP whose members are stored, not deflated: ``archive/data.warc.gz`` holds
one gzip member for each record, ``indexes/index.cdxj`` one line for each record with its
place in that member, and ``indexes/index.idx`` the place and checksum of each block of such
lines. So a record is found and read without extracting the archive, and a block of the index
without reading the rest of it. An archive holds at most RECORDS records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, chain, islice
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.llm.common import Scratch, beside, located, lookup, small_batches

DATA, INDEX, BLOCKS = "archive/data.warc.gz", "indexes/index.cdxj", "indexes/index.idx"
#: Records of a block of the index, which is read at once.
SPLIT = 2000
#: Records of an archive; its index lines are held until its records are written.
RECORDS = 50_000
#: A block of the index: where its lines begin, how many bytes they have, and their checksum.
BLOCK_AT = struct.Struct("<QQL")
#: Payloads of at least this many bytes are stored once.
LEAST_BYTES = 1000

# Fixed values of the ZIP format: signatures, layouts, and the mark of a value kept in ZIP64 form.
LOCAL, CENTRAL, END, END64, LOCATOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
LOCAL_AT = struct.Struct("<4s5H3L2H")
CENTRAL_AT = struct.Struct("<4s6H3L5H2L")
END_AT = struct.Struct("<4s4H2LH")
END64_AT = struct.Struct("<4sQ2H2L4Q")
LOCATOR_AT = struct.Struct("<4sLQL")
BIG32, BIG16, ZIP64_ID = 0xFFFFFFFF, 0xFFFF, 1


class ZipWriter:
    """Writes stored members to a stream that need not seek; all places in ZIP64 form."""

    def __init__(self, out: BinaryIO, zip64: bool = True) -> None:
        self.out, self.zip64, self.at = out, zip64, 0
        self.members: list[tuple[bytes, int, int, int]] = []

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def member(self, name: str, blocks: Iterator[bytes]) -> None:
        start, raw = self.at, name.encode()
        # Bit 3: sizes and checksum follow the data; bit 11: the name is UTF-8.
        self.put(LOCAL_AT.pack(LOCAL, 45, 0x0808, 0, 0, 33, 0, 0, 0, len(raw), 0) + raw)
        crc = size = 0
        for block in blocks:
            self.put(block)
            crc, size = zlib.crc32(block, crc), size + len(block)
        self.put(b"PK\x07\x08" + struct.pack("<L2Q" if self.zip64 else "<3L", crc, size, size))
        self.members.append((raw, crc, size, start))

    def close(self) -> None:
        first, n = self.at, len(self.members)
        for raw, crc, size, start in self.members:
            big = self.zip64 or max(size, start) >= BIG32
            extra = struct.pack("<2H3Q", ZIP64_ID, 24, size, size, start) if big else b""
            small, place = (BIG32, BIG32) if big else (size, start)
            self.put(CENTRAL_AT.pack(CENTRAL, 45, 45, 0x0808, 0, 0, 33, crc, small, small, len(raw), len(extra), 0, 0, 0, 0, place) + raw + extra)
        length = self.at - first
        if self.zip64 or n >= BIG16 or max(first, length) >= BIG32:
            here = self.at
            self.put(END64_AT.pack(END64, 44, 45, 45, 0, 0, n, n, length, first))
            self.put(LOCATOR_AT.pack(LOCATOR, 0, here, 1))
            self.put(END_AT.pack(END, 0, 0, BIG16, BIG16, BIG32, BIG32, 0))
        else:
            self.put(END_AT.pack(END, 0, 0, n, n, length, first, 0))


@dataclass(frozen=True)
class Member:
    """A member: if it is stored, its bytes are [start, start + size) of the archive."""

    name: str
    start: int
    size: int
    crc: int
    method: int = 0


class ZipReader:
    """The members of a ZIP in a file that can seek; reads the directory and what is asked for."""

    def __init__(self, file: BinaryIO) -> None:
        self.file = file
        file.seek(0, 2)
        self.length = file.tell()
        tail_at = max(0, self.length - 65_557)  # the end record and its longest comment
        tail = self.read(tail_at, self.length - tail_at)
        at = tail.rfind(END)
        while at >= 0 and (at + END_AT.size > len(tail) or at + END_AT.size + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(END, 0, at)
        if at < 0:
            raise ValueError("no end of a ZIP directory")
        _, _, _, _, count, length, first, _ = END_AT.unpack_from(tail, at)
        back = tail_at + at - LOCATOR_AT.size
        if back >= 0 and (BIG16 == count or BIG32 in (length, first)):
            mark, _, place, _ = LOCATOR_AT.unpack(self.read(back, LOCATOR_AT.size))
            if mark == LOCATOR:
                mark, *_, count, length, first = END64_AT.unpack(self.read(place, END64_AT.size))
                if mark != END64:
                    raise ValueError("no ZIP64 end record where its locator points")
        self.members = {m.name: m for m in self._directory(self.read(first, length), count)}

    def read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(size)
        if len(data) != size:
            raise ValueError("the archive ends too early")
        return data

    def _directory(self, data: bytes, count: int) -> Iterator[Member]:
        at = 0
        for _ in range(count):
            mark, _, _, flags, method, _, _, crc, packed, size, n_name, n_extra, n_note, _, _, _, start = CENTRAL_AT.unpack_from(data, at)
            if mark != CENTRAL:
                raise ValueError("a broken ZIP directory")
            at += CENTRAL_AT.size
            name = data[at : at + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = data[at + n_name : at + n_name + n_extra]
            at += n_name + n_extra + n_note
            while len(extra) >= 4:
                kind, n = struct.unpack_from("<2H", extra)
                if kind == ZIP64_ID:
                    wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                    size = next(wide) if size == BIG32 else size
                    packed = next(wide) if packed == BIG32 else packed
                    start = next(wide) if start == BIG32 else start
                extra = extra[4 + n :]
            *_, n_name, n_extra = LOCAL_AT.unpack(self.read(start, LOCAL_AT.size))
            yield Member(name, start + LOCAL_AT.size + n_name + n_extra, packed, crc, method)

    def member(self, name: str) -> Member:
        """The stored member of this name; one that is absent or packed is an error that names it."""
        if name not in self.members:
            raise ValueError(f"the archive has no member {name}")
        if self.members[name].method:
            raise ValueError(f"the member {name} is packed, not stored, and cannot be read in ranges")
        return self.members[name]

    def whole(self, name: str) -> bytes:
        """All bytes of a member, held against its checksum."""
        found = self.member(name)
        data = self.range(found, 0, found.size)
        if zlib.crc32(data) != found.crc:
            raise ValueError(f"the member {name} does not have its checksum")
        return data

    def range(self, member: Member, at: int, size: int) -> bytes:
        if at < 0 or at + size > member.size:
            raise ValueError("a range outside its member")
        return self.read(member.start + at, size)


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    name = (urn or "<urn:x-page:null>")[12:-1]
    return None if name == "null" else int(name)


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record. A revisit keeps the HTTP header, with the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url) if url else "urn:x-page:no-url"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header (names in lower case) and payload of one record."""

    def fields(head: bytes) -> dict[str, str]:
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}

    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    warc = fields(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


def _file_system(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")


def write_archives(pages: DataFrame, root: str, level: int = 4) -> DataFrame:
    """One archive for each partition of pages, in the shared folder ``root``.

    ``pages`` has page_id, url, html, sha1, revisit and refers_to. Returns (path, records) of
    each archive. A file's name is new in each attempt, so a task that is run again leaves an
    orphan, and only the archives of tasks that succeeded are returned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _file_system(root)
        rows = (row for b in batches for row in b.to_pylist())
        for first in rows:
            lines: list[bytes] = []
            at = 0

            def members(first: dict = first, lines: list[bytes] = lines) -> Iterator[bytes]:
                nonlocal at
                for row in chain([first], islice(rows, RECORDS - 1)):
                    payload = (row["html"] or "").encode()
                    raw = record(row["page_id"], row["url"], payload, row["sha1"], row["refers_to"], row["revisit"])
                    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                    data = pack.compress(raw) + pack.flush()
                    lines.append(json.dumps({"id": _urn(row["page_id"]), "offset": at, "length": len(data), "digest": row["sha1"]}).encode() + b"\n")
                    at += len(data)
                    yield data

            store.create_dir(base, recursive=True)
            path = f"{base}/{uuid.uuid4().hex}.wacz"
            with store.open_output_stream(path) as out:
                z = ZipWriter(out)
                z.member(DATA, members())
                blocks = [b"".join(lines[i : i + SPLIT]) for i in range(0, len(lines), SPLIT)]
                z.member(INDEX, iter(blocks))
                z.member(BLOCKS, block_table(blocks))
                z.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(lines)], pa.int64())], ["path", "records"])

    return pages.select("page_id", "url", "html", "sha1", "revisit", "refers_to").mapInArrow(run, "path string, records long")


def block_table(blocks: list[bytes]) -> Iterator[bytes]:
    starts = accumulate(map(len, blocks), initial=0)
    return (BLOCK_AT.pack(start, len(x), zlib.crc32(x)) for start, x in zip(starts, blocks, strict=False))


def index_lines(z: ZipReader, block: int) -> list[bytes]:
    """The lines of one block of the index."""
    start, size, crc = BLOCK_AT.unpack_from(z.whole(BLOCKS), block * BLOCK_AT.size)
    data = z.range(z.member(INDEX), start, size)
    if zlib.crc32(data) != crc:
        raise ValueError(f"block {block} of {INDEX} does not have its checksum")
    return data.splitlines()


#: Bytes of records side by side that are read in one request, about.
REQUEST = 4 << 20


def neighbours(z: ZipReader, data: Member, entries: list[dict]) -> Iterator[bytes]:
    """The records of index entries, in order. Those that lie side by side are read together."""
    at = 0
    while at < len(entries):
        start, end, upto = entries[at]["offset"], entries[at]["offset"] + entries[at]["length"], at + 1
        while upto < len(entries) and entries[upto]["offset"] == end and end - start < REQUEST:
            end, upto = end + entries[upto]["length"], upto + 1
        whole = memoryview(z.range(data, start, end - start))
        for e in entries[at:upto]:
            yield bytes(whole[e["offset"] - start : e["offset"] - start + e["length"]])
        at = upto


def read_archives(archives: DataFrame, root: str) -> DataFrame:
    """Every record of the archives: page_id, type, payload_bytes, sha1, refers_to.

    Each block of an archive's index is read by itself, its records a few MB at a time. A record's gzip member has a checksum,
    and the payload of a response is hashed again and held against its header.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _file_system(root)
        for b in batches:
            for row in b.to_pylist():
                with store.open_input_file(row["path"]) as file:
                    z = ZipReader(file)
                    data, found = z.member(DATA), []
                    for raw in neighbours(z, data, list(map(json.loads, index_lines(z, row["block"])))):
                        warc, http, payload = parse(zlib.decompress(raw, 31))
                        sha1 = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
                        revisit = warc["warc-type"] == "revisit"
                        if not revisit and hashlib.sha1(payload).hexdigest() != sha1:
                            raise ValueError("a payload does not have its digest")
                        size = int(http["content-length"]) if revisit else len(payload)
                        found.append((_page(warc["warc-record-id"]), size, sha1, warc["warc-type"], _page(warc.get("warc-refers-to"))))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                cols = list(zip(*found, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(records - 1) div {SPLIT}")))
    ranges = archives.select("path", blocks.alias("block"))
    spread = ranges.repartition(max(1, archives.sparkSession.sparkContext.defaultParallelism * 2))
    return spread.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write pages to archives and read them back: one row for each page.

    Of pages with equal payloads of at least ``least_bytes`` bytes, those with the largest
    page_id are responses and the others revisit it. A null html is an empty payload; a null
    page_id is below all others; rows that repeat an id and a payload are written each; a null
    url gets a urn in its place. Other columns are ignored; an empty table gives no rows.
    Revisits of a hot payload are found by a lookup that deals no key's rows to one task.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    html = F.coalesce(F.col("row.html").cast("string"), F.lit(""))
    rows = located(pages.select("page_id", "url", "html"), scratch).select("row_file", "row_at", F.col("row.page_id").cast("long").alias("page_id"), F.col("row.url").cast("string").alias("url"), html.alias("html"))
    # Digests and places are brought together; payloads stay where they are, and are hashed again as they are written.
    named = rows.select("row_file", "row_at", "page_id", F.octet_length("html").alias("size"), F.sha1(F.encode("html", "UTF-8")).alias("sha1"))
    named = scratch.write(named, "digests")
    large = named.filter(F.col("size") >= least_bytes)
    groups = large.groupBy("sha1").agg(F.max("page_id").alias("best"), F.count("*").alias("n")).filter("n > 1")
    groups = scratch.sized(groups, "groups", "n")
    again = lookup(large, groups, "sha1", "n").filter(~F.col("page_id").eqNullSafe(F.col("best")))
    again = scratch.write(again.select("row_file", "row_at", F.col("best").alias("refers_to"), F.lit(True).alias("revisit")), "revisits")
    decided = beside(rows, again).select("page_id", "url", "html", F.sha1(F.encode("html", "UTF-8")).alias("sha1"), F.coalesce("revisit", F.lit(False)).alias("revisit"), "refers_to")
    with small_batches(pages.sparkSession):
        archives = scratch.write(write_archives(decided, f"{scratch.path}/archives"), "list")
    scratch.keep("list")
    return read_archives(archives, scratch.path)


def op3_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP3_SQL = """
WITH sized AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
ranked AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS best FROM sized)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> best THEN best END AS refers_to
FROM ranked
"""
