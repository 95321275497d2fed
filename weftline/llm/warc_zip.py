"""WARC records packaged in ZIP archives: writing, and reading by byte ranges.

An archive holds two stored (uncompressed) members: archive/data.warc.gz, one gzip member per WARC record, and
indexes/index.cdxj, one line per record with its place. The reader takes the end of the file, follows the
central directory (and its ZIP64 forms) to the members, reads the index, and then only the byte ranges of records.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, need, prepare, scratch_path, stored

# Fixed values of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
MAX16, MAX32, UTF8 = 0xFFFF, 0xFFFFFFFF, 0x0800
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An archive is closed at this size; a reader's task takes so many records.
ARCHIVE_BYTES, READ_RECORDS, GAP = 32 << 20, 2000, 1 << 16
#: Payloads shorter than this are never revisits.
REVISIT_BYTES = 100


def zip_stored(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP file of stored members; ZIP64 records where a size needs them, or always."""
    out, central = bytearray(), bytearray()
    for name, data in members:
        big = zip64 or len(data) >= MAX32 or len(out) >= MAX32
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), len(out)) if big else b""
        size, at, version = (MAX32, MAX32, 45) if big else (len(data), len(out), 20)
        crc, raw = zlib.crc32(data), name.encode()
        central += struct.pack("<4s6H3L5H2L", CENTRAL, version, version, UTF8, 0, 0, 33, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, at) + raw + extra
        local = extra[:20].replace(struct.pack("<HH", 1, 24), struct.pack("<HH", 1, 16), 1) if big else b""
        out += struct.pack("<4s5H3L2H", LOCAL, version, UTF8, 0, 0, 33, crc, size, size, len(raw), len(local)) + raw + local + data
    at, n = len(out), len(members)
    out += central
    if zip64 or at >= MAX32 or n >= MAX16:
        out += struct.pack("<4sQ2H2L4Q", END64, 44, 45, 45, 0, 0, n, n, len(central), at) + struct.pack("<4sLQL", LOCATOR64, 0, at + len(central), 1)
        n, at = MAX16, MAX32
    return bytes(out + struct.pack("<4s4H2LH", END, 0, 0, n, n, min(len(central), MAX32), at, 0))


def zip_members(f: BinaryIO, size: int) -> dict[str, tuple[int, int, int]]:
    """name -> (where its data begin, bytes, compression method), from the central directory alone."""
    tail_at = max(0, size - (22 + MAX16 + 20))
    f.seek(tail_at)
    tail = f.read(size - tail_at)
    k = tail.rfind(END)
    while k >= 0 and (k + 22 > len(tail) or k + 22 + struct.unpack_from("<H", tail, k + 20)[0] > len(tail)):
        k = tail.rfind(END, 0, k)
    if k < 0:
        raise ValueError("no end of central directory: not a ZIP file")
    n, length, at = struct.unpack_from("<HLL", tail, k + 10)
    if MAX16 == n or MAX32 in (length, at):
        if k < 20 or tail[k - 20 : k - 16] != LOCATOR64:
            raise ValueError("ZIP64 locator is missing")
        f.seek(struct.unpack_from("<Q", tail, k - 12)[0])
        end = f.read(56)
        if end[:4] != END64:
            raise ValueError("ZIP64 end of central directory is missing")
        n, length, at = struct.unpack_from("<QQQ", end, 32)
    f.seek(at)
    central, out, p = f.read(length), {}, 0
    for _ in range(n):
        if central[p : p + 4] != CENTRAL:
            raise ValueError("damaged central directory")
        method, _, _, _, packed, full, n_name, n_extra, n_note = struct.unpack_from("<H2HL2L3H", central, p + 10)
        begin = struct.unpack_from("<L", central, p + 42)[0]
        name = central[p + 46 : p + 46 + n_name].decode("utf-8", "replace")
        extra, q = central[p + 46 + n_name : p + 46 + n_name + n_extra], 0
        while q + 4 <= len(extra):
            kind, width = struct.unpack_from("<HH", extra, q)
            if kind == 1:  # present fields only, in this order
                wide = list(struct.unpack_from(f"<{width // 8}Q", extra, q + 4))
                full = wide.pop(0) if full == MAX32 else full
                packed = wide.pop(0) if packed == MAX32 else packed
                begin = wide.pop(0) if begin == MAX32 else begin
            q += 4 + width
        out[name] = (begin, packed, method)
        p += 46 + n_name + n_extra + n_note
    for name, (begin, packed, method) in out.items():
        f.seek(begin)
        head = f.read(30)
        if head[:4] != LOCAL:
            raise ValueError(f"{name}: no local header")
        out[name] = (begin + 30 + sum(struct.unpack_from("<HH", head, 26)), packed, method)
    return out


def _uri(page_id: int | None, key: int) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:row:{key}>"


def warc_record(uri: str, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One response, or a revisit of another page's response (its HTTP head without the payload)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": uri, "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url), "WARC-Payload-Digest": f"sha256:{digest}"}
    if refers_to is not None:
        head |= {"WARC-Refers-To": _uri(refers_to, 0), "WARC-Profile": REVISIT}
        payload = b""
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(http) + len(payload))}
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head.items()), "\r\n"]).encode() + http + payload + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers (lower-case names), payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = _headers(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, _headers(http), payload


def _headers(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder, as Python workers reach it."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri if "://" in uri or uri.startswith("file:") else f"file://{uri}"))


def write_archives(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per page to archives in folder (default: the shared folder); path, bytes, n_records per archive.

    Null html or url: empty; white space and control characters of a url are written percent-encoded. Equal payloads of REVISIT_BYTES or more: the smallest page_id
    (nulls don't count) is the response. Repeated rows of that page_id are responses too; an empty table gives no archives; other columns are left out. Each task attempt has file names of its own, so lost and repeated tasks do no harm.
    """
    spark = pages.sparkSession
    prepare(spark)
    folder = folder or scratch_path(spark, "warc")
    rows = need(
        pages, {"page_id": "long", "url": "string", "html": "string"}
    ).withColumn("html", F.coalesce("html", F.lit("")).cast("binary")).withColumn("digest", F.sha2("html", 256))
    # Only payloads that occur again need a join; those of many pages stay where they are.
    firsts = rows.where(F.octet_length("html") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = stored(firsts.where("n > 1"), "repeated", few=8)
    typed = join_counted(rows, firsts, "digest", how="left").select(
        "page_id", F.coalesce("url", F.lit("")).alias("url"), "html", "digest", F.expr("if(page_id <=> first, null, first)").alias("refers_to")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = open_fs(folder)
        task, made, key = TaskContext.get(), 0, 0
        data, index = bytearray(), []

        def close() -> pa.RecordBatch:
            nonlocal made
            fs.create_dir(base, recursive=True)
            path = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{made:04d}.wacz"
            body = zip_stored([(DATA, bytes(data)), (INDEX, "\n".join(index).encode())])
            with fs.open_output_stream(f"{base}/{path}") as f:
                f.write(body)
            made += 1
            out = pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{path}"]), pa.array([len(body)], pa.int64()), pa.array([len(index)], pa.int64())],
                ["path", "bytes", "n_records"]
            )
            data.clear()
            index.clear()
            return out

        for batch in batches:
            for page_id, url, html, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                uri = _uri(page_id, task.partitionId() << 36 | key)
                packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                member = packer.compress(warc_record(uri, url, html, digest, refers)) + packer.flush()
                index.append(json.dumps({"id": uri, "at": len(data), "n": len(member)}))
                data += member
                key += 1
                if len(data) >= archive_bytes:
                    yield close()
        if index:
            yield close()

    return stored(typed.mapInArrow(write, "path string, bytes long, n_records long"), "warc-list")


def index_entries(archives: DataFrame) -> DataFrame:
    """path, at (in the file), n: the byte range of every record, from the archives' directories and indexes."""
    prepare(archives.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = open_fs(path)
                with fs.open_input_file(at) as f:
                    members = zip_members(f, f.size())
                    begin, _, method = members[DATA]
                    place, length, how = members[INDEX]
                    if method or how:
                        raise ValueError(f"{path}: members must be stored")
                    f.seek(place)
                    rows = [json.loads(x) for x in f.read(length).decode().splitlines()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(rows), pa.string()), pa.array(
                        [begin + r["at"] for r in rows], pa.int64()
                    ), pa.array([r["n"] for r in rows], pa.int64())],
                    ["path", "at", "n"]
                )

    return archives.select("path").mapInArrow(read, "path string, at long, n long")


def read_records(archives: DataFrame) -> DataFrame:
    """page_id, url, record_type, refers_to, payload (null for revisits), payload_bytes, payload_digest (both of the full payload).

    Digests of responses are computed from what was read and must equal the header's. Neighbouring ranges are read at once.
    """
    spark = archives.sparkSession
    listed = archives.agg(F.sum("n_records")).first()[0] if "n_records" in archives.columns else None
    tasks = max(1, -(-(listed or 0) // READ_RECORDS), spark.sparkContext.defaultParallelism)
    entries = index_entries(archives).repartition(tasks, "path", F.floor(F.col("at") / (READ_RECORDS * 2048))).sortWithinPartitions("path", "at")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            out: list[tuple] = []
            k = 0
            while k < len(rows):
                path, at, n = rows[k]
                j, end = k + 1, at + n
                while j < len(rows) and rows[j][0] == path and rows[j][1] - end <= GAP and rows[j][1] + rows[j][2] - at <= 8 << 20:
                    end = rows[j][1] + rows[j][2]
                    j += 1
                fs, name = open_fs(path)
                with fs.open_input_file(name) as f:
                    f.seek(at)
                    span = f.read(end - at)
                out += [_row(zlib.decompress(span[a - at : a - at + m], 31)) for _, a, m in rows[k:j]]
                k = j
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                ["page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"]
            )

    return entries.mapInArrow(read, "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string")


def _row(raw: bytes) -> tuple:
    warc, http, payload = parse_record(raw)
    page = lambda uri: int(uri[10:-1]) if uri and uri.startswith("<urn:page:") else None
    said = warc["warc-payload-digest"].removeprefix("sha256:")
    if warc["warc-type"] == "revisit":
        return page(warc["warc-record-id"]), warc["warc-target-uri"], "revisit", page(warc["warc-refers-to"]), None, int(http["content-length"]), said
    if (found := hashlib.sha256(payload).hexdigest()) != said:
        raise ValueError(f"{warc['warc-record-id']}: the payload's digest is {found}, the header says {said}")
    return page(warc["warc-record-id"]), warc["warc-target-uri"], warc["warc-type"], None, payload, len(payload), found
