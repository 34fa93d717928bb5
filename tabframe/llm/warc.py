"""WARC archives in which equal payloads are stored once."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as sf

from tabframe.llm.common import fresh_folder, table, tasks, written

#: Bytes after which a task starts another archive.
ARCHIVE_BYTES = 64 << 20
#: Payloads with fewer bytes are always written out.
LEAST_BYTES = 0
#: Date of the records; one value, so that reruns write the same archives.
DATE = "2024-01-01T00:00:00Z"
#: Fixed value of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "archive string, records long, bytes long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _opened(path: str):
    """File system and path; a plain path or file: is local, other schemes go by their name."""
    local = re.match(r"^(?:file:)?/+(.*)$", path)
    return (fs.LocalFileSystem(), "/" + local[1]) if local else fs.FileSystem.from_uri(path)


def record(page_id, url, payload: bytes, keeper, date: str = DATE) -> bytes:
    """One record with new headers, as a gzip member; a revisit of ``keeper`` where that is another page."""
    first = keeper is None or keeper == page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if first else http
    head = [("WARC-Type", "response" if first else "revisit"), ("WARC-Record-ID", _record_id(page_id)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    head.append(("WARC-Payload-Digest", f"sha1:{digest(payload)}"))
    head.append(("WARC-Block-Digest", f"sha1:{digest(block)}"))
    if not first:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(keeper)), ("X-Refers-To-Page-ID", keeper)]
    if page_id is not None:
        head.append(("X-Page-ID", page_id))
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block))]
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(lines.encode() + block + b"\r\n\r\n") + packer.flush()


def _record_id(page_id) -> str:
    number = hashlib.sha256(f"page {page_id}".encode()).hexdigest()
    return f"<urn:uuid:{number[:8]}-{number[8:12]}-8{number[13:16]}-a{number[17:20]}-{number[20:32]}>"


def _writer(folder: str, most: int):
    def run(batches):
        task, out, name, count, size, part = TaskContext.get(), None, "", 0, 0, 0
        system, root = _opened(folder)

        def done():
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([count], pa.int64()), "bytes": pa.array([size], pa.int64())})

        for batch in batches:
            for page_id, url, payload, keeper in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "keeper"))):
                if out is None:
                    # a name of the attempt's own: what a lost attempt leaves behind is in no manifest
                    name, count, size = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{part}.warc.gz", 0, 0
                    out, part = system.open_output_stream(f"{root}/{name}", compression=None), part + 1
                packed = record(page_id.as_py(), url.as_py(), payload.as_py(), keeper.as_py())
                out.write(packed)
                count, size = count + 1, size + len(packed)
                if size >= most:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return run


def resolved(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload and keeper: the page whose response has the payload, null where the page has its own.

    Headers alone are shuffled by digest: each group keeps its largest id, and pages of groups of more than one look
    theirs up; a hot payload is merged before the exchange. Payloads then meet that by page and digest.
    """
    payload = sf.coalesce("html", sf.lit(""))
    read = pages.select(
        sf.col("page_id").cast("long").alias("page_id"), "url", sf.encode(payload, "utf-8").alias("payload"))
    read = read.withColumn("key", sf.sha2("payload", 256))
    headers = read.where(sf.octet_length("payload") >= least).select("page_id", "key")
    groups = headers.groupBy("key").agg(sf.max("page_id").alias("keeper"), sf.count("*").alias("n")).where("n > 1")
    others = headers.join(groups, "key").where("not page_id <=> keeper").select(
        sf.col("page_id").alias("p"), sf.col("key").alias("k"), "keeper").distinct()
    return read.join(others, sf.col("page_id").eqNullSafe(sf.col("p")) & (sf.col("key") == sf.col("k")), "left").select(
        "page_id", "url", "payload", "keeper")


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_BYTES, most: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for each page into archives in ``folder``; returns the manifest (archive, records, bytes).

    Of pages with equal payloads of ``least`` bytes or more, the one with the largest page_id is a response and the
    others are revisits of it. A null html is an empty payload. A null page_id counts as smaller than any other, and
    groups of such pages only are all responses, as are repeated rows with the id of the response. A null url leaves
    the header out. Only page_id, url and html are looked at. Without pages no archive is written.

    ``folder`` is on a file system that driver and executors share.
    """
    system, root = _opened(folder)
    system.create_dir(root, recursive=True)
    return written(resolved(pages, least).mapInArrow(_writer(folder, most), MANIFEST), "manifest")


def members(stream, size: int = 1 << 20):
    """The unpacked members of a gzip stream, one at a time."""
    rest = b""
    while True:
        unpacker, out = zlib.decompressobj(31), []
        while not unpacker.eof:
            chunk = rest or stream.read(size)
            if not chunk:
                if out:
                    raise ValueError("an archive ends inside a record")
                return
            out.append(unpacker.decompress(chunk))
            rest = b""
        rest = unpacker.unused_data
        yield b"".join(out)


def parsed(data: bytes) -> dict:
    """Fields of one record; lengths and digests that do not hold are errors."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    named = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if version != "WARC/1.1" or rest[len(block):] != b"\r\n\r\n" or f"sha1:{digest(block)}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"not a whole record: {fields}")
    if kind == "response" and (len(payload) != length or digest(payload) != named):
        raise ValueError(f"the payload is not the one named: {fields}")
    number = lambda name: int(fields[name]) if name in fields else None
    return {"page_id": number("X-Page-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": length,
            "payload_digest": named, "record_type": kind, "refers_to": number("X-Refers-To-Page-ID"),
            "payload": payload if kind == "response" else None}


def _reader(folder: str, columns: list[str], rows: int = 256):
    def run(batches):
        system, root = _opened(folder)
        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
        pack = lambda found: pa.RecordBatch.from_pydict(
            {c: pa.array([r[c] for r in found], kinds.get(c, pa.string())) for c in columns})
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                with system.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    found = []
                    for data in members(stream):
                        found.append(parsed(data))
                        if len(found) == rows:
                            yield pack(found)
                            found = []
                    if found:
                        yield pack(found)

    return run


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the archives named in ``manifest``, each checked against its digests; payload is null for
    revisits, and left out altogether if ``payloads`` is false."""
    fields = [f.strip() for f in RECORDS.split(",")][: None if payloads else -1]
    names = [f.split()[0] for f in fields]
    return manifest.repartition(tasks(manifest), "archive").mapInArrow(_reader(folder, names), ", ".join(fields))


def op2_warc(spark, sf_dir):
    folder = fresh_folder(spark, "warc")
    manifest = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(manifest, folder, payloads=False)


#: Base32 of the digest is spelt by fives of its 160 bits.
ORACLE = r"""
with p as (select page_id, url, coalesce(html, '') as payload from pages),
d as (select page_id, url, octet_length(encode(payload)) as payload_bytes, max(page_id) over (partition by payload) as top,
             sha1(payload) as hex from p),
b as (select *, array_to_string([lpad(bin(instr('0123456789abcdef', hex[i + 1]) - 1), 4, '0') for i in range(0, 40)], '') as bits from d)
select page_id, url, payload_bytes, case when page_id = top then 'response' else 'revisit' end as record_type,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(list_sum(
         [cast(bits[i * 5 + j + 1] as integer) * (16 >> j) for j in range(0, 5)]) as integer), 1) for i in range(0, 32)], '') as payload_digest,
       case when page_id <> top then top end as refers_to
from b
"""
