"""Operator 3: WARC archives and a normaliser of monolithic gzip.

write_archives writes a record per page into archives that are one gzip stream each. normalise inflates each
such file once, as a stream, writes every record again as a gzip member of its own and a sidecar index with the
offsets; read_records then opens any record by its offset. Files are named anew by each attempt of a task and
count only by the rows that the attempt returns, so a lost executor leaves nothing but unused files. Archives
are bounded in size, and a file is one task's work from opening to closing.
"""

from __future__ import annotations

import base64
import json
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import blocks, bounded_batches, materialize, remove, shared_dir, task

ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 20
#: Payloads of fewer bytes are never written as revisits.
LEAST_SHARED = 1000
#: So many classes of equal payloads at most (about 60 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_CLASSES = 200_000
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "path string, offset bigint, length bigint, record_id string, record_type string, target_uri string"


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """A response record, or a revisit record without payload if refers_to is given; digest in hex."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:x-page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>",
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "WARC-Refers-To": None if refers_to is None else f"<urn:x-page:{refers_to}>",
        "WARC-Profile": None if refers_to is None else PROFILE,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, the record's bytes) of inflated chunks; at most a record and a chunk are held."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        while (end := held.find(b"\r\n\r\n")) >= 0:
            head = parse(bytes(held[:end]))
            size = end + 4 + int(head["content-length"]) + 4
            if len(held) < size:
                break
            yield head, bytes(held[:size])
            del held[:size]
    if held.strip():
        raise ValueError("an archive ends inside a record")


def inflate(stream) -> Iterator[bytes]:
    """The inflated bytes of a gzip file, whatever its members; a broken file is an error."""
    d = zlib.decompressobj(31)
    while data := stream.read(CHUNK):
        while data:
            out = d.decompress(data, CHUNK)
            if out:
                yield out
            if d.eof:
                data, d = d.unused_data, zlib.decompressobj(31)
            else:
                data = d.unconsumed_tail
    while not d.eof and (out := d.decompress(b"", CHUNK)):
        yield out


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@task
def _write(batches: Iterator[pa.RecordBatch], folder: str, date: str, limit: int) -> Iterator[pa.RecordBatch]:
    fs, base = _fs(folder)
    fs.create_dir(base, recursive=True)
    out, done, n, name = None, 0, 0, ""
    finished: list[tuple[str, int]] = []

    def end():
        nonlocal out
        if out is not None:
            out.write(z.flush())
            out.close()
            finished.append((f"{folder}/{name}", n))
            out = None

    for t in blocks(batches, "html"):
        for r in t.to_pylist():
            if out is None:
                name, z, done, n = f"{uuid.uuid4().hex}.warc.gz", zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0
                out = fs.open_output_stream(f"{base}/{name}", compression=None)
            data = record(r["page_id"], r["url"], (r["html"] or "").encode(), r["digest"], r["refers_to"], date)
            out.write(z.compress(data))
            done, n = done + len(data), n + 1
            if done >= limit:
                end()
    end()
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in finished], pa.string()), pa.array([x[1] for x in finished], pa.int64())], names=["path", "n_records"])


@task
def _normalise(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    fs, base = _fs(folder)
    fs.create_dir(base, recursive=True)
    for batch in batches:
        for path in batch.column("path").to_pylist():
            source, inside = _fs(path)
            name = f"{uuid.uuid4().hex}.warc.gz"
            rows, offset = [], 0
            with source.open_input_stream(inside, compression=None) as f, fs.open_output_stream(f"{base}/{name}", compression=None) as out, fs.open_output_stream(f"{base}/{name}.idx.jsonl", compression=None) as index:
                for head, data in records(inflate(f)):
                    member = _gzip(data)
                    out.write(member)
                    rows.append((f"{folder}/{name}", offset, len(member), head["warc-record-id"], head["warc-type"], head.get("warc-target-uri")))
                    index.write(json.dumps({"offset": offset, "length": len(member), "id": rows[-1][3], "type": rows[-1][4], "uri": rows[-1][5]}).encode() + b"\n")
                    offset += len(member)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["path", "offset", "length", "record_id", "record_type", "target_uri"])


@task
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    opened, f = None, None
    for batch in batches:
        rows = []
        for path, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True):
            if path != opened:
                if f is not None:
                    f.close()
                fs, inside = _fs(path)
                opened, f = path, fs.open_input_file(inside)
            data = zlib.decompress(f.read_at(length, offset), 31)
            end = data.index(b"\r\n\r\n")
            head = parse(data[:end])
            block = data[end + 4 : end + 4 + int(head["content-length"])]
            payload = block[block.index(b"\r\n\r\n") + 4 :]
            kind, said = head["warc-type"], base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
            if kind == "response" and hashlib.sha1(payload).hexdigest() != said:
                raise ValueError(f"{head['warc-record-id']} in {path}: the payload hasn't got its digest")
            number = lambda x: int(x[len("<urn:x-page:") : -1]) if x and x.startswith("<urn:x-page:") else None
            rows.append((number(head["warc-record-id"]), kind, head.get("warc-target-uri"), number(head.get("warc-refers-to")), said, payload if kind == "response" else None))
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["page_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload"])
    if f is not None:
        f.close()


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, refers_to): of equal payloads of LEAST_SHARED bytes or more all but the
    largest page_id refer to it. The classes are maxima combined before the shuffle; only classes of more than
    one row are joined back. Rows that repeat the largest page_id are all responses, as is a class without ids."""
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", F.sha1(F.coalesce("html", F.lit(""))).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size"))
    keyed = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.sha1(F.coalesce("html", F.lit(""))).alias("d"), F.octet_length(F.coalesce("html", F.lit(""))).alias("s")).where(f"s >= {LEAST_SHARED}")
    shared = keyed.groupBy("d", "s").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1 and top is not null").select("d", "s", "top")
    shared = materialize(shared, "warc-shared")
    if shared.count() <= BROADCAST_CLASSES:
        shared = F.broadcast(shared)
    joined = own.join(shared, (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s")), "left")
    return joined.select("page_id", "url", "html", "digest", F.expr("if(page_id = top, null, top)").alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(path, n_records) of archives of about archive_bytes each, one gzip stream a file, of pages as
    with_revisits gives them. A null html is an empty payload; a null url has no target; an empty table writes
    nothing. The folder must be one that all executors share and that Arrow's file systems can open."""
    bounded_batches(pages.sparkSession)
    return materialize(pages.mapInArrow(partial(_write, folder=folder, date=date, limit=archive_bytes), "path string, n_records bigint"), "warc-written")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """The offset index (path, offset, length, record_id, record_type, target_uri) of the archives (path) after
    writing each again with a gzip member for every record, beside a sidecar index file. Each file is inflated
    once, as a stream; files are dealt evenly, so one row is one task's unit."""
    n = archives.count()
    return materialize(archives.select("path").repartition(max(1, n)).mapInArrow(partial(_normalise, folder=folder), INDEX), "warc-index")


def read_records(index: DataFrame) -> DataFrame:
    """(page_id, record_type, target_uri, refers_to, payload_digest, payload) of the records of an index, each
    opened by its offset; a revisit's payload is null. A payload that hasn't got its digest is an error."""
    return index.select("path", "offset", "length").mapInArrow(_read, "page_id bigint, record_type string, target_uri string, refers_to bigint, payload_digest string, payload binary")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of pages (page_id, url, html) written
    to archives in the shared folder, normalised and read back; a revisit has the size of its response."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/tallyspark/warc-{uuid.uuid4().hex}"
    index = normalise(write_archives(with_revisits(pages), f"{folder}/whole"), f"{folder}/members")
    remove(spark, f"{folder}/whole")
    back = read_records(index).select("page_id", F.length("payload").cast("bigint").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    back = materialize(back, "warc-read")
    sizes = back.where("record_type = 'response' and page_id is not null").join(back.where("refers_to is not null").select(F.col("refers_to").alias("page_id")).distinct(), "page_id", "left_semi").groupBy(F.col("page_id").alias("of")).agg(F.max("payload_bytes").alias("bytes"))
    return back.join(sizes, F.col("refers_to") == F.col("of"), "left").select("page_id", F.coalesce("payload_bytes", "bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
