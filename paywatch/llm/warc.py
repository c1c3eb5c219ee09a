"""WARC archives: written as one gzip stream, normalised to a member per record, indexed.

``write_archives`` writes monolithic archives, as many crawlers leave them: one gzip stream
over all records, which can only be read from its start. ``normalise`` inflates each such
stream once, in pieces, rewrites every record as its own gzip member and writes a sidecar
index of JSON lines (page id, type, digest, offset, length). ``read_records`` then reads
single members by offset.

Of records with equal payloads of at least LEAST_SHARED bytes, the one with the largest
page id is a ``response``; the others are ``revisit`` records, without the payload, that
refer to it. Payloads are compared by SHA-1 and length.

Files lie in the shared folder. Their names are unique per attempt and only those that a
finished task reports are used, so a lost executor leaves at most an unused file behind.
A task holds one record, never a whole archive.

Cases: a null html is an empty payload and a null url is left out. A null page id is below
all others and refers to the largest, a group without any id has only responses. Repeated
rows (equal id and payload) are records of their own; all that carry the largest id are
responses. Other columns are not written.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha1
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywatch.runtime import scratch_path, settled

LEAST_SHARED = 1000
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 20
GZIP = 31
ID, PROFILE = "urn:page:", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest and, for revisits, the page referred to."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    keyed = rows.withColumns({"digest": F.sha1("payload"), "bytes": F.length("payload")})
    shared = (
        keyed.filter(F.col("bytes") >= LEAST_SHARED)
        .groupBy("digest", "bytes")
        .agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    # Only payloads that occur twice; written, so that a crowded one can be split.
    shared = settled(shared, "payloads")
    revisits = F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    return keyed.join(shared, ["digest", "bytes"], "left").select("page_id", "url", "payload", "digest", revisits.alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record with an HTTP response; a revisit keeps the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>"]
    if page_id is not None:
        head.append(f"WARC-Page-ID: <{ID}{page_id}>")
    if url:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]|"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{ID}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}


def parsed(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    """Page id, payload bytes, digest, type and page referred to, from the record's own bytes."""
    head, _, body = raw.partition(b"\r\n\r\n")
    warc = headers(head)
    body = body[: int(warc["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    number = lambda name: int(warc[name].strip("<>").removeprefix(ID)) if name in warc else None
    if warc["warc-type"] == "revisit":
        size, digest = int(headers(http)["content-length"]), warc["warc-payload-digest"].removeprefix("sha1:")
    else:
        size, digest = len(payload), sha1(payload).hexdigest()
    return number("warc-page-id"), size, digest, warc["warc-type"], number("warc-refers-to")


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Cut inflated bytes into whole records by their Content-Length."""
    held, need = bytearray(), 0
    for chunk in chunks:
        held += chunk
        while len(held) >= need:
            end = held.find(b"\r\n\r\n")
            if end < 0:
                need = len(held) + 1
                break
            need = end + 4 + int(headers(bytes(held[:end]))["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 1
    if held:
        raise ValueError(f"{len(held)} bytes of an incomplete record at the end of the stream")


def inflated(source: pa.NativeFile) -> Iterator[bytes]:
    """The bytes of a gzip file, in pieces; of all its members if there are several."""
    inflater = zlib.decompressobj(GZIP)
    while data := source.read(CHUNK):
        while data:
            yield inflater.decompress(data, 4 * CHUNK)
            while inflater.unconsumed_tail:
                yield inflater.decompress(inflater.unconsumed_tail, 4 * CHUNK)
            data = inflater.unused_data
            if inflater.eof:
                inflater = zlib.decompressobj(GZIP)
    if tail := inflater.flush():
        yield tail


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def write_archives(rows: DataFrame, folder: str, most: int = ARCHIVE_BYTES, level: int = 6) -> DataFrame:
    """Write the rows of ``with_revisits`` as monolithic archives; a row (archive) for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(folder)
        system.create_dir(base, recursive=True)
        name, out, deflater, size = "", None, None, 0
        for batch in batches:
            for k in range(batch.num_rows):
                if out is None:
                    name, size = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out, deflater = system.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(level, zlib.DEFLATED, GZIP)
                raw = record(*(batch.column(i)[k].as_py() for i in range(5)))
                out.write(deflater.compress(raw))
                size += len(raw)
                if size >= most:
                    out.write(deflater.flush())
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"]})
        if out is not None:
            out.write(deflater.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"]})

    return settled(rows.mapInArrow(run, "archive string"), "archives")


def _per_file(files: DataFrame) -> DataFrame:
    """One task per archive, up to the files there are."""
    return files.repartition(max(1, files.count()))


def normalise(archives: DataFrame, level: int = 6) -> DataFrame:
    """Rewrite every archive with a member per record and a sidecar index: (archive, index)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                target = path.removesuffix(".warc.gz") + f"-{uuid.uuid4().hex[:8]}-members.warc.gz"
                system, source = opened(path)
                place = opened(target)[1]
                offset = 0
                with (
                    system.open_input_stream(source, compression=None) as data,
                    system.open_output_stream(place, compression=None) as out,
                    system.open_output_stream(f"{place}.idx", compression=None) as index,
                ):
                    for raw in records(inflated(data)):
                        deflater = zlib.compressobj(level, zlib.DEFLATED, GZIP)
                        member = deflater.compress(raw) + deflater.flush()
                        out.write(member)
                        page, size, digest, kind, refers_to = parsed(raw)
                        line = {"page_id": page, "type": kind, "digest": digest, "bytes": size, "refers_to": refers_to, "offset": offset, "length": len(member)}
                        index.write(json.dumps(line).encode() + b"\n")
                        offset += len(member)
                yield pa.RecordBatch.from_pydict({"archive": [target], "index": [f"{target}.idx"]})

    return settled(_per_file(archives).mapInArrow(run, "archive string, index string"), "members")


def read_records(members: DataFrame) -> DataFrame:
    """Every record, read by its index entry and parsed from its own bytes."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, place = opened(path)
                rows = []
                with system.open_input_file(place) as data, system.open_input_stream(opened(index)[1], compression=None, buffer_size=CHUNK) as lines:
                    held = b""
                    while chunk := lines.read(CHUNK):
                        *whole, held = (held + chunk).split(b"\n")
                        for line in whole:
                            entry = json.loads(line)
                            data.seek(entry["offset"])
                            rows.append(parsed(zlib.decompress(data.read(entry["length"]), GZIP)))
                        for at in range(0, len(rows), 10_000):
                            columns = zip(*rows[at : at + 10_000])
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
                        rows = []

    return _per_file(members).mapInArrow(run, RECORD)


def archived(pages: DataFrame) -> DataFrame:
    """Write the pages, normalise the archives, and read them back."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read_records(normalise(write_archives(with_revisits(pages), folder)))
