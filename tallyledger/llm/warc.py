"""WARC archives: pages written as one gzip stream per archive, normalised to one member per record with an index.

An archive is a row (archive, data) of a table, so that any store Spark can write holds it; save_archives
writes the same bytes as files. Defined results: null html is an empty payload; a null url is empty; payloads
under 100 bytes are never revisits; of equal payloads the smallest page_id is the response (rows that share
it all are, and share a record id); a null page_id comes last; an empty table gives no archives; a record of any size is
read in time that grows with its length; extra columns are ignored. The target URI is the url with only those characters
escaped that no URI may hold; a url that this changes is kept besides, in a field of its own, and read back from there.
"""

from __future__ import annotations

import hashlib
import re
import urllib.parse
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tallyledger.llm.text import ready_workers, table
from tallyledger.sources.scratch import written_once

LEAST_REVISIT = 100
# Records' bytes in one archive before the next begins; a single larger record still is one archive.
ARCHIVE_BYTES = 8 << 20
_GZIP = 31  # zlib's window bits for gzip framing
_STEP = 1 << 16
INDEX = "array<struct<record: int, at: bigint, length: bigint, type: string, page: string>>"
_INDEX_TYPE = pa.list_(
    pa.struct([("record", pa.int32()), ("at", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("page", pa.string())])
)


def mark_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest and first (the response's page_id for revisits, else null).

    The digests that repeat are counted with a map-side part; only they, once each, meet the pages again.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    long = F.octet_length("html") >= LEAST_REVISIT
    first = rows.where(long).groupBy("digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    first = first.where("_n > 1").select(F.col("digest").alias("_digest"), "_first")
    later = ~F.col("page_id").eqNullSafe(F.col("_first"))
    return rows.join(first, F.col("digest") == F.col("_digest"), "left").select(
        "page_id", "url", "html", "digest", F.when(F.col("_first").isNotNull() & later, F.col("_first")).alias("first")
    )


def _uri(url: str) -> str:
    """The url with what no URI may hold escaped; escapes it has stay as they are."""
    quoted = urllib.parse.quote(url, safe=":/?#[]@!$&'()*+,;=%")
    return re.sub("%(?![0-9A-Fa-f]{2})", "%25", quoted)


def _record(page: int | None, url: str, payload: bytes, digest: str, first: int | None) -> bytes:
    name = "" if page is None else page
    uri = _uri(url)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if uri != url:
        lines.append(f"Page-URL: {urllib.parse.quote(url, safe='')}")
    if first is not None:
        lines += [
            f"WARC-Refers-To: <urn:page:{first}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    block = head + payload if first is None else head
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _head(data: bytes | bytearray, at: int) -> tuple[dict[str, str], int] | None:
    """Header fields (lower-case names) of the record at a place and where its block begins; None if not all there."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return None
    lines = data[at:end].decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record at byte {at}: {lines[0][:40]!r}")
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}, end + 4


def records_of(stream: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of gzip data, whole-file or by member, inflated once and in steps: header fields and the record's bytes."""
    inflate, held, at, need = zlib.decompressobj(_GZIP), bytearray(), 0, 0
    view = memoryview(stream)
    for k in range(0, len(view), _STEP):
        data = bytes(view[k : k + _STEP])
        while data:
            held += inflate.decompress(data)
            data = inflate.unused_data
            if inflate.eof and (data or k + _STEP < len(view)):
                inflate = zlib.decompressobj(_GZIP)
        # A record whose length is known is not looked at again before all of it is there.
        while len(held) >= need and (found := _head(held, at)) is not None:
            fields, block = found
            end = block + int(fields["content-length"]) + 4
            if end > len(held):
                need = end
                break
            with memoryview(held) as all_held:
                record = bytes(all_held[at:end])
            yield fields, record
            at = need = end
        del held[:at]
        at, need = 0, max(need - at, 0)
    if held or not inflate.eof and len(view):
        raise ValueError("the archive ends inside a record")


def write_archives(marked: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """archive, data: each archive one whole-file gzip stream, as a plain compressor leaves it."""
    ready_workers(marked.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        out, size, gzip = [], 0, None

        def closed() -> pa.RecordBatch:
            data = b"".join([*out, gzip.flush()])
            return pa.RecordBatch.from_pydict({"archive": [f"{part:06d}-{number:06d}"], "data": pa.array([data], pa.binary())})

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "digest", "first")]
            for row in zip(*columns, strict=True):
                page, url, html, digest, first = (x.as_py() for x in row)
                record = _record(page, url or "", html.encode(), digest, first)
                gzip = gzip or zlib.compressobj(1, zlib.DEFLATED, _GZIP)
                out.append(gzip.compress(record))
                size += len(record)
                if size >= archive_bytes:
                    yield closed()
                    out, size, gzip, number = [], 0, None, number + 1
        if gzip:
            yield closed()

    return marked.mapInArrow(run, "archive string, data binary")


def normalise(archives: DataFrame) -> DataFrame:
    """archive, data, index: the stream inflated once, every record a gzip member of its own, and where each lies."""
    ready_workers(archives.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("archive"), batch.column("data"), strict=True):
                members, index, at = [], [], 0
                for fields, record in records_of(data.as_py()):
                    gzip = zlib.compressobj(6, zlib.DEFLATED, _GZIP)
                    member = gzip.compress(record) + gzip.flush()
                    page = fields["warc-record-id"].removeprefix("<urn:page:").removesuffix(">")
                    index.append({"record": len(index), "at": at, "length": len(member), "type": fields["warc-type"], "page": page})
                    members.append(member)
                    at += len(member)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name.as_py()]), pa.array([b"".join(members)], pa.binary()), pa.array([index], _INDEX_TYPE)],
                    ["archive", "data", "index"],
                )

    return archives.select("archive", "data").mapInArrow(run, f"archive string, data binary, index {INDEX}")


def read_records(normalised: DataFrame) -> DataFrame:
    """Every record by its index entry alone: page_id, url, record_type, payload (null for revisits), payload_bytes,
    payload_digest, refers_to. A payload that does not give the digest of its header is an error."""
    ready_workers(normalised.sparkSession)
    names = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]

    def one(member: bytes) -> tuple:
        fields, record = next(records_of(member))
        block = record[_head(record, 0)[1] : -4]
        page = fields["warc-record-id"].removeprefix("<urn:page:").removesuffix(">")
        digest, size = fields["warc-payload-digest"].removeprefix("sha256:"), int(fields["warc-payload-length"])
        payload, first = None, None
        if fields["warc-type"] == "revisit":
            first = int(fields["warc-refers-to"].removeprefix("<urn:page:").removesuffix(">"))
        else:
            payload = block[block.index(b"\r\n\r\n") + 4 :]
            size = len(payload)
            if hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"the payload of page {page} does not match its digest")
        url = urllib.parse.unquote(fields["page-url"]) if "page-url" in fields else fields["warc-target-uri"]
        return int(page) if page else None, url, fields["warc-type"], payload, size, digest, first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, index in zip(batch.column("data"), batch.column("index"), strict=True):
                whole, entries = data.as_buffer(), index.as_py()
                for k in range(0, len(entries), 256):
                    rows = [one(whole.slice(e["at"], e["length"]).to_pybytes()) for e in entries[k : k + 256]]
                    columns = [pa.array(list(c), kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return normalised.select("data", "index").mapInArrow(
        run,
        "page_id bigint, url string, record_type string, payload binary, payload_bytes bigint, payload_digest string, refers_to bigint",
    )


def index_of(normalised: DataFrame) -> DataFrame:
    """The sidecar: archive, record, at, length, type, page."""
    return normalised.select("archive", F.inline("index"))


def save_archives(normalised: DataFrame, folder: str) -> DataFrame:
    """Write each archive as <archive>.warc.gz with its index beside it, into a shared folder by URI; gives the paths.

    A file is written under another name and moved, so a retried task leaves only whole files. Run it by an action.
    """
    ready_workers(normalised.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for name, data, index in zip(*(batch.column(c) for c in ("archive", "data", "index")), strict=True):
                lines = "".join(f"{e['page']}\t{e['type']}\t{e['at']}\t{e['length']}\n" for e in index.as_py())
                path = f"{base}/{name.as_py()}.warc.gz"
                for target, body in ((path, data.as_buffer()), (f"{path}.idx", lines.encode())):
                    with store.open_output_stream(f"{target}.{attempt}", compression=None) as out:
                        out.write(body)
                    store.move(f"{target}.{attempt}", target)
                yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([len(index.as_py())], pa.int64())})

    return normalised.mapInArrow(run, "path string, records bigint")


def op9_warc(spark, sf_dir: str) -> DataFrame:
    archives = write_archives(mark_revisits(table(spark, sf_dir, "pages")))
    stored = written_once(normalise(archives))
    return read_records(stored).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
