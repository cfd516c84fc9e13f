"""WARC archives: writing, normalising whole-file gzip streams to one member a record, reading by offset.

`write_archives` makes archives that are each one gzip stream, as some crawlers do: nothing in them can be
read without inflating all that comes before. `normalise` inflates each stream once, from start to end
in pieces, writes every record as a gzip member of its own, and a sidecar index with a line for each
member. `read_archives` then reads members by their offsets, in spans that different tasks can take.

Files are opened with pyarrow.fs by URI, in the folder that driver and executors share. A task that is
run again writes files under new names; only files named in the written manifest count.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.grouping import attach
from tracewell.session import materialise, shared_dir

#: Bytes inflated at a time.
PIECE = 1 << 20
#: Records of an archive; a task with more begins another archive.
ARCHIVE_RECORDS = 20_000
#: Members that one row of the normaliser's manifest names.
SPAN = 2_000
_GZIP = 31
# Fixed values of the format.
_VERSION = b"WARC/1.1\r\n"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri:
        return fs.LocalFileSystem(), re.sub(r"^file:", "", uri)
    return fs.FileSystem.from_uri(uri)


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A response record, or a revisit record, which has the HTTP header of the payload but not the payload.

    A response is named by its digest, as each payload has one, so that revisits can refer to it.
    """
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    response = uuid.uuid5(uuid.NAMESPACE_URL, f"sha1:{digest}")
    lines = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4() if revisit else response}>", "WARC-Date: 2000-01-01T00:00:00Z"]
    lines += [f"WARC-Target-URI: {quote(url or '', safe=_URI)}"] * (url is not None)
    lines += [f"WARC-Payload-Digest: sha1:{digest}"] + [f"Page-ID: {page_id}"] * (page_id is not None)
    if revisit:
        lines += [f"WARC-Profile: {_REVISIT_PROFILE}", f"WARC-Refers-To: <urn:uuid:{response}>"] + [f"Refers-To-Page-ID: {refers_to}"] * (refers_to is not None)
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return _VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_URI = ":/?#[]@!$&'()*+,;=%-._~"


def parse_header(head: bytes) -> dict[str, str]:
    """Fields of a header block, names in lower case; the first of a repeated field counts."""
    out: dict[str, str] = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            out.setdefault(name.decode("latin-1").strip().lower(), value.decode("utf-8", "replace").strip())
    return out


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
    """Header and raw bytes (header to closing blank lines, in pieces) of each record of an inflated stream.

    The bytes of a record have to be used up before the next is asked for. Raises ValueError where the
    stream is no WARC or is cut off.
    """
    held = b""

    def more() -> bool:
        nonlocal held
        piece = next(pieces, None)
        if piece is None:
            return False
        held += piece
        return True

    while True:
        while not held.strip(b"\r\n"):
            held = b""
            if not more():
                return
        held = held.lstrip(b"\r\n")
        while (stop := held.find(b"\r\n\r\n")) < 0:
            if not more():
                raise ValueError("a record's header is cut off")
        if not held.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = held[: stop + 4]
        fields = parse_header(head)
        left = int(fields["content-length"])
        held = held[stop + 4 :]

        def body() -> Iterator[bytes]:
            nonlocal held, left
            yield head
            while left:
                if not held and not more():
                    raise ValueError("a record's block is cut off")
                part, held = held[:left], held[left:]
                left -= len(part)
                yield part
            yield b"\r\n\r\n"

        yield fields, body()


def inflate(stream, size: int = PIECE) -> Iterator[bytes]:
    """The content of a gzip file of one or many members, in pieces."""
    inflater = zlib.decompressobj(_GZIP)
    while data := stream.read(size):
        while data:
            piece = inflater.decompress(data, size)
            if piece:
                yield piece
            if inflater.eof:
                data = inflater.unused_data
                inflater = zlib.decompressobj(_GZIP)
            else:
                data = inflater.unconsumed_tail
    if piece := inflater.flush():
        yield piece


def write_archives(rows: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Writes archives of one gzip stream each from rows (page_id, url, payload, digest, refers_to, revisit); returns their names and record counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, count, squeeze = None, "", 0, None

        def close() -> pa.RecordBatch:
            out.write(squeeze.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count])], names=["archive", "records"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    store, path = filesystem(folder)
                    store.create_dir(path)
                    name, count, squeeze = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, zlib.compressobj(level, zlib.DEFLATED, _GZIP)
                    out = store.open_output_stream(filesystem(name)[1], compression=None)
                out.write(squeeze.compress(record(*row)))
                count += 1
                if count == ARCHIVE_RECORDS:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return rows.select("page_id", "url", "payload", "digest", "refers_to", "revisit").mapInArrow(run, "archive string, records long")


def normalise_archive(archive: str, target: str, level: int = 6) -> Iterator[tuple[str, str, int, int, int]]:
    """Rewrites one archive as target, a member a record, with the index target.idx.

    Yields, for each SPAN of members: target, index, byte range in the index, members. An index line is
    JSON: offset and length of the member, and the record's type and target.
    """
    source, path = filesystem(archive)
    store, to = filesystem(target)
    index = f"{target}.idx"
    with source.open_input_stream(path, compression=None) as stream, store.open_output_stream(to, compression=None) as out, store.open_output_stream(filesystem(index)[1], compression=None) as side:
        at = line_at = span_at = members = 0
        for fields, pieces in records(inflate(stream)):
            squeeze, length = zlib.compressobj(level, zlib.DEFLATED, _GZIP), 0
            for piece in pieces:
                length += out.write(part) if (part := squeeze.compress(piece)) else 0
            length += out.write(squeeze.flush())
            line = json.dumps({"offset": at, "length": length, "type": fields.get("warc-type"), "uri": fields.get("warc-target-uri")}).encode() + b"\n"
            side.write(line)
            at, line_at, members = at + length, line_at + len(line), members + 1
            if members == SPAN:
                yield target, index, span_at, line_at, members
                span_at, members = line_at, 0
        if members:
            yield target, index, span_at, line_at, members


_SPANS = "archive string, index string, index_start long, index_end long, members long"


def normalise(archives: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Normalises the archives named in the column archive; returns a row for each span of members (see normalise_archive)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                store, path = filesystem(folder)
                store.create_dir(path)
                spans = list(normalise_archive(archive, f"{folder}/{uuid.uuid4().hex}.warc.gz", level))
                columns = list(zip(*spans)) if spans else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()])], names=[f.split()[0] for f in _SPANS.split(", ")])

    return archives.select("archive").mapInArrow(run, _SPANS)


def read_member(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and payload of one member."""
    content = zlib.decompress(raw, _GZIP)
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = parse_header(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, parse_header(http), payload


_RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(spans: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the spans, read member by member at the offsets of the index.

    payload_bytes and payload_digest are of the full payload: taken from the payload of a response, whose
    digest has to equal the header's (else ValueError), and from the headers of a revisit. payloads
    False leaves the column payload null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = [f.split()[0] for f in _RECORD.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for archive, index, low, high in zip(*(c.to_pylist() for c in batch.columns)):
                store, path = filesystem(archive)
                with store.open_input_file(filesystem(index)[1]) as side:
                    lines = side.read_at(high - low, low).splitlines()
                rows, held = [], 0
                with store.open_input_file(path) as members:
                    for line in lines:
                        entry = json.loads(line)
                        fields, http, payload = read_member(members.read_at(entry["length"], entry["offset"]))
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        revisit = fields["warc-type"] == "revisit"
                        if not revisit and payload_digest(payload) != digest:
                            raise ValueError(f"payload of {fields['warc-record-id']} in {archive} is damaged")
                        number = lambda name, f=fields: int(f[name]) if name in f else None
                        rows.append((number("page-id"), fields.get("warc-target-uri"), payload if payloads and not revisit else None, int(http["content-length"]) if revisit else len(payload), digest, fields["warc-type"], number("refers-to-page-id")))
                        held += len(payload) * payloads
                        if held > PIECE or len(rows) == SPAN:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return spans.select("archive", "index", "index_start", "index_end").mapInArrow(run, _RECORD)


def _digested(pages: DataFrame, with_payload: bool) -> DataFrame:
    """(page_id, url, payload, digest) of (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payload = [x or b"" for x in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(payload if with_payload else [None] * len(payload), pa.binary()), pa.array([payload_digest(p) for p in payload], pa.string())], names=["page_id", "url", "payload", "digest"])

    return pages.mapInArrow(run, "page_id long, url string, payload binary, digest string")


def deduplicated(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Rows for write_archives: of equal payloads the one with the smallest id is a response, others revisit it."""
    named = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    rows = attach(_digested(named, True), "digest", "page_id", {"_low": F.min("page_id")}, {"_low": F.min("_low")})
    first = F.row_number().over(Window.partitionBy("digest", "_salt", "page_id").orderBy("url")) == 1
    rows = rows.withColumn("revisit", ~(F.col("page_id").eqNullSafe(F.col("_low")) & first))
    return rows.withColumn("refers_to", F.when(F.col("revisit"), F.col("_low"))).drop("_low", "_salt")


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record per page, normalises the archives and reads every record back by its offset.

    The payload is the html in UTF-8; a null or empty one is an empty payload, and empty payloads are
    equal as others are. Returns (page_id, url, payload_bytes, payload_digest, record_type, refers_to)
    per input row. Of repeated rows with the smallest id one is the response, the others revisit that
    id. A null id counts after all others; revisits of it have a null refers_to. A null url is left out
    of its record. Other columns are left out; an empty table gives no archives and no rows.
    """
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc")
    written = materialise(write_archives(deduplicated(pages, id_col, url_col, html_col), f"{folder}/streams"), "warc-manifest")
    parts = max(1, min(written.count(), 100_000))
    spans = materialise(normalise(written.repartition(parts), f"{folder}/members"), "warc-spans")
    parts = max(1, min(spans.count(), 100_000))
    return read_archives(spans.repartition(parts), payloads=False).drop("payload")
