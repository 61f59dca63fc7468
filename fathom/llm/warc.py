"""WARC archives of pages as Zstandard files: one frame per record, one dictionary per archive.

An archive begins with a skippable frame that holds the dictionary (itself a frame, or plain), followed
by one frame for each record. Tasks write archives of bounded size straight to a shared folder, under
a name of their own, and give them their final name when they are whole; the list of archives that
Spark keeps names only those of tasks that succeeded, so a repeated task leaves at most an unlisted file.

The reader streams an archive frame by frame: memory is bounded by the largest record. It checks every
record and raises ``DamagedArchive`` with place and reason instead of skipping anything.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.session import materialise, new_path

from .batches import column_of

ARCHIVE_BYTES = 64 << 20
SAMPLE_BYTES = 2 << 20
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
REVISIT_BYTES = 100
# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class DamagedArchive(ValueError):
    """An archive that breaks the format; the message says where and how."""


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def encode_record(page_id, url: str | None, payload: bytes, digest: str, first_id, revisit: bool, date: str) -> bytes:
    """A response, or a revisit without payload that names the record it repeats."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("WARC-Profile", REVISIT_PROFILE if revisit else None),
        ("WARC-Refers-To", record_id(first_id, digest) if revisit else None),
        ("X-Page-ID", None if page_id is None else str(page_id)),
        ("X-Refers-To-Page-ID", str(first_id) if revisit else None),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in fields if v is not None)
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes, place: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise DamagedArchive(f"{place}: {line[:80]!r} is no header")
        name = name.decode("ascii", "replace").lower()
        if name in found:
            raise DamagedArchive(f"{place}: header {name} is repeated")
        found[name] = value.strip().decode("utf-8", "replace")
    return found


def _number(fields: dict[str, str], name: str, place: str) -> int:
    value = fields.get(name, "")
    if not value.isascii() or not value.isdigit():
        raise DamagedArchive(f"{place}: {name} is {value!r}")
    return int(value)


def decode_record(data: bytes, place: str) -> dict:
    """A validated record: its headers, lengths and digests must agree with its content."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if version != VERSION or not gap:
        raise DamagedArchive(f"{place}: begins with {version[:20]!r}")
    fields = _fields(lines, place)
    for name in REQUIRED:
        if not fields.get(name):
            raise DamagedArchive(f"{place}: no {name}")
    length = _number(fields, "content-length", place)
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise DamagedArchive(f"{place}: {len(rest) - 4} bytes of content, the header says {length}")
    block = rest[:length]
    if fields.get("warc-block-digest") != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise DamagedArchive(f"{place}: the block has another digest")
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        raise DamagedArchive(f"{place}: type {kind!r}")
    answer, gap, payload = block.partition(b"\r\n\r\n")
    status, _, lines = answer.partition(b"\r\n")
    if not gap or not status.startswith(b"HTTP/"):
        raise DamagedArchive(f"{place}: no HTTP header")
    size = _number(_fields(lines, place), "content-length", place)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise DamagedArchive(f"{place}: the payload has another length or digest")
    if kind == "revisit" and (payload or not re.fullmatch("[0-9a-f]{64}", digest) or not fields.get("warc-refers-to")):
        raise DamagedArchive(f"{place}: a revisit with a payload, or without a digest or reference")
    page, first = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
    return {
        "page_id": None if page is None else int(page), "url": fields.get("warc-target-uri"), "record_type": kind,
        "refers_to": None if first is None else int(first), "payload_bytes": size, "payload_digest": digest,
        "payload": payload if kind == "response" else None,
    }


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path) if ":" in path else f"file://{path}")


def _dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """Trained on an archive's first records; none if they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8)
    except zstandard.ZstdError:
        return None


def _write_archive(folder: str, records: Iterator[bytes]) -> tuple[str, int] | None:
    """Write records up to the archive's size; its path and number of records, nothing without any."""
    head, size = [], 0
    for record in records:
        head.append(record)
        size += len(record)
        if size >= SAMPLE_BYTES:
            break
    if not head:
        return None
    store, base = _filesystem(folder)
    name = f"{base}/{uuid.uuid4().hex}.warc.zst"
    dictionary, count = _dictionary(head), 0
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True, write_content_size=True)
    with store.open_output_stream(f"{name}.part", compression=None) as out:
        packed = b"" if dictionary is None else zstandard.ZstdCompressor(level=19).compress(dictionary.as_bytes())
        out.write(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
        for record in head:
            out.write(packer.compress(record))
            count += 1
        if size < ARCHIVE_BYTES:
            for record in records:
                out.write(packer.compress(record))
                count += 1
                size += len(record)
                if size >= ARCHIVE_BYTES:
                    break
    store.move(f"{name}.part", name)
    return f"{folder}/{name.rsplit('/', 1)[1]}", count


def write_archives(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str | None = None
) -> DataFrame:
    """Write a record for each row and return the list of archives: ``archive``, ``records``.

    Null html is an empty payload. Of records with equal payloads of ``REVISIT_BYTES`` bytes or more,
    those with the smallest ``page_id`` are responses (all rows that repeat this number) and the others
    revisit it; if no number is known, and below that size, all are responses. Null numbers and
    addresses are left out of the record; control characters in an address are escaped. Other columns
    are ignored. An empty table gives no archive.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    repeated = (
        rows.where(F.octet_length("payload") >= REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1 AND first_id IS NOT NULL")
    )
    repeated = materialise(repeated.select("digest", "first_id"), "repeated")
    records = rows.join(repeated, "digest", "left").select(
        "page_id", "url", "payload", "digest", "first_id",
        F.expr("first_id IS NOT NULL AND NOT (page_id <=> first_id)").alias("revisit"),
    )
    stamp = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    store, base = _filesystem(folder)
    store.create_dir(base, recursive=True)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            columns = [column_of(batch, n) for n in ("page_id", "url", "payload", "digest", "first_id", "revisit")]
            for row in zip(*columns):
                yield encode_record(*(x.as_py() for x in row), stamp)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = encoded(batches)
        while written := _write_archive(folder, records):
            yield pa.RecordBatch.from_pydict({"archive": [written[0]], "records": pa.array([written[1]], pa.int64())})

    return materialise(records.mapInArrow(run, "archive string, records long"), "archives")


def frames(stream, place: str) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each record frame of an open archive."""
    data, offset = b"", 0

    def need(n: int) -> bytes:
        nonlocal data
        while len(data) < n and (more := stream.read(1 << 20)):
            data += more
        return data

    dictionary = None
    head = need(8)
    if len(head) >= 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_MAGIC:
        (size,) = struct.unpack("<I", head[4:8])
        if len(need(8 + size)) < 8 + size:
            raise DamagedArchive(f"{place}: ends in its dictionary")
        packed, data, offset = data[8 : 8 + size], data[8 + size :], 8 + size
        if packed.startswith(FRAME_MAGIC):
            packed = zstandard.ZstdDecompressor().decompressobj().decompress(packed)
        dictionary = zstandard.ZstdCompressionDict(packed) if packed else None
    unpacker = zstandard.ZstdDecompressor(dict_data=dictionary)
    while need(1):
        if need(4)[:4] != FRAME_MAGIC:
            raise DamagedArchive(f"{place} at {offset}: no frame begins here")
        one, parts, used = unpacker.decompressobj(), [], 0
        try:
            while not one.eof:
                if not need(1):
                    raise DamagedArchive(f"{place} at {offset}: ends in a frame")
                used += len(data)
                parts.append(one.decompress(data))
                data = one.unused_data
        except zstandard.ZstdError as error:
            raise DamagedArchive(f"{place} at {offset}: {error}") from error
        yield offset, b"".join(parts)
        offset += used - len(data)


def read_archives(archives: DataFrame, path: str = "archive", payloads: bool = True) -> DataFrame:
    """The records of all archives that a column lists, validated; ``payload`` only if wanted.

    Each row is a record: ``page_id``, ``url``, ``record_type``, ``refers_to``, ``payload_bytes`` and
    ``payload_digest`` of the full payload, and the ``payload`` of a response.
    """
    fields = [
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), *([("payload", pa.binary())] if payloads else []),
    ]
    schema = pa.schema(fields)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in column_of(batch, path).to_pylist():
                store, name = _filesystem(place)
                rows, size = [], 0
                with store.open_input_stream(name, compression=None) as stream:
                    for offset, data in frames(stream, place):
                        record = decode_record(data, f"{place} at {offset}")
                        rows.append({n: record[n] for n in names})
                        size += len(data) if payloads else 200
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"
    parts = max(1, archives.count())
    return archives.select(path).repartition(parts).mapInArrow(run, kinds + (", payload binary" if payloads else ""))


def archived(pages: DataFrame, **columns) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back without payloads."""
    return read_archives(write_archives(pages, new_path(pages.sparkSession, "warc"), **columns), payloads=False)
