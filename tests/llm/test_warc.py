import hashlib
import io
import struct

import pytest
import zstandard

from fathom.llm import warc
from fathom.llm.warc import DamagedArchive, archived, decode_record, encode_record, frames, read_archives, write_archives
from fathom.session import new_path

from .conftest import words

SCHEMA = "page_id long, url string, html string"
LONG = "<p>" + words(1, 60)
ROWS = [
    (5, "http://a/5", LONG), (3, "http://a/3", LONG), (9, None, LONG), (1, "http://a b/\r\nX: y", "short"), (2, "u", "short"),
    (4, "u", None), (6, "u", ""), (7, "u", "é" * 50), (8, "u", "é" * 50), (10, "u", "y" * 99), (11, "u", "y" * 99), (None, "u", LONG),
    (12, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 20), (3, "http://a/3", LONG), (13, "u", words(2, 30000)),
]


def expected():
    first = {}
    for i, _, h in ROWS:
        data = (h or "").encode()
        if len(data) >= 100 and i is not None:
            first[data] = min(i, first.get(data, i))
    out = []
    for i, _, h in ROWS:
        data = (h or "").encode()
        to = first.get(data)
        revisit = to is not None and to != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    listed = write_archives(pages, new_path(spark, "warc"))
    got = read_archives(listed).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected()
    by = {r.page_id: r for r in got}
    assert by[13].payload == ROWS[-1][2].encode() and by[5].payload is None and by[9].url is None
    assert by[1].url == "http://a%20b/%0D%0AX:%20y"
    assert sum(r.records for r in listed.collect()) == len(ROWS)
    slim = archived(pages.withColumn("payload", pages.url).withColumn("digest", pages.url))
    assert "payload" not in slim.columns and slim.count() == len(ROWS)
    assert archived(pages.limit(0)).count() == 0


def test_archives_roll_over_and_share_a_dictionary(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "SAMPLE_BYTES", 60_000)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 150_000)
    records = [encode_record(k, "u", words(k % 50, 100).encode(), hashlib.sha256(words(k % 50, 100).encode()).hexdigest(), None, False, "d") for k in range(400)]
    stream, paths = iter(records), []
    while written := warc._write_archive(f"file://{tmp_path}", stream):
        paths.append(written)
    assert len(paths) > 2 and sum(n for _, n in paths) == 400 and not list(tmp_path.glob("*.part"))
    found = []
    for path, _ in paths:
        data = open(path.removeprefix("file://"), "rb").read()
        magic, size = struct.unpack("<II", data[:8])
        assert magic == 0x184D2A5D and size > 1000 and zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])[:4] == b"\x37\xa4\x30\xec"
        found += [decode_record(d, path)["page_id"] for _, d in frames(io.BytesIO(data), path)]
    assert found == list(range(400))


def archive(records, dictionary=b""):
    packer = zstandard.ZstdCompressor(write_checksum=True)
    return struct.pack("<II", 0x184D2A5D, len(dictionary)) + dictionary + b"".join(map(packer.compress, records))


def good(payload=b"hello", **change):
    data = encode_record(1, "u", payload, hashlib.sha256(payload).hexdigest(), None, False, "2024-01-01T00:00:00Z")
    for old, new in change.get("replace", ()):
        assert old in data
        data = data.replace(old, new, 1)
    return data


def test_sound_archives_are_read():
    assert [d for _, d in frames(io.BytesIO(archive([good(), good(b"")])), "x")] == [good(), good(b"")]
    assert list(frames(io.BytesIO(b""), "x")) == [] and list(frames(io.BytesIO(archive([])), "x")) == []
    one = io.BytesIO(zstandard.ZstdCompressor().compress(good()))
    assert len(list(frames(one, "x"))) == 1
    assert decode_record(good(), "x")["payload"] == b"hello"


@pytest.mark.parametrize(
    "replace",
    [
        [(b"WARC/1.1", b"WARC/9.9")], [(b"WARC-Date", b"WARC-Dote")], [(b"Content-Length: 83", b"Content-Length: 82")],
        [(b"hello", b"hullo")], [(b"WARC-Type: response", b"WARC-Type: revisit")], [(b"WARC-Type: response", b"WARC-Type: other")],
        [(b"\r\n\r\nhello\r\n\r\n", b"\r\n\r\nhello")], [(b"WARC-Type", b"WARC Type\r\nx")], [(b"Payload-Digest: sha256:", b"Payload-Digest: sha256:0")],
        [(b"WARC-Date: ", b"Content-Length: 1\r\nWARC-Date: ")],
    ],
)
def test_damaged_records_are_refused(replace):
    with pytest.raises(DamagedArchive):
        decode_record(good(replace=replace), "x")


def test_damaged_archives_are_refused():
    whole = archive([good(), good(words(3, 500).encode())])
    for broken in (whole[:-9], whole[:6], whole + b"tail", whole[:40] + b"\0" + whole[41:], archive([], b"")[:4] + struct.pack("<I", 99)):
        with pytest.raises(DamagedArchive):
            list(frames(io.BytesIO(broken), "x"))
