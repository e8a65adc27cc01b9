import hashlib
import struct

import pytest
import zstandard

from graphloom.llm import warc
from graphloom.llm.common import Scratch, read_file

SCHEMA = "page_id long, url string, html string, digest string, extra int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", 1) for i, u, h in rows], SCHEMA)


def test_round_trip(spark):
    big, small = "<p>é" * 500, "<p>" * 300
    rows = [(i, f"http://x/{i}", big) for i in range(40)] + [(i, None, small) for i in range(40, 50)]
    rows += [(50, "a\r\nb: c", None), (51, "", ""), (52, "u", "y" * 300_000), (None, "n", big), (53, "u", "é" * 500), (54, "u", "é" * 500), (54, "u", "é" * 500)]
    files = warc.write(pages(spark, rows).repartition(3), Scratch(spark, "t"))
    got = {}
    for r in warc.read(files).collect():
        got.setdefault(r.page_id, []).append((r.payload_bytes, r.payload_digest, r.record_type, r.refers_to))
    want = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        top = max((j for j, _, g in rows if g == h and j is not None), default=None) if len(raw) >= 1000 else None
        dup = top is not None and top != i
        want.setdefault(i, []).append((len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if dup else "response", top if dup else None))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items()}
    uri = files.first()["uri"]
    data = read_file(uri)
    assert struct.unpack_from("<I", data)[0] == warc.DICTIONARY_MAGIC
    at, _ = next(warc.frames(data))
    for broken in (data[:-3], data[:at] + b"xxxx" + data[at + 4 :]):
        with pytest.raises(warc.Malformed):
            list(warc.frames(broken))
    assert warc.read(warc.write(pages(spark, []), Scratch(spark, "t"))).count() == 0


def test_reader_takes_compressed_dictionary_and_checks_records():
    samples = [f"<html>{i} some text that repeats {i * i}</html>".encode() * 3 for i in range(500)]
    trained = zstandard.train_dictionary(2000, samples)
    c = zstandard.ZstdCompressor(dict_data=trained, write_checksum=True)
    body = warc.record(5, "http://u", b"payload", hashlib.sha1(b"payload").hexdigest(), None, 7)
    held = zstandard.ZstdCompressor().compress(trained.as_bytes())
    data = struct.pack("<II", warc.DICTIONARY_MAGIC, len(held)) + held + c.compress(body) + struct.pack("<II", 0x184D2A51, 3) + b"abc" + c.compress(body)
    assert [warc.parse(x)["payload"] for _, x in warc.frames(data)] == [b"payload"] * 2
    for bad in (body.replace(b"payload\r", b"pAyload\r"), body[:-1], body.replace(b"WARC-Date: ", b"WARC-Data: "), body.replace(b"WARC/1.1", b"WARC/9"), body + b"x", body.replace(b"Length: 7", b"Length: 8")):
        with pytest.raises(warc.Malformed):
            warc.parse(bad)


def foreign(kind, block, *fields, content="application/warc-fields"):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{kind}-{len(block)}>", "WARC-Date: 2020-02-02T02:02:02Z", f"Content-Type: {content}", *fields, f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_records_of_other_writers(spark, tmp_path):
    http = "application/http; msgtype=response"
    page = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4\r\nbody\r\n0\r\n\r\n"
    whole = [
        foreign("warcinfo", b"software: other\r\nformat: WARC File Format 1.0\r\n"),
        foreign("request", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n", "WARC-Target-URI: http://x/", content="application/http; msgtype=request"),
        foreign("response", page, "WARC-Target-URI: http://x/", content=http),  # no digest
        foreign("response", b"HTTP/1.0 404 No\r\n\r\nlong without a length", f"WARC-Payload-Digest: sha256:{hashlib.sha256(b'long without a length').hexdigest()}", content=http),
        foreign("revisit", b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\n", "WARC-Refers-To-Target-URI: http://x/", content=http),
        foreign("metadata", b"", f"WARC-Block-Digest: sha1:{hashlib.sha1(b'').hexdigest()}"),
        foreign("resource", b"\x00\xff", f"WARC-Block-Digest: md5:{hashlib.md5(b'\x00\xff').hexdigest()}", content="image/x"),
        foreign("conversion", b"plain text", content="text/plain"),
        warc.record(9, "http://p/9", b"own", hashlib.sha1(b"own").hexdigest(), None, 3),
    ]
    path = tmp_path / "other.warc.zst"
    path.write_bytes(b"".join(zstandard.ZstdCompressor().compress(x) for x in whole))
    files = spark.createDataFrame([(f"file://{path}",)], "uri string")
    got = warc.records(files).orderBy("offset").collect()
    assert [r.record_type for r in got] == ["warcinfo", "request", "response", "response", "revisit", "metadata", "resource", "conversion", "response"]
    assert [r.page_id for r in warc.read(files).collect()] == [9] and got[2].target_uri == "http://x/"
    assert got[2].payload_digest == hashlib.sha1(page.partition(b"\r\n\r\n")[2]).hexdigest() and got[4].payload_bytes == 9
    for bad in (whole[6].replace(b"\xff", b"\xfe"), whole[3].replace(b"without", b"With0ut"), foreign("revisit", b"HTTP/1.1 200 OK\r\n\r\n", content=http)):
        with pytest.raises(warc.Malformed):
            warc.parse(bad)
