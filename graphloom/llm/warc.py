"""WARC archives in Zstandard: a writer with revisit records, and a reader that validates what it reads.

A file starts with a skippable frame (magic 0x184D2A5D) that holds the file's compression dictionary, plain or
itself compressed; after it comes one frame per record, so that a record can be decoded from its offset alone.
The reader finds the ends of frames from the frames' own block headers.  It checks the version line, the named
fields, the record's length against Content-Length, the end marks, the digests of block and payload where they are
given (SHA-1, SHA-256 or MD5, in base 32 or hex) and, of records that hold HTTP, the header and its length.  It takes
all types of records, those that other writers make too: warcinfo, request, metadata, resource, conversion,
continuation; read() gives pages, records() every record.

Of records with equal payloads of at least REVISIT_BYTES the one with the largest page_id is the response and
the others are revisits that carry the HTTP header alone.

Defined results: a null html is an empty payload; a null url becomes `urn:page:<id>`; a null page_id stays null
(such rows refer to the group's response, and are responses where no row of the group has an id); rows that
repeat the largest page_id are responses all; an empty table writes no file; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, read_file, write_file

REVISIT_BYTES = 1000
#: A file is closed when its frames reach so many bytes.
FILE_BYTES = 16_000_000
#: The dictionary is trained on that many pages at the most, of that many characters each; it only affects sizes.
SAMPLE_PAGES, SAMPLE_CHARS, DICTIONARY_BYTES = 400, 4_000, 32_768
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


class Malformed(ValueError):
    """A file, frame or record breaks the format."""


def frame_end(data: bytes, at: int) -> int:
    """Where the Zstandard frame at `at` ends, from its header and block headers."""
    try:
        (magic,) = struct.unpack_from("<I", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
        elif magic != FRAME_MAGIC:
            raise Malformed(f"no frame at {at}")
        else:
            flags = data[at + 4]
            single = flags >> 5 & 1
            end = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
            last = False
            while not last:
                block = data[end] | data[end + 1] << 8 | data[end + 2] << 16
                last, kind = bool(block & 1), block >> 1 & 3
                if kind == 3:
                    raise Malformed(f"reserved block type at {end}")
                end += 3 + (1 if kind == 1 else block >> 3)
            end += 4 * (flags >> 2 & 1)
    except (struct.error, IndexError):
        raise Malformed(f"the frame at {at} is cut off") from None
    if end > len(data):
        raise Malformed(f"the frame at {at} is cut off")
    return end


def frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of every frame after the dictionary."""
    import zstandard

    at, dictionary = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC:
        at = frame_end(data, 0)
        raw = data[8:at]
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):
            raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 27)
        dictionary = zstandard.ZstdCompressionDict(raw) if raw else None
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(data):
        end = frame_end(data, at)
        if struct.unpack_from("<I", data, at)[0] != FRAME_MAGIC:  # another skippable frame
            at = end
            continue
        try:
            yield at, reader.decompress(data[at:end])
        except zstandard.ZstdError as error:
            raise Malformed(f"the frame at {at}: {error}") from None
        at = end


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    lines = head.decode("utf-8").split("\r\n")
    found: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise Malformed(f"not a header line: {line[:80]!r}")
        found[name.lower()] = value.strip(" \t")
    return lines[0], found


_HASHES = {"sha1": hashlib.sha1, "sha-1": hashlib.sha1, "sha256": hashlib.sha256, "sha-256": hashlib.sha256, "md5": hashlib.md5}


def _digest(value: str) -> tuple[str, str] | None:
    """(algorithm, hex) of a digest field; none where the algorithm is not one that is checked."""
    algorithm, colon, text = value.partition(":")
    make = _HASHES.get(algorithm.lower())
    if not colon or make is None:
        return None
    size = make().digest_size
    try:
        raw = bytes.fromhex(text) if len(text) == 2 * size else base64.b32decode(text.upper() + "=" * (-len(text) % 8))
    except ValueError:
        raise Malformed(f"not a digest: {value[:80]!r}") from None
    if len(raw) != size:
        raise Malformed(f"not a digest: {value[:80]!r}")
    return algorithm.lower(), raw.hex()


def _check(name: str, value: str | None, data: bytes) -> None:
    found = _digest(value) if value else None
    if found and _HASHES[found[0]](data).hexdigest() != found[1]:
        raise Malformed(f"{name} differs")


def parse(content: bytes) -> dict:
    """One record, validated: its fields, and of a response the payload.  `digest` is the payload's SHA-1 as the record
    states it, or as it is where a response states none."""
    head, mark, rest = content.partition(b"\r\n\r\n")
    version, fields = _fields(head)
    if not mark or version not in ("WARC/1.0", "WARC/1.1"):
        raise Malformed(f"not a WARC record: {version[:40]!r}")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise Malformed(f"no {name}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise Malformed("Content-Length and the record's length differ")
    kind, block = fields["warc-type"], rest[:-4]
    _check("the block's digest", fields.get("warc-block-digest"), block)
    payload, length = block, len(block)
    if kind in ("response", "revisit", "request") and fields.get("content-type", "").lower().startswith("application/http"):
        http, mark, payload = block.partition(b"\r\n\r\n")
        first, http_fields = _fields(http)
        if not (mark or kind == "revisit") or not (first.startswith("HTTP/") or kind == "request" and " HTTP/" in first):
            raise Malformed("no HTTP header")
        stated = http_fields.get("content-length", "")
        length = int(stated) if stated.isdigit() else len(payload)
        if kind == "response" and length != len(payload) and "transfer-encoding" not in http_fields and "warc-truncated" not in fields:
            raise Malformed("the payload's length differs")
        length = len(payload) if kind == "response" else length
    given = fields.get("warc-payload-digest")
    if kind == "revisit":
        if payload or not ("warc-refers-to" in fields or "warc-refers-to-target-uri" in fields or given):
            raise Malformed("not a revisit record")
    else:
        _check("the payload's digest", given, payload)
    known = _digest(given) if given else None
    digest = known[1] if known and known[0] in ("sha1", "sha-1") else hashlib.sha1(payload).hexdigest() if kind == "response" else None
    return {"type": kind, "id": fields["warc-record-id"], "uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"), "digest": digest, "length": length, "payload": payload, "fields": fields}


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, length: int) -> bytes:
    """A response, or with refers_to a revisit record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {length}\r\n\r\n".encode()
    body = http + payload if refers_to is None else http
    name = f"urn:page:{'' if page_id is None else page_id}"
    target = "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url) if url else name
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def dictionary(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample of pages; empty where there are too few of them."""
    import zstandard

    # the pages of least hash, so that the same pages give the same archive; a share of hashes is cut first, so that
    # tasks have few rows to send
    share = min(1.0, 4 * SAMPLE_PAGES / max(pages.count(), 1))
    heads = pages.select(F.substring("html", 1, SAMPLE_CHARS).alias("h")).where("length(h) > 64").withColumn("x", F.xxhash64("h"))
    chosen = heads.where(F.pmod("x", F.lit(1 << 20)) < share * (1 << 20)).orderBy("x", "h").limit(SAMPLE_PAGES)
    sample = [r["h"].encode() for r in chosen.collect()]
    if len(sample) < 32:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except zstandard.ZstdError:  # the trainer refuses samples that are all alike or too short
        return b""


def write(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """Write all pages; a row per file: uri, records."""
    raw = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), raw.alias("html"))
    known = plain.withColumns({"digest": F.sha1("html"), "length": F.octet_length("html"), "other": F.xxhash64("html")})
    key = ["digest", "length", "other"]
    # groups of one need no row here; equal payloads meet as counts, not as texts
    groups = known.where(F.col("length") >= REVISIT_BYTES).groupBy(*key).agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    groups = scratch.table(groups, "groups")
    rows = known.join(groups, key, "left").select("page_id", "url", "html", "digest", "length", F.when(F.col("response") == F.col("page_id"), None).otherwise(F.col("response")).alias("refers_to"))
    rows = rows.withColumn("html", F.when(F.col("refers_to").isNull(), F.col("html")))
    trained, folder = dictionary(pages), f"{scratch.root}/warc"

    def run(batches):
        import zstandard

        writer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(trained)) if trained else zstandard.ZstdCompressor(level=3)
        head = struct.pack("<II", DICTIONARY_MAGIC, len(trained)) + trained
        # a second attempt of a task writes files of its own; only those that a finished task lists are read
        attempt, parts, size, done = uuid.uuid4().hex, [head], 0, 0

        def close():
            uri = f"{folder}/{attempt}-{done:05d}.warc.zst"
            write_file(uri, parts)
            return pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([len(parts) - 1], pa.int64())], ["uri", "records"])

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, digest, length, refers_to = (c[i].as_py() for c in batch.columns)
                parts.append(writer.compress(record(page_id, url, html or b"", digest, refers_to, length)))
                size += len(parts[-1])
                if size >= FILE_BYTES:
                    yield close()
                    parts, size, done = [head], 0, done + 1
        if len(parts) > 1:
            yield close()

    return scratch.table(rows.mapInArrow(run, "uri string, records long"), "files")


def read_records(uri: str) -> Iterator[tuple[int, dict]]:
    """(offset, record) of a file."""
    for at, content in frames(read_file(uri)):
        yield at, parse(content)


_RECORD = "uri string, offset long, record_type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string"


def records(files: DataFrame) -> DataFrame:
    """A row per record, of any type, of files (uri, and where it is there, records: their expected count)."""
    counted = "records" in files.columns

    def run(batches):
        for batch in batches:
            counts = batch.column(1).to_pylist() if counted else [None] * batch.num_rows
            for uri, n in zip(batch.column(0).to_pylist(), counts, strict=True):
                out = [(uri, at, r["type"], r["id"], r["uri"], r["refers_to"], r["length"], r["digest"]) for at, r in read_records(uri)]
                if n is not None and len(out) != n:
                    raise Malformed(f"{uri}: {len(out)} records, {n} written")
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else ((),) * 8, kinds, strict=True)], [f.split()[0] for f in _RECORD.split(", ")])

    n = max(1, files.count())
    return files.select("uri", *(["records"] if counted else [])).repartition(min(n, 10_000), "uri").mapInArrow(run, _RECORD)


def read(files: DataFrame) -> DataFrame:
    """A row per page of the listed files; each file's record count is checked."""
    page = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1), F.lit("")).cast("long")
    rows = records(files).where("record_type IN ('response', 'revisit') AND record_id LIKE '<urn:page:%'")
    return rows.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), F.col("target_uri").alias("url"), "offset")
