"""Token-ID output: a static range asymmetric numeral system (rANS) over interleaved lanes.

An archive is a folder: `table` (the frequency table that all files share) and files of blocks.  A block
holds up to BLOCK ids in LANES interleaved lanes, each lane a 64-bit rANS state that takes and gives 32-bit
words.  Blocks are independent and consist of segments of CHECKPOINT steps; a segment begins at a checkpoint (all
lane states and the place in the words) and has the CRC-32 of its ids.  Readers decode segments in parallel, within a
file and within a block, from their own byte ranges alone, and join what documents have in several segments by
combining checksums.  The footer lists blocks, their ids and documents with their lengths; its own CRC-32 and those
of the segments are checked on reading, and the states that a segment ends with against the next checkpoint.

Defined results: a null text counts as empty, so such a document has the end id alone; rows that repeat a
doc_id stay separate rows, in the order of their texts; a null doc_id sorts first and stays null; an empty
table makes no file and no rows; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, open_fs, read_file, scan_text, write_file
from .tokens import Encoder

#: Probability bits; lanes of a block; ids of a block; steps between checkpoints; ids of a file; segments that a reader takes at once.
BITS, LANES, BLOCK, CHECKPOINT, FILE_IDS, TAKEN = 22, 2048, 1 << 19, 128, 1 << 23, 8
MAGIC, END = b"GLRANS02", b"GLRANSFT"
#: Bytes of a segment's head: place in the words, CRC-32 of its ids, states.
_HEAD = 8 + 8 * LANES
_LOW = np.uint64(1 << 31)


class Table:
    """Frequencies of all symbols, scaled so that they sum to 2**BITS and none is zero."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        ends = np.cumsum(self.freq)
        if len(freq) == 0 or int(ends[-1]) != 1 << BITS or (self.freq == 0).any():
            raise ValueError("not a frequency table")
        self.start = ends - self.freq
        self._symbol = None

    @property
    def symbol(self) -> np.ndarray:
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._symbol

    @staticmethod
    def of_counts(counts: np.ndarray) -> Table:
        """Every symbol gets 1, the rest is shared in proportion; what rounding leaves goes to the largest."""
        n = len(counts)
        room = (1 << BITS) - n
        if room < 0:
            raise ValueError(f"{n} symbols don't fit {BITS} bits")
        counts = counts.astype(np.float64)
        extra = np.floor(counts * (room / counts.sum())).astype(np.int64) if counts.sum() else np.zeros(n, np.int64)
        extra[int(np.argmax(counts))] += room - int(extra.sum())
        return Table(extra + 1)

    def to_bytes(self) -> bytes:
        raw = self.freq.astype("<u4").tobytes()
        return MAGIC + struct.pack("<II", len(self.freq), zlib.crc32(raw)) + raw

    @staticmethod
    def from_bytes(raw: bytes) -> Table:
        n, crc = struct.unpack_from("<II", raw, 8)
        body = raw[16:]
        if raw[:8] != MAGIC or len(body) != 4 * n or zlib.crc32(body) != crc:
            raise ValueError("the frequency table is damaged")
        return Table(np.frombuffer(body, "<u4"))


def segments(n: int) -> int:
    """Segments of a block of n ids."""
    return -(-n // (LANES * CHECKPOINT))


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    """One independent block: ids, words, the heads of its segments, words.  Lane j codes the ids at j, j + LANES, ...;
    the last steps back to the first."""
    n = len(ids)
    steps = -(-n // LANES)
    padded = np.zeros(steps * LANES, np.int64)
    padded[:n] = ids
    freq, start = table.freq[padded].reshape(steps, LANES), table.start[padded].reshape(steps, LANES)
    limit = freq << np.uint64(63 - BITS)
    x, words, done, marks = np.full(LANES, _LOW, np.uint64), [], 0, []
    width = [LANES] * (steps - 1) + [n - (steps - 1) * LANES]
    for t in range(steps - 1, -1, -1):
        w = width[t]
        y, f = x[:w], freq[t, :w]
        full = y >= limit[t, :w]
        if full.any():
            words.append(y[full].astype(np.uint32))
            done += len(words[-1])
            y = np.where(full, y >> np.uint64(32), y)
        q = y // f
        x[:w] = (q << np.uint64(BITS)) + (y - q * f) + start[t, :w]
        if t % CHECKPOINT == 0:
            marks.append((done, zlib.crc32(ids[t * LANES : (t + CHECKPOINT) * LANES].astype("<u4").tobytes()), x.astype("<u8").tobytes()))
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    heads = b"".join(struct.pack("<II", done - left, crc) + states for left, crc, states in reversed(marks))
    return struct.pack("<II", n, done) + heads + stream.astype("<u4").tobytes()


def decode_segments(read, table: Table, n: int, first: int, last: int) -> Iterator[np.ndarray]:
    """The ids of segments first..last-1 of a block of n ids, one after the other.  read(start, length) gives bytes of the block."""
    total = segments(n)
    count, n_words = struct.unpack("<II", read(0, 8))
    if count != n or not 0 <= first < last <= total:
        raise ValueError("the block's length is wrong")
    after = last < total
    heads = read(8 + first * _HEAD, (last - first + after) * _HEAD)
    places = [struct.unpack_from("<II", heads, i * _HEAD) for i in range(last - first + after)] + [(n_words, 0)] * (not after)
    states = [np.frombuffer(heads, "<u8", LANES, i * _HEAD + 8) for i in range(last - first + after)] + [np.full(LANES, _LOW)] * (not after)
    stream = np.frombuffer(read(8 + total * _HEAD + 4 * places[0][0], 4 * (places[-1][0] - places[0][0])), "<u4").astype(np.uint64)
    symbol, freq, start = table.symbol, table.freq, table.start
    mask, shift = np.uint64((1 << BITS) - 1), np.uint64(BITS)
    for k in range(first, last):
        x, p, end = states[k - first].astype(np.uint64), places[k - first][0] - places[0][0], places[k - first + 1][0] - places[0][0]
        own = min(n - k * CHECKPOINT * LANES, CHECKPOINT * LANES)
        steps = -(-own // LANES)
        out = np.empty((steps, LANES), np.uint32)
        for t in range(steps):
            w = LANES if t < steps - 1 else own - t * LANES
            y = x[:w]
            slot = y & mask
            s = symbol[slot.astype(np.int64)]
            out[t, :w] = s
            y = freq[s] * (y >> shift) + slot - start[s]
            low = np.flatnonzero(y < _LOW)
            if len(low):
                if p + len(low) > end:
                    raise ValueError("the block is damaged")
                y[low] = (y[low] << np.uint64(32)) | stream[p : p + len(low)]
                p += len(low)
            x[:w] = y
        ids = out.reshape(-1)[:own]
        if p != end or not (x == states[k - first + 1]).all() or zlib.crc32(ids.astype("<u4").tobytes()) != places[k - first][1]:
            raise ValueError("the block is damaged")
        yield ids


def decode_block(raw: bytes, table: Table, first: int = 0) -> np.ndarray:
    """The ids of a block from segment `first` on."""
    (n,) = struct.unpack_from("<I", raw)

    def read(start: int, length: int) -> bytes:
        if len(raw) < start + length:
            raise ValueError("the block's length is wrong")
        return raw[start : start + length]

    if len(raw) != 8 + segments(n) * _HEAD + 4 * struct.unpack_from("<I", raw, 4)[0]:
        raise ValueError("the block's length is wrong")
    return np.concatenate(list(decode_segments(read, table, n, first, segments(n))))


def _product(a: int, b: int) -> int:
    """Of two polynomials over bits, highest power last as CRC-32 has them, modulo its polynomial."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def joined_crc(first: int, second: int, length: int) -> int:
    """CRC-32 of two byte strings one after the other, from theirs and the length of the second."""
    power, square, bits = 1 << 31, 1 << 30, 8 * length
    while bits:
        if bits & 1:
            power = _product(power, square)
        square, bits = _product(square, square), bits >> 1
    return _product(power, first) ^ second


class Writer:
    """One file: documents in order, cut into blocks without regard to where documents end."""

    def __init__(self, table: Table, start: int):
        self.table, self.start = table, start
        self.blocks, self.docs, self.held, self.n_held, self.n = [], [], [], 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n += len(ids)
        if self.n_held >= BLOCK:
            rest = np.concatenate(self.held)
            while len(rest) >= BLOCK:
                self._block(rest[:BLOCK])
                rest = rest[BLOCK:]
            self.held, self.n_held = [rest], len(rest)

    def _block(self, ids: np.ndarray) -> None:
        self.blocks.append(encode_block(ids, self.table))

    def parts(self) -> list[bytes]:
        if self.n_held:
            self._block(np.concatenate(self.held))
            self.held, self.n_held = [], 0
        footer = json.dumps({"start": self.start, "n": self.n, "blocks": [len(b) for b in self.blocks], "null": [i for i, (d, _) in enumerate(self.docs) if d is None], "docs": len(self.docs)}).encode()
        footer += np.array([(d or 0, n) for d, n in self.docs], "<i8").reshape(-1, 2).tobytes()
        return [MAGIC, *self.blocks, footer, struct.pack("<II", len(footer), zlib.crc32(footer)), END]


def read_footer(uri: str) -> dict:
    """What a file holds: first id's place, ids, sizes of blocks, documents with their lengths."""
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        size = f.size()
        tail = f.read_at(16, size - 16)
        length, crc = struct.unpack_from("<II", tail)
        footer = f.read_at(length, size - 16 - length)
        if f.read_at(8, 0) != MAGIC or tail[8:] != END or zlib.crc32(footer) != crc:
            raise ValueError(f"{uri} is damaged")
    head, at = json.JSONDecoder().raw_decode(footer.decode("latin-1"))
    docs = np.frombuffer(footer, "<i8", offset=at).reshape(-1, 2)
    if size != 8 + sum(head["blocks"]) + length + 16 or len(docs) != head["docs"]:
        raise ValueError(f"{uri} has a wrong length")
    return head | {"docs": docs}


def read_documents(uri: str, table: Table, head: dict, first: int, last: int) -> Iterator[tuple[int, int, int, int]]:
    """(document's place in the file, place of its part's first id in the file, ids of the part, their CRC-32) for all that
    documents have in segments first..last-1 of a file.  One segment is in memory at a time."""
    ends = np.cumsum(head["docs"][:, 1])
    offsets = 8 + np.concatenate([[0], np.cumsum(head["blocks"])])
    a_block = segments(BLOCK)
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        while first < last:
            block = first // a_block
            n = min(BLOCK, head["n"] - block * BLOCK)
            stop = min(last, block * a_block + segments(n))
            read = lambda start, length, at=int(offsets[block]): f.read_at(length, at + start)
            at = block * BLOCK + (first - block * a_block) * LANES * CHECKPOINT
            for ids in decode_segments(read, table, n, first - block * a_block, stop - block * a_block):
                doc, raw = int(np.searchsorted(ends, at, "right")), ids.astype("<u4").tobytes()
                place = at
                while place < at + len(ids):
                    end = min(int(ends[doc]), at + len(ids))
                    yield doc, place, end - place, zlib.crc32(raw[4 * (place - at) : 4 * (end - at)])
                    place, doc = end, doc + 1
                at += len(ids)
            first = stop


def token_rows(documents: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(part, place, doc_id, n, ids) in ascending order of doc_id: parts ascend, places ascend in a part."""
    docs = scan_text(documents)
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        encoder, part, place = Encoder.of(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], encoder.dtype).tobytes()
        width = encoder.dtype.itemsize
        for batch in batches:
            from .common import text_chunks

            for rows, _, _ in text_chunks(batch):
                ids = [x + end for x in encoder.encode([t or "" for t in rows.column(1).to_pylist()])]
                n = np.array([len(x) // width for x in ids], np.int64)
                places = place + np.cumsum(n) - n
                place += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), pa.array(places), rows.column(0), pa.array(n), pa.array(ids, pa.binary())], ["part", "place", "doc_id", "n", "ids"])

    return ordered.mapInArrow(run, "part int, place long, doc_id long, n long, ids binary")


def write_archive(documents: DataFrame, tokenizer: str, end_id: int, scratch: Scratch) -> tuple[str, DataFrame]:
    """Encode all documents.  Returns the archive's folder and a row per file (uri, n_docs, n)."""
    spark = documents.sparkSession
    rows = scratch.table(token_rows(documents, tokenizer, end_id), "ids")
    encoder = Encoder.of(tokenizer)
    size, dtype = encoder.size, encoder.dtype

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            from .common import byte_column

            data, _ = byte_column(batch.column(0))
            total += np.bincount(np.frombuffer(data.tobytes(), dtype), minlength=size)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["id", "n"])

    counts = np.zeros(size, np.int64)
    # at most a row for each id of the vocabulary
    for r in rows.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    # a row for each task that wrote a part; places become global by it
    ends = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    base, total = {}, 0
    for part in sorted(ends):
        base[part], total = total, total + ends[part]
    folder = f"{scratch.root}/archive"
    table_bytes = Table.of_counts(counts).to_bytes()
    write_file(f"{folder}/table", [table_bytes])

    def write(batches):
        table, writer, due = Table.from_bytes(table_bytes), None, -1

        def close():
            uri = f"{folder}/{writer.start:020d}-{writer.n:012d}.rans"
            write_file(uri, writer.parts())
            return pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([len(writer.docs)], pa.int64()), pa.array([writer.n], pa.int64())], ["uri", "n_docs", "n"])

        for batch in batches:
            for part, place, doc_id, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                start = base[part] + place
                if writer is not None and (start != due or writer.n >= FILE_IDS):
                    yield close()
                    writer = None
                if writer is None:
                    writer = Writer(table, start)
                ids = np.frombuffer(ids, dtype)
                writer.add(doc_id, ids)
                due = start + len(ids)
        if writer is not None:
            yield close()

    # files of a finished task stay under the names that its places give, so a second attempt writes the same
    files = scratch.table(rows.mapInArrow(write, "uri string, n_docs long, n long"), "files")
    scratch.drop("ids")
    return folder, files


def read_archive(files: DataFrame, folder: str) -> DataFrame:
    """A row per document of the archive's files: doc_id, start, n_tokens, ids_crc32.  Files are read by segments."""

    def spread(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                total = segments(read_footer(uri)["n"])  # a block is a whole number of segments
                firsts = np.arange(0, total, TAKEN)
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(firsts)), pa.array(firsts, pa.int64()), pa.array(np.minimum(firsts + TAKEN, total), pa.int64())], ["uri", "first", "last"])

    names = ["uri", "doc", "doc_id", "place", "n", "n_all", "crc"]

    def run(batches):
        table, held = None, (None, {})
        for batch in batches:
            for uri, first, last in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                table = table or Table.from_bytes(read_file(f"{folder}/table"))
                held = held if held[0] == uri else (uri, read_footer(uri))
                head, null = held[1], set(held[1]["null"])
                out = [(uri, d, None if d in null else int(head["docs"][d, 0]), head["start"] + p, n, int(head["docs"][d, 1]), crc) for d, p, n, crc in read_documents(uri, table, head, first, last)]
                kinds = (pa.string(), *(pa.int64(),) * 6)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def join(table: pa.Table) -> pa.Table:
        """The parts of one document; a part is a segment."""
        table = table.sort_by("place")
        crc, n = 0, 0
        for own, size in zip(table.column("crc").to_pylist(), table.column("n").to_pylist(), strict=True):
            crc, n = joined_crc(crc, own, 4 * size) if n else own, n + size
        if n != table.column("n_all")[0].as_py():
            raise ValueError("a document's parts are not whole")
        return pa.table({"doc_id": table.column("doc_id")[:1], "start": table.column("place")[:1], "n_tokens": pa.array([n], pa.int64()), "ids_crc32": pa.array([crc], pa.int64())})

    parts = max(1, files.count())
    units = files.select("uri").repartition(min(parts, 10_000), "uri").mapInArrow(spread, "uri string, first long, last long")
    # a task makes the table of symbols once, so that tasks take a quarter of a full file or more
    units = units.repartition(min(2 * parts, 10_000), "uri", "first").sortWithinPartitions("uri", "first")
    found = units.mapInArrow(run, "uri string, doc long, doc_id long, place long, n long, n_all long, crc long")
    shape = "doc_id long, start long, n_tokens long, ids_crc32 long"
    # a row of a split document for each segment that it is in; both branches read the parts from a table
    found = Scratch(files.sparkSession, "archive").table(found, "parts")
    whole = found.where("n = n_all").select("doc_id", F.col("place").alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    return whole.union(found.where("n < n_all").groupBy("uri", "doc").applyInArrow(join, shape))
