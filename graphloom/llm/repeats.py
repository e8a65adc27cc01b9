"""Removal of byte strings that occur earlier in the corpus, by column-wise sorting of text pieces.

Every string of LENGTH bytes (a window) picks an anchor: its k-gram of least hash, the leftmost of equals.  The
choice depends on the window's bytes alone, so equal windows pick the same anchor at the same place.  A maximal
run of windows with one anchor is a piece; each window is in exactly one piece.  Equal windows can only be in
pieces of the same anchor, where they stand in the same columns once pieces are aligned on the anchor.

* Anchors that occur once have no repeat and go.  Pieces alike in all bytes are one class (128 bits of anchor
  and piece hash); all but its first occurrence are repeats as a whole.
* The classes of an anchor are sorted as a collection, column-wise: from the last column to the first, each
  round inserts one symbol of every piece, which gives the order of all suffixes that begin in that column (the
  collection's Burrows-Wheeler transform, column by column: the symbols of the next round in this order) and
  the common prefixes of neighbours.  As pieces are aligned, suffixes of different columns need not be merged.
  Beyond SORTED pieces columns lie in files of the shared folder, one for each block of pieces, and are read one
  after the other; the order and the prefixes of the last column alone are in memory.  Where neighbours share
  LENGTH bytes or more, windows are equal, and all but the first are repeats.
* An anchor of more than HOT classes would be too much for one task: its windows are met by hash, one row each.

Defined results: a null text is empty; "earlier" is a smaller doc_id, or the same and an earlier start; rows that
repeat a doc_id are documents of their own, and equal strings at equal starts in them are not earlier than each
other; a null doc_id counts as the smallest; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, byte_column, chunks, mix, open_fs, scan_text, text_chunks, trim, unused, write_file
from .jaccard import _BYTE, _powers

#: Bytes of a repeat; bytes of an anchor.
LENGTH, GRAM = 100, 32
#: Pieces that are sorted together, about (a single anchor's classes always are); above it columns are in a file.
SORTED = 100_000
#: Classes of one anchor, beyond which its windows are met by their hashes instead of in one task's sort.
HOT = 200_000
NO_ID = -(1 << 63)


def pieces(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """All pieces of some texts: doc (row), s (start in the text), n (windows), a (anchor's place in the piece),
    h (anchor's hash) and ph (the piece's hash)."""
    size = len(data)
    none = np.zeros(0, np.int64)
    if size < length:
        return dict.fromkeys(("doc", "s", "n", "a"), none) | dict.fromkeys(("h", "ph"), none)
    up, down = _powers(size + 1)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:size], out=sums[1:])
    grams = mix((sums[gram:] - sums[:-gram]) * down[: size - gram + 1])
    least = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    width, have = length - gram + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    # windows that end in the text they begin in
    inside = np.zeros(size + 1, np.int32)
    long_enough = np.flatnonzero(np.diff(starts) >= length)
    np.add.at(inside, starts[long_enough], 1)
    np.add.at(inside, starts[long_enough + 1] - length + 1, -1)
    window = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(window):
        return pieces(data[:0], starts[:1])
    anchor = (least[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)])
    first = np.flatnonzero(new)
    n = np.diff(np.concatenate([first, [len(window)]]))
    s, a = window[first], anchor[first]
    e = s + n - 1 + length
    doc = np.searchsorted(starts, s, "right") - 1
    ph = mix(((sums[e] - sums[s]) * down[s]) ^ np.uint64(0xC2B2AE3D27D4EB4F)) + n.astype(np.uint64)
    return {"doc": doc, "s": s - starts[doc], "n": n, "a": a - s, "h": grams[a].view(np.int64), "ph": ph.view(np.int64)}


class Columns:
    """The columns of aligned pieces: in memory, or in files of the shared folder, a file for each block of pieces, which
    are read one column after the other.  256: a piece has no byte there."""

    def __init__(self, folder: str | None):
        self.folder, self.blocks = folder, []

    def add(self, block: np.ndarray) -> None:
        """The next block: a row for each column."""
        if self.folder is None:
            self.blocks.append(block)
            return
        uri = f"{self.folder}/{uuid.uuid4().hex}.columns"
        write_file(uri, [np.ascontiguousarray(block, "<u2").tobytes()])
        fs, path = open_fs(uri)
        self.blocks.append((fs, path, fs.open_input_file(path), block.shape[1]))

    def __getitem__(self, column: int) -> np.ndarray:
        if self.folder is None:
            return np.concatenate([b[column] for b in self.blocks])
        return np.concatenate([np.frombuffer(f.read_at(2 * n, 2 * n * column), "<u2") for _, _, f, n in self.blocks])

    def close(self) -> None:
        for fs, path, f, _ in self.blocks if self.folder else ():
            f.close()
            fs.delete_file(path)


def sort_columns(texts: list[bytes], anchors: np.ndarray, groups: np.ndarray, ids: np.ndarray, at: np.ndarray, length: int = LENGTH, memory: int = SORTED, folder: str | None = None):
    """Repeats among pieces of several anchors.  groups: ascending number of each piece's anchor; ids, at: document
    and place of each piece; folder: where columns go if there are more pieces than `memory`.  Yields (piece, column)
    arrays of windows that occur earlier in another piece."""
    m = len(texts)
    left = int(anchors.max())
    right = max(len(t) - int(a) for t, a in zip(texts, anchors.tolist(), strict=True))
    table = Columns(folder if m > memory else None)
    try:
        shape = (left + right, m)
        step = 20_000
        for i in range(0, m, step):
            block = np.full((min(step, m - i), shape[0]), 256, np.uint16)
            for j, (t, a) in enumerate(zip(texts[i : i + step], anchors[i : i + step].tolist(), strict=True)):
                block[j, left - a : left - a + len(t)] = np.frombuffer(t, np.uint8)
            table.add(block.T)
        order = np.arange(m)
        common = np.zeros(m, np.int32)  # of each suffix with the one before it
        rank = groups.astype(np.int64) * 257
        for c in range(shape[0] - 1, -1, -1):
            symbol = table[c]
            key = rank + symbol
            by = np.argsort(key[order], kind="stable")
            # the least common prefix between old neighbours p < q of one symbol is that of all rows in (p, q]
            now = order[by]
            same = np.zeros(m, bool)
            same[1:] = (key[now[1:]] == key[now[:-1]]) & (symbol[now[1:]] < 256)
            next_common = np.zeros(m, np.int32)
            at_same = np.flatnonzero(same)
            if len(at_same):
                ends = np.empty(2 * len(at_same), np.int64)
                ends[0::2], ends[1::2] = by[at_same - 1] + 1, by[at_same] + 1
                padded = np.append(common, 0)
                next_common[at_same] = np.minimum.reduceat(padded, ends)[0::2] + 1
            order, common = now, next_common
            full = common >= length
            if full.any():
                # runs of equal windows; the first of a run is the least (document, place)
                run = np.cumsum(~full)
                member = full.copy()
                member[:-1] |= full[1:]
                rows = np.flatnonzero(member)
                piece, of = order[rows], run[rows]
                place = at[piece] + (c - left)
                sort = np.lexsort((place, ids[piece], of))
                p, o = piece[sort], of[sort]
                head = np.concatenate([[True], o[1:] != o[:-1]])
                first = np.flatnonzero(head)[np.cumsum(head) - 1]
                later = (ids[p] != ids[p[first]]) | (at[p] != at[p[first]])
                yield p[later], np.full(int(later.sum()), c - left)
    finally:
        table.close()


def repeats(documents: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Spans of repeats: d, crc (of the text), lists of starts and ends.  They may overlap."""
    docs = scan_text(documents).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))

    def cut(batches):
        for batch in batches:
            for rows, data, starts in text_chunks(batch):
                p = pieces(data, starts, length, gram)
                ids = np.asarray(rows.column(0))
                bounds = starts.tolist()
                crc = np.array([zlib.crc32(data[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)], np.int64)
                meta = (p["n"] << 8) | p["a"]
                for i in range(0, len(meta), 50_000):
                    j = slice(i, i + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (p["h"][j], p["ph"][j], ids[p["doc"][j]], crc[p["doc"][j]], p["s"][j], meta[j])], ["h", "ph", "d", "crc", "s", "meta"])

    every = docs.mapInArrow(cut, "h long, ph long, d long, crc long, s long, meta long")
    again = every.select("h").groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h")
    # written first: a join straight on the counts would keep all rows of an anchor in one task
    again = scratch.table(again, "again")
    met = scratch.table(every.join(again, "h"), "met")
    scratch.drop("again")
    where = F.struct("d", "s", "crc", "meta")
    first = scratch.table(met.groupBy("h", "ph").agg(F.min(where).alias("first"), F.count(F.lit(1)).alias("c")), "classes")
    end = F.col("s") + F.shiftright("meta", 8) + (length - 1)
    more = first.where("c > 1").select("h", "ph", F.col("first.d").alias("d0"), F.col("first.s").alias("s0"))
    copies = met.join(more, ["h", "ph"]).where("d <> d0 OR s <> s0").select("d", "crc", F.col("s").alias("a"), end.alias("b"))

    # classes of anchors that have several: their first occurrences, with their bytes
    several = scratch.table(first.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "several")

    def texts_of(anchors: DataFrame) -> DataFrame:
        chosen = first.join(anchors.select("h"), "h").select("h", "first.*").groupBy("d", "crc").agg(F.collect_list(F.struct("h", "s", "meta")).alias("own"))
        return chosen.join(docs.withColumnRenamed("doc_id", "d"), "d").select("d", "crc", "own", "text")

    def bring(batches):
        for batch in batches:
            for rows, data, starts in text_chunks(batch):
                out: list[list] = [[], [], [], [], [], []]
                for i, (d, crc, own) in enumerate(zip(*(rows.column(k).to_pylist() for k in range(3)), strict=True)):
                    raw = data[starts[i] : starts[i + 1]].tobytes()
                    if zlib.crc32(raw) != crc:  # another row of this id
                        continue
                    for x in own:
                        n, a = x["meta"] >> 8, x["meta"] & 255
                        for to, v in zip(out, (x["h"], d, crc, x["s"], a, raw[x["s"] : x["s"] + n - 1 + length]), strict=True):
                            to.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(),) * 5 + (pa.binary(),), strict=True)], ["h", "d", "crc", "s", "a", "piece"])

    folder = f"{scratch.root}/columns"

    def compare(batches):
        held: list[pa.RecordBatch] = []

        def work(rows: pa.Table):
            h = np.asarray(rows.column("h"))
            groups = np.concatenate([[0], np.cumsum(h[1:] != h[:-1])])
            d, crc, s = (rows.column(c).to_numpy() for c in ("d", "crc", "s"))
            found = list(sort_columns(rows.column("piece").to_pylist(), rows.column("a").to_numpy(), groups, d, s + rows.column("a").to_numpy(), length, folder=folder))
            if found:
                piece, column = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
                begin = s[piece] + rows.column("a").to_numpy()[piece] + column
                order = np.lexsort((begin, piece))
                piece, begin = piece[order], begin[order]
                new = np.concatenate([[True], (piece[1:] != piece[:-1]) | (begin[1:] != begin[:-1] + 1)])
                heads = np.flatnonzero(new)
                tails = np.concatenate([heads[1:], [len(piece)]]) - 1
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (d[piece[heads]], crc[piece[heads]], begin[heads], begin[tails] + length)], ["d", "crc", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) >= SORTED:
                rows = pa.Table.from_batches(held).combine_chunks()
                h = rows.column("h").to_numpy()
                change = np.flatnonzero(h[1:] != h[:-1])
                if len(change):  # the last anchor may go on in the next batch
                    at = int(change[-1]) + 1
                    yield from work(rows.slice(0, at))
                    held = rows.slice(at).to_batches()
        if held:
            yield from work(pa.Table.from_batches(held).combine_chunks())

    shape = "h long, d long, crc long, s long, a long, piece binary"
    brought = texts_of(several.where(F.col("n") <= HOT)).mapInArrow(bring, shape)
    shared = scratch.table(brought.repartition("h").sortWithinPartitions("h", "d", "s").mapInArrow(compare, "d long, crc long, a long, b long"), "shared")
    if not several.where(F.col("n") > HOT).isEmpty():
        shared = shared.union(_by_hash(texts_of(several.where(F.col("n") > HOT)).mapInArrow(bring, shape), scratch, length))
    spans = copies.union(shared).groupBy("d", "crc").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    spans = scratch.table(spans, "spans")
    for name in ("met", "classes", "shared", "several", "windows", "firsts"):
        scratch.drop(name)
    return spans


def _by_hash(brought: DataFrame, scratch: Scratch, length: int) -> DataFrame:
    """d, crc, a, b of windows of pieces (those of very hot anchors) that occur earlier in another piece, by 128 bits of
    hash: as many rows as windows, met by the window's own hash, so that no anchor is gathered anywhere."""

    def windows(batches):
        for batch in batches:
            data, starts = byte_column(batch.column(5))
            for a, b in chunks(np.diff(starts)):
                own, at = data[starts[a] : starts[b]], starts[a : b + 1] - starts[a]
                up, down = _powers(len(own) + 1)
                halves = []
                for table in (_BYTE, mix(_BYTE + np.uint64(1))):
                    sums = np.zeros(len(own) + 1, np.uint64)
                    np.cumsum(table[own] * up[: len(own)], out=sums[1:])
                    halves.append(mix((sums[length:] - sums[:-length]) * down[: max(0, len(own) - length + 1)]).view(np.int64))
                n = np.maximum(np.diff(at) - length + 1, 0)
                piece = np.repeat(np.arange(b - a), n)
                offset = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
                place = at[piece] + offset
                d, crc, s = (np.asarray(batch.column(c))[a:b][piece] for c in (1, 2, 3))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (halves[0][place], halves[1][place], d, crc, s + offset)], ["x", "y", "d", "crc", "s"])

    each = scratch.table(brought.mapInArrow(windows, "x long, y long, d long, crc long, s long"), "windows")
    firsts = scratch.table(each.groupBy("x", "y").agg(F.min(F.struct("d", "s")).alias("f"), F.count(F.lit(1)).alias("c")).where("c > 1"), "firsts")
    later = each.join(firsts, ["x", "y"]).where("d <> f.d OR s <> f.s")
    return scratch.table(later.select("d", "crc", F.col("s").alias("a"), (F.col("s") + length).alias("b")), "hot")


def merged(a: list[int], b: list[int]) -> np.ndarray:
    """Maximal runs that intervals cover; touching ones are one."""
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.concatenate([[True], a[1:] > b[:-1]])
    heads = np.flatnonzero(new)
    return np.stack([a[heads], b[np.concatenate([heads[1:], [len(a)]]) - 1]], 1)


def remove(documents: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Every row of documents, in its own columns, and two more at the end: lists of the starts and ends of repeats."""
    spans = repeats(documents, scratch, length, gram)
    text = F.col("text").cast("string")
    d, crc, a, b = unused(documents, "_d", "_crc", "_a", "_b")
    left = documents.withColumns({d: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), crc: F.crc32(F.coalesce(text, F.lit("")).cast("binary"))})
    return left.join(spans.withColumnsRenamed({"d": d, "crc": crc, "a": a, "b": b}), [d, crc], "left").select(*(left[f"`{c}`"] for c in documents.columns), a, b)


def kept(raw: np.ndarray, a: list[int] | None, b: list[int] | None) -> tuple[bytes, np.ndarray]:
    """The bytes that stay, and the runs removed."""
    if not a:
        return raw.tobytes(), np.zeros((0, 2), np.int64)
    runs = merged(a, b)
    keep = np.ones(len(raw), bool)
    for i, j in runs.tolist():
        keep[i:j] = False
    return raw[keep].tobytes(), runs


def digest(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    rows = remove(scan_text(documents), scratch)

    def run(batches):
        for batch in batches:
            for part, data, starts in text_chunks(batch):
                out = []
                for i, (d, a, b) in enumerate(zip(*(part.column(k).to_pylist() for k in (0, 2, 3)), strict=True)):
                    raw = data[starts[i] : starts[i + 1]]
                    stay, runs = kept(raw, a, b)
                    out.append((d, len(raw), len(raw) - len(stay), len(runs), hashlib.sha256(stay).hexdigest()))
                kinds = (pa.int64(),) * 4 + (pa.string(),)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cleaned(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """Documents in their own columns, repeats cut out of text; a cut never leaves part of a character, and
    n_chars, where it is there, follows the text."""
    rows = remove(documents, scratch)
    names = [f.name for f in documents.schema.fields]

    def run(batches):
        for batch in batches:
            starts = byte_column(batch.column(names.index("text")))[1]
            for i, j in chunks(np.diff(starts)):
                part = batch.slice(i, j - i)
                data, at = byte_column(part.column(names.index("text")))
                texts = []
                for k, (t, a, b) in enumerate(zip(*(part.column(c).to_pylist() for c in (names.index("text"), len(names), len(names) + 1)), strict=True)):
                    texts.append(t if t is None or not a else kept(data[at[k] : at[k + 1]], a, b)[0].decode("utf-8", "ignore"))
                columns = list(part.columns[: len(names)])
                columns[names.index("text")] = pa.array(texts, part.column(names.index("text")).type)
                yield pa.RecordBatch.from_arrays(columns, names)
            trim()

    out = rows.mapInArrow(run, documents.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return out
