"""Vector best-fit packing of token pieces into sequences.

Every piece has three demands: its tokens, one document, and its attention cost (the square of its length);
every sequence has a capacity for each.  Pieces go longest first into the open bin, able to take it under
every constraint, that scores best: by the weighted dot product of demand and residual, or by the smallest
norm of what would be left.  Every open bin that can take the piece is scored; ties go to the bin opened first.

Pieces are dealt over groups of about GROUP pieces that pack on their own; a group leaves at most about one
bin that a single packing might have saved.

Defined results: a null text is empty and has the end id alone; texts of more than the limit are cut so that
only the first piece can be shorter; rows that repeat a doc_id are packed as documents of their own (piece
rows then repeat too); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, scan_text, text_chunks
from .tokens import Encoder

#: Pieces of a group, about; documents of a sequence, at the most (its attention mask has a block for each).
GROUP, DOCS = 40_000, 64


def best_fit(lengths: np.ndarray, tokens: int, docs: int, attention: int, rule: str = "dot", weights=(1.0, 0.05, 0.25)) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece.  `rule`: "dot" (weighted dot product, smallest residual taken up best) or
    "norm" (weighted norm of the residual left).  All demands and residuals count in shares of capacity."""
    if len(lengths) and (int(lengths.max()) > tokens or int(lengths.max()) ** 2 > attention or docs < 1):
        raise ValueError("a piece exceeds a capacity")
    capacity = np.array([tokens, docs, attention], np.float64)
    w = np.array(weights, np.float64)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    # open bins in the order they were opened: number and what is left of each capacity
    number, left, n_open, n_bins = np.empty(1024, np.int64), np.zeros((3, 1024), np.int64), 0, 0
    least = int(lengths.min()) if len(lengths) else 0

    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        own = left[:, :n_open]
        fits = np.flatnonzero((own[0] >= n) & (own[1] >= 1) & (own[2] >= n * n))
        if len(fits):
            need, residual = (n, 1, n * n) / capacity, own[:, fits] / capacity[:, None]
            if rule == "dot":  # a nearly full bin offers little of what the piece asks; the least offer is the best fit
                part = (w * need)[:, None] * residual
            else:
                part = w[:, None] * (residual - need[:, None]) ** 2
            at = int(fits[np.argmin(part[0] + part[1] + part[2])])
        else:
            if n_open == len(number):  # bins that can take no piece any more go, or there is more room
                keep = np.flatnonzero((own[0] >= least) & (own[1] >= 1) & (own[2] >= least * least))
                number[: len(keep)], left[:, : len(keep)], n_open = number[keep], left[:, keep], len(keep)
                if 2 * n_open > len(number):
                    number, left = np.concatenate([number, number]), np.concatenate([left, left], axis=1)
            at = n_open
            number[at], left[:, at] = n_bins, (tokens, docs, attention)
            n_open, n_bins = n_open + 1, n_bins + 1
        bins[i], offsets[i] = number[at], tokens - left[0, at]
        left[:, at] -= (n, 1, n * n)
    return bins, offsets


def pieces(documents: DataFrame, tokenizer: str, end_id: int, limit: int) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece; the ids themselves are not moved."""

    def run(batches):
        encoder = Encoder.of(tokenizer)
        end = np.array([end_id], encoder.dtype).tobytes()
        for batch in batches:
            for rows, _, _ in text_chunks(batch):
                out = []
                for doc_id, raw in zip(rows.column(0).to_pylist(), encoder.encode([t or "" for t in rows.column(1).to_pylist()]), strict=True):
                    ids = np.frombuffer(raw + end, encoder.dtype).astype("<u4")
                    cuts = [0, *range((len(ids) - 1) % limit + 1, len(ids) + 1, limit)]
                    out += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return scan_text(documents).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(documents: DataFrame, tokenizer: str, end_id: int, scratch: Scratch, limit: int = 2048, docs: int | None = None, attention: int | None = None, rule: str = "dot") -> DataFrame:
    """Pieces with sequence_id and offset.  `attention` defaults to what a piece of `limit` tokens needs: less would leave
    no place for it, and no sequence of `limit` tokens costs more, so that with it this capacity weighs in the score only."""
    docs, attention = docs or DOCS, attention or limit * limit
    rows = scratch.table(pieces(documents, tokenizer, end_id, limit), "pieces")
    n = rows.count()
    groups = max(1, round(n / GROUP))

    def run(table: pa.Table) -> pa.Table:
        group = table.column("g")[0].as_py()
        table = table.sort_by([("length", "descending"), ("ids_crc32", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets = best_fit(np.asarray(table.column("length")), limit, docs, attention, rule)
        return table.drop_columns(["g"]).append_column("sequence_id", pa.array(bins + (group << 40))).append_column("offset", pa.array(offsets))

    # the rows of a third of all documents may share a source or a text, never a group: groups are dealt by
    # the hash of document, piece and content
    dealt = rows.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
