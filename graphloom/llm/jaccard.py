"""Set similarity self-join of documents: a size-aware heavy-light join on word shingles.

A document's set holds its distinct n-word shingles as 64-bit hashes.  Documents of equal sets are one from the
start (a 128-bit fingerprint of the set).  Two sets can only link if

* both are small and share a subset of the fixed size that their two sizes demand: small ("light") sets list
  all those subsets; or
* a large ("heavy") set is one of them, and they share a shingle of their prefixes: in one global order of
  shingles, frequent ones last, a set's first n - ceil(t n) + 1 shingles.  Their inverted lists are scanned.

The boundary between small and large is the one of least cost: rows of subsets against rows of prefixes times
the length of list that a row meets, which a sketch of all shingles gives (its second moment).  The same sketch,
of fixed size, orders shingles by frequency; any order gives whole results.

Lists aren't multiplied out.  In rounds each set is compared with the list leaders that it meets most (one at first, then up to
LEADERS, no pair twice); every second round is led by sets with most of their prefix in long lists; links found make groups, and lists of one group go.  Lists of few pairs between groups need one round alone; rounds of the others end
when groups stop growing together.  A list that still has many more pairs than its sets have prefix shingles is dealt
anew under keys of one shingle more, if that leaves few of its pairs: linked sets whose first common shingle is k also
share a second one, in prefixes longer by one.  What is left is joined list by list, but only sets of different groups whose bitmaps (parities of
shingles by hash) leave room for a link become rows, and a pair is compared if it shares as many prefix shingles as a
link of its sizes needs.  Every comparison is exact, on whole texts.

Defined results: no text and no word give an empty set (n 0) that links with nothing; fewer words than n give
one shingle of all words; rows that repeat a doc_id are documents of their own; a null doc_id takes no part in
labels (its component is null unless a copy has an id); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, mix, scan_text, text_chunks, unused
from .components import components

#: Words of a shingle; threshold as a fraction (links: DEN * intersection >= NUM * union).
WORDS, NUM, DEN = 5, 75, 100
#: Counters of the sketch and of one of its blocks; the largest boundary that the cost is tried for (a set of 20 has up
#: to 21,000 subsets, so that larger ones never cost less than their prefix of 6).
SKETCH, SKETCH_BLOCK, MOST_LIGHT = 1 << 21, 1 << 12, 20
#: Leaders of a list, and those a set is compared with, in later rounds; pairs between groups for each row of a list that needs no further round; the share of
#: pairs that a round must settle for another one; pairs for each prefix shingle of a list's sets that it stays whole with;
#: the share of a list's pairs that longer keys may leave to be used; most shingles of a key; words of a bitmap.
LEADERS, PAIRS, SETTLED, STAYS, WORTH, DEEPEST, BITMAP = 4, 4, 0.1, 4, 0.25, 4, 8
#: Parts of the postings that are shuffled one after the other (a power of two); sets whose ids are broadcast to find their
#: texts (more are joined).
PARTS, FETCHED = 4, 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        inverse = np.uint64(pow(int(_R), -1, 1 << 64))
        _POWERS[size] = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, base, np.uint64), dtype=np.uint64)]) for base in (_R, inverse))
    return _POWERS[size]


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, and where each text's words begin (with the end)."""
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = _GAP[data]
    inner = ~gap[1:-1]
    begins = np.flatnonzero(inner & (gap[:-2] | _marks(starts, len(data))))
    end_marks = _marks(starts[1:] - 1, len(data))
    ends = np.flatnonzero(inner & (gap[2:] | end_marks)) + 1
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[_FOLD[data]] * up[: len(data)], out=sums[1:])
    h = mix((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64))
    return h, np.searchsorted(begins, starts)


def _marks(places: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n + 1, bool)
    out[places[(places >= 0) & (places < n)]] = True
    return out[:n]


def shingle_sets(data: np.ndarray, starts: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """For each text its sorted distinct shingles."""
    h, at = word_hashes(data, starts)
    n = np.diff(at)
    total = len(h)
    rolled = np.zeros(max(total - words + 1, 0), np.uint64)
    for k in range(words):
        rolled = mix(rolled + h[k : k + len(rolled)] * np.uint64(2 * k + 3))
    out = []
    for a, m in zip(at.tolist(), n.tolist()):
        if m >= words:
            s = np.sort(rolled[a : a + m - words + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s)
        elif m:
            x = np.full(1, m, np.uint64)
            for k in range(m):
                x = mix(x * np.uint64(31) + h[a + k])
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprint(own: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    a = mix(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    b = mix(own * _R + np.uint64(17)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def needed(n: int, m: int) -> int:
    """The least intersection of linked sets of sizes n and m."""
    return -(-NUM * (n + m) // (NUM + DEN))


def partners(n: int) -> range:
    return range(-(-NUM * n // DEN), DEN * n // NUM + 1)


def subset_sizes(n: int, most: int) -> list[int]:
    """The sizes of subsets that a light set of n lists for its light partners."""
    return sorted({needed(n, m) for m in partners(n) if 1 <= m <= most})


def prefix(n):
    return n + (-NUM * n // DEN) + 1


def boundary(counts: dict[int, int], heavy_rows: int, meets: float) -> int:
    """The size up to which sets are light, by cost.  counts: sets of each size up to MOST_LIGHT; heavy_rows:
    prefix rows of all larger ones; meets: rows that a prefix row meets in its list."""
    best = (float("inf"), 0)
    for b in range(MOST_LIGHT + 1):
        light = sum(c * sum(comb(n, k) for k in subset_sizes(n, b)) for n, c in counts.items() if n <= b)
        heavy = heavy_rows + sum(c * prefix(n) for n, c in counts.items() if DEN * n // NUM > b)
        best = min(best, (light + heavy * meets, b))
    return best[1]


def scan(documents: DataFrame, scratch: Scratch, words: int = WORDS) -> tuple[DataFrame, np.ndarray]:
    """First pass: a row per document (doc_id, n, f1, f2, wide: its bitmap), and the sketch of all shingles of all documents."""

    def run(batches):
        sketch = np.zeros(SKETCH, np.int64)
        names = ["doc_id", "n", "f1", "f2", "wide", "block", "counts"]
        for batch in batches:
            for rows, data, starts in text_chunks(batch):
                sets = shingle_sets(data, starts, words)
                every = np.concatenate(sets)
                sketch += np.bincount((every >> np.uint64(43)).astype(np.int64), minlength=SKETCH)
                prints = np.array([fingerprint(s) for s in sets], np.int64).reshape(-1, 2)
                n = len(sets)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array([bitmap(s).tobytes() for s in sets], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        for b in range(SKETCH // SKETCH_BLOCK):
            own = sketch[b * SKETCH_BLOCK : (b + 1) * SKETCH_BLOCK]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.nulls(1, t) for t in (*(pa.int64(),) * 4, pa.binary())] + [pa.array([b], pa.int32()), pa.array([own.tobytes()], pa.binary())], names)

    schema = "doc_id long, n long, f1 long, f2 long, wide binary, block int, counts binary"
    both = scratch.table(scan_text(documents).mapInArrow(run, schema), "scan")

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"block": table.column("block")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    sketch = np.zeros(SKETCH, np.int64)
    # blocks have a fixed number; a block's group holds a row for each task of the scan, summed in two steps
    blocks = both.where("block IS NOT NULL").select("block", "counts")
    salted = blocks.withColumn("salt", F.pmod(F.xxhash64("counts"), F.lit(16)))
    part = salted.groupBy("block", "salt").applyInArrow(add, "block int, counts binary")
    # written, as a table's shuffle files are deleted at once
    for r in scratch.table(part.groupBy("block").applyInArrow(add, "block int, counts binary"), "sketch").toLocalIterator():
        sketch[r["block"] * SKETCH_BLOCK : (r["block"] + 1) * SKETCH_BLOCK] = np.frombuffer(r["counts"], np.int64)
    scratch.drop("sketch")
    return both.where("block IS NULL").select("doc_id", "n", "f1", "f2", "wide"), sketch


def ordered(own: np.ndarray, heavy_class: np.ndarray) -> np.ndarray:
    """A set in the one order of all shingles.  own is sorted, and a stable sort by class keeps it so within a class."""
    return own[np.argsort(heavy_class[(own >> np.uint64(43)).astype(np.int64)], kind="stable")]


def signatures(own: np.ndarray, light: int, heavy_class: np.ndarray) -> np.ndarray:
    """The keys of a set's inverted lists: subsets for light partners (odd), prefix shingles for heavy ones (even)."""
    n = len(own)
    out = []
    if n <= light:
        for size in subset_sizes(n, light):
            for subset in combinations(own.tolist(), size):
                x = np.full(1, size, np.uint64)
                for v in subset:
                    x = mix(x * _R + np.uint64(v))
                out.append(x | np.uint64(1))
    if n and DEN * n // NUM > light:
        out.append(ordered(own, heavy_class)[: prefix(n)] & ~np.uint64(1))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def longer_keys(own: np.ndarray, heavy_class: np.ndarray, depth: int, keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of depth + 1 shingles from some of a set's keys of depth shingles, where their last shingle stands in the
    set's order, and the keys that they are made from.  `at`: that place for the given keys (-1: to be found)."""
    reach = ordered(own, heavy_class)[: prefix(len(own)) + depth] & ~np.uint64(1)
    made, places, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for key, place in zip(keys.view(np.uint64), at.tolist(), strict=True):
        if place < 0:
            found = np.flatnonzero(reach == key)
            if not len(found):  # of another set under this id
                continue
            place = int(found[0])
        made.append(mix(reach[place + 1 :] * _R + key) & ~np.uint64(1))
        places.append(np.arange(place + 1, len(reach)))
        of.append(np.full(len(reach) - place - 1, np.uint64(key).view(np.int64)))
    return np.concatenate(made), np.concatenate(places), np.concatenate(of)


def bitmap(own: np.ndarray) -> np.ndarray:
    """Parities of a set's shingles by as many values of a hash as the set has shingles, at least (a power of two from 512
    on): two sets differ in as many shingles as bits, at the least."""
    size = max(64 * BITMAP, 1 << max(len(own) - 1, 0).bit_length())
    at = (mix(own ^ np.uint64(0x9D39247E33776D41)) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=size) & 1 == 1, bitorder="little").view("<i8")


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of the same set with fewer values of the hash."""
    return np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0)


def near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b, other columns) whose bitmaps leave room for a link, with their fingerprints (a1, a2, b1, b2)."""
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("id").alias(side), F.col("n").alias(f"{side}n"), F.col("f1").alias(f"{side}1"), F.col("f2").alias(f"{side}2"), F.col("wide").alias(f"{side}w")), side)
    names = [c for c in pairs.columns if c not in ("an", "bn", "aw", "bw")]

    def run(batches):
        for batch in batches:
            n, m = (np.asarray(batch.column(c)) for c in ("an", "bn"))
            room = n + m - 2 * -(-NUM * (n + m) // (NUM + DEN))
            keep = np.zeros(len(n), bool)
            for i, (x, y) in enumerate(zip(batch.column("aw").to_pylist(), batch.column("bw").to_pylist(), strict=True)):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")  # of signed words the bits of absolute values are counted
                words = min(len(x), len(y))
                keep[i] = np.bitwise_count(folded(x, words) ^ folded(y, words)).sum() <= room[i]
            yield batch.select(names).filter(pa.array(keep))

    return pairs.mapInArrow(run, pairs.select(names).schema)


def fetched(ids: DataFrame, documents: DataFrame, scratch: Scratch, name: str, words: int) -> DataFrame:
    """id, f1, text of sets (id, f1, f2; a written table).  Texts are filtered where they are read; only those of more sets
    than FETCHED are all moved."""

    def same(batches):
        for batch in batches:
            for part, data, starts in text_chunks(batch):
                sets = shingle_sets(data, starts, words)
                keep = [fingerprint(s) == q for s, q in zip(sets, zip(part.column(1).to_pylist(), part.column(3).to_pylist(), strict=True), strict=True)]
                yield part.select(["id", "f1", "text"]).filter(pa.array(keep, pa.bool_()))

    few = ids.count() <= FETCHED
    found = scan_text(documents).join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("id")).select("id", "f1", "text", "f2")
    # rows that repeat an id with an equal set are one
    return scratch.table(found.mapInArrow(same, "id long, f1 long, text string").groupBy("id", "f1").agg(F.min("text").alias("text")), name)


def verify(pairs: DataFrame, sets: DataFrame, documents: DataFrame, scratch: Scratch, name: str, words: int = WORDS) -> DataFrame:
    """Those of pairs (a, b, other columns) that link.  Bitmaps drop most of the others first, so that few texts are moved.
    Rows come sorted by b, so that a leader's set is made once for a run of rows."""
    others = pairs.columns
    left = scratch.table(near(pairs, sets), f"near_{name}")
    ids = left.select(F.col("a").alias("id"), F.col("a1").alias("f1"), F.col("a2").alias("f2")).union(left.select("b", "b1", "b2")).distinct()
    texts = fetched(scratch.table(ids, f"ids_{name}"), documents, scratch, f"texts_{name}", words)
    for side in "ab":
        left = left.join(texts.withColumnsRenamed({"id": side, "f1": f"{side}1", "text": f"text_{side}"}), [side, f"{side}1"])
    rows = left.select(*others, "b1", "text_a", "text_b")

    def run(batches) -> Iterator[pa.RecordBatch]:
        last = (None, None)
        for batch in batches:
            for part, data, starts in text_chunks(batch, "text_a"):
                sets = shingle_sets(data, starts, words)
                keep = np.zeros(len(sets), bool)
                b_ids, b_texts = list(zip(part.column("b").to_pylist(), part.column("b1").to_pylist(), strict=True)), part.column("text_b")
                for i, own in enumerate(sets):
                    if last[0] != b_ids[i]:
                        raw = np.frombuffer(b_texts[i].as_py().encode(), np.uint8)
                        last = (b_ids[i], shingle_sets(raw, np.array([0, len(raw)]), words)[0])
                    both = len(np.intersect1d(own, last[1], assume_unique=True))
                    keep[i] = DEN * both >= NUM * (len(own) + len(last[1]) - both)
                yield part.select(others).filter(pa.array(keep))

    found = scratch.table(rows.mapInArrow(run, pairs.schema), f"links_{name}")
    for table in ("near", "ids", "texts"):
        scratch.drop(f"{table}_{name}")
    return found


def join(documents: DataFrame, scratch: Scratch, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(sets, links): doc_id, n, rep of every document (rep: the least id of equal sets); links between reps that
    join all linked sets: every linked pair is in one component of them."""
    docs, sketch = scan(documents, scratch, words)
    total = int(sketch.sum())
    # Spread over SKETCH counters, all other shingles add total^2 / SKETCH to the sum of squares
    squares = float((sketch.astype(np.float64) ** 2).sum()) - total * total / SKETCH
    meets = max(1.0, squares / max(total, 1))
    key = ["f1", "f2", "n"]
    reps = scratch.table(docs.where("n > 0").groupBy(*key).agg(F.min("doc_id").alias("rep")), "reps")
    sizes = reps.groupBy(F.least("n", F.lit(MOST_LIGHT + 1)).alias("n")).agg(F.count(F.lit(1)).alias("c"), F.sum(F.expr(f"n - ({NUM} * n + {DEN - 1}) div {DEN} + 1")).alias("p")).collect()
    counts = {r["n"]: r["c"] for r in sizes if r["n"] <= MOST_LIGHT}
    light = boundary(counts, sum(r["p"] for r in sizes if r["n"] > MOST_LIGHT), meets)
    # frequency classes by powers of two above what a counter holds on average
    level = np.maximum(sketch / (4 * total / SKETCH + 4), 1)
    classes = documents.sparkSession.sparkContext.broadcast(np.log2(level).astype(np.uint8))

    def run(batches):
        for batch in batches:
            for _, data, starts in text_chunks(batch):
                sets = shingle_sets(data, starts, words)
                keys = [signatures(s, light, classes.value) for s in sets]
                size = [len(k) for k in keys]
                own = np.repeat(np.array([fingerprint(s)[0] for s in sets], np.int64), size)
                flat = np.concatenate(keys).view(np.int64)
                for a in range(0, len(flat), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(flat[a : a + 50_000]), pa.array(own[a : a + 50_000])], ["key", "f1"])

    # a row names its set by half of the fingerprint: sets that share it by chance are compared like others.  Tables are
    # written before they are joined: a join straight on the aggregate would keep all rows of a key in one task
    postings = scratch.table(scan_text(documents).mapInArrow(run, "key long, f1 long"), "postings")
    # lists that hold different sets; equal sets never count.  Part by part, so that little is shuffled at once
    lists = None
    for part in range(PARTS):
        some = postings.where(F.shiftright("key", 1).bitwiseAND(F.lit(PARTS - 1)) == part)
        shared = scratch.table(some.groupBy("key").agg(F.min("f1").alias("x"), F.max("f1").alias("y")).where("x <> y").select("key"), f"shared{part}")
        kept = scratch.table(some.join(shared, "key").distinct(), f"lists{part}")
        lists = kept if lists is None else lists.union(kept)
        scratch.drop(f"shared{part}")
    scratch.drop("postings")
    rows = scratch.table(lists.join(reps, "f1").select("key", F.col("rep").alias("id"), "n", F.col("rep").alias("g")), "open0")
    for part in range(PARTS):
        scratch.drop(f"lists{part}")
    # rows that repeat an id with an equal set are one
    whose = reps.withColumnRenamed("rep", "id")
    marks = docs.join(whose, key).where("doc_id = id").groupBy("id", *key).agg(F.first("wide").alias("wide"))

    def fold(batches):
        for batch in batches:
            bits = pa.array([folded(np.frombuffer(x, "<i8"), BITMAP) for x in batch.column("wide").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, bits], [*batch.schema.names, "bits"])

    marks = marks.join(rows.select("id").distinct(), "id").select("id", "n", "f1", "f2", "wide")
    sets = scratch.table(marks.mapInArrow(fold, "id long, n long, f1 long, f2 long, wide binary, bits array<long>"), "marks")
    links, rows = _rounds(rows, sets, documents, scratch, words)
    rows, cut = _split(rows, sets, documents, classes, scratch, words)

    # what is left: pairs of different groups, by list
    rows = scratch.table(rows.join(sets.select("id", "n", "bits"), ["id", "n"]).join(cut, "id", "left").withColumn("cut", F.col("cut").isNotNull()), "last")
    x = rows.withColumnsRenamed({"id": "a", "g": "ga", "bits": "ba", "cut": "ca"})
    y = rows.withColumnsRenamed({"id": "b", "g": "gb", "n": "m", "bits": "bb", "cut": "cb"})
    least = f"({NUM} * (n + m) + {NUM + DEN - 1}) div {NUM + DEN}"
    apart = " + ".join(f"bit_count(ba[{i}] ^ bb[{i}])" for i in range(BITMAP))
    meeting = x.join(y, "key").where("a < b AND ga <> gb").where(FITS).where(f"{apart} <= n + m - 2 * ({least})")
    meeting = meeting.groupBy("a", "b", "n", "m").agg(F.count(F.lit(1)).alias("times"), F.bool_and(F.col("ca") & F.col("cb")).alias("cut"))
    # shingles beyond the prefix of the set whose prefix ends first are common at most; light subsets count as they are,
    # and sets that both were in a list dealt anew may have met there
    rest = F.expr(f"greatest(({NUM} * n + {DEN - 1}) div {DEN}, ({NUM} * m + {DEN - 1}) div {DEN}) - 1")
    second = meeting.where((F.least("n", "m") <= light) | F.col("cut") | (F.col("times") >= F.expr(least) - rest)).select("a", "b")
    more = verify(second, sets, documents, scratch, "last", words)
    scratch.drop("marks")
    scratch.drop("last")
    return docs.join(reps, key, "left").select("doc_id", "n", "rep"), links.union(more)


#: Sizes that a link allows.
FITS = f"{DEN} * least(n, m) >= {NUM} * greatest(n, m)"


def _mixed(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """A row for each list that holds several groups: key, m (sets), cross (pairs between groups), room (prefix shingles
    of its sets) and common (shingles that each of its sets shares with any set it links to, at least)."""
    all_of = f"({NUM} * n + {DEN - 1}) div {DEN}"
    each = rows.groupBy("key", "g").agg(F.count(F.lit(1)).cast("double").alias("c"), F.sum(F.expr(f"n - {all_of} + 1")).alias("room"), F.min(F.expr(all_of)).alias("common"))
    of = each.groupBy("key").agg(F.count(F.lit(1)).alias("groups"), F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("squares"), F.sum("room").alias("room"), F.min("common").alias("common"))
    return scratch.table(of.where("groups > 1").select("key", "m", ((F.col("m") * F.col("m") - F.col("squares")) / 2).alias("cross"), "room", "common"), name)


def _rounds(rows: DataFrame, sets: DataFrame, documents: DataFrame, scratch: Scratch, words: int) -> tuple[DataFrame, DataFrame]:
    """Rounds of comparisons with list leaders.  rows: key, id, n and g (group) of lists.  Gives the links found, and the
    rows of lists that hold several groups.  All lists take part in the first round, long ones in those that follow."""
    links, before, turn, busy, moves, tried = None, float("inf"), 0, rows, None, None

    def placed(lists: DataFrame, to: DataFrame) -> DataFrame:
        return lists.join(to, F.col("g") == F.col("node"), "left").select("key", "id", "n", F.coalesce("component", "g").alias("g"))

    while True:
        # leaders: the least ids at first; then, in each second round, sets with most of their prefix in these lists (of copies that
        # were changed in places, those with the fewest changes, which link with the most others), and any others between
        lead, rank = busy.withColumn("share", F.lit(0.0)), F.xxhash64("id", F.lit(turn)) if turn else F.lit(0)
        if turn % 2:
            share = busy.groupBy("id", "n").agg((F.count(F.lit(1)) / F.expr(f"n - ({NUM} * n + {DEN - 1}) div {DEN} + 1")).alias("share"))
            lead = busy.join(scratch.table(share, f"share{turn}"), ["id", "n"])
        salt = F.pmod(F.xxhash64("id"), F.lit(LEADERS if turn else 1))
        leaders = lead.groupBy("key", salt.alias("salt")).agg(F.min(F.struct((-F.col("share")).alias("minus"), rank.alias("rank"), "id", "n", "g")).alias("x"))
        leaders = scratch.table(leaders.select("key", F.col("x.id").alias("b"), F.col("x.n").alias("m"), F.col("x.g").alias("gb"), (-F.col("x.minus")).alias("share")), f"leaders{turn}")
        met = busy.join(leaders, "key").where("g <> gb").where(FITS).groupBy("id", "g", "b", "gb").agg(F.count(F.lit(1)).alias("times"), F.max("share").alias("share"))
        if tried is not None:  # no pair is compared again
            met = met.join(tried, ["id", "b"], "left_anti")
        # those that a set meets most
        turns = F.row_number().over(Window.partitionBy("id", "g").orderBy(F.desc("times"), F.desc("share"), "b"))
        best = met.withColumn("turn", turns).where(F.col("turn") <= (LEADERS if turn else 1))
        best = scratch.table(best.select(F.col("id").alias("a"), "b", F.col("g").alias("ga"), "gb"), f"tried{turn}")
        pairs = best.select(F.col("a").alias("id"), "b")
        tried = pairs if tried is None else tried.union(pairs)
        found = verify(best, sets, documents, scratch, str(turn), words)
        links = found.select("a", "b") if links is None else links.union(found.select("a", "b"))
        joined = components(found.select(F.col("ga").alias("a"), F.col("gb").alias("b")), scratch, f"grow{turn}_")
        grown = scratch.table(joined, f"grown{turn}")
        if turn == 0:
            now = placed(rows, grown)
            mixed = _mixed(now, scratch, "mixed0")
            rows = scratch.table(now.join(mixed.select("key"), "key"), "open1")
            now = rows
        else:  # of what later rounds move, only where each group of the first round ends
            now = scratch.table(placed(busy, grown), f"busy{turn}_")
            mixed = _mixed(now, scratch, f"mixed{turn}")
            later = grown if moves is None else moves.select("node", F.col("component").alias("c1")).join(grown.select(F.col("node").alias("c1"), "component"), "c1", "left").select("node", F.coalesce("component", "c1").alias("component")).unionByName(grown.join(moves.select("node"), "node", "left_anti"))
            moves = scratch.table(later, f"moves{turn}")
        for name in (f"busy{turn}" if turn else "open0", f"leaders{turn}", f"share{turn}"):
            scratch.drop(name)
        # lists of few pairs need no further round
        long = mixed.where(F.col("cross") > PAIRS * F.col("m"))
        cost = long.agg(F.sum("cross").alias("cross")).first()["cross"] or 0
        turn += 1
        if not cost or cost > (1 - SETTLED) * before:
            break
        before, busy = cost, scratch.table(now.join(long.select("key"), "key"), f"busy{turn}")
    for past in range(turn):
        scratch.drop(f"tried{past}")
    if moves is not None:
        now = placed(rows, moves)
        rows = scratch.table(now.join(_mixed(now, scratch, "mixed_last").select("key"), "key"), "open_last")
        scratch.drop("open1")
    return links, rows


def _split(rows: DataFrame, sets: DataFrame, documents: DataFrame, classes, scratch: Scratch, words: int) -> tuple[DataFrame, DataFrame]:
    """Lists of prefix shingles with many more pairs than their sets have prefix shingles, dealt anew under keys of one
    shingle more, as long as there are any and links need to share so many.  Gives all rows, and the ids that were in
    such lists (id, cut)."""

    def run_at(depth: int):
        def run(batches):
            for batch in batches:
                for part, data, starts in text_chunks(batch):
                    sets = shingle_sets(data, starts, words)
                    for i, s in enumerate(sets):
                        own = part.column(4)[i].as_py()
                        keys, at, of = longer_keys(s, classes.value, depth, np.array([x["key"] for x in own], np.int64), np.array([x["at"] for x in own], np.int64))
                        for a in range(0, len(keys), 50_000):
                            k = keys[a : a + 50_000]
                            same = [pa.array(np.full(len(k), part.column(c)[i].as_py(), np.int64)) for c in (0, 1, 2)]
                            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), *same, pa.array(at[a : a + 50_000]), pa.array(of[a : a + 50_000])], ["key", "id", "n", "g", "at", "of"])

        return run

    kept, cut = [], []
    rows, turn = rows.withColumn("at", F.lit(-1).cast("long")), _mixed(rows, scratch, "long0")
    for depth in range(1, DEEPEST):
        long = scratch.table(turn.where((F.col("cross") > STAYS * F.col("room")) & (F.col("key") % 2 == 0) & (F.col("common") > depth)).select(F.col("key").alias("of"), "cross"), f"tried_long{depth}")
        if long.isEmpty():
            break
        # of each set, at most the keys of its prefix
        own = rows.join(long.select(F.col("of").alias("key")), "key").groupBy("id", "n", "g").agg(F.collect_list(F.struct("key", "at")).alias("own"))
        ids = scratch.table(own.join(sets.select("id", "n", "f1", "f2"), ["id", "n"]).select("id", "n", "g", "own", "f1", "f2"), f"own{depth}")
        texts = fetched(ids.select("id", "f1", "f2").distinct(), documents, scratch, f"texts_long{depth}", words)
        given = ids.join(texts, ["id", "f1"]).select("id", "n", "g", "text", "own")
        dealt = scratch.table(given.mapInArrow(run_at(depth), "key long, id long, n long, g long, at long, of long"), f"dealt{depth}")
        turn = _mixed(dealt, scratch, f"long{depth}")
        parts = dealt.select("key", "of").distinct().join(turn, "key").groupBy("of").agg(F.sum("cross").alias("now"))
        # lists of sets that are much alike have no fewer pairs under longer keys, and stay as they were
        better = scratch.table(long.join(parts, "of", "left").where(F.coalesce("now", F.lit(0.0)) < WORTH * F.col("cross")).select("of"), f"better{depth}")
        kept.append(rows.join(better.select(F.col("of").alias("key")), "key", "left_anti"))
        rows = scratch.table(dealt.join(better, "of").select("key", "id", "n", "g", "at"), f"kept{depth}")
        for name in (f"dealt{depth}", f"own{depth}", f"texts_long{depth}"):
            scratch.drop(name)
        cut.append(rows.select("id"))
        turn = turn.join(rows.select("key").distinct(), "key", "left_semi")
    for other in kept:
        rows = rows.unionByName(other)
    ids = cut[0] if cut else sets.select("id").limit(0)
    for other in cut[1:]:
        ids = ids.union(other)
    return rows.select("key", "id", "n", "g"), ids.distinct().withColumn("cut", F.lit(True))


def classes(documents: DataFrame, scratch: Scratch, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    sets, links = join(documents, scratch, words)
    sets = scratch.table(sets, "sets")
    labels = components(links, scratch)
    found = sets.join(labels, F.col("rep") == F.col("node"), "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def representatives(documents: DataFrame, scratch: Scratch, words: int = WORDS) -> DataFrame:
    """One row of each class, that of the least doc_id (null last), in its own columns.  Rows are told apart by a number
    of their own, written with them, so that rows that repeat a doc_id or have none are rows like all others."""
    (row,) = unused(documents, "_row")
    rows = scratch.table(documents.withColumn(row, F.monotonically_increasing_id()), "rows")
    numbered = rows.select(F.col(row).alias("doc_id"), "text")
    found = classes(numbered, scratch, words).select(F.col("doc_id").alias("row"), "component_id")
    named = found.join(rows.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id")), "row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    stay = scratch.table(named.groupBy("component_id").agg(first.alias("x")).select(F.col("x.row").alias(row)), "stay")
    return rows.join(stay, row, "left_semi").drop(row)
