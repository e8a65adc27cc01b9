"""Benchmark decontamination by templates, in DataFrame functions alone.

Words of documents and benchmark items are canonicalised: numbers, names and units become typed placeholders.
Windows of WINDOW words are hash-joined twice, as lower-cased words and as templates.  A template match fills
slots: the item's value and the document's value at each placeholder.  Matches of one alignment (document place
less item place) count only if their slots are consistent, that is if equal item values have equal document
values and the other way round; this finds questions whose numbers or names were exchanged, and rejects texts
that merely have the same form.  A document is contaminated by an item if at least COVER of the item's windows
match.

A template window of PLAIN plain words counts by itself.  Where an item does not reach COVER so (texts dense in
numbers, names and units have few such windows, or none), every window with a plain word counts, if its alignment
is consistent over all of them and its words that are alike (plain ones, and slots of equal values) are PLAIN, or half
of a short item's words and three at the least; the item's windows are then those with a plain word.

Items of fewer words than WINDOW are one window.  Items of three words are matched word by word, as a template of three
words says too little; those of one or two words are matched with documents that hold nothing else.

Defined results: a null or wordless text matches nothing; items of equal text are reported each; rows that repeat
a doc_id are one document here (their matches are united); a null doc_id is reported as null; empty tables give
no rows; other columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Words of a window; plain words of a template window that counts by itself, and of an alignment; share of an item's windows.
WINDOW, PLAIN, COVER = 8, 5, 0.5
#: Least words of an item that is looked for inside documents, and of one that is a template.
LEAST, LEAST_TEMPLATE = 3, 4
#: Windows of all items up to which they are broadcast (about 200 bytes each); above, the join is a shuffled one.
BROADCAST_WINDOWS = 200_000
#: Bits of the constant set by which places are found whose hash an item may have: of each hash, and at the least and most.
#: Beyond the most (about a million windows) the set lets more places through, which the join drops.
HASH_BITS, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 24
#: Words of measure.
UNITS = (
    "kg g mg km m cm mm mile miles meter meters metre metres foot feet inch inches liter liters litre litres ml "
    "hour hours minute minutes second seconds day days week weeks month months year years dollar dollars euro euros "
    "cent cents pound pounds percent degree degrees"
).split()

#: No repeated group: Java's regular expressions would recurse once for each character of a long run.
_BREAK = r"[^\p{L}\p{M}\p{N}.,]+|[.,](?![0-9])|(?<![0-9])[.,]"


def words(text: Column) -> Column:
    """Words in their own case; a decimal or thousands mark stays inside its number."""
    return F.array_remove(F.split(text, _BREAK), "")


def template(own: Column, low: Column) -> Column:
    """Words with placeholders for numbers, units and names (a capital before small letters), else lower-cased.
    `low` holds the same words lower-cased.  The commonest case, a small Latin letter in front, is tested first."""

    def one(w: Column, i: Column) -> Column:
        small = F.get(low, i)
        first = F.substring(w, 1, 1)
        unit = F.when(small.isin(UNITS), F.lit("<unit>"))
        number = F.when(w.rlike(r"^[0-9]+([.,][0-9]+)*$"), F.lit("<num>"))
        name = F.when((first != F.lower(first)) & (F.length(w) > 1) & (F.substring(w, 2, 1) == F.substring(small, 2, 1)), F.lit("<name>"))
        plain = F.when((w >= "a") & (w < "{"), F.coalesce(unit, small))
        return plain.when((w >= "0") & (w < ":"), F.coalesce(number, small)).otherwise(F.coalesce(unit, name, small))

    return F.transform(own, one)


def hashed(rows: DataFrame, sizes: list[int], keep: list[str]) -> DataFrame:
    """`keep`, and columns hl<n> and hc<n>: the hash of each window of n words at each place of l and c (at the last
    places windows are cut off and their hashes mean nothing).  A window's hash is made of the hashes of two shorter
    ones, so that eight words cost three steps.  Each step is a projection that carries on only what later ones read."""
    parts: dict[int, tuple[int, int]] = {}
    todo = list(sizes)
    while todo:
        size = todo.pop()
        if size > 1 and size not in parts:
            left = 1 << ((size - 1).bit_length() - 1)
            parts[size] = (left, size - left)
            todo += parts[size]
    names = {"l": 0, "c": 1}
    rows = rows.select(*keep, *(_word_hashes(x, salt).alias(f"h{x}1") for x, salt in names.items()))
    have = {1}
    for size in sorted(parts):
        left, right = parts[size]
        have.add(size)
        later = {p for other, pair in parts.items() if other > size for p in pair} | set(sizes)
        old = [f"h{x}{n}" for n in sorted(have & later - {size}) for x in names]
        rows = rows.select(*keep, *old, *(_longer(f"h{x}{left}", f"h{x}{right}", left).alias(f"h{x}{size}") for x in names))
        have &= later
    return rows


def _word_hashes(source: str, salt: int) -> Column:
    return F.transform(source, lambda w: F.xxhash64(w, F.lit(salt)))


def _longer(a: str, b: str, left: int) -> Column:
    return F.transform(a, lambda x, i: F.xxhash64(x, F.get(F.col(b), i + left)))


def bitmap(windows: DataFrame, n: int) -> tuple[Column, int]:
    """A set of hashes as a constant array of 64-bit words, and its bits, for n hashes."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << max(n * HASH_BITS - 1, 1).bit_length()))
    at = F.col("h").bitwiseAND(F.lit(size - 1))
    # words that have a bit: MOST_BITS / 64 rows at the most
    set_ = windows.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(h & 63 AS INT))")).alias("b")).collect()
    held = [0] * (size // 64)
    for r in set_:
        held[r["w"]] = r["b"]
    return F.from_json(F.lit(json.dumps(held)), "array<bigint>"), size


def _in(bits: Column, size: int, h: Column) -> Column:
    at = h.bitwiseAND(F.lit(size - 1))
    return F.getbit(F.get(bits, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1


def _places(hs: Column, size: int, kind: int, bits: Column, n_bits: int) -> Column:
    """(size, kind, pos, h, dl) of those windows of a text, of one size and kind, whose hash is in `bits`; dl are a
    template window's words."""
    last = F.col("n") - size
    every = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    hit = F.filter(every, lambda i: _in(bits, n_bits, F.get(hs, i)))
    own = lambda i: F.slice("l", i + 1, size) if kind else F.lit(None).cast("array<string>")
    return F.transform(hit, lambda i: F.struct(F.lit(size).alias("size"), F.lit(kind).alias("kind"), i.alias("pos"), F.get(hs, i).alias("h"), own(i).alias("dl")))


def contaminated(documents: DataFrame, items: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, item_id, n_matched, n_windows, coverage and kind (verbatim or reparameterised) of each such pair."""
    text = F.col("text").cast("string")
    raw = items.select(F.col("item_id").cast("long").alias("item_id"), text.alias("t")).withColumn("w", words("t"))
    own = raw.where(F.size("w") >= LEAST).withColumns({"l": F.transform("w", lambda x: F.lower(x)), "size": F.least(F.size("w"), F.lit(WINDOW))})
    own = own.withColumn("c", template(F.col("w"), F.col("l")))
    sizes = sorted(r["size"] for r in own.select("size").distinct().collect()) or [WINDOW]  # WINDOW at the most
    own = hashed(own.withColumn("n", F.size("w")), sizes, ["item_id", "size", "n", "c", "l"])
    # each item has one size; the hashes of its places are in the columns of that size
    own = own.withColumns({f"h{x}": F.coalesce(*(F.when(F.col("size") == n, F.col(f"h{x}{n}")) for n in sizes)) for x in ("l", "c")})
    places = own.select("item_id", "size", "n", "c", "l", "hl", "hc", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("size"))).alias("ipos"))
    cut = places.select("item_id", "size", "n", "ipos", *(F.slice(x, F.col("ipos") + 1, F.col("size")).alias(x) for x in ("c", "l")), *(F.get(x, F.col("ipos")).alias(x) for x in ("hl", "hc")))
    plain = F.size(F.filter("c", lambda x: ~x.startswith("<")))
    cut = cut.withColumns({"plain": plain, "strong": plain >= F.least(F.lit(PLAIN), F.col("size") - 1)})
    both = cut.withColumn("kinds", F.when((F.col("plain") > 0) & (F.col("plain") < F.col("size")) & (F.col("size") >= LEAST_TEMPLATE), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    of = F.col("kind") == 1
    windows = both.withColumn("kind", F.explode("kinds")).select("item_id", "size", "n", "ipos", "kind", "strong", (F.col("plain") > 0).alias("worded"), F.when(of, F.col("hc")).otherwise(F.col("hl")).alias("h"), F.when(of, F.col("c")).alias("ic"), F.when(of, F.col("l")).alias("il"))
    windows = scratch.table(windows, "windows")
    totals = windows.groupBy("item_id").agg(F.countDistinct("ipos").alias("n_all"), F.countDistinct(F.when(F.col("worded"), F.col("ipos"))).alias("n_worded"), F.max("n").alias("n_words"))
    n_windows = windows.count()
    bounded = n_windows <= BROADCAST_WINDOWS
    small = F.broadcast if bounded else (lambda x: x)

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), words(text).alias("w")).select("doc_id", "w", F.transform("w", lambda x: F.lower(x)).alias("l"))
    docs = docs.select("doc_id", F.size("w").alias("n"), "l", template(F.col("w"), F.col("l")).alias("c"))
    docs = hashed(docs, sizes, ["doc_id", "n", "l"])
    # places whose hash an item may have are found inside the arrays, by a constant set of bits, before any row is made
    bits, n_bits = bitmap(windows, n_windows)
    lists = [_places(F.col(f"h{x}{size}"), size, kind, bits, n_bits) for size in sizes for kind, x in enumerate(("l", "c"))]
    each = docs.select("doc_id", F.explode(F.concat(*lists)).alias("x")).select("doc_id", "x.*")
    met = each.join(small(windows), ["h", "kind", "size"])
    met = met.select("doc_id", "item_id", (F.col("pos") - F.col("ipos")).alias("shift"), "ipos", "kind", "strong", "worded", "ic", "il", "dl")
    met = scratch.table(met, "met")

    # slots of template matches: consistent if item values and document values of an alignment pair off; by strong
    # windows alone, and over all windows
    key = ["doc_id", "item_id", "shift"]
    at = F.posexplode(F.arrays_zip("ic", "il", "dl")).alias("k", "s")
    cells = met.where("kind = 1").select(*key, "strong", "ipos", at).select(*key, "strong", (F.col("ipos") + F.col("k")).alias("at"), "s.*")
    slots = cells.where("ic LIKE '<%'").groupBy(*key, "ic", "il", "dl").agg(F.max("strong").alias("strong"))
    same = [F.col(f"m.{k}").eqNullSafe(F.col(f"x.{k}")) for k in key]

    def consistent(found: DataFrame, of: DataFrame) -> DataFrame:
        clash = of.groupBy(*key, "ic", "il").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key).union(of.groupBy(*key, "ic", "dl").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key)).distinct()
        return found.alias("m").join(clash.alias("x"), same, "left_anti")

    def covered(good: DataFrame, total: str, way: str) -> DataFrame:
        whole = good.union(met.where("kind = 0" if total == "n_all" else "kind = 0 AND worded").select(*key, "ipos", F.lit(True)))
        counted = whole.groupBy("doc_id", "item_id", "ipos").agg(F.max("verbatim").alias("verbatim")).groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_matched"), F.count_if("verbatim").alias("n_verbatim"))
        out = counted.join(small(totals), "item_id").withColumn("n_windows", F.col(total)).where(F.col("n_matched") >= COVER * F.col("n_windows"))
        return out.select("doc_id", "item_id", F.lit(way).alias("way"), "n_matched", "n_windows", "n_verbatim")

    template_met = met.where("kind = 1").select(*key, "strong", "ipos")
    strong = consistent(template_met.where("strong"), slots.where("strong")).select(*key, "ipos", F.lit(False).alias("verbatim"))
    # an alignment's words that are alike, each place once
    alike = cells.where("ic NOT LIKE '<%' OR il = dl").select(*key, "at").distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    need = F.greatest(F.lit(LEAST), F.least(F.lit(PLAIN), F.ceil(F.col("n_words") / 2)))
    said = alike.join(small(totals), "item_id").where(F.col("n") >= need).select(*key)
    wide = consistent(template_met, slots).select(*key, "ipos").alias("m").join(said.alias("x"), same, "left_semi").withColumn("verbatim", F.lit(False))
    # a pair that both ways find is reported by the strong windows
    ways = covered(strong, "n_all", "1 strong").union(covered(wide, "n_worded", "2 wide"))
    out = ways.groupBy("doc_id", "item_id").agg(F.min(F.struct("way", "n_matched", "n_windows", "n_verbatim")).alias("x")).select("doc_id", "item_id", "x.n_matched", "x.n_windows", "x.n_verbatim")
    # items of one or two words
    tiny = raw.where(F.size("w").between(1, LEAST - 1)).select("item_id", F.transform("w", lambda x: F.lower(x)).alias("l"))
    if not tiny.isEmpty():  # else documents need not be read for them
        alone = documents.select(F.col("doc_id").cast("long").alias("doc_id"), words(text).alias("w")).where(F.size("w").between(1, LEAST - 1)).select("doc_id", F.transform("w", lambda x: F.lower(x)).alias("l"))
        one = F.lit(1).cast("long")
        out = out.unionByName(alone.join(tiny, "l").select("doc_id", "item_id", one.alias("n_matched"), one.alias("n_windows"), one.alias("n_verbatim")).distinct())
    kind = F.when(F.col("n_verbatim") >= COVER * F.col("n_windows"), "verbatim").otherwise("reparameterised")
    return out.select("doc_id", "item_id", "n_matched", "n_windows", (F.col("n_matched") / F.col("n_windows")).alias("coverage"), kind.alias("kind"))


def cleaned(documents: DataFrame, items: DataFrame, scratch: Scratch) -> DataFrame:
    """Documents that no item contaminates, in their own columns."""
    bad = scratch.table(contaminated(documents, items, scratch).select("doc_id").distinct(), "bad")
    return documents.join(bad.alias("bad"), documents["doc_id"].cast("long").eqNullSafe(F.col("bad.doc_id")), "left_anti")
