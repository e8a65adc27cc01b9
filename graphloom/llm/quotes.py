"""Conversations without quotations, in order of replies.

A line's quote level is the number of leading `>` marks.  A passage is a run of lines of one level; a line that
introduces a quotation ("... wrote:") goes with what it introduces.  Passages and own texts are normalised (small
letters, words alone) and hashed: the whole, its paragraphs and, for quotations that were cut, its sentences.
Paragraphs and sentences of fewer than LEAST words say too little and aren't hashed; a short passage is only
known as a whole message.

Hashes of quoted passages are joined to messages of the same conversation that say them in their own words.  Each
hash counts for the latest message before the quotation, with its words; the message with most words is the
passage's original.  What is not found so is looked for in all conversations (whole passages and paragraphs; the
first message by conv_id and turn).  The latest original in the conversation of a message's level-1 passages is what
it replies to.  Passages with an original are taken out of the text; those without one stay, marks and all.

Messages that reply to nothing known begin a thread.  A conversation's messages stand in the order of thread (the turn
it began at), depth and turn: each follows what it replies to.

The search for the latest saying is a running maximum over globally sorted rows in bounded parts, and conversations are
built in parts of PART messages, so that neither a sentence nor a conversation that holds a third of all rows meets
in one task.

Defined results: a null text is empty; a null conv_id or turn takes no part in links (such rows are in a conversation
null, or last in theirs); rows that repeat conv_id and turn share what they say and reply to, and stay separate; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, text_chunks

#: Words of a paragraph or sentence that is hashed, at least; messages of a built part of a conversation.
LEAST, PART = 4, 64

_MARKS = re.compile(r"(?:[ \t]*>)+")
_INTRODUCES = re.compile(r"\b(wrote|writes|schrieb|écrit|escribió)\b.*:\s*$", re.IGNORECASE)
_SENTENCE = re.compile(r"[.!?]+(?:\s+|$)")
_WORD = re.compile(r"\w+")


def passages(text: str) -> list[tuple[int, str, str]]:
    """(level, text, raw) of each run of lines of one quote level.  A line that introduces a quotation is in the raw lines
    of the passage that it introduces, and in no text."""
    lines = []
    for line in text.split("\n"):
        m = _MARKS.match(line)
        lines.append((m.group().count(">"), line[m.end() :].removeprefix(" "), line) if m else (0, line, line))
    follows, ahead = [0] * len(lines), 0  # the level of the next line that says something
    for i in range(len(lines) - 1, -1, -1):
        follows[i] = ahead
        if lines[i][1].strip():
            ahead = lines[i][0]
    out: list[tuple[int, list[str], list[str]]] = []
    held: list[str] = []
    for (level, line, raw), next_level in zip(lines, follows, strict=True):
        if next_level > level and _INTRODUCES.search(line):
            held.append(raw)
            continue
        if held and not line.strip():  # between the introduction and what it introduces
            held.append(raw)
            continue
        if not out or out[-1][0] != level or held:
            out.append((level, [], held))
            held = []
        out[-1][1].append(line)
        out[-1][2].append(raw)
    if held:
        out.append((0, [], held))
    return [(level, "\n".join(own), "\n".join(raw)) for level, own, raw in out]


def _normal(text: str) -> tuple[str, int]:
    found = _WORD.findall(text.lower())
    return " ".join(found), len(found)


def hashes(text: str) -> dict[int, int]:
    """Hash to words of the whole of a passage, of its paragraphs and of its sentences."""
    kinds = [("w", [text], 1), ("p", re.split(r"\n\s*\n", text), LEAST), ("s", _SENTENCE.split(text), LEAST)]
    out = {}
    for kind, parts, least in kinds:
        for said, n in map(_normal, parts):
            if n >= least:
                out[xxhash.xxh64_intdigest(f"{kind} {said}") - (1 << 63)] = n
    return out


def own_text(text: str, linked=None) -> str:
    """A message without the passages of these numbers (None: without any quotation)."""
    kept = [raw for k, (level, _, raw) in enumerate(passages(text)) if level == 0 or (linked is not None and k not in linked)]
    return "\n".join(kept).strip()


_UNITS = "conv_id long, turn long, crc long, k int, level int, h long, words int, foreign boolean"


def units(messages: DataFrame) -> DataFrame:
    """A row for each hash: conv_id, turn, crc (of the text), k (passage), level, h, words, and foreign (whether it is long
    enough to be looked for in other conversations)."""

    def run(batches):
        for batch in batches:
            for part, _, _ in text_chunks(batch):
                out: list[tuple] = []
                for c, t, text in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                    text = text or ""
                    crc, own = zlib.crc32(text.encode()), passages(text)
                    said = "\n\n".join(p for level, p, _ in own if level == 0)
                    out += [(c, t, crc, -1, 0, h, n, False) for h, n in hashes(said).items()]
                    for k, (level, quoted, _) in enumerate(own):
                        if level:
                            out += [(c, t, crc, k, level, h, n, n >= LEAST) for h, n in hashes(quoted).items()]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_())
                for i in range(0, len(out), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out[i : i + 50_000], strict=True), kinds, strict=True)], [f.split()[0] for f in _UNITS.split(", ")])

    named = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("text").cast("string")).where("conv_id IS NOT NULL AND turn IS NOT NULL")
    return named.mapInArrow(run, _UNITS)


def numbered(df: DataFrame, scratch: Scratch, name: str, *order: str) -> DataFrame:
    """df, written, with `part` and `at`: rows ascend by the order columns over ascending parts and places in them."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = scratch.table(ordered.withColumn("at", F.monotonically_increasing_id()), name)
    return rows.withColumns({"part": F.shiftright("at", 33), "at": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))})


def latest(quoted: DataFrame, said: DataFrame, scratch: Scratch) -> DataFrame:
    """quoted (conv_id, turn, h, ...) with source: the latest turn before its own at which its conversation says h."""
    wanted = scratch.table(quoted.select("conv_id", "h").distinct(), "wanted")
    sayings = said.join(wanted, ["conv_id", "h"], "left_semi").select("conv_id", "h", "turn").distinct()
    asked = quoted.select("conv_id", "h", "turn").distinct()
    # a saying of the same turn is later than the question: a message doesn't quote itself
    both = asked.withColumn("says", F.lit(False)).union(sayings.withColumn("says", F.lit(True)))
    rows = numbered(both, scratch, "sorted", "conv_id", "h", "turn", "says")
    key = ["conv_id", "h"]
    # a key goes on over parts only at their ends: what earlier parts said, a row for each of its parts
    ends = rows.where("says").groupBy(*key, "part").agg(F.max("turn").alias("top"))
    spread = rows.groupBy(*key).agg(F.min("part").alias("first"), F.max("part").alias("last")).where("first < last").select(*key)
    over = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.select(*key, "part").distinct().join(spread, key, "left_semi").join(ends, [*key, "part"], "left")
    carried = parts.withColumn("before", F.max("top").over(over)).select(*key, "part", "before")
    inside = Window.partitionBy(*key, "part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("here", F.max(F.when(F.col("says"), F.col("turn"))).over(inside)).where("NOT says").join(carried, [*key, "part"], "left")
    found = found.select(*key, "turn", F.coalesce("here", "before").alias("source")).where("source IS NOT NULL")
    return quoted.join(scratch.table(found, "latest"), [*key, "turn"])


def link(messages: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, turn, crc, k, level, from_conv, source (turn) and words of every passage whose original is known."""
    every = scratch.table(units(messages), "units")
    said = every.where("level = 0")
    quoted = scratch.table(every.where("level > 0"), "quoted")
    passage = ["conv_id", "turn", "crc", "k", "level"]
    met = latest(quoted.select(*passage, "h", "words"), said, scratch)
    votes = met.groupBy(*passage, "source").agg(F.sum("words").alias("words"))
    near = votes.groupBy(*passage).agg(F.max(F.struct("words", "source")).alias("x"))
    near = scratch.table(near.select(*passage, F.col("conv_id").alias("from_conv"), "x.source", "x.words"), "near")
    rest = quoted.where("foreign").join(near, passage, "left_anti").select(*passage, "h", "words")
    first = said.join(rest.select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.min(F.struct("conv_id", "turn")).alias("of"))
    first = scratch.table(first.select("h", F.col("of.conv_id").alias("from_conv"), F.col("of.turn").alias("source")), "first")
    far = rest.join(first, "h").where("from_conv <> conv_id").groupBy(*passage, "from_conv", "source").agg(F.sum("words").alias("words"))
    far = far.groupBy(*passage).agg(F.max(F.struct("words", (-F.col("from_conv")).alias("c"), "source")).alias("x"))
    return scratch.table(near.union(far.select(*passage, (-F.col("x.c")).alias("from_conv"), "x.source", "x.words")), "links")


def threads(links: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, turn, parent, thread and depth of every message that replies to another, by doubling of pointers."""
    parents = links.where("level = 1 AND from_conv = conv_id").groupBy("conv_id", "turn").agg(F.max("source").alias("parent"))
    now = parents.select("conv_id", "turn", "parent", F.col("parent").alias("thread"), F.lit(1).cast("long").alias("depth"))
    now, k = scratch.table(now, "jump0"), 0
    while True:
        up = now.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("t2"), F.col("depth").alias("d2"))
        both = now.join(up, ["conv_id", "thread"], "left")
        k += 1
        now = scratch.table(both.select("conv_id", "turn", "parent", F.coalesce("t2", "thread").alias("thread"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), F.col("t2").isNotNull().alias("moved")), f"jump{k}")
        if now.where("moved").isEmpty():
            return now.drop("moved")
        now = now.drop("moved")


def unquoted(messages: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, turn, role, text (without the passages whose original is known), parent, thread, depth, n_quoted
    (passages taken out) and n_foreign (those of them that other conversations say), a row for each message."""
    links = link(messages, scratch)
    placed = scratch.table(threads(links, scratch), "placed")
    out = links.groupBy("conv_id", "turn", "crc").agg(F.collect_set("k").alias("ks"), F.count(F.lit(1)).cast("int").alias("n_quoted"), F.count_if(F.col("from_conv") != F.col("conv_id")).cast("int").alias("n_foreign"))
    named = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = named.withColumn("crc", F.crc32(F.col("text").cast("binary"))).join(scratch.table(out, "out"), ["conv_id", "turn", "crc"], "left").drop("crc")

    def run(batches):
        for batch in batches:
            for part, _, _ in text_chunks(batch):
                texts = [t if ks is None else own_text(t, set(ks)) for t, ks in zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(texts, pa.string()), *part.columns[5:]], ["conv_id", "turn", "role", "text", "n_quoted", "n_foreign"])

    plain = rows.select("conv_id", "turn", "role", "text", "ks", "n_quoted", "n_foreign").mapInArrow(run, "conv_id long, turn long, role string, text string, n_quoted int, n_foreign int")
    zero = {c: F.coalesce(c, F.lit(0)).cast("int") for c in ("depth", "n_quoted", "n_foreign")}
    return plain.join(placed, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", "text", "parent", F.coalesce("thread", "turn").alias("thread"), *(zero[c].alias(c) for c in zero))


def positions(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows of unquoted() with position: their place in their conversation's order of replies, from 0."""
    keyed = rows.withColumns({"last": F.col("thread").isNull(), "none": F.col("conv_id").isNull()})
    placed = numbered(keyed, scratch, "ordered", "none", "conv_id", "last", "thread", "depth", "turn", "role", "text").drop("none", "last")
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    base = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))  # a row for each part
    global_ = placed.join(F.broadcast(base), "part").withColumn("row", F.col("base") + F.col("at")).drop("part", "at", "base")
    first = scratch.table(global_.groupBy("conv_id").agg(F.min("row").alias("first")), "starts")
    joined = global_.join(first.withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of")))
    return joined.withColumn("position", F.col("row") - F.col("first")).drop("of", "row", "first")


def conversations(messages: DataFrame, scratch: Scratch) -> DataFrame:
    """A row for each PART messages of a conversation: conv_id, part, n_messages, their turns, parents and depths in order
    of replies, n_quoted, n_foreign, and their texts as `role: text`, on lines of their own."""
    rows = positions(unquoted(messages, scratch), scratch)
    line = F.struct("position", "turn", "parent", "depth", F.concat_ws(": ", "role", "text").alias("line"))
    # a part holds PART messages at the most
    built = rows.withColumn("part", F.floor(F.col("position") / PART)).groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(line)).alias("x"), F.sum("n_quoted").alias("n_quoted"), F.sum("n_foreign").alias("n_foreign"))
    return built.select("conv_id", "part", F.size("x").alias("n_messages"), F.col("x.turn").alias("turns"), F.col("x.parent").alias("parents"), F.col("x.depth").alias("depths"), "n_quoted", "n_foreign", F.array_join(F.transform("x", lambda m: m["line"]), "\n").alias("text"))
