"""Retrieval methods over questions: what each gives as evidence, and the parts of the walk that decide."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import json_of, triple_text
from ..schema import Config
from . import retrieval, search
from .graph import ego_units

DEFAULT = Config()
_NONE = "array<string>"


def direct(questions: DataFrame) -> DataFrame:
    """qid, k, h, r, u: no evidence at all."""
    return questions.select("qid", F.lit(0).alias("k"), F.lit("").alias("h"), F.lit("").alias("r"), F.lit("").alias("u")).limit(0)


def known(gold: DataFrame) -> DataFrame:
    """The gold triples (qid, pos, h, r, u) as evidence, in their order, each once."""
    once = gold.groupBy("qid", "h", "r", "u").agg(F.min("pos").alias("pos"))
    return once.select("qid", F.row_number().over(W.partitionBy("qid").orderBy("pos", "h", "r", "u")).alias("k"), "h", "r", "u")


#: Evidence of a question by method: functions of a context, a dictionary of the tables that they need.
METHODS: dict[str, Callable[[dict], DataFrame]] = {
    "direct": lambda x: direct(x["questions"]),
    "know": lambda x: known(x["gold"]),
    "know+": lambda x: known(x["gold"]),
    "fmt": lambda x: retrieval.flat_evidence(x["scores"], x["triples"], x.get("budget", DEFAULT.evidence)),
    "graph": lambda x: retrieval.ego_evidence(x["ranked"], ego_units(x["triples"]), budget=x.get("budget", DEFAULT.evidence)),
    "react": lambda x: react(x["questions"], x["decide"], x["facts"], x["materialise"], keep=x.get("budget", DEFAULT.evidence)),
    "walk": lambda x: search.evidence_rows(x["chains"], x.get("budget", DEFAULT.evidence)),
}


def retrieve(method: str, context: dict) -> DataFrame:
    """qid, k, h, r, u of a method by its name."""
    if method not in METHODS:
        raise ValueError(f"no method {method!r}; there are {', '.join(METHODS)}")
    return METHODS[method](context)


def collected_images(evidence: DataFrame, images: DataFrame, most: int | None = None) -> DataFrame:
    """qid, n, entity, path, caption: images (entity, seq, path, caption) of the evidence's ends, in order of evidence,
    heads before tails, each path once."""
    ends = evidence.select("qid", "k", F.posexplode(F.array("h", "u")).alias("side", "entity"))
    met = ends.join(images, "entity").groupBy("qid", "path").agg(F.min(F.struct("k", "side", "seq", "entity", "caption")).alias("at"))
    out = met.select("qid", F.row_number().over(W.partitionBy("qid").orderBy("at", "path")).alias("n"), "at.entity", "path", "at.caption")
    return out if most is None else out.where(F.col("n") <= most)


def evidence_text(evidence: DataFrame, images: DataFrame, hidden: DataFrame | None = None, most: int = 3, arrows: bool = True) -> DataFrame:
    """qid, text: what an answerer reads.  images: qid, n, entity, path, caption; hidden: qid, path whose caption is the
    answer and stays blank."""
    edge = F.concat_ws("", F.lit("- "), "h", F.lit(" --"), "r", F.lit("--> "), "u") if arrows else F.concat(F.lit("- "), triple_text(F.col("h"), F.col("r"), F.col("u")))
    lines = evidence.select("qid", F.lit(0).alias("s"), F.col("k").cast("long").alias("n"), edge.alias("line"))
    pictures = images.where(F.col("n") <= most)
    caption = F.coalesce("caption", F.lit(""))
    if hidden is not None:
        pictures = pictures.join(hidden.select("qid", "path", F.lit(True).alias("hide")).distinct(), ["qid", "path"], "left")
        caption = F.when(F.col("hide"), F.lit("")).otherwise(caption)
    shown = pictures.select("qid", F.lit(1).alias("s"), F.col("n").cast("long").alias("n"), F.concat(F.lit("- [image of "), "entity", F.lit("] "), caption).alias("line"))
    both = lines.unionByName(shown)
    return both.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "n", "line"))), lambda x: x["line"]), "\n").alias("text"))


def decomposed(question: Column, reply: Column, most: int = 2, mentions: int = 4) -> tuple[Column, Column]:
    """(sub-queries, mentions) from a model's reply {subqueries, mentions}: the question itself first, then what differs
    from it, letter case aside; a reply that can't be read gives the question alone."""
    got = json_of(reply)
    texts = lambda key: F.filter(F.coalesce(F.from_json(F.get_json_object(got, f"$.{key}"), _NONE), F.array().cast(_NONE)), lambda x: F.trim(x) != "")
    other = F.filter(texts("subqueries"), lambda s: F.lower(F.trim(s)) != F.lower(F.trim(question)))
    return F.slice(F.concat(F.array(question), other), 1, most), F.slice(texts("mentions"), 1, mentions)


def verdict(reply: Column) -> Column:
    """support, partial or reject; partial where the reply says none of them."""
    said = F.get_json_object(json_of(reply), "$.verdict")
    return F.when(said.isin("support", "partial", "reject"), said).otherwise(F.lit("partial"))


def roots(questions: DataFrame, mentions: DataFrame, images: DataFrame, texts: DataFrame, most: int = 2, floor: float = 0.55, image_floor: float = 0.0, alpha: float = DEFAULT.alpha) -> DataFrame:
    """qid, k, name: where a walk begins.  Resolved mentions come first (mentions: qid, pos, name, and near, sim: the most
    similar name where nothing is resolved, taken from `floor` on); then entities by image score (images: qid, name,
    score) as far as there is room; then, where there are fewer than `most`, by alpha * text + (1 - alpha) * image
    (texts: qid, name, score).  There is room for `most`, or for all mentions if they are more."""
    none = F.lit(None).cast("double")
    row = lambda name, pos, i, t, kind: [F.col("qid"), name.alias("name"), pos.cast("double").alias("pos"), i.cast("double").alias("i"), t.cast("double").alias("t"), F.lit(kind).alias("kind")]
    found = F.coalesce("name", F.when(F.col("sim") >= floor, F.col("near")))
    every = mentions.select(*row(found, F.col("pos"), none, none, 0)).unionByName(images.select(*row(F.col("name"), none, F.col("score"), none, 1))).unionByName(texts.select(*row(F.col("name"), none, none, F.col("score"), 2)))
    every = every.unionByName(questions.select(*row(F.lit(None).cast("string"), none, none, none, 3)))
    # a row for each name, of what all three say of it; the question's own figures are sums of them
    one = every.groupBy("qid", "name").agg(F.min("pos").alias("pos"), F.max("i").alias("i"), F.max("t").alias("t"), F.count_if(F.col("kind") == 0).alias("n"), F.count_if(F.col("kind") == 1).alias("p"), F.count_if(F.col("kind") == 2).alias("c"), F.count_if(F.col("kind") == 3).alias("q"))
    own = W.partitionBy("qid")
    one = one.withColumn("room", F.greatest(F.lit(most), F.sum("n").over(own))).withColumn("pictured", F.sum("p").over(own) > 0).withColumn("asked", F.sum("q").over(own) > 0)
    mixed = F.when(F.col("pictured"), F.lit(alpha) * F.col("t") + F.lit(1 - alpha) * F.coalesce("i", F.lit(0.0))).otherwise(F.col("t"))
    place = lambda tier, at: F.struct(F.lit(tier).alias("tier"), at.alias("at"))
    x = F.when(F.col("pos").isNotNull(), place(0, F.col("pos"))).when(F.col("i") >= image_floor, place(1, -F.col("i"))).when(F.col("c") > 0, place(2, -mixed))
    ranked = one.where("asked AND name IS NOT NULL").withColumn("x", x).where("x IS NOT NULL").withColumn("k", F.row_number().over(own.orderBy("x", "name")))
    # the text fill stops at `most`, mentions and images at the room
    return ranked.where((F.col("k") <= F.col("room")) & ((F.col("x.tier") < 2) | (F.col("k") <= most))).select("qid", "k", "name")


def beam_cut(chains: DataFrame, beam: int = DEFAULT.beam) -> DataFrame:
    """The `beam` chains of best score of each sub-query."""
    k = F.row_number().over(W.partitionBy("qid", "subquery").orderBy(F.desc(F.round("score", 9)), "path"))
    return chains.withColumn("k", k).where(F.col("k") <= beam)


def verify_cut(chains: DataFrame, most: int = DEFAULT.verify) -> DataFrame:
    """Chains with `judged`: whether they are among the `most` of best score of their question; the rest have no verdict."""
    k = F.row_number().over(W.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "path"))
    return chains.withColumn("judged", k <= most)


def step_score(rank: Column, n: Column, sim: Column, weight: float = DEFAULT.step_weight) -> Column:
    """weight * (1 - rank / n) + (1 - weight) * sim."""
    return F.lit(weight) * (1 - rank / F.greatest(n, F.lit(1))) + F.lit(1 - weight) * sim


def decisions(shown: DataFrame, replies: DataFrame, cites: int = 8, follows: int = 3) -> DataFrame:
    """qid, path, answered, and the links to cite and to follow, by what a reply names.  shown: qid, path, pos, relation,
    target, incoming; replies: qid, path, reply ({answered, cite: [name], follow: [name]}).  Names are compared without
    letter case and punctuation, a reply may give a name after a colon or several between commas, and of two links with
    one target the later relation counts."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[\s\-_/()\[\]{}.,;:'\"]+", " "))
    own = shown.groupBy("qid", "path", norm(F.col("target")).alias("key")).agg(F.max(F.struct("pos", "relation", "target", "incoming")).alias("link"))
    got = json_of(F.col("reply"))
    listed = lambda key: F.coalesce(F.from_json(F.get_json_object(got, f"$.{key}"), _NONE), F.array().cast(_NONE))
    after = lambda x: F.regexp_replace(x, "(?s)^[^:]*:", "")
    names = lambda key: F.array_distinct(F.filter(F.flatten(F.transform(listed(key), lambda x: F.concat(F.array(norm(x)), F.transform(F.split(after(x), ","), norm)))), lambda x: x != ""))
    base = replies.select("qid", "path", F.coalesce(F.get_json_object(got, "$.answered").cast("boolean"), F.lit(False)).alias("answered"), names("cite").alias("c"), names("follow").alias("f"))
    out = base.select("qid", "path", "answered")
    for column, most, name in (("c", cites, "cite"), ("f", follows, "follow")):
        each = base.select("qid", "path", F.posexplode(column).alias("i", "key")).join(own, ["qid", "path", "key"])
        picked = each.groupBy("qid", "path").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("i", "link"))), lambda x: x["link"]), 1, most).alias(name))
        out = out.join(picked, ["qid", "path"], "left")
    return out


def facts(triples: DataFrame, most: int = 30) -> DataFrame:
    """entity, facts: what an agent is shown of an entity, outgoing then incoming, the first ones."""
    units = ego_units(triples, most)
    return units.groupBy(F.col("name").alias("entity")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "h", "r", "u"))), lambda x: F.struct(x["h"].alias("h"), x["r"].alias("r"), x["u"].alias("u"))).alias("facts"))


def react(questions: DataFrame, decide: Callable[[Column, Column, Column], Column], shown: DataFrame, materialise: Callable[[DataFrame, str], DataFrame], steps: int = 6, keep: int = DEFAULT.evidence, search: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """qid, k, h, r, u: what an agent keeps.  A round is one decision of every question that goes on.

    decide: a column function of question, history and the facts seen so far that gives JSON text {action, arg, keep};
    shown: entity, facts.  Facts are numbered from 1 for good; an agent keeps those it names, in order, each once;
    `expand` shows an entity's facts, `search` (a function of rows qid, arg that gives qid, names) the names it finds."""
    fact = "array<struct<h:string,r:string,u:string>>"
    now = questions.select("qid", "question", F.array().cast(_NONE).alias("history"), F.array().cast(fact).alias("seen"), F.array().cast(fact).alias("kept"))
    over = None
    for i in range(steps):
        reply = json_of(decide(F.col("question"), F.col("history"), F.col("seen")))
        own = now.withColumn("reply", reply).select("qid", "question", "history", "seen", "kept", F.lower(F.trim(F.get_json_object("reply", "$.action"))).alias("action"), F.get_json_object("reply", "$.arg").alias("arg"), F.coalesce(F.from_json(F.get_json_object("reply", "$.keep"), "array<int>"), F.array().cast("array<int>")).alias("numbers"))
        wanted = F.transform(F.filter("numbers", lambda n: (n >= 1) & (n <= F.size("seen"))), lambda n: F.get(F.col("seen"), n - 1))
        own = materialise(own.withColumn("kept", F.array_distinct(F.concat("kept", wanted))), f"react{i}")
        goes = own.where("action IN ('expand', 'search')")
        if goes.isEmpty():  # no question opens anything any more, so that facts need not be met again
            now = own
            break
        ended = own.join(goes.select("qid"), "qid", "left_anti").select("qid", "kept")
        over = ended if over is None else over.unionByName(ended)
        opened = goes.where("action = 'expand'").join(shown, F.col("arg") == F.col("entity"), "left")
        line = F.when(F.col("entity").isNull(), F.concat(F.lit("expand("), "arg", F.lit(") -> no such entity"))).otherwise(F.concat(F.lit("expand("), "arg", F.lit(")")))
        expanded = opened.select("qid", "question", F.array_append("history", line).alias("history"), F.concat("seen", F.coalesce("facts", F.array().cast(fact))).alias("seen"), "kept")
        looked = goes.where("action = 'search'")
        if search is not None:
            looked = looked.join(search(looked.select("qid", "arg")), "qid", "left")
            hits = F.coalesce(F.nullif(F.array_join("names", ", "), F.lit("")), F.lit("nothing"))
        else:
            hits = F.lit("nothing")
        searched = looked.select("qid", "question", F.array_append("history", F.concat(F.lit("search("), "arg", F.lit(") -> "), hits)).alias("history"), "seen", "kept")
        now = expanded.unionByName(searched)
    over = over.unionByName(now.select("qid", "kept"))
    return over.select("qid", F.posexplode(F.slice("kept", 1, keep)).alias("k", "t")).select("qid", (F.col("k") + 1).alias("k"), "t.h", "t.r", "t.u")


def expand_first(question: Column, history: Column, seen: Column) -> Column:
    """The offline agent: it expands the last word of the question, keeps the facts whose tail or relation the question
    names, and finishes."""
    words = F.split(F.trim(question), " ")
    low = F.lower(question)
    named = F.transform(F.filter(F.transform(seen, lambda f, i: F.struct((i + 1).alias("i"), f.alias("f"))), lambda x: F.contains(low, F.lower(F.replace(x["f"]["r"], F.lit("_"), F.lit(" ")))) | F.contains(low, F.lower(x["f"]["u"]))), lambda x: x["i"])
    start = F.to_json(F.struct(F.lit("expand").alias("action"), F.element_at(words, -1).alias("arg"), F.array().cast("array<int>").alias("keep")))
    finish = F.to_json(F.struct(F.lit("finish").alias("action"), F.lit("").alias("arg"), named.alias("keep")))
    return F.when(F.size(history) == 0, start).otherwise(finish)


def ranked_units(queries: DataFrame, units: DataFrame, images: DataFrame | None = None, k: int = 8) -> DataFrame:
    """query_id, id, rank, sim: units by fused vectors.  queries, units: id, embedding and image (null: none); both sides
    are gamma * text + (1 - gamma) * image where there is an image."""
    from . import vectors

    def fused(df: DataFrame) -> DataFrame:
        text_, image = vectors.unit(F.col("embedding")), vectors.unit(F.col("image"))
        return df.select("id", F.when(F.col("image").isNull(), text_).otherwise(vectors.unit(vectors.fuse(text_, image))).alias("embedding"))

    return vectors.similar(fused(queries), fused(units), k=k)
