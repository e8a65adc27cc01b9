"""Retrieval baselines, candidate tiers and filters of finished items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import names_whole

#: Words that only make sense to someone who sees the graph, and wordings that promise a picture.
JARGON = r"\b(entit(y|ies)|triple|node|graph|relation|dataset|knowledge base)\b"
PROMISE = (
    r"accompan(?:y|ies|ying)|attached (?:image|photo)|provided (?:image|photograph)"
    r"|(?:this|the) photograph (?:below|here)|shown below|pictured below"
)


def ego_evidence(ranked: DataFrame, units: DataFrame, top: int = 3, budget: int = 5) -> DataFrame:
    """qid, k, h, r, u: the edges of a question's `top` best units (qid, name, pos) in order, each once, up to the budget."""
    best = ranked.where(F.col("pos") <= top).join(units, "name")
    once = best.groupBy("qid", "h", "r", "u").agg(F.min(F.struct("pos", "rank")).alias("at"))
    k = F.row_number().over(W.partitionBy("qid").orderBy("at", "h", "r", "u"))
    return once.withColumn("k", k).where(F.col("k") <= budget).select("qid", "k", "h", "r", "u")


def flat_evidence(scores: DataFrame, triples: DataFrame, budget: int = 5) -> DataFrame:
    """qid, k, h, r, u: the triples of best score (qid, seq, sim)."""
    k = F.row_number().over(W.partitionBy("qid").orderBy(F.desc(F.round("sim", 9)), "seq"))
    return scores.withColumn("k", k).where(F.col("k") <= budget).join(triples, "seq").select("qid", "k", "h", "r", "u")


def tiers(*sources: DataFrame, cap: int = 15) -> DataFrame:
    """key, k, name: candidates of several sources (key, name, pos), earlier sources first, each name once, capped."""
    every = None
    for i, s in enumerate(sources):
        part = s.select("key", "name", F.struct(F.lit(i).alias("tier"), F.col("pos").cast("double").alias("pos")).alias("at"))
        every = part if every is None else every.unionByName(part)
    once = every.groupBy("key", "name").agg(F.min("at").alias("at"))
    k = F.row_number().over(W.partitionBy("key").orderBy("at", "name"))
    return once.withColumn("k", k).where(F.col("k") <= cap).select("key", "k", "name")


def named_waypoint(question: Column, waypoints: Column, start: Column) -> Column:
    """Whether a question names a node that its path only passes."""
    return F.exists(waypoints, lambda w: (w != start) & names_whole(question, w))


def drop_reason(question: Column, leaked: Column, subject: Column | None = None, endpoint: Column | None = None, kind: Column | None = None, answer: Column | None = None) -> Column:
    """Why an item goes, first reason first; null: it stays.  leaked: the atoms that its question gives away; subject and
    endpoint: names that it must not hold anywhere (null: none); kind: its type, of which visual chains alone must not
    promise a picture (unset: all must not)."""
    said = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    holds = lambda name: F.contains(F.lower(question), F.lower(name))
    told = said(question) if answer is None else said(question) & said(answer)
    promised = question.rlike(f"(?iU){PROMISE}")
    out = F.when(~told, "not verbalised").when(F.size(leaked) > 0, "leak").when(question.rlike(f"(?iU){JARGON}"), "jargon").when(promised if kind is None else promised & (kind == "mm_chain"), "promised image")
    out = out if endpoint is None else out.when(holds(endpoint), "endpoint named")
    return out if subject is None else out.when(holds(subject), "subject named")


def subjects_of(spec: Column) -> Column:
    """Names that a question may hold, from its spec: none of a hidden subject; the start alone of a hidden caption; else
    start, entity, both sides, and the objects of constraints, population and exclusion."""
    one = lambda name: F.array(spec[name])
    every = F.concat(*(one(c) for c in ("start", "entity", "left", "right")), F.coalesce(spec["constraints"], F.array().cast("array<string>")), one("population"), one("excluded"))
    chosen = F.when(F.coalesce(spec["hide_subject"], F.lit(False)), F.array().cast("array<string>")).when(F.coalesce(spec["hide_caption"], F.lit(False)), one("start")).otherwise(every)
    return F.filter(chosen, lambda x: x.isNotNull())


def item_verdict(question: Column, kind: Column, mode: Column, nodes: Column, subject: Column) -> Column:
    """Why a finished item goes: grounded ones; chains that name a node between start and end; visual ones that name
    their subject as a word; null: it stays.  nodes: those of the path, in order."""
    between = F.slice(nodes, 2, F.greatest(F.size(nodes) - 2, F.lit(0)))
    named = F.exists(between, lambda w: (w != F.get(nodes, F.lit(0))) & names_whole(question, w))
    visual = (kind == "multimodal") & mode.isin("identify", "attribute") & names_whole(question, subject)
    return F.when((kind == "multimodal") & (mode == "grounded"), "grounded").when(kind.isin("chain", "mm_chain") & (F.size(nodes) > 2) & named, "names a waypoint").when(visual, "names the subject")


def filled(items: DataFrame, *sources: DataFrame, key: str = "path") -> DataFrame:
    """Items with the value and the number of the first source (key, value) that has one; null where none has."""
    values = []
    for i, s in enumerate(sources):
        items = items.join(s.groupBy(key).agg(F.min("value").alias(f"_v{i}")), key, "left")
        values.append(F.when(F.col(f"_v{i}").isNotNull(), F.struct(F.col(f"_v{i}").alias("value"), F.lit(i).alias("source"))))
    return items.withColumn("_x", F.coalesce(*values)).select("*", "_x.value", "_x.source").drop("_x", *(f"_v{i}" for i in range(len(sources))))


def still_missing(filled_items: DataFrame) -> DataFrame:
    """n, filled and missing of a fill cascade's result."""
    return filled_items.agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("filled"), F.count_if(F.col("value").isNull()).alias("missing"))
