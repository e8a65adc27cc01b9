"""Benchmark templates as queries: each gives the whole population that a sampler would draw from; `quota` keeps a
reproducible share of it, by a hash of the item's own signature, so that no partitioning changes the choice."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import VISUAL, visual_terms
from ..schema import CONTRAST_WEIGHT, Config
from ..storage import Steps
from . import graph as G
from .order import numbered

DEFAULT = Config()


def joined(values: Column, mark: str = ";") -> Column:
    return F.array_join(F.array_sort(values), mark)


def chains(triples: DataFrame, k: int, hub_degree: int = DEFAULT.hub_degree, sink_degree: int = DEFAULT.sink_degree, materialise: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Paths of k described steps: start, path, endpoint.  The rules are applied to edges before any join, so what is
    joined is at most one edge for each (h, r).  With `materialise`, triples and usable edges are written once and each
    hop is one join of written tables."""
    keep = materialise or (lambda df, name: df)
    triples = keep(triples.select("h", "r", "u"), "edges")
    hub, sink = G.hubs(triples, hub_degree), G.sinks(triples, sink_degree)
    flags = G.steps(triples).withColumn("cls", G.relation_class(F.col("r")))
    flags = flags.join(hub.select(F.col("name").alias("u"), F.lit(True).alias("hub")), "u", "left").join(sink.select(F.col("name").alias("u"), F.lit(True).alias("sink")), "u", "left")
    edges = keep(flags.select("h", "r", "u", "cls", F.col("hub").isNotNull().alias("hub"), F.col("sink").isNotNull().alias("sink")), "usable")
    inner = edges.where("cls = 'core' AND NOT hub").select("h", "r", "u")
    last = edges.where("cls <> 'weak' AND NOT sink").select("h", "r", "u")
    step = lambda r, u: F.concat(F.lit("-"), r, F.lit(">"), u)
    now = (last if k == 1 else inner).select(F.col("h").alias("start"), F.array("h", "u").alias("nodes"), F.concat("h", step(F.col("r"), F.col("u"))).alias("path"), F.col("u").alias("at"))
    for i in range(1, k):
        nxt = (last if i == k - 1 else inner).select(F.col("h").alias("at"), F.col("r").alias("nr"), F.col("u").alias("nu"))
        now = now.join(nxt, "at").where(~F.array_contains("nodes", F.col("nu"))).select("start", F.array_append("nodes", F.col("nu")).alias("nodes"), F.concat("path", step(F.col("nr"), F.col("nu"))).alias("path"), F.col("nu").alias("at"))
    return now.select("start", "path", F.col("at").alias("endpoint"))


def predicates(triples: DataFrame, least: int, most: int) -> DataFrame:
    """h, r, u, n: core predicates (r, u) of so many distinct heads, with their heads."""
    core = triples.where(G.relation_class(F.col("r")) == "core").select("h", "r", "u").distinct()
    sized = core.groupBy("r", "u").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(least, most))
    return core.join(sized, ["r", "u"])


def intersections(triples: DataFrame, hub_degree: int = DEFAULT.hub_degree, least: int = 2, most: int = 60) -> DataFrame:
    """Pairs of predicates of different relation and object that some, but on neither side all, heads satisfy, none of
    them a hub.  Pairs come from heads that are no hubs, whose predicates are few; a pair that a hub has too is known by
    the hubs of its two predicates (`most` names at the most), so that no hub's predicates are paired."""
    p = predicates(triples, least, most)
    flag = G.hubs(triples, hub_degree).select(F.col("name").alias("h"), F.lit(True).alias("hub"))
    own = p.join(flag, "h", "left")
    held = own.groupBy("r", "u").agg(F.collect_set(F.when(F.col("hub"), F.col("h"))).alias("hubs"))
    plain = own.where("hub IS NULL").join(held, ["r", "u"])
    a, b = (plain.select("h", *(F.col(c).alias(f"{c}{i}") for c in ("r", "u", "n", "hubs"))) for i in (1, 2))
    met = a.join(b, "h").where("struct(r1, u1) < struct(r2, u2) AND r1 <> r2 AND u1 <> u2 AND NOT arrays_overlap(hubs1, hubs2)")
    out = met.groupBy("r1", "u1", "n1", "r2", "u2", "n2").agg(F.count(F.lit(1)).alias("n"), joined(F.collect_list("h")).alias("answer"))
    return out.where("n <> n1 AND n <> n2").select("r1", "u1", "r2", "u2", "n", "answer")


def absences(triples: DataFrame, hub_degree: int = DEFAULT.hub_degree, least: int = 3, most: int = 8, low: float = 0.25, high: float = 0.8) -> DataFrame:
    """Ordered pairs of predicates where the second takes a real share, but not all, out of the first."""
    p = predicates(triples, least, most)
    own = p.join(G.hubs(triples, hub_degree), F.col("h") == F.col("name"), "left_anti")
    sizes = own.groupBy("r", "u").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    population = own.join(sizes, ["r", "u"]).select("h", F.col("r").alias("r1"), F.col("u").alias("u1"), "size")
    excluded = p.select("h", F.col("r").alias("r2"), F.col("u").alias("u2"))
    key = ["r1", "u1", "size", "r2", "u2"]
    shares = population.join(excluded, "h").where("r1 <> r2 OR u1 <> u2").groupBy(*key).agg(F.count(F.lit(1)).alias("removed"), F.collect_set("h").alias("out")).where((F.col("removed") / F.col("size")).between(low, high))
    members = population.groupBy("r1", "u1").agg(F.collect_set("h").alias("all"))  # `most` names at the most
    return shares.join(members, ["r1", "u1"]).select("r1", "u1", "r2", "u2", "size", "removed", joined(F.array_except("all", "out")).alias("answer"))


def contrast_weight(r: Column) -> Column:
    weight = F.lit(1.0)
    for name, w in CONTRAST_WEIGHT.items():
        weight = F.when(r == name, F.lit(w)).otherwise(weight)
    return weight


def comparatives(triples: DataFrame, materialise: Callable[[DataFrame, str], DataFrame], typed: DataFrame | None = None, reach: int = 3, trickle: float = 0.2) -> DataFrame:
    """class, a, b, r, weight and both sides' values: siblings of a class (by is_a, and `typed`: name, class) with the
    axis on which they differ most.  Each member is paired with the next `reach` ones in the hash order of its class, the
    last with the first again, so that a class of n gives about reach * n pairs, and one of up to 2 * reach + 1 all
    its pairs.  Pairs whose axes are all of little weight (geographic ones) stay only as a `trickle`, chosen by hash."""
    member = triples.where("r = 'is_a'").select(F.col("u").alias("class"), F.col("h").alias("a"))
    member = member if typed is None else member.unionByName(typed.select("class", F.col("name").alias("a")))
    placed = materialise(numbered(member.distinct().withColumn("d", F.md5(F.col("a").cast("binary"))), ["class"], ["d", "a"], materialise, "siblings"), "placed")
    sizes = placed.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    after = placed.join(sizes, "class").select("class", "a", F.explode(F.transform(F.sequence(F.lit(1), F.lit(reach)), lambda i: F.pmod(F.col("place") + i, F.col("n")))).alias("place"))
    met = after.join(placed.select("class", "place", F.col("a").alias("b")), ["class", "place"]).where("a <> b")
    pairs = met.select("class", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tails = G.tails(triples.where(G.relation_class(F.col("r")) == "core")).select("h", "r", "tails")
    left = pairs.join(tails.select(F.col("h").alias("a"), "r", F.col("tails").alias("left_values")), "a")
    both = left.join(tails.select(F.col("h").alias("b"), "r", F.col("tails").alias("right_values")), ["b", "r"]).where("left_values <> right_values")
    best = both.withColumn("weight", contrast_weight(F.col("r"))).groupBy("class", "a", "b").agg(F.min(F.struct((-F.col("weight")).alias("m"), "r", "left_values", "right_values")).alias("x"))
    out = best.select("class", "a", "b", "x.r", (-F.col("x.m")).alias("weight"), "x.left_values", "x.right_values")
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", "class", "a", "b").cast("binary")), 1, 8), 16, 10).cast("long")
    return out.where((F.col("weight") >= 1) | (draw < int(trickle * (1 << 32))))


def temporals(triples: DataFrame, facts: int = 4, makers: int = 2) -> DataFrame:
    """Dated entities with their first core facts and first makers."""
    dated = triples.where("r = 'origin_year' AND u RLIKE '^[0-9]{3,4}'").select("h", F.col("u").alias("year"))
    out = triples.where((F.col("r") != "origin_year") & (G.relation_class(F.col("r")) == "core")).join(dated.select("h").distinct(), "h", "left_semi")
    own = out.withColumn("k", F.row_number().over(W.partitionBy("h").orderBy("seq"))).where(F.col("k") <= facts).groupBy("h").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat_ws("=", "r", "u").alias("x")))), lambda s: s["x"]), ";").alias("developments"), F.count(F.lit(1)).alias("n1"))
    inn = triples.where("r IN ('produces', 'made_by')").join(dated.select(F.col("h").alias("u")).distinct(), "u", "left_semi")
    made = inn.withColumn("k", F.row_number().over(W.partitionBy("u").orderBy("seq"))).where(F.col("k") <= makers).groupBy(F.col("u").alias("h")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda s: s["h"]), ";").alias("makers"), F.count(F.lit(1)).alias("n2"))
    full = dated.join(own, "h", "left").join(made, "h", "left").where("n1 IS NOT NULL OR n2 IS NOT NULL")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return full.select("h", "year", F.coalesce("developments", F.lit("")).alias("developments"), F.coalesce("makers", F.lit("")).alias("makers"), (1 + n("n1") + n("n2")).cast("long").alias("hops"))


def oldest(triples: DataFrame, most: int = 5) -> DataFrame:
    """The earliest dated entities."""
    return triples.where("r = 'origin_year'").select(F.expr("try_cast(regexp_extract(u, '^([0-9]{3,4})', 1) AS INT)").alias("year"), F.col("h").alias("entity"), F.col("u").alias("raw")).where("year IS NOT NULL").orderBy("year", "entity", "raw").limit(most)


def commonest(triples: DataFrame, relations: list[str], most: int = 4) -> DataFrame:
    """The most common objects of some relations; ties go to the one seen first."""
    n = triples.where(F.col("r").isin(relations)).groupBy("r", "u").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    rank = F.row_number().over(W.partitionBy("r").orderBy(F.desc("n"), "first"))
    return n.withColumn("rank", rank).where(F.col("rank") <= most).select("r", "rank", "u", "n")


def extrema(triples: DataFrame, relations: list[str], support: int = 8) -> DataFrame:
    """r, answer, n, runners_up and the first triples that say so, of the most common object of each relation."""
    ranked = commonest(triples, relations)
    label = F.concat("u", F.lit(" ("), "n", F.lit(")"))
    next_ = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") > 1, F.struct("rank", label.alias("x"))))), lambda s: s["x"]), ", ")
    top = ranked.groupBy("r").agg(F.max(F.when(F.col("rank") == 1, F.col("u"))).alias("answer"), F.max("n").alias("n"), next_.alias("runners_up"))
    own = triples.join(top.select("r", F.col("answer").alias("u")), ["r", "u"])
    first = own.withColumn("k", F.row_number().over(W.partitionBy("r").orderBy("seq"))).where(F.col("k") <= support)
    gold = first.groupBy("r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda s: s["h"]), ";").alias("support"))
    return top.join(gold, "r").select("r", "answer", "n", "runners_up", "support")


def aggregations(extremes: DataFrame, differences: DataFrame, n: int, share: float = 0.15, seed: str = "7") -> DataFrame:
    """mode, qid: n aggregation items, a share of them extrema as far as there are any, the rest absences.  Both sides
    have qid; which ones is decided by hash."""
    wanted = round(n * share)
    first = quota(extremes, wanted, "extremum", seed).select(F.lit("extremum").alias("mode"), "qid")
    have = first.count()  # `wanted` at the most
    return first.unionByName(quota(differences, n - have, "absence", seed).select(F.lit("absence").alias("mode"), "qid"))


def visual_subjects(triples: DataFrame, images: DataFrame, hub_degree: int = DEFAULT.hub_degree) -> DataFrame:
    """Imaged entities that are no hubs, with up to three core facts (identify) and one fact by hash (attribute)."""
    imaged = images.select(F.col("entity").alias("h")).distinct().join(G.hubs(triples, hub_degree).select(F.col("name").alias("h")), "h", "left_anti")
    facts = triples.where(G.relation_class(F.col("r")) == "core").join(imaged, "h", "left_semi")
    ranked = facts.withColumn("k", F.row_number().over(W.partitionBy("h").orderBy("seq")))
    own = ranked.groupBy("h").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= 3, F.struct("k", F.concat_ws("=", "r", "u").alias("x"))))), lambda s: s["x"]), ";").alias("facts"))
    usable = facts.join(G.hubs(triples, hub_degree).select(F.col("name").alias("u")), "u", "left_anti")
    one = usable.groupBy("h").agg(F.min(F.struct(F.md5(F.col("seq").cast("binary")).alias("d"), "r", "u")).alias("x"))
    return own.join(one, "h", "left").select(F.col("h").alias("subject"), "facts", F.col("x.r").alias("relation"), F.col("x.u").alias("value"))


def grounded(triples: DataFrame, images: DataFrame, hub_degree: int = DEFAULT.hub_degree) -> DataFrame:
    """subject, relation, value: imaged entities that are no hubs, with one core fact about no hub, by hash.  Such items name
    their subject and are off by default (a quota of 0), and cleaning drops them."""
    out = visual_subjects(triples, images, hub_degree)
    return out.where("relation IS NOT NULL").select("subject", "relation", "value")


def visual_terminals(triples: DataFrame, images: DataFrame, hub_degree: int = DEFAULT.hub_degree, words: int = 10, terms: int = 4) -> DataFrame:
    """name, path, caption, terms: images of entities that are no hubs whose caption has `words` words, a visual one, and
    `terms` terms beyond the entity's name; six terms are kept."""
    hub = G.hubs(triples, hub_degree).select(F.col("name").alias("entity"))
    said = images.where((F.size(F.split(F.trim("caption"), r"\s+")) >= words) & F.col("caption").rlike(rf"(?iU)\b({VISUAL})\b")).join(hub, "entity", "left_anti")
    own = said.withColumn("t", visual_terms(F.col("caption"), F.col("entity"))).where(F.size("t") >= terms)
    return own.select(F.col("entity").alias("name"), "path", "caption", F.array_join(F.slice("t", 1, 6), ";").alias("terms"))


def visual_chains(triples: DataFrame, terminals: DataFrame, k: int, hub_degree: int = DEFAULT.hub_degree) -> DataFrame:
    """Paths of k steps that end in a terminal (name, terms), built backwards: core, unforked, heads no hubs."""
    hub = G.hubs(triples, hub_degree)
    back = G.unforked(triples).where(G.relation_class(F.col("r")) == "core").join(hub, F.col("h") == F.col("name"), "left_anti").select(F.col("h").alias("ph"), F.col("r").alias("pr"), F.col("u").alias("at"))
    now = terminals.select(F.col("name").alias("at"), F.array("name").alias("nodes"), F.col("name").alias("path"), F.col("name").alias("endpoint"), "terms")
    for _ in range(k):
        now = now.join(back, "at").where(~F.array_contains("nodes", F.col("ph"))).select(F.col("ph").alias("at"), F.array_append("nodes", F.col("ph")).alias("nodes"), F.concat("ph", F.lit("-"), "pr", F.lit(">"), "path").alias("path"), "endpoint", "terms")
    return now.select(F.col("at").alias("start"), "path", "endpoint", "terms")


def identified(items: DataFrame, *parts: str, name: str = "item") -> DataFrame:
    """Items with a content-addressed qid over their own values."""
    return items.withColumn("qid", F.concat(F.lit(f"{name}-"), F.substring(F.sha1(F.concat_ws("|", *parts).cast("binary")), 1, 10)))


def quota(items: DataFrame, n: int, kind: str, seed: str = "7", key: str = "qid") -> DataFrame:
    """The n items of least hash of seed, kind and key."""
    return items.withColumn("draw", F.md5(F.concat_ws(":", F.lit(seed), F.lit(kind), key).cast("binary"))).orderBy("draw", key).limit(n)


def fillable(items: DataFrame, most: int = DEFAULT.most_atoms) -> DataFrame:
    """Items (atoms, gold: arrays) that have gold triples and 1 to `most` answer atoms."""
    return items.where((F.size("gold") > 0) & F.size("atoms").between(1, most))


def signature(kind: Column, mode: Column, atoms: Column, gold: Column) -> Column:
    """What makes two items the same: type, mode, sorted atoms and sorted gold triples."""
    edges = F.array_sort(F.transform(gold, lambda t: F.concat_ws("|", t["h"], t["r"], t["u"])))
    return F.sha1(F.concat_ws("~", kind, F.coalesce(mode, F.lit("")), F.array_join(F.array_sort(atoms), ";"), F.array_join(edges, ";")).cast("binary"))


def filled_quotas(items: DataFrame, quotas: dict[str, int], seed: str = "7") -> DataFrame:
    """Of each type as many fillable items of different signature as its quota says, by hash.  items: qid, type, mode,
    atoms, gold.  A rank by type is cut before its shuffle, and a type without a quota has none."""
    own = fillable(items).withColumn("sig", signature(F.col("type"), F.col("mode"), F.col("atoms"), F.col("gold")))
    once = own.groupBy("type", "sig").agg(F.min("qid").alias("qid"))
    draw = F.md5(F.concat_ws(":", F.lit(seed), "type", "sig").cast("binary"))
    limit = F.lit(0)
    for kind, n in quotas.items():
        limit = F.when(F.col("type") == kind, F.lit(n)).otherwise(limit)
    ranked = once.withColumn("k", F.row_number().over(W.partitionBy("type").orderBy(draw, "sig")))
    return ranked.where(F.col("k") <= max([0, *quotas.values()])).where(F.col("k") <= limit).select("type", "qid", "k")


def visual_floor(items: DataFrame, share: float, order: str = "qid", materialise: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Drop text items, the last ones in `order`, until the share of visual ones is reached; all stay if it is met.  The
    number that stays is reckoned as SQL does: the product in decimals, then a division of doubles."""
    materialise = materialise or Steps(items.sparkSession, "floor")
    items = materialise(items, "items")
    rest = Decimal(1) - Decimal(str(share))
    keep = items.agg(F.floor((F.count_if("multimodal") * F.lit(rest)).cast("double") / F.lit(float(share))).alias("keep")).first()["keep"]
    texts = numbered(items.where("NOT multimodal"), [], [order], materialise, "texts").where(F.col("place") < keep)
    return items.where("multimodal").unionByName(texts.drop("place"))


def stratified(items: DataFrame, n: int, seed: str = "7") -> DataFrame:
    """n items spread over types by their share (half-even rounding, one at least), chosen by hash within a type."""
    sizes = items.groupBy("type").agg(F.count(F.lit(1)).alias("size"))
    total = sizes.agg(F.sum("size").alias("total"))
    take = sizes.join(F.broadcast(total), F.lit(True))  # one row on the right
    take = take.select("type", F.greatest(F.lit(1), F.bround(F.lit(float(n)) * F.col("size") / F.col("total"))).cast("long").alias("take"))
    draw = F.md5(F.concat_ws(":", F.lit(seed), "qid").cast("binary"))
    ranked = items.withColumn("draw", draw).withColumn("k", F.row_number().over(W.partitionBy("type").orderBy("draw", "qid")))
    return ranked.join(F.broadcast(take), "type").where("k <= take").select("qid", "type", "draw").orderBy("draw", "qid").limit(n)


def sticky_split(items: DataFrame, prior: DataFrame, dev: int, seed: str = "7") -> DataFrame:
    """qid, split: assignments of a prior split (qid, split) never change; dev is filled up to its size with new items
    spread over types, and all other new items are test.  Items that are gone drop out."""
    old = prior.join(items.select("qid"), "qid", "left_semi").select("qid", "split")
    fresh = items.join(prior.select("qid"), "qid", "left_anti")
    have = old.where("split = 'dev'").count()  # `dev` or so at the most
    taken = stratified(fresh, max(0, dev - have), seed).select("qid", F.lit("dev").alias("split"))
    rest = fresh.join(taken.select("qid"), "qid", "left_anti").select("qid", F.lit("test").alias("split"))
    return old.unionByName(taken).unionByName(rest)


#: Templates by name, functions of a context: triples, images (where they are asked for) and materialise.
TEMPLATES: dict[str, Callable[[dict], DataFrame]] = {
    **{f"chain{k}": lambda x, k=k: chains(x["triples"], k, materialise=x["materialise"]) for k in (2, 3, 4, 5)},
    "intersection": lambda x: intersections(x["triples"]),
    "comparative": lambda x: comparatives(x["triples"], x["materialise"], x.get("typed")),
    "temporal": lambda x: temporals(x["triples"]),
    "aggregation_extremum": lambda x: extrema(x["triples"], x.get("relations", ["made_from", "produced_in", "used_for", "located_in"])),
    "aggregation_absence": lambda x: absences(x["triples"]),
    **{f"mm_chain{k}": lambda x, k=k: visual_chains(x["triples"], visual_terminals(x["triples"], x["images"]), k) for k in (2, 3)},
    "multimodal_identify": lambda x: visual_subjects(x["triples"], x["images"]).select("subject", "facts"),
    "multimodal_attribute": lambda x: visual_subjects(x["triples"], x["images"]).where("value IS NOT NULL").select("subject", "relation", "value"),
    "multimodal_grounded": lambda x: grounded(x["triples"], x["images"]),
}
#: Items of each template where nothing else is said; grounded ones are off.
QUOTA = dict.fromkeys(TEMPLATES, 200) | {"multimodal_grounded": 0}


def drawn(context: dict, quotas: dict[str, int] | None = None, seed: str = "7") -> DataFrame:
    """type, qid, item (JSON): of every template the items of least hash, as many as its quota says."""
    out = None
    for name, n in (QUOTA | (quotas or {})).items():
        if not n:
            continue
        rows = TEMPLATES[name](context)
        whole = F.to_json(F.struct(*sorted(rows.columns)))
        own = rows.select(F.lit(name).alias("type"), whole.alias("item")).distinct()
        own = own.select("type", F.concat(F.lit("item-"), F.substring(F.sha1(F.concat_ws("|", "type", "item").cast("binary")), 1, 10)).alias("qid"), "item")
        part = quota(own, n, name, seed).select("type", "qid", "item")
        out = part if out is None else out.unionByName(part)
    return out
