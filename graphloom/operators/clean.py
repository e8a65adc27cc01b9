"""Cleaning: duplicate spellings, class nodes, annotation, images carried over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import Config
from .graph import class_degrees, degrees, relation_class

DEFAULT = Config()


def surface_key(name: Column) -> Column:
    """Spelling without what is in round brackets, lower-cased, digits, Latin, kana and Han alone."""
    bare = F.regexp_replace(F.regexp_replace(name, r"\([^()]*\)", ""), "（[^（）]*）", "")
    return F.regexp_replace(F.lower(bare), "[^0-9a-z぀-ヿ一-鿿]", "")


def duplicate_spellings(triples: DataFrame, names: DataFrame) -> DataFrame:
    """name -> survivor for names whose key another name shares: highest degree, then shortest, then first by seq."""
    keyed = degrees(triples, names.select("name")).join(names, "name").withColumn("key", surface_key(F.col("name"))).where("key <> ''")
    best = keyed.groupBy("key").agg(F.min(F.struct((-F.col("degree")).alias("d"), F.length("name").alias("l"), "seq", "name")).alias("x"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return keyed.join(best.select("key", F.col("x.name").alias("survivor")), "key").where("name <> survivor").select("name", "survivor")


def remap(triples: DataFrame, to: DataFrame) -> DataFrame:
    """Both ends replaced; self-loops that result go, of equal triples the first (by seq) stays."""
    h, u = to.select(F.col("name").alias("h"), F.col("survivor").alias("h2")), to.select(F.col("name").alias("u"), F.col("survivor").alias("u2"))
    new = triples.join(h, "h", "left").join(u, "u", "left").select(F.coalesce("h2", "h").alias("h"), "r", F.coalesce("u2", "u").alias("u"), "seq")
    return new.where("h <> u").groupBy("h", "r", "u").agg(F.min("seq").alias("seq"))


def merged_attributes(names: DataFrame, aliases: DataFrame, texts: DataFrame, images: DataFrame, to: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(names, aliases, texts, images) after duplicate spellings (to: name, survivor) were merged.  The survivor gets the
    other spelling, what that has in round brackets, and its aliases; its own texts and images come first, then those
    that it lacks.  aliases: alias, name, seq; texts: entity, seq, text; images: entity, seq, path, ..."""
    moved = to.select(F.col("name").alias("entity"), "survivor")
    # a survivor's own rows come before those of the spellings merged into it
    place = lambda df, key: df.join(moved.withColumnRenamed("entity", key), key, "left").withColumn("_late", F.col("survivor").isNotNull()).withColumn(key, F.coalesce("survivor", key)).drop("survivor")
    once = lambda df, *key: df.withColumn("_k", F.row_number().over(W.partitionBy(*key).orderBy("_late", "seq"))).where("_k = 1").drop("_k", "_late")
    spelled = to.select(F.col("name").alias("alias"), F.col("survivor").alias("name"))
    inner = to.select(F.explode(F.regexp_extract_all("name", F.lit(r"(\([^)]*\))"), F.lit(1))).alias("x"), F.col("survivor").alias("name")).select(F.regexp_replace("x", r"^[() ]+|[() ]+$", "").alias("alias"), "name")
    known = place(aliases, "name").select("alias", "name")
    own = known.unionByName(spelled).unionByName(inner).where("alias <> name AND alias <> ''").distinct()
    return names.join(to.select("name"), "name", "left_anti"), own, once(place(texts, "entity"), "entity", "text"), once(place(images, "entity"), "entity", "path")


def type_nodes(triples: DataFrame, attributed: DataFrame, least_in: int = DEFAULT.type_in, share: float = DEFAULT.type_share, most_out: int = DEFAULT.type_out) -> DataFrame:
    """Names that only serve as classes: is_a comes in, little else does, and no text or image is attached."""
    d = class_degrees(triples).where((F.col("n_class") >= least_in) & (F.col("n_class") >= share * F.col("n_in")) & (F.col("n_out") <= most_out))
    return d.join(attributed.select(F.col("entity").alias("name")).distinct(), "name", "left_anti").select("name", "n_class")


def fold(triples: DataFrame, nodes: DataFrame, types: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(types, triples): is_a edges to class nodes become ordered types of their subject, after the type that it had
    (types: name, type)."""
    own = triples.join(nodes.select(F.col("name").alias("u")), "u", "left_semi").where("r = 'is_a'")
    said = own.select(F.col("h").alias("name"), F.lit(1).alias("later"), "seq", F.col("u").alias("type"))
    if types is not None:
        had = types.where("coalesce(type, '') <> ''").join(own.select(F.col("h").alias("name")).distinct(), "name", "left_semi")
        said = said.unionByName(had.select("name", F.lit(0).alias("later"), F.lit("").alias("seq"), "type"))
    once = said.groupBy("name", "type").agg(F.min(F.struct("later", "seq")).alias("at"))
    out = once.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "type"))), lambda x: x["type"]), ";").alias("types"))
    return out, triples.join(own.select("h", "r", "u").distinct(), ["h", "r", "u"], "left_anti")


def left_after_folding(names: DataFrame, nodes: DataFrame, triples: DataFrame) -> DataFrame:
    """Names without the class nodes that no triple left by folding uses."""
    used = triples.select(F.explode(F.array("h", "u")).alias("name")).distinct()
    return names.join(nodes.select("name").join(used, "name", "left_anti"), "name", "left_anti")


def annotate(triples: DataFrame, hub_degree: int = DEFAULT.hub_degree) -> DataFrame:
    """Triples with the class of their relation and whether their tail is a hub."""
    hub = degrees(triples).where(F.col("degree") >= hub_degree).select(F.col("name").alias("u"), F.lit(True).alias("hub"))
    return triples.join(hub, "u", "left").select("h", "r", "u", relation_class(F.col("r")).alias("cls"), F.coalesce("hub", F.lit(False)).alias("into_hub"))


def carry_images(old: DataFrame, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Images of an older graph, placed by name, else by the first alias that matches; null: orphan."""
    by_alias = aliases.groupBy("alias").agg(F.min_by("name", "seq").alias("via_alias"))
    exact = names.select(F.col("name").alias("exact")).distinct()
    return old.join(exact, F.col("entity") == F.col("exact"), "left").join(by_alias, F.col("entity") == F.col("alias"), "left").select("entity", "path", F.coalesce("exact", "via_alias").alias("placed"))


def content_images(images: DataFrame, side: int = 200, pixels: int = 1_000_000, repeats: int = 8) -> DataFrame:
    """Images of distinct bytes, large enough on both sides, that are not small ones of an often repeated size."""
    once = images.groupBy("sha1").agg(F.min(F.struct("path", "w", "h")).alias("x")).select("sha1", "x.*").where((F.col("w") >= side) & (F.col("h") >= side))
    n = once.groupBy("w", "h").agg(F.count(F.lit(1)).alias("n"))
    return once.join(n, ["w", "h"]).where(~((F.col("w") * F.col("h") < pixels) & (F.col("n") >= repeats))).select("path", "w", "h")


def largest_first(names: DataFrame, key: str = "degree", most: int = 10) -> DataFrame:
    """The top rows by a count; names break ties."""
    return names.orderBy(F.desc(key), "name").limit(most)
