"""Graph operators over tables of triples (h, r, u, seq) and entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import CONFUSABLE, Config

DEFAULT = Config()


def merge(candidates: DataFrame) -> DataFrame:
    """Candidates with sources to triples: identity (h, r, u), earliest seq, distinct sources in order of first seq."""
    once = candidates.groupBy("h", "r", "u", "source").agg(F.min("seq").alias("seq"))
    own = F.array_sort(F.collect_list(F.struct("seq", "source")))
    return once.groupBy("h", "r", "u").agg(F.min("seq").alias("seq"), F.transform(own, lambda x: x["source"]).alias("sources"))


def valid(candidates: DataFrame) -> DataFrame:
    """Candidates with all three parts, that do not link a name with itself."""
    full = [F.trim(F.col(c)) != "" for c in ("h", "r", "u")]
    return candidates.where(full[0] & full[1] & full[2] & (F.lower(F.trim("h")) != F.lower(F.trim("u"))))


def endpoints(triples: DataFrame) -> DataFrame:
    """Names of all entities that triples need."""
    return triples.select(F.explode(F.array("h", "u")).alias("name")).distinct()


def degrees(triples: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """name, degree: both ends count, a self-loop twice; with `names`, those alone and 0 where no triple has one."""
    found = triples.select(F.explode(F.array("h", "u")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("degree"))
    if names is None:
        return found
    return names.join(found, "name", "left").select("name", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def class_degrees(triples: DataFrame) -> DataFrame:
    """name, n_in, n_out, n_class (is_a in): three counters in one pass."""
    ends = triples.select(F.explode(F.array(F.struct(F.col("h").alias("name"), F.lit(True).alias("out"), F.lit(False).alias("cls")), F.struct(F.col("u").alias("name"), F.lit(False).alias("out"), (F.col("r") == "is_a").alias("cls")))).alias("e")).select("e.*")
    return ends.groupBy("name").agg(F.count_if(~F.col("out")).alias("n_in"), F.count_if("out").alias("n_out"), F.count_if("cls").alias("n_class"))


def stats(triples: DataFrame, texts: DataFrame, images: DataFrame) -> DataFrame:
    """Six counts of a graph in one row: each table is aggregated once and joined as one row."""
    t = triples.agg(F.count(F.lit(1)).alias("triples"), F.countDistinct("r").alias("relations"))
    e = endpoints(triples).agg(F.count(F.lit(1)).alias("entities"))
    x = texts.select("entity", "text").distinct().agg(F.count(F.lit(1)).alias("text_attributes"))
    i = images.agg(F.count(F.lit(1)).alias("images"), F.countDistinct("entity").alias("multimodal_entities"))
    # one row each, so that this is no product of tables
    one = F.lit(1).alias("k")
    return t.select(one, "*").join(e.select(one, "*"), "k").join(x.select(one, "*"), "k").join(i.select(one, "*"), "k").drop("k")


def tails(triples: DataFrame) -> DataFrame:
    """h, r, n and its tails as one sorted text."""
    return triples.groupBy("h", "r").agg(F.countDistinct("u").alias("n"), F.array_join(F.array_sort(F.collect_set("u")), ";").alias("tails"))


def heads(triples: DataFrame) -> DataFrame:
    """u, r, n (distinct heads)."""
    return triples.groupBy("u", "r").agg(F.countDistinct("h").alias("n"))


def relation_class(r: Column, classes: dict[str, str] | None = None) -> Column:
    """core, taxonomic or weak; core where nothing is said."""
    out = F.lit("core")
    for name, cls in (classes if classes is not None else DEFAULT.relation_class).items():
        out = F.when(r == name, F.lit(cls)).otherwise(out)
    return out


def hubs(triples: DataFrame, least: int = DEFAULT.hub_degree) -> DataFrame:
    return degrees(triples).where(F.col("degree") >= least).select("name")


def sinks(triples: DataFrame, least: int = DEFAULT.sink_degree) -> DataFrame:
    """Names that many triples point at: poor answers."""
    return triples.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select(F.col("u").alias("name"))


def confusable_group(r: Column) -> Column:
    """The first group of relations that holds r, else null."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(CONFUSABLE))):
        out = F.when(r.isin(CONFUSABLE[i]), F.lit(i)).otherwise(out)
    return out


def unforked(triples: DataFrame) -> DataFrame:
    """(h, r) with exactly one distinct tail, and that tail."""
    return triples.groupBy("h", "r").agg(F.min("u").alias("u"), F.max("u").alias("u2")).where("u = u2").drop("u2")


def unconfusable(triples: DataFrame) -> DataFrame:
    """(h, r) where h has no second relation of r's group; relations without a group always pass."""
    pairs = triples.select("h", "r").distinct().withColumn("grp", confusable_group(F.col("r")))
    alone = pairs.where("grp IS NOT NULL").groupBy("h", "grp").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("r")).where("n = 1").select("h", "r")
    return pairs.where("grp IS NULL").select("h", "r").unionByName(alone)


def steps(triples: DataFrame) -> DataFrame:
    """Edges that a described path may take: the only tail of (h, r), and r without a rival.  One aggregate by head."""
    only = unforked(triples).withColumn("grp", confusable_group(F.col("r")))
    rivals = triples.select("h", confusable_group(F.col("r")).alias("grp"), "r").where("grp IS NOT NULL").groupBy("h", "grp").agg(F.countDistinct("r").alias("n")).where("n > 1").select("h", "grp")
    return only.join(rivals, ["h", "grp"], "left_anti").select("h", "r", "u")


def resolve(mentions: DataFrame, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """mention -> name: the exact name, else the lower-cased key.  A name beats any alias for a key, the later name
    (by seq) beats an earlier one, the first alias beats later ones."""
    keyed = names.select(F.lower(F.trim("name")).alias("key"), "name", F.lit(0).alias("tier"), "seq")
    by_name = keyed.groupBy("key").agg(F.max_by("name", "seq").alias("n0"))
    by_alias = aliases.select(F.lower(F.trim("alias")).alias("key"), "name", "seq").groupBy("key").agg(F.min_by("name", "seq").alias("n1"))
    keys = by_name.join(by_alias, "key", "full").select("key", F.coalesce("n0", "n1").alias("folded"))
    exact = names.select(F.col("name").alias("exact")).distinct()
    left = mentions.join(exact, F.col("mention") == F.col("exact"), "left").withColumn("key", F.lower(F.trim("mention")))
    return left.join(keys, "key", "left").select("mention", F.coalesce("exact", "folded").alias("name"))


def classes_of(types: Column, kind: Column) -> Column:
    """An entity's classes: its types, else its one type, else none."""
    return F.coalesce(types, F.when(kind.isNotNull(), F.array(kind)), F.array().cast("array<string>"))


def members(edges: DataFrame, links: DataFrame, triples: DataFrame) -> DataFrame:
    """Edges (h, r, u) with `held`, whether they are among triples, and `linked`, whether some link joins h to u."""
    own = triples.select("h", "r", "u", F.lit(True).alias("_t")).distinct()
    near = links.select("h", "u", F.lit(True).alias("_l")).distinct()
    return edges.join(own, ["h", "r", "u"], "left").join(near, ["h", "u"], "left").select(*edges.columns, F.col("_t").isNotNull().alias("held"), F.col("_l").isNotNull().alias("linked"))


def keep_texts(texts: DataFrame, cap: int = DEFAULT.text_cap) -> DataFrame:
    """The last `cap` distinct texts of each entity, by first occurrence."""
    once = texts.groupBy("entity", "text").agg(F.min("seq").alias("seq"))
    rank = F.row_number().over(W.partitionBy("entity").orderBy(F.desc("seq")))
    return once.withColumn("rank", rank).where(F.col("rank") <= cap)


def keep_images(images: DataFrame, cap: int = DEFAULT.image_cap) -> DataFrame:
    """The first `cap` distinct paths of each entity."""
    once = images.groupBy("entity", "path").agg(F.min("seq").alias("seq"), F.min_by("caption", "seq").alias("caption"))
    rank = F.row_number().over(W.partitionBy("entity").orderBy("seq"))
    return once.withColumn("rank", rank).where(F.col("rank") <= cap)


def ego_units(triples: DataFrame, most: int = 12) -> DataFrame:
    """name, rank, h, r, u: an entity's outgoing, then incoming edges, first ones only."""
    out = triples.select(F.col("h").alias("name"), F.lit(0).alias("dir"), "seq", "h", "r", "u")
    inn = triples.select(F.col("u").alias("name"), F.lit(1).alias("dir"), "seq", "h", "r", "u")
    rank = F.row_number().over(W.partitionBy("name").orderBy("dir", "seq"))
    return out.unionByName(inn).withColumn("rank", rank).where(F.col("rank") <= most).select("name", "rank", "h", "r", "u")


def drop_edges(triples: DataFrame, rate: float, seed: str = "0") -> DataFrame:
    """Triples left after a reproducible random drop: decided by each triple's own hash."""
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "h", "r", "u").cast("binary")), 1, 8), 16, 10).cast("long")
    return triples.where(draw >= int(rate * (1 << 32)))
