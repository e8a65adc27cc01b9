"""Pages: bounded views of entities, their text, and notes for export."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import safe_name
from ..schema import Config
from .order import numbered, spread

DEFAULT = Config()


def links(triples: DataFrame) -> DataFrame:
    """name, relation, target, incoming, seq: each triple seen from both ends."""
    out = triples.select(F.col("h").alias("name"), F.col("r").alias("relation"), F.col("u").alias("target"), F.lit(False).alias("incoming"), "seq")
    return out.unionByName(triples.select(F.col("u").alias("name"), F.col("r").alias("relation"), F.col("h").alias("target"), F.lit(True).alias("incoming"), "seq"))


def budget(triples: DataFrame, per_relation: int = DEFAULT.per_relation, per_page: int = DEFAULT.per_page) -> DataFrame:
    """name, relation, n, take, truncated.  Relations with fewer links come first; a running sum replaces the loop."""
    n = links(triples).groupBy("name", "relation").agg(F.count(F.lit(1)).alias("n"))
    m = F.least("n", F.lit(per_relation))
    before = F.sum(m).over(W.partitionBy("name").orderBy("n", "relation").rowsBetween(W.unboundedPreceding, 0)) - m
    take = F.greatest(F.lit(0), F.least(m, F.lit(per_page) - before))
    return n.withColumn("take", take.cast("long")).withColumn("truncated", F.col("n") - F.col("take"))


def page_links(triples: DataFrame, per_relation: int = DEFAULT.per_relation, per_page: int = DEFAULT.per_page) -> DataFrame:
    """The links that pages show: outgoing ones of a relation first, in order of seq, as far as the budget goes."""
    rank = F.row_number().over(W.partitionBy("name", "relation").orderBy("incoming", "seq"))
    # Spark cuts such a ranking before its shuffle, so that a hub sends on few rows of a relation
    shown = links(triples).withColumn("k", rank).where(F.col("k") <= per_relation)
    return shown.join(budget(triples, per_relation, per_page).select("name", "relation", "take", "truncated"), ["name", "relation"]).where(F.col("k") <= F.col("take"))


def render(triples: DataFrame, images: DataFrame, entities: DataFrame | None = None, shown: int = 3, chars: int = 90) -> DataFrame:
    """name, page: heading, alias, kind and text lines (entities: name, aliases, types, text), images (the captions of the
    first ones), facts, and what mentions it, by relation.  A page shows what its budget allows, so its parts are few."""
    links_ = page_links(triples)
    more = F.when(F.col("truncated") > 0, F.concat(F.lit("  (+"), "truncated", F.lit(" more)"))).otherwise(F.lit(""))
    one = links_.groupBy("name", "incoming", "relation", "truncated").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "target"))), lambda s: s["target"]), ", ").alias("t"))
    line = F.struct("incoming", "relation", F.concat(F.lit("- "), "relation", F.lit(": "), "t", more).alias("line"))
    own = one.groupBy("name").agg(F.array_sort(F.collect_list(line)).alias("x"))
    part = lambda inc, title: F.when(F.exists("x", lambda s: s["incoming"] == inc), F.concat(F.lit(title), F.array_join(F.transform(F.filter("x", lambda s: s["incoming"] == inc), lambda s: s["line"]), "\n")))
    text = own.select("name", part(False, "## Facts\n").alias("facts"), part(True, "## Mentioned by\n").alias("mentions"))
    caption = F.substring(F.coalesce(F.nullif("caption", F.lit("")), F.lit("(uncaptioned)")), 1, chars)
    first = images.withColumn("k", F.row_number().over(W.partitionBy("entity").orderBy("seq"))).where(F.col("k") <= shown)
    counts = images.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    captions = first.groupBy("entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", caption.alias("c")))), lambda s: s["c"]), " | ").alias("c"))
    head = counts.join(captions, "entity").select(F.col("entity").alias("name"), F.concat(F.lit("["), "n", F.lit(" image(s)] "), "c").alias("images"))
    page = text.join(head, "name", "left")
    parts = [F.concat(F.lit("# "), "name")]
    if entities is not None:
        said = lambda c, title: F.when(F.size(c) > 0, F.concat(F.lit(title), F.array_join(c, ", "))).alias(f"_{c}")
        page = page.join(entities.select("name", said("aliases", "Also known as: "), said("types", "Kind: "), F.when(F.size("text") > 0, F.array_join("text", "\n")).alias("_text")), "name", "left")
        parts += ["_aliases", "_types", "_text"]
    return page.select("name", F.concat_ws("\n\n", *parts, "images", "facts", "mentions").alias("page"))


def notes(triples: DataFrame, materialise: Callable[[DataFrame, str], DataFrame], texts: DataFrame | None = None, images: DataFrame | None = None, part: int = 1000) -> DataFrame:
    """file, part, note: Markdown of each name with all its texts (entity, seq, text), relations, mentions and images
    (entity, seq, path).  File names are unique, letter case aside.  A note of more than `part` lines goes on in further
    rows, in order, so that no name is gathered into one value however many links it has."""
    all_links = links(triples)
    line = F.when(F.col("incoming"), F.concat(F.lit("- [["), "target", F.lit("]] "), "relation")).otherwise(F.concat(F.lit("- "), "relation", F.lit(" [["), "target", F.lit("]]")))
    rows = all_links.select("name", F.when(F.col("incoming"), 2).otherwise(1).alias("section"), F.col("seq").cast("string").alias("seq"), line.alias("line"))
    for extra, section, column, text in ((texts, 0, "text", lambda c: c), (images, 3, "path", lambda c: F.concat(F.lit("![["), c, F.lit("]]")))):
        if extra is not None:
            rows = rows.unionByName(extra.select(F.col("entity").alias("name"), F.lit(section).alias("section"), F.format_string("%020d", F.col("seq").cast("long")).alias("seq"), text(F.col(column)).alias("line")))
    title = lambda section: F.element_at(F.array(*map(F.lit, ["## Text", "## Relations", "## Mentioned by", "## Images"])), section + 1)
    degree = F.count_if(F.col("section").isin(1, 2)).alias("degree")
    names = materialise(rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), degree).where("degree > 0"), "note_names")
    long = materialise(names.where(F.col("n") + 4 > part).select("name", "degree"), "note_long")  # with its titles; a row for `part` lines at the least
    named = numbered(names.select("name", safe_name(F.col("name")).alias("file")).withColumn("low", F.lower("file")), ["low"], ["name"], materialise, "note_files")
    named = named.select("name", F.concat("file", F.when(F.col("place") > 0, F.concat(F.lit("-"), F.col("place") + 1)).otherwise(F.lit("")), F.lit(".md")).alias("file"))
    head = F.when(F.col("part") == 0, F.concat(F.lit("---\nname: "), "name", F.lit("\ndegree: "), "degree", F.lit("\n---\n"))).otherwise(F.lit(""))
    told = lambda body: body.join(named, "name").select("file", F.col("part").cast("int").alias("part"), F.concat(head, "lines").alias("note"))
    listed = lambda x: F.array_join(F.transform(F.array_sort(x), lambda s: s["line"]), "\n")
    # a short note is one group of lines, which are sent once
    short = spread(rows.join(F.broadcast(long.select("name")), "name", "left_anti"), "name").groupBy("name").agg(F.collect_list(F.struct("section", "seq", "line")).alias("x"), degree).where("degree > 0")
    titles = F.transform(F.array_distinct(F.transform("x", lambda s: s["section"])), lambda n: F.struct(n.alias("section"), F.lit("").alias("seq"), title(n).alias("line")))
    short = short.select("name", "degree", F.lit(0).alias("part"), listed(F.concat("x", titles)).alias("lines"))
    # only lines of long ones get places in a global order
    big = rows.join(F.broadcast(long.select("name")), "name", "left_semi")
    big = big.unionByName(big.select("name", "section", F.lit("").alias("seq"), title(F.col("section")).alias("line")).distinct())
    placed = numbered(big, ["name"], ["section", "seq", "line"], materialise, "note_lines").withColumn("part", F.floor(F.col("place") / part).cast("int"))
    body = placed.groupBy("name", "part").agg(listed(F.collect_list(F.struct("place", "line"))).alias("lines")).join(F.broadcast(long), "name")
    return told(short).unionByName(told(body.select(*short.columns)))


def graphml(triples: DataFrame, names: DataFrame) -> DataFrame:
    """ord, row: the lines of a GraphML document (header 0, nodes 1, edges 2, footer 3).  names: name, degree, and where
    they are known n_images, from which multimodal follows."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    spark = triples.sparkSession
    names = names if "n_images" in names.columns else names.withColumn("n_images", F.lit(0))
    kinds = [("degree", "node", "long"), ("n_images", "node", "long"), ("multimodal", "node", "boolean"), ("relation", "edge", "string")]
    keys = "".join(f'<key id="{k}" for="{on}" attr.name="{k}" attr.type="{t}"/>' for k, on, t in kinds)
    ends = spark.createDataFrame([(0, f'<graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="directed">'), (3, "</graph></graphml>")], "ord int, row string")
    data = lambda k, c: F.concat(F.lit(f'<data key="{k}">'), c, F.lit("</data>"))
    multimodal = F.when(F.col("n_images") > 0, "true").otherwise("false")
    nodes = names.select(F.lit(1).alias("ord"), F.concat(F.lit('<node id="'), esc("name"), F.lit('">'), data("degree", "degree"), data("n_images", "n_images"), data("multimodal", multimodal), F.lit("</node>")).alias("row"))
    edges = triples.select(F.lit(2).alias("ord"), F.concat(F.lit('<edge source="'), esc("h"), F.lit('" target="'), esc("u"), F.lit('"><data key="relation">'), esc("r"), F.lit("</data></edge>")).alias("row"))
    return ends.unionByName(nodes).unionByName(edges)
