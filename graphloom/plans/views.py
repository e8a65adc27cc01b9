"""The graph view over the driver's tables, as DataFrames and as the same view in SQL.

`seq` is an ordering key made of the row's own values, so that no global numbering (and no single task) is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _edge(df: DataFrame, h: str, r: str, u: str) -> DataFrame:
    return df.select(F.expr(h).alias("h"), F.lit(r).alias("r"), F.expr(u).alias("u"))


def _once(df: DataFrame, *keys: str) -> DataFrame:
    """The distinct keys of a large table, as numbers, before names are made of them; few of them repeat, so that they are
    dealt first and not grouped where they are read."""
    return spread(df.select(*keys), *keys).distinct()


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """h, r, u, seq.  Only the relations that repeat rows are made distinct, each on its own."""
    t = {n: table(spark, sf_dir, n) for n in ("orders", "customer", "supplier", "nation", "region", "part", "lineitem")}
    nation, region = t["nation"], t["region"]
    parts = [
        _edge(t["orders"], "concat('o', o_orderkey)", "made_by", "concat('c', o_custkey)"),
        _edge(t["orders"], "concat('o', o_orderkey)", "origin_year", "CAST(year(o_orderdate) AS STRING)"),
        _edge(t["orders"], "concat('o', o_orderkey)", "associated_with", "o_orderpriority"),
        _edge(t["customer"].join(nation, F.col("c_nationkey") == F.col("n_nationkey")), "concat('c', c_custkey)", "located_in", "n_name"),
        _edge(t["supplier"].join(nation, F.col("s_nationkey") == F.col("n_nationkey")), "concat('s', s_suppkey)", "located_in", "n_name"),
        _edge(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")), "n_name", "part_of", "r_name"),
        _edge(t["customer"], "concat('c', c_custkey)", "is_a", "c_mktsegment"),
        _edge(t["part"], "concat('p', p_partkey)", "is_a", "p_type"),
        _edge(t["part"], "concat('p', p_partkey)", "produced_by", "p_brand"),
        _edge(t["part"], "concat('p', p_partkey)", "has_property", "concat('size ', p_size)"),
        _edge(_once(t["lineitem"], "l_suppkey", "l_partkey"), "concat('s', l_suppkey)", "produces", "concat('p', l_partkey)"),
        _edge(_once(t["lineitem"], "l_orderkey", "l_partkey"), "concat('o', l_orderkey)", "uses_material", "concat('p', l_partkey)"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("seq", F.concat_ws("|", "r", "h", "u"))


TRIPLES_SQL = """t AS (SELECT *, r || '|' || h || '|' || u AS seq FROM (
  SELECT 'o' || o_orderkey AS h, 'made_by' AS r, 'c' || o_custkey AS u FROM orders
  UNION ALL SELECT 'o' || o_orderkey, 'origin_year', CAST(year(o_orderdate) AS VARCHAR) FROM orders
  UNION ALL SELECT 'o' || o_orderkey, 'associated_with', o_orderpriority FROM orders
  UNION ALL SELECT 'c' || c_custkey, 'located_in', n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 's' || s_suppkey, 'located_in', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT n_name, 'part_of', r_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'c' || c_custkey, 'is_a', c_mktsegment FROM customer
  UNION ALL SELECT 'p' || p_partkey, 'is_a', p_type FROM part
  UNION ALL SELECT 'p' || p_partkey, 'produced_by', p_brand FROM part
  UNION ALL SELECT 'p' || p_partkey, 'has_property', 'size ' || p_size FROM part
  UNION ALL SELECT DISTINCT 's' || l_suppkey, 'produces', 'p' || l_partkey FROM lineitem
  UNION ALL SELECT DISTINCT 'o' || l_orderkey, 'uses_material', 'p' || l_partkey FROM lineitem))"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text attributes of entities: entity, seq, text."""
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("p"), F.col("doc_id") % 50 + 1).alias("entity"), F.col("doc_id").alias("seq"), "text")


TEXTS_SQL = "txt AS (SELECT 'p' || (doc_id % 50 + 1) AS entity, doc_id AS seq, text FROM documents)"


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image attributes of entities: entity, seq, path, caption."""
    caption = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id") % 40 + 1).alias("entity"), F.col("page_id").alias("seq"), F.col("url").alias("path"), caption.alias("caption"))


IMAGES_SQL = "img AS (SELECT 'p' || (page_id % 40 + 1) AS entity, page_id AS seq, url AS path, regexp_extract(html, '<title>([^<]*)</title>', 1) AS caption FROM pages)"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows of three runs over the same questions: run, correct, qid, type, precision, recall, n_calls, seconds, error, answer."""
    o = table(spark, sf_dir, "orders")
    base = o.select(
        F.concat(F.lit("q"), "o_orderkey").alias("qid"), F.col("o_orderpriority").alias("type"), F.col("o_custkey"), F.col("o_orderkey"), F.col("o_orderstatus"),
        (F.col("o_custkey") % 5 / 4).alias("precision"), (F.col("o_orderkey") % 9 / 8).alias("recall"), (F.col("o_custkey") % 7).cast("int").alias("n_calls"), (F.col("o_orderkey") % 1000 / 10).alias("seconds"),
        F.when(F.col("o_orderkey") % 37 == 0, F.concat(F.when(F.col("o_custkey") % 2 == 0, F.lit("timeout")).otherwise(F.lit("overflow")), F.lit(": item "), "o_orderkey")).alias("error"),
    )
    right = {"full": F.col("o_orderstatus") != "F", "flat": F.col("o_custkey") % 3 == 0, "ego": F.col("o_orderkey") % 4 == 0}
    runs = F.array(*(F.struct(F.lit(k).alias("run"), v.alias("correct")) for k, v in right.items()))
    answer = F.when(F.col("o_orderkey") % 41 == 0, F.lit("(answer generation failed: busy)")).otherwise(F.concat(F.lit("it is c"), F.col("o_custkey") % 10))
    out = base.select("*", answer.alias("answer"), F.explode(runs).alias("x")).select("x.run", "x.correct", "*")
    return out.drop("x", "o_custkey", "o_orderkey", "o_orderstatus")


RESULTS_SQL = """res AS (SELECT run, 'q' || o_orderkey AS qid, o_orderpriority AS type,
    CASE run WHEN 'full' THEN o_orderstatus <> 'F' WHEN 'flat' THEN o_custkey % 3 = 0 ELSE o_orderkey % 4 = 0 END AS correct,
    CASE WHEN o_orderkey % 41 = 0 THEN '(answer generation failed: busy)' ELSE 'it is c' || (o_custkey % 10) END AS answer,
    CAST(o_custkey % 5 AS DOUBLE) / 4 AS precision, CAST(o_orderkey % 9 AS DOUBLE) / 8 AS recall,
    CAST(o_custkey % 7 AS INTEGER) AS n_calls, CAST(o_orderkey % 1000 AS DOUBLE) / 10 AS seconds,
    CASE WHEN o_orderkey % 37 = 0 THEN (CASE WHEN o_custkey % 2 = 0 THEN 'timeout' ELSE 'overflow' END) || ': item ' || o_orderkey END AS error
  FROM orders, (VALUES ('full'), ('flat'), ('ego')) v(run))"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted and gold triples of questions: qid, side (pred or gold), h, r, u."""
    l = table(spark, sf_dir, "lineitem")
    base = l.select(F.concat(F.lit("q"), "l_orderkey").alias("qid"), F.concat(F.lit("o"), "l_orderkey").alias("h"), F.lit("uses_material").alias("r"), F.concat(F.lit("p"), "l_partkey").alias("u"), "l_returnflag", "l_linenumber")
    gold = base.where("l_returnflag <> 'N' OR l_linenumber = 1").select("qid", F.lit("gold").alias("side"), "h", "r", "u")
    pred = base.where("l_linenumber % 2 = 1").select("qid", F.lit("pred").alias("side"), F.expr("IF(l_linenumber = 3, u, h)").alias("h"), "r", F.expr("IF(l_linenumber = 3, h, u)").alias("u"))
    return gold.unionByName(pred)


EVIDENCE_SQL = """ev AS (
  SELECT 'q' || l_orderkey AS qid, 'gold' AS side, 'o' || l_orderkey AS h, 'uses_material' AS r, 'p' || l_partkey AS u FROM lineitem WHERE l_returnflag <> 'N' OR l_linenumber = 1
  UNION ALL SELECT 'q' || l_orderkey, 'pred', CASE WHEN l_linenumber = 3 THEN 'p' || l_partkey ELSE 'o' || l_orderkey END, 'uses_material', CASE WHEN l_linenumber = 3 THEN 'o' || l_orderkey ELSE 'p' || l_partkey END FROM lineitem WHERE l_linenumber % 2 = 1)"""


def craft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of low degrees, so that the rules about hubs and sinks leave something: h, r, u, seq.  Customers, parts and
    numbered workshops, villages and provinces; some customers fork or have a rival relation."""
    c, p = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part")
    parts = [
        _edge(c, "concat('c', c_custkey)", "made_from", "concat('p', c_custkey + 1)"),
        _edge(c.where("c_custkey % 10 = 0"), "concat('c', c_custkey)", "made_from", "concat('p', c_custkey + 2)"),
        _edge(c.where("c_custkey % 7 = 0"), "concat('c', c_custkey)", "uses_material", "concat('p', c_custkey + 3)"),
        _edge(p, "concat('p', p_partkey)", "uses_method", "concat('b', p_partkey div 2)"),
        _edge(p, "concat('p', p_partkey)", "has_property", "concat('a', p_partkey div 6)"),
        _edge(p, "concat('p', p_partkey)", "used_for", "concat('d', p_partkey div 4)"),
        _edge(p, "concat('p', p_partkey)", "is_a", "p_type"),
        _edge(p, "concat('b', p_partkey div 2)", "made_by", "concat('v', p_partkey div 6)").distinct(),
        _edge(p, "concat('v', p_partkey div 6)", "located_in", "concat('y', p_partkey div 24)").distinct(),
        _edge(p, "concat('y', p_partkey div 24)", "part_of", "concat('z', p_partkey div 240)").distinct(),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.withColumn("seq", F.concat_ws("|", "r", "h", "u"))


CRAFT_SQL = """t AS (SELECT *, r || '|' || h || '|' || u AS seq FROM (
  SELECT 'c' || c_custkey AS h, 'made_from' AS r, 'p' || (c_custkey + 1) AS u FROM customer
  UNION ALL SELECT 'c' || c_custkey, 'made_from', 'p' || (c_custkey + 2) FROM customer WHERE c_custkey % 10 = 0
  UNION ALL SELECT 'c' || c_custkey, 'uses_material', 'p' || (c_custkey + 3) FROM customer WHERE c_custkey % 7 = 0
  UNION ALL SELECT 'p' || p_partkey, 'uses_method', 'b' || (p_partkey // 2) FROM part
  UNION ALL SELECT 'p' || p_partkey, 'has_property', 'a' || (p_partkey // 6) FROM part
  UNION ALL SELECT 'p' || p_partkey, 'used_for', 'd' || (p_partkey // 4) FROM part
  UNION ALL SELECT 'p' || p_partkey, 'is_a', p_type FROM part
  UNION ALL SELECT DISTINCT 'b' || (p_partkey // 2), 'made_by', 'v' || (p_partkey // 6) FROM part
  UNION ALL SELECT DISTINCT 'v' || (p_partkey // 6), 'located_in', 'y' || (p_partkey // 24) FROM part
  UNION ALL SELECT DISTINCT 'y' || (p_partkey // 24), 'part_of', 'z' || (p_partkey // 240) FROM part))"""
