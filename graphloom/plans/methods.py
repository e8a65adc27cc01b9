"""Queries of retrieval methods, the walk's parts, and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, graph, methods, order, pages, search, vectors
from ..storage import Steps
from . import views
from .registry import COS, query, triples_of
from .views import table

# --------------------------------------------------------------------------- methods by name

#: Questions about orders, and their gold triples, in order.
GOLD = """gold AS (SELECT 'q' || l_orderkey AS qid, l_linenumber AS pos, 'o' || l_orderkey AS h, 'uses_material' AS r, 'p' || l_partkey AS u FROM lineitem WHERE l_returnflag <> 'N')"""


def _gold(spark, d):
    l = table(spark, d, "lineitem").where("l_returnflag <> 'N'")
    return l.select(F.concat(F.lit("q"), "l_orderkey").alias("qid"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("o"), "l_orderkey").alias("h"), F.lit("uses_material").alias("r"), F.concat(F.lit("p"), "l_partkey").alias("u"))


KNOWN = f"""{GOLD}, kn AS (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY pos, h, r, u) AS INTEGER) AS k, h, r, u FROM (SELECT qid, h, r, u, min(pos) AS pos FROM gold GROUP BY qid, h, r, u))"""


@query(f"WITH {KNOWN} SELECT qid, k, h, r, u FROM kn")
def know_evidence(spark, d):
    return methods.retrieve("know", {"gold": _gold(spark, d)})


PICTURES = f"""{KNOWN}, im AS (SELECT qid, path, min({{'k': k, 'side': side, 'seq': img.seq, 'entity': entity, 'caption': caption}}) AS place FROM (SELECT qid, k, 0 AS side, h AS e FROM kn UNION ALL SELECT qid, k, 1, u FROM kn) JOIN img ON e = entity GROUP BY qid, path),
pi AS (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY place, path) AS INTEGER) AS n, place.entity AS entity, path, place.caption AS caption FROM im)"""


@query(f"WITH {PICTURES} SELECT qid, n, entity, path, caption FROM pi", "img")
def evidence_images(spark, d):
    return methods.collected_images(methods.known(_gold(spark, d)), views.images(spark, d))


@query(f"""WITH {PICTURES}, hi AS (SELECT qid, path FROM pi WHERE n = 2), li AS (SELECT qid, 0 AS s, k AS n, '- ' || h || ' uses material ' || u AS line FROM kn
  UNION ALL SELECT pi.qid, 1, n, '- [image of ' || entity || '] ' || CASE WHEN hi.path IS NOT NULL THEN '' ELSE coalesce(caption, '') END FROM pi LEFT JOIN hi ON pi.qid = hi.qid AND pi.path = hi.path WHERE n <= 3)
SELECT qid, string_agg(line, chr(10) ORDER BY s, n) AS text FROM li GROUP BY qid""", "img")
def know_plus_text(spark, d):
    own = methods.retrieve("know+", {"gold": _gold(spark, d)})
    pictures = methods.collected_images(own, views.images(spark, d))
    return methods.evidence_text(own, pictures, pictures.where("n = 2").select("qid", "path"), arrows=False)


@query("""SELECT 'q' || o_orderkey AS qid, CAST(0 AS BIGINT) AS evidence, 'Who made o' || o_orderkey || '?' AS prompt FROM orders""")
def direct_prompts(spark, d):
    q = table(spark, d, "orders").select(F.concat(F.lit("q"), "o_orderkey").alias("qid"), F.concat(F.lit("Who made o"), "o_orderkey", F.lit("?")).alias("question"))
    n = methods.retrieve("direct", {"questions": q}).groupBy("qid").agg(F.count(F.lit(1)).alias("evidence"))
    return q.join(n, "qid", "left").select("qid", F.coalesce("evidence", F.lit(0)).cast("long").alias("evidence"), F.col("question").alias("prompt"))


@query(f"""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({COS}, 9) DESC, v.vec_id) AS k FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)
SELECT 'q' || query_id AS qid, CAST(k AS INTEGER) AS k, 's' || (id % 100 + 1) AS h, 'located_in' AS r, n_name AS u FROM s JOIN supplier ON s_suppkey = id % 100 + 1 JOIN nation ON s_nationkey = n_nationkey WHERE k <= 5""")
def flat_evidence(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    scores = vectors.similar(v.where("id % 20 = 0"), v, k=5).select(F.concat(F.lit("q"), "query_id").alias("qid"), F.col("id").cast("string").alias("seq"), "sim")
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 100 + 1).alias("s_suppkey")).join(s, "s_suppkey")
    t = rows.select(F.col("vec_id").cast("string").alias("seq"), F.concat(F.lit("s"), "s_suppkey").alias("h"), F.lit("located_in").alias("r"), F.col("n_name").alias("u"))
    return methods.retrieve("fmt", {"scores": scores, "triples": t})


@query("""WITH v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), m AS (SELECT label, list(mean ORDER BY pos) AS mv FROM (SELECT label, pos, avg(x) AS mean FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS pos FROM v) GROUP BY label, pos) GROUP BY label),
w AS (SELECT id, e, CASE WHEN id % 2 = 0 THEN mv END AS i FROM v JOIN m USING (label)),
f AS (SELECT id, CASE WHEN i IS NULL THEN list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) ELSE list_transform(list_zip(e, i), lambda z: 0.7 * z[1] / sqrt(list_inner_product(e, e)) + 0.3 * z[2] / sqrt(list_inner_product(i, i))) END AS u FROM w),
s AS (SELECT q.id AS query_id, f.id, list_cosine_similarity(q.u, f.u) AS sim FROM f q JOIN f ON q.id <> f.id WHERE q.id % 20 = 0)
SELECT query_id, id, CAST(k AS INTEGER) AS rank, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, id) AS k FROM s) WHERE k <= 8""")
def ranked_units(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    m = vectors.mean_vectors(v, "label").withColumnRenamed("embedding", "m")
    units = v.join(m, "label").select("id", "embedding", F.when(F.col("id") % 2 == 0, F.col("m")).alias("image"))
    return methods.ranked_units(units.where("id % 20 = 0"), units).select("query_id", "id", "rank", F.round("sim", 6).alias("sim"))


@query("""WITH e AS (SELECT h AS entity, 0 AS dir, seq, h, r, u FROM t UNION ALL SELECT u, 1, seq, h, r, u FROM t), k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY dir, seq) AS rank FROM e)
SELECT entity, string_agg(h || '|' || r || '|' || u, ';' ORDER BY rank) AS facts FROM k WHERE rank <= 30 GROUP BY entity""", "t")
def agent_facts(spark, d):
    own = methods.facts(Steps(spark, "facts")(triples_of(spark, d), "edges"))
    return own.select("entity", F.array_join(F.transform("facts", lambda f: F.concat_ws("|", f["h"], f["r"], f["u"])), ";").alias("facts"))


@query("""WITH q AS (SELECT 'c' || c_custkey AS qid, CASE WHEN c_custkey % 2 = 0 THEN 'where located in is ' ELSE 'which kind is a thing like ' END || 'c' || c_custkey AS question FROM customer),
x AS (SELECT h AS e, 0 AS dir, seq, h, r, u FROM t UNION ALL SELECT u, 1, seq, h, r, u FROM t), k AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY dir, seq) AS rank FROM x),
s AS (SELECT qid, h, r, u, row_number() OVER (PARTITION BY qid ORDER BY rank) AS k FROM q JOIN k ON qid = e WHERE rank <= 30 AND (contains(question, replace(r, '_', ' ')) OR contains(question, lower(u))))
SELECT qid, CAST(k AS INTEGER) AS k, h, r, u FROM s WHERE k <= 5""", "t")
def agent_evidence(spark, d):
    steps = Steps(spark, "react")
    t = steps(triples_of(spark, d), "edges")
    q = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("qid"), F.concat(F.when(F.col("c_custkey") % 2 == 0, "where located in is ").otherwise("which kind is a thing like "), F.lit("c"), "c_custkey").alias("question"))
    return methods.retrieve("react", {"questions": q, "decide": methods.expand_first, "facts": methods.facts(t), "materialise": steps})


@query("""SELECT o_orderkey, array_to_string(list_slice(list_concat(['Who made it?'], CASE o_orderkey % 3 WHEN 0 THEN ['which maker'] WHEN 1 THEN [] ELSE ['part one'] END), 1, 2), ';') AS subqueries, CASE o_orderkey % 3 WHEN 0 THEN 'o' || o_orderkey || ';c' WHEN 1 THEN '' ELSE '1;2;3;4' END AS mentions FROM orders""")
def decomposed_questions(spark, d):
    reply = F.element_at(F.array(F.concat(F.lit('Here: ```json\n{"subqueries": ["who made it? ", "which maker"], "mentions": ["o'), "o_orderkey", F.lit('", " ", "c"]}\n```')), F.lit("no"), F.lit('{"subqueries": ["part one", "part two"], "mentions": ["1", "2", "3", "4", "5"]}')), (F.col("o_orderkey") % 3 + 1).cast("int"))
    subs, mentions = methods.decomposed(F.lit("Who made it?"), reply)
    return table(spark, d, "orders").select("o_orderkey", F.array_join(subs, ";").alias("subqueries"), F.array_join(mentions, ";").alias("mentions"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'support' WHEN 1 THEN 'reject' ELSE 'partial' END AS verdict FROM orders")
def chain_verdicts(spark, d):
    reply = F.element_at(F.array(*map(F.lit, ['{"verdict": "support", "why": "x"}', 'So: {"verdict": "reject"}.', '{"verdict": "maybe"}', "nothing"])), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", methods.verdict(reply).alias("verdict"))


ROOTS = """q AS (SELECT c_custkey AS qid FROM customer), me AS (SELECT c_custkey AS qid, i AS pos, CASE WHEN (c_custkey + i) % 3 = 0 THEN 'n' || (c_custkey + i) % 25 END AS name, 'm' || (c_custkey + i) % 7 AS near, ((c_custkey + i) % 10) / 10.0 AS sim FROM customer, (VALUES (0), (1), (2)) v(i) WHERE i < c_custkey % 4),
im AS (SELECT c_custkey AS qid, 'n' || (c_custkey * 3 + i) % 25 AS name, (c_custkey * 7 + i * 3) % 11 / 11.0 - 0.1 AS score FROM customer, (VALUES (0), (1)) v(i) WHERE c_custkey % 5 < 2),
tx AS (SELECT c_custkey AS qid, 'n' || i AS name, (c_custkey * (i + 3)) % 17 / 17.0 AS score FROM customer, range(25) v(i))"""


@query(f"""WITH {ROOTS}, a AS (SELECT qid, name, 0 AS tier, CAST(min(pos) AS DOUBLE) AS place FROM (SELECT qid, pos, coalesce(name, CASE WHEN sim >= 0.55 THEN near END) AS name FROM me) WHERE name IS NOT NULL GROUP BY qid, name),
b AS (SELECT qid, name, 1 AS tier, -score AS place FROM im WHERE score >= 0), c AS (SELECT tx.qid, tx.name, 2 AS tier, -CASE WHEN tx.qid % 5 < 2 THEN 0.7 * tx.score + 0.3 * coalesce(im.score, 0) ELSE tx.score END AS place FROM tx LEFT JOIN im ON tx.qid = im.qid AND tx.name = im.name),
e AS (SELECT qid, name, min({{'tier': tier, 'place': CAST(round(place, 12) AS DOUBLE)}}) AS x FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY qid, name),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY x, name) AS k FROM e), o AS (SELECT q.qid, greatest(2, (SELECT count(*) FROM me WHERE me.qid = q.qid)) AS room FROM q)
SELECT r.qid, CAST(k AS INTEGER) AS k, name FROM r JOIN o ON r.qid = o.qid WHERE k <= room AND (x.tier < 2 OR k <= 2)""")
def walk_roots(spark, d):
    c = order.spread(table(spark, d, "customer").select(F.col("c_custkey").alias("qid")), "qid", times=256)
    some = lambda n: c.select("qid", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    me = some(3).where("i < qid % 4").selectExpr("qid", "i AS pos", "CASE WHEN (qid + i) % 3 = 0 THEN concat('n', (qid + i) % 25) END AS name", "concat('m', (qid + i) % 7) AS near", "((qid + i) % 10) / 10.0D AS sim")
    im = some(2).where("qid % 5 < 2").selectExpr("qid", "concat('n', (qid * 3 + i) % 25) AS name", "(qid * 7 + i * 3) % 11 / 11.0D - 0.1D AS score")
    tx = some(25).selectExpr("qid", "concat('n', i) AS name", "(qid * (i + 3)) % 17 / 17.0D AS score")
    return methods.roots(c, me, im, tx)


CHAINS = """ch AS (SELECT o_custkey AS qid, o_orderkey % 2 AS subquery, 'path' || o_orderkey AS path, (o_orderkey * 37 % 101) / 101.0 AS score FROM orders)"""


def _chains(spark, d):
    return table(spark, d, "orders").selectExpr("o_custkey AS qid", "o_orderkey % 2 AS subquery", "concat('path', o_orderkey) AS path", "(o_orderkey * 37 % 101) / 101.0D AS score")


@query(f"WITH {CHAINS} SELECT qid, subquery, path, CAST(k AS INTEGER) AS k FROM (SELECT *, row_number() OVER (PARTITION BY qid, subquery ORDER BY round(score, 9) DESC, path) AS k FROM ch) WHERE k <= 3")
def beam_cuts(spark, d):
    return methods.beam_cut(_chains(spark, d)).select("qid", "subquery", "path", "k")


@query(f"WITH {CHAINS} SELECT qid, path, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, path) <= 8 AS judged FROM ch")
def verify_cuts(spark, d):
    return methods.verify_cut(_chains(spark, d)).select("qid", "path", "judged")


@query("SELECT p_partkey, round(0.6 * (1 - (p_size % 3) / 3.0) + 0.4 * (p_partkey % 10) / 10.0, 6) AS score FROM part")
def step_scores(spark, d):
    score = methods.step_score(F.col("p_size") % 3, F.lit(3), F.col("p_partkey") % 10 / 10)
    return table(spark, d, "part").select("p_partkey", F.round(score, 6).alias("score"))


@query("""WITH d AS (SELECT name, count(*) AS degree FROM (SELECT h AS name FROM t UNION ALL SELECT u FROM t) GROUP BY name) SELECT name, round(sqrt(greatest(1, degree)), 6) AS weight FROM d""", "t")
def damped_weights(spark, d):
    return graph.degrees(triples_of(spark, d)).select("name", F.round(F.sqrt(F.greatest(F.lit(1), F.col("degree"))), 6).alias("weight"))


@query("""SELECT 'c' || c_custkey AS qid, c_custkey % 2 = 0 AS answered, CASE WHEN c_custkey % 3 = 0 THEN 'located_in>' || n_name ELSE '' END AS cite, CASE WHEN c_custkey % 3 = 1 THEN 'is_a>' || c_mktsegment || ';located_in>' || n_name ELSE 'is_a>' || c_mktsegment END AS follow FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def page_decisions(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = c.select(F.concat(F.lit("c"), "c_custkey").alias("qid"), F.lit("").alias("path"), "c_custkey", "n_name", "c_mktsegment")
    links = F.array(F.struct(F.lit(0).alias("pos"), F.lit("is_a").alias("relation"), F.col("c_mktsegment").alias("target")), F.struct(F.lit(1).alias("pos"), F.lit("old_place").alias("relation"), F.col("n_name").alias("target")), F.struct(F.lit(2).alias("pos"), F.lit("located_in").alias("relation"), F.col("n_name").alias("target")))
    shown = rows.select("qid", "path", F.explode(links).alias("x")).select("qid", "path", "x.*", F.lit(False).alias("incoming"))
    cite = F.when(F.col("c_custkey") % 3 == 0, F.array(F.concat(F.lit("nation: "), F.lower("n_name")), F.lit("nobody"))).otherwise(F.array().cast("array<string>"))
    follow = F.when(F.col("c_custkey") % 3 == 1, F.array(F.concat(F.lower("c_mktsegment"), F.lit(", "), "n_name"))).otherwise(F.array(F.concat(F.lit("("), "c_mktsegment", F.lit(")"))))
    reply = F.to_json(F.struct((F.col("c_custkey") % 2 == 0).alias("answered"), cite.alias("cite"), follow.alias("follow")))
    out = methods.decisions(shown, rows.select("qid", "path", reply.alias("reply")))
    named = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: F.concat(x["relation"], F.lit(">"), x["target"])), ";"), F.lit(""))
    return out.select("qid", "answered", named("cite").alias("cite"), named("follow").alias("follow"))


@query("""WITH l AS (SELECT 'q' || l_orderkey AS qid, l_linenumber % 3 AS c, l_linenumber, 'p' || (l_partkey % 9) AS edge FROM lineitem), k AS (SELECT qid, c, max(l_linenumber) AS score FROM l GROUP BY qid, c),
o AS (SELECT l.qid, edge, min({'v': l.c, 's': -score, 'n': l_linenumber, 'e': edge}) AS place FROM l JOIN k ON l.qid = k.qid AND l.c = k.c WHERE l.c < 2 GROUP BY l.qid, edge)
SELECT qid, CAST(k AS INTEGER) AS rank, edge FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY place) AS k FROM o) WHERE k <= 5""")
def evidence_by_best(spark, d):
    return search.evidence(_evidence_chains(spark, d), way="best")


@query("""WITH l AS (SELECT 'q' || l_orderkey AS qid, l_linenumber % 3 AS c, l_linenumber, 'p' || (l_partkey % 9) AS edge FROM lineitem), k AS (SELECT qid, c, max(l_linenumber) AS score FROM l GROUP BY qid, c),
o AS (SELECT l.qid, edge, min({'v': l.c, 's': -score, 'n': l_linenumber, 'e': edge}) AS place FROM l JOIN k ON l.qid = k.qid AND l.c = k.c WHERE l.c < 2 GROUP BY l.qid, edge),
n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY place) AS k, count(*) OVER (PARTITION BY qid) AS m FROM o)
SELECT qid, CAST(CASE WHEN m <= 2 THEN k ELSE CASE k WHEN 3 THEN 1 ELSE 2 END END AS INTEGER) AS rank, edge FROM n WHERE m <= 2 OR k IN (1, 3)""")
def evidence_by_choice(spark, d):
    chains = _evidence_chains(spark, d)
    picks = chains.select("qid", F.array(F.lit(3), F.lit(3), F.lit(99), F.lit(1), F.lit(2)).alias("numbers")).distinct()
    return search.evidence(chains, budget=2, way="choice", picks=picks)


def _evidence_chains(spark, d):
    l = table(spark, d, "lineitem").select(F.concat(F.lit("q"), "l_orderkey").alias("qid"), (F.col("l_linenumber") % 3).alias("c"), "l_linenumber", F.concat(F.lit("p"), F.col("l_partkey") % 9).alias("edge")).repartition("qid")
    chains = l.groupBy("qid", "c").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "edge"))), lambda s: s["edge"]).alias("edges"), F.max("l_linenumber").cast("double").alias("score"))
    return chains.withColumn("verdict", F.element_at(F.array(*map(F.lit, ["support", "partial", "reject"])), (F.col("c") + 1).cast("int")))


# --------------------------------------------------------------------------- reach

REACH = """ro AS (SELECT n_name AS qid, n_name AS node, 0 AS place FROM nation), lk AS (SELECT h AS node, u AS next, false AS incoming, seq FROM t UNION ALL SELECT u, h, true, seq FROM t),
m1 AS (SELECT qid, next AS node, min({'place': place, 'incoming': incoming, 'seq': seq}) AS x FROM ro JOIN lk ON ro.node = lk.node WHERE next <> qid GROUP BY qid, next),
o1 AS (SELECT qid, node, row_number() OVER (PARTITION BY qid ORDER BY x, node) AS place FROM m1), ord AS (SELECT qid, node, CAST(place AS BIGINT) AS place FROM ro UNION ALL SELECT qid, node, place FROM o1)"""


@query(f"WITH {REACH} SELECT qid, node, place FROM ord", "t")
def discovery_order(spark, d):
    steps = Steps(spark, "discovery")
    roots = table(spark, d, "nation").select(F.col("n_name").alias("qid"), F.col("n_name").alias("node"), F.lit(0).alias("place"))
    return search.discovery(steps(triples_of(spark, d), "edges"), roots, 1, steps)


CEILINGS = f"""{REACH}, gn AS (SELECT name, relation, count(*) AS n FROM (SELECT h AS name, r AS relation FROM t UNION ALL SELECT u, r FROM t) GROUP BY name, relation),
bg AS (SELECT name, relation, greatest(0, least(least(n, 8), 40 - (sum(least(n, 8)) OVER (PARTITION BY name ORDER BY n, relation ROWS UNBOUNDED PRECEDING) - least(n, 8)))) AS take FROM gn),
pg AS (SELECT k.name, k.h, k.relation AS r, k.u FROM (SELECT *, row_number() OVER (PARTITION BY name, relation ORDER BY incoming, seq) AS k FROM (SELECT h AS name, r AS relation, h, u, false AS incoming, seq FROM t UNION ALL SELECT u, r, h, u, true, seq FROM t)) k JOIN bg ON k.name = bg.name AND k.relation = bg.relation WHERE k <= take),
go AS (SELECT DISTINCT n_name AS qid, CASE WHEN n_regionkey < 2 THEN 'near' ELSE 'far' END AS type, 'c' || c_custkey AS h, 'is_a' AS r, c_mktsegment AS u FROM customer JOIN nation ON c_nationkey = n_nationkey OR c_custkey % 100 = n_nationkey),
ce AS (SELECT go.*, EXISTS (SELECT 1 FROM ord WHERE ord.qid = go.qid AND node IN (h, u)) AS a, EXISTS (SELECT 1 FROM ord JOIN pg ON pg.name = ord.node WHERE ord.qid = go.qid AND pg.h = go.h AND pg.r = go.r AND pg.u = go.u) AS b,
  EXISTS (SELECT 1 FROM ord JOIN pg ON pg.name = ord.node WHERE ord.qid = go.qid AND place < 24 AND pg.h = go.h AND pg.r = go.r AND pg.u = go.u) AS c FROM go),
cq AS (SELECT qid, type, count(*) AS gold, count(*) FILTER (a) AS reachable, count(*) FILTER (b) AS rendered, count(*) FILTER (c) AS paged FROM ce GROUP BY qid, type)"""


def _ceilings(spark, d):
    steps = Steps(spark, "shares")
    t, n = steps(triples_of(spark, d), "edges"), table(spark, d, "nation")
    roots = n.select(F.col("n_name").alias("qid"), F.col("n_name").alias("node"), F.lit(0).alias("place"))
    c = table(spark, d, "customer")
    fact = [F.concat(F.lit("c"), "c_custkey").alias("h"), F.lit("is_a").alias("r"), F.col("c_mktsegment").alias("u")]
    kind = F.when(F.col("n_regionkey") < 2, "near").otherwise("far").alias("type")
    gold = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("qid"), kind, *fact).unionByName(c.join(n, F.col("c_custkey") % 100 == F.col("n_nationkey")).select(F.col("n_name").alias("qid"), kind, *fact))
    return search.page_ceilings(t, search.discovery(t, roots, 1, steps), gold, pages.page_links(t))


@query(f"WITH {CEILINGS} SELECT qid, type, gold, reachable, rendered, paged FROM cq", "t")
def three_ceilings(spark, d):
    return _ceilings(spark, d)


@query(f"""WITH {CEILINGS}, s AS (SELECT type, * EXCLUDE (type) FROM cq UNION ALL SELECT 'ALL', * EXCLUDE (type) FROM cq UNION ALL SELECT 'ALL less skipped', * EXCLUDE (type) FROM cq WHERE type <> 'far')
SELECT type, count(*) AS questions, CAST(sum(gold) AS BIGINT) AS gold, round(sum(reachable) / sum(gold), 6) AS reachable, round(sum(rendered) / sum(gold), 6) AS rendered, round(sum(paged) / sum(gold), 6) AS paged FROM s GROUP BY type""", "t")
def ceiling_shares(spark, d):
    return search.ceiling_shares(_ceilings(spark, d), ["far"])


# --------------------------------------------------------------------------- evaluation


@query("SELECT run, qid FROM res WHERE error IS NOT NULL OR contains(answer, 'generation failed')", "res")
def failed_rows(spark, d):
    return evaluate.failed(views.results(spark, d))


@query("""WITH b AS (SELECT qid, correct FROM res WHERE run = 'full'), x AS (SELECT r.*, b.correct AS b FROM res r LEFT JOIN b USING (qid)),
a AS (SELECT run, count(*) AS n, round(avg(CAST(correct AS INTEGER)), 6) AS acc, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(n_calls), 6) AS calls, round(avg(CAST(correct AS INTEGER)) - avg(CAST(b AS INTEGER)), 6) AS delta, count(*) FILTER (correct AND NOT b) AS up, count(*) FILTER (NOT correct AND b) AS down FROM x GROUP BY run)
SELECT run, n, acc, precision, recall, calls, delta, CASE WHEN up + down > 0 THEN round((up - down) / sqrt(up + down), 6) ELSE 0 END AS z FROM a""", "res")
def ablation_table(spark, d):
    return evaluate.ablation(views.results(spark, d), "full")


ARMS = """ar AS (SELECT 'q' || o_orderkey AS qid, CASE WHEN o_orderkey % 6 = 0 THEN 'mm_chain' ELSE 'chain' END AS type, b AS backbone, w AS wording, (o_orderkey * (b + 2) + o_custkey * w) % 7 < 3 + b - w AS correct FROM orders, (VALUES (1), (2)) x(b), (VALUES (1), (2)) y(w) WHERE (o_orderkey + b + w) % 9 <> 0)"""


@query(f"""WITH {ARMS}, p AS (SELECT qid, max(type) AS type, max(CASE WHEN backbone = 1 AND wording = 1 THEN CAST(correct AS INTEGER) END) AS a, max(CASE WHEN backbone = 1 AND wording = 2 THEN CAST(correct AS INTEGER) END) AS b, max(CASE WHEN backbone = 2 AND wording = 1 THEN CAST(correct AS INTEGER) END) AS c, max(CASE WHEN backbone = 2 AND wording = 2 THEN CAST(correct AS INTEGER) END) AS e FROM ar GROUP BY qid HAVING count(*) = 4),
s AS (SELECT 'all' AS scope, * FROM p UNION ALL SELECT 'without mm_chain', * FROM p WHERE type <> 'mm_chain')
SELECT scope, count(*) AS n, round(avg(a - c), 6) AS margin_1, round(avg(b - e), 6) AS margin_2, round(avg(a - c) - avg(b - e), 6) AS advantage FROM s GROUP BY scope""")
def home_field(spark, d):
    o = table(spark, d, "orders")
    arms = o.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("b")).select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("w")).where("(o_orderkey + b + w) % 9 <> 0")
    return evaluate.home_field(arms.selectExpr("concat('q', o_orderkey) AS qid", "CASE WHEN o_orderkey % 6 = 0 THEN 'mm_chain' ELSE 'chain' END AS type", "b AS backbone", "w AS wording", "(o_orderkey * (b + 2) + o_custkey * w) % 7 < 3 + b - w AS correct"))


@query("""WITH a AS (SELECT run, count(*) AS n, avg(CAST(correct AS INTEGER)) AS acc, avg(precision) AS p, avg(recall) AS r FROM res GROUP BY run)
SELECT run, n AS rows, CASE run WHEN 'flat' THEN n + 1 ELSE n END AS stated, CAST(0 AS BIGINT) AS duplicates, CAST(0 AS BIGINT) AS extra, CAST(0 AS BIGINT) AS missing, CASE run WHEN 'full' THEN 'precision' WHEN 'flat' THEN 'acc,recall' ELSE '' END AS wrong_means FROM a""", "res")
def verified_summaries(spark, d):
    r = Steps(spark, "verified")(views.results(spark, d), "results")
    off = lambda c, run, by: F.col(c) + F.when(F.col("run") == run, F.lit(by)).otherwise(F.lit(1e-5))
    s = r.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("double")).alias("acc"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"))
    stated = s.select("run", (F.col("n") + F.when(F.col("run") == "flat", 1).otherwise(0)).alias("n"), off("acc", "flat", 0.01).alias("acc"), off("precision", "full", -0.001).alias("precision"), off("recall", "flat", 6e-5).alias("recall"))
    out = evaluate.verified(r, stated, r.select("qid").distinct())
    return out.select("run", "rows", "stated", F.col("duplicates").cast("long").alias("duplicates"), "extra", F.col("missing").cast("long").alias("missing"), "wrong_means")


@query("""SELECT run, qid, error IS NULL AND contains(answer, 'c' || (CAST(substr(qid, 2) AS BIGINT) % 10)) AS correct FROM res WHERE CAST(substr(qid, 2) AS BIGINT) % 5 <> 0""", "res")
def rejudged_rows(spark, d):
    o = table(spark, d, "orders").where("o_orderkey % 5 <> 0")
    items = o.select(F.concat(F.lit("q"), "o_orderkey").alias("qid"), F.lit("who").alias("question"), F.lit("it").alias("answer"), F.array(F.concat(F.lit("C"), F.col("o_orderkey") % 10)).alias("atoms"))
    return evaluate.rejudged(views.results(spark, d), items, evaluate.names_all).select("run", "qid", "correct")


@query("SELECT entity, path, CASE WHEN seq % 3 = 0 THEN '' ELSE coalesce(caption, '') END AS caption FROM img", "img")
def masked_captions(spark, d):
    i = views.images(spark, d)
    own = i.withColumn("key", F.concat_ws("#", "path", "seq"))
    out = evaluate.masked(own.select("entity", "caption", "seq", F.col("key").alias("path")), own.where("seq % 3 = 0").select(F.col("key").alias("path")))
    return out.select("entity", F.regexp_replace("path", "#[0-9]+$", "").alias("path"), "caption")


@query("""WITH p AS (SELECT qid FROM res WHERE run = 'full' AND CAST(substr(qid, 2) AS BIGINT) % 3 <> 0), i AS (SELECT 'q' || o_orderkey AS qid FROM orders WHERE o_orderkey % 2 = 0), s AS (SELECT 'q' || o_orderkey AS qid FROM orders WHERE o_orderkey % 7 = 0), g AS (SELECT qid FROM p WHERE qid NOT IN (SELECT qid FROM s))
SELECT 'kept' AS part, qid FROM g WHERE qid IN (SELECT qid FROM i) UNION ALL SELECT 'left', qid FROM i WHERE qid NOT IN (SELECT qid FROM g) UNION ALL SELECT 'repair kept', qid FROM p WHERE qid NOT IN (SELECT qid FROM i) UNION ALL SELECT 'repair left', qid FROM i""", "res")
def reused_rows(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("q"), "o_orderkey").alias("qid"))
    prior = views.results(spark, d).where("run = 'full'").select("qid").join(o.where("o_orderkey % 3 <> 0").select("qid"), "qid", "left_semi")
    items, stale = o.where("o_orderkey % 2 = 0").select("qid"), o.where("o_orderkey % 7 = 0").select("qid")
    whole, repair = evaluate.reused(prior, items, stale), evaluate.reused(prior, items, stale, items)
    parts = zip(("kept", "left", "repair kept", "repair left"), (*whole, *repair), strict=True)
    out = None
    for name, rows in parts:
        part = rows.select(F.lit(name).alias("part"), "qid")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT qid FROM (SELECT qid FROM res WHERE run = 'full' AND correct INTERSECT SELECT qid FROM res WHERE run = 'flat' AND correct INTERSECT SELECT qid FROM res WHERE run = 'ego' AND correct INTERSECT SELECT 'q' || l_orderkey FROM lineitem)", "res")
def common_questions(spark, d):
    r = views.results(spark, d).where("correct")
    arms = [r.where(F.col("run") == x).select("qid") for x in ("full", "flat", "ego")] + [table(spark, d, "lineitem").select(F.concat(F.lit("q"), "l_orderkey").alias("qid"))]
    return evaluate.common(*arms)
