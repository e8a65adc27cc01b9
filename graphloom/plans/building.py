"""Queries of sources, construction, cleaning and item building."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prompts, providers, text
from ..operators import build, clean, graph, retrieval, templates
from ..sources import files, folders
from ..storage import Steps
from ..streaming import watch
from . import views
from .registry import CLASS, ITEMS, TYPES, _items, _type_nodes, query, triples_of
from .views import table

# --------------------------------------------------------------------------- sources: written, then read back


def _written(spark, d, name, columns):
    """A folder of source files made of a table: (folder, rows).  A file for each row, written where the row is."""
    steps = Steps(spark, name)
    root = f"{steps.root}/raw"
    steps(folders.write_rows(columns, root), "written")
    return root


def _texts(spark, d):
    p = table(spark, d, "pages")
    name = F.concat(F.when(F.col("page_id") % 7 == 0, F.lit("_")).otherwise(F.lit("")), F.lit("page"), "page_id", F.lit("."), F.element_at(F.array(*map(F.lit, ["txt", "MD", "jpg", "bin"])), (F.col("page_id") % 4 + 1).cast("int")))
    return p.select(F.concat(F.lit("sub"), F.col("page_id") % 3, F.lit("/"), name).alias("name"), F.col("html").cast("binary").alias("content"))


FILES_SQL = """f AS (SELECT page_id, 'sub' || page_id % 3 || '/page' || page_id || '.' || (['txt', 'MD', 'jpg', 'bin'])[page_id % 4 + 1] AS name, html FROM pages WHERE page_id % 7 <> 0 AND page_id % 4 <> 3)"""


@query(f"WITH {FILES_SQL} SELECT name, CASE WHEN page_id % 4 = 2 THEN 'image' ELSE 'text' END AS kind, sha256(html) AS hash FROM f")
def source_files(spark, d):
    root = _written(spark, d, "sources", _texts(spark, d))
    own = files.source_files(spark, root)
    return own.select(F.regexp_extract("path", "(sub[0-9]+/.*)$", 1).alias("name"), "kind", "hash")


@query(f"WITH {FILES_SQL} SELECT name, html AS text FROM f WHERE page_id % 4 < 2")
def decoded_files(spark, d):
    root = _written(spark, d, "decoded", _texts(spark, d))
    own = files.source_files(spark, root).where("kind = 'text'")
    return own.select(F.regexp_extract("path", "(sub[0-9]+/.*)$", 1).alias("name"), files.decoded("path", "content").alias("text"))


@query(f"WITH {FILES_SQL} SELECT name, CAST(0 AS INTEGER) AS para_no, md5(trim(html, chr(10) || chr(9) || ' ')) AS digest FROM f WHERE page_id % 4 < 2 AND NOT contains(html, chr(10) || chr(10)) AND length(html) <= 2000 AND trim(html) <> ''")
def file_paragraphs(spark, d):
    root = _written(spark, d, "paragraphs", _texts(spark, d))
    own = build.paragraphs(files.source_files(spark, root).where("kind = 'text'"))
    whole = table(spark, d, "pages").where("NOT contains(html, '\\n\\n') AND length(html) <= 2000").select(F.concat(F.lit("page"), "page_id").alias("stem"))
    named = own.select(F.regexp_extract("path", "(sub[0-9]+/.*)$", 1).alias("name"), F.regexp_extract("path", "/(page[0-9]+)[.]", 1).alias("stem"), "para_no", F.md5(F.col("text").cast("binary")).alias("digest"))
    return named.join(whole, "stem", "left_semi").select("name", "para_no", "digest")


def _graph_tables(spark, d):
    """Entities and triples of suppliers, as a graph document has them."""
    t = triples_of(spark, d).where("r = 'located_in' AND h LIKE 's%'").withColumn("sources", F.array(F.lit("f1"), "h"))
    img = F.when(F.col("s_suppkey") % 5 == 0, F.array(F.struct(F.concat(F.lit("i"), "s_suppkey", F.lit(".jpg")).alias("path"), F.lit('a "cap"').alias("caption"), F.lit(None).cast("string").alias("source"), F.lit(2).alias("page")))).otherwise(F.array().cast(files.IMG))
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("name"), F.lit("seller").alias("type"), F.array(F.lit("seller")).alias("types"), F.array("s_name").alias("aliases"), F.array(F.concat(F.lit("text \\ of "), "s_name")).alias("text"), img.alias("img"), (F.col("s_suppkey") % 9 == 0).alias("hub"))
    return s, t


@query("""SELECT 's' || s_suppkey AS name, s_name AS alias, 'text \\ of ' || s_name AS said, CASE WHEN s_suppkey % 5 = 0 THEN 'i' || s_suppkey || '.jpg' END AS image, CAST(1 AS BIGINT) AS degree, s_suppkey % 9 = 0 AS hub FROM supplier""")
def loaded_entities(spark, d):
    steps, (e, t) = Steps(spark, "document"), _graph_tables(spark, d)
    files.save_document(files.graph_document(e, t), f"{steps.root}/graph")
    got = files.read_graph(spark, f"{steps.root}/graph/part-*")[0]
    return got.select("name", F.get("aliases", F.lit(0)).alias("alias"), F.get("text", F.lit(0)).alias("said"), F.get("img.path", F.lit(0)).alias("image"), "degree", "hub")


@query("SELECT h, r, u, 'f1;' || h AS sources FROM t WHERE r = 'located_in' AND h LIKE 's%'", "t")
def loaded_triples(spark, d):
    steps, (e, t) = Steps(spark, "document"), _graph_tables(spark, d)
    files.save_document(files.graph_document(e, t), f"{steps.root}/graph")
    return files.read_graph(spark, f"{steps.root}/graph/part-*")[1].select("h", "r", "u", F.array_join("sources", ";").alias("sources"))


@query("SELECT name, CAST(count(*) AS BIGINT) AS degree FROM (SELECT h AS name FROM t WHERE r = 'located_in' AND h LIKE 's%' UNION ALL SELECT 's' || s_suppkey FROM supplier WHERE false) GROUP BY name", "t")
def saved_degrees(spark, d):
    steps, (e, t) = Steps(spark, "tables"), _graph_tables(spark, d)
    files.write_graph(e, t, f"{steps.root}/graph")
    return spark.read.parquet(f"{steps.root}/graph/entities").select("name", "degree")


@query("SELECT url || '#' || page_id AS path, CASE WHEN page_id % 2 = 0 THEN 'third_party' ELSE 'own, \"or\" not' END AS rights, 'line' || chr(10) || page_id AS rights_note FROM pages")
def manifest_rows(spark, d):
    root = f"{Steps(spark, 'images').root}/manifest"
    p = table(spark, d, "pages")
    rows = p.select(F.concat_ws("#", "url", "page_id").alias("path"), F.when(F.col("page_id") % 2 == 0, "third_party").otherwise('own, "or" not').alias("rights"), F.lit("no").alias("included"), F.lit("").alias("source"), F.col("url").alias("source_url"), F.lit("").alias("source_page"), F.concat(F.lit("line\n"), "page_id").alias("rights_note"))
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(root)
    return files.image_manifest(spark, root).select("path", "rights", "rights_note")


@query("SELECT run, qid, correct, precision FROM res", "res")
def results_rows(spark, d):
    root = f"{Steps(spark, 'results').root}/document"
    r = views.results(spark, d).select("run", "qid", "correct", "precision")
    files.results_document(r, r.agg(F.count(F.lit(1)).alias("n"))).write.text(root)
    return files.read_results(spark, root, "run string, qid string, correct boolean, precision double", "n long")[0]


@query("SELECT 'item' || page_id AS qid, CASE WHEN page_id % 2 = 0 THEN 'dev' ELSE 'test' END AS split FROM pages")
def split_rows(spark, d):
    root = f"{Steps(spark, 'splits').root}/split"
    p = table(spark, d, "pages").select(F.concat(F.lit("item"), "page_id").alias("qid"), F.when(F.col("page_id") % 2 == 0, "dev").otherwise("test").alias("split"))
    lists = p.groupBy("split").agg(F.collect_list("qid").alias("q"))  # a split document is one value by its nature
    lists.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("split", "q")))).alias("value")).write.text(root)
    return files.split_of(spark, root, "dev").withColumn("split", F.lit("dev")).unionByName(files.split_of(spark, root, "test").withColumn("split", F.lit("test")))


@query("SELECT 'item' || p_partkey AS qid, p_type AS type, p_brand || ';' || p_size AS atoms, 'h|made_by|' || p_brand AS gold, CAST(p_size AS INTEGER) AS hops FROM part")
def items_rows(spark, d):
    root = f"{Steps(spark, 'items').root}/items"
    p = table(spark, d, "part")
    gold = F.array(F.struct(F.lit("h").alias("h"), F.lit("made_by").alias("r"), F.col("p_brand").alias("u")))
    item = F.struct(F.concat(F.lit("item"), "p_partkey").alias("qid"), F.col("p_type").alias("type"), F.array("p_brand", F.col("p_size").cast("string")).alias("answer_atoms"), gold.alias("gold_triples"), F.col("p_size").cast("int").alias("hops"))
    # some documents are lists, some have an envelope
    whole = p.groupBy((F.col("p_partkey") % 4).alias("k")).agg(F.to_json(F.collect_list(item)).alias("x"))
    whole.select(F.concat(F.lit("doc"), "k", F.lit(".json")).alias("name"), F.when(F.col("k") % 2 == 0, F.concat(F.lit('{"items": '), "x", F.lit("}"))).otherwise(F.col("x")).cast("binary").alias("content")).transform(lambda x: Steps(spark, "itemdocs")(folders.write_rows(x, root), "written"))
    got = files.items_of(spark, root)
    return got.select("qid", "type", F.array_join("answer_atoms", ";").alias("atoms"), F.concat_ws("|", F.col("gold_triples")[0]["h"], F.col("gold_triples")[0]["r"], F.col("gold_triples")[0]["u"]).alias("gold"), "hops")


@query("""SELECT 'h' || page_id AS h, 'seen_in' AS r, 'first' AS u, CAST(-1 AS BIGINT) AS epoch FROM pages WHERE page_id % 3 <> 0 UNION ALL SELECT 'h' || page_id, 'seen_in', CASE WHEN page_id % 3 = 0 THEN 'first' ELSE 'second' END, -2 FROM pages WHERE page_id % 3 <> 1
UNION ALL SELECT 'h' || page_id, 'seen_in', CASE WHEN page_id % 3 = 2 THEN 'second' ELSE 'first' END, -3 FROM pages""")
def rescanned_triples(spark, d):
    steps = Steps(spark, "rescan")
    root, manifest, triples = (f"{steps.root}/{x}" for x in ("raw", "manifest", "triples"))
    p = table(spark, d, "pages")
    made = lambda rows, word: steps(folders.write_rows(rows.select(F.concat(F.lit("f"), "page_id", F.lit(".txt")).alias("name"), F.concat(F.lit("h"), "page_id", F.lit(" | Seen in | "), word).cast("binary").alias("content")), root), "written")

    def grown(new):
        return build.numbered_candidates(providers.extract(build.paragraphs(new))).select("h", "r", "u", "source")

    made(p.where("page_id % 3 <> 0"), F.lit("first"))
    watch.rescan(spark, root, grown, manifest, triples)
    made(p.where("page_id % 3 = 0"), F.lit("first"))
    made(p.where("page_id % 3 = 2"), F.lit("second"))
    for force in (False, False, True):  # what is new or changed, nothing, and everything again
        watch.rescan(spark, root, grown, manifest, triples, force)
    return spark.read.parquet(triples).select("h", "r", "u", F.col("epoch").cast("long").alias("epoch"))


@query("SELECT 'doc' || conv_id AS stem, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS page, text FROM conversations WHERE conv_id % 3 = 0")
def page_texts(spark, d):
    c = table(spark, d, "conversations")
    whole = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\f").alias("t"))
    root = _written(spark, d, "books", whole.select(F.concat(F.lit("doc"), "conv_id", F.lit(".txt")).alias("name"), F.col("t").cast("binary").alias("content")))
    needed = c.where("conv_id % 3 = 0").select(F.concat(F.lit("doc"), "conv_id").alias("stem"))
    return files.page_texts(files.source_files(spark, root), needed)


@query("SELECT 'p' || page_id AS path, CASE WHEN page_id % 3 = 0 THEN 'unknown' WHEN page_id % 3 = 1 THEN 'changed' ELSE 'ok' END AS state FROM pages")
def checked_files(spark, d):
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("p"), "page_id").alias("path"), F.col("html").cast("binary").alias("content"))
    known = p.where("page_id % 3 <> 0").select("path", F.when(F.col("page_id") % 3 == 2, F.sha2("content", 256)).otherwise(F.lit("old")).alias("sha256"))
    return files.checked(p, known)


@query("""SELECT 'p' || page_id AS path, CASE WHEN page_id % 4 = 0 THEN 'NEW' WHEN page_id % 4 = 1 THEN 'CHANGED' WHEN page_id % 4 = 2 THEN 'REMOVED' ELSE 'processed' END AS status FROM pages""")
def snapshot_changes(spark, d):
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("p"), "page_id").alias("path"), F.sha2(F.col("html").cast("binary"), 256).alias("hash"))
    now = p.where("page_id % 4 <> 2")
    old = p.where("page_id % 4 <> 0").select("path", F.when(F.col("page_id") % 4 == 1, F.lit("old")).otherwise(F.col("hash")).alias("hash"))
    return files.status(now, old, removed=True)


@query("SELECT 'p' || page_id % 100 AS path, max(page_id) AS n_triples FROM pages GROUP BY 1")
def latest_records(spark, d):
    p = table(spark, d, "pages").select(F.concat(F.lit("p"), F.col("page_id") % 100).alias("path"), F.col("page_id").cast("string").alias("hash"), F.col("page_id").alias("n_triples"), F.timestamp_seconds("page_id").alias("processed_at"))
    return files.recorded(p.where("n_triples % 2 = 0"), p.where("n_triples % 2 = 1")).select("path", "n_triples")


@query("""WITH e AS (SELECT vec_id AS id, vec_id * 2654435761 AS h FROM embeddings), x AS (SELECT id, xor(h, (CAST(1 AS BIGINT) << CAST(id % 40 AS INTEGER)) - 1 - ((CAST(1 AS BIGINT) << CAST(id % 40 - least(id % 13, id % 40) AS INTEGER)) - 1)) AS h FROM e),
m AS (SELECT x.id, e.id AS match, CAST(bit_count(xor(x.h, e.h)) AS INTEGER) AS distance FROM x, e)
SELECT id, match, distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, match) AS k FROM m) WHERE k = 1 AND distance <= 10""")
def perceptual_matches(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("match"), (F.col("vec_id") * F.lit(2654435761)).alias("hash"))
    some = "(1L << CAST(match % 40 AS INT)) - 1 - ((1L << CAST(match % 40 - least(match % 13, match % 40) AS INT)) - 1)"
    return files.best_matches(e.select(F.col("match").alias("id"), F.expr(f"hash ^ ({some})").alias("hash")), e)


# --------------------------------------------------------------------------- construction

#: Paragraphs that the offline provider reads: two facts of each document's first words; some names are aliases.
PARAS_SQL = """w AS (SELECT doc_id, string_split(text, ' ') AS w, source FROM documents WHERE len(string_split(text, ' ')) >= 4),
f AS (SELECT source AS path, doc_id AS para_no, trim(w[1]) AS h, 'Sits-next  to' AS r, trim(w[2]) AS u, w FROM w UNION ALL SELECT source, doc_id, trim(w[3]), 'made of', trim(w[4]), w FROM w),
v AS (SELECT path, para_no, h, regexp_replace(regexp_replace(lower(trim(r)), '\\s+', '_', 'g'), '-', '_', 'g') AS r, u, w[1] || ' | Sits-next  to | ' || w[2] || chr(10) || w[3] || ' | made of | ' || w[4] AS context FROM f WHERE NOT contains(w[1] || w[2] || w[3] || w[4], '|') AND NOT regexp_matches(w[1] || w[2] || w[3] || w[4], '[\\n\\r]')),
c AS (SELECT *, printf('%s#%08d#%s', path, para_no, h || '|' || r || '|' || u) AS seq FROM v WHERE h <> '' AND u <> '' AND lower(h) <> lower(u)),
n AS (SELECT *, CASE WHEN lower(h) = 'the' THEN 'THE' WHEN lower(h) IN ('die', 'der') THEN 'Der' ELSE h END AS ch, CASE WHEN lower(u) = 'the' THEN 'THE' WHEN lower(u) IN ('die', 'der') THEN 'Der' ELSE u END AS cu FROM c),
k AS (SELECT * FROM n WHERE lower(ch) <> lower(cu))"""


def _constructed(spark, d):
    docs = table(spark, d, "documents").withColumn("w", F.split("text", " ")).where("size(w) >= 4")
    w = lambda i: F.get("w", F.lit(i))
    body = F.concat(w(0), F.lit(" | Sits-next  to | "), w(1), F.lit("\n"), w(2), F.lit(" | made of | "), w(3))
    joined = F.concat(w(0), w(1), w(2), w(3))
    paras = docs.where(~F.contains(joined, F.lit("|")) & ~joined.rlike("[\n\r]")).select(F.col("source").alias("path"), F.col("doc_id").cast("int").alias("para_no"), body.alias("text"))
    names = spark.createDataFrame([("THE", 0), ("Der", 1)], "name string, seq long")
    aliases = spark.createDataFrame([("die", "Der", 0)], "alias string, name string, seq long")
    return build.construct(paras, names, aliases, Steps(spark, "construct"))


@query(f"""WITH {PARAS_SQL}, s AS (SELECT ch, r, cu, path, min(seq) AS seq FROM k GROUP BY ch, r, cu, path)
SELECT ch AS h, r, cu AS u, min(seq) AS seq, string_agg(path, ';' ORDER BY seq, path) AS sources FROM s GROUP BY ch, r, cu""")
def built_triples(spark, d):
    return _constructed(spark, d)["triples"].withColumn("sources", F.array_join("sources", ";"))


@query(f"""WITH {PARAS_SQL}, e AS (SELECT ch AS entity, seq, context FROM k UNION ALL SELECT cu, seq, context FROM k),
x AS (SELECT entity, trim(regexp_replace(context, '\\s+', ' ', 'g')) AS text, min(seq) AS seq FROM e GROUP BY 1, 2)
SELECT entity, seq, text FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY seq DESC) AS rank FROM x) WHERE rank <= 5""")
def built_texts(spark, d):
    return _constructed(spark, d)["texts"]


@query(f"""WITH {PARAS_SQL}, t AS (SELECT DISTINCT ch AS h, r, cu AS u FROM k), g AS (SELECT name, count(*) AS degree FROM (SELECT h AS name FROM t UNION ALL SELECT u FROM t) GROUP BY name),
m AS (SELECT h AS mention, ch AS name FROM n UNION SELECT u, cu FROM n), a AS (SELECT mention AS alias, name FROM m WHERE mention <> name UNION SELECT 'die', 'Der')
SELECT coalesce(g.name, z.name) AS name, CAST(coalesce(degree, 0) AS BIGINT) AS degree, coalesce((SELECT string_agg(DISTINCT alias, ';' ORDER BY alias) FROM a WHERE a.name = coalesce(g.name, z.name)), '') AS aliases FROM g FULL JOIN (SELECT 'THE' AS name UNION ALL SELECT 'Der') z ON g.name = z.name""")
def built_entities(spark, d):
    return _constructed(spark, d)["entities"].select("name", "degree", F.array_join("aliases", ";").alias("aliases"))


@query("""WITH x AS (SELECT 'p' || p_partkey AS name, p_name AS s FROM part) SELECT name, CASE WHEN length(s) % 3 = 0 THEN 'old text' ELSE left(s, 400) END AS text FROM x""")
def summarised_texts(spark, d):
    e = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("name"), F.array().cast("array<string>").alias("aliases"), F.array(F.lit("old text")).alias("text"), "p_name")
    out = build.summarised(e, lambda name, said: F.when(F.length("p_name") % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit('"'), "p_name", F.lit('"'))))
    return out.select("name", F.get("text", F.lit(0)).alias("text"))


@query("""WITH i AS (SELECT page_id, 'c' || page_id % 20 AS one, 'c' || page_id % 30 AS two FROM pages), a AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN one WHEN page_id % 3 = 1 AND two <> one AND page_id % 20 <> page_id % 30 THEN two END AS entity, CASE WHEN page_id % 3 = 0 THEN 1 ELSE 2 END AS round FROM i),
k AS (SELECT a.*, row_number() OVER (PARTITION BY entity ORDER BY page_id) AS k FROM a JOIN customer ON entity = 'c' || c_custkey)
SELECT entity, 'p' || page_id AS path, 'cap ' || page_id AS caption, CAST(round AS INTEGER) AS round FROM k WHERE k <= 6""")
def aligned_images(spark, d):
    p = table(spark, d, "pages").select(F.concat(F.lit("p"), "page_id").alias("path"), F.col("page_id").alias("seq"))
    number = lambda c: F.substring(c, 2, 20).cast("long")
    offered = p.select("path", F.array(F.concat(F.lit("c"), F.col("seq") % 20)).alias("names"))
    # a model that takes the first name for every third image, rejects others with a caption, and takes new offers of some
    own, first = number(F.col("path")), F.get("names", F.lit(0))
    takes = (own % 3 == 0) | ((own % 3 == 1) & (first == F.concat(F.lit("c"), own % 30)) & (own % 20 != own % 30))
    ask = lambda path, names: F.to_json(F.struct(F.when(takes, first).alias("entity"), F.concat(F.lit("cap "), own).alias("caption")))
    again = lambda rows: rows.select("path", F.array(F.concat(F.lit("c"), number(F.col("path")) % 30)).alias("names"))
    names = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("name"))
    return build.alignments(p, offered, ask, names, again)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 'c' || o_custkey END AS match FROM orders""")
def judged_matches(spark, d):
    reply = F.element_at(F.array(F.lit("no idea"), F.concat(F.lit('Sure: {"match": "c'), "o_custkey", F.lit('"}')), F.lit('{"match": "someone else"}'), F.lit('{"match": null}')), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", providers.listed(reply, F.array(F.lit("c0"), F.concat(F.lit("c"), "o_custkey"))).alias("match"))


# --------------------------------------------------------------------------- cleaning's second half

DOUBLE = """du AS (SELECT 'S' || s_suppkey || ' (alt' || s_suppkey || ')' AS name, 's' || s_suppkey AS survivor FROM supplier WHERE s_suppkey % 2 = 0)"""


def _double(spark, d):
    s = table(spark, d, "supplier").where("s_suppkey % 2 = 0")
    return s.select(F.concat(F.lit("S"), "s_suppkey", F.lit(" (alt"), "s_suppkey", F.lit(")")).alias("name"), F.concat(F.lit("s"), "s_suppkey").alias("survivor"))


def _merged(spark, d):
    s, to = table(spark, d, "supplier"), _double(spark, d)
    names = s.select(F.concat(F.lit("s"), "s_suppkey").alias("name")).unionByName(to.select("name"))
    aliases = to.select(F.concat("name", F.lit("!")).alias("alias"), "name", F.lit(0).alias("seq"))
    texts = s.select(F.concat(F.lit("s"), "s_suppkey").alias("entity"), F.lit(5).alias("seq"), F.lit("own").alias("text")).unionByName(to.select(F.col("name").alias("entity"), F.lit(1).alias("seq"), F.lit("own").alias("text"))).unionByName(to.select(F.col("name").alias("entity"), F.lit(2).alias("seq"), F.col("name").alias("text")))
    images = to.select(F.col("name").alias("entity"), F.lit(1).alias("seq"), F.lit("x.jpg").alias("path")).unionByName(to.select(F.col("survivor").alias("entity"), F.lit(9).alias("seq"), F.lit("x.jpg").alias("path")))
    return clean.merged_attributes(names, aliases, texts, images, to)


@query(f"WITH {DOUBLE} SELECT alias, name FROM (SELECT name || '!' AS alias, survivor AS name FROM du UNION SELECT name, survivor FROM du UNION SELECT 'alt' || substr(survivor, 2), survivor FROM du)")
def merged_aliases(spark, d):
    return _merged(spark, d)[1]


@query(f"WITH {DOUBLE} SELECT 's' || s_suppkey AS entity, CAST(5 AS INTEGER) AS seq, 'own' AS text FROM supplier UNION ALL SELECT survivor, 2, name FROM du")
def merged_texts(spark, d):
    return _merged(spark, d)[2].select("entity", "seq", "text")


@query(f"WITH {DOUBLE} SELECT survivor AS entity, CAST(9 AS INTEGER) AS seq, 'x.jpg' AS path FROM du")
def merged_images(spark, d):
    return _merged(spark, d)[3].select("entity", "seq", "path")


@query(f"""WITH {TYPES}, s AS (SELECT h AS name, 1 AS later, seq, u AS type FROM t JOIN ty ON u = ty.name WHERE r = 'is_a' UNION ALL SELECT DISTINCT h, 0, '', 'kept' FROM t JOIN ty ON u = ty.name WHERE r = 'is_a' AND h LIKE '%7'),
o AS (SELECT name, type, min({{'later': later, 'seq': seq}}) AS place FROM s GROUP BY name, type) SELECT name, string_agg(type, ';' ORDER BY place, type) AS types FROM o GROUP BY name""", "t txt img")
def ordered_types(spark, d):
    t = Steps(spark, "types")(triples_of(spark, d), "edges")
    had = t.where("h LIKE '%7'").select(F.col("h").alias("name"), F.lit("kept").alias("type")).distinct()
    return clean.fold(t, _type_nodes(spark, d), had)[0]


@query(f"WITH {TYPES}, l AS (SELECT h, u FROM t WHERE NOT (r = 'is_a' AND u IN (SELECT name FROM ty))) SELECT name FROM (SELECT h AS name FROM t UNION SELECT u FROM t) WHERE name NOT IN (SELECT name FROM ty WHERE name NOT IN (SELECT h FROM l UNION SELECT u FROM l))", "t txt img")
def folded_names(spark, d):
    t = Steps(spark, "folded")(triples_of(spark, d), "edges")
    nodes = _type_nodes(spark, d)
    return clean.left_after_folding(graph.endpoints(t), nodes, clean.fold(t, nodes)[1])


@query("SELECT 'p' || p_partkey AS name, CASE WHEN p_partkey % 2 = 0 THEN p_type || ';' || p_brand ELSE p_type END AS classes FROM part")
def entity_classes(spark, d):
    p = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("name"), F.col("p_type").alias("type"), F.when(F.col("p_partkey") % 2 == 0, F.array("p_type", "p_brand")).alias("types"))
    return p.select("name", F.array_join(graph.classes_of(F.col("types"), F.col("type")), ";").alias("classes"))


@query("SELECT h, r, u, (h, r, u) IN (SELECT h, r, u FROM t WHERE r = 'is_a') AS held, (h, u) IN (SELECT h, u FROM t WHERE r IN ('is_a', 'part_of')) AS linked FROM t WHERE r <> 'uses_material'", "t")
def edge_members(spark, d):
    t = Steps(spark, "members")(triples_of(spark, d), "edges")
    return graph.members(t.where("r <> 'uses_material'").select("h", "r", "u"), t.where("r IN ('is_a', 'part_of')"), t.where("r = 'is_a'")).select("h", "r", "u", "held", "linked")


# --------------------------------------------------------------------------- items

SAID = """vi AS (SELECT entity, path, caption || ' beside a red woven sheet that dries on a board' AS caption FROM img)"""


def _said(spark, d):
    return views.images(spark, d).withColumn("caption", F.concat("caption", F.lit(" beside a red woven sheet that dries on a board")))


@query(f"""WITH {SAID}, dg AS (SELECT name, count(*) AS n FROM (SELECT h AS name FROM t UNION ALL SELECT u FROM t) GROUP BY name)
SELECT entity AS name, path FROM vi WHERE len(regexp_split_to_array(trim(caption), '\\s+')) >= 10 AND entity NOT IN (SELECT name FROM dg WHERE n >= 40)""", "craft img")
def visual_terminals(spark, d):
    return templates.visual_terminals(Steps(spark, "terminals")(views.craft(spark, d), "edges"), _said(spark, d)).select("name", "path")


@query(f"""WITH hub AS (SELECT name FROM (SELECT h AS name FROM t UNION ALL SELECT u FROM t) GROUP BY name HAVING count(*) >= 40), im AS (SELECT DISTINCT entity AS h FROM img WHERE entity NOT IN (SELECT name FROM hub)),
fa AS (SELECT t.* FROM t JOIN im USING (h) WHERE {CLASS} = 'core'), us AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY md5(seq), r, u) AS j FROM fa WHERE u NOT IN (SELECT name FROM hub))
SELECT h AS subject, r AS relation, u AS value FROM us WHERE j = 1""", "craft img")
def grounded_items(spark, d):
    return templates.grounded(Steps(spark, "grounded")(views.craft(spark, d), "edges"), views.images(spark, d))


@query("""WITH n AS (SELECT r, u, count(*) AS n, min(seq) AS f FROM t WHERE r IN ('uses_method', 'used_for', 'made_by') GROUP BY r, u), k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY n DESC, f) AS k FROM n),
g AS (SELECT t.r, h, row_number() OVER (PARTITION BY t.r ORDER BY seq) AS j FROM t JOIN k ON t.r = k.r AND t.u = k.u AND k.k = 1)
SELECT r, max(CASE WHEN k = 1 THEN u END) AS answer, max(CASE WHEN k = 1 THEN n END) AS n, coalesce(string_agg(CASE WHEN k BETWEEN 2 AND 4 THEN u || ' (' || n || ')' END, ', ' ORDER BY k), '') AS runners_up, (SELECT string_agg(h, ';' ORDER BY j) FROM g WHERE g.r = k.r AND j <= 8) AS support FROM k WHERE k <= 4 GROUP BY r""", "craft")
def extrema(spark, d):
    return templates.extrema(views.craft(spark, d), ["uses_method", "used_for", "made_by"])


@query(f"""WITH {ITEMS}, e AS (SELECT qid FROM it WHERE type = '1-URGENT' ORDER BY md5('7:extremum:' || qid), qid LIMIT 30), a AS (SELECT qid FROM it WHERE type <> '1-URGENT' ORDER BY md5('7:absence:' || qid), qid LIMIT 170)
SELECT 'extremum' AS mode, qid FROM e UNION ALL SELECT 'absence', qid FROM a""")
def aggregation_items(spark, d):
    it = _items(spark, d)
    return templates.aggregations(it.where("type = '1-URGENT'"), it.where("type <> '1-URGENT'"), 200)


@query("""WITH i AS (SELECT 'q' || o_orderkey AS qid, o_orderpriority AS type, o_orderkey % 12 AS n FROM orders), ok AS (SELECT * FROM i WHERE n BETWEEN 1 AND 8),
s AS (SELECT type, sha1(type || '~~' || array_to_string(list_transform(range(n), lambda x: CAST(n AS VARCHAR)), ';') || '~' || 'h|r|' || n) AS sig, min(qid) AS qid FROM ok GROUP BY type, n), k AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY md5('7:' || type || ':' || sig), sig) AS k FROM s)
SELECT type, qid, CAST(k AS INTEGER) AS k FROM k WHERE k <= CASE type WHEN '1-URGENT' THEN 3 WHEN '5-LOW' THEN 5 ELSE 0 END""")
def filled_quotas(spark, d):
    n = (F.col("o_orderkey") % 12).cast("int")
    gold = F.array(F.struct(F.lit("h").alias("h"), F.lit("r").alias("r"), n.cast("string").alias("u")))
    o = table(spark, d, "orders").select(F.concat(F.lit("q"), "o_orderkey").alias("qid"), F.col("o_orderpriority").alias("type"), F.lit(None).cast("string").alias("mode"), F.array_repeat(n.cast("string"), n).alias("atoms"), gold.alias("gold"))
    return templates.filled_quotas(o, {"1-URGENT": 3, "5-LOW": 5})


@query(f"""WITH {ITEMS}, pr AS (SELECT qid, CASE WHEN o_orderkey % 2 = 0 THEN 'dev' ELSE 'test' END AS split FROM it WHERE o_orderkey % 40 < 2), h AS (SELECT count(*) AS c FROM pr WHERE split = 'dev'), fr AS (SELECT * FROM it WHERE qid NOT IN (SELECT qid FROM pr)),
s AS (SELECT type, count(*) AS size, (SELECT count(*) FROM fr) AS total FROM fr GROUP BY type), ta AS (SELECT type, greatest(1, CAST(round_even(CAST((SELECT 900 - c FROM h) AS DOUBLE) * size / total, 0) AS BIGINT)) AS take FROM s),
k AS (SELECT fr.qid, fr.type, md5('7:' || qid) AS draw, row_number() OVER (PARTITION BY fr.type ORDER BY md5('7:' || qid), qid) AS k FROM fr),
nw AS (SELECT qid FROM (SELECT k.qid, draw FROM k JOIN ta ON k.type = ta.type WHERE k <= take) ORDER BY draw, qid LIMIT (SELECT 900 - c FROM h))
SELECT qid, split FROM pr UNION ALL SELECT qid, 'dev' FROM nw UNION ALL SELECT qid, 'test' FROM fr WHERE qid NOT IN (SELECT qid FROM nw)""")
def sticky_split(spark, d):
    it = _items(spark, d)
    prior = it.where("o_orderkey % 40 < 2").select("qid", F.when(F.col("o_orderkey") % 2 == 0, "dev").otherwise("test").alias("split"))
    gone = spark.createDataFrame([("none-such", "dev")], "qid string, split string")
    return templates.sticky_split(it, prior.unionByName(gone), 900)


_PROMPT = prompts.VERBALISE["absence"].replace("'", "''")


@query(f"""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN replace(replace(replace(replace(replace(replace('{_PROMPT}', '{{pop_rel}}', 'is_a'), '{{pop_obj}}', p_type), '{{pop_size}}', CAST(p_size AS VARCHAR)), '{{exc_rel}}', 'made_by'), '{{exc_obj}}', p_brand), '{{answer}}', p_name)
  WHEN p_partkey % 3 = 1 THEN replace(replace(replace('{prompts.VERBALISE["chain"]}', '{{start}}', p_name), '{{path}}', '  ' || p_name || ' --is_a--> ' || p_type), '{{answer}}', p_type) END AS prompt FROM part""")
def verbalising_prompts(spark, d):
    p = table(spark, d, "part")
    kind = F.when(F.col("p_partkey") % 3 == 0, "absence").when(F.col("p_partkey") % 3 == 1, "chain").otherwise("none")
    one = F.create_map(F.lit("pop_rel"), F.lit("is_a"), F.lit("pop_obj"), "p_type", F.lit("pop_size"), F.col("p_size").cast("string"), F.lit("exc_rel"), F.lit("made_by"), F.lit("exc_obj"), "p_brand", F.lit("answer"), "p_name")
    two = F.create_map(F.lit("start"), F.col("p_name"), F.lit("path"), F.concat(F.lit("  "), "p_name", F.lit(" --is_a--> "), "p_type"), F.lit("answer"), "p_type")
    return p.select("p_partkey", prompts.verbalising(kind, F.when(kind == "absence", one).otherwise(two)).alias("prompt"))


@query("SELECT event_id, trim(regexp_replace(lower(event_type), '[^a-z0-9]+', ' ', 'g')) AS folded FROM events")
def folded_types_of_events(spark, d):
    return table(spark, d, "events").select("event_id", text.folded(F.concat(F.upper("event_type"), F.lit(" !"))).alias("folded"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN 'https://commons.wikimedia.org/wiki/File:' || replace(replace(replace(replace(replace(url_encode(replace(p_name, ' ', '_') || '_(é)_no.' || p_partkey || ',!.jpg'), '%28', '('), '%29', ')'), '%27', chr(39)), '%21', '!'), '%2C', ',') END AS url FROM part""")
def commons_pages(spark, d):
    name = F.concat("p_name", F.lit(" (é) no."), "p_partkey", F.lit(",!.jpg"))
    source = F.when(F.col("p_partkey") % 3 == 0, F.lit("a folder")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("from wikimedia commons:  "), name, F.lit(" (CC BY-SA 4.0)"))).otherwise(F.concat(F.lit("Wikimedia Commons: "), name))
    return table(spark, d, "part").select("p_partkey", text.commons_url(source).alias("url"))


@query("SELECT count(*) AS n, count(*) FILTER (page_id % 4 = 0 OR page_id % 3 = 0) AS filled, count(*) FILTER (page_id % 4 <> 0 AND page_id % 3 <> 0) AS missing FROM pages")
def missing_sources(spark, d):
    p = table(spark, d, "pages").select(F.col("page_id").alias("path"))
    known = [p.where(f"path % {m} = 0").select("path", F.concat(F.lit("x"), "path").alias("value")) for m in (4, 3)]
    return retrieval.still_missing(retrieval.filled(p, *known))


@query("""WITH s AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'c' || p_partkey WHEN 2 THEN 'c' || p_partkey || ';' || p_brand || ';x' || p_size ELSE p_type || ';' || p_brand END AS names FROM part) SELECT * FROM s""")
def allowed_names(spark, d):
    none = F.lit(None).cast("string")
    k, kind = F.col("p_partkey"), F.col("p_partkey") % 4
    spec = F.struct(F.when(kind != 3, F.concat(F.lit("c"), k)).otherwise(none).alias("start"), none.alias("entity"), F.when(kind == 3, F.col("p_type")).alias("left"), F.when(kind == 3, F.col("p_brand")).alias("right"), F.when(kind == 2, F.array("p_brand")).alias("constraints"), F.when(kind == 2, F.concat(F.lit("x"), "p_size")).alias("population"), none.alias("excluded"), (kind == 0).alias("hide_subject"), (kind == 1).alias("hide_caption"))
    own = table(spark, d, "part").withColumn("spec", spec)
    return own.select("p_partkey", F.array_join(retrieval.subjects_of(F.col("spec")), ";").alias("names"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'grounded' WHEN 1 THEN 'names a waypoint' WHEN 2 THEN 'names the subject' END AS reason FROM part""")
def item_verdicts(spark, d):
    kind = F.col("p_partkey") % 5
    question = F.when(kind == 1, F.concat(F.lit("From a by way of Mid"), "p_partkey", F.lit("?"))).when(kind == 2, F.concat(F.lit("Is it sub"), "p_partkey", F.lit("?"))).when(kind == 3, F.concat(F.lit("From a to the end"), "p_partkey")).otherwise(F.lit("What is it?"))
    nodes = F.array(F.lit("a"), F.concat(F.lit("mid"), "p_partkey"), F.concat(F.lit("end"), "p_partkey"))
    what = F.when(kind.isin(1, 3), "chain").otherwise("multimodal")
    mode = F.when(kind == 0, "grounded").when(kind == 4, "attribute").otherwise("identify")
    return table(spark, d, "part").select("p_partkey", retrieval.item_verdict(question, what, mode, nodes, F.concat(F.lit("sub"), "p_partkey")).alias("reason"))


def _drawn(spark, d):
    steps = Steps(spark, "drawn")
    context = {"triples": steps(views.craft(spark, d), "edges"), "images": _said(spark, d), "materialise": steps, "relations": ["used_for", "made_by"]}
    return templates.drawn(context, {"chain2": 30, "chain5": 5, "temporal": 0})


_DRAWN = {"aggregation_absence": 200, "aggregation_extremum": 2, "chain2": 30, "chain3": 200, "chain4": 200, "chain5": 5, "comparative": 200, "intersection": 200, "mm_chain2": 0, "mm_chain3": 0, "multimodal_attribute": 40, "multimodal_identify": 40}


@query("SELECT type, n FROM (VALUES " + ", ".join(f"('{k}', CAST({v} AS BIGINT))" for k, v in _DRAWN.items() if v) + ") v(type, n)")
def drawn_items(spark, d):
    return _drawn(spark, d).where("type NOT LIKE 'mm_chain%'").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey AS qid, CASE WHEN p_partkey % 2 = 0 THEN '[{\"h\":\"a\",\"r\":\"is\",\"u\":\"' || p_brand || '\"}]' ELSE '{}' END AS answer, CAST(1 AS INTEGER) AS calls, CAST(CASE WHEN p_partkey % 2 = 0 THEN 9 + length(p_brand) ELSE 5 END AS BIGINT) AS chars FROM part")
def provider_answers(spark, d):
    prompt = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("a | is | "), "p_brand")).otherwise(F.lit("hello"))
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("qid"), prompt.alias("prompt"), F.array().cast("array<string>").alias("images"))
    return providers.answers(rows).select(F.col("qid").cast("long").alias("qid"), "answer", "calls", "chars")
