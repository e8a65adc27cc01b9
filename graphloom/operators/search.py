"""Search over pages: roots, bounded breadth-first reach, beam walk in rounds, and evidence by turns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import Config
from .order import spread
from .pages import links

DEFAULT = Config()
#: Verdicts in order of preference; what is rejected is no evidence.
VERDICTS = ["support", "partial", "none", "reject"]


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def question_roots(questions: DataFrame, names: DataFrame, least: int = 3) -> DataFrame:
    """qid, name, rank: names (of `least` characters) that a question holds between word limits, longest first.  Spans of
    as many words as names have are looked up by hash, instead of searching every name in every question."""
    keyed = names.where(F.length("name") >= least).select("name", tokens(F.col("name")).alias("t")).where(F.size("t") > 0)
    sizes = sorted(r["n"] for r in keyed.select(F.size("t").alias("n")).distinct().collect()) or [1]  # a row for each length in words
    # a question's spans are made distinct within its row, so that no task holds those of many
    spans = F.flatten(F.transform(F.array(*map(F.lit, sizes)), lambda n: F.transform("t", lambda w, i: F.array_join(F.slice(F.col("t"), i + 1, n), " "))))
    told = spread(questions.select("qid", "question"), "qid", times=4).select("qid", tokens(F.col("question")).alias("t"))
    phrase = told.select("qid", F.explode(F.array_distinct(spans)).alias("phrase"))
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc(F.length("name")), "name"))
    return phrase.join(keyed.select("name", F.array_join("t", " ").alias("phrase")), "phrase").select("qid", "name").distinct().withColumn("rank", rank)


def reach(triples: DataFrame, roots: DataFrame, depth: int, materialise: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """qid, node, level: nodes within `depth` steps of a question's roots, over edges in both directions.  Each level
    is written, so that plans stay small and a lost executor costs one level."""
    near = materialise(links(triples).select(F.col("name").alias("node"), F.col("target").alias("next")).distinct(), "near")
    level = materialise(roots.select("qid", "node").distinct().withColumn("level", F.lit(0)), "level0")
    seen = level
    for d in range(1, depth + 1):
        step = level.join(near, "node").select("qid", F.col("next").alias("node")).distinct()
        level = materialise(step.join(seen.select("qid", "node"), ["qid", "node"], "left_anti").withColumn("level", F.lit(d)), f"level{d}")
        seen = seen.unionByName(level)
    return seen


def ceilings(seen: DataFrame, gold: DataFrame) -> DataFrame:
    """qid, n, reachable: gold triples with an end among the nodes reached."""
    ends = gold.select("qid", "h", "r", "u", F.explode(F.array("h", "u")).alias("node"))
    hit = ends.join(seen.select("qid", "node", F.lit(1).alias("hit")), ["qid", "node"], "left")
    edges = hit.groupBy("qid", "h", "r", "u").agg(F.max("hit").alias("hit"))
    return edges.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("reachable"))


def overlap(a: Column, b: Column) -> Column:
    """The offline similarity of two texts: shared words over the root of their counts."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    return F.size(F.array_intersect(x, y)) / F.sqrt(F.greatest(F.size(x) * F.size(y), F.lit(1)))


LINK = "array<struct<pos:int,relation:string,target:string,incoming:boolean,sim:double>>"


def offline_decision(links: Column, follow: int = 3, cite: int = 8, floor: float | None = None) -> Column:
    """What the offline navigator does with a page's ranked links: it cites those of similarity `floor` or more (None:
    none), follows the first ones, and calls the question answered if it cites."""
    named = F.array().cast(LINK) if floor is None else F.slice(F.filter(links, lambda x: x["sim"] >= floor), 1, cite)
    return F.struct((F.size(named) > 0).alias("answered"), named.alias("cite"), F.slice(links, 1, follow).alias("follow"))


def edge_of(node: Column, link: Column) -> Column:
    """A link as the triple that is stored, h|r|u."""
    return F.when(link["incoming"], F.concat_ws("|", link["target"], link["relation"], node)).otherwise(F.concat_ws("|", node, link["relation"], link["target"]))


def walk(questions: DataFrame, page: DataFrame, materialise: Callable[[DataFrame, str], DataFrame], depth: int = DEFAULT.depth, beam: int = DEFAULT.beam, weight: float = DEFAULT.step_weight, pages: int = DEFAULT.pages, similarity: Callable[[Column, Column], Column] = overlap, decide: Callable[[Column], Column] = offline_decision) -> DataFrame:
    """qid, subquery, path, cited, edges, score: the finished chains of a best-first walk for each sub-query.

    questions: qid, subquery, question (what a link is compared with), node (a root); page: links that pages show.  A round
    opens the page of each chain's last node, ranks its links, and takes the decision on them (decide: a column function
    of the ranked links that gives answered, cite and follow; a provider's, or a rule).  Cited facts stay with the chain
    and all that comes of it; links that are followed make longer chains, never to a node that a chain has; their score is
    step rank and the chain's similarity to the question; `beam` of each sub-query go on.  A sub-query that has opened
    `pages` pages opens no more.  Finished are: chains that cite, chains that came of an answered page, dead ends that
    hold something, and the last beam.  Of one path the last state counts.  `edges` is the evidence: cited facts first,
    then the path, each once."""
    key = ["qid", "subquery"]
    none, empty = F.array().cast("array<string>"), F.lit("")
    shown = page.select(F.col("name").alias("node"), "relation", "target", "incoming")
    start = questions.select(*key, "question", "node", F.array("node").alias("nodes"), none.alias("steps"), none.alias("cited"), F.lit(0.0).alias("score"), F.lit(0).alias("opened"))
    now, done = materialise(start, "walk0"), []
    state = [*key, "question", "node", "nodes", "steps", "cited", "score", "opened"]
    path = F.concat_ws(";", "steps")
    for d in range(1, depth + 1):
        goes = now.where(F.col("opened") < pages)
        held = now.where(F.col("opened") >= pages)
        link_text = F.concat_ws(" ", F.replace("relation", F.lit("_"), F.lit(" ")), "target")
        links_ = goes.join(shown, "node").withColumn("sim", similarity(F.col("question"), link_text).cast("double"))
        order = F.struct((-F.round("sim", 9)).alias("m"), "relation", "target", "incoming", "sim")
        one = links_.groupBy(*key, "steps", "nodes").agg(F.array_sort(F.collect_list(order)).alias("x"))  # a page's budget of links
        ranked = F.transform("x", lambda x, i: F.struct(i.alias("pos"), x["relation"].alias("relation"), x["target"].alias("target"), x["incoming"].alias("incoming"), x["sim"].alias("sim"))).cast(LINK)
        seen = goes.join(one.select(*key, "steps", "nodes", ranked.alias("links")), [*key, "steps", "nodes"], "left").withColumn("links", F.coalesce("links", F.array().cast(LINK)))
        told = seen.withColumn("d", decide(F.col("links")))
        told = told.withColumn("cited", F.array_distinct(F.concat("cited", F.transform("d.cite", lambda x: edge_of(F.col("node"), x)))))
        told = materialise(told.withColumn("n", F.size("d.follow")), f"told{d}")
        each = told.select("*", F.posexplode("d.follow").alias("rank", "link")).where(~F.array_contains("nodes", F.col("link.target")))
        steps = F.array_append("steps", edge_of(F.col("node"), F.col("link")))
        kids = each.select(*key, "question", F.col("link.target").alias("node"), F.array_append("nodes", F.col("link.target")).alias("nodes"), steps.alias("steps"), "cited", "rank", "n", "opened", F.col("d.answered").alias("answered"))
        said = F.replace(F.replace(F.concat_ws(" ", "steps"), F.lit("|"), F.lit(" ")), F.lit("_"), F.lit(" "))
        score = F.lit(weight) * (1 - F.col("rank") / F.greatest("n", F.lit(1))) + F.lit(1 - weight) * similarity(F.col("question"), said)
        kids = materialise(kids.withColumn("score", score), f"kids{d}")
        grew = kids.select(*key, F.slice("steps", 1, F.size("steps") - 1).alias("steps"), F.slice("nodes", 1, F.size("nodes") - 1).alias("nodes")).distinct().withColumn("grew", F.lit(True))
        flag = told.join(grew, [*key, "steps", "nodes"], "left")
        ends = (F.size("d.cite") > 0) | (F.col("grew").isNull() & ((F.size("steps") > 0) | (F.size("cited") > 0)))
        done.append(flag.where(ends).select(*key, path.alias("path"), F.col("nodes")[0].alias("root"), "steps", "cited", "score", F.lit(2 * d).alias("turn")))
        done.append(kids.where("answered").select(*key, path.alias("path"), F.col("nodes")[0].alias("root"), "steps", "cited", "score", F.lit(2 * d + 1).alias("turn")))
        total = goes.groupBy(*key).agg(F.count(F.lit(1)).alias("more"))
        cut = F.row_number().over(W.partitionBy(*key).orderBy(F.desc(F.round("score", 9)), "root", "path"))
        best = kids.select("*", path.alias("path"), F.col("nodes")[0].alias("root")).withColumn("k", cut).where(F.col("k") <= beam)
        nxt = best.join(total, key).withColumn("opened", F.col("opened") + F.col("more").cast("int")).select(*state)
        now = materialise(nxt.unionByName(held.select(*state)), f"walk{d}")
    done.append(now.where((F.size("steps") > 0) | (F.size("cited") > 0)).select(*key, path.alias("path"), F.col("nodes")[0].alias("root"), "steps", "cited", "score", F.lit(2 * depth + 2).alias("turn")))
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    last = every.groupBy(*key, "root", "path").agg(F.max_by(F.struct("steps", "cited", "score"), F.struct("turn", F.size("cited"))).alias("x"))
    return last.select(*key, "root", "path", "x.cited", F.array_distinct(F.concat("x.cited", "x.steps")).alias("edges"), "x.score")


def by_turns(chains: list[list], budget: int) -> list:
    """Edges taken one a turn from each chain; a chain whose next edge was taken goes on to its next new one."""
    taken: dict = {}
    waiting = [iter(c) for c in chains]
    while waiting and len(taken) < budget:
        still = []
        for chain in waiting:
            edge = next((e for e in chain if e not in taken), None)
            if edge is not None and len(taken) < budget:
                taken[edge] = len(taken)
                still.append(chain)
        waiting = still
    return list(taken)


def by_best(chains: list[list], budget: int) -> list:
    """Edges of the best chain first, then of the next, each once."""
    return list(dict.fromkeys(e for c in chains for e in c))[:budget]


def by_choice(chains: list[list], budget: int, picks: list[int] | None, offered: int = 40) -> list:
    """The edges that a model picked by number out of all, in their order; by turns where it picked none."""
    every = list(dict.fromkeys(e for c in chains for e in c))
    if len(every) <= budget:
        return every
    chosen = list(dict.fromkeys(every[i - 1] for i in picks or [] if 1 <= i <= min(offered, len(every))))[:budget]
    return chosen or by_turns(chains, budget)


def _turns(chains: Column, budget: int) -> Column:
    """by_turns as a column: a round adds an edge while there is one, and takes one of each chain at the most."""
    none = F.array().cast("array<string>")
    rounds = F.least(F.lit(budget), F.array_max(F.transform(chains, F.size)))
    return F.aggregate(F.flatten(F.array_repeat(chains, rounds)), none, lambda taken, c: F.when(F.size(taken) >= budget, taken).otherwise(F.concat(taken, F.slice(F.array_except(c, taken), 1, 1))))


def _choice(chains: Column, budget: int, picks: Column, offered: int = 40) -> Column:
    """The edges that a model picked by number out of all, in their order; by turns where it picked none."""
    every = F.array_distinct(F.flatten(chains))
    meant = F.filter(F.coalesce(picks, F.array().cast("array<int>")), lambda i: (i >= 1) & (i <= F.least(F.lit(offered), F.size(every))))
    chosen = F.slice(F.array_distinct(F.transform(meant, lambda i: F.get(every, i - 1))), 1, budget)
    return F.when(F.size(every) <= budget, every).when(F.size(chosen) > 0, chosen).otherwise(_turns(chains, budget))


def evidence(chains: DataFrame, budget: int = DEFAULT.evidence, way: str = "turns", picks: DataFrame | None = None) -> DataFrame:
    """qid, rank, edge.  chains: qid, verdict, score, edges (in order).  Rejected chains give nothing; others come by
    verdict, then score.  `way`: "turns", "best" (drain the best chain first) or "choice" (picks: qid, numbers that a
    model named).  A question has few chains (the beam), so they are one array, and the fold is a column function."""
    place = F.array_position(F.array(*map(F.lit, VERDICTS)), F.coalesce("verdict", F.lit("")))
    place = F.when(place > 0, place - 1).otherwise(F.lit(2))
    rows = chains.where(~F.col("verdict").eqNullSafe("reject")).select("qid", F.struct(place.alias("v"), (-F.col("score")).alias("s"), "edges").alias("x"))
    own = rows.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["edges"]).alias("chains"))
    if way == "choice":
        told = own.withColumn("numbers", F.lit(None).cast("array<int>")) if picks is None else own.join(picks.groupBy("qid").agg(F.min(F.col("numbers").cast("array<int>")).alias("numbers")), "qid", "left")
        picked = told.select("qid", _choice(F.col("chains"), budget, F.col("numbers")).alias("taken"))
    elif way == "best":
        picked = own.select("qid", F.slice(F.array_distinct(F.flatten("chains")), 1, budget).alias("taken"))
    else:
        picked = own.select("qid", _turns(F.col("chains"), budget).alias("taken"))
    return picked.select("qid", F.posexplode("taken").alias("rank", "edge")).select("qid", (F.col("rank") + 1).alias("rank"), "edge")


def evidence_rows(chains: DataFrame, budget: int = DEFAULT.evidence, way: str = "turns") -> DataFrame:
    """The same as triples: qid, k, h, r, u, of edges written h|r|u."""
    part = lambda i: F.get(F.split("edge", r"\|"), F.lit(i))
    return evidence(chains, budget, way).select("qid", F.col("rank").alias("k"), part(0).alias("h"), part(1).alias("r"), part(2).alias("u"))


def page_ceilings(triples: DataFrame, order: DataFrame, gold: DataFrame, page: DataFrame, most: int = DEFAULT.pages) -> DataFrame:
    """qid, type, gold, reachable, rendered, paged: gold triples (qid, type, h, r, u) that have an end among the nodes
    reached, that a page of these shows, and that one of the first `most` pages shows.  order: qid, node, place (from 0,
    as pages would be opened); page: links that pages show."""
    edge = page.select("name", F.when(F.col("incoming"), F.col("target")).otherwise(F.col("name")).alias("h"), F.col("relation").alias("r"), F.when(F.col("incoming"), F.col("name")).otherwise(F.col("target")).alias("u"))
    once = gold.select("qid", "type", "h", "r", "u").distinct()
    ends = once.select("*", F.explode(F.array("h", "u")).alias("node")).distinct()
    met = ends.join(order, ["qid", "node"], "left").join(edge.withColumnRenamed("name", "node").withColumn("shown", F.lit(True)), ["node", "h", "r", "u"], "left")
    each = met.groupBy("qid", "type", "h", "r", "u").agg(F.max(F.col("place").isNotNull()).alias("a"), F.max(F.col("place").isNotNull() & F.col("shown").isNotNull()).alias("b"), F.max((F.col("place") < most) & F.col("shown").isNotNull()).alias("c"))
    return each.groupBy("qid", "type").agg(F.count(F.lit(1)).alias("gold"), F.count_if("a").alias("reachable"), F.count_if("b").alias("rendered"), F.count_if("c").alias("paged"))


def ceiling_shares(rows: DataFrame, skipped: list[str] = ()) -> DataFrame:
    """type, questions and shares of gold for each type, for ALL, and for ALL less some types."""
    scope = F.filter(F.array(F.col("type"), F.lit("ALL"), F.when(~F.col("type").isin(*skipped) if skipped else F.lit(False), F.lit("ALL less skipped"))), lambda x: x.isNotNull())
    every = rows.select(F.explode(scope).alias("scope"), "gold", "reachable", "rendered", "paged")
    share = lambda c: F.round(F.sum(c) / F.sum("gold"), 6).alias(c)
    return every.groupBy(F.col("scope").alias("type")).agg(F.count(F.lit(1)).alias("questions"), F.sum("gold").alias("gold"), share("reachable"), share("rendered"), share("paged"))


def discovery(triples: DataFrame, roots: DataFrame, depth: int, materialise: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """qid, node, place: nodes in the order in which a breadth-first reader meets them: roots (qid, node, place) first,
    then what each shows, outgoing before incoming, by seq; a node's first place counts.  A level is ordered by the place
    of its parents, one ranking for each question."""
    near = materialise(links(triples).select(F.col("name").alias("node"), F.col("target").alias("next"), F.struct("incoming", "seq").alias("at")), "near")
    seen = materialise(roots.select("qid", "node", F.col("place").cast("long").alias("place")), "order0")
    level = seen
    for d in range(1, depth + 1):
        met = level.join(near, "node").groupBy("qid", "next").agg(F.min(F.struct("place", "at")).alias("x")).withColumnRenamed("next", "node")
        new = met.join(seen.select("qid", "node"), ["qid", "node"], "left_anti")
        base = seen.groupBy("qid").agg((F.max("place") + 1).alias("base"))
        placed = new.join(base, "qid").withColumn("k", F.row_number().over(W.partitionBy("qid").orderBy("x", "node")) - 1)
        level = materialise(placed.select("qid", "node", (F.col("base") + F.col("k")).cast("long").alias("place")), f"order{d}")
        seen = seen.unionByName(level)
    return seen
