import pytest
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import clean, evaluate, graph, pages, search, templates, vectors
from graphloom.storage import Steps


def edges(spark, rows):
    return spark.createDataFrame([(h, r, u, f"{i:04d}") for i, (h, r, u) in enumerate(rows)], "h string, r string, u string, seq string")


def test_merge_keeps_first_order_of_sources(spark):
    c = spark.createDataFrame([(3, "a", "r", "b", "f2"), (1, "a", "r", "b", "f1"), (2, "a", "r", "b", "f2"), (4, "A", "r", "a ", "f1")], "seq long, h string, r string, u string, source string")
    rows = graph.merge(graph.valid(c)).collect()
    assert [(r.seq, r.sources) for r in rows] == [(1, ["f1", "f2"])]


def test_degrees_count_both_ends(spark):
    t = edges(spark, [("a", "r", "a"), ("a", "r", "b")])
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    assert {r.name: r.degree for r in graph.degrees(t, names).collect()} == {"a": 3, "b": 1, "c": 0}


def test_chain_rules_one_by_one(spark):
    good = [("s", "made_from", "m"), ("m", "uses_method", "e")]

    def paths(more, **k):
        t = edges(spark, good + more)
        return {r.path for r in templates.chains(t, 2, **{"hub_degree": 99, "sink_degree": 99} | k).collect()}

    whole = "s-made_from>m-uses_method>e"
    assert whole in paths([])
    assert whole not in paths([("s", "made_from", "other")])  # forked
    assert whole not in paths([("s", "uses_material", "x")])  # a rival wording
    assert whole not in paths([("m", "x1", "y"), ("m", "x2", "z")], hub_degree=4)  # through a hub
    assert whole not in paths([("q", "r1", "e"), ("w", "r2", "e")], sink_degree=3)  # a sink as answer
    assert paths([("e", "associated_with", "z")]) == {whole}  # a weak end
    assert paths([("e", "is_a", "z")]) == {whole, "m-uses_method>e-is_a>z"}
    assert paths([("e", "gives", "m")]) == {whole, "s-made_from>m-uses_method>e", "q"} - {"q"}  # no way back


@pytest.mark.parametrize(("size", "removed", "stays"), [(5, 1, False), (4, 1, True), (5, 4, True), (6, 5, False)])
def test_absence_share(spark, size, removed, stays):
    rows = [(f"x{i}", "has", "A") for i in range(size)] + [(f"x{i}", "wants", "B") for i in range(removed)]
    rows += [(f"y{i}", "wants", "B") for i in range(max(0, 3 - removed))]
    got = [r for r in templates.absences(edges(spark, rows)).collect() if r.r1 == "has"]
    assert bool(got) == stays
    if stays:
        assert got[0].answer == ";".join(f"x{i}" for i in range(removed, size))


def test_page_budget_and_truncation(spark):
    sizes = {"a": 1, "b": 2, "c": 9, "d": 9, "e": 9, "f": 9, "g": 9, "h": 9}
    t = edges(spark, [("n", r, f"{r}{i}") for r, k in sizes.items() for i in range(k)])
    got = {r.relation: (r["take"], r.truncated) for r in pages.budget(t).where("name = 'n'").collect()}
    assert [got[r][0] for r in sizes] == [1, 2, 8, 8, 8, 8, 5, 0] and [got[r][1] for r in "cdefgh"] == [1, 1, 1, 1, 4, 9]
    assert pages.page_links(t).where("name = 'n'").count() == 40
    page = pages.render(t, spark.createDataFrame([("n", 1, "p.jpg", "")], "entity string, seq long, path string, caption string")).where("name = 'n'").first().page
    assert page.startswith("# n\n\n[1 image(s)] (uncaptioned)\n\n## Facts\n- a: a0\n") and "(+9 more)" not in page and "g: g0, g1, g2, g3, g4  (+4 more)" in page


def test_type_nodes_and_folding(spark):
    rows = [(f"x{i}", "is_a", "bare") for i in range(3)] + [(f"x{i}", "is_a", "texted") for i in range(3)] + [("bare", "r", "z"), ("x0", "is_a", "rare")]
    t = edges(spark, rows)
    nodes = clean.type_nodes(t, spark.createDataFrame([("texted",)], "entity string"))
    assert [r.name for r in nodes.collect()] == ["bare"]
    types, left = clean.fold(t, nodes)
    assert {r.name: r.types for r in types.collect()} == {"x0": "bare", "x1": "bare", "x2": "bare"}
    assert left.where("u = 'bare'").count() == 0 and left.where("h = 'bare'").count() == 1


def test_duplicate_spellings(spark):
    t = edges(spark, [("x", "r", "y"), ("X (別名)", "r", "y"), ("x", "r", "X (別名)"), ("x", "q", "z")])
    names = spark.createDataFrame([("x", 0), ("X (別名)", 1), ("y", 2), ("z", 3), ("()", 4)], "name string, seq long")
    dup = clean.duplicate_spellings(t, names)
    assert [tuple(r) for r in dup.collect()] == [("X (別名)", "x")]
    assert sorted((r.h, r.r, r.u) for r in clean.remap(t, dup).collect()) == [("x", "q", "z"), ("x", "r", "y")]


def test_resolution_order(spark):
    names = spark.createDataFrame([("Ab", 0), ("AB", 1), ("c", 2)], "name string, seq long")
    aliases = spark.createDataFrame([("ab", "c", 0), ("zz", "c", 2), ("ZZ", "Ab", 1)], "alias string, name string, seq long")
    got = {r.mention: r.name for r in graph.resolve(spark.createDataFrame([("Ab",), (" aB",), ("zz",), ("no",)], "mention string"), names, aliases).collect()}
    assert got == {"Ab": "Ab", " aB": "AB", "zz": "Ab", "no": None}


def test_turns():
    a, b, c = ["1", "2", "3"], ["1", "4", "5"], ["1"]
    assert search.by_turns([a, b, c], 10) == ["1", "4", "2", "5", "3"] and search.by_turns([a, b, c], 3) == ["1", "4", "2"]


def test_evidence_and_walk(spark):
    chains = spark.createDataFrame([("q", "partial", 0.9, ["a", "b"]), ("q", "support", 0.1, ["a", "c"]), ("q", "reject", 5.0, ["z"])], "qid string, verdict string, score double, edges array<string>")
    assert [r.edge for r in search.evidence(chains, 3).orderBy("rank").collect()] == ["a", "b", "c"]
    t = edges(spark, [("root", "made_from", "kozo fiber"), ("root", "located_in", "gifu"), ("kozo fiber", "produced_in", "kochi")])
    q = spark.createDataFrame([("q", "s", "where is the kozo fiber produced in", "root")], "qid string, subquery string, question string, node string")
    got = {r.path for r in search.walk(q, pages.page_links(t), Steps(spark, "t"), depth=2).collect()}
    assert got == {"root|made_from|kozo fiber;kozo fiber|produced_in|kochi", "root|located_in|gifu"}
    assert search.by_best([["a", "b"], ["a", "c", "d"]], 3) == ["a", "b", "c"]
    assert search.by_choice([["a", "b"], ["a", "c"]], 2, [3, 9, 1]) == ["c", "a"] and search.by_choice([["a", "b"], ["c"]], 2, []) == ["a", "c"] and search.by_choice([["a"]], 2, None) == ["a"]


def plain_walk(pages_of, question, root, depth, beam, cap, floor, weight=0.6, follow=3):
    """The same walk with lists, chain by chain."""

    def sim(text):
        import re

        x, y = (set(re.findall(r"[^\W_]+", s.lower())) for s in (question, text))
        return len(x & y) / max(len(x) * len(y), 1) ** 0.5

    front, finished, opened = [([root], [], [], 0.0)], {}, 0
    for _ in range(depth):
        if not front or opened >= cap:
            break
        opened += len(front)
        nxt = []
        for nodes, steps, cited, score in front:
            at = nodes[-1]
            ranked = sorted(pages_of.get(at, []), key=lambda x: (-round(sim(f"{x[0].replace('_', ' ')} {x[1]}"), 9), *x))
            edge = lambda x, at=at: f"{x[1]}|{x[0]}|{at}" if x[2] else f"{at}|{x[0]}|{x[1]}"
            cites = [x for x in ranked if sim(f"{x[0].replace('_', ' ')} {x[1]}") >= floor][:8]
            cited = list(dict.fromkeys(cited + [edge(x) for x in cites]))
            kids = []
            for rank, x in enumerate(ranked[:follow]):
                if x[1] not in nodes:
                    path = [*steps, edge(x)]
                    kids.append(([*nodes, x[1]], path, cited, weight * (1 - rank / max(len(ranked[:follow]), 1)) + (1 - weight) * sim(" ".join(path).replace("|", " ").replace("_", " "))))
            if cites or (not kids and (steps or cited)):
                finished[";".join(steps)] = (cited, steps)
            if cites:
                for k in kids:
                    finished[";".join(k[1])] = (k[2], k[1])
            nxt += kids
        front = sorted(nxt, key=lambda c: (-round(c[3], 9), ";".join(c[1])))[:beam]
    for _, steps, cited, _ in front:
        if steps or cited:
            finished[";".join(steps)] = (cited, steps)
    return {(p, tuple(dict.fromkeys(c + st))) for p, (c, st) in finished.items()}


@pytest.mark.parametrize(("cap", "floor"), [(24, 0.25), (2, 0.25), (24, 9.0)])
def test_walk_against_lists(spark, cap, floor):
    import random

    rng = random.Random(cap)
    names = [f"{a} {b}" for a in ("red", "blue", "old") for b in ("mill", "river", "paper", "screen")]
    rows = sorted({(rng.choice(names), rng.choice(["made_of", "found_near", "used_for"]), rng.choice(names)) for _ in range(45)})
    t = edges(spark, [r for r in rows if r[0] != r[2]])
    page = pages.page_links(t)
    pages_of = {}
    for r in page.collect():
        pages_of.setdefault(r.name, []).append((r.relation, r.target, r.incoming))
    asked = [(f"q{i}", f"what is the {rng.choice(names)} {rng.choice(['made of', 'found near', 'used for'])}", rng.choice(names)) for i in range(6)]
    q = spark.createDataFrame([(i, "s", x, n) for i, x, n in asked], "qid string, subquery string, question string, node string")
    got = search.walk(q, page, Steps(spark, "t"), pages=cap, decide=lambda links: search.offline_decision(links, floor=floor)).collect()
    for i, question, root in asked:
        assert {(r.path, tuple(r.edges)) for r in got if r.qid == i} == plain_walk(pages_of, question, root, 3, 3, cap, floor)


def test_reach_levels(spark):
    t = edges(spark, [("a", "r", "b"), ("c", "r", "b"), ("c", "r", "d")])
    got = {(r.node, r.level) for r in search.reach(t, spark.createDataFrame([("q", "a")], "qid string, node string"), 2, Steps(spark, "t")).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2)}


def test_metrics(spark):
    rows = [("q", "gold", "a", "r", "b"), ("q", "gold", "c", "r", "d"), ("q", "pred", "b", "x", "a"), ("q", "pred", "c", "r", "d"), ("q", "pred", "c", "r", "d"), ("e", "gold", "a", "r", "b")]
    got = {r.qid: r for r in evaluate.precision_recall(spark.createDataFrame(rows, "qid string, side string, h string, r string, u string")).collect()}
    assert (got["q"].precision, got["q"].recall, got["q"].recall_entailed) == (0.5, 0.5, 1.0) and (got["e"].precision, got["e"].recall) == (0.0, 0.0)


def test_greedy_filter_is_the_loop(spark):
    import random

    rng = random.Random(1)
    steps = Steps(spark, "t")
    for n, m in ((3, 0), (12, 18)):
        pairs = [(0, 1), (1, 2)] if n == 3 else sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})
        kept = []
        for i in range(n):
            if not any((j, i) in pairs for j in kept):
                kept.append(i)
        got = vectors.greedy_filter(spark.createDataFrame(pairs, "a long, b long"), spark.range(n).select("id"), Steps(spark, "g"))
        assert sorted(r.id for r in got.collect()) == kept
    assert steps is not None


def test_half_even_shares(spark):
    items = spark.createDataFrame([(f"q{i}", "a" if i < 5 else "b") for i in range(10)], "qid string, type string")
    assert {r.type: r.n for r in templates.stratified(items, 5).groupBy("type").agg(F.count("*").alias("n")).collect()} == {"a": 2, "b": 2}


def plain_sentences(text):
    import re

    return [x for x in (x.strip() for x in re.split(text_end, text)) if x]


text_end = text.SENTENCE_END


def plain_compress(raw, keywords, most):
    """Sentences in two classes; each is taken if all that is taken so far and itself fit when joined."""
    flat = " ".join(raw.split())
    if len(flat) <= most:
        return flat
    told = sorted(plain_sentences(flat), key=lambda s: not any(k and k.lower() in s.lower() for k in keywords))
    taken = []
    for s in told:
        if len(" ".join([*taken, s])) <= most:
            taken.append(s)
        elif not taken:
            taken = None
            break
    return " ".join(taken) if taken else (told[0] if told else flat)[: most - 1].rstrip() + "…"


def plain_paragraphs(raw, least, most):
    """Three passes: blocks, blocks of enough characters, pieces of few enough."""
    blocks = [b.strip() for b in raw.replace("\r\n", "\n").split("\n\n") if b.strip()]
    ends, size = [], -1
    for i, b in enumerate(blocks):
        size += len(b) + 1
        if size >= least:
            ends.append(i + 1)
            size = -1
    if blocks and (not ends or ends[-1] < len(blocks)):
        ends[-1:] = [len(blocks)]
    whole = ["\n".join(blocks[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
    return [piece for block in whole for piece in ([block] if len(block) <= most else plain_pieces(block, most))]


def plain_pieces(block, most):
    lines = [""]
    for s in plain_sentences(block):
        while len(s) > most:
            lines += [s[:most], ""]
            s = s[most:]
        if lines[-1] and len(lines[-1]) + 1 + len(s) > most:
            lines.append(s)
        else:
            lines[-1] = f"{lines[-1]} {s}".strip()
    return [x for x in lines if x]


def test_packing_of_sentences_against_plain_code(spark):
    import random

    rng = random.Random(5)
    pieces = ["One", " it", ". ", "! ", "。", "\n", "\n\n", "\r\n\r\n", "  ", "Äß", "word " * 6, "x" * 45, "? ", "\t", "\u00a0", "\x1c"]
    texts = ["", " ", "abcdefghij", *("".join(rng.choice(pieces) for _ in range(rng.randint(1, 60))) for _ in range(250))]
    df = spark.createDataFrame([(t, ["IT", ""], rng.randint(5, 60)) for t in texts], "t string, k array<string>, m int")
    for r in df.select("*", text.compressed("t", F.col("k"), F.col("m")).alias("c"), text.split_paragraphs("t", 12, 40).alias("p")).collect():
        assert r.c == plain_compress(r.t, ["it", ""], r.m) and r.p == plain_paragraphs(r.t, 12, 40)


def test_url_join_against_the_library(spark):
    from urllib.parse import urljoin

    bases = ["http://h", "http://h/", "http://h/d/e", "https://h:8/d/e/?q=1#f", "http://h/a/b/c/"]
    links = ["x", "/x", "//o/x", "http://z/y", "../x", "./x", "x/../../y", "?q", "#f", "", "a/./b", "..", ".", "mailto:a", "/../x", "x?y=/../z", "x/"]
    rows = [(b, x) for b in bases for x in links]
    got = spark.createDataFrame(rows, "b string, x string").select("b", "x", text.url_join("b", "x").alias("u")).collect()
    assert {(r.b, r.x): r.u for r in got} == {(b, x): urljoin(b, x) for b, x in rows}


def test_text(spark):
    assert text.reply_json('so ```json\n[1]\n``` x') == [1] and text.reply_json('see {"a": [1]} ok') == [1] and text.reply_json("no") is None
    assert text.fold("Ｗashi-和紙!") == "washi 和紙"
    row = spark.range(1).select(text.leaked(F.lit("The surface of Su-ki, su?"), F.array(F.lit("su"), F.lit("urfac"), F.lit("surface o")), F.array(F.lit("Su-ki"))).alias("x"), text.link_candidates(F.lit("a: b, c")).alias("y"), text.visual_terms(F.lit("A red Washi sheet, red paper, drying"), F.lit("washi")).alias("z"), text.safe_name(F.lit(' a/b:*? ')).alias("n"), text.safe_name(F.lit("//")).alias("e"), text.names_whole(F.lit("a surface"), F.lit("su")).alias("w")).first()
    assert row.x == ["su", "surface o"] and row.y == ["a: b", "c", "b", "c"] and row.n == "a b" and row.e == "entity" and not row.w
    assert row.z == ["drying", "sheet", "paper"]
    accented = spark.range(1).select(text.visual_terms(F.lit("Méthode Rédigée redé drying"), F.lit("méthode")).alias("z")).first()
    assert accented.z == ["drying", "Rédigée", "redé"]


def test_dropped_edges_do_not_depend_on_partitions(spark):
    t = edges(spark, [(f"h{i}", "r", f"u{i}") for i in range(200)])
    a, b = ({r.h for r in graph.drop_edges(x, 0.25).collect()} for x in (t, t.repartition(7)))
    assert a == b and 120 < len(a) < 180


def test_links(spark):
    html = """<a href="/a">x</a><a href='http://h/b?q'>y</a><img src="i/p.JPG"><div style="background:url('c.png')"><p>https://x.y/z.webp</p>"""
    row = spark.createDataFrame([("http://h/d/e", html)], "page string, html string").select(text.page_links(F.col("html")).alias("p"), text.image_links(F.col("html")).alias("i"), text.url_join("page", F.lit("i/p.JPG")).alias("u"), text.folded(F.lit("Ａ-b!")).alias("f")).first()
    assert row.p == ["/a"] and sorted(row.i) == ["c.png", "https://x.y/z.webp", "i/p.JPG"] and row.u == "http://h/d/i/p.JPG" and row.f == "a b"


def test_visual_subjects_and_chains(spark):
    t = edges(spark, [("a", "made_from", "b"), ("a", "associated_with", "c"), ("a", "uses_method", "d"), ("z", "made_by", "a")])
    img = spark.createDataFrame([("a", 1, "p", "c")], "entity string, seq long, path string, caption string")
    row = templates.visual_subjects(t, img).first()
    assert row.subject == "a" and row.facts == "made_from=b;uses_method=d" and row.relation in ("made_from", "uses_method")
    end = spark.createDataFrame([("b", "red")], "name string, terms string")
    assert [r.path for r in templates.visual_chains(t, end, 2).collect()] == ["z-made_by>a-made_from>b"]


def test_remaining_and_repaired_rows(spark):
    old = spark.createDataFrame([("full", "a", None), ("full", "b", "x: y")], "run string, qid string, error string")
    new = spark.createDataFrame([("new", "a", None), ("new", "b", None)], "run string, qid string, error string")
    assert sorted((r.run, r.qid) for r in evaluate.repaired(old, new).collect()) == [("full", "a"), ("new", "b")]
    assert [tuple(r)[1:] for r in evaluate.error_kinds(old).collect()] == [("x", 1)]
