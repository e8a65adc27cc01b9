import random

from graphloom.llm import quotes
from graphloom.llm.common import Scratch

A = "I think the red boat is faster. It has a brand new sail! And no engine."
B = "Ann wrote:\n> I think the red boat\n> is faster. It has a brand new\n> sail!\n\nNo. The blue boat won last year."
C = "Bob wrote:\n> Ann wrote:\n>> It has a brand new sail!\n> The blue boat won last year.\nThat was luck."
SCHEMA = "conv_id long, turn long, role string, text string, depth int, h int"


def levels(text):
    return [(level, own) for level, own, _ in quotes.passages(text)]


def test_levels():
    assert levels("a\n> b\n>> c\n> > d\n> e\nf") == [(0, "a"), (1, "b"), (2, "c\nd"), (1, "e"), (0, "f")]
    assert quotes.own_text(B) == "No. The blue boat won last year." and quotes.own_text(C) == "That was luck."
    assert levels("") == [(0, "")] and quotes.own_text("she wrote: x") == "she wrote: x"
    for text in (A, B, C, "", "x wrote:\n\n> y", "a wrote:\nb wrote:\n> c\n\n", "> q\n\nz", "x wrote:"):
        assert "\n".join(raw for _, _, raw in quotes.passages(text)) == text  # nothing is lost where nothing is linked
    assert quotes.own_text(B, {0}) == quotes.own_text(B) and quotes.own_text(B, {7}) == B


def test_many_introductions_take_linear_time():
    text = "he wrote:\n\n" * 20_000 + "> x"
    assert len(quotes.passages(text)) <= 2


def test_links_and_order(spark):
    rows = [(1, 0, "user", A), (1, 1, "user", "Something else."), (1, 2, "user", B), (1, 3, "user", C), (2, 0, "user", B), (2, 1, None, None), (2, 2, "user", ""), (3, None, "user", "x"), (None, 1, "user", "y"), (1, 1, "user", "Something else."), (4, 0, "user", "> " * 50_000 + "x " * 50_000), (4, 1, "user", "> nobody ever said these words\n\nwhat"), (5, 0, "user", "yes"), (5, 1, "user", "no it is not. yes"), (5, 2, "user", "> yes\nwhy?")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).repartition(3)
    out = quotes.unquoted(df, Scratch(spark, "t")).collect()
    assert len(out) == len(rows)
    by = {(r.conv_id, r.turn): r for r in out}
    assert (by[1, 2].parent, by[1, 2].thread, by[1, 2].depth, by[1, 2].n_quoted) == (0, 0, 1, 1)
    assert (by[1, 3].parent, by[1, 3].thread, by[1, 3].depth, by[1, 3].n_quoted) == (2, 0, 2, 2)
    assert by[1, 3].text == "That was luck." and by[2, 0].parent is None
    assert by[2, 0].text == "No. The blue boat won last year." and by[2, 0].n_foreign == 1  # said in conversation 1
    assert by[4, 1].text == "> nobody ever said these words\n\nwhat" and by[4, 1].parent is None
    assert by[5, 2].parent == 0 and by[5, 2].text == "why?"  # a short passage is only known as a whole message
    whole = {r.conv_id: r for r in quotes.conversations(df, Scratch(spark, "t")).collect()}
    assert whole[1].n_messages == 5 and whole[1].turns == [0, 2, 3, 1, 1] and whole[1].parents == [None, 0, 2, None, None]
    assert whole[1].text.index("red boat") < whole[1].text.index("blue boat") < whole[1].text.index("luck") < whole[1].text.index("Something")
    assert whole[3].turns == [None] and whole[None].turns == [1]
    assert quotes.conversations(df.limit(0), Scratch(spark, "t")).count() == 0


def brute(rows):
    """Links and parents by plain loops."""
    messages = {}
    for c, t, _, text in rows:
        messages.setdefault((c, t), []).append(text)
    said = {key: {h for text in texts for h in quotes.hashes("\n\n".join(p for level, p, _ in quotes.passages(text) if level == 0))} for key, texts in messages.items()}
    parent, taken = {}, {}
    for (c, t), texts in messages.items():
        for text in texts:
            for k, (level, own, _) in enumerate(quotes.passages(text)):
                if not level:
                    continue
                votes, far = {}, {}
                for h, n in quotes.hashes(own).items():
                    before = [u for (d, u), s in said.items() if d == c and u < t and h in s]
                    if before:
                        votes[max(before)] = votes.get(max(before), 0) + n
                    everywhere = [key for key, s in said.items() if h in s]
                    if everywhere and n >= quotes.LEAST and min(everywhere)[0] != c:
                        far[min(everywhere)] = far.get(min(everywhere), 0) + n
                if votes:
                    source = max(votes, key=lambda u: (votes[u], u))
                    if level == 1:
                        parent[c, t] = max(source, parent.get((c, t), -1))
                if votes or far:
                    taken.setdefault((c, t, text), set()).add(k)
    return parent, taken


def test_against_brute_force(spark):
    rng = random.Random(11)
    words = ["boat", "sail", "wind", "red", "blue", "old", "fast", "we", "saw", "it", "there", "rope"]

    def say():
        return ["\n\n".join(". ".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 2)))][0]

    rows, common = [], "we saw it there again"
    for c in range(25):
        own = []
        for t in range(rng.randint(1, 9)):
            text = say() if rng.random() < 0.8 else common
            if own and rng.random() < 0.7:
                old = rng.choice(own if rng.random() < 0.85 else [x[3] for x in rows])
                lines = old.split("\n")
                cut = lines[rng.randrange(len(lines)) :] if rng.random() < 0.3 else lines
                text = rng.choice(["", "Ann wrote:\n", "Bob wrote:\n\n"]) + "\n".join("> " + x for x in cut) + "\n" + text
            own.append(text)
            rows.append((c, t, "user", text))
    rows += rng.sample(rows, 5)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).repartition(5)
    parent, taken = brute(rows)
    got = quotes.unquoted(df, Scratch(spark, "t")).collect()
    want = [(c, t, parent.get((c, t)), quotes.own_text(text, taken[c, t, text]) if (c, t, text) in taken else text, len(taken.get((c, t, text), ()))) for c, t, _, text in rows]
    assert sorted(((r.conv_id, r.turn, r.parent, r.text, r.n_quoted) for r in got), key=str) == sorted(want, key=str)
    assert len(parent) > 20 and sum(r.n_foreign for r in got) > 3
    for r in quotes.conversations(df, Scratch(spark, "t")).collect():
        for i, p in enumerate(r.parents):
            assert p is None or p in r.turns[:i]


def test_a_common_sentence_makes_rows_in_proportion(spark, monkeypatch):
    rows = [(1, t, "user", "this very sentence is said by everyone here" if t % 2 else "> this very sentence is said by everyone here\n\nindeed") for t in range(4000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).repartition(5)
    scratch = Scratch(spark, "t")
    links = quotes.link(df, scratch)
    assert links.count() == 1999 and links.where("source <> turn - 1").count() == 0
    assert spark.read.parquet(f"{scratch.root}/latest").count() <= 3 * len(rows)
    assert quotes.positions(quotes.unquoted(df, Scratch(spark, "t")), Scratch(spark, "t")).selectExpr("max(position)", "count(DISTINCT position)").first() == (3999, 4000)
