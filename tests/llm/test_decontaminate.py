import random
import re

import pytest

from graphloom.llm import decontaminate as dc
from graphloom.llm.common import Scratch

WORD = re.compile(r"[^\W_]+(?:(?<=[0-9])[.,](?=[0-9])[^\W_]+)*")


def canon(w):
    if w[0] in "0123456789":
        return "<num>" if re.fullmatch(r"[0-9]+([.,][0-9]+)*", w) else w.lower()
    if w.lower() in dc.UNITS:
        return "<unit>"
    return "<name>" if w[0] != w[0].lower() and len(w) > 1 and w[1] == w[1].lower() else w.lower()


def brute(docs, items):
    out = set()
    parsed = {}
    for d, t in docs:
        parsed.setdefault(d, []).append(WORD.findall(t or ""))
    for i, t in items:
        iw = WORD.findall(t or "")
        if len(iw) < dc.LEAST:
            out |= {(d, i, 1, 1, "verbatim") for d, texts in parsed.items() for w in texts if iw and [x.lower() for x in w] == [x.lower() for x in iw]}
            continue
        size = min(len(iw), dc.WINDOW)
        n = len(iw) - size + 1
        for d, texts in parsed.items():
            verbatim, shifts = set(), {}
            for w in texts:
                for p in range(len(w) - size + 1):
                    for q in range(n):
                        a, b = iw[q : q + size], w[p : p + size]
                        if [x.lower() for x in a] == [x.lower() for x in b]:
                            verbatim.add(q)
                        ca, cb = list(map(canon, a)), list(map(canon, b))
                        plain = sum(not x.startswith("<") for x in ca)
                        if ca == cb and min(dc.PLAIN, size - 1) <= plain < size and size >= 4:
                            s = shifts.setdefault(p - q, (set(), set()))
                            s[0].add(q)
                            s[1].update((k, x.lower(), y.lower()) for k, x, y in zip(ca, a, b) if k.startswith("<"))
            good = set(verbatim)
            for qs, slots in shifts.values():
                if len({s[:2] for s in slots}) == len(slots) == len({(s[0], s[2]) for s in slots}):
                    good |= qs
            if len(good) >= dc.COVER * n:
                out.add((d, i, len(good), n, "verbatim" if len(verbatim) >= dc.COVER * n else "reparameterised"))
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(5)] + ["été", "kg", "hours"]
    names, items = ["Alice", "Bob", "Zoë"], [(0, None), (1, "too short"), (2, "exactly five words are here"), (3, "one Two 3")]
    for i in range(4, 16):
        w = [rng.choice(vocabulary) if rng.random() < 0.75 else rng.choice([str(rng.randint(1, 99)), "1,500.25", rng.choice(names)]) for _ in range(rng.randint(8, 40))]
        items.append((i, " ".join(w)))
    items.append((20, items[5][1]))
    docs = [(0, None), (1, ""), (2, "7 8 9 " * 50), (3, "Exactly FIVE words, are here!")]
    for d in range(4, 90):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        if rng.random() < 0.8:
            leak = rng.choice(items[4:])[1].split()
            kind = rng.random()
            if kind < 0.4:
                swap = {}
                leak = [swap.setdefault(x, str(rng.randint(100, 999))) if x[0].isdigit() else swap.setdefault(x, rng.choice(["Carl", "Dora", "Emil"])) if x in names else x for x in leak]
            elif kind < 0.5:
                leak = [x.upper() for x in leak]
            elif kind < 0.7:
                leak = leak[: len(leak) * rng.randint(2, 5) // 5]
            elif kind < 0.8:
                leak = [str(rng.randint(1, 9)) if x[0].isdigit() else x for x in leak]
            at = rng.randint(0, len(body))
            body[at:at] = leak
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(body)))
    docs += [(92, "Too, SHORT"), (93, "far too short"), (94, "so one two 3 and"), docs[10], (None, items[6][1]), (95, "x " * 50_000 + items[7][1]), (96, "-" * 200_000 + "." * 100_000)]
    got = dc.contaminated(spark.createDataFrame([(*r, 1, 1) for r in docs], "doc_id long, text string, item_id int, h int").repartition(3), spark.createDataFrame([(*r, 3) for r in items], "item_id long, text string, doc_id int"), Scratch(spark, "t"))
    rows = got.collect()
    want = brute([x for x in docs if x[0] not in (95, 96)], items)
    assert {(r.doc_id, r.item_id, r.n_matched, r.n_windows, r.kind) for r in rows if r.doc_id != 95} == want and len({k[4] for k in want}) == 2
    assert {r.item_id for r in rows if r.doc_id == 95} == {7}


def test_slots_must_be_consistent(spark):
    item = "if Ann buys 3 red pens and 5 blue pens while Ben sells 3 old books how many are left"
    docs = [(1, item.replace("3", "8").replace("5", "6").replace("Ann", "Eve")), (2, "if Eve buys 8 red pens and 8 blue pens while Ben sells 8 old books how many are left"), (3, "some other text about pens and books that is quite long indeed")]
    got = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"), Scratch(spark, "t")).collect()
    assert [(r.doc_id, r.kind) for r in got] == [(1, "reparameterised")]


@pytest.mark.parametrize("empty", ["docs", "items", "both"])
def test_empty_tables_and_cleaning(spark, empty):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, item), (2, "clean"), (None, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = docs.limit(0) if empty != "items" else docs
    items = items.limit(0) if empty != "docs" else items
    assert dc.contaminated(docs, items, Scratch(spark, "t")).count() == 0
    full = spark.createDataFrame([(1, item), (2, "clean"), (None, None)], "doc_id long, text string")
    left = dc.cleaned(full, spark.createDataFrame([(1, item)], "item_id long, text string"), Scratch(spark, "t")).collect()
    assert sorted((r.doc_id or 0) for r in left) == [0, 2]


DENSE = "Tom bought 12 apples for 3 dollars each and Anna bought 5 pears for 2 dollars each"
ASKED = DENSE + ". How many dollars did Tom and Anna spend"


def renamed(text, **values):
    return " ".join(values.get(w.rstrip("."), w) for w in text.split())


def test_number_dense_items(spark):
    """Truth by construction: consistent new values leak, others don't."""
    new = {"Tom": "Eve", "Anna": "Karl", "12": "40", "3": "7", "5": "6", "2": "9"}
    broken = DENSE.replace("3 dollars", "7 dollars").replace("2 dollars", "7 dollars")  # two values become one
    docs = [
        (1, "Some words go first. " + renamed(DENSE.replace("12", "40"), Tom="Eve", Anna="Karl")),
        (2, "w1x " * 3 + " ".join(new.get(w, w) for w in DENSE.split()) + " and so on"),
        (3, " ".join(new.get(w, w) for w in ASKED.split())),
        (4, broken),
        (5, "Eve 7 3 km and 6 4 9 8 kg and 5 1 2 3 4 hours and 6"),
        (6, "Eve sold 40 plums to 7 pounds all or Karl sold 6 nuts to 9 pounds all"),
    ]
    items = [(1, DENSE), (2, ASKED), (3, "Eve 1 2 km and 3 4 5 6 kg and 7 8 9 10 11 hours and 12")]
    got = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), Scratch(spark, "t")).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert {(1, 1), (2, 1), (3, 1), (3, 2)} <= found
    assert not {x for x in found if x[0] in (4, 5, 6)}
    assert all(r.coverage == r.n_matched / r.n_windows >= dc.COVER for r in got)
    assert {(r.n_matched, r.n_windows, r.kind) for r in got if (r.doc_id, r.item_id) == (2, 1)} == {(10, 10, "reparameterised")}


def test_short_items(spark):
    """Items of three words, short sums with other numbers, and what isn't either."""
    items = [(1, "solve for x"), (2, "What is 12 plus 30?"), (3, "Paris"), (4, "What is 12 plus 12?")]
    docs = [(1, "First, solve for X and then rest"), (2, "He asked: What is 7 plus 9? Nobody knew."), (3, "paris!"), (4, "I saw Paris in spring"), (5, "what was 12 plus 30"), (6, "solve it for x"), (7, "So What is 4 plus 4 then")]
    got = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), Scratch(spark, "t")).collect()
    assert {(r.doc_id, r.item_id, r.kind) for r in got} == {(1, 1, "verbatim"), (2, 2, "reparameterised"), (3, 3, "verbatim"), (7, 4, "reparameterised")}


def test_very_many_windows(spark, monkeypatch):
    """300,000 windows: a larger set of bits and a shuffled join, with the same result, and few places beyond the true ones."""
    many = spark.range(25_000).selectExpr("id AS item_id", "concat_ws(' ', transform(sequence(1, 19), i -> substring(sha1(concat(id, '-', i)), 1, 12))) AS text")
    docs = many.where("item_id % 100 = 7").selectExpr("item_id AS doc_id", "concat('some words before ', text, ' and after') AS text").unionByName(spark.range(500).selectExpr("id + 100000 AS doc_id", "concat_ws(' ', transform(sequence(1, 300), i -> substring(md5(concat(id, '+', i)), 1, 9))) AS text"))
    scratch = Scratch(spark, "t")
    got = dc.contaminated(docs, many, scratch).select("doc_id", "item_id", "n_matched", "n_windows").collect()
    assert {tuple(r) for r in got} == {(i, i, 12, 12) for i in range(7, 25_000, 100)}
    assert spark.read.parquet(f"{scratch.root}/windows").count() > dc.BROADCAST_WINDOWS
