import random
import re

import numpy as np
import pytest

from graphloom.llm import jaccard
from graphloom.llm.common import Scratch
from graphloom.llm.components import components

SCHEMA = "doc_id long, text string, n long, rep int, f1 string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def fold(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def plain_set(text, words=5):
    w = WORD.findall(fold(text or ""))
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute(rows):
    sets = [plain_set(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "Ab", "x\x0bq", "\x1c"]
    common = [rng.choice(vocabulary) for _ in range(30)]
    texts = [None, "", " \n", "a", "A", "a b", "a b c d e", "a b c d e f", " a b"]
    while len(texts) < n:
        kind = rng.random()
        if kind < 0.45 or len(texts) < 20:
            w = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 6, 8, 10, 12, 15, 20, 40, 120]))]
            if rng.random() < 0.4:
                w += common
        else:
            w = (rng.choice(texts) or "").split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                i = rng.randrange(len(w) + 1)
                w[i : i + rng.choice([0, 1])] = [rng.choice(vocabulary)] if rng.random() < 0.6 else []
        texts.append(rng.choice([" ", "\n", "  "]).join(w))
    ids = rng.sample(range(10_000), n)
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, 1, 1, "c") for d, t in rows], SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in jaccard.classes(docs, Scratch(spark, "t")).collect())
    assert got == brute(rows)


@pytest.mark.parametrize("seed", [3, 4])
def test_rounds_and_split_lists_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "PAIRS", 0)
    monkeypatch.setattr(jaccard, "STAYS", -1)
    monkeypatch.setattr(jaccard, "WORTH", 1e9 if seed == 3 else 0.5)
    monkeypatch.setattr(jaccard, "boundary", lambda *a: 0)
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, 1, 1, "c") for d, t in rows], SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in jaccard.classes(docs, Scratch(spark, "t")).collect())
    assert got == brute(rows)


def test_longer_keys_meet_every_link():
    rng = np.random.default_rng(5)
    classes = np.zeros(jaccard.SKETCH, np.uint8)
    classes[rng.integers(0, jaccard.SKETCH, jaccard.SKETCH // 3)] = 2
    tried = 0
    for _ in range(600):
        n = int(rng.integers(3, 40))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.92], rng.integers(0, 1 << 63, int(rng.integers(0, 4))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both < 75 * (len(a) + len(b) - both) or len(a) == len(b) == both:
            continue
        assert sum(int(x).bit_count() for x in (jaccard.bitmap(a) ^ jaccard.bitmap(b)).view(np.uint64)) <= len(a) + len(b) - 2 * both
        keys = [(jaccard.signatures(x, 0, classes), np.full(jaccard.prefix(len(x)), -1)) for x in (a, b)]
        for depth in range(1, min(4, -(-75 * min(len(a), len(b)) // 100))):
            keys = [jaccard.longer_keys(x, classes, depth, *k)[:2] for x, k in zip((a, b), keys, strict=True)]
            assert len(np.intersect1d(keys[0][0], keys[1][0]))
            tried += 1
    assert tried > 300


def test_hot_lists_grow_in_proportion(spark, monkeypatch):
    """Near copies that their first leader doesn't link, and sets without links in lists of common shingles."""
    rng = random.Random(6)
    made = []
    real = jaccard.verify
    monkeypatch.setattr(jaccard, "verify", lambda pairs, *a: made.append(pairs.count()) or real(pairs, *a))
    base = [f"b{i}" for i in range(80)]
    common = [[f"c{k}_{i}" for i in range(14)] for k in range(12)]
    rows = []
    for i in range(1500):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 2, 3])):
            w[rng.randrange(80)] = f"x{rng.randrange(1 << 30)}"
        rows.append((i, " ".join(w)))
    for i in range(1500, 3000):  # all shingles but few are common ones
        rows.append((i, " ".join(sum(rng.sample(common, 4), [])) + f" y{i}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in jaccard.classes(docs, Scratch(spark, "t")).collect()}
    assert got == {d: c for d, _, c in brute(rows)}
    assert sum(made) < 12 * len(rows)


@pytest.mark.parametrize("light", [0, 3, 6, 8])
def test_every_boundary_meets_every_link(light):
    rng = np.random.default_rng(light)
    classes = np.zeros(jaccard.SKETCH, np.uint8)
    for _ in range(400):
        n = int(rng.integers(1, 14))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 63, int(rng.integers(0, 3))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= 75 * (len(a) + len(b) - both):
            assert len(np.intersect1d(jaccard.signatures(a, light, classes), jaccard.signatures(b, light, classes)))


def test_boundary_follows_cost():
    assert jaccard.boundary({}, 0, 1.0) == 0
    assert jaccard.boundary({4: 10}, 0, 1.0) < 4 <= jaccard.boundary({4: 10}, 0, 500.0)


def test_long_text_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d e " * 40_000), (2, "a b c d e " * 40_001), (3, "q" * 300_000), (3, "q" * 300_000)], "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard.classes(docs, Scratch(spark, "t")).collect()) == [(1, 5, 1), (2, 5, 1), (3, 1, 3), (3, 1, 3)]
    assert jaccard.classes(docs.limit(0), Scratch(spark, "t")).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    group = {}
    for a, b in edges:
        group.setdefault(a, {a})
        group.setdefault(b, {b})
        if group[a] is not group[b]:
            group[a] |= group[b]
            for x in group[b]:
                group[x] = group[a]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: min(group[x]) for x in linked}


def test_one_row_of_each_class(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight", "red orange yellow green blue indigo violet black")
    rows = [(1, a), (1, a), (2, a), (2, b), (5, b), (None, b), (None, c), (None, c), (None, ""), (7, None)]
    docs = spark.createDataFrame([(d, t, 1, 1, "c") for d, t in rows], SCHEMA).repartition(3)
    kept = jaccard.representatives(docs, Scratch(spark, "t"))
    assert kept.dtypes == docs.dtypes
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, a), (2, b), (None, c), (None, ""), (7, None)], key=str)


def test_bitmaps_never_exceed_the_difference():
    rng = np.random.default_rng(5)
    for n, m, both in [(3, 4, 2), (500, 600, 450), (511, 520, 1), (700, 3000, 600), (5000, 5100, 4900), (9000, 9100, 0)]:
        every = rng.integers(0, 1 << 63, n + m - both, np.uint64)
        x, y = jaccard.bitmap(every[:n]), jaccard.bitmap(every[n - both :])
        words = min(len(x), len(y))
        apart = int(np.bitwise_count((jaccard.folded(x, words) ^ jaccard.folded(y, words)).view("<u8")).sum())
        assert apart <= n + m - 2 * both
        if not both or n == 511:  # and leave no room for a link of sets that have little in common
            assert apart > n + m - 2 * jaccard.needed(n, m)


def test_only_texts_of_likely_pairs_are_moved(spark, monkeypatch):
    rng, written = random.Random(9), {}
    common = "one two three four five six seven eight nine ten"
    texts = [" ".join(f"w{rng.randrange(10_000)}" for _ in range(60)) + " " + common for _ in range(300)]
    rows = list(enumerate(texts + [t + " more" for t in texts[:10]]))
    table = Scratch.table

    def noted(self, df, name):
        out = table(self, df, name)
        written[name] = out.count() if "text" in out.columns else 0
        return out

    monkeypatch.setattr(Scratch, "table", noted)
    got = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "few"))
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert max(written.values()) <= 40


def test_many_edges_and_many_texts(spark, monkeypatch):
    from graphloom.llm import components as module

    monkeypatch.setattr(module, "ONE_TASK", 0)
    monkeypatch.setattr(jaccard, "FETCHED", 0)
    rows = corpus(4)
    got = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "many"))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_changed_copies_meet_the_least_changed_ones(spark, monkeypatch):
    """Copies that only the ones with few changes link leave few pairs to the last join."""
    rng, left = random.Random(12), {}
    real = jaccard.verify

    def noted(pairs, sets, documents, scratch, name, words):
        left[name] = pairs.count()
        return real(pairs, sets, documents, scratch, name, words)

    monkeypatch.setattr(jaccard, "verify", noted)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(300):
        w = list(base)
        for place in rng.sample(range(0, 150, 6), 0 if i == 200 else rng.choice([2, 3, 3, 4, 4, 5])):
            w[place] = f"x{rng.randrange(1 << 30)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in jaccard.classes(docs, Scratch(spark, "t")).collect()}
    assert got == {d: c for d, _, c in brute(rows)}
    assert left["last"] < len(rows)
