import hashlib
import random

import numpy as np
import pytest

from graphloom.llm import repeats
from graphloom.llm.common import Scratch


def brute(rows, length=100):
    seen, out = {}, []
    places = sorted((d, i, r) for r, (d, t) in enumerate(rows) for i in range(max(0, len((t or "").encode()) - length + 1)))
    cover = [np.zeros(len((t or "").encode()), bool) for _, t in rows]
    raws = [(t or "").encode() for _, t in rows]
    for d, i, r in places:
        w = raws[r][i : i + length]
        if seen.setdefault(w, (d, i)) != (d, i):
            cover[r][i : i + length] = True
    for (d, _), raw, c in zip(rows, raws, cover, strict=True):
        runs = int((np.diff(np.concatenate([[0], c.astype(int)])) == 1).sum())
        out.append((d, len(raw), int(c.sum()), runs, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~c])).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    words = [rng.choice(["the", "of", "éa", "tion", "x", "ing ", "qu", "ß"]) * rng.randint(1, 3) for _ in range(60)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    shared = [prose(rng.randint(15, 60)) for _ in range(6)]
    texts = [None, "", "short", "ab" * 300, "a" * 500, "Chgeä " * 90, "Chgeä " * 40, "z" * 100, "z" * 100, "z" * 99]
    for _ in range(50):
        parts = [prose(rng.randint(1, 60)) for _ in range(rng.randint(1, 3))]
        for _ in range(rng.randint(0, 2)):
            s = rng.choice(shared)
            i = rng.randint(0, len(s) // 3)
            parts.insert(rng.randint(0, len(parts)), s[i : len(s) - rng.randint(0, len(s) // 3)])
        texts.append(rng.choice(["", " ", "\n"]).join(parts))
    texts += [rng.choice(texts) for _ in range(12)]
    t = list(rng.choice(texts[20:60]))
    t[len(t) // 2] = "#"
    texts.append("".join(t))
    return list(zip(rng.sample(range(-50, 5000), len(texts)), texts, strict=True))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(repeats, "SORTED", [7, 100_000, 60][seed - 1])
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, s int, h int").repartition(3)
    assert sorted(tuple(r) for r in repeats.digest(docs, Scratch(spark, "t")).collect()) == brute(rows)


@pytest.mark.parametrize("hot", [0, 3])
def test_hot_anchors_against_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = corpus(4 + hot)
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, s int, h int").repartition(3)
    assert sorted(tuple(r) for r in repeats.digest(docs, Scratch(spark, "t")).collect()) == brute(rows)


def test_columns_in_a_file_give_the_same(tmp_path):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 4, 400).astype(np.uint8).tobytes()
    texts, anchors, at = [], [], []
    for _ in range(300):
        s = int(rng.integers(100, 130))
        t = bytearray(base[s : 150 + int(rng.integers(60, 100))])
        if rng.random() < 0.7:
            t[int(rng.integers(0, len(t)))] = 9
        texts.append(bytes(t))
        anchors.append(150 - s)
        at.append(150)
    args = (texts, np.array(anchors), np.zeros(300, np.int64), np.arange(300), np.array(at))
    one, two = ([(p.tolist(), c.tolist()) for p, c in repeats.sort_columns(*args, memory=m, folder=f"file://{tmp_path}")] for m in (1000, 10))
    assert one == two and one and not list(tmp_path.iterdir())


def test_repeated_ids_null_ids_and_nothing(spark):
    t, u = "abcdefghij" * 13, "".join(chr(97 + i * i % 26) + str(i) for i in range(90))
    rows = [(5, t), (5, t), (None, u), (5, "!" + u), (9, t)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in repeats.digest(docs, Scratch(spark, "t")).collect()}
    # within a row of period 10 only the first 109 bytes are not covered from an earlier start
    assert got == {(5, 130): 120, (None, len(u)): 0, (5, len(u) + 1): len(u), (9, 130): 130}
    assert repeats.digest(docs.limit(0), Scratch(spark, "t")).count() == 0


def test_cleaned_keeps_columns(spark):
    t = "é" * 10 + "".join(chr(97 + i * i % 26) + str(i) for i in range(90))
    docs = spark.createDataFrame([(1, t, "x", 5), (2, "ü" + t, "y", 6), (3, None, "z", None)], "doc_id long, text string, a string, n_chars long")
    out = {r.doc_id: r for r in repeats.cleaned(docs, Scratch(spark, "t")).collect()}
    assert out[1].text == t and out[2].text == "ü" and out[2].n_chars == 1 and out[3].text is None and out[2].a == "y"
