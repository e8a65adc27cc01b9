import random
import zlib

import numpy as np
import pytest

from graphloom.llm import packing, rans, sharding
from graphloom.llm.common import Scratch
from graphloom.llm.queries import tokenizer_path
from graphloom.llm.tokens import Encoder, cut

ODD = [None, "", " ", "\n\n", "a", "<|endoftext|> b", "x " * 5000, "word" * 3000, "né  à\t\n \n b", "中文β 5²Ⅷ", "###", "it's  ok\r\n x"]
SCHEMA = "doc_id long, text string, n int, start long, piece string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, 2, "z") for i, t in enumerate(texts)], SCHEMA)


def plain_ids(texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return [t.encode(x or "", add_special_tokens=False).ids + [end] for x in texts]


def test_cut_pieces_encode_as_the_whole():
    encoder, rng = Encoder(tokenizer_path()), random.Random(5)
    texts = ["".join(rng.choice(" \n\t\r\x1c  aZé'sβ中5²Ⅷ.,!-_#́ªº") for _ in range(rng.randint(0, 12))) for _ in range(5000)]
    assert all("".join(cut(t)) == t for t in texts)
    for t, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, encoder.dtype).tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [1, 5, 511, 512, 513, 100_000, rans.BLOCK])
def test_block_round_trip_and_checkpoints(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 5000).astype(np.uint32)
    t = rans.Table.of_counts(np.bincount(ids, minlength=6000))
    raw = rans.encode_block(ids, t)
    assert (rans.decode_block(raw, t) == ids).all()
    for first in range(1, rans.segments(n)):
        assert (rans.decode_block(raw, t, first) == ids[first * rans.CHECKPOINT * rans.LANES :]).all()
    broken = bytearray(raw)
    broken[-1] ^= 1
    if n > 600:
        with pytest.raises(ValueError):
            rans.decode_block(bytes(broken), t)


def test_archive_round_trip(spark):
    texts = ODD + ["the same text"] * 40
    docs = frame(spark, texts)
    folder, files = rans.write_archive(docs.repartition(3), tokenizer_path(), 2, Scratch(spark, "t"))
    rows = sorted(rans.read_archive(files, folder).collect())
    ids, at = plain_ids(texts, 2), 0
    assert len(rows) == len(texts)
    for i, r in enumerate(rows):
        assert tuple(r) == (i, at, len(ids[i]), zlib.crc32(np.array(ids[i], "<u4").tobytes()))
        at += len(ids[i])


def test_archive_of_nothing_and_null_ids(spark):
    folder, files = rans.write_archive(frame(spark, []), tokenizer_path(), 2, Scratch(spark, "t"))
    assert rans.read_archive(files, folder).count() == 0
    docs = spark.createDataFrame([(None, "b"), (7, None), (7, "a"), (7, "a")], "doc_id long, text string")
    folder, files = rans.write_archive(docs, tokenizer_path(), 2, Scratch(spark, "t"))
    rows = rans.read_archive(files, folder).orderBy("start").collect()
    assert [(r.doc_id, r.n_tokens) for r in rows] == [(None, 2), (7, 1), (7, 2), (7, 2)]


def test_packing(spark):
    texts = ODD + ["same"] * 30 + ["a b c " * 700, "q" * 9000]
    rows = packing.pack(frame(spark, texts), tokenizer_path(), 0, Scratch(spark, "t"), limit=64).collect()
    ids = plain_ids(texts, 0)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for d, ps in by_doc.items():
        ps.sort(key=lambda r: r.piece)
        assert [p.piece for p in ps] == list(range(len(ps))) and sum(p.length for p in ps) == len(ids[d])
        assert all(p.length == 64 for p in ps[1:])
        for p in ps:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[d][p.start : p.start + p.length], "<u4").tobytes())
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= 64
    assert len(by_seq) <= -(-sum(map(len, ids)) // 64) + 2
    assert packing.pack(frame(spark, []), tokenizer_path(), 0, Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("rule", ["dot", "norm"])
def test_best_fit_holds_every_constraint(rule):
    rng = np.random.default_rng(1)
    n = rng.integers(1, 60, 500)
    bins, offsets = packing.best_fit(n, 100, 4, 5000, rule)
    for b in set(bins.tolist()):
        own = n[bins == b]
        assert own.sum() <= 100 and len(own) <= 4 and (own**2).sum() <= 5000
        assert sorted(offsets[bins == b].tolist()) == np.concatenate([[0], np.cumsum(n[bins == b][np.argsort(offsets[bins == b])])[:-1]]).tolist()


def plain_best_fit(lengths, capacity, rule, w):
    """Every open bin scored, one after the other."""
    bins, out = [], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = (lengths[i], 1, lengths[i] ** 2)
        best = None
        for b, left in enumerate(bins):
            if all(x >= y for x, y in zip(left, need)):
                part = [(x / c, y / c) for x, y, c in zip(left, need, capacity)]
                score = sum(k * y * x if rule == "dot" else k * (x - y) ** 2 for k, (x, y) in zip(w, part))
                if best is None or score < best[0] - 1e-12:
                    best = (score, b)
        if best is None:
            best = (0, len(bins))
            bins.append(capacity)
        bins[best[1]] = tuple(x - y for x, y in zip(bins[best[1]], need))
        out[i] = best[1]
    return out


def test_rule_and_weights_choose_the_bin():
    rng = np.random.default_rng(2)
    n, seen = rng.integers(1, 70, 300), []
    for rule in ("dot", "norm"):
        for w in ((1.0, 0.05, 0.25), (0.01, 1.0, 0.01), (0.2, 0.1, 1.0)):
            bins, _ = packing.best_fit(n, 100, 5, 5200, rule, w)
            assert bins.tolist() == plain_best_fit(n.tolist(), (100, 5, 5200), rule, w)
            seen.append(tuple(bins.tolist()))
    assert len(set(seen)) == 6


def test_documents_of_a_sequence_are_bounded(spark):
    rows = packing.pack(frame(spark, ["a"] * 400), tokenizer_path(), 0, Scratch(spark, "t")).collect()
    sizes = {}
    for r in rows:
        sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + 1
    assert max(sizes.values()) == packing.DOCS and len(sizes) == -(-400 // packing.DOCS)


def plain_permutation(x, n, key, rounds):
    """The Feistel network and cycle walking over plain integers."""
    mask = (1 << 64) - 1

    def mix(v):
        v ^= v >> 30
        v = v * 0xBF58476D1CE4E5B9 & mask
        v ^= v >> 27
        v = v * 0x94D049BB133111EB & mask
        return v ^ v >> 31

    bits = max(2, (n - 1).bit_length())
    left, right = bits // 2, bits - bits // 2
    while True:
        a, b = x >> right, x & (1 << right) - 1
        for i in range(rounds):
            k = mix(i + mix(key) & mask)
            if i % 2 == 0:
                a ^= mix(b ^ k) & (1 << left) - 1
            else:
                b ^= mix(a ^ k) & (1 << right) - 1
        x = a << right | b
        if x < n:
            return x


def test_shard_and_slot_recomputed(spark):
    docs = spark.createDataFrame([(3 * i + 1, "x" * (i % 7)) for i in range(203)], "doc_id long, text string").repartition(4)
    for r in sharding.shard(docs, 8, Scratch(spark, "t")).collect():
        place = plain_permutation((r.doc_id - 1) // 3, 203, sharding.KEY, sharding.ROUNDS)
        assert (r.shard, r.slot) == (place % 8, place // 8)


def test_joined_checksums():
    rng = np.random.default_rng(4)
    for n in (0, 1, 4, 1000, 70_001):
        a, b = rng.bytes(333), rng.bytes(n)
        assert rans.joined_crc(zlib.crc32(a), zlib.crc32(b), n) == zlib.crc32(a + b)


def test_documents_over_many_segments(spark):
    texts = ["long words " * 160_000, "short", None, "other things " * 145_000, "end"]
    folder, files = rans.write_archive(frame(spark, texts), tokenizer_path(), 2, Scratch(spark, "t"))
    rows = sorted(rans.read_archive(files, folder).collect())
    ids = plain_ids(texts, 2)
    assert sum(map(len, ids)) > 2 * rans.LANES * rans.CHECKPOINT
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in rows] == [(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(ids)]
    assert [r.start for r in rows] == np.concatenate([[0], np.cumsum([len(x) for x in ids])[:-1]]).tolist()


def test_permutation_is_one():
    for n in (1, 2, 3, 5, 8, 100, 1000, 4097):
        p = sharding.Permutation(n)
        out = p.forward(np.arange(n))
        assert sorted(out.tolist()) == list(range(n)) and (p.backward(out) == np.arange(n)).all()


def test_sharding(spark):
    texts = ODD + ["dup"] * 25
    rows = sharding.shard(frame(spark, texts), 8, Scratch(spark, "t")).orderBy("row").collect()
    assert [r.row for r in rows] == [r.doc_id for r in rows] == list(range(len(texts)))
    slots = {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.shard(frame(spark, texts).repartition(3), 8, Scratch(spark, "t")).orderBy("row").collect()
    assert again == rows
    assert sharding.shard(frame(spark, []), 8, Scratch(spark, "t")).count() == 0


def test_a_full_cache_changes_nothing(monkeypatch):
    from graphloom.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_PIECES", 3)
    encoder = Encoder(tokenizer_path())
    text = "one Two thrée, 4 five one Two  six\n seven"
    assert np.frombuffer(encoder.encode([text])[0], encoder.dtype).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(encoder.pieces) == 3


@pytest.mark.parametrize(("table", "column"), [("documents", "text"), ("pages", "html"), ("conversations", "text"), ("benchmark", "text")])
def test_whole_texts_against_the_library(table, column):
    """Every text of a whole table: the ids of cut pieces are those of the library."""
    import os

    import pyarrow.parquet as pq

    path = f"/root/testdata/sf0.01/{table}.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables here")
    texts = [t for t in pq.read_table(path, columns=[column]).column(0).to_pylist() if t]
    mixed = ["".join(t[i::7] + x for i, x in enumerate(("Ⅷ", "²", "中", "é\u0301", "\u200b", "ﬁ", "\t\u00a0"))) for t in texts[:200]]
    encoder = Encoder(tokenizer_path())
    texts += mixed
    for t, raw in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(raw, encoder.dtype).tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def whole(encoder, texts):
    return [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, encoder.dtype).tobytes() for t in texts]


def test_known_pieces_are_found_without_cutting_texts(monkeypatch):
    from graphloom.llm import tokens

    encoder, texts = Encoder(tokenizer_path()), ["", "One two, thrée\n\n 4 five  ", "six " * 50, "", "  Two", "don’t — “né” слово, 中 𐐀𐐁 😀 Ⅷ"]
    expected = whole(encoder, texts)
    assert encoder.encode(texts) == expected

    def never(*_):
        raise AssertionError("a piece was taken by itself")

    monkeypatch.setattr(tokens, "cut", never)
    monkeypatch.setattr(tokens._Pieces, "__missing__", never)
    monkeypatch.setattr(encoder.pieces, "merge", never)
    monkeypatch.setattr(encoder.pieces, "whole", never)
    assert encoder.encode(texts[::-1]) == expected[::-1]


@pytest.mark.parametrize("most", [0, 7, 600_000])
def test_short_pieces_keep_apart(monkeypatch, most):
    """Neighbouring texts, zero characters, lengths about the key's, tables that grow, blocks that end anywhere, full caches."""
    from graphloom.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_PIECES", most)
    monkeypatch.setattr(tokens, "BLOCK", 37)
    encoder, rng = Encoder(tokenizer_path()), random.Random(8)
    texts = ["a ", "b", " ", " b", "x  ", "y", "", "1 ", "é", "a\0", "a", "\0", "\0\0", "a\0\0b", "中 a", "a 中", "\0 ", "\ud7ff", "ª" * 16, "𐐀" * 5, "中" * 7 + " 中"]
    texts += [" " * k + c * n + "." for c in "aé-" for n in range(10, 26) for k in (0, 1, 2)]
    texts += [" ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 18))) for _ in range(40)) for _ in range(100)]
    for _ in range(2):
        assert encoder.encode(texts) == whole(encoder, texts)
    assert len(encoder.pieces) <= most and (most < 600_000 or encoder.pieces.short.bits > 12)
    assert encoder.encode([]) == [] and encoder.encode([""]) == [b""]


def test_pieces_of_any_script():
    """Letters, marks, numerals, spaces and signs of one to four bytes, next to each other in any order."""
    encoder, rng = Encoder(tokenizer_path()), random.Random(9)
    chars = [*"  \n\ta'sZé²¼ªß\xa0\xad", *"слжΩاب한中々ªʰ𐐀𝒳", *"\u0301\u064e\u20dd", *"Ⅷ٣²㊀𝟙", *"\u2003\u3000\u200b\u2028", *"’—“😀€\uffff"]
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 14))) for _ in range(6000)]
    assert all("".join(cut(t)) == t for t in texts)
    assert encoder.encode(texts) == whole(encoder, texts)
