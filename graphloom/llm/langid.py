"""Language identification of mixed text.

A word's script (by code point ranges) narrows the languages that it can be of; its character n-grams give a
log posterior over those; Viterbi over the words of a whole text, with a penalty for each switch, labels spans.

The model is fitted on a bounded sample of labelled rows: about SAMPLE_DOCS for each language, chosen by a
hash of the id.  Prediction sees the text alone.

Defined results: a null text, and one without a letter, is `und` with score 0 and no spans; so is every text
where nothing was learned; rows that repeat an id are predicted one by one; equal counts of words go to the
language that comes first by name; a null id is not held out; an empty table gives no rows; other columns are not read.

`identified` keeps the rows whose text is of a learned language, and writes that language to their lang: a text goes
if it is `und`, if no language has LEAST_SHARE of its words, or if LEAST_KNOWN of its letters or more are of scripts
that no learned language is written in.
"""

from __future__ import annotations

import pickle
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, bound_batches, byte_column, chunks, mix, trim

UND = "und"
#: Documents that a language's counts are taken from, about; hashed n-grams; longest n-gram; penalty of a switch.
SAMPLE_DOCS, BUCKETS, LONGEST, PENALTY = 1500, 1 << 16, 4, 6.0
#: Words a worker remembers; the least share of a language's letters that makes a script one of its own; floor of a word's score.
CACHE_WORDS, SCRIPT_SHARE, FLOOR = 300_000, 0.02, -8.0
#: Shares below which a text is of no language: of words in spans of its main one, of letters in learned scripts.
LEAST_SHARE, LEAST_KNOWN = 0.25, 0.5

#: First and last code points of scripts.
SCRIPTS = [
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF),
    ("arabic", 0x750, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("gurmukhi", 0xA00, 0xA7F),
    ("gujarati", 0xA80, 0xAFF), ("tamil", 0xB80, 0xBFF), ("telugu", 0xC00, 0xC7F), ("kannada", 0xC80, 0xCFF),
    ("malayalam", 0xD00, 0xD7F), ("sinhala", 0xD80, 0xDFF), ("thai", 0xE00, 0xE7F), ("lao", 0xE80, 0xEFF),
    ("tibetan", 0xF00, 0xFFF), ("myanmar", 0x1000, 0x109F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("ethiopic", 0x1200, 0x137F), ("khmer", 0x1780, 0x17FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF),
    ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x2FA1F),
]
NAMES = sorted({s for s, _, _ in SCRIPTS}) + ["other"]
_FIRST = np.array(sorted(a for _, a, _ in SCRIPTS), np.int64)
_BY_FIRST = sorted((a, b, NAMES.index(s)) for s, a, b in SCRIPTS)
_LAST = np.array([b for _, b, _ in _BY_FIRST], np.int64)
_SCRIPT = np.array([s for _, _, s in _BY_FIRST], np.int64)

_LATIN1 = re.compile("[a-zªµºà-öø-ÿ]+")
_WIDE = re.compile(r"[^\W\d_]+")
_BEYOND = re.compile("[^\x00-\xff]")


def script_of(points: np.ndarray) -> np.ndarray:
    """The script number of each code point."""
    at = np.searchsorted(_FIRST, points, "right") - 1
    inside = (at >= 0) & (points <= _LAST[at])
    return np.where(inside, _SCRIPT[at], len(NAMES) - 1)


def words(lowered: str):
    """Runs of letters of a lower-cased text."""
    return (_WIDE if _BEYOND.search(lowered) else _LATIN1).findall(lowered)


def ngrams(own: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words: buckets of all n-grams, where each word's begin in them, and each word's script."""
    text = "\x02" + "\x02".join(own) + "\x02"
    points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    bounds = np.flatnonzero(points == 2)
    lengths = np.diff(bounds) - 1
    word_at = np.zeros(len(points), np.int64)
    word_at[bounds[1:-1]] = 1
    word_at = np.cumsum(word_at)  # a mark belongs to the word that it opens; the last one to the last word
    h = mix(points)
    grams, owner = [], []
    rolling = np.zeros(0, np.uint64)
    for n in range(1, LONGEST + 1):
        rolling = h if n == 1 else mix(rolling[:-1] * np.uint64(31) + h[n - 1 :] + np.uint64(n))
        first = np.arange(len(rolling))
        last = first + n - 1
        # from a word's opening mark to its closing mark, but never over a mark in between
        open_word = word_at[first]
        inside = (last <= bounds[np.minimum(open_word + 1, len(bounds) - 1)]) & (first < bounds[-1])
        if n == 1:
            inside &= points != 2
        grams.append(rolling[inside] & np.uint64(BUCKETS - 1))
        owner.append(open_word[inside])
    owner, grams = np.concatenate(owner), np.concatenate(grams).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    letters = points[bounds[:-1] + 1].astype(np.int64)
    starts = np.searchsorted(owner[order], np.arange(len(own)))
    assert len(lengths) == len(own)
    return grams[order], starts, script_of(letters)


class Model:
    """Log probabilities of buckets for each language, and the languages that each script admits."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        if not langs:
            return
        p = counts + 0.5
        self.logp = np.ascontiguousarray(np.log(p / p.sum(1, keepdims=True)).T.astype(np.float32))
        share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
        admits = (share >= SCRIPT_SHARE).T
        self.learned = admits.any(1)
        admits[~admits.any(1)] = True  # no language is known by this script: all stay candidates
        self.barred = np.where(admits, 0.0, -1e9).astype(np.float32)

    def score(self, own: list[str]) -> np.ndarray:
        """Log posteriors of words, at FLOOR at least."""
        grams, starts, script = ngrams(own)
        total = np.add.reduceat(self.logp[grams], starts, axis=0) + self.barred[script]
        total -= total.max(1, keepdims=True)
        total -= np.log(np.exp(total).sum(1, keepdims=True))
        return np.maximum(total, FLOOR)


    def known(self, text: str) -> float:
        """The share of a text's letters that are of a script which some language is written in."""
        if self.learned[NAMES.index("latin")] and not _BEYOND.search(text):
            return 1.0
        points = np.frombuffer("".join(_WIDE.findall(text)).encode("utf-32-le"), "<u4").astype(np.int64)
        return float(self.learned[script_of(points)].mean()) if len(points) else 0.0


class Labeller:
    """Labels texts; remembers the scores of words it has met."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.scores = np.zeros((1024, len(model.langs)), np.float32)

    def _ids(self, docs: list[list[str]]) -> tuple[list[np.ndarray], np.ndarray]:
        """For each text the rows of its words in a table of scores (-1: not a word of letters), and the table.
        Words that the cache has no room for get rows behind it, for this call alone."""
        known, at = self.known, len(self.known)
        new = sorted({w for ws in docs for w in ws if w not in known})
        new = [w for w in new if w.isascii() or any(c.isalpha() for c in w)]
        own = self.model.score(new) if new else np.zeros((0, self.scores.shape[1]), np.float32)
        table = dict(zip(new, range(at, at + len(new)), strict=True))
        if at + len(new) > CACHE_WORDS:
            ids = [np.array([known[w] if w in known else table.get(w, -1) for w in ws], np.int64) for ws in docs]
            return ids, np.concatenate([self.scores[:at], own])
        if at + len(new) > len(self.scores):
            room = max(at + len(new), 2 * len(self.scores)) - len(self.scores)
            self.scores = np.concatenate([self.scores, np.zeros((room, self.scores.shape[1]), np.float32)])
        self.scores[at : at + len(new)] = own
        known.update(table)
        return [np.array([known.get(w, -1) for w in ws], np.int64) for ws in docs], self.scores

    def label(self, texts: list[str | None]) -> list[np.ndarray]:
        """The language number of each word of each text (-1: not a word of letters)."""
        docs = [words(t.lower()) if t else [] for t in texts]
        ids, scores = self._ids(docs)
        kept = [i[i >= 0] if len(i) and i.min() < 0 else i for i in ids]
        paths = viterbi(kept, scores)
        out = []
        for i, k, path in zip(ids, kept, paths, strict=True):
            if len(k) != len(i):
                full = np.full(len(i), -1, np.int64)
                full[i >= 0] = path
                path = full
            out.append(path)
        return out


def viterbi(docs: list[np.ndarray], scores: np.ndarray, penalty: float = PENALTY) -> list[np.ndarray]:
    """The best path of languages through each document's words: the sum of scores less the penalty of each
    switch.  Steps run over all documents at once, longest first, so that those still active stand in front."""
    k = scores.shape[1]
    lengths = np.array([len(d) for d in docs], np.int64)
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    flat = np.concatenate([docs[i] for i in order]) if len(docs) else np.zeros(0, np.int64)
    starts = np.cumsum(sizes) - sizes
    steps = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(1, steps + 1), "right")
    # at each word: the best language before it, and for each language whether it came from there by a switch
    best = np.zeros(len(flat), np.int16)
    switched = np.zeros((len(flat), k), bool)
    value = np.zeros((len(docs), k), np.float32)
    emission = scores[flat] if len(flat) else np.zeros((0, k), np.float32)
    rows = np.arange(len(docs))
    for t in range(steps):
        a = active[t]
        at = starts[:a] + t
        v = value[:a]
        if t:
            top = v.argmax(1)
            limit = v[rows[:a], top][:, None] - np.float32(penalty)
            best[at] = top
            switched[at] = limit > v
            v = np.maximum(v, limit)
            v -= limit  # only differences count; this keeps single precision exact enough
        value[:a] = v + emission[at]
    path = np.zeros(len(flat), np.int64)
    state = value.argmax(1)
    for t in range(steps - 1, -1, -1):
        a = active[t]
        at = starts[:a] + t
        s = state[:a]
        path[at] = s
        if t:
            state[:a] = np.where(switched[at, s], best[at], s)
    out: list = [None] * len(docs)
    for j, i in enumerate(order.tolist()):
        out[i] = path[starts[j] : starts[j] + sizes[j]]
    return out


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE_DOCS) -> Model:
    """Counts over about `sample` documents of each language, whole texts, chosen by a hash of the key."""
    rows = labelled.select(F.col(key).cast("string").alias("k"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    langs = sorted((r["lang"], r["n"]) for r in sizes.collect())  # a row for each language
    if not langs:
        return Model([], np.zeros((0, BUCKETS)), np.zeros((0, len(NAMES))))
    number = {name: i for i, (name, _) in enumerate(langs)}
    share = F.element_at(F.create_map(*[x for name, n in langs for x in (F.lit(name), F.lit(min(1.0, sample / n)))]), F.col("lang"))
    chosen = rows.where(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")

    def count(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            starts = byte_column(batch.column(1))[1]
            for a, b in chunks(np.diff(starts), BATCH_BYTES):
                part = batch.slice(a, b - a)
                by_lang: dict[int, list[str]] = {}
                for name, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    by_lang.setdefault(number[name], []).extend(words(t.lower()))
                for k, own in by_lang.items():
                    if own:
                        total = found.setdefault(k, np.zeros(BUCKETS + len(NAMES)))
                        grams, _, script = ngrams(own)
                        total[:BUCKETS] += np.bincount(grams, minlength=BUCKETS)
                        total[BUCKETS:] += np.bincount(script, minlength=len(NAMES))
        for k, total in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["k", "total"])

    counts = np.zeros((len(langs), BUCKETS + len(NAMES)))
    for r in chosen.mapInArrow(count, "k int, total binary").toLocalIterator():  # one array at a time
        counts[r["k"]] += np.frombuffer(r["total"])
    return Model([name for name, _ in langs], counts[:, :BUCKETS], counts[:, BUCKETS:])


def judged(texts: list[str | None], labeller: Labeller | None) -> list[tuple[str, float, list]]:
    """(language, score, spans) of each text."""
    if labeller is None:
        return [(UND, 0.0, [])] * len(texts)
    out, langs = [], labeller.model.langs
    for t, path in zip(texts, labeller.label(texts), strict=True):
        own = path[path >= 0]
        if not len(own):
            out.append((UND, 0.0, []))
            continue
        counts = np.bincount(own, minlength=len(langs))
        top = int(counts.argmax())
        spans = [(langs[top], 0, len(t))] if counts[top] == len(own) else spans_of(t, path, langs)
        out.append((langs[top], float(counts[top] / len(own)), spans))
    return out


def _labellers(spark, model: Model):
    """A function that gives executors their labeller (None where nothing was learned)."""
    held = spark.sparkContext.broadcast(zlib.compress(pickle.dumps(model), 1))

    def get() -> Labeller | None:
        own = pickle.loads(zlib.decompress(held.value))
        return Labeller(own) if own.langs else None

    return get


def predict(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, lang_pred, score (the share of words in spans of that language) and spans (lang, start, end: characters)."""
    bound_batches(docs.sparkSession)
    get, kind = _labellers(docs.sparkSession, model), docs.schema[key].dataType
    span = pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches):
        labeller = get()
        for batch in batches:
            starts = byte_column(batch.column(1))[1]
            for a, b in chunks(np.diff(starts), BATCH_BYTES):
                part = batch.slice(a, b - a)
                found = judged(part.column(1).to_pylist(), labeller)
                rows = [[{"lang": x, "start": i, "end": j} for x, i, j in s] for _, _, s in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.float64()), pa.array(rows, pa.list_(span))], [key, "lang_pred", "score", "spans"])
            trim()

    schema = f"{key} {kind.simpleString()}, lang_pred string, score double, spans array<struct<lang:string,start:int,end:int>>"
    return docs.select(key, F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def identified(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows whose text is of a learned language, in their own columns; lang, where it is one of them, holds that language.
    No row is shuffled.  Where nothing was learned, every text with a letter stays as it is."""
    bound_batches(docs.sparkSession)
    get, at = _labellers(docs.sparkSession, model), docs.columns.index(text)
    to = docs.columns.index(lang) if lang in docs.columns and docs.schema[lang].dataType.simpleString() == "string" else None

    def run(batches):
        labeller = get()
        for batch in batches:
            starts = byte_column(batch.column(at))[1]
            for a, b in chunks(np.diff(starts), BATCH_BYTES):
                part = batch.slice(a, b - a)
                texts = part.column(at).to_pylist()
                if labeller is None:
                    yield part.filter(pa.array([any(c.isalpha() for c in t or "") for t in texts], pa.bool_()))
                    continue
                found = judged(texts, labeller)
                keep = [name != UND and score >= LEAST_SHARE and labeller.model.known(t) >= LEAST_KNOWN for t, (name, score, _) in zip(texts, found, strict=True)]
                columns = list(part.columns)
                if to is not None:
                    columns[to] = pa.array([f[0] for f in found], columns[to].type)
                yield pa.RecordBatch.from_arrays(columns, part.schema.names).filter(pa.array(keep, pa.bool_()))
            trim()

    return docs.mapInArrow(run, docs.schema)


def spans_of(text: str, path: np.ndarray, langs: list[str]) -> list[tuple[str, int, int]]:
    """Spans of a mixed text by characters: from the first word of a run of one language to the next run."""
    lowered = text.lower()
    pattern = _WIDE if _BEYOND.search(lowered) else _LATIN1
    places = np.array([m.start() for m in pattern.finditer(lowered)], np.int64)
    if len(lowered) != len(text):  # some letters have longer lower cases
        ends = np.cumsum([len(c.lower()) for c in text])
        places = np.searchsorted(ends, places, "right")
    out: list[tuple[str, int, int]] = []
    for place, k in zip(places.tolist(), path.tolist(), strict=True):
        if k >= 0 and (not out or langs[k] != out[-1][0]):
            if out:
                out[-1] = (out[-1][0], out[-1][1], place)
            out.append((langs[k], place if out else 0, len(text)))
    return out


def held_out(key: str = "doc_id") -> Column:
    """Rows that a model must not learn from: crc32 of the id as text, mod 3, is 1 (a null id: they aren't)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))
