"""Token ids of whole texts, by the tokenizers library, with a bounded cache of word pieces.

A byte-level vocabulary splits text by a fixed pattern before it merges bytes.  The pattern's matches never
reach over two kinds of places: the end of a run of letters, and the front of a single space that stands
directly before a letter.  A text cut there has the ids of its pieces, one after the other, so that the
library has to encode each distinct piece once for a worker; tests hold this against the whole text.

Texts are cut and their short pieces found with arrays, many texts at once: a piece's bytes and length are its key, so
that what is found is the piece itself.
"""

from __future__ import annotations

from array import array
from functools import cache
from itertools import chain

import numpy as np

#: Distinct pieces that a worker remembers, and the longest of them in characters.
CACHE_PIECES, CACHE_CHARS = 600_000, 40
#: 64-bit words of a short piece's key, whose last byte is the length; bytes of such a piece at the most; pieces looked up at once.
WORDS, BLOCK = 3, 1 << 15
SHORT = 8 * WORDS - 1

_WORKERS: dict = {}
_ASCII = np.array([b < 128 and chr(b).isalpha() for b in range(256)])


@cache
def _alphabet() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _letters(data: np.ndarray) -> np.ndarray:
    """Whether a byte of UTF-8 belongs to a letter."""
    out, lead = _ASCII[data], np.flatnonzero(data >= 0xC0)
    if len(lead):
        head, rest = data[lead].astype(np.int64), lambda at, i: data[at + i].astype(np.int64) & 63
        code = (head & 31) << 6 | rest(lead, 1)
        three, four = np.flatnonzero(head >= 0xE0), np.flatnonzero(head >= 0xF0)
        third, fourth = lead[three], lead[four]
        code[three] = (head[three] & 15) << 12 | rest(third, 1) << 6 | rest(third, 2)
        code[four] = (head[four] & 7) << 18 | rest(fourth, 1) << 12 | rest(fourth, 2) << 6 | rest(fourth, 3)
        own = _alphabet()[code]
        out[lead] = out[lead + 1] = own
        out[third + 2] = own[three]
        out[fourth + 3] = own[four]
    return out


def edges(raw: bytes, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces of texts in UTF-8 begin, and the end of the last one.  A piece begins behind a run of letters, at a space
    that stands directly before a letter, and with a text."""
    data = np.frombuffer(raw, np.uint8)
    letter, first = _letters(data), np.zeros(len(raw) + 1, bool)
    first[1 : len(raw)] = letter[:-1] & ~letter[1:]
    space = (data[:-1] == 32) & letter[1:]
    space[ends[(ends > 0) & (ends < len(raw))] - 1] = False
    first[: len(space)] |= space
    first[begins] = True
    first[-1] = True
    return np.flatnonzero(first)


def cut(text: str) -> list[str]:
    """Pieces whose ids, joined, are the text's ids."""
    raw = text.encode()
    at = edges(raw, np.array([0]), np.array([len(raw)])).tolist()
    return [raw[a:b].decode() for a, b in zip(at[:-1], at[1:], strict=True)]


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: visible ones as themselves, others from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(others)}


#: For each length of a piece, what of its words is its own, and the length itself; nothing of longer pieces.
_OWN = [np.array([(1 << 8 * min(max(n - 8 * w, 0), 8)) - 1 for n in range(SHORT + 1)] + [0], np.uint64) for w in range(WORDS)]
_LENGTH = np.array([n << 56 for n in range(SHORT + 1)] + [0], np.uint64)


class _Short:
    """Ids of short pieces, by open addressing over arrays.  A span is a place in the pool of ids, times 64, and how many."""

    def __init__(self, dtype: np.dtype, bits: int = 12):
        self.n, self.pool, self.end = 0, np.zeros(1 << bits, dtype), 0
        self._clear(bits)

    def _clear(self, bits: int) -> None:
        self.bits = bits
        self.keys, self.span = [np.zeros(1 << bits, np.uint64) for _ in range(WORDS)], np.zeros(1 << bits, np.int64)

    def _first(self, keys: list[np.ndarray]) -> np.ndarray:
        h = np.zeros(len(keys[0]), np.uint64)
        for k in keys:
            h = (h ^ k) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        return (h * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _others(self, slot: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
        """Whether slots hold something else than the keys."""
        last = self.keys[-1][slot]
        out = last != keys[-1]
        for own, k in zip(self.keys[:-1], keys[:-1], strict=True):
            out |= own[slot] != k
        return out & (last != 0)

    def spans(self, keys: list[np.ndarray]) -> np.ndarray:
        """Zero for keys that are not there."""
        slot = self._first(keys)
        left = np.flatnonzero(self._others(slot, keys))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            left = left[self._others(slot[left], [k[left] for k in keys])]
        return self.span[slot]

    def add(self, keys: list[np.ndarray], ids: list[list[int]]) -> None:
        """Remember distinct keys that are not there."""
        sizes = np.array([len(x) for x in ids], np.int64)
        places = self.end + np.cumsum(sizes) - sizes
        fresh = np.array(list(chain.from_iterable(ids)), self.pool.dtype)
        if self.end + len(fresh) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.end], np.zeros(self.end + 2 * len(fresh), self.pool.dtype)])
        self.pool[self.end : self.end + len(fresh)] = fresh
        self.end += len(fresh)
        self.n += len(ids)
        bits = self.bits
        while 3 * self.n > 1 << bits:  # probes stay short
            bits += 1
        if bits > self.bits:
            used = np.flatnonzero(self.span)
            old = [k[used] for k in self.keys], self.span[used]
            self._clear(bits)
            self._put(*old)
        self._put(keys, places * 64 + sizes)

    def _put(self, keys: list[np.ndarray], span: np.ndarray) -> None:
        slot, left = self._first(keys), np.arange(len(span))
        while len(left):
            free = left[self.span[slot[left]] == 0]
            # of keys that meet in a slot one stays; no two spans are alike
            self.span[slot[free]] = span[free]
            stay = free[self.span[slot[free]] == span[free]]
            for own, k in zip(self.keys, keys, strict=True):
                own[slot[stay]] = k[stay]
            left = left[self.span[slot[left]] != span[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)


class _Pieces(dict):
    """Ids of pieces, as bytes; a piece met for the first time is encoded by the library.  Short pieces are kept in
    arrays."""

    def __init__(self, tokenizer, dtype):
        super().__init__()
        self.whole, self.merge, self.letters = tokenizer.encode, tokenizer.model.tokenize, _byte_letters()
        self.code = "H" if dtype.itemsize == 2 else "I"
        self.short = _Short(dtype)

    def __len__(self) -> int:
        return super().__len__() + self.short.n

    def __missing__(self, piece: str) -> bytes:
        found = array(self.code, self.by_library(piece)).tobytes()
        if len(piece) <= CACHE_CHARS and len(self) < CACHE_PIECES:
            self[piece] = found
        return found

    def by_library(self, piece: str) -> list[int]:
        word = piece[1:] if piece[:1] == " " else piece
        if word.isalpha():  # one match of the pattern: only merges are left to do
            if piece.isascii():
                return [t.id for t in self.merge(self.letters[32] + word if word is not piece else piece)]
            return [t.id for t in self.merge(piece.encode().decode("latin-1").translate(self.letters))]
        return self.whole(piece, add_special_tokens=False).ids

    def of_texts(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts in UTF-8."""
        raw, lengths = b"".join(texts), np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(lengths)
        begins = ends - lengths
        at = edges(raw, begins, ends)
        words = np.frombuffer(raw + bytes(8 * WORDS + 8 + -len(raw) % 8), "<u8")
        ids, sizes = [], [np.zeros(1, np.int64)]
        for a in range(0, len(at) - 1, BLOCK):
            found = self._block(raw, words, at[a : a + BLOCK + 1])
            ids.append(found[0])
            sizes.append(found[1])
        ids = np.concatenate([np.zeros(0, self.short.pool.dtype), *ids]).tobytes()
        place = np.cumsum(np.concatenate(sizes)) * self.short.pool.itemsize
        return [ids[a:b] for a, b in zip(place[np.searchsorted(at, begins)].tolist(), place[np.searchsorted(at, ends)].tolist(), strict=True)]

    def _block(self, raw: bytes, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces between places, one after the other, and how many each has."""
        begins, lengths = at[:-1], np.diff(at)
        shift, kind = ((begins & 7) << 3).astype(np.uint64), np.minimum(lengths, SHORT + 1)
        back = np.uint64(64) - shift  # shifts by 64 give zero
        aligned = [words[(begins >> 3) + i] for i in range(WORDS + 1)]
        keys = [(aligned[i] >> shift | aligned[i + 1] << back) & _OWN[i][kind] for i in range(WORDS)]
        keys[-1] |= _LENGTH[kind]
        span = self.short.spans(keys)
        missing = np.flatnonzero(span == 0)
        if len(missing):
            met, longer, kept, new, room = {}, [], [], [], CACHE_PIECES - len(self)
            for i, start, end in zip(missing.tolist(), begins[missing].tolist(), at[missing + 1].tolist(), strict=True):
                piece = raw[start:end]
                if piece in met:
                    continue
                if end - start > SHORT:
                    met[piece] = None
                    longer.append(piece)
                    continue
                met[piece] = ids = self.by_library(piece.decode())
                if len(new) < room:
                    kept.append(i)
                    new.append(ids)
            if kept:
                self.short.add([k[kept] for k in keys], new)
                span[missing] = self.short.spans([k[missing] for k in keys])
                missing = missing[span[missing] == 0]
            for piece in longer:
                met[piece] = np.frombuffer(self[piece.decode()], self.short.pool.dtype)
        sizes, others = span & 63, []
        for i, start, end in zip(missing.tolist(), begins[missing].tolist(), at[missing + 1].tolist(), strict=True):
            others.append(met[raw[start:end]])
            sizes[i] = len(others[-1])
        ends = np.cumsum(sizes)
        begins = ends - sizes
        ids = self.short.pool.take(np.repeat((span >> 6) - begins, sizes) + np.arange(ends[-1]), mode="clip")
        for start, own in zip(begins[missing].tolist(), others, strict=True):
            ids[start : start + len(own)] = own
        return ids, sizes


class Encoder:
    """Ids of texts under a byte-level tokenizer file.  Strings of special tokens in a text are ordinary text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.pieces = _Pieces(self.tokenizer, self.dtype)

    @staticmethod
    def of(path: str) -> Encoder:
        """The worker's own encoder: it outlives a task."""
        if path not in _WORKERS:
            _WORKERS[path] = Encoder(path)
        return _WORKERS[path]

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian integers of self.dtype."""
        return self.pieces.of_texts([t.encode() for t in texts])
