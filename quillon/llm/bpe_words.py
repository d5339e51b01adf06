"""Vectorised pre-tokenisation for byte-level BPE, and a table from distinct words to their ids.

The pattern of public_tokenizers splits a text into words; on texts of ASCII and Latin letters the split is done
on whole blocks of bytes at once, on any other text by the `regex` module. Each distinct word is encoded once a
worker and found again by a 64-bit hash of its bytes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex

from quillon.llm.common import hash_slices, same_slices, words_at

L, N, S, O, X = range(5)  # letter, digit, white space, other, end of a text
END = 0xFF  # no byte of UTF-8

#: Unicode white space, as the pattern's \s has it (fixed values).
SPACE = r"\t-\r \x85\xa0  -     　"


def _classes() -> np.ndarray:
    c = np.full(256, O, dtype=np.uint8)
    c[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = L
    c[ord("0") : ord("9") + 1] = N
    c[[*range(9, 14), 32]] = S
    c[0x80:0xC0] = c[0xC3:0xCA] = L  # continuation bytes, and the first bytes of U+00C0 to U+024F
    c[END] = X
    return c


CLASSES = _classes()
_PLAIN = bytes(b for b in range(256) if b < 0x80 or 0x80 <= b < 0xC0 or 0xC3 <= b < 0xCA)


def is_plain(text: bytes) -> bool:
    """Whether the block split holds: ASCII, and letters from U+00C0 to U+024F."""
    return text.isascii() or not text.translate(None, _PLAIN) and b"\xc3\x97" not in text and b"\xc3\xb7" not in text


@lru_cache
def _pattern(pattern: str):
    return regex.compile(pattern.replace(r"[^\s", rf"[^{SPACE}").replace(r"\S", rf"[^{SPACE}]").replace(r"\s", rf"[{SPACE}]"))


def word_starts(b: np.ndarray) -> np.ndarray:
    """Where the pattern's matches start in a block of plain texts, each of which ends in END."""
    c = CLASSES[b]
    start = np.ones(len(b), dtype=bool)
    np.not_equal(c[1:], c[:-1], out=start[1:])
    start |= c == X
    # the last of several white-space characters before a word stands alone, and a blank joins the word
    j = np.flatnonzero(start[1:] & (c[1:] < X) & (c[1:] != S) & (c[:-1] == S)) + 1
    start[j - 1] = True
    start[j[b[j - 1] == 32]] = False
    q = np.flatnonzero((b[:-1] == 39) & start[:-1] & (c[1:] == L))
    if q.size:
        x, y = b[q + 1], b[np.minimum(q + 2, len(b) - 1)]
        one = np.isin(x, list(b"stmd"))
        two = (x == ord("r")) & (y == ord("e")) | (x == ord("v")) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))
        for which, n in ((q[one], 2), (q[two], 3)):
            start[which + 1] = False
            rest = which + n
            start[rest[c[rest] == L]] = True
    return np.flatnonzero(start)


def split(texts: list[bytes], pattern: str) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts, each with END behind it, as one buffer; starts and lengths of their words, END a word of its own; whether a word is END."""
    plain = [is_plain(t) for t in texts]
    if all(plain):
        buf = b"\xff".join(texts) + b"\xff"
        starts = word_starts(np.frombuffer(buf, dtype=np.uint8))
        lengths = np.diff(starts, append=len(buf))
    else:
        find, parts, sizes = _pattern(pattern).findall, [], []
        for t, simple in zip(texts, plain, strict=True):
            if simple:
                t += b"\xff"
                parts.append(t)
                sizes.append(np.diff(word_starts(np.frombuffer(t, dtype=np.uint8)), append=len(t)))
            else:
                words = [w.encode() for w in find(t.decode())]
                parts += [*words, b"\xff"]
                sizes.append(np.array([*map(len, words), 1]))
        buf = b"".join(parts)
        lengths = np.concatenate(sizes)
        starts = np.cumsum(lengths) - lengths
    return buf + bytes(8), starts, lengths, np.frombuffer(buf, dtype=np.uint8)[starts] == END


class WordTable:
    """Ids of the distinct words met so far, word 0 being END. At most `limit` words are kept, and those of one block; then it starts anew.

    encode gets new words and returns a list of ids for each. Words are found by a hash of their bytes, and the bytes
    compared; a word whose hash another one has is found by its bytes alone.
    """

    SLOTS = 20

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], end: list[int], limit: int = 500_000):
        self.encode, self.end, self.limit = encode, end, limit
        self.clear()

    def clear(self) -> None:
        self.keys, self.vals = np.zeros(1 << self.SLOTS, dtype=np.uint64), np.full(1 << self.SLOTS, -1, dtype=np.int32)
        self.spare: dict[int, int] = {}
        self.same: dict[bytes, int] = {}  # words whose hash another word has
        self.n, self.used, self.held = 0, 0, 0
        self.offs, self.lens, self.flat = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int32), np.zeros(1 << 18, dtype=np.uint32)
        self.froms, self.sizes, self.bytes = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 20, dtype=np.uint8)
        self._append([bytes([END])], [self.end])

    def _append(self, words: list[bytes], ids: list[list[int]]) -> None:
        new = np.fromiter((x for w in ids for x in w), dtype=np.uint32)
        own = np.frombuffer(b"".join(words), dtype=np.uint8)
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.held + len(own) + 8 > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros_like(self.bytes)])
        while self.n + len(ids) > len(self.offs):
            self.offs, self.lens, self.froms, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.offs, self.lens, self.froms, self.sizes))
        at = slice(self.n, self.n + len(ids))
        self.flat[self.used : self.used + len(new)] = new
        self.bytes[self.held : self.held + len(own)] = own
        self.lens[at] = np.fromiter(map(len, ids), dtype=np.int32)
        self.offs[at] = self.used + np.cumsum(self.lens[at]) - self.lens[at]
        self.sizes[at] = np.fromiter(map(len, words), dtype=np.int64)
        self.froms[at] = self.held + np.cumsum(self.sizes[at]) - self.sizes[at]
        self.n, self.used, self.held = self.n + len(ids), self.used + len(new), self.held + len(own)

    def _slots(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (h >> np.uint64(64 - self.SLOTS)).astype(np.int64), (h & np.uint64((1 << self.SLOTS) - 1)).astype(np.int64)

    def _is(self, index: np.ndarray, buf: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Whether the words at index are the bytes of these slices."""
        at = np.ndarray((len(self.bytes) - 7,), dtype="<u8", buffer=self.bytes, strides=(1,))
        return same_slices(at, self.froms[index], self.sizes[index], words_at(buf), starts, lengths)

    def find(self, buf: bytes, starts: np.ndarray, lengths: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The index of each word."""
        if self.n > self.limit:
            self.clear()
        h = self._hashes(buf, starts, lengths)
        a, b = self._slots(h)
        out = np.where(self.keys[a] == h, self.vals[a], -1)
        left = np.flatnonzero(out < 0)
        other = b[left]
        out[left] = np.where(self.keys[other] == h[left], self.vals[other], -1)
        out[ends] = 0
        left = np.flatnonzero(out < 0)
        if left.size:
            unique, first, where = np.unique(h[left], return_index=True, return_inverse=True)
            got = np.array([self.spare.get(x, -1) for x in unique.tolist()], dtype=np.int32)
            new = np.flatnonzero(got < 0)
            if new.size:
                at, n = starts[left[first[new]]].tolist(), lengths[left[first[new]]].tolist()
                words = [buf[s : s + k] for s, k in zip(at, n, strict=True)]
                got[new] = np.arange(self.n, self.n + len(words))
                self._append(words, self.encode(words))
                self._keep(unique[new], got[new])
            out[left] = got[where]
        for k in np.flatnonzero(~self._is(out, buf, starts, lengths)).tolist():
            word = buf[starts[k] : starts[k] + lengths[k]]
            if word not in self.same:
                self.same[word] = self.n
                self._append([word], self.encode([word]))
            out[k] = self.same[word]
        return out

    def _hashes(self, buf: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return hash_slices(buf, starts, lengths)

    def _keep(self, h: np.ndarray, index: np.ndarray) -> None:
        for k in range(2):
            slot = self._slots(h)[k]
            free = np.flatnonzero(self.vals[slot] < 0)
            _, one = np.unique(slot[free], return_index=True)  # one word a slot
            free = free[one]
            self.keys[slot[free]], self.vals[slot[free]] = h[free], index[free]
            rest = np.ones(len(h), dtype=bool)
            rest[free] = False
            h, index = h[rest], index[rest]
            if not len(h):
                return
        self.spare.update(zip(h.tolist(), index.tolist(), strict=True))

    def ids(self, index: np.ndarray) -> np.ndarray:
        """The ids of the words, one after the other."""
        n = self.lens[index].astype(np.int64)
        return self.flat[np.repeat(self.offs[index] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
