"""Byte-level BPE by corpus-level merge replay.

A corpus is the distinct words of a block of documents, and its state the parts of every word, at first single
bytes. An inverted index has, for each pair of neighbouring parts that is a merge, the positions where it stands.
Merges are replayed in rank order, each at all its positions in the corpus at once, left to right; a merge changes
the index only at the neighbours it touched. A merge that arises later than its rank still runs next, as the pair
of lowest rank present is always the next one. Only where a merge makes a pair of a lower rank than its own could a
word alone have gone on differently; such words, which hardly occur, are encoded alone.

Words recur, so a worker keeps the ids of those it has seen (at most a stated number); documents are looked up word
by word, and no word crosses the network. Decoding puts together the vocabulary's bytes of the ids.

Cases: a null or empty text has no ids; the digests are those of empty bytes; every byte string can be encoded if the
vocabulary has all 256 bytes, else a ValueError names the byte; an empty table gives no rows; a null doc_id stays null.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.bpe_words import WordTable, split
from quillon.llm.common import blocks, read_table, texts_of


@lru_cache
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache
def merges(path: str) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """The id of each single byte, the bytes of each id, the sorted keys of all pairs that merge, and their ranks."""
    ranks = load_ranks(path)
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"the vocabulary lacks byte {missing[0]}")
    names: list[bytes] = [b""] * (max(ranks.values()) + 1)
    pairs: dict[int, int] = {}
    for word, rank in ranks.items():
        names[rank] = word
        for k in range(1, len(word)):
            if (a := ranks.get(word[:k])) is not None and (b := ranks.get(word[k:])) is not None:
                pairs[a << 32 | b] = rank
    keys = np.array(sorted(pairs), dtype=np.int64)
    return np.array([ranks[bytes([b])] for b in range(256)]), names, keys, np.array([pairs[k] for k in keys.tolist()])


def plain_bpe(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """One word alone: the leftmost pair of the lowest rank, again and again, by a heap of pairs."""
    n = len(word)
    ends, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))  # of the part at each byte

    def pair(i: int) -> tuple[int, int, int] | None:
        """The rank, place and end of the pair that starts at i."""
        if after[i] < n and (rank := ranks.get(word[i : ends[after[i]]])) is not None:
            return rank, i, ends[after[i]]
        return None

    heap = [p for i in range(n) if (p := pair(i))]
    heapq.heapify(heap)
    gone = bytearray(n + 1)
    while heap:
        rank, i, end = heapq.heappop(heap)
        if gone[i] or after[i] >= n or ends[after[i]] != end:
            continue
        j = after[i]
        gone[j], ends[i], after[i] = 1, end, after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and (p := pair(k)):
                heapq.heappush(heap, p)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : ends[i]]])
        i = after[i]
    return out


def replay(words: list[bytes], path: str) -> list[list[int]]:
    """The ids of each word: every merge in rank order over the whole corpus, by the inverted index."""
    single, _, keys, key_ranks = merges(path)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    part = np.append(single[np.frombuffer(b"".join(words), dtype=np.uint8)], -2)  # a part's id at its first byte, -1 inside it
    total = len(part) - 1  # stands for "no neighbour"
    after, before = np.minimum(np.arange(1, total + 2), total), np.arange(-1, total)
    ends = np.cumsum(sizes[sizes > 0])
    after[ends - 1] = total
    before[ends - sizes[sizes > 0]] = before[total] = total

    def rank(i: np.ndarray) -> np.ndarray:
        """The rank of the pair that starts at each position, or -1."""
        key = part[i] << 32 | np.maximum(part[after[i]], 0)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where((keys[at] == key) & (part[i] >= 0) & (after[i] < total), key_ranks[at], -1)

    index: dict[int, list[np.ndarray]] = defaultdict(list)

    def enter(at: np.ndarray, ranks: np.ndarray) -> list[int]:
        at, ranks = at[ranks >= 0], ranks[ranks >= 0]
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks, prepend=-1)).tolist()
        for k, lo in enumerate(cuts):
            index[int(ranks[lo])].append(at[lo : cuts[k + 1] if k + 1 < len(cuts) else None])
        return ranks[cuts].tolist()

    everywhere = np.arange(total)
    queue = enter(everywhere, rank(everywhere)) if total else []
    heapq.heapify(queue)
    early: list[np.ndarray] = []
    while queue:
        r = heapq.heappop(queue)
        if r not in index:
            continue
        i = np.unique(np.concatenate(index.pop(r)))
        i = i[rank(i) == r]  # else a neighbour's merge has taken one of the two
        j = after[i]
        if (j[:-1] == i[1:]).any():  # pairs that share a part: left to right
            taken, last = [], -1
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                if a != last:
                    taken.append(a)
                    last = b
            i = np.array(taken)
            j = after[i]
        if not len(i):
            continue
        k = after[j]
        part[i], part[j] = r, -1
        after[i] = k
        before[k[k < total]] = i[k < total]
        h = before[i]
        touched = np.unique(np.concatenate([i, h[h < total]]))
        ranks = rank(touched)
        if (low := (ranks >= 0) & (ranks < r)).any():
            early.append(touched[low])
        for fresh in enter(touched, ranks):
            heapq.heappush(queue, fresh)
    starts = np.cumsum(sizes) - sizes
    ids = np.split(part[:total][part[:total] >= 0], np.cumsum(np.add.reduceat(np.append(part[:total] >= 0, 0), starts) * (sizes > 0))[:-1]) if words else []
    out = [x.tolist() for x in ids]
    if early:  # a pair of lower rank than the merge that made it may come before that merge's other places in the word
        ranks = load_ranks(path)
        for w in set(np.searchsorted(np.cumsum(sizes), np.concatenate(early), side="right").tolist()):
            out[w] = plain_bpe(words[w], ranks)
    return out


def decode(ids: Iterable[int], path: str) -> bytes:
    names = merges(path)[1]
    return b"".join(names[i] for i in ids)


#: Bytes of text whose new words make one corpus.
CORPUS_BYTES = 8 << 20

class Digested(WordTable):
    """Words with their ids and with what each puts into the digests, which go when the words go."""

    def __init__(self, path: str, limit: int = 500_000):
        self.path = path
        super().__init__(lambda words: replay(words, path), [], limit)

    def clear(self) -> None:
        self.decimal: list[bytes] = []
        self.decoded: list[bytes] = []
        super().clear()

    def digested(self) -> tuple[list[bytes], list[bytes]]:
        """Of every word the decimal ids, each with a comma behind, and the decoded bytes."""
        for w in range(len(self.decimal), self.n):
            ids = self.flat[self.offs[w] : self.offs[w] + self.lens[w]].tolist()
            self.decimal.append("".join(f"{i}," for i in ids).encode())
            self.decoded.append(decode(ids, self.path))
        return self.decimal, self.decoded


#: A worker's words by vocabulary.
_TABLES: dict[str, Digested] = {}


def table_of(path: str) -> Digested:
    if path not in _TABLES:
        _TABLES[path] = Digested(path)
    return _TABLES[path]


TYPES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text to the count and digest of the ids, and the digest of the bytes decoded from them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(path)
        for batch in batches:
            texts, counts, ids_sha, decoded_sha = texts_of(batch.column(1)), [], [], []
            for lo, hi in blocks(texts, CORPUS_BYTES):
                buf, starts, lengths, ends = split(texts[lo:hi], pattern)
                index = table.find(buf, starts, lengths, ends)
                decimal, decoded = table.digested()
                n = np.add.reduceat(table.lens[index], np.concatenate([[0], np.flatnonzero(ends)[:-1] + 1]))
                counts += n.tolist()
                words, last = index.tolist(), 0
                for end in np.flatnonzero(ends).tolist():
                    own, last = words[last:end], end + 1
                    ids_sha.append(hashlib.sha256(b"".join([decimal[w] for w in own])[:-1]).hexdigest())
                    decoded_sha.append(hashlib.sha256(b"".join([decoded[w] for w in own])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)], schema=TYPES)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text to doc_id and `ids`, for use as training input."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(path)
        for batch in batches:
            texts, out = texts_of(batch.column(1)), []
            for lo, hi in blocks(texts):
                buf, starts, lengths, ends = split(texts[lo:hi], pattern)
                index = table.find(buf, starts, lengths, ends)
                out += np.split(table.ids(index), np.cumsum(table.lens[index])[ends][:-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def op3_bpe_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return encode_decode(read_table(spark, sf_dir, "documents"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
