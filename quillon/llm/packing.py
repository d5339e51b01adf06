"""Vector bin packing of tokenised documents into training sequences.

Every document becomes its token ids and one closing id 0. Whole runs of `max_tokens` ids make sequences of their
own; what is left of each document is an item with a vector of sizes (tokens, segments, loss-bearing tokens), and
bins are filled by the dot-product heuristic of Panigrahy, Talwar, Uyeda and Wieder, "Heuristics for Vector Bin
Packing" (2011): of the items that fit, the one whose size vector has the largest dot product with the room left in
the bin goes in next. When none fits whole, the largest item that is left is cut to fill the room.

Each task packs its own documents, so nothing is shuffled and a lost task is redone alike; one sequence a task may
stay part-filled. Sequence ids are the task's partition number, shifted by 40 bits, plus a count.

Cases: a null or empty text is the closing id alone; repeated rows and ties keep the order of the input; an empty
table gives no rows; a null doc_id stays null; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import json
import os
from collections import defaultdict, deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.bpe_words import WordTable, split
from quillon.llm.common import blocks, freeing, read_table, texts_of

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
TYPES = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")])


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold. A segment's first `context` ids bear no loss: nothing precedes them."""

    tokens: int = 1024
    segments: int = 256
    loss_tokens: int = 1023
    context: int = 1
    window: int = 4096  # items that wait at a time


@dataclass
class Item:
    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int


@dataclass
class Packer:
    """Packs items as they come; `closed` gets (item, sequence, offset, loss-bearing ids)."""

    limits: Limits
    first: int = 0
    waiting: dict[int, deque[Item]] = field(default_factory=lambda: defaultdict(deque))
    n: int = 0

    def loss(self, tokens: int) -> int:
        return max(0, tokens - self.limits.context)

    def add(self, item: Item) -> Iterator[tuple[Item, int, int, int]]:
        most = self.limits.tokens if self.loss(self.limits.tokens) <= self.limits.loss_tokens else self.limits.loss_tokens + self.limits.context
        while len(item.ids) >= most:
            head, item = self.cut(item, most)
            yield head, self.first, 0, self.loss(most)
            self.first += 1
        if len(item.ids):
            self.waiting[len(item.ids)].append(item)
            self.n += 1
        if self.n >= self.limits.window:
            yield from self.pack(self.limits.window // 2)

    @staticmethod
    def cut(item: Item, k: int) -> tuple[Item, Item]:
        return Item(item.doc_id, item.start, item.ids[:k], item.doc_tokens), Item(item.doc_id, item.start + k, item.ids[k:], item.doc_tokens)

    def take(self, size: int) -> Item:
        item = self.waiting[size].popleft()
        self.n -= 1
        if not self.waiting[size]:
            del self.waiting[size]
        return item

    def pack(self, keep: int = 0) -> Iterator[tuple[Item, int, int, int]]:
        """Fills bins until `keep` items wait. Items of one size have one vector, so sizes are compared, not items."""
        most = np.array([self.limits.tokens, self.limits.segments, self.limits.loss_tokens])
        while self.n > keep:
            room, offset = most.copy(), 0
            while self.n and (room > 0).all():
                sizes = np.fromiter(self.waiting, dtype=np.int64)
                vectors = np.stack([sizes, np.ones_like(sizes), np.maximum(0, sizes - self.limits.context)], axis=1)
                fits = (vectors <= room).all(axis=1)
                if fits.any():
                    gain = ((vectors / most) @ (room / most)) * fits
                    item = self.take(int(sizes[gain == gain.max()].max()))
                else:
                    item, rest = self.cut(self.take(int(sizes.max())), int(min(room[0], room[2] + self.limits.context)))
                    self.waiting[len(rest.ids)].appendleft(rest)
                    self.n += 1
                k = len(item.ids)
                yield item, self.first, offset, self.loss(k)
                room -= [k, 1, self.loss(k)]
                offset += k
            self.first += 1


_TABLES: dict[str, WordTable] = {}
_ADDED: dict[str, tuple[list[bytes], Callable[[bytes], list[int]]]] = {}


def byte_of(char: str) -> int:
    """The byte for which a character of a byte-level vocabulary stands."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return ord(char) if ord(char) in plain else rest[ord(char) - 256]


def word_table(path: str) -> WordTable:
    """A worker's table of words for the tokenizer in this file.

    New words are encoded by the vocabulary that `tokenizers` reads from the file. Where each merge's id follows its
    rank, as in this format it does, tiktoken's core gives the same ids in a fifth of the time; else `tokenizers` runs.
    """
    if path not in _TABLES:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        model = json.loads(tokenizer.to_str())["model"]
        vocab = tokenizer.get_vocab(with_added_tokens=False)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if all(vocab["".join(m)] == 256 + i for i, m in enumerate(pairs)) and len(vocab) >= 256 + len(pairs):
            special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
            of = {chr(c): byte_of(chr(c)) for c in [*range(33, 127), *range(161, 173), *range(174, 324)]}
            ranks = {bytes(of[c] for c in w): i for w, i in vocab.items() if w not in special}
            one = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece

            def encode(words: list[bytes]) -> list[list[int]]:
                return [one(w) for w in words]

        else:

            def encode(words: list[bytes]) -> list[list[int]]:
                return [x.ids for x in tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

        added = [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]
        _ADDED[path] = added, lambda text: tokenizer.encode(text.decode(), add_special_tokens=False).ids
        _TABLES[path] = WordTable(encode, [0])
    return _TABLES[path]


def tokenised(texts: list[bytes], path: str, pattern: str) -> Iterator[np.ndarray]:
    """The ids of each text, with the closing 0. Texts that hold one of the vocabulary's added tokens, which no word may cross, are left to `tokenizers`."""
    table = word_table(path)
    added, whole = _ADDED[path]
    for lo, hi in blocks(texts):
        own = texts[lo:hi]
        odd = {k for k, t in enumerate(own) if any(a in t for a in added)}
        buf, starts, lengths, ends = split([b"" if k in odd else t for k, t in enumerate(own)], pattern)
        index = table.find(buf, starts, lengths, ends)
        ids = table.ids(index)
        for k, x in enumerate(np.split(ids, np.cumsum(table.lens[index])[ends][:-1])):
            yield np.array([*whole(own[k]), 0], dtype=np.uint32) if k in odd else x


def pack(docs: DataFrame, tokenizer: str, pattern: str, limits: Limits = Limits()) -> DataFrame:
    """doc_id and text to one row a piece; see the module's text."""

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(limits, first=TaskContext.get().partitionId() << 40)

        def rows(pieces) -> Iterator[pa.RecordBatch]:
            out = [(p.doc_id, p.start, len(p.ids), crc32(p.ids.astype("<u4").tobytes()), p.doc_tokens, k, offset, loss) for p, k, offset, loss in pieces]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*out, strict=True)], schema=TYPES)

        for batch in batches:
            ids = tokenised(texts_of(batch.column(1)), tokenizer, pattern)
            yield from rows(x for doc, own in zip(batch.column(0).to_pylist(), ids, strict=True) for x in packer.add(Item(doc, 0, own, len(own))))
        yield from rows(packer.pack())

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(freeing(packed), SCHEMA)


def op2_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return pack(read_table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), P.PATTERN)
