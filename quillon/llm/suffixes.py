"""Repeated passages across a corpus, by prefix doubling over sampled suffixes.

A byte goes if a string of `length` bytes that covers it also starts anywhere else. Plain prefix doubling (Karp, Miller
and Rosenberg's names for strings of doubling lengths, discarding unique ones as Dementiev, Kaerkkaeinen, Mehnert and
Sanders do) has a row for each byte of the corpus in its first rounds. Here a row stands for a whole run of starts:

1. Sampling. Each window of `length` bytes is led by its minimiser, the place of its least 8-byte word by hash. That
   place depends on nothing but the window's own bytes, so equal windows have it at equal distance. Starts that share
   a leader make one run, about 200 of them on average.
2. Names. A run is cut at multiples of `step` of the distance to the leader. A piece has two names: of the bytes common
   to all its windows (the core), and of the bytes of any of them (the whole), each a fingerprint in place of a rank, so
   that naming takes no global sort. Cores grow from round to round as steps shrink, at 240 bytes
   from 113 over 225 to all. A piece carries the names for a second, longer length too, so that one set of rounds finds
   both what the query removes (400 bytes) and passages of over 50 words (240 bytes).
3. Discarding. A piece whose core is unique has no repeated window and is discarded. Pieces whose wholes are equal are
   repeated in all their windows: these are marked, and one of them goes on as a witness. Pieces that share a core but
   not the whole are cut finer. At step 1 core and whole are one window, so the result is exact but for collisions of
   128 bits of names.

Rows are counted by aggregations that combine before the shuffle. The few commonest cores are broadcast to the rows that
hold them and the others joined, so a passage in a third of all documents is no task's burden; nothing is paired with
anything.

Cases: a null text is empty; texts shorter than `length` keep all; equal rows, even with one doc_id, are repeats of each
other; a passage that overlaps itself counts; rows of null doc_id take part; an empty table gives no rows; other columns,
whatever their names, are kept by `cut`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from quillon.llm.common import Scratch, blocks, columns_of, freeing, fresh, map_arrow, mix, read_table, texts_of, words_at

WORD = 8
#: Bytes of texts whose windows are sampled at a time, for which some sixty times as many are held; copies are cut at the same places.
PIECE = 1 << 18
#: Pieces that are named at a time.
PIECES = 1 << 15

NODE = "quillon_id long, quillon_text long, core long, whole long, long_core long, long_whole long, leader long, near int, long_near int, far int"
NODES = pa.schema([(n, pa.int32() if t == "int" else pa.int64()) for n, t in map(str.split, NODE.split(", "))])
ROW = ["quillon_id", "quillon_text"]


@dataclass(frozen=True)
class Settings:
    length: int = 400
    steps: tuple[int, ...] = (256, 16, 1)
    longer: int = 0  # a second length, found in the same rounds; 0 for none


#: Passages of over 50 words: of 51 words in running text, 99 in 100 take more bytes.
PASSAGE = Settings(240, (128, 16, 1))
#: Both these and what the query removes.
BOTH = Settings(240, (128, 16, 1), 400)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    n = len(x) - w + 1
    padded = np.concatenate([x, np.full(-len(x) % w, np.iinfo(x.dtype).max, dtype=x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def runs(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one leader: the text's number, the leader's place, and its least and largest distance."""
    found = []
    for lo, hi in blocks(texts, PIECE):
        for cut in range(0, max(1, max(len(t) for t in texts[lo:hi]) - length + 1), PIECE):
            own = [t[cut : cut + PIECE + length - 1] for t in texts[lo:hi]]
            sizes = np.array([len(t) for t in own])
            total = int(sizes.sum())
            if total < length:
                continue
            x = words_at(b"".join(own) + bytes(WORD - 1))[:total]
            packed = (mix(x) & np.uint64(0xFFFFFFFF00000000)) | np.arange(total, dtype=np.uint64)
            m = (sliding_min(packed[: total - WORD + 1], length - WORD + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            first = np.cumsum(sizes) - sizes
            change = np.zeros(len(m) + 1, dtype=np.int64)
            some = sizes >= length
            np.add.at(change, first[some], 1)
            np.add.at(change, (first + sizes - length + 1)[some], -1)
            valid = np.cumsum(change[:-1]) > 0
            begins = valid.copy()
            begins[1:] &= (m[1:] != m[:-1]) | ~valid[:-1]
            starts = np.flatnonzero(begins)
            goes_on = valid.copy()
            goes_on[:-1] &= (m[1:] != m[:-1]) | ~valid[1:]
            ends = np.flatnonzero(goes_on)
            leader = m[starts]
            doc = np.searchsorted(np.cumsum(sizes), leader, side="right")
            found.append((doc + lo, leader - first[doc] + cut, leader - ends, leader - starts))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def hashes(buf: bytes, starts: np.ndarray, ends: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The fingerprint of each slice."""
    got = (xxh3_64_intdigest(buf[a:b], k) for a, b, k in zip(starts.tolist(), ends.tolist(), seeds.tolist(), strict=True))
    return np.fromiter(got, dtype=np.uint64, count=len(starts)).view(np.int64)


def named(texts: list[bytes], doc: np.ndarray, leader: np.ndarray, near: np.ndarray, far: np.ndarray, step: int, s: Settings) -> Iterator[tuple]:
    """The runs' pieces at this step, many at a time: text's number, names of core and whole at both lengths, leader, least distances at both, largest distance.

    Near a text's end windows of the longer length start no more: these have a larger least distance, or no names.
    """
    buf, sizes = b"".join(texts), np.array([len(t) for t in texts], dtype=np.int64)
    first, n = near // step, far // step - near // step + 1
    cuts = np.flatnonzero(np.diff(np.cumsum(n) // PIECES, prepend=-1)).tolist()
    for lo, hi in zip(cuts, [*cuts[1:], len(n)], strict=True):
        r = np.repeat(np.arange(lo, hi), n[lo:hi])
        j = np.arange(len(r)) - np.repeat(np.cumsum(n[lo:hi]) - n[lo:hi], n[lo:hi]) + first[r]
        a, b, k, own = np.maximum(near[r], j * step), np.minimum(far[r], j * step + step - 1), doc[r], leader[r]
        at = (np.cumsum(sizes) - sizes)[k] + own
        core = hashes(buf, at - j * step, at - j * step - step + 1 + s.length, j)
        whole = hashes(buf, at - b, at - a + s.length, b << 16 | a)
        c = np.maximum(a, own + s.longer - sizes[k])
        long = np.flatnonzero(c <= b) if s.longer else np.zeros(0, dtype=np.int64)
        names, absent = [np.zeros(len(r), dtype=np.int64) for _ in range(2)], np.ones(len(r), dtype=bool)
        if long.size:
            x, y, z = at[long], j[long], c[long]
            names[0][long] = hashes(buf, x - y * step, x - y * step - step + 1 + s.longer, y)
            names[1][long] = hashes(buf, x - b[long], x - z + s.longer, b[long] << 16 | z)
            absent[long] = False
        yield k, core, whole, *(pa.array(x, mask=absent) for x in names), own, a, pa.array(c.astype(np.int32), mask=absent), b


def keyed(docs: DataFrame, own: str = ROW[0], digest: str = ROW[1]) -> DataFrame:
    """docs and what tells rows with different texts apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({own: F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), digest: F.xxhash64(text)})


def pieces(rows: DataFrame, step: int, s: Settings) -> DataFrame:
    """Named pieces of the runs in `runs`, or, if rows have no such column, of all runs."""
    given = "runs" in rows.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(2))
            if given:
                lists, flat = batch.column(3), batch.column(3).flatten()
                doc = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy())
                todo = (doc, *(flat.field(k).to_numpy().astype(np.int64) for k in range(3)))
            else:
                todo = runs(texts, s.length)
            ids, digests = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k, *columns in named(texts, *todo, step, s) if len(todo[0]) else ():
                yield pa.RecordBatch.from_arrays([pa.array(c, t) if isinstance(c, np.ndarray) else c for c, t in zip((ids[k], digests[k], *columns), NODES.types, strict=True)], schema=NODES)

    return rows.select(*ROW, F.col("text").cast("string"), *["runs"] * given).mapInArrow(freeing(run), NODE)


def resolved(scratch: Scratch, some: DataFrame, core: str, whole: str, near: str, length: int) -> tuple[DataFrame, DataFrame]:
    """Marks (row, start, end, length) of pieces whose wholes repeat, and of each different whole of a core that has several one piece's place."""
    place = F.struct(*ROW, "leader", "near", "far")
    wholes = scratch.table(some.groupBy(core, whole).agg(F.count("*").alias("n"), F.min(place).alias("one")))
    twice = some.join(wholes.filter("n > 1").select(core, whole), [core, whole])
    marks = scratch.table(twice.select(*ROW, (F.col("leader") - F.col("far")).alias("start"), (F.col("leader") - F.col(near) + length).alias("end"), F.lit(length).alias("length")))
    finer, counts = scratch.recurring(wholes, core)
    places = scratch.table(finer.select("one.*"))
    scratch.drop(wholes, counts)
    return marks, places


def repeated(docs: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Marks (row, start, end, length) of repeated windows of both lengths, and the rows with texts that may have any. docs: as keyed() gives them.

    Both lengths share runs and rounds: a window that repeats at the longer length starts with one that does at the
    shorter, with the same leader. Pieces are cut finer while either length needs it.
    """
    scratch = Scratch(docs.sparkSession, "suffixes")
    source, marks, texts = docs.select(*ROW, F.col("text").cast("string").alias("text")), [], None
    rows = source
    for step in s.steps:
        nodes = scratch.table(pieces(rows, step, s))
        shared, counts = scratch.recurring(nodes, "core")
        some = scratch.table(shared)
        scratch.drop(nodes, counts)
        if texts is None:
            texts = scratch.table(source.join(some.select(*ROW).distinct(), ROW).dropDuplicates(ROW))
        found, places = resolved(scratch, some, "core", "whole", "near", s.length)
        marks.append(found)
        if s.longer:
            found, more = resolved(scratch, some.filter("long_core IS NOT NULL"), "long_core", "long_whole", "long_near", s.longer)
            marks.append(found)
            places = places.unionByName(more)
        scratch.drop(some)
        if step != s.steps[-1]:
            left = places.groupBy(*ROW).agg(F.collect_set(F.struct("leader", "near", "far")).alias("runs"))
            rows = texts.join(left, ROW)
    return reduce(DataFrame.unionByName, marks), texts


def joined(spans: list) -> list[tuple[int, int]]:
    """Maximal runs of bytes."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes of the texts of these numbers."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    wide = int(end.max()) + 1
    reach = np.maximum.accumulate(end + doc * wide)
    new = np.ones(len(doc), dtype=bool)
    new[1:] = start[1:] + doc[1:] * wide > reach[:-1]
    last = np.append(np.flatnonzero(new)[1:], len(doc)) - 1
    return doc[new], start[new], reach[last] - doc[last] * wide


def cuts(marks: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """Of rows with marks, once a row's keys: passage_bytes, which all marks of s.length cover, and, of the longer length if there is one, the removed spans, the bytes kept and their digest."""
    spans = marks.groupBy(*ROW).agg(F.collect_list(F.struct("start", "end", "length")).alias("spans"))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    types = pa.schema([("quillon_id", pa.int64()), ("quillon_text", pa.int64()), ("passage_bytes", pa.int64()), ("spans", pa.list_(span)), ("kept", pa.binary()), ("kept_sha256", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, flat = texts_of(batch.column(2)), batch.column(3).flatten()
            doc = np.repeat(np.arange(len(texts)), batch.column(3).value_lengths().to_numpy())
            start, end, length = (flat.field(k).to_numpy() for k in range(3))
            short, own = length == s.length, length == (s.longer or s.length)
            at, lo, hi = merged(doc[short], start[short], end[short])
            passage = np.bincount(at, weights=hi - lo, minlength=len(texts)).astype(np.int64)
            at, lo, hi = merged(doc[own], start[own], end[own])
            offsets = np.searchsorted(at, np.arange(len(texts) + 1))
            pairs = list(zip(lo.tolist(), hi.tolist(), strict=True))
            kept = [kept_bytes(t, pairs[a:b]) for t, a, b in zip(texts, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            removed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(lo), pa.array(hi)], fields=list(span)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(passage), removed, pa.array(kept, pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])], schema=types)

    return texts.join(spans, ROW).select(*ROW, "text", "spans").mapInArrow(freeing(run), "quillon_id long, quillon_text long, passage_bytes long, spans array<struct<start: long, end: long>>, kept binary, kept_sha256 string")


def digests(docs: DataFrame, s: Settings = BOTH) -> DataFrame:
    """doc_id and text to the counts of bytes and spans that are removed at the longer length, and the digest of what is kept.

    passage_bytes are the bytes that strings of s.length cover which also start elsewhere.
    """
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    found = cuts(*repeated(rows, s), s).select(*ROW, "passage_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.col("kept_sha256").alias("cut_sha256"))
    slim = rows.select("doc_id", *ROW, F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))
    every = slim.join(found, ROW, "left")
    removed, spans, passage = (F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_removed", "n_spans", "passage_bytes"))
    return every.select("doc_id", "n_bytes", removed, spans, F.coalesce("cut_sha256", "sha256").alias("kept_sha256"), passage)


def cut(docs: DataFrame, s: Settings = PASSAGE) -> DataFrame:
    """docs without repeated passages in `text`. Characters that lose some of their bytes go whole."""
    names = docs.columns
    own, digest, kept = fresh(names, "own_id", "own_text", "own_kept")
    rows = keyed(docs, own, digest)
    found = cuts(*repeated(keyed(docs.select("doc_id", "text")), s), s).select(F.col(ROW[0]).alias(own), F.col(ROW[1]).alias(digest), F.col("kept").alias(kept))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            old, new = batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()
            texts = [a if b is None else b.decode(errors="ignore") for a, b in zip(old, new, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(len(names))], names=names)

    fields = [T.StructField("text", T.StringType()) if f.name == "text" else f for f in docs.schema.fields]
    return map_arrow(rows.join(found, [own, digest], "left").select(*columns_of(docs), kept), run, T.StructType(fields))


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"))
