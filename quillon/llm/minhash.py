"""Near-duplicate documents by MinHash, odd sketches and exact verification.

1. Signatures. A text's words are hashed and combined to the distinct shingles of `shingle` words; documents of one set
   make a class (the digest of the sorted set). 128 MinHash samples are cut into bands of 4. Another set of samples,
   the least hash in each of 4096 ranges (one-permutation hashing), is folded into an odd sketch (Mitzenmacher, Pagh and
   Pham, "Efficient Estimation for High Similarities using Odd Sketches", 2014): each sample flips one bit of a 2048-bit
   map, and the bits set in the XOR of two maps tell how many samples differ. They are never more than twice the
   shingles that only one of two sets has, nor more than these and the shingles of either set that are no samples, as a
   range of which both have a sample can differ in both by one such shingle, but then hides a shingle that both share.
   So a pair that has too many for its sizes is no link, whatever collides. Only for sets too large for this to tell
   much, where samples are thousands, the number estimated by the bits decides too.
2. Buckets. A band's key that several classes share makes a bucket. At a similarity of 0.8 a pair shares one of 32 bands
   but for a chance of 5e-8.
3. Rounds. In each round every class is compared with one hub, that of one of its buckets, if they are not yet
   connected: sketches and sizes first, then the full sets. A bucket's first hub is its class that shares buckets with
   most others, which the members of a group of copies have in common; later ones are drawn by hash. Components are
   updated, and buckets in one component retire. So a group of thousands of near copies costs a few comparisons a member.
4. Rest. In buckets that still hold several components, pairs across components whose sizes and sketches allow a link
   are compared, each in the first band that both share: no link is lost to the choice of hubs. Small buckets are joined
   with themselves, split by the sizes of sets; the classes of large ones are dealt to blocks, and tasks hold the
   sketches of two blocks against each other as arrays.

Links are confirmed on full sets: 100 * intersection >= 100 * similarity * union. Links, components and signatures stay
tables in the shared folder; nothing of them goes to the driver.

Cases: a null or empty text, or one without words, has an empty set and is linked with nothing; texts of fewer words
than a shingle are one shingle; rows with equal sets are linked, whatever their ids; a set that only rows of null doc_id
have is a component of its own, without an id; an empty table gives no rows; other columns, whatever their names, are
kept by `dedup`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, blocks, columns_of, fresh, hash_slices, mix, read_table, texts_of

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    percent: int = 80  # of intersection to union
    samples: int = 128
    band: int = 4
    ranges: int = 4096  # of hashes, each of which gives a sample to the sketch
    sketch_words: int = 32  # of 64 bits
    slack: float = 0.1  # by which an estimate may miss the bar: over seven deviations, a chance below 1e-12
    estimated: int = 6000  # sizes of two sets, added, from which the estimate decides too
    rounds: int = 3
    joined: int = 64  # classes of a bucket up to which they are joined; more are compared in blocks
    block: int = 4096
    seed: int = 23


def shingles(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, one text after the other, and their number a text."""
    counts = np.zeros(len(texts), dtype=np.int64)
    parts = []
    for lo, hi in blocks(texts):
        buf = b" \n".join(texts[lo:hi]).translate(LOWER)
        b = np.frombuffer(buf, dtype=np.uint8)
        space = SPACE[b]
        edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
        starts, lengths = edge[::2], edge[1::2] - edge[::2]
        if not len(starts):
            continue
        word = hash_slices(buf + bytes(8), starts, lengths)
        ends = np.cumsum(np.array([len(t) + 2 for t in texts[lo:hi]]))
        doc = np.searchsorted(ends, starts, side="right")
        n_words = np.bincount(doc, minlength=hi - lo)
        first = np.cumsum(n_words) - n_words
        h = np.full(len(word), np.uint64(size))
        for k in range(size):  # a short text's last words count as absent, so that it is one shingle
            at = np.arange(len(word)) + k
            inside = at < (first + n_words)[doc]
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, word[np.minimum(at, len(word) - 1)], np.uint64(0)))
        whole = np.arange(len(word)) - first[doc] + size <= np.maximum(n_words, size)[doc]
        h, doc = h[whole], doc[whole]
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        counts[lo:hi] = np.bincount(doc[new], minlength=hi - lo)
        parts.append(h[new])
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), counts


def samples(sets: np.ndarray, counts: np.ndarray, s: Settings) -> np.ndarray:
    """MinHash samples of the sets that are not empty: one row each."""
    rng = np.random.default_rng(s.seed)
    flips, factors = rng.integers(0, 1 << 32, s.samples, dtype=np.uint32), rng.integers(0, 1 << 31, s.samples, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    low = (sets >> np.uint64(32)).astype(np.uint32)
    starts = (np.cumsum(counts) - counts)[counts > 0]
    out = np.empty((len(starts), s.samples), dtype=np.uint32)
    if not len(starts):
        return out
    step = 1 << 18
    cuts = [0]  # sets that are worked on together
    for i in range(len(starts)):
        if starts[i] - starts[cuts[-1]] > step:
            cuts.append(i)
    for a, b in zip(cuts, [*cuts[1:], len(starts)], strict=True):
        part = low[starts[a] : starts[b] if b < len(starts) else None]
        for k in range(s.samples):
            x = (part ^ flips[k]) * factors[k]
            out[a:b, k] = np.minimum.reduceat(x ^ (x >> np.uint32(15)), starts[a:b] - starts[a]) if len(part) else 0
    return out


def bands(got: np.ndarray, s: Settings) -> np.ndarray:
    """One 64-bit key a band."""
    g = got.reshape(len(got), s.samples // s.band, s.band).astype(np.uint64)
    h = np.broadcast_to(np.arange(g.shape[1], dtype=np.uint64), g.shape[:2]).copy()
    for k in range(s.band):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + g[:, :, k])
    return h.view(np.int64)


def odd_sketches(sets: np.ndarray, counts: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The parity bitmaps of the sets that are not empty, as words of 64 bits, and the number of samples in each."""
    doc = np.repeat(np.arange((counts > 0).sum()), counts[counts > 0])
    part = sets >> np.uint64(64 - s.ranges.bit_length() + 1)
    first = np.ones(len(sets), dtype=bool)  # sets are sorted: the least hash of a range comes first
    first[1:] = (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])
    doc, picked = doc[first], sets[first]
    n = int((counts > 0).sum())
    bit = (mix(picked) % np.uint64(64 * s.sketch_words)).astype(np.int64)
    odd = np.zeros((n, s.sketch_words), dtype=np.uint64)
    place = doc * (64 * s.sketch_words) + bit
    places, times = np.unique(place, return_counts=True)
    places = places[times % 2 == 1]
    np.bitwise_or.at(odd.ravel(), places >> 6, np.uint64(1) << (places & 63).astype(np.uint64))
    return odd.view(np.int64), np.bincount(doc, minlength=n)


def signatures(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id and text to a hash of the text, n_shingles, the set's digest (null if empty), its bands and its sketch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_bands = s.samples // s.band
        for batch in batches:
            sets, counts = shingles(texts_of(batch.column(1)), s.shingle)
            full = counts > 0
            ends = np.cumsum(counts)[full].tolist()
            digests = [xxhash.xxh3_128_digest(sets[e - n : e].tobytes()) for e, n in zip(ends, counts[full].tolist(), strict=True)]
            got = samples(sets, counts, s)
            offsets = np.concatenate([[0], np.cumsum(full)])
            digest, at = [], iter(digests)
            for f in full.tolist():
                digest.append(next(at) if f else None)
            band = pa.ListArray.from_arrays(pa.array(offsets * n_bands, pa.int32()), pa.array(bands(got, s).ravel(), pa.int64()))
            maps, picked = odd_sketches(sets, counts, s)
            sketch = pa.ListArray.from_arrays(pa.array(offsets * s.sketch_words, pa.int32()), pa.array(maps.ravel(), pa.int64()))
            n_picked = np.zeros(batch.num_rows, dtype=np.int64)
            n_picked[full] = picked
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts), pa.array(digest, pa.binary()), band, sketch, pa.array(n_picked)], names=["doc_id", "text_hash", "n_shingles", "digest", "bands", "sketch", "picked"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit("")))).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, digest binary, bands array<long>, sketch array<long>, picked long")


def alike(s: Settings) -> F.Column:
    """Whether sizes, sketches and, for large sets, the estimate less the slack allow for the similarity."""
    bits = sum((F.bit_count(F.col("sketch_a")[k].bitwiseXOR(F.col("sketch_b")[k])) for k in range(s.sketch_words)), F.lit(0))
    width = 64.0 * s.sketch_words
    differ = F.log(F.greatest(F.lit(1.0) - 2.0 * bits / width, F.lit(1e-9))) / float(np.log(1 - 2 / width))
    bar = s.percent / 100 - s.slack
    filled = s.ranges * (1 - F.exp(-(F.col("size_a") + F.col("size_b")) / ((1 + bar) * s.ranges)))  # by the union, at the bar
    sizes, hidden = F.col("size_a") + F.col("size_b"), F.col("size_a") + F.col("size_b") - F.col("picked_a") - F.col("picked_b")
    near = (100 * F.least("size_a", "size_b") >= s.percent * F.greatest("size_a", "size_b")) & ((bits - F.least(hidden, F.ceil(bits / 2))) * (100 + s.percent) <= sizes * (100 - s.percent))
    return near & ((sizes < s.estimated) | (F.col("picked_a") + F.col("picked_b") - differ >= 2 * bar * filled))


def confirmed(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough. texts: digest, text."""
    both = pairs.join(texts.select(F.col("digest").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("digest").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second, keep = texts_of(batch.column(2)), texts_of(batch.column(3)), []
            for lo in range(0, len(first), 256):
                x_sets, x_counts = shingles(first[lo : lo + 256], s.shingle)
                y_sets, y_counts = shingles(second[lo : lo + 256], s.shingle)
                for x_end, nx, y_end, ny in zip(np.cumsum(x_counts).tolist(), x_counts.tolist(), np.cumsum(y_counts).tolist(), y_counts.tolist(), strict=True):
                    all_ = len(np.union1d(x_sets[x_end - nx : x_end], y_sets[y_end - ny : y_end]))
                    keep.append(100 * (nx + ny - all_) >= s.percent * all_)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """The smallest node that each node of links (a, b) reaches, as node, comp.

    Labels go along links and are shortened by following each label's own label; each step is a table of its own, and
    as labels at least halve their distance, there are few.
    """
    both = scratch.table(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("comp")))
    while True:
        offered = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("offer"))
        near = labels.join(offered, "node").withColumn("next", F.least("comp", "offer"))
        ahead = labels.select(F.col("node").alias("next"), F.col("comp").alias("jump"))
        stepped = scratch.table(near.join(ahead, "next").select("node", F.col("comp").alias("was"), F.least("next", "jump").alias("comp")))
        moved = not stepped.filter("was != comp").isEmpty()
        scratch.drop(labels)
        labels = stepped
        if not moved:
            scratch.drop(both)
            return labels


def relabelled(scratch: Scratch, labels: DataFrame, found: DataFrame) -> DataFrame:
    """labels (digest, weight, comp) after links (a, b) between classes: only components are joined, not classes anew."""
    own = labels.select("digest", "comp")
    ends = found.join(own.select(F.col("digest").alias("a"), F.col("comp").alias("ca")), "a").join(own.select(F.col("digest").alias("b"), F.col("comp").alias("cb")), "b")
    merged = components(scratch, ends.filter("ca != cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    new = scratch.table(labels.join(merged.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("digest", "weight", F.coalesce("to", "comp").alias("comp")))
    scratch.drop(labels, merged)
    return new


def near_classes(scratch: Scratch, signed: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """digest, comp of all classes that share a bucket with others. signed: the table of signatures."""
    n_bands = s.samples // s.band
    firsts = [F.first(c).alias(a) for c, a in (("n_shingles", "size"), ("picked", "picked"), ("bands", "bands"), ("sketch", "sketch"))]
    classes = scratch.table(signed.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), *firsts))
    keys = scratch.table(classes.select("digest", F.posexplode("bands").alias("band", "key")).select("digest", "band", F.xxhash64("band", "key").alias("key")))
    shared, counts = scratch.recurring(keys, "key")
    buckets = scratch.table(shared)
    labels = scratch.table(buckets.join(counts, "key").groupBy("digest").agg(F.sum("n").alias("weight"), F.first("digest").alias("comp")))
    some = scratch.table(classes.join(labels.select("digest"), "digest"))
    scratch.drop(classes, keys, counts)
    source = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text")).filter("rep IS NOT NULL")
    texts = scratch.table(one_text(some, source, s))
    sketched = ["digest", "size", "picked", "sketch"]
    left, right = (some.select(*[F.col(c).alias(x if c == "digest" else f"{c}_{x}") for c in sketched]) for x in "ab")
    for k in range(s.rounds + 1):
        marked = scratch.table(buckets.join(labels, "digest"))
        lead = F.col("weight") if k == 0 else F.xxhash64("digest", F.lit(k))
        hub = F.max(F.struct(lead.alias("lead"), F.col("digest").alias("hub"), F.col("comp").alias("hub_comp"))).alias("m")
        open_keys = scratch.table(marked.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"), hub).filter("lo != hi").select("key", "n", "m.*"))
        if open_keys.isEmpty():
            scratch.drop(marked, open_keys)
            break
        if k < s.rounds:
            best = F.max(F.struct("lead", "hub")).alias("m")
            stars = marked.join(open_keys, "key").filter("comp != hub_comp").groupBy("digest").agg(best).select(F.least("digest", "m.hub").alias("a"), F.greatest("digest", "m.hub").alias("b"))
            pairs = stars.distinct().join(left, "a").join(right, "b").filter(alike(s)).select("a", "b")
        else:
            rest = scratch.table(marked.join(open_keys.select("key", "n"), "key").join(some.select(*sketched, "bands"), "digest"))
            pairs = across(rest.filter(F.col("n") <= s.joined), n_bands, s).unionByName(in_blocks(rest.filter(F.col("n") > s.joined), s))
        found = scratch.table(confirmed(pairs, texts, s))
        if not found.isEmpty():
            labels = relabelled(scratch, labels, found)
        scratch.drop(marked, open_keys, found)
    scratch.drop(buckets, some, texts)
    return labels


def across(rest: DataFrame, n_bands: int, s: Settings) -> DataFrame:
    """Pairs (a, b) across components of a bucket that sizes and sketches allow to be links, each in the first band that both share.

    Of two sets that are links one has at least `percent` of the other's size, so buckets are split at powers of that
    ratio: the larger set of a pair is looked up in its own class of sizes and the one below.
    """
    size_class = F.floor(F.log("size") / float(np.log(100 / s.percent)) - 1e-9).cast("int")
    kept = ["key", "band", "comp", "bands", "digest", "size", "picked", "sketch"]
    x, y = (rest.withColumn("at", size_class).select("at", *[F.col(c).alias(f"{c}_{p}") for c in kept]) for p in "ab")
    y = y.withColumn("at", F.explode(F.array("at", F.col("at") - 1)))
    first = F.when(F.col("bands_a")[0] == F.col("bands_b")[0], 0)
    for k in range(1, n_bands):
        first = first.when(F.col("bands_a")[k] == F.col("bands_b")[k], k)
    ordered = (F.col("size_a") < F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("digest_a") < F.col("digest_b")))
    near = (x["key_a"] == y["key_b"]) & (x["at"] == y["at"]) & ordered & (F.col("comp_a") != F.col("comp_b")) & alike(s) & (first == F.col("band_a"))
    return x.join(y, near).select(F.col("digest_a").alias("a"), F.col("digest_b").alias("b"))


def in_blocks(rest: DataFrame, s: Settings) -> DataFrame:
    """What `across` gives, for buckets (key, n classes) that are large: a bucket's classes are dealt to blocks of about `block`, and a task compares two blocks."""
    blocks_ = F.ceil(F.col("n") / s.block).cast("int")
    rows = rest.withColumn("own", F.pmod(F.xxhash64("digest", F.lit(3)), blocks_).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks_ - 1)))
    kept = ["key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "band", "comp", "digest", "size", "picked", "sketch", "bands"]
    width, bar = 64.0 * s.sketch_words, s.percent / 100 - s.slack

    def possible(bits: np.ndarray, size: np.ndarray, hidden: np.ndarray) -> np.ndarray:
        return (bits - np.minimum(hidden, (bits + 1) // 2)) * (100 + s.percent) <= size * (100 - s.percent)

    def near(batch: pa.Table) -> Iterator[tuple[list[bytes], list[bytes]]]:
        columns = {c: batch[c].combine_chunks() for c in ("own", "comp", "digest", "size", "picked", "sketch", "bands")}
        size = columns["size"].to_numpy()
        order = np.argsort(size, kind="stable")
        size, picked, own = size[order], columns["picked"].to_numpy()[order], columns["own"].to_numpy()[order]
        sketch = columns["sketch"].flatten().to_numpy().reshape(len(size), -1).view(np.uint64)[order]
        bands_ = columns["bands"].flatten().to_numpy().reshape(len(size), -1)[order]
        codes: dict[bytes, int] = {}
        comp = np.array([codes.setdefault(c, len(codes)) for c in columns["comp"].to_pylist()])[order]
        digest, band, across_ = np.array(columns["digest"].to_pylist(), dtype=object)[order], batch["band"][0].as_py(), batch["i"][0].as_py() != batch["j"][0].as_py()
        few = max(1, s.sketch_words // 4)
        for lo in range(0, len(size), 32):
            a = np.arange(lo, min(lo + 32, len(size)))
            b = np.arange(lo, np.searchsorted(size, 100 * size[a[-1]] // s.percent, side="right"))
            both, hidden = size[a][:, None] + size[b], size[a][:, None] + size[b] - picked[a][:, None] - picked[b]
            ok = (b > a[:, None]) & (comp[a][:, None] != comp[b]) & (100 * size[a][:, None] >= s.percent * size[b])
            if across_:
                ok &= own[a][:, None] != own[b]
            if not ok.any():
                continue
            some = np.bitwise_count(sketch[a, None, :few] ^ sketch[None, b, :few]).sum(axis=2, dtype=np.int64)
            x, y = np.nonzero(ok & possible(some, both, hidden))  # a part of the bits rejects most
            bits, both, hidden = np.bitwise_count(sketch[a[x]] ^ sketch[b[y]]).sum(axis=1, dtype=np.int64), both[x, y], hidden[x, y]
            differ = np.log(np.maximum(1 - 2 * bits / width, 1e-9)) / np.log(1 - 2 / width)
            filled = s.ranges * (1 - np.exp(-both / ((1 + bar) * s.ranges)))
            keep = possible(bits, both, hidden) & ((both < s.estimated) | (picked[a[x]] + picked[b[y]] - differ >= 2 * bar * filled))
            x, y = a[x[keep]], b[y[keep]]
            first = (bands_[x] == bands_[y]).argmax(axis=1) == band
            yield digest[x[first]].tolist(), digest[y[first]].tolist()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                for a, b in near(pa.Table.from_batches(held)):
                    if a:
                        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
                held.clear()

        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)], axis=1)
            cuts = (np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if lo == hi:
                    continue
                if (group := tuple(keys[lo].tolist())) != now:
                    yield from done()
                    now = group
                held.append(batch.slice(lo, hi - lo))
        yield from done()

    return rows.select(*kept).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a binary, b binary")


def one_text(some: DataFrame, source: DataFrame, s: Settings) -> DataFrame:
    """A text of each class. Rows of one id may differ, so each is held against its class's digest."""
    rows = source.join(some.select("rep", "digest"), "rep").select("digest", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, counts = shingles(texts_of(batch.column(1)), s.shingle)
            ends = np.cumsum(counts).tolist()
            same = [xxhash.xxh3_128_digest(sets[e - n : e].tobytes()) == d for e, n, d in zip(ends, counts.tolist(), batch.column(0).to_pylist(), strict=True)]
            yield batch.filter(pa.array(same, pa.bool_()))

    return rows.mapInArrow(run, "digest binary, text string").dropDuplicates(["digest"])


def groups(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id and text to doc_id, n_shingles, component_id, text_hash and kept: one row a row."""
    scratch = Scratch(docs.sparkSession, "minhash")
    signed = scratch.table(signatures(docs, s))
    labels = near_classes(scratch, signed, docs, s)
    slim = signed.select("doc_id", "n_shingles", "text_hash", "digest")
    firsts = slim.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("class_id"))
    classes = firsts.join(labels, "digest", "left").withColumn("comp", F.coalesce("comp", "digest"))
    smallest = classes.groupBy("comp").agg(F.min("class_id").alias("component_id"))
    named = scratch.table(classes.join(smallest, "comp").select("digest", "component_id"))
    linked = slim.join(named, "digest").select("doc_id", "n_shingles", "component_id", "text_hash")
    alone = slim.filter("digest IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_hash")
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("doc_id").isNull() & F.col("component_id").isNull()))


def dedup(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of docs that are kept; of rows equal in doc_id and text, one."""
    none, own, text = F.lit((1 << 63) - 1), *fresh(docs.columns, "own_id", "own_text")
    kept = groups(docs, s).filter("kept").select(F.coalesce("doc_id", none).alias(own), F.col("text_hash").alias(text)).distinct()
    rows = docs.withColumns({own: F.coalesce(F.col("doc_id").cast("long"), none), text: F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    return rows.join(kept, [own, text], "left_semi").dropDuplicates([own, text]).select(*columns_of(docs))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(read_table(spark, sf_dir, "documents"), Settings(shingle=4))
