"""Line dedup with a log-template tree.

Every line is parsed along a tree of fixed depth (He, Zhu, Zheng and Lyu, "Drain: An Online Log Parsing Approach with
Fixed Depth Tree", 2017): the number of its tokens, then its leading tokens; a token that holds a digit, an address or
a link is a variable field and takes the wildcard's branch. A second tree is walked from the line's end, for fields among
the leading tokens. Drain merges templates as lines stream by, so its templates depend on their order. Here a leaf looks
at all of its different lines at once: a token that stands at its position in at least `share` of these, and in
`least_docs`, is constant, and any other is a variable field. So templates depend on nothing but the set of lines.

What recurs, and is dropped from all documents but that of the smallest doc_id, so that nothing vanishes from the corpus:

* a whole line of two or more tokens, fields and all, in at least `least_exact` different texts;
* a line whose fields of digits, addresses and links are wildcards, in at least `least_docs` different texts, if it has
  `least_tokens` constant tokens and no more variable ones than these;
* a leaf's template, in different lines of at least `least_docs` different texts, if it has `least_constants` constant
  tokens and these are two thirds of all.

Lines of one token always stay.

Texts are counted for each key by an aggregation that is dealt by key and text first, so a template in a third of all
lines is no task's burden. Leaves that hold several lines are marked in a bitmap of fixed size, which all tasks get; a
leaf that shares another's bit is looked at in vain. Only the different lines of such leaves are taken apart, each once.

Cases: a null text stays null, an empty one empty; blank lines stay; a text whose lines all go becomes empty and its
row stays; repeated rows are one text; rows with null doc_id count, and never keep a recurring line unless all are
null; an empty table gives no rows; other columns, whatever their names, are kept as they are by `dedup`.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import Scratch, columns_of, fresh, map_arrow, read_table, texts_of

WILDCARD = b"<*>"
_VARIABLE = re.compile(rb"[0-9@]|://")
#: Kinds of keys, in their lowest two bits.
EXACT, MASKED, AHEAD, BEHIND = range(4)
ROW = ["quillon_id", "quillon_text"]


@dataclass(frozen=True)
class Settings:
    leading: int = 3
    least_tokens: int = 3
    least_constants: int = 5
    least_docs: int = 8
    least_exact: int = 3
    share: float = 0.125
    bitmap: int = 1 << 23  # bits


def key_of(kind: int, n: int, tokens: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(tokens, n) & ~3 | kind
    return h - (1 << 64) if h >> 63 else h


def masked(line: bytes, tokens: list[bytes]) -> list[bytes]:
    """The tokens, variable fields as wildcards."""
    return [WILDCARD if _VARIABLE.search(t) else t for t in tokens] if _VARIABLE.search(line) else tokens


def whole_keys(line: bytes, tokens: list[bytes], fields: list[bytes], s: Settings) -> list[int]:
    """Keys of a line of two or more tokens itself and of its masked form."""
    n = len(tokens)
    keys = [key_of(EXACT, n, b" ".join(tokens))]
    if fields is not tokens:
        constants = n - fields.count(WILDCARD)
        if constants >= s.least_tokens and 2 * constants >= n:  # a line of numbers says nothing about its template
            keys.append(key_of(MASKED, n, b" ".join(fields)))
    return keys


def leaf_keys(fields: list[bytes], s: Settings) -> list[int]:
    """The line's leaves in both trees, if it is long enough to have constants and a field."""
    n = len(fields)
    if n <= s.least_constants:
        return []
    return [key_of(AHEAD, n, b" ".join(fields[: s.leading])), key_of(BEHIND, n, b" ".join(fields[-s.leading :]))]


def parsed(text: bytes) -> Iterator[tuple[int, bytes, list[bytes], list[bytes]]]:
    """Number, line, tokens and masked tokens of all lines of two or more tokens."""
    for k, line in enumerate(text.split(b"\n")):
        tokens = line.split()
        if len(tokens) > 1:
            yield k, line, tokens, masked(line, tokens)


def keyed(docs: DataFrame, own: str = ROW[0], digest: str = ROW[1]) -> DataFrame:
    """docs and, to tell rows apart, a hash of the text."""
    return docs.withColumns({own: F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), digest: F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})


def per_document(docs: DataFrame, work, schema: str, names: list[str]) -> DataFrame:
    """Rows of id, text hash and what `work` makes of the text, a list of tuples."""
    types = [pa.int64(), pa.int64(), *({"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}[t] for t in schema.split(", "))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2)), strict=True):
                rows += [(i, h, *x) for x in work(t)]
                if len(rows) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[*ROW, *names])
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[*ROW, *names])

    given = ", ".join(f"{n} {t}" for n, t in zip([*ROW, *names], ["long", "long", *schema.split(", ")], strict=True))
    return keyed(docs).select(*ROW, F.col("text").cast("string")).mapInArrow(run, given)


def counted(docs: DataFrame, s: Settings) -> DataFrame:
    """key, n (different texts) and first_id of recurring lines, recurring masked lines, and leaves that may have templates."""

    def work(text: bytes) -> Iterable[tuple[int, int]]:
        found: dict[int, int] = {}
        for _, line, tokens, fields in parsed(text):
            whole = whole_keys(line, tokens, fields, s)
            for k in whole:
                found[k] = whole[0]
            for k in leaf_keys(fields, s):
                found[k] = whole[0]
        return found.items()

    once = per_document(docs, work, "long, long", ["key", "line"])
    every = once.groupBy("key").agg(F.count_distinct("quillon_text").alias("n"), F.min("quillon_id").alias("first_id"), F.min("line").alias("lo"), F.max("line").alias("hi"))
    kind = F.col("key").bitwiseAND(3)
    enough = F.when(kind == EXACT, F.col("n") >= s.least_exact).otherwise(F.col("n") >= s.least_docs)
    return every.filter(enough & ((kind < AHEAD) | (F.col("lo") != F.col("hi")))).select("key", "n", "first_id")


def bits_of(leaves: DataFrame, size: int) -> np.ndarray:
    """A bitmap of keys: at most size / 64 words, whatever the number of keys."""
    at = F.pmod(F.shiftright("key", 2), F.lit(size))
    words = leaves.groupBy(F.shiftright(at, 6).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(shiftright(key, 2), {size}) & 63 AS INT))")).alias("bits")).collect()
    out = np.zeros(size // 64, dtype=np.int64)
    out[[w["word"] for w in words]] = [w["bits"] for w in words]
    return np.unpackbits(out.astype("<i8").view(np.uint8), bitorder="little")


def template_lines(scratch: Scratch, docs: DataFrame, leaves: DataFrame, s: Settings) -> DataFrame:
    """key (of a whole line) and first_id (of its template) of the lines whose leaf gives them a recurring template."""
    spark, bits = docs.sparkSession, bits_of(leaves, s.bitmap)
    shared = spark.sparkContext.broadcast(np.packbits(bits))

    def work(text: bytes) -> Iterable[tuple[int, int, list[int]]]:
        marks, out = shared.value, []
        for _, line, tokens, fields in parsed(text):
            for leaf in leaf_keys(fields, s):
                at = (leaf >> 2) % s.bitmap
                if marks[at >> 3] >> (7 - (at & 7)) & 1:
                    hashes = [0 if t is WILDCARD else key_of(0, 0, t) for t in fields]
                    out.append((key_of(EXACT, len(tokens), b" ".join(tokens)), leaf, hashes))
        return out

    rows = per_document(docs, work, "long, long, array<long>", ["key", "leaf", "tokens"])
    one = F.min(F.struct("quillon_id", "quillon_text", "tokens")).alias("one")
    different = scratch.table(rows.groupBy("leaf", "key").agg(one).select("leaf", "key", "one.*"))
    sizes = scratch.table(different.groupBy("leaf").agg(F.count("*").alias("size")).filter(F.col("size") >= s.least_docs))
    tokens = different.select("leaf", F.posexplode("tokens").alias("place", "token")).filter("token != 0").groupBy("leaf", "place", "token").agg(F.count("*").alias("n")).filter(F.col("n") >= s.least_docs)
    constant = tokens.join(sizes, "leaf").filter(F.col("n") >= F.col("size") * s.share)
    constants = scratch.table(constant.groupBy("leaf", "size").agg(F.collect_list("place").alias("places"), F.collect_list("token").alias("constants")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            templates = []
            for leaf, own, places, constants in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
                known = set(zip(places, constants, strict=True))
                kept = [t if (k, t) in known else 0 for k, t in enumerate(own)]
                n = len(kept) - kept.count(0)
                text = np.array([leaf, *kept], dtype=np.int64).tobytes()
                templates.append(key_of(leaf & 3, len(kept), text) if n >= s.least_constants and 3 * n >= 2 * len(kept) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(templates, pa.int64()), batch.column(6)], names=["key", "quillon_id", "template", "quillon_text"])

    # constants of the few largest leaves, each of over a thousandth of the lines, are broadcast
    most = max(10_000, (sizes.agg(F.sum("size")).first()[0] or 0) // 1000)
    hot, rest = F.broadcast(constants.filter(F.col("size") > most)), constants.filter(F.col("size") <= most)
    both = different.join(hot, "leaf").unionByName(different.join(rest, "leaf"))
    made = scratch.table(both.select("key", "quillon_id", "leaf", "tokens", "places", "constants", "quillon_text").mapInArrow(run, "key long, quillon_id long, template long, quillon_text long").filter("template IS NOT NULL"))
    recurring = made.groupBy("template").agg(F.count_distinct("quillon_text").alias("n"), F.min("quillon_id").alias("first_id")).filter(F.col("n") >= s.least_docs)
    return made.join(scratch.table(recurring), "template").select("key", "first_id").distinct()


def recurring(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Keys of recurring lines, masked lines and lines of recurring templates, each with the document that keeps it."""
    scratch = Scratch(docs.sparkSession, "templates")
    keys = scratch.table(counted(docs, s))
    kind = F.col("key").bitwiseAND(3)
    return keys.filter(kind < AHEAD).select("key", "first_id").unionByName(template_lines(scratch, docs, keys.filter(kind >= AHEAD), s))


def dropped_lines(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Numbers of the lines that each document loses, once a document and text."""
    keys = Scratch(docs.sparkSession, "lines").table(recurring(docs, s))

    def work(text: bytes) -> Iterable[tuple[int, int]]:
        return [(key, k) for k, line, tokens, fields in parsed(text) for key in whole_keys(line, tokens, fields, s)]

    every = per_document(docs, work, "long, int", ["key", "line"])
    hits = every.join(keys, "key").filter("quillon_id != first_id").select(*ROW, "line")
    return hits.groupBy(*ROW).agg(F.collect_set("line").alias("quillon_lines"))


def dedup(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs with recurring lines cut from `text`; also n_lines and n_dropped (with underscores behind, if docs has these)."""
    names = docs.columns
    own, digest, cut, n_lines, n_dropped = fresh(names, "own_id", "own_text", "own_lines", "n_lines", "n_dropped")
    cuts = dropped_lines(docs.select("doc_id", "text"), s).withColumnsRenamed({ROW[0]: own, ROW[1]: digest, "quillon_lines": cut})
    joined = keyed(docs, own, digest).join(cuts, [own, digest], "left").select(*columns_of(docs), cut)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            texts, lines, gone = [], [], []
            for t, cut in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                own = [] if t is None else t.split("\n")
                cut = set(cut or ())
                texts.append(t if not cut else "\n".join(x for n, x in enumerate(own) if n not in cut))
                lines.append(len(own))
                gone.append(len(cut))
            columns = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int32()), pa.array(gone, pa.int32())], names=[*names, n_lines, n_dropped])

    fields = [T.StructField("text", T.StringType()) if f.name == "text" else f for f in docs.schema.fields]
    return map_arrow(joined, run, T.StructType([*fields, T.StructField(n_lines, T.IntegerType()), T.StructField(n_dropped, T.IntegerType())]))


def op4_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
