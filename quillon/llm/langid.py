"""Language identification by compression.

Each language has a zstandard dictionary of raw content, a bounded sample of its training texts. A text is compressed
once with each dictionary, in segments so that a dictionary bears on all of a long text; the language whose dictionary
gives the fewest bytes wins (Benedetto, Caglioti and Loreto, "Language Trees and Zipping", 2002). The score is how much
shorter the best code is than the second best, as a share of the latter; a narrow margin is a rejection.

Texts too short for matches compress alike with all dictionaries. Texts of under `short` bytes, and ties of under
`settled` bytes, are coded by the bits of each byte after the four before it, counted in the same dictionaries (partial
matching, blended over shorter contexts). Under `short` bytes no margin is too narrow, and only a tie is rejected.

Sampling: languages are counted over all rows; a text joins the sample when the hash of its doc_id lies under a
threshold that lets about `sample_docs` of each language through, and at most that many are kept. Of a text longer than
`text_chars`, `segments` pieces spread evenly over the whole of it are taken; dictionaries take an equal share of each
text, again spread. These samples are all that the driver ever holds.

Cases: null text, or one without a letter: `und`, score 0, rejected; no training rows at all: `und`; one language
only: it, score 1; ties: the language that sorts first; repeated rows: each predicted alike; an empty table gives no
rows; null lang is never learned from; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import columns_of, fresh, map_arrow, read_table, texts_of

UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_TO_SPACE = bytes(b if chr(b).isalpha() and b < 128 or b >= 128 else 32 for b in range(256))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def plain(text: bytes) -> bytes:
    """Lower case, and one blank for what is no letter in ASCII."""
    return b" ".join(text.decode().lower().encode().translate(_TO_SPACE).split())


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text[:64].decode(errors="ignore")) or _LETTER.search(text.decode()) is not None


def spread_over(text: Column, chars: int, segments: int) -> Column:
    """Texts of up to `chars` characters whole, of longer ones as many characters in segments from start to end."""
    each = chars // segments
    at = lambda k: (F.length(text) - each) * k / (segments - 1) + 1
    pieces = [F.substring(text, at(k).cast("int"), F.lit(each)) for k in range(segments)]
    return F.when(text.isNull() | (F.length(text) <= chars), text).otherwise(F.concat_ws(" ", *pieces))


def dictionary(texts: list[bytes], most: int) -> bytes:
    """The texts, joined; of texts that are too long together, each loses bytes at the middle of its pieces alike."""
    size = sum(map(len, texts)) + len(texts)
    if size <= most:
        return b"\n".join(texts)
    out = []
    for t in texts:
        pieces = [t[i : i + 512] for i in range(0, len(t), 512)]
        out.append(b"".join(p[: max(1, len(p) * most // size - 1)] for p in pieces))
    return b"\n".join(out)


@dataclass
class CompressionClassifier:
    """Raw-content dictionaries by language."""

    dictionaries: dict[str, bytes]
    level: int = 3  # zstandard's, for dictionaries and all texts
    segment: int = 16_384
    narrow: float = 0.005
    short: int = 64
    settled: int = 4096
    context: int = 4
    _made: list = field(default_factory=list, repr=False)
    _counted: dict = field(default_factory=dict, repr=False)

    @classmethod
    def fit(cls, texts: DataFrame, sample_docs: int = 128, text_chars: int = 4096, segments: int = 8, dictionary_bytes: int = 98_304, **options) -> CompressionClassifier:
        """texts: doc_id, text and lang of the training rows."""
        rows = texts.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
        counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
        if not counts:
            return cls({}, **options)
        share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 2.0 * sample_docs / n))])
        spread = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
        some = rows.filter(spread < F.element_at(share, F.col("lang"))).select("lang", spread_over(F.col("text"), text_chars, segments).alias("text"), F.xxhash64("doc_id").alias("k"))
        some = some.orderBy("k").limit(4 * sample_docs * len(counts))
        chosen: dict[str, list[str]] = {}
        for r in sorted(some.collect(), key=lambda r: (r["k"], r["text"])):
            if len(own := chosen.setdefault(r["lang"], [])) < sample_docs:
                own.append(r["text"])
        return cls({lang: dictionary([plain(t.encode()) for t in own], dictionary_bytes) for lang, own in sorted(chosen.items())}, **options)

    def __getstate__(self):
        return {**self.__dict__, "_made": [], "_counted": {}}

    def _compressors(self) -> list[tuple[str, zstandard.ZstdCompressor]]:
        if not self._made:
            for lang, content in sorted(self.dictionaries.items()):
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=self.level)
                self._made.append((lang, zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))
        return self._made

    def _bits(self, text: bytes) -> list[tuple[float, str]]:
        """The bits of a short text by language, fewest first."""
        if not self._counted:
            for lang, content in self.dictionaries.items():
                content = b" " + content + b" "
                self._counted[lang] = Counter(content[i : i + k] for k in range(1, self.context + 2) for i in range(len(content) - k + 1))
        text, out = b" " + text + b" ", []
        for lang, n in self._counted.items():
            total, bits = len(self.dictionaries[lang]) + 2, 0.0
            for i in range(1, len(text)):
                p = (n[text[i : i + 1]] + 1 / 256) / (total + 1)
                for k in range(1, min(i, self.context) + 1):
                    p = (n[text[i - k : i + 1]] + p) / (n[text[i - k : i]] + 1)
                bits -= math.log2(p)
            out.append((bits, lang))
        return sorted(out)

    def predict(self, text: bytes | None) -> tuple[str, float, bool]:
        """The language, the score and whether it is rejected."""
        if not text or not self.dictionaries or not has_letter(text):
            return UNDETERMINED, 0.0, True
        text = plain(text)
        parts = [text] if len(text) <= self.segment else [text[i : i + self.segment] for i in range(0, len(text), self.segment)]
        sizes = sorted((sum(len(c.compress(p)) for p in parts), lang) for lang, c in self._compressors())
        if len(sizes) == 1:
            return sizes[0][1], 1.0, False
        if len(text) < self.short or sizes[0][0] == sizes[1][0] and len(text) < self.settled:
            sizes = self._bits(text)
        score = 1 - sizes[0][0] / sizes[1][0]
        return sizes[0][1], score, score < self.narrow if len(text) >= self.short else score == 0


def identify(docs: DataFrame, model: CompressionClassifier) -> DataFrame:
    """docs and the columns lang_pred, score and rejected, with underscores behind those that docs has."""
    names = docs.columns
    new_names = fresh(names, "lang_pred", "score", "rejected")
    given = docs.schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = names.index("text")
            got = [model.predict(t) for t in texts_of(batch.column(at))]
            new = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*names, *new_names])

    out = T.StructType([*given.fields, *map(T.StructField, new_names, (T.StringType(), T.DoubleType(), T.BooleanType()))])
    return map_arrow(docs, run, out)


def told(docs: DataFrame, model: CompressionClassifier) -> DataFrame:
    """The rows of docs that are not rejected."""
    rejected = fresh(docs.columns, "lang_pred", "score", "rejected")[2]
    return identify(docs, model).filter(~F.col(rejected)).select(*columns_of(docs))


def fit_on_unheld(docs: DataFrame, **options) -> CompressionClassifier:
    """Learns from the rows of documents that are not held out."""
    rows = docs.filter(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return CompressionClassifier.fit(rows, **options)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit_on_unheld(docs)
    found = identify(docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out")), model)
    return found.drop("text")
