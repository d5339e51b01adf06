"""Toxicity by cumulative-link ordinal regression.

Labels say whether a text is toxic; severity is graded 0 where it is not, 1 where it is, and 2 where a toxic text has
at least the median number of the words that a first fit finds. Features are whole words and the beginnings of words, of
3 to 8 characters that several words share, as rare words are learned only by what they share. One weight a feature is shared by all thresholds
(McCullagh, "Regression Models for Ordinal Data", 1980):
P(grade >= j) = 1 / (1 + exp(threshold_j - sum of weight * count / sqrt(length))), where count is how many of the text's
words have the feature, and length the text's words in units of `unit`, 1 at least: chance hits add up in long
texts. Weights are fitted with an L1 penalty by accelerated proximal gradient on a bounded sample of labelled rows; the
penalty of a feature is `deviations` times the deviation that its gradient has by chance, so that rare features need no
more evidence than common ones. All features of positive weight are fitted once more with a tenth of the penalty (relaxed
lasso), as a penalty that keeps chance words out also shrinks the weights of the true ones; thresholds carry none. Every
whole text is then scored by its words' weights.

Sampling: labels are counted over all labelled rows; hash thresholds let about `sample_rows` / 2 of each through,
and rows weigh as many as they stand for. The sampled labels are broadcast, and executors turn the sampled texts into
counted words; of a text with more than `most_words` different words, those of the least hashes are learned from. Only
these counts go to the driver, at most 2 * `sample_rows` rows, each as one text and one array.

Cases: a null or empty text has no words and so the severity of the thresholds alone; no labelled rows: severity 0 for
all; no toxic row: likewise; repeated rows score alike; a doc_id with several labels counts as toxic if one says so;
null labels are not learned from; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import read_table, texts_of

_TO_SPACE = bytes(b if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Words in lower case; what is no letter or digit in ASCII divides words."""
    return text.decode().lower().encode().translate(_TO_SPACE).split()


def features(word: bytes, shortest: int = 3, longest: int = 8) -> list[bytes]:
    """The word and its beginnings, which a sign that words cannot hold marks."""
    w = word.decode()
    return [word, *(b"^" + w[:k].encode() for k in range(shortest, min(longest, len(w)) + 1))]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    """Feature weights and ascending thresholds."""

    weights: dict[bytes, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)
    unit: float = 50.0
    _known: dict[bytes, float] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_known": {}}

    def _weight(self, word: bytes) -> float:
        """The weight of all features of a word; those of words met before are kept, up to a bound."""
        if (x := self._known.get(word)) is None:
            if len(self._known) >= 1 << 17:
                self._known.clear()
            x = self._known[word] = math.fsum(self.weights.get(f, 0.0) for f in features(word))
        return x

    def exceed(self, text: bytes) -> list[float]:
        """P(grade >= j) for j from 1."""
        own = words(text)
        x = math.fsum(map(self._weight, own)) / math.sqrt(max(1.0, len(own) / self.unit))
        return _sigmoid(x - np.array(self.thresholds)).tolist()

    @classmethod
    def fit(cls, counted: Iterable[dict[bytes, int]], lengths: list[int], toxic: list[int], stands_for: list[float], least_docs: int = 8, least_words: int = 4, deviations: float = 4.5, steps: int = 200) -> OrdinalModel:
        if not any(toxic):
            return cls({}, [])
        word_ids, ids, starts, own = {}, {}, [0], []
        flat = array("i")  # feature numbers, word by word
        for n_of in counted:
            for w in n_of:
                if w not in word_ids:
                    word_ids[w] = len(word_ids)
                    flat.extend(ids.setdefault(f, len(ids)) for f in features(w))
                    starts.append(len(flat))
            own.append((np.array([word_ids[w] for w in n_of], dtype=np.int32), np.array(list(n_of.values()), dtype=np.int32)))
        of_word, starts, n_own = np.array(flat, dtype=np.int32), np.array(starts), len(word_ids)
        del word_ids, flat

        def counts(ws: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The features of a text's words, and how many of these have each."""
            n = starts[ws + 1] - starts[ws]
            f, at = np.unique(of_word[np.repeat(starts[ws] - np.cumsum(n) + n, n) + np.arange(n.sum())], return_inverse=True)
            return f, np.bincount(at, weights=np.repeat(times, n), minlength=len(f))

        share, y = np.array(stands_for) / np.sum(stands_for), np.array(toxic)
        docs, weight, hits = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids)), np.zeros(len(ids))
        for (ws, times), s, t in zip(own, share, y, strict=True):
            f = counts(ws, times)[0]
            docs[f] += 1
            weight[f] += s
            hits[f] += s * t
        # a feature that is no commoner in toxic texts than in all cannot be a sign of them
        n_words = np.bincount(of_word, minlength=len(ids))  # a beginning of few words says nothing that these do not
        names = sorted(f for f, i in ids.items() if docs[i] >= least_docs and (n_words[i] >= least_words or not f.startswith(b"^")) and hits[i] > (share * y).sum() * weight[i])
        at, n_features = np.array([ids[f] for f in names], dtype=np.int64), len(ids)
        del ids
        column = np.full(n_features, -1, dtype=np.int64)
        column[at] = np.arange(len(names))
        rows, cols, values = [], [], []
        for i, (ws, times) in enumerate(own):
            f, k = counts(ws, times)
            k, f = k[column[f] >= 0], column[f[column[f] >= 0]]
            rows.append(np.full(len(f), i, dtype=np.int32))
            cols.append(f.astype(np.int32))
            values.append((k / math.sqrt(max(1.0, lengths[i] / cls.unit))).astype(np.float32))
        rows, cols, values = (np.concatenate(x) for x in (rows, cols, values))
        first = cls._fit(rows, cols, values, toxic, share, names, deviations, steps)
        kept = np.array([first.weights.get(f, 0) > 0 for f in names], dtype=bool)
        signs = np.zeros(n_features, dtype=bool)
        signs[at[kept]] = True
        tells = np.bincount(np.repeat(np.arange(n_own), np.diff(starts)), weights=signs[of_word], minlength=n_own) > 0
        found = [int(tells[ws].sum()) for ws, _ in own]
        middle = float(np.median([k for k, t in zip(found, toxic, strict=True) if t and k] or [0]))
        grades = [t and 1 + (k >= max(2, middle)) for t, k in zip(toxic, found, strict=True)]
        some = kept[cols] if len(names) else np.zeros(0, dtype=bool)
        return cls._fit(rows[some], (np.cumsum(kept) - 1)[cols[some]], values[some], grades, share, [f for f, k in zip(names, kept, strict=True) if k], deviations / 10, 5 * steps)

    @classmethod
    def _fit(cls, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: list[int], share: np.ndarray, names: list[bytes], deviations: float, steps: int) -> OrdinalModel:
        y, n, m = np.array(grades), len(grades), len(names)
        top = int(y.max())
        base = [float(np.clip((share * (y >= j)).sum(), 1e-6, 1 - 1e-6)) for j in range(1, top + 1)]
        theta = np.maximum.accumulate([np.log((1 - p) / p) for p in base])
        w, z, t = np.zeros(m), np.zeros(m), 1.0

        def summed(at: np.ndarray, size: int, of) -> np.ndarray:
            """Sums of of(slice) by at, slice by slice, so that nothing else of the matrix's size is held."""
            out = np.zeros(size)
            for lo in range(0, len(at), 1 << 20):
                part = slice(lo, lo + (1 << 20))
                out += np.bincount(at[part], weights=of(part), minlength=size)
            return out

        chance = np.sqrt(base[0] * (1 - base[0]) * summed(cols, m, lambda p: (share[rows[p]] * values[p]) ** 2))
        load = summed(rows, n, lambda p: values[p])
        rate = 2.0 / max(1e-6, summed(cols, m, lambda p: (share * load)[rows[p]] * values[p]).max(initial=0.0))  # by a bound on the curvature
        for _ in range(steps):
            x = summed(rows, n, lambda p: z[cols[p]] * values[p])  # noqa: B023
            # likelihood of a grade: the difference of neighbouring cumulative curves
            cum = np.concatenate([np.ones((n, 1)), _sigmoid(x[:, None] - theta), np.zeros((n, 1))], axis=1)
            slope = cum * (1 - cum)
            p = np.maximum(cum[np.arange(n), y] - cum[np.arange(n), y + 1], 1e-12)
            a, b = slope[np.arange(n), y] / p, slope[np.arange(n), y + 1] / p
            gx = -share * (a - b)
            g = summed(cols, m, lambda p: gx[rows[p]] * values[p])  # noqa: B023
            new = z - rate * g
            new = np.sign(new) * np.maximum(np.abs(new) - rate * deviations * chance, 0)
            t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
            z, w, t = new + (t - 1) / t_next * (new - w), new, t_next
            for j in range(top):  # a threshold lies below the grades from j + 1 on
                g_theta = (share * (a * (y == j + 1) - b * (y == j))).sum()
                theta[j] -= 2.0 * g_theta
            theta = np.maximum.accumulate(theta)
        return cls({k: float(v) for k, v in zip(names, w, strict=True) if v}, theta.tolist())


def counted_words(text: bytes, most: int) -> tuple[dict[bytes, int], int]:
    """A text's words and how many of each, of many those of the least hashes; and the number of all."""
    own = words(text)
    n = Counter(own)
    if len(n) > most:
        n = {w: n[w] for w in sorted(n, key=lambda w: (xxhash.xxh3_64_intdigest(w), w))[:most]}
    return dict(n), len(own)


def fit_on_labels(docs: DataFrame, labels: DataFrame, sample_rows: int = 9000, most_words: int = 1000) -> OrdinalModel:
    """docs: doc_id, text; labels: doc_id, toxic (0 or 1)."""
    grade = F.when(F.col("toxic") == 0, 0).when(F.col("toxic") > 0, 1)
    graded = labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade")).filter("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.max("grade").alias("grade"))
    counts = {r["grade"]: r["n"] for r in graded.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return OrdinalModel()
    each = sample_rows / len(counts)
    share = {g: min(1.0, each / n) for g, n in counts.items()}
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    some = graded.filter(spread < F.element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col("grade")))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample_rows)  # a bound that hashes hardly ever reach
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [counted_words(t, most_words) for t in texts_of(batch.column(2))]
            joined = [b" ".join(n).decode() for n, _ in got]
            times = [np.array(list(n.values()), dtype="<i4").tobytes() for n, _ in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(joined, pa.string()), pa.array(times, pa.binary()), pa.array([k for _, k in got], pa.int64())], names=["doc_id", "grade", "words", "times", "n_words"])

    rows = texts.join(F.broadcast(some), "doc_id").select("doc_id", "grade", "text").mapInArrow(run, "doc_id long, grade int, words string, times binary, n_words long")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "n_words", "words").limit(2 * sample_rows).collect()
    known = [(r["n_words"], r["grade"], 1 / share[r["grade"]]) for r in rows]
    rows.reverse()

    def counted() -> Iterator[dict[bytes, int]]:
        while rows:  # each row is let go once it is read
            r = rows.pop()
            yield dict(zip(r["words"].encode().split(), np.frombuffer(r["times"], dtype="<i4").tolist(), strict=True))

    return OrdinalModel.fit(counted(), *map(list, zip(*known, strict=True))) if known else OrdinalModel()


def score(docs: DataFrame, model: OrdinalModel, flag_at: float = 0.25) -> DataFrame:
    """doc_id and text to the expected severity, the likeliest grade and whether the text counts as toxic, which one clear word suffices for."""
    names = ["doc_id", "severity", "p_toxic", "grade", "toxic"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            severity, toxic, grade = [], [], []
            for t in texts_of(batch.column(1)):
                p = model.exceed(t)
                severity.append(sum(p))
                toxic.append(p[0] if p else 0.0)
                cum = [1.0, *p, 0.0]
                grade.append(max(range(len(p) + 1), key=lambda j: cum[j] - cum[j + 1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(severity, pa.float64()), pa.array(toxic, pa.float64()), pa.array(grade, pa.int32()), pa.array([x >= flag_at for x in toxic], pa.bool_())], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, severity double, p_toxic double, grade int, toxic boolean")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score(docs, fit_on_labels(docs, read_table(spark, sf_dir, "labels")))
