"""Very long texts, repeated rows, ties and empty training tables."""

import hashlib
import tracemalloc
import zlib

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm import audio, common, langid, minhash, packing, suffixes, toxicity
from tests.llm.test_dedup import brute

LONG = " ".join(f"word{k % 9973} and more" for k in range(150_000))  # beyond a block


def test_long_texts_are_grouped_whole(table):
    assert len(LONG) > common.BLOCK_BYTES
    texts = [LONG, LONG + " tail", LONG[: len(LONG) // 2], "short one here now", "short one here now"]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.groups(table(texts), minhash.Settings(shingle=4)).collect()}
    sets, label = brute(texts, 4, 80)
    assert [got[i] for i in range(5)] == [(len(s), c) for s, c in zip(sets, label, strict=True)]


def test_long_texts_lose_repeats_beyond_a_piece(table, monkeypatch):
    rng = np.random.default_rng(2)
    filler = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()
    shared = filler(600)
    texts = [filler(suffixes.PIECE + 1000) + shared + filler(50), filler(300) + shared + filler(10)]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffixes.digests(table(texts)).collect()}
    assert got == {0: (600, 1), 1: (600, 1)}


def test_sampling_of_windows_holds_little_at_a_time():
    rng = np.random.default_rng(5)
    draw = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8))
    for texts in ([draw(4000) for _ in range(1000)], [draw(4_000_000)]):
        tracemalloc.start()
        doc, leader, near, far = suffixes.runs(texts, 240)
        held = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert held < 32 << 20
        assert (far - near + 1).sum() >= sum(len(t) - 239 for t in texts) and (leader - far >= 0).all() and doc.max() == len(texts) - 1


def test_workers_free_memory_after_a_task(monkeypatch):
    freed = []
    monkeypatch.setattr(common.ctypes, "CDLL", lambda _: type("C", (), {"malloc_trim": staticmethod(freed.append)}))
    assert list(common.freeing(iter)([1, 2])) == [1, 2] and freed == [0]
    monkeypatch.setattr(common.ctypes, "CDLL", lambda _: object())
    assert list(common.freeing(iter)([3])) == [3]


def test_long_texts_are_packed_whole(table):
    text = "many words, é and 12 more; " * 90_000
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = [*tok.encode(text, add_special_tokens=False).ids, 0]
    rows = sorted(packing.pack(table([text]), P.path("byte_bpe_50k.json"), P.PATTERN).collect(), key=lambda r: r["start"])
    assert len(text.encode()) > common.BLOCK_BYTES and sum(r["length"] for r in rows) == len(want) == rows[0]["doc_tokens"]
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(want[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes())


def test_long_recordings(table):
    text = "sound " * 60_000
    got = audio.digests(table([text, text, None])).collect()
    payload = audio.payload_of(text.encode())
    rows = {r["doc_id"]: r for r in got}
    assert len(payload) > 4 * audio.PIECE and rows[0]["payload_sha256"] == hashlib.sha256(payload).hexdigest()
    assert rows[0]["feature"] == rows[1]["feature"]
    s, x = audio.Settings(), (np.frombuffer(payload, dtype=np.uint8).astype(np.float32) - 128) / 128
    whole = audio.resample(x, s.up, s.down, s.taps)
    half = audio.resample(x[: len(x) // 2], s.up, s.down, s.taps)
    assert np.array_equal(whole[: len(half) - 100], half[:-100])  # pieces leave no seams


def test_languages_of_long_repeated_and_tied_texts(table):
    a, b = b"lorem ipsum dolor sit amet " * 40, b"quick brown fox jumps over " * 40
    model = langid.CompressionClassifier({"aa": a, "bb": b})
    long = (b"the quick brown fox jumps over it " * 2000).decode()
    out = {r["doc_id"]: (r["lang_pred"], r["score"], r["rejected"]) for r in langid.identify(table([long, long, "fox jumps over", "fox jumps over"]), model).collect()}
    assert len(long) > 3 * model.segment and out[0] == out[1] and out[0][0] == "bb" and out[2] == out[3]
    tied = langid.CompressionClassifier({"bb": a, "aa": a})
    assert tied.predict(b"lorem ipsum") == ("aa", 0.0, True) and tied.predict(long.encode())[:2] == ("aa", 0.0)
    assert langid.CompressionClassifier({"xx": a}).predict(b"anything") == ("xx", 1.0, False)


def test_language_without_training_rows(spark, table):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.fit_on_unheld(none)
    assert {(r["lang_pred"], r["score"], r["rejected"]) for r in langid.identify(table(["some text", None]), model).collect()} == {("und", 0.0, True)}


def test_samples_are_spread_over_whole_texts(spark):
    text = "".join(chr(97 + k // 2000) for k in range(52_000))
    got = spark.createDataFrame([(text,), ("short",), (None,)], "text string").select(langid.spread_over(F.col("text"), 4096, 8).alias("t")).collect()
    assert got[1]["t"] == "short" and got[2]["t"] is None and len(got[0]["t"]) == 8 * 512 + 7
    assert got[0]["t"][0] == "a" and got[0]["t"][-1] == "z" and len(set(got[0]["t"])) >= 8
    assert langid.dictionary([b"ab" * 3000, b"cd" * 3000], 6000).count(b"cd") > 1000


def test_toxicity_of_long_repeated_and_tied_rows(spark, table):
    words = [f"plain{k}" for k in range(300)]
    texts = [" ".join(words[(k * 7 + j) % 300] for j in range(30)) + (" badword" if k % 4 == 0 else "") for k in range(400)] + ["plain0 " * 50_000 + "badword"]
    docs = table(texts)
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(401)] + [(5, None), (7, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit_on_labels(docs, labels)
    assert max(model.weights, key=model.weights.get) in (b"badword", b"^bad", b"^badw", b"^badwo", b"^badwor", b"^badword")
    out = {r["doc_id"]: r for r in toxicity.score(table(["a badword here", "a badword here", "plain1 plain2", None, "x " * 1_500_000]), model).collect()}
    assert out[0]["severity"] == out[1]["severity"] > out[2]["severity"] and out[3]["severity"] <= out[2]["severity"] + 1e-9 and not out[4]["toxic"]
    assert toxicity.counted_words(b"a b c a " * 10, 2)[1] == 40 and len(toxicity.counted_words(b"a b c", 2)[0]) == 2
