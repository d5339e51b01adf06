import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import ann, audio, langid, toxicity, warc
from quillon.llm.common import read_table
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.01"


def test_neighbours_against_brute_force(spark):
    got = ann.op5_nearest_neighbours(spark, SF).toPandas()
    rows = read_table(spark, SF, "embeddings").collect()
    ids, v = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=float)
    hit = total = 0
    for q, own in got.groupby("query_id"):
        dist = np.sqrt(((v - v[ids == q][0]) ** 2).sum(axis=1))
        best = [ids[k] for k in np.lexsort((ids, dist)) if ids[k] != q][:10]
        own = own.sort_values("rank")
        assert own["rank"].tolist() == list(range(1, len(own) + 1))
        assert np.array_equal(own["score"].to_numpy(), np.array([dist[ids == i][0] for i in own["vec_id"]]))
        hit, total = hit + len(set(best) & set(own["vec_id"])), total + len(best)
    assert total and hit / total >= 0.95


def test_neighbours_in_several_blocks(spark):
    rows = read_table(spark, "/root/testdata/sf0.1", "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    got = ann.search(rows, rows.filter(F.col("id") % 20 == 0), 10, ann.Settings(block_rows=300, sample_rows=200)).toPandas()
    data = rows.collect()
    ids, v = np.array([r["id"] for r in data]), np.array([r["v"] for r in data], dtype=float)
    hit = total = 0
    for q, own in got.groupby("query_id"):
        dist = np.sqrt(((v - v[ids == q][0]) ** 2).sum(axis=1))
        best = [ids[k] for k in np.lexsort((ids, dist)) if ids[k] != q][:10]
        hit, total = hit + len(set(best) & set(own["vec_id"])), total + len(best)
    assert total == 1000 and hit / total >= 0.93


def test_recall_and_work_over_fifty_thousand_vectors():
    rng, s = np.random.default_rng(8), ann.Settings()
    v = rng.standard_normal((50_000, 64))
    v[:2000] = v[2000:4000] + 0.1 * rng.standard_normal((2000, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    ids = rng.permutation(len(v))
    blocks = [ann.Index(ids[p], v[p], s) for p in np.array_split(rng.permutation(len(v)), 4)]
    sample = rng.permutation(len(v))[: s.sample_rows]
    first, hit, queries = ann.Index(ids[sample], v[sample], s), 0, range(0, 50_000, 1250)
    for q in queries:
        bound = first.nearest(v[q], ids[q], 10)[1][-1]
        got = [b.nearest(v[q], ids[q], 10, bound) for b in blocks]
        near, dist = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        true = np.argsort(((v - v[q]) ** 2).sum(axis=1))[1:11]
        hit += len(set(ids[true]) & set(near[np.argsort(dist)[:10]]))
    assert hit / (10 * len(queries)) >= 0.93
    assert sum(b.verified for b in blocks) / len(queries) / len(v) < 0.1


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [float("inf"), 1.0]), (8, [3.0, 4.0]), (9, [1.0]), (None, [1.0, 0.1])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.search(df, df, 2).collect()}
    assert got == {(0, 1): (1, 0.0), (0, 2): (2, 0.0), (1, 1): (0, 0.0), (1, 2): (2, 0.0), (2, 1): (0, 0.0), (2, 2): (1, 0.0), (8, 1): (0, 20**0.5), (8, 2): (1, 20**0.5)}
    assert ann.search(df.filter("false"), df.filter("false")).count() == 0


def test_toxic_texts_are_found(spark, table):
    docs = read_table(spark, SF, "documents")
    model = toxicity.fit_on_labels(docs, read_table(spark, SF, "labels"))
    assert len(model.thresholds) == 2 and model.thresholds[0] <= model.thresholds[1]
    worst = max(model.weights, key=model.weights.get).decode()
    out = {r["doc_id"]: r for r in toxicity.score(table([*ODD, f"You {worst}, {worst.upper()}!", "a clean text"]), model).collect()}
    assert out[len(ODD)]["p_toxic"] > out[len(ODD) + 1]["p_toxic"] and not out[len(ODD) + 1]["toxic"]
    assert all(0 <= r["severity"] <= 2 for r in out.values()) and not any(out[i]["toxic"] for i in range(len(ODD)))
    none = toxicity.fit_on_labels(docs, read_table(spark, SF, "labels").filter("false"))
    assert toxicity.score(table(["x"]), none).first()["severity"] == 0
    assert toxicity.score(table(["x"]).filter("false"), model).count() == 0


def test_held_out_toxicity(spark):
    docs, labels = read_table(spark, "/root/testdata/sf0.1", "documents"), read_table(spark, "/root/testdata/sf0.1", "labels")
    out = langid.held_out(F.col("doc_id"))
    model = toxicity.fit_on_labels(docs, labels.filter(~out))
    got = toxicity.score(docs.join(labels.filter(out), "doc_id", "left_semi"), model).join(labels.select("doc_id", F.col("toxic").alias("label")), "doc_id").toPandas()
    flagged = got[got["toxic"]]
    assert len(flagged) > 30 and flagged["label"].mean() > 0.95


def test_held_out_toxicity_by_language(spark):
    docs, labels = read_table(spark, "/root/testdata/sf0.1", "documents"), read_table(spark, "/root/testdata/sf0.1", "labels")
    out = langid.held_out(F.col("doc_id"))
    model = toxicity.fit_on_labels(docs, labels.filter(~out))
    held = docs.join(labels.filter(out).select("doc_id", F.col("toxic").alias("label")), "doc_id")
    got = toxicity.score(held, model).join(held.select("doc_id", "lang", "label"), "doc_id").toPandas()
    for lang, own in got.groupby("lang"):
        assert own[own["label"] == 1]["toxic"].mean() > 0.8, lang
        assert own[own["label"] == 0]["toxic"].mean() < 0.03, lang


def test_language_accuracy_on_held_out_rows(spark):
    got = langid.op9_language_id(spark, SF).join(read_table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.95 and got["score"].between(0, 1).all()


def test_language_of_odd_texts(table):
    model = langid.CompressionClassifier({"aa": b"lorem ipsum dolor sit amet " * 40, "bb": b"quick brown fox jumps over " * 40})
    out = {r["doc_id"]: r for r in langid.identify(table([*ODD, "the quick brown fox jumps over"]), model).collect()}
    assert out[len(ODD)]["lang_pred"] == "bb" and not out[len(ODD)]["rejected"]
    assert [out[i]["lang_pred"] for i in (0, 1, 2, 9)] == ["und"] * 4 and out[5]["lang_pred"] in ("aa", "bb")
    assert langid.identify(table(["x"]).filter("false"), model).count() == 0
    assert langid.CompressionClassifier({}).predict(b"text") == ("und", 0.0, True)


def test_short_texts_have_a_language(spark):
    docs = read_table(spark, "/root/testdata/sf0.1", "documents")
    short = docs.filter(langid.held_out(F.col("doc_id")) & (F.length("text") < 40))
    got = langid.identify(short, langid.fit_on_unheld(docs)).toPandas()
    for some in (got[got["text"].str.len() < 20], got[got["text"].str.len() >= 20]):
        assert len(some) > 5 and (some["lang_pred"] == some["lang"]).mean() > 0.9 and not some["rejected"].any()


def test_learning_ignores_held_out_rows(spark):
    rows = [(i, "held" * 30 if zlib.crc32(str(i).encode()) % 5 == 0 else "kept" * 30, "xx") for i in range(60)] + [(99, "kept", None), (98, None, "xx")]
    model = langid.fit_on_unheld(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert b"held" not in model.dictionaries["xx"] and b"kept" in model.dictionaries["xx"]


def test_audio_round_trip(table):
    texts = [*ODD, "x" * 192, "x" * 193]
    out = {r["doc_id"]: r for r in audio.digests(table(texts)).collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        p = b + b" " * (-len(b) % 192 or (192 if not b else 0))
        assert (out[i]["n_bytes"], out[i]["payload_bytes"], out[i]["payload_sha256"], out[i]["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert out[i]["media_sha256"] == hashlib.sha256(audio.to_wav(p, 16000)).hexdigest()
    assert out[7]["feature"] == out[8]["feature"] and audio.digests(table(["x"]).filter("false")).count() == 0


def test_audio_parts():
    x = np.random.default_rng(1).standard_normal(1000).astype(np.float32)
    for up, down in ((1, 2), (3, 4), (160, 147)):
        h, y = audio.low_pass(up, down, 16), audio.resample(x, up, down, 16)
        spread = np.zeros(len(x) * up + 5000)
        spread[: len(x) * up : up] = x
        full = np.convolve(spread, h.T.ravel())
        assert max(np.corrcoef(y[50:-50], full[o::down][: len(y)][50:-50])[0, 1] for o in range(16 * up)) > 0.999999
    assert audio.hysteresis(np.array([0, 1, 3, 1, 0, 1, 1, 0.0]), 2, 0.5) == [(1, 4)]
    with pytest.raises(ValueError):
        audio.from_wav(b"no wav at all")


def test_features_equal_a_direct_computation():
    s, rng = audio.Settings(), np.random.default_rng(4)
    for n in (192, 5000, 40_000):
        samples = rng.integers(0, 256, n, dtype=np.uint8)
        samples[n // 3 : n // 2] = 128 + rng.integers(-3, 4, n // 2 - n // 3)
        f = audio.analyse(samples.tobytes(), s.rate, s)
        x = (samples.astype(float) - 128) / 128
        y = audio.resample(x.astype(np.float32), s.up, s.down, s.taps).astype(float)  # test_audio_parts holds it against a convolution
        y = y - y.mean()
        y = np.pad(y, (0, max(0, s.frame - len(y))))
        rate, mel = s.rate * s.up / s.down, []
        for lo in range(0, len(y) - s.frame + 1, s.hop):
            power = np.abs(np.fft.fft(y[lo : lo + s.frame] * np.hanning(s.frame))[: s.frame // 2 + 1]) ** 2
            mel.append(np.log(np.maximum(power @ audio.mel_bank(rate, s.frame, s.bands).astype(float), s.floor)))
        assert np.allclose(f.mel, mel, atol=1e-3)
        energy, hot, runs = np.exp(np.array(mel)).sum(axis=1), False, []
        middle = np.median(energy)
        for k, e in enumerate([*energy, 0.0]):
            if e > s.lower * middle and not runs[-1:] == [None]:
                runs, hot = [*runs, k, None], False
            hot = hot or e > s.upper * middle
            if e <= s.lower * middle and runs[-1:] == [None]:
                runs[-2:] = [(runs[-2], k)] if hot else []
        hop = s.hop / rate
        assert f.segments == [(round(a * hop, 6), round((b - 1) * hop + s.frame / rate, 6)) for a, b in runs]
        parts = audio.feature_string(audio.stored(f, s)).split(";")
        assert parts[:2] == [str(len(mel)), str(len(runs))] and np.allclose([float(v) for v in parts[3].split(",")[: s.bands]], np.mean(mel, axis=0), atol=0.01)


def test_tensors(table):
    rows = audio.tensor_rows(table(["some text " * 2000, "b"])).toPandas()
    s = audio.Settings()
    t = audio.as_tensors(pa.array(rows["log_mel"].tolist(), pa.list_(pa.float32())))
    assert t.type.shape == [s.tensor_frames, s.bands] and (rows["end_s"] > rows["start_s"]).all() and len(rows) > 2


def test_warc_round_trip(spark, tmp_path):
    pages = [(5, "http://a/ b", "same"), (3, None, "same"), (9, "http://c", None), (8, "http://d", ""), (7, "http://é", "é" * 40_000), (None, "x", "same"), (3, "http://again", "same"), (None, "y", "alone")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    archives = warc.write_archives(df, archive_bytes=300)
    out = warc.read_archives(archives).collect()
    want = [(5, 4, "same", "revisit", 3), (3, 4, "same", "response", None), (9, 0, "", "revisit", 8), (8, 0, "", "response", None), (7, 80_000, "é" * 40_000, "response", None), (None, 4, "same", "revisit", 3), (3, 4, "same", "response", None), (None, 5, "alone", "response", None)]
    assert sorted(map(str, ((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["problem"]) for r in out))) == sorted(str((p, n, warc.sha1_base32(t.encode()), k, f, None)) for p, n, t, k, f in want)
    assert warc.read_archives(warc.write_archives(df.filter("false"))).count() == 0
    warc.export(archives, str(tmp_path))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert warc.read_archives(files).count() == len(pages)


def test_warc_damage_is_reported():
    good = warc.member(1, "http://a", b"payload", None, False, 6)
    import gzip

    broken = gzip.compress(gzip.decompress(good).replace(b"payload", b"paylaod"))
    records = list(warc.records(good + broken + good))
    assert [r.problem is None for r in records] == [True, False, True]
    plain = gzip.decompress(good)
    flipped = bytearray(good)
    flipped[len(flipped) // 2] ^= 0xFF
    damaged = [
        good[:-4],
        good[: len(good) // 2],
        bytes(flipped),
        b"trailing bytes",
        gzip.compress(plain.replace(b"Content-Length: 7", b"Content-Length: x", 1).replace(b"\r\nContent-Length: ", b"\r\nContent-Length: -", 1)),
        gzip.compress(plain.replace(b"urn:uuid:", b"urn:uuid:z")),
        gzip.compress(b"no header"),
        gzip.compress(b""),
    ]
    for bad in damaged:
        got = [warc.page_row(r) for r in warc.records(good + bad + good)]
        assert got[0] == got[-1] == warc.page_row(next(warc.records(good))) and got[0][5] is None and len(got) >= 3
        assert all(x[5] for x in got[1:-1])
    odd = gzip.compress(plain.replace(b"WARC-Date", b"WARC-\xff\xfe"))  # a header that is no UTF-8 is read as far as it is
    assert [warc.page_row(r)[:5] for r in warc.records(odd)] == [warc.page_row(next(warc.records(good)))[:5]]
    assert list(warc.records(b"")) == []


def test_common_payloads_are_broadcast(spark):
    pages = [(k, f"http://{k}", "error" if k % 3 else f"page {k % 12}") for k in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = [sorted(map(tuple, warc.read_archives(warc.write_archives(df, hot=hot)).select("page_id", "record_type", "refers_to").collect())) for hot in (5, 10_000)]
    first = {}
    want = []
    for k, _, html in pages:
        first.setdefault(html, k)
        want.append((k, "response", None) if first[html] == k else (k, "revisit", first[html]))
    assert rows[0] == rows[1] == want
