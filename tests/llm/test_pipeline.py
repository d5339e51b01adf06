import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as cp
from quillon.llm import lines, suffixes
from quillon.llm.common import read_table
from tests.llm.conftest import ODD
from tests.llm.test_dedup import brute, brute_lines

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = read_table(spark, SF, "documents")
    names, given = [], docs
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, given, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        back = spark.read.parquet(f"{tmp_path}/{k}")
        names.append((name, back.count()))
        if k < len(cp.STAGES) - 1:
            assert back.columns == docs.columns
            assert back.join(given, "doc_id", "left_anti").count() == 0
            given = back
    assert [n for n, _ in names] == ["language_id", "line_dedup", "near_dedup", "passage_dedup", "packing"]
    sizes = [n for _, n in names[:-1]]
    assert docs.count() >= sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] > 100
    pieces = back.toPandas()
    assert set(pieces["doc_id"]) == {r["doc_id"] for r in given.select("doc_id").collect()}
    assert (pieces.groupby("sequence_id")["length"].sum() <= 1024).all()


def test_near_dedup_equals_brute_force(spark):
    docs = read_table(spark, SF, "documents")
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: r[0])
    _, label = brute([t for _, t in rows], 5, 80)
    got = {r["doc_id"] for r in cp.near_dedup(spark, docs, SF).select("doc_id").collect()}
    assert got == {i for k, (i, _) in enumerate(rows) if label[k] == k}


def test_line_dedup_equals_brute_force(spark):
    docs = read_table(spark, SF, "documents")
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: r[0])
    want = brute_lines([t for _, t in rows], lines.Settings())
    got = {r["doc_id"]: r["text"] for r in cp.line_dedup(spark, docs, SF).collect()}
    assert got == {i: w for (i, _), w in zip(rows, want, strict=True) if w}


def test_passage_dedup_equals_brute_force(spark):
    docs = read_table(spark, SF, "documents")
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    length, seen = suffixes.PASSAGE.length, Counter()
    for t in texts.values():
        seen.update(t[p : p + length] for p in range(len(t) - length + 1))
    got = {r["doc_id"]: r for r in cp.passage_dedup(spark, docs, SF).collect()}
    for i, t in texts.items():
        spans = suffixes.joined([(p, p + length) for p in range(len(t) - length + 1) if seen[t[p : p + length]] > 1])
        want = suffixes.kept_bytes(t, spans).decode(errors="ignore")
        assert got[i]["text"] == want and got[i]["n_chars"] == len(want) if want else i not in got


def test_passages_of_over_fifty_words_go(spark):
    """Passages planted into documents of the table: each is gone from all of them, and the others stay as they are."""
    rows = [r for r in read_table(spark, SF, "documents").filter("length(text) > 400").orderBy("doc_id").limit(40).collect()]
    draw = random.Random(4)
    passages = [" ".join("".join(draw.choice("abcdefghilmnoprstu") for _ in range(draw.randint(2, 8))) for _ in range(draw.randint(51, 60))) for _ in range(6)]
    planted = [(10_000 + k, f"{rows[k]['text'][:200]} own{k} {passages[k % 6]} {chr(65 + k)}end {rows[k]['text'][200:300]}", "en") for k in range(24)]
    alone = [(20_000 + k, " ".join(f"c{draw.randint(0, 10**6)}" for _ in range(80)), "en") for k in range(20)]
    docs = spark.createDataFrame(planted + alone, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["text"] for r in cp.passage_dedup(spark, docs, SF).collect()}
    assert all(got[i] == t for i, t, _ in alone)
    gone = [p[20:-20] not in got[i] for i, t, _ in planted for p in passages if p in t]
    assert len(gone) == 24 and all(gone) and all(f"own{k}" in got[10_000 + k] and f"{chr(65 + k)}end" in got[10_000 + k] for k in range(24))


def test_stages_of_odd_and_empty_tables(spark, table):
    odd = table([*ODD, *ODD]).unionByName(table(["one more text of some words"])).withColumn("rejected", F.lit(1))
    for name, stage in cp.STAGES:
        for docs in (odd, odd.filter("false")):
            out = stage(spark, docs, SF)
            assert name == "packing" or out.columns == odd.columns
            n = out.count()
            assert n == 0 if docs is not odd else n <= odd.count() or name == "packing"
