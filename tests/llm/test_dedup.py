import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from quillon.llm import langid, lines, minhash, suffixes
from tests.llm.conftest import ODD

rng = random.Random(5)


def words(n):
    return [f"w{rng.randint(0, 10**6)}" for _ in range(n)]


def edited(base, k):
    w = list(base)
    for _ in range(k):
        w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
    return " ".join(w)


BASE = words(120)
FAMILY = [edited(BASE, rng.choice([0, 1, 1, 2, 3, 5, 8, 12])) for _ in range(60)]
TEXTS = ODD + FAMILY + [" ".join(words(60)) for _ in range(20)] + ["A B c d", "a b C D", "a b", "A b"]


def brute(texts, n, percent):
    tr = {c: c + 32 for c in range(65, 91)}
    sets = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(tr))
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    label = list(range(len(texts)))
    changed = True
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            m = min(label[i], label[j])
            if label[i] != m or label[j] != m:
                label[i] = label[j] = m
                changed = True
    return sets, label


def test_groups_equal_brute_force(table):
    got = {r["doc_id"]: r for r in minhash.groups(table(TEXTS), minhash.Settings(shingle=4)).collect()}
    sets, label = brute(TEXTS, 4, 80)
    assert [(got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) for i in range(len(TEXTS))] == [(len(s), c, c == i) for i, (s, c) in enumerate(zip(sets, label, strict=True))]


def test_sketches_reject_no_link(spark):
    s, draw, rows = minhash.Settings(), np.random.default_rng(3), []
    for union, both, n in ((15, 12, 400), (20, 16, 400), (30, 24, 400), (50, 40, 400), (100, 80, 400), (800, 640, 300), (1500, 1200, 100), (3500, 2800, 50), (20_000, 16_000, 10)):
        for _ in range(n):
            e, half = draw.integers(0, 1 << 64, union, dtype=np.uint64), both + (union - both) // 2
            sets = [np.sort(e[:half]), np.sort(np.concatenate([e[:both], e[half:]]))]
            maps, picked = minhash.odd_sketches(np.concatenate(sets), np.array([len(x) for x in sets]), s)
            rows.append((union, *(len(x) for x in sets), *picked.tolist(), *maps.tolist()))
    pairs = spark.createDataFrame(rows, "union int, size_a long, size_b long, picked_a long, picked_b long, sketch_a array<long>, sketch_b array<long>")
    assert {r["union"]: r["count"] for r in pairs.filter(~minhash.alike(s)).groupBy("union").count().collect()} == {}
    assert pairs.withColumn("sketch_b", F.transform("sketch_b", lambda x: F.bitwise_not(x))).filter(minhash.alike(s) & (F.col("size_a") < 1000)).count() == 0


def test_dedup_keeps_one_of_each_group(table):
    df = table(["a b c d e f", "a b c d e f", "g h i j k l", None, ""]).unionByName(table(["a b c d e f"]))
    out = minhash.dedup(df).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in out) == [(0, "a b c d e f"), (2, "g h i j k l"), (3, ""), (4, "")]
    assert minhash.groups(df.filter("false")).count() == 0


def test_shingles_of_blocks_equal_single_texts():
    texts = [(t or "").encode() for t in TEXTS]
    sets, counts = minhash.shingles(texts, 4)
    alone = [minhash.shingles([t], 4)[0].tolist() for t in texts]
    assert [len(a) for a in alone] == counts.tolist() and sum(alone, []) == sets.tolist()


def passages(texts, length):
    count = {}
    data = [(t or "").encode() for t in texts]
    for t in data:
        for p in range(len(t) - length + 1):
            k = hashlib.md5(t[p : p + length]).digest()
            count[k] = count.get(k, 0) + 1
    out = []
    for t in data:
        spans = suffixes.joined([(p, p + length) for p in range(len(t) - length + 1) if count[hashlib.md5(t[p : p + length]).digest()] > 1])
        out.append((len(t), sum(b - a for a, b in spans), len(spans), hashlib.sha256(suffixes.kept_bytes(t, spans)).hexdigest()))
    return out


def test_removed_passages_equal_brute_force(table):
    shared, other = " ".join(words(90)), " ".join(words(90))
    texts = ODD + [" ".join(words(20)) + shared[a:b] + " ".join(words(9)) for a, b in ((0, 500), (10, 520), (60, 459), (60, 460), (0, 399))] + [other, other, "ab" * 700, "a" * 399, "a" * 400, other[:400] + "!" + other[30:480]]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.digests(table(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == passages(texts, 400)


def test_shorter_passages_are_told(table):
    shared = " ".join(words(45))[:300]
    texts = [" ".join(words(30)) + shared + " ".join(words(30)), shared[:250] + " ".join(words(9)), " ".join(words(60)), shared[:239], None]
    got = {r["doc_id"]: r for r in suffixes.digests(table(texts)).collect()}
    assert [got[i]["passage_bytes"] for i in range(5)] == [n for _, n, *_ in passages(texts, 240)] and got[0]["passage_bytes"] >= 250
    assert all(r["n_removed"] == 0 for r in got.values())


def test_columns_with_names_of_our_own(table):
    base = " ".join(words(60))
    df = table([base + " one two", base + " one two", "other", None]).withColumnsRenamed({"key": "own_ID", "quillon_extra": "quillon_id", "lang": "quillon_text", "source": "odd.`name"})
    df = df.selectExpr("*", "1 AS own_text", "2 AS own_kept", "3 AS n_lines", "4 AS own_lines", "5 AS lang_pred", "6 AS Score", "7 AS rejected")
    model = langid.CompressionClassifier({"aa": b"lorem ipsum dolor sit amet " * 40, "bb": b"w1 w2 w3 w4 w5 other " * 40})
    for out in (minhash.dedup(df), suffixes.cut(df), lines.dedup(df), langid.identify(df, model), langid.told(df, model)):
        rows = out.collect()
        assert out.columns[: len(df.columns)] == df.columns
        assert all((r["own_ID"], r["quillon_id"], r["own_text"], r["own_kept"], r["n_lines"], r["own_lines"], r["Score"]) == ("x", "y", 1, 2, 3, 4, 6) for r in rows)


def test_short_passages_and_pieces(table, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 40)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 120))) for _ in range(25)]
    sets = suffixes.Settings(9, (8, 2, 1), 12)
    rows = suffixes.digests(table(texts), sets).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows}
    assert [got[i] for i in range(len(texts))] == passages(texts, 12)
    assert {r["doc_id"]: r["passage_bytes"] for r in rows} == {i: n for i, (_, n, *_) in enumerate(passages(texts, 9))}


def test_cut_keeps_columns(table):
    p = "é" * 300
    df = table(["start " + p + " end", p, "clean", None, ""])
    out = {r["doc_id"]: r for r in suffixes.cut(df).collect()}
    assert out[0]["text"] == "start  end" and out[1]["text"] == "" and out[2]["text"] == "clean" and out[3]["text"] is None
    assert suffixes.cut(df).columns == df.columns and suffixes.digests(df.filter("false")).count() == 0


def test_recurring_templates_go_but_once(table):
    note = "Released under license number {} of the year {} by all authors named"
    texts = [f"unique text {i} " + " ".join(w.translate(str.maketrans("0123456789", "abcdefghij")) for w in words(8)) + "\n" + note.format(i, 1990 + i) + "\nok\n" for i in range(12)] + ODD
    out = {r["doc_id"]: r for r in lines.dedup(table(texts)).collect()}
    assert note.format(0, 1990) in out[0]["text"]
    assert all("Released" not in out[i]["text"] and f"unique text {i} " in out[i]["text"] and "\nok" in out[i]["text"] for i in range(1, 12))
    for i, t in enumerate(ODD, 12):
        assert out[i]["text"] == t and out[i]["n_dropped"] == 0


def test_copies_of_one_text_are_no_template(table):
    out = lines.dedup(table(["The very same long line of one text\nand another line of it"] * 20)).agg(F.sum("n_dropped")).first()[0]
    assert out == 0 and lines.dedup(table(["x"]).filter("false")).count() == 0


def test_generalised_fields(table):
    texts = [f"The order was shipped by courier {n} to the customer without any delay" for n in ("anna", "bert", "carl", "dora", "emil", "fritz", "gerd", "hans", "ida")]
    assert lines.dedup(table(texts)).agg(F.sum("n_dropped")).first()[0] == len(texts) - 1


def test_short_and_rare_lines_recur(table):
    own = [" ".join(w.translate(str.maketrans("0123456789", "abcdefghij")) for w in words(8)) for _ in range(12)]
    texts = [f"{t}\nRead more\nPage 3 of 10\nPage {i} of 99\n" + ("One rare line of words\n" if i < 3 else "Two of these only\n" if i < 5 else "") for i, t in enumerate(own)]
    out = {r["doc_id"]: r["text"] for r in lines.dedup(table(texts)).collect()}
    assert out[0] == texts[0] and all("Read more" not in out[i] and "Page 3 of 10" not in out[i] and own[i] in out[i] and f"Page {i} of 99" in out[i] for i in range(1, 12))
    assert [i for i in out if "rare" in out[i]] == [0] and [i for i in out if "only" in out[i]] == [3, 4]


def brute_lines(texts, s):
    """Which lines go, from the definitions alone; texts by doc_id."""

    def mask(tokens):
        return tuple("<*>" if re.search("[0-9@]|://", t) else t for t in tokens)

    exact, fields, leaves = {}, {}, {}
    for i, t in enumerate(texts):
        for line in (t or "").split("\n"):
            tokens = tuple(line.split())
            if len(tokens) < 2:
                continue
            m = mask(tokens)
            exact.setdefault(tokens, set()).add(i)
            constants = len(m) - m.count("<*>")
            if m != tokens and constants >= s.least_tokens and 2 * constants >= len(m):
                fields.setdefault(m, set()).add(i)
            if len(m) > s.least_constants:
                leaves.setdefault((0, len(m), m[: s.leading]), {}).setdefault(tokens, set()).add(i)
                leaves.setdefault((1, len(m), m[-s.leading :]), {}).setdefault(tokens, set()).add(i)
    distinct = lambda ids: len({texts[i] for i in ids})
    first = [{k: min(v) for k, v in found.items() if distinct(v) >= least} for found, least in ((exact, s.least_exact), (fields, s.least_docs))]
    templates = {}
    for leaf, own in leaves.items():
        if len(own) < s.least_docs:
            continue
        count = {}
        for tokens in own:
            for p, t in enumerate(mask(tokens)):
                count[p, t] = count.get((p, t), 0) + 1
        for tokens, ids in own.items():
            made = tuple(t if t != "<*>" and count[p, t] >= max(s.least_docs, s.share * len(own)) else None for p, t in enumerate(mask(tokens)))
            constants = sum(t is not None for t in made)
            if constants >= s.least_constants and 3 * constants >= 2 * len(made):
                templates.setdefault((leaf, made), []).append((tokens, min(ids)))
    of_line = {}
    for lines_ in templates.values():
        if distinct([i for _, i in lines_]) >= s.least_docs:
            for tokens, _ in lines_:
                of_line.setdefault(tokens, set()).add(min(i for _, i in lines_))
    out = []
    for i, t in enumerate(texts):
        kept = []
        for line in (t or "").split("\n"):
            tokens = tuple(line.split())
            keepers = {first[0].get(tokens), first[1].get(mask(tokens)), *of_line.get(tokens, ())} - {None}
            if not keepers - {i}:
                kept.append(line)
        out.append("\n".join(kept))
    return out


def test_dropped_lines_equal_brute_force(table):
    draw, names = random.Random(11), [f"n{'abcdefghij'[k % 10]}{'klmnop'[k // 10]}" for k in range(60)]
    makes = [
        lambda: f"Posted by {draw.choice(names)} in local news today",
        lambda: f"{draw.choice(names)} has sent a message to you",
        lambda: f"The order of {draw.choice(names)} was shipped by courier {draw.choice(names)} without any delay at all",
        lambda: f"All rights reserved by us since {draw.randint(1900, 2020)} in {draw.choice(names)} and elsewhere too",
        lambda: f"Page {draw.randint(1, 30)} of {draw.randint(30, 40)}",
        lambda: "The order of " + " ".join(draw.choice(names) for _ in range(10)),
        lambda: " ".join(draw.choice(names[:4]) for _ in range(draw.randint(1, 7))),
        lambda: draw.choice(["Read more", "ok", "", "  ", "One line that stands in many texts as it is", "Section 12 of the act of 1999 applies"]),
    ]
    texts = ["\n".join(draw.choice(makes)() for _ in range(draw.randint(0, 9))) for _ in range(150)] + ODD
    texts += [texts[3]] * 9
    s = lines.Settings()
    got = {r["doc_id"]: r for r in lines.dedup(table(texts), s).collect()}
    want = brute_lines(texts, s)
    assert [(got[i]["text"] or "") for i in range(len(texts))] == want
    gone = [line for t, w in zip(texts, want, strict=True) if t for line in t.split("\n") if line not in w.split("\n")]
    assert sum("Posted by" in x for x in gone) > 40 and sum("sent a message" in x for x in gone) > 40 and sum("shipped by" in x for x in gone) > 40
    again = {r["doc_id"]: r["text"] for r in lines.dedup(table(texts), lines.Settings(bitmap=64)).collect()}
    assert again == {i: r["text"] for i, r in got.items()}  # a bitmap that is full costs work, and nothing else


def test_near_copies_and_texts_below_the_bar(spark):
    """Near copies of one text, and texts that are alike by about 0.66; what links them is told from their edits."""
    draw, n, size, k = np.random.default_rng(6), 700, 200, 5
    texts, lost = [], []
    for family, edits in (("a", 1), ("b", 4)):
        base = [f"{family}{j}" for j in range(size)]
        for i in range(n):
            own, gone = list(base), set()
            for p in draw.choice(size, edits, replace=False).tolist():
                own[p] = f"{family}x{i}y{p}"
                gone |= {q for q in range(p - k + 1, p + 1) if 0 <= q <= size - k}
            texts.append(" ".join(own))
            lost.append(gone)
    label, every = list(range(2 * n)), size - k + 1

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for lo in (0, n):
        for i in range(lo, lo + n):
            for j in range(i):
                if j >= lo and 100 * (shared := every - len(lost[i] | lost[j])) >= 80 * (2 * every - shared):
                    a, b = sorted((root(i), root(j)))
                    label[b] = a
    want = [root(i) for i in range(2 * n)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for s in (minhash.Settings(shingle=k), minhash.Settings(shingle=k, rounds=1, joined=5, block=100)):
        got = {r["doc_id"]: r["component_id"] for r in minhash.groups(rows, s).collect()}
        assert [got[i] for i in range(2 * n)] == want
    assert len(set(want[:n])) == 1 and len(set(want[n:])) > 100
