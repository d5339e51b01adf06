import pytest
from pyspark.sql import functions as F

from quillon.functions import names as N
from quillon.operators import graph, linkage, registry
from quillon.operators.filters import PRESETS, FilterSpec
from quillon.schema import ASSIGNMENTS, REGISTRY
from quillon.streaming import incremental


def value(spark, make, *args):
    df = spark.createDataFrame([args], ", ".join(f"c{k} string" for k in range(len(args))))
    return df.select(make(*[F.col(f"c{k}") for k in range(len(args))])).first()[0]


@pytest.mark.parametrize(
    "make, args, want",
    [
        (N.fold_translit, ("Universitätsklinik & Søn Łódź",), "universitatsklinik and son lodz"),
        (N.fold_delete, ("Universitätsklinik",), "universittsklinik"),
        (N.char_ngrams, ("ab cd",), ["abcd"]),
        (N.acronym_of, ("european trial group",), "etg"),
        (N.fold_key, ("The University of X",), "university x"),
        (N.strip_legal, ("Acme Pharma GmbH & Co. KG",), "Acme Pharma"),
        (N.strip_legal, ("Acme, Inc.",), "Acme"),
        (N.salt_base, ("Drug Sodium",), "drug"),
        (N.substance_ladder, ("Aspirin® 100 mg tablets",), ["aspirin 100 mg tablets", "aspirin tablets", "aspirin"]),
        (N.junk_reason, ("10 mg tablet",), "only dose or form"),
        (N.junk_reason, ("n/a",), "placeholder"),
        (N.junk_reason, ("18F-DPA-714",), None),
        (N.classify_pair, ("Acme GmbH", "Acme"), "removal"),
        (N.is_cross_entity, ("Acme Pharma / Other Hospital",), True),
        (N.is_cross_entity, ("Novo A/S",), False),
        (N.clean_substance, ("A / b; c",), "a|b|c"),
    ],
)
def test_names(spark, make, args, want):
    assert value(spark, make, *args) == want


def test_jaro():
    assert N.jaro_of("martha", "marhta") == pytest.approx(0.944444, abs=1e-5)
    assert N.jaro_of("", "x") == 0 and N.jaro_of("same", "same") == 1


LABELS = [(1, "Charité Universitätsmedizin Berlin"), (2, "Charite Berlin"), (3, "Novartis Pharma"), (4, "Novartis Farmaceutica"), (5, "European Trial Group")]


def test_retrieval_and_pairs(spark):
    labels = spark.createDataFrame(LABELS, "id long, label string")
    index = linkage.build_index(labels, n=3)
    q = spark.createDataFrame([(10, "charite universitatsmedizin berlin"), (11, "ETG"), (12, "Novartis")], "query long, text string")
    slate = linkage.retrieve(q, index, use_ngram=True, use_acronym=True, threshold=0.3, interleave=True).collect()
    got = {(r["query"], r["id"]): r["channel"] for r in slate}
    assert got[10, 1] == "exact" and got[11, 5] == "acronym" and (12, 3) in got and (12, 4) in got
    assert all(r["place"] <= 10 for r in slate)
    pairs = {(r["a"], r["b"]): r["score"] for r in linkage.pair_graph(index, use_ngram=True).collect()}
    assert (1, 2) in pairs and (3, 4) in pairs and all(0 < s <= 1 for s in pairs.values()) and all(a < b for a, b in pairs)


def test_components_and_canopies(spark):
    nodes = spark.range(1, 9).withColumn("weight", F.col("id").cast("double"))
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9), (3, 4, 0.6), (5, 6, 0.2), (7, 8, 0.7)], "a long, b long, score double")
    comp = dict(graph.components(nodes.select("id"), pairs).collect())
    assert [comp[k] for k in range(1, 9)] == [1, 1, 1, 1, 5, 5, 7, 7]
    block = dict(graph.canopies(nodes, pairs, 0.5, 2).collect())
    assert block == {4: 4, 3: 4, 2: 2, 1: 2, 5: 5, 6: 6, 8: 8, 7: 8}


def test_cascade(spark):
    q = spark.createDataFrame([(1, "Acme GmbH"), (2, "Placeholder"), (3, "Überpharma"), (4, "Nothing known at all"), (5, "Acmee Labs")], "query long, text string")
    aliases = spark.createDataFrame([("acme", "Acme"), ("uberpharma", "Uberpharma"), ("acmeee labs", "Acme Labs")], "alias string, canonical string")
    over = spark.createDataFrame([("none", "x")], "raw_clean string, canonical string")
    neg = spark.createDataFrame([("placeholder",)], "alias string")
    got = {r["query"]: (r["canonical"], r["status"], r["tier"]) for r in linkage.normalise_sponsors(q, aliases, over, neg).collect()}
    assert got[1][0] == "Acme" and got[2] == (None, "rejected", "negative") and got[3][0] == "Uberpharma"
    assert got[4][2] == "unknown" and got[5][0] in ("Acme", "Acme Labs")


def test_substances(spark):
    q = spark.createDataFrame([(1, "Aspirin 100 mg"), (2, "Placebo"), (3, "10 mg"), (4, "Zzz-unknown"), (5, "both")], "query long, text string")
    vocabulary = spark.createDataFrame([("aspirin", "acetylsalicylic acid"), ("both", "x"), ("both", "y")], "alias_clean string, substance_clean string")
    got = {r["query"]: (r["class"], r["canonical"]) for r in linkage.resolve_substances(q, vocabulary).collect()}
    assert got == {1: ("registry", "acetylsalicylic acid"), 2: ("placebo", None), 3: ("rejected", None), 4: ("residue", None), 5: ("ambiguous", None)}


def reg_row(id_, canonical, merged=None, by="model"):
    return (id_, canonical, None, None, None, None, None, None, by, None, None, None, merged, None)


def test_registry_merges_and_idempotence(spark):
    reg = spark.createDataFrame([reg_row("ent_000001", "Acme"), reg_row("ent_000002", "Acme Corp"), reg_row("ent_000003", "Pinned", by="human")], REGISTRY)
    asg = spark.createDataFrame([("acme corp", "ent_000002", 0.9, None, None, "model", None, None, None), ("by hand", "ent_000002", 1.0, None, None, "human", None, None, None)], ASSIGNMENTS)
    merges = spark.createDataFrame([("ent_000002", "ent_000001", "same"), ("ent_000003", "ent_000001", "no")], "loser_id string, winner_id string, reason string")
    reg2, asg2 = registry.apply_merges(reg, asg, merges)
    assert {r["entity_id"]: r["merged_into"] for r in reg2.collect()} == {"ent_000001": None, "ent_000002": "ent_000001", "ent_000003": None}
    assert {r["raw"]: r["entity_id"] for r in asg2.collect()} == {"acme corp": "ent_000001", "by hand": "ent_000002"}
    clusters = spark.createDataFrame([("acme c.", "acme corp"), ("new one", "New One")], "raw string, canonical string")
    reg3, asg3 = registry.from_clusters(reg2, asg2, clusters)
    reg4, asg4 = registry.from_clusters(reg3, asg3, clusters)
    assert reg3.count() == reg4.count() == 4
    assert {tuple(r) for r in asg3.collect()} == {tuple(r) for r in asg4.collect()}
    assert {r["raw"]: r["entity_id"] for r in asg3.collect()}["acme c."] == "ent_000001"
    assert incremental.violations(reg2, reg3, asg2, asg3).count() == 0


def test_gate_and_backlog(spark):
    old = spark.createDataFrame([("1", "A", "accepted"), ("2", "B", "accepted")], "_id string, label string, status string")
    incremental.regression_gate(old, old)
    with pytest.raises(ValueError):
        incremental.regression_gate(old, spark.createDataFrame([("1", None, "unknown")], "_id string, label string, status string"))
    with pytest.raises(LookupError):
        incremental.regression_gate(None, old)
    new = spark.createDataFrame([("x",), ("y",), ("z",)], "raw string")
    todo = incremental.nightly_todo(new, spark.createDataFrame([("x",)], "raw string"), spark.createDataFrame([("y", 3)], "raw string, attempts int"))
    assert [r[0] for r in todo.collect()] == ["z"]


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text('{"_id": "1", "v": "a"}\n{"_id": "2", "v": "b"}\n')
    seen = []
    run = lambda: incremental.run_increment(incremental.stream_documents(spark, str(folder), "_id string, v string"), str(tmp_path / "cp"), lambda df, k: seen.extend(r["_id"] for r in df.collect()))
    run()
    (folder / "b.json").write_text('{"_id": "3", "v": "c"}\n')
    run()
    assert sorted(seen) == ["1", "2", "3"]


def test_filter_state():
    spec = FilterSpec(status=["Completed"], date_range=("2020-01-01", "2020-12-31"), text="été")
    assert FilterSpec.from_token(spec.to_token()) == spec
    assert spec.describe()["text"] == "été" and FilterSpec().describe()["status"] == "All"
    assert PRESETS["last_12m"]("2024-05-01").date_range == ("2023-05-01", "2024-05-01")


def test_fuzzy_equals_brute_force(spark):
    import random

    draw = random.Random(3)
    base = ["".join(draw.choice("abcdeinorst") for _ in range(draw.randint(6, 14))) for _ in range(90)]
    near = []
    for w in base:
        x = list(w)
        for _ in range(draw.randint(0, 2)):
            x[draw.randrange(1, len(x))] = draw.choice("abcdeinorst")
        near.append("".join(x) + draw.choice(["", "s", "en"]))
    q = spark.createDataFrame(list(enumerate(near)), "query long, text string")
    t = spark.createDataFrame(list(enumerate(base)), "id long, target string")
    got = {(r["query"], r["id"]) for r in linkage.fuzzy(q, t, 0.9).collect()}
    want = {(i, j) for i, a in enumerate(near) for j, b in enumerate(base) if a[0] == b[0] and abs(len(a) - len(b)) <= 0.25 * max(len(a), len(b)) and N.jaro_of(a, b) >= 0.9}
    assert got == want and len(want) > 20


def test_concentration_is_one_order(spark):
    from quillon.operators import frames

    df = spark.range(5000).selectExpr("CAST(id * id % 97 AS STRING) AS k")
    rows = frames.concentration(df, "k").orderBy("rank").collect()
    counts = sorted(((r["n"], r["k"]) for r in rows), key=lambda x: (-x[0], x[1]))
    assert [(r["n"], r["k"]) for r in rows] == counts and [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and rows[-1]["cum_pct"] == 100.0


def test_large_components_give_the_same_canopies(spark):
    import random

    draw = random.Random(9)
    nodes = spark.createDataFrame([(k, float(draw.randint(1, 6))) for k in range(60)], "id long, weight double")
    edges = {(min(a, b), max(a, b)) for a, b in ((draw.randrange(60), draw.randrange(60)) for _ in range(90)) if a != b}
    pairs = spark.createDataFrame([(a, b, round(draw.uniform(0.3, 1), 2)) for a, b in sorted(edges)], "a long, b long, score double")
    one = dict(graph.canopies(nodes, pairs, 0.5, 4).collect())
    assert dict(graph.canopies(nodes, pairs, 0.5, 4, at_once=0).collect()) == one and len(one) == 60 and len(set(one.values())) > 10
