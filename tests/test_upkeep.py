import pytest
from pyspark.sql import functions as F

from quillon.functions import sponsors as S
from quillon.operators import quality, sampling, upkeep
from quillon.schema import ASSIGNMENTS, REGISTRY
from quillon.sources import landing
from quillon.streaming import incremental


def typed(spark, schema, rows):
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)


def test_renames_collide_into_merges(spark):
    reg = typed(spark, REGISTRY, [{"entity_id": "ent_1", "canonical": "Cyclosporine"}, {"entity_id": "ent_2", "canonical": "Ciclosporin"}, {"entity_id": "ent_3", "canonical": "Adrenaline"}, {"entity_id": "ent_4", "canonical": "ADRENALINE"}, {"entity_id": "ent_5", "canonical": "adrenaline", "merged_into": "ent_9"}])
    table = spark.createDataFrame([("cyclosporine", "Ciclosporin"), ("adrenaline", "Epinephrine"), ("unknown", "X"), ("other", " ")], "old string, new string")
    got = {r["entity_id"]: (r["canonical"], r["merged_into"]) for r in upkeep.rename(reg, table).collect()}
    assert got == {"ent_1": ("Cyclosporine", "ent_2"), "ent_2": ("Ciclosporin", None), "ent_3": ("Epinephrine", None), "ent_4": ("ADRENALINE", "ent_3"), "ent_5": ("adrenaline", "ent_9")}


def test_overrides_pin_and_reject(spark):
    reg = typed(spark, REGISTRY, [{"entity_id": "ent_000007", "canonical": "Aspirin"}])
    asg = typed(spark, ASSIGNMENTS, [{"raw": "asa", "entity_id": "ent_000099"}, {"raw": "kept", "entity_id": "ent_000007"}])
    over = spark.createDataFrame([("asa", "aspirin", None), ("bb", "", "a class"), ("new one", "Newdrug", None), (None, "x", None)], "raw string, canonical string, reason string")
    grown, rows, rejected = upkeep.pin(reg, asg, over)
    assert {r["raw"]: r["entity_id"] for r in rows.collect()} == {"asa": "ent_000007", "kept": "ent_000007", "new one": "ent_000008"}
    assert {r["canonical"] for r in grown.collect()} == {"Aspirin", "Newdrug"} and [tuple(r) for r in rejected.collect()] == [("bb", "a class")]


def test_duplicates_by_alias_spare_what_a_person_made(spark):
    reg = typed(spark, REGISTRY, [{"entity_id": "ent_1", "canonical": "Leucovorin"}, {"entity_id": "ent_2", "canonical": "Calcium folinate", "decided_by": "model"}, {"entity_id": "ent_3", "canonical": "Both", "decided_by": "model"}, {"entity_id": "ent_4", "canonical": "Folinate", "decided_by": "human"}])
    aliases = spark.createDataFrame([("calcium folinate", "ent_1"), ("both", "ent_1"), ("both", "ent_4"), ("folinate", "ent_1")], "alias string, entity_id string")
    got = upkeep.duplicates(reg, typed(spark, ASSIGNMENTS, []), aliases).collect()
    assert [(r["loser_id"], r["winner_id"]) for r in got] == [("ent_2", "ent_1")]


def test_runs_snapshots_and_backlog(spark, tmp_path):
    log = f"{tmp_path}/runs"
    assert incremental.runs(spark, log).count() == 0
    for k in (1, 2, 1):
        incremental.record_run(spark, log, run_id=f"r{k}", status="ok", n_new=k)
    assert sorted((r["run_id"], r["n_new"]) for r in incremental.runs(spark, log).collect()) == [("r1", 1), ("r2", 2)]
    df = spark.createDataFrame([("a", 1), ("b", 2)], "raw string, n_trials long")
    with pytest.raises(LookupError):
        incremental.snapshot(spark, f"{tmp_path}/s", "1", "state")
    incremental.take_snapshot({"state": df}, f"{tmp_path}/s", "1")
    assert incremental.snapshot(spark, f"{tmp_path}/s", "1", "state")["state"].count() == 2
    incremental.write_backlog(spark.createDataFrame([("a",), ("b",), ("c",)], "raw string"), df, f"{tmp_path}/b")
    assert [r["raw"] for r in spark.read.csv(f"{tmp_path}/b", header=True).coalesce(1).collect()] == ["b", "a", "c"]


def test_optional_headed_and_replaced(spark, tmp_path):
    assert landing.read_optional_csv(spark, f"{tmp_path}/none.csv", ["a"]) is None
    at = tmp_path / "sheet.csv"
    at.write_text('Report of medicines\nmade today,,\n"Name","Active substance",Other\nA,"x, y",1\nB, z ,2\n')
    rows = landing.read_headed_csv(spark, str(at), ["Active substance", "Name"]).collect()
    assert [tuple(r) for r in rows] == [("x, y", "A"), ("z", "B")]
    with pytest.raises(ValueError):
        landing.read_headed_csv(spark, str(at), ["Missing"])
    for n in (3, 5):
        landing.replace_table(spark.range(n), f"{tmp_path}/t")
        assert spark.read.parquet(f"{tmp_path}/t").count() == n


def test_stratified_sample(spark):
    rows = spark.range(1000).withColumn("s", F.when(F.col("id") < 5, "few").when(F.col("id") < 300, "some").otherwise("most"))
    got = sampling.stratified(rows, "s", 50, 3, F.xxhash64("id")).groupBy("s").count().collect()
    counts = {r["s"]: r["count"] for r in got}
    assert counts["few"] == 3 and sum(counts.values()) == 50 and sampling.uniform(rows, 7, F.xxhash64("id")).count() == 7


def test_parents_and_rules(spark):
    one = lambda f, *x: spark.createDataFrame([x], ", ".join(f"c{k} string" for k in range(len(x)))).select(f(*[F.col(f"c{k}") for k in range(len(x))])).first()[0]
    parents = one(S.department_parents, "Dept of Neurology, University Medical Center Utrecht")
    assert parents[0] == "university medical center utrecht" and "umc utrecht" in parents
    assert one(S.parent_key, "Department of X, Acme University Hospital") == one(lambda c: S.N.family_key(c), "acme university hospital")
    assert one(S.sponsor_type, "University of X") == "unknown" and one(S.sponsor_type, "Hochschule X") == "academic" and one(S.sponsor_type, "Hospital group network") == "hospital"
    assert tuple(one(S.derive, "Acme Pharma GmbH & Co. KG")) == ("Acme Pharma", "legal_suffix", 0.85)
    assert tuple(one(S.derive, "X / Y Hospital")) == (None, None, None) or one(S.derive, "The Group")["derived"] is None
    assert tuple(one(lambda c: S.by_rule(c, "case_punct"), "Acme Ltd")) == (None, None, None)
    assert one(lambda a, b: S.removed_words(F.split(a, " "), F.split(b, " ")), "a b c d", "a c") == ["b", "d"]
    assert one(lambda a, b: S.removed_tail(F.split(a, " "), F.split(b, " ")), "a b c", "a b") == "c"
    assert one(S.looks_mangled, "Universitt Zrich") and not one(S.looks_mangled, "University") and one(S.trap_family, "Merck KGaA") == "merck_family"
    assert one(S.is_classed, "acme::hospital") and not one(S.is_classed, "acme::")


def test_quality_frames(spark):
    rows = spark.createDataFrame([(1, "b1", 0, True), (2, "b1", 1, False), (3, "b2", 0, True)], "id long, base string, version int, kept boolean")
    got = quality.version_table(rows, "base", "version", "kept").collect()
    assert [tuple(r) for r in got] == [("b1", 2, 1, 2, False, "1 -> 2")]
