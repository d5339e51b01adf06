"""The entity registry: a slowly changing store of canonicals, with merges, assignments, review and model outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import names as N
from quillon.functions.text import blank_to_null
from quillon.operators.frames import first_by, upsert
from quillon.operators.graph import components
from quillon.operators.lineage import cut
from quillon.schema import REGISTRY, SPEND


def empty(spark) -> DataFrame:
    return spark.createDataFrame([], REGISTRY)


def read(spark, path: str, schema: T.StructType = REGISTRY) -> DataFrame:
    """A typed CSV; what is missing is null."""
    return spark.read.csv(path, header=True, schema=schema)


def next_number(registry: DataFrame) -> DataFrame:
    """One row: the largest entity number so far, 0 if there is none."""
    return registry.agg(F.coalesce(F.max(F.regexp_extract("entity_id", r"^ent_(\d+)$", 1).try_cast("long")), F.lit(0)).alias("last"))


def add(registry: DataFrame, new: DataFrame) -> DataFrame:
    """Appends entities (any of the registry's columns but the id), numbered on from the largest id in order of canonical."""
    last = next_number(registry).first()["last"]
    cols = [F.col(f.name).cast(f.dataType) if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in REGISTRY.fields if f.name != "entity_id"]
    # numbers without a gap, by the position in a sort: zipWithIndex keeps the sort distributed
    rows = new.select(*cols).orderBy("canonical")
    numbered = rows.rdd.zipWithIndex().map(lambda x: (f"ent_{last + x[1] + 1:06d}", *x[0]))
    return registry.unionByName(registry.sparkSession.createDataFrame(numbered, REGISTRY))


def live(registry: DataFrame) -> DataFrame:
    return registry.filter("merged_into IS NULL")


def resolve(registry: DataFrame) -> DataFrame:
    """entity_id and the entity at the end of its chain of merges, as final_id. A cycle ends at one of its members.

    Pointers are doubled, so a chain of length n takes log2(n) steps.
    """
    ids = registry.select("entity_id", F.coalesce("merged_into", "entity_id").alias("final_id"))
    known = cut(ids)
    for _ in range(40):
        ahead = known.select(F.col("entity_id").alias("final_id"), F.col("final_id").alias("then"))
        stepped = cut(known.join(ahead, "final_id", "left").select("entity_id", F.coalesce("then", "final_id").alias("final_id"), (F.coalesce("then", "final_id") != F.col("final_id")).alias("moved")))
        known = stepped.select("entity_id", "final_id")
        if not stepped.filter("moved").limit(1).count():
            break
    return known


def apply_merges(registry: DataFrame, assignments: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """merges: loser_id, winner_id, reason. Entities that a person decided are not merged away; a person's assignments stay."""
    pinned = registry.filter("decided_by = 'human'").select(F.col("entity_id").alias("loser_id"))
    ok = first_by(merges.filter("loser_id != winner_id").join(pinned, "loser_id", "left_anti"), ["loser_id"], F.col("winner_id"))
    merged = registry.join(ok.withColumnRenamed("loser_id", "entity_id"), "entity_id", "left")
    merged = merged.withColumns({"merged_into": F.coalesce("merged_into", "winner_id"), "note": F.coalesce("note", "reason")}).select(*registry.columns)
    moved = assignments.join(resolve(merged), "entity_id", "left")
    kept = F.col("decided_by") == "human"
    return merged, moved.withColumn("entity_id", F.when(kept, F.col("entity_id")).otherwise(F.coalesce("final_id", "entity_id"))).select(*assignments.columns)


def from_clusters(registry: DataFrame, assignments: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """clusters: raw, canonical (and confidence). Known canonicals are reused through merges, others added; a person's
    assignments win. Running it again changes nothing."""
    final = resolve(registry)
    known = registry.join(final, "entity_id").select(F.lower("canonical").alias("key"), F.col("final_id").alias("entity_id"))
    known = known.groupBy("key").agg(F.min("entity_id").alias("entity_id"))
    keyed = clusters.withColumn("key", F.lower("canonical"))
    new = first_by(keyed.join(known, "key", "left_anti"), ["key"], F.col("canonical")).select("canonical", F.lit("model").alias("decided_by"))
    grown = cut(add(registry, new))
    ids = known.unionByName(grown.join(registry.select("entity_id"), "entity_id", "left_anti").select(F.lower("canonical").alias("key"), "entity_id"))
    fresh = first_by(keyed.join(ids, "key"), ["raw"], F.col("entity_id"))
    cols = [F.col("raw"), F.col("entity_id"), F.col("confidence").cast("double") if "confidence" in clusters.columns else F.lit(None).cast("double").alias("confidence"), F.lit("cluster").alias("channel"), F.lit(None).cast("string").alias("reason"), F.lit("model").alias("decided_by")]
    fresh = fresh.select(*cols, *[F.lit(None).cast("string").alias(c) for c in ("decided_at_utc", "model_id", "prompt_version")])
    human = assignments.filter("decided_by = 'human'").select("raw")
    return grown, upsert(assignments, fresh.join(human, "raw", "left_anti").select(*assignments.columns), ["raw"])


def surface_forms(registry: DataFrame, assignments: DataFrame) -> DataFrame:
    """All names of live entities: canonicals and assigned raw strings."""
    alive = live(registry)
    assigned = assignments.filter("entity_id IS NOT NULL").join(resolve(registry), "entity_id").select(F.col("final_id").alias("entity_id"), F.col("raw").alias("label"))
    both = alive.select("entity_id", F.col("canonical").alias("label")).unionByName(assigned.join(alive.select("entity_id"), "entity_id", "left_semi"))
    return both.filter(blank_to_null(F.col("label")).isNotNull()).distinct()


def resolve_labels(registry: DataFrame, assignments: DataFrame) -> DataFrame:
    """Raw string to its live entity's canonical, parent and type."""
    final = assignments.join(resolve(registry), "entity_id", "left").withColumn("entity_id", F.coalesce("final_id", "entity_id")).drop("final_id")
    return final.join(live(registry).select("entity_id", "canonical", "parent", "entity_type"), "entity_id", "left")


def review_reason(entity: Column, confidence: Column, n_trials: Column, least: float = 0.75, many: int = 20, least_many: float = 0.9) -> Column:
    return F.when(entity.isNull(), "unassigned").when(confidence.isNull(), "no confidence recorded").when(confidence < least, "low confidence").when((n_trials >= many) & (confidence < least_many), "high impact, middling confidence")


def route_for_review(assignments: DataFrame, impact: DataFrame) -> DataFrame:
    """impact: raw, n_trials. Rows that a person should see, those of most trials first."""
    rows = assignments.filter("decided_by IS NULL OR decided_by != 'human'").join(impact, "raw", "left")
    rows = rows.withColumn("review_reason", review_reason(F.col("entity_id"), F.col("confidence"), F.col("n_trials"))).filter("review_reason IS NOT NULL")
    return rows.orderBy(F.desc(F.coalesce("n_trials", F.lit(0))), "confidence", "raw")


def trials_per_entity(assignments: DataFrame, impact: DataFrame, registry: DataFrame) -> DataFrame:
    """Trials of each live entity, 0 where there are none."""
    counts = assignments.join(impact, "raw").groupBy("entity_id").agg(F.sum("n_trials").alias("n_trials"))
    return counts.join(live(registry).select("entity_id"), "entity_id", "right").withColumn("n_trials", F.coalesce("n_trials", F.lit(0)))


def salt_rollup(registry: DataFrame) -> DataFrame:
    """Salts whose base is an entity too: loser_id, winner_id, salt_form, reason."""
    alive = live(registry).select("entity_id", "canonical")
    bases = alive.groupBy(F.lower("canonical").alias("base")).agg(F.min("entity_id").alias("winner_id"))
    salts = alive.select(F.col("entity_id").alias("loser_id"), "canonical", N.salt_base(F.col("canonical")).alias("base"), N.salt_form(F.col("canonical")).alias("salt_form")).filter("base IS NOT NULL")
    return salts.join(bases, "base").filter("loser_id != winner_id").select("loser_id", "winner_id", "salt_form", F.concat(F.lit("salt of "), "base").alias("reason"))


def pick_winner(groups: DataFrame) -> DataFrame:
    """groups: grp, entity_id, canonical, impact. The shortest name that another one extends, else the one of most impact."""
    other = groups.select("grp", F.col("entity_id").alias("other_id"), F.lower("canonical").alias("other"))
    low = F.lower("canonical")
    longer = groups.join(other, "grp").filter((F.col("entity_id") != F.col("other_id")) & (F.startswith("other", F.concat(low, F.lit(" "))) | F.endswith("other", F.concat(F.lit(" "), low))))
    marked = groups.join(longer.select("grp", "entity_id").distinct().withColumn("is_base", F.lit(True)), ["grp", "entity_id"], "left").withColumn("is_base", F.coalesce("is_base", F.lit(False)))
    size = F.when(F.col("is_base"), F.length("canonical")).otherwise(-F.col("impact"))
    return first_by(marked, ["grp"], F.col("is_base").desc(), size, F.col("entity_id")).select("grp", F.col("entity_id").alias("winner_id"))


def blocked_merge(a: Column, b: Column, a_type: Column, b_type: Column, a_known: Column, b_known: Column) -> Column:
    """Whether a merge needs more evidence: both are reference names, or types differ and names are unlike."""
    alike = (N.fold_key(a) == N.fold_key(b)) | F.coalesce(N.salt_base(a) == F.lower(b), F.lit(False)) | F.coalesce(N.salt_base(b) == F.lower(a), F.lit(False))
    unlike = F.coalesce(a_type != b_type, F.lit(False)) & (N.ngram_jaccard(a, b, 3) < 0.30)
    return ~alike & ((a_known & b_known) | unlike)


def key_pairs(entities: DataFrame, least: int = 2, most: int = 20) -> DataFrame:
    """Pairs with one bag of words; bags of more than `most` entities say nothing. entities: id, name."""
    from quillon.operators.linkage import pairs_from_postings

    return pairs_from_postings(entities.select("id", N.fold_key(F.col("name")).alias("key")).filter("key != ''"), "key", least, most).select("a", "b").distinct()


def merge_votes(votes: DataFrame) -> DataFrame:
    """Answers of a model to pair questions: block, members (ids), merge_into (index from 1 of each member's winner, or null).
    Winners by majority; ties to the smaller id."""
    rows = votes.select(F.posexplode("members").alias("i", "loser_id"), "members", "merge_into")
    rows = rows.select("loser_id", F.get("members", F.get("merge_into", F.col("i")) - 1).alias("winner_id")).filter("winner_id IS NOT NULL AND winner_id != loser_id")
    counts = rows.groupBy("loser_id", "winner_id").agg(F.count("*").alias("n"))
    return first_by(counts, ["loser_id"], F.col("n").desc(), F.col("winner_id"))


def merge_groups(votes: DataFrame) -> DataFrame:
    """Components of the voted merges: id, comp."""
    pairs = merge_votes(votes).select(F.col("loser_id").alias("a"), F.col("winner_id").alias("b"))
    return components(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), pairs)


CLUSTERS = T.ArrayType(T.StructType([T.StructField("canonical", T.StringType()), T.StructField("members", T.ArrayType(T.StringType()))]))


def parse_clusters(answers: DataFrame) -> DataFrame:
    """answers: block, members, answer (JSON). Valid answers divide the block's members; others are marked."""
    parsed = answers.withColumn("clusters", F.from_json("answer", CLUSTERS))
    flat = F.flatten(F.transform("clusters", lambda c: c["members"]))
    valid = F.coalesce((F.size(F.array_except(flat, "members")) == 0) & (F.size(F.array_except("members", flat)) == 0) & (F.size(flat) == F.size(F.array_distinct(flat))), F.lit(False))
    return parsed.select("block", valid.alias("valid"), F.explode_outer("clusters").alias("c")).select("block", "valid", "c.canonical", F.explode_outer("c.members").alias("raw"))


def parse_choice(answers: DataFrame) -> DataFrame:
    """answers: raw, n_candidates, answer (JSON with choice). A choice out of bounds is none."""
    choice = F.get_json_object("answer", "$.choice").try_cast("int")
    return answers.withColumn("choice", F.when((choice >= 1) & (choice <= F.col("n_candidates")), choice))


def parse_translations(answers: DataFrame) -> DataFrame:
    """answers: entity_id, answer (JSON with english)."""
    return answers.select("entity_id", blank_to_null(F.get_json_object("answer", "$.english")).alias("english")).filter("english IS NOT NULL")


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def slate_hash(candidates: Column) -> Column:
    return F.sha2(F.array_join(candidates, "|"), 256)


def cost(prices: DataFrame, usage: DataFrame) -> DataFrame:
    """usage with cost_usd. prices: model_id, valid_from, valid_to, input_usd, output_usd, cache_usd (a million tokens)."""
    on = (usage["model_id"] == prices["model_id"]) & (F.col("recorded_at_utc") >= F.col("valid_from")) & (F.col("recorded_at_utc") < F.coalesce("valid_to", F.lit("9999")))
    usd = (F.col("input_tokens") * F.col("input_usd") + F.col("output_tokens") * F.col("output_usd") + F.col("cache_read_tokens") * F.col("cache_usd")) / 1e6
    return usage.drop("cost_usd").join(F.broadcast(prices), on).drop(prices["model_id"]).withColumn("cost_usd", usd).select(*[f.name for f in SPEND.fields])


def record_spend(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """The ledger and what it does not have by batch."""
    return ledger.unionByName(new.join(ledger.select("batch_id"), "batch_id", "left_anti").select(*ledger.columns))


def budget_guard(ledger: DataFrame, estimate: float, budget: float, run_cap: float | None = None) -> None:
    """Raises where an estimate passes what is left of the budget, or the cap of one run."""
    spent = ledger.agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("s")).first()["s"]
    if spent + estimate > budget:
        raise RuntimeError(f"estimated {estimate:.2f} USD, of which {budget - spent:.2f} is left")
    if run_cap is not None and estimate > run_cap:
        raise RuntimeError(f"estimated {estimate:.2f} USD, over the cap of {run_cap:.2f} for one run")
