"""Upkeep of the entity registry: renames, pinned decisions, duplicates, and what no entity is for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import names as N
from quillon.functions.text import blank_to_null, squish
from quillon.operators import registry as R
from quillon.operators.frames import first_by, upsert
from quillon.schema import ASSIGNMENTS


def folded(c: Column) -> Column:
    """Lower case without accents, single blanks."""
    return squish(F.lower(N.fold_ascii(c)))


def rename(registry: DataFrame, renames: DataFrame) -> DataFrame:
    """renames: old, new. Live entities of an old name take the new one; where a live entity has it already, or another takes it first, they are merged into that."""
    table = first_by(renames.filter(blank_to_null(F.col("new")).isNotNull()).select(folded(F.col("old")).alias("key"), "new"), ["key"], F.col("new"))
    alive = R.live(registry).select("entity_id", folded(F.col("canonical")).alias("key"))
    hits = alive.join(table, "key").select("entity_id", "new", folded(F.col("new")).alias("target"))
    stay = alive.join(table.select("key"), "key", "left_anti").groupBy(F.col("key").alias("target")).agg(F.min("entity_id").alias("holder"))
    first = hits.groupBy("target").agg(F.min("entity_id").alias("first"))
    plan = hits.join(first, "target").join(stay, "target", "left").select("entity_id", "new", F.nullif(F.coalesce("holder", "first"), "entity_id").alias("into"))
    out = registry.join(plan, "entity_id", "left")
    merged = F.col("into").isNotNull()
    return out.withColumns(
        {
            "canonical": F.when(~merged & F.col("new").isNotNull(), F.col("new")).otherwise(F.col("canonical")),
            "merged_into": F.coalesce("merged_into", "into"),
            "note": F.when(merged, F.concat(F.lit("merged into the entity named '"), "new", F.lit("'"))).otherwise(F.col("note")),
        }
    ).select(*registry.columns)


def pin(registry: DataFrame, assignments: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """overrides: raw, canonical, reason. A person's mappings: entities that are lacking are added, their assignments replace others.
    An empty canonical says that the string is none; the third frame (raw, reason) has these."""
    given = first_by(overrides.filter(blank_to_null(F.col("raw")).isNotNull()), ["raw"], F.col("canonical").asc_nulls_last())
    none = blank_to_null(F.col("canonical")).isNull()
    rejected = given.filter(none).select("raw", F.coalesce("reason", F.lit("manual override: not a substance")).alias("reason"))
    mapped = given.filter(~none).withColumn("key", folded(F.col("canonical")))
    keys = registry.groupBy(folded(F.col("canonical")).alias("key")).agg(F.min("entity_id").alias("entity_id"))
    fresh = first_by(mapped.join(keys, "key", "left_anti"), ["key"], F.col("canonical"))
    grown = R.add(registry, fresh.select("canonical", F.lit(1.0).alias("confidence"), F.lit("human").alias("decided_by"), F.lit("manual").alias("model_id")))
    keys = grown.groupBy(folded(F.col("canonical")).alias("key")).agg(F.min("entity_id").alias("entity_id"))
    rows = mapped.join(keys, "key").withColumns({"confidence": F.lit(1.0), "channel": F.lit("manual"), "decided_by": F.lit("human"), "model_id": F.lit("manual")})
    rows = rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in ASSIGNMENTS.fields])
    return grown, upsert(assignments, rows.select(*assignments.columns), ["raw"]), rejected


def duplicates(registry: DataFrame, assignments: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Merges (loser_id, winner_id, reason) of live entities with one name, into that of most assignments; and of a model's
    entities whose name is an alias of exactly one other. aliases: alias, entity_id."""
    final = R.resolve(registry)
    counts = assignments.join(final, "entity_id").groupBy(F.col("final_id").alias("entity_id")).agg(F.count("*").alias("n"))
    alive = R.live(registry).select("entity_id", "canonical", "decided_by", folded(F.col("canonical")).alias("key")).join(counts, "entity_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    winner = first_by(alive, ["key"], F.col("n").desc(), F.col("entity_id")).select("key", F.col("entity_id").alias("winner_id"))
    same = alive.join(winner, "key").filter("entity_id != winner_id").select(F.col("entity_id").alias("loser_id"), "winner_id", F.concat(F.lit("duplicate canonical '"), "canonical", F.lit("'")).alias("reason"))
    if aliases is None:
        return same
    known = aliases.join(final, "entity_id").select(folded(F.col("alias")).alias("key"), F.col("final_id").alias("entity_id")).join(alive.select("entity_id"), "entity_id", "left_semi")
    one = known.groupBy("key").agg(F.min("entity_id").alias("winner_id"), F.countDistinct("entity_id").alias("k")).filter("k = 1")
    model = alive.filter("decided_by = 'model'").join(same.select(F.col("loser_id").alias("entity_id")), "entity_id", "left_anti")
    named = model.join(one, "key").filter("entity_id != winner_id").select(F.col("entity_id").alias("loser_id"), "winner_id", F.concat(F.lit("'"), "canonical", F.lit("' is an alias of the winning entity")).alias("reason"))
    return same.unionByName(named)


def abstain(strings: DataFrame, candidates: DataFrame) -> DataFrame:
    """Strings (raw) without any candidate (raw): nothing is asked about them."""
    return strings.join(candidates.select("raw").distinct(), "raw", "left_anti").select("raw", F.lit("no candidates").alias("reason"))


def lists_from_decisions(decisions: DataFrame, assignments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """decisions: raw, verdict, reason, decided_at_utc. Of each string's last verdict: what names no substance, and what was
    left open and is still unassigned. Both: raw, reason."""
    last = first_by(decisions, ["raw"], F.col("decided_at_utc").desc_nulls_last(), F.col("verdict"))
    none = last.filter("verdict = 'not_a_substance'").select("raw", "reason")
    undecided = last.filter("verdict = 'abstain'").join(assignments.select("raw"), "raw", "left_anti").select("raw", "reason")
    return none, undecided
