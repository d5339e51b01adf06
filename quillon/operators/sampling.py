"""Stratified samples in an order that a key fixes, and what rules do to pairs of raw and decided values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.names import fold_translit


def allotted(counts: DataFrame, budget: int, least: int) -> DataFrame:
    """counts: stratum, n. Adds k: shares of the budget, at least `least` and at most n; the stratum with most rows to spare takes what is left over."""
    every = Window.partitionBy(F.lit(0))  # strata are few: there is one row each
    shared = counts.withColumn("k", F.least("n", F.greatest(F.lit(least), F.floor(budget * F.col("n") / F.sum("n").over(every)))))
    spare = F.row_number().over(every.orderBy((F.col("n") - F.col("k")).desc(), "stratum")) == 1
    rest = budget - F.sum("k").over(every)
    return shared.withColumn("k", F.when(spare, F.least("n", F.greatest(F.lit(least), F.col("k") + rest))).otherwise(F.col("k")))


def stratified(rows: DataFrame, stratum: str, budget: int, least: int, *order: Column) -> DataFrame:
    """About `budget` rows, dealt to strata by their shares; adds rank within the stratum."""
    plan = allotted(rows.groupBy(F.col(stratum).alias("stratum")).agg(F.count("*").alias("n")), budget, least)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(stratum).orderBy(*order)))
    return ranked.filter(F.col("rank") <= budget).join(plan.select(F.col("stratum").alias(stratum), "k"), stratum).filter("rank <= k").drop("k")


def rule_safety(pairs: DataFrame, rules: dict[str, Column], final: str) -> DataFrame:
    """Of each rule: how often it answers, and how often it agrees, differs in spelling only, or conflicts with `final`."""
    answers = F.array(*[F.struct(F.lit(name).alias("rule"), c.alias("derived")) for name, c in rules.items()])
    derived = pairs.select(F.col(final).alias("final"), F.explode_outer(answers).alias("m")).select("m.rule", "m.derived", "final")
    same, alike = F.col("derived") == F.col("final"), fold_translit(F.col("derived")) == fold_translit(F.col("final"))
    outcome = F.when(same, "agree").when(alike, "cosmetic").otherwise("conflict")
    counts = derived.filter("derived IS NOT NULL").withColumn("outcome", outcome).groupBy("rule").agg(F.count("*").alias("fires"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("agree", "cosmetic", "conflict")])
    return counts.withColumn("conflict_pct", F.round(100.0 * F.col("conflict") / F.col("fires"), 1))


def uniform(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """k rows, in an order that a key fixes."""
    return rows.orderBy(*order).limit(k)
