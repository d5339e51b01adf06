"""Data-quality rules: counts of all rules in one pass, and the rows behind them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    severity: str
    category: str
    issue: str
    hit: str  # an expression over a row, or the name of a column that counts for it


def issue_table(df: DataFrame, rules: list[Rule], more: dict[str, DataFrame]) -> DataFrame:
    """severity, category, issue and n_affected of every rule. Rules over rows are counted in one pass; `more` has, by issue, frames of one column n."""
    own = [r for r in rules if r.issue not in more]
    one = df.agg(*[F.count_if(F.coalesce(F.expr(r.hit), F.lit(False))).alias(f"r{k}") for k, r in enumerate(own)])
    counts = one.unpivot([], [f"r{k}" for k in range(len(own))], "rule", "n_affected")
    named = F.element_at(F.create_map(*[F.lit(x) for k, r in enumerate(own) for x in (f"r{k}", r.issue)]), F.col("rule"))
    out = counts.select(named.alias("issue"), "n_affected")
    for issue, frame in more.items():
        out = out.unionByName(frame.select(F.lit(issue).alias("issue"), F.col("n").cast("long").alias("n_affected")))
    kinds = F.create_map(*[x for r in rules for x in (F.lit(r.issue), F.struct(F.lit(r.severity).alias("severity"), F.lit(r.category).alias("category")))])
    return out.withColumn("k", F.element_at(kinds, F.col("issue"))).select("k.severity", "k.category", "issue", "n_affected")


def shared_keys(df: DataFrame, key: str, least: int = 20) -> DataFrame:
    """Pairs of an EUCTR and a CTIS row with one key of `least` characters: euctr_id, ctis_id, key. df: id, register, key."""
    rows = df.filter(F.length(key) >= least).select("id", "register", F.col(key).alias("key"))
    left, right = (rows.filter(F.col("register") == r).select("key", F.col("id").alias(f"{r.lower()}_id")) for r in ("EUCTR", "CTIS"))
    return left.join(right, "key").filter("euctr_id != ctis_id").select("euctr_id", "ctis_id", "key")


def first_shared_keys(df: DataFrame, key: str, n: int, least: int = 20) -> DataFrame:
    """The first n of these pairs by key, euctr_id and ctis_id, without making the others. An id stands once in a register.

    Each of the first n keys that have a pair gives one at least, and none of a key's first n pairs reaches beyond the n + 1
    smallest ids of either register (one may be its own counterpart, which is no pair). So at most n * (n + 1)^2 pairs are made.
    """
    rows = df.filter(F.length(key) >= least).select("id", "register", F.col(key).alias("key"))
    sides = [F.when(F.col("register") == r, F.col("id")) for r in ("EUCTR", "CTIS")]
    ends = [f(x).alias(f"{name}{k}") for k, x in enumerate(sides) for name, f in (("low", F.min), ("high", F.max))]
    paired = rows.groupBy("key").agg(*ends).filter("low0 IS NOT NULL AND low1 IS NOT NULL AND NOT (low0 = high1 AND high0 = low1)")
    some = rows.join(F.broadcast(paired.orderBy("key").limit(n).select("key")), "key", "left_semi")
    ranked = some.withColumn("_r", F.row_number().over(Window.partitionBy("key", "register").orderBy("id"))).filter(F.col("_r") <= n + 1).drop("_r")
    return top(shared_keys(ranked, "key", least), n, "key", "euctr_id", "ctis_id")


def duplicated(df: DataFrame, key: str) -> DataFrame:
    """Keys that several rows have, and how many."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def unmapped(df: DataFrame, raw: Column, known: list[str]) -> DataFrame:
    """Numeric codes that no mapping knows, by how many rows have them."""
    codes = df.select(raw.alias("raw")).filter(F.col("raw").rlike("^[0-9]+$") & ~F.col("raw").isin(known))
    return codes.groupBy("raw").agg(F.count("*").alias("n_trials"))


def lost(df: DataFrame, raw: str, normalised: str) -> DataFrame:
    """Raw values that became nothing, by how many rows have them."""
    gone = df.filter((F.coalesce(raw, F.lit("")) != "") & (F.coalesce(normalised, F.lit("")) == ""))
    return gone.groupBy(raw).agg(F.count("*").alias("n_trials"))


def still_coded(df: DataFrame, normalised: str) -> DataFrame:
    """Normalised values that are still numbers, by how many rows have them."""
    return df.filter(F.col(normalised).rlike("^[0-9]+$")).groupBy(normalised).agg(F.count("*").alias("n_trials"))


def top(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def version_table(df: DataFrame, base: str, version: str, kept: str) -> DataFrame:
    """Of bases with several versions: their number, the latest, its id, whether that one is kept, and all ids in order."""
    latest = F.max_by(F.struct("id", kept), F.struct(version, "id"))
    rows = df.groupBy(base).agg(F.count("*").alias("n_versions"), F.max(version).alias("latest"), latest.alias("m"), F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), " -> ").alias("all_versions"))
    return rows.filter("n_versions > 1").select(base, "n_versions", "latest", F.col("m.id").alias("latest_id"), F.col(f"m.{kept}").alias("latest_kept"), "all_versions")


def variant_table(df: DataFrame, base: str, variant: str) -> DataFrame:
    """Of each base: how many variants it has, and which."""
    return df.groupBy(base).agg(F.countDistinct(variant).alias("n_variants"), F.array_join(F.array_sort(F.collect_set(variant)), ", ").alias("variants"))


def collapse(log: DataFrame, raw: str, canonical: str, weight: str) -> DataFrame:
    """One row: strings, weight, canonicals, strings without one, and strings a canonical."""
    some = F.coalesce(canonical, F.lit("")) != ""
    one = log.agg(F.count("*").alias("strings"), F.sum(weight).alias("weight"), F.countDistinct(F.when(some, F.col(canonical))).alias("canonicals"), F.count_if(~some).alias("unlabelled"))
    return one.withColumn("ratio", F.col("strings") / F.nullif("canonicals", F.lit(0)))


def weighted(log: DataFrame, by: str, weight: str, missing: str | None = None) -> DataFrame:
    """The weight of each group; without `missing`, rows of no group do not count."""
    group = F.col(by) if missing is None else F.coalesce(by, F.lit(missing))
    return log.filter(group.isNotNull()).groupBy(group.alias(by)).agg(F.sum(weight).alias("weight"))


def share_of_group(df: DataFrame, by: str, hit: Column) -> DataFrame:
    """Each row with whether any and whether all of its group hit."""
    w = Window.partitionBy(by)
    return df.withColumns({"any_hit": F.bool_or(hit).over(w), "all_hit": F.bool_and(hit).over(w)})
