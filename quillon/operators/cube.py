"""The ad-hoc cube: counts of trials by one or two dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.frames import percent, top_k
from quillon.plans import bins

#: Dimension to its expression over trials; those in MULTI are arrays, one row a value; those in TOP show the most frequent.
DIMENSIONS = {
    "status": "status", "register": "register", "analysis_register": "coalesce(analysis_register, register)", "year": "year", "phase": "phases",
    "country": "countries", "organ": "organs", "term": "terms", "substance": "substances", "sponsor": "sponsor", "sponsor_type": "sponsor_type",
    "age_group": "age_group", "has_pip": "has_pip", "is_orphan": "is_orphan", "results": bins.RESULTS, "scope": bins.SCOPE,
    "participants": bins.PARTICIPANTS, "duration": bins.DURATION, "spread": bins.SPREAD,
}
MULTI = {"phase", "country", "organ", "term", "substance"}
TOP = {"country", "organ", "term", "substance", "sponsor"}

#: Population that normalises countries, by the age filter.
POPULATION = {"<18": "child_pop", "≥18": "adult_pop", "All": "total_pop"}


def _dimension(df: DataFrame, name: str, alias: str) -> DataFrame:
    e: Column = F.expr(DIMENSIONS[name])
    return df.withColumn(alias, F.explode(e) if name in MULTI else e).filter(F.col(alias).isNotNull() & (F.col(alias).cast("string") != ""))


def explore(trials: DataFrame, x: str, group: str | None = None, top_n: int = 8) -> DataFrame:
    """x_val, grp_val (with a group) and n. top_n is held to 3 to 20."""
    n = max(3, min(20, top_n))
    df = _dimension(trials, x, "x_val")
    if x in TOP:
        df = df.join(F.broadcast(top_k(df.groupBy("x_val").agg(F.count("*").alias("n")), "x_val", n).select("x_val")), "x_val", "left_semi")
    if group is None:
        return df.groupBy("x_val").agg(F.count("*").alias("n"))
    df = _dimension(df, group, "grp_val")
    best = top_k(df.groupBy("grp_val").agg(F.count("*").alias("n")), "grp_val", n).select("grp_val")
    return df.join(F.broadcast(best), "grp_val", "left_semi").groupBy("x_val", "grp_val").agg(F.count("*").alias("n"))


def table(cube: DataFrame) -> DataFrame:
    """The cube with each cell's share of the total and, without a group, the running share."""
    total = F.sum("n").over(Window.partitionBy())
    out = cube.withColumn("pct", percent(F.col("n"), total))
    if "grp_val" in cube.columns:
        return out
    return out.withColumn("cum_pct", percent(F.sum("n").over(Window.orderBy("x_val").rowsBetween(Window.unboundedPreceding, 0)), total))


def within_x(cube: DataFrame) -> DataFrame:
    """Each cell's share of its x, as percent-stacked bars show it."""
    return cube.withColumn("pct", percent(F.col("n"), F.sum("n").over(Window.partitionBy("x_val"))))


def stats(cube: DataFrame) -> DataFrame:
    """Total, mean, median, sd, min and max of the cells, by group if there is one."""
    aggs = [F.sum("n").alias("total"), F.bround(F.avg("n"), 1).alias("mean"), F.bround(F.expr("percentile(n, 0.5)"), 1).alias("median"), F.bround(F.stddev_samp("n"), 1).alias("sd"), F.min("n").alias("least"), F.max("n").alias("most")]
    return cube.groupBy("grp_val").agg(*aggs) if "grp_val" in cube.columns else cube.agg(*aggs)


def per_million(cube: DataFrame, key: str, populations: DataFrame, age: str = "<18") -> DataFrame:
    """n per million people of the country in `key`. populations: country and the columns of POPULATION, in thousands."""
    pop = F.col(POPULATION[age])
    dims = populations.select(F.col("country").alias(key), pop)
    return cube.join(F.broadcast(dims), key, "left").withColumn("n", F.when(pop > 0, F.bround(F.col("n") / (pop / 1000), 1))).drop(POPULATION[age])
