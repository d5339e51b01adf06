"""Relational operators that several queries share. All are lazy and total: every top-k and every 'first' has a full order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.lineage import cut


def percent(hit: Column, of: Column, digits: int = 1) -> Column:
    """hit as a percentage of `of`, half to even; null where `of` is 0."""
    return F.bround(F.lit(100.0) * hit / F.nullif(of, F.lit(0)), digits)


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in this order, which must be total."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def top_k(df: DataFrame, key: str, n: int, by: str = "n") -> DataFrame:
    """The n keys with the largest `by`, ties by key."""
    return df.orderBy(F.desc(by), F.asc(key)).limit(n)


def top_k_ties(df: DataFrame, n: int, by: str = "n") -> DataFrame:
    """Rows whose `by` is among the n largest, ties with the last one included. df holds one row a category."""
    bar = df.select(by).orderBy(F.desc(by)).limit(n).agg(F.min(by).alias("_bar"))
    return df.join(F.broadcast(bar), F.col(by) >= F.col("_bar")).drop("_bar")


def top_per_group(df: DataFrame, group: str, key: str, n: int, by: str = "n") -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(by), F.asc(key)))).filter(F.col("_rn") <= n).drop("_rn")


def mode_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows and the most frequent value of each key, ties to the value that sorts first."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("_neg"), F.col(value).alias("_v")))
    return counts.groupBy(*keys).agg(F.sum("_n").alias("n"), best["_v"].alias(value))


def cooccurrence(df: DataFrame, id_: str, values: str, domain: DataFrame) -> DataFrame:
    """Pairs a < b of one array's values, counted over rows; domain: one column `value` with the values that count."""
    exploded = df.select(id_, F.explode(values).alias("value")).join(F.broadcast(domain), "value", "left_semi")
    own = exploded.groupBy(id_).agg(F.array_sort(F.collect_set("value")).alias("v"))
    pairs = own.select(F.posexplode("v").alias("i", "a"), "v").select("a", F.explode(F.slice("v", F.col("i") + 2, F.size("v"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


def symmetric(pairs: DataFrame) -> DataFrame:
    """Pairs in both directions: a matrix in rows."""
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))


def complete(df: DataFrame, keys: list[str], fill: dict) -> DataFrame:
    """All combinations of the keys' values; the domains are of categories, not of rows."""
    grid = df.agg(*[F.collect_set(k).alias(k) for k in keys])
    for k in keys:
        grid = grid.withColumn(k, F.explode(k))
    return grid.join(df, keys, "left").na.fill(fill)


def ecdf(df: DataFrame, group: str, value: str) -> DataFrame:
    """Cumulative distribution of value in each group; counts of equal values are combined before the window."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group)
    running = F.sum("n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return counts.select(group, value, (running / F.sum("n").over(w)).alias("ecdf"))


def log_histogram(df: DataFrame, value: str, *keys: str, per_decade: int = 10) -> DataFrame:
    """Counts in bins of equal width of log10(value), with each bin's bounds."""
    bin_ = F.floor(F.round(F.log10(F.col(value).cast("double")) * per_decade, 9)).cast("int")
    counts = df.filter(F.col(value) > 0).groupBy(*keys, bin_.alias("bin")).agg(F.count("*").alias("n"))
    low = F.greatest(F.lit(1), F.floor(F.pow(F.lit(10.0), F.col("bin") / per_decade))).cast("long")
    return counts.withColumns({"low": low, "high": F.ceil(F.pow(F.lit(10.0), (F.col("bin") + 1) / per_decade)).cast("long")})


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Of each column: rows that have it, and the percentage; one pass."""
    got = df.agg(F.count("*").alias("_all"), *[F.count(c).alias(c) for c in columns])
    return got.unpivot(["_all"], columns, "field", "n").select("field", "n", percent(F.col("n"), F.col("_all")).alias("pct"))


def missing_by(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Percentage of nulls of each column by group."""
    got = df.groupBy(group).agg(*[F.bround(F.avg(F.col(c).isNull().cast("int")) * 100, 1).alias(c) for c in columns])
    return got.unpivot([group], columns, "field", "pct_missing")


def waterfall(stages: DataFrame) -> DataFrame:
    """stages: step (int), remaining. Adds what each step removed; a handful of rows."""
    return stages.withColumn("removed", F.lag("remaining").over(Window.orderBy("step")) - F.col("remaining"))


def concentration(df: DataFrame, key: str) -> DataFrame:
    """Categories by falling count with rank and cumulative percentage.

    Categories are dealt in their order to as many ranges as the session has shuffle partitions; each range is summed up
    by itself, and one row a range says what comes before it.
    """
    order = [F.desc("n"), F.asc(key)]
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.groupBy(key).agg(F.count("*").alias("n")).repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    w = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("_range").agg(F.sum("n").alias("_n"), F.count("*").alias("_k"))
    before = before.select("_range", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_k").over(w), F.lit(0)).alias("_k0"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    own = Window.partitionBy("_range").orderBy(*order)
    out = dealt.join(F.broadcast(before), "_range")  # one row a range
    rank = (F.col("_k0") + F.row_number().over(own)).cast("int")
    running = F.col("_n0") + F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, 0))
    return out.select(key, "n", rank.alias("rank"), F.bround(100.0 * running / F.col("_all"), 1).alias("cum_pct"))


def grouping_total(counts: DataFrame, key: str, label: str = "All") -> DataFrame:
    """Counts and, under `label`, their sums over a key."""
    rest = [c for c in counts.columns if c not in (key, "n")]
    return counts.unionByName(counts.groupBy(*rest).agg(F.sum("n").alias("n")).withColumn(key, F.lit(label)))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and those of old whose key new lacks."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def raw_beside(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """One row a field of each id: what the source has, and what became of it."""
    fields = [F.struct(F.lit(name).alias("field"), F.col(raw).cast("string").alias("raw"), F.col(new).cast("string").alias("normalised")) for name, (raw, new) in pairs.items()]
    return df.select("id", F.explode(F.array(*fields)).alias("f")).select("id", "f.field", "f.raw", "f.normalised")
