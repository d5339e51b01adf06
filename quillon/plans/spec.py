"""Declarative aggregate queries over trials: one description, planned by Spark and written out as SQL for the oracle."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.plans.trials_view import BASE, DERIVED, LINES, SPONSOR, TRIALS_SQL

ALL_COLUMNS = {*BASE, *SPONSOR, *LINES, *DERIVED}


def percent(hit: str, of: str) -> str:
    """One decimal, half to even."""
    return f"CAST(100 AS DOUBLE) * {hit} / {of}"


@dataclass(frozen=True)
class Counts:
    """Rows of trials by keys.

    keys: name to an expression that both engines understand. explode: name to a multi-value column, one row a value,
    usable in keys and top. where: before, after_explode: behind the explosion. distinct: count trials, not rows.
    sums: name to an expression that is summed. rate: name to a condition; gives the name's count and pct of n.
    share: keys within which n's share is pct; () for all rows. totals: key that also gets rows for all its values,
    under that label. top: (key, n, ties): only the most frequent values of a key. least: HAVING n >=. cumulative: keys
    within which n is summed up in the order of the last key.
    """

    keys: dict[str, str]
    explode: dict[str, str] = field(default_factory=dict)
    where: str = "true"
    after_explode: str = "true"
    distinct: bool = False
    rate: tuple[str, str] | None = None
    share: tuple[str, ...] | None = None
    totals: tuple[str, str] | None = None
    top: tuple[str, int, bool] | None = None
    least: int = 1
    limit: int | None = None
    cumulative: tuple[str, ...] | None = None
    medians: dict[str, str] = field(default_factory=dict)

    def needs(self) -> list[str]:
        text = " ".join([*self.keys.values(), *self.explode.values(), self.where, self.after_explode, (self.rate or ("", ""))[1], *self.medians.values()])
        return sorted(ALL_COLUMNS & set(re.findall(r"\w+", text)))

    def flat(self) -> tuple[str, str] | None:
        """The name and column of the only explosion, where nothing else reads that column."""
        if len(self.explode) != 1:
            return None
        (name, column), *_ = self.explode.items()
        text = " ".join([*self.keys.values(), self.where, self.after_explode, (self.rate or ("", ""))[1], *self.medians.values()])
        others = set(re.findall(r"\w+", text))
        read = others | {x for c in others if c in DERIVED for x in DERIVED[c][0]}
        return (name, column) if column in LINES and LINES[column][2] and column not in read else None

    def run(self, trials: DataFrame, exploded: bool = False) -> DataFrame:
        """trials: with the columns that are needed; exploded: already one row a value of `flat`'s column."""
        df = trials.filter(self.where)
        for name, column in () if exploded else self.explode.items():
            df = df.withColumn(name, F.explode(column))
        df = df.filter(self.after_explode)
        extra = {"_hit": f"CASE WHEN {self.rate[1]} THEN 1 ELSE 0 END"} if self.rate else {}
        df = df.select("id", *[F.expr(e).alias(k) for k, e in {**self.keys, **extra, **{f"_m_{k}": e for k, e in self.medians.items()}}.items()])
        if not self.distinct and not self.medians:  # combined once; ranking and keeping read the small result, whose shuffle they share
            df = df.groupBy(*self.keys).agg(F.count("*").alias("_n"), *([F.sum("_hit").alias("_hit")] if self.rate else []))
            count, weight = F.sum("_n"), F.sum("_n")
        else:
            count, weight = F.countDistinct("id") if self.distinct else F.count("*"), F.count("*")
        if self.top:
            key, n, ties = self.top
            counted = df.filter(F.col(key).isNotNull()).groupBy(key).agg(weight.alias("_w"))
            if ties:
                best = counted.withColumn("_r", F.rank().over(Window.orderBy(F.desc("_w")))).filter(F.col("_r") <= n)
            else:
                best = counted.orderBy(F.desc("_w"), key).limit(n)
            df = df.join(F.broadcast(best.select(key)) if not ties else best.select(key), key, "left_semi")
        if self.totals:
            key, label = self.totals
            df = df.unionByName(df.withColumn(key, F.lit(label)))
        aggs = [count.cast("long").alias("n")]
        aggs += [F.sum("_hit").cast("long").alias(self.rate[0])] if self.rate else []
        aggs += [F.expr(f"percentile(_m_{k}, 0.5)").alias(k) for k in self.medians]
        out = df.groupBy(*self.keys).agg(*aggs).filter(F.col("n") >= self.least)
        if self.rate:
            out = out.withColumn("pct", F.bround(F.expr(percent(self.rate[0], "n")), 1))
        if self.share is not None:
            total = F.sum("n").over(Window.partitionBy(*self.share)) if self.share else F.sum("n").over(Window.partitionBy())
            out = out.withColumn("pct", F.bround(100.0 * F.col("n") / total, 1))
        if self.cumulative is not None:
            last = [*self.keys][-1]
            out = out.withColumn("cumulative", F.sum("n").over(Window.partitionBy(*self.cumulative).orderBy(last).rowsBetween(Window.unboundedPreceding, 0)))
        if self.limit:
            out = out.orderBy(F.desc("n"), *self.keys).limit(self.limit)
        return out

    def sql(self) -> str:
        columns = {**self.keys, **({"_hit": f"CASE WHEN {self.rate[1]} THEN 1 ELSE 0 END"} if self.rate else {}), **{f"_m_{k}": e for k, e in self.medians.items()}}
        exploded = "SELECT * FROM t" + f" WHERE {self.where}"
        for name, column in self.explode.items():
            exploded = f"SELECT *, unnest({column}) AS {name} FROM ({exploded})"
        parts = [f"_e AS (SELECT * FROM ({exploded}) WHERE {self.after_explode})", "_k AS (SELECT id, " + ", ".join(f"{e} AS {k}" for k, e in columns.items()) + " FROM _e)"]
        source = "_k"
        if self.top:
            key, n, ties = self.top
            counted = f"SELECT {key}, count(*) AS _n FROM _k WHERE {key} IS NOT NULL GROUP BY {key}"
            best = f"SELECT {key} FROM (SELECT {key}, rank() OVER (ORDER BY _n DESC) AS _r FROM ({counted})) WHERE _r <= {n}" if ties else f"SELECT {key} FROM ({counted}) ORDER BY _n DESC, {key} LIMIT {n}"
            parts.append(f"_t AS (SELECT * FROM _k WHERE {key} IN ({best}))")
            source = "_t"
        if self.totals:
            key, label = self.totals
            parts.append(f"_u AS (SELECT * FROM {source} UNION ALL BY NAME SELECT * REPLACE ('{label}' AS {key}) FROM {source})")
            source = "_u"
        keys = ", ".join(self.keys)
        select = [keys, ("count(DISTINCT id)" if self.distinct else "count(*)") + " AS n"]
        select += [f"CAST(sum(_hit) AS BIGINT) AS {self.rate[0]}"] if self.rate else []
        select += [f"quantile_cont(_m_{k}, 0.5) AS {k}" for k in self.medians]
        parts.append(f"_g AS (SELECT {', '.join(select)} FROM {source} GROUP BY {keys} HAVING count({'DISTINCT id' if self.distinct else '*'}) >= {self.least})")
        out = ["*"]
        if self.rate:
            out.append(f"round_even({percent(self.rate[0], 'n')}, 1) AS pct")
        if self.share is not None:
            over = f"PARTITION BY {', '.join(self.share)}" if self.share else ""
            out.append(f"round_even(CAST(100 AS DOUBLE) * n / sum(n) OVER ({over}), 1) AS pct")
        if self.cumulative is not None:
            over = f"PARTITION BY {', '.join(self.cumulative)} " if self.cumulative else ""
            out.append(f"CAST(sum(n) OVER ({over}ORDER BY {[*self.keys][-1]} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative")
        tail = f" ORDER BY n DESC, {keys} LIMIT {self.limit}" if self.limit else ""
        return TRIALS_SQL + ", " + ",\n ".join(parts) + f"\nSELECT {', '.join(out)} FROM _g{tail}"


#: Statistics of a numeric column, as the reports tabulate them.
STATISTICS = {
    "total": ("CAST(round(sum(v), 2) AS DOUBLE)", "CAST(round(sum(v), 2) AS DOUBLE)"),
    "mean": ("round(avg(v), 4)", "round(avg(v), 4)"),
    "median": ("round(percentile(v, 0.5), 6)", "round(quantile_cont(v, 0.5), 6)"),
    "q1": ("round(percentile(v, 0.25), 6)", "round(quantile_cont(v, 0.25), 6)"),
    "q3": ("round(percentile(v, 0.75), 6)", "round(quantile_cont(v, 0.75), 6)"),
    "sd": ("round(stddev_samp(v), 4)", "round(stddev_samp(v), 4)"),
    "least": ("CAST(min(v) AS DOUBLE)", "CAST(min(v) AS DOUBLE)"),
    "most": ("CAST(max(v) AS DOUBLE)", "CAST(max(v) AS DOUBLE)"),
}


@dataclass(frozen=True)
class Statistics:
    """Exact descriptive statistics of a numeric expression by keys; totals as in Counts."""

    value: str
    keys: dict[str, str]
    where: str = "true"
    totals: tuple[str, str] | None = None
    least: int = 1
    which: tuple[str, ...] = tuple(STATISTICS)

    def needs(self) -> list[str]:
        return sorted(ALL_COLUMNS & set(re.findall(r"\w+", " ".join([self.value, self.where, *self.keys.values()]))))

    def run(self, trials: DataFrame) -> DataFrame:
        df = trials.filter(self.where).select(*[F.expr(e).alias(k) for k, e in self.keys.items()], F.expr(f"CAST({self.value} AS DOUBLE)").alias("v")).filter("v IS NOT NULL")
        if self.totals:
            key, label = self.totals
            df = df.unionByName(df.withColumn(key, F.lit(label)))
        return df.groupBy(*self.keys).agg(F.count("*").alias("n"), *[F.expr(STATISTICS[s][0]).alias(s) for s in self.which]).filter(F.col("n") >= self.least)

    def sql(self) -> str:
        keys = ", ".join(f"{e} AS {k}" for k, e in self.keys.items())
        parts = [f"_k AS (SELECT {keys + ', ' if keys else ''}CAST({self.value} AS DOUBLE) AS v FROM t WHERE {self.where})", "_v AS (SELECT * FROM _k WHERE v IS NOT NULL)"]
        source = "_v"
        if self.totals:
            key, label = self.totals
            parts.append(f"_u AS (SELECT * FROM _v UNION ALL BY NAME SELECT * REPLACE ('{label}' AS {key}) FROM _v)")
            source = "_u"
        names = ", ".join(self.keys)
        stats = ", ".join(f"{STATISTICS[s][1]} AS {s}" for s in self.which)
        group = f" GROUP BY {names} HAVING count(*) >= {self.least}" if names else ""
        return TRIALS_SQL + ", " + ", ".join(parts) + f" SELECT {names + ', ' if names else ''}count(*) AS n, {stats} FROM {source}{group}"
