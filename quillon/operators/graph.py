"""Connected components and greedy canopies of pair graphs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.lineage import cut


def components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """nodes: id. pairs: a, b. The smallest id that each node reaches, as comp; labels go along pairs and jump along labels."""
    both = cut(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(nodes.select("id", F.col("id").alias("comp")))
    while True:
        offers = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("offer"))
        near = labels.join(offers, "id", "left").withColumn("next", F.least("comp", F.coalesce("offer", "comp")))
        jumps = near.select(F.col("id").alias("next"), F.col("next").alias("jump"))
        stepped = cut(near.join(jumps, "next", "left").select("id", F.col("comp").alias("was"), F.least("next", F.coalesce("jump", "next")).alias("comp")))
        labels = stepped.select("id", "comp")
        if not stepped.filter("was != comp").limit(1).count():
            return labels


def canopies(nodes: DataFrame, pairs: DataFrame, threshold: float = 0.5, most: int = 40, at_once: int = 100_000) -> DataFrame:
    """nodes: id, weight. pairs: a, b, score. Blocks of at most `most`: seeds by falling weight take their free neighbours.

    A component of strong pairs is closed under this. Components of up to `at_once` nodes and pairs are each worked on in
    one go; larger ones in rounds, of which each settles the seeds that no heavier free node within two steps can disturb.
    Both give the blocks that one pass over all nodes would.
    """
    strong = pairs.filter(F.col("score") >= threshold)
    comp = components(nodes.select("id"), strong)
    edges = strong.select(F.col("a").alias("id"), F.col("b").alias("to"), "score").unionByName(strong.select(F.col("b").alias("id"), F.col("a").alias("to"), "score")).filter("id != to")
    edges, rows = cut(edges.join(comp, "id")), cut(nodes.select("id", F.col("weight").cast("double").alias("weight")).join(comp, "id"))
    sizes = rows.select("comp").unionByName(edges.select("comp")).groupBy("comp").agg(F.count("*").alias("n"))
    large = cut(sizes.filter(F.col("n") > at_once).select("comp"))
    own = rows.withColumns({"to": F.lit(None).cast("long"), "score": F.lit(None).cast("double")}).select("comp", "id", "weight", "to", "score")
    near = edges.withColumn("weight", F.lit(None).cast("double")).select("comp", "id", "weight", "to", "score")
    small = own.unionByName(near).join(large, "comp", "left_anti").groupBy("comp").applyInPandas(lambda df: _blocks(df, most), "id long, block long")
    return small.unionByName(_rounds(rows.join(large, "comp", "left_semi"), edges.join(large, "comp", "left_semi"), most))


def _blocks(df: pd.DataFrame, most: int) -> pd.DataFrame:
    own, near, block = df[df["to"].isna()], df[df["to"].notna()].sort_values(["id", "score", "to"], ascending=[True, False, True]), {}
    by = {k: v["to"].astype("int64").tolist() for k, v in near.groupby("id")}
    for seed in own.sort_values(["weight", "id"], ascending=[False, True])["id"].tolist():
        if seed not in block:
            free = [x for x in by.get(seed, ()) if x not in block and x != seed][: most - 1]
            block |= dict.fromkeys([seed, *free], seed)
    return pd.DataFrame({"id": list(block), "block": list(block.values())})


def _rounds(nodes: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """The same for components that no task should hold. nodes: id, weight; edges: id, to, score, both ways."""
    free = cut(nodes.select("id", F.struct("weight", (-F.col("id")).alias("k")).alias("rank")))
    settled = free.select("id", F.col("id").alias("block")).filter("false")
    while not free.isEmpty():
        open_ = cut(edges.select("id", "to", "score").join(free.select("id"), "id", "left_semi").join(free.select(F.col("id").alias("to"), F.col("rank").alias("to_rank")), "to"))
        one = cut(free.join(open_.groupBy("id").agg(F.max("to_rank").alias("m")), "id", "left").select("id", "rank", F.greatest("rank", F.coalesce("m", "rank")).alias("best")))
        two = open_.join(one.select(F.col("id").alias("to"), "best"), "to").groupBy("id").agg(F.max("best").alias("m"))
        seeds = cut(one.join(two, "id", "left").filter((F.col("best") == F.col("rank")) & F.coalesce(F.col("m") == F.col("rank"), F.lit(True))).select("id"))
        order = Window.partitionBy("id").orderBy(F.desc("score"), "to")
        taken = open_.join(seeds, "id", "left_semi").dropDuplicates(["id", "to"]).withColumn("r", F.row_number().over(order)).filter(F.col("r") < most)
        now = cut(seeds.select("id", F.col("id").alias("block")).unionByName(taken.select(F.col("to").alias("id"), F.col("id").alias("block"))))
        settled, free = settled.unionByName(now), cut(free.join(now.select("id"), "id", "left_anti"))
    return settled
