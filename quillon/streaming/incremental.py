"""Increments: what is new, what a run may not break, and the same over a stream of landed files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators.frames import first_by


def backlog(new: DataFrame, key: str, *done: DataFrame) -> DataFrame:
    """Rows of new whose key none of the frames has."""
    for d in done:
        new = new.join(d.select(key), key, "left_anti")
    return new


def nightly_todo(new: DataFrame, assigned: DataFrame, deferred: DataFrame, most_attempts: int = 3) -> DataFrame:
    """New strings that are not assigned and have not failed too often. deferred: raw, attempts."""
    return backlog(new, "raw", assigned, deferred.filter(F.col("attempts") >= most_attempts))


def count_attempts(deferred: DataFrame, failed: DataFrame) -> DataFrame:
    """One more attempt for what failed, the rest as it was."""
    both = deferred.join(failed.select("raw").distinct().withColumn("f", F.lit(1)), "raw", "full")
    return both.select("raw", (F.coalesce("attempts", F.lit(0)) + F.coalesce("f", F.lit(0))).cast("int").alias("attempts"))


def label_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and new: _id, label, status. What became of each label."""
    a = first_by(old, ["_id"], F.col("label")).select("_id", F.col("label").alias("old_label"), F.col("status").alias("old_status"))
    b = first_by(new, ["_id"], F.col("label"))
    change = F.when(F.col("old_label") == F.col("label"), "unchanged").when((F.col("old_status") == "unknown") & (F.col("status") == "accepted"), "unknown -> accepted").when(F.col("status") == "unknown", "REGRESSION: -> unknown").otherwise("label changed")
    return b.join(a, "_id").withColumn("change", change)


def regression_gate(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Counts by change; raises on a regression, and where there is nothing to compare with."""
    if old is None:
        raise LookupError("no baseline to compare with")
    changes = label_changes(old, new)
    counts = changes.groupBy("change").agg(F.count("*").alias("n"))
    bad = changes.filter(F.col("change").startswith("REGRESSION")).limit(1).count()
    if bad:
        raise ValueError(f"labels were lost: {counts.collect()}")
    return counts


def violations(before: DataFrame, after: DataFrame, assigned_before: DataFrame, assigned_after: DataFrame) -> DataFrame:
    """Invariants of a run: a person's entities and assignments stay, merges stay, nothing shrinks. Rows are breaches."""
    pins = before.filter("decided_by = 'human'").join(after.select("entity_id", F.col("canonical").alias("c2")), "entity_id", "left").filter("c2 IS NULL OR c2 != canonical").select(F.lit("pin").alias("kind"), F.col("entity_id").alias("key"))
    points = assigned_before.filter("decided_by = 'human'").join(assigned_after.select("raw", F.col("entity_id").alias("e2")), "raw", "left").filter("e2 IS NULL OR e2 != entity_id").select(F.lit("assignment").alias("kind"), F.col("raw").alias("key"))
    merges = before.filter("merged_into IS NOT NULL").join(after.select("entity_id", F.col("merged_into").alias("m2")), "entity_id", "left").filter("m2 IS NULL").select(F.lit("merge").alias("kind"), F.col("entity_id").alias("key"))
    lost = before.select("entity_id").join(after.select("entity_id"), "entity_id", "left_anti").select(F.lit("lost").alias("kind"), F.col("entity_id").alias("key"))
    return pins.unionByName(points).unionByName(merges).unionByName(lost)


def stream_documents(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 1000) -> DataFrame:
    """Landed JSON as a stream; each file is read once, as the checkpoint knows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def run_increment(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Hands all that has landed since the last run to handle(batch, id), exactly once a batch if handle is idempotent by id."""
    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle).start()
    query.awaitTermination()


def windowed_counts(events: DataFrame, time: str, late: str = "10 minutes", length: str = "1 hour", *keys: str) -> DataFrame:
    """Counts by window, batch or stream; late rows beyond the watermark are not waited for in a stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


# --- what a run leaves behind ---

RUN = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("ended_at_utc", T.StringType()), T.StructField("status", T.StringType()), *[T.StructField(n, T.LongType()) for n in ("n_new", "n_assigned", "n_deferred")], T.StructField("cost_usd", T.DoubleType()), T.StructField("note", T.StringType())])


def record_run(spark: SparkSession, folder: str, **values) -> None:
    """Appends a row to the log of runs; a run that is recorded already is not recorded again."""
    row = spark.createDataFrame([tuple(values.get(f.name) for f in RUN.fields)], RUN)
    if _exists(spark, folder):
        row = row.join(spark.read.schema(RUN).parquet(folder).select("run_id"), "run_id", "left_anti").select(*RUN.fieldNames())
    row.write.mode("append").parquet(folder)


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """The log of runs, empty where none is recorded."""
    return spark.read.schema(RUN).parquet(folder) if _exists(spark, folder) else spark.createDataFrame([], RUN)


def write_backlog(todo: DataFrame, impact: DataFrame, path: str) -> None:
    """What is left to decide, those of most trials first. todo: raw; impact: raw, n_trials."""
    rows = todo.join(impact, "raw", "left").withColumn("n_trials", F.coalesce("n_trials", F.lit(0)))
    rows.orderBy(F.desc("n_trials"), "raw").write.mode("overwrite").csv(path, header=True)


def take_snapshot(tables: dict[str, DataFrame], root: str, version: str) -> None:
    """Writes each table under the version. A marker comes last, so that a snapshot that was cut short is none."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{version}/{name}")
    spark.range(1).write.mode("overwrite").parquet(f"{root}/{version}/_complete")


def snapshot(spark: SparkSession, root: str, version: str, *names: str) -> dict[str, DataFrame]:
    """The tables of a version, to go back to; raises where the version is not complete."""
    if not _exists(spark, f"{root}/{version}/_complete"):
        raise LookupError(f"no complete snapshot {version}")
    return {n: spark.read.parquet(f"{root}/{version}/{n}") for n in names}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
