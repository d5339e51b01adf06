"""Where data come in and go out: landed documents, typed CSV, logs and exports."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import trial as X
from quillon.functions.text import blank_to_null, extract, split_list
from quillon.operators.frames import first_by
from quillon.schema import PIP_DECISION, TRIAL_DOCUMENT


def quarters(year: int) -> list[tuple[date, date]]:
    starts = [date(year, m, 1) for m in (1, 4, 7, 10)] + [date(year + 1, 1, 1)]
    return [(a, b - timedelta(days=1)) for a, b in zip(starts, starts[1:])]


def load_ranges(start: date, end: date, load, fallback, most_depth: int = 8) -> list[tuple[date, date, str]]:
    """Loads a range of dates; a range that fails is halved, and one that cannot be halved goes to fallback.

    load(start, end) says whether it worked; it writes landing files and must be idempotent by range.
    """
    done: list[tuple[date, date, str]] = []

    def go(a: date, b: date, depth: int) -> None:
        if load(a, b):
            done.append((a, b, "bulk"))
        elif depth >= most_depth or a == b:
            fallback(a, b)
            done.append((a, b, "fallback"))
        else:
            middle = a + (b - a) // 2
            go(a, middle, depth + 1)
            go(middle + timedelta(days=1), b, depth + 1)

    go(start, end, 0)
    return done


def missing_ranges(ranges: DataFrame, log: DataFrame) -> DataFrame:
    """Ranges that the log of completed ones lacks."""
    return ranges.join(log, ["start", "end"], "left_anti")


def ids_in_pages(pages: DataFrame, column: str = "html") -> DataFrame:
    """Trial numbers in landed summary pages."""
    return pages.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(r"(\d{4}-\d{6}-\d{2})"), 1)).alias("id")).distinct()


def read_documents(spark: SparkSession, path: str, schema: T.StructType = TRIAL_DOCUMENT) -> DataFrame:
    """Landed JSON with its schema declared, so that only the paths that are used are parsed."""
    return spark.read.schema(schema).json(path)


def upsert_documents(old: DataFrame, new: DataFrame, loaded: str = "loaded_at") -> DataFrame:
    """The latest load of each document."""
    return first_by(old.unionByName(new), ["_id"], F.col(loaded).desc_nulls_last())


def drop_orphans(documents: DataFrame) -> DataFrame:
    """Without records that no register's name is on."""
    return documents.filter("ctrname IS NOT NULL")


def bernoulli(documents: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """A sample by a hash of the id: the same rows in every run and on every layout."""
    return documents.filter(F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(1_000_000)) < int(fraction * 1_000_000))


def transitions(raw: DataFrame, column: str = "json") -> DataFrame:
    """Records of text JSON whose status speaks of a transition."""
    status = F.get_json_object(F.col(column), "$.x5_trial_status")
    return raw.filter(F.lower(status).like("%transition%")).select("_id", status.alias("status"))


def read_padded_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV of text columns; those that it lacks are null."""
    df = spark.read.csv(path, header=True)
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def read_optional_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame | None:
    """As above, or None where nothing is at the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return read_padded_csv(spark, path, columns) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else None


def read_headed_csv(spark: SparkSession, path: str, wanted: list[str], within: int = 50) -> DataFrame:
    """A sheet as CSV whose header comes after some lines of other text: the first of `within` lines that has all wanted names."""
    first = [r["value"] for r in spark.read.text(path).limit(within).collect()]
    names = lambda line: [c.strip().strip('"').strip().lower() for c in line.split(",")]
    at = next((k for k, line in enumerate(first) if {w.lower() for w in wanted} <= set(names(line))), None)
    if at is None:
        raise ValueError(f"no header with {', '.join(wanted)} in the first {within} lines")
    header, schema = names(first[at]), T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(names(first[at])))])
    before = first[: at + 1]
    rows = spark.read.text(path).filter(~F.col("value").isin(before)) if before else spark.read.text(path)
    parsed = rows.select(F.from_csv("value", ", ".join(f"{f.name} string" for f in schema.fields)).alias("r")).select("r.*").toDF(*header)
    return parsed.select(*[F.trim(F.col(f"`{w.lower()}`")).alias(w) for w in wanted])


def replace_table(df: DataFrame, path: str) -> None:
    """Writes beside the old table and then moves the new one into its place, so that readers find the one or the other, whole."""
    spark = df.sparkSession
    new, old = (spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{x}") for x in ("new", "old"))
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(f"{path}.new")
    store.delete(old, True)
    if store.exists(target) and not store.rename(target, old):
        raise OSError(f"{path} cannot be moved aside")
    if not store.rename(new, target):
        store.rename(old, target)
        raise OSError(f"{path} cannot be replaced")
    store.delete(old, True)


def assert_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def cache_is_valid(df: DataFrame, columns: list[str], version: str = X.DATA_PROCESSING_VERSION) -> bool:
    """Whether a prepared table has the columns and the version that this code writes."""
    return all(c in df.columns for c in columns) and df.select("data_processing_version").distinct().limit(2).collect() == [Row(data_processing_version=version)]


def pip_feed(spark: SparkSession, path: str) -> DataFrame:
    """The decisions of a JSON feed {"data": [...]}, typed."""
    data = T.StructType([T.StructField("data", T.ArrayType(T.StructType([T.StructField(f.name, T.StringType()) for f in PIP_DECISION.fields])))])
    rows = spark.read.schema(data).json(path, multiLine=True).select(F.inline("data"))
    number, procedure = X.pip_decision_number(F.col("pip_decision_number")), X.pip_procedure_number(F.col("pip_procedure_number"))
    return rows.select(*[(number if f.name == "pip_decision_number" else procedure if f.name == "pip_procedure_number" else F.col(f.name).try_cast(f.dataType)).alias(f.name) for f in PIP_DECISION.fields])


def page_fields(pages: DataFrame, column: str = "html") -> DataFrame:
    """Fields of landed decision pages: dt/dd pairs by name, and flags from the text."""
    html = F.col(column)
    field = lambda name: blank_to_null(F.regexp_replace(F.regexp_extract(html, rf"(?is)<dt[^>]*>\s*{name}\s*</dt>\s*<dd[^>]*>(.*?)</dd>", 1), "<[^>]+>", " "))
    text = F.lower(F.regexp_replace(html, "<[^>]+>", " "))
    kind = field("Decision type")
    code = F.when(F.lower(kind).contains("waiver"), "W").when(F.lower(kind).contains("modif"), "PM").when(F.lower(kind).contains("refus"), "RP").when(kind.isNotNull(), "P")
    return pages.select(
        *[c for c in pages.columns if c != column], field("Active substance").alias("active_substance"), field("Therapeutic area").alias("therapeutic_area"), kind.alias("decision_type_text"), code.alias("decision_type_code"),
        F.coalesce(X.pip_decision_number(field("Decision number")), X.pip_decision_number(html)).alias("pip_decision_number"), text.rlike("full waiver|waiver in all").alias("has_full_waiver"), text.rlike("partial waiver|waiver for").alias("has_partial_waiver"), text.rlike("deferral").alias("has_deferral"),
    )


def chembl_aliases(molecules: DataFrame) -> DataFrame:
    """molecules: pref_name, molecule_synonyms (array of syn_type, molecule_synonym). One alias a row."""
    rows = molecules.select(F.lower("pref_name").alias("substance_clean"), F.explode("molecule_synonyms").alias("s"))
    kind = F.when(F.col("s.syn_type") == "TRADE_NAME", "trade_name").when(F.col("s.syn_type") == "USAN", "usan").when(F.col("s.syn_type") == "BAN", "ban").otherwise("chembl_synonym")
    return rows.select(F.lower("s.molecule_synonym").alias("alias_clean"), "substance_clean", kind.alias("alias_type"), F.lit("chembl").alias("source")).distinct()


def sponsor_export(raw: DataFrame) -> DataFrame:
    """_id, raw_sponsor and is_commercial, once an id. raw: the flat frame of plans.prepare."""
    name = F.coalesce(F.element_at(F.split("sponsor_e", " / "), 1), F.col("sponsor_c"))
    kind = X.sponsor_type(F.coalesce("sponsor_kind_e", "sponsor_kind_c"))
    rows = raw.select("_id", name.alias("raw_sponsor"), F.when(kind == "Industry", True).when(kind == "Academic", False).alias("is_commercial")).filter("raw_sponsor IS NOT NULL")
    return first_by(rows, ["_id"], F.col("raw_sponsor"))


def substance_export(unified: DataFrame) -> DataFrame:
    """Distinct (_id, raw_substance): the INN where there is one, else the product."""
    text = F.coalesce(blank_to_null(F.col("DIMP_inn_name")), F.col("DIMP_product_name"))
    return unified.select("_id", F.explode(split_list(text)).alias("raw_substance")).distinct()


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV with a header; for results that a person downloads."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def country_of(id_: str = "_id"):
    return extract(F.col(id_), r"([A-Z]{2,3})$", 1)
