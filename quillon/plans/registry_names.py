"""Named queries over the entity registry and record linkage, each with SQL of the same result.

The registry has an entity for each part: its name, the name in capitals, the name as a salt, or the brand, by turns.
Raw strings are the names of parts with a dose, assigned by turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import graph, linkage, upkeep
from quillon.operators import registry as R
from quillon.operators.frames import first_by
from quillon.schema import ASSIGNMENTS, REGISTRY, SPEND

QUERIES: dict = {}
ORACLES: dict = {}


def _typed(df: DataFrame, schema, **columns) -> DataFrame:
    return df.select(*[columns[f.name].cast(f.dataType).alias(f.name) if f.name in columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def _part(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet")


def entities(spark: SparkSession, d: str) -> DataFrame:
    k, name = F.col("p_partkey"), F.col("p_name")
    canonical = F.when(k % 4 == 0, name).when(k % 4 == 1, F.upper(name)).when(k % 4 == 2, F.concat(name, F.lit(" sodium"))).otherwise(F.concat_ws(" ", "p_brand", "p_type"))
    merged = F.when(k % 9 == 8, F.format_string("ent_%06d", k - 4))
    return _typed(_part(spark, d), REGISTRY, entity_id=F.format_string("ent_%06d", k), canonical=canonical, merged_into=merged, decided_by=F.when(k % 5 == 0, "human").otherwise("model"))


def assigned(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return _typed(_part(spark, d), ASSIGNMENTS, raw=F.concat("p_name", F.lit(" "), k.cast("string"), F.lit(" mg")), entity_id=F.format_string("ent_%06d", F.floor(k / 2)), confidence=(k % 10) / 10.0, decided_by=F.when(k % 7 == 0, "human").otherwise("model"))


#: e: entities with final_id, the one they are merged into or themselves (what is merged into is never merged itself); a: assignments.
SQL = """WITH e AS (SELECT p_partkey AS k, printf('ent_%06d', p_partkey) AS entity_id, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN p_name || ' sodium' ELSE p_brand || ' ' || p_type END AS canonical,
 CASE WHEN p_partkey % 9 = 8 THEN printf('ent_%06d', p_partkey - 4) END AS merged_into, CASE WHEN p_partkey % 5 = 0 THEN 'human' ELSE 'model' END AS decided_by, coalesce(CASE WHEN p_partkey % 9 = 8 THEN printf('ent_%06d', p_partkey - 4) END, printf('ent_%06d', p_partkey)) AS final_id FROM part),
 a AS (SELECT p_partkey AS k, p_name || ' ' || p_partkey || ' mg' AS raw, printf('ent_%06d', CAST(floor(p_partkey / 2) AS BIGINT)) AS entity_id, CASE WHEN p_partkey % 7 = 0 THEN 'human' ELSE 'model' END AS decided_by FROM part)
"""


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


# --- the registry ---


@query(SQL + ", f AS (SELECT final_id, count(*) AS n FROM a JOIN e USING (entity_id) GROUP BY 1), l AS (SELECT entity_id, canonical, lower(canonical) AS key, coalesce(n, 0) AS n FROM e LEFT JOIN f ON f.final_id = e.entity_id WHERE merged_into IS NULL), w AS (SELECT *, first_value(entity_id) OVER (PARTITION BY key ORDER BY n DESC, entity_id) AS winner_id FROM l) SELECT entity_id AS loser_id, winner_id, 'duplicate canonical ''' || canonical || '''' AS reason FROM w WHERE entity_id <> winner_id")
def q_registry_duplicates(spark, d):
    return upkeep.duplicates(entities(spark, d), assigned(spark, d))


@query(SQL + ", r AS (SELECT DISTINCT lower(p_name) AS key, 'new ' || p_brand AS new FROM part WHERE p_partkey % 50 = 0 QUALIFY row_number() OVER (PARTITION BY lower(p_name) ORDER BY 'new ' || p_brand) = 1), h AS (SELECT e.entity_id, new, lower(new) AS target FROM e JOIN r ON lower(e.canonical) = r.key WHERE merged_into IS NULL), m AS (SELECT target, min(entity_id) AS first FROM h GROUP BY 1) SELECT e.entity_id, CASE WHEN h.entity_id = first THEN new ELSE canonical END AS canonical, coalesce(merged_into, CASE WHEN h.entity_id <> first THEN first END) AS merged_into FROM e LEFT JOIN (h JOIN m USING (target)) ON h.entity_id = e.entity_id")
def q_registry_renames(spark, d):
    """Names in another standard: renamed, or merged where the name is taken."""
    table = _part(spark, d).filter("p_partkey % 50 = 0").select(F.col("p_name").alias("old"), F.concat(F.lit("new "), "p_brand").alias("new"))
    return upkeep.rename(entities(spark, d), table).select("entity_id", "canonical", "merged_into")


_OVERRIDES = "o AS (SELECT p_name || ' ' || p_partkey || ' mg' AS raw, CASE WHEN p_partkey % 30 = 0 THEN '' WHEN p_partkey % 20 = 0 THEN 'pinned ' || p_brand ELSE p_name END AS canonical FROM part WHERE p_partkey % 10 = 0)"


@query(
    SQL
    + f", {_OVERRIDES}, k AS (SELECT lower(canonical) AS key, min(entity_id) AS entity_id FROM e GROUP BY 1), n AS (SELECT DISTINCT canonical FROM o WHERE canonical <> '' AND lower(canonical) NOT IN (SELECT key FROM k)), g AS (SELECT lower(canonical) AS key, printf('ent_%06d', (SELECT max(k) FROM e) + row_number() OVER (ORDER BY canonical)) AS entity_id FROM n), b AS (SELECT * FROM k UNION ALL SELECT * FROM g), p AS (SELECT raw, b.entity_id FROM o JOIN b ON lower(o.canonical) = b.key WHERE canonical <> '')"
    + " SELECT raw, entity_id, 'pinned' AS kind FROM p UNION ALL SELECT raw, entity_id, 'kept' FROM a WHERE raw NOT IN (SELECT raw FROM p) UNION ALL SELECT raw, NULL, 'none' FROM o WHERE canonical = ''"
)
def q_registry_overrides(spark, d):
    """A person's mappings over the assignments: new entities are numbered on, an empty name is none."""
    k = F.col("p_partkey")
    table = _part(spark, d).filter(k % 10 == 0).select(F.concat("p_name", F.lit(" "), k.cast("string"), F.lit(" mg")).alias("raw"), F.when(k % 30 == 0, "").when(k % 20 == 0, F.concat(F.lit("pinned "), "p_brand")).otherwise(F.col("p_name")).alias("canonical"), F.lit(None).cast("string").alias("reason"))
    _, rows, rejected = upkeep.pin(entities(spark, d), assigned(spark, d), table)
    kept = rows.select("raw", "entity_id", F.when(F.col("channel") == "manual", "pinned").otherwise("kept").alias("kind"))
    return kept.unionByName(rejected.select("raw", F.lit(None).cast("string").alias("entity_id"), F.lit("none").alias("kind")))


_MERGES = "m AS (SELECT entity_id AS loser_id, printf('ent_%06d', k - 1) AS winner_id FROM e WHERE k % 12 = 7 AND decided_by <> 'human')"


@query(SQL + f", {_MERGES}, r AS (SELECT e.*, coalesce(merged_into, winner_id) AS into_id FROM e LEFT JOIN m ON loser_id = entity_id), s AS (SELECT r.entity_id, r.into_id, coalesce(z.into_id, y.into_id, r.into_id, r.entity_id) AS final FROM r LEFT JOIN r y ON y.entity_id = r.into_id LEFT JOIN r z ON z.entity_id = y.into_id) SELECT a.raw, CASE WHEN a.decided_by = 'human' THEN a.entity_id ELSE s.final END AS entity_id FROM a JOIN s USING (entity_id)")
def q_registry_merges(spark, d):
    """Assignments after merges: a person's entities and assignments stay."""
    reg = entities(spark, d)
    number = F.substring("entity_id", 5, 20).cast("long")
    merges = reg.filter(number % 12 == 7).select(F.col("entity_id").alias("loser_id"), F.format_string("ent_%06d", number - 1).alias("winner_id"), F.lit("told").alias("reason"))
    return R.apply_merges(reg, assigned(spark, d), merges)[1].select("raw", "entity_id")


@query(SQL + " SELECT entity_id, canonical AS label FROM e WHERE merged_into IS NULL UNION SELECT e.final_id, raw FROM a JOIN e USING (entity_id)")
def q_surface_forms(spark, d):
    return R.surface_forms(entities(spark, d), assigned(spark, d)).select("entity_id", "label")


@query(SQL + " SELECT a.raw, e.final_id AS entity_id, l.canonical FROM a JOIN e USING (entity_id) JOIN e l ON l.entity_id = e.final_id")
def q_resolved_labels(spark, d):
    return R.resolve_labels(entities(spark, d), assigned(spark, d)).select("raw", "entity_id", "canonical")


@query(SQL + ", i AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY 1) SELECT e.entity_id, CAST(coalesce(sum(i.n), 0) AS BIGINT) AS n_trials FROM e LEFT JOIN a ON a.entity_id = e.entity_id LEFT JOIN i ON i.k = a.k WHERE e.merged_into IS NULL GROUP BY 1")
def q_trials_per_entity(spark, d):
    impact = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_partkey").agg(F.count("*").alias("n_trials"))
    named = impact.join(_part(spark, d), F.col("l_partkey") == F.col("p_partkey")).select(F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"), F.lit(" mg")).alias("raw"), "n_trials")
    return R.trials_per_entity(assigned(spark, d), named, entities(spark, d)).select("entity_id", "n_trials")


@query(SQL + " SELECT raw, 'no candidates' AS reason FROM a WHERE entity_id NOT IN (SELECT entity_id FROM e WHERE k % 3 = 0)")
def q_abstained(spark, d):
    rows = assigned(spark, d)
    number = F.substring("entity_id", 5, 20).cast("long")
    return upkeep.abstain(rows, rows.join(entities(spark, d).filter(number % 3 == 0).select("entity_id"), "entity_id"))


@query("SELECT event_id % 500 AS raw_id, event_type AS verdict FROM events QUALIFY row_number() OVER (PARTITION BY event_id % 500 ORDER BY ts DESC, event_id DESC) = 1")
def q_last_verdicts(spark, d):
    """Both lists that the cached decisions give, and the rest, as the last verdict of each string."""
    events = spark.read.parquet(f"{d}/events.parquet")
    kinds = {"view": "not_a_substance", "click": "abstain"}
    verdict = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("event_type")), F.col("event_type"))
    decisions = events.select((F.col("event_id") % 500).cast("string").alias("raw"), verdict.alias("verdict"), F.lit(None).cast("string").alias("reason"), F.format_string("%020d-%020d", F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_id")).alias("decided_at_utc"))
    none, undecided = upkeep.lists_from_decisions(decisions, decisions.filter("false"))
    other = first_by(decisions, ["raw"], F.col("decided_at_utc").desc()).filter(~F.col("verdict").isin("not_a_substance", "abstain"))
    parts = [none.select("raw", F.lit("view").alias("verdict")), undecided.select("raw", F.lit("click").alias("verdict")), other.select("raw", "verdict")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select(F.col("raw").cast("long").alias("raw_id"), "verdict")


@query(
    """WITH u AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'small' ELSE 'large' END AS model_id, CAST(ts AS DATE) AS day, event_id % 1000 AS i, event_id % 300 AS o FROM events),
 p AS (SELECT *, CASE model_id WHEN 'small' THEN 1.0 ELSE 3.0 END AS pi, CASE model_id WHEN 'small' THEN 5.0 ELSE 15.0 END AS po FROM u)
SELECT model_id, CAST(count(*) AS BIGINT) AS batches, round(sum(i * CAST(pi AS DOUBLE) + o * CAST(po AS DOUBLE)) / 1e6, 6) AS cost_usd FROM p GROUP BY 1"""
)
def q_model_spend(spark, d):
    """What models cost, by dated prices; batches that are booked twice count once."""
    events = spark.read.parquet(f"{d}/events.parquet")
    k = F.col("event_id")
    usage = _typed(events, SPEND, recorded_at_utc=F.col("ts").cast("date").cast("string"), batch_id=k, model_id=F.when(k % 2 == 0, "small").otherwise("large"), n_requests=F.lit(1), input_tokens=k % 1000, output_tokens=k % 300, cache_read_tokens=F.lit(0))
    prices = spark.createDataFrame([("small", "2000-01-01", None, 1.0, 5.0, 0.1), ("large", "2000-01-01", None, 3.0, 15.0, 0.3)], "model_id string, valid_from string, valid_to string, input_usd double, output_usd double, cache_usd double")
    priced = R.cost(prices, usage)
    book = R.record_spend(priced.filter(F.col("batch_id").cast("long") % 3 == 0), priced)
    return book.groupBy("model_id").agg(F.count("*").alias("batches"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))


# --- linkage ---

_LABELS = "l AS (SELECT min(p_partkey) AS id, p_name || ' ' || p_brand AS label FROM part GROUP BY 2), f AS (SELECT id, label, trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) AS form FROM l)"


def _vocabulary(spark, d):
    return _part(spark, d).groupBy(F.concat_ws(" ", "p_name", "p_brand").alias("label")).agg(F.min("p_partkey").alias("id"))


def _strings(spark, d):
    """Every part's label, in capitals with other signs."""
    return _part(spark, d).select(F.col("p_partkey").alias("query"), F.upper(F.concat_ws(" - ", "p_name", "p_brand")).alias("text"))


@query(f"WITH {_LABELS}, q AS (SELECT p_partkey AS query, trim(regexp_replace(lower(p_name || ' - ' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS form FROM part) SELECT query, id FROM q JOIN f USING (form)")
def q_exact_matches(spark, d):
    return linkage.exact(_strings(spark, d), linkage.build_index(_vocabulary(spark, d), generic=[])).select("query", "id")


_ACRONYM = "list_aggregate(list_transform(list_filter(string_split(form, ' '), lambda w: length(w) >= 2), lambda w: w[1]), 'string_agg', '')"


@query(f"WITH {_LABELS}, c AS (SELECT id, {_ACRONYM} AS acronym FROM f), q AS (SELECT DISTINCT p_brand AS query, form FROM part JOIN f ON f.id = part.p_partkey), o AS (SELECT id AS query, {_ACRONYM} AS acronym FROM f UNION SELECT id, replace(form, ' ', '') FROM f WHERE length(replace(form, ' ', '')) <= 6), h AS (SELECT DISTINCT o.query, c.id FROM o JOIN c USING (acronym) WHERE length(acronym) >= 2) SELECT query, id FROM h QUALIFY row_number() OVER (PARTITION BY query ORDER BY id) <= 10")
def q_acronym_matches(spark, d):
    """Labels with the initials of another, ten at most."""
    labels = _vocabulary(spark, d)
    return linkage.acronym(labels.select(F.col("id").alias("query"), F.col("label").alias("text")), linkage.build_index(labels, generic=[])).select("query", "id")


@query(f"WITH {_LABELS}, v AS (SELECT DISTINCT p_name || ' ' || p_brand AS raw, p_type || '/' || p_name AS key FROM part) SELECT DISTINCT q.id AS query, o.id FROM l q JOIN v x ON x.raw = q.label JOIN v y USING (key) JOIN l o ON o.label = y.raw WHERE x.raw <> y.raw")
def q_structured_matches(spark, d):
    """Labels that share a key with another."""
    labels = _vocabulary(spark, d)
    evidence = _part(spark, d).select(F.concat_ws(" ", "p_name", "p_brand").alias("raw"), F.concat_ws("/", "p_type", "p_name").alias("evidence_key")).distinct()
    return linkage.structured(labels.select(F.col("id").alias("query"), F.col("label").alias("text")), linkage.build_index(labels, generic=[]), evidence).select("query", "id")


@query("WITH t AS (SELECT min(p_partkey) AS id, p_name AS target FROM part GROUP BY 2), q AS (SELECT p_partkey AS query, 'study of ' || p_name || ' by ' || lower(p_brand) AS text FROM part), w AS (SELECT id FROM t WHERE len(list_filter(string_split(target, ' '), lambda x: length(x) >= 4)) > 0) SELECT query, id FROM q JOIN t ON contains(' ' || text || ' ', ' ' || target || ' ') WHERE id IN (SELECT id FROM w)")
def q_contained_names(spark, d):
    """Names that stand in a longer text, found by their rarest word."""
    part = _part(spark, d)
    targets = part.groupBy(F.col("p_name").alias("target")).agg(F.min("p_partkey").alias("id"))
    texts = part.select(F.col("p_partkey").alias("query"), F.concat(F.lit("study of "), "p_name", F.lit(" by "), F.lower("p_brand")).alias("text"))
    return linkage.containment(texts, targets)


@query("SELECT o_orderkey AS id, CAST(70 * floor(o_orderkey / 70) + o_orderkey % 7 AS BIGINT) AS comp FROM orders")
def q_components(spark, d):
    """Components of chains of ten."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    k = F.col("o_orderkey")
    pairs = orders.filter(k % 70 >= 7).select((k - 7).alias("a"), k.alias("b"))
    return graph.components(orders.select(k.alias("id")), pairs)
