"""Named queries over deduplication, linkage, the registry and increments, each with SQL of the same result."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import names as N
from quillon.functions.text import title_key
from quillon.operators import frames, linkage, registry
from quillon.plans.prepare import drop_in_both
from quillon.plans.trials_view import TRIALS_SQL, trials
from quillon.streaming import incremental

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None, view: bool = False):
    """Registers a function of (spark, sf_dir) under its name with its SQL; view: behind the view's definition of t."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (TRIALS_SQL if view else "") + sql
        return f

    return keep


def read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- deduplication ---


@query("SELECT base_id, id, register FROM t QUALIFY row_number() OVER (PARTITION BY base_id ORDER BY CASE register WHEN 'CTIS' THEN 1 ELSE 2 END, submission_date DESC, id) = 1", True)
def q_dedup_representative(spark, d):
    df = trials(spark, d, "base_id", "register", "submission_date")
    return frames.first_by(df, ["base_id"], F.when(F.col("register") == "CTIS", 1).otherwise(2), F.desc("submission_date"), F.col("id")).select("base_id", "id", "register")


@query("SELECT custkey, id FROM t WHERE register = 'CTIS' QUALIFY row_number() OVER (PARTITION BY custkey ORDER BY id DESC) = 1", True)
def q_dedup_latest_version(spark, d):
    return trials(spark, d, "custkey", "register").filter("register = 'CTIS'").groupBy("custkey").agg(F.max("id").alias("id"))


@query(", b AS (SELECT base_id FROM t GROUP BY 1 HAVING count(DISTINCT register) > 1) SELECT id, register, base_id FROM t WHERE NOT (register = 'EUCTR' AND base_id IN (SELECT base_id FROM b))", True)
def q_dedup_cross_register(spark, d):
    df = trials(spark, d, "register", "base_id").withColumnRenamed("id", "_id")
    return drop_in_both(df, "base_id").withColumnRenamed("_id", "id")


@query("SELECT id, base_id FROM t WHERE register = 'EUCTR' AND base_id NOT IN (SELECT base_id FROM t WHERE migrated)", True)
def q_transition_anti(spark, d):
    df = trials(spark, d, "base_id", "register", "migrated")
    return df.filter("register = 'EUCTR'").join(df.filter("migrated").select("base_id"), "base_id", "left_anti").select("id", "base_id")


@query(", s AS (SELECT 0 AS step, count(*) AS remaining FROM t UNION ALL SELECT 1, count(DISTINCT base_id) FROM t UNION ALL SELECT 2, count(DISTINCT base_id) FROM t WHERE register = 'CTIS') SELECT step, remaining, lag(remaining) OVER (ORDER BY step) - remaining AS removed FROM s", True)
def q_waterfall_lag(spark, d):
    df = trials(spark, d, "base_id", "register")
    one = df.agg(F.count("*").alias("0"), F.countDistinct("base_id").alias("1"), F.countDistinct(F.when(F.col("register") == "CTIS", F.col("base_id"))).alias("2"))
    return frames.waterfall(one.unpivot([], ["0", "1", "2"], "step", "remaining").withColumn("step", F.col("step").cast("int")))


@query("SELECT doc_id, trim(substr(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')), 1, 80)) AS title_key FROM documents")
def q_title_keys(spark, d):
    return read(spark, d, "documents").select("doc_id", F.trim(title_key(F.col("text"))).alias("title_key"))


# --- ledgers, labels, review ---


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def q_ledger_latest(spark, d):
    last = F.max(F.struct("turn", "role")).alias("m")
    return read(spark, d, "conversations").groupBy("conv_id").agg(last).select("conv_id", "m.turn", "m.role")


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 AND c_custkey % 2 = 0 THEN 'human ' || c_name WHEN c_custkey % 5 = 0 THEN c_name WHEN c_custkey % 3 = 0 THEN 'label ' || c_mktsegment ELSE c_name END AS label, CASE WHEN c_custkey % 5 = 0 AND c_custkey % 2 = 0 THEN 'human' WHEN c_custkey % 5 = 0 THEN 'human_reject' WHEN c_custkey % 3 = 0 THEN 'pipeline' ELSE 'raw' END AS source FROM customer")
def q_label_precedence(spark, d):
    from quillon.plans.prepare import attach_sponsor_labels

    c = read(spark, d, "customer")
    key = F.col("c_custkey")
    rows = c.select(key.cast("string").alias("_id"), F.col("c_name").alias("sponsor_name_raw"), F.col("c_name").alias("sponsor_name"), key)
    labels = c.filter("c_custkey % 3 = 0").select(key.cast("string").alias("_id"), F.concat(F.lit("label "), "c_mktsegment").alias("sponsor_clean"), F.lit(None).cast("string").alias("sponsor_parent"), F.lit(None).cast("string").alias("sponsor_type"))
    ledger = c.filter("c_custkey % 5 = 0").select(F.col("c_name").alias("row_key"), F.when(key % 2 == 0, "edit").otherwise("reject").alias("action"), F.lit("sponsor").alias("domain"), F.concat(F.lit("human "), "c_name").alias("final_value"), F.lit("2024-01-01").alias("decided_at_utc"))
    return attach_sponsor_labels(rows, labels, ledger).select("c_custkey", F.col("sponsor_label").alias("label"), F.col("sponsor_label_source").alias("source"))


@query("SELECT CASE WHEN doc_id % 4 <> 0 THEN 'unchanged' WHEN quality = 1 AND toxic = 0 THEN 'unknown -> accepted' ELSE 'label changed' END AS change, count(*) AS n FROM labels WHERE quality = 1 OR doc_id % 4 <> 0 GROUP BY 1")
def q_regression_gate(spark, d):
    rows = read(spark, d, "labels").filter("quality = 1 OR doc_id % 4 <> 0")
    same = F.col("doc_id") % 4 != 0
    old = rows.select(F.col("doc_id").alias("_id"), F.lit("a").alias("label"), F.when((F.col("toxic") == 0) & ~same, "unknown").otherwise("accepted").alias("status"))
    new = rows.select(F.col("doc_id").alias("_id"), F.when(same, "a").otherwise("b").alias("label"), F.lit("accepted").alias("status"))
    return incremental.regression_gate(old, new)


@query("WITH a AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE doc_id END AS entity, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE (doc_id % 100) / CAST(100 AS DOUBLE) END AS confidence, doc_id % 40 AS n FROM labels) SELECT doc_id, reason FROM (SELECT doc_id, CASE WHEN entity IS NULL THEN 'unassigned' WHEN confidence IS NULL THEN 'no confidence recorded' WHEN confidence < 0.75 THEN 'low confidence' WHEN n >= 20 AND confidence < 0.9 THEN 'high impact, middling confidence' END AS reason FROM a) WHERE reason IS NOT NULL")
def q_review_routing(spark, d):
    k = F.col("doc_id")
    reason = registry.review_reason(F.when(k % 11 != 0, k), F.when(k % 7 != 0, (k % 100) / F.lit(100.0)), k % 40)
    return read(spark, d, "labels").select("doc_id", reason.alias("reason")).filter("reason IS NOT NULL")


@query("SELECT CASE WHEN p_size < 10 THEN '<10' WHEN p_size < 25 THEN '10-24' WHEN p_size < 40 THEN '25-39' ELSE '40+' END AS band, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS weight FROM part GROUP BY 1")
def q_confidence_bands(spark, d):
    band = F.when(F.col("p_size") < 10, "<10").when(F.col("p_size") < 25, "10-24").when(F.col("p_size") < 40, "25-39").otherwise("40+")
    return read(spark, d, "part").groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.sum("p_size").alias("weight"))


# --- linkage ---

_NAMES = "WITH l AS (SELECT min(p_partkey) AS id, p_name || ' ' || p_brand AS label FROM part GROUP BY 2), f AS (SELECT id, label, trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) AS form FROM l), w AS (SELECT id, list_filter(string_split(form, ' '), lambda x: length(x) >= 2) AS w FROM f), k AS (SELECT id, unnest(list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || w[i + 1])))) AS token, w FROM w), tok AS (SELECT id, token, NOT list_contains(w, token) AS is_concat FROM k), idf AS (SELECT token, ln(1 + (SELECT count(*) FROM l) / CAST(count(*) AS DOUBLE)) AS idf FROM tok GROUP BY 1)"


def _labels(spark, d):
    """The different labels of all parts, which are the vocabulary and the queries alike."""
    return read(spark, d, "part").groupBy(F.concat_ws(" ", "p_name", "p_brand").alias("label")).agg(F.min("p_partkey").alias("id"))


def _asked(labels):
    return labels.select(F.col("id").alias("query"), F.col("label").alias("text"))


@query(_NAMES + ", q AS (SELECT id AS query, token FROM tok), total AS (SELECT query, sum(idf) AS total FROM q JOIN idf USING (token) GROUP BY 1), s AS (SELECT query, tok.id, sum(idf) AS shared FROM q JOIN idf USING (token) JOIN tok USING (token) GROUP BY ALL), c AS (SELECT query, id, round(shared / total, 6) AS score FROM s JOIN total USING (query)) SELECT * FROM (SELECT * FROM c WHERE score >= 0.15) QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 5")
def q_token_idf_topk(spark, d):
    labels = _labels(spark, d)
    hits = linkage.token_idf(_asked(labels), linkage.build_index(labels, generic=[]), k=1 << 30)
    hits = hits.withColumn("score", F.round("score", 6)).filter("score >= 0.15")
    return frames.top_per_group(hits, "query", "id", 5, "score").select("query", "id", "score")


_GRAMS = _NAMES + ", g AS (SELECT DISTINCT id, unnest(list_transform(range(1, length(replace(form, ' ', '')) - 1), lambda i: substr(replace(form, ' ', ''), i, 3))) AS gram FROM f), n AS (SELECT id, count(*) AS n FROM g GROUP BY 1)"


@query(_GRAMS + ", s AS (SELECT x.id AS query, y.id AS id, count(*) AS s FROM g x JOIN g y USING (gram) GROUP BY ALL) SELECT query, s.id, round(s / CAST(a.n + b.n - s AS DOUBLE), 6) AS score FROM s JOIN n a ON a.id = query JOIN n b ON b.id = s.id WHERE s / CAST(a.n + b.n - s AS DOUBLE) >= 0.6")
def q_ngram_jaccard(spark, d):
    labels = _labels(spark, d)
    hits = linkage.ngram(_asked(labels), linkage.build_index(labels, n=3, generic=[]), k=1 << 30, threshold=0.6)
    return hits.select("query", "id", F.round("score", 6).alias("score"))


@query(_NAMES + ", c AS (SELECT token FROM tok GROUP BY 1 HAVING count(*) BETWEEN 2 AND 500), m AS (SELECT id, sum(idf) AS mass FROM tok JOIN idf USING (token) WHERE NOT is_concat GROUP BY 1), s AS (SELECT x.id AS a, y.id AS b, sum(idf) AS s FROM tok x JOIN tok y ON x.token = y.token AND x.id < y.id JOIN idf ON idf.token = x.token WHERE x.token IN (SELECT token FROM c) GROUP BY ALL) SELECT a, b, round(least(1, s / greatest(least(p.mass, q.mass), 1e-9)), 6) AS score FROM s JOIN m p ON p.id = a JOIN m q ON q.id = b")
def q_pairs_scored(spark, d):
    pairs = linkage.token_pairs(linkage.build_index(_labels(spark, d), generic=[]))
    return pairs.select("a", "b", F.round("score", 6).alias("score"))


@query("WITH RECURSIVE r AS (SELECT n_nationkey AS id, n_nationkey AS cur FROM nation UNION ALL SELECT id, CAST(floor(cur / 2) AS INT) FROM r WHERE cur > 1) SELECT id, min(cur) AS final FROM r GROUP BY 1")
def q_merge_chain(spark, d):
    k = F.col("n_nationkey")
    reg = read(spark, d, "nation").select(k.cast("string").alias("entity_id"), F.when(k > 1, F.floor(k / 2).cast("string")).alias("merged_into"))
    return registry.resolve(reg).select(F.col("entity_id").cast("int").alias("id"), F.col("final_id").cast("int").alias("final"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 0 WHEN p_partkey % 3 = 1 THEN 1 ELSE 2 END AS rung, lower(p_name) AS canonical FROM part")
def q_alias_ladder(spark, d):
    part = read(spark, d, "part")
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, F.concat("p_name", F.lit(" 10 mg"))).otherwise(F.concat("p_name", F.lit(" 10 mg tablets")))
    aliases = part.select(F.lower("p_name").alias("alias"), F.lower("p_name").alias("canonical")).distinct()
    return linkage.ladder_hit(part.select(k.alias("query"), text.alias("text")), aliases, N.substance_ladder(F.col("text"))).select(F.col("query").alias("id"), "rung", "canonical")


@query("WITH b AS (SELECT DISTINCT p_name FROM part) SELECT p_name || ' sodium' AS loser, p_name AS winner, 'sodium' AS salt_form FROM b")
def q_salt_rollup(spark, d):
    from quillon.schema import REGISTRY

    bases = read(spark, d, "part").select("p_name").distinct()
    reg = bases.select(F.col("p_name").alias("entity_id"), F.col("p_name").alias("canonical")).unionByName(bases.select(F.concat("p_name", F.lit(" sodium")).alias("entity_id"), F.concat("p_name", F.lit(" sodium")).alias("canonical")))
    reg = reg.select(*[F.col(f.name) if f.name in ("entity_id", "canonical") else F.lit(None).cast(f.dataType).alias(f.name) for f in REGISTRY.fields])
    return registry.salt_rollup(reg).select(F.col("loser_id").alias("loser"), F.col("winner_id").alias("winner"), "salt_form")


@query("WITH l AS (SELECT min(p_partkey) AS id, p_name || ' ' || p_brand AS label FROM part GROUP BY 2), k AS (SELECT id, array_to_string(list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> ''))), ' ') AS key FROM l) SELECT x.id AS a, y.id AS b FROM k x JOIN k y ON x.key = y.key AND x.id < y.id WHERE x.key IN (SELECT key FROM k GROUP BY 1 HAVING count(*) BETWEEN 2 AND 20)")
def q_key_pairs(spark, d):
    return registry.key_pairs(_labels(spark, d).withColumnRenamed("label", "name"))


# --- sources and increments ---


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS INT)) AS BIGINT) AS total FROM events GROUP BY 1")
def q_json_props(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").try_cast("int")).alias("total"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_incremental_delta(spark, d):
    return incremental.backlog(read(spark, d, "documents").select("doc_id"), "doc_id", read(spark, d, "labels"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def q_event_windows(spark, d):
    events = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return incremental.windowed_counts(events, "ts", "10 minutes", "1 hour", "event_type").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT page_id, regexp_matches(lower(html), '<table') AS has_table, length(html) - length(replace(html, '<a ', 'xx')) AS links FROM pages")
def q_page_flags(spark, d):
    html = F.col("html")
    return read(spark, d, "pages").select("page_id", F.lower(html).rlike("<table").alias("has_table"), (F.length(html) - F.length(F.replace(html, F.lit("<a "), F.lit("xx")))).cast("long").alias("links"))


@query("SELECT c_custkey, coalesce(n_orders, 0) AS attempts FROM customer LEFT JOIN (SELECT o_custkey, 1 AS n_orders FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def q_attempts_upsert(spark, d):
    base = read(spark, d, "customer").select(F.col("c_custkey").alias("raw"), F.lit(0).alias("attempts"))
    return incremental.count_attempts(base, read(spark, d, "orders").select(F.col("o_custkey").alias("raw"))).select(F.col("raw").alias("c_custkey"), "attempts")


