"""Named queries of the preprocessing report: issues and their rows, versions, variants, how far names collapse."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import frames, quality
from quillon.operators.quality import Rule
from quillon.plans.trials_view import TRIALS_SQL, trials

QUERIES: dict = {}
ORACLES: dict = {}

#: Raw values beside the view's columns: expressions that both engines read, in the order in which they build on each other.
RAW = {
    "title_key": "concat('shared title of trial ', CAST(id % 997 AS STRING))",
    "raw_status": "CASE WHEN register = 'CTIS' THEN CAST(id % 9 AS STRING) ELSE status END",
    "raw_country": "CASE WHEN id % 19 = 0 THEN concat('territory ', CAST(id % 7 AS STRING)) ELSE countries[{first}] END",
    "country": "CASE WHEN id % 19 <> 0 THEN countries[{first}] END",
    "organ": "CASE WHEN id % 23 = 0 THEN CAST(100000000000 + id % 5 AS STRING) ELSE organs[{first}] END",
    "label": "CASE WHEN id % 6 = 0 THEN concat(sponsor, ' GmbH') WHEN id % 10 = 0 THEN concat(sponsor, ' Ltd') ELSE sponsor END",
    "moved": "register = 'EUCTR' AND id % 4 = 1",
    "number": "CASE WHEN register = 'CTIS' AND id % 2 = 0 THEN base_id ELSE id END",
}
_COLUMNS = ("register", "base_id", "status", "decision_date", "submission_date", "days_to_decision", "year", "countries", "organs", "sponsor", "sponsor_type")
_VARIANTS = ["AT", "BE", "DE", "ES", "FR", "IT", "NL"]
RAW["variant"] = "CASE id % 7 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(_VARIANTS)) + " END"


def rows(spark, d):
    """The view with raw values beside it."""
    df = trials(spark, d, *_COLUMNS)
    for name, e in RAW.items():
        df = df.withColumn(name, F.expr(e.replace("{first}", "0")))
    return df


#: The same in DuckDB, as a prefix that defines x.
SQL = TRIALS_SQL + ", x AS (SELECT *, " + ", ".join(f"{e.replace('{first}', '1').replace('AS STRING', 'AS VARCHAR')} AS {n}" for n, e in RAW.items()) + " FROM t)"

#: Fixed: legal forms that a label should not hold, with what counts as one for both engines.
JUNK = r"\b(GmbH|Inc|Ltd|S\.A|AG|B\.V|LLC|PLC)\b"
_CODES = [str(k) for k in range(1, 7)]

RULES = [
    Rule("High", "Deduplication", "Residual cross-register duplicates by shared title key", ""),
    Rule("High", "Deduplication", "Transitioned EUCTR trials without a CTIS match in current fallbacks", ""),
    Rule("High", "Deduplication", "Duplicate canonical trial IDs in final cache", ""),
    Rule("High", "Status", "CTIS numeric status codes outside the current mapping", f"register = 'CTIS' AND raw_status NOT IN ({', '.join(map(repr, _CODES))})"),
    Rule("High", "Dates", "Completed trials with no decision_date", "status = 'Completed' AND decision_date IS NULL"),
    Rule("Medium", "Country", "Country strings normalised to missing", "raw_country <> '' AND country IS NULL"),
    Rule("Medium", "Organ class", "CTIS organ-class codes still stored as raw numbers", "organ LIKE '100000000%'"),
    Rule("Medium", "Identifiers", "Canonical trial IDs appearing more than once", ""),
    Rule("Medium", "Sponsor", "Sponsor labels still contain legal-entity tokens", "label LIKE '% GmbH' OR label LIKE '% Ltd'"),
    Rule("Low", "Status", "Trials with status 'Other'", "status NOT IN ('Completed', 'Ongoing', 'Withdrawn', 'Not Authorised', 'Administrative')"),
    Rule("Low", "Dates", "days_to_decision greater than 10 years", "days_to_decision > 3650"),
    Rule("Low", "Dates", "Submission year outside [1990, current year]", "year < 1990 OR year > 2001"),
]
_PAIRS = "p AS (SELECT a.id AS euctr_id, b.id AS ctis_id, a.title_key AS key FROM x a JOIN x b ON a.title_key = b.title_key AND a.register = 'EUCTR' AND b.register = 'CTIS' AND a.id <> b.id WHERE length(a.title_key) >= 20)"
_UNMATCHED = "u AS (SELECT id, base_id, number FROM x WHERE moved AND number NOT IN (SELECT number FROM x WHERE register = 'CTIS'))"
_TWICE = "d AS (SELECT number, count(*) AS n FROM x GROUP BY 1 HAVING count(*) > 1)"
_SUBQUERIES = {0: "(SELECT count(*) FROM p)", 1: "(SELECT count(*) FROM u)", 2: "(SELECT count(*) FROM d)", 7: "(SELECT count(*) FROM d)"}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, SQL + sql
        return f

    return keep


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def unmatched(df):
    """Moved EUCTR rows whose number no CTIS row has."""
    return df.filter("moved").join(df.filter("register = 'CTIS'").select("number"), "number", "left_anti").select("id", "base_id", "number")


@query(f", {_PAIRS}, {_UNMATCHED}, {_TWICE} " + " UNION ALL ".join(f"SELECT '{r.severity}' AS severity, '{r.category}' AS category, {_quoted(r.issue)} AS issue, " + (_SUBQUERIES[k] if k in _SUBQUERIES else f"(SELECT count_if({r.hit}) FROM x)") + " AS n_affected" for k, r in enumerate(RULES)))
def a_issue_table(spark, d):
    """All twelve rules with their severity."""
    df = rows(spark, d)
    twice = quality.duplicated(df, "number").agg(F.count("*").alias("n"))
    counts = df.filter(F.length("title_key") >= 20).groupBy("title_key").agg(F.count_if(F.col("register") == "EUCTR").alias("e"), F.count_if(F.col("register") == "CTIS").alias("c"))
    pairs = counts.agg(F.sum(F.col("e") * F.col("c")).alias("n"))  # no pair is made to be counted
    return quality.issue_table(df, RULES, {RULES[0].issue: pairs, RULES[1].issue: unmatched(df).agg(F.count("*").alias("n")), RULES[2].issue: twice, RULES[7].issue: twice})


@query(f", {_PAIRS} SELECT * FROM p ORDER BY key, euctr_id, ctis_id LIMIT 100")
def a_shared_titles(spark, d):
    """The first hundred pairs of both registers with one title."""
    return quality.first_shared_keys(rows(spark, d), "title_key", 100)


@query(f", {_UNMATCHED} SELECT * FROM u")
def a_unmatched_transitions(spark, d):
    return unmatched(rows(spark, d))


@query(" SELECT raw_status AS raw, count(*) AS n_trials FROM x WHERE register = 'CTIS' AND raw_status NOT IN ('1', '2', '3', '4', '5', '6') GROUP BY 1")
def a_unmapped_status(spark, d):
    return quality.unmapped(rows(spark, d).filter("register = 'CTIS'"), F.col("raw_status"), _CODES)


@query(" SELECT raw_country, count(*) AS n_trials FROM x WHERE raw_country <> '' AND country IS NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30")
def a_country_failures(spark, d):
    return quality.top(quality.lost(rows(spark, d), "raw_country", "country"), 30, F.desc("n_trials"), "raw_country")


@query(" SELECT organ, count(*) AS n_trials FROM x WHERE regexp_matches(organ, '^[0-9]+$') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30")
def a_organ_codes(spark, d):
    return quality.top(quality.still_coded(rows(spark, d), "organ"), 30, F.desc("n_trials"), "organ")


@query(rf" SELECT label, count(*) AS n FROM x WHERE regexp_matches(label, '{JUNK}') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30")
def a_junk_labels(spark, d):
    return quality.top(rows(spark, d).filter(F.col("label").rlike(JUNK)).groupBy("label").agg(F.count("*").alias("n")), 30, F.desc("n"), "label")


@query(" SELECT number, n FROM (SELECT number, count(*) AS n FROM x GROUP BY 1) WHERE n > 1")
def a_duplicate_numbers(spark, d):
    return quality.duplicated(rows(spark, d), "number")


@query(", v AS (SELECT CAST(floor(id / 8) AS BIGINT) AS family, variant FROM x WHERE register = 'EUCTR') SELECT family, count(DISTINCT variant) AS n_variants, string_agg(DISTINCT variant, ', ' ORDER BY variant) AS variants FROM v GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def a_country_variants(spark, d):
    """Families of records with the most countries."""
    df = rows(spark, d).filter("register = 'EUCTR'").withColumn("family", F.floor(F.col("id") / 8))
    return quality.top(quality.variant_table(df, "family", "variant"), 20, F.desc("n_variants"), "family")


@query(", v AS (SELECT CAST(floor(id / 9) AS BIGINT) AS family, id, CAST(id % 5 AS BIGINT) AS version, id % 2 = 0 AS kept FROM x WHERE register = 'CTIS') SELECT family, count(*) AS n_versions, max(version) AS latest, arg_max(id, version * 100000000 + id) AS latest_id, arg_max(kept, version * 100000000 + id) AS latest_kept, string_agg(CAST(id AS VARCHAR), ' -> ' ORDER BY id) AS all_versions FROM v GROUP BY 1 HAVING count(*) > 1 ORDER BY 2 DESC, 1 LIMIT 25")
def a_amendments(spark, d):
    """Families with the most amendments, and whether the latest one is kept."""
    df = rows(spark, d).filter("register = 'CTIS'").withColumns({"family": F.floor(F.col("id") / 9), "version": F.col("id") % 5, "kept": F.col("id") % 2 == 0})
    return quality.top(quality.version_table(df, "family", "version", "kept"), 25, F.desc("n_versions"), "family")


@query(", l AS (SELECT label AS raw, CASE WHEN sponsor_type IS NOT NULL THEN sponsor END AS canonical, count(*) AS n_trials FROM x WHERE label IS NOT NULL GROUP BY 1, 2) SELECT count(*) AS strings, CAST(sum(n_trials) AS BIGINT) AS weight, count(DISTINCT canonical) AS canonicals, count_if(canonical IS NULL) AS unlabelled, count(*) / CAST(count(DISTINCT canonical) AS DOUBLE) AS ratio FROM l")
def a_collapse(spark, d):
    """How many strings a canonical name stands for."""
    df = rows(spark, d).filter("label IS NOT NULL")
    log = df.groupBy(F.col("label").alias("raw"), F.when(F.col("sponsor_type").isNotNull(), F.col("sponsor")).alias("canonical")).agg(F.count("*").alias("n_trials"))
    return quality.collapse(log, "raw", "canonical", "n_trials")


@query(" SELECT sponsor, CAST(sum(n_trials) AS BIGINT) AS weight FROM (SELECT label, sponsor, count(*) AS n_trials FROM x WHERE sponsor IS NOT NULL GROUP BY 1, 2) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def a_canonical_weights(spark, d):
    log = rows(spark, d).groupBy("label", "sponsor").agg(F.count("*").alias("n_trials"))
    return quality.top(quality.weighted(log, "sponsor", "n_trials"), 25, F.desc("weight"), "sponsor")


@query(" SELECT coalesce(sponsor_type, 'not recorded') AS sponsor_type, count(*) AS weight FROM x WHERE status = 'Completed' GROUP BY 1")
def a_decided_by(spark, d):
    log = rows(spark, d).filter("status = 'Completed'").groupBy("sponsor_type", "register").agg(F.count("*").alias("n_trials"))
    return quality.weighted(log, "sponsor_type", "n_trials", "not recorded")


@query(", g AS (SELECT sponsor, bool_or(status = 'Completed') AS any_hit, bool_and(status = 'Completed') AS all_hit FROM x WHERE sponsor IS NOT NULL GROUP BY 1) SELECT any_hit, all_hit, count(*) AS n FROM g GROUP BY 1, 2")
def a_any_and_all(spark, d):
    """Sponsors of which some, and of which all trials are completed."""
    marked = quality.share_of_group(rows(spark, d).filter("sponsor IS NOT NULL"), "sponsor", F.col("status") == "Completed")
    return marked.select("sponsor", "any_hit", "all_hit").distinct().groupBy("any_hit", "all_hit").agg(F.count("*").alias("n"))


@query(" SELECT id, f.field AS field, CASE f.field WHEN 'status' THEN raw_status WHEN 'country' THEN raw_country ELSE label END AS raw, CASE f.field WHEN 'status' THEN status WHEN 'country' THEN country ELSE sponsor END AS normalised FROM x, (SELECT unnest(['status', 'country', 'sponsor']) AS field) f")
def q_trial_detail(spark, d):
    """Of each trial the raw values beside what became of them; a caller filters by id, which reaches the scan."""
    pairs = {"status": ("raw_status", "status"), "country": ("raw_country", "country"), "sponsor": ("label", "sponsor")}
    return frames.raw_beside(rows(spark, d), pairs)
