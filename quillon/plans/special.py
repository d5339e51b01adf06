"""Named queries that need more than one aggregation, each with SQL of the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.operators import cube, frames
from quillon.operators.filters import FilterSpec
from quillon.plans import bins
from quillon.plans.dashboard import COMPLETED, SELECTED
from quillon.plans.trials_view import TRIALS_SQL, exploded, trials

QUERIES: dict = {}
ORACLES: dict = {}

PCT = "round_even(CAST(100 AS DOUBLE) * {0} / {1}, 1)"


def query(sql: str):
    """Registers a function of (spark, sf_dir) under its name with the SQL that follows the view's definition of t."""

    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = TRIALS_SQL + sql
        return f

    return keep


def populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic populations (thousands) and coordinates of the countries; the real ones are a parameter of the library."""
    k = F.col("n_nationkey")
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(
        F.col("n_name").alias("country"), ((k + 1) * 100).cast("double").alias("child_pop"), ((k + 1) * 400).cast("double").alias("adult_pop"),
        ((k + 1) * 500).cast("double").alias("total_pop"), (k * 2.0 - 20).alias("lat"), (k * 3.0 - 30).alias("lng"),
    )


POPULATIONS_SQL = ", p AS (SELECT n_name AS country, CAST((n_nationkey + 1) * 100 AS DOUBLE) AS child_pop, CAST((n_nationkey + 1) * 400 AS DOUBLE) AS adult_pop, CAST((n_nationkey + 1) * 500 AS DOUBLE) AS total_pop, n_nationkey * CAST(2 AS DOUBLE) - 20 AS lat, n_nationkey * CAST(3 AS DOUBLE) - 30 AS lng FROM nation)"


# --- overview ---


@query("SELECT count(*) AS n, count_if(status = 'Completed') AS completed, count_if(status = 'Ongoing') AS ongoing, count_if(has_pip = 'Yes') AS with_pip FROM t")
def q_kpi(spark, d):
    return trials(spark, d, "status", "has_pip").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "Completed").alias("completed"), F.count_if(F.col("status") == "Ongoing").alias("ongoing"), F.count_if(F.col("has_pip") == "Yes").alias("with_pip"))


@query(f", c AS (SELECT * FROM t WHERE {COMPLETED}) SELECT (SELECT count(*) FROM c) AS completed, (SELECT count_if(has_results) FROM c) AS posted, (SELECT count_if(sponsor_type = 'Academic' AND NOT has_results) FROM c) AS academic_without, (SELECT count_if(sponsor_type = 'Industry' AND NOT has_results) FROM c) AS industry_without, (SELECT count_if(sponsor_type = 'Academic') FROM t) AS academic, (SELECT count_if(sponsor_type = 'Industry') FROM t) AS industry")
def q_kpi_compliance(spark, d):
    done, late = F.expr(COMPLETED), F.expr(f"{COMPLETED} AND NOT has_results")
    kind = F.col("sponsor_type")
    return trials(spark, d, "status", "decision_date", "has_results", "sponsor_type").agg(
        F.count_if(done).alias("completed"), F.count_if(done & F.col("has_results")).alias("posted"), F.count_if(late & (kind == "Academic")).alias("academic_without"),
        F.count_if(late & (kind == "Industry")).alias("industry_without"), F.count_if(kind == "Academic").alias("academic"), F.count_if(kind == "Industry").alias("industry"),
    )


SPEC = FilterSpec(status=["Completed", "Ongoing"], date_range=("1996-01-01", "2000-12-31"), country=["NATION_3", "NATION_7"], phase=["Phase I"], age_group="<18", pip="Yes", orphan="No", text="ring|bolt", product=["Brand#1", "Brand#11", "Brand#2", "Brand#13"])


@query("SELECT id, status, submission_date FROM t WHERE status IN ('Completed', 'Ongoing') AND (submission_date IS NULL OR submission_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31') AND list_has_any(countries, ['NATION_3', 'NATION_7']) AND list_contains(phases, 'Phase I') AND has_pip = 'Yes' AND is_orphan = 'No' AND age_group IN ('Paediatric', 'Paediatric & Adult') AND (regexp_matches(array_to_string(terms, ' / '), '(?i)ring|bolt') OR regexp_matches(array_to_string(substances, ' / '), '(?i)ring|bolt')) AND list_has_any(substances, ['Brand#1', 'Brand#11', 'Brand#2', 'Brand#13'])")
def q_filters(spark, d):
    return SPEC.apply(trials(spark, d, "status", "submission_date", "countries", "phases", "age_group", "has_pip", "is_orphan", "terms", "substances")).select("id", "status", "submission_date")


@query("SELECT id FROM t WHERE regexp_matches(array_to_string(organs, ' / '), '(?i)STAND.RD|PROMO') AND regexp_matches(array_to_string(countries, ' / '), '(?i)NATION_1') AND regexp_matches(array_to_string(phases, ' / '), '(?i)Phase I')")
def q_filters_parity(spark, d):
    """Selections as patterns and substrings: "NATION_1" is found in "NATION_12", "Phase I" in "Phase IV"."""
    spec = FilterSpec(organ_class=["STAND.RD", "PROMO"], country=["NATION_1"], phase=["Phase I"], parity=True)
    return spec.apply(trials(spark, d, "organs", "countries", "phases")).select("id")


@query("SELECT (SELECT count(*) FROM t WHERE status = 'Completed' AND n_countries = 1) AS filtered, (SELECT count(*) FROM t) AS total")
def q_trial_count_bar(spark, d):
    return trials(spark, d, "status", "n_countries").agg(F.count_if(FilterSpec(status=["Completed"], mononational=True).predicate(["status", "n_countries"])).alias("filtered"), F.count("*").alias("total"))


@query("SELECT id, register, status, decision_date, sponsor FROM t WHERE decision_date IS NOT NULL ORDER BY decision_date DESC, id LIMIT 5")
def q_recent_trials(spark, d):
    return trials(spark, d, "register", "status", "decision_date", "sponsor").orderBy(F.desc_nulls_last("decision_date"), "id").limit(5)


@query("SELECT id, register, status, submission_date, start_date, decision_date, array_to_string(phases, ' / ') AS phase, array_to_string(countries, ' / ') AS countries, n_countries, array_to_string(substances, ' / ') AS substances, sponsor, sponsor_type, age_group, has_pip, is_orphan, has_results FROM t")
def q_trials_table(spark, d):
    joined = {c: F.array_join(c, " / ") for c in ("countries", "substances")}
    df = trials(spark, d, "register", "status", "submission_date", "start_date", "decision_date", "phases", "countries", "n_countries", "substances", "sponsor", "sponsor_type", "age_group", "has_pip", "is_orphan", "has_results")
    return df.withColumn("phase", F.array_join("phases", " / ")).withColumns(joined).drop("phases")


@query(f"SELECT id, register, sponsor, decision_date, has_results FROM t WHERE {COMPLETED} AND NOT has_results")
def q_overdue_list(spark, d):
    return trials(spark, d, "register", "sponsor", "status", "decision_date", "has_results").filter(f"{COMPLETED} AND NOT has_results").drop("status")


@query(f"SELECT id, register, sponsor, decision_date, has_results FROM t WHERE {COMPLETED} AND has_results")
def q_results_posted(spark, d):
    return trials(spark, d, "register", "sponsor", "status", "decision_date", "has_results").filter(f"{COMPLETED} AND has_results").drop("status")


@query("SELECT id, CASE WHEN register = 'CTIS' THEN 'https://euclinicaltrials.eu/ctis-public/view/' || CAST(id AS VARCHAR) ELSE 'https://www.clinicaltrialsregister.eu/ctr-search/trial/' || CAST(id AS VARCHAR) END AS link FROM t")
def q_trial_links(spark, d):
    link = F.when(F.col("register") == "CTIS", F.concat(F.lit("https://euclinicaltrials.eu/ctis-public/view/"), F.col("id").cast("string"))).otherwise(F.concat(F.lit("https://www.clinicaltrialsregister.eu/ctr-search/trial/"), F.col("id").cast("string")))
    return trials(spark, d, "register").select("id", link.alias("link"))


# --- distributions ---


@query(", c AS (SELECT coalesce(analysis_register, register) AS register, CAST(floor(round(log10(CAST(participants_n AS DOUBLE)) * 10, 9)) AS INT) AS bin FROM t WHERE participants_n > 0) SELECT register, bin, count(*) AS n, CAST(greatest(1, floor(pow(CAST(10 AS DOUBLE), bin / CAST(10 AS DOUBLE)))) AS BIGINT) AS low, CAST(ceil(pow(CAST(10 AS DOUBLE), (bin + 1) / CAST(10 AS DOUBLE))) AS BIGINT) AS high FROM c GROUP BY register, bin")
def q_participants_log_hist(spark, d):
    df = trials(spark, d, "participants_n", "analysis_register", "register").withColumn("register", F.coalesce("analysis_register", "register"))
    return frames.log_histogram(df, "participants_n", "register")


@query(", c AS (SELECT status, start_date, count(*) AS n FROM t WHERE start_date IS NOT NULL GROUP BY ALL) SELECT status, start_date, round(CAST(sum(n) OVER (PARTITION BY status ORDER BY start_date) AS DOUBLE) / sum(n) OVER (PARTITION BY status), 9) AS ecdf FROM c")
def q_ecdf_start(spark, d):
    return frames.ecdf(trials(spark, d, "status", "start_date"), "status", "start_date").withColumn("ecdf", F.round("ecdf", 9))


# --- countries ---


@query(", e AS (SELECT id, unnest(countries) AS c FROM t), top AS (SELECT c FROM e GROUP BY c ORDER BY count(*) DESC, c LIMIT 10), f AS (SELECT DISTINCT id, c FROM e WHERE c IN (SELECT c FROM top)) SELECT x.c AS a, y.c AS b, count(*) AS n FROM f x JOIN f y ON x.id = y.id AND x.c < y.c GROUP BY ALL")
def q_country_cooccur(spark, d):
    df = trials(spark, d, "countries")
    top = frames.top_k(df.select(F.explode("countries").alias("value")).groupBy("value").agg(F.count("*").alias("n")), "value", 10).select("value")
    return frames.cooccurrence(df, "id", "countries", top)


def trials_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials are told apart where their rows lie already, by id: no task gathers the pairs of a file to count them by country."""
    pairs = exploded(spark, sf_dir, "countries", "country").select("id", "country").distinct()
    return pairs.groupBy("country").agg(F.count("*").alias("n_trials"))


@query(POPULATIONS_SQL + ", e AS (SELECT DISTINCT id, unnest(countries) AS country FROM t), c AS (SELECT country, count(*) AS n_trials FROM e GROUP BY 1) SELECT country, n_trials, lat, lng, round_even(n_trials / (child_pop / 1000), 1) AS per_million_children, round_even(n_trials / (adult_pop / 1000), 1) AS per_million_adults, round_even(n_trials / (total_pop / 1000), 1) AS per_million_total FROM c JOIN p USING (country)")
def q_country_per_million(spark, d):
    counts = trials_by_country(spark, d)
    joined = counts.join(F.broadcast(populations(spark, d)), "country")
    return joined.select("country", "n_trials", "lat", "lng", *[F.bround(F.col("n_trials") / (F.col(c) / 1000), 1).alias(f"per_million_{n}") for c, n in (("child_pop", "children"), ("adult_pop", "adults"), ("total_pop", "total"))])


@query(POPULATIONS_SQL + ", e AS (SELECT DISTINCT id, unnest(countries) AS country FROM t), c AS (SELECT country, count(*) AS n_trials FROM e GROUP BY 1) SELECT country, lat, lng, n_trials, round(least(8 + ln(1 + n_trials) * 4, 35), 6) AS radius FROM c JOIN p USING (country)")
def q_map_radius(spark, d):
    counts = trials_by_country(spark, d)
    return counts.join(F.broadcast(populations(spark, d)), "country").select("country", "lat", "lng", "n_trials", F.round(F.least(8 + F.log1p("n_trials") * 4, F.lit(35.0)), 6).alias("radius"))


@query(POPULATIONS_SQL + ", v AS (SELECT country FROM p WHERE lat BETWEEN -10 AND 4 AND lng BETWEEN -15 AND 6), s AS (SELECT id, status, countries FROM t WHERE EXISTS (SELECT 1 FROM v WHERE list_contains(countries, v.country))) SELECT s.id, s.status, s.countries[1] AS primary_country, p.child_pop FROM s LEFT JOIN p ON p.country = s.countries[1]")
def q_map_bbox(spark, d):
    dims = populations(spark, d)
    inside = dims.filter("lat BETWEEN -10 AND 4 AND lng BETWEEN -15 AND 6").select("country")
    df = trials(spark, d, "status", "countries")
    hits = df.select("id", F.explode("countries").alias("country")).join(F.broadcast(inside), "country", "left_semi").select("id").distinct()
    some = df.join(hits, "id", "left_semi").select("id", "status", F.get("countries", F.lit(0)).alias("primary_country"))
    return some.join(F.broadcast(dims.select(F.col("country").alias("primary_country"), "child_pop")), "primary_country", "left")


# --- substances and sponsors ---


@query(", e AS (SELECT DISTINCT id, year, unnest(substances) AS substance FROM t WHERE year IS NOT NULL) SELECT substance, min(year) AS debut, count(DISTINCT id) AS n FROM e GROUP BY 1")
def q_substance_debut(spark, d):
    pairs = exploded(spark, d, "substances", "substance", "year").filter("year IS NOT NULL").groupBy("id", "substance").agg(F.min("year").alias("year"))
    return pairs.groupBy("substance").agg(F.min("year").alias("debut"), F.count("*").alias("n"))


@query(", e AS (SELECT id, terms, unnest(substances) AS substance FROM t), s AS (SELECT substance FROM e GROUP BY 1 ORDER BY count(*) DESC, substance LIMIT 5), f AS (SELECT substance, unnest(terms) AS term FROM e WHERE substance IN (SELECT substance FROM s)), c AS (SELECT substance, term, count(*) AS n FROM f GROUP BY ALL) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY substance ORDER BY n DESC, term) <= 5")
def q_substance_top_conditions(spark, d):
    df = trials(spark, d, "substances", "terms").select("terms", F.explode("substances").alias("substance"))
    top = frames.top_k(df.groupBy("substance").agg(F.count("*").alias("n")), "substance", 5).select("substance")
    counts = df.join(F.broadcast(top), "substance", "left_semi").select("substance", F.explode("terms").alias("term")).groupBy("substance", "term").agg(F.count("*").alias("n"))
    return frames.top_per_group(counts, "substance", "term", 5)


@query(", c AS (SELECT sponsor, coalesce(sponsor_type, 'Unknown') AS sponsor_type, count(*) AS k FROM t WHERE sponsor IS NOT NULL GROUP BY ALL), m AS (SELECT sponsor, sponsor_type FROM c QUALIFY row_number() OVER (PARTITION BY sponsor ORDER BY k DESC, sponsor_type) = 1), s AS (SELECT sponsor, CAST(sum(k) AS BIGINT) AS n FROM c GROUP BY 1) SELECT sponsor, n, sponsor_type FROM s JOIN m USING (sponsor) ORDER BY n DESC, sponsor LIMIT 20")
def q_top_sponsors_mode(spark, d):
    df = trials(spark, d, "sponsor", "sponsor_type").filter("sponsor IS NOT NULL").withColumn("sponsor_type", F.coalesce("sponsor_type", F.lit("Unknown")))
    return frames.top_k(frames.mode_by(df, ["sponsor"], "sponsor_type"), "sponsor", 20)


def _ties(key: str, column: str, where: str, n: int) -> str:
    return f", e AS (SELECT {key}, unnest({column}) AS v FROM {where}), c AS (SELECT {key}, v, count(*) AS n FROM e GROUP BY ALL), s AS (SELECT *, {PCT.format('n', f'sum(n) OVER (PARTITION BY {key})')} AS pct FROM c), k AS (SELECT v, rank() OVER (ORDER BY sum(n) DESC) AS r FROM c GROUP BY v) SELECT s.* FROM s JOIN k USING (v) WHERE r <= {n}"


def compare_top(df: DataFrame, key: str, values: str, n: int) -> DataFrame:
    """Shares of a multi-value column within each key, for the n values most frequent over all keys, ties included."""
    counts = df.select(key, F.explode(values).alias("v")).groupBy(key, "v").agg(F.count("*").alias("n"))
    shares = counts.withColumn("pct", frames.percent(F.col("n"), F.sum("n").over(Window.partitionBy(key))))
    best = frames.top_k_ties(counts.groupBy("v").agg(F.sum("n").alias("n")), n).select("v")
    return shares.join(best, "v", "left_semi")


@query(_ties("sponsor", "organs", f"t WHERE {SELECTED}", 4))
def q_compare_organ_ties(spark, d):
    return compare_top(trials(spark, d, "sponsor", "organs").filter(SELECTED), "sponsor", "organs", 4)


@query(_ties("sponsor", "countries", f"t WHERE {SELECTED}", 10))
def q_compare_country_ties(spark, d):
    return compare_top(trials(spark, d, "sponsor", "countries").filter(SELECTED), "sponsor", "countries", 10)


CHOSEN = "'NATION_1', 'NATION_5', 'NATION_9', 'NATION_14'"


@query(_ties("country", "organs", f"(SELECT unnest(countries) AS country, organs FROM t) WHERE country IN ({CHOSEN})", 8))
def q_cc_organ_ties(spark, d):
    return compare_top(trials(spark, d, "countries", "organs").select(F.explode("countries").alias("country"), "organs").filter(f"country IN ({CHOSEN})"), "country", "organs", 8)


@query(f", e AS (SELECT id, unnest(countries) AS country, duration_days FROM t) SELECT id, country, {bins.MONTHS} AS months FROM e WHERE country IN ({CHOSEN}) AND duration_days IS NOT NULL")
def q_cc_duration(spark, d):
    df = trials(spark, d, "countries", "duration_days").filter("duration_days IS NOT NULL").select("id", F.explode("countries").alias("country"), "duration_days")
    return df.filter(f"country IN ({CHOSEN})").select("id", "country", F.expr(bins.MONTHS).alias("months"))


@query(f"SELECT id, sponsor, status, coalesce(submission_date, start_date) AS first_date, n_countries, {bins.SCOPE} AS scope, array_to_string(phases, ' / ') AS phase FROM t WHERE sponsor = 'Customer#000000001'")
def q_sponsor_portfolio(spark, d):
    df = trials(spark, d, "sponsor", "status", "submission_date", "start_date", "n_countries", "phases").filter("sponsor = 'Customer#000000001'")
    return df.select("id", "sponsor", "status", F.coalesce("submission_date", "start_date").alias("first_date"), "n_countries", F.expr(bins.SCOPE).alias("scope"), F.array_join("phases", " / ").alias("phase"))


TODAY = "DATE '2002-01-01'"
SPAN_END = f"CASE WHEN status = 'Completed' AND decision_date IS NOT NULL THEN decision_date WHEN status = 'Ongoing' THEN {TODAY} ELSE decision_date END"


@query(f", s AS (SELECT id, coalesce(start_date, submission_date) AS span_start, {SPAN_END} AS e FROM t WHERE sponsor = 'Customer#000000001') SELECT id, span_start, greatest(e, span_start) AS span_end, CAST(date_diff('day', span_start, greatest(e, span_start)) AS INT) AS days FROM s WHERE e IS NOT NULL AND span_start IS NOT NULL")
def q_sponsor_swimlane(spark, d):
    df = trials(spark, d, "sponsor", "status", "submission_date", "start_date", "decision_date").filter("sponsor = 'Customer#000000001'")
    df = df.select("id", F.coalesce("start_date", "submission_date").alias("span_start"), F.expr(SPAN_END).alias("span_end")).filter("span_start IS NOT NULL AND span_end IS NOT NULL")
    return df.withColumn("span_end", F.greatest("span_end", "span_start")).withColumn("days", F.date_diff("span_end", "span_start"))


# --- the cube ---

_CUBE = ", e AS (SELECT coalesce(analysis_register, register) AS grp_val, unnest(organs) AS x_val FROM t), x AS (SELECT x_val FROM e GROUP BY 1 ORDER BY count(*) DESC, x_val LIMIT 5), c AS (SELECT x_val, grp_val, count(*) AS n FROM e WHERE x_val IN (SELECT x_val FROM x) GROUP BY ALL)"
_YEARS = ", c AS (SELECT year AS x_val, count(*) AS n FROM t WHERE year IS NOT NULL GROUP BY 1)"


def _cube(spark, d):
    return cube.explore(trials(spark, d, "organs", "analysis_register", "register"), "organ", "analysis_register", 5)


@query(_CUBE + " SELECT * FROM c")
def q_cube_xy(spark, d):
    return _cube(spark, d)


@query(_CUBE + f" SELECT *, {PCT.format('n', 'sum(n) OVER ()')} AS pct FROM c")
def q_cube_table(spark, d):
    return cube.table(_cube(spark, d))


@query(_CUBE + f" SELECT *, {PCT.format('n', 'sum(n) OVER (PARTITION BY x_val)')} AS pct FROM c")
def q_cube_within_x(spark, d):
    return cube.within_x(_cube(spark, d))


@query(_YEARS + f" SELECT *, {PCT.format('n', 'sum(n) OVER ()')} AS pct, {PCT.format('sum(n) OVER (ORDER BY x_val)', 'sum(n) OVER ()')} AS cum_pct FROM c")
def q_cube_cumulative(spark, d):
    return cube.table(cube.explore(trials(spark, d, "year"), "year"))


@query(_CUBE + " SELECT grp_val, CAST(sum(n) AS BIGINT) AS total, round_even(avg(n), 1) AS mean, round_even(quantile_cont(n, 0.5), 1) AS median, round_even(stddev_samp(n), 1) AS sd, min(n) AS least, max(n) AS most FROM c GROUP BY 1")
def q_cube_stats(spark, d):
    return cube.stats(_cube(spark, d))


@query(POPULATIONS_SQL + ", e AS (SELECT unnest(countries) AS x_val FROM t), x AS (SELECT x_val, count(*) AS n FROM e GROUP BY 1 ORDER BY n DESC, x_val LIMIT 8) SELECT x_val, round_even(n / (child_pop / 1000), 1) AS n FROM x LEFT JOIN p ON country = x_val")
def q_cube_per_million(spark, d):
    return cube.per_million(cube.explore(trials(spark, d, "countries"), "country"), "x_val", populations(spark, d))


# --- reports ---


@query(", e AS (SELECT register, unnest(phases) AS phase FROM t) SELECT phase, count_if(register = 'CTIS') AS \"CTIS\", count_if(register = 'EUCTR') AS \"EUCTR\", count(*) AS total FROM e GROUP BY 1")
def q_pivot_phase_register(spark, d):
    df = trials(spark, d, "register", "phases").select("register", F.explode("phases").alias("phase"))
    out = df.groupBy("phase").pivot("register", ["CTIS", "EUCTR"]).count().na.fill(0)
    return out.withColumn("total", F.col("CTIS") + F.col("EUCTR"))


@query(", c AS (SELECT age_group, status, count(*) AS n FROM t WHERE age_group IN ('Paediatric', 'Adult') GROUP BY ALL), s AS (SELECT *, round_even(CAST(100 AS DOUBLE) * n / sum(n) OVER (PARTITION BY age_group), 1) AS pct FROM c) SELECT status, coalesce(max(n) FILTER (age_group = 'Paediatric'), 0) AS \"Paediatric_n\", max(pct) FILTER (age_group = 'Paediatric') AS \"Paediatric_pct\", coalesce(max(n) FILTER (age_group = 'Adult'), 0) AS \"Adult_n\", max(pct) FILTER (age_group = 'Adult') AS \"Adult_pct\" FROM s GROUP BY 1")
def q_pivot_two_measures(spark, d):
    counts = trials(spark, d, "age_group", "status").filter("age_group IN ('Paediatric', 'Adult')").groupBy("age_group", "status").agg(F.count("*").alias("n"))
    counts = counts.withColumn("pct", frames.percent(F.col("n"), F.sum("n").over(Window.partitionBy("age_group"))))
    return counts.groupBy("status").pivot("age_group", ["Paediatric", "Adult"]).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.max("pct").alias("pct")).na.fill(0, ["Paediatric_n", "Adult_n"])


_FIELDS = ["register", "status", "submission_date", "decision_date", "duration_days", "participants_n", "sponsor_type", "days_to_decision"]


@query(", a AS (SELECT count(*) AS k, " + ", ".join(f"count({c}) AS {c}" for c in _FIELDS) + " FROM t) " + " UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS n, {PCT.format(c, 'k')} AS pct FROM a" for c in _FIELDS))
def q_completeness_unpivot(spark, d):
    return frames.completeness(trials(spark, d, *_FIELDS), _FIELDS)


@query(" UNION ALL ".join(f"SELECT register, '{c}' AS field, round_even(avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) * 100, 1) AS pct_missing FROM t GROUP BY 1" for c in ("decision_date", "duration_days", "sponsor_type")))
def q_missing_by_register(spark, d):
    return frames.missing_by(trials(spark, d, "register", "decision_date", "duration_days", "sponsor_type"), "register", ["decision_date", "duration_days", "sponsor_type"])


_FLAGS = "SELECT register, 'pip' AS flag, has_pip AS value FROM t UNION ALL SELECT register, 'orphan', is_orphan FROM t UNION ALL SELECT register, 'results', CASE WHEN has_results THEN 'Yes' ELSE 'No' END FROM t"


@query(f", f AS ({_FLAGS}) SELECT register, flag, value, count(*) AS n FROM f GROUP BY ALL")
def q_flags_unpivot(spark, d):
    df = trials(spark, d, "register", "has_pip", "is_orphan", "has_results")
    flags = df.select("register", F.col("has_pip").alias("pip"), F.col("is_orphan").alias("orphan"), F.when(F.col("has_results"), "Yes").otherwise("No").alias("results"))
    return flags.unpivot(["register"], ["pip", "orphan", "results"], "flag", "value").groupBy("register", "flag", "value").agg(F.count("*").alias("n"))


def _domain(column: str, n: int) -> str:
    return f", e AS (SELECT age_group, unnest({column}) AS v FROM t WHERE age_group IN ('Paediatric', 'Adult')), c AS (SELECT * FROM (SELECT age_group, v, count(*) AS n FROM e GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY age_group ORDER BY n DESC, v) <= {n}), k AS (SELECT age_group, count(*) AS total FROM t WHERE age_group IN ('Paediatric', 'Adult') GROUP BY 1) SELECT v, age_group, coalesce(n, 0) AS n, coalesce({PCT.format('n', 'total')}, 0) AS pct FROM (SELECT DISTINCT v FROM c) CROSS JOIN (SELECT DISTINCT age_group FROM c) LEFT JOIN c USING (v, age_group) LEFT JOIN k USING (age_group)"


def top_by_age(df: DataFrame, values: str, n: int) -> DataFrame:
    """The top n values of each age group, over the union of both domains, as shares of the group's trials."""
    df = df.filter("age_group IN ('Paediatric', 'Adult')")
    counts = df.select("age_group", F.explode(values).alias("v")).groupBy("age_group", "v").agg(F.count("*").alias("n"))
    grid = frames.complete(frames.top_per_group(counts, "age_group", "v", n), ["v", "age_group"], {"n": 0})
    total = df.groupBy("age_group").agg(F.count("*").alias("total"))
    return grid.join(F.broadcast(total), "age_group").select("v", "age_group", "n", frames.percent(F.col("n"), F.col("total")).alias("pct"))


@query(_domain("organs", 4))
def q_complete_domain(spark, d):
    return top_by_age(trials(spark, d, "age_group", "organs"), "organs", 4)


@query(_domain("terms", 15))
def c_terms(spark, d):
    return top_by_age(trials(spark, d, "age_group", "terms"), "terms", 15)


@query(_domain("substances", 15))
def c_substances(spark, d):
    return top_by_age(trials(spark, d, "age_group", "substances"), "substances", 15)


@query(_domain("countries", 20))
def c_countries(spark, d):
    return top_by_age(trials(spark, d, "age_group", "countries"), "countries", 20)


@query(", c AS (SELECT age_group, sponsor, count(*) AS n FROM t WHERE age_group IN ('Paediatric', 'Adult') AND sponsor IS NOT NULL GROUP BY ALL) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY age_group ORDER BY n DESC, sponsor) <= 15")
def c_top_sponsors(spark, d):
    counts = trials(spark, d, "age_group", "sponsor").filter("age_group IN ('Paediatric', 'Adult') AND sponsor IS NOT NULL").groupBy("age_group", "sponsor").agg(F.count("*").alias("n"))
    return frames.top_per_group(counts, "age_group", "sponsor", 15)


@query("SELECT count(*) AS trials, min(submission_date) AS first_date, max(submission_date) AS last_date, count(DISTINCT sponsor) AS sponsors, count_if(migrated) AS migrated, (SELECT count(DISTINCT s) FROM (SELECT unnest(substances) AS s FROM t)) AS substances, (SELECT count(DISTINCT c) FROM (SELECT unnest(countries) AS c FROM t)) AS countries FROM t")
def r_overview(spark, d):
    df = trials(spark, d, "submission_date", "sponsor", "migrated", "substances", "countries")
    main = df.agg(F.count("*").alias("trials"), F.min("submission_date").alias("first_date"), F.max("submission_date").alias("last_date"), F.countDistinct("sponsor").alias("sponsors"), F.count_if("migrated").alias("migrated"))
    parts = main
    for c in ("substances", "countries"):
        parts = parts.unionByName(df.select(F.explode(c).alias("v")).agg(F.countDistinct("v").alias(c)), allowMissingColumns=True)
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns])


@query(f", c AS (SELECT sponsor, count(*) AS n FROM t WHERE sponsor IS NOT NULL GROUP BY 1) SELECT sponsor, n, row_number() OVER (ORDER BY n DESC, sponsor) AS rank, {PCT.format('sum(n) OVER (ORDER BY n DESC, sponsor ROWS UNBOUNDED PRECEDING)', 'sum(n) OVER ()')} AS cum_pct FROM c")
def a_sponsor_concentration(spark, d):
    return frames.concentration(trials(spark, d, "sponsor").filter("sponsor IS NOT NULL"), "sponsor")


@query("SELECT count_if(decision_date IS NULL) AS no_decision, count_if(submission_date IS NULL) AS no_submission, quantile_cont(CAST(days_to_decision AS DOUBLE), 0.5) AS median_days FROM t")
def a_dates(spark, d):
    return trials(spark, d, "decision_date", "submission_date", "days_to_decision").agg(F.count_if(F.col("decision_date").isNull()).alias("no_decision"), F.count_if(F.col("submission_date").isNull()).alias("no_submission"), F.expr("percentile(CAST(days_to_decision AS DOUBLE), 0.5)").alias("median_days"))


@query("SELECT id, register, days_to_decision FROM t WHERE days_to_decision > 2000 ORDER BY days_to_decision DESC, id LIMIT 30")
def a_extreme_days(spark, d):
    return trials(spark, d, "register", "days_to_decision").filter("days_to_decision > 2000").orderBy(F.desc("days_to_decision"), "id").limit(30)


@query("SELECT id, register, year FROM t WHERE year < 1996 OR year > 2000")
def a_implausible_year(spark, d):
    return trials(spark, d, "register", "year").filter("year < 1996 OR year > 2000")


@query(", s AS (SELECT base_id, n_countries FROM t), c AS (SELECT base_id, count(*) AS size FROM s GROUP BY 1) SELECT size, count(*) AS n FROM c GROUP BY 1")
def a_group_sizes(spark, d):
    return trials(spark, d, "base_id").groupBy("base_id").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


@query("SELECT base_id, id, register FROM t QUALIFY count(*) OVER (PARTITION BY base_id) > 1")
def a_duplicates(spark, d):
    df = trials(spark, d, "base_id", "register")
    return df.join(df.groupBy("base_id").agg(F.count("*").alias("k")).filter("k > 1").select("base_id"), "base_id", "left_semi")


@query(", e AS (SELECT register, unnest(substances) AS substance FROM t), c AS (SELECT substance, register, count(*) AS n FROM e GROUP BY ALL), s AS (SELECT *, CAST(sum(n) OVER (PARTITION BY substance) AS BIGINT) AS total FROM c) SELECT * FROM s QUALIFY row_number() OVER (ORDER BY total DESC, substance, register) <= 40")
def a_substance_rows(spark, d):
    counts = trials(spark, d, "register", "substances").select("register", F.explode("substances").alias("substance")).groupBy("substance", "register").agg(F.count("*").alias("n"))
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy("substance"))).orderBy(F.desc("total"), "substance", "register").limit(40)


_ISSUES = {
    "no decision date of a completed trial": "status = 'Completed' AND decision_date IS NULL",
    "decision after over 10 years": "days_to_decision > 3650",
    "submission year out of range": "year < 1990 OR year > 2001",
    "no country": "countries IS NULL",
    "no organ class": "organs IS NULL",
    "label with a legal form": "sponsor LIKE '% GmbH%' OR sponsor LIKE '% Ltd%'",
    "no sponsor type": "sponsor_type IS NULL",
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS issue, count_if({v}) AS n FROM t" for k, v in _ISSUES.items()))
def a_issues(spark, d):
    names = list(_ISSUES)
    one = trials(spark, d, "status", "decision_date", "days_to_decision", "year", "countries", "organs", "sponsor", "sponsor_type").agg(*[F.count_if(F.expr(_ISSUES[n])).alias(n) for n in names])
    return one.unpivot([], names, "issue", "n")
