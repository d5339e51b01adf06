"""Named queries over the whole preparation: raw records of two registers, made from the keys of orders, to one row a trial.

Four orders make one trial b: two EUCTR records (Germany, Belgium) and two amendments of one CTIS record. A third of the
CTIS records name the EUCTR number that they continue; a fifth of the EUCTR records say that they have moved, and share
the CTIS record's title. So a trial is kept as its latest CTIS amendment, and also as its Belgian record where neither
holds. The SQL says what must come out, from the keys alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.dimensions import ORGAN_CLASSES
from quillon.plans import prepare as P
from quillon.schema import LEDGER, SPONSOR_LABELS, TRIAL_DOCUMENT

QUERIES: dict = {}
ORACLES: dict = {}

_CLASSES = list(ORGAN_CLASSES)


def _pick(k: Column, *values: str | None) -> Column:
    """The value at k modulo their number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records as the document store holds them; the JSON that it gives is read with the declared schema."""
    k, b = F.col("o_orderkey"), F.floor(F.col("o_orderkey") / 4)
    year, day = 2010 + b % 10, F.col("o_orderdate").cast("date")
    later = lambda n: F.date_add(day, n.cast("int") if isinstance(n, Column) else n).cast("string")
    number = F.format_string("%d-%06d-10", year, b)
    moved = F.when(b % 5 == 0, F.format_string("A long enough title of moved trial %d", b))
    euctr = {
        "_id": F.concat(number, _pick(k, "-DE", "-BE")),
        "a2_eudract_number": number,
        "a1_member_state_concerned": _pick(k, "Germany - BfArM", "Belgium - FAMHP"),
        "a3_full_title_of_the_trial": F.coalesce(moved, F.format_string("European title number %d of a trial", b)),
        "a7_trial_is_part_of_a_paediatric_investigation_plan": _pick(b, "Yes", "No", None, ""),
        "dimp": F.array(F.struct(F.format_string("Product %d", b % 9).alias("d31_product_name"), F.format_string("drug %d sodium", b % 8).alias("d391_inn_generic_name"), _pick(b, "Yes", "No", None).alias("d25_the_imp_has_been_designated_in_this_indication_as_an_orphan_drug_in_the_community"))),
        "e12_meddra_classification": F.array(F.struct(_pick(b, "Hemophilia", "Lung tumors", "Metastatic leukemia").alias("e12_term"), _pick(b, *_CLASSES).alias("e12_system_organ_class"))),
        "e71_human_pharmacology_phase_i": _pick(b, "Yes", "No"),
        "e73_therapeutic_confirmatory_phase_iii": _pick(b, "No", "yes", "No"),
        "f11_trial_has_subjects_under_18": _pick(b, "Yes", "No", "No"),
        "f12_adults_1864_years": _pick(b, "true", "No"),
        "f422_in_the_whole_clinical_trial": (b % 300).cast("string"),
        "x5_trial_status": F.when(b % 5 == 0, "Trial now transitioned").otherwise(_pick(b, "Completed", "Ongoing", "Prematurely Ended", "Not Authorised")),
        "p_end_of_trial_status": _pick(b, "Completed", None, None, None),
        "x6_date_on_which_this_record_was_first_entered_in_the_eudract_database": day.cast("string"),
        "n_date_of_competent_authority_decision": F.when(b % 11 != 0, later(b % 90 - 10)),
        "p_date_of_the_global_end_of_the_trial": later(400),
        "trialInformation": F.struct(later(30).alias("recruitmentStartDate")),
        "b1_sponsor": F.array(F.struct(F.format_string("Sponsor   %d", b % 40).alias("b11_name_of_sponsor"), _pick(b, "Commercial", "Non-Commercial", None).alias("b31_and_b32_status_of_the_sponsor"))),
    }
    ctis = {
        "_id": F.format_string("2022-5%05d-10-0%d", b, k % 4 - 2),
        "ctStatus": (b % 14 + 1).cast("string"),
        "trialPhase": _pick(b, "Human Pharmacology (Phase I)- Other", "Therapeutic exploratory (Phase II)", "Therapeutic confirmatory (Phase III)", "Therapeutic use (Phase IV)"),
        "ageGroup": _pick(b, "0-17 years", "18-64 years, 65+ years", "0-17 years, 18-64 years"),
        "resultsFirstReceived": _pick(b, "true", "false"),
        "totalNumberEnrolled": (b % 50).cast("string"),
        "authorizedApplication": F.struct(
            F.array(F.struct(F.format_string("2022-5%05d-10", b).alias("ctNumber"), later(5).alias("submissionDate")), F.struct(F.lit(None).cast("string").alias("ctNumber"), day.cast("string").alias("submissionDate"))).alias("applicationInfo"),
            F.struct(F.when(b % 3 == 0, number).alias("eudraCtCode")).alias("eudraCt"),
            F.array(F.struct(F.lit("Spain").alias("mscName"), later(40).alias("firstDecisionDate")), F.struct(F.lit("Italy").alias("mscName"), later(40 + b % 20).alias("firstDecisionDate"))).alias("memberStatesConcerned"),
            F.struct(
                F.array(F.struct(F.struct(F.format_string("Acme %d", b % 50).alias("name")).alias("organisation"), _pick(b, "Commercial", "Non-Commercial").alias("commercial"))).alias("sponsors"),
                F.struct(F.struct(F.coalesce(moved, F.format_string("Another title number %d of a trial", b)).alias("fullTitle")).alias("clinicalTrialIdentifiers")).alias("trialDetails"),
            ).alias("authorizedPartI"),
        ),
    }
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate")
    text = F.when(k % 4 < 2, F.to_json(F.struct(*[c.alias(n) for n, c in euctr.items()]))).otherwise(F.to_json(F.struct(*[c.alias(n) for n, c in ctis.items()])))
    return orders.select(F.from_json(text, TRIAL_DOCUMENT).alias("d")).select("d.*")


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.createDataFrame([], SPONSOR_LABELS)
    return P.prepare(records(spark, sf_dir), labels, spark.createDataFrame([], LEDGER))


#: The trials that stay, in DuckDB: b, whether CTIS, the date of its order, the id and the EUCTR number.
KEPT = """WITH k AS (SELECT o_orderkey AS k, CAST(floor(o_orderkey / 4) AS BIGINT) AS b, CAST(o_orderdate AS DATE) AS day FROM orders),
 r AS (SELECT *, k % 4 >= 2 AS ctis, printf('%d-%06d-10', 2010 + b % 10, b) AS number FROM k),
 t AS (SELECT *, CASE WHEN ctis THEN printf('2022-5%05d-10-01', b) ELSE number || '-BE' END AS _id FROM r WHERE k % 4 = 3 OR (k % 4 = 1 AND b % 3 <> 0 AND b % 5 <> 0))
"""


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


@query(
    KEPT
    + """SELECT _id, CASE WHEN ctis THEN 'CTIS' ELSE 'EUCTR' END AS register, CASE WHEN ctis AND b % 3 <> 0 THEN 'CTIS' ELSE 'EUCTR' END AS analysis_register,
 CASE WHEN ctis AND b % 3 <> 0 THEN _id ELSE number END AS trial_base_id, CASE WHEN ctis THEN printf('2022-5%05d-10', b) ELSE number END AS ct_number,
 CASE WHEN ctis AND b % 3 = 0 THEN printf('2022-5%05d-10', b) || ' / EudraCT ' || number WHEN ctis THEN printf('2022-5%05d-10', b) ELSE number END AS trial_identifiers,
 CASE WHEN ctis AND b % 3 = 0 THEN 'Belgium / Germany / Italy / Spain' WHEN ctis THEN 'Italy / Spain' ELSE 'Belgium / Germany' END AS countries,
 CASE WHEN ctis AND b % 3 = 0 THEN 4 ELSE 2 END AS n_countries FROM t"""
)
def q_prepared_identity(spark, d):
    """Which records stay, under which numbers, in which countries."""
    return prepared(spark, d).select("_id", "register", "analysis_register", "trial_base_id", F.col("CT_number").alias("ct_number"), "trial_identifiers", F.col("Member_state").alias("countries"), "n_countries")


@query(
    KEPT
    + """SELECT _id,
 CASE WHEN ctis THEN CASE WHEN b % 14 + 1 BETWEEN 2 AND 7 THEN 'Ongoing' WHEN b % 14 + 1 = 8 THEN 'Completed' ELSE 'Not Authorised' END
  WHEN b % 4 = 0 THEN 'Completed' WHEN b % 11 <> 0 OR b % 4 = 1 THEN 'Ongoing' WHEN b % 4 = 2 THEN 'Completed' ELSE 'Not Authorised' END AS status,
 CASE WHEN ctis THEN CASE b % 4 WHEN 0 THEN 'Phase I' WHEN 1 THEN 'Phase II' WHEN 2 THEN 'Phase III' ELSE 'Phase IV' END
  ELSE nullif(concat_ws(' / ', CASE WHEN b % 2 = 0 THEN 'Phase I' END, CASE WHEN b % 3 = 1 THEN 'Phase III' END), '') END AS phase,
 CASE WHEN ctis THEN CASE b % 3 WHEN 0 THEN 'Paediatric' WHEN 1 THEN 'Adult' ELSE 'Paediatric & Adult' END
  ELSE CASE WHEN b % 3 = 0 AND b % 2 = 0 THEN 'Paediatric & Adult' WHEN b % 3 = 0 THEN 'Paediatric' WHEN b % 2 = 0 THEN 'Adult' ELSE 'Unknown' END END AS age_group,
 CASE WHEN ctis THEN 'No' WHEN b % 4 = 0 THEN 'Yes' WHEN b % 4 = 1 THEN 'No' ELSE 'Unknown' END AS has_pip,
 CASE WHEN ctis THEN CASE WHEN b % 2 = 0 THEN 'Industry' ELSE 'Academic' END ELSE CASE b % 3 WHEN 0 THEN 'Industry' WHEN 1 THEN 'Academic' END END AS sponsor_type,
 CASE WHEN ctis THEN printf('Acme %d', b % 50) ELSE printf('Sponsor %d', b % 40) END AS sponsor,
 CASE WHEN ctis THEN CASE WHEN b % 50 > 0 THEN CAST(b % 50 AS DOUBLE) END ELSE CASE WHEN b % 300 > 0 THEN CAST(b % 300 AS DOUBLE) END END AS participants_n,
 CASE WHEN ctis THEN b % 2 = 0 ELSE false END AS has_results FROM t"""
)
def q_prepared_categories(spark, d):
    """What is derived from codes, flags and free text."""
    return prepared(spark, d).select("_id", "status", "phase", "age_group", F.col("has_PIP").alias("has_pip"), "sponsor_type", F.col("sponsor_label").alias("sponsor"), "participants_n", "has_results")


@query(
    KEPT
    + """, d AS (SELECT *, day AS submitted, CASE WHEN ctis THEN day + 40 WHEN b % 11 <> 0 THEN day + CAST(b % 90 - 10 AS INT) END AS decided FROM t)
SELECT _id, submitted AS submission_date, decided AS decision_date, CAST(year(submitted) AS INT) AS year, CASE WHEN ctis AND b % 3 = 0 THEN CAST(2010 + b % 10 AS INT) ELSE CAST(year(submitted) AS INT) END AS analysis_year,
 CASE WHEN decided >= submitted THEN CAST(decided - submitted AS DOUBLE) END AS days_to_decision, CASE WHEN ctis THEN CAST(b % 20 AS DOUBLE) END AS spread_days,
 CASE WHEN NOT ctis AND (b % 4 = 0 OR (b % 4 = 2 AND b % 11 = 0)) THEN 370.0 END AS duration_days FROM d"""
)
def q_prepared_dates(spark, d):
    """Dates and what lies between them."""
    names = {"submission_date_parsed": "submission_date", "decision_date": "decision_date", "year": "year", "analysis_year": "analysis_year", "days_to_decision": "days_to_decision", "decision_date_spread_days": "spread_days", "trial_duration_days": "duration_days"}
    return prepared(spark, d).select("_id", *[F.col(c).alias(n) for c, n in names.items()])


_ORGANS = "[" + ", ".join("'" + v[0] + v[1:].lower().replace("'", "''") + "'" for v in ORGAN_CLASSES.values()) + "]"


@query(
    KEPT
    + f"""SELECT _id, CASE b % 3 WHEN 0 THEN 'Haemophilia' WHEN 1 THEN 'Lung tumour' ELSE 'Leukaemia' END AS term, {_ORGANS}[CAST(b % {len(ORGAN_CLASSES)} AS INT) + 1] AS organ,
 printf('Product %d', b % 9) AS product, printf('Drug %d sodium', b % 8) AS substance, CASE WHEN b % 3 = 0 THEN 'Yes' WHEN b % 3 = 1 THEN 'No' ELSE 'Unknown' END AS orphan FROM t WHERE NOT ctis"""
)
def q_prepared_dimensions(spark, d):
    """Terms, organ classes, products and substances of the EUCTR records that stay."""
    df = prepared(spark, d).filter("register = 'EUCTR'")
    return df.select("_id", F.col("MEDDRA_term").alias("term"), F.col("MEDDRA_organ_class").alias("organ"), F.col("DIMP_product_name").alias("product"), F.col("substance_label").alias("substance"), F.col("is_orphan").alias("orphan"))


@query(
    KEPT.replace(" t AS", " u AS").rstrip()
    + """, n AS (SELECT count(*) AS raw, count(DISTINCT b) AS b, count(DISTINCT CASE WHEN b % 3 = 0 THEN b END) AS joined, count(DISTINCT CASE WHEN b % 3 <> 0 AND b % 5 = 0 THEN b END) AS moved FROM r),
 s AS (SELECT unnest(['raw', 'representative', 'latest_version', 'title_swap', 'base_swap', 'transition_swap', 'pass_0', 'pass_1', 'pass_2']) AS name, unnest(range(9)) AS step)
SELECT CAST(step AS INT) AS step, name, CASE WHEN step = 0 THEN raw WHEN step = 1 THEN joined + 3 * (b - joined) WHEN step = 2 THEN joined + 2 * (b - joined) ELSE joined + 2 * (b - joined) - moved END AS remaining FROM s, n"""
)
def q_prepared_waterfall(spark, d):
    """Rows after each step of deduplication."""
    return P.waterfall(records(spark, d)).select(F.col("step").cast("int").alias("step"), "name", "remaining")


@query(
    KEPT
    + """, v AS (SELECT 'CTIS' AS register, CASE WHEN b % 2 = 0 THEN 'Commercial' ELSE 'Non-Commercial' END AS raw, CASE WHEN b % 2 = 0 THEN 'Industry' ELSE 'Academic' END AS normalised FROM t WHERE ctis
 UNION ALL SELECT 'EUCTR', CASE b % 3 WHEN 0 THEN 'Commercial' WHEN 1 THEN 'Non-Commercial' END, CASE b % 3 WHEN 0 THEN 'Industry' WHEN 1 THEN 'Academic' END FROM t WHERE NOT ctis)
SELECT register, raw, normalised, count(*) AS n_trials, coalesce(raw <> coalesce(normalised, ''), false) AS changed FROM v GROUP BY 1, 2, 3"""
)
def q_prepared_log(spark, d):
    """Raw kinds of sponsors, and what became of them."""
    documents = records(spark, d)
    ctis, euctr = F.col("authorizedApplication.authorizedPartI.sponsors.commercial")[0], F.col("b1_sponsor.b31_and_b32_status_of_the_sponsor")[0]
    raw = documents.select("_id", F.coalesce(ctis, euctr).alias("raw"))
    return P.normalisation_log(prepared(spark, d).join(raw, "_id"), "raw", "sponsor_type")


# --- compounds of paediatric decisions ---


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision for each part, about one of twelve substances."""
    k = F.col("p_partkey")
    number = F.format_string("P/%d/%d", k + 1, 2010 + k % 5)
    columns = {"pip_decision_number": number, "active_substance": F.format_string("Drug %d 5 mg", k % 12), "decision_date": F.format_string("%d-03-%02d", 2010 + k % 5, k % 28 + 1), "decision_type_code": _pick(k, "p", "PM", "w"), "condition": F.col("p_type")}
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(*[c.alias(n) for n, c in columns.items()])
    return rows.withColumns({c: F.lit(None).cast("string") for c in ("pip_procedure_number", "ema_url")})


def compounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    trials = prepared(spark, sf_dir)
    return P.complex_compounds(P.pip_trial_index(trials), P.pip_decision_index(decisions(spark, sf_dir)), trials.select("_id"))


_COMPOUNDS = KEPT + """, d AS (SELECT 'drug ' || p_partkey % 12 AS token, count(*) AS n_decisions FROM part GROUP BY 1 HAVING count(*) >= 2),
 c AS (SELECT token AS substance_token, n_decisions, count(*) AS n_trials, 'Drug ' || (b % 8) || ' sodium' AS substances, 'EUCTR' AS registers, CAST(min(year(day)) AS INT) AS first_year, CAST(max(year(day)) AS INT) AS last_year FROM t JOIN d ON token = 'drug ' || b % 8 WHERE NOT ctis GROUP BY 1, 2, 4)
"""


@query(_COMPOUNDS + "SELECT * FROM c")
def q_pip_compounds(spark, d):
    """Compounds with several decisions and the trials that test them."""
    return compounds(spark, d)


@query(_COMPOUNDS + "SELECT * FROM c ORDER BY n_decisions DESC, n_trials DESC, substance_token LIMIT 5")
def q_pip_compounds_top(spark, d):
    return compounds(spark, d).orderBy(F.desc("n_decisions"), F.desc("n_trials"), "substance_token").limit(5)


@query(_COMPOUNDS + "SELECT substance_token AS value, substances || ' (' || n_decisions || ' decisions, ' || n_trials || ' trials)' AS label FROM c")
def q_pip_compound_choices(spark, d):
    """What a reader chooses a compound from."""
    label = F.format_string("%s (%d decisions, %d trials)", "substances", "n_decisions", "n_trials")
    return compounds(spark, d).select(F.col("substance_token").alias("value"), label.alias("label"))


@query("SELECT printf('P/%d/%d', p_partkey + 1, 2010 + p_partkey % 5) AS pip_decision_label, upper(['p', 'PM', 'w'][CAST(p_partkey % 3 AS INT) + 1]) AS decision_type_code, printf('%d-03-%02d', 2010 + p_partkey % 5, p_partkey % 28 + 1) AS decision_date, 'Drug 3 5 mg' AS active_substance, p_type AS condition FROM part WHERE p_partkey % 12 = 3")
def q_pip_compound_decisions(spark, d):
    """All decisions of one compound."""
    return P.compound_decisions(P.pip_decision_index(decisions(spark, d)), "drug 3")
