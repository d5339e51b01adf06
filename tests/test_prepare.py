import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from quillon.functions import trial as X
from quillon.functions.text import date_spread, dedup_slash, sentence_case, title_key, try_date
from quillon.operators.filters import FilterSpec
from quillon.plans import prepare as P
from quillon.schema import LEDGER, SPONSOR_LABELS, TRIAL_DOCUMENT


def one(spark, make, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{k} string" for k in range(len(values))))
    return df.select(make(*[F.col(f"c{k}") for k in range(len(values))]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "make, raw, want",
    [
        (X.clean_countries, "Germany - BfArM, UK / Czechia / 12 / xx / 2020-01-01", "Czech Republic / Germany / United Kingdom"),
        (X.clean_countries, "United States of America / France (metropolitan)", "France / United States"),
        (X.clean_countries, "12 / 3.4", None),
        (X.clean_terms, "Metastatic breast TUMORS / Leukemia stage IV / HIV-1 infection / leukemia", "Breast tumour / Leukaemia / HIV-1 infection"),
        (X.clean_terms, "Diabetes type II / esophageal cancer refractory", "Diabetes type 2 / Oesophageal cancer"),
        (X.clean_organs, "100000004849 / 10 - Eye disorders / 999", "Cardiac disorders / Eye disorders"),
        (X.participants, "12 / 1,200 patients / none", 1200.0),
        (X.participants, "0", None),
        (X.status_category, "Not authorised", "Not Authorised"),
        (X.status_category, "Authorised, recruiting", "Ongoing"),
        (X.status_category, "Ended", "Completed"),
        (X.status_category, "Withdrawn / Completed", "Withdrawn"),
        (X.status_category, "Under evaluation", "Not Authorised"),
        (X.status_display, "ended / completed / 8 / something else", "Completed / Something else"),
        (X.ctis_phase, "Therapeutic confirmatory (Phase III)", "Phase III"),
        (X.ctis_phase, "Phase I/II", "Phase I"),
        (X.sponsor_type, "Non-commercial", "Academic"),
        (X.sponsor_type, "Commercial", "Industry"),
        (X.sponsor_name, " NULL ", None),
        (X.pip_decision_number, "see P/0012/2019 of", "P/12/2019"),
        (X.register, "2010-012345-12-BE", "EUCTR"),
        (X.register, "2022-500001-12-01", "CTIS"),
        (sentence_case, "CHRONIC HIV-1 infection", "Chronic HIV-1 infection"),
        (title_key, "A Trial: of (X)!", "a trial of x"),
        (dedup_slash, "a/ b /a", "a / b"),
        (try_date, "2020-03", date(2020, 3, 1)),
        (try_date, "2020-03-04T10:00", date(2020, 3, 4)),
        (try_date, "soon", None),
        (date_spread, "2020-01-01 / x / 2020-01-11", 10),
    ],
)
def test_column_functions(spark, make, raw, want):
    assert one(spark, make, raw) == want


def test_pip_and_age(spark):
    assert one(spark, X.has_pip, "CTIS", " ") == "No"
    assert one(spark, X.has_pip, "CTIS", "PIP 12") == "Yes"
    assert one(spark, X.has_pip, "EUCTR", None) == "Unknown"
    assert one(spark, X.age_group, "EUCTR", "Yes", "No", "true", None) == "Paediatric & Adult"
    assert one(spark, X.age_group, "CTIS", None, None, None, "65+ years") == "Adult"
    assert one(spark, X.substance_tokens, "Drug Sodium 10 mg; abc / Otherdrug") == ["drug", "otherdrug"]


def e(id_, title="", status="Ongoing", **more):
    return {"_id": id_, "a2_eudract_number": id_[:14], "a3_full_title_of_the_trial": title, "x5_trial_status": status, **more}


def c(id_, title="", status="4", transition=None, **more):
    app = {"applicationInfo": [{"ctNumber": id_[:14], "submissionDate": "2023-02-01"}, {"submissionDate": "2023-01-01"}], "eudraCt": {"eudraCtCode": transition}, "authorizedPartI": {"trialDetails": {"clinicalTrialIdentifiers": {"fullTitle": title}}}}
    app["memberStatesConcerned"] = [{"mscName": "Spain", "firstDecisionDate": "2023-03-01"}, {"mscName": "Italy", "firstDecisionDate": "2023-03-11"}]
    return {"_id": id_, "ctStatus": status, "authorizedApplication": app, **more}


SPAIN = {"2022-500001-10-01", "2012-000003-10-00", "2022-500009-10-00", "2022-500010-10-00"}
LONG = "A long enough title of one moved trial"
RECORDS = [
    e("2010-000001-10-DE", a1_member_state_concerned="Germany - BfArM"),
    e("2010-000001-10-BE", a1_member_state_concerned="Belgium - FAMHP", n_date_of_competent_authority_decision="2011-05-01", x6_date_on_which_this_record_was_first_entered_in_the_eudract_database="2011-04-01", e71_human_pharmacology_phase_i="Yes", e72_therapeutic_exploratory_phase_ii="yes"),
    e("2010-000001-10-3RD"),
    e("12345678-1234-1234-1234-123456789012"),
    e("2011-000002-10-FR", LONG, "Trial now transitioned"),
    c("2022-500001-10-00", LONG),
    c("2022-500001-10-01", LONG),
    e("2012-000003-10-FR", "Another title that is long enough", "Trial now transitioned"),
    c("2012-000003-10-00", "Nothing alike in the words"),
    e("2013-000004-10-ES", "Third title that is long enough", "Completed"),
    c("2022-500009-10-00", "Completely different", transition="2013-000004-10"),
    e("2014-000005-10-AT", "Same generic title of two trials"),
    c("2022-500010-10-00", "Same generic title of two trials", status="12"),
    e("2015-000006-10-IT", "short", "Completed", p_date_of_the_global_end_of_the_trial="2016-01-01", trialInformation={"recruitmentStartDate": "2015-01-01"}),
]


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("docs") / "d.json"
    at.write_text("\n".join(map(json.dumps, RECORDS)))
    return spark.read.schema(TRIAL_DOCUMENT).json(str(at))


def test_prepare(spark, documents):
    labels = spark.createDataFrame([("2014-000005-10-AT", "Acme", "Acme Group", "industry")], SPONSOR_LABELS)
    out = P.prepare(documents, labels, spark.createDataFrame([], LEDGER))
    rows = {r["_id"]: r for r in out.collect()}
    assert set(rows) == {"2010-000001-10-BE", "2022-500001-10-01", "2012-000003-10-00", "2022-500009-10-00", "2014-000005-10-AT", "2022-500010-10-00", "2015-000006-10-IT"}
    be = rows["2010-000001-10-BE"]
    assert (be["Member_state"], be["n_countries"], be["phase"], be["days_to_decision"], be["year"]) == ("Belgium / Germany", 2, "Phase I / Phase II", 30.0, 2011)
    moved = rows["2022-500009-10-00"]
    assert (moved["analysis_register"], moved["analysis_year"], moved["trial_base_id"]) == ("EUCTR", 2013, "2013-000004-10")
    assert moved["trial_identifiers"].endswith(" / EudraCT 2013-000004-10")
    latest = rows["2022-500001-10-01"]
    assert (str(latest["submission_date_parsed"]), str(latest["decision_date"]), latest["decision_date_spread_days"], latest["Member_state"]) == ("2023-01-01", "2023-03-01", 10.0, "Italy / Spain")
    assert (rows["2022-500010-10-00"]["status"], latest["status"]) == ("Not Authorised", "Ongoing")
    assert rows["2015-000006-10-IT"]["trial_duration_days"] == 365.0
    assert rows["2014-000005-10-AT"]["sponsor_label_source"] == "pipeline"
    assert len({r["trial_base_id"] for r in rows.values()}) == len(rows)
    shown = FilterSpec(country=["Spain"]).apply(P.as_trials(out)).select("id")
    assert {r["id"] for r in shown.collect()} == SPAIN


def test_waterfall_falls_to_the_result(spark, documents):
    rows = P.waterfall(documents).orderBy("step").collect()
    assert rows[0]["remaining"] == 12 and rows[-1]["remaining"] == 7 and rows[-1]["name"] == "pass_2"


def test_ledger_latest_wins(spark):
    ledger = spark.createDataFrame([("a", "accept", "sponsor", "X", "2024-01-01"), ("a", "reject", "sponsor", None, "2024-02-01"), ("b", "edit", None, " Y ", "2024-01-01"), ("c", "edit", "substance", "Z", "2024-01-01")], LEDGER)
    assert {(r[0], r[1], r[2]) for r in P.latest_decisions(ledger).collect()} == {("a", None, "reject"), ("b", "Y", "edit")}


def test_compounds(spark):
    trials = spark.createDataFrame([("1", "CTIS", 2020, "Drugone / Placebo"), ("2", "EUCTR", 2019, "Drugone sodium"), ("3", "EUCTR", 2018, "Other")], "_id string, register string, year int, substance_label string")
    decisions = spark.createDataFrame([("P/1/2020", "drugone"), ("P/2/2020", "Drugone 5 mg; other")], "pip_decision_number string, active_substance string")
    for c_ in ("pip_procedure_number", "ema_url", "decision_type_code", "decision_date", "condition"):
        decisions = decisions.withColumn(c_, F.lit(None).cast("string"))
    got = P.complex_compounds(P.pip_trial_index(trials), P.pip_decision_index(decisions), trials.select("_id")).collect()
    assert [(r["substance_token"], r["n_decisions"], r["n_trials"], r["first_year"]) for r in got] == [("drugone", 2, 2, 2019)]
