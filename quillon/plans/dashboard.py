"""The dashboard's named queries, over any frame with the columns of the trials view."""

from __future__ import annotations

from quillon.plans import bins
from quillon.plans.spec import Counts, Statistics

PHASE = {"explode": {"phase": "phases"}, "after_explode": f"phase IN {bins.PHASES}"}
COMPLETED = "status = 'Completed' AND decision_date IS NOT NULL"
SELECTED = "sponsor IN ('Customer#000000001', 'Customer#000000002', 'Customer#000000004', 'Customer#000000007', 'Customer#000000010')"
CHOSEN = "country IN ('NATION_1', 'NATION_5', 'NATION_9', 'NATION_14')"
REGISTER = "coalesce(analysis_register, register)"
AUTHORISED = "decision_date IS NOT NULL AND status IS NOT NULL AND decision_year BETWEEN 1996 AND 2001"


def _explode(name: str, column: str, **more) -> dict:
    return {"explode": {name: column}, "after_explode": f"{name} IS NOT NULL", **more}


def _compare(key: str, value: str, where: str = "true", **more) -> Counts:
    """Sponsors against a category, with the category's share within the sponsor."""
    return Counts({"sponsor": "sponsor", key: value}, where=f"{SELECTED} AND ({where})", share=("sponsor",), **more)


def _country(key: str, value: str, where: str = "true", explode: dict | None = None, **more) -> Counts:
    """Selected countries against a category, with the category's share within the country."""
    after = CHOSEN + "".join(f" AND {k} IS NOT NULL" for k in explode or {})
    return Counts({"country": "country", key: value}, {"country": "countries", **(explode or {})}, where, after, share=("country",), **more)


QUERIES: dict[str, Counts | Statistics] = {
    # overview
    "q_status_counts": Counts({"status": "status"}),
    "q_year_counts": Counts({"year": "year"}, where="year IS NOT NULL"),
    "q_migration_signal": Counts({"year": "year", "provenance": bins.PROVENANCE}, where="year IS NOT NULL"),
    "q_migration_cumulative": Counts({"month": "CAST(date_trunc('month', submission_date) AS DATE)"}, where="migrated", cumulative=()),
    "q_status_by_register": Counts({"register": "register", "status": "status"}),
    # conditions and countries
    "q_top_organ": Counts({"organ": "organ"}, **_explode("organ", "organs", where="status IN ('Completed') AND register IN ('CTIS')", limit=15)),
    "q_top_term": Counts({"term": "term"}, **_explode("term", "terms", limit=20)),
    "q_country_top30": Counts({"country": "country"}, **_explode("country", "countries", limit=30)),
    # paediatric investigation plans
    "q_pip_register": Counts({"register": REGISTER, "has_pip": "has_pip"}),
    "q_pip_year_share": Counts({"year": "year", "has_pip": "has_pip"}, where="year IS NOT NULL", share=("year",)),
    # substances
    "q_top_substances": Counts({"substance": "substance", "register": REGISTER}, **_explode("substance", "substances", top=("substance", 15, False))),
    "q_substance_timeline": Counts({"year": "year", "substance": "substance"}, **_explode("substance", "substances", where="year IS NOT NULL", top=("substance", 8, False))),
    "q_substance_register_share": Counts({"substance": "substance", "register": REGISTER}, **_explode("substance", "substances", top=("substance", 10, False), share=("substance",))),
    "q_substance_age_share": Counts({"substance": "substance", "age_group": "age_group"}, **_explode("substance", "substances", top=("substance", 10, False), share=("substance",))),
    # phases
    "q_phase_register": Counts({"phase": "phase", "register": REGISTER}, **PHASE),
    "q_phase_status": Counts({"phase": "phase", "status": "status"}, **PHASE),
    "q_phase_sponsor": Counts({"phase": "phase", "sponsor_type": "sponsor_type"}, where="sponsor_type IS NOT NULL", **PHASE),
    # completion and times
    "q_completion_cohort": Counts({"decision_year": "decision_year", "register": REGISTER}, where=AUTHORISED, rate=("n_completed", "status = 'Completed'"), least=5),
    "q_completion_sponsor": Counts({"decision_year": "decision_year", "sponsor_type": "sponsor_type"}, where=f"{AUTHORISED} AND sponsor_type IS NOT NULL", rate=("n_completed", "status = 'Completed'"), least=5),
    "q_completion_phase": Counts({"phase": "phase"}, where="status IS NOT NULL", rate=("n_completed", "status = 'Completed'"), **PHASE),
    "q_duration_quartiles_all": Statistics(bins.MONTHS, {"register": REGISTER}, totals=("register", "All"), which=("median", "q1", "q3", "least", "most")),
    "q_quarter_starts": Counts({"quarter": "CAST(date_trunc('quarter', start_date) AS DATE)", "register": REGISTER}, where="start_date IS NOT NULL"),
    "q_decision_time": Statistics("log10(greatest(days_to_decision, 1))", {"register": REGISTER}, "days_to_decision IS NOT NULL AND days_to_decision < 3650", totals=("register", "All"), which=("median", "q1", "q3")),
    "q_decision_time_sponsor": Statistics("days_to_decision", {"sponsor_type": "sponsor_type", "register": REGISTER}, "sponsor_type IS NOT NULL AND days_to_decision < 3650", which=("median", "q1", "q3", "mean")),
    "q_ctis_date_spread": Statistics("log10(greatest(spread_days, 1))", {"country_group": bins.COUNTRY_GROUP}, "register = 'CTIS' AND n_countries > 1", which=("median", "q1", "q3")),
    # sponsors
    "q_compare_phase": Counts({"sponsor": "sponsor", "phase": "phase"}, where=SELECTED, share=("sponsor",), **PHASE),
    "q_compare_status": _compare("status", "status"),
    "q_compare_pip": _compare("has_pip", "has_pip"),
    "q_compare_participants": _compare("size", bins.PARTICIPANTS, "participants_n > 0"),
    "q_compare_orphan": _compare("is_orphan", "is_orphan"),
    "q_compare_scope": _compare("scope", bins.SCOPE, "n_countries IS NOT NULL"),
    "q_compare_year": Counts({"sponsor": "sponsor", "year": "year"}, where=f"{SELECTED} AND year IS NOT NULL"),
    "q_compare_results": _compare("results", bins.RESULTS, COMPLETED),
    "q_compare_duration": Statistics(bins.MONTHS, {"sponsor": "sponsor"}, SELECTED, which=("median", "q1", "q3", "least", "most")),
    "q_sponsor_bubble": Counts({"organ": "organ", "phase": "phase"}, {"organ": "organs", "phase": "phases"}, where="sponsor = 'Customer#000000001'"),
    "q_sponsor_type_rollup": Counts({"sponsor_type": "sponsor_type", "register": "register"}, where="sponsor_type IS NOT NULL", totals=("register", "All")),
    # countries
    "q_cc_phase": _country("phase", "phase", explode={"phase": "phases"}),
    "q_cc_status": _country("status", "status"),
    "q_cc_sponsor_type": _country("sponsor_type", "sponsor_type", "sponsor_type IS NOT NULL"),
    "q_cc_pip": _country("has_pip", "has_pip"),
    "q_cc_participants": _country("size", bins.PARTICIPANTS, "participants_n > 0"),
    "q_cc_orphan": _country("is_orphan", "is_orphan"),
    "q_cc_scope": _country("scope", bins.SCOPE, "n_countries IS NOT NULL"),
    "q_cc_year": Counts({"country": "country", "year": "year"}, {"country": "countries"}, "year IS NOT NULL", CHOSEN),
    "q_cc_results": _country("results", bins.RESULTS, COMPLETED),
    # results
    "q_results_by_year": Counts({"decision_year": "decision_year", "results": bins.RESULTS}, where=COMPLETED),
    "q_results_by_sponsor": Counts({"sponsor_type": "coalesce(sponsor_type, 'Unknown')", "results": bins.RESULTS}, where=COMPLETED, share=("sponsor_type",)),
    "q_results_audit": Counts({"register": "register", "has_results": "has_results", "status": "status"}),
}
QUERIES["q_year_register"] = Counts({"year": "year", "register": REGISTER}, where="year IS NOT NULL")
