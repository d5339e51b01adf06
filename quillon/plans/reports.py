"""Queries of the report, the comparison of age groups and the audit."""

from __future__ import annotations

from quillon.plans import bins
from quillon.plans.dashboard import AUTHORISED, COMPLETED, PHASE, REGISTER, _explode
from quillon.plans.spec import Counts, Statistics

AGES = "age_group IN ('Paediatric', 'Adult')"


def _share(key: str, value: str | None = None, where: str = "true", **more) -> Counts:
    return Counts({key: value or key}, where=where, share=(), **more)


def _by_age(key: str, value: str | None = None, where: str = "true", **more) -> Counts:
    """Age groups against a category, with the category's share within the group."""
    return Counts({"age_group": "age_group", key: value or key}, where=f"{AGES} AND ({where})", share=("age_group",), **more)


QUERIES: dict[str, Counts | Statistics] = {
    # report
    "r_status": _share("status"),
    "r_register": _share("register"),
    "r_pip": _share("has_pip"),
    "r_orphan": _share("is_orphan"),
    "r_sponsor_type": _share("sponsor_type", where="sponsor_type IS NOT NULL"),
    "r_phase": Counts({"phase": "phase"}, share=(), **PHASE),
    "r_organ": Counts({"organ": "organ"}, **_explode("organ", "organs", share=())),
    "r_condition": Counts({"term": "term"}, **_explode("term", "terms", share=())),
    "r_country": Counts({"country": "country"}, **_explode("country", "countries", share=())),
    "r_countries_per_trial": _share("n_countries", where="n_countries IS NOT NULL"),
    "r_top_sponsors": Counts({"sponsor": "sponsor", "sponsor_type": "sponsor_type"}, where="sponsor IS NOT NULL", limit=20),
    "r_year_total": Counts({"year": "year"}, where="year IS NOT NULL", cumulative=()),
    "r_participants_register": Counts({"size": bins.PARTICIPANTS, "register": REGISTER}, where="participants_n > 0"),
    "r_duration": Statistics(bins.MONTHS, {"register": REGISTER}, totals=("register", "All")),
    "r_completion_sponsor": Counts({"decision_year": "decision_year", "sponsor_type": "sponsor_type"}, where=f"{AUTHORISED} AND sponsor_type IS NOT NULL", rate=("n_completed", "status = 'Completed'"), least=5),
    "r_cohorts": Counts({"decision_year": "decision_year"}, where=AUTHORISED, rate=("n_completed", "status = 'Completed'"), least=5),
    "r_migration": Counts({"year": "year", "provenance": bins.PROVENANCE}, where="year IS NOT NULL"),
    "r_migration_timeline": Counts({"month": "CAST(date_trunc('month', submission_date) AS DATE)"}, where="migrated", cumulative=()),
    "r_substances_register": Counts({"substance": "substance", "register": "register"}, **_explode("substance", "substances", top=("substance", 20, False))),
    "r_substances_year": Counts({"year": "year", "substance": "substance"}, **_explode("substance", "substances", top=("substance", 8, False))),
    "r_results_year": Counts({"decision_year": "decision_year", "results": bins.RESULTS}, where=COMPLETED),
    "r_results_sponsor": Counts({"sponsor_type": "sponsor_type", "results": bins.RESULTS}, where=f"{COMPLETED} AND sponsor_type IS NOT NULL"),
    "r_results_rate": Counts({"register": "'All'"}, where=COMPLETED, rate=("n_posted", "has_results")),
    "r_decision_days": Statistics("days_to_decision", {"register": "register"}, "days_to_decision < 3650", totals=("register", "All")),
    "r_continuous_participants": Statistics("participants_n", {"register": "register"}, "participants_n > 0", totals=("register", "All")),
    "r_continuous_countries": Statistics("n_countries", {"register": "register"}, totals=("register", "All")),
    # comparison of age groups
    "c_overview": _share("age_group"),
    "c_participants": _by_age("size", bins.PARTICIPANTS, "participants_n > 0"),
    "c_duration": Statistics(bins.MONTHS, {"age_group": "age_group"}, AGES),
    "c_status": _by_age("status"),
    "c_phase": Counts({"age_group": "age_group", "phase": "phase"}, where=AGES, share=("age_group",), **PHASE),
    "c_phase_sponsor": Counts({"age_group": "age_group", "phase": "phase", "sponsor_type": "sponsor_type"}, where=f"{AGES} AND sponsor_type IS NOT NULL", share=("age_group", "phase"), **PHASE),
    "c_sponsor_type": _by_age("sponsor_type", where="sponsor_type IS NOT NULL"),
    "c_sponsor_trend": Counts({"year": "year", "age_group": "age_group", "sponsor_type": "sponsor_type"}, where=f"{AGES} AND sponsor_type IS NOT NULL", share=("year", "age_group")),
    "c_pip": _by_age("has_pip"),
    "c_pip_phase": Counts({"phase": "phase"}, where="age_group = 'Paediatric'", rate=("n_pip", "has_pip = 'Yes'"), **PHASE),
    "c_orphan": _by_age("is_orphan"),
    "c_pip_orphan": Counts({"label": bins.PIP_ORPHAN}, where="age_group = 'Paediatric'", share=()),
    "c_register": _by_age("register"),
    "c_results": _by_age("results", bins.RESULTS, COMPLETED),
    "c_results_year": Counts({"decision_year": "decision_year", "age_group": "age_group"}, where=f"{AGES} AND {COMPLETED}", rate=("n_results", "has_results"), least=3),
    "c_cohorts": Counts({"decision_year": "decision_year", "age_group": "age_group"}, where=f"{AGES} AND {AUTHORISED}", rate=("n_completed", "status = 'Completed'"), least=5),
    "c_year": _by_age("year", where="year IS NOT NULL"),
    "c_decision_days": Statistics("days_to_decision", {"age_group": "age_group"}, f"{AGES} AND days_to_decision < 3650"),
    "c_decision_trend": Counts({"decision_year": "decision_year", "age_group": "age_group"}, where=f"{AGES} AND days_to_decision < 3650", medians={"median_days": "days_to_decision"}, least=5),
    "c_scope": _by_age("scope", "CASE WHEN n_countries >= 10 THEN '10+' ELSE CAST(n_countries AS VARCHAR(12)) END", "n_countries > 0"),
    "c_orphan_organ": Counts({"age_group": "age_group", "organ": "organ"}, **_explode("organ", "organs", where=AGES, rate=("n_orphan", "is_orphan = 'Yes'"))),
    # audit
    "a_register": Counts({"register": "register"}),
    "a_analysis_register": Counts({"analysis_register": "analysis_register"}),
    "a_age": _share("age_group"),
    "a_age_register": Counts({"register": "register", "age_group": "age_group"}),
    "a_register_phase": Counts({"register": "register", "phase": "phase"}, **PHASE),
    "a_register_status": Counts({"register": "register", "status": "status"}),
    "a_year_register": Counts({"year": "year", "analysis_register": "analysis_register"}),
    "a_substance_age": Counts({"substance": "substance", "age_group": "age_group"}, **_explode("substance", "substances", top=("substance", 12, False), share=("substance",))),
}
