"""Expressions of display bins, built from their bounds, and the order in which labels are shown."""

from __future__ import annotations

from quillon.functions.dimensions import PHASES

# A value below a bound has its label, one beyond all bounds the last. Results are compared by these labels.
BELOW = {
    "participants_n": [(10, "1-9"), (100, "10-99"), (1000, "100-999"), (10_000, "1,000-9,999"), (None, "10,000+")],
    "n_countries": [(2, "1"), (3, "2"), (6, "3-5"), (10, "6-9"), (None, "10+")],
    "duration_days": [(183, "<6 months"), (365, "6-12 months"), (730, "1-2 years"), (1095, "2-3 years"), (None, "3+ years")],
    "spread_days": [(1, "0 days"), (8, "1-7 days"), (31, "8-30 days"), (91, "31-90 days"), (None, ">90 days")],
}
# Labels of results, of where records come from, and of paediatric plans and orphan status.
RESULT_LABELS = ("Results reported", "No results reported", "Unknown")
PROVENANCE_LABELS = ("CTIS source, EUCTR-era migrated", "CTIS source, native CTIS-era", "EUCTR source", "Other")
PIP_ORPHAN_LABELS = ("PIP + Orphan", "PIP only", "Orphan only", "Neither")
COUNTRY_GROUP_FROM = 5
DAYS_A_MONTH = 30.4375


def binned(column: str, absent: str) -> str:
    """A CASE of the column's bins; null where `absent` holds."""
    whens = " ".join(f"WHEN {column} < {bound} THEN '{label}'" for bound, label in BELOW[column][:-1])
    return f"CASE WHEN {absent} THEN NULL {whens} ELSE '{BELOW[column][-1][1]}' END"


def first_of(labels: tuple[str, ...], *conditions: str) -> str:
    """A CASE of the label of the first condition that holds; the last label is for none."""
    return "CASE " + " ".join(f"WHEN {c} THEN '{label}'" for c, label in zip(conditions, labels)) + f" ELSE '{labels[-1]}' END"


PARTICIPANTS = binned("participants_n", "participants_n IS NULL OR participants_n <= 0")
SCOPE = binned("n_countries", "n_countries IS NULL")
DURATION = binned("duration_days", "duration_days IS NULL")
SPREAD = binned("spread_days", "spread_days IS NULL")
COUNTRY_GROUP = f"CASE WHEN n_countries >= {COUNTRY_GROUP_FROM} THEN '{COUNTRY_GROUP_FROM}+' ELSE CAST(n_countries AS VARCHAR(12)) END"
RESULTS = first_of(RESULT_LABELS, "has_results", "NOT has_results")
PROVENANCE = first_of(PROVENANCE_LABELS, "register = 'CTIS' AND analysis_register = 'EUCTR'", "register = 'CTIS'", "register = 'EUCTR'")
PIP_ORPHAN = first_of(PIP_ORPHAN_LABELS, "has_pip = 'Yes' AND is_orphan = 'Yes'", "has_pip = 'Yes'", "is_orphan = 'Yes'")
MONTHS = f"duration_days / CAST({DAYS_A_MONTH} AS DOUBLE)"

#: Display order of each bin's labels.
ORDER = {
    "participants": tuple(label for _, label in BELOW["participants_n"]),
    "scope": tuple(label for _, label in BELOW["n_countries"]),
    "duration": tuple(label for _, label in BELOW["duration_days"]),
    "spread": tuple(label for _, label in BELOW["spread_days"]),
    "phase": PHASES,
    "status": ("Ongoing", "Completed", "Withdrawn", "Not Authorised", "Administrative"),
}
