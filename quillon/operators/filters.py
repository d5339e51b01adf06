"""The filter state of every dashboard query, and the one predicate made of it."""

from __future__ import annotations

import base64
import json
import re
from dataclasses import asdict, dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _regex(values: list[str], raw: bool) -> str:
    return "(?i)" + "|".join(values if raw else [re.escape(v) for v in values])


@dataclass(frozen=True)
class FilterSpec:
    """Empty fields do not filter. Selections of multi-value columns match whole values.

    parity=True takes selections of organs and conditions as unescaped patterns and those of countries and phases as
    substrings, as the application did that these queries come from: there "Phase I" also matches "Phase II".
    """

    status: list[str] = field(default_factory=list)
    register: list[str] = field(default_factory=list)
    date_range: tuple[str, str] | None = None
    organ_class: list[str] = field(default_factory=list)
    condition: list[str] = field(default_factory=list)
    country: list[str] = field(default_factory=list)
    phase: list[str] = field(default_factory=list)
    pip: str = "All"
    orphan: str = "All"
    age_group: str = "All"
    sponsor: list[str] = field(default_factory=list)
    text: str = ""
    product: list[str] = field(default_factory=list)
    mononational: bool = False
    parity: bool = False

    def predicate(self, columns: list[str], include_age: bool = True) -> Column:
        """One Catalyst expression. columns: those of the frame; text searches the ones of TEXT that it has."""
        out = F.lit(True)
        if self.status:
            out &= F.col("status").isin(self.status)
        if self.register:
            out &= F.col("register").isin(self.register)
        if self.date_range:
            out &= F.col("submission_date").isNull() | F.col("submission_date").between(*(F.lit(d).cast("date") for d in self.date_range))
        for column, chosen, raw in (("organs", self.organ_class, True), ("terms", self.condition, True), ("countries", self.country, False), ("phases", self.phase, False)):
            if chosen:
                whole = F.arrays_overlap(column, F.array(*map(F.lit, chosen)))
                out &= F.array_join(column, " / ").rlike(_regex(chosen, raw)) if self.parity else whole
        if self.pip != "All":
            out &= F.col("has_pip") == self.pip
        if self.orphan != "All":
            out &= F.col("is_orphan") == self.orphan
        if include_age and self.age_group != "All":
            out &= F.col("age_group").isin({"<18": "Paediatric", "≥18": "Adult"}[self.age_group], "Paediatric & Adult")
        if self.mononational:
            out &= F.col("n_countries") == 1
        if self.sponsor:
            out &= F.col("sponsor").isin(self.sponsor)
        if self.text:
            pattern, found = "(?i)" + self.text, F.lit(False)
            for c in TEXT:
                if c in columns:
                    value = F.array_join(c, " / ") if c in ARRAYS else F.col(c).cast("string")
                    found |= value.rlike(pattern)
            out &= found
        if self.product:
            out &= F.arrays_overlap("substances", F.array(*map(F.lit, self.product)))
        return out

    def apply(self, trials: DataFrame, include_age: bool = True) -> DataFrame:
        return trials.filter(self.predicate(trials.columns, include_age))

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, sort_keys=True)

    @classmethod
    def from_dict(cls, state: dict) -> FilterSpec:
        known = {f.name for f in fields(cls)}
        state = {k: v for k, v in state.items() if k in known and v is not None}
        if "date_range" in state:
            state["date_range"] = tuple(state["date_range"])
        return cls(**state)

    @classmethod
    def from_json(cls, text: str) -> FilterSpec:
        return cls.from_dict(json.loads(text))

    def to_token(self) -> str:
        return base64.urlsafe_b64encode(self.to_json().encode()).decode()

    @classmethod
    def from_token(cls, token: str) -> FilterSpec:
        return cls.from_json(base64.urlsafe_b64decode(token).decode())

    def describe(self) -> dict[str, str]:
        """Printable values: All where nothing is chosen, (none) for no text."""
        out = {}
        for k, v in asdict(self).items():
            if k == "parity":
                continue
            shown = " – ".join(v) if k == "date_range" and v else ", ".join(v) if isinstance(v, list) else str(v) if v else ""
            out[k] = shown or ("(none)" if k == "text" else "No" if k == "mononational" else "All")
        return out

    def with_(self, **changes) -> FilterSpec:
        return replace(self, **changes)


#: Columns that a text search looks into, and which of them are arrays.
TEXT = ("title", "product", "substances", "identifiers", "terms", "sponsor")
ARRAYS = {"substances", "terms"}

#: Named presets. `today` (ISO date) is given by the caller, so that a preset stays a pure function.
PRESETS = {
    "ctis_only": lambda today: FilterSpec(register=["CTIS"]),
    "ongoing_pip": lambda today: FilterSpec(status=["Ongoing"], pip="Yes"),
    "orphan": lambda today: FilterSpec(orphan="Yes"),
    "last_12m": lambda today: FilterSpec(date_range=(f"{int(today[:4]) - 1}{today[4:]}", today)),
    "neuroblastoma_belgium": lambda today: FilterSpec(condition=["Neuroblastoma"], country=["Belgium"]),
    "pip_10y": lambda today: FilterSpec(pip="Yes", date_range=(f"{int(today[:4]) - 10}{today[4:]}", today)),
    "completed": lambda today: FilterSpec(status=["Completed"]),
    "ongoing": lambda today: FilterSpec(status=["Ongoing"]),
    "pip": lambda today: FilterSpec(pip="Yes"),
}
