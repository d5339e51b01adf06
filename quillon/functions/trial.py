"""Column expressions that prepare trials."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import dimensions as D
from quillon.functions.text import blank_to_null, distinct_list, extract, join_list, lookup, replace_all, sentence_case, split_list, squish

DATA_PROCESSING_VERSION = "1"


def register(id_: Column) -> Column:
    """By the country behind the number. Serial numbers have six digits, and more from a million on."""
    return F.when(id_.rlike(r"^\d{4}-\d{6,}-\d{2}-([A-Z]|3RD)"), "EUCTR").otherwise("CTIS")


def valid_id(id_: Column) -> Column:
    """Not a UUID, not the store's own record, not a third-country record."""
    return ~(id_.rlike("^.{8}-.{4}-.{4}-.{4}-.{12}$") | (id_ == "meta-info") | id_.endswith("-3RD"))


def euctr_base(id_: Column) -> Column:
    return F.regexp_replace(id_, "-[A-Z]{2,3}$", "")


def ctis_base(id_: Column) -> Column:
    return F.regexp_replace(id_, r"-\d+$", "")


def version(id_: Column) -> Column:
    """The amendment's number at the end of the id, or null."""
    return extract(id_, r"\d+$").try_cast("int")


def clean_countries(c: Column) -> Column:
    """Canonical countries of a raw list, sorted, each once; an authority behind the country is cut."""
    names = {**{n.lower(): n for n in D.COUNTRIES}, **D.COUNTRY_ALIASES}
    parts = F.filter(F.transform(F.split(c, " / |, "), lambda x: F.trim(x)), lambda x: x != "")
    parts = F.transform(parts, lambda x: F.trim(F.regexp_replace(x, r"^([A-Za-z][A-Za-z .]+?)\s*-\s+.*$", "$1")))
    junk = r"^\d+$|^\d+\.\d+$|\d{4}-\d{2}-\d{2}|T\d{2}:|^[0-9a-f]{8}-"
    parts = F.filter(parts, lambda x: ~x.rlike(junk) & (F.length(x) > 1))
    # prefixes are tried in the table's order: names first, then aliases
    prefix = "^(" + "|".join(k.replace(".", r"\.") for k in names) + ")"
    known = F.transform(parts, lambda x: F.coalesce(lookup(F.lower(x), names), lookup(extract(F.lower(x), prefix, 1), names)))
    return join_list(F.array_sort(F.array_distinct(F.filter(known, lambda x: x.isNotNull()))))


def unite(a: Column, b: Column) -> Column:
    """Both registers' columns as one; where both have a value they are joined by an underscore."""
    return F.nullif(F.concat_ws("_", a, b), F.lit(""))


def clean_terms(c: Column) -> Column:
    one = lambda x: F.trim(sentence_case(F.trim(replace_all(x, *D.TERM_SPELLINGS))))
    return join_list(F.array_distinct(F.filter(F.transform(split_list(c), one), lambda x: x != "")))


def clean_organs(c: Column) -> Column:
    """Numbered names lose their number, codes become names, unknown codes go."""
    named = lambda x: F.when(x.rlike("^[0-9]+ - "), F.regexp_replace(x, "^[0-9]+ - ", "")).when(x.rlike("^[0-9]+$"), lookup(x, D.ORGAN_CLASSES)).otherwise(x)
    spelled = lambda x: F.replace(x, F.lit("unspecified incl cysts and polyps"), F.lit("unspecified (incl cysts and polyps)"))
    parts = F.filter(F.transform(split_list(c), named), lambda x: x.isNotNull())
    return join_list(F.array_distinct(F.transform(parts, lambda x: F.trim(sentence_case(spelled(x))))))


def participants(c: Column) -> Column:
    """The largest positive number of a list."""
    numbers = F.transform(split_list(c), lambda x: F.regexp_replace(x, "[^0-9.]", "").try_cast("double"))
    return F.array_max(F.filter(numbers, lambda x: x > 0))


def status_category(raw: Column) -> Column:
    out = None
    for name, pattern in D.STATUS_CATEGORIES:
        hit = F.coalesce(raw, F.lit("")).rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("Not Authorised")


def status_display(raw: Column) -> Column:
    """Statuses of a list by their display names, without numbers, each once."""
    shown = lambda x: F.coalesce(lookup(F.lower(x), D.STATUS_NAMES), F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1_000_000))))
    parts = F.filter(split_list(raw), lambda x: ~x.rlike("^[0-9]+$"))
    return join_list(F.array_distinct(F.transform(parts, shown)))


def has_pip(reg: Column, raw: Column) -> Column:
    low = F.lower(raw)
    return F.when(low.rlike("yes|true"), "Yes").when(low.rlike("no|false"), "No").when(reg == "CTIS", F.when(blank_to_null(raw).isNotNull(), "Yes").otherwise("No")).otherwise("Unknown")


def age_group(reg: Column, under_18: Column, adults: Column, elderly: Column, ctis: Column) -> Column:
    yes = lambda c: F.lower(F.coalesce(c, F.lit(""))).rlike(D.FLAG_SET)
    own = F.coalesce(ctis, F.lit(""))
    young = F.when(reg == "EUCTR", yes(under_18)).otherwise(own.rlike("0-17"))
    old = F.when(reg == "EUCTR", yes(adults) | yes(elderly)).otherwise(own.rlike(r"18-64|65\+"))
    return F.when(young & old, "Paediatric & Adult").when(young, "Paediatric").when(old, "Adult").otherwise("Unknown")


def sponsor_type(raw: Column) -> Column:
    low = F.lower(raw)
    return F.when(low.rlike("non.commercial|non commercial|academic"), "Academic").when(low.rlike("commercial"), "Industry")


def euctr_phase(*flags: Column) -> Column:
    on = [F.when(F.lower(f).rlike(D.PHASE_SET), n) for f, n in zip(flags, D.PHASES, strict=True)]
    return join_list(F.filter(F.array(*on), lambda x: x.isNotNull()))


def ctis_phase(raw: Column) -> Column:
    """One phase by ordered patterns, so that "Phase I/II" is Phase I; other text stays."""
    t = F.trim(raw)
    low = F.lower(t)
    found = F.coalesce(*[F.when(low.rlike(p), name) for name, p in D.CTIS_PHASES.items()])
    return F.coalesce(found, F.nullif(t, F.lit("")))


def is_orphan(reg: Column, euctr: Column, ctis: Column) -> Column:
    return F.when((reg == "EUCTR") & F.lower(F.coalesce(euctr, F.lit(""))).rlike(D.ORPHAN_SET), "Yes").when((reg == "EUCTR") & euctr.isNotNull(), "No").when((reg == "CTIS") & blank_to_null(ctis).isNotNull(), "Yes").otherwise("Unknown")


def is_exploratory_substance(c: Column) -> Column:
    key = F.lower(F.coalesce(c, F.lit("")))
    return (F.length(key) >= 3) & key.rlike(r"\p{L}") & ~key.rlike(D.NO_SUBSTANCE)


def substance_tokens(c: Column) -> Column:
    """What a substance is matched by: no dose, no salt, split at ; and /, four characters at least."""
    x = F.lower(squish(c))
    x = replace_all(x, (D.DOSE, ""), (D.SALTS, ""))
    return F.array_distinct(F.filter(F.transform(F.split(x, "[;/]"), squish), lambda t: F.length(t) >= 4))


def sponsor_name(c: Column) -> Column:
    t = F.trim(c)
    return F.when(~t.isin("NA", "", "NULL"), F.regexp_replace(t, r"\s{2,}", " "))


def fallback_substances(inn: Column) -> Column:
    """Sorted labels of a trial's substances where no label file has them."""
    shown = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1_000_000)))
    parts = F.filter(F.transform(split_list(inn), lambda x: shown(squish(x))), is_exploratory_substance)
    return F.array_sort(F.array_distinct(parts))


def pip_decision_number(c: Column) -> Column:
    """P/n/yyyy without leading zeros."""
    found = extract(F.upper(c), r"P/0*\d+/\d{4}")
    return F.regexp_replace(found, r"^P/0+(?=\d)", "P/")


def pip_procedure_number(c: Column) -> Column:
    return extract(F.upper(c), r"(EMEA-|EMA/PE/|EMA/)[A-Z0-9/-]*\d[A-Z0-9/-]*")


def identifiers(reg: Column, ct: Column, transition: Column) -> Column:
    return F.when((reg == "CTIS") & transition.isNotNull(), F.concat(ct, F.lit(" / EudraCT "), transition)).otherwise(ct)


__all__ = [n for n in dir() if not n.startswith("_")]
distinct_identifiers = distinct_list
