"""Sponsors' names: parents of departments, candidates, types, one rule at a time, strata of a gold set; all expressions.

A sponsor is cleaned first (`names.clean_sponsor_alias`). Functions take the raw name, unless they say otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import names as N
from quillon.functions.text import let, replace_all, squish

# What is cut from names to find candidates. Results are compared by them.
LEGAL_FORMS = [
    "inc", "incorporated", "corp", "corporation", "company", "co", "ltd", "limited", "llc", "plc", "ag", "gmbh", "kg", "kgaa",
    "bv", "nv", "sa", "sas", "srl", "spa", "a/s", "ab", "oy", "pte", "kk",
    "s a", "b v", "n v", "s l", "sl", "s l u", "s p a", "s pa", "s r l", "s r o", "as", "a s", "asa", "aps",
    "s a s", "s a u", "sau", "d o o", "sp z o o", "sarl", "mbh",
]
ADDRESS = [
    r"\d{3,}", "street", "strasse", "road", "avenue", "ave", "boulevard", "blvd", "drive", "new york", "ny", "usa",
    "united states", "uk", "germany", "france", "belgium", "netherlands", "switzerland", "austria",
]
COUNTRY_TAILS = [
    "the netherlands", "netherlands", "nederland", "belgium", "france", "germany", "united kingdom", "uk", "united states", "usa",
    "switzerland", "austria", "spain", "italy", "denmark", "sweden", "norway", "finland",
]
BRANCHES = ["international", "pharmaceuticals", "biologicals", "biosciences", "sciences", "therapeutics", "oncology", "diagnostics", "europe", "north america", "global"]
DEPARTMENTS = ["department", "dept", "departement", "unit", "section", "klinik", "abteilung", "afdeling", "heilkunde", "dermatology", "neurology", "endocrinology", "pharmacology", "toxicology"]
INSTITUTIONS = [
    "university", "universiteit", "universitair", "universitaire", "universityhospital", "universitetshospital", "universitetshospitalet",
    "medical", "medisch", "medische", "hospital", "hospitals", "sygehus", "sygehuset", "sjukhus", "sjukhuset", "ziekenhuis",
    "centre", "center", "centrum", "klinikum", "clinic", "umc", "chu", "chru", "institute", "institut", "istituto", "ospedale",
    "policlinico", "stichting",
]

# A derived name of nothing but these says too little.
STOP_WORDS = [
    "the", "of", "and", "de", "der", "das", "die", "le", "la", "les", "hospital", "university", "clinic", "centre", "center",
    "institute", "department", "research", "group", "trust", "foundation", "pharma", "pharmaceuticals", "medical", "health",
    "ministry", "unknown",
]
CONFIDENCE = {"case_punct": 0.90, "legal_suffix": 0.85}

# Types of sponsors, the first that fits; an academic name shows no hospital.
ACADEMIC = r"\b(universit|college|hochschule|universitat|universite|universidade|universidad)\b"
ACADEMIC_BUT = r"\b(hospital|klinikum|kliniken|medical cent|nhs|medisch centrum)\b"
TYPES = {
    "hospital": r"\b(hospital|hospitals|clinic|klinikum|kliniken|ospedale|hopital|hpital|ziekenhuis|sjukhus|nhs|chu|chru|umc|amc|istituto irccs|policlinico)\b",
    "foundation": r"\b(foundation|fondation|fondazione|stichting|fundacion|fundacao|fundatie)\b",
    "cooperative_group": r"\b(eortc|hovon|sakk|gercor|ecog|hecog|swog|alliance|cooperative group|study group|trial group|network)\b",
    "public_body": r"\b(ministry|government|agency|nih|nci|inserm|nhs england|public health|health authority)\b",
    "charity": r"\b(charity|charitable|cancer research uk|red cross)\b",
}

# A rough type for drawing samples, the first that fits, in lower case.
PRIORS = {
    "industry": r"\b(ltd|inc|gmbh|s\.?a\.?|b\.?v\.?|a/s|plc|llc|pharma|pharmaceutical|biotech|therapeutic|laboratoires|s\.?p\.?a\.?)\b",
    "hospital": r"hospital|klinik|clinic|ziekenhuis|spital|ospedale|h(ô|o)pital|hospitalier|sjukhus|szpital|nemocnice",
    "academic": r"universit|hochschule|univerz|uniwersytet|school of medicine|college",
    "cooperative_group": r"\b(group|groupe|gruppo|intergroup|consortium|network|collaborative|cooperative)\b",
    "foundation": r"foundation|fondation|stichting|fundaci|fondazione|stiftung|trust|charity",
    "public_body": r"institut|centre|center|centro|zentrum|agency|ministry|national|council",
}

# Beginnings of words that lost their letters beyond ASCII.
MANGLED = [
    "universitt", "abteilung fr", "ansthesie", "mnchen", "kln", "zrich", "wrzburg", "dsseldorf", "gttingen", "tbingen", "nrnberg",
    "hpital", "kbenhavn", "linkping", "jyvskyl", "mnster", "pdiatri", "charit", "klinik fr", "institut fr", "hmatologie",
    "onkologie fr", "universittsklinik", "frderung", "gesundheitsfrderung",
]

# Families of names that are easily confused.
TRAPS = {
    "merck_family": r"merck|msd|sharp\s*&?\s*dohme",
    "university": r"universit|hochschule|univerz",
    "hospital": r"hospital|klinik|clinic|ziekenhuis|spital|ospedale|h(ô|o)pital|hospitalier",
    "department": r"\b(department|departement|abteilung|afdeling|servizio|servicio|dept|unit(à|a)|klinik f(ü|u)r|service de)\b",
    "combined": r"\b(and|und|et|en)\b.*\b(hospital|universit|institut|centre|center)\b",
    "joined": r" / | \+ ",
    "titled": r"^(dr|prof|mr|ms|mrs)\.?\s",
    "two_words": r"^[A-Z][a-z]+ [A-Z][a-z]+$",
}


def any_of(words: list[str]) -> str:
    return rf"\b({'|'.join(words)})\b"


def without(c: Column, pattern: str) -> Column:
    return squish(F.regexp_replace(c, pattern, ""))


def no_address(clean: Column) -> Column:
    return without(clean, any_of(ADDRESS))


def no_legal_form(clean: Column) -> Column:
    """Without one legal form at the end."""
    return without(clean, rf"\s+\b({'|'.join(LEGAL_FORMS)})$")


def no_branch(clean: Column) -> Column:
    return without(clean, any_of(BRANCHES))


def strip_legal_forms(clean: Column) -> Column:
    """Without legal forms and the conjunctions that they leave, six deep at most; what a round leaves as it is, further rounds would too."""
    cut = lambda c, rounds: let(without(no_legal_form(c), r"\s+\b(and|und|et|e|y)$"), lambda x: F.when(x == c, x).otherwise(cut(x, rounds - 1)) if rounds > 1 else x)
    return let(clean, lambda c: cut(c, 6))


def usable(c: Column, shortest: int = 1) -> Column:
    return F.when(F.length(c) >= shortest, c)


def listed(*some: Column) -> Column:
    """The values that are not null or empty, each once, in this order."""
    return F.array_distinct(F.filter(F.array(*some), lambda x: x.isNotNull() & (x != "")))


def spelled(raw: Column) -> Column:
    """Saints and centres in one spelling."""
    return squish(replace_all(N.clean_sponsor_alias(raw), (r"\b(sint|saint)\b", "st"), (r"\b(centers?|centres?|centrum)\b", "centre")))


def without_department(raw: Column) -> Column:
    """What stands before a department, if that is three letters or more."""
    return let(N.clean_sponsor_alias(raw), _without_department)


def _without_department(clean: Column) -> Column:
    return let(without(clean, rf"\s+{any_of(DEPARTMENTS)}.*$"), lambda out: F.when((F.length(out) >= 3) & (out != clean), out))


def parent_spellings(raw: Column) -> Column:
    """An institution's name without address and country, in the spellings under which labels know it."""
    base = no_address(N.clean_sponsor_alias(raw))
    base = squish(F.regexp_replace(F.regexp_replace(base, rf"\s+\b({'|'.join(COUNTRY_TAILS)})$", ""), r"^\s*(the\s+)?", ""))
    centred = lambda x: F.array(x, F.regexp_replace(x, r"\bcenter\b", "centre"), F.regexp_replace(x, r"\bcentre\b", "center"))
    saint = lambda word: lambda x: F.regexp_replace(x, rf"\b{word}\b", "st")
    sainted = lambda c: F.concat(c, F.transform(c, saint("sint")), F.transform(c, saint("saint")))
    short = lambda x: F.array(F.regexp_replace(x, r"^university medical cent(?:er|re)\s+(.+)$", "umc $1"), F.regexp_replace(x, r"^universitair medisch centrum\s+(.+)$", "umc $1"), F.regexp_replace(x, r"^(.+)\s+universitair medisch centrum$", "$1 umc"))
    compact = lambda x: F.nullif(F.regexp_extract(x, r"^([a-z0-9-]+\s+umc)\b", 1), F.lit(""))
    every = lambda saints: F.concat(saints, F.flatten(F.transform(saints, short)), F.transform(saints, compact))
    saints = let(let(base, centred), lambda c: F.array_distinct(sainted(c)))
    return F.array_distinct(F.filter(let(saints, every), lambda x: x.isNotNull() & (x != "")))


def named_parents(raw: Column) -> Column:
    """Institutions that a department's name may belong to, as it spells them: its parts that name one, what stands before the department, what begins with an institution."""
    raw = F.coalesce(raw, F.lit(""))
    anchor = any_of(INSTITUTIONS)
    parts = F.filter(F.transform(F.split(raw, r"\s*[,;/]\s*"), N.clean_sponsor_alias), lambda x: (F.length(x) >= 3) & x.rlike(anchor))
    tail = lambda clean: F.nullif(F.regexp_extract(clean, rf"({anchor}.*)$", 1), F.lit(""))
    rest = let(N.clean_sponsor_alias(raw), lambda clean: listed(_without_department(clean), tail(clean)))
    return F.array_distinct(F.concat(parts, rest))


def department_parents(raw: Column) -> Column:
    """Institutions that a department's name may belong to: its parts that name one, then their spellings."""
    return let(named_parents(raw), lambda parents: F.array_distinct(F.concat(parents, F.flatten(F.transform(parents, parent_spellings)))))


def parent_key(raw: Column) -> Column:
    """The first family key among the parents, or null."""
    return F.get(F.filter(F.transform(department_parents(raw), N.family_key), lambda x: x.isNotNull()), 0)


def is_classed(key: Column) -> Column:
    """Whether a family key names a kind of institution."""
    return F.coalesce(key.rlike(rf"::({'|'.join(N.CONCEPTS)})(\|.*)?$"), F.lit(False))


def suggest(raw: Column) -> Column:
    """A proposal for the canonical name: the parent, without address, legal form and branch."""
    cut = lambda clean: no_branch(no_legal_form(no_address(F.coalesce(F.get(named_parents(raw), F.lit(0)), clean))))
    return let(N.clean_sponsor_alias(raw), lambda clean: let(cut(clean), lambda x: F.initcap(F.when(F.length(x) >= 3, x).otherwise(clean))))


def candidates(raw: Column) -> Column:
    """Names under which a sponsor may be known, most faithful first."""
    clean = N.clean_sponsor_alias(raw)
    bare = no_address(clean)
    no_legal = no_legal_form(bare)
    no_paren = N.clean_sponsor_alias(squish(F.regexp_replace(raw, r"\(.*?\)", "")))
    words, most, own = F.split(clean, " "), F.split(no_legal, " "), F.split(bare, " ")
    head = lambda w, k: F.array_join(F.slice(w, 1, k), " ")
    whole = listed(clean, bare, no_paren, no_legal, no_branch(no_legal))
    every = F.concat(whole, department_parents(raw), listed(head(words, 3), head(most, 1), head(most, 2), F.element_at(own, -1)))
    return F.array_distinct(F.filter(every, lambda x: F.length(x) >= 2))


def first_that_fits(c: Column, rules: dict[str, str], otherwise: str) -> Column:
    out = F
    for name, pattern in rules.items():
        out = out.when(c.rlike(pattern), name)
    return out.otherwise(otherwise)


def sponsor_type(raw: Column) -> Column:
    low = F.lower(F.coalesce(raw, F.lit("")))
    return F.when(low.rlike(ACADEMIC) & ~low.rlike(ACADEMIC_BUT), "academic").otherwise(first_that_fits(low, TYPES, "unknown"))


def type_prior(raw: Column) -> Column:
    return first_that_fits(F.lower(raw), PRIORS, "other")


def looks_mangled(raw: Column) -> Column:
    return F.lower(raw).rlike("|".join(MANGLED))


def trap_family(raw: Column) -> Column:
    low = F.lower(raw)
    return (
        F.when(low.rlike(TRAPS["merck_family"]), "merck_family")
        .when(low.rlike(TRAPS["university"]) & low.rlike(TRAPS["hospital"]), "uni_vs_hospital")
        .when(low.rlike(TRAPS["department"]), "department")
        .when(raw.rlike(TRAPS["joined"]) | low.rlike(TRAPS["combined"]), "combined")
        .when(raw.rlike(TRAPS["titled"]) | raw.rlike(TRAPS["two_words"]), "person_like")
        .otherwise("none")
    )


def says_enough(c: Column, shortest: int = 4) -> Column:
    """Whether a derived name still names an organisation."""
    return F.coalesce((F.length(c) >= shortest) & F.exists(F.split(c, " "), lambda t: ~t.isin(STOP_WORDS)), F.lit(False))


def answer(clean: Column, cut: Column, rule: str) -> Column:
    """What one rule alone makes of a cleaned name and of that without legal forms; null where it declines. case_punct answers only where no other rule would."""
    found = {"case_punct": F.when(cut == clean, clean), "legal_suffix": F.when(cut != clean, cut)}[rule]
    return let(found, lambda x: F.when(says_enough(x), F.initcap(x)))


def _both(raw: Column, body: Callable[[Column, Column], Column]) -> Column:
    """body of the cleaned name and of that without legal forms, each made once."""
    return let(N.clean_sponsor_alias(raw), lambda clean: let(strip_legal_forms(clean), lambda cut: body(clean, cut)))


def _verdict(derived: Column, rule: Column | str, confidence: Column | float) -> Column:
    """derived, rule_id and confidence, all null where there is no answer."""
    return let(derived, lambda x: F.struct(x.alias("derived"), F.when(x.isNotNull(), rule).alias("rule_id"), F.when(x.isNotNull(), confidence).alias("confidence")))


def by_rule(raw: Column, rule: str) -> Column:
    """One rule alone: derived, rule_id and confidence, all null where it declines."""
    return _both(raw, lambda clean, cut: _verdict(answer(clean, cut, rule), rule, CONFIDENCE[rule]))


def by_rules(raw: Column) -> Column:
    """The answers of all rules, each alone, as by_rule gives them; rules that decline are left out."""
    every = lambda clean, cut: F.array(*[_verdict(answer(clean, cut, rule), rule, CONFIDENCE[rule]) for rule in CONFIDENCE])
    return F.filter(_both(raw, every), lambda m: m["derived"].isNotNull())


def derive(raw: Column) -> Column:
    """The rules together. Combined sponsors are left as they are; a cut that leaves too little is not made."""

    def together(clean: Column, cut: Column) -> Column:
        fired = (cut != clean) & says_enough(cut)
        name = F.when(fired, cut).otherwise(clean)
        given = lambda x: says_enough(x) & ~F.coalesce(N.is_cross_entity(clean), F.lit(False))
        rule = F.when(fired, "legal_suffix").otherwise("case_punct")
        confidence = F.when(fired, CONFIDENCE["legal_suffix"]).otherwise(CONFIDENCE["case_punct"])
        return _verdict(let(name, lambda x: F.when(given(x), F.initcap(x))), rule, confidence)

    return _both(raw, together)


def removed_words(raw: Column, final: Column) -> Column:
    """The words of raw that are left over when final's are found in it in order. Both are arrays."""
    none = F.array().cast("array<string>")
    step = lambda final: lambda n, w: F.when(F.get(final, n["at"]) == w, F.struct((n["at"] + 1).alias("at"), n["left"].alias("left"))).otherwise(F.struct(n["at"].alias("at"), F.concat(n["left"], F.array(w)).alias("left")))
    return let(final, lambda f: F.aggregate(raw, F.struct(F.lit(0).alias("at"), none.alias("left")), step(f), lambda n: n["left"]))


def removed_tail(raw: Column, final: Column) -> Column:
    """What follows final in raw, if raw begins with all of it; else null. Both are arrays."""
    tail = lambda r, f: F.when((F.size(f) < F.size(r)) & (F.slice(r, 1, F.size(f)) == f), F.array_join(F.slice(r, F.size(f) + 1, F.size(r)), " "))
    return let(raw, lambda r: let(final, lambda f: tail(r, f)))
