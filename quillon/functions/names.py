"""Folding, tokens and cleaning of sponsor and substance names; expressions, but for Jaro similarity."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillon.functions.text import extract, replace_all, squish


def _latin() -> tuple[str, str, dict[str, str]]:
    """Letters from U+00C0 to U+024F and U+1E00 to U+1EFF that fold to one ASCII letter, and those that fold to more."""
    special = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "ħ": "h", "ı": "i", "ŧ": "t"}
    one, to, more = "", "", {}
    for c in [*map(chr, range(0xC0, 0x250)), *map(chr, range(0x1E00, 0x1F00))]:
        low = c.lower()
        flat = special.get(low) or "".join(x for x in unicodedata.normalize("NFKD", low) if not unicodedata.combining(x))
        if flat.isascii() and flat.isalpha():
            if len(flat) == 1:
                one, to = one + c, to + flat
            else:
                more[c] = flat
    return one, to, more


_ONE, _TO, _MORE = _latin()

# Words too frequent in sponsors' names to tell them apart.
GENERIC = ["university", "universite", "universita", "universidad", "universitat", "hospital", "hospitals", "institute", "institut", "instituto", "clinic", "clinical", "centre", "center", "medical", "medicine", "research", "foundation", "fondazione", "fundacion", "department", "group", "gmbh", "ltd", "limited", "inc", "llc", "plc", "corp", "company", "pharma", "pharmaceuticals", "of", "the", "and", "de", "di", "for"]

# Words that do not count when names are compared as bags of words.
KEY_STOP = ["of", "the", "and", "de", "der", "die", "das", "du", "la", "le", "les", "el", "et", "en", "van", "di", "da", "do", "for", "with"]

# Legal forms at the end of sponsors' names.
LEGAL = r"(?i)[\s,]+(gmbh( & co\.? kg)?|ag|inc|ltd|limited|llc|l\.l\.c|plc|corp|corporation|co|company|s\.?a\.?s?|s\.?p\.?a|s\.?r\.?l|b\.?v|n\.?v|a/s|aps|ab|oy|kg|kgaa|se)\.?$"

# Institutions and the patterns that show them.
CONCEPTS = {"university": r"\buniversit\w*|\buniv\b", "hospital": r"\bhospita\w*|\bklini\w*|\bclini\w*|\bziekenhuis\b|\bsjukhus\w*", "institute": r"\binstitut\w*", "foundation": r"\bfoundation\b|\bfonda[tz]ion\w*|\bfundac\w*|\bstiftung\b", "centre": r"\bcent(re|er|ro|rum)\b"}

# Doses and forms that are cut from substances, step by step.
DOSE = r"(?i)\b\d+[,.]?\d*\s*(mg|mcg|microgram|micrograms|mikrogramm|g|ml|l|iu|ui|mbq|gbq|%|ppm|mmol|nmol|molar|units?|i\.?u\.?|mg/ml|mg/kg|g/l)\b"
FORM = r"(?i)\b(solution|suspension|concentrate|powder|lyophilised|lyophilized|tablet|tablets|capsule|capsules|hard capsule|hard capsules|film.?coated|modified.?release|prolonged.?release|extended.?release|immediate.?release|injection|infusion|intravenous|intra.?venous|subcutaneous|intramuscular|intrathecal|intravitreal|oral|topical|transdermal|ophthalmic|nasal|inhaler|inhalation|nebuliser|nebulizer|spray|pre.?filled syringe|prefilled syringe|pen|autoinjector|auto.?injector|vial|ampoule|ampule|bag|dispersion|emulsion|granules|patch|implant|depot|foam|rinse|gel|cream|ointment|lotion|drops|for injection|for infusion|for oral use|for intravenous use)\b"

# Salts that a name ends with.
SALT = r"^(.+?)\s+(hydrochloride|dihydrochloride|hydrobromide|sulfate|sulphate|phosphate|acetate|maleate|fumarate|tartrate|citrate|mesylate|tosylate|besylate|sodium|disodium|potassium|calcium|magnesium|chloride|bromide|nitrate|succinate|lactate|gluconate|monohydrate|dihydrate|trihydrate)$"


def fold_ascii(c: Column) -> Column:
    """Latin letters without accents; other characters stay."""
    c = F.translate(c, _ONE, _TO)
    for letter, flat in _MORE.items():
        if letter in "ßæœþÆŒÞ":
            c = F.replace(c, F.lit(letter), F.lit(flat))
    return c


def tidy(c: Column) -> Column:
    return squish(replace_all(F.replace(F.lower(c), F.lit("&"), F.lit(" and ")), ("[^a-z0-9]+", " ")))


def fold_translit(c: Column) -> Column:
    return tidy(fold_ascii(c))


def fold_delete(c: Column) -> Column:
    """As above, but letters beyond ASCII are dropped, as some sources have them."""
    return tidy(F.regexp_replace(c, r"[^\x01-\x7F]", ""))


def fold_forms(c: Column) -> Column:
    return F.array_distinct(F.array(fold_translit(c), fold_delete(c)))


def words_of(folded: Column, generic: list[str] = GENERIC, drop_numeric: bool = False) -> Column:
    keep = lambda t: (F.length(t) >= 2) & ~t.isin(generic)
    out = F.filter(F.split(folded, " "), keep)
    return F.filter(out, lambda t: ~t.rlike("^[0-9]+$")) if drop_numeric else out


def tokens_of(folded: Column, generic: list[str] = GENERIC, drop_numeric: bool = False) -> Column:
    """Words and the concatenations of neighbouring words."""
    t = words_of(folded, generic, drop_numeric)
    pairs = F.when(F.size(t) >= 2, F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.concat(a, b))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(t, pairs))


def char_ngrams(folded: Column, n: int = 4) -> Column:
    s = F.replace(folded, F.lit(" "), F.lit(""))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - n + 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(n)))
    return F.array_distinct(grams)


def acronym_of(folded: Column) -> Column:
    """Initials of two or more words, else null."""
    w = F.filter(F.split(folded, " "), lambda t: F.length(t) >= 2)
    return F.when(F.size(w) >= 2, F.array_join(F.transform(w, lambda t: F.substring(t, 1, 1)), ""))


def dice(a: Column, b: Column) -> Column:
    """Bigram Dice similarity of folded names."""
    x, y = char_ngrams(fold_translit(a), 2), char_ngrams(fold_translit(b), 2)
    return 2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))


def ngram_jaccard(a: Column, b: Column, n: int = 3) -> Column:
    x, y = char_ngrams(fold_translit(a), n), char_ngrams(fold_translit(b), n)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def fold_key(c: Column) -> Column:
    """The sorted bag of words."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(fold_translit(c), " "), lambda t: (t != "") & ~t.isin(KEY_STOP)))), " ")


def clean_sponsor_alias(c: Column) -> Column:
    """Lower case without accents; quotes and dashes of one kind, other punctuation as blanks."""
    return squish(replace_all(F.lower(fold_ascii(c)), (r"[\u00A0\u200B\u200C\u200D]", " "), ("[‘’`´]", "'"), ("[–—−]", "-"), ("&", " and "), (r"[.,;:(){}\[\]]", " ")))


def strip_legal(c: Column) -> Column:
    """Without legal forms and what joins them, up to six deep."""
    for _ in range(6):
        c = replace_all(F.trim(c), (LEGAL, ""), (r"(?i)\s+(and|&|und|et|y|e)$", ""), (r"[\s,;.-]+$", ""))
    return c


def is_department(c: Column) -> Column:
    return c.rlike(r"(?i)\b(department|dept|division|section|unit|ward|abteilung|afdeling|servicio|service|dipartimento|klinik f[uü]r)\b")


def strip_department(c: Column) -> Column:
    """Without a trailing department clause; null if nothing changes or too little is left."""
    cut = F.trim(F.regexp_replace(c, r"(?i)[,;-]\s*(department|dept|division|section|unit|abteilung|afdeling|servicio|service|dipartimento)\b.*$", ""))
    return F.when((cut != c) & (F.length(cut) >= 4), cut)


def institution_concepts(c: Column) -> Column:
    folded = fold_translit(c)
    return F.filter(F.array(*[F.when(folded.rlike(p), F.lit(k)) for k, p in CONCEPTS.items()]), lambda x: x.isNotNull())


def institution_class(c: Column) -> Column:
    return F.array_join(F.array_sort(institution_concepts(c)), "|")


def anchor_key(c: Column) -> Column:
    """Words of three letters and more that are not generic, once each."""
    folded = fold_translit(c)
    for p in CONCEPTS.values():
        folded = F.regexp_replace(folded, p, " ")
    return F.array_join(F.array_distinct(F.filter(F.split(squish(folded), " "), lambda t: (F.length(t) >= 3) & ~t.isin(GENERIC))), " ")


def family_key(c: Column) -> Column:
    return F.when(anchor_key(c) != "", F.concat_ws("::", anchor_key(c), institution_class(c)))


def combined_parts(c: Column) -> Column:
    """The parts of a combined sponsor; the slashes of a/s and s/a do not divide."""
    kept = replace_all(c, (r"(?i)\ba/s\b", "a§s"), (r"(?i)\bs/a\b", "s§a"))
    return F.filter(F.transform(F.split(kept, r"\s*[/;]\s*"), lambda x: F.trim(F.replace(x, F.lit("§"), F.lit("/")))), lambda x: x != "")


def is_cross_entity(c: Column) -> Column:
    """Whether a combined sponsor names parts of different families."""
    keys = F.array_distinct(F.filter(F.transform(combined_parts(c), lambda x: family_key(x)), lambda x: x.isNotNull()))
    return F.size(keys) > 1


def contains_tokens(haystack: Column, needle: Column) -> Column:
    return F.contains(F.concat(F.lit(" "), haystack, F.lit(" ")), F.concat(F.lit(" "), needle, F.lit(" ")))


def clean_alias(c: Column) -> Column:
    return squish(replace_all(F.lower(c), (r"[  ​‌‍]", " "), ("[®™]", ""), ("[‘’]", "'"), ("[–—−]", "-")))


def clean_substance(c: Column) -> Column:
    return squish(replace_all(clean_alias(c), (r"\s*[/;|]\s*", "|")))


def substance_ladder(c: Column) -> Column:
    """Raw, without dose, without form, and the first token where it is specific."""
    x0 = clean_alias(c)
    x1 = squish(F.regexp_replace(x0, DOSE, ""))
    x2 = squish(F.regexp_replace(x1, FORM, ""))
    first = extract(x2, r"^[a-z0-9][a-z0-9\-]*")
    rungs = F.array(x0, x1, x2, F.when((F.length(first) >= 5) | (first == x0), first))
    return F.array_distinct(F.filter(rungs, lambda r: r.isNotNull() & (r != "")))


def display_substance(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1_000_000)))


def is_placebo(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit(""))).rlike(r"\bplacebo\b")


def junk_reason(c: Column) -> Column:
    """Why a text names no substance, or null."""
    x = clean_alias(c)
    left = squish(replace_all(x, (DOSE, " "), (FORM, " "), (r"\b\d+([.,]\d+)?\b", " "), (r"\b(mg|ml|g|l|iu|x|per|day|daily|dose|doses|once|twice|and|or|of|the|in|with|for)\b", " "), (r"[^a-z0-9À-ɏ]+", " ")))
    holder = x.rlike(r"^(n/?a|none|nil|unknown|not (yet )?(applicable|available|established|assigned)|tbd|to be (determined|confirmed)|various|see above|-+|\.+)$")
    return F.when(F.coalesce(F.length(x), F.lit(0)) < 3, "too short").when(holder, "placeholder").when(F.length(left) < 3, "only dose or form")


def salt_base(c: Column) -> Column:
    """The name without its salt, or null if it ends with none."""
    return squish(extract(F.lower(c), SALT, 1))


def salt_form(c: Column) -> Column:
    return extract(F.lower(c), SALT, 2)


def classify_pair(raw: Column, final: Column) -> Column:
    a, b = F.split(fold_translit(raw), " "), F.split(fold_translit(final), " ")
    more, less = F.size(F.array_except(a, b)), F.size(F.array_except(b, a))
    return F.when((more == 0) & (less == 0), "identical").when(less == 0, "removal").when(more == 0, "addition").otherwise("substitution")


def classify_outcome(raw: Column, derived: Column, want: Column) -> Column:
    return F.when(derived == want, "agree").when(fold_translit(derived) == fold_translit(want), "cosmetic").when(derived == raw, "no-op").otherwise("conflict")


def held_out(c: Column, modulus: int = 10) -> Column:
    """A stable split by a polynomial hash of the characters."""
    codes = F.transform(F.split(c, ""), lambda x: F.ascii(x).cast("long"))
    return F.aggregate(codes, F.lit(7).cast("long"), lambda h, b: (h * 31 + b) % 1000003) % modulus == 0


def is_subsequence(needle: Column, haystack: Column) -> Column:
    """Whether the words of needle stand in haystack in this order."""
    return F.aggregate(haystack, F.lit(0), lambda k, w: F.when(F.get(needle, k) == w, k + 1).otherwise(k)) >= F.size(needle)


def jaro_of(a: str, b: str) -> float:
    """Jaro similarity, without a bonus for prefixes."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, matched = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                matched.append(x)
                break
    if not matched:
        return 0.0
    other = [y for y, t in zip(b, taken, strict=True) if t]
    m, moved = len(matched), sum(x != y for x, y in zip(matched, other, strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


@F.pandas_udf(DoubleType())
def jaro(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
