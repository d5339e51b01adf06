"""Column expressions over text and lists of text; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEP = " / "


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once, however often body names it; a plan repeats an expression wherever it stands."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def squish(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def split_list(c: Column, sep: str = SEP) -> Column:
    """Trimmed, non-empty parts of a joined list; null stays null."""
    return F.filter(F.transform(F.split(c, f"\\Q{sep}\\E"), lambda x: F.trim(x)), lambda x: x != "")


def join_list(a: Column, sep: str = SEP) -> Column:
    """A list as text; an empty one is null."""
    return F.when(F.size(a) > 0, F.array_join(a, sep))


def distinct_list(c: Column) -> Column:
    """Parts squished, each once in order of appearance."""
    return join_list(F.array_distinct(F.transform(split_list(c), squish)))


def dedup_slash(c: Column) -> Column:
    """Parts between slashes of any spacing, each once."""
    return join_list(F.array_distinct(F.filter(F.transform(F.split(c, "/"), lambda x: F.trim(x)), lambda x: x != "")))


def title_key(c: Column) -> Column:
    return F.substring(squish(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", " ")), 1, 80)


def extract(c: Column, pattern: str, group: int = 0) -> Column:
    """The match, or null."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def try_date(c: Column) -> Column:
    """A date from yyyy-MM-dd with or without a time, yyyyMMdd, yyyy-MM or yyyy."""
    c = F.trim(c)
    day = F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")).cast("date")
    return F.coalesce(
        F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}([ T].*)?$"), day),
        F.when(c.rlike(r"^\d{8}$"), F.try_to_timestamp(c, F.lit("yyyyMMdd")).cast("date")),
        F.when(c.rlike(r"^\d{4}-\d{2}$"), F.try_to_timestamp(F.concat(c, F.lit("-01")), F.lit("yyyy-MM-dd")).cast("date")),
        F.when(c.rlike(r"^\d{4}$"), F.try_to_timestamp(F.concat(c, F.lit("-01-01")), F.lit("yyyy-MM-dd")).cast("date")),
    )


def dates_of(c: Column) -> Column:
    return F.filter(F.transform(split_list(c, "/"), try_date), lambda x: x.isNotNull())


def first_date_of(c: Column) -> Column:
    """The earliest date of a joined list."""
    return F.array_min(dates_of(c))


def date_spread(c: Column) -> Column:
    """Days between the earliest and the latest date of a joined list."""
    return F.date_diff(F.array_max(dates_of(c)), F.array_min(dates_of(c)))


def lookup(c: Column, table: dict[str, str]) -> Column:
    """A literal map's value, or null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def sentence_case(c: Column) -> Column:
    """First letter upper, the rest lower, but for words that are acronyms of 2 to 5 capitals (HIV-1 too)."""
    words = F.split(c, " ")
    acronym = lambda w: w.rlike("^[A-Z]{2,5}([-/][A-Z0-9]+)*$")
    low = lambda w, i: F.when(i == 0, F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000)))).otherwise(F.lower(w))
    return F.array_join(F.transform(words, lambda w, i: F.when(acronym(w), w).otherwise(low(w, i))), " ")


def replace_all(c: Column, *rules: tuple[str, str]) -> Column:
    for pattern, by in rules:
        c = F.regexp_replace(c, pattern, by)
    return c


def leaves(c: Column, kind: T.DataType) -> Column:
    """All scalars below a nested value of declared type, as an array of text."""
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.flatten(F.transform(c, lambda x: leaves(x, kind.elementType))), F.array().cast("array<string>"))
    if isinstance(kind, T.StructType):
        parts = [leaves(c[f.name], f.dataType) for f in kind.fields]
        return F.concat(*parts) if parts else F.array().cast("array<string>")
    return F.array(c.cast("string"))


def at_path(c: Column, kind: T.DataType, path: list[str]) -> Column | None:
    """The leaves below a dotted path, through arrays and structs; None if the type has no such path."""
    if isinstance(kind, T.ArrayType):
        if at_path(F.lit(None).cast(kind.elementType), kind.elementType, path) is None:
            return None
        return F.coalesce(F.flatten(F.transform(c, lambda x: at_path(x, kind.elementType, path))), F.array().cast("array<string>"))
    if not path:
        return leaves(c, kind)
    if isinstance(kind, T.StructType) and path[0] in kind.fieldNames():
        return at_path(c[path[0]], kind[path[0]].dataType, path[1:])
    return None


def flat(tokens: Column, keep: list[str]) -> Column:
    """Tokens as a joined list: without blanks, NA and NULL, numbers (but for those in keep), timestamps and single characters."""
    good = lambda x: x.isNotNull() & ~x.isin("", "NULL", "NA") & (~x.rlike("^[0-9.]+$") | x.isin(keep)) & ~x.rlike(r"\d{4}-\d{2}-\d{2}T") & (F.length(x) > 1)
    return join_list(F.array_distinct(F.transform(F.filter(tokens, good), lambda x: F.trim(x))))
