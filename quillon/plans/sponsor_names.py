"""Named queries over sponsors' names: types, parents, rules alone and replayed, removed words, a stratified sample.

Names are made from customers: a frame of twelve patterns, filled with the market segment and a number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import names as N
from quillon.functions import sponsors as S
from quillon.operators import sampling

QUERIES: dict = {}
ORACLES: dict = {}

#: {s} is the market segment in lower case, {n} a number below 40.
PATTERNS = [
    "Department of Neurology, {s} {n} University Hospital",
    "{s} {n} Pharma GmbH & Co. KG",
    "Saint {s} {n} Medical Center, 12345 Main Street, New York",
    "Universität {s} {n}",
    "Universitt {s} Klinikum {n}",
    "Fondazione {s} {n}",
    "European {s} {n} Study Group",
    "Ministry of {s} {n}, France",
    "The {s} College / {s} {n} Cancer Trust",
    "Dr. {s} {n}",
    "Universitair Medisch Centrum {s}{n}",
    "{s} {n} International B.V.",
]


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and raw, dealt to as many tasks as the session has shuffle partitions: customers are few bytes, and much is done with each."""
    k, tasks = F.col("c_custkey"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    filled = [F.replace(F.replace(F.lit(p), F.lit("{s}"), F.lower("c_mktsegment")), F.lit("{n}"), (k % 40).cast("string")) for p in PATTERNS]
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(k, "c_mktsegment").repartition(tasks, k).select(k.alias("id"), F.element_at(F.array(*filled), (k % len(PATTERNS) + 1).cast("int")).alias("raw"))


def _each(rows: DataFrame, values: Column, name: str) -> DataFrame:
    """id and one row a value, none of which is null. Under a plain explode Spark tests the array before, and makes it three times."""
    return rows.select("id", F.explode_outer(values).alias(name)).filter(F.col(name).isNotNull())


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_RAW = f"replace(replace([{', '.join(map(_q, PATTERNS))}][CAST(c_custkey % {len(PATTERNS)} AS INT) + 1], '{{s}}', lower(c_mktsegment)), '{{n}}', CAST(c_custkey % 40 AS VARCHAR))"


def _clean(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(replace(lower(strip_accents({x})), '&', ' and '), '[.,;:(){{}}\\[\\]]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _without(x: str, pattern: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, {_q(pattern)}, '', 'g'), '\\s+', ' ', 'g'))"


def _title(x: str) -> str:
    return f"list_aggregate(list_transform(string_split({x}, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ')"


def _case(x: str, rules: dict[str, str], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, {_q(p)}) THEN '{k}'" for k, p in rules.items()) + f" ELSE '{otherwise}' END"


_LEGAL = rf"\s+\b({'|'.join(S.LEGAL_FORMS)})$"
_ANCHOR = S.any_of(S.INSTITUTIONS)
_CUT = ", ".join(f"c{k} AS (SELECT * REPLACE ({_without(_without('cut', _LEGAL), chr(92) + 's+' + chr(92) + 'b(and|und|et|e|y)$')} AS cut) FROM {'c' + str(k - 1) if k else 'n0'})" for k in range(6))
#: n: id, raw, clean, and cut, which is clean without legal forms.
NAMES = f"WITH n0 AS (SELECT c_custkey AS id, {_RAW} AS raw, {_clean(_RAW)} AS clean, {_clean(_RAW)} AS cut FROM customer), {_CUT}, n AS (SELECT * FROM c5)"
_ENOUGH = f"(length({{x}}) >= 4 AND len(list_filter(string_split({{x}}, ' '), lambda w: w NOT IN ({', '.join(map(_q, S.STOP_WORDS))}))) > 0)"


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


#: In lower case; for DuckDB's word boundaries letters beyond ASCII are no letters, so another one stands in.
_LOW = "regexp_replace(lower(raw), '[à-ÿ]', 'x', 'g')"


@query(NAMES + f" SELECT id, CASE WHEN regexp_matches({_LOW}, {_q(S.ACADEMIC)}) AND NOT regexp_matches({_LOW}, {_q(S.ACADEMIC_BUT)}) THEN 'academic' ELSE {_case(_LOW, S.TYPES, 'unknown')} END AS sponsor_type FROM n")
def q_sponsor_types(spark, d):
    return named(spark, d).select("id", S.sponsor_type(F.col("raw")).alias("sponsor_type"))


_TRAP = (
    f"CASE WHEN regexp_matches(lower(raw), {_q(S.TRAPS['merck_family'])}) THEN 'merck_family' WHEN regexp_matches(lower(raw), {_q(S.TRAPS['university'])}) AND regexp_matches(lower(raw), {_q(S.TRAPS['hospital'])}) THEN 'uni_vs_hospital'"
    f" WHEN regexp_matches(lower(raw), {_q(S.TRAPS['department'])}) THEN 'department' WHEN regexp_matches(raw, {_q(S.TRAPS['joined'])}) OR regexp_matches(lower(raw), {_q(S.TRAPS['combined'])}) THEN 'combined'"
    f" WHEN regexp_matches(raw, {_q(S.TRAPS['titled'])}) OR regexp_matches(raw, {_q(S.TRAPS['two_words'])}) THEN 'person_like' ELSE 'none' END"
)
_STRATA = f"s AS (SELECT id, {_case('lower(raw)', S.PRIORS, 'other')} AS prior, regexp_matches(lower(raw), {_q('|'.join(S.MANGLED))}) AS mangled, {_TRAP} AS trap FROM n)"


@query(NAMES + f", {_STRATA} SELECT * FROM s")
def q_sponsor_strata(spark, d):
    raw = F.col("raw")
    return named(spark, d).select("id", S.type_prior(raw).alias("prior"), S.looks_mangled(raw).alias("mangled"), S.trap_family(raw).alias("trap"))


@query(
    NAMES
    + f""", {_STRATA}, c AS (SELECT prior, count(*) AS n FROM s GROUP BY 1), q AS (SELECT prior, n, least(n, greatest(2, CAST(floor(100 * n / CAST((SELECT sum(n) FROM c) AS DOUBLE)) AS BIGINT))) AS k FROM c),
 o AS (SELECT *, CAST(sum(k) OVER () AS BIGINT) AS total FROM q), f AS (SELECT prior, CASE WHEN row_number() OVER (ORDER BY n - k DESC, prior) = 1 THEN least(n, greatest(2, k + 100 - total)) ELSE k END AS k FROM o)
 SELECT id, prior, rank FROM (SELECT id, prior, CAST(row_number() OVER (PARTITION BY prior ORDER BY (id * 7919 + 13) % 1000003, id) AS INT) AS rank FROM s) JOIN f USING (prior) WHERE rank <= k"""
)
def q_gold_sample(spark, d):
    """A hundred names, dealt to rough types by their shares, two of each at least, in an order that a hash fixes."""
    rows = named(spark, d).select("id", S.type_prior(F.col("raw")).alias("prior"))
    return sampling.stratified(rows, "prior", 100, 2, (F.col("id") * 7919 + 13) % 1000003, F.col("id")).select("id", "prior", "rank")


@query(
    NAMES
    + f", a AS (SELECT id, 'case_punct' AS rule, CASE WHEN cut = clean THEN clean END AS x FROM n UNION ALL SELECT id, 'legal_suffix', CASE WHEN cut <> clean THEN cut END FROM n)"
    + f" SELECT id, rule, {_title('x')} AS derived, CASE rule WHEN 'case_punct' THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.85 AS DOUBLE) END AS confidence FROM a WHERE {_ENOUGH.format(x='x')}"
)
def q_sponsor_rules(spark, d):
    """What each rule alone makes of a name."""
    return _each(named(spark, d), S.by_rules(F.col("raw")), "m").select("id", F.col("m.rule_id").alias("rule"), "m.derived", "m.confidence")


def _spellings() -> tuple[str, str, str]:
    """Lists of an institution's spellings: of saints from c, short and compact ones from s."""
    rr = lambda y, a, b: f"regexp_replace({y}, {_q(a)}, {_q(b)}, 'g')"
    saints = f"list_concat(c, list_transform(c, lambda y: {rr('y', chr(92) + 'bsint' + chr(92) + 'b', 'st')}), list_transform(c, lambda y: {rr('y', chr(92) + 'bsaint' + chr(92) + 'b', 'st')}))"
    short = [rr("y", r"^university medical cent(?:er|re)\s+(.+)$", r"umc \1"), rr("y", r"^universitair medisch centrum\s+(.+)$", r"umc \1"), rr("y", r"^(.+)\s+universitair medisch centrum$", r"\1 umc")]
    return saints, f"flatten(list_transform(s, lambda y: [{', '.join(short)}]))", r"list_transform(s, lambda y: nullif(regexp_extract(y, '^([a-z0-9-]+\s+umc)\b', 1), ''))"


_PARTS = f"list_filter(list_transform(regexp_split_to_array(raw, '\\s*[,;/]\\s*'), lambda x: {_clean('x')}), lambda x: length(x) >= 3 AND regexp_matches(x, {_q(_ANCHOR)}))"
_STRIPPED = _without("clean", rf"\s+{S.any_of(S.DEPARTMENTS)}.*$")
_SAINTS, _SHORT, _COMPACT = _spellings()
PARENTS = (
    NAMES
    + f", p AS (SELECT id, raw, clean, {_PARTS} AS parts, CASE WHEN {_STRIPPED} <> clean AND length({_STRIPPED}) >= 3 THEN {_STRIPPED} END AS stripped, nullif(regexp_extract(clean, {_q('(' + _ANCHOR + '.*)$')}, 1), '') AS tail FROM n)"
    + ", f AS (SELECT *, coalesce(parts[1], stripped, tail) AS first FROM p)"
)
_BASE = f"trim(regexp_replace(regexp_replace(regexp_replace({_without(_clean('parent'), S.any_of(S.ADDRESS))}, {_q(chr(92) + 's+' + chr(92) + 'b(' + '|'.join(S.COUNTRY_TAILS) + ')$')}, ''), '^\\s*(the\\s+)?', ''), '\\s+', ' ', 'g'))"


@query(
    PARENTS
    + f""", e AS (SELECT DISTINCT id, unnest(list_concat(parts, [stripped, tail])) AS parent FROM f), b AS (SELECT id, parent, {_BASE} AS base FROM e WHERE parent IS NOT NULL),
 v AS (SELECT id, [base, regexp_replace(base, '\\bcenter\\b', 'centre', 'g'), regexp_replace(base, '\\bcentre\\b', 'center', 'g')] AS c FROM b), w AS (SELECT id, {_SAINTS} AS s FROM v), x AS (SELECT id, unnest(list_concat(s, {_SHORT}, {_COMPACT})) AS parent FROM w)
 SELECT DISTINCT id, parent FROM (SELECT id, parent FROM b UNION ALL SELECT id, parent FROM x) WHERE parent IS NOT NULL AND parent <> ''"""
)
def q_department_parents(spark, d):
    return _each(named(spark, d), S.department_parents(F.col("raw")), "parent").distinct()


_SUGGESTED = _without(_without(_without("coalesce(first, clean)", S.any_of(S.ADDRESS)), _LEGAL), S.any_of(S.BRANCHES))


@query(PARENTS + f", g AS (SELECT id, CASE WHEN length({_SUGGESTED}) >= 3 THEN {_SUGGESTED} ELSE clean END AS x FROM f) SELECT id, {_title('x')} AS suggestion FROM g")
def q_sponsor_suggestion(spark, d):
    return named(spark, d).select("id", S.suggest(F.col("raw")).alias("suggestion"))


@query(NAMES + " SELECT id, nullif(array_to_string(string_split(clean, ' ')[len(string_split(cut, ' ')) + 1:], ' '), '') AS tail, CAST(len(string_split(clean, ' ')) - len(string_split(cut, ' ')) AS INT) AS n FROM n")
def q_removed_words(spark, d):
    """What the legal rule cuts from the end of a name, and how many words."""
    raw, final = F.split("clean", " "), F.split("cut", " ")
    return cut_names(named(spark, d)).select("id", S.removed_tail(raw, final).alias("tail"), F.size(S.removed_words(raw, final)).alias("n"))


def cut_names(rows: DataFrame) -> DataFrame:
    """id, raw, clean, and cut, which is clean without legal forms; each column is made from the one before."""
    return rows.withColumn("clean", N.clean_sponsor_alias(F.col("raw"))).withColumn("cut", S.strip_legal_forms(F.col("clean")))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw, what was decided for it, and what the rules derive: every third decision keeps the legal form, every fifth name is another one."""
    clean, cut = F.col("clean"), F.col("cut")
    want = F.when(F.col("id") % 5 == 0, F.concat(F.lit("Other "), F.initcap(cut))).when(F.col("id") % 3 == 0, F.initcap(clean)).when(F.col("id") % 7 == 0, F.upper(cut)).otherwise(F.initcap(cut))
    return cut_names(named(spark, sf_dir)).withColumn("final", want)


_PAIRS = NAMES + f", w AS (SELECT *, CASE WHEN id % 5 = 0 THEN 'Other ' || {_title('cut')} WHEN id % 3 = 0 THEN {_title('clean')} WHEN id % 7 = 0 THEN upper(cut) ELSE {_title('cut')} END AS final FROM n)"
_RULES = f", a AS (SELECT *, 'case_punct' AS rule, CASE WHEN cut = clean THEN clean END AS x FROM w UNION ALL SELECT *, 'legal_suffix', CASE WHEN cut <> clean THEN cut END FROM w), o AS (SELECT *, {_title('x')} AS derived FROM a WHERE {_ENOUGH.format(x='x')}), c AS (SELECT rule, CASE WHEN derived = final THEN 'agree' WHEN lower(derived) = lower(final) THEN 'cosmetic' ELSE 'conflict' END AS outcome FROM o)"


@query(_PAIRS + _RULES + " SELECT rule, count(*) AS fires, count_if(outcome = 'agree') AS agree, count_if(outcome = 'cosmetic') AS cosmetic, count_if(outcome = 'conflict') AS conflict, round(100.0 * count_if(outcome = 'conflict') / count(*), 1) AS conflict_pct FROM c GROUP BY 1")
def q_rule_safety(spark, d):
    """How often each rule alone agrees with what was decided."""
    rows = pairs(spark, d)
    return sampling.rule_safety(rows, {r: S.answer(F.col("clean"), F.col("cut"), r) for r in S.CONFIDENCE}, "final")


@query(NAMES + ", r AS (SELECT unnest(string_split(clean, ' ')[len(string_split(cut, ' ')) + 1:]) AS word FROM n) SELECT word, count(*) AS n FROM r GROUP BY 1 QUALIFY row_number() OVER (ORDER BY count(*) DESC, word) <= 25")
def q_removed_word_counts(spark, d):
    """The words that decisions cut most often."""
    rows = pairs(spark, d)
    left: Column = S.removed_words(F.split("clean", " "), F.split("cut", " "))
    return _each(rows, left, "word").groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(25)
