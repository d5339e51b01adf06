"""Record linkage by inverted indexes: postings, retrieval channels, scored pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import names as N
from quillon.functions import sponsors as S
from quillon.operators.frames import first_by
from quillon.operators.lineage import cut

#: Order in which channels win when several find one label.
CHANNEL_RANK = {"exact": 1, "structured": 2, "token_idf": 3, "ngram": 4, "acronym": 5}


@dataclass
class Index:
    """Posting frames: forms (id, label, form), tokens (id, token, is_concat, idf), grams (id, gram), acronyms (id, acronym)."""

    forms: DataFrame
    tokens: DataFrame
    grams: DataFrame
    acronyms: DataFrame
    n: int
    generic: list[str]
    drop_numeric: bool


def _forms(df: DataFrame) -> DataFrame:
    return df.select("id", "label", F.explode(N.fold_forms(F.col("label"))).alias("form")).distinct()


def build_index(labels: DataFrame, n: int = 4, generic: list[str] | None = None, drop_numeric: bool = False) -> Index:
    """labels: id, label."""
    generic = N.GENERIC if generic is None else generic
    forms, total = cut(_forms(labels)), labels.select("id").distinct().count()
    f = F.col("form")
    words, every = N.words_of(f, generic, drop_numeric), N.tokens_of(f, generic, drop_numeric)
    tokens = forms.select("id", F.explode(every).alias("token"), words.alias("w")).select("id", "token", (~F.array_contains("w", F.col("token"))).alias("is_concat"))
    tokens = tokens.groupBy("id", "token").agg(F.bool_and("is_concat").alias("is_concat"))
    idf = tokens.groupBy("token").agg(F.log(1 + F.lit(total) / F.count("*")).alias("idf"))
    grams = forms.select("id", F.explode(N.char_ngrams(f, n)).alias("gram")).filter("gram != ''").distinct()
    acronyms = forms.select("id", N.acronym_of(f).alias("acronym")).filter("acronym IS NOT NULL").distinct()
    return Index(forms, cut(tokens.join(idf, "token")), grams, acronyms, n, generic, drop_numeric)


def _top(df: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def exact(queries: DataFrame, index: Index) -> DataFrame:
    q = queries.select("query", F.explode(N.fold_forms(F.col("text"))).alias("form"))
    return q.join(index.forms, "form").select("query", "id", F.lit(1.0).alias("score"), F.lit("exact").alias("channel")).distinct()


def token_idf(queries: DataFrame, index: Index, k: int = 10, least: float = 0.15) -> DataFrame:
    """Shared weight of the query's known tokens."""
    folded = queries.select("query", F.explode(N.fold_forms(F.col("text"))).alias("form"))
    own = folded.select("query", F.explode(N.tokens_of(F.col("form"), index.generic, index.drop_numeric)).alias("token")).distinct()
    known = own.join(index.tokens.select("token", "idf").distinct(), "token")
    total = known.groupBy("query").agg(F.sum("idf").alias("total"))
    shared = known.join(index.tokens.select("token", "id"), "token").groupBy("query", "id").agg(F.sum("idf").alias("shared"))
    scored = shared.join(total, "query").select("query", "id", (F.col("shared") / F.col("total")).alias("score"), F.lit("token_idf").alias("channel"))
    return _top(scored.filter(F.col("score") >= least), k)


def ngram(queries: DataFrame, index: Index, k: int = 10, threshold: float = 0.45) -> DataFrame:
    """Jaccard similarity of character n-grams."""
    folded = queries.select("query", F.explode(N.fold_forms(F.col("text"))).alias("form"))
    own = folded.select("query", F.explode(N.char_ngrams(F.col("form"), index.n)).alias("gram")).distinct()
    of_query, of_label = own.groupBy("query").agg(F.count("*").alias("nq")), index.grams.groupBy("id").agg(F.count("*").alias("nl"))
    shared = own.join(index.grams, "gram").groupBy("query", "id").agg(F.count("*").alias("s"))
    scored = shared.join(of_query, "query").join(of_label, "id").select("query", "id", (F.col("s") / (F.col("nq") + F.col("nl") - F.col("s"))).alias("score"), F.lit("ngram").alias("channel"))
    return _top(scored.filter(F.col("score") >= threshold), k)


def acronym(queries: DataFrame, index: Index, k: int = 10) -> DataFrame:
    """Labels whose initials are the query's, or the query itself if it is short."""
    folded = queries.select("query", F.explode(N.fold_forms(F.col("text"))).alias("form"))
    short = F.replace(F.col("form"), F.lit(" "), F.lit(""))
    own = folded.select("query", F.explode(F.array(N.acronym_of(F.col("form")), F.when(F.length(short) <= 6, short))).alias("acronym")).filter("length(acronym) >= 2").distinct()
    return _top(own.join(index.acronyms, "acronym").select("query", "id", F.lit(1.0).alias("score"), F.lit("acronym").alias("channel")).distinct(), k)


def structured(queries: DataFrame, index: Index, evidence: DataFrame) -> DataFrame:
    """Labels that share a key (business number, mail domain, postcode) with the query. evidence: raw, evidence_key."""
    keys = queries.join(evidence.withColumnRenamed("raw", "text"), "text").select("query", "text", "evidence_key")
    other = evidence.join(index.forms.select("id", F.col("label").alias("raw")).distinct(), "raw")
    return keys.join(other, "evidence_key").filter("raw != text").select("query", "id", F.lit(1.0).alias("score"), F.lit("structured").alias("channel")).distinct()


def retrieve(queries: DataFrame, index: Index, evidence: DataFrame | None = None, k: int = 10, use_ngram: bool = False, use_acronym: bool = False, threshold: float = 0.45, interleave: bool = False) -> DataFrame:
    """A slate of k labels a query. queries: query, text. Channels fill it by rank, or take turns."""
    parts = [exact(queries, index), token_idf(queries, index, k)]
    parts += [structured(queries, index, evidence)] if evidence is not None else []
    parts += [ngram(queries, index, k, threshold)] if use_ngram else []
    parts += [acronym(queries, index, k)] if use_acronym else []
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    rank = F.try_element_at(F.create_map(*[F.lit(x) for kv in CHANNEL_RANK.items() for x in kv]), F.col("channel"))
    hits = first_by(hits.withColumn("rank", rank), ["query", "id"], F.col("rank"), F.col("score").desc())
    by: list[Column] = [F.col("rank"), F.col("score").desc(), F.col("id")]
    if interleave:
        hits = hits.withColumn("slot", F.row_number().over(Window.partitionBy("query", "channel").orderBy(*by)))
        by = [F.col("slot"), *by]
    hits = hits.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(*by))).filter(F.col("place") <= k)
    return hits.join(index.forms.select("id", "label").distinct(), "id").select("query", "place", "id", "label", "score", "channel")


def pairs_from_postings(postings: DataFrame, key: str, least: int = 2, most: int = 500) -> DataFrame:
    """Pairs a < b that share a key, with the key. Keys of more than `most` postings say nothing and are no evidence:
    the cap is part of the definition, and comes before the join."""
    counts = postings.select(key, "id").distinct().groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n").between(least, most)).select(key)
    kept = postings.select(key, "id").distinct().join(counts, key)
    return kept.select(key, F.col("id").alias("a")).join(kept.select(key, F.col("id").alias("b")), key).filter("a < b")


def token_pairs(index: Index, most: int = 500) -> DataFrame:
    """Shared weight of each pair over the smaller mass of the two, 1 at most."""
    mass = index.tokens.filter("NOT is_concat").groupBy("id").agg(F.sum("idf").alias("mass"))
    idf = index.tokens.select("token", "idf").distinct()
    shared = pairs_from_postings(index.tokens, "token", most=most).join(idf, "token").groupBy("a", "b").agg(F.sum("idf").alias("s"))
    m = [mass.select(F.col("id").alias(x), F.col("mass").alias(f"m_{x}")) for x in "ab"]
    score = F.least(F.lit(1.0), F.col("s") / F.greatest(F.least(F.coalesce("m_a", F.lit(1e-9)), F.coalesce("m_b", F.lit(1e-9))), F.lit(1e-9)))
    return shared.join(m[0], "a", "left").join(m[1], "b", "left").select("a", "b", score.alias("score"), F.lit("token_idf").alias("channel"))


def pair_graph(index: Index, evidence: DataFrame | None = None, use_ngram: bool = False, use_acronym: bool = False, most: int = 500, gram_most: int = 20, gram_shared: int = 6) -> DataFrame:
    """The best channel of each pair."""
    parts = [token_pairs(index, most)]
    if use_acronym:
        parts.append(pairs_from_postings(index.acronyms, "acronym", most=most).select("a", "b", F.lit(1.0).alias("score"), F.lit("acronym").alias("channel")).distinct())
    if use_ngram:
        counts = pairs_from_postings(index.grams, "gram", most=gram_most).groupBy("a", "b").agg(F.count("*").alias("s"))
        parts.append(counts.filter(F.col("s") >= gram_shared).select("a", "b", F.lit(0.7).alias("score"), F.lit("ngram").alias("channel")))
    if evidence is not None:
        keyed = evidence.join(index.forms.select("id", F.col("label").alias("raw")).distinct(), "raw")
        parts.append(pairs_from_postings(keyed, "evidence_key", most=most).select("a", "b", F.lit(1.0).alias("score"), F.lit("structured").alias("channel")).distinct())
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    best = F.max(F.struct("score", "channel")).alias("m")
    return out.groupBy("a", "b").agg(best).select("a", "b", "m.score", "m.channel")


#: Letters from rare to common in names; what is none of these is rarer still.
_RARE_FIRST = "zqxjkwyvbfghpdumclstnroiae "


def _letters(c: Column) -> Column:
    """The letters, each with how often it has stood before, rare ones first: a set, of which two names share as many as their letters match at most."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    counted = F.transform(chars, lambda x, i: F.concat(F.lpad(F.instr(F.lit(_RARE_FIRST), x).cast("string"), 2, "0"), x, F.size(F.filter(F.slice(chars, 1, i + 1), lambda y: y == x)).cast("string")))
    return F.array_sort(counted)


def fuzzy(queries: DataFrame, targets: DataFrame, least: float = 0.92) -> DataFrame:
    """Jaro similarity within the same first letter. queries: query, text; targets: id, target. Generic, short and numbered texts take no part.

    Of two names a share s / |a| + s / |b| >= 3 * least - 1 of letters must match, and one is at most a third longer. So
    they share one of the rarest letters of each, by which they are found; sharing enough letters is checked before Jaro.
    """
    ok = lambda c: (F.length(c) >= 6) & ~c.rlike("^[0-9]") & ~c.isin(N.GENERIC)
    q, t = queries.filter(ok(F.col("text"))), targets.filter(ok(F.col("target")))
    both = 3 * least - 1
    matched = both * 0.75 / 1.75  # of a name's letters at least, if the other is three quarters as long or more

    def keyed(df: DataFrame, text: str) -> DataFrame:
        df = df.withColumn(f"{text}_set", _letters(F.col(text)))
        n = F.size(f"{text}_set")
        few = F.slice(f"{text}_set", 1, (n - F.ceil(n * matched - 1e-9) + 1).cast("int"))
        return df.withColumn("letter", F.explode(few)).withColumn("k", F.substring(text, 1, 1))

    near = keyed(q, "text").join(keyed(t, "target"), ["k", "letter"]).drop("letter").dropDuplicates(["query", "text", "id", "target"])
    near = near.filter(F.abs(F.length("text") - F.length("target")) <= F.greatest(F.length("text"), F.length("target")) * 0.25)
    common = F.size(F.array_intersect("text_set", "target_set"))
    near = near.filter(common / F.length("text") + common / F.length("target") >= both - 1e-9)
    return near.withColumn("score", N.jaro("text", "target")).filter(F.col("score") >= least).select("query", "id", "score")


def containment(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets whose words stand in the query, found by the target's rarest word.

    Both sides grow with the input, and a text's words are many times the table whose size Spark knows: neither is sent to all.
    """
    telling = lambda text: F.array_distinct(F.filter(F.split(text, " "), lambda w: (F.length(w) >= 4) & ~w.isin(N.GENERIC)))
    words = targets.select("id", "target", F.explode(telling("target")).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    signal = first_by(words.join(counts.hint("merge"), "word"), ["id"], F.col("n"), F.col("word"))
    own = queries.select("query", "text", F.explode(telling("text")).alias("word"))
    return own.hint("merge").join(signal.select("id", "target", "word"), "word").filter(N.contains_tokens(F.col("text"), F.col("target"))).select("query", "id").distinct()


def ladder_hit(queries: DataFrame, aliases: DataFrame, ladder: Column) -> DataFrame:
    """The first rung of each query's ladder that is an alias; aliases: alias, canonical. More than one canonical is ambiguous."""
    rungs = queries.select("query", F.posexplode(ladder).alias("rung", "alias"))
    hits = rungs.join(aliases, "alias").groupBy("query", "rung").agg(F.min("canonical").alias("canonical"), F.countDistinct("canonical").alias("n"))
    return first_by(hits, ["query"], F.col("rung")).select("query", "rung", "canonical", (F.col("n") > 1).alias("ambiguous"), (100 - F.col("rung")).alias("score"))


def cascade(queries: DataFrame, tiers: list[tuple[str, DataFrame]]) -> DataFrame:
    """The first tier that answers. Each tier: query, canonical, status. What none answers is unknown."""
    out = None
    for k, (name, df) in enumerate(tiers):
        part = df.select("query", "canonical", "status", F.lit(name).alias("tier"), F.lit(k).alias("_k"))
        out = part if out is None else out.unionByName(part)
    best = first_by(out, ["query"], F.col("_k"), F.col("canonical"))
    return queries.select("query").distinct().join(best.drop("_k"), "query", "left").withColumns({"status": F.coalesce("status", F.lit("unknown")), "tier": F.coalesce("tier", F.lit("unknown"))})


def normalise_sponsors(queries: DataFrame, aliases: DataFrame, overrides: DataFrame, negatives: DataFrame) -> DataFrame:
    """queries: query, text. aliases: alias, canonical. overrides: raw_clean, canonical. negatives: alias."""
    q = queries.withColumn("text", N.clean_sponsor_alias(F.col("text")))
    ladder = S.candidates(F.col("text"))
    over = ladder_hit(q, overrides.select(F.col("raw_clean").alias("alias"), "canonical"), ladder).select("query", "canonical", F.lit("accepted").alias("status"))
    neg = q.select("query", F.explode(ladder).alias("alias")).join(negatives.select("alias"), "alias", "left_semi").select("query", F.lit(None).cast("string").alias("canonical"), F.lit("rejected").alias("status")).distinct()
    hit = ladder_hit(q, aliases, ladder).select("query", "canonical", F.when(F.col("ambiguous") | (F.col("score") < 90), "review").otherwise("accepted").alias("status"))
    canon = aliases.select("canonical").distinct().withColumn("key", N.family_key(F.col("canonical"))).filter("key IS NOT NULL")
    unique = canon.groupBy("key").agg(F.min("canonical").alias("canonical"), F.count("*").alias("n"))
    family = q.withColumn("key", N.family_key(F.col("text"))).join(unique, "key").select("query", "canonical", F.when(F.col("n") == 1, "accepted").otherwise("review").alias("status"))
    cross = q.filter(N.is_cross_entity(F.col("text"))).select("query", F.lit(None).cast("string").alias("canonical"), F.lit("review").alias("status"))
    targets = aliases.select(F.xxhash64("alias").alias("id"), F.col("alias").alias("target"), "canonical")
    held = containment(q, targets).join(targets, "id").groupBy("query").agg(F.min("canonical").alias("canonical"), F.countDistinct("canonical").alias("n")).select("query", "canonical", F.when(F.col("n") == 1, "accepted").otherwise("review").alias("status"))
    close = fuzzy(q, targets).join(targets, "id").groupBy("query").agg(F.max_by("canonical", "score").alias("canonical")).withColumn("status", F.lit("review"))
    return cascade(queries, [("override", over), ("negative", neg), ("alias", hit), ("family", family), ("combined", cross), ("containment", held), ("fuzzy", close)])


def resolve_substances(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """queries: query, text. vocabulary: alias_clean, substance_clean. Class, canonical and rung of each raw substance."""
    aliases = vocabulary.select(N.clean_alias(F.col("alias_clean")).alias("alias"), N.clean_substance(F.col("substance_clean")).alias("canonical")).distinct()
    same = aliases.groupBy("alias").agg(F.bool_or(F.col("alias") == F.col("canonical")).alias("own"))
    aliases = aliases.join(same, "alias").filter("NOT own OR alias = canonical").drop("own")  # an alias that is itself a canonical means that
    hit = ladder_hit(queries, aliases, N.substance_ladder(F.col("text")))
    out = queries.join(hit, "query", "left")
    kind = F.when(N.is_placebo(F.col("text")), "placebo").when(N.junk_reason(F.col("text")).isNotNull(), "rejected").when(F.col("ambiguous"), "ambiguous").when(F.col("canonical").isNotNull(), "registry").otherwise("residue")
    return out.select("query", "text", kind.alias("class"), F.when(kind == "registry", F.col("canonical")).alias("canonical"), "rung")
