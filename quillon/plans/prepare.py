"""From raw records of both registers to one row a trial.

Each step is a frame of its own: flatten, unify, pick and swap representatives, drop cross-register duplicates, attach
what siblings have, derive. Only keys and small projections are joined; the wide rows are joined once, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import trial as X
from quillon.functions.dimensions import ORGAN_CLASSES, STATUS_CODES
from quillon.functions.text import at_path, blank_to_null, date_spread, dedup_slash, distinct_list, first_date_of, flat, join_list, lookup, split_list, title_key, try_date
from quillon.operators.frames import first_by
from quillon.operators.lineage import cut
from quillon.schema import PATHS

LEAST_TITLE = 20


def flatten(documents: DataFrame) -> DataFrame:
    """The raw frame: one text column a path; paths that the documents lack are null. Invalid ids go."""
    keep = list(ORGAN_CLASSES)
    columns = []
    for name, path in PATHS.items():
        head, *rest = path.split(".")
        found = at_path(F.col(head), documents.schema[head].dataType, rest) if head in documents.columns else None
        if found is None:
            columns.append(F.lit(None).cast("string").alias(name))
        elif not rest and documents.schema[head].dataType.typeName() not in ("array", "struct"):
            columns.append(F.when(~F.col(head).cast("string").isin("NA"), F.col(head).cast("string")).alias(name))
        elif name.startswith("decided") or name.startswith("subjects"):  # lists of dates and numbers are kept whole
            columns.append(join_list(F.filter(found, lambda x: x.isNotNull() & ~x.isin("", "NULL", "NA"))).alias(name))
        else:
            columns.append(flat(found, keep).alias(name))
    return documents.filter(X.valid_id(F.col("_id"))).select("_id", *columns)


def unify(raw: DataFrame) -> DataFrame:
    """Both registers' columns as one, cleaned enough to tell trials apart."""
    reg = F.col("register")
    df = raw.withColumn("register", X.register(F.col("_id")))
    df = df.withColumns(
        {
            "raw_countries": X.unite(F.col("state_e"), F.col("states_c")),
            "transition_eudract_number": distinct_list(F.col("transition")),
            "CT_number": X.unite(F.col("a2"), F.col("ct")),
            "Full_title": X.unite(F.col("title_e"), F.coalesce("title_c", "public_title_c")),
            "DIMP_product_name": X.unite(F.col("products_e"), F.col("products_c")),
            "DIMP_inn_name": X.unite(F.col("inn_1"), F.col("inn_2")),
            "MEDDRA_term": X.unite(F.col("terms_e"), F.col("terms_c")),
            "MEDDRA_organ_class": X.unite(F.col("organs_e"), F.col("organs_c")),
            "Member_state": X.clean_countries(X.unite(X.clean_countries(F.col("state_e")), X.clean_countries(F.col("states_c")))),
            "PIP_status": X.unite(F.col("pip_e"), F.col("pip_c")),
            "trial_status_raw": X.unite(F.col("status_e"), F.col("status_c")),
            "submission_date": F.when(reg == "CTIS", first_date_of(F.col("submitted_c")).cast("string")).otherwise(F.col("submitted_e")),
            "ctis_decision_date_first": first_date_of(F.col("decided_first_c")),
            "decision_date_spread_days": F.when(reg == "CTIS", date_spread(F.col("decided_first_c")).cast("double")),
        }
    )
    text = [f.name for f in df.schema.fields if f.dataType.typeName() == "string" and f.name != "_id"]
    df = df.withColumns({c: blank_to_null(F.col(c)) for c in text})
    df = df.withColumn("application_status_raw", F.col("trial_status_raw"))
    base = F.when(reg == "EUCTR", X.euctr_base(F.col("_id"))).when(F.col("transition_eudract_number").isNotNull(), F.element_at(split_list(F.col("transition_eudract_number")), 1)).otherwise(F.col("_id"))
    return df.withColumns({"trial_base_id": base, "title_key": title_key(F.col("Full_title"))})


def _keys(df: DataFrame) -> DataFrame:
    """The narrow columns that deduplication reads."""
    says = F.coalesce(F.col("trial_status_raw"), F.lit("")).rlike("(?i)transitioned") | F.coalesce(F.col("end_status"), F.lit("")).rlike("(?i)transitioned")
    return df.select("_id", "register", "trial_base_id", "title_key", "CT_number", "transition_eudract_number", says.alias("transitioned"), X.version(F.col("_id")).alias("version"), X.ctis_base(F.col("_id")).alias("ctis_base"), X.euctr_base(F.col("_id")).alias("euctr_base"))


def representatives(keys: DataFrame, member_state: str = "BE") -> DataFrame:
    """One id a base: CTIS first, then the preferred country, the latest amendment, the smallest id."""
    rank = F.when(F.col("register") == "CTIS", 1).when(F.col("register") == "EUCTR", 2).otherwise(3)
    other = F.when((F.col("register") == "EUCTR") & F.col("_id").endswith(f"-{member_state}"), 0).otherwise(1)
    rows = keys.filter("trial_base_id IS NOT NULL AND trial_base_id != ''")
    return first_by(rows, ["trial_base_id"], rank, other, F.coalesce("version", F.lit(-1)).desc(), F.col("_id")).select("_id")


def latest_versions(keys: DataFrame, *by: str) -> DataFrame:
    """CTIS rows of the latest amendment of each base (and of what else is in by)."""
    return first_by(keys.filter("register = 'CTIS'"), ["ctis_base", *by], F.col("version").desc_nulls_last(), F.col("_id"))


def _swap(kept: DataFrame, drop: DataFrame, add: DataFrame) -> DataFrame:
    return cut(kept.join(drop, "_id", "left_anti").unionByName(add).distinct())


def kept_ids(keys: DataFrame) -> dict[str, DataFrame]:
    """Ids after each step, by the step's name; the last is the result. Each step reads the one before several times, so each is cut."""
    keys = cut(keys)
    steps = {"representative": cut(representatives(keys))}
    kept = steps["representative"]
    # an older amendment makes way for the latest
    latest = latest_versions(keys).select("ctis_base", F.col("_id").alias("latest_id"))
    moved = keys.filter("register = 'CTIS'").join(kept, "_id", "left_semi").join(latest, "ctis_base").filter("_id != latest_id")
    kept = steps["latest_version"] = _swap(kept, moved.select("_id"), moved.select(F.col("latest_id").alias("_id")))
    # a transitioned record makes way for its counterpart: by title, else by base id, else by transition number
    moving = keys.filter("register = 'EUCTR' AND transitioned").join(kept, "_id", "left_semi")
    titled = latest_versions(keys.filter(F.length("title_key") >= LEAST_TITLE), "title_key").join(moving.select("title_key"), "title_key", "left_semi")
    kept = steps["title_swap"] = _swap(kept, moving.join(titled.select("title_key"), "title_key", "left_semi").select("_id"), titled.select("_id"))
    still = moving.join(kept, "_id", "left_semi")
    based = first_by(keys.filter("register = 'CTIS'").withColumn("short", F.regexp_replace("_id", r"-\d{2}$", "")), ["short"], F.col("version").desc_nulls_last(), F.col("_id")).join(still.select(F.col("euctr_base").alias("short")), "short", "left_semi")
    kept = steps["base_swap"] = _swap(kept, still.join(based.select(F.col("short").alias("euctr_base")), "euctr_base", "left_semi").select("_id"), based.select("_id"))
    still = moving.join(kept, "_id", "left_semi")
    numbered = keys.filter("register = 'CTIS'").withColumn("euctr_base", F.explode(split_list(F.col("transition_eudract_number"))))
    numbered = first_by(numbered, ["ctis_base", "euctr_base"], F.col("version").desc_nulls_last(), F.col("_id")).join(still.select("euctr_base"), "euctr_base", "left_semi")
    kept = steps["transition_swap"] = _swap(kept, still.join(numbered.select("euctr_base"), "euctr_base", "left_semi").select("_id"), numbered.select("_id"))
    # records of one trial in both registers: the EUCTR copy goes
    rows = keys.join(kept, "_id", "left_semi")
    numbers = rows.filter("register = 'CTIS'").select(F.explode(split_list(F.col("transition_eudract_number"))).alias("euctr_base")).distinct()
    rows = rows.join(rows.filter("register = 'EUCTR'").join(numbers, "euctr_base", "left_semi").select("_id"), "_id", "left_anti")
    rows = cut(rows)
    steps["pass_0"] = rows.select("_id")
    rows = drop_in_both(rows.withColumn("base_ct", X.euctr_base(F.col("CT_number"))), "base_ct")
    rows = cut(rows)
    steps["pass_1"] = rows.select("_id")
    flagged = keys.filter((F.col("register") == "EUCTR") & F.col("transitioned") & (F.length("title_key") >= LEAST_TITLE)).select("title_key").distinct()
    same = rows.join(flagged, "title_key", "left_semi")
    both = same.groupBy("title_key").agg(F.countDistinct("register").alias("k")).filter("k > 1").select("title_key")
    gone = same.filter("register = 'EUCTR'").join(both, "title_key", "left_semi").select("_id")
    steps["pass_2"] = cut(rows.join(gone, "_id", "left_anti").select("_id"))
    return steps


def drop_in_both(rows: DataFrame, key: str) -> DataFrame:
    """Without the EUCTR rows of keys that both registers have."""
    both = rows.groupBy(key).agg(F.countDistinct("register").alias("_k")).filter("_k > 1").select(key)
    gone = rows.filter("register = 'EUCTR'").join(both, F.equal_null(rows[key], both[key]), "left_semi").select("_id")
    return rows.join(gone, "_id", "left_anti")


def sibling_lists(unified: DataFrame) -> DataFrame:
    """What all records of a base have, before any is dropped: one aggregation for all lists."""
    named = {"Member_state": "all_countries", "trial_status_raw": "all_statuses_raw", "MEDDRA_term": "all_meddra", "MEDDRA_organ_class": "all_organ"}
    lists = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(split_list(F.col(c)))))).alias(a) for c, a in named.items()]
    got = unified.groupBy("trial_base_id").agg(*lists)
    return got.select("trial_base_id", F.size("all_countries").alias("n_countries"), *[join_list(F.col(a)).alias(a) for a in named.values()])


def attach_siblings(kept: DataFrame, lists: DataFrame) -> DataFrame:
    df = kept.join(lists, "trial_base_id", "left")
    status = F.when(F.col("register") == "CTIS", F.coalesce("application_status_raw", "trial_status_raw")).otherwise(F.coalesce("all_statuses_raw", "trial_status_raw"))
    return df.withColumns(
        {
            "Member_state": F.coalesce("all_countries", "Member_state"),
            "member_state_status_raw": F.col("all_statuses_raw"),
            "trial_status_raw": status,
            "MEDDRA_term_raw": F.coalesce("all_meddra", "MEDDRA_term"),
            "MEDDRA_organ_class_raw": F.coalesce("all_organ", "MEDDRA_organ_class"),
            "n_countries": F.nullif("n_countries", F.lit(0)),
        }
    ).drop("all_countries", "all_statuses_raw", "all_meddra", "all_organ")


def _latest(*columns: str) -> Column:
    """The latest of several dates; nulls do not count."""
    return F.array_max(F.filter(F.array(*[try_date(F.col(c)) for c in columns]), lambda x: x.isNotNull()))


def derive(df: DataFrame) -> DataFrame:
    """All derived columns of a trial."""
    reg, ctis = F.col("register"), F.col("register") == "CTIS"
    migrated = ctis & F.col("transition_eudract_number").isNotNull()
    code = F.when(ctis, lookup(F.trim("ct_status"), STATUS_CODES))
    end_status = F.when(F.col("end_status").isNull() & F.col("decided_e").isNotNull(), "Ongoing").otherwise(F.col("end_status"))
    df = df.withColumn("_status", F.when(ctis, F.coalesce(code, "trial_status_raw", "application_status_raw", end_status)).otherwise(F.coalesce(end_status, "ct_status", "trial_status_raw")))
    df = df.withColumn("_status", F.when(ctis, F.coalesce(lookup(F.trim("_status"), STATUS_CODES), "_status")).otherwise(F.col("_status")))
    df = df.withColumns(
        {
            "analysis_register": F.when(migrated, "EUCTR").otherwise(reg),
            "MEDDRA_term": X.clean_terms(F.col("MEDDRA_term_raw")),
            "MEDDRA_organ_class": X.clean_organs(F.col("MEDDRA_organ_class_raw")),
            "DIMP_product_name_raw": F.col("DIMP_product_name"),
            "DIMP_inn_name_raw": F.col("DIMP_inn_name"),
            "DIMP_product_name": dedup_slash(F.col("DIMP_product_name")),
            "DIMP_inn_name": dedup_slash(F.col("DIMP_inn_name")),
            "CT_number": distinct_list(F.col("CT_number")),
            "canonical_trial_id": F.col("trial_base_id"),
            "start_date": _latest("start_1", "start_2", "start_3"),
            "status": X.status_category(F.col("_status")),
            "status_raw": X.status_display(F.col("_status")),
            "submission_date_parsed": try_date(F.col("submission_date")),
            "participants_n": F.when(ctis, F.coalesce(X.participants(F.col("subjects_c")), X.participants(F.col("subjects_row_c")))).otherwise(X.participants(F.col("subjects_e"))),
            "has_PIP": X.has_pip(reg, F.col("PIP_status")),
            "age_group": X.age_group(reg, F.col("under_18"), F.col("adults"), F.col("elderly"), F.col("ages_c")),
            "sponsor_type": X.sponsor_type(F.when(ctis, F.col("sponsor_kind_c")).otherwise(F.col("sponsor_kind_e"))),
            "sponsor_name_raw": F.when(ctis, F.col("sponsor_c")).otherwise(F.element_at(F.split("sponsor_e", " / "), 1)),
            "phase": F.when(ctis, X.ctis_phase(F.col("phase_c"))).otherwise(X.euctr_phase(*[F.col(f"phase_{k}") for k in range(1, 5)])),
            "results_source_raw": F.when(ctis, F.col("results_c")).otherwise(F.col("results_e")),
            "is_orphan": X.is_orphan(reg, F.col("orphan_e"), F.col("orphan_c")),
            "pip_decision_number": X.pip_decision_number(F.col("pip_number")),
        }
    )
    decided = F.when(ctis, F.coalesce("ctis_decision_date_first", first_date_of(F.col("decided_c")))).otherwise(try_date(F.col("decided_e")))
    end = F.when(F.col("status") == "Completed", _latest("end_1", "end_2", "end_3"))
    df = df.withColumns({"decision_date": decided, "trial_duration_end_date": end, "status_raw": F.coalesce("status_raw", "status"), "year": F.year("submission_date_parsed")})
    days, lag = F.date_diff("trial_duration_end_date", "start_date"), F.date_diff("decision_date", "submission_date_parsed")
    return df.withColumns(
        {
            "trial_identifiers": X.identifiers(reg, F.col("CT_number"), F.col("transition_eudract_number")),
            "analysis_year": F.when(migrated, F.substring("transition_eudract_number", 1, 4).try_cast("int")).otherwise(F.col("year")),
            "days_to_decision": F.when(lag >= 0, lag.cast("double")),
            "trial_duration_days": F.when(days.between(0, 3649), days.cast("double")),
            "sponsor_name": X.sponsor_name(F.col("sponsor_name_raw")),
            "has_results": F.when(ctis, F.lower(F.coalesce("results_c", F.lit(""))).rlike("^true$")).otherwise(F.col("results_e").isNotNull()),
            "data_processing_version": F.lit(X.DATA_PROCESSING_VERSION),
        }
    ).drop("_status", *PATHS)


def latest_decisions(ledger: DataFrame) -> DataFrame:
    """The last valid decision of each key of an append-only ledger; ties in time go to the larger value."""
    rows = ledger.filter(F.coalesce("domain", F.lit("sponsor")) == "sponsor").filter(F.col("action").isin("accept", "edit", "reject") & (F.col("row_key") != ""))
    last = first_by(rows, ["row_key"], F.col("decided_at_utc").desc_nulls_last(), F.col("action").desc(), F.col("final_value").desc_nulls_last())
    return last.select(F.col("row_key").alias("sponsor_name_raw"), F.when(F.col("action") != "reject", blank_to_null(F.col("final_value"))).alias("human_label"), F.col("action").alias("human_action"))


def attach_sponsor_labels(df: DataFrame, labels: DataFrame, ledger: DataFrame) -> DataFrame:
    """Labels by precedence: a person's, the pipeline's, the raw name; a rejection clears the pipeline's.

    sponsor_type stays the register's flag; the label file's type is sponsor_entity_type.
    """
    own = labels.select("_id", "sponsor_clean", "sponsor_parent", F.col("sponsor_type").alias("sponsor_entity_type"))
    df = df.drop("sponsor_clean", "sponsor_parent", "sponsor_entity_type").join(own, "_id", "left").join(latest_decisions(ledger), "sponsor_name_raw", "left")
    curated = F.col("human_action").isNotNull()
    label = F.coalesce("human_label", F.when(~curated, F.col("sponsor_clean")), "sponsor_name")
    source = F.when(F.col("human_label").isNotNull(), "human").when(curated, "human_reject").when(F.col("sponsor_clean").isNotNull(), "pipeline").otherwise("raw")
    return df.withColumns({"sponsor_label": label, "sponsor_label_source": source}).drop("human_label", "human_action")


def attach_substance_labels(df: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Labels from a file, else the trial's own substances."""
    if labels is None:
        return df.withColumn("substance_label", join_list(X.fallback_substances(F.col("DIMP_inn_name"))))
    return df.join(labels.select("_id", "substance_label"), "_id", "left")


def pip_trial_index(df: DataFrame) -> DataFrame:
    """One row a trial, substance and token by which decisions are matched."""
    rows = df.select("_id", "register", "year", F.explode(split_list(F.col("substance_label"))).alias("active_substance")).filter(X.is_exploratory_substance(F.col("active_substance")))
    return rows.withColumn("substance_token", F.explode(X.substance_tokens(F.col("active_substance")))).distinct()


def pip_decision_index(decisions: DataFrame) -> DataFrame:
    """One row a token and decision."""
    cleaned = decisions.withColumns({c: F.upper(F.trim(c)) for c in ("pip_procedure_number", "pip_decision_number", "decision_type_code")}).distinct()
    rows = cleaned.filter(blank_to_null(F.col("active_substance")).isNotNull()).withColumn("pip_decision_label", F.coalesce("pip_decision_number", "pip_procedure_number", "ema_url"))
    rows = rows.withColumn("substance_token", F.explode(X.substance_tokens(F.col("active_substance"))))
    return first_by(rows, ["substance_token", "pip_decision_label"], F.col("decision_date").desc_nulls_last(), F.col("active_substance"), F.col("condition"))


def complex_compounds(trial_index: DataFrame, decision_index: DataFrame, ids: DataFrame, least: int = 2) -> DataFrame:
    """Compounds with several decisions, and the filtered trials that test them."""
    counts = decision_index.groupBy("substance_token").agg(F.countDistinct("pip_decision_label").alias("n_decisions")).filter(F.col("n_decisions") >= least)
    some = trial_index.join(ids, "_id", "left_semi").join(counts, "substance_token")
    return some.groupBy("substance_token", "n_decisions").agg(
        F.countDistinct("_id").alias("n_trials"), join_list(F.array_sort(F.collect_set("active_substance"))).alias("substances"),
        join_list(F.array_sort(F.collect_set("register"))).alias("registers"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
    )


def compound_decisions(decision_index: DataFrame, token: str) -> DataFrame:
    return decision_index.filter(F.col("substance_token") == token).select("pip_decision_label", "decision_type_code", "decision_date", "active_substance", "condition").distinct().orderBy(F.desc_nulls_last("decision_date"), "pip_decision_label")


def add_pip_columns(df: DataFrame) -> DataFrame:
    tokens = pip_trial_index(df).groupBy("_id").agg(join_list(F.array_sort(F.collect_set("active_substance"))).alias("pip_active_substances"), join_list(F.array_sort(F.collect_set("substance_token"))).alias("pip_substance_tokens"))
    return df.join(tokens, "_id", "left")


def prepare(documents: DataFrame, sponsor_labels: DataFrame, ledger: DataFrame, substance_labels: DataFrame | None = None) -> DataFrame:
    """The prepared table."""
    unified = cut(unify(flatten(documents)))
    kept = unified.join(kept_ids(_keys(unified))["pass_2"], "_id", "left_semi")
    df = derive(attach_siblings(kept, sibling_lists(unified)))
    return add_pip_columns(attach_substance_labels(attach_sponsor_labels(df, sponsor_labels, ledger), substance_labels))


def waterfall(documents: DataFrame) -> DataFrame:
    """Rows after each step of deduplication."""
    from quillon.operators.frames import waterfall as steps_of

    unified = cut(unify(flatten(documents)))
    parts = {"raw": unified.select("_id"), **kept_ids(_keys(unified))}
    frames = [df.agg(F.count("*").alias("remaining")).select(F.lit(k).alias("step"), F.lit(name).alias("name"), "remaining") for k, (name, df) in enumerate(parts.items())]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return steps_of(out)


def normalisation_log(df: DataFrame, raw: str, normalised: str) -> DataFrame:
    """Raw values and what became of them, with the number of trials."""
    counts = df.groupBy("register", F.col(raw).alias("raw"), F.col(normalised).alias("normalised")).agg(F.count("*").alias("n_trials"))
    return counts.withColumn("changed", F.col("raw").isNotNull() & (F.col("raw") != F.coalesce("normalised", F.lit("")))).orderBy("register", F.desc("n_trials"), "raw")


def as_trials(prepared: DataFrame) -> DataFrame:
    """The prepared table with the names and arrays that the named queries, filters and the cube read."""
    lists = {"phases": "phase", "countries": "Member_state", "substances": "substance_label", "terms": "MEDDRA_term", "organs": "MEDDRA_organ_class"}
    names = {"id": "_id", "base_id": "trial_base_id", "title": "Full_title", "product": "DIMP_product_name", "identifiers": "trial_identifiers", "sponsor": "sponsor_label", "has_pip": "has_PIP", "submission_date": "submission_date_parsed", "spread_days": "decision_date_spread_days", "duration_days": "trial_duration_days"}
    same = ["register", "analysis_register", "status", "year", "start_date", "decision_date", "days_to_decision", "participants_n", "n_countries", "age_group", "is_orphan", "has_results", "sponsor_type"]
    return prepared.select(*[F.col(v).alias(k) for k, v in names.items()], *same, *[split_list(F.col(v)).alias(k) for k, v in lists.items()], F.year("decision_date").alias("decision_year"), ((F.col("register") == "CTIS") & (F.col("analysis_register") == "EUCTR")).alias("migrated"))


