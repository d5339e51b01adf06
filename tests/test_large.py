"""Queries on tables whose keys, or groups, are beyond those of the test data."""

import os
import re

import duckdb
import pytest

from quillon import catalog
from quillon.operators import quality
from tests.oracle import TABLES, differences

SF = "/root/testdata/sf0.001"


def tables(at, **changed: str) -> str:
    """A folder of the test data's tables, some of them given by SQL instead."""
    for t in TABLES:
        if t in changed:
            duckdb.execute(f"COPY ({changed[t].format(SF)}) TO '{at}/{t}.parquet' (FORMAT parquet)")
        else:
            os.symlink(f"{SF}/{t}.parquet", f"{at}/{t}.parquet")
    return str(at)


@pytest.fixture(scope="module")
def a_million_trials(tmp_path_factory):
    """Four orders make a trial: trials from 999,900 on, so that most serial numbers have seven digits."""
    return tables(tmp_path_factory.mktemp("keys"), orders="SELECT * REPLACE (o_orderkey + 3999600 AS o_orderkey) FROM '{}/orders.parquet'")


@pytest.mark.parametrize(
    "name",
    [
        "q_pip_compounds",
        "q_pip_compound_choices",
        "q_pip_compounds_top",
        "q_prepared_dates",
        "q_prepared_dimensions",
        "q_prepared_categories",
        "q_prepared_identity",
        "q_prepared_log",
        "q_prepared_waterfall",
    ],
)
def test_numbers_of_seven_digits(spark, a_million_trials, name):
    assert differences(spark, name, catalog.QUERIES[name], catalog.ORACLES[name], a_million_trials) == ""


def cleanings(df) -> int:
    """How often a plan folds a name's letters; each stands for a whole chain of patterns behind it."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("translate(")


@pytest.mark.parametrize(
    "name, most",
    [
        ("q_sponsor_suggestion", 3),  # the name, the name again for its parents, and the parts of the name
        ("q_department_parents", 3),  # as for a suggestion, and each parent's spellings
        ("q_rule_safety", 3),  # the name, what is derived, and what was decided
        ("q_sponsor_rules", 1),
        ("q_removed_words", 1),
    ],
)
def test_names_are_cleaned_once(spark, name, most):
    assert cleanings(catalog.QUERIES[name](spark, SF)) <= most


def test_texts_are_not_sent_to_all(spark):
    """The table of parts is small on disk, and Spark judges by that; the words of all texts are not."""
    assert "Broadcast" not in catalog.QUERIES["q_contained_names"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_first_pairs_equal_all_pairs_sorted(spark):
    """Keys of many sizes, some of one register only, one whose only pair is a row with itself; fewer pairs asked for than there are."""
    rows = [(i, r, f"a title of twenty letters {i * i % 7}") for i in range(60) for r in (["EUCTR"] if i % 3 else ["CTIS", "EUCTR"] if i % 4 else ["CTIS"])]
    rows += [(900, r, "a title of a row that is its own counterpart") for r in ("EUCTR", "CTIS")] + [(901, "EUCTR", "a title of one register alone")]
    df = spark.createDataFrame(rows, "id long, register string, k string")
    every = quality.shared_keys(df, "k")
    for n in (1, 3, 20, every.count() + 5):
        want = quality.top(every, n, "key", "euctr_id", "ctis_id").collect()
        assert quality.first_shared_keys(df, "k", n).collect() == want and len(want) == min(n, every.count())


def test_first_pairs_come_from_few_rows(spark):
    plan = catalog.QUERIES["a_shared_titles"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    pairs = plan.index("euctr_id#", plan.index("Join [key"))
    assert "WindowGroupLimit" in plan[pairs:]


@pytest.mark.parametrize(
    "name",
    [
        "q_country_per_million",
        "q_map_radius",
        "q_substance_debut",
    ],
)
def test_trials_are_told_apart_by_id(spark, name):
    """No arrays are gathered from the files, and pairs that lie by id are not dealt anew to be counted."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "count(distinct" not in plan and not re.search(r"hashpartitioning\((country|substance)#\d+, id#", plan)
