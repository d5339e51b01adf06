"""All queries by name, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.plans import dashboard, prepared, quality, records, registry_names, reports, special, sponsor_names
from quillon.plans.spec import Counts
from quillon.plans.trials_view import exploded, trials

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _run(spark: SparkSession, sf_dir: str, spec) -> DataFrame:
    if isinstance(spec, Counts) and (flat := spec.flat()):
        return spec.run(exploded(spark, sf_dir, flat[1], flat[0], *spec.needs()), exploded=True)
    return spec.run(trials(spark, sf_dir, *spec.needs()))


for _name, _spec in {**dashboard.QUERIES, **reports.QUERIES}.items():
    QUERIES[_name] = lambda spark, sf_dir, spec=_spec: _run(spark, sf_dir, spec)
    ORACLES[_name] = _spec.sql()

QUERIES |= special.QUERIES | records.QUERIES | prepared.QUERIES | quality.QUERIES | sponsor_names.QUERIES | registry_names.QUERIES
ORACLES |= special.ORACLES | records.ORACLES | prepared.ORACLES | quality.ORACLES | sponsor_names.ORACLES | registry_names.ORACLES
