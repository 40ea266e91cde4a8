"""All registered queries: name -> (query, SQL check or None)."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from colweave.session import tune
from workloads import corpus, mapping, matching, reduction, replies, sessions, streams
from workloads.mapping import flagship  # noqa: F401

MODULES = (corpus, reduction, matching, replies, mapping, sessions, streams)


def _tuned(query):
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(tune(spark), sf_dir)

    return run


def _all():
    merged = {}
    for module in MODULES:
        merged.update(module.QUERIES)
    return merged


def queries():
    return {name: _tuned(query) for name, (query, _) in _all().items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in _all().items() if sql is not None}
