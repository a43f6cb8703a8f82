"""All queries of the library by name, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tsunagi.plans import entities, intake, jobs, mails, outreach, pairs, service, streams
from tsunagi.sources.binding import Domain, oracle

_PLANS = (pairs, outreach, service, mails, entities, streams, jobs, intake)


def _run(query: Callable[[Domain], DataFrame], spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(Domain(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.t01_best_pairs(Domain(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: partial(_run, f) for plan in _PLANS for f in plan.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: oracle(sql) for plan in _PLANS for f, sql in plan.QUERIES.items() if sql}
