"""Registry of named queries: Spark builder + DuckDB oracle SQL.

Each entry's builder takes a :class:`~auric.sources.fixtures.Fixtures` and
returns the operator's result over whole tables; ``oracle`` is independent SQL
over the fixture views (``None`` when only a rows check is meaningful).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package
from ..sources.fixtures import Fixtures
from .present import present


@dataclass
class Query:
    name: str
    build: Callable[[Fixtures], DataFrame]
    oracle: str | None
    survey_id: str


REGISTRY: dict[str, Query] = {}


def register(name: str, survey_id: str, oracle: str | None):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, oracle, survey_id)
        return fn
    return deco


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    # Event times are TIMESTAMP_NTZ; pin the session zone so NTZ → instant casts
    # (watermarks, epoch arithmetic) cannot shift across daylight-saving changes.
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship_package(spark)
    return present(REGISTRY[name].build(Fixtures(spark, sf_dir)))


def load_all():
    from . import queries, queries_core, queries_series, queries_stream  # noqa: F401  (registers everything)
    from . import queries_constraints  # noqa: F401  (after the queries whose tables it checks)
    return REGISTRY
