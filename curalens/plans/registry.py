"""Registry of queries: a Spark plan and, where SQL can express it, its DuckDB text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from curalens.plans.oracle_views import ORACLE_VIEWS
from curalens.session import tune
from curalens.sources.standins import Views

PLAN_MODULES = ["lists", "merging", "reviewing", "scoring", "reporting", "slots", "images", "texts", "collecting", "streams"]
_PLANS: dict[str, Callable[[Views], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(plan: Callable[[Views], DataFrame]):
        if name in _PLANS:
            raise ValueError(f"{name} is registered twice")
        _PLANS[name] = plan
        if sql is not None:
            _SQL[name] = with_views(sql)
        return plan
    return register


def with_views(sql: str) -> str:
    """Put the definitions of the domain tables a query names in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in ORACLE_VIEWS:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text, re.I):
                visit(ORACLE_VIEWS[name])
                needed.append(name)

    visit(sql)
    head = ",\n".join(f"{n} AS ({ORACLE_VIEWS[n].strip()})" for n in needed)
    body = sql.strip()
    if not head:
        return body
    if re.match(r"WITH\s", body, re.I):
        return f"WITH {head},\n{body[4:].lstrip()}"
    return f"WITH {head}\n{body}"


def _plain_instants(df: DataFrame) -> DataFrame:
    """Instants leave as zone-free UTC timestamps, the form of the supplied tables."""
    return df.select(*[
        F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType)
        else F.col(f"`{f.name}`") for f in df.schema.fields])


def _bind(plan: Callable[[Views], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tune(spark)
        # Shuffled rows of these tables take some 20 times their bytes once they are sorted or hashed: a task reads
        # a quarter of the usual 64 MB.
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16m")
        return _plain_instants(plan(Views(spark, sf_dir)))
    return run


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: _bind(plan) for name, plan in _PLANS.items()}


def all_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def _load() -> None:
    from importlib import import_module
    for name in PLAN_MODULES:
        import_module(f"curalens.plans.{name}")
