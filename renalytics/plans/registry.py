"""Registry of named plans: ``name -> (spark, sf_dir) -> DataFrame`` and SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Plan] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a plan; ``sql`` is its independent DuckDB/ANSI twin, if any."""
    def deco(fn: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"duplicate plan {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so that its registrations run."""
    import importlib
    for m in PLAN_MODULES:
        importlib.import_module(f"{__package__}.{m}")


PLAN_MODULES = ["staging_plans", "profile_plans", "split_plans", "feature_plans", "evaluation_plans", "risk_plans", "attribution_plans", "report_plans", "smote_plans", "io_plans", "model_plans"]
