"""The registered queries of this package and, where SQL can state one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
LLM_QUERIES: dict[str, Plan] = {}
LLM_ORACLES: dict[str, str] = {}


def registered(sql: str | None = None):
    """Register a function under its name, with the SQL of its rows if there is any."""

    def register(plan: Plan) -> Plan:
        LLM_QUERIES[plan.__name__] = plan
        if sql is not None:
            LLM_ORACLES[plan.__name__] = sql
        return plan

    return register
