"""Query registry: a DataFrame plan, its output shape and, where one exists, the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.plans import sql_parts


@dataclass(frozen=True)
class Shape:
    """Output columns, each with the precision at which two engines are compared.

    ``keys`` pass through, ``n`` are counts, ``r6``/``r3`` are rounded to decimals and ``sig`` to nine
    significant digits (for columns that span many orders of magnitude).
    """

    keys: str = ""
    n: str = ""
    r6: str = ""
    r3: str = ""
    sig: str = ""

    def apply(self, df: DataFrame) -> DataFrame:
        number = lambda c: F.col(c).cast("double")
        exact = lambda c: F.format_string("%.8e", number(c)).cast("double")
        return df.select(
            *self.keys.split(),
            *[F.col(c).cast("bigint").alias(c) for c in self.n.split()],
            *[(F.round(number(c), 6) + F.lit(0.0)).alias(c) for c in self.r6.split()],
            *[(F.round(number(c), 3) + F.lit(0.0)).alias(c) for c in self.r3.split()],
            *[F.when(F.col(c).isNotNull(), exact(c) + F.lit(0.0)).alias(c) for c in self.sig.split()],
        )

    def sql(self, source: str) -> str:
        columns = [
            *self.keys.split(),
            *[f"CAST({c} AS BIGINT) AS {c}" for c in self.n.split()],
            *[f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in self.r6.split()],
            *[f"round(CAST({c} AS DOUBLE), 3) + 0.0 AS {c}" for c in self.r3.split()],
            *[f"CAST(printf('%.8e', CAST({c} AS DOUBLE)) AS DOUBLE) + 0.0 AS {c}" for c in self.sig.split()],
        ]
        return f"SELECT {', '.join(columns)} FROM {source}"


Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(shape: Shape, needs: str = "", sql: str | None = None):
    """Register a plan under its function name.

    ``needs`` lists the shared SQL steps to put in front, ``sql`` is the body of the final step (a name
    of a step, or a SELECT); without it the query is checked by its rows only.
    """

    def register(plan: Plan) -> Plan:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return shape.apply(plan(spark, sf_dir))

        run.__name__, run.__doc__ = plan.__name__, plan.__doc__
        QUERIES[plan.__name__] = run
        if sql is not None:
            body = sql if " " in sql.strip() else f"SELECT * FROM {sql}"
            ORACLES[plan.__name__] = sql_parts.compose(needs.split(), body, shape.sql("answer"))
        return plan

    return register
