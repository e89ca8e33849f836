"""Schema and data checks that name what they found."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from barloom.functions.scalars import as_col


def require_columns(df: DataFrame, columns: Sequence[str], what: str = "table") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns {missing}; it has {df.columns}")
    return df


def require_rows(df: DataFrame, what: str = "table") -> DataFrame:
    """Error on an empty table; reads at most one row."""
    if df.isEmpty():
        raise ValueError(f"{what} has no rows")
    return df


def require_history(df: DataFrame, minimum: int, what: str = "series") -> DataFrame:
    """Error unless more than ``minimum`` rows exist; scans no further than that."""
    found = df.limit(minimum + 1).count()
    if found <= minimum:
        raise ValueError(f"{what} has {found} rows, more than {minimum} are needed")
    return df


def known_label(c: str | Column, allowed: Sequence[str]) -> Column:
    """The label itself; the job fails on the first value outside ``allowed``."""
    c = as_col(c)
    return F.when(c.isNull() | c.isin(*allowed), c).otherwise(
        F.raise_error(F.concat(F.lit("unexpected label: "), c.cast("string"))))


def unknown_labels(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Distinct values outside ``allowed``."""
    found = df.select(F.col(column).cast("string").alias(column)).filter(F.col(column).isNotNull()).distinct()
    return found.filter(~F.col(column).isin(*allowed))


def numeric_features(df: DataFrame, drop: Sequence[str] = ()) -> list[str]:
    """Numeric columns in schema order, without the dropped ones; errors when none is left."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in drop]
    if not names:
        raise ValueError(f"no numeric feature columns among {df.columns}")
    return names


def complete_rows(df: DataFrame, features: Sequence[str], target: str | None = None) -> DataFrame:
    """Rows where every feature (and the target, if given) is present, features as DOUBLE."""
    subset = [*features, *([target] if target else [])]
    ready = df.dropna("any", subset=subset)
    return ready.withColumns({c: F.col(c).cast("double") for c in features})
