"""Panels stored by key in buckets, so that windows and aggregations per series start without an exchange."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from barloom.functions.frames import DAILY, Series


def store_panel(df: DataFrame, name: str, path: str, s: Series = DAILY, buckets: int = 64) -> DataFrame:
    """Write ``df`` as table ``name`` with files under ``path``, bucketed by the series' keys, sorted by its order.

    The one exchange of a panel is paid here: rows are dealt by key into as many tasks as buckets, each of which
    writes one file. Every plan that partitions by all the keys then reads a bucket a task as it is. A series lies
    in one bucket, so store bars (one row a day), not trades. An existing table or folder is an error.
    """
    dealt = df.repartition(buckets, *s.keys)
    (dealt.write.mode("errorifexists").format("parquet").option("path", path)
     .bucketBy(buckets, *s.keys).sortBy(*s.order).saveAsTable(name))
    return df.sparkSession.table(name)


def attach_panel(spark: SparkSession, name: str, path: str, columns: str, s: Series = DAILY, buckets: int = 64) -> DataFrame:
    """A panel that another session stored: the files hold no bucketing, so its catalog entry is made anew.

    ``columns`` is the schema as DDL; keys, order and ``buckets`` must be those it was stored with. Spark trusts
    them: the bucket is part of each file's name.
    """
    spark.sql(f"CREATE TABLE {_quoted([name])} ({columns}) USING parquet CLUSTERED BY ({_quoted(s.keys)}) "
              f"SORTED BY ({_quoted(s.order)}) INTO {int(buckets)} BUCKETS LOCATION '{_literal(path)}'")
    return spark.table(name)


def _quoted(names: Sequence[str]) -> str:
    return ", ".join(f"`{n.replace('`', '``')}`" for n in names)


def _literal(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")
