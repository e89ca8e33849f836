"""Text price files and table sinks.

Files are always read as text with a known schema and then repaired with try-casts, never by inference.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from barloom.functions.scalars import day, number
from barloom.sources.bars import one_per_day
from barloom.sources.checks import require_columns, require_rows

# The positional layout of a downloaded price file and the accepted header names.
POSITIONAL = ("date", "Adj Close", "Close", "High", "Low", "Open", "Volume")
DATE_NAMES = ("date", "Date", "Datetime", "timestamp")
PRICE_NAMES = ("Adj Close", "Adj_Close", "Close", "close", "Price", "price")
PRICE_COLUMNS = {"Open": "open", "High": "high", "Low": "low", "Close": "close",
                 "Adj Close": "adj_close", "Volume": "volume"}


def text_schema(columns: Sequence[str]) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def date_column(columns: Sequence[str], rule: str = "listed") -> str:
    """Name of the date column, the first column when the rule finds none.

    Rules: ``listed`` names in order, ``equal`` to "date" ignoring case, ``contains`` "date" ignoring
    case, ``exact`` "date".
    """
    if rule == "listed":
        found = [c for c in DATE_NAMES if c in columns]
    elif rule == "equal":
        found = [c for c in columns if c.lower() == "date"]
    elif rule == "contains":
        found = [c for c in columns if "date" in c.lower()]
    elif rule == "exact":
        found = [c for c in columns if c == "date"]
    else:
        raise ValueError(f"unknown date rule {rule!r}")
    return found[0] if found else columns[0]


def price_column(columns: Sequence[str], rule: str = "listed") -> str:
    """Name of the price column: ``listed`` names in order, or by ``contains`` with fallbacks."""
    if rule == "listed":
        found = [c for c in PRICE_NAMES if c in columns]
        if not found:
            raise ValueError(f"no price column among {list(columns)}")
        return found[0]
    if rule == "contains":
        lower = [(c, c.lower()) for c in columns]
        adjusted = [c for c, name in lower if "adj" in name and "close" in name]
        plain = [c for c, name in lower if "close" in name]
        return (adjusted + plain + [columns[1]])[0]
    raise ValueError(f"unknown price rule {rule!r}")


def find_price_file(spark: SparkSession, folder: str, candidates: Sequence[str]) -> str:
    """First candidate present in the folder itself, else its first CSV by name, else an error."""
    inside = "/" + re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "", folder).strip("/")
    listing = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true")
        .load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("name"))
        .filter(F.regexp_replace("path", "/[^/]*$", "").endswith(inside))
    )
    rank = F.array_position(F.array(*[F.lit(c) for c in candidates]), F.col("name"))
    best = listing.withColumn("rank", F.when(rank > 0, rank)).orderBy(F.asc_nulls_last("rank"), "name", "path").first()
    if best is None:
        raise FileNotFoundError(f"no price file in {folder}")
    return best["path"]


def by_header(spark: SparkSession, path: str, keys: Sequence[str]) -> list[DataFrame]:
    """One all-text table per distinct header line of the files under ``path``, each with its own columns.

    Executors read the first lines; the driver sees one row per file, as it does when it lists them.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    first = (lines.filter(F.col("start") == 0).withColumn("at", F.monotonically_increasing_id())
             .groupBy("file").agg(F.min_by("value", "at").alias("header")))
    groups: dict[str, list[str]] = {}
    for row in first.orderBy("file").collect():
        groups.setdefault(row.header, []).append(unquote(row.file))
    reader = spark.read.option("header", "true")
    if keys:
        reader = reader.option("basePath", path)
    return [reader.csv(paths) for paths in groups.values()]


def _all_of(parts: Sequence[DataFrame], path: str, keys: Sequence[str]) -> DataFrame:
    if not parts:
        raise ValueError(f"price file {path} has no rows")
    bars = reduce(DataFrame.unionByName, parts)
    return one_per_day(require_rows(bars, f"price file {path}"), keys)


def read_positional(spark: SparkSession, path: str, keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Bars from headerless positional files laid out in one folder per key value, one per day.

    Junk and header lines are exactly the lines whose first cell is not a date. Cells that do not parse
    become missing and rows without any value are dropped.
    """
    raw = spark.read.schema(text_schema((*POSITIONAL, *keys))).csv(path)
    values = {PRICE_COLUMNS[c]: number(c) for c in POSITIONAL[1:]}
    bars = raw.select(*keys, day("date").alias("d"), *[v.alias(n) for n, v in values.items()])
    return _all_of([bars.filter(F.col("d").isNotNull()).dropna("all", subset=list(values))], path, keys)


def read_prices(spark: SparkSession, path: str, date_rule: str = "listed", price_rule: str = "listed",
                keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Key, date and price, one row per day, of headed files; each file's columns are found in its own header."""
    parts = []
    for table in by_header(spark, path, keys):
        columns = [c for c in table.columns if c not in keys]
        d, price = date_column(columns, date_rule), price_column(columns, price_rule)
        raw = table.select(*keys, day(F.col(f"`{d}`")).alias("d"), number(F.col(f"`{price}`")).alias("adj_close"))
        parts.append(raw.dropna("any", subset=["d", "adj_close"]))
    return _all_of(parts, path, keys)


def read_ohlcv(spark: SparkSession, path: str, keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Full bars, one per day, of headed files; every price column must exist and the adjusted close must parse."""
    parts = []
    for table in by_header(spark, path, keys):
        require_columns(table, list(PRICE_COLUMNS), f"price file {path}")
        d = date_column([c for c in table.columns if c not in keys], "equal")
        bars = table.select(*keys, day(F.col(f"`{d}`")).alias("d"),
                            *[number(F.col(f"`{c}`")).alias(n) for c, n in PRICE_COLUMNS.items()])
        parts.append(bars.dropna("any", subset=["d", "adj_close"]))
    return _all_of(parts, path, keys)


def read_labelled(spark: SparkSession, path: str, day_column: str = "d", fmt: str = "parquet",
                  text: Sequence[str] = ("asset", "best_strategy")) -> DataFrame:
    """A stored feature or label table, rows without a date left out.

    CSV is read as text by its header; all columns but the date and those listed in ``text`` become numbers.
    """
    reader = spark.read.format(fmt)
    df = (reader.option("header", "true") if fmt == "csv" else reader).load(path)
    require_columns(df, [day_column], f"labelled table {path}")
    if fmt == "csv":
        df = df.select(*[day(f"`{c}`").alias(c) if c == day_column else F.col(f"`{c}`") if c in text else number(f"`{c}`").alias(c)
                         for c in df.columns])
    return require_rows(df.filter(F.col(day_column).isNotNull()), f"labelled table {path}")


def write_table(df: DataFrame, path: str, keys: Sequence[str] = ("asset",), fmt: str = "parquet",
                mode: str = "errorifexists", **options: str) -> str:
    """Write partitioned by key; the rebalance lets AQE split a key too large for one task."""
    (df.hint("rebalance", *keys).write.mode(mode).partitionBy(*keys).format(fmt).options(**options).save(path))
    return path


def write_checked(df: DataFrame, path: str, keys: Sequence[str] = ("asset",), day_column: str = "d",
                  labels: Mapping[str, Sequence[str]] | None = None, least: int = 1, **sink: str) -> dict:
    """``write_table`` with checks counted by the job that writes: no pass over the data of their own.

    Returns rows, undated rows, first and last day and, for each column of ``labels``, the rows whose value is none
    of those allowed (a missing label is allowed). Fewer than ``least`` rows, an undated row or an unknown label is an
    error that names every fault. It is known once the rows are written, so the folder stays, for a look; read a
    table only after this returned. The counts are taken behind the last exchange, where a task counts once.
    """
    require_columns(df, [*keys, day_column, *(labels or {})], f"table for {path}")
    unknown = {c: F.col(c).isNotNull() & ~F.col(c).isin(*allowed) for c, allowed in (labels or {}).items()}
    count = lambda c: F.count(F.when(c, F.lit(1)))
    seen = Observation()
    watched = df.hint("rebalance", *keys).observe(
        seen, F.count(F.lit(1)).alias("rows"), count(F.col(day_column).isNull()).alias("undated"),
        F.min(day_column).alias("first"), F.max(day_column).alias("last"),
        *[count(bad).alias(f"unknown {c}") for c, bad in unknown.items()])
    (watched.write.mode(sink.pop("mode", "errorifexists")).partitionBy(*keys).format(sink.pop("fmt", "parquet"))
     .options(**sink).save(path))
    found = seen.get
    faults = {k: found[k] for k in ("undated", *[f"unknown {c}" for c in unknown]) if found[k]}
    if found["rows"] < least:
        faults["rows"] = found["rows"]
    if faults:
        raise ValueError(f"table written to {path} fails its checks: {faults}")
    return found


def write_positional(bars: DataFrame, path: str, keys: Sequence[str] = ("asset",)) -> str:
    """Bars as positional CSV with a header line in every file."""
    named = bars.select(*keys, F.col("d").cast("string").alias("date"),
                        *[F.col(PRICE_COLUMNS[c]).cast("string").alias(c) for c in POSITIONAL[1:]])
    return write_table(named, path, keys, "csv", header="true")
