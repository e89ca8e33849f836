"""Exact quantiles of groups of any size, by histograms that are refined around the wanted ranks.

The first pass counts values by sign and magnitude, every further one cuts the buckets that hold a wanted rank
into CELLS cells. A bucket carries its count and its smallest and largest value, and a rank is found once the
two agree. Counts are partial sums of bounded number, so no task and no buffer holds the values of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import settle

#: Cells into which a bucket is cut, and buckets to each power of two in the first pass.
CELLS, PER_OCTAVE = 4096, 16


def _magnitude(v: Column) -> Column:
    """Bucket of a value by sign and logarithm, in the order of the values; NaN comes last, as Spark sorts it."""
    level = F.floor(F.least(F.log2(F.abs(v)), F.lit(1100.0)) * PER_OCTAVE) + 2000 * PER_OCTAVE
    return (F.when(F.isnan(v), F.lit(1 << 40)).when(v == 0, F.lit(0)).when(v > 0, level).otherwise(-level)).cast("long")


def _counted(rows: DataFrame, keys: Sequence[str], bucket: Column) -> DataFrame:
    """n, low, high of every bucket, and the values that come before it among those of the same keys."""
    cells = rows.groupBy(*keys, bucket.alias("_cell")).agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    earlier = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def quantiles(df: DataFrame, columns: Sequence[str], points: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, field, q): per group and column an array with the value at each of ``points``, between two values interpolated.

    Equal to ``percentile`` on doubles. Missing values are left out, and a group without values has no row for
    that column. NaN counts as the largest value, infinities as themselves; a null group is a group. ``df`` is
    read once a pass, so settle what is costly to make. Passes end when all ranks are found, after the first and
    48 / log2(CELLS) more or one beyond that. A pass hands nothing on but the table of wanted ranks, which has two
    rows for each group, column and point; Spark broadcasts it if it is small and joins it on the keys if not.
    """
    if not points or not all(0 <= p <= 1 for p in points):
        raise ValueError("points lie between 0 and 1")
    keys = [f"_by{i}" for i in range(len(by))] + ["field"]
    values = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=False)], F.inline(F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns]))).where("v IS NOT NULL")

    first = settle(_counted(values, keys, _magnitude(F.col("v"))))
    size = first.groupBy(*keys).agg(F.sum("n").alias("size"))
    places = [(F.col("size") - 1) * F.lit(float(p)) for p in points]
    ranks = size.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(i).alias("point"), F.lit(upper).alias("upper"), at.alias("at"), (cut(at) + 1).cast("long").alias("rank"))
        for i, at in enumerate(places) for upper, cut in ((False, F.floor), (True, F.ceil))])))
    wanted = settle(_placed(ranks, first, keys))
    while not (open_ := wanted.where("low < high")).isEmpty():
        ranges = [*keys, "low", "high"]
        spans = open_.select(*ranges).distinct().select(*[F.col(c).alias(f"_{c}") for c in ranges])
        inside = values.join(spans, [*_same(values, keys), F.col("v").between(F.col("_low"), F.col("_high"))])
        cell = F.floor((F.col("v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * CELLS)
        finer = _counted(inside.select(*keys, "_low", "_high", "v"), [*keys, "_low", "_high"], cell)
        narrowed = _placed(open_.withColumnsRenamed({"low": "_low", "high": "_high"}), finer, [*keys, "_low", "_high"])
        wanted = settle(wanted.where("NOT low < high").unionByName(narrowed))

    low, high = (F.max(F.when(F.col("upper") == side, F.col("low"))) for side in (False, True))
    pairs = wanted.groupBy(*keys, "point").agg(F.first("at").alias("at"), low.alias("a"), high.alias("b"))
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(
        (F.ceil("at") - F.col("at")) * F.col("a") + (F.col("at") - F.floor("at")) * F.col("b"))
    done = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("point", value.alias("value")))).alias("_q"))
    return done.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=False)], "field", F.col("_q.value").alias("q"))


def _same(rows: DataFrame, keys: Sequence[str]) -> list[Column]:
    """Equal keys; the other side has them with an underscore in front."""
    return [rows[k].eqNullSafe(F.col(f"_{k}")) for k in keys]


def _placed(ranks: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every rank with the range of the cell that holds it, counted on from the start of that cell."""
    known = cells.select(*[F.col(k).alias(f"_{k}") for k in keys], "before", "n", "low", "high")
    held = F.col("rank").between(F.col("before") + 1, F.col("before") + F.col("n"))
    kept = [c for c in ranks.columns if c not in ("rank", "_low", "_high")]
    return ranks.join(known, [*_same(ranks, keys), held]).select(*kept, (F.col("rank") - F.col("before")).alias("rank"), "low", "high")
