"""Numbers, ranks and medians in a global order without sorting all rows in one task.

Rows are range-partitioned by their order and written; each range counts its rows, the few counts are summed up, and
numbers run on inside each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociforge.session import Cut


def _ranged(df: DataFrame, order: list, cut: Cut) -> DataFrame:
    """``df`` with its range as ``_p``; written, as ranges are drawn from a sample that differs from run to run."""
    return cut.write(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))


def _before(ranged: DataFrame, weight) -> DataFrame:
    """``(_p, _before, _all)``: the weight of all ranges before each and of all; a row for each range."""
    sums = ranged.groupBy("_p").agg(F.sum(weight).alias("_w"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_p", F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_in_ranges_before"), F.sum("_w").over(Window.partitionBy()).alias("_all"))


def running(df: DataFrame, order: list, weight: Column, name: str, cut: Cut | None = None) -> DataFrame:
    """``df`` with a ``name`` column: the sum of a whole-number ``weight`` over all rows before it in the order."""
    cut = cut or Cut(df.sparkSession)
    ranged = _ranged(df.withColumn("_w", weight.cast("long")), order, cut)
    inside = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.withColumn(name, F.coalesce(F.sum("_w").over(inside), F.lit(0))).join(F.broadcast(_before(ranged, F.col("_w"))), "_p")
    return joined.select(*df.columns, (F.col(name) + F.col("_in_ranges_before")).cast("long").alias(name))


def numbered(df: DataFrame, order: list, name: str, cut: Cut | None = None, start: int = 0) -> DataFrame:
    """``df`` with a ``name`` column: the place of each row in the order, from ``start`` on."""
    return running(df, order, F.lit(1), name, cut).withColumn(name, F.col(name) + start)


def value_counts(df: DataFrame, col: str, cut: Cut | None = None) -> DataFrame:
    """``(col, n, below, total)``: each distinct value, its rows, the rows with smaller values and all rows."""
    cut = cut or Cut(df.sparkSession)
    ranged = _ranged(df.groupBy(col).agg(F.count("*").alias("n")), [col], cut)
    inside = Window.partitionBy("_p").orderBy(col).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(_before(ranged, F.col("n"))), "_p")
    return joined.select(col, "n", (F.col("_in") + F.col("_in_ranges_before")).alias("below"), F.col("_all").alias("total"))


def exact_median(df: DataFrame, col: str, cut: Cut | None = None) -> float | None:
    """The median of the values that aren't null, the mean of the middle two where their number is even."""
    counts = value_counts(df.filter(F.col(col).isNotNull()), col, cut)
    holds = lambda k: (F.col("below") <= k) & (k < F.col("below") + F.col("n"))
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    row = counts.agg(F.max(F.when(holds(low), F.col(col))), F.max(F.when(holds(high), F.col(col)))).first()
    return None if row[0] is None else (row[0] + row[1]) / 2
