"""Row numbers within groups of any size, from one sort of the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize


def numbered(rows: DataFrame, groups: Sequence[str], order: Sequence[str], *, name: str = "pos", size: str = "n") -> DataFrame:
    """Each row with its place in its group, gapless from 0, and the number of rows of the group.

    All rows are sorted by (groups, order) in ranges, so that a group of any size spreads over many tasks. What stands
    before a stretch of a group comes from one row for each group and range. `groups` hold no nulls; `order` should tell
    all rows apart, else equal rows take their places as they come. The result is read from a written table.
    """
    laid = rows.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order)
    # the number of a row in its range, and the range's in the upper bits
    laid = materialize(laid.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    laid = laid.withColumn("_range", F.shiftright("_at", 33))
    runs = laid.groupBy(*groups, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(*groups)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # written, so that the optimizer knows its size when it chooses the join
    runs = materialize(runs.select(*groups, "_range", "_first", before.alias("_before"), F.sum("_n").over(whole).alias(size)), "runs")
    found = laid.join(runs, [*groups, "_range"]).withColumn(name, F.col("_before") + F.col("_at") - F.col("_first"))
    return found.drop("_at", "_range", "_first", "_before")
