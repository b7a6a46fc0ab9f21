"""Per-group ordered scans that never hold a large group in one task.

A plain window puts every row of a group in one task. Here every group of more rows than
a task should scan is cut into slices of its order; each slice is scanned on its own, and
what it needs from earlier slices comes from one summary row per slice.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# inputs up to this size fit one task, so no group of theirs needs slicing
SMALL_BYTES = 128 * 1024 * 1024
# a task scans about a million rows a second, so smaller groups are left whole
HOT_ROWS = 20_000_000
ROWS_PER_SLICE = 5_000_000


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; starts no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def hot_groups(df: DataFrame, keys: list[str], min_rows: int = HOT_ROWS) -> list:
    """Keys of all groups above `min_rows`, with their counts, the largest first.

    Of n rows there are fewer than n / min_rows such groups. Only the key columns are read.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > min_rows)
    return counts.orderBy(F.desc("_rows")).collect()


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: str,
    tie: str,
    *,
    lags: Mapping[str, str] | None = None,
    carries: Mapping[str, Column] | None = None,
    number: str | None = None,
    small_bytes: int = SMALL_BYTES,
    min_rows: int = HOT_ROWS,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Add columns computed along each group in (`order`, `tie`) order.

    lags:    output name -> column, its value in the row before
    carries: output name -> expression, its last non-null value up to this row
    number:  output name of the row number, from 1
    `order` and `tie` are numeric, date or timestamp columns; together unique in a group.
    """
    lags, carries = dict(lags or {}), dict(carries or {})
    for name, expression in carries.items():
        df = df.withColumn(name, expression)

    def windowed(part: DataFrame) -> DataFrame:
        return _scan(part, keys, order, tie, lags, list(carries), number)

    if plan_bytes(df) <= small_bytes:
        return windowed(df)
    hot = hot_groups(df, keys, min_rows)
    if not hot:
        return windowed(df)

    # 50 000 rows for 10^12 (see hot_groups): small enough to send to every task
    fields = [f for f in df.schema.fields if f.name in keys]
    schema = T.StructType([T.StructField(f"__hot_{f.name}", f.dataType) for f in fields] + [T.StructField("__hot", T.IntegerType())])
    listed = df.sparkSession.createDataFrame([(*(row[f.name] for f in fields), i) for i, row in enumerate(hot)], schema)
    same = F.lit(True)
    for f in fields:
        same &= F.col(f.name).eqNullSafe(F.col(f"__hot_{f.name}"))
    marked = df.join(F.broadcast(listed), same, "left").drop(*(f"__hot_{f.name}" for f in fields))

    hot_rows = sum(row["_rows"] for row in hot)
    slices = max(2, math.ceil(hot_rows / rows_per_slice))
    sliced = add_slices(marked.filter(F.col("__hot").isNotNull()), order, tie, slices)
    result = _sliced_scan(sliced, order, tie, lags, list(carries), number)
    return windowed(marked.filter(F.col("__hot").isNull()).drop("__hot")).unionByName(result)


def add_slices(df: DataFrame, order: str, tie: str, slices: int) -> DataFrame:
    """Add (`_slice`, `_sub`), rising with (`order`, `tie`), of about equal row counts.

    Bounds are quantiles, so they follow the data. A value of `order` frequent enough to
    be several bounds gets a slice of its own, divided further by `tie`.
    """
    df = df.withColumn("_order", _as_number(df, order))
    bounds = _quantiles(df, "_order", slices)
    frequent = {a for a, b in zip(bounds, bounds[1:]) if a == b}
    splits = _finite(set(bounds) | {math.nextafter(v, math.inf) for v in frequent})
    df = _bucket(df, "_order", "_slice", splits)
    if frequent:
        df = df.withColumn("_tie", _as_number(df, tie))
        df = _bucket(df, "_tie", "_sub", _finite(_quantiles(df, "_tie", slices))).drop("_tie")
        own = [splits.index(v) + 1 if v > -math.inf else 0 for v in frequent]
        # neighbours too close for a double share a slice; `tie` divides single values only
        spread = df.filter(F.col("_slice").isin(own)).groupBy("_slice").agg(F.min(order).eqNullSafe(F.max(order)).alias("one"))
        own = [r["_slice"] for r in spread.filter("one").collect()]
        df = df.withColumn("_sub", F.when(F.col("_slice").isin(own), F.col("_sub")).otherwise(0))
    else:
        df = df.withColumn("_sub", F.lit(0))
    return df.drop("_order")


def _finite(values: Iterable[float]) -> list[float]:
    return sorted(v for v in set(values) if math.isfinite(v))


def _quantiles(df: DataFrame, column: str, parts: int) -> list[float]:
    points = F.array(*(F.lit(i / parts) for i in range(1, parts)))
    return df.agg(F.percentile_approx(column, points, 10 * parts + 10_000)).first()[0] or []


def _as_number(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, T.DateType):
        number = F.unix_date(name)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        number = F.unix_micros(F.col(name).cast("timestamp"))
    else:
        number = F.col(name)
    # null sorts before everything, here as in a window
    return F.coalesce(number.cast("double"), F.lit(-math.inf))


def _bucket(df: DataFrame, source: str, target: str, splits: Iterable[float]) -> DataFrame:
    splits = [-math.inf, *splits, math.inf]
    if len(splits) < 3:
        return df.withColumn(target, F.lit(0))
    cut = Bucketizer(splits=splits, inputCol=source, outputCol=target, handleInvalid="keep")
    return cut.transform(df).withColumn(target, F.col(target).cast("int"))


def _scan(df, keys, order, tie, lags, carries, number) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order, tie)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    columns = {out: F.lag(column).over(w) for out, column in lags.items()}
    columns |= {name: F.last(name, ignorenulls=True).over(so_far) for name in carries}
    if number:
        columns[number] = F.row_number().over(w).cast("long")
    return df.withColumns(columns)


def _sliced_scan(df, order, tie, lags, carries, number) -> DataFrame:
    part = ["__hot", "_slice", "_sub"]
    at = F.struct(order, tie)
    # one row per slice: its last row, its last non-null values and its row count
    summary = [F.count(F.lit(1)).alias("__before")]
    summary += [F.max_by(F.struct(column), at).alias(f"__end_{out}") for out, column in lags.items()]
    summary += [F.expr(f"max_by({name}, struct({order}, {tie})) FILTER (WHERE {name} IS NOT NULL)").alias(f"__end_{name}") for name in carries]
    edges = df.groupBy(*part).agg(*summary)
    w = Window.partitionBy("__hot").orderBy("_slice", "_sub")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(
        *part,
        F.coalesce(F.sum("__before").over(before), F.lit(0)).alias("__before"),
        *(F.lag(f"__end_{out}").over(w).alias(f"__end_{out}") for out in lags),
        *(F.last(f"__end_{name}", ignorenulls=True).over(before).alias(f"__end_{name}") for name in carries),
    )
    w = Window.partitionBy(*part).orderBy(order, tie)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = {"__row": F.row_number().over(w).cast("long")}
    local |= {out: F.lag(column).over(w) for out, column in lags.items()}
    local |= {name: F.last(name, ignorenulls=True).over(so_far) for name in carries}
    joined = df.withColumns(local).join(edges, part, "left")
    final = {out: F.when(F.col("__row") > 1, F.col(out)).otherwise(F.col(f"__end_{out}")[column]) for out, column in lags.items()}
    final |= {name: F.coalesce(F.col(name), F.col(f"__end_{name}")) for name in carries}
    if number:
        final[number] = F.col("__row") + F.col("__before")
    helpers = [*part, "__row", "__before", *(f"__end_{name}" for name in [*lags, *carries])]
    return joined.withColumns(final).drop(*helpers)
