"""Increments kept as files of one store, with a catalog of what each file holds.

    <store>/log/run=<id>/log_no=<n>/   the events of a run, clustered by table and key
    <store>/files/of=<id>/             one row for each of its files: the zone map

A zone map row has a file's least and greatest position, table and key. A scan joins the catalog with
the runs it needs and drops files whose zones miss what is asked for; only the others are opened. The
driver makes the same few file-system calls however long a chain is: Spark lists the store itself, in
tasks where it has many folders.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources.changelog import Position, scan_range


def write_run(
    changes: DataFrame, start: Position, end: Position, store: str, run_id: str, key: str, *, db: str | None = None, include: Sequence[str] = (), exclude: Sequence[str] = (),
) -> str:
    """Write the events of [start, end) as a run of the store, and its zone maps; returns the run's folder.

    Events are sorted in ranges of (log file, table, key), so that each file holds few tables and a narrow
    range of keys. Replays need no order: they take the event of the highest position.
    """
    spark, path = changes.sparkSession, f"{store}/log/run={run_id}"
    events = scan_range(changes, start, end, db=db, include=include, exclude=exclude)
    events.repartitionByRange("log_no", "tbl", key).sortWithinPartitions("log_no", "tbl", key).write.partitionBy("log_no").parquet(path)
    # a run without events has no files
    written = spark.read.schema(changes.schema).parquet(path)
    zones = written.groupBy(F.lit(run_id).alias("run"), _file().alias("file"), "log_no").agg(
        F.count("*").alias("rows"), *(f(c).alias(f"{name}_{end}") for c, name in (("log_pos", "pos"), ("tbl", "tbl"), (key, "key")) for f, end in ((F.min, "low"), (F.max, "high"))),
    )
    zones.coalesce(1).write.parquet(f"{store}/files/of={run_id}")
    return path


def _file() -> Column:
    """A file's place in the store, wherever that lies."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"/(run=[^/]*/log_no=[^/]*/[^/]*)$", 1)


def files_of(
    spark: SparkSession, store: str, runs: DataFrame, *, start: Position | None = None, end: Position | None = None, tables: Sequence[str] = (), keys: tuple[Any, Any] | None = None,
) -> DataFrame:
    """The catalog's rows of the files that may hold what is asked for: runs (`run`), positions, tables, a range of keys."""
    zones = spark.read.parquet(f"{store}/files").join(runs.select("run").distinct(), "run", "left_semi")
    no = F.col("log_no")
    if start:
        zones = zones.filter((no > start[0]) | ((no == start[0]) & (F.col("pos_high") >= start[1])))
    if end:
        zones = zones.filter((no < end[0]) | ((no == end[0]) & (F.col("pos_low") < end[1])))
    if tables:
        zones = zones.filter(F.exists(F.array(*map(F.lit, tables)), lambda t: t.between(F.col("tbl_low"), F.col("tbl_high"))))
    if keys:
        zones = zones.filter((F.col("key_high") >= F.lit(keys[0])) & (F.col("key_low") <= F.lit(keys[1])))
    return zones


def read_files(spark: SparkSession, store: str, files: DataFrame, schema: StructType) -> DataFrame:
    """The events in the listed files. The driver holds their names, as the scan itself does."""
    names = [r["file"] for r in files.select("file").collect()]
    if not names:
        return spark.createDataFrame([], schema)
    # a filter on the file's name alone is applied to the listing, before any file is opened
    return spark.read.schema(schema).parquet(f"{store}/log").filter(_file().isin(names)).select(schema.fieldNames())
