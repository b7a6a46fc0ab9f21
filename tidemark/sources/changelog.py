"""The change log as a table: half-open range scans, the end position, increments.

A position is (log_no, log_pos). One event may carry several rows, told apart by `sub`;
ranges use the position alone and so never split an event.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType

from tidemark.operators.select import keep_names
from tidemark.session import folder_exists, partition_values

Position = tuple[int, int]
# the first event of a log file starts here, after the file's magic number
FIRST_POS = 4


def in_range(start: Position, end: Position) -> Column:
    """`start <= position < end`.

    Written with plain bounds on log_no, so that a table partitioned by log_no is pruned;
    a comparison of structs keeps the same rows but prunes nothing.
    """
    (s, s_pos), (e, e_pos) = start, end
    no, pos = F.col("log_no"), F.col("log_pos")
    return no.between(s, e) & ~((no == s) & (pos < s_pos)) & ~((no == e) & (pos >= e_pos))


def check_range(start: Position, end: Position) -> None:
    if start[0] < 1 or end[0] < 1 or start[1] <= 0 or end[1] <= 0:
        raise ValueError(f"not a valid position range: {start} to {end}")
    if start[0] > end[0]:
        raise ValueError(f"start log file {start[0]} comes after end log file {end[0]}")


def scan_range(
    changes: DataFrame,
    start: Position,
    end: Position,
    db: str | None = None,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
) -> DataFrame:
    """Events in [start, end), of one database and of the tables a snapshot selected."""
    check_range(start, end)
    rows = changes.filter(in_range(start, end))
    if db is not None:
        rows = rows.filter(F.col("db") == db)
    return keep_names(rows, "tbl", include, exclude)


def read_range(spark: SparkSession, path: str, start: Position, end: Position) -> DataFrame:
    """Range scan of a stored log, partitioned by log_no.

    The first, middle and last files are separate scans: only so do the position bounds
    reach the Parquet reader, and the files between carry no position test at all.
    """
    check_range(start, end)
    log = spark.read.parquet(path)
    no, pos = F.col("log_no"), F.col("log_pos")
    (s, s_pos), (e, e_pos) = start, end
    if s == e:
        return log.filter((no == s) & (pos >= s_pos) & (pos < e_pos))
    parts = [log.filter((no == s) & (pos >= s_pos)), log.filter((no == e) & (pos < e_pos))]
    if e - s > 1:
        parts.insert(1, log.filter((no > s) & (no < e)))
    return reduce(DataFrame.unionAll, parts)


def scan_per_table(changes: DataFrame, positions: DataFrame, end: Position | None = None) -> DataFrame:
    """Events of each table from that table's own position on.

    `positions` has one row per table (tbl, start_no, start_pos); tables without a
    position have no snapshot to replay onto and give no events. Files before the earliest
    start, one number looked up first, are not read.
    """
    first = positions.agg(F.min("start_no")).first()[0]
    changes = changes.filter(F.col("log_no") >= F.lit(first)) if first is not None else changes.limit(0)
    no, pos = F.col("log_no"), F.col("log_pos")
    after = (no > F.col("start_no")) | ((no == F.col("start_no")) & (pos >= F.col("start_pos")))
    if end is not None:
        changes = changes.filter((no < end[0]) | ((no == end[0]) & (pos < end[1])))
    return changes.join(positions, "tbl").filter(after).select(changes.columns)


def log_end(changes: DataFrame) -> DataFrame:
    """The exclusive end: just past the last event, hence a valid next start."""
    last = changes.agg(F.max(F.struct("log_no", "log_pos")).alias("at"))
    return last.select(F.col("at.log_no").cast("int").alias("log_no"), (F.col("at.log_pos") + 1).alias("log_pos"))


def stored_log_numbers(spark: SparkSession, path: str) -> list[int]:
    """The log files of a log stored by `log_no`, in order, from the listing alone."""
    return sorted(int(v) for v in partition_values(spark, path, "log_no"))


def stored_log_end(spark: SparkSession, path: str) -> DataFrame:
    """`log_end` of a log stored by `log_no`: only its last file that has events is read."""
    log = spark.read.parquet(path)
    for number in reversed(stored_log_numbers(spark, path)):
        end = log_end(log.filter(F.col("log_no") == number)).filter("log_no IS NOT NULL")
        if not end.isEmpty():
            return end
    return log_end(log.limit(0))


def log_files(changes: DataFrame) -> DataFrame:
    """Log files in server order, which is the order of the numeric suffix, not of names."""
    return (
        changes.select("log_file").distinct()
        .select("log_file", F.regexp_extract("log_file", r"([0-9]+)$", 1).cast("int").alias("log_no"))
        .orderBy("log_no")
    )


def range_files(files: DataFrame, start_file: str, end_file: str) -> DataFrame:
    """The files a range touches; both ends must exist and stand in order."""
    ends = {r["log_file"]: r["log_no"] for r in files.filter(F.col("log_file").isin(start_file, end_file)).collect()}
    for name in (start_file, end_file):
        if name not in ends:
            raise ValueError(f"log file does not exist: {name}")
    if ends[start_file] > ends[end_file]:
        raise ValueError(f"log file {start_file} comes after {end_file}")
    return files.filter(F.col("log_no").between(ends[start_file], ends[end_file]))


def write_increment(
    changes: DataFrame, start: Position, end: Position, path: str, *, full_id: str = "", db: str | None = None, include: Sequence[str] = (), exclude: Sequence[str] = (),
) -> DataFrame:
    """Write the events of [start, end), one partition per log file, and the info record.

    Of one database, and of the tables that the full's lists choose, where these are given.

    `rebalance` divides a large log file among several tasks and packs small ones, so
    neither decides the size of the files written. Returns the one-row info record.
    """
    spark = changes.sparkSession
    events = scan_range(changes, start, end, db=db, include=include, exclude=exclude)
    events.hint("rebalance", "log_no").write.partitionBy("log_no").parquet(f"{path}/log")
    record = {
        "database": db or "", "full_backup_file_id": full_id,
        "start_no": start[0], "start_pos": start[1], "end_no": end[0], "end_pos": end[1],
    }
    info = spark.range(1).select(*(F.lit(v).alias(k) for k, v in record.items()))
    info.coalesce(1).write.json(f"{path}/meta")
    return info


def read_increment(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/log")


def read_increment_info(spark: SparkSession, *paths: str) -> DataFrame:
    """The info records of increments, one row each."""
    schema = "database string, full_backup_file_id string, start_no int, start_pos long, end_no int, end_pos long"
    return spark.read.schema(schema).json([f"{p}/meta" for p in paths])


def read_chain(spark: SparkSession, paths: Sequence[str], schema: StructType) -> DataFrame:
    """The events of a chain's increments in one scan; position order is a sort away.

    An increment without a log folder, or without events in it, counts as empty. Files are
    partitioned by `log_no` below each increment, so bounds on it prune.
    """
    there = [f"{p}/log/log_no={n}" for p in paths if folder_exists(spark, f"{p}/log") for n in partition_values(spark, f"{p}/log", "log_no")]
    if not there:
        return spark.createDataFrame([], schema)
    # no base path is common to all increments, so the partition's number comes from the file's
    stored = T.StructType([f for f in schema.fields if f.name != "log_no"])
    number = F.regexp_extract(F.col("_metadata.file_path"), r"/log_no=([0-9]+)/", 1).cast(schema["log_no"].dataType)
    return spark.read.schema(stored).option("recursiveFileLookup", "true").parquet(*there).select("*", number.alias("log_no")).select(schema.fieldNames())


def concat_increments(parts: Sequence[DataFrame], ordered: bool = True) -> DataFrame:
    """Increments as one log in position order, whatever order they come in.

    A replay keeps the last event of each key and needs no order: it can do without the sort.
    """
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return both.orderBy("log_no", "log_pos", "sub") if ordered else both
