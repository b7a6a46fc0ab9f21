"""Snapshots: tables written as sharded, compressed Parquet, schema and data apart.

    <root>/data/<table>/   the rows
    <root>/meta/position.json  where the log stood, if known
    <root>/meta/tables/    one row per table: rows written, codec, phase, schema, and the
                           selection the snapshot was made with
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.select import UNVERSIONED_ENGINE, keep_names_on_restore, select_names
from tidemark.session import folder_exists, materialize, read_text, write_text

# fixed values: tables written at once; drop modes of a restore
THREADS = 4
DROP_MODES = ("DROP", "TRUNCATE", "DELETE", "NONE", "FAIL")

_MANIFEST = "name string, phase int, rows long, codec string, schema_json string, tables_include string, tables_exclude string, key_columns string, start_no int, start_pos long"


def write_snapshot(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    root: str,
    *,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    engines: Mapping[str, str] | None = None,
    ignore_engines: Sequence[str] = (),
    codec: str = "zstd",
    shard_rows: int | None = None,
    shard_keys: Mapping[str, str] | None = None,
    position: tuple[int, int] | None = None,
    keys: Mapping[str, Sequence[str]] | None = None,
    positions: Mapping[str, tuple[int, int]] | None = None,
) -> DataFrame:
    """Write the selected tables and return the manifest.

    shard_rows: most rows per file; row counts bound a shard whatever the keys look like
    shard_keys: table -> column; shards then hold ranges of it, in order
    position: where the log stood, and so where a chain of increments may begin
    keys: table -> the columns that tell its rows apart, which a typed restore goes by
    positions: table -> where the log stood when that table was read, if not all at one position
    """
    engines, shard_keys = dict(engines or {}), dict(shard_keys or {})
    names = [n for n in select_names(list(tables), include, exclude) if engines.get(n) not in set(ignore_engines)]
    phase_of = {n: 2 if engines.get(n) == UNVERSIONED_ENGINE else 1 for n in names}
    codec = "uncompressed" if codec == "none" else codec

    def write(name: str) -> tuple:
        df = tables[name]
        rows = df
        if name in shard_keys:
            rows = rows.repartitionByRange(shard_keys[name]).sortWithinPartitions(shard_keys[name])
        # the count comes with the write itself, no second pass over the rows; it sits
        # above the exchange, whose sampling reads the input as well
        seen = Observation()
        writer = rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.option("compression", codec)
        if shard_rows:
            writer = writer.option("maxRecordsPerFile", shard_rows)
        writer.parquet(f"{root}/data/{name}")
        return name, phase_of[name], seen.get["rows"], codec, df.schema.json(), ",".join(include), ",".join(exclude), json.dumps(list(keys[name])) if keys and name in keys else None, *(positions or {}).get(name, (None, None))

    written: list[tuple] = []
    for phase in (1, 2):
        group = [n for n in names if phase_of[n] == phase]
        written += _at_once(spark, write, group)
    # by Arrow, which needs no Python worker for a few rows
    columns = [field.split()[0] for field in _MANIFEST.split(", ")]
    rows = pa.Table.from_pylist([dict(zip(columns, row)) for row in written])
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.parquet(f"{root}/meta/tables")
    if position:
        write_text(spark, f"{root}/meta/position.json", json.dumps({"log_no": position[0], "log_pos": position[1]}))
    return read_manifest(spark, root)


def read_position(spark: SparkSession, root: str) -> tuple[int, int] | None:
    """Where the log stood when the snapshot was made, if that was kept."""
    if not folder_exists(spark, f"{root}/meta/position.json"):
        return None
    kept = json.loads(read_text(spark, f"{root}/meta/position.json"))
    return kept["log_no"], kept["log_pos"]


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{root}/meta/tables")


def selection(spark: SparkSession, root: str) -> tuple[list[str], list[str]]:
    """The include and exclude lists of a snapshot; increments on top of it inherit them."""
    row = read_manifest(spark, root).select("tables_include", "tables_exclude").first()
    include, exclude = ([n for n in text.split(",") if n] for text in (row or ("", "")))
    return include, exclude


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    row = read_manifest(spark, root).filter(F.col("name") == name).first()
    if row is None:
        raise ValueError(f"the snapshot has no table {name}")
    return _read(spark, root, name, row["schema_json"])


def _read(spark: SparkSession, root: str, name: str, schema_json: str) -> DataFrame:
    return spark.read.schema(T.StructType.fromJson(json.loads(schema_json))).parquet(f"{root}/data/{name}")


def shard_rows(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Rows per shard file of a table."""
    rows = read_table(spark, root, name).select(F.col("_metadata.file_path").alias("file"))
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("rows"))


def write_keyed(df: DataFrame, table: str, key: str, buckets: int, path: str) -> DataFrame:
    """A snapshot as a table bucketed and sorted by a unique key, one file per bucket.

    The shuffle is paid once here: later merges of an image onto it move only the image,
    provided `buckets` is not below the session's number of shuffle partitions.
    """
    rows = df.repartition(buckets, key)
    rows.write.bucketBy(buckets, key).sortBy(key).option("path", path).option("compression", "zstd").saveAsTable(table)
    return df.sparkSession.table(table)


def write_exact_shards(df: DataFrame, path: str, key: str | Sequence[str], rows_per_shard: int) -> DataFrame:
    """Write a table in shards of exactly `rows_per_shard` rows in key order, the last one shorter; returns it with `shard`.

    Rows are sorted in ranges of (key, hash of the row), so that a key of many rows spreads over tasks too. A row's
    number in the table is its place in its range plus the rows of the ranges before: one number for each task.
    """
    spark, keys = df.sparkSession, [key] if isinstance(key, str) else list(key)
    order = [*keys, F.xxhash64(*df.columns)]
    laid = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    laid = laid.withColumn("_range", F.shiftright("_at", 33))
    ranges, before = [], 0
    for r in laid.groupBy("_range").agg(F.min("_at").alias("first"), F.count("*").alias("n")).orderBy("_range").collect():
        ranges.append((r["_range"], before - r["first"]))
        before += r["n"]
    listed = F.broadcast(spark.createDataFrame(ranges, "_range long, _shift long"))  # a row for each task of the sort
    numbered = laid.join(listed, "_range").withColumn("_row", F.col("_at") + F.col("_shift")).withColumn("shard", F.expr(f"_row div {rows_per_shard}"))
    # a shard is in one task, and so one file
    shards = numbered.repartition("shard").sortWithinPartitions("shard", "_row").select(*df.columns, "shard")
    shards.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return spark.read.schema(shards.schema).parquet(path)


def restore_full(
    spark: SparkSession,
    root: str,
    target_db: str,
    *,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    drop_mode: str = "DROP",
    location: str | None = None,
) -> list[str]:
    """Load a snapshot into the tables of `target_db`; returns the names loaded.

    DROP replaces a table, TRUNCATE and DELETE replace its rows and keep its definition,
    NONE and FAIL refuse to touch an existing table.
    """
    tables = read_tables(spark, root, include, exclude)
    return load_tables(spark, tables, target_db, drop_mode=drop_mode, location=location)


def read_tables(spark: SparkSession, root: str, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The snapshot's tables that a restore's lists choose, by name."""
    chosen = keep_names_on_restore(read_manifest(spark, root), "name", include, exclude).collect()
    return {row["name"]: _read(spark, root, row["name"], row["schema_json"]) for row in chosen}


def read_positions(spark: SparkSession, root: str) -> DataFrame:
    """(tbl, start_no, start_pos) of the tables that were read at a position of their own."""
    return read_manifest(spark, root).filter("start_no IS NOT NULL").select(F.col("name").alias("tbl"), "start_no", "start_pos")


def read_layouts(spark: SparkSession, root: str, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> dict[str, tuple[T.StructType, list[str]]]:
    """Schema and key columns of the tables that a restore's lists choose; a table without a key is an error."""
    chosen = keep_names_on_restore(read_manifest(spark, root), "name", include, exclude).collect()
    if missing := [row["name"] for row in chosen if not row["key_columns"]]:
        raise ValueError(f"the snapshot keeps no key of {missing[0]}")
    return {row["name"]: (T.StructType.fromJson(json.loads(row["schema_json"])), json.loads(row["key_columns"])) for row in chosen}


def load_tables(spark: SparkSession, tables: Mapping[str, DataFrame], target_db: str, *, drop_mode: str = "DROP", location: str | None = None) -> list[str]:
    """Write tables into `target_db` under a drop mode; returns their names."""
    mode = drop_mode.upper()
    if mode not in DROP_MODES:
        raise ValueError(f"unknown drop mode: {drop_mode}")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{target_db}`" + (f" LOCATION '{location}'" if location else ""))

    def load(name: str) -> str:
        df, target = tables[name], f"`{target_db}`.`{name}`"
        if mode == "DROP":
            spark.sql(f"DROP TABLE IF EXISTS {target}")
        if mode in ("TRUNCATE", "DELETE") and spark.catalog.tableExists(target):
            df.select(spark.table(target).columns).write.insertInto(target, overwrite=True)
        else:
            df.write.mode("errorifexists").format("parquet").saveAsTable(target)
        return name

    return _at_once(spark, load, list(tables))


def _at_once(spark: SparkSession, work: Callable, items: Sequence) -> list:
    """A few independent jobs at a time, in order of `items`. Each gets its own copy of
    the caller's job settings: jobs sharing one would overwrite each other's ids."""
    with ThreadPoolExecutor(THREADS) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(work), item) for item in items]]
