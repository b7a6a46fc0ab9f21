"""Continuous increments: each trigger exports what the log gained since the last one."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.session import read_text, write_text

_MANIFEST = "batch long, start_no int, start_pos long, end_no int, end_pos long, events long, late boolean"


def read_log_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None, schema: StructType | None = None) -> DataFrame:
    """A stored log, partitioned by log_no, as a stream of its files."""
    schema = schema or spark.read.parquet(path).schema
    options = {"maxFilesPerTrigger": files_per_trigger} if files_per_trigger else {}
    return spark.readStream.schema(schema).options(**options).parquet(path)


def start_increments(changes: DataFrame, root: str, checkpoint: str, db: str | None = None) -> StreamingQuery:
    """Write one increment per micro-batch below `root` until the log is used up.

    The checkpoint is the resume position: a later run goes on where this one stopped.
    """
    if db is not None:
        changes = changes.filter(F.col("db") == db)
    return (
        changes.writeStream.foreachBatch(lambda batch, batch_id: write_batch(batch, batch_id, root))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def write_batch(batch: DataFrame, batch_id: int, root: str) -> None:
    """One increment and its manifest row. A repeated batch overwrites its own output, so
    replays after a failure leave no duplicates. Every event is kept, also one that comes
    after its successors; the manifest then marks the increment as late."""
    spark = batch.sparkSession
    at, seen = F.struct("log_no", "log_pos"), Observation()
    events = batch.observe(seen, F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n"))
    events.hint("rebalance", "log_no").write.mode("overwrite").partitionBy("log_no").parquet(f"{root}/log/batch={batch_id}")
    got = seen.get
    first, last = (tuple(got[c]) if got["n"] else None for c in ("first", "last"))
    # the row before holds the end of all earlier batches
    previous = json.loads(read_text(spark, _manifest_file(root, batch_id - 1))) if batch_id else None
    start = (previous["end_no"], previous["end_pos"]) if previous and previous["end_no"] is not None else first
    end = start if last is None else max(start, (last[0], last[1] + 1))
    row = {
        "batch": batch_id, "start_no": start and start[0], "start_pos": start and start[1], "end_no": end and end[0], "end_pos": end and end[1],
        "events": got["n"], "late": bool(previous and first and start and first < start),
    }
    write_text(spark, _manifest_file(root, batch_id), json.dumps(row) + "\n")


def _manifest_file(root: str, batch_id: int) -> str:
    return f"{root}/manifest/{batch_id:012d}.json"


def read_increments(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/log")


def read_increment_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Per batch: the half-open range it covers, its events, `late`."""
    return spark.read.schema(_MANIFEST).json(f"{root}/manifest")


def by_window(changes: DataFrame, length: str) -> DataFrame:
    """One increment per schedule slot: its events and the half-open range they cover."""
    at = F.struct("log_no", "log_pos")
    slots = changes.groupBy(F.window("event_ts", length).alias("w")).agg(F.count(F.lit(1)).alias("events"), F.min(at).alias("a"), F.max(at).alias("b"))
    return slots.select(
        F.col("w.start").alias("slot"), "events", F.col("a.log_no").alias("start_no"), F.col("a.log_pos").alias("start_pos"),
        F.col("b.log_no").alias("end_no"), (F.col("b.log_pos") + 1).alias("end_pos"),
    )
