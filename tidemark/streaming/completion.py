"""When a table's files are complete: their fingerprint stood still for k polls."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.ordered import ordered_scan
from tidemark.streaming.versions import finished


def stable_rounds(stable_seconds: float = 2, poll_seconds: float = 0.5) -> int:
    return max(2, math.ceil(stable_seconds / poll_seconds))


def file_fingerprints(files: DataFrame, table: str, poll: str, name: str, size: str, modified: str) -> DataFrame:
    """One fingerprint per table and poll over (name, size, time) of its files: a sum of
    hashes, so file order does not matter and tasks combine before the exchange."""
    row = F.xxhash64(name, size, modified).cast("decimal(20,0)")
    return files.groupBy(table, poll).agg(
        F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.sum(row).cast("string")).alias("fingerprint")
    )


def stable_tables(
    polls: DataFrame, fingerprint: Column, rounds: int, outcome: str = "running",
    table: str = "tbl", poll: str = "poll_no", **scan_options,
) -> DataFrame:
    """Per table the first poll with `rounds` equal fingerprints in a row behind it.

    `done_by` is "stable", or "finish" for tables listed only because the whole run
    ended well. While the run goes on, or after it failed, only stable tables count.
    """
    rows = polls.select(table, poll, fingerprint.alias("_print"))
    rows = ordered_scan(rows, [table], poll, poll, lags={"_before": "_print"}, number="_n", **scan_options)
    # where the current standstill began; it lasts from there to this row
    begun = F.when(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(F.col("_print")), F.col("_n"))
    rows = ordered_scan(rows, [table], poll, poll, carries={"_since": begun}, **scan_options)
    done = F.min(F.when(F.col("_n") - F.col("_since") >= rounds, F.col(poll)))
    found = rows.groupBy(table).agg(done.alias("done_poll"))
    if outcome == "success":
        by = F.when(F.col("done_poll").isNotNull(), "stable").otherwise("finish")
        return found.withColumn("done_by", by)
    return found.filter(F.col("done_poll").isNotNull()).withColumn("done_by", F.lit("stable"))


_STATE = "tbl string, poll_no long, fingerprint string, equal long, done_poll long"


def start_completion(polls: DataFrame, root: str, checkpoint: str, rounds: int) -> StreamingQuery:
    """The streaming form over (tbl, poll_no, fingerprint), until the polls are used up."""
    return (
        polls.writeStream.foreachBatch(lambda batch, batch_id: follow_batch(batch, batch_id, root, rounds))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def follow_batch(batch: DataFrame, batch_id: int, root: str, rounds: int, **scan_options) -> None:
    """Carry each table's standstill on over one batch of polls.

    The state is one row per table: its last poll and fingerprint, for how many polls that
    has stood still, and when the table was first done. It joins the batch as a poll from
    before, so the batch form's scan does the rest and a table with most of the polls is
    divided as there. Written per batch, hence a repeated batch gives the same state.
    """
    spark = batch.sparkSession
    rows = batch.select("tbl", F.col("poll_no").cast("long").alias("poll_no"), "fingerprint")
    if batch_id:
        before = spark.read.schema(_STATE).parquet(f"{root}/state/batch={batch_id - 1}")
        rows = rows.unionByName(before.withColumn("known", F.lit(True)), allowMissingColumns=True)
    else:
        rows = rows.selectExpr("*", "CAST(NULL AS LONG) AS equal", "CAST(NULL AS LONG) AS done_poll", "CAST(NULL AS BOOLEAN) AS known")
    rows = ordered_scan(rows, ["tbl"], "poll_no", "poll_no", lags={"_before": "fingerprint"}, number="_n", **scan_options)
    moved = F.col("_before").isNull() | ~F.col("_before").eqNullSafe(F.col("fingerprint"))
    begun = F.when(F.col("known"), F.col("_n") - F.col("equal")).when(moved, F.col("_n"))
    rows = ordered_scan(rows, ["tbl"], "poll_no", "poll_no", carries={"_since": begun}, **scan_options)
    equal = F.col("_n") - F.col("_since")
    done = F.min(F.when(F.col("known").isNull() & (equal >= rounds), F.col("poll_no")))
    last = F.max(F.struct("poll_no", "fingerprint", equal.alias("equal")))
    state = rows.groupBy("tbl").agg(last.alias("_last"), F.coalesce(F.min("done_poll"), done).alias("done_poll"))
    state.select("tbl", "_last.*", "done_poll").write.mode("overwrite").parquet(f"{root}/state/batch={batch_id}")


def completed_so_far(spark: SparkSession, root: str) -> DataFrame:
    """Tables found complete up to the last finished batch: `tbl`, `done_poll`."""
    batches = finished(spark, f"{root}/state/batch")
    if not batches:
        return spark.createDataFrame([], _STATE).select("tbl", "done_poll")
    state = spark.read.schema(_STATE).parquet(f"{root}/state/batch={batches[-1]}")
    return state.filter(F.col("done_poll").isNotNull()).select("tbl", "done_poll")
