"""Streams over the change log, and their batch counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.registry import query
from tidemark.plans.restore import _LATEST, _MERGED
from tidemark.session import scratch_dir
from tidemark.streaming import completion, increments
from tidemark.streaming.image import LiveImage


def _log_stream(t):
    """The change log stored by log file, and read back as a stream."""
    path = scratch_dir(t.spark, "log")
    t.changes.hint("rebalance", "log_no").write.partitionBy("log_no").parquet(path)
    return increments.read_log_stream(t.spark, path, files_per_trigger=50, schema=t.changes.schema)


@query("stream_increments", uses="changes", sql="SELECT * FROM changes WHERE db = 'mall'")
def stream_increments(t):
    root = scratch_dir(t.spark, "increments")
    increments.start_increments(_log_stream(t), root, f"{root}/checkpoint", db="mall").awaitTermination()
    return increments.read_increments(t.spark, root).drop("batch")


@query("stream_image", uses="changes snapshot", sql=f"""
WITH replayed AS (SELECT * FROM changes), base AS (SELECT * FROM snapshot), {_LATEST} {_MERGED}""")
def stream_image(t):
    root = scratch_dir(t.spark, "image")
    image = LiveImage(t.spark, root, "pk", ["val"], compact_every=2)
    image.load_base(t.snapshot)
    image.start(_log_stream(t), f"{root}/checkpoint").awaitTermination()
    return image.read()


@query("increments_by_window", uses="changes", sql="""
SELECT time_bucket(INTERVAL 5 MINUTE, event_ts) AS slot, count(*) AS events,
  min(log_no) AS start_no, arg_min(log_pos, log_no * 1099511627776 + log_pos) AS start_pos,
  max(log_no) AS end_no, arg_max(log_pos, log_no * 1099511627776 + log_pos) + 1 AS end_pos
FROM changes GROUP BY ALL""")
def increments_by_window(t):
    return increments.by_window(t.changes, "5 minutes")


@query("stable_tables", uses="polls", sql="""
WITH runs AS (
  SELECT tbl, poll_no, size_bytes, row_number() OVER (PARTITION BY tbl ORDER BY poll_no)
    - row_number() OVER (PARTITION BY tbl, size_bytes ORDER BY poll_no) AS island FROM polls),
places AS (SELECT tbl, poll_no, row_number() OVER (PARTITION BY tbl, size_bytes, island ORDER BY poll_no) - 1 AS equal FROM runs)
SELECT tbl, min(poll_no) FILTER (WHERE equal >= 4) AS done_poll,
  CASE WHEN min(poll_no) FILTER (WHERE equal >= 4) IS NULL THEN 'finish' ELSE 'stable' END AS done_by
FROM places GROUP BY tbl""")
def stable_tables(t):
    return completion.stable_tables(t.polls, F.col("size_bytes"), completion.stable_rounds(2, 0.5), outcome="success")


@query("stream_stable_tables", uses="polls", sql="""
WITH runs AS (
  SELECT tbl, poll_no, size_bytes, row_number() OVER (PARTITION BY tbl ORDER BY poll_no)
    - row_number() OVER (PARTITION BY tbl, size_bytes ORDER BY poll_no) AS island FROM polls),
places AS (SELECT tbl, poll_no, row_number() OVER (PARTITION BY tbl, size_bytes, island ORDER BY poll_no) - 1 AS equal FROM runs)
SELECT tbl, CAST(min(poll_no) AS BIGINT) AS done_poll FROM places WHERE equal >= 4 GROUP BY tbl""")
def stream_stable_tables(t):
    source, root = scratch_dir(t.spark, "polls"), scratch_dir(t.spark, "done")
    rows = t.polls.select("tbl", "poll_no", F.col("size_bytes").cast("string").alias("fingerprint"))
    # polls arrive in two deliveries; the second run goes on from the first one's state
    for low in (0, 20):
        rows.filter(F.col("poll_no").between(low, low + 19)).write.mode("append").parquet(source)
        polls = t.spark.readStream.schema(rows.schema).parquet(source)
        completion.start_completion(polls, root, f"{root}/checkpoint", completion.stable_rounds(2, 0.5)).awaitTermination()
    return completion.completed_so_far(t.spark, root)
