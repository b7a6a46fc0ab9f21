"""Chains: one full backup and the increments that follow it."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.catalog import fulls, increments, latest_increments
from tidemark.operators.ordered import ordered_scan
from tidemark.sources.changelog import Position

_KEYS = ["account_id", "full_backup_file_id"]


def next_starts(sessions: DataFrame, include_failed: bool = False) -> DataFrame:
    """Where the next increment of each full begins.

    The end of the latest increment, else the full's own position. `error` names what
    is missing, and the position is then null: an increment without an end must not be
    skipped over, as that would leave a hole in the chain.
    """
    base = fulls(sessions, include_failed).select(
        "account_id", F.col("backup_file_id").alias("full_backup_file_id"), F.struct("end_no", "end_pos").alias("_full")
    )
    latest = latest_increments(sessions, include_failed).select(
        *_KEYS, F.col("backup_file_id").alias("after_increment"), F.struct("end_no", "end_pos").alias("_inc")
    )
    at = F.coalesce("_inc", "_full")
    bad = at["end_no"].isNull() | (at["end_no"] <= 0) | at["end_pos"].isNull() | (at["end_pos"] <= 0)
    error = F.when(bad, F.when(F.col("_inc").isNotNull(), "increment_without_end").otherwise("full_without_position"))
    joined = base.join(latest, _KEYS, "left").withColumn("error", error)
    ok = F.col("error").isNull()
    return joined.select(
        *_KEYS, "after_increment",
        F.when(ok, at["end_no"]).alias("next_no"), F.when(ok, at["end_pos"]).alias("next_pos"), "error",
    )


def chain_prefix(sessions: DataFrame, choices: DataFrame, include_failed: bool = False) -> DataFrame:
    """Increments up to and including the chosen one, per full.

    `choices` has one row per restored full: `account_id`, `full_backup_file_id` and the
    chosen increment `backup_file_id`, or null for the whole chain. A join with one bound per
    full, not a window, so a very long chain is spread over many tasks.
    """
    rows = increments(sessions, include_failed)
    marks = choices.select(*_KEYS, F.col("backup_file_id").alias("_chosen"))
    chosen = rows.select(F.col("backup_file_id").alias("_chosen"), *_KEYS, F.struct("backup_time", "seq").alias("_upto"))
    bounds = marks.join(chosen, ["_chosen", *_KEYS], "left")
    known = F.col("_chosen").isNull() | F.col("_upto").isNotNull()
    bounds = bounds.filter(known).select(*_KEYS, "_upto")
    upto = F.col("_upto").isNull() | (F.struct("backup_time", "seq") <= F.col("_upto"))
    return rows.join(bounds, _KEYS).filter(upto).drop("_upto").select(rows.columns)


def unknown_choices(sessions: DataFrame, choices: DataFrame, include_failed: bool = False) -> DataFrame:
    """Choices that name no increment of their full; a restore must not start with any."""
    rows = increments(sessions, include_failed).select(*_KEYS, "backup_file_id")
    return choices.filter(F.col("backup_file_id").isNotNull()).join(rows, [*_KEYS, "backup_file_id"], "left_anti")


def position() -> Column:
    """(start_no, start_pos) as one exact number; 31 and 63 bits hold any values of theirs."""
    return (F.col("start_no").cast("decimal(10,0)") * F.lit(Decimal(2**63)) + F.col("start_pos").cast("decimal(19,0)")).cast("decimal(38,0)")


def chain_links(sessions: DataFrame, include_failed: bool = True, **scan_options) -> DataFrame:
    """Every member of every chain in log order, with its predecessor's end and whether
    it starts exactly there (`linked`). The full opens its chain. Where records have a
    `backupDir`, an increment without one cannot be replayed and so links to nothing."""
    is_full = F.col("backup_type") == "full"
    rows = sessions if include_failed else sessions.filter(F.col("status") == "success")
    rows = rows.withColumn("chain_id", F.when(is_full, F.col("backup_file_id")).otherwise(F.col("full_backup_file_id")))
    # the full's own start is not a link: it comes first and is linked by definition
    rows = rows.withColumn("_at", F.when(is_full, F.lit(-1).cast("decimal(38,0)")).otherwise(position()))
    scanned = ordered_scan(
        rows, ["account_id", "chain_id"], "_at", "seq", lags={"prev_no": "end_no", "prev_pos": "end_pos"}, **scan_options
    )
    meets = (F.col("prev_no") == F.col("start_no")) & (F.col("prev_pos") == F.col("start_pos"))
    if "backupDir" in scanned.columns:
        meets &= F.trim("backupDir") != ""
    return scanned.withColumn("linked", is_full | F.coalesce(meets, F.lit(False)))


def chain_gaps(sessions: DataFrame, include_failed: bool = True, **scan_options) -> DataFrame:
    """The increments that do not start where their predecessor ended."""
    return chain_links(sessions, include_failed, **scan_options).filter(~F.col("linked")).drop("_at", "linked")


def unbroken_prefix(sessions: DataFrame, include_failed: bool = False, **scan_options) -> DataFrame:
    """Members of each chain before its first break: what may be restored."""
    links = chain_links(sessions, include_failed, **scan_options)
    # the same groups in the same order, so this scan needs no further exchange or sort
    broken = F.when(~F.col("linked"), F.lit(True))
    marked = ordered_scan(links, ["account_id", "chain_id"], "_at", "seq", carries={"_broken": broken}, **scan_options)
    return marked.filter(F.col("_broken").isNull()).drop("_at", "_broken", "linked", "prev_no", "prev_pos")


def chain_span(members: DataFrame) -> tuple[Position, Position] | None:
    """The log range the increments of one chain cover together; one row is collected."""
    span = increments(members, include_failed=True).agg(
        F.min(F.struct("start_no", "start_pos")).alias("s"), F.max(F.struct("end_no", "end_pos")).alias("e")
    ).first()
    if span is None or span["s"] is None:
        return None
    return tuple(span["s"]), tuple(span["e"])


def baselines_at(sessions: DataFrame, targets: DataFrame, include_failed: bool = False, **scan_options) -> DataFrame:
    """For each target (`database`, `target_time`, any other columns) the latest full at
    or before it.

    Fulls and the distinct target times are put in one order per database and the last
    full seen is carried along: no non-equi join, and a hot database is scanned in
    slices. Targets then look their time up, so many of one time cost no more than few.
    """
    at = ["database", "target_time"]
    times = targets.select(*at).distinct()
    full = F.struct("backup_file_id", "backup_time")
    rows = fulls(sessions, include_failed).select(
        "database", F.col("backup_time").alias("target_time"), F.col("seq").alias("_seq"), full.alias("_full")
    )
    # a target sorts after the fulls of the same moment
    wanted = times.select(*at, F.lit((1 << 62) - 1).cast("long").alias("_seq"), F.lit(True).alias("_target"))
    both = rows.unionByName(wanted, allowMissingColumns=True)
    seen = ordered_scan(both, ["database"], "target_time", "_seq", carries={"_last": F.col("_full")}, **scan_options)
    found = seen.filter("_target").select(
        *at, F.col("_last.backup_file_id").alias("full_backup_file_id"), F.col("_last.backup_time").alias("full_backup_time")
    )
    return targets.join(found, at, "left")
