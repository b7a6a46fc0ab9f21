"""Questions about the manifest: sessions, jobs and instances."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SESSION_SEARCH_FIELDS = ("database", "dirName", "backupDir")
JOB_SEARCH_FIELDS = ("name", "tables", "backup_type", "db_instance_id")
INSTANCE_SEARCH_FIELDS = ("name", "host", "database")



def fulls(sessions: DataFrame, include_failed: bool = False) -> DataFrame:
    return _usable(sessions.filter(F.col("backup_type") == "full"), include_failed)


def increments(sessions: DataFrame, include_failed: bool = False) -> DataFrame:
    return _usable(sessions.filter(F.col("backup_type") == "increment"), include_failed)


def _usable(sessions: DataFrame, include_failed: bool) -> DataFrame:
    """Only finished runs may serve as a baseline or move the end of a chain."""
    return sessions if include_failed else sessions.filter(F.col("status") == "success")


# ---- filters

def scope(rows: DataFrame, account_id: str | None) -> DataFrame:
    """Rows of the caller; without an account there are none."""
    account_id = (account_id or "").strip()
    return rows.filter(F.col("account_id") == account_id) if account_id else rows.limit(0)


def search(rows: DataFrame, keyword: str | None, fields: Sequence[str]) -> DataFrame:
    """Case-blind substring in any of the fields; an empty keyword keeps all."""
    keyword = (keyword or "").strip().lower()
    if not keyword:
        return rows
    hit = F.lit(False)
    for field in fields:
        hit |= F.coalesce(F.contains(F.lower(field), F.lit(keyword)), F.lit(False))
    return rows.filter(hit)


def list_filtered(
    rows: DataFrame,
    contains: Mapping[str, str] | None = None,
    time_column: str = "createTime",
    start: datetime | str | None = None,
    end: datetime | str | None = None,
    status: int | str | None = None,
) -> DataFrame:
    """Given filters only, all of them; times inclusive; a status counts only if 0 or 1."""
    for column, text in (contains or {}).items():
        if text:
            rows = rows.filter(F.contains(F.lower(column), F.lit(text.lower())))
    if start:
        rows = rows.filter(F.col(time_column) >= F.lit(start))
    if end:
        rows = rows.filter(F.col(time_column) <= F.lit(end))
    if str(status) in ("0", "1"):
        rows = rows.filter(F.col("status") == int(status))
    return rows


# ---- joins

NO_INSTANCE = "—"


def job_instance_names(jobs: DataFrame, instances: DataFrame) -> DataFrame:
    names = instances.select(F.col("id").alias("db_instance_id"), F.col("name").alias("instance_name"))
    return jobs.join(names, "db_instance_id", "left").withColumn("instance_name", F.coalesce("instance_name", F.lit(NO_INSTANCE)))


def fulls_with_increments(sessions: DataFrame) -> DataFrame:
    """Full records that any increment names, whatever became of either."""
    parents = increments(sessions, include_failed=True).select(F.col("full_backup_file_id").alias("backup_file_id")).distinct()
    return fulls(sessions, include_failed=True).join(parents, "backup_file_id", "left_semi")


def increments_of_fulls(sessions: DataFrame, chosen: DataFrame) -> DataFrame:
    """Increments of the chosen fulls (`full_backup_file_id`), newest first."""
    children = increments(sessions, include_failed=True)
    ids = chosen.select("full_backup_file_id").distinct()
    return children.join(ids, "full_backup_file_id").orderBy(F.desc("backup_time"), F.desc("seq"))


def free_full_jobs(jobs: DataFrame, editing: str | None = None, current_link: str | None = None) -> DataFrame:
    """Full jobs no other incremental job links to.

    While job `editing` is edited its own link does not block, and the full job it
    points to stays selectable even if another job took it.
    """
    links = jobs.filter((F.col("backup_type") == "incremental") & (F.trim("linked_full_backup_job_id") != ""))
    if editing:
        links = links.filter(F.col("id") != editing)
    taken = links.select(F.trim("linked_full_backup_job_id").alias("id")).distinct()
    if current_link:
        taken = taken.filter(F.col("id") != current_link.strip())
    return jobs.filter(F.col("backup_type") == "full").join(taken, "id", "left_anti")


def check_job_links(jobs: DataFrame, instances: DataFrame) -> DataFrame:
    """`link_error` per job: the first rule it breaks, or null.

    missing_link, instance_missing, link_invalid (no such full job in the account),
    link_taken (another incremental job of the account has the same link).
    """
    link, account = "linked_full_backup_job_id", "account_id"
    known = instances.select(F.col("id").alias("db_instance_id"), account, F.lit(True).alias("_instance"))
    checked = jobs.join(known, ["db_instance_id", account], "left")
    instance_missing = F.when(F.col("_instance").isNull(), "instance_missing")
    is_linked = F.col("backup_type") == "incremental"
    # only incremental jobs have a link; the others would all meet under an empty one
    linked, others = checked.filter(is_linked), checked.filter(~is_linked)
    full_ids = jobs.filter(F.col("backup_type") == "full").select(F.col("id").alias(link), account, F.lit(True).alias("_full"))
    uses = jobs.filter(is_linked).groupBy(account, link).agg(F.count(F.lit(1)).alias("_uses"))
    error = F.when(F.trim(link) == "", "missing_link").otherwise(
        F.coalesce(instance_missing, F.when(F.col("_full").isNull(), "link_invalid"), F.when(F.col("_uses") > 1, "link_taken"))
    )
    linked = linked.join(full_ids, [link, account], "left").join(uses, [link, account], "left")
    return linked.select(*jobs.columns, error.alias("link_error")).unionByName(
        others.select(*jobs.columns, instance_missing.alias("link_error"))
    )


def jobs_without_instance(jobs: DataFrame, instances: DataFrame) -> DataFrame:
    known = instances.select(F.col("id").alias("db_instance_id"), "account_id")
    return jobs.join(known, ["db_instance_id", "account_id"], "left_anti")


def instances_in_use(instances: DataFrame, jobs: DataFrame) -> DataFrame:
    used = jobs.select(F.col("db_instance_id").alias("id"), "account_id").distinct()
    return instances.join(used, ["id", "account_id"], "left_semi")


def orphan_increments(sessions: DataFrame, existing_fulls: DataFrame) -> DataFrame:
    """Increments whose full is not among `existing_fulls`."""
    ids = existing_fulls.select(F.col("backup_file_id").alias("full_backup_file_id"))
    return increments(sessions, include_failed=True).join(ids, "full_backup_file_id", "left_anti")


def delete_cascade(sessions: DataFrame, doomed_fulls: DataFrame) -> DataFrame:
    """What goes with the given fulls (`backup_file_id`): themselves and their increments.

    One semi join on the id of the chain a record belongs to, so sessions are read once.
    """
    chain = F.when(F.col("backup_type") == "full", F.col("backup_file_id")).otherwise(F.col("full_backup_file_id"))
    doomed = doomed_fulls.select(F.col("backup_file_id").alias("_chain"))
    return sessions.withColumn("_chain", chain).join(doomed, "_chain", "left_semi").drop("_chain")


def _newest_per(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest record per key. Pre-aggregated: one row per key leaves each task."""
    kept = [c for c in rows.columns if c not in keys]
    newest = F.max_by(F.struct(*kept), F.struct("backup_time", "seq")).alias("_newest")
    return rows.groupBy(*keys).agg(newest).select(*keys, "_newest.*").select(rows.columns)


def job_baselines(jobs: DataFrame, sessions: DataFrame, include_failed: bool = False) -> DataFrame:
    """Per incremental job the newest full its linked job made, null if there is none."""
    newest = _newest_per(
        fulls(sessions, include_failed).select("account_id", "job_id", "backup_file_id", "backup_time", "seq"), ["account_id", "job_id"]
    )
    baseline = newest.select(
        "account_id",
        F.col("job_id").alias("linked_full_backup_job_id"),
        F.col("backup_file_id").alias("full_backup_file_id"),
        F.col("backup_time").alias("full_backup_time"),
    )
    chosen = jobs.filter(F.col("backup_type") == "incremental")
    return chosen.join(baseline, ["account_id", "linked_full_backup_job_id"], "left")


# ---- aggregates

def object_counts(objects: DataFrame, keys: Sequence[str]) -> DataFrame:
    return objects.groupBy(*keys).agg(
        F.count_if(F.col("kind") == "table").alias("table_count"),
        F.count_if(F.col("kind") == "view").alias("view_count"),
        F.count(F.lit(1)).alias("total"),
    )


def duplicate_links(jobs: DataFrame) -> DataFrame:
    """Full jobs that several incremental jobs of an account link to."""
    links = jobs.filter((F.col("backup_type") == "incremental") & (F.col("linked_full_backup_job_id") != ""))
    return (
        links.groupBy("account_id", "linked_full_backup_job_id")
        .agg(F.count(F.lit(1)).alias("n_jobs")).filter(F.col("n_jobs") > 1)
    )


# ---- newest, first, upsert

def latest_increments(sessions: DataFrame, include_failed: bool = False) -> DataFrame:
    return _newest_per(increments(sessions, include_failed), ["account_id", "full_backup_file_id"])


def keep_newest(rows: DataFrame, keys: Sequence[str], n: int = 20) -> DataFrame:
    """The n newest per key. Spark applies the limit before the exchange as well, so at
    most n rows per key leave each task."""
    w = Window.partitionBy(*keys).orderBy(F.desc("backup_time"), F.desc("seq"))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def unique_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row per key in input order; null is a key like any other."""
    kept = [c for c in rows.columns if c != key]
    first = rows.groupBy(key).agg(F.min_by(F.struct(*kept), F.col(order)).alias("_first"))
    return first.select(key, "_first.*").select(rows.columns)


def upsert(current: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Incoming records replace those of equal key. Among the incoming the highest
    `order` wins; replaced or new, they list before all others (`batch` descending)."""
    kept = [c for c in incoming.columns if c != key]
    last = incoming.groupBy(key).agg(F.max_by(F.struct(*kept), F.col(order)).alias("_last"))
    fresh = last.select(key, "_last.*").withColumn("batch", F.lit(1))
    stale = current.join(incoming.select(key).distinct(), key, "left_anti").withColumn("batch", F.lit(0))
    return stale.unionByName(fresh)


# ---- retention

def retention(
    sessions: DataFrame,
    policy: DataFrame,
    as_of: datetime,
    fulls_only: bool = False,
) -> DataFrame:
    """Records past their database's age limit, for a separate delete call.

    `policy` has `database` and `clean_days`; null or 0 keeps everything. The newest
    finished full of a database, the run that triggers the clean-up, is never listed.
    Age counts strictly more than N days; the database name must match exactly.
    """
    current = _newest_per(fulls(sessions).select("database", "backup_file_id", "backup_time", "seq"), ["database"])
    limits = policy.filter(F.col("clean_days") > 0).select("database", "clean_days")
    # a database without a finished full has triggered no clean-up, hence the inner join
    rules = limits.join(current.select("database", F.col("backup_file_id").alias("_current")), "database")
    candidates = fulls(sessions, include_failed=True) if fulls_only else sessions
    age_limit = F.lit(as_of) - F.make_dt_interval(F.col("clean_days"))
    return (
        candidates.join(rules, "database")
        .filter((F.col("backup_time") < age_limit) & (F.col("backup_file_id") != F.col("_current")))
        .select(*sessions.columns, "clean_days")
    )


def smart_mode(runs: DataFrame, sessions: DataFrame, full_weekday: int = 2) -> DataFrame:
    """Per run of a job: a full on the given weekday (1 = Sunday) or while no finished
    full from before that run exists, an increment otherwise."""
    first = (
        fulls(sessions).groupBy(F.col("job_id").alias("id"), "account_id")
        .agg(F.min("backup_time").alias("_first_full"))
    )
    has_full = F.coalesce(F.col("_first_full") < F.col("run_at"), F.lit(False))
    mode = F.when((F.dayofweek("run_at") == full_weekday) | ~has_full, "full").otherwise("increment")
    return runs.join(first, ["id", "account_id"], "left").withColumn("mode", mode).drop("_first_full")


def newest_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("backup_time"), F.desc("seq"))
