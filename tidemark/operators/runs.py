"""Whole runs: a full with its log position, the next increment, and restores from what was stored.

A run's record is a session row; these rows are what the chain operators read. A record names the
folder it wrote (`backupDir`), so a restore finds snapshots and increments by the records alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import chain, restore, typed
from tidemark.operators.catalog import fulls, increments
from tidemark.operators.select import keep_names, keep_names_on_restore
from tidemark.session import delete_folder
from tidemark.sources import changelog, filecatalog, snapshots

Position = tuple[int, int]

# fields of a record that these operators read
RECORD = (
    "backup_file_id string, backup_type string, full_backup_file_id string, account_id string, database string, seq long, backup_time timestamp_ntz, "
    "start_no int, start_pos long, end_no int, end_pos long, status string, backupDir string"
)


def record(spark: SparkSession, **values) -> DataFrame:
    """One session row; what is not given is null, and a run counts as finished."""
    row = {"status": "success", "full_backup_file_id": "", "account_id": ""} | values
    fields = [f.rsplit(" ", 1) for f in RECORD.split(", ")]
    return spark.range(1).select(*(F.lit(row.get(name)).cast(kind).alias(name) for name, kind in fields))


def take_full(tables: Mapping[str, DataFrame], path: str, run_id: str, position: Position, moment: datetime, **options) -> DataFrame:
    """Write a snapshot that keeps its log position, and return its record.

    Tables that were read at positions of their own come with `positions`; `position` is then the
    first of these. A restore rolls every table forward from its own one to a common cut.
    """
    spark = next(iter(tables.values())).sparkSession
    if options.get("positions") and min(options["positions"].values()) < position:
        raise ValueError(f"a table was read before {position}, where increments will begin")
    named = {k: options.pop(k) for k in ("account_id", "database", "seq") if k in options}
    snapshots.write_snapshot(spark, tables, path, position=position, **options)
    ends = {"end_no": position[0], "end_pos": position[1]}
    return record(spark, backup_file_id=run_id, backup_type="full", backup_time=moment, backupDir=path, **ends, **named)


def take_increment(
    sessions: DataFrame, full_id: str, log_path: str, path: str, run_id: str, moment: datetime, *, upto: Position | None = None, catalog_key: str | None = None, **named,
) -> DataFrame:
    """Write what the stored log gained since the full's latest increment, and return the record.

    To the folder `path`, or, with `catalog_key`, as a run of the store at `path`, whose catalog tells what each file
    holds (see `filecatalog`; the key is the column that zones are kept of).

    It begins where the chain ends, so increments tile the log, and goes to `upto` or to the log's
    end. Database and table lists are those of the full: events of others are left out. An error if
    the chain gives no valid start, or if nothing is left to write.
    """
    spark = sessions.sparkSession
    full = _the_full(sessions, full_id, named.get("account_id"), f"no place to begin after {full_id}: no such full")
    own = sessions.filter(F.col("account_id").eqNullSafe(F.lit(full["account_id"])))
    at = chain.next_starts(own).filter(F.col("full_backup_file_id") == full_id).limit(2).collect()
    if len(at) != 1 or at[0]["error"]:
        raise ValueError(f"no place to begin after {full_id}: {at[0]['error'] if at else 'no such full'}")
    start = (at[0]["next_no"], at[0]["next_pos"])
    end = upto or tuple(changelog.stored_log_end(spark, log_path).first() or ())
    if not end or end <= start:
        raise ValueError(f"the log has nothing from {start} on")
    include, exclude = snapshots.selection(spark, full["backupDir"])
    log = spark.read.parquet(log_path)
    chosen = {"db": _database(full, log), "include": include, "exclude": exclude}
    if catalog_key:
        path = filecatalog.write_run(log, start, end, path, run_id, catalog_key, **chosen)
    else:
        changelog.write_increment(log, start, end, path, full_id=full_id, **chosen)
    ends = {"start_no": start[0], "start_pos": start[1], "end_no": end[0], "end_pos": end[1]}
    named = {"account_id": full["account_id"], "database": full["database"]} | named
    return record(spark, backup_file_id=run_id, backup_type="increment", full_backup_file_id=full_id, backup_time=moment, backupDir=path, **ends, **named)


def _the_full(sessions: DataFrame, full_id: str, account_id: str | None, problem: str) -> Row:
    """The one finished full of that id, of one account where several use the id."""
    found = fulls(sessions).filter(F.col("backup_file_id") == full_id)
    if account_id is not None:
        found = found.filter(F.col("account_id") == account_id)
    rows = found.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(problem)
    return rows[0]


def _database(full: Row, log: DataFrame) -> str | None:
    """The database that a full's events are of; a log without that column is of one database."""
    return (full["database"] or None) if "db" in log.columns else None


def _own_events(spark: SparkSession, events: DataFrame, full: Row, include: Sequence[str], exclude: Sequence[str], moment: datetime | None) -> DataFrame:
    """Events of the full's database and tables, of the chosen ones among these, up to a moment."""
    database = _database(full, events)
    if database is not None:
        events = events.filter(F.col("db") == database)
    events = keep_names(events, "tbl", *snapshots.selection(spark, full["backupDir"]))
    events = keep_names_on_restore(events, "tbl", include, exclude)
    starts = snapshots.read_positions(spark, full["backupDir"])
    if not starts.isEmpty():
        # what a table already held when it was read is not replayed; a row for each table
        no, pos = F.col("start_no"), F.col("start_pos")
        after = no.isNull() | (F.col("log_no") > no) | ((F.col("log_no") == no) & (F.col("log_pos") >= pos))
        events = events.join(starts, "tbl", "left").filter(after).select(events.columns)
    return events if moment is None else events.filter(F.col("event_ts") <= F.lit(moment).cast("timestamp_ntz"))


def _chain(sessions: DataFrame, full_id: str, upto: str | None, account_id: str | None) -> tuple[Row, DataFrame]:
    """A full's record, and those of its increments before the chain's first break, as far as `upto`."""
    full = _the_full(sessions, full_id, account_id, f"not one finished full named {full_id}")
    own = sessions.filter((F.col("backup_file_id") == full_id) | (F.col("full_backup_file_id") == full_id))
    own = own.filter(F.col("account_id").eqNullSafe(F.lit(full["account_id"])))
    members = increments(chain.unbroken_prefix(own))
    if upto is not None:
        choice = sessions.sparkSession.createDataFrame([(full["account_id"], full_id, upto)], "account_id string, full_backup_file_id string, backup_file_id string")
        if not chain.unknown_choices(members, choice).isEmpty():
            raise ValueError(f"{upto} is no increment of {full_id} that can be reached")
        members = chain.chain_prefix(members, choice)
    return full, members


def chain_events(
    sessions: DataFrame, full_id: str, schema, *, upto: str | None = None, moment: datetime | None = None, account_id: str | None = None,
    include: Sequence[str] = (), exclude: Sequence[str] = (),
) -> tuple[Row, DataFrame]:
    """A full's record, and the events of its increments in one scan.

    The increments are those before the chain's first break, as far as `upto`, the id of the last one wanted; of their
    events those of the full's database and tables, up to `moment`.
    """
    spark = sessions.sparkSession
    full, members = _chain(sessions, full_id, upto, account_id)
    # a record for each increment: as many as a chain has runs
    paths = [r["backupDir"] for r in members.orderBy("seq").collect()]
    return full, _own_events(spark, changelog.read_chain(spark, paths, schema), full, include, exclude, moment)


def restore_from_catalog(
    sessions: DataFrame, full_id: str, store: str, key: str, payload: Sequence[str], schema, *, key_range: tuple | None = None, upto: str | None = None,
    moment: datetime | None = None, account_id: str | None = None, include: Sequence[str] = (), exclude: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """`restore_tables` from increments that are runs of a catalogued store, of all keys or of a range of them.

    Files that hold none of the chosen tables, or no key of the range, are not opened.
    """
    spark = sessions.sparkSession
    full, members = _chain(sessions, full_id, upto, account_id)
    tables = list(snapshots.read_tables(spark, full["backupDir"], include, exclude))
    files = filecatalog.files_of(spark, store, members.select(F.col("backup_file_id").alias("run")), tables=tables, keys=key_range)
    events = _own_events(spark, filecatalog.read_files(spark, store, files, schema), full, include, exclude, moment)
    if key_range is None:
        return _laid_over(spark, full, events, key, payload, include, exclude)
    within = F.col(key).between(*key_range)
    return {name: df.filter(within) for name, df in _laid_over(spark, full, events.filter(within), key, payload, include, exclude).items()}


def log_events(
    sessions: DataFrame, database: str, moment: datetime, log_path: str, *, account_id: str | None = None, include: Sequence[str] = (), exclude: Sequence[str] = (),
) -> tuple[Row, DataFrame]:
    """The latest full of a database from `moment` or before, and the events of the stored log from there to `moment`.

    Earlier log files are pruned, later events left out by time. Where several accounts have fulls of a database of that
    name, one must be named.
    """
    spark = sessions.sparkSession
    if account_id is not None:
        sessions = sessions.filter(F.col("account_id") == account_id)
    elif len(fulls(sessions).filter(F.col("database") == database).select("account_id").distinct().limit(2).collect()) > 1:
        raise ValueError(f"{database} is a database of several accounts: name one")
    target = spark.createDataFrame([(database, moment)], "database string, target_time timestamp_ntz")
    found = chain.baselines_at(sessions, target).first()["full_backup_file_id"]
    if found is None:
        raise ValueError(f"{database} has no full from {moment} or before")
    full = fulls(sessions).filter((F.col("backup_file_id") == found) & (F.col("database") == database)).first()
    after = (F.col("log_no") > full["end_no"]) | ((F.col("log_no") == full["end_no"]) & (F.col("log_pos") >= full["end_pos"]))
    log = spark.read.parquet(log_path).filter(F.col("log_no") >= full["end_no"]).filter(after)
    return full, _own_events(spark, log, full, include, exclude, moment)


def _laid_over(spark: SparkSession, full: Row, events: DataFrame, key: restore.Key, payload: Sequence[str], include: Sequence[str], exclude: Sequence[str]) -> dict[str, DataFrame]:
    """The full's tables with the events' image laid over them: one image, written by table and counted once."""
    keys = restore.key_columns(key)
    image, counts = restore.image_by_table(restore.latest_image(events, ["tbl", *keys], payload))
    tables = snapshots.read_tables(spark, full["backupDir"], include, exclude)
    return {
        name: restore.merge(base, image.filter(F.col("tbl") == name).drop("tbl"), keys, payload, counted=counts.get(name, 0)) for name, base in tables.items()
    }


def restore_tables(
    sessions: DataFrame, full_id: str, key: restore.Key, payload: Sequence[str], schema, *, upto: str | None = None, moment: datetime | None = None,
    account_id: str | None = None, include: Sequence[str] = (), exclude: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """The tables of a full with its increments laid over them, from the stored folders alone.

    See `chain_events` for what is replayed: nothing of another database, account or table list. All
    increments are one scan and all tables one image; each table then takes its own rows of it.
    `schema` is that of the log. All tables have the same key and payload here; `restore_typed` takes
    tables of different columns.
    """
    full, events = chain_events(sessions, full_id, schema, upto=upto, moment=moment, account_id=account_id, include=include, exclude=exclude)
    return _laid_over(sessions.sparkSession, full, events, key, payload, include, exclude)


def restore_typed(
    sessions: DataFrame, full_id: str, schema, *, upto: str | None = None, moment: datetime | None = None, account_id: str | None = None,
    include: Sequence[str] = (), exclude: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """The tables of a full, each with its own columns and key, with its increments laid over them.

    The log carries rows as JSON text in `before` and `after`; columns and keys are those that the snapshot's manifest
    keeps (`take_full(..., keys=...)`). One scan of the increments and one shuffle give the images of all tables.
    """
    full, events = chain_events(sessions, full_id, schema, upto=upto, moment=moment, account_id=account_id, include=include, exclude=exclude)
    spark = sessions.sparkSession
    return typed.lay_over(snapshots.read_layouts(spark, full["backupDir"], include, exclude), snapshots.read_tables(spark, full["backupDir"], include, exclude), events)


def restore_database(sessions: DataFrame, full_id: str, target_db: str, key: restore.Key, payload: Sequence[str], schema, *, drop_mode: str = "DROP", location: str | None = None, **choice) -> list[str]:
    """`restore_tables`, written into the tables of `target_db` under a drop mode."""
    tables = restore_tables(sessions, full_id, key, payload, schema, **choice)
    return snapshots.load_tables(sessions.sparkSession, tables, target_db, drop_mode=drop_mode, location=location)


def restore_database_typed(sessions: DataFrame, full_id: str, target_db: str, schema, *, drop_mode: str = "DROP", location: str | None = None, **choice) -> list[str]:
    """`restore_typed`, written into the tables of `target_db`, which may have another name than the full's database."""
    return snapshots.load_tables(sessions.sparkSession, restore_typed(sessions, full_id, schema, **choice), target_db, drop_mode=drop_mode, location=location)


def restore_at(
    sessions: DataFrame, database: str, moment: datetime, log_path: str, key: restore.Key, payload: Sequence[str], include: Sequence[str] = (), exclude: Sequence[str] = (),
    account_id: str | None = None,
) -> dict[str, DataFrame]:
    """The tables of a database as they were at `moment`: the latest full from before, and the log from there on.

    See `log_events` for what is replayed.
    """
    full, events = log_events(sessions, database, moment, log_path, account_id=account_id, include=include, exclude=exclude)
    return _laid_over(sessions.sparkSession, full, events, key, payload, include, exclude)


def delete_runs(listed: DataFrame, root: str) -> list[str]:
    """Delete the folders of the listed runs, all of them below `root`; returns those that were there.

    An explicit call on the list that retention or a cascade made; nothing else deletes.
    """
    spark, base = listed.sparkSession, root.rstrip("/") + "/"
    folders = [r["backupDir"] for r in listed.select("backupDir").distinct().collect()]
    strange = [f for f in folders if not f or not f.startswith(base) or ".." in f.split("/") or f.rstrip("/") == base.rstrip("/")]
    if strange:
        raise ValueError(f"not below {root}: {strange[0]}")
    return sorted(f for f in folders if delete_folder(spark, f))
