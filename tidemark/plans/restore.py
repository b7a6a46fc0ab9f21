"""Change log, chains and restore."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import catalog, diff, digesttree, runs, typed
from tidemark.operators import chain as chains
from tidemark.operators import restore as ops
from tidemark.operators.diff import verify_tables
from tidemark.operators.select import keep_names_on_restore
from tidemark.plans.registry import query
from tidemark.session import materialize, scratch_dir
from tidemark.sources import changelog as log
from tidemark.sources.snapshots import write_keyed

# an event order number for the oracles; their fixtures have one row per event
_LATEST = """
  latest AS (SELECT pk, val, op FROM (
    SELECT *, row_number() OVER (PARTITION BY pk ORDER BY log_no DESC, log_pos DESC, sub DESC) AS rn FROM replayed) x
    WHERE rn = 1)"""
_MERGED = """
  SELECT s.pk AS pk, s.val AS val FROM base s WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.pk = s.pk)
  UNION ALL SELECT pk, val FROM latest WHERE op <> 'D'"""


def increments_by_file(changes: DataFrame) -> DataFrame:
    """One increment per log file, as a log-file rotation would have made them."""
    files = changes.groupBy("log_no").agg(F.min("log_pos").alias("start_pos"), F.max("log_pos").alias("_last"))
    return files.select(
        F.concat(F.lit("inc"), F.col("log_no")).alias("backup_file_id"),
        F.lit("increment").alias("backup_type"), F.lit("base").alias("full_backup_file_id"),
        F.lit("acct0").alias("account_id"), F.col("log_no").cast("long").alias("seq"),
        F.col("log_no").alias("start_no"), "start_pos",
        # the next file opens at its first position, so an increment ends there
        (F.col("log_no") + 1).alias("end_no"), F.lit(log.FIRST_POS).cast("long").alias("end_pos"),
        F.lit("success").alias("status"),
    )


def base_session(spark) -> DataFrame:
    values = {
        "backup_file_id": "base", "backup_type": "full", "full_backup_file_id": "", "account_id": "acct0", "seq": 0,
        "start_no": 0, "start_pos": 0, "end_no": 1, "end_pos": log.FIRST_POS, "status": "success",
    }
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))


def restore_from_chain(base: DataFrame, changes: DataFrame, sessions: DataFrame, key: str, payload: list[str], strategy: str | None = None):
    """Full plus increments: the unbroken chain gives one log range, replayed at once."""
    span = chains.chain_span(chains.unbroken_prefix(sessions))
    if span is None:
        return base.select(key, *payload)
    image = ops.latest_image(log.scan_range(changes, *span), key, payload)
    return ops.merge(base, image, key, payload, strategy)


@query("restore_chain", uses="changes snapshot", sql=f"""
WITH replayed AS (SELECT * FROM changes), base AS (SELECT * FROM snapshot), {_LATEST} {_MERGED}""")
def restore_chain(t):
    sessions = base_session(t.spark).unionByName(increments_by_file(t.changes))
    return restore_from_chain(t.snapshot, t.changes, sessions, "pk", ["val"])


@query("latest_image", uses="changes", sql=f"""
WITH replayed AS (SELECT * FROM changes), {_LATEST} SELECT pk, val FROM latest WHERE op <> 'D'""")
def latest_image(t):
    return ops.latest_image(t.changes, "pk", ["val"]).filter("live").select("pk", "val")


@query("restore_keyed", uses="changes snapshot", sql=f"""
WITH replayed AS (SELECT * FROM changes), base AS (SELECT * FROM snapshot), {_LATEST} {_MERGED}""")
def restore_keyed(t):
    """The same restore onto a snapshot bucketed by key, which then stays in place."""
    path = scratch_dir(t.spark, "keyed")
    table = "tidemark_" + path.rsplit("-", 1)[1]
    base = write_keyed(t.snapshot, table, "pk", 8, path)
    merged = ops.merge(base, ops.latest_image(t.changes, "pk", ["val"]), "pk", ["val"], "rebuild")
    result = materialize(merged, "restored")
    t.spark.sql(f"DROP TABLE {table}")
    return result


_START, _END = (1, 304), (8, 504)
_IN_RANGE = "(log_no > 1 OR (log_no = 1 AND log_pos >= 304)) AND (log_no < 8 OR (log_no = 8 AND log_pos < 504))"


@query("log_range", uses="changes", sql=f"SELECT * FROM changes WHERE {_IN_RANGE}")
def log_range(t):
    return log.scan_range(t.changes, _START, _END)


@query("log_range_db", uses="changes", sql=f"SELECT * FROM changes WHERE {_IN_RANGE} AND db = 'mall'")
def log_range_db(t):
    return log.scan_range(t.changes, _START, _END, db="mall")


@query("log_range_tables", uses="changes", sql=f"SELECT * FROM changes WHERE {_IN_RANGE} AND tbl IN ('t1', 't2', 't3') AND tbl <> 't2'")
def log_range_tables(t):
    return log.scan_range(t.changes, _START, _END, include=["t1", "t2", "t3"], exclude=["t2"])


@query("log_range_per_table", uses="changes table_positions", sql="""
SELECT c.* FROM changes c, table_positions p
WHERE c.tbl = p.tbl AND (c.log_no > p.start_no OR (c.log_no = p.start_no AND c.log_pos >= p.start_pos))""")
def log_range_per_table(t):
    return log.scan_per_table(t.changes, t.table_positions)


@query("log_end", uses="changes", sql="""
SELECT log_no, log_pos + 1 AS log_pos FROM changes ORDER BY log_no DESC, log_pos DESC LIMIT 1""")
def log_end(t):
    return log.log_end(t.changes)


def _stored(t) -> str:
    """The change log as a server would have it: a folder for each log file."""
    path = scratch_dir(t.spark, "log")
    t.changes.repartition("log_no").write.partitionBy("log_no").parquet(path)
    return path


@query("log_end_stored", uses="changes", sql="""
SELECT log_no, log_pos + 1 AS log_pos FROM changes ORDER BY log_no DESC, log_pos DESC LIMIT 1""")
def log_end_stored(t):
    return log.stored_log_end(t.spark, _stored(t))


@query("log_range_per_table_stored", uses="changes table_positions", sql="""
SELECT c.* FROM changes c, table_positions p
WHERE c.tbl = p.tbl AND p.start_no >= 2 AND (c.log_no > p.start_no OR (c.log_no = p.start_no AND c.log_pos >= p.start_pos))""")
def log_range_per_table_stored(t):
    return log.scan_per_table(t.spark.read.parquet(_stored(t)), t.table_positions.filter("start_no >= 2")).select(t.changes.columns)


@query("log_file_order", uses="changes", sql="""
SELECT DISTINCT log_file, log_no FROM changes WHERE log_file BETWEEN 'binlog.000001' AND (SELECT max(log_file) FROM changes)""")
def log_file_order(t):
    files = log.log_files(t.changes)
    last = files.agg(F.max_by("log_file", "log_no")).first()[0]
    return log.range_files(files, "binlog.000001", last).orderBy("log_no")


@query("increment_write", uses="changes", sql=f"SELECT * FROM changes WHERE {_IN_RANGE} AND db = 'crm'")
def increment_write(t):
    path = scratch_dir(t.spark, "increment")
    log.write_increment(t.changes, _START, _END, path, full_id="base", db="crm")
    return log.read_range(t.spark, f"{path}/log", _START, _END)


@query("union_all", uses="changes", sql=f"SELECT * FROM changes WHERE {_IN_RANGE}")
def union_all(t):
    """[a, b) and [b, c), concatenated in log order, are [a, c)."""
    middle = (4, 1204)
    parts = [log.scan_range(t.changes, _START, middle), log.scan_range(t.changes, middle, _END)]
    return log.concat_increments(parts)


@query("next_start", uses="sessions", sql="""
WITH ok AS (SELECT * FROM sessions WHERE status = 'success'),
inc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_id, full_backup_file_id ORDER BY backup_time DESC, seq DESC) AS rn
                       FROM ok WHERE backup_type = 'increment') x WHERE rn = 1)
SELECT f.account_id, f.backup_file_id AS full_backup_file_id, i.backup_file_id AS after_increment,
       coalesce(i.end_no, f.end_no) AS next_no, coalesce(i.end_pos, f.end_pos) AS next_pos, CAST(NULL AS VARCHAR) AS error
FROM ok f LEFT JOIN inc i ON i.account_id = f.account_id AND i.full_backup_file_id = f.backup_file_id
WHERE f.backup_type = 'full'""")
def next_start(t):
    return chains.next_starts(t.sessions)


@query("latest_increment", uses="sessions", sql="""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY account_id, full_backup_file_id ORDER BY backup_time DESC, seq DESC) AS rn
  FROM sessions WHERE backup_type = 'increment' AND status = 'success') x WHERE rn = 1""")
def latest_increment(t):
    return catalog.latest_increments(t.sessions)


def _choices(sessions: DataFrame) -> DataFrame:
    """A restore request per full: the increment with seq % 5 = 3; the whole chain where seq % 3 = 0."""
    rows = sessions.filter("backup_type = 'increment' AND seq % 5 = 3")
    return rows.select("account_id", "full_backup_file_id", F.when(F.col("seq") % 3 != 0, F.col("backup_file_id")).alias("backup_file_id"))


@query("chain_prefix", uses="sessions", sql="""
WITH incs AS (SELECT * FROM sessions WHERE backup_type = 'increment'),
pick AS (SELECT * FROM incs WHERE seq % 5 = 3)
SELECT i.* FROM incs i JOIN pick p ON p.full_backup_file_id = i.full_backup_file_id
WHERE p.seq % 3 = 0 OR i.backup_time < p.backup_time OR (i.backup_time = p.backup_time AND i.seq <= p.seq)""")
def chain_prefix(t):
    return chains.chain_prefix(t.sessions, _choices(t.sessions), include_failed=True)


@query("chain_prefix_accounts", uses="sessions", sql="""
WITH twice AS (SELECT * FROM sessions UNION ALL SELECT * REPLACE ('other' AS account_id) FROM sessions WHERE seq % 2 = 0),
incs AS (SELECT * FROM twice WHERE backup_type = 'increment'),
pick AS (SELECT * FROM incs WHERE seq % 5 = 3 AND account_id <> 'other')
SELECT i.* FROM incs i JOIN pick p ON p.full_backup_file_id = i.full_backup_file_id AND p.account_id = i.account_id
WHERE p.seq % 3 = 0 OR i.backup_time < p.backup_time OR (i.backup_time = p.backup_time AND i.seq <= p.seq)""")
def chain_prefix_accounts(t):
    """Two accounts have fulls of one id; a choice is one account's."""
    twice = t.sessions.unionByName(t.sessions.filter("seq % 2 = 0").withColumn("account_id", F.lit("other")))
    return chains.chain_prefix(twice, _choices(t.sessions), include_failed=True)


_LINKED = """
linked AS (
  SELECT *, backup_type = 'full' OR (lag(end_no) OVER w = start_no AND lag(end_pos) OVER w = start_pos) AS ok,
         lag(end_no) OVER w AS prev_no, lag(end_pos) OVER w AS prev_pos,
         CASE WHEN backup_type = 'full' THEN backup_file_id ELSE full_backup_file_id END AS chain_id
  FROM sessions
  WINDOW w AS (PARTITION BY account_id, CASE WHEN backup_type = 'full' THEN backup_file_id ELSE full_backup_file_id END
               ORDER BY CASE WHEN backup_type = 'full' THEN 0 ELSE 1 END, start_no, start_pos, seq))"""


@query("chain_gaps", uses="sessions", sql=f"WITH {_LINKED} SELECT * EXCLUDE (ok) FROM linked WHERE NOT coalesce(ok, false)")
def chain_gaps(t):
    return chains.chain_gaps(t.sessions)


@query("unbroken_prefix", uses="sessions", sql=f"""
WITH {_LINKED}
SELECT * EXCLUDE (ok, prev_no, prev_pos) FROM linked l WHERE NOT EXISTS (
  SELECT 1 FROM linked b WHERE b.chain_id = l.chain_id AND NOT coalesce(b.ok, false) AND b.seq <= l.seq)""")
def unbroken_prefix(t):
    return chains.unbroken_prefix(t.sessions, include_failed=True)


@query("asof_full", uses="sessions targets", sql="""
WITH f AS (SELECT database, backup_time, max(seq) AS seq FROM sessions WHERE backup_type = 'full' AND status = 'success' GROUP BY ALL)
SELECT t.database, t.order_id, t.line_no, t.target_time, CAST(f.seq AS VARCHAR) AS full_backup_file_id, f.backup_time AS full_backup_time
FROM targets t ASOF LEFT JOIN f ON t.database = f.database AND t.target_time >= f.backup_time""")
def asof_full(t):
    return chains.baselines_at(t.sessions, t.targets)


_PIT = "2024-01-15 12:00:00"


@query("restore_pit", uses="changes snapshot", sql=f"""
WITH replayed AS (SELECT * FROM changes WHERE event_ts <= TIMESTAMP '{_PIT}'), base AS (SELECT * FROM snapshot), {_LATEST} {_MERGED}""")
def restore_pit(t):
    changes = t.changes.filter(F.col("event_ts") <= F.lit(datetime.fromisoformat(_PIT)).cast("timestamp_ntz"))
    return ops.merge(t.snapshot, ops.latest_image(changes, "pk", ["val"]), "pk", ["val"])


def _by_table(df: DataFrame) -> dict[str, DataFrame]:
    return {f"t{i}": df.filter(F.col("pk") % 4 == i) for i in range(4)}


def _listed(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("tbl"), "pk", "val") for name, df in sorted(tables.items())])


def _stored_runs(t) -> tuple[DataFrame, str]:
    """A full and three increments, written by the engine itself over a stored log; the last one ends in mid-file."""
    root, path = scratch_dir(t.spark, "runs"), _stored(t)
    day = datetime(2024, 1, 1)
    sessions = runs.take_full(_by_table(t.snapshot), f"{root}/full", "f", (1, log.FIRST_POS), day, seq=0, database="mall")
    for i, upto in enumerate(((3, 304), (5, log.FIRST_POS), (8, 504)), 1):
        sessions = materialize(sessions, "sessions")
        sessions = sessions.unionByName(runs.take_increment(sessions, "f", path, f"{root}/inc{i}", f"i{i}", day + timedelta(hours=i), upto=upto, seq=i))
    return materialize(sessions, "sessions"), path


_MERGED_BY_TABLE = f"SELECT concat('t', CAST(pk % 4 AS VARCHAR)) AS tbl, pk, val FROM ({_MERGED}) m"


_TO_THE_CUT = f"""
WITH replayed AS (SELECT * FROM changes WHERE db = 'mall' AND (log_no < 8 OR (log_no = 8 AND log_pos < 504))),
base AS (SELECT * FROM snapshot), {_LATEST} {_MERGED_BY_TABLE}"""


@query("restore_stored", uses="changes snapshot", sql=_TO_THE_CUT)
def restore_stored(t):
    """All tables of a database, from the stored full and its stored increments."""
    sessions, _ = _stored_runs(t)
    return _listed(runs.restore_tables(sessions, "f", "pk", ["val"], t.changes.schema))


@query("restore_consistent_cut", uses="changes snapshot", sql=_TO_THE_CUT)
def restore_consistent_cut(t):
    """Tables that were read at four positions come to one: each is rolled forward from its own."""
    root, path, day = scratch_dir(t.spark, "cut"), _stored(t), datetime(2024, 1, 1)
    tables, positions = {}, {}
    for i, (name, base) in enumerate(_by_table(t.snapshot).items()):
        positions[name] = (2 + i, 404)
        seen = t.changes.filter(f"db = 'mall' AND tbl = '{name}' AND (log_no < {2 + i} OR (log_no = {2 + i} AND log_pos < 404))")
        tables[name] = materialize(ops.merge(base, ops.latest_image(seen, "pk", ["val"]), "pk", ["val"]), "state")
    sessions = runs.take_full(tables, f"{root}/full", "f", (2, 404), day, seq=0, database="mall", positions=positions)
    for i, upto in enumerate(((3, 304), (8, 504)), 1):
        sessions = materialize(sessions, "sessions")
        sessions = sessions.unionByName(runs.take_increment(sessions, "f", path, f"{root}/inc{i}", f"i{i}", day + timedelta(hours=i), upto=upto, seq=i))
    return _listed(runs.restore_tables(materialize(sessions, "sessions"), "f", "pk", ["val"], t.changes.schema))


@query("restore_stored_upto", uses="changes snapshot", sql=f"""
WITH replayed AS (SELECT * FROM changes WHERE db = 'mall' AND log_no < 5), base AS (SELECT * FROM snapshot WHERE pk % 4 <> 2), {_LATEST}
SELECT * FROM ({_MERGED_BY_TABLE}) x WHERE tbl <> 't2'""")
def restore_stored_upto(t):
    """Up to the second increment, without one table."""
    sessions, _ = _stored_runs(t)
    return _listed(runs.restore_tables(sessions, "f", "pk", ["val"], t.changes.schema, upto="i2", exclude=["t2"]))


@query("take_increment", uses="changes", sql="""
SELECT * FROM (VALUES ('f', 0, 0, 1, 4), ('i1', 1, 4, 3, 304), ('i2', 3, 304, 5, 4), ('i3', 5, 4, 8, 504)) x(backup_file_id, start_no, start_pos, end_no, end_pos)
UNION ALL SELECT 'i4', 8, 504, * FROM (SELECT log_no, log_pos + 1 AS pos FROM changes ORDER BY log_no DESC, log_pos DESC LIMIT 1) y
WHERE log_no > 8 OR (log_no = 8 AND pos > 504)""")
def take_increment(t):
    """Each increment begins where the one before ended; the last one goes to the log's end."""
    sessions, path = _stored_runs(t)
    rows = sessions
    if tuple(log.stored_log_end(t.spark, path).first()) > (8, 504):
        rows = rows.unionByName(runs.take_increment(sessions, "f", path, scratch_dir(t.spark, "last"), "i4", datetime(2024, 1, 2), seq=4))
    return rows.select("backup_file_id", F.coalesce("start_no", F.lit(0)).alias("start_no"), F.coalesce("start_pos", F.lit(0)).alias("start_pos"), "end_no", "end_pos")


@query("restore_pit_stored", uses="changes snapshot", sql=f"""
WITH replayed AS (SELECT * FROM changes WHERE db = 'mall' AND event_ts <= TIMESTAMP '{_PIT}'), base AS (SELECT * FROM snapshot), {_LATEST} {_MERGED_BY_TABLE}""")
def restore_pit_stored(t):
    """A moment restored from the latest of three fulls before it, and the stored log from there on."""
    root, path = scratch_dir(t.spark, "runs"), _stored(t)
    moment = datetime.fromisoformat(_PIT)
    # a full where every tenth part of the events before that moment ends, and one from after it
    cuts = t.changes.filter(F.col("event_ts") <= F.lit(moment).cast("timestamp_ntz")).agg(F.max("log_no").alias("n")).first()["n"] or 1
    sessions = runs.take_full(_by_table(t.snapshot), f"{root}/f0", "f0", (1, log.FIRST_POS), datetime(2000, 1, 1), seq=0, database="mall")
    before = t.changes.filter(F.col("log_no") < cuts)
    seen = before.agg(F.max("event_ts").alias("at")).first()["at"]
    if seen is not None:
        image = ops.latest_image(before.filter("db = 'mall'"), "pk", ["val"])
        state = materialize(ops.merge(t.snapshot, image, "pk", ["val"]), "state")
        sessions = sessions.unionByName(runs.take_full(_by_table(state), f"{root}/f1", "f1", (cuts, log.FIRST_POS), seen, seq=1, database="mall"))
    sessions = sessions.unionByName(runs.take_full(_by_table(t.snapshot.limit(0)), f"{root}/f2", "f2", (cuts + 1, log.FIRST_POS), datetime(2100, 1, 1), seq=2, database="mall"))
    return _listed(runs.restore_at(materialize(sessions, "sessions"), "mall", moment, path, "pk", ["val"]))


# tables of different columns: t0 by a number, t1 by two columns, t2 by a text that some updates change; t3 is not backed up
_MOVED = "op = 'U' AND log_pos % 700 = 4"
_TYPED_KEYS = {"t0": ["id"], "t1": ["grp", "item"], "t2": ["code"]}


def _typed_log(changes: DataFrame) -> DataFrame:
    """The change log with rows as text in `before` and `after`, as wide as each table is."""
    tbl, pk, code = F.col("tbl"), F.col("pk"), F.concat(F.lit("c"), F.col("pk"))

    def row(code):
        first = F.struct(pk.alias("id"), F.floor(F.col("val") * 100).alias("balance"), F.concat(F.lit("n"), F.col("log_pos")).alias("note"))
        second = F.struct((pk % 10).cast("int").alias("grp"), pk.alias("item"), F.col("event_ts").alias("at"), F.col("op").alias("kind"))
        third = F.struct(code.alias("code"), F.col("log_no").alias("n"), F.array("op", F.concat(F.lit("x"), F.col("log_pos"))).alias("tags"))
        return F.when(tbl == "t0", typed.encode(first)).when(tbl == "t1", typed.encode(second)).when(tbl == "t2", typed.encode(third)).otherwise("{}")

    after = row(F.when(F.expr(_MOVED), F.concat(F.lit("d"), pk)).otherwise(code))
    kept = [c for c in changes.columns if c not in ("pk", "val")]
    return changes.select(*kept, F.when(F.col("op") != "I", row(code)).alias("before"), F.when(F.col("op") != "D", after).alias("after"))


@query("restore_database_typed", uses="changes snapshot", sql=f"""
WITH ev AS (SELECT * FROM changes WHERE db = 'mall' AND tbl <> 't3' AND (log_no < 8 OR (log_no = 8 AND log_pos < 504))),
steps AS (
  SELECT *, 1 AS step, op <> 'D' AS live, CASE WHEN tbl = 't2' AND {_MOVED} THEN concat('d', pk) WHEN tbl = 't2' THEN concat('c', pk) ELSE CAST(pk AS VARCHAR) END AS k FROM ev
  UNION ALL SELECT *, 0, false, concat('c', pk) FROM ev WHERE tbl = 't2' AND {_MOVED}),
latest AS (SELECT * FROM steps QUALIFY row_number() OVER (PARTITION BY tbl, k ORDER BY log_no DESC, log_pos DESC, step DESC) = 1),
base AS (
  SELECT concat('t', CAST(pk % 4 AS VARCHAR)) AS tbl, concat(CASE WHEN pk % 4 = 2 THEN 'c' ELSE '' END, pk) AS k,
    CAST(CASE pk % 4 WHEN 0 THEN CAST(floor(val * 100) AS BIGINT) WHEN 1 THEN 946684800000000 ELSE 0 END AS VARCHAR) AS a, 'base' AS b
  FROM snapshot WHERE pk % 4 <> 3)
SELECT * FROM base WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.tbl = base.tbl AND l.k = base.k)
UNION ALL SELECT tbl, k,
  CAST(CASE tbl WHEN 't0' THEN CAST(floor(val * 100) AS BIGINT) WHEN 't1' THEN epoch_us(event_ts) ELSE log_no END AS VARCHAR),
  CASE tbl WHEN 't0' THEN concat('n', log_pos) WHEN 't1' THEN op ELSE concat(op, '|x', log_pos) END
FROM latest WHERE live""")
def restore_database_typed(t):
    """Three tables of different columns and keys out of a log of two databases; the full left a fourth table out."""
    spark, root, pk = t.spark, scratch_dir(t.spark, "typed"), F.col("pk")
    cents = F.floor(F.col("val") * 100)
    tables = {
        "t0": t.snapshot.filter("pk % 4 = 0").select(pk.alias("id"), cents.alias("balance"), F.lit("base").alias("note")),
        "t1": t.snapshot.filter("pk % 4 = 1").select((pk % 10).cast("int").alias("grp"), pk.alias("item"), F.expr("timestamp_ntz'2000-01-01 00:00:00'").alias("at"), F.lit("base").alias("kind")),
        "t2": t.snapshot.filter("pk % 4 = 2").select(F.concat(F.lit("c"), pk).alias("code"), F.lit(0).alias("n"), F.array(F.lit("base")).alias("tags")),
        "t3": t.snapshot.filter("pk % 4 = 3"),
    }
    changes = _typed_log(t.changes)
    changes.write.partitionBy("log_no").parquet(f"{root}/log")
    day = datetime(2024, 1, 1)
    sessions = runs.take_full(tables, f"{root}/full", "f", (1, log.FIRST_POS), day, seq=0, database="mall", keys=_TYPED_KEYS, exclude=["t3"])
    for i, upto in enumerate(((3, 304), (8, 504)), 1):
        sessions = materialize(sessions, "sessions")
        sessions = sessions.unionByName(runs.take_increment(sessions, "f", f"{root}/log", f"{root}/inc{i}", f"i{i}", day + timedelta(hours=i), upto=upto, seq=i))
    found = runs.restore_typed(materialize(sessions, "sessions"), "f", changes.schema)
    return reduce(DataFrame.unionByName, [
        found["t0"].select(F.lit("t0").alias("tbl"), F.col("id").cast("string").alias("k"), F.col("balance").cast("string").alias("a"), F.col("note").alias("b")),
        found["t1"].select(F.lit("t1").alias("tbl"), F.col("item").cast("string").alias("k"), F.unix_micros(F.col("at").cast("timestamp")).cast("string").alias("a"), F.col("kind").alias("b")),
        found["t2"].select(F.lit("t2").alias("tbl"), F.col("code").alias("k"), F.col("n").cast("string").alias("a"), F.array_join("tags", "|").alias("b")),
    ])


@query("restore_from_catalog", uses="changes snapshot", sql=f"""
WITH replayed AS (SELECT * FROM changes WHERE db = 'mall' AND tbl IN ('t1', 't3') AND pk BETWEEN 20 AND 400 AND (log_no < 8 OR (log_no = 8 AND log_pos < 504))),
base AS (SELECT * FROM snapshot WHERE pk % 4 IN (1, 3) AND pk BETWEEN 20 AND 400), {_LATEST} {_MERGED_BY_TABLE}""")
def restore_from_catalog(t):
    """Two tables and a range of keys, from the files that can hold them: the catalog's zones leave the others unopened."""
    root, path = scratch_dir(t.spark, "catalogued"), _stored(t)
    day = datetime(2024, 1, 1)
    sessions = runs.take_full(_by_table(t.snapshot), f"{root}/full", "f", (1, log.FIRST_POS), day, seq=0, database="mall")
    for i, upto in enumerate(((3, 304), (5, log.FIRST_POS), (8, 504)), 1):
        sessions = materialize(sessions, "sessions")
        sessions = sessions.unionByName(runs.take_increment(sessions, "f", path, f"{root}/store", f"i{i}", day + timedelta(hours=i), upto=upto, seq=i, catalog_key="pk"))
    return _listed(runs.restore_from_catalog(
        materialize(sessions, "sessions"), "f", f"{root}/store", "pk", ["val"], t.changes.schema, key_range=(20, 400), include=["t1", "t3"]))


@query("restore_subset", uses="changes snapshot", sql=f"""
WITH replayed AS (SELECT * FROM changes WHERE tbl IN ('t1', 't3')),
base AS (SELECT * FROM snapshot WHERE pk % 4 IN (1, 3)), {_LATEST} {_MERGED}""")
def restore_subset(t):
    """The table list applies to the snapshot and to the replayed changes alike."""
    chosen = ["t1", "t3"]
    base = t.snapshot.withColumn("tbl", F.concat(F.lit("t"), (F.col("pk") % 4).cast("string")))
    base = keep_names_on_restore(base, "tbl", chosen)
    changes = keep_names_on_restore(t.changes, "tbl", chosen)
    return ops.merge(base, ops.latest_image(changes, "pk", ["val"]), "pk", ["val"])


@query("restore_rename", uses="changes", sql="""
SELECT * REPLACE ('mall_restore' AS db) FROM changes WHERE db = 'mall' AND tbl <> 't0'""")
def restore_rename(t):
    return ops.rename_database(t.changes, "mall", "mall_restore", exclude=["t0"])


@query("verify_restore", uses="changes snapshot", sql=f"""
WITH replayed AS (SELECT * FROM changes), base AS (SELECT * FROM snapshot), {_LATEST},
merged AS ({_MERGED})
SELECT count(*) AS restored_rows, count(*) AS expected_rows, true AS equal FROM merged""")
def verify_restore(t):
    """Replaying the log in one range, or in two, one on top of the other, is the same."""
    whole = ops.merge(t.snapshot, ops.latest_image(t.changes, "pk", ["val"]), "pk", ["val"], "rebuild")
    half = ops.merge(t.snapshot, ops.latest_image(t.changes.filter("log_no <= 5"), "pk", ["val"]), "pk", ["val"])
    rest = ops.latest_image(t.changes.filter("log_no > 5"), "pk", ["val"])
    return verify_tables(ops.merge(half, rest, "pk", ["val"]), whole)


_DIFF = """
WITH both_sides AS (
  SELECT b.o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' ELSE 'changed' END AS change,
         a.o_custkey AS a1, CAST(b.o_custkey AS VARCHAR) AS b1, a.o_orderstatus AS a2, b.o_orderstatus AS b2,
         a.o_totalprice AS a3, CAST(b.o_totalprice AS VARCHAR) AS b3, a.o_orderdate AS a4, b.o_orderdate AS b4,
         a.o_orderpriority AS a5, b.o_orderpriority AS b5
  FROM orders_v2 b LEFT JOIN orders_v1 a ON a.o_orderkey = b.o_orderkey)
SELECT o_orderkey, change, 'o_custkey' AS field, b1 AS new_value FROM both_sides WHERE CAST(a1 AS VARCHAR) IS DISTINCT FROM b1
UNION ALL SELECT o_orderkey, change, 'o_orderstatus', b2 FROM both_sides WHERE a2 IS DISTINCT FROM b2
UNION ALL SELECT o_orderkey, change, 'o_totalprice', b3 FROM both_sides WHERE CAST(a3 AS VARCHAR) IS DISTINCT FROM b3
UNION ALL SELECT o_orderkey, change, 'o_orderdate', strftime(b4, '%Y-%m-%d %H:%M:%S') FROM both_sides WHERE a4 IS DISTINCT FROM b4
UNION ALL SELECT o_orderkey, change, 'o_orderpriority', b5 FROM both_sides WHERE a5 IS DISTINCT FROM b5"""


@query("table_diff", uses="orders_v1 orders_v2", sql=_DIFF)
def table_diff(t):
    return diff.table_diff(t.orders_v1, t.orders_v2, "o_orderkey")


@query("table_diff_tree", uses="orders_v1 orders_v2", sql=_DIFF)
def table_diff_tree(t):
    """Both versions stored with their digest trees; only leaves that differ are read."""
    root = scratch_dir(t.spark, "trees")
    for name, df in (("v1", t.orders_v1), ("v2", t.orders_v2)):
        digesttree.write_with_tree(df, f"{root}/{name}", "o_orderkey", leaves=64)
    return digesttree.diff_with_tree(t.spark, f"{root}/v1", f"{root}/v2", "o_orderkey")


# rows with arrays, structs and maps; in the second table a null is added or takes a value's place
def _nested(orders: DataFrame, changed: bool) -> DataFrame:
    key, owner = F.col("o_orderkey"), F.col("o_custkey").cast("int")
    null, none = F.array(F.lit(None).cast("int")), F.expr("cast(array() as array<int>)")
    more = F.when(key % 3 == 0, null).otherwise(none)
    more = F.when(F.lit(changed) & (key % 7 == 0), F.concat(more, null)).otherwise(more)
    flag = F.when(~(F.lit(changed) & (key % 11 == 0)), owner)
    return orders.select(
        key.alias("k"), F.concat(F.array(owner), more).alias("a"), F.array(F.struct(flag.alias("x"), F.lit(1).alias("y"))).alias("s"),
        F.create_map(F.lit("m"), flag, F.lit("n"), owner).alias("m"),
    )


@query("table_diff_digest", sql="""
SELECT o_orderkey AS k, 'changed' AS change, f AS field FROM orders, unnest(['a', 's', 'm']) u(f)
WHERE (f = 'a' AND o_orderkey % 7 = 0) OR (f <> 'a' AND o_orderkey % 11 = 0)""")
def table_diff_digest(t):
    """Inner nulls and map entries count, also where rows are first compared by digest."""
    return diff.table_diff(_nested(t.orders, False), _nested(t.orders, True), "k", strategy="digest").select("k", "change", "field")


@query("verify_restore_nested", sql="""
SELECT * FROM (SELECT 'same' AS side, count(*) AS restored_rows, count(*) AS expected_rows, true AS equal FROM orders
UNION ALL SELECT 'changed', count(*), count(*), count(*) FILTER (o_orderkey % 7 = 0 OR o_orderkey % 11 = 0) = 0 FROM orders) x""")
def verify_restore_nested(t):
    same, other = (verify_tables(_nested(t.orders.repartition(3), changed), _nested(t.orders, False)) for changed in (False, True))
    return same.select(F.lit("same").alias("side"), "*").unionByName(other.select(F.lit("changed").alias("side"), "*"))


@query("table_changes", uses="orders_v1 orders_v2", sql="""
WITH counted AS (
  SELECT *, 1 AS n FROM orders_v1 UNION ALL SELECT *, -1 FROM orders_v2)
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, CAST(sum(n) AS BIGINT) AS surplus
FROM counted GROUP BY ALL HAVING sum(n) <> 0""")
def table_changes(t):
    return diff.multiset_diff(t.orders_v1, t.orders_v2)


@query("multiset_equal", sql="""
WITH lists AS (
  SELECT p_partkey, [p_size % 3, p_size % 4, p_size % 5] AS a, [p_size % 4, p_size % 5, CAST(p_partkey % 3 AS INTEGER)] AS b FROM part)
SELECT p_partkey, list_sort(a) = list_sort(b) AS equal FROM lists""")
def multiset_equal(t):
    size = F.col("p_size")
    a = F.array(size % 3, size % 4, size % 5)
    b = F.array(size % 4, size % 5, (F.col("p_partkey") % 3).cast("int"))
    return t.part.select("p_partkey", diff.arrays_equal(a, b).alias("equal"))
