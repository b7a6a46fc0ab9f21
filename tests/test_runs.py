"""Whole runs: fulls with their position, increments that tile the log, restores from stored folders, deletes."""

import datetime as dt
import decimal
import pathlib

import pytest
from pyspark.sql import functions as F

from tidemark.operators import chain, runs
from tidemark.session import clear_scratch, folder_exists, scratch_dir
from tidemark.sources import changelog, filecatalog, snapshots

DAY = dt.datetime(2024, 1, 1)
LOG = "log_no int, log_pos long, sub int, event_ts timestamp_ntz, db string, tbl string, op string, a int, b string, val string"


@pytest.fixture
def world(spark, tmp_path):
    """Two tables with a key of two columns, a stored log of four files, and a full with two increments.

    Another database has tables of the same names, and its events are all over the log.
    """
    base = {n: spark.createDataFrame([(i, n, f"{n}{i}") for i in range(6)], "a int, b string, val string") for n in ("x", "y")}
    events = [(n, 4 + 10 * k, 0, DAY + dt.timedelta(hours=n, minutes=k), "d", "xy"[k % 2], "UID"[k % 3], k, "xy"[k % 2], f"v{n}.{k}") for n in range(1, 5) for k in range(8)]
    events += [(n, at + 5, sub, ts, "other", tbl, "U", a, b, "foreign") for n, at, sub, ts, _, tbl, _, a, b, _ in events if at < 74]
    log = spark.createDataFrame(events, LOG)
    path, root = str(tmp_path / "log"), str(tmp_path / "runs")
    log.write.partitionBy("log_no").parquet(path)
    sessions = runs.take_full(base, f"{root}/f", "f", (1, 24), DAY, database="d", seq=0)
    for i, upto in enumerate(((2, 4), (3, 34)), 1):
        sessions = sessions.unionByName(runs.take_increment(sessions, "f", path, f"{root}/i{i}", f"i{i}", DAY + dt.timedelta(hours=i), upto=upto, seq=i))
    return base, log, path, root, sessions


def expected(base, log, where):
    out = {}
    for name, df in base.items():
        rows = {(r["a"], r["b"]): r["val"] for r in df.collect()}
        for e in log.filter(where).filter((F.col("tbl") == name) & (F.col("db") == "d")).orderBy("log_no", "log_pos").collect():
            rows.pop((e["a"], e["b"]), None)
            if e["op"] != "D":
                rows[e["a"], e["b"]] = e["val"]
        out[name] = sorted((*k, v) for k, v in rows.items())
    return out


def got(tables):
    return {n: sorted(map(tuple, df.select("a", "b", "val").collect())) for n, df in tables.items()}


FROM_FULL = "(log_no > 1 OR log_pos >= 24)"


def test_increments_tile_the_log(spark, world):
    _, _, path, root, sessions = world
    last = runs.take_increment(sessions, "f", path, f"{root}/i3", "i3", DAY + dt.timedelta(hours=3), seq=3)
    rows = sessions.unionByName(last).orderBy("seq").collect()
    assert [((r["start_no"], r["start_pos"]), (r["end_no"], r["end_pos"])) for r in rows[1:]] == [((1, 24), (2, 4)), ((2, 4), (3, 34)), ((3, 34), (4, 75))]
    assert chain.chain_gaps(sessions.unionByName(last)).isEmpty()
    assert snapshots.read_position(spark, f"{root}/f") == (1, 24)
    with pytest.raises(ValueError, match="nothing"):
        runs.take_increment(sessions.unionByName(last), "f", path, f"{root}/i4", "i4", DAY + dt.timedelta(hours=4), seq=4)
    with pytest.raises(ValueError, match="no such full"):
        runs.take_increment(sessions, "g", path, f"{root}/i5", "i5", DAY)
    assert runs.snapshots.read_position(spark, f"{root}/i1") is None


def test_a_database_comes_back_from_what_was_stored(spark, world):
    base, log, _, _, sessions = world
    key, schema = ["a", "b"], log.schema
    whole = expected(base, log, f"{FROM_FULL} AND (log_no < 3 OR (log_no = 3 AND log_pos < 34))")
    assert got(runs.restore_tables(sessions, "f", key, ["val"], schema)) == whole
    first = expected(base, log, f"{FROM_FULL} AND log_no < 2")
    assert got(runs.restore_tables(sessions, "f", key, ["val"], schema, upto="i1", include=["y"])) == {"y": first["y"]}
    moment = DAY + dt.timedelta(hours=2, minutes=3)
    assert got(runs.restore_tables(sessions, "f", key, ["val"], schema, moment=moment)) == expected(base, log, f"{FROM_FULL} AND event_ts <= TIMESTAMP_NTZ'{moment}'")
    with pytest.raises(ValueError, match="no increment"):
        runs.restore_tables(sessions, "f", key, ["val"], schema, upto="i9")
    with pytest.raises(ValueError, match="not one finished full"):
        runs.restore_tables(sessions, "g", key, ["val"], schema)
    location = scratch_dir(spark, "db")
    names = runs.restore_database(sessions, "f", "tidemark_restored", key, ["val"], schema, location=location)
    assert sorted(names) == ["x", "y"] and got({n: spark.table(f"tidemark_restored.{n}") for n in names}) == whole
    spark.sql("DROP DATABASE tidemark_restored CASCADE")


def test_a_broken_chain_restores_its_prefix(spark, world):
    base, log, _, _, sessions = world
    gap = sessions.withColumn("start_pos", F.when(F.col("backup_file_id") == "i2", F.col("start_pos") + 1).otherwise(F.col("start_pos")))
    assert got(runs.restore_tables(gap, "f", ["a", "b"], ["val"], log.schema)) == expected(base, log, f"{FROM_FULL} AND log_no < 2")


def test_a_moment_takes_the_latest_full_before_it(spark, world):
    base, log, path, root, sessions = world
    moment = DAY + dt.timedelta(hours=4, minutes=2)
    told = expected(base, log, f"{FROM_FULL} AND event_ts <= TIMESTAMP_NTZ'{moment}'")
    assert got(runs.restore_at(sessions, "d", moment, path, ["a", "b"], ["val"])) == told
    later = runs.restore_tables(sessions, "f", ["a", "b"], ["val"], log.schema)
    sessions = sessions.unionByName(runs.take_full(later, f"{root}/f2", "f2", (3, 34), DAY + dt.timedelta(hours=3, minutes=2, seconds=30), database="d", seq=9))
    assert got(runs.restore_at(sessions, "d", moment, path, ["a", "b"], ["val"])) == told
    with pytest.raises(ValueError, match="no full"):
        runs.restore_at(sessions, "d", DAY - dt.timedelta(days=1), path, ["a", "b"], ["val"])


def test_runs_keep_to_the_fulls_database_tables_and_account(spark, world):
    base, log, path, root, sessions = world
    assert {r["db"] for r in changelog.read_chain(spark, [f"{root}/i1", f"{root}/i2"], log.schema).collect()} == {"d"}
    # a second account has a full of the same id and database, whose increments leave a table out
    other = runs.take_full(base, f"{root}/g", "f", (1, 24), DAY, database="d", account_id="b", seq=20, exclude=["y"])
    both = sessions.unionByName(other)
    more = runs.take_increment(both, "f", path, f"{root}/g1", "g1", DAY + dt.timedelta(hours=1), upto=(3, 34), account_id="b", seq=21)
    assert {r["tbl"] for r in changelog.read_increment(spark, f"{root}/g1").collect()} == {"x"}
    both = both.unionByName(more)
    whole = expected(base, log, f"{FROM_FULL} AND (log_no < 3 OR (log_no = 3 AND log_pos < 34))")
    with pytest.raises(ValueError, match="not one finished full"):
        runs.restore_tables(both, "f", ["a", "b"], ["val"], log.schema)
    assert got(runs.restore_tables(both, "f", ["a", "b"], ["val"], log.schema, account_id="b")) == {"x": whole["x"]}
    assert got(runs.restore_tables(both, "f", ["a", "b"], ["val"], log.schema, account_id="")) == whole
    moment = DAY + dt.timedelta(hours=4, minutes=2)
    with pytest.raises(ValueError, match="several accounts"):
        runs.restore_at(both, "d", moment, path, ["a", "b"], ["val"])
    told = expected(base, log, f"{FROM_FULL} AND event_ts <= TIMESTAMP_NTZ'{moment}'")
    assert got(runs.restore_at(both, "d", moment, path, ["a", "b"], ["val"], account_id="b")) == {"x": told["x"]}


def test_a_catalogued_store_opens_only_files_that_can_hold_the_rows(spark, world, monkeypatch):
    base, log, path, root, sessions = world
    store = f"{root}/store"
    full = sessions.filter("backup_type = 'full'")
    rows = full
    for i, upto in enumerate(((2, 4), (3, 34), (4, 75)), 1):
        rows = rows.unionByName(runs.take_increment(rows, "f", path, store, f"c{i}", DAY + dt.timedelta(hours=i), upto=upto, seq=i, catalog_key="a"))
    # the driver looks at no increment's folder by itself
    for name in ("folder_exists", "partition_values"):
        monkeypatch.setattr(changelog, name, None)
    whole = expected(base, log, f"{FROM_FULL} AND log_pos < 75")
    restored = runs.restore_from_catalog(rows, "f", store, ["a", "b"], ["val"], log.schema)
    assert got(restored) == whole
    ids = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "run string")
    every = filecatalog.files_of(spark, store, ids)
    assert {r["file"].split("/")[0] for r in every.collect()} == {"run=c1", "run=c2", "run=c3"}
    assert every.agg(F.sum("rows")).first()[0] == filecatalog.read_files(spark, store, every, log.schema).count()
    some = filecatalog.files_of(spark, store, ids, tables=["x"], keys=(0, 2), start=(2, 4), end=(4, 4))
    wanted = {r["file"] for r in some.collect()}
    assert 0 < len(wanted) < every.count()
    told = filecatalog.read_files(spark, store, every, log.schema).filter("tbl = 'x' AND a BETWEEN 0 AND 2 AND log_no BETWEEN 2 AND 3").collect()
    for r in every.collect():  # what is not wanted can't even be read
        if r["file"] not in wanted:
            (pathlib.Path(store) / "log" / r["file"]).write_bytes(b"junk")
            (pathlib.Path(store) / "log" / r["file"]).with_name("." + r["file"].split("/")[-1] + ".crc").unlink()
    found = filecatalog.read_files(spark, store, some, log.schema).filter("tbl = 'x' AND a BETWEEN 0 AND 2").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, told)) and told
    assert filecatalog.read_files(spark, store, some.limit(0), log.schema).collect() == []


TYPED = "log_no int, log_pos long, sub int, event_ts timestamp_ntz, db string, tbl string, op string, before string, after string"


def test_tables_of_different_columns(spark, tmp_path):
    root, path = str(tmp_path / "runs"), str(tmp_path / "log")
    tables = {
        "p": spark.createDataFrame([(1, 1.5, dt.datetime(2024, 1, 1)), (2, None, None), (3, 3.0, None)], "id long, price double, at timestamp_ntz"),
        "q": spark.createDataFrame([("a", dt.date(2024, 1, 1), ["x"], decimal.Decimal("1.10")), ("b", dt.date(2024, 1, 2), [], None)], "code string, day date, tags array<string>, sum decimal(20,2)"),
    }
    rows = [
        ("d", "p", "U", '{"id": 1}', '{"id": 1, "price": 2, "at": "2024-05-06T07:08:09.123456", "later": 5}'),
        ("e", "p", "D", '{"id": 3}', None),  # another database
        ("d", "p", "U", '{"price": 3.0, "id": 3}', '{"id":3,"price":null}'),
        ("d", "q", "U", '{"code": "a", "day": "2024-01-01"}', '{"code": "c", "day": "2024-01-01", "tags": ["y", null], "sum": 12345678901234567.89}'),  # the key moves
        ("d", "q", "D", '{"day": "2024-01-02", "code": "b"}', None),
        ("d", "q", "I", None, '{"day": "2024-01-02", "code": "b", "tags": null, "sum": 0.5}'),
        ("d", "p", "U", '{"id": 2}', '{"id": 4, "price": 4.0}'), ("d", "p", "U", '{"id": 4}', '{"id": 5, "price": 5.0}'),  # moved on in one event
        ("d", "z", "I", None, '{"id": 1}'),  # no such table in the full
    ]
    events = [(1 + k // 4, 4 + 10 * k, 0, DAY, db, tbl, op, before, after) for k, (db, tbl, op, before, after) in enumerate(rows)]
    events[7] = (*events[6][:2], 1, *events[7][3:])
    log = spark.createDataFrame(events, TYPED)
    log.write.partitionBy("log_no").parquet(path)
    sessions = runs.take_full(tables, f"{root}/f", "f", (1, 4), DAY, database="d", seq=0, keys={"p": ["id"], "q": ["code", "day"]})
    sessions = sessions.unionByName(runs.take_increment(sessions, "f", path, f"{root}/i", "i", DAY + dt.timedelta(hours=1), seq=1))
    found = runs.restore_typed(sessions, "f", log.schema)
    assert {n: df.columns for n, df in found.items()} == {n: df.columns for n, df in tables.items()}
    assert sorted(map(tuple, found["p"].collect()), key=repr) == [(1, 2.0, dt.datetime(2024, 5, 6, 7, 8, 9, 123456)), (3, None, None), (5, 5.0, None)]
    assert sorted(map(tuple, found["q"].collect()), key=repr) == [
        ("b", dt.date(2024, 1, 2), None, decimal.Decimal("0.50")), ("c", dt.date(2024, 1, 1), ["y", None], decimal.Decimal("12345678901234567.89")),
    ]
    assert set(runs.restore_typed(sessions, "f", log.schema, include=["p"])) == {"p"}
    names = runs.restore_database_typed(sessions, "f", "tidemark_typed", log.schema, location=scratch_dir(spark, "db"))
    assert sorted(names) == ["p", "q"] and spark.table("tidemark_typed.p").count() == 3
    spark.sql("DROP DATABASE tidemark_typed CASCADE")
    keyless = runs.take_full(tables, f"{root}/g", "g", (1, 4), DAY, database="d", seq=5)
    with pytest.raises(ValueError, match="keeps no key"):
        runs.restore_typed(keyless, "g", log.schema)


def test_deletes_only_what_is_listed_and_below_the_root(spark, world):
    _, _, _, root, sessions = world
    listed = sessions.filter("backup_file_id = 'i2'")
    assert runs.delete_runs(listed, root) == [f"{root}/i2"] and runs.delete_runs(listed, root) == []
    assert folder_exists(spark, f"{root}/i1") and folder_exists(spark, f"{root}/f")
    for bad in (root, f"{root}/../other", "/elsewhere/i1", None):
        with pytest.raises(ValueError, match="not below"):
            runs.delete_runs(listed.withColumn("backupDir", F.lit(bad).cast("string")), root)


def test_scratch_can_be_cleared(spark):
    path = scratch_dir(spark, "short")
    spark.range(3).write.parquet(path)
    other = path.replace(spark.sparkContext.applicationId, "another-application")
    spark.range(3).write.parquet(other)
    clear_scratch(spark)
    assert not folder_exists(spark, path) and folder_exists(spark, other)
