import pytest
from pyspark.sql import functions as F

from tidemark.plans.fixtures import Tables
from tidemark.sources import changelog as log

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def changes(spark):
    return Tables(spark, SF).changes


@pytest.fixture(scope="module")
def stored(spark, changes, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log") / "log")
    changes.write.partitionBy("log_no").parquet(path)
    return path


def positions(df):
    return sorted((r["log_no"], r["log_pos"]) for r in df.select("log_no", "log_pos").collect())


def test_start_is_inclusive_and_end_exclusive(changes):
    got = positions(log.scan_range(changes, (2, 104), (2, 404)))
    assert got == [(2, 104), (2, 204), (2, 304)]


def test_an_empty_range_gives_nothing(changes):
    assert log.scan_range(changes, (2, 104), (2, 104)).isEmpty()


def test_ranges_tile(changes):
    a, b, c = (1, 5004), (3, 704), (6, 4)
    whole = positions(log.scan_range(changes, a, c))
    parts = positions(log.scan_range(changes, a, b)) + positions(log.scan_range(changes, b, c))
    assert sorted(parts) == whole and len(set(parts)) == len(parts)


@pytest.mark.parametrize("start,end", [((2, 504), (2, 904)), ((2, 504), (3, 904)), ((1, 4), (9, 204))])
def test_stored_scan_equals_filter(spark, changes, stored, start, end):
    assert positions(log.read_range(spark, stored, start, end)) == positions(log.scan_range(changes, start, end))


def test_stored_scan_prunes_files_and_pushes_positions(spark, stored):
    plan = log.read_range(spark, stored, (2, 504), (5, 904))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 3
    assert "GreaterThanOrEqual(log_pos,504)" in plan and "LessThan(log_pos,904)" in plan
    one_filter = spark.read.parquet(stored).filter(log.in_range((2, 504), (5, 904)))
    assert "PartitionFilters: [isnotnull(log_no" in one_filter._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("start,end", [((3, 4), (2, 4)), ((0, 4), (2, 4)), ((1, 0), (2, 4))])
def test_bad_ranges_are_refused(changes, start, end):
    with pytest.raises(ValueError):
        log.scan_range(changes, start, end)


def test_the_end_is_a_valid_next_start(spark, changes):
    end = tuple(log.log_end(changes).first())
    assert end == (10, 4 + 999 * 100 + 1)
    assert log.scan_range(changes, (1, 4), end).count() == changes.count()
    assert log.scan_range(changes, end, (11, 4)).isEmpty()


def test_log_files_sort_by_number_not_by_name(spark):
    files = log.log_files(spark.createDataFrame([("b.9",), ("b.10",), ("b.2",), ("b.9",)], "log_file string"))
    assert [r["log_file"] for r in files.collect()] == ["b.2", "b.9", "b.10"]
    assert [r["log_file"] for r in log.range_files(files, "b.9", "b.10").orderBy("log_no").collect()] == ["b.9", "b.10"]
    with pytest.raises(ValueError, match="does not exist"):
        log.range_files(files, "b.1", "b.10")
    with pytest.raises(ValueError, match="comes after"):
        log.range_files(files, "b.10", "b.9")


def test_tables_without_a_position_are_left_out(spark, changes):
    places = spark.createDataFrame([("t1", 3, 504)], "tbl string, start_no int, start_pos long")
    got = log.scan_per_table(changes, places, end=(5, 4))
    expected = changes.filter("tbl = 't1' AND (log_no = 4 OR (log_no = 3 AND log_pos >= 504))")
    assert positions(got) == positions(expected)


def test_increment_keeps_one_database_and_its_record(spark, changes, tmp_path):
    path = str(tmp_path / "inc")
    info = log.write_increment(changes, (1, 4), (3, 4), path, full_id="f1", db="mall").first()
    assert (info["database"], info["full_backup_file_id"], info["start_no"], info["end_no"]) == ("mall", "f1", 1, 3)
    rows = log.read_increment(spark, path)
    assert rows.filter("db <> 'mall'").isEmpty() and positions(rows) == positions(log.scan_range(changes, (1, 4), (3, 4), db="mall"))
    assert spark.read.json(f"{path}/meta").first()["end_no"] == 3


def test_concatenation_is_in_position_order(spark, changes):
    parts = [log.scan_range(changes, (2, 4), (3, 4)), log.scan_range(changes, (1, 4), (2, 4)).drop("val")]
    rows = [(r["log_no"], r["log_pos"]) for r in log.concat_increments(parts).collect()]
    assert rows == sorted(rows) and len(rows) == 2000


def test_a_chain_reads_as_one_log(spark, changes, tmp_path):
    paths = [str(tmp_path / f"inc{i}") for i in range(4)]
    ends = [(1, 4), (2, 504), (2, 504), (4, 4)]
    for path, start, end in zip(paths, ends, ends[1:]):
        log.write_increment(changes, start, end, path)
    # the second covers nothing and the last was never written
    rows = log.read_chain(spark, paths, changes.schema)
    assert positions(rows) == positions(log.scan_range(changes, ends[0], ends[-1]))
    assert sorted(rows.columns) == sorted(changes.columns)
    assert log.read_chain(spark, paths[3:], changes.schema).isEmpty()
    info = log.read_increment_info(spark, *paths[:3]).collect()
    assert sorted((r["start_no"], r["end_no"]) for r in info) == [(1, 2), (2, 2), (2, 4)]


def test_a_stored_log_is_pruned(spark, tmp_path):
    rows = [(n, 4 + 100 * k, 0, f"t{k % 2}") for n in (1, 2, 9_000_000) for k in range(5)]
    path = str(tmp_path / "log")
    events = spark.createDataFrame(rows, "log_no int, log_pos long, sub int, tbl string")
    events.write.partitionBy("log_no").parquet(path)
    assert log.stored_log_numbers(spark, path) == [1, 2, 9_000_000]
    assert tuple(log.stored_log_end(spark, path).first()) == tuple(log.log_end(events).first()) == (9_000_000, 405)
    positions = spark.createDataFrame([("t0", 2, 104)], "tbl string, start_no int, start_pos long")
    scan = log.scan_per_table(spark.read.parquet(path), positions)
    assert "PartitionFilters: [isnotnull(log_no" in scan._jdf.queryExecution().executedPlan().toString() or "(log_no" in scan._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:120]
    assert {(r["log_no"], r["log_pos"]) for r in scan.collect()} == {(n, p) for n, p, _, t in rows if t == "t0" and (n, p) >= (2, 104)}


def test_a_chain_is_one_scan(spark, tmp_path):
    events = spark.createDataFrame([(n, 4 + k, 0, "d", "t") for n in range(1, 6) for k in range(4)], "log_no int, log_pos long, sub int, db string, tbl string")
    paths = []
    for a, b in (((1, 4), (2, 6)), ((2, 6), (2, 6)), ((2, 6), (6, 4))):
        paths.append(str(tmp_path / f"inc{len(paths)}"))
        log.write_increment(events, a, b, paths[-1])
    chain = log.read_chain(spark, [*paths, str(tmp_path / "none")], events.schema)
    assert sorted(map(tuple, chain.collect())) == sorted(map(tuple, events.collect()))
    assert chain._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    assert log.read_chain(spark, [str(tmp_path / "none")], events.schema).isEmpty()
