import json
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators.select import EmptySelection
from tidemark.session import scratch_dir, shared_folder
from tidemark.plans import REGISTRY
from tidemark.sources import dumps, snapshots, store

METADATA = """# Started dump at: 2026-01-01
[config]
quote-character = BACKTICK

[source]
# SOURCE_LOG_FILE = "binlog.000007"
#SOURCE_LOG_POS = 157

[`mall`.`base_user`]
real_table_name = base_user_real
rows = 12
# rows = 99

[`mall`.`bad`]\r
rows = twelve\r
rows_extra = 5\r

[`mall`]
rows = 77
[`mall`.`v=1`]
is_view = 1
rows =
[`mall`.`last`]
 rows=3
rows = 4"""


@pytest.fixture
def metadata(spark, tmp_path):
    (tmp_path / "s1").mkdir()
    (tmp_path / "s1" / "metadata").write_bytes(METADATA.encode())
    return dumps.read_sections(spark, str(tmp_path), recursiveFileLookup=True)


def test_metadata_objects(metadata):
    got = sorted(tuple(r) for r in dumps.metadata_objects(metadata).drop("file").collect())
    assert got == [
        ("mall", "bad", "bad", 0, "table"), ("mall", "base_user", "base_user_real", 12, "table"),
        ("mall", "last", "last", 4, "table"), ("mall", "v=1", "v=1", 0, "view"),
    ]


def test_source_position(metadata):
    row = dumps.source_positions(metadata).first()
    assert (row["log_file"], row["log_pos"], row["error"]) == ("binlog.000007", 157, None)


@pytest.mark.parametrize("text,expected", [
    ("[SOURCE]\nsource_log_file = binlog.1\nSOURCE_LOG_POS=9\n", ("binlog.1", 9)),
    ('[source]\nSOURCE_LOG_FILE = "b"\n', (None, None)), ("[source]\nSOURCE_LOG_FILE = b\nSOURCE_LOG_POS = 0\n", (None, None)),
    ("[other]\nSOURCE_LOG_FILE = b\nSOURCE_LOG_POS = 5\n", (None, None)), ("[source]\n[x]\nSOURCE_LOG_FILE = b\nSOURCE_LOG_POS = 5\n", (None, None)),
    ("[source]\nSOURCE_LOG_FILE = a\nSOURCE_LOG_FILE = b\nSOURCE_LOG_POS = 5", ("b", 5)),
])
def test_source_position_forms(spark, tmp_path, text, expected):
    (tmp_path / "metadata").write_text(text)
    row = dumps.source_positions(dumps.read_sections(spark, str(tmp_path))).first()
    assert (row["log_file"], row["log_pos"]) == expected and (row["error"] is None) == (expected[0] is not None)


def files(spark, *names):
    return spark.createDataFrame([(1, n) for n in names], "session int, file string")


def test_objects_from_file_names(spark):
    rows = files(
        spark, "mall.base_user-schema.sql.zst", "mall.base_user.00000.sql.zst", "mall.base_user.00001.sql.zst", "mall-schema-create.sql.zst",
        "metadata", "metadata.partial.sql.zst", "mall.a.b-schema.sql.zst", "mall.only.00000.sql.zst", "mall.x.sql.zst", "mall.y.00000.sql",
    )
    got = dumps.infer_objects(rows, "session", "file")
    assert sorted(r["name"] for r in got.collect()) == ["a.b", "base_user", "only"]


def test_names_fill_in_only_where_metadata_gives_nothing(spark):
    known = spark.createDataFrame([(1, "mall", "t", "t", 5, "table")], "session int, schema string, name string, real_table_name string, rows long, kind string")
    rows = files(spark, "mall.a.00000.sql.zst").unionByName(files(spark, "mall.b.00000.sql.zst").withColumn("session", F.lit(2)))
    got = sorted((r["session"], r["name"], r["items_source"]) for r in dumps.objects_or_inferred(known, rows, "session", "file").collect())
    assert got == [(1, "t", "metadata"), (2, "b", "filenames")]


def test_discovery_takes_one_database(spark):
    rows = files(spark, "mall.u-schema.sql.zst", "mall.u.00000.sql.zst", "mall.v.00003.sql.zst", "mall_test.w.00000.sql.zst", "mall.x-schema.txt")
    assert sorted(r["name"] for r in dumps.discover_tables(rows, "file", "mall").collect()) == ["u", "v"]


def test_layout_priority(spark):
    rows = files(spark, "metadata", "data/metadata.partial", "other")
    assert dumps.pick_layout(rows, "session", "file").first()["metadata_file"] == "data/metadata.partial"
    assert dumps.pick_layout(rows, "session", "file", dumps.FINISHED_METADATA_FILES).first()["metadata_file"] == "metadata"
    assert dumps.pick_layout(files(spark, "x"), "session", "file").isEmpty()


def test_listing_and_sizes(spark, tmp_path):
    for session, size in (("a", 10), ("b", 7)):
        (tmp_path / session / "data").mkdir(parents=True)
        (tmp_path / session / "data" / "f").write_bytes(b"x" * size)
        (tmp_path / session / "meta").write_bytes(b"y")
    listed = dumps.list_files(spark, str(tmp_path)).withColumn("session", F.regexp_extract("path", rf"{tmp_path.name}/([^/]+)/", 1))
    assert {r["session"]: r["size_bytes"] for r in dumps.session_sizes(listed, "session").collect()} == {"a": 11, "b": 8}


def test_store_normalization(spark, tmp_path):
    records = [
        {"backup_file_id": " id1 ", "backup_type": " FULL ", "size": "12", "binlog_end_pos": 157, "binlog_end_file": "b.000012", "account_id": "x", "status": "failed"},
        {"backup_type": "", "size": "many", "backupTime": "2026-01-02 03:04:05"}, 5, "text", {"backup_type": "increment", "database": None},
    ]
    lines, array, no_list = tmp_path / "lines", tmp_path / "array", tmp_path / "none"
    lines.write_text("\n".join(json.dumps(r) for r in records))
    array.write_text(json.dumps([r for r in records if isinstance(r, dict)], indent=2))
    no_list.write_text("3")
    for path, multi in ((lines, False), (array, True)):
        rows = store.normalize_sessions(store.read_store(spark, str(path), multi), "owner").collect()
        got = {(r["account_id"], r["backup_type"], r["size"], r["binlog_end_pos"], r["end_no"], r["status"]) for r in rows}
        assert got == {("x", "full", 12, 157, 12, "failed"), ("owner", "full", 0, 0, None, ""), ("owner", "increment", 0, 0, None, "")}
        assert len({r["backup_file_id"] for r in rows}) == 3 and "id1" in {r["backup_file_id"] for r in rows}
    again = [store.normalize_sessions(store.read_store(spark, str(lines)), "owner").select("backup_file_id").collect() for _ in range(2)]
    assert again[0] == again[1]
    assert store.read_store(spark, str(no_list)).isEmpty()


def test_store_of_odd_elements_and_numbers(spark, tmp_path):
    text = '[{"job_id": "a", "size": 12.5, "binlog_end_pos": 1e3}, 42, null, "text", [1], {"job_id": "b", "size": true, "binlog_end_pos": "12.5", "lastExitCode": -3.9}]'
    (tmp_path / "array").write_text(text)
    (tmp_path / "lines").write_text("\n".join(json.dumps(x) for x in json.loads(text)))
    for name in ("array", "lines"):
        rows = store.normalize_sessions(store.read_store(spark, str(tmp_path / name))).collect()
        got = {r["job_id"]: (r["size"], r["binlog_end_pos"], r["lastExitCode"]) for r in rows}
        assert got == {"a": (12, 1000, None), "b": (1, 0, -3)}


def test_the_last_source_section_counts_as_a_pair(spark, tmp_path):
    for name, sections in {
        "two": [("binlog.000001", 900), ("binlog.000002", 100)], "wide": [("binlog.999999", 7), ("binlog.1000000", 5)], "half": [("binlog.000003", 8), ("binlog.000004", None)],
    }.items():
        body = "".join(f"[source]\nsource_log_file = {f}\n" + (f"source_log_pos = {p}\n" if p else "") for f, p in sections)
        (tmp_path / name).write_text(body)
    rows = dumps.source_positions(dumps.read_sections(spark, str(tmp_path))).collect()
    got = {r["file"].rsplit("/", 1)[1]: (r["log_file"], r["log_pos"]) for r in rows}
    assert got == {"two": ("binlog.000002", 100), "wide": ("binlog.1000000", 5), "half": ("binlog.000003", 8)}


# ---- snapshots

@pytest.fixture
def tables(spark):
    return {
        "users": spark.range(100).select("id", F.struct(F.col("id").alias("x"), F.array("id").alias("l")).alias("s"), F.lit("é\n'").alias("t")),
        "log": spark.range(30).withColumn("d", F.col("id").cast("decimal(20,3)")), "empty": spark.range(0).withColumn("n", F.lit(1)),
    }


def test_snapshot_and_read_back(spark, tables):
    root = scratch_dir(spark, "t")
    manifest = snapshots.write_snapshot(spark, tables, root, engines={"log": "MyISAM"})
    assert sorted((r["name"], r["phase"], r["rows"]) for r in manifest.collect()) == [("empty", 1, 0), ("log", 2, 30), ("users", 1, 100)]
    for name, df in tables.items():
        back = snapshots.read_table(spark, root, name)
        assert back.schema.simpleString() == df.schema.simpleString()
        assert sorted(back.collect(), key=repr) == sorted(df.collect(), key=repr)
    with pytest.raises(ValueError):
        snapshots.read_table(spark, root, "nobody")


@pytest.mark.parametrize("codec,mark", [("zstd", ".zstd.parquet"), ("none", ".parquet"), ("gzip", ".gz.parquet")])
def test_codec(spark, tables, codec, mark):
    root = scratch_dir(spark, "t")
    snapshots.write_snapshot(spark, tables, root, include=["log"], codec=codec)
    names = [r["path"] for r in dumps.list_files(spark, f"{root}/data/log").filter("path LIKE '%.parquet'").collect()]
    assert names and all(n.endswith(mark) for n in names) and (codec != "none" or not any("zstd" in n for n in names))


def test_shards_are_bounded_and_in_key_order(spark):
    root = scratch_dir(spark, "t")
    df = spark.range(1050).repartition(3)
    snapshots.write_snapshot(spark, {"t": df}, root, shard_rows=100, shard_keys={"t": "id"})
    shards = snapshots.read_table(spark, root, "t").groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).orderBy("lo").collect()
    assert max(r["n"] for r in shards) <= 100 and sum(r["n"] for r in shards) == 1050
    assert all(a["hi"] < b["lo"] for a, b in zip(shards, shards[1:]))


def test_selection_and_engines(spark, tables):
    root = scratch_dir(spark, "t")
    manifest = snapshots.write_snapshot(spark, tables, root, exclude=["empty"], engines={"log": "MEMORY"}, ignore_engines=["MEMORY"])
    assert [r["name"] for r in manifest.collect()] == ["users"]
    assert snapshots.selection(spark, root) == ([], ["empty"])
    with pytest.raises(EmptySelection):
        snapshots.write_snapshot(spark, tables, scratch_dir(spark, "t"), include=["nobody"])


def test_restore_modes(spark, tables):
    root, place = scratch_dir(spark, "t"), scratch_dir(spark, "db")
    snapshots.write_snapshot(spark, tables, root, include=["log", "users"])
    db = "restored_modes"
    try:
        assert snapshots.restore_full(spark, root, db, include=["log"], exclude=["log"], drop_mode="none", location=place) == ["log"]
        with pytest.raises(Exception, match="ALREADY_EXISTS"):
            snapshots.restore_full(spark, root, db, include=["log"], drop_mode="FAIL")
        spark.sql(f"DROP TABLE {db}.log")
        spark.sql(f"CREATE TABLE {db}.log (d DECIMAL(20,3) COMMENT 'kept', id BIGINT) USING parquet")
        spark.sql(f"INSERT INTO {db}.log VALUES (1, 1)")
        for mode in ("TRUNCATE", "DELETE"):
            snapshots.restore_full(spark, root, db, include=["log"], drop_mode=mode)
            assert spark.table(f"{db}.log").columns == ["d", "id"] and spark.table(f"{db}.log").count() == 30
            assert spark.table(f"{db}.log").filter("d <> id").isEmpty()
        snapshots.restore_full(spark, root, db)
        assert spark.table(f"{db}.log").columns == ["id", "d"] and spark.table(f"{db}.users").count() == 100
        with pytest.raises(ValueError):
            snapshots.restore_full(spark, root, db, drop_mode="MAYBE")
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS {db} CASCADE")


def test_scratch_paths_lie_in_the_named_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    a, b = scratch_dir(spark, "x"), scratch_dir(spark, "x")
    assert shared_folder(spark) == folder.rstrip("/") and a != b and a.startswith(folder) and b.startswith(folder)


def test_store_files_are_bounded(spark, monkeypatch):
    sizes, read = [], store.read_store

    def kept(session, path):
        sizes.extend(r["value"].count("job_id") for r in session.read.text(path, wholetext=True).collect())
        return read(session, path)

    monkeypatch.setattr(store, "read_store", kept)
    monkeypatch.setattr("tidemark.plans.objects.KEYS_PER_FILE", 40, raising=False)
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    found = REGISTRY["normalize_array"](spark, "/root/testdata/sf0.001").count()
    assert found == orders.where("o_orderkey % 50 <> 7").count() and max(sizes) <= 40 and sum(sizes) == orders.count()


def test_lists_are_cut_at_their_elements(spark, tmp_path):
    texts = {
        "a": '[1, "x,y", {"job_id": "q, \\"]["}, [1, [2, {"k": "}"}]], null , "{\\"job_id\\": 1}"]', "b": " [ ] ", "c": '\n[{"job_id": "\\\\"},\n\t{"a": ["]", "\\\\\\""], "job_id": "z"}\n]\n', "d": '["lone"]',
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    told = sorted(json.dumps(x) for text in texts.values() for x in json.loads(text))
    for size in ("7b", "64m"):
        with_splits(spark, size)
        try:
            got = [r["value"] for r in store.list_elements(spark, str(tmp_path)).collect()]
        finally:
            with_splits(spark, "128m")
        assert sorted(json.dumps(json.loads(v)) for v in got if v.strip()) == told
        assert sorted(r["job_id"] for r in store.read_store(spark, str(tmp_path)).collect() if r["job_id"]) == sorted(['q, "][', "\\", "z"])


def with_splits(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1" if size == "7b" else "4m")


def test_form_is_decided_for_each_file(spark, tmp_path):
    (tmp_path / "lines").write_text('\n  \n{"job_id": "a"}\n"{\\"job_id\\": \\"no\\"}"\n{"job_id": "b"}\n[{"job_id": "no"}]\nbroken {\nnull\n{}\n')
    (tmp_path / "list").write_text('[{"job_id": "c"},\n{"job_id": "d"}, "{\\"job_id\\": \\"no\\"}"]')
    (tmp_path / "blank").write_text(" \n")
    rows = store.read_store(spark, str(tmp_path)).collect()
    assert sorted(r["job_id"] or "" for r in rows) == ["", "a", "b", "c", "d"]


@pytest.mark.parametrize("pieces", [1, 3, 1 << 14])
def test_runs_of_a_split_are_summed_one_by_one(spark, tmp_path, monkeypatch, pieces):
    monkeypatch.setattr(store, "RUN_PIECES", pieces)
    values = [["a,b", {"k": ["]", i, [1, 2], '\\"['], "t": "x,,y" * (i % 5)}, i, None, "[", '"', list(range(i % 9))] for i in range(60)]
    for name, value in (("one", values), ("two", values[::-1]), ("flat", values[3])):
        (tmp_path / name).write_text(json.dumps(value))
    cut = store.list_elements(spark, str(tmp_path))
    told = sorted(json.dumps(x) for value in (values, values, values[3]) for x in value)
    assert sorted(json.dumps(json.loads(r["value"])) for r in cut.collect()) == told
    # a window over pieces holds a run of them, and not a whole split
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    over = set(re.findall(r"windowspecdefinition\((.*?), at#\d+L ASC", plan))
    assert over and all(re.fullmatch(r"file#\d+, block#\d+L, run#\d+L", spec) for spec in over)
