import pytest
from pyspark.sql import functions as F

from tidemark.operators import restore as ops
from tidemark.plans.fixtures import Tables
from tidemark.plans.restore import base_session, increments_by_file, restore_from_chain
from tidemark.session import scratch_dir
from tidemark.sources.snapshots import write_keyed

SF = "/root/testdata/sf0.01"
EVENT = "log_no int, log_pos long, sub int, op string, pk long, a int, b string"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def events(spark, *rows):
    return spark.createDataFrame(list(rows), EVENT)


def test_last_event_wins_and_deletes_go(spark):
    log = events(
        spark, (1, 10, 0, "I", 1, 1, "x"), (1, 20, 0, "U", 1, 2, "y"), (2, 5, 0, "U", 1, 3, "z"),
        (1, 30, 0, "I", 2, 9, "q"), (1, 40, 0, "D", 2, None, None), (10, 1, 0, "I", 3, 1, "ten"), (9, 99, 0, "I", 3, 0, "nine"),
    )
    image = ops.latest_image(log, "pk", ["a", "b"])
    assert rows_of(image.filter("live").select("pk", "a", "b")) == [(1, 3, "z"), (3, 1, "ten")]


def test_a_last_value_of_null_stays_null(spark):
    log = events(spark, (1, 1, 0, "I", 1, 5, "x"), (1, 2, 0, "U", 1, None, None))
    for payload in (["a"], ["a", "b"]):
        assert all(v is None for v in ops.latest_image(log, "pk", payload).select(*payload).first())


def test_key_change_is_delete_and_insert_of_one_event(spark):
    log = events(spark, (1, 10, 0, "D", 1, None, None), (1, 10, 1, "I", 7, 4, "m"))
    base = spark.createDataFrame([(1, 4, "m")], "pk long, a int, b string")
    for strategy in ("patch", "rebuild"):
        assert rows_of(ops.merge(base, ops.latest_image(log, "pk", ["a", "b"]), "pk", ["a", "b"], strategy)) == [(7, 4, "m")]


def test_rows_of_one_event_follow_their_number(spark):
    log = events(spark, (1, 10, 1, "I", 1, 2, "later"), (1, 10, 0, "D", 1, None, None))
    assert rows_of(ops.latest_image(log, "pk", ["a"]).select("pk", "a", "live")) == [(1, 2, True)]


def test_fixed_width_payload_hashes_without_sorting(spark):
    log = Tables(spark, SF).changes
    plan = ops.latest_image(log, "pk", ["val"])._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "Sort" not in plan and "Window" not in plan


def test_short_and_long_position_numbers_agree(spark, monkeypatch):
    log = events(
        spark, (1, 10, 0, "U", 1, 1, "a"), (1, 10, 7, "U", 1, 2, "b"), (1, 9, 9, "U", 1, 3, "c"),
        (3, 1, 0, "D", 2, None, None), (2, 2**32 - 1, 3, "I", 2, 5, "x"),
    )
    expected = [(1, 2, "b", True), (2, None, None, False)]
    for limit in (0, 1 << 80):
        monkeypatch.setattr(ops, "PACK_BYTES", limit)
        for payload in (["a"], ["a", "b"]):
            got = ops.latest_image(log, "pk", payload).select("pk", *payload, "live")
            assert rows_of(got) == [(r[0], *r[1:1 + len(payload)], r[3]) for r in expected]
    huge = log.withColumn("log_pos", F.col("log_pos") + F.lit(2**62))
    monkeypatch.setattr(ops, "PACK_BYTES", 0)
    assert dict(huge.select(ops.position_number(huge).alias("n")).dtypes)["n"].startswith("decimal")
    assert dict(log.select(ops.position_number(log).alias("n")).dtypes)["n"] == "bigint"


def test_partial_images(spark):
    log = events(
        spark,
        (1, 1, 0, "U", 1, 5, None), (1, 2, 0, "U", 1, None, "n"),       # both from different events
        (1, 1, 0, "U", 2, 6, None),                                      # b comes from the snapshot
        (1, 1, 0, "U", 3, 7, "old"), (1, 2, 0, "D", 3, None, None), (1, 3, 0, "I", 3, 8, None),  # reborn: b is absent
        (1, 1, 0, "D", 4, None, None),
    )
    base = spark.createDataFrame([(i, 0, f"s{i}") for i in range(1, 6)], "pk long, a int, b string")
    image = ops.latest_image(log, "pk", ["a", "b"], partial=True)
    assert rows_of(ops.merge(base, image, "pk", ["a", "b"])) == [(1, 5, "n"), (2, 6, "s2"), (3, 8, None), (5, 0, "s5")]
    with pytest.raises(ValueError):
        ops.merge(base, image, "pk", ["a", "b"], "patch")


def test_strategies_agree(spark):
    t = Tables(spark, SF)
    image = ops.latest_image(t.changes, "pk", ["val"])
    patch, rebuild = (ops.merge(t.snapshot, image, "pk", ["val"], s) for s in ("patch", "rebuild"))
    assert rows_of(patch) == rows_of(rebuild)


@pytest.fixture
def no_broadcast_by_size(spark):
    """Only what the code itself asks for is broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_changed_keys_are_counted_before_choosing(spark, monkeypatch, no_broadcast_by_size):
    t = Tables(spark, SF)
    image = ops.latest_image(t.changes, "pk", ["val"])
    expected = rows_of(ops.merge(t.snapshot, image, "pk", ["val"]))
    for keys, join in ((1_000_000, "BroadcastHashJoin"), (10, "SortMergeJoin")):
        monkeypatch.setattr(ops, "BROADCAST_KEYS", keys)
        merged = ops.merge(t.snapshot, image, "pk", ["val"])
        assert join in merged._jdf.queryExecution().executedPlan().toString()
        assert rows_of(merged) == expected


def test_patch_never_shuffles_the_base(spark):
    t = Tables(spark, SF)
    plan = ops.merge(t.snapshot, ops.latest_image(t.changes, "pk", ["val"]), "pk", ["val"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_a_keyed_snapshot_is_not_shuffled(spark, no_broadcast_by_size):
    t = Tables(spark, SF)
    base = write_keyed(t.snapshot, "keyed_base", "pk", 8, scratch_dir(spark, "keyed"))
    try:
        image = ops.latest_image(t.changes, "pk", ["val"])
        merged = ops.merge(base, image, "pk", ["val"], "rebuild")
        plan = merged._jdf.queryExecution().executedPlan().toString()
        # the events are exchanged by key, for their aggregate or for the join; the base is not
        assert "Bucketed: true" in plan
        assert not any("Exchange" in line for line in above(plan, "Bucketed: true"))
        assert rows_of(merged) == rows_of(ops.merge(t.snapshot, image, "pk", ["val"]))
    finally:
        spark.sql("DROP TABLE keyed_base")


def above(plan, text):
    """The operators between a scan and the join it feeds."""
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if text in line)
    join = max(i for i in range(at) if "Join" in lines[i])
    return lines[join + 1:at]


def test_replay_at_once_equals_replay_in_pieces(spark):
    t = Tables(spark, SF)
    whole = ops.merge(t.snapshot, ops.latest_image(t.changes, "pk", ["val"]), "pk", ["val"])
    state = t.snapshot
    for low, high in ((1, 3), (4, 4), (5, 10)):
        state = ops.merge(state, ops.latest_image(t.changes.filter(F.col("log_no").between(low, high)), "pk", ["val"]), "pk", ["val"])
    assert rows_of(state) == rows_of(whole)


def test_a_broken_chain_restores_its_prefix_only(spark):
    t = Tables(spark, SF)
    sessions = base_session(spark).unionByName(increments_by_file(t.changes).filter("log_no <> 4"))
    got = restore_from_chain(t.snapshot, t.changes, sessions, "pk", ["val"])
    image = ops.latest_image(t.changes.filter("log_no <= 3"), "pk", ["val"])
    assert rows_of(got) == rows_of(ops.merge(t.snapshot, image, "pk", ["val"]))


def test_no_increments_leaves_the_snapshot(spark):
    t = Tables(spark, SF)
    assert rows_of(restore_from_chain(t.snapshot, t.changes, base_session(spark), "pk", ["val"])) == rows_of(t.snapshot)


def test_rename_filters_by_the_source_name(spark):
    rows = spark.createDataFrame([("mall", "a"), ("mall", "b"), ("crm", "a")], "db string, tbl string")
    assert rows_of(ops.rename_database(rows, "mall", "copy", include=["a"], exclude=["a"])) == [("copy", "a")]


def test_repeated_base_keys_and_wide_keys(spark):
    """Both strategies give the image's row once, and keys may be several columns."""
    base = spark.createDataFrame([(1, "x", 1.0), (1, "x", 1.5), (1, "y", 2.0)], "k int, l string, v double")
    log = spark.createDataFrame([("U", 1, 4, 0, 1, "x", 9.0), ("D", 1, 5, 0, 1, "z", None), ("I", 2, 4, 0, 2, "x", 3.0)], "op string, log_no int, log_pos long, sub int, k int, l string, v double")
    for strategy in ("patch", "rebuild", None):
        got = ops.merge(base, ops.latest_image(log, ["k", "l"], ["v"]), ["k", "l"], ["v"], strategy)
        assert sorted(map(tuple, got.collect())) == [(1, "x", 9.0), (1, "y", 2.0), (2, "x", 3.0)]


def test_positions_of_any_size(spark):
    top = 2**63 - 1
    rows = [(9_000_000, 2**40 + 5, 1, "a"), (9_000_000, 2**40 + 5, 2**31 - 1, "b"), (2**31 - 1, 4, 0, "c"), (2**31 - 1, top, 7, "d"), (2**31 - 2, top, 2**31 - 1, "e"), (0, 0, 0, "f")]
    df = spark.createDataFrame(rows, "log_no int, log_pos long, sub int, v string")
    got = [r["v"] for r in df.orderBy(ops.position_number(df)).collect()]
    assert got == [r[3] for r in sorted(rows)]
