import pathlib

import pytest
from pyspark.sql import functions as F

from tidemark.operators import restore as ops
from tidemark.plans.fixtures import Tables
from tidemark.session import scratch_dir
from tidemark.sources import changelog as log
from tidemark.streaming import completion, increments
from tidemark.streaming.image import LiveImage

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SF)


def append(changes, path, low, high):
    changes.filter(F.col("log_no").between(low, high)).write.mode("append").partitionBy("log_no").parquet(path)


def positions(df):
    return sorted((r["log_no"], r["log_pos"]) for r in df.select("log_no", "log_pos").collect())


def test_runs_resume_where_the_last_one_stopped(spark, t):
    source, root = scratch_dir(spark, "src"), scratch_dir(spark, "out")
    ranges = []
    for low, high in ((1, 3), (4, 4), (5, 10)):
        append(t.changes, source, low, high)
        increments.start_increments(increments.read_log_stream(spark, source), root, f"{root}/cp").awaitTermination()
        ranges.append(((low, 4), (high + 1, 4)))
    rows = increments.read_increments(spark, root)
    # each increment is the batch range scan of its stretch, and together they tile the log
    for batch, (start, end) in enumerate(ranges):
        assert positions(rows.filter(F.col("batch") == batch)) == positions(log.scan_range(t.changes, start, end))
    manifest = increments.read_increment_manifest(spark, root).orderBy("batch").collect()
    assert [r["events"] for r in manifest] == [3000, 1000, 6000] and not any(r["late"] for r in manifest)
    assert all((a["end_no"], a["end_pos"]) == (b["start_no"], b["start_pos"]) for a, b in zip(manifest, manifest[1:]))
    # nothing new: no further increment
    increments.start_increments(increments.read_log_stream(spark, source), root, f"{root}/cp").awaitTermination()
    assert increments.read_increments(spark, root).count() == t.changes.count()


def test_a_repeated_batch_leaves_no_duplicates(spark, t):
    root = scratch_dir(spark, "out")
    batch = t.changes.filter("log_no = 1")
    for _ in range(2):
        increments.write_batch(batch, 0, root)
    assert increments.read_increments(spark, root).count() == 1000
    assert increments.read_increment_manifest(spark, root).count() == 1


def test_late_events_are_kept_and_marked(spark, t):
    root = scratch_dir(spark, "out")
    increments.write_batch(t.changes.filter("log_no = 2"), 0, root)
    increments.write_batch(t.changes.filter("log_no = 1"), 1, root)
    increments.write_batch(t.changes.limit(0), 2, root)
    rows = increments.read_increment_manifest(spark, root).orderBy("batch").collect()
    assert [r["late"] for r in rows] == [False, True, False] and [r["events"] for r in rows] == [1000, 1000, 0]
    assert len({(r["end_no"], r["end_pos"]) for r in rows}) == 1
    assert increments.read_increments(spark, root).count() == 2000


def image_rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_live_image_equals_batch_restore_at_any_point(spark, t):
    root = scratch_dir(spark, "image")
    image = LiveImage(spark, root, "pk", ["val"], compact_every=2)
    image.load_base(t.snapshot)
    assert image_rows(image.read()) == image_rows(t.snapshot)
    for batch in range(4):
        image.apply(t.changes.filter(F.col("log_no") == batch + 1), batch)
        upto = t.changes.filter(F.col("log_no") <= batch + 1)
        expected = ops.merge(t.snapshot, ops.latest_image(upto, "pk", ["val"]), "pk", ["val"])
        assert image_rows(image.read()) == image_rows(expected)


def test_live_image_ignores_repeats_and_order(spark, t):
    roots = [scratch_dir(spark, "image") for _ in range(2)]
    for root, order in zip(roots, ([1, 2, 3], [3, 1, 1, 2])):
        image = LiveImage(spark, root, "pk", ["val"], compact_every=100)
        for batch, log_no in enumerate(order):
            image.apply(t.changes.filter(F.col("log_no") == log_no), batch)
        if root == roots[1]:
            image.compact(1)
            image.apply(t.changes.filter("log_no = 2"), 3)
    a, b = (LiveImage(spark, r, "pk", ["val"]).read() for r in roots)
    assert image_rows(a) == image_rows(b)
    with pytest.raises(ValueError):
        LiveImage(spark, scratch_dir(spark, "none"), "pk", ["val"]).read()


def test_folds_leave_untouched_buckets_alone(spark, monkeypatch):
    root = scratch_dir(spark, "image")
    rows = spark.range(4000).select((F.col("id") % 50).cast("int").alias("a"), F.col("id").alias("b"), F.lit("base").alias("val"))
    image = LiveImage(spark, root, ["a", "b"], ["val"], compact_every=1, buckets=16)
    image.load_base(rows)

    def batch(n, ids, op="U"):
        return spark.createDataFrame([(i % 50, i, f"v{n}", op, 1, 10 * n, 0) for i in ids], "a int, b long, val string, op string, log_no int, log_pos long, sub int")

    def files():
        return {p: p.stat().st_mtime_ns for p in (pathlib.Path(root) / "base").rglob("*.parquet")}

    before, told = files(), {r["b"]: "base" for r in rows.collect()}
    image.apply(batch(0, [7]), 0)  # one key: into a tier of its bucket, no base is written
    assert files() == before and len(list((pathlib.Path(root) / "tier").rglob("*.parquet"))) == 1
    told[7] = "v0"
    one = next(b for b, n in image._state()["tier"].items())
    some = [r["b"] for r in rows.withColumn("bucket", image._bucket()).filter(F.col("bucket") == int(one)).limit(60).collect()]
    image.apply(batch(1, some), 1)  # a share of that bucket: a new base for it alone
    told |= {i: "v1" for i in some}
    state = image._state()
    assert not state["tier"] and {b for b, (upto, _) in state["base"].items() if upto == 1} == {one}
    assert {p: t for p, t in files().items() if f"bucket={one}/" not in str(p)} == {p: t for p, t in before.items() if f"bucket={one}/" not in str(p)}
    image.apply(batch(2, some[:5], "D"), 2)
    for i in some[:5]:
        del told[i]
    assert not (pathlib.Path(root) / "base" / "upto=-1" / f"bucket={one}").exists()  # replaced, and a fold ago
    assert not (pathlib.Path(root) / "delta" / "batch=1").exists()
    image.apply(batch(0, [some[0]]), 3)  # older than the delete
    again = LiveImage(spark, root, ["a", "b"], ["val"], buckets=5)
    assert {r["b"]: r["val"] for r in again.read().collect()} == told and again.buckets == 16
    monkeypatch.setattr("tidemark.streaming.image.BROADCAST_KEYS", 0)
    image.apply(batch(4, []), 4)
    assert {r["b"]: r["val"] for r in image.read().collect()} == told
    empty = LiveImage(spark, scratch_dir(spark, "image"), "b", ["val"])
    empty.load_base(rows.limit(0))
    assert empty.read().collect() == []


def events_of(spark, n, ids, op="U"):
    return spark.createDataFrame([(i, f"v{n}", op, 1, 10 * n, 0) for i in ids], "pk long, val string, op string, log_no int, log_pos long, sub int")


def stored(root, folder):
    return sorted(str(p.relative_to(root)) for p in pathlib.Path(root, folder).rglob("*.parquet"))


def test_triggers_write_few_files_whatever_the_buckets(spark):
    root = scratch_dir(spark, "image")
    image = LiveImage(spark, root, "pk", ["val"], compact_every=2, buckets=32)
    image.load_base(spark.range(6400).select(F.col("id").alias("pk"), F.lit("base").alias("val")))
    image.apply(events_of(spark, 1, range(300)), 0)
    assert len(stored(root, "delta/batch=0")) == 1
    image.apply(events_of(spark, 2, range(100, 350)), 1)
    assert len(stored(root, "delta/batch=1")) == 1 and len(stored(root, "tier/upto=1")) == 1
    image.apply(events_of(spark, 3, range(20), "D"), 2)
    told = {i: "base" for i in range(6400)} | {i: "v1" for i in range(300)} | {i: "v2" for i in range(100, 350)}
    assert dict(image_rows(image.read())) == {i: v for i, v in told.items() if i >= 20}


def test_tiers_that_are_mostly_dead_are_written_anew(spark):
    root = scratch_dir(spark, "image")
    image = LiveImage(spark, root, "pk", ["val"], compact_every=1, buckets=8)
    rows = spark.range(4000).select(F.col("id").alias("pk"), F.lit("base").alias("val"))
    image.load_base(rows)
    ids, told = {}, {i: "base" for i in range(4000)}
    for r in rows.withColumn("bucket", image._bucket()).collect():
        ids.setdefault(str(r["bucket"]), []).append(r["pk"])
    some = sorted(ids)
    image.apply(events_of(spark, 1, [ids[b][0] for b in some]), 0)
    told |= {ids[b][0]: "v1" for b in some}
    for n, b in enumerate(some[:5], 1):  # the first tier keeps 7, 6, 5, 4 and 3 of its 8 buckets
        assert stored(root, "tier/upto=0") and image._state()["wide"]["0"] == 8
        image.apply(events_of(spark, n + 1, [ids[b][1]]), n)
        told[ids[b][1]] = f"v{n + 1}"
        assert dict(image_rows(image.read())) == told
    image.apply(events_of(spark, 9, [ids[some[0]][0]], "D"), 6)  # and the last three go along
    del told[ids[some[0]][0]]
    tier = image._state()["tier"]
    assert {b for b, (upto, _) in tier.items() if upto == 6} >= {some[0], *some[5:]} and set(tier) == set(some)
    assert dict(image_rows(image.read())) == told
    image.apply(events_of(spark, 10, [ids[some[1]][2]]), 7)
    told[ids[some[1]][2]] = "v10"
    assert dict(image_rows(image.read())) == told and not stored(root, "tier/upto=0")


def test_images_with_a_folder_for_each_bucket_go_on(spark):
    root = scratch_dir(spark, "image")
    image = LiveImage(spark, root, "pk", ["val"], compact_every=2, buckets=4)
    image.load_base(spark.range(400).select(F.col("id").alias("pk"), F.lit("base").alias("val")))
    for folder, n, ids in (("tier/upto=1", 1, range(30)), ("delta/batch=2", 3, range(10, 40))):
        events_of(spark, n, ids).withColumn("bucket", image._bucket()).write.partitionBy("bucket").parquet(f"{root}/{folder}")
    held = {str(r["bucket"]): r["count"] for r in events_of(spark, 1, range(30)).withColumn("bucket", image._bucket()).groupBy("bucket").count().collect()}
    image._keep(image._state() | {"upto": 1, "tier": {b: [1, n] for b, n in held.items()}})
    told = {i: "base" for i in range(400)} | {i: "v1" for i in range(10)} | {i: "v3" for i in range(10, 40)}
    assert dict(image_rows(image.read())) == told
    image.apply(events_of(spark, 4, [5, 399]), 3)
    assert dict(image_rows(image.read())) == told | {5: "v4", 399: "v4"}


@pytest.mark.parametrize("stable,poll,rounds", [(2, 0.5, 4), (2, 3, 2), (5, 2, 3), (0, 1, 2)])
def test_stable_rounds(stable, poll, rounds):
    assert completion.stable_rounds(stable, poll) == rounds


POLLS = [("a", n, s) for n, s in enumerate([1, 1, 2, 2, 2, 2, 9])] + [("b", n, n) for n in range(6)] + [("c", n, 5) for n in range(3)]


def test_tables_are_done_after_equal_polls(spark):
    polls = spark.createDataFrame(POLLS, "tbl string, poll_no int, size int").repartition(4)

    def done(outcome, **options):
        rows = completion.stable_tables(polls, F.col("size"), 2, outcome, **options).collect()
        return {(r["tbl"], r["done_poll"], r["done_by"]) for r in rows}

    stable = {("a", 4, "stable"), ("c", 2, "stable")}
    assert done("running") == done("failed") == stable
    assert done("success") == stable | {("b", None, "finish")}
    assert done("running", small_bytes=0, min_rows=1, rows_per_slice=2) == stable


def test_standstill_is_carried_over_batches(spark):
    polls = spark.createDataFrame(POLLS, "tbl string, poll_no int, size int").withColumn("fingerprint", F.col("size").cast("string"))
    expected = {(r["tbl"], r["done_poll"]) for r in completion.stable_tables(polls, F.col("size"), 2).collect()}
    for options in ({}, dict(small_bytes=0, min_rows=1, rows_per_slice=2)):
        for cuts in ([3, 4, 7],) if options else ([7], [1, 2, 3, 4, 5, 6, 7], [3, 4, 7]):
            root, low = scratch_dir(spark, "done"), 0
            for batch_id, high in enumerate(cuts):
                part = polls.filter((F.col("poll_no") >= low) & (F.col("poll_no") < high))
                for _ in range(2 if high == 4 else 1):
                    completion.follow_batch(part, batch_id, root, 2, **options)
                low = high
            assert {(r["tbl"], r["done_poll"]) for r in completion.completed_so_far(spark, root).collect()} == expected
        if not options:
            assert completion.completed_so_far(spark, scratch_dir(spark, "none")).isEmpty()


def test_fingerprint_ignores_file_order_and_sees_every_change(spark):
    rows = [("t", 1, "f1", 5, 100), ("t", 1, "f2", 6, 100), ("t", 2, "f2", 6, 100), ("t", 2, "f1", 5, 100), ("t", 3, "f1", 5, 101), ("t", 3, "f2", 6, 100), ("t", 4, "f1", 5, 101)]
    files = spark.createDataFrame(rows, "tbl string, poll_no int, name string, size long, modified long")
    prints = {r["poll_no"]: r["fingerprint"] for r in completion.file_fingerprints(files, "tbl", "poll_no", "name", "size", "modified").collect()}
    assert prints[1] == prints[2] and len({prints[2], prints[3], prints[4]}) == 3


def test_window_slots(spark, t):
    slots = increments.by_window(t.changes, "1 day").collect()
    assert sum(r["events"] for r in slots) == t.changes.count()
    assert all((a["end_no"], a["end_pos"]) <= (b["start_no"], b["start_pos"]) for a, b in zip(*(lambda s: (s, s[1:]))(sorted(slots, key=lambda r: r["slot"]))))


def test_positions_beyond_any_packing(spark):
    root = scratch_dir(spark, "out")
    rows = [(9_000_000, 2**41 + 5, "d"), (9_000_001, 4, "d")]
    for batch, row in enumerate(rows):
        increments.write_batch(spark.createDataFrame([row], "log_no int, log_pos long, db string"), batch, root)
    got = [(r["start_no"], r["start_pos"], r["end_no"], r["end_pos"], r["late"]) for r in increments.read_increment_manifest(spark, root).orderBy("batch").collect()]
    assert got == [(9_000_000, 2**41 + 5, 9_000_000, 2**41 + 6, False), (9_000_000, 2**41 + 6, 9_000_001, 5, False)]
