import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import diff, digesttree


def record(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def changes(old, new, **options):
    rows = diff.table_diff(old, new, "k", **options).collect()
    return sorted((r["k"], r["change"], r["field"], r["new_value"]) for r in rows) if not options.get("include_removed") else rows


@pytest.fixture(params=["direct", "digest"])
def how(request):
    return request.param


def test_equal_tables_give_nothing(spark, how):
    a = record(spark, "k int, b struct<c:int,d:int>, l array<int>", (1, (2, 3), [1, 2]), (2, None, None))
    assert changes(a, a, strategy=how) == []


def test_nested_field(spark, how):
    schema = "k int, a int, b struct<c:int,d:int>"
    assert changes(record(spark, schema, (1, 1, (2, 4))), record(spark, schema, (1, 1, (3, 4))), strategy=how) == [(1, "changed", "b.c", "3")]


def test_arrays_are_multisets(spark, how):
    schema = "k int, a array<int>"
    old = record(spark, schema, (1, [1, 2, 3]), (2, [1, 2, 2]), (3, [1, 1, 2]))
    new = record(spark, schema, (1, [3, 1, 2]), (2, [1, 2, 4]), (3, [1, 2, 2]))
    assert changes(old, new, strategy=how) == [(2, "changed", "a", "[1,2,4]"), (3, "changed", "a", "[1,2,2]")]


def test_added_field_counts_and_removed_field_gives_nothing(spark):
    old, new = record(spark, "k int, a int, gone int", (1, 1, 5)), record(spark, "k int, a int, b int", (1, 1, 2))
    for how in ("direct", "digest"):
        assert changes(old, new, strategy=how) == [(1, "changed", "b", "2")]


def test_null_to_value_and_back(spark, how):
    schema = "k int, a int, b int, c boolean"
    old, new = record(spark, schema, (1, None, 2, False)), record(spark, schema, (1, 1, None, True))
    assert changes(old, new, strategy=how) == [(1, "changed", "a", "1"), (1, "changed", "b", None), (1, "changed", "c", "true")]


def test_swapped_nulls_are_a_change(spark, how):
    schema = "k int, a string, b string"
    old, new = record(spark, schema, (1, "x", None)), record(spark, schema, (1, None, "x"))
    assert changes(old, new, strategy=how) == [(1, "changed", "a", None), (1, "changed", "b", "x")]


def test_added_and_removed_rows(spark, how):
    schema = "k int, a int"
    old, new = record(spark, schema, (1, 1), (2, 2)), record(spark, schema, (2, 2), (3, None), (4, 4))
    # an added row gives all its fields, also those without a value
    assert changes(old, new, strategy=how) == [(3, "added", "a", None), (4, "added", "a", "4")]
    rows = diff.table_diff(old, new, "k", include_removed=True, strategy=how).collect()
    assert [tuple(r) for r in rows if r["change"] == "removed"] == [(1, "removed", None, None)]


def test_multiset_diff(spark):
    a = record(spark, "x int, y string", (1, "a"), (1, "a"), (2, None), (3, "c"))
    b = record(spark, "x int, y string", (1, "a"), (2, None), (3, "c"), (4, "d"))
    assert sorted(tuple(r) for r in diff.multiset_diff(a, b).collect()) == [(1, "a", 1), (4, "d", -1)]
    assert diff.multiset_diff(a, a).isEmpty()


@pytest.mark.parametrize("a,b,equal", [([1, 2, 3], [3, 2, 1], True), ([1, 1, 2], [1, 2, 2], False), ([1], [1, 1], False), ([], [], True), ([None, 1], [1, None], True)])
def test_arrays_equal(spark, a, b, equal):
    row = spark.createDataFrame([(a, b)], "a array<int>, b array<int>").select(diff.arrays_equal(F.col("a"), F.col("b")))
    assert row.first()[0] is equal


def test_verify_tables(spark):
    a = record(spark, "x int, y string", (1, "a"), (2, None), (2, None))
    same = a.repartition(5).select("y", "x")
    assert tuple(diff.verify_tables(same, a).first()) == (3, 3, True)
    moved = record(spark, "x int, y string", (1, "a"), (2, None), (None, "2"))
    assert diff.verify_tables(moved, a).first()["equal"] is False
    assert tuple(diff.verify_tables(a.limit(0), a.limit(0)).first()) == (0, 0, True)
    plan = diff.verify_tables(same, a)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def test_one_changed_row_in_many_is_found_by_digest(spark):
    old = spark.range(5000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    new = old.withColumn("v", F.when(F.col("k") == 4321, "other").otherwise(F.col("v")))
    assert changes(old, new, strategy="digest") == [(4321, "changed", "v", "other")]


def test_map_values_travel_as_json(spark):
    old, new = (record(spark, "k int, m array<struct<a:int>>", (1, [(n,)])) for n in (1, 2))
    ((_, _, field, value),) = changes(old, new)
    assert field == "m" and json.loads(value) == [{"a": 2}]


NESTED = "k int, a array<int>, s array<struct<x: int, y: int>>, m map<string, int>, n map<string, array<int>>, t struct<p: int, q: map<string, int>>, b array<array<boolean>>"
NESTED_ROWS = [
    (1, [1], [(1, None)], {"a": 1}, {"a": [1]}, (1, {"z": None}), [[]]),
    (1, [1, None], [(1, None)], {"a": 1}, {"a": [1]}, (1, {"z": None}), [[]]),
    (1, [], [(1, None)], {"a": 1}, {"a": [1]}, (1, {"z": None}), [[]]),
    (1, [None], [(1, None)], {"a": 1}, {"a": [1]}, (1, {"z": None}), [[]]),
    (1, None, [(1, None)], {"a": 1}, {"a": [1]}, (1, {"z": None}), [[]]),
    (1, [1], [(None, 1)], {"a": 1}, {"a": [1]}, (1, {"z": None}), [[]]),
    (1, [1], [None], {"a": 1}, {"a": [1]}, (1, {"z": None}), [[]]),
    (1, [1], [(1, None)], {"a": None}, {"a": [1]}, (1, {"z": None}), [[]]),
    (1, [1], [(1, None)], {}, {"a": [1]}, (1, {"z": None}), [[]]),
    (1, [1], [(1, None)], {"a": 1}, {"a": [1, None]}, (1, {"z": None}), [[]]),
    (1, [1], [(1, None)], {"a": 1}, {"a": [1]}, (1, {}), [[]]),
    (1, [1], [(1, None)], {"a": 1}, {"a": [1]}, (None, {"z": None}), [[]]),
    (1, [1], [(1, None)], {"a": 1}, {"a": [1]}, (1, {"z": None}), [[], [], []]),
    (1, [1], [(1, None)], {"a": 1}, {"a": [1]}, (1, {"z": None}), [[False]]),
]


def test_inner_nulls_and_maps_are_seen(spark):
    """Both strategies and the check of whole tables tell all of these rows apart."""
    for i, left in enumerate(NESTED_ROWS):
        for j, right in enumerate(NESTED_ROWS):
            if j > 3 and i not in (0, j) and (i + j) % 4:
                continue
            a, b = (spark.createDataFrame([r], NESTED) for r in (left, right))
            direct, digest = (sorted(r["field"] for r in diff.table_diff(a, b, "k", strategy=s).collect()) for s in ("direct", "digest"))
            assert direct == digest and bool(direct) == (i != j), (left, right)
            assert diff.verify_tables(a, b).first()["equal"] is (i == j)


def test_keys_of_several_columns(spark):
    old = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 3)], "k int, l string, v int")
    new = spark.createDataFrame([(1, "a", 1), (1, "b", 5), (3, "a", 3)], "k int, l string, v int")
    for how in ("direct", "digest"):
        rows = diff.table_diff(old, new, ["k", "l"], include_removed=True, strategy=how).collect()
        assert sorted(map(tuple, rows)) == [(1, "b", "changed", "v", "5"), (2, "a", "removed", None, None), (3, "a", "added", "v", "3")]


def test_digest_trees_lead_to_what_differs(spark, tmp_path):
    old = spark.range(3000).select("id", (F.col("id") % 7).cast("int").alias("x"), F.array(F.col("id"), F.lit(None).cast("long")).alias("list"))
    changed = F.when(F.col("id").isin(5, 900), F.lit(None).cast("int")).otherwise(F.col("x"))
    new = old.filter("id <> 77").withColumn("x", changed).unionByName(old.limit(1).withColumn("id", F.lit(9000).cast("long")))
    roots = [str(tmp_path / n) for n in ("old", "new", "same", "empty", "other")]
    for df, root in zip((old, new, old.repartition(3), old.limit(0)), roots[:4]):
        digesttree.write_with_tree(df, root, "id", leaves=100)
    leaves = digesttree.differing_leaves(spark, *roots[:2])
    assert 1 <= len(leaves) <= 4 and digesttree.differing_leaves(spark, roots[0], roots[2]) == []
    told = sorted(map(tuple, diff.table_diff(old, new, "id", include_removed=True).collect()), key=repr)
    for root in roots[:2]:  # leaves that are alike can't even be read
        for file in (tmp_path / root / "rows").rglob("*.parquet"):
            if int(file.parent.name.removeprefix("_leaf=")) not in leaves:
                file.write_bytes(b"junk")
                file.with_name(f".{file.name}.crc").unlink()
    got = sorted(map(tuple, digesttree.diff_with_tree(spark, *roots[:2], "id", include_removed=True).collect()), key=repr)
    assert got == told and len(told) == 5
    assert tuple(digesttree.verify_with_tree(spark, roots[2], roots[0]).first()) == (3000, 3000, True)
    assert tuple(digesttree.verify_with_tree(spark, roots[1], roots[0]).first()) == (3000, 3000, False)
    assert tuple(digesttree.verify_with_tree(spark, roots[3], roots[0]).first()) == (0, 3000, False)
    assert digesttree.diff_with_tree(spark, roots[3], roots[2], "id").count() == 6000
    digesttree.write_with_tree(old, roots[4], "id", leaves=10)
    with pytest.raises(ValueError, match="leaves"):
        digesttree.differing_leaves(spark, roots[0], roots[4])
