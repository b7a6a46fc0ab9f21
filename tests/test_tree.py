import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import tree

SCHEMA = "id string, pid string, name string, ord long"
# A(B, C(D, E)), F(G, H(I))
LETTERS = [("A", None), ("B", "A"), ("C", "A"), ("D", "C"), ("E", "C"), ("F", None), ("G", "F"), ("H", "F"), ("I", "H")]


def nodes(spark, rows=LETTERS):
    return spark.createDataFrame([(i, p, i, n) for n, (i, p) in enumerate(rows)], SCHEMA).repartition(4)


def names(df):
    return [r["name"] for r in df.collect()]


def test_pre_order(spark):
    assert names(tree.depth_first(nodes(spark))) == list("ABCDEFGHI")


def test_empty_values_are_left_out(spark):
    rows = spark.createDataFrame([("a", None, None, 0), ("b", "a", "", 1), ("c", "b", "x", 2)], SCHEMA)
    assert names(tree.depth_first(rows)) == ["x"]
    numbers = spark.createDataFrame([("a", None, 0, 0), ("b", "a", 5, 1)], "id string, pid string, name int, ord long")
    assert names(tree.depth_first(numbers)) == [5]


def test_a_failing_node_takes_its_subtree_along(spark):
    assert names(tree.prune(nodes(spark), F.col("name") != "C")) == list("ABFGHI")
    assert names(tree.prune(nodes(spark), F.col("name") == "D")) == []


def test_siblings_sort_with_the_default_last(spark):
    rows = [("r", None, "r", 1), ("x", "r", "x", None), ("y", "r", "y", 1000), ("z", "r", "z", 0), ("w", "z", "w", 5)]
    assert names(tree.sort_siblings(spark.createDataFrame(rows, SCHEMA))) == ["r", "z", "w", "x", "y"]


def test_ancestors(spark):
    got = {r["name"]: (r["parent"], r["parents"]) for r in tree.with_ancestors(nodes(spark)).collect()}
    assert got["E"] == ("C", ["A", "C"]) and got["A"] == (None, []) and got["I"] == ("H", ["F", "H"])


def test_find_gives_the_first_match_and_its_root(spark):
    rows = spark.createDataFrame([("1", None, "home", 0), ("2", "1", "list", 0), ("3", None, "list", 1), ("4", "2", "item", 0)], SCHEMA)
    got = {r["name"]: (r["id"], r["root_label"]) for r in tree.find_first(rows).collect()}
    assert got == {"home": ("1", None), "list": ("2", "home"), "item": ("4", "home")}
    assert {r["name"]: r["root_label"] for r in tree.find_first(rows, level=1).collect()}["item"] == "list"


def test_cycles_are_an_error_and_orphans_are_left_out(spark):
    with pytest.raises(ValueError, match="cycle"):
        tree.depth_first(nodes(spark, [("a", "b"), ("b", "a"), ("r", None)]))
    assert names(tree.depth_first(nodes(spark, [("r", None), ("o", "nowhere"), ("p", "o")]))) == ["r"]


def test_roots_only_and_empty(spark):
    assert names(tree.depth_first(nodes(spark, [("a", None), ("b", None)]))) == ["a", "b"]
    assert tree.depth_first(nodes(spark).limit(0)).isEmpty()


def test_a_deep_random_tree(spark):
    rnd, rows, depth = random.Random(4), [("n000", None)], {"n000": 1}
    for i in range(1, 200):
        parent = f"n{max(0, i - rnd.choice([1, 1, 1, 2])):03d}"
        rows.append((f"n{i:03d}", parent))
        depth[f"n{i:03d}"] = depth[parent] + 1
    got = {r["id"]: r["d"] for r in tree.with_path(nodes(spark, rows)).select("id", F.size("path").alias("d")).collect()}
    assert got == depth and max(depth.values()) > 64


def test_children_come_in_bounded_rows(spark):
    rows = spark.range(2500).select(F.concat(F.lit("c"), "id").alias("id"), F.lit("p").alias("pid"), F.lit("n").alias("name"), F.col("id").alias("ord"))
    got = tree.children_lists(rows).orderBy("chunk").collect()
    assert [len(r["children"]) for r in got] == [1000, 1000, 500]
    assert [c["ord"] for r in got for c in r["children"]] == list(range(2500))
    assert tree.children_lists(nodes(spark)).filter("pid IS NULL").first()["children"][0]["id"] == "A"


def test_many_rows_below_a_cycle(spark):
    rows = [("a", "b"), ("b", "a"), ("r", None), *((f"x{i}", "a") for i in range(300)), *((f"y{i}", f"x{i}") for i in range(300))]
    with pytest.raises(ValueError, match="cycle"):
        tree.depth_first(nodes(spark, rows))


def test_children_without_order(spark):
    rows = spark.range(2500).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("id"), F.lit("p").alias("pid"), F.lit("n").alias("name"), F.lit(None).cast("long").alias("ord"))
    got = tree.children_lists(rows).orderBy("chunk").collect()
    assert [len(r["children"]) for r in got] == [1000, 1000, 500]
    assert [c["id"] for r in got for c in r["children"]] == [f"{i:05d}" for i in range(2500)]


def test_a_hot_parent_is_numbered_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(tree, "SMALL_BYTES", 0)
    monkeypatch.setattr(tree, "hot_groups", lambda nodes, keys: [1])
    rnd = random.Random(2)
    rows = [(f"c{i:05d}", rnd.choice(["hot", "hot", None, f"p{i % 7}"]), "n", rnd.choice([None, i % 50])) for i in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {}
    for r in tree.children_lists(df, per_row=100).orderBy("chunk").collect():
        got.setdefault(r["pid"], []).extend(c["id"] for c in r["children"])
    told = {}
    for i, pid, _, ord_ in sorted(rows, key=lambda r: (r[3] is None, r[3] or 0, r[0])):
        told.setdefault(pid, []).append(i)
    assert got == told
    plan = tree._numbered_children(df, "ord")._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan
