"""A tree of digests kept beside a stored table, so that two copies are compared by reading what differs.

    <root>/rows/_leaf=<n>/   the rows, by ranges of their hashed keys
    <root>/tree/             one row for each node: level, node, rows and a digest of 128 bits
    <root>/schema.json       the columns, which a table without rows has no file to tell by

A leaf's digest is the order-free sum of its rows' hashes, a higher node's the hash of its children. A
comparison goes down from the root and follows only nodes that differ; of the tables themselves only
the leaves found so are read. Ranges are of hashes, so both copies have the same ones whatever keys
they hold, and a leaf holds its share of the rows.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.diff import _row_digest, leaf_fields, table_diff
from tidemark.operators.restore import key_columns
from tidemark.session import read_text, write_text

FANOUT = 16
_SUM = "decimal(38,0)"


def write_with_tree(df: DataFrame, root: str, key: str | Sequence[str], leaves: int = 256) -> None:
    """Store a table by leaves, and its tree. `leaves` should make a leaf some tens of MB; copies to be compared share it."""
    spark, keys = df.sparkSession, key_columns(key)
    marked = df.withColumn("_leaf", F.pmod(F.xxhash64(*keys), F.lit(leaves)).cast("int"))
    marked.hint("rebalance", "_leaf").write.partitionBy("_leaf").parquet(f"{root}/rows")
    stored = spark.read.schema(marked.schema).parquet(f"{root}/rows")
    write_text(spark, f"{root}/schema.json", marked.schema.json())
    h, g = _row_digest([(F.col(name), kind, True) for name, kind in sorted(leaf_fields(df.schema), key=lambda f: f[0])])
    level = stored.select(F.col("_leaf").alias("node"), h.cast(_SUM).alias("h"), g.cast(_SUM).alias("g")).groupBy("node").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("h").cast(_SUM).alias("h"), F.sum("g").cast(_SUM).alias("g"))
    tree, width, number = level.withColumn("level", F.lit(0)), leaves, 0
    while width > 1:
        child = F.array_sort(F.collect_list(F.struct("node", "rows", "h", "g")))  # FANOUT at most
        level = level.groupBy(F.expr(f"node div {FANOUT}").cast("int").alias("node")).agg(F.sum("rows").alias("rows"), child.alias("c"))
        level = level.select("node", "rows", F.xxhash64("c").cast(_SUM).alias("h"), F.xxhash64(F.lit(1), "c").cast(_SUM).alias("g"))
        width, number = -(-width // FANOUT), number + 1
        tree = tree.unionByName(level.withColumn("level", F.lit(number)))
    tree.withColumn("leaves", F.lit(leaves)).coalesce(1).write.parquet(f"{root}/tree")


def differing_leaves(spark: SparkSession, old: str, new: str) -> list[int]:
    """Numbers of the leaves in which two stored tables differ; only the trees are read."""
    a, b = (spark.read.parquet(f"{root}/tree") for root in (old, new))
    tops = [df.agg(F.max("level").alias("level"), F.max("leaves").alias("leaves")).first() for df in (a, b)]
    if tops[0]["leaves"] is not None and tops[1]["leaves"] is not None and tops[0]["leaves"] != tops[1]["leaves"]:
        raise ValueError(f"trees of {tops[0]['leaves']} and {tops[1]['leaves']} leaves can't be compared")
    found: list[int] | None = None
    for number in range(max((t["level"] for t in tops if t["level"] is not None), default=-1), -1, -1):
        sides = [df.filter(F.col("level") == number).select("node", F.struct("rows", "h", "g").alias(name)) for df, name in ((a, "a"), (b, "b"))]
        if found is not None:
            sides = [df.filter(F.expr(f"node div {FANOUT}").isin(found)) for df in sides]
        met = sides[0].join(sides[1], "node", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
        found = sorted(r["node"] for r in met.select("node").collect())
        if not found:
            return []
    return found or []


def read_leaves(spark: SparkSession, root: str, leaves: Sequence[int] | None = None) -> DataFrame:
    """A stored table, or the given leaves of it."""
    rows = spark.read.schema(StructType.fromJson(json.loads(read_text(spark, f"{root}/schema.json")))).parquet(f"{root}/rows")
    return (rows if leaves is None else rows.filter(F.col("_leaf").isin(list(leaves)))).drop("_leaf")


def diff_with_tree(spark: SparkSession, old: str, new: str, key: str | Sequence[str], include_removed: bool = False) -> DataFrame:
    """`table_diff` of two stored tables of one layout, from the leaves in which they differ alone."""
    leaves = differing_leaves(spark, old, new)
    return table_diff(read_leaves(spark, old, leaves), read_leaves(spark, new, leaves), key, include_removed)


def verify_with_tree(spark: SparkSession, restored: str, expected: str) -> DataFrame:
    """One row as `verify_tables` gives it, from the trees' roots alone."""
    sides = []
    for root, name in ((restored, "restored"), (expected, "expected")):
        tree = spark.read.parquet(f"{root}/tree")
        top = F.max_by(F.struct("rows", "h", "g"), "level")
        sides.append(tree.agg(top.alias(name)).withColumn("one", F.lit(1)))
    both = sides[0].join(sides[1], "one")
    rows = [F.coalesce(f"{side}.rows", F.lit(0).cast("long")).alias(f"{side}_rows") for side in ("restored", "expected")]
    return both.select(*rows, F.col("restored").eqNullSafe(F.col("expected")).alias("equal"))
