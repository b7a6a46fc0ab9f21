"""Hierarchies kept as rows with a parent id.

Paths from the root come from pointer doubling: each round every row jumps to where its
current ancestor points, so a tree of depth d needs log2(d) joins rather than d. Finished
rows leave the loop, and each round is written out, which cuts the lineage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import SMALL_BYTES, hot_groups, plan_bytes
from tidemark.session import materialize

# from so many rounds on, that is 2^5 levels, rows still open are first tested for a cycle
CYCLE_TEST_ROUND = 5
# fixed value: where a node without an order number sorts among its siblings
DEFAULT_ORDER = 999
# most children in one row of a children list
CHILDREN_PER_ROW = 1000


def with_path(nodes: DataFrame, label: str = "name", order: str = "ord") -> DataFrame:
    """Nodes (`id`, `pid`, ...) reachable from a root, with `path`: one struct (ord, id,
    label) per node from the root down to the node itself.

    Sorting by `path` is depth-first pre-order with siblings in (order, id) order. Rows
    whose parent is missing hang below nothing and are left out, as are their children.
    """
    entry = F.struct(F.coalesce(order, F.lit(DEFAULT_ORDER)).cast("long").alias("ord"), F.col("id").alias("id"), F.col(label).alias("label"))
    rows = nodes.select("id", F.col("pid").alias("_at"), F.array(entry).alias("_path"))
    finished, active = [rows.filter("_at IS NULL")], rows.filter("_at IS NOT NULL")
    left, done = 1, 0
    while left:
        if done == CYCLE_TEST_ROUND:
            _refuse_cycles(active)
        known = reduce(DataFrame.unionAll, finished).unionAll(active)
        upper = known.select(F.col("id").alias("_at"), F.col("_at").alias("_next"), F.col("_path").alias("_upper"))
        # a parent of many children repeats on the left only, where a hot key is split
        step = active.join(upper, "_at").select("id", F.col("_next").alias("_at"), F.concat("_upper", "_path").alias("_path"))
        # the write itself counts what is left to do
        seen = Observation()
        step = materialize(step.observe(seen, F.count_if(F.col("_at").isNotNull()).alias("open")), "tree")
        finished.append(step.filter("_at IS NULL"))
        active = step.filter("_at IS NOT NULL")
        left, done = seen.get["open"], done + 1
    paths = reduce(DataFrame.unionAll, finished).select("id", F.col("_path").alias("path"))
    return nodes.join(paths, "id")


def _refuse_cycles(active: DataFrame) -> None:
    """An error if some rows never reach a root.

    Ids alone are followed, so a cycle makes nothing grow. In n open rows a chain of jumps, which
    double each round, has ended after log2(n) rounds, or never does.
    """
    jumps = materialize(active.select("id", "_at"), "tree-jumps")
    for _ in range(jumps.count().bit_length() + 1):
        onward = jumps.select(F.col("id").alias("_at"), F.col("_at").alias("_next"))
        # where the jump ends at a finished row there is nothing to follow
        jumps = materialize(jumps.join(onward, "_at").select("id", F.col("_next").alias("_at")), "tree-jumps")
        if jumps.isEmpty():
            return
    raise ValueError("the parent ids form a cycle")


def depth_first(nodes: DataFrame, label: str = "name", order: str = "ord") -> DataFrame:
    """Node values in pre-order, without empty ones (null, empty text, 0, false)."""
    value = F.col(label)
    kept = value.isNotNull() & ~F.coalesce(value.cast("string").isin("", "0", "0.0", "false"), F.lit(False))
    if dict(nodes.dtypes)[label] == "string":
        kept = value.isNotNull() & (value != "")
    return with_path(nodes, label, order).filter(kept).orderBy("path")


def prune(nodes: DataFrame, predicate: Column, label: str = "name", order: str = "ord") -> DataFrame:
    """Nodes that pass and whose ancestors all pass: the others are cut off before the
    paths are built, and what hung below them is then out of reach."""
    return with_path(nodes.filter(predicate), label, order).orderBy("path")


def sort_siblings(nodes: DataFrame, order: str = "ord", label: str = "name") -> DataFrame:
    """The whole tree in pre-order, siblings by order number, those without one at 999."""
    return with_path(nodes, label, order).orderBy("path")


def path_text(part: str = "id") -> Column:
    return F.array_join(F.transform("path", lambda x: x[part].cast("string")), "/")


def with_ancestors(nodes: DataFrame, label: str = "name", order: str = "ord") -> DataFrame:
    """Add `parents`, labels from the root down to the parent, and `parent`, the last."""
    rows = with_path(nodes, label, order)
    parents = F.transform(F.slice("path", F.lit(1), F.size("path") - 1), lambda x: x["label"])
    return rows.withColumn("parents", parents).withColumn("parent", F.try_element_at("parents", F.lit(-1)))


def find_first(nodes: DataFrame, label: str = "name", level: int = 0, order: str = "ord") -> DataFrame:
    """For every label its first node in pre-order, with the ancestor at `level`."""
    rows = with_ancestors(nodes, label, order)
    first = rows.groupBy(label).agg(F.min(F.struct("path", "id", "parents")).alias("_first"))
    return first.select(
        F.col("_first.id").alias("id"), label, F.get(F.col("_first.parents"), F.lit(level)).alias("root_label")
    )


def children_lists(nodes: DataFrame, order: str = "ord", per_row: int = CHILDREN_PER_ROW) -> DataFrame:
    """Children of each parent in order, nested, in rows of bounded size.

    A parent's list is the concatenation of its rows by `chunk`, so a parent of any number of
    children fits. Children go by `order`, those without one last, and then by id.
    """
    child = F.struct(F.col(order).alias("ord"), *(c for c in nodes.columns if c not in ("pid", order)))
    rows = _numbered_children(nodes, order).withColumn("chunk", F.floor(F.col("_place") / per_row).cast("long"))
    listed = rows.groupBy("pid", "chunk").agg(F.sort_array(F.collect_list(F.struct("_place", child.alias("child")))).alias("_children"))
    return listed.select("pid", "chunk", F.transform("_children", lambda x: x["child"]).alias("children"))


def _numbered_children(nodes: DataFrame, order: str) -> DataFrame:
    """Nodes with `_place`, their number among the children of their parent, from 0.

    Where a parent has more children than a task should hold, all nodes are sorted once in ranges
    of (parent, order, id), so such a parent spreads over many tasks; what comes before a range is
    one row for each parent in it.
    """
    if plan_bytes(nodes) <= SMALL_BYTES or not hot_groups(nodes, ["pid"]):
        among = Window.partitionBy("pid").orderBy(F.asc_nulls_last(order), "id")
        return nodes.withColumn("_place", F.row_number().over(among) - 1)
    # all nodes sorted once in ranges: a node's number in that sort is unique and keeps the order of ids
    spread = nodes.repartitionByRange("pid", F.asc_nulls_last(order), "id").sortWithinPartitions("pid", F.asc_nulls_last(order), "id")
    spread = materialize(spread.withColumn("_at", F.monotonically_increasing_id()), "children")
    ranges = spread.groupBy("pid", F.shiftright("_at", 33).alias("_range")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("pid").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = materialize(ranges.select(F.col("pid").alias("_pid"), "_range", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")), "child-ranges")
    met = spread.join(ranges, spread["pid"].eqNullSafe(ranges["_pid"]) & (F.shiftright("_at", 33) == F.col("_range")))
    return met.withColumn("_place", F.col("_before") + F.col("_at") - F.col("_first")).select(*nodes.columns, "_place")
