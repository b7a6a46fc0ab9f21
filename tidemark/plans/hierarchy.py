"""Hierarchies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import tree as ops
from tidemark.plans.registry import query

_WALK = """
WITH RECURSIVE walk AS (
  SELECT id, pid, name, ord, id AS path, CAST(NULL AS VARCHAR) AS parents, CAST(NULL AS VARCHAR) AS parent, CAST(NULL AS VARCHAR) AS root,
         lpad(CAST(ord AS VARCHAR), 9, '0') AS place, 1 AS depth FROM nodes WHERE pid IS NULL
  UNION ALL
  SELECT n.id, n.pid, n.name, n.ord, concat(w.path, '/', n.id), CASE WHEN w.parents IS NULL THEN w.name ELSE concat(w.parents, '/', w.name) END, w.name, coalesce(w.root, w.name),
         concat(w.place, '/', lpad(CAST(n.ord AS VARCHAR), 9, '0')), w.depth + 1 FROM nodes n JOIN walk w ON n.pid = w.id)"""


def _walk(nodes: str, tail: str) -> str:
    return _WALK.replace("WITH RECURSIVE ", f"WITH RECURSIVE nodes AS ({nodes}), ") + tail


@query("tree_values", uses="tree", sql=_walk(
    "SELECT id, pid, CASE WHEN ord % 10 = 3 THEN '' ELSE name END AS name, ord FROM tree",
    "SELECT name, path, depth FROM walk WHERE name <> ''"))
def tree_values(t):
    nodes = t.tree.withColumn("name", F.when(F.col("ord") % 10 == 3, "").otherwise(F.col("name")))
    return ops.depth_first(nodes).select("name", ops.path_text().alias("path"), F.size("path").alias("depth"))


@query("tree_filter", uses="tree", sql=_walk("SELECT * FROM tree WHERE ord % 4 <> 1", "SELECT id, pid, name, path FROM walk"))
def tree_filter(t):
    return ops.prune(t.tree, F.col("ord") % 4 != 1).select("id", "pid", "name", ops.path_text().alias("path"))


@query("tree_sort", uses="tree", sql=_walk(
    "SELECT id, pid, name, CASE WHEN ord % 3 = 0 THEN 999 ELSE 500 - ord % 400 END AS ord FROM tree", "SELECT id, path, place FROM walk"))
def tree_sort(t):
    nodes = t.tree.withColumn("ord", F.when(F.col("ord") % 3 != 0, 500 - F.col("ord") % 400))
    place = F.array_join(F.transform("path", lambda x: F.lpad(x["ord"].cast("string"), 9, "0")), "/")
    return ops.sort_siblings(nodes).select("id", ops.path_text().alias("path"), place.alias("place"))


@query("tree_ancestors", uses="tree", sql=_walk("SELECT * FROM tree", "SELECT id, parent, coalesce(parents, '') AS parents FROM walk"))
def tree_ancestors(t):
    return ops.with_ancestors(t.tree).select("id", "parent", F.array_join("parents", "/").alias("parents"))


@query("tree_find", uses="tree", sql=_walk(
    "SELECT id, pid, concat('m', CAST(ord % 37 AS VARCHAR)) AS name, ord FROM tree",
    "SELECT id, name, root AS root_label FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY place) AS rn FROM walk) x WHERE rn = 1"))
def tree_find(t):
    nodes = t.tree.withColumn("name", F.concat(F.lit("m"), (F.col("ord") % 37).cast("string")))
    return ops.find_first(nodes)


@query("children_list", uses="tree", sql="""
SELECT pid, (place - 1) // 1000 AS chunk, string_agg(id, ',' ORDER BY place) AS children
FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY ord, id) AS place FROM tree) x GROUP BY ALL""")
def children_list(t):
    ids = F.transform("children", lambda x: x["id"])
    return ops.children_lists(t.tree).select("pid", "chunk", F.array_join(ids, ",").alias("children"))
