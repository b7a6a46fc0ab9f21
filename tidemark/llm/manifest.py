"""Merkle manifest of a dataset: slot pivots hash the runs of a tree, and give every row its siblings.

Rows are leaves. Within a group (a source) they are numbered by id; every 16 neighbours form a run. A grouped aggregate
spreads a run over one column for each slot: the columns one after the other are hashed to the run's node, and without
its own column they are a child's siblings. Levels follow until a group has one node, its subroot; the subroots, in the
order of their groups, make a tree of their own. Then paths go down: each run hands its children what it got from above
together with their siblings. No text is read twice, no group meets in one task, and the driver sees one number, the
size of the largest group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.numbered import numbered
from tidemark.session import materialize

FANOUT = 16
#: characters of a digest
DIGEST = 64
#: what a leaf is the hash of
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "array<struct<left: string, right: string>>"


def field_text(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*(field_text(v) for v in values)), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of its path."""
    return F.aggregate(path, leaf, lambda below, s: F.sha2(F.concat(s["left"], below, s["right"]), 256))


def proof_digest(path: Column) -> Column:
    """The hash of all siblings of a path, from the leaf's up."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _pivot(nodes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row for each run of nodes (keys, pos, n, columns): the run's pos, the group's n, slots s0 to s15, their digests joined, and the run's digest.

    A group of one node keeps the node's digest.
    """
    run = nodes.withColumn("_slot", F.col("pos") % FANOUT).withColumn("pos", F.floor(F.col("pos") / FANOUT))
    slots = [F.expr(f"max(struct({', '.join(columns)})) FILTER (WHERE _slot = {k}) AS s{k}") for k in range(FANOUT)]
    spread = run.groupBy(*keys, "pos").agg(F.max("n").alias("n"), *slots)
    spread = spread.withColumn("joined", F.expr(f"concat_ws('', {', '.join(f's{k}.digest' for k in range(FANOUT))})"))
    return spread.withColumn("digest", F.when(F.col("n") == 1, F.col("joined")).otherwise(F.sha2("joined", 256)))


def _children(runs: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The nodes of pivoted runs again: each with its path, which is its siblings and then the run's own path.

    Digests are of one length, so what is left of the joined slots without a child's own is two substrings.
    """
    slots = [f"s{k}" for k in range(FANOUT)]
    kept = [c for c in runs.columns if c not in {"pos", "n", "path", "digest", "joined", *slots}]
    each = runs.select(*kept, "n", "path", "joined", F.col("pos").alias("_run"), F.posexplode(F.array(*slots)).alias("_k", "_child")).where("_child is not null")
    left = F.left("joined", F.col("_k") * DIGEST)
    right = F.substring("joined", (F.col("_k") + 1) * DIGEST + 1, F.lit(FANOUT * DIGEST))
    path = F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), F.col("path")))
    return each.select(*kept, (F.col("_run") * FANOUT + F.col("_k")).alias("pos"), path.alias("path"), *(F.col(f"_child.{c}").alias(c) for c in columns))


def _grow(nodes: DataFrame, keys: list[str], columns: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The runs of every level, lowest first, and (keys, digest) of each group's last node.

    Written level by level: a level has a sixteenth of the rows of the one below.
    """
    largest = nodes.agg(F.max("n")).first()[0] or 0
    levels, tops = [], []
    while True:
        level = materialize(_pivot(nodes, keys, columns), "runs")
        levels.append(level)
        tops.append(level.where(F.col("n") <= FANOUT).select(*keys, "digest"))
        if largest <= FANOUT:
            break
        largest = -(-largest // FANOUT)
        nodes = level.where(F.col("n") > FANOUT).select(*keys, "pos", F.ceil(F.col("n") / FANOUT).alias("n"), "digest")
        columns = ["digest"]
    top = tops[0]
    for more in tops[1:]:
        top = top.unionByName(more)
    return levels, top


def _descend(levels: list[DataFrame], keys: list[str], columns: list[str], above: DataFrame, carried: list[str]) -> DataFrame:
    """The lowest nodes with their whole paths; `above` has (keys, path, carried) for each group's last node."""
    known = None
    for height in range(len(levels) - 1, -1, -1):
        level = levels[height]
        last = level.where(F.col("n") <= FANOUT).join(above, keys)
        if known is None:
            runs = last
        else:
            runs = last.unionByName(level.where(F.col("n") > FANOUT).join(known, [*keys, "pos"]), allowMissingColumns=True)
        wanted = columns if height == 0 else ["digest"]
        known = _children(runs.select(*level.columns, "path", *carried), keys, wanted)
        known = known.drop("digest") if height else known
    return known


def manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, *, group: str = "source", order: str = "doc_id", also: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Every row as (order, leaf, path, subroot, root, and the expressions of `also`, taken from the row).

    A leaf is the hash of the row's fields, in their order. A path is the (left, right) siblings of each level, joined
    hex digests, from the leaf's run up over its group's subroot to the root; `fold` and `proof_digest` read it.

    Rows without a group form one, the first; rows without an id come first in their group. Rows of one group and id are
    ordered by their leaf, and repeated rows are leaves of their own. A lone leaf is its group's subroot, and a lone
    subroot the root. An empty table has no rows. Fields may be null or empty; columns that are not named don't count.
    """
    keys, also = ["has_group", "in_group"], dict(also or {})
    rows = docs.select(
        F.col(group).isNotNull().alias("has_group"), F.coalesce(F.col(group).cast("string"), F.lit("")).alias("in_group"), F.col(order).alias("_order"),
        leaf_digest([F.col(f) for f in fields]).alias("digest"), *(value.alias(f"also_{name}") for name, value in also.items()),
    )
    # texts are hashed here, once; repeated rows are told apart by a number that is written with them
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    kept = ["digest", "_order", "_row", *(f"also_{name}" for name in also)]
    levels, subroots = _grow(numbered(rows, keys, ["_order", "digest", "_row"]), keys, kept)
    subroots = materialize(subroots, "subroots")

    whole = numbered(subroots.withColumn("_all", F.lit(0)), ["_all"], keys)
    upper, root = _grow(whole, ["_all"], ["digest", *keys])
    root = root.select("_all", F.expr(f"cast(array() as {_PATH})").alias("path"), F.col("digest").alias("root"))
    above = materialize(_descend(upper, ["_all"], ["digest", *keys], root, ["root"]).select(*keys, F.col("digest").alias("subroot"), "path", "root"), "above")

    found = _descend(levels, keys, kept, above, ["subroot", "root"])
    return found.select(F.col("_order").alias(order), F.col("digest").alias("leaf"), "path", "subroot", "root", *(F.col(f"also_{name}").alias(name) for name in also))
