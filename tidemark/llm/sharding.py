"""Shards by a k-d tree: recursive splits at weighted medians along the widest metadata dimension.

A node of the tree holds a number of shards. It is split into two halves of its shards at the weighted quantile that
gives each half its share of the bytes, along the dimension in which the node's rows spread widest, measured against the
whole table. Rows are ordered by (value, tie), where no two rows have one tie, so a cut may fall within a value that
many rows have. Cuts are found by counting: bytes are summed by buckets of the values, and only the bucket that holds
the cut is looked into further, for all nodes of a level at once. The driver sees these sums, at most `BUCKETS` for each
node, and fewer nodes than shards.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.numbered import numbered
from tidemark.session import materialize

#: what each row weighs besides its text
OVERHEAD = 16
#: buckets that a step sums bytes by
BUCKETS = 1024
#: a cut may miss its place by this part of a shard's bytes, or by one row
TOLERANCE = 1 / 2000
_LAST = 2**63 - 1
#: dimensions are clamped to this, so that differences fit a long; what is beyond is ordered by ties
_FAR = 2**61


@dataclass
class Node:
    """Shards first to first + shards - 1. A split node sends (value, tie) up to its cut to `low`."""

    first: int
    shards: int
    dim: int = -1
    cut: tuple[int, int] = (0, 0)
    halves: list[Node] = field(default_factory=list)

    def leaves(self) -> list[Node]:
        return [leaf for half in self.halves for leaf in half.leaves()] if self.halves else [self]


def text_number(value: Column) -> Column:
    """A number in the order of strings, by their first six bytes; null counts as empty."""
    start = F.rpad(F.left(F.hex(F.encode(F.coalesce(value, F.lit("")), "UTF-8")), F.lit(12)), 12, "0")
    return F.conv(start, 16, 10).cast("long")


def _place(node: Node, dims: list[str]) -> Column:
    """The first shard of the leaf that a row falls in."""
    if not node.halves:
        return F.lit(node.first)
    value, tie = node.cut
    low = (F.col(dims[node.dim]) < value) | ((F.col(dims[node.dim]) == value) & (F.col("tie") <= tie))
    return F.when(low, _place(node.halves[0], dims)).otherwise(_place(node.halves[1], dims))


@dataclass
class _Search:
    """The cut of one node lies among the rows of [low, high]; `below` bytes come before them."""

    node: Node
    target: float
    low: int
    high: int
    below: int = 0
    value: int | None = None  # set once the cut is known to fall within this value


def _narrow(search: _Search, sums: list[tuple[int, ...]], slack: float) -> tuple[int, int] | None:
    """The cut, or None when the search goes on in one bucket.

    Sums are (bucket, bytes, least value, greatest value, least tie, greatest tie), ascending.
    """
    within = search.value is not None
    for _, size, least, greatest, first_tie, last_tie in sums:
        if search.below + size < search.target:
            search.below += size
            continue
        if size <= slack or first_tie == last_tie:
            after = search.below + size - search.target <= search.target - search.below
            end = greatest if after else least - 1
            return (search.value, end) if within else (end, _LAST)
        if least == greatest:
            search.value, search.low, search.high = least, first_tie, last_tie
        else:
            search.low, search.high = least, greatest
        return None
    end = sums[-1][3]
    return (search.value, end) if within else (end, _LAST)


def _cut_level(rows: DataFrame, root: Node, nodes: list[Node], dims: list[str], spans: list[float], slack: float) -> None:
    """Splits every node of a level that holds rows."""
    spark = rows.sparkSession
    placed = rows.withColumn("_node", _place(root, dims))
    by_first = {node.first: node for node in nodes}
    facts = [F.sum("size").alias("size"), *(f(d).alias(f"{f.__name__}_{d}") for d in dims for f in (F.min, F.max))]
    searches: dict[int, _Search] = {}
    for r in placed.where(F.col("_node").isin(list(by_first))).groupBy("_node").agg(*facts).collect():
        node = by_first[r["_node"]]
        widths = [(r[f"max_{d}"] - r[f"min_{d}"]) / span for d, span in zip(dims, spans, strict=True)]
        node.dim = max(range(len(dims)), key=lambda i: widths[i])
        d, share = dims[node.dim], node.shards // 2 / node.shards
        searches[node.first] = _Search(node, r["size"] * share, r[f"min_{d}"], r[f"max_{d}"])
    while searches:
        # one row for each open node: fewer than there are shards
        asked = [
            (s.node.first, s.node.dim, s.value, s.low, s.high, max(1, -(-(s.high - s.low + 1) // BUCKETS))) for s in searches.values()
        ]
        wanted = F.broadcast(spark.createDataFrame(asked, "_node int, dim int, within long, low long, high long, width long"))
        value = F.element_at(F.array(*dims), F.col("dim") + 1)
        found = placed.join(wanted, "_node").withColumn("_v", F.when(F.col("within").isNull(), value).when(F.col("within") == value, F.col("tie")))
        found = found.where("_v between low and high").withColumn("_bucket", F.expr("(_v - low) div width"))
        sums: dict[int, list] = {}
        for r in found.groupBy("_node", "_bucket").agg(F.sum("size").alias("size"), F.min("_v"), F.max("_v"), F.min("tie"), F.max("tie")).collect():
            sums.setdefault(r["_node"], []).append(tuple(r)[1:])
        for first, search in list(searches.items()):
            cut = _narrow(search, sorted(sums[first]), slack)
            if cut is not None:
                node, left = search.node, search.node.shards // 2
                node.cut, node.halves = cut, [Node(first, left), Node(first + left, node.shards - left)]
                del searches[first]


def kd_tree(rows: DataFrame, shards: int, dims: list[str]) -> Node:
    """The tree over a written table of (dims, tie, size), all longs; ties differ and are not negative."""
    root = Node(0, shards)
    facts = rows.agg(F.sum("size").alias("size"), *(f(d).alias(f"{f.__name__}_{d}") for d in dims for f in (F.min, F.max))).first()
    if facts["size"] is None:
        return root
    spans = [max(1, facts[f"max_{d}"] - facts[f"min_{d}"]) for d in dims]
    slack = facts["size"] / shards * TOLERANCE
    while level := [leaf for leaf in root.leaves() if leaf.shards > 1 and leaf.dim < 0]:
        _cut_level(rows, root, level, dims, spans, slack)
        for node in level:  # without rows there is nothing to split
            node.dim = max(node.dim, 0)
    return root


def kd_shards(
    docs: DataFrame, *, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text",
    dims: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Every row as (id, size, text_crc32, shard, slot): its shard, and its place there, gapless from 0, by id.

    `size` is the text's UTF-8 bytes and `OVERHEAD`. Give the number of shards, or the bytes that a shard shall have:
    then there are as many as the total holds, rounded up. Sizes of shards differ from the mean by `TOLERANCE` for each
    of the log2(shards) levels and by one row at each cut. With fewer rows than shards some shards stay empty.

    `dims` are long expressions over the rows; without them source, language, characters and id. Nulls count as 0 and a
    null text as empty. Repeated rows and equal values are told apart by a row number that is written with them. An
    empty table has no rows; columns that are not named don't count.
    """
    if dims is None:
        dims = {"source": text_number(F.col("source")), "lang": text_number(F.col("lang")), "n_chars": F.col("n_chars").cast("long"), "id": F.col(id_col).cast("long")}
    names = [f"dim_{name}" for name in dims]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        *(F.greatest(F.least(F.coalesce(value, F.lit(0)), F.lit(_FAR)), F.lit(-_FAR)).alias(name) for name, value in zip(names, dims.values(), strict=True)), F.monotonically_increasing_id().alias("tie"),
    )
    rows = materialize(rows, "sizes")
    if shards is None:
        shards = max(1, math.ceil((rows.agg(F.sum("size")).first()[0] or 0) / target_bytes))
    placed = rows.select("_id", "size", "text_crc32", "tie", _place(kd_tree(rows, shards, names), names).alias("shard"))
    return numbered(placed, ["shard"], ["_id", "tie"], name="slot").select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", "slot")
