"""Packing documents into sequences: dominance reduction on the counts by length, then best fit.

All that decides a packing is how many pieces there are of each length, at most `capacity` numbers. These are counted
on the cluster, solved on the driver as runs ("n sequences alike, of these lengths"), and dealt back to the pieces by
their number within a length. No piece leaves the cluster, and the runs are as few at any input size.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.tokens import encoder
from tidemark.session import materialize


@dataclass(frozen=True)
class Run:
    """`times` sequences that each hold pieces of these lengths."""

    lengths: tuple[int, ...]
    times: int


class _Counts:
    """How many pieces of each length are left; lengths with none are not listed."""

    def __init__(self, counts: dict[int, int]):
        self.of = {w: n for w, n in counts.items() if n > 0}
        self.sorted = sorted(self.of)

    def take(self, lengths: tuple[int, ...], times: int) -> Run:
        for w in lengths:
            self.of[w] -= times
            if not self.of[w]:
                del self.of[w]
                self.sorted.remove(w)
        return Run(lengths, times)

    def times(self, lengths: tuple[int, ...]) -> int:
        return min(self.of.get(w, 0) // lengths.count(w) for w in lengths)

    def largest(self, most: int, without: tuple[int, ...] = ()) -> int | None:
        """The largest length up to `most` of which a piece is left beside those in `without`."""
        for i in range(bisect_right(self.sorted, most) - 1, -1, -1):
            if self.of[self.sorted[i]] > without.count(self.sorted[i]):
                return self.sorted[i]
        return None

    def smallest(self, n: int, without: tuple[int, ...] = ()) -> list[int]:
        """The lengths of the n smallest pieces beside `without`, fewer if there are fewer."""
        out: list[int] = []
        for w in self.sorted:
            out += [w] * min(n - len(out), self.of[w] - without.count(w))
            if len(out) == n:
                break
        return out


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[Run], dict[int, int]]:
    """Fix sets that some best packing holds; the runs fixed, and the counts left.

    For a piece w, a set is fixed if any other set with w could be exchanged for it, piece by piece, with no loss:
    - w alone, if no other piece fits beside it;
    - w and a piece that fills the sequence;
    - w and the largest piece that fits, if no two others fit together;
    - w, the largest piece a that fits and the largest b that fits beside both, if no three others fit together, and
      b is as long as the shorter piece of any pair that fits.
    """
    left, runs = _Counts(counts), []
    for w in sorted(left.of, reverse=True):
        while left.of.get(w):
            room = capacity - w
            a = left.largest(room, (w,))
            if a is None:
                chosen: tuple[int, ...] = (w,)
            elif a == room or sum(left.smallest(2, (w,))) > room or len(left.smallest(2, (w,))) < 2:
                chosen = (w, a)
            else:
                three = left.smallest(3, (w,))
                b = left.largest(room - a, (w, a))
                second = left.largest(room // 2, (w,))
                if (len(three) == 3 and sum(three) <= room) or b is None or second is not None and second > b:
                    break
                chosen = (w, a, b)
            # alike sets in one go; what a set rests on changes only when a length runs out
            runs.append(left.take(chosen, max(1, left.times(chosen) - (len(set(chosen)) > 1))))
    return runs, left.of


def best_fit(counts: dict[int, int], capacity: int) -> list[Run]:
    """Best fit, longest pieces first: each goes where the least room is left that holds it."""
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(lengths: tuple[int, ...], times: int) -> None:
        room = capacity - sum(lengths)
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append((lengths, times))

    for w in sorted(counts, reverse=True):
        n = counts[w]
        while n:
            i = bisect_left(rooms, w)
            if i == len(rooms):
                each = capacity // w  # a new sequence is the next best fit until it is full
                if n >= each:
                    put((w,) * each, n // each)
                    n %= each
                else:
                    put((w,) * n, 1)
                    n = 0
                continue
            room = rooms[i]
            lengths, times = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(i)
            each = min(room // w, n)
            used = min(times, n // each)
            put(lengths + (w,) * each, used)
            if used < times:
                put(lengths, times - used)
            n -= used * each
    return [Run(lengths, times) for kept in by_room.values() for lengths, times in kept]


def solve(counts: dict[int, int], capacity: int) -> list[Run]:
    """Runs that hold every piece once."""
    fixed, left = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(left, capacity)


def pieces(docs: DataFrame, path: str, *, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Each document's ids and `end_id`, cut into pieces of `capacity` of which the first may be shorter."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def cut(batches):
        ids_of = encoder(path).ids
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.array([*ids_of(text), end_id], "<u4")
                first = len(ids) % capacity or capacity
                for k, end in enumerate(range(first, len(ids) + 1, capacity)):
                    start = 0 if k == 0 else end - capacity
                    at.append(i)
                    rows.append((k, start, end - start, zlib.crc32(ids[start:end].tobytes()), ids[start:end]))
            columns = [batch.column("doc_id").take(pa.array(at, pa.int32())), pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[j] for r in rows], pa.int64()) for j in (1, 2, 3))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(pa.array([r[4].astype("i4") for r in rows], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


def slots(spark: SparkSession, runs: list[Run]) -> DataFrame:
    """Which numbers of a length go where: number r in [low, low + times) is at `at` in sequence first_sequence + r - low."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for run in runs:
        at = 0
        for w in run.lengths:
            rows.append((w, used.get(w, 0), run.times, first, at))
            used[w] = used.get(w, 0) + run.times
            at += w
        first += run.times
    return spark.createDataFrame(rows, "length long, low long, times long, first_sequence long, at long")


def pack(cut: DataFrame, capacity: int = 1024) -> DataFrame:
    """Adds `sequence_id` and `offset` to rows with a `length` from 1 to `capacity`; every row is packed, repeated ones too.

    An empty table stays empty. A null length, or one out of range, is an error.
    """
    spark = cut.sparkSession
    kept = materialize(cut.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    # numbers within a length: counted by the task that wrote a row, so that no length meets in one task
    by_part = kept.groupBy("length", "_part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = by_part.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).limit(capacity + 2).collect()}
    if any(w is None or not 1 <= w <= capacity for w in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    plan = slots(spark, solve(counts, capacity))
    within = Window.partitionBy("length", "_part").orderBy("_row")
    numbered = kept.withColumn("_n", F.row_number().over(within) - 1).join(begins.drop("n"), ["length", "_part"]).withColumn("_n", F.col("_n") + F.col("base"))
    # a few entries for each length: its size hangs on the capacity alone
    placed = numbered.join(F.broadcast(plan), (numbered["length"] == plan["length"]) & (F.col("_n") >= plan["low"]) & (F.col("_n") < plan["low"] + plan["times"]))
    return placed.select(
        *(numbered[c] for c in cut.columns), (plan["first_sequence"] + F.col("_n") - plan["low"]).alias("sequence_id"), plan["at"].alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str, *, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's pieces and their places; a null text is empty and so one piece of `end_id`; a null id stays."""
    return pack(pieces(docs, path, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence, from pieces that carry `ids`."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
