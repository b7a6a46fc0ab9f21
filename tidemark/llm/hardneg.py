"""Hard negatives by an inverted multi-index over integer vectors.

Vectors are cut into two halves, and each half has a codebook of its own; a cell holds the rows of one pair of
codewords. For an anchor the score of a row is at most the sum of two half-scores: anchor half times codeword, plus the
anchor half's length times the radius of the rows around the codeword. A heap walks the pairs in falling order of that
sum (multi-sequence), and stops where a bound shows that nothing below can enter a result. So results are exact whatever
the codebooks are, which are fitted on a bounded sample; every row is indexed.

A walk that reads as it goes is not distributed, so each search takes two rounds of jobs. The first walks until it has
met `FIRST_ROWS` rows; their scores certify a floor. The second walks on to that floor. A round's visits are a table of
(cell block, anchors), joined with the index's blocks: rows and anchors meet as small matrices. Tasks keep the best few
of each anchor before anything is shuffled.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

#: a component x counts as floor(SCALE * x)
SCALE = 256
#: rows whose squared length is above this take no part: 100 times a score must fit a long
LONGEST = 2.0**55
#: rows that the codebooks are fitted on at most, and components of these
SAMPLE_ROWS, SAMPLE_VALUES = 20_000, 2_000_000
#: rows of a cell aimed at, and codewords of a half at most; the directory of cells has at most their square
CELL_ROWS, CODEWORDS = 512, 256
#: rows of an index block, and anchors that share a visit
BLOCK_ROWS, ANCHORS = 512, 64
#: rows that the first round meets for an anchor
FIRST_ROWS = 2048
#: scores kept in a task before the best of each anchor are given out
HELD = 500_000

_FAR = 2**62  # beyond all scores
_EXACT = 2.0**52  # products of lengths up to here are exact in doubles


@dataclass
class Index:
    """Codebooks, and the directory of cells: rows, blocks and the radius of each half."""

    dim: int
    books: tuple[np.ndarray, np.ndarray]  # codewords by half dimension
    rows: np.ndarray  # int64[k1, k2]
    blocks: np.ndarray
    radius: tuple[np.ndarray, np.ndarray]  # float[k1, k2]

    def halves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.books[0].shape[1]
        return vectors[:, :cut], vectors[:, cut:]


# ---- rows ----


def clean(vectors: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(id, label, vector) of the rows that take part, vectors as longs; repeated rows count once."""
    whole = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    odd = F.exists(F.col(vector_col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == math.inf))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()).where(~odd)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), whole.alias("v"))
    rows = rows.where(F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x) <= LONGEST)
    return rows.select("id", "label", F.transform("v", lambda x: x.cast("long")).alias("vector")).distinct()


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """Vectors as rows of a matrix; what a short one lacks is 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.arange(dim) < sizes[:, None]] = values
    return out


def _pack(matrix: np.ndarray) -> bytes:
    """A matrix in the narrowest integers that hold it; the first byte says which."""
    far = int(np.abs(matrix).max(initial=0))
    width = 2 if far < 2**15 else 4 if far < 2**31 else 8
    return bytes([width]) + matrix.astype(f"<i{width}").tobytes()


def _unpack(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).reshape(-1, dim).astype(np.int64)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of a with those of b."""
    lengths = [math.sqrt(float((x.astype(np.float64) ** 2).sum(axis=1).max(initial=0))) for x in (a, b)]
    if lengths[0] * lengths[1] <= _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


# ---- index ----


def codebook(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k codewords of a half: k-means from spread-out rows of the sample."""
    points = np.unique(points, axis=0).astype(np.float64)
    words = points[np.linspace(0, len(points) - 1, min(k, len(points))).astype(int)]
    for _ in range(rounds):
        near = _nearest(points, words)[0]
        count = np.bincount(near, minlength=len(words))
        total = np.zeros_like(words)
        np.add.at(total, near, points)
        words = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], words)
    return words


def _nearest(points: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest word of each point, and its distance, never rounded below the true one."""
    near = ((words**2).sum(axis=1) - 2 * points @ words.T).argmin(axis=1)
    away = np.sqrt(((points - words[near]) ** 2).sum(axis=1))
    return near, away * (1 + 1e-9) + 1e-9


def build_index(rows: DataFrame) -> tuple[Index, DataFrame, DataFrame] | None:
    """The index, its blocks (c1, c2, block, ids, labels, vectors), and the rows with their cells; None without rows.

    A cell is dealt over blocks by hashed ids, so a cell of any size spreads over many tasks.
    """
    spark = rows.sparkSession
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim")).first()
    n, dim = facts["n"], max(facts["dim"] or 0, 2)
    if not n:
        return None
    sampled = min(SAMPLE_ROWS, SAMPLE_VALUES // dim + 1)
    share = F.pmod(F.xxhash64("id", "vector"), F.lit(max(1, n // sampled))) == 0
    sample = rows.where(share).select("vector").toArrow()
    points = _matrix(sample["vector"], dim) if sample.num_rows else np.zeros((1, dim), np.int64)
    cut, k = dim // 2, max(1, min(CODEWORDS, round(math.sqrt(n / CELL_ROWS))))
    books = (codebook(points[:, :cut], k), codebook(points[:, cut:], k))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = _matrix(batch["vector"], dim).astype(np.float64)
            (c1, r1), (c2, r2) = _nearest(matrix[:, :cut], books[0]), _nearest(matrix[:, cut:], books[1])
            more = {"c1": c1.astype(np.int32), "c2": c2.astype(np.int32), "r1": r1, "r2": r2}
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, more.values())], names=[*batch.schema.names, *more])

    schema = "id long, label long, vector array<long>, c1 int, c2 int, r1 double, r2 double"
    placed = materialize(rows.mapInArrow(assign, schema), "placed")
    shape = (len(books[0]), len(books[1]))
    index = Index(dim, books, np.zeros(shape, np.int64), np.zeros(shape, np.int64), (np.zeros(shape), np.zeros(shape)))
    # one row for each cell that holds rows: at most CODEWORDS squared
    for c in placed.groupBy("c1", "c2").agg(F.count("*").alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2")).collect():
        at = (c["c1"], c["c2"])
        index.rows[at], index.radius[0][at], index.radius[1][at] = c["n"], c["r1"], c["r2"]
    index.blocks[:] = -(-index.rows // BLOCK_ROWS)

    def pack(group: pa.Table) -> pa.Table:
        one = {
            "c1": pa.array([group["c1"][0].as_py()], pa.int32()), "c2": pa.array([group["c2"][0].as_py()], pa.int32()), "block": pa.array([group["block"][0].as_py()], pa.int32()),
            "ids": [group["id"].to_numpy().astype("<i8").tobytes()], "labels": [group["label"].to_numpy().astype("<i8").tobytes()], "vectors": [_pack(_matrix(group["vector"], dim))],
        }
        return pa.table(one)

    sizes = [(int(a), int(b), int(index.blocks[a, b])) for a, b in zip(*index.rows.nonzero(), strict=True)]
    listed = F.broadcast(spark.createDataFrame(sizes, "c1 int, c2 int, blocks int"))
    dealt = placed.join(listed, ["c1", "c2"]).withColumn("block", F.pmod(F.xxhash64("id", "label"), F.col("blocks")).cast("int"))
    blocks = dealt.select("c1", "c2", "block", "id", "label", "vector").groupBy("c1", "c2", "block").applyInArrow(
        pack, "c1 int, c2 int, block int, ids binary, labels binary, vectors binary")
    return index, materialize(blocks, "blocks"), placed


# ---- walks ----


def multi_sequence(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(sum, i, j) over all pairs, the greatest sum first: a heap holds the border of what has been given out."""
    by1, by2 = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    a, b = first[by1].tolist(), second[by2].tolist()
    heap = [(-(a[0] + b[0]), 0, 0)]
    while heap:
        total, x, y = heapq.heappop(heap)
        yield -total, int(by1[x]), int(by2[y])
        if x + 1 < len(a):
            heapq.heappush(heap, (-(a[x + 1] + b[y]), x + 1, y))
        if x == 0 and y + 1 < len(b):
            heapq.heappush(heap, (-(a[0] + b[y + 1]), 0, y + 1))


class Walk:
    """One anchor's bounds over the cells of an index."""

    def __init__(self, index: Index, vector: np.ndarray):
        halves = [h[0] for h in index.halves(vector[None, :].astype(np.float64))]
        lengths = [float(np.sqrt((h**2).sum())) for h in halves]
        self.index, middle, reach = index, [], []
        for half, length, book, radius in zip(halves, lengths, index.books, index.radius, strict=True):
            middle.append(book @ half)
            reach.append(length * radius)
        # what floating point may have lost
        slack = 1 + 1e-9 * (sum(np.abs(m).max() for m in middle) + sum(r.max() for r in reach))
        centre, around = middle[0][:, None] + middle[1][None, :], reach[0] + reach[1] + slack
        self.upper, self.lower = centre + around, centre - around
        # a codeword's half-score with its widest cell: no cell of it lies above
        self.first, self.second = middle[0] + reach[0].max(axis=1) + slack, middle[1] + reach[1].max(axis=0)

    def cells(self, windows: list[tuple[float, float]], *, skip: set, limit: int | None = None) -> list[tuple[int, int]]:
        """Cells that may hold a score of some window [least, greatest], in the heap's order.

        It stops where no cell to come reaches any window: the windows are certified. With `limit` also where the cells
        hold that many rows.
        """
        floor, out, met = min((low for low, _ in windows), default=math.inf), [], 0
        for bound, i, j in multi_sequence(self.first, self.second):
            if bound < floor or (limit is not None and met >= limit):
                break
            if not self.index.rows[i, j] or (i, j) in skip:
                continue
            if any(self.upper[i, j] >= low and self.lower[i, j] <= high for low, high in windows):
                out.append((i, j))
                met += int(self.index.rows[i, j])
        return out


@dataclass
class Search:
    """What a round looks for.

    Of same-label rows the best `count`, or of different-label rows the best `count` in each of an anchor's windows.
    """

    index: Index
    same_label: bool
    count: int


_VISITS = "c1 int, c2 int, block int, anchors binary, anchor_ids binary, anchor_labels binary, numbers binary, windows binary"
_FOUND = "anchor long, window int, score long, id long"


def _visits(search: Search, anchors: DataFrame, again: bool) -> DataFrame:
    """Which blocks which anchors meet; anchors are (anchor, id, label, vector, lows, highs, floors).

    Rows: up to ANCHORS anchors of neighbouring cells with the blocks of a cell. The second round (`again`) leaves out
    the cells of the first, which it walks once more to know them.
    """
    index = search.index

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ANCHORS):
                batch = whole.slice(start, ANCHORS)
                matrix = _matrix(batch["vector"], index.dim)
                lows, highs, floors = (batch[c].to_pylist() for c in ("lows", "highs", "floors"))
                asked: dict[tuple[int, int], list[int]] = {}
                for at in range(batch.num_rows):
                    walk = Walk(index, matrix[at])
                    cells = walk.cells(list(zip(lows[at], highs[at], strict=True)), skip=set(), limit=FIRST_ROWS)
                    if again:
                        cells = walk.cells(list(zip(floors[at], highs[at], strict=True)), skip=set(cells))
                    for cell in cells:
                        asked.setdefault(cell, []).append(at)
                yield from _visit_rows(batch, matrix, lows, highs, asked)

    def _visit_rows(batch, matrix, lows, highs, asked) -> Iterator[pa.RecordBatch]:
        ids, labels, numbers = (batch[c].to_numpy() for c in ("id", "label", "anchor"))
        rows = []
        for (i, j), who in asked.items():
            windows = np.array([[*zip(lows[w], highs[w], strict=True)] for w in who], np.int64) if not search.same_label else np.zeros(0, np.int64)
            data = (_pack(matrix[who]), *(x[who].astype("<i8").tobytes() for x in (ids, labels, numbers)), windows.astype("<i8").tobytes())
            rows += [(i, j, block, *data) for block in range(int(index.blocks[i, j]))]
            if len(rows) >= 256:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    def _batch(rows) -> pa.RecordBatch:
        kinds = [pa.int32()] * 3 + [pa.binary()] * 5
        names = [f.split()[0] for f in _VISITS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return anchors.mapInArrow(plan, _VISITS)


class _Best:
    """The best few of each (anchor, window) that a task has met, given out now and then."""

    def __init__(self, count: int):
        self.count, self.parts, self.held = count, [], 0

    def add(self, anchor: np.ndarray, window: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.parts.append((anchor, window, score, ids))
        self.held += len(anchor)

    def take(self) -> list[np.ndarray]:
        """All that is held, cut to the best of each; equal scores by the smaller id."""
        columns = [np.concatenate(c) for c in zip(*self.parts, strict=True)] if self.parts else [np.zeros(0, np.int64)] * 4
        anchor, window, score, ids = columns
        order = np.lexsort((ids, -score, window, anchor))
        anchor, window, score, ids = (c[order] for c in (anchor, window, score, ids))
        fresh = np.ones(len(anchor), bool)
        fresh[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1])
        starts = np.flatnonzero(fresh)
        place = np.arange(len(anchor)) - np.repeat(starts, np.diff(np.append(starts, len(anchor))))
        kept = place < self.count
        self.parts = [(anchor[kept], window[kept], score[kept], ids[kept])]
        self.held = int(kept.sum())
        return list(self.parts[0])


def _meet(search: Search, visits: DataFrame, blocks: DataFrame) -> DataFrame:
    """The best of each anchor and window among the blocks it visits: (anchor, window, score, id)."""
    dim, count = search.index.dim, search.count

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, last, rows = _Best(count), None, None
        for batch in batches:
            for at in range(batch.num_rows):
                place = tuple(batch[c][at].as_py() for c in ("c1", "c2", "block"))
                if place != last:
                    last = place
                    rows = (_unpack(batch["vectors"][at].as_py(), dim), *(np.frombuffer(batch[c][at].as_py(), "<i8") for c in ("ids", "labels")))
                _one(batch, at, rows, best)
                if best.held > HELD:
                    best.take()
                    if best.held > HELD // 2:
                        yield _given(best)
        if best.parts:
            yield _given(best)

    def _one(batch, at, rows, best) -> None:
        vectors, ids, labels = rows
        anchors = _unpack(batch["anchors"][at].as_py(), dim)
        own, own_labels, numbers = (np.frombuffer(batch[c][at].as_py(), "<i8") for c in ("anchor_ids", "anchor_labels", "numbers"))
        table = scores(anchors, vectors)
        same = own_labels[:, None] == labels[None, :]
        if search.same_label:
            _few(best, numbers, 0, table, same & (own[:, None] != ids[None, :]), ids, count)
            return
        windows = np.frombuffer(batch["windows"][at].as_py(), "<i8").reshape(len(numbers), -1, 2)
        for w in range(windows.shape[1]):
            _few(best, numbers, w, table, ~same & (table >= windows[:, w, :1]) & (table <= windows[:, w, 1:]), ids, count)

    def _few(best, numbers, window, table, fits, ids, count) -> None:
        """Of each row of the table the best `count` that fit; equal scores by the smaller id."""
        for at in np.flatnonzero(fits.any(axis=1)):
            which = np.flatnonzero(fits[at])
            if len(which) > count:
                least = np.partition(table[at, which], len(which) - count)[len(which) - count]
                which = which[table[at, which] >= least]
                which = which[np.lexsort((ids[which], -table[at, which]))[:count]]
            best.add(np.full(len(which), numbers[at]), np.full(len(which), window, np.int64), table[at, which], ids[which])

    def _given(best) -> pa.RecordBatch:
        anchor, window, score_, ids = best.take()
        best.parts, best.held = [], 0
        return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(window.astype(np.int32)), pa.array(score_), pa.array(ids)], names=["anchor", "window", "score", "id"])

    # visits come from few anchors but name every block these meet: their estimate is far too low to broadcast by
    met = visits.hint("merge").join(blocks, ["c1", "c2", "block"])
    return met.mapInArrow(score, _FOUND)


def _best(found: DataFrame, count: int) -> DataFrame:
    """The best `count` of each anchor and window, numbered from 1; a task sends no more than that of each."""
    w = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= count)


def _search(search: Search, anchors: DataFrame, blocks: DataFrame) -> DataFrame:
    """Both rounds of a search over anchors (anchor, id, label, vector, c1, c2, lows, highs)."""
    every = anchors.withColumn("floors", F.col("lows"))
    first = materialize(_best(_meet(search, _visits(search, every, False), blocks), search.count), "first-round")
    # a full window's last score is a floor: nothing below can enter; equal scores may, by a smaller id
    full = first.where(F.col("rank") == search.count).select("anchor", F.struct("window", "score").alias("f"))
    floors = full.groupBy("anchor").agg(F.map_from_entries(F.collect_list("f")).alias("known"))  # as many as windows
    raised = F.transform("lows", lambda low, w: F.greatest(low, F.coalesce(F.try_element_at(F.col("known"), w), low)))
    later = anchors.join(floors, "anchor", "left").withColumn("known", F.coalesce("known", F.expr("cast(map() as map<int, long>)")))
    later = _laid(later.withColumn("floors", raised).drop("known"))
    second = _meet(search, _visits(search, later, True), blocks)
    columns = ["anchor", "window", "score", "id"]
    return materialize(_best(first.select(columns).unionByName(second.select(columns)), search.count), "second-round")


def _laid(anchors: DataFrame) -> DataFrame:
    """Anchors of neighbouring cells side by side, so that those of one batch visit much the same cells."""
    return anchors.repartitionByRange("c1", "c2", "anchor").sortWithinPartitions("c1", "c2", "anchor")


def mine(
    vectors: DataFrame, anchors: Column, *, positives: int = 5, negatives: int = 3, low: tuple[int, int] = (50, 100), high: tuple[int, int] = (95, 100),
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """For each anchor its positives, and for each of these the hardest negatives of a window of scores.

    Anchors are the rows whose `id` fulfils the condition. A row's score is its integer inner product with the anchor,
    components x counting as floor(256 * x); higher scores come first, equal ones by smaller id. An anchor's positives
    are its best rows of the same label and another id. Negatives have another label and a score n that with the
    positive's score p fulfils low[0] * p <= low[1] * n and high[1] * n <= high[0] * p. Returns (anchor_id, positive_id,
    rank, negative_id, positive_score, negative_score).

    Rows with a null id, label or vector, or a null, infinite or not-a-number component, take no part, nor do rows longer
    than `LONGEST`, whose scores don't fit. Shorter vectors are filled up with 0. Repeated rows count once; rows that
    share an id but not their content are rows of their own, and such anchors have results each. An empty table has no
    results; columns that are not named don't count.
    """
    spark = vectors.sparkSession
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = materialize(clean(vectors, id_col, label_col, vector_col), "vectors")
    built = build_index(rows)
    if built is None:
        return spark.createDataFrame([], result)
    index, blocks, placed = built
    own = placed.where(anchors).withColumn("anchor", F.monotonically_increasing_id()).withColumns({"lows": F.array(F.lit(-_FAR)), "highs": F.array(F.lit(_FAR))})
    own = materialize(_laid(own.select("anchor", "id", "label", "vector", "c1", "c2", "lows", "highs")), "anchors")
    near = _search(Search(index, True, positives), own, blocks)

    # the window of each positive; a negative score has none
    bounds = near.where("score >= 0").select(
        "anchor", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
        F.struct(F.expr(f"(score * {low[0]} + {low[1] - 1}) div {low[1]} AS least"), F.expr(f"(score * {high[0]}) div {high[1]} AS greatest")).alias("bounds"),
    )
    known = bounds.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("window", "bounds"))).alias("known"))  # as many as positives

    def filled(name: str, missing: int) -> Column:
        """An anchor's bounds of all windows; a window that it lacks holds nothing."""
        return F.array(*(F.coalesce(F.try_element_at("known", F.lit(i))[name], F.lit(missing)) for i in range(positives)))

    asked = own.drop("lows", "highs").join(known, "anchor").withColumns({"lows": filled("least", _FAR), "highs": filled("greatest", -_FAR)}).drop("known")
    found = _search(Search(index, False, negatives), _laid(asked), blocks)
    named = bounds.join(own.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    return found.join(named, ["anchor", "window"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )
