"""Hard negatives against all pairs in plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hardneg
from tidemark.llm.hardneg import Walk, build_index, clean, mine, multi_sequence, scores
from tidemark.operators.ordered import plan_bytes

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, every, positives, negatives):
    whole = set()
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.add((i, label, tuple(math.floor(float(np.float32(x)) * 256) for x in v)))
    out = []
    for i, label, v in whole:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in whole)
        for p, j, other in [s for s in scored if s[2] == label and s[1] != i][:positives]:
            hard = [s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p][:negatives]
            out += [(i, j, rank, n, -p, -s) for rank, (s, n, _) in enumerate(hard, 1)]
    return sorted(out)


def result(df):
    return sorted(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def odd_rows(seed, n=400, dim=6):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 0.5) for _ in range(dim)] for _ in range(5)]
    rows = []
    for i in range(n):
        centre = rnd.choice([*centres, centres[0], centres[0]])
        v = [round(c + rnd.gauss(0, 0.05), 2) for c in centre]
        rows.append((i, rnd.randrange(3), v))
    rows += [(i, rnd.randrange(3), centres[1]) for i in range(n, n + 120)]  # ties
    rows += rows[:7] + rows[:1]  # repeated rows
    nan, inf = float("nan"), float("inf")
    rows += [(None, 1, centres[0]), (2000, None, centres[0]), (2010, 1, None), (2020, 1, [None] * dim), (2030, 1, [nan] * dim), (2040, 1, [inf] + [0.0] * (dim - 1)), (2050, 1, [-inf] * dim)]
    rows += [(2060, 1, []), (2070, 2, [0.5]), (2080, 0, [0.5] * (dim + 3)), (-10, 1, centres[2]), (30, 2, centres[3])]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(hardneg, "CELL_ROWS", 20)
    monkeypatch.setattr(hardneg, "BLOCK_ROWS", 16)
    monkeypatch.setattr(hardneg, "FIRST_ROWS", 30)
    rows = odd_rows(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    extra = df.select("*", *(F.lit("z").alias(c) for c in ("id", "vector", "anchor", "c1", "c2", "block", "rank", "score")))
    assert result(mine(extra, F.col("id") % 10 == 0, positives=4, negatives=3)) == brute(rows, 10, 4, 3)


def test_no_rows_and_no_anchors(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mine(none, F.col("id") % 10 == 0).collect() == []
    one = spark.createDataFrame([(3, 1, [0.5, 0.5]), (4, 2, [0.5, 0.25])], SCHEMA)
    assert mine(one, F.col("id") % 10 == 0).collect() == []


def test_every_row_is_in_one_block(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "CELL_ROWS", 20)
    monkeypatch.setattr(hardneg, "BLOCK_ROWS", 16)
    rows = clean(spark.createDataFrame(odd_rows(3), SCHEMA), "vec_id", "label", "embedding")
    index, blocks, _ = build_index(rows)
    ids = [i for b in blocks.collect() for i in np.frombuffer(b.ids, "<i8").tolist()]
    assert sorted(ids) == sorted(r.id for r in rows.collect()) and index.rows.sum() == len(ids)


def test_sequence_falls_and_is_whole():
    rnd = np.random.default_rng(1)
    a, b = rnd.normal(size=9), rnd.normal(size=7)
    walked = list(multi_sequence(a, b))
    assert [w[0] for w in walked] == sorted((w[0] for w in walked), reverse=True)
    assert {(i, j) for _, i, j in walked} == {(i, j) for i in range(9) for j in range(7)}
    assert all(abs(total - a[i] - b[j]) < 1e-12 for total, i, j in walked)


def test_bounds_hold(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "CELL_ROWS", 10)
    rows = clean(spark.createDataFrame(odd_rows(4), SCHEMA), "vec_id", "label", "embedding")
    index, _, placed = build_index(rows)
    own = placed.collect()
    vectors = np.zeros((len(own), index.dim), np.int64)
    for at, r in enumerate(own):
        vectors[at, : len(r.vector)] = r.vector
    table = scores(vectors[:20], vectors)
    for at in range(20):
        walk = Walk(index, vectors[at])
        for to, r in enumerate(own):
            assert walk.lower[r.c1, r.c2] <= table[at, to] <= walk.upper[r.c1, r.c2] <= walk.first[r.c1] + walk.second[r.c2] + 1e-6
        # walking to a floor meets every cell that holds a score above it
        floor = int(np.sort(table[at])[-5])
        met = set(walk.cells([(floor, 2**62)], skip=set()))
        assert {(r.c1, r.c2) for to, r in enumerate(own) if table[at, to] >= floor} <= met
        assert len(walk.cells([(floor, 2**62)], skip=set(), limit=1)) <= 1


@pytest.mark.parametrize("same_label", [True, False])
def test_visits_are_never_broadcast(spark, same_label):
    rows = clean(spark.createDataFrame(odd_rows(5), SCHEMA), "vec_id", "label", "embedding")
    index, blocks, placed = build_index(rows)
    far = F.array(F.lit(-(2**62))), F.array(F.lit(2**62))
    anchors = placed.where("id = 0").select(F.lit(0).cast("long").alias("anchor"), "id", "label", "vector", far[0].alias("lows"), far[1].alias("highs"), far[0].alias("floors"))
    search = hardneg.Search(index, same_label, 3)
    visits = hardneg._visits(search, anchors, False)
    # by their estimate both sides would be sent to the driver, however many blocks each anchor meets
    assert max(map(plan_bytes, (visits, blocks))) < int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b"))
    met = hardneg._meet(search, visits, blocks)
    assert met.count() == 3
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_large_components_are_exact():
    b = np.array([[2**27, 1], [2**27 - 1, 2**26 + 1]], np.int64)
    assert scores(b, b).tolist() == [[x * x2 + y * y2 for x2, y2 in b.tolist()] for x, y in b.tolist()]
