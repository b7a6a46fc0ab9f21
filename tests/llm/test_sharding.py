"""K-d shards against a tree built in plain Python, and their sizes."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm.sharding import OVERHEAD, kd_shards, kd_tree, text_number

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def plain_cuts(rows, shards):
    """Sets of ties by shard; rows are (dims, tie, size). Each cut is at the place nearest to its share of the bytes."""
    spans = [max(1, max(r[0][d] for r in rows) - min(r[0][d] for r in rows)) for d in range(len(rows[0][0]))]
    out = {}

    def go(own, first, k):
        if k == 1 or not own:
            out[first] = {r[1] for r in own}
            return
        widths = [(max(r[0][d] for r in own) - min(r[0][d] for r in own)) / spans[d] for d in range(len(spans))]
        dim = widths.index(max(widths))
        own, left = sorted(own, key=lambda r: (r[0][dim], r[1])), k // 2
        target, below, at = sum(r[2] for r in own) * left / k, 0, 0
        while below + own[at][2] < target:
            below += own[at][2]
            at += 1
        if below + own[at][2] - target <= target - below:
            at += 1
        go(own[:at], first, left)
        go(own[at:], first + left, k - left)

    go(rows, 0, shards)
    return {first: ties for first, ties in out.items() if ties}


@pytest.mark.parametrize(("seed", "shards"), [(1, 7), (2, 13)])
def test_cuts_are_exact_where_rows_are_large(spark, seed, shards):
    # few rows for each shard, so every row is above the tolerance and each cut is exact
    rnd = random.Random(seed)
    rows = [((rnd.choice([1, 1, 1, 5, 9]), rnd.randint(-(10**12), 10**12), 3), tie, rnd.choice([16, 16, 500, 9000])) for tie in range(150)]
    df = spark.createDataFrame([(*r[0], r[1], r[2]) for r in rows], "a long, b long, c long, tie long, size long")
    from tidemark.llm.sharding import _place

    tree = kd_tree(df, shards, ["a", "b", "c"])
    found = {}
    for r in df.select("tie", _place(tree, ["a", "b", "c"]).alias("shard")).collect():
        found.setdefault(r.shard, set()).add(r.tie)
    assert found == plain_cuts(rows, shards)


def test_sizes_are_near_equal_and_slots_gapless(spark):
    rnd = random.Random(4)
    texts = ["copy " * 40] * 1500 + ["x" * rnd.randint(0, 300) for _ in range(3000)] + [None, "", "Ä" * 20000]
    rows = [(rnd.randint(0, 4000), rnd.choice(["hot", "hot", "a", None]), rnd.choice(["en", "de", None]), len(t or ""), t) for t in texts]
    rows += [(None, None, None, None, None), rows[0], rows[0]]
    df = spark.createDataFrame(rows, SCHEMA)
    extra = df.select("*", *(F.lit("z").alias(c) for c in ("size", "tie", "shard", "slot", "_id", "dim_id", "pos")))
    got = kd_shards(extra.repartition(5), shards=9).collect()
    assert len(got) == len(rows)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(
        ((r[0], len((r[4] or "").encode()) + OVERHEAD, zlib.crc32((r[4] or "").encode())) for r in rows), key=repr,
    )
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r)
    assert sorted(shards) == list(range(9))
    mean = sum(r.size for r in got) / 9
    for own in shards.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        ids = [r.doc_id for r in sorted(own, key=lambda r: r.slot)]
        assert ids == sorted(ids, key=lambda i: (i is not None, i))
        # the one text of 40 000 bytes is the only row that a cut can miss much by
        assert abs(sum(r.size for r in own) - mean) < 0.02 * mean + 1000 or any(r.size > 40_000 for r in own)


def test_small_and_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert kd_shards(none, shards=40).collect() == []
    rows = [(i, "a", "en", 1, "x") for i in range(3)]
    got = kd_shards(spark.createDataFrame(rows, SCHEMA), shards=40).collect()
    assert sorted(r.doc_id for r in got) == [0, 1, 2] and len({r.shard for r in got}) == 3
    same = spark.createDataFrame([(1, "a", "en", 1, "x")] * 8, SCHEMA)
    got = kd_shards(same, shards=4).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(s, i) for s in range(4) for i in range(2)]


def test_target_bytes_gives_the_number_of_shards(spark):
    df = spark.createDataFrame([(i, "a", "en", 1, "x" * 84) for i in range(50)], SCHEMA)
    got = kd_shards(df, target_bytes=1000).groupBy("shard").agg(F.sum("size").alias("size")).collect()
    assert sorted((r.shard, r.size) for r in got) == [(i, 1000) for i in range(5)]


def test_text_numbers_keep_the_order_of_strings(spark):
    texts = ["", "a", "ab", "abc", "b", "zz", "Ä", "abcdef", "abcdefg"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text_number(F.col("t")).alias("n")).collect()
    by = {r.t: r.n for r in rows}
    ordered = sorted(texts, key=lambda t: t.encode())
    assert [by[t] for t in ordered] == sorted(by[t] for t in ordered) and by["abcdef"] == by["abcdefg"]
