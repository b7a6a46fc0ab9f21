"""Packing against optimal packings of small sets, and on whole tables."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm.packing import pack, pack_documents, pieces, reduce_by_dominance, sequences, solve

PATH = public_tokenizers.path("byte_bpe_50k.json")


def optimum(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for j in {room: j for j, room in enumerate(bins) if room >= items[i]}.values():
            bins[j] -= items[i]
            go(i + 1, bins)
            bins[j] += items[i]
        go(i + 1, [*bins, capacity - items[i]])

    go(0, [])
    return best[0]


def test_reduction_never_costs_a_sequence():
    for seed in range(300):
        rnd = random.Random(seed)
        capacity = rnd.choice([10, 20, 30])
        items = [rnd.randint(1, capacity) for _ in range(rnd.randint(1, 9))]
        fixed, left = reduce_by_dominance(dict(Counter(items)), capacity)
        rest = [w for w, n in left.items() for _ in range(n)]
        best = optimum(items, capacity)
        assert sum(r.times for r in fixed) + (optimum(rest, capacity) if rest else 0) == best, items
        assert sum(r.times for r in solve(dict(Counter(items)), capacity)) <= best + 1


def test_every_piece_once_and_none_too_full():
    for seed in range(60):
        rnd = random.Random(seed)
        capacity = rnd.choice([1, 7, 64, 1024])
        items = [min(capacity, max(1, int(rnd.lognormvariate(rnd.uniform(1, 6), 1)))) for _ in range(rnd.choice([1, 50, 3000]))]
        got = Counter()
        for run in solve(dict(Counter(items)), capacity):
            assert sum(run.lengths) <= capacity and run.times > 0
            for w in run.lengths:
                got[w] += run.times
        assert got == Counter(items)


def test_few_runs_and_close_to_the_bound():
    rnd = random.Random(1)
    items = [max(1, int(rnd.lognormvariate(6.2, 1)) % 1024) for _ in range(200_000)]
    runs = solve(dict(Counter(items)), 1024)
    assert len(runs) < 4000 and sum(r.times for r in runs) <= 1.001 * (-(-sum(items) // 1024))


def gapless(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_documents(spark):
    rnd = random.Random(5)
    rows = [(i, None if i % 50 == 0 else " ".join(rnd.choices(["the", "of", "tion", "erre", "xx"], k=rnd.choice([0, 3, 60, 300, 2500]))), "z") for i in range(300)]
    rows += [(None, "no id", "z"), (7, rows[7][1], "z"), (8, "the " * 40_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(4)
    got = pack_documents(docs, PATH).collect()
    gapless(got, 1024)
    library = Tokenizer.from_file(PATH)
    told = Counter()
    for i, text, _ in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            told[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert told == Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got)
    total = sum(r["length"] for r in got)
    assert len({r["sequence_id"] for r in got}) <= 1.05 * total / 1024


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(1, "the of"), (2, "a b c d"), (3, None)], "doc_id long, text string")
    packed = pack(pieces(docs, PATH, capacity=6, keep_ids=True), 6)
    rows, out = packed.collect(), {r["sequence_id"]: r["ids"] for r in sequences(packed).collect()}
    for r in rows:
        assert out[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]
    assert sum(map(len, out.values())) == sum(r["length"] for r in rows)


def test_one_length_of_many_rows(spark):
    rows = pack(spark.range(5000).selectExpr("id", "300L AS length", "id AS low", "id AS at").repartition(7), 1024).collect()
    assert gapless(rows, 1024) == -(-5000 // 3) and len({r["id"] for r in rows}) == 5000


def test_no_rows_and_bad_lengths(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
    for bad in ("NULL", "0", "1025"):
        with pytest.raises(ValueError, match="1024"):
            pack(spark.range(3).selectExpr("id", f"CAST({bad} AS LONG) AS length"), 1024)
