"""The Jaccard join and its components against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import jaccard
from tidemark.llm.components import components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def closure(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def expected(rows):
    sets = [shingles(t) for _, t in rows]
    pairs = [
        (i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    ]
    groups = closure(pairs, range(len(rows)))
    least = {}
    for n, g in groups.items():
        if rows[n][0] is not None:
            least[g] = min(least.get(g, rows[n][0]), rows[n][0])
    return sorted((str(i), len(s), str(least.get(groups[n], i))) for n, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


def edited(rnd, words, share):
    out = []
    for w in words:
        x = rnd.random()
        out += [] if x < share / 3 else [w, f"n{rnd.randrange(10**6)}"] if x < share * 2 / 3 else [f"r{rnd.randrange(10**6)}"] if x < share else [w]
    return out


def corpus(seed):
    """Families of edited texts around the threshold, chains of edits, passages that many share, short texts, copies."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rnd.choices(vocabulary, k=60)
    texts = [None, "", "  \n ", "one", "One", "one two", "a b c d", "A b  c\td", "a b c d e", "a b c d e f"]
    for _ in range(14):
        base = rnd.choices(vocabulary, k=rnd.choice([5, 7, 9, 14, 30, 80, 200, 700]))
        texts.append(" ".join(base))
        chain = base
        for k in range(8):
            texts.append(" ".join(edited(rnd, base, rnd.choice([0.005, 0.02, 0.04, 0.06]))))
            chain = edited(rnd, chain, 0.02)
            texts.append(" ".join(chain) + " " * k)
            texts.append(" ".join(base[: rnd.randint(int(0.75 * len(base)), len(base))]))
    for _ in range(60):
        own = rnd.choices(vocabulary, k=rnd.choice([20, 60, 150]))
        at = rnd.randrange(len(own))
        texts.append(" ".join(own[:at] + passage + own[at:]))
    rows = [(3 * i + 5, t) for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    return rows + [(rows[0][0], rows[0][1]), (None, rows[1][1]), (None, "only here " * 5), (1, rows[2][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, name string, size int").repartition(5)
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.near_duplicates(docs).collect())
    assert got == expected(rows)


def test_no_rows_and_no_links(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(1, "a b c d e f g"), (2, "h i j k l m n"), (3, None)]
    assert sorted(map(tuple, jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == [(1, 3, 1), (2, 3, 2), (3, 0, 3)]


def look_ups_by_set(texts):
    sets = next(jaccard.shingle_sets(pa.array(texts)))
    sign, row, extra = jaccard.look_ups(sets)
    out = {}
    for s, r, e in zip(sign.tolist(), row.tolist(), extra.tolist(), strict=True):
        own = out.setdefault((r, e & 255), [set(), (e >> 8) & 0xFFFFFF])
        own[0].add(s)
    return out


@pytest.mark.parametrize("words", [4, 6, 8, 12, 25, 60, 150, 400, 1500])
def test_partners_share_as_many_look_ups_as_promised(words):
    """Pigeonhole, for pairs as far apart as a link allows: no pair may share fewer look-ups than both sets count on."""
    rnd, linked = random.Random(words), 0
    for _ in range(60):
        base = [f"w{rnd.randrange(10**9)}" for _ in range(words)]
        other = edited(rnd, base, rnd.choice([0.01, 0.02, 0.04])) if rnd.random() < 0.6 else base[rnd.randrange(max(1, words // 5)) :]
        a, b = shingles(" ".join(base)), shingles(" ".join(other))
        if a == b or 100 * len(a & b) < 80 * len(a | b):
            continue
        linked += 1
        found = look_ups_by_set([" ".join(base), " ".join(other)])
        assert any(
            len(found[0, band][0] & found[1, band][0]) >= max(found[0, band][1], found[1, band][1]) for _, band in found if (0, band) in found and (1, band) in found
        )
    assert linked or words < 9


def test_band_limits():
    begins, bands = jaccard.bands()
    assert all(b.end == after.begin for b, after in zip(bands, bands[1:], strict=False))
    for size in [*range(1, 300), 5000, 10**6]:
        for other in range(size, min(size + 100, 2 * size)):
            both = (PERCENT * (size + other) + 99 + PERCENT) // (100 + PERCENT)
            if both <= size and 100 * both >= PERCENT * (size + other - both) and both < other:
                band = bands[np.searchsorted(begins, other, "right") - 1]
                assert size + other - 2 * both <= band.differ


PERCENT = jaccard.PERCENT


def test_components(spark):
    rnd = random.Random(4)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 2000 + i) for i in range(40)] + [(9000, 9000)]
    rnd.shuffle(pairs)
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == closure(pairs, {n for p in pairs for n in p})
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_empty_texts_after_many_sets(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "REMEMBERED", 3)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    texts = [f"w{i} x{i} y{i} z{i} a{i} b{i}" for i in range(40)] + [None, "", " ", "w0 x0 y0 z0 a0 b0"]
    spark.conf.set(batch, "10")
    try:
        rows = jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()
    finally:
        spark.conf.set(batch, before)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == {i: (2 if t and t.strip() else 0, 0 if i == 43 else i) for i, t in enumerate(texts)}
