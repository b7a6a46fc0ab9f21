"""Phrase and proximity search against brute force."""

import random
import re
from collections import Counter

import pytest

from tidemark.llm import decontaminate as D


def word_list(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected(docs, items):
    out = []
    for i, text in docs:
        words, hit, ids = word_list(text), set(), set()
        for item_id, item in items:
            own = word_list(item)
            n = min(10, len(own))
            windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else set()
            for k in range(len(words) - n + 1 if n else 0):
                if tuple(words[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    ids |= {str(item_id)} if item_id is not None else set()
        out.append((str(i), len(words), len(hit), tuple(sorted(ids))))
    return Counter(out)


def tables(seed):
    rnd = random.Random(seed)
    vocabulary = ["the", "of", "A", "and", *[f"w{i}" for i in range(30)], "é", "Ünder", "x_y", "don't"]
    items = [(k, " ".join(rnd.choices(vocabulary, k=rnd.choice([0, 1, 2, 9, 10, 11, 30])))) for k in range(25)]
    items += [(3, items[5][1]), (None, " ".join(rnd.choices(vocabulary, k=12))), (99, None), (100, "the the the the the the the the the the the the")]
    docs = [(1, None), (2, ""), (3, "the " * 40), (4, "-- ,, !"), (None, items[6][1])]
    for i in range(5, 120):
        parts = rnd.choices(vocabulary, k=rnd.choice([0, 5, 40, 200]))
        for _ in range(rnd.choice([0, 0, 1, 2])):
            own = (rnd.choice(items)[1] or "").upper().split()
            at, low = rnd.randrange(len(parts) + 1), rnd.randrange(len(own) + 1)
            parts[at:at] = own[low : low + rnd.choice([5, 10, 12, 30])]
        docs.append((i, rnd.choice([" ", ", ", "\n"]).join(parts)))
    return [*docs, docs[20], docs[20]], items


@pytest.mark.parametrize(("seed", "shard", "slice_words"), [(1, 1 << 20, 1_000_000), (2, 300, 1_000_000), (3, 300, 200)])
def test_exact_phrases(spark, monkeypatch, seed, shard, slice_words):
    monkeypatch.setattr(D, "SHARD_BYTES", shard)
    monkeypatch.setattr(D, "SLICE_WORDS", slice_words)
    docs, items = tables(seed)
    found = D.decontaminate(
        spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, terms string, row_id int").repartition(3),
        spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, spans string"),
    ).collect()
    assert Counter((str(r["doc_id"]), r["n_words"], r["n_hit"], tuple(r["items"])) for r in found) == expected(docs, items)
    assert any(r["n_hit"] for r in found) and not all(r["n_hit"] for r in found)


def test_no_documents_or_items(spark):
    empty = "doc_id long, text string"
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert D.decontaminate(spark.createDataFrame([], empty), items).collect() == []
    docs = spark.createDataFrame([(1, "a b c")], empty)
    row = D.decontaminate(docs, items.limit(0)).first()
    assert (row["n_words"], row["n_hit"], row["items"]) == (3, 0, [])


def test_rarest_term_comes_first():
    wanted = D.phrases(["the of rare", "the the"], 3)
    counts = {t: n for t, n in zip(D.phrases(["the"], 1).terms[0].view("i8").tolist() + D.phrases(["of"], 1).terms[0].view("i8").tolist(), (50, 20), strict=True)}
    order = D._rarest_first(wanted, counts)
    long = int(wanted.length.argmax())
    assert order[long].tolist() == [2, 1, 0]


def test_proximity(spark):
    docs = [(1, "alpha x x beta"), (2, "alpha x x x x beta"), (3, "beta alpha alpha"), (4, "alpha"), (5, None), (6, "beta")]
    got = dict(map(tuple, D.proximity(spark.createDataFrame(docs, "doc_id long, text string"), ["alpha", "Beta"], 3).collect()))
    assert set(got) == {1, 3}
    # what is found in a document doesn't hang on others beside it
    one = [(7, "a x x b x x c"), (8, "c x a b b x"), (9, "a b x"), (10, "x c")]
    for others in ([], [(20, "a " * 50)], [(20, "c " * 50)], [(20, "b " * 50)]):
        df = spark.createDataFrame(one + others, "doc_id long, text string").coalesce(1)
        assert dict(map(tuple, D.proximity(df, ["a", "b", "c"], 3).collect())) == {8: 1}
        assert dict(map(tuple, D.proximity(df, ["a", "b", "c"], 6).collect())) == {7: 1, 8: 1}
