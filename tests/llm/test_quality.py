"""The quality classifier: held-out accuracy, sums against a plain dot product, and odd inputs."""

import math
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import quality as Q
from tidemark.llm.words import MARKED, words

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def auc(pairs):
    ranked = sorted(pairs)
    ranks = {}
    for k, (s, _) in enumerate(ranked):
        ranks.setdefault(s, []).append(k + 1)
    good = [np.mean(ranks[s]) for s, y in ranked if y]
    n, m = len(good), len(ranked) - len(good)
    return (sum(good) - n * (n + 1) / 2) / (n * m)


def test_held_out_rows_are_told_apart(spark, tables):
    docs, labels = tables
    rows = {r["doc_id"]: r for r in Q.classify(docs, labels).collect()}
    assert len(rows) == docs.count()
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    told = [(rows[r["doc_id"]], r["quality"]) for r in labels.collect()]
    held = [(r, y) for r, y in told if r["held_out"]]
    assert auc([(r["score"], y) for r, y in held]) > 0.99
    assert np.mean([r["predicted"] == y for r, y in held]) > 0.97
    clean = [r["predicted"] for r, y in held if y]
    assert np.mean(clean) > 0.95


def test_held_out_labels_change_nothing(spark, tables):
    docs, labels = tables
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(Q.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (dict(Q.classify(docs, x).select("doc_id", "score").collect()) for x in (labels, turned))
    assert a == b


def test_score_is_a_sparse_dot_product():
    rnd = np.random.default_rng(1)
    model = Q.Model(rnd.normal(size=1 << Q.BITS).astype("f4"), 0.25)
    texts = ["", None, "one two one", "a", "!! x !!"]
    found = list(words(pa.array(texts), MARKED))
    got = np.concatenate([Q.scores(f, model) for f in found])
    for f in found:
        for i, (slots, values) in enumerate(zip(*Q._rows(f), strict=True)):
            dot = sum(float(model.weights[s]) * v for s, v in zip(slots[:-1], values[:-1], strict=True)) + model.bias
            assert got[f.low + i] == pytest.approx(1 / (1 + np.exp(-dot)))
    assert got[0] == got[1] == pytest.approx(1 / (1 + np.exp(-0.25)))


def test_odd_inputs(spark):
    schema = "doc_id long, text string, score string, label int, _text int"
    docs = spark.createDataFrame([(1, "good text here", "x", 1, 1), (2, None, "x", 1, 1), (None, "", "x", 1, 1), (1, "good text here", "x", 1, 1)], schema)
    labels = "doc_id long, quality int, toxic int"
    none = Q.classify(docs, spark.createDataFrame([], labels)).collect()
    assert len(none) == 4 and {r["score"] for r in none} == {0.5}
    rows = Q.classify(docs, spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, 0), (None, 1, 0), (3, 0, 0)], labels)).collect()
    assert len(rows) == 4 and len({r["score"] for r in rows if r["doc_id"] == 1}) == 1
    assert Q.classify(docs.limit(0), spark.createDataFrame([(1, 1, 0)], labels)).collect() == []


def test_the_leaders_update():
    """One shard against the update written out, slot by slot."""
    rnd = np.random.default_rng(3)
    bias = 1 << Q.BITS
    slots = [np.append(np.sort(rnd.choice(40, size=rnd.integers(1, 6), replace=False)), bias) for _ in range(60)]
    values = [np.append(3 * rnd.random(len(s) - 1), 1.0) for s in slots]
    labels = rnd.integers(0, 2, 60).astype(float)
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= Q.L1 else -(z[i] - math.copysign(Q.L1, z[i])) / ((Q.BETA + math.sqrt(n[i])) / Q.ALPHA + Q.L2)

    for _ in range(3):
        for at, x, y in zip(slots, values, labels, strict=True):
            own = {i: weight(i) for i in at}
            p = 1 / (1 + math.exp(-sum(own[i] * v for i, v in zip(at, x, strict=True))))
            for i, v in zip(at, x, strict=True):
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / Q.ALPHA * own[i]
                n[i] += g * g
    weights, found = Q.fit_shard(slots, values, labels, epochs=3)
    assert found == pytest.approx(weight(bias)) and any(weights)
    assert {i: weights[i] for i in np.flatnonzero(weights)} == pytest.approx({i: weight(i) for i in list(z) if i != bias and weight(i)})
