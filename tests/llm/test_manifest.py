"""The Merkle manifest against a tree built in plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm.manifest import fold, leaf_digest, manifest, proof_digest
from tidemark.llm.numbered import numbered

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """The last node, and for each first node its siblings: (left, right) of each level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for path, i in zip(paths, at, strict=True):
            run = runs[i // 16]
            path.append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
        at = [i // 16 for i in at]
        nodes = [sha("".join(run)) for run in runs]
    return nodes[0], paths


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tops, out = [], []
    for source in order:
        own = sorted(groups[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        tops.append((climb([leaf(r) for r in own]), own))
    root, above = climb([top for (top, _), _ in tops]) if tops else (None, [])
    for ((top, paths), own), up in zip(tops, above, strict=True):
        out += [(r[0], leaf(r), tuple(path + up), top, root) for r, path in zip(own, paths, strict=True)]
    return sorted(out, key=repr)


def result(df):
    return sorted(((r[0], r.leaf, tuple((s.left, s.right) for s in r.path), r.subroot, r.root) for r in df.collect()), key=repr)


def odd_rows():
    rnd = random.Random(5)
    rows = [(i, "hot", "en", i % 50, f"Text {i}") for i in range(300)]
    rows += [(1000 + i, f"s{i % 20}", rnd.choice(["de", None]), None, rnd.choice([None, "", "Ä" * 5000, "A b"])) for i in range(60)]
    rows += [(5000 + i, None, "en", 3, "none") for i in range(17)]
    rows += [(None, "hot", None, None, None), (None, "hot", None, None, "x"), (7, "hot", "en", 7, "Text 7"), (7, "hot", "en", 7, "Text 7"), (9, "", "", 0, ""), (-3, "Ärger", "en", 1, "y")]
    rnd.shuffle(rows)
    return rows


def test_against_plain(spark):
    rows = odd_rows()
    assert result(manifest(spark.createDataFrame(rows, SCHEMA).repartition(7))) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 17, 257])
def test_sizes(spark, n):
    rows = [(i, "one", "en", 1, str(i)) for i in range(n)]
    assert result(manifest(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_proofs_show_what_was_changed(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    found = manifest(df, also={"offered": leaf_digest([*fields, F.concat("text", F.lit("!"))]), "known": F.col("text").isNotNull()})
    kept = found.select(fold(F.col("leaf"), F.col("path")).alias("own"), fold(F.col("offered"), F.col("path")).alias("other"), "root", "known", proof_digest(F.col("path")).alias("proof"), "path").collect()
    assert len(kept) == len(rows)
    for r in kept:
        assert r.own == r.root and (r.other == r.root) is (not r.known)
        assert r.proof == sha("".join(s.left + s.right for s in r.path))


def test_clashing_columns_do_not_count(spark):
    rows = odd_rows()[:40]
    df = spark.createDataFrame(rows, SCHEMA)
    extra = df.select("*", *(F.lit("z").alias(c) for c in ("digest", "pos", "n", "path", "s0", "root", "leaf", "_row", "_order", "in_group")))
    assert result(manifest(extra)) == brute(rows)


def test_numbers_are_gapless_in_every_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 40).alias("g"), F.hash("id").alias("v"), "id")
    rows = numbered(df, ["g"], ["v", "id"]).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.g, []).append(r)
    for own in groups.values():
        own.sort(key=lambda r: (r.v, r.id))
        assert [r.pos for r in own] == list(range(len(own))) and {r.n for r in own} == {len(own)}
