"""The stages against plain versions, each on its own input, and the whole."""

import re
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from tidemark.llm import quality
from test_decontaminate import expected as hits
from test_jaccard import expected as groups
from test_packing import gapless
from test_scans import plain_pii

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score int, pii int, _key int"


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage got and gave, on the small tables."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "out")
        stage(spark, docs, SF).write.parquet(path)
        out[name] = (docs, docs := spark.read.parquet(path))
    return out


def test_columns(spark, stages):
    told = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert [len(P.STAGES), *(out.columns == told for _, out in list(stages.values())[:-1])] == [5, True, True, True, True]


def test_quality(spark, stages):
    given, kept = stages["quality classifier"]
    model = quality.fit_labelled(given, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = quality.score(given, model, keep=["doc_id"]).collect()
    assert {i for i, _ in rows_of(kept)} == {r["doc_id"] for r in scores if r["score"] >= 0.7}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = Counter(labels.get(i) for i, _ in rows_of(kept))
    assert left[1] > 0.95 * sum(labels.values()) and left[0] < 0.3 * (len(labels) - sum(labels.values()))


def test_near_duplicates(stages):
    given, kept = (rows_of(d) for d in stages["n-gram Jaccard join"])
    assert sorted(str(i) for i, _ in kept) == sorted(i for i, _, group in groups(given) if i == group)


def test_decontamination(spark, stages):
    given, kept = (rows_of(d) for d in stages["benchmark decontamination"])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(str(i) for i, _ in kept) == sorted(i for i, _, n, _ in hits(given, items) if not n)


def test_personal_data(stages):
    given, kept = (dict(rows_of(d)) for d in stages["PII"])
    assert given.keys() == kept.keys()
    for i, text in given.items():
        spans = plain_pii(text)
        if not spans:
            assert re.fullmatch(r"(?s).*\[[A-Z_]+\].*", kept[i]) or kept[i] == text
        for start, _, end, _ in spans:
            assert text[start:end] not in kept[i]
    assert all(r["n_chars"] == len(r["text"]) for r in stages["PII"][1].collect())


def test_packing(stages):
    given, packed = stages["best-fit packing"]
    rows = packed.collect()
    gapless(rows, 1024)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    told = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows_of(given)}
    got = Counter()
    for r in rows:
        got[r["doc_id"]] += r["length"]
    assert got == told


def test_run_is_the_stages(spark, stages):
    told = stages["best-fit packing"][1]
    own = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, P.run(spark, SF).select(own).collect())) == sorted(map(tuple, told.select(own).collect()))


ODD = [
    (1, None, "en", "a", 0, 1, 1, 1), (2, "", "en", "a", 0, 1, 1, 1), (3, "one two three four five six", None, None, None, 1, 1, 1), (3, "one two three four five six", None, None, None, 1, 1, 1),
    (3, "another text under the same id here", "en", "a", 1, 1, 1, 1), (None, "no id a@b.c", "en", "a", 1, 1, 1, 1), (5, "One TWO three four five six", "en", "a", 1, 1, 1, 1), (6, "word " * 30_000, "en", "a", 1, 1, 1, 1),
]


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES])
def test_odd_rows(spark, stage):
    docs = spark.createDataFrame(ODD, SCHEMA)
    for given in (docs, docs.limit(0)):
        out = stage(spark, given, SF)
        assert stage is P.pack or out.columns == docs.columns
        out.collect()
    rows = stage(spark, docs, SF).collect()
    if stage is P.keep_one_of_each_group:
        assert Counter(r["doc_id"] for r in rows) == {1: 1, 2: 1, 3: 2, None: 1, 6: 1}
    elif stage is P.hide_personal_data:
        assert [r["text"] for r in rows if r["doc_id"] is None] == ["no id [EMAIL]"] and len(rows) == len(ODD)
    elif stage is P.keep_clean:
        assert len(rows) == len(ODD)


def test_rows_that_share_an_id_lose_no_text(spark):
    a = " ".join(f"alpha{i}" for i in range(40))
    b = a.replace("alpha", "beta")
    rows = [(5, a), (5, b), (9, a + " end"), (3, b + " end"), (7, a + " end"), (7, ""), (7, "a b c d e f lone"), (8, a), (8, a), (2, "x y z"), (2, "X  y z"), (2, None), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 0, 0, 0) for i, t in rows], SCHEMA).repartition(3)
    kept = Counter((r["doc_id"], (r["text"] or "").lower().replace("  ", " ")) for r in P.keep_one_of_each_group(spark, docs, SF).collect())
    assert kept == Counter([(5, a), (3, b + " end"), (7, ""), (7, "a b c d e f lone"), (2, "x y z"), (2, ""), (None, a)])


def test_clean_rows_stay_beside_others_of_their_id(spark):
    item = next(r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(r["text"].split()) > 20)
    rows = [(1, item), (1, "nothing of it here"), (2, item), (2, item), (3, "clean"), (3, None), (None, item), (None, "no id")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 0, 0, 0) for i, t in rows], SCHEMA).repartition(3)
    kept = sorted(((r["doc_id"], r["text"]) for r in P.keep_clean(spark, docs, SF).collect()), key=repr)
    assert kept == sorted([(1, "nothing of it here"), (3, "clean"), (3, None), (None, "no id")], key=repr)
