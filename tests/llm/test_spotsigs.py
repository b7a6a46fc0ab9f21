"""Fingerprints, the next document and the edited text against a plain version; pairs against all pairs."""

import hashlib
import random
from collections import Counter

import pytest

from tidemark.llm import spotsigs as S


def table(seed, n):
    rnd = random.Random(seed)
    words = ["the", "of", "der", "la", *[f"word{i}" for i in range(60)], "été", "🙂x"]
    texts = [" ".join(rnd.choices(words, k=rnd.choice([0, 1, 3, 20, 200]))) for _ in range(n)]
    rows = [(rnd.randrange(10**6), t) for t in texts]
    return rows + [(rows[0][0], "same id"), (None, "no id the word"), (None, None), (rows[1][0], rows[1][1])]


def plain(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        a, b, c = (S.signatures(t) for t in (text, edited, after))
        out.append((str(i), len(text), hashlib.sha256(edited.encode()).hexdigest(), S.written(a), S.written(b), S.likeness(a, b), S.likeness(a, c)))
    return sorted(out)


@pytest.mark.parametrize(("n", "parts"), [(0, 4), (1, 1), (40, 3), (400, 16)])
def test_next_and_edited(spark, n, parts):
    rows = table(n, n) if n > 1 else [(5, "the lone one here now"), (5, None)][:1] * n
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, range string, key int").repartition(parts)
    assert sorted((str(r[0]), *r[1:]) for r in map(tuple, S.with_next(docs).collect())) == plain(rows)


def P(spots, chains=()):
    return S.Print(frozenset(spots), frozenset(chains))


def test_signatures():
    assert S.signatures(None) == S.signatures("") == P(())
    assert [len(S.signatures(t).chains) for t in ("!!!", "one two", "one two three four five")] == [1, 1, 2]
    text = "the red old house of big blue sky and the tall green tree in cold dark water is warm new day"
    assert S.signatures(text) == S.signatures(text.upper()) and len(S.signatures(text).spots) >= S.MIN_SPOTS
    assert not S.signatures(" ".join(f"the a{i} b{i} c{i}" for i in range(S.KEPT_CHAINS))).chains
    assert S.written(P({255, 1})) == "000000000000000100000000000000ff" and S.written(P(())) == "" and S.written(P((), {2})) == ".0000000000000002"


def test_likeness():
    many, few = range(100, 104), range(100, 103)
    assert S.likeness(P(()), P(())) == 1.0 and S.likeness(P((), {1}), P(())) == S.likeness(P({1, 2, 3, 4}), P(())) == 0.0
    assert S.ratio({1, 2, 3}, {2, 3, 4}) == 0.5 and S.ratio({1, 2, 3}, {2, 3, 4}, 0.6) == 0.0 and S.ratio({1}, set(range(9)), 0.5) == 0.0
    # both have spots enough; one has not, then chains count; one has no chains, then spots do
    assert S.likeness(P(many, {1}), P(many, {2})) == 1.0 and S.likeness(P(many, {1, 2}), P(few, {1, 2, 3})) == 2 / 3
    assert S.likeness(P(range(100, 120)), P(few, {1})) == 3 / 20


def test_a_text_and_its_edit_are_compared_by_one_kind():
    words = [f"word{i}" for i in range(60)]
    # four spots in the text, three in what is left of them when the last word is gone
    text = " ".join(["the", *words[:20], "of", *words[20:40], "and", *words[40:57], "in", *words[57:]])
    edited = text.rsplit(" ", 1)[0]
    a, b = S.signatures(text), S.signatures(edited)
    assert len(a.spots) == S.MIN_SPOTS > len(b.spots) and S.likeness(a, b) > 0.9


def pair_sets():
    rnd = random.Random(8)
    sets = []
    for _ in range(25):
        base = {rnd.randrange(2000) for _ in range(rnd.choice([1, 3, 8, 30, 90]))}
        for part in [base, base, *({x for x in base if rnd.random() > 0.12} | {rnd.randrange(2000)} for _ in range(4))]:
            spots = frozenset(part)
            sets.append(S.Print(spots, frozenset(x + 5000 for x in part) | {rnd.randrange(9000)} if len(spots) < S.KEPT_CHAINS else frozenset()))
    return [*sets, P(()), P((), {7, 8, 9}), P((), {7, 8, 9, 10})]


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_similar_pairs(spark, threshold):
    sets = pair_sets()
    prints = spark.createDataFrame([(i, S.written(s)) for i, s in enumerate(sets)], "doc_id long, fingerprint string")
    got = {(r["a"], r["b"]): (r["likeness"], r["copies_a"], r["copies_b"]) for r in S.similar_pairs(prints, threshold).collect()}
    copies = Counter(map(S.written, sets))
    own = sorted({S.written(s): s for s in sets if S.written(s)}.items())
    told = {(a, b): (S.likeness(x, y), copies[a], copies[b]) for i, (a, x) in enumerate(own) for b, y in own[i + 1 :] if S.likeness(x, y) >= threshold}
    assert got.keys() == told.keys() and all(got[p] == pytest.approx(told[p]) for p in told)


def test_fingerprints(spark):
    rows = [(1, "the a b c"), (1, "the a b c"), (None, None)]
    got = S.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r["fingerprint"] for r in got}) == 2 and got[2]["fingerprint"] == ""
