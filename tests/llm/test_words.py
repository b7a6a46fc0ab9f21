"""Word hashes against words taken one by one."""

import re

import numpy as np
import pyarrow as pa

from tidemark.llm.words import ALNUM, MARKED, SPACED, words

TEXTS = [None, "", "One two", "  one\tTWO x  ", "é à É", "a", "x" * 5000 + " y", "a-b a_b 7up", "\x00a b\x7f", "straße🙂 STRASSE", " ", "end"]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def taken(column, letters, target):
    rows = [[] for _ in range(len(column))]
    for found in words(column, letters, target):
        for row, value in zip(found.row.tolist(), found.hash.tolist(), strict=True):
            rows[found.low + row].append(value)
    return rows


def check(letters, pattern):
    expected = [re.findall(pattern, lower(t)) for t in TEXTS]
    for target in (1, 20, 1 << 20):
        rows = taken(pa.array(TEXTS), letters, target)
        assert [len(r) for r in rows] == [len(r) for r in expected]
        names = {}
        for own, told in zip(rows, expected, strict=True):
            for value, word in zip(own, told, strict=True):
                assert names.setdefault(word, value) == value
        assert len(set(names.values())) == len(names)


def test_words_between_white_space():
    check(SPACED, r"[^\x20\x09-\x0D]+")


def test_alphanumeric_words():
    check(ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_words_and_marks():
    check(MARKED, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+|[\x00-\x08\x0e-\x1f\x21-\x2F\x3A-\x60\x7B-\x7F]+")


def test_slices_and_empty_columns():
    column = pa.array(TEXTS)
    assert taken(column.slice(3, 5), SPACED, 10) == taken(column, SPACED, 10)[3:8]
    assert list(words(pa.array([], pa.string()), SPACED)) == []
    assert taken(pa.array(["", None]), SPACED, 10) == [[], []]


def test_hashes_fill_all_bits():
    values = np.concatenate([w.hash for w in words(pa.array([" ".join(f"w{i}" for i in range(5000))]), SPACED)])
    bits = ((values[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).mean(axis=0)
    assert len(set(values.tolist())) == 5000 and abs(bits - 0.5).max() < 0.05
