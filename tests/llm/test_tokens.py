"""Token ids and counts against the `tokenizers` library."""

import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm.tokens import LONG_SPACE, byte_of, count_tokens, encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
SPECIAL = "<|endoftext|>"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def texts():
    rnd = random.Random(3)
    parts = ["the", " The", "'re", "'r", "'s", "  ", "\n", " \n ", "\t", "42", "é", "ñ", "中文", "🙂", "!!", "...", "x" * 40, SPECIAL, "<|endof", " ", " ", "can't", "I'll", "'"]
    return [None, "", " ", SPECIAL, SPECIAL * 3, "a" * 3000, " " * 700 + "x"] + ["".join(rnd.choices(parts, k=rnd.randint(1, 120))) for _ in range(300)]


def test_ids_equal_the_library(library):
    for text in texts():
        assert encoder(PATH).ids(text) == ids(library, text), text


def test_every_character_is_split_alike(library):
    """The two libraries agree on every class of character."""
    points = [*range(0x3100), *range(0x3100, 0x110000, 61)]
    asked = [f"a{chr(c)}1{chr(c)} {chr(c)}{chr(c)}!{chr(c)}  {chr(c)}'s{chr(c)}" for c in points if not 0xD800 <= c < 0xE000]
    told = library.encode_batch(asked, add_special_tokens=False)
    ordinary = encoder(PATH).ordinary
    for text, known in zip(asked, told, strict=True):
        assert ordinary(text) == known.ids, ascii(text)
        starts = encoder(PATH).word_starts(text)
        assert [i for a, b in zip(starts, [*starts[1:], len(text)], strict=True) for i in ordinary(text[a:b])] == known.ids, ascii(text)


def test_every_token_is_made_by_the_files_merges():
    """So a merge by rank never joins a pair that the file has no merge for: isolated, such a pair would stay apart."""
    with open(PATH, encoding="utf-8") as file:
        model = json.load(file)["model"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    rank = {pair: i for i, pair in enumerate(pairs)}
    alphabet = byte_of()
    assert sorted(alphabet.values()) == list(range(256))
    assert [model["vocab"][a + b] for a, b in pairs] == sorted(model["vocab"][a + b] for a, b in pairs)
    for token in model["vocab"]:
        if token == SPECIAL:
            continue
        parts = list(token)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), 1 << 30))
            assert (parts[best], parts[best + 1]) in rank, token
            parts[best : best + 2] = [parts[best] + parts[best + 1]]


@pytest.mark.parametrize(("chunk", "overlap"), [(16, 5), (40, 16), (64, 40), (32_768, 1_024)])
def test_counts(spark, library, chunk, overlap):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(None, "no id", "x"), (1, "again", "x"), (1, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)
    got = sorted(map(str, count_tokens(docs, PATH, chunk=chunk, overlap=overlap, limit=40).collect()))
    told = [(i, len((t or "").encode()), len(ids(library, t))) for i, t, _ in rows]
    assert got == sorted(f"Row(doc_id={i}, n_bytes={b}, n_tokens={n}, over_limit={n > 40})" for i, b, n in told)


def test_a_very_long_text(spark, library):
    text = "".join(f"word{i} can't  stop\n" for i in range(60_000))
    row = count_tokens(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH).first()
    assert row["n_tokens"] == len(ids(library, text)) and row["n_bytes"] == len(text)


def test_no_rows(spark):
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_very_long_white_space():
    own, library = encoder(PATH), Tokenizer.from_file(PATH)
    for text in ("x" + " " * 1_000_000 + "y", "\n" * 1_000_000, " " * (LONG_SPACE - 1) + "a", "a b " + "\t" * LONG_SPACE + "c<|endoftext|> d"):
        assert own.ids(text) == library.encode(text, add_special_tokens=False).ids
