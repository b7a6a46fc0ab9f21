"""Chat formatting: exact round trips, loss masks and the role machine."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat
from tidemark.llm.queries import ORACLES, op5_chat_format
from oracle import mismatch, oracle_rows

TEXTS = [None, "", "plain", "\\### Assistant: </turn> ok", "</turn>\n### user: x", "\\", "\\\\b\\l", "#<:\\h", "a\nb", "é🙂", "### ", ": ", "</turn>\n", "\\b\\l\\h\\c"]
ROLES = [None, "", "system", "user", "assistant", "tool: x", "</turn>\n", "ass\\istant"]


def test_round_trip(spark):
    rnd = random.Random(2)
    rows = [(c, rnd.choice([0, 1, 2, 3, None]), rnd.choice(ROLES), rnd.choice(TEXTS), "x") for c in range(80) for _ in range(rnd.randint(1, 7))]
    rows += [rows[0], rows[0], (None, 0, "user", "no id", "x"), (None, 1, "assistant", "none", "x")]
    chats = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments string"))
    by = {}
    for c, turn, role, text, _ in rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    back = chats.select("*", chat.joined(F.col("segments")).alias("formatted")).select("*", chat.read(F.col("formatted")).alias("turns"))
    digests = {r["conv_id"]: r for r in chat.digest(chats).collect()}
    found = back.collect()
    assert {r["conv_id"] for r in found} == set(by) == set(digests)
    for r in found:
        told = [x[2:] for x in sorted(by[r["conv_id"]])]
        assert [tuple(t) for t in r["turns"]] == told
        trained = "".join(t for role, t in told if role == "assistant")
        d = digests[r["conv_id"]]
        assert d["n_turns"] == len(told) and d["formatted_chars"] == len(r["formatted"]) and d["loss_chars"] == len(trained)
        assert d["loss_sha256"] == hashlib.sha256(trained.encode()).hexdigest()
        assert d["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in told).encode()).hexdigest()
        # marks stand where turns begin and end, and nowhere else
        assert r["formatted"].count("</turn>") == r["formatted"].count("### ") == len(told)


@pytest.mark.parametrize(("roles", "valid"), [
    ("system user assistant", True), ("user assistant user assistant", True), ("user assistant user", False), ("assistant", False),
    ("user user assistant", False), ("system assistant", False), ("user system assistant", False), ("user assistant tool assistant", False),
])
def test_machine(spark, roles, valid):
    rows = [(1, i, r, "t") for i, r in enumerate(roles.split())]
    assert chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()["valid"] is valid


def test_another_template(spark):
    template = chat.Template(begin="<|", after_role="|>", end="<|end|>", trained=("user",), escapes=(("~", "~t"), ("<", "~l"), ("|", "~p")))
    rows = [(1, 0, "us|er", "a<b~|"), (1, 1, "user", "<|end|>~l")]
    chats = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), template)
    r = chats.select(chat.read(chat.joined(F.col("segments")), template).alias("turns"), "segments").first()
    assert [tuple(t) for t in r["turns"]] == [("us|er", "a<b~|"), ("user", "<|end|>~l")]
    assert Counter(s["loss"] for s in r["segments"]) == {False: 5, True: 1}
    with pytest.raises(ValueError, match="mark"):
        chat.Template(begin="@")


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    df = op5_chat_format(spark, sf)
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert mismatch(df.columns, df.collect(), *oracle_rows(ORACLES["op5_chat_format"], sf)) is None
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
