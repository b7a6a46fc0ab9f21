"""Byte-level BPE ids as the `tokenizers` library gives them, and token counts by overlapping chunks.

The vocabulary file (a `tokenizers` JSON of the byte-level kind) is a parameter. Its merges are run by `tiktoken`,
which is about five times as fast. The two agree: every token of the vocabulary encodes to itself, so a merge by rank
never joins a pair the file has no merge for, and both split words by one pattern (both facts are tests). Its pattern
fails on very long white space; texts with such are left to `tokenizers`. The file's special strings are cut out first,
as the library does by default. Where chunks are spliced, the words are the library's.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

#: fixed values: the word pattern of the byte-level pre-tokenizer
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: a match can still change if it ends so close to where a chunk was cut: "'re" may stand there as "'r"
UNSETTLED = 4
#: white space of this many characters is left to the library: the other one's pattern runs out of stack at about ten times as many
LONG_SPACE = 100_000
_SPACE = re.compile(r"\s+")


def byte_of() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary, turned round."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Ids of whole texts; one for each worker and vocabulary file."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError(f"{path} is no plain byte-level BPE")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        alphabet = byte_of()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self._bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._library = Tokenizer.from_file(path)
        self._split = self._library.pre_tokenizer.pre_tokenize_str
        self._cut = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")

    def ordinary(self, text: str) -> list[int]:
        """Ids of a text without special strings."""
        if len(text) >= LONG_SPACE and any(m.end() - m.start() >= LONG_SPACE for m in _SPACE.finditer(text)):
            return self._library.encode(text, add_special_tokens=False).ids
        return self._bpe.encode_ordinary(text)

    def word_starts(self, text: str) -> list[int]:
        """Where the library's words begin; they leave nothing out."""
        return [start for _, (start, _) in self._split(text)]

    def ids(self, text: str | None) -> list[int]:
        if not text:
            return []
        out, at = [], 0
        for found in self._cut.finditer(text):
            out += self.ordinary(text[at : found.start()])
            out.append(self.special[found.group()])
            at = found.end()
        return out + self.ordinary(text[at:]) if at else self.ordinary(text)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def special_strings(path: str) -> list[str]:
    with open(path, encoding="utf-8") as file:
        return [t["content"] for t in json.load(file)["added_tokens"]]


def chunk_ends(text: str, path: str, overlap: int, first: bool, last: bool) -> tuple[list[int], list[int], list[int], list[int], int]:
    """Encode one chunk with offsets.

    Gives the word boundaries in the first `overlap` characters with the tokens before each, the same for the last
    `overlap` characters (only boundaries that the cut at the end can't move), and the tokens in all.
    """
    ordinary = encoder(path).ordinary
    head, tail, heads, tails = [], [], [], []
    begin_tail, sure = len(text) - overlap, len(text) - UNSETTLED
    total = len(ordinary(text))
    starts = encoder(path).word_starts(text)
    if not first:
        near = [p for p in starts if p < overlap]
        before = 0
        for i, p in enumerate(near):
            head.append(p)
            heads.append(before)
            if i + 1 < len(near):
                before += len(ordinary(text[p : near[i + 1]]))
    if not last:
        near = [p for p in starts if p >= begin_tail]
        after = len(ordinary(text[near[0] :])) if near else 0
        before = total - after
        for i, p in enumerate(near):
            if p > sure:
                break
            tail.append(p)
            tails.append(before)
            if i + 1 < len(near):
                before += len(ordinary(text[p : near[i + 1]]))
    return head, heads, tail, tails, total


def whole_counts(df: DataFrame, path: str, keys: list[str], text: str) -> DataFrame:
    """Tokens of texts that are encoded in one go."""
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", n_tokens long"

    def count(batches):
        ids = encoder(path).ids
        for batch in batches:
            n = [len(ids(t)) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(n, pa.int64())], [*keys, "n_tokens"])

    return df.select(*keys, text).mapInArrow(count, schema)


def chunk_counts(df: DataFrame, path: str, size: int, overlap: int) -> DataFrame:
    """Tokens of each (key, text) without special strings, spliced from chunks of `size` characters.

    Neighbouring chunks share `overlap` characters. The word pattern never looks back, so once two chunks have a word
    boundary at one place, all that follows is equal: there they are spliced. `n_tokens` is null where two chunks
    share no boundary.
    """
    spans = F.expr(f"sequence(0L, greatest(0L, cast((char_length(text) - {overlap} - 1) div {size} as bigint)))")
    chunks = (
        df.select("key", "text", F.posexplode(spans).alias("k", "at"), F.size(spans).alias("of"))
        .select("key", "k", "of", F.expr(f"substring(text, cast(at * {size} + 1 as int), {size + overlap})").alias("text"))
        # a huge text is one row of the source: deal its chunks out
        .repartition("key", "k")
    )

    def encode(batches):
        for batch in batches:
            rows = [
                chunk_ends(t, path, overlap, k == 0, k == of - 1)
                for t, k, of in zip(batch.column("text").to_pylist(), batch.column("k").to_pylist(), batch.column("of").to_pylist(), strict=True)
            ]
            cut = [[(p - size, n) for p, n in zip(r[2], r[3], strict=True) if 0 <= p - size < overlap] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("k"), batch.column("of"),
                 *(pa.array([r[i] for r in rows], pa.list_(pa.int64())) for i in (0, 1)),
                 *(pa.array([[x[i] for x in c] for c in cut], pa.list_(pa.int64())) for i in (0, 1)),
                 pa.array([r[4] for r in rows], pa.int64())],
                ["key", "k", "of", "head", "heads", "tail", "tails", "total"],
            )

    lists = ", ".join(f"{c} array<long>" for c in ("head", "heads", "tail", "tails"))
    ends = chunks.mapInArrow(encode, f"key long, k int, of int, {lists}, total long")
    following = Window.partitionBy("key").orderBy("k")
    shared = F.array_intersect("tail", "next_head")
    return (
        ends.withColumn("next_head", F.lead("head").over(following)).withColumn("next_heads", F.lead("heads").over(following))
        .withColumn("splice", F.when(F.size(shared) > 0, shared[0]))
        .withColumn("gain", F.when(F.col("k") == F.col("of") - 1, F.col("total")).when(
            F.col("splice").isNotNull(),
            F.expr("tails[array_position(tail, splice) - 1] - next_heads[array_position(next_head, splice) - 1]"),
        ))
        .groupBy("key").agg(F.when(F.count("gain") == F.count("*"), F.sum("gain")).alias("n_tokens"))
    )


def count_tokens(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, chunk: int = 32_768, overlap: int = 1_024) -> DataFrame:
    """Tokens of every whole text: (id, n_bytes, n_tokens, over_limit), one row for each input row.

    Texts above two chunks are cut at their special strings, then into overlapping chunks that are encoded apart. Where
    two chunks of a text share no word boundary, chunk and overlap are doubled for that text, at last to the whole text.
    A null or empty text has 0 bytes and 0 tokens; a null id stays; repeated rows are counted each for itself; other
    columns are left out, whatever their names.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    huge = F.char_length("text") > 2 * chunk
    kind = base.schema["doc_id"].dataType.simpleString()
    short = whole_counts(base.where(~huge).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text"), path, ["doc_id", "n_bytes"], "text")
    special = special_strings(path)
    cut = "|".join(f"\\Q{s}\\E" for s in sorted(special, key=len, reverse=True))
    parts = F.split("text", cut, -1) if special else F.array("text")
    # each stretch between special strings is a text of its own; the table is written so that its keys stay
    segments = materialize(
        base.where(huge).withColumn("row", F.monotonically_increasing_id())
        .select("row", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.explode(parts).alias("text"))
        .withColumn("key", F.monotonically_increasing_id()),
        "token-segments",
    )
    spark, done, left, size, step = docs.sparkSession, [], segments.select("key", "text"), chunk, overlap
    while True:
        counted = materialize(chunk_counts(left, path, size, step), "token-counts")
        done.append(counted.where("n_tokens is not null"))
        missing = counted.where("n_tokens is null").select("key")
        if missing.isEmpty():
            break
        left, size, step = left.join(missing, "key", "left_semi"), size * 2, step * 2
    counts = done[0]
    for more in done[1:]:
        counts = counts.unionByName(more)
    long = (
        segments.select("key", "row", "doc_id", "n_bytes").join(counts, "key")
        .groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), (F.sum("n_tokens") + F.count("*") - 1).alias("n_tokens"))
        .select(F.col("doc_id").cast(kind), "n_bytes", "n_tokens")
    )
    return short.unionByName(long).withColumn("over_limit", F.col("n_tokens") > limit)
