"""Document fingerprints by SpotSigs: chains of content words that follow common words.

Each common word (an anchor) and the CHAIN content words after it are one signature, a spot; a fingerprint is the set of a
text's spots. Texts of few spots also have the chains of any words. Two fingerprints are as alike as the Jaccard ratio of
their spots, or, if one of them has too few, of their chains: a pair is always compared by one kind. Sets are compared
within partitions by size.
"""

from __future__ import annotations

import hashlib
import math
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

#: content words in a signature
CHAIN = 3
#: with fewer spots than this a text is compared by the chains of all its words
MIN_SPOTS = 4
#: and texts of fewer than this keep those chains, so that neighbours on both sides of MIN_SPOTS have them
KEPT_CHAINS = 16
#: hex digits of a written signature
DIGITS = 16
#: fixed values: common words of the four languages
ANCHORS = frozenset(
    "a an and are as at be by for from in is it of on or that the this to was were will with "
    "aber auch auf das dem den der des die ein eine für im ist mit nicht sich und von zu "
    "al como con de del el en es la las lo los más no para por que se su un una y "
    "au aux avec ce dans des du elle est et il je le les mais ou par pas pour qui sur une".split()
)

_WORD = re.compile(r"\w+")


class Print(NamedTuple):
    """Spots, and chains of any words where there are few spots; 64-bit numbers. Both are empty for an empty text only."""

    spots: frozenset[int]
    chains: frozenset[int]


def signatures(text: str | None) -> Print:
    if not text:
        return Print(frozenset(), frozenset())
    words = _WORD.findall(text.lower())
    content = [w for w in words if w not in ANCHORS]
    spots, k = set(), 0
    for w in words:
        if w in ANCHORS:
            chain = content[k : k + CHAIN]
            if len(chain) == CHAIN:
                spots.add(xxh3_64_intdigest(f"{w} {' '.join(chain)}"))
        else:
            k += 1
    if len(spots) >= KEPT_CHAINS:
        return Print(frozenset(spots), frozenset())
    if len(words) <= CHAIN:
        return Print(frozenset(spots), frozenset({xxh3_64_intdigest(" ".join(words) or text)}))
    return Print(frozenset(spots), frozenset(xxh3_64_intdigest(" ".join(words[i : i + CHAIN + 1])) for i in range(len(words) - CHAIN)))


def written(signs: Print) -> str:
    """A fingerprint as text: its sorted spots, sixteen hex digits each, and, if it has them, its chains after a dot."""
    spots, chains = (np.sort(np.fromiter(part, np.uint64, len(part))).astype(">u8").tobytes().hex() for part in signs)
    return f"{spots}.{chains}" if chains else spots


def ratio(a: frozenset[int], b: frozenset[int], at_least: float = 0.0) -> float:
    """The Jaccard ratio, or 0 where the sizes alone show that it is below `at_least`."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not large or len(small) < at_least * len(large):
        return 0.0
    both = len(small & large)
    found = both / (len(a) + len(b) - both)
    return found if found >= at_least else 0.0


def likeness(a: Print, b: Print, at_least: float = 0.0) -> float:
    """How alike two fingerprints are. Equal ones are alike, also empty ones; an empty one and another are not."""
    if a == b:
        return 1.0
    spots = min(len(a.spots), len(b.spots)) >= MIN_SPOTS or not a.chains or not b.chains
    return ratio(a.spots, b.spots, at_least) if spots else ratio(a.chains, b.chains, at_least)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every whole text; a null text counts as empty and has an empty fingerprint."""
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, fingerprint string"

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([written(signatures(t)) for t in batch.column(1).to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def similar_pairs(prints: DataFrame, threshold: float = 0.8) -> DataFrame:
    """All pairs (a, b, likeness, copies_a, copies_b) of different non-empty fingerprints with a likeness of `threshold` or more.

    Equal fingerprints are one row here (`a` < `b` are fingerprints) with the number of their copies, so copies make no
    pairs. Sizes fall into partitions whose bounds grow by 1 / threshold: only neighbours can hold a pair. In a
    partition, a pair shares one of the first (1 - threshold) parts of its signatures, rarest first, so that common
    chains are looked up by few texts. Spots and chains are looked up apart, and each pair is found by its own kind.
    """
    sets = prints.where(F.col("fingerprint") != "").groupBy("fingerprint").agg(F.count("*").alias("copies"))
    part = F.split("fingerprint", "[.]")
    spots, chains = part[0], F.coalesce(F.get(part, F.lit(1)), F.lit(""))
    sets = sets.withColumn("spots", (F.length(spots) / DIGITS).cast("long")).withColumn("chains", (F.length(chains) / DIGITS).cast("long"))

    def kind(name: str, signs: Column, least: int) -> DataFrame:
        listed = F.transform(F.sequence(F.lit(0), (F.length(signs) / DIGITS).cast("int") - 1), lambda i: F.substr(signs, i * DIGITS + 1, F.lit(DIGITS)))
        own = sets.where(F.col(name) >= least).withColumn("size", F.col(name))
        spread = own.select("fingerprint", "size", "spots", "chains", F.explode(listed).alias("sign"))
        counted = spread.groupBy("sign").agg(F.count("*").alias("n"))
        by_rank = F.sort_array(F.collect_list(F.struct("n", "sign")))
        ranked = spread.join(counted, "sign").groupBy("fingerprint", "size", "spots", "chains").agg(by_rank.alias("ranked"))
        # the pair's overlap is at least threshold * the larger size
        first = F.expr(f"slice(ranked, 1, size - cast(ceil({threshold} * size) as int) + 1)")
        prefix = ranked.select("fingerprint", "size", "spots", "chains", F.explode(first).alias("x"), F.floor(F.log("size") / math.log(1 / threshold) + 1e-9).alias("part"))
        return prefix.select("fingerprint", "size", "spots", "chains", "part", F.col("x.sign").alias("sign"))

    def pairs(prefix: DataFrame, by_spots: bool) -> DataFrame:
        index = prefix.select("part", "sign", *(F.col(c).alias(f"{c}_a") for c in ("fingerprint", "size", "spots", "chains")))
        probe = prefix.select(F.explode(F.array("part", F.col("part") + 1, F.col("part") - 1)).alias("part"), "sign", *(F.col(c).alias(f"{c}_b") for c in ("fingerprint", "size", "spots", "chains")))
        fits = (F.col("fingerprint_a") < F.col("fingerprint_b")) & (F.least("size_a", "size_b") >= threshold * F.greatest("size_a", "size_b") - 1e-9)
        own = (F.least("spots_a", "spots_b") >= MIN_SPOTS) | (F.least("chains_a", "chains_b") == 0)
        met = index.join(probe, ["part", "sign"]).where(fits & (own if by_spots else ~own))
        met = met.select(F.col("fingerprint_a").alias("a"), F.col("fingerprint_b").alias("b")).distinct()
        at = 0 if by_spots else 1
        return met.withColumn("likeness", jaccard(F.split("a", "[.]")[at], F.split("b", "[.]")[at])).where(F.col("likeness") >= threshold)

    found = pairs(kind("spots", spots, 1), True).unionByName(pairs(kind("chains", chains, 1), False))
    for end in "ab":
        found = found.join(sets.select(F.col("fingerprint").alias(end), F.col("copies").alias(f"copies_{end}")), end)
    return found.select("a", "b", "likeness", "copies_a", "copies_b")


def jaccard(a: Column, b: Column) -> Column:
    """The ratio of two written sets."""
    def listed(x):
        return F.transform(F.sequence(F.lit(0), (F.length(x) / DIGITS).cast("int") - 1), lambda i: F.substr(x, i * DIGITS + 1, F.lit(DIGITS)))

    x, y = listed(a), listed(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def _bounds(docs: DataFrame, parts: int) -> list[int]:
    """Ids that cut the documents into parts of about one size, from the largest down; ids of the table, so none is empty."""
    shares = [i / parts for i in range(1, parts + 1)]
    row = docs.agg(F.max("key").alias("top"), F.percentile_approx("key", shares, 20 * parts).alias("cuts")).first()
    return sorted({row["top"], *(row["cuts"] or [])}, reverse=True) if row["top"] is not None else []


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's fingerprint, that of its edited text, and their likeness to it and to the next document's.

    The next document is the one with the next smaller id, after the smallest the one with the largest. The edited text
    has the last floor(n / 2) of the n characters replaced by as many of the next text's first. Rows with one id follow
    each other by text; null ids come last. A null text is empty. A lone document is its own next one.

    The documents are dealt out once, in ranges of ids; each range also gets the first document of the range below.
    """
    spark, least = docs.sparkSession, -(1 << 63)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.coalesce("doc_id", F.lit(least)))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = _bounds(base, 4 * parts)
    if not bounds:
        cut, heads = F.lit(0), base.limit(0).select(F.lit(0).alias("range"), "doc_id", "text", "key", F.lit(True).alias("tail"))
    else:
        # two steps, so that a row is held against few bounds
        step = max(1, math.isqrt(len(bounds)))
        fine = [bounds[i : i + step] for i in range(0, len(bounds), step)]
        listed = lambda of: F.array(*(F.lit(b).cast("long") for b in of))
        block = F.size(F.filter(listed(f[0] for f in fine), lambda b: b >= F.col("key"))) - 1
        cut = block * step + F.size(F.filter(F.element_at(F.array(*map(listed, fine)), block + 1), lambda b: b >= F.col("key"))) - 1
        first = base.where(F.col("key").isin(bounds)).groupBy("key").agg(F.min("text").alias("text"))
        above = F.element_at(F.create_map(*(F.lit(x) for i, b in enumerate(bounds) for x in (b, (i - 1) % len(bounds)))), F.col("key"))
        heads = first.select(above.alias("range"), F.lit(None).cast("long").alias("doc_id"), "text", "key", F.lit(True).alias("tail"))
    rows = base.select(cut.cast("int").alias("range"), "doc_id", "text", "key", F.lit(False).alias("tail"))
    dealt = rows.unionByName(heads.withColumn("range", F.col("range").cast("int"))).repartition(parts, "range").sortWithinPartitions("range", "tail", F.desc("key"), "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches):
        last = None
        for batch in batches:
            out = []
            for where, doc_id, text, tail in zip(*(batch.column(c).to_pylist() for c in ("range", "doc_id", "text", "tail")), strict=True):
                signs = signatures(text)
                if last is not None and last[0] == where:
                    out.append(_compared(*last[1:], text, signs))
                last = None if tail else (where, doc_id, text, signs)
            yield pa.RecordBatch.from_pylist(out, _RESULT)

    return dealt.select("range", "doc_id", "text", "tail").mapInArrow(run, schema)


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compared(doc_id, text: str, signs: Print, next_text: str, next_signs: Print) -> dict:
    n = len(text) // 2
    edited = text[: len(text) - n] + next_text[:n]
    edited_signs = signatures(edited)
    return {
        "doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(), "fingerprint": written(signs),
        "edited_fingerprint": written(edited_signs), "near_edited": likeness(signs, edited_signs), "near_next": likeness(signs, next_signs),
    }
