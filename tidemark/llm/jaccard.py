"""Exact Jaccard self-join on word shingles by universe partition and pigeonhole, and the groups it links.

Two sets of sizes a and b with a ratio of 0.8 or more differ in (a + b) / 9 elements at most, say H. Cut the universe
of shingles by a hash into H + 1 segments: in one at least both hold the same subset. Sets are taken by bands of
size; a pair meets in the band of its larger set, so a set is indexed in its own band and, if large enough, in the
next one. A segment is looked up by the hash of the subset it holds. In bands of few segments each also stands for its
subsets less one element (a one-deletion neighbourhood): then two subsets that differ by one element meet, a segment
counts twice, and half as many will do.

What a look-up costs is how many sets share it. Bands have 2 * SPARE more segments than needed, so partners share that
many look-ups and one more. Empty subsets are left out first. Of the look-ups that other sets share, counted over all
sets, each set then leaves out the costliest as long as one that it has in common with a partner must remain
(allocation by cost); a set with fewer shared look-ups than partners have in common is done.

Every candidate pair is verified on the texts. Copies are one set. A group that shares a subset is first held against
its smallest member only; pairs inside a component need no more. Sets that still share a look-up with another component
are compared by their rarest shingles, which rules out nearly all of their pairs unseen, and then in full.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.cluster import by_ids
from tidemark.llm.components import components
from tidemark.llm.words import SPACED, U64, chained, keyed, mix, words
from tidemark.session import materialize

SHINGLE = 5
#: two sets link when 100 * both >= PERCENT * either
PERCENT = 80
#: the sizes of a band grow by this factor
GROWTH = 1.4
#: segments that each set may leave out, as a share of those needed
SPARE = 0.12
#: bands of so few segments use one-deletion neighbourhoods
FEW = 4
#: copies that a task remembers, so that it indexes them once
REMEMBERED = 200_000
#: sets that share a shingle and are held against each other in one task
LOT = 512
#: bits of a sketch; sets of some thousand shingles are still told apart by so many
SKETCH_BITS = 1024
#: stands for a null id
NO_ID = -(1 << 63)


class Band:
    """How sets are cut when the larger of a pair has fewer than `end` elements."""

    def __init__(self, number: int, begin: int, end: int):
        self.number, self.begin, self.end = number, begin, end
        # |a xor b| = a + b - 2 both, and both >= PERCENT / (100 + PERCENT) * (a + b)
        self.differ = 2 * (end - 1) * (100 - PERCENT) // (100 + PERCENT)
        self.deletions = self.differ + 1 <= FEW
        self.spare = 0 if self.deletions else int(SPARE * (self.differ + 1)) + 1
        self.segments = self.differ // 2 + 1 if self.deletions else self.differ + 1 + 2 * self.spare


@lru_cache(maxsize=1)
def bands() -> tuple[list[int], list[Band]]:
    """All bands, by where they begin."""
    begins = [1]
    while begins[-1] < 1 << 40:
        begins.append(max(begins[-1] + 1, int(begins[-1] * GROWTH)))
    return begins, [Band(i, a, b) for i, (a, b) in enumerate(zip(begins[:-1], begins[1:], strict=True))]


@lru_cache(maxsize=1)
def _numbers() -> tuple[np.ndarray, ...]:
    begins, every = bands()
    return (np.array(begins), *(np.array([getattr(b, c) for b in every], np.int64) for c in ("begin", "differ", "spare", "segments", "deletions")))


class Sets(NamedTuple):
    """The distinct shingles of some rows, sorted within each: row i has values[bounds[i] : bounds[i + 1]]."""

    values: np.ndarray
    bounds: np.ndarray

    def of(self, i: int) -> np.ndarray:
        return self.values[self.bounds[i] : self.bounds[i + 1]]

    def sketches(self) -> np.ndarray:
        """A row of bits for each set: whether an odd number of its shingles falls on a bit.

        Where two rows differ, the sets differ in one shingle at least.
        """
        rows = len(self.bounds) - 1
        cell = np.repeat(np.arange(rows), np.diff(self.bounds)) * SKETCH_BITS + (mix(self.values ^ U64(0xD1B54A32D192ED03)) % U64(SKETCH_BITS)).astype(np.int64)
        odd = (np.bincount(cell, minlength=rows * SKETCH_BITS) & 1).astype(np.uint8)
        return np.packbits(odd.reshape(rows, SKETCH_BITS), axis=1).view(np.int64)

    def names(self) -> list[int | None]:
        """A number for each set, the same for equal sets; none for an empty one."""
        return [xxhash.xxh3_64_intdigest(v.tobytes(), len(v)) - (1 << 63) if len(v) else None for v in map(self.of, range(len(self.bounds) - 1))]


def shingle_sets(column: pa.Array):
    """The shingle sets of all rows in order, some at a time."""
    for found in words(column, SPACED):
        size = found.high - found.low
        at = found.bounds()
        whole = chained(found.hash, SHINGLE)
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                own = np.sort(whole[a : b - SHINGLE + 1])
                new = np.empty(len(own), bool)
                new[0] = True
                np.not_equal(own[1:], own[:-1], out=new[1:])
                out.append(own[new])
            elif b > a:  # a text of fewer words is one shingle
                out.append(mix((found.hash[a:b] * keyed(b - a, 1000 * (b - a))).sum(dtype=U64, keepdims=True) + U64(b - a)))
            else:
                out.append(np.empty(0, U64))
        yield Sets(np.concatenate(out), np.cumsum([0, *map(len, out)])) if size else Sets(np.empty(0, U64), np.zeros(1, np.int64))


def look_ups(sets: Sets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every signature of every set: (sign, row, extra).

    `extra` holds the set's size, how many shared look-ups any two partners have in common, and the band.
    """
    begins, begin, differ, spare, segments, deletions = _numbers()
    sizes = np.diff(sets.bounds)
    own = np.searchsorted(begins, sizes, "right") - 1
    place, mixed = mix(sets.values + U64(0x2545F4914F6CDD1D)), mix(sets.values ^ U64(0x8CB92BA72F3D8DD7))
    out = []
    for band, fits in ((own, sizes > 0), (own + 1, (sizes > 0) & (100 * sizes >= PERCENT * begin[np.minimum(own + 1, len(begin) - 1)]))):
        rows = np.flatnonzero(fits & (differ[np.minimum(band, len(begin) - 1)] > 0))
        if not len(rows):
            continue
        band = band[rows]
        n = segments[band]
        first = np.cumsum(n) - n  # the segments of all these sets, one after another
        take = np.repeat(sets.bounds[rows] - (np.cumsum(sizes[rows]) - sizes[rows]), sizes[rows]) + np.arange(sizes[rows].sum())
        who = np.repeat(np.arange(len(rows)), sizes[rows])
        where = first[who] + (place[take] % n.astype(U64)[who]).astype(np.int64)
        value = mixed[take]
        held = np.bincount(where, minlength=n.sum())
        # sums of 64-bit numbers, as two exact sums of halves
        low, high = (np.bincount(where, (half & U64(0xFFFFFFFF)).astype(np.float64), minlength=n.sum()).astype(U64) for half in (value, value >> U64(32)))
        total = low + (high << U64(32))
        whose = np.repeat(np.arange(len(rows)), n)
        named = mix((np.arange(n.sum()) - first[whose]).astype(U64) * U64(0x9E3779B97F4A7C15) + band[whose].astype(U64))
        empty = held == 0
        so_far = np.cumsum(empty)
        rank = so_far - (so_far[first] - empty[first])[whose]  # of an empty segment in its set, from 1
        empties = np.bincount(whose[empty], minlength=len(rows))
        # partners have 2 * spare + 1 subsets in common; those that are empty in one set are left out, spare of them at most
        common = 2 * spare[band] + 1 - np.minimum(empties, spare[band])
        kept = np.flatnonzero(~empty | (rank > spare[band][whose]))
        extra = (sizes[rows] << 24 | common) << 8 | band
        out.append((mix(total[kept] + named[kept]), rows[whose[kept]], extra[whose[kept]]))
        less = np.flatnonzero(deletions[band][who])
        if len(less):
            out.append((mix(total[where[less]] - value[less] + named[where[less]]), rows[who[less]], extra[who[less]]))
    if not out:
        return np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _described(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, doc_id, size, name) of every row's set."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            names, sizes = [], []
            for sets in shingle_sets(batch.column("text")):
                names += sets.names()
                sizes += np.diff(sets.bounds).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(names, pa.int64())], ["doc_id", "size", "name"])

    return rows.mapInArrow(run, "doc_id long, size long, name long")


def _indexed(docs: DataFrame, text_col: str) -> DataFrame:
    """(sign, name, extra) for every look-up of every set."""

    def run(batches):
        seen: dict[int, None] = {}
        for batch in batches:
            for sets in shingle_sets(batch.column(0)):
                names = sets.names()
                new = []
                for i, name in enumerate(names):
                    if name is not None and name not in seen:  # an empty set has no look-ups
                        seen[name] = None
                        new.append(i)
                while len(seen) > REMEMBERED:
                    del seen[next(iter(seen))]
                if not new:
                    continue
                some = Sets(np.concatenate([sets.of(i) for i in new]), np.cumsum([0, *(len(sets.of(i)) for i in new)]))
                sign, row, extra = look_ups(some)
                yield pa.RecordBatch.from_arrays([pa.array(sign.view(np.int64)), pa.array(np.array([names[i] for i in new], np.int64)[row]), pa.array(extra)], ["sign", "name", "extra"])

    return docs.select(text_col).mapInArrow(run, "sign long, name long, extra long")


def _shared(index: DataFrame) -> DataFrame:
    """The look-ups that different sets share, less those that a set may leave out: (sign, name, size)."""
    group = Window.partitionBy("sign")
    both = index.withColumn("low", F.min("name").over(group)).withColumn("high", F.max("name").over(group)).withColumn("n", F.count("*").over(group))
    shared = both.where("low <> high").select("sign", "name", "extra", "n").distinct()
    # partners have `common` of these or more: some of them stay when each set leaves out its costliest, one less
    costly = Window.partitionBy("name", "extra").orderBy(F.desc("n"), "sign")
    kept = shared.withColumn("place", F.row_number().over(costly)).where(F.col("place") >= F.expr("(extra >> 8) & 16777215"))
    return kept.select("sign", "name", F.expr("extra >> 32").alias("size"))


def _texts(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(name, text, size, sketch) of the documents with these keys."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("key"), F.col(text_col).alias("text"))
    chosen = by_ids(rows, keys, "key", "left_semi")

    def run(batches):
        for batch in batches:
            at = 0
            for sets in shingle_sets(batch.column(0)):
                n = len(sets.bounds) - 1
                sketch = pa.FixedSizeListArray.from_arrays(pa.array(sets.sketches().ravel()), SKETCH_BITS // 64).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(sets.names(), pa.int64()), batch.column(0).slice(at, n), pa.array(np.diff(sets.bounds)), sketch], ["name", "text", "size", "sketch"])
                at += n

    return chosen.select("text").mapInArrow(run, "name long, text string, size long, sketch array<long>")


def _may_link(a: str, b: str):
    """Whether two sets' sketches leave room for a link; a and b are suffixes of `size` and `sketch`."""
    differ = F.aggregate(F.zip_with(f"sketch{a}", f"sketch{b}", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return (100 + PERCENT) * differ <= (100 - PERCENT) * (F.col(f"size{a}") + F.col(f"size{b}"))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts link."""
    sketches = {end: texts.select(F.col("name").alias(end), F.col("size").alias(f"size_{end}"), F.col("sketch").alias(f"sketch_{end}")) for end in "ab"}
    pairs = pairs.join(sketches["a"], "a").join(sketches["b"], "b").where(_may_link("_a", "_b")).select("a", "b")
    joined = (
        pairs.join(texts.select(F.col("name").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("name").alias("a"), F.col("text").alias("text_a")), "a")
    )

    def run(batches):
        for batch in batches:
            a = batch.column("text_a").dictionary_encode()  # a pivot comes many times
            first, second = (
                [sets.of(i) for sets in shingle_sets(c) for i in range(len(sets.bounds) - 1)] for c in (a.dictionary, batch.column("text_b"))
            )
            keep = []
            for i, other in zip(a.indices.to_pylist(), second, strict=True):
                own = first[i]
                both = len(own) + len(other) - len(np.union1d(own, other))
                keep.append(100 * both >= PERCENT * (len(own) + len(other) - both))
            chosen = pc.indices_nonzero(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(chosen), batch.column("b").take(chosen)], ["a", "b"])

    return joined.mapInArrow(run, "a long, b long")


def _links(pairs: DataFrame, docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    names = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    keys = materialize(classes.join(names, "name", "left_semi").select("key").distinct(), "jaccard-keys")
    texts = materialize(_texts(docs, keys, id_col, text_col).dropDuplicates(["name"]), "jaccard-texts")
    return materialize(_verified(pairs, texts), "jaccard-links")


def _near_in_size(a: str, b: str):
    return (100 * F.least(a, b) >= PERCENT * F.greatest(a, b))


def _unresolved(shared: DataFrame, found: DataFrame) -> DataFrame:
    """(name, component) of the sets that share a look-up with a set of another component."""
    placed = shared.join(found.select(F.col("node").alias("name"), "component"), "name", "left").withColumn("component", F.coalesce("component", "name"))
    open_ = placed.groupBy("sign").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("sign")
    return placed.join(open_, "sign", "left_semi").select("name", "component").distinct()


def _elements(texts: DataFrame) -> DataFrame:
    """(element, name, size): the shingles of each set."""

    def run(batches):
        for batch in batches:
            for sets in shingle_sets(batch.column(0)):
                sizes = np.diff(sets.bounds)
                names = np.array([n or 0 for n in sets.names()], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(sets.values.view(np.int64)), pa.array(np.repeat(names, sizes)), pa.array(np.repeat(sizes, sizes))], ["element", "name", "size"])

    return texts.select("text").mapInArrow(run, "element long, name long, size long")


def _across(elements: DataFrame, sets: DataFrame, tried: DataFrame) -> DataFrame:
    """The pairs (a, b) of different components that can still link.

    `sets` are (name, component, size, sketch). Their shingles are counted. Of a linked pair both hold a shingle among
    their rarest: the smaller set among its first 1/9, the larger one among its first 1/5; the rest need no look-up.
    Shingles that one set alone has can't be common, and with the sketches they rule out most pairs unseen.
    """
    # counts are summed before the shuffle and written, so that the join on a frequent shingle can be split
    counts = materialize(elements.groupBy("element").agg(F.count("*").alias("n")).where("n > 1"), "jaccard-counts")
    held = elements.join(counts, "element")
    rarest = Window.partitionBy("name").orderBy("n", "element")
    ranked = held.withColumn("rank", F.row_number().over(rarest)).withColumn("known", F.count("*").over(Window.partitionBy("name")))
    low, high = 100 + PERCENT, 2 * PERCENT
    # of the set's size - known shingles that it has alone, all come before the others in its order
    ranked = ranked.withColumn("place", F.col("rank") + F.col("size") - F.col("known")).withColumn("small", F.expr(f"place <= size - cast(ceil(size * {high} / {low}) as bigint) + 1"))
    first = ranked.where(F.expr(f"place <= size - cast(ceil(size * {PERCENT} / 100) as bigint) + 1")).select("element", "name", "known", "small", "n")
    first = materialize(first.join(sets.select("name", "component"), "name"), "jaccard-rarest")
    meeting = materialize(first.groupBy("element").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("element"), "jaccard-meeting")
    first = first.join(meeting, "element", "left_semi").join(sets.drop("component"), "name")
    # a frequent shingle's sets are dealt over lots; the smaller ones of its pairs go to each of them
    lots = F.ceil(F.col("n") / LOT).cast("int")
    other = first.select("element", F.pmod(F.xxhash64("name"), lots).cast("int").alias("lot"), *(F.col(c).alias(f"{c}_b") for c in ("name", "size", "sketch", "known", "component")))
    first = first.where("small").withColumn("lot", F.explode(F.sequence(F.lit(0), lots - 1)))
    order = F.struct("size", "name") < F.struct("size_b", "name_b")
    enough = low * F.least("known", "known_b") >= PERCENT * (F.col("size") + F.col("size_b"))
    pairs = first.join(other, ["element", "lot"]).where(order & (F.col("component") != F.col("component_b")) & enough & _near_in_size("size", "size_b") & _may_link("", "_b"))
    pairs = pairs.select(F.least("name", "name_b").alias("a"), F.greatest("name", "name_b").alias("b")).distinct()
    return pairs.join(tried, ["a", "b"], "left_anti")


def set_names(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, set_name) of every row: equal for texts of equal sets, null for texts without words."""
    return _described(docs, id_col, text_col).select("doc_id", F.col("name").alias("set_name"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", names: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; the component is the smallest doc_id that links reach.

    With `names` also `set_name`, and `leads`: whether the row's set is the first of its component by id and name.

    A text without words, or null, has no shingles and is alone. A text of fewer words than a shingle is one shingle.
    Repeated rows and equal texts link. A null doc_id stays null and never names a component that has another id.
    """
    described = materialize(_described(docs, id_col, text_col), "jaccard-sets")
    classes = materialize(
        described.where("name is not null").groupBy("name")
        .agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("key"), F.min("doc_id").alias("least")), "jaccard-classes",
    )
    shared = materialize(_shared(_indexed(docs, text_col)), "jaccard-shared")
    pivots = shared.groupBy("sign").agg(F.min_by(F.struct("name", "size"), "name").alias("pivot"))
    stars = shared.join(pivots, "sign").where((F.col("name") != F.col("pivot.name")) & _near_in_size("size", "pivot.size"))
    stars = materialize(stars.select(F.col("pivot.name").alias("a"), F.col("name").alias("b")).distinct(), "jaccard-pairs")
    links = _links(stars, docs, classes, id_col, text_col)
    found = materialize(components(links), "jaccard-components")
    open_sets = materialize(_unresolved(shared, found), "jaccard-open")
    if not open_sets.isEmpty():
        keys = materialize(classes.join(open_sets, "name", "left_semi").select("key").distinct(), "jaccard-keys")
        texts = materialize(_texts(docs, keys, id_col, text_col).dropDuplicates(["name"]).join(open_sets, "name"), "jaccard-texts")
        tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        more = materialize(_across(_elements(texts), texts.drop("text"), tried), "jaccard-pairs")
        links = links.unionByName(materialize(_verified(more, texts), "jaccard-links"))
        found = materialize(components(links), "jaccard-components")
    named = classes.join(found, classes["name"] == found["node"], "left").withColumn("component", F.coalesce("component", "name"))
    first = F.min(F.when(F.col("least").isNotNull(), F.struct("least", "name")))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"), first.alias("first"))
    by_class = named.select("name", "component").join(least, "component").select("name", "component_id", (F.col("first.name") == F.col("name")).alias("leads"))
    rows = described.join(by_class, "name", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    more = [F.col("name").alias("set_name"), F.coalesce("leads", F.lit(False)).alias("leads")] if names else []
    return rows.select("doc_id", F.col("size").alias("n_shingles"), "component_id", *more)
