"""Benchmark decontamination on a positional inverted index that is dealt out by documents.

The index is a table: a row is a shard of documents with, for each term, the sorted places where it stands, counted
through the shard. A phrase is found by taking the places of its rarest term, shifted to where the phrase would begin,
and keeping those that every next rarer term confirms at its own shift. How rare a term is, is counted over all shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import ALNUM, U64, words
from tidemark.session import materialize

WINDOW = 10
#: bytes of text in a shard of the index
SHARD_BYTES = 1 << 20
#: words of test items that are searched for at once; more items take more passes over the index
SLICE_WORDS = 1_000_000
#: empty places between the documents of a shard, so that no phrase runs over an end
GAP = 1

_INDEX = "row_ids array<long>, doc_ids array<{kind}>, sizes array<int>, terms array<long>, counts array<int>, places array<int>"


@dataclass(frozen=True)
class Phrases:
    """Windows of terms of equal or smaller length; `item` is a number for each."""

    terms: np.ndarray  # uint64 [n, WINDOW]; the tail of a short one repeats nothing and is masked by `length`
    length: np.ndarray  # int64
    item: np.ndarray  # int64


def phrases(texts: list[str | None], size: int = WINDOW) -> Phrases:
    """All windows of `size` neighbouring words of each text; a shorter text, unless empty, is one window."""
    rows, lengths, items = [], [], []
    for found in words(pa.array(texts, pa.string()), ALNUM):
        bounds = found.bounds()
        for i in range(found.high - found.low):
            own = found.hash[bounds[i] : bounds[i + 1]]
            if len(own) >= size:
                rows.append(np.lib.stride_tricks.sliding_window_view(own, size))
            elif len(own):
                rows.append(np.pad(own, (0, size - len(own)))[None])
            else:
                continue
            lengths.append(np.full(len(rows[-1]), min(size, len(own))))
            items.append(np.full(len(rows[-1]), found.low + i))
    if not rows:
        return Phrases(np.empty((0, size), U64), np.empty(0, np.int64), np.empty(0, np.int64))
    terms, length, item = np.concatenate(rows), np.concatenate(lengths), np.concatenate(items)
    # a window that an item repeats is searched for once
    _, keep = np.unique(np.column_stack([terms, length.astype(U64), item.astype(U64)]), axis=0, return_index=True)
    return Phrases(terms[keep], length[keep], item[keep])


def build_index(docs: DataFrame, terms: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The places of all terms, or of those that the test items hold, written to the shared folder.

    `sizes` are the words of each document; `row_ids` tell rows apart that have one id.
    """
    wanted = None if terms is None else np.unique(terms)
    kind = docs.schema[id_col].dataType.simpleString()

    def column(value, of) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(value)], pa.int32()), value if isinstance(value, pa.Array) else pa.array(value, of))

    def shards(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in words(batch.column("text"), ALNUM, SHARD_BYTES):
                sizes = np.diff(found.bounds())
                place = np.arange(len(found.row)) + found.row * GAP
                known = found.hash
                if wanted is not None:
                    at = np.searchsorted(wanted, known)
                    at[at == len(wanted)] = 0
                    hit = wanted[at] == known if len(wanted) else np.zeros(len(known), bool)
                    place, known = place[hit], known[hit]
                order = np.argsort(known, kind="stable")
                own, counts = np.unique(known[order], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [column(batch.column(c).slice(found.low, found.high - found.low), None) for c in ("row_id", "doc_id")]
                    + [column(sizes, pa.int32()), column(own.view(np.int64), pa.int64()), column(counts, pa.int32()), column(place[order], pa.int32())],
                    ["row_ids", "doc_ids", "sizes", "terms", "counts", "places"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return materialize(rows.mapInArrow(shards, _INDEX.format(kind=kind)), "postings")


def term_counts(index: DataFrame) -> DataFrame:
    """Occurrences of every indexed term over all shards."""

    def count(batches):
        for batch in batches:
            for terms, counts in zip(batch.column("terms"), batch.column("counts"), strict=True):
                yield pa.RecordBatch.from_arrays([terms.values, counts.values.cast(pa.int64())], ["term", "n"])

    return index.select("terms", "counts").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


class Shard:
    """One row of the index, ready for intersections."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        get = lambda name: batch.column(name)[i].values.to_numpy(zero_copy_only=False)
        self.sizes = get("sizes").astype(np.int64)
        self.terms, self.counts = get("terms").view(U64), get("counts").astype(np.int64)
        self.places = get("places").astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.begins = np.concatenate([[0], np.cumsum(self.sizes + GAP)])  # of each document
        # (term, place) as one sorted key, for membership
        self.keys = np.repeat(np.arange(len(self.terms), dtype=np.int64) << 32, self.counts) | self.places

    def number(self, terms: np.ndarray) -> np.ndarray:
        """The shard's own number of each term, -1 for none."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def expand(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All places of each of these terms: whose it is, and the place."""
        n = self.counts[number]
        who = np.repeat(np.arange(len(number)), n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return who, self.places[self.starts[number][who] + within]

    def stands(self, number: np.ndarray, place: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(place), bool)
        key = (number << 32) | np.maximum(place, 0)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (self.keys[at] == key) & (place >= 0)

    def documents(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, place, "right") - 1

    def exact(self, wanted: Phrases, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences: the window, and the place it begins. `order` gives each window's words, rarest first."""
        number = self.number(wanted.terms)
        inside = np.arange(wanted.terms.shape[1]) < wanted.length[:, None]
        window = np.flatnonzero(((number >= 0) | ~inside).all(axis=1))
        if not len(window):
            return window, window
        who, place = self.expand(number[window, order[window, 0]])
        window = window[who]
        begin = place - order[window, 0]
        for k in range(1, wanted.terms.shape[1]):
            word = order[window, k]
            keep = (k >= wanted.length[window]) | self.stands(number[window, word], begin + word)
            window, begin = window[keep], begin[keep]
        return window, begin

    def near(self, terms: np.ndarray, span: int) -> np.ndarray:
        """Places of a term from which on all terms stand in one document, at most `span` words on.

        Terms are tried rarest first, which only says how soon places are ruled out.
        """
        number = self.number(terms)
        if (number < 0).any():
            return np.empty(0, np.int64)
        number = number[np.argsort(self.counts[number], kind="stable")]
        place = np.unique(np.concatenate([self.places[self.starts[n] : self.starts[n + 1]] for n in number]))
        for term in number:
            other = self.places[self.starts[term] : self.starts[term + 1]]
            doc = self.documents(place)
            end = np.minimum(place + span + 1, self.begins[doc + 1] - GAP)
            place = place[np.searchsorted(other, place) < np.searchsorted(other, end)]
        return place


def _rarest_first(wanted: Phrases, counted: dict[int, int]) -> np.ndarray:
    terms, back = np.unique(wanted.terms, return_inverse=True)
    n = np.array([counted.get(int(t), 0) for t in terms.view(np.int64)], np.int64)[back].reshape(wanted.terms.shape)
    n[np.arange(wanted.terms.shape[1]) >= wanted.length[:, None]] = np.iinfo(np.int64).max
    return np.argsort(n, axis=1, kind="stable")


def _slices(items: DataFrame) -> Iterator[list]:
    """The test items in lots of bounded size; the driver holds one lot at a time."""
    sized = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    n = sized.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    lots = 1 + n // (2 * SLICE_WORDS)
    for k in range(lots):
        rows = sized.where(F.pmod(F.xxhash64("text"), F.lit(lots)) == k).collect()
        if rows:
            yield rows


_HITS = "row_id long, doc_id {kind}, n_words long, spans array<array<long>>, items array<string>"


def _hits(index: DataFrame, wanted: Phrases, order: np.ndarray, names: list[str | None]) -> DataFrame:
    """For each document the words inside occurrences as [begin, end) ranges, and the ids of the items."""
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()

    def search(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch, i)
                window, begin = shard.exact(wanted, order)
                doc = shard.documents(begin)
                by = np.lexsort((begin, doc))
                window, begin, doc = window[by], begin[by], doc[by]
                spans: list[list] = [[] for _ in shard.sizes]
                items: list[list] = [[] for _ in shard.sizes]
                for own in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(doc)) + 1) if len(doc) else []:
                    d = doc[own[0]]
                    low = begin[own] - shard.begins[d]
                    spans[d] = _merged(low, low + wanted.length[window[own]])
                    items[d] = [names[i] for i in np.unique(wanted.item[window[own]]).tolist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row_ids")[i].values, batch.column("doc_ids")[i].values, pa.array(shard.sizes), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string()))],
                    ["row_id", "doc_id", "n_words", "spans", "items"],
                )

    return index.mapInArrow(search, _HITS.format(kind=kind))


def _merged(low: np.ndarray, high: np.ndarray) -> list[list[int]]:
    """Overlapping ranges as one; they come in order of `low`."""
    out: list[list[int]] = []
    for a, b in zip(low.tolist(), high.tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """Occurrences of the items' windows in whole documents, one row for each input row.

    Gives (doc_id, n_words, n_hit, items array<string>, spans). `spans` are [begin, end) word ranges. `items` are the
    distinct ids of items with a window in the document, sorted as strings; an item with a null id hits but is not
    listed. A null text has no words, in either table; a null doc_id stays; repeated rows stand for themselves; without
    items nothing is hit. Other columns are left out.
    """
    lots = list(_vocabulary(items))
    index = build_index(docs, np.unique(np.concatenate(lots)) if lots else np.empty(0, U64), id_col, text_col)
    counts = term_counts(index)
    spark, hits = docs.sparkSession, []
    for rows in _slices(items) if lots else [[]]:
        found = phrases([r["text"] for r in rows], size)
        asked = spark.createDataFrame([(t,) for t in np.unique(found.terms).view(np.int64).tolist()], "term long")
        counted = {r["term"]: r["n"] for r in counts.join(F.broadcast(asked), "term", "left_semi").collect()} if len(found.item) else {}
        names = [None if r["item_id"] is None else str(r["item_id"]) for r in rows]
        hits.append(_hits(index, found, _rarest_first(found, counted), names))
    every = hits[0]
    if len(hits) > 1:
        for more in hits[1:]:
            every = every.unionByName(more)
        every = every.groupBy("row_id").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    return _answer(every)


def _vocabulary(items: DataFrame) -> Iterator[np.ndarray]:
    for rows in _slices(items):
        for found in words(pa.array([r["text"] for r in rows], pa.string()), ALNUM):
            yield np.unique(found.hash)


def _answer(every: DataFrame) -> DataFrame:
    """Ranges of all slices as one, and the words they cover."""
    spans = F.array_sort("spans")
    reach = F.expr("aggregate(ordered, named_struct('n', 0L, 'end', 0L), (a, s) -> named_struct('n', a.n + greatest(0L, s[1] - greatest(s[0], a.end)), 'end', greatest(a.end, s[1])), a -> a.n)")
    listed = F.array_sort(F.array_distinct(F.filter("items", lambda i: i.isNotNull())))
    return every.withColumn("ordered", spans).select("doc_id", "n_words", reach.alias("n_hit"), listed.alias("items"), F.col("ordered").alias("spans"))


def proximity(docs: DataFrame, terms: list[str], span: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents in which all terms stand at most `span` words apart: (doc_id, n), n places of a term where such a stretch begins.

    What is found in a document hangs on it alone. Without terms nothing is found.
    """
    asked = np.concatenate([w.hash for w in words(pa.array([" ".join(terms)]), ALNUM)])
    kind = docs.schema[id_col].dataType.simpleString()

    def search(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch, i)
                doc, n = np.unique(shard.documents(shard.near(np.unique(asked), span)), return_counts=True) if len(asked) else (np.empty(0, int),) * 2
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[i].values.take(pa.array(doc, pa.int64())), pa.array(n, pa.int64())], ["doc_id", "n"])

    return build_index(docs, asked, id_col, text_col).mapInArrow(search, f"doc_id {kind}, n long")
