"""Quality classifier: logistic regression on hashed word n-grams, fitted by follow the regularised leader.

A score is a sparse dot product: the weights of a text's words, word pairs and repeats, over the root of their number. Each
shard of the labelled sample fits a model of its own; their mean is the model (parameter mixing). A model has
2**BITS weights at any input size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.cluster import free_name
from tidemark.llm.words import MARKED, U64, Words, chained, words

BITS = 18
#: labelled rows that a model is fitted on, about; a share of all is taken by the hash of the id
SAMPLE_ROWS = 16_000
SHARDS = 4
EPOCHS = 3
#: step size and regularisation
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.0005, 0.0005
THRESHOLD = 0.7


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # float32[2**BITS]
    bias: float


#: the slot of all pairs of one word and itself, with marks between or not: no text has many of any one such pair
AGAIN = 1


def features(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """The slot of each word, word pair and repeat, and whose text it is from."""
    slot = (found.hash >> U64(64 - BITS)).astype(np.int64)
    pair = (chained(found.hash, 2, salt=7) >> U64(64 - BITS)).astype(np.int64)
    together = found.row[1:] == found.row[:-1]
    word = found.kind == 1
    plain, row = found.hash[word], found.row[word]
    again = row[1:][(plain[1:] == plain[:-1]) & (row[1:] == row[:-1])]
    return np.concatenate([slot, pair[together], np.full(len(again), AGAIN)]), np.concatenate([found.row, found.row[1:][together], again])


def fit_shard(slots: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Follow the regularised leader over the rows in order, `epochs` times; the last slot is the bias."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weight(at):
        own = z[at]
        return np.where(np.abs(own) <= L1, 0.0, -(own - np.sign(own) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for at, x, y in zip(slots, values, labels, strict=True):
            w = weight(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y) * x
            square = g * g
            z[at] += g - (np.sqrt(n[at] + square) - np.sqrt(n[at])) / ALPHA * w
            n[at] += square
    every = weight(np.arange(len(z)))
    return every[:-1], float(every[-1])


def _rows(found: Words) -> tuple[list[np.ndarray], list[np.ndarray]]:
    slot, row = features(found)
    by = np.lexsort((slot, row))
    slot, row = slot[by], row[by]
    bounds = np.searchsorted(row, np.arange(found.high - found.low + 1))
    slots, values = [], []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        at, n = np.unique(slot[a:b], return_counts=True)
        slots.append(np.append(at, 1 << BITS))
        values.append(np.append(n / np.sqrt(max(1, b - a)), 1.0))
    return slots, values


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label", rows: int = SAMPLE_ROWS) -> Model:
    """A model from about `rows` labelled texts, or all if there are fewer. Null labels and ids are left out.

    Which ones is up to their ids' hashes. Without any labelled row every score is a half.
    """
    known = labelled.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    # a count of the ids alone: the texts are not read for it
    share = min(1.0, rows / max(1, known.select(id_col).count()))
    sample = known.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)) < round(share * (1 << 30)))
    dealt = sample.select(
        F.col(text_col).alias("text"), F.col(label_col).cast("double").alias("label"), F.pmod(F.xxhash64(F.col(id_col), F.lit("shard")), F.lit(SHARDS)).alias("shard"),
        F.xxhash64(F.col(id_col), F.lit("order")).alias("turn"),
    )

    def train(table: pa.Table) -> pa.Table:
        table = table.sort_by("turn").combine_chunks()
        slots, values = [], []
        texts = table.column("text").combine_chunks()
        for found in words(texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts, MARKED):
            own = _rows(found)
            slots += own[0]
            values += own[1]
        weights, bias = fit_shard(slots, values, table.column("label").to_numpy())
        return pa.table({"weights": pa.array([weights.astype("f4").tobytes()], pa.binary()), "bias": [bias], "rows": [table.num_rows]})

    shards = dealt.groupBy("shard").applyInArrow(train, "weights binary, bias double, rows long").collect()  # a vector of fixed size each
    total = sum(r["rows"] for r in shards) or 1
    mean = np.zeros(1 << BITS)
    for r in sorted(shards, key=lambda r: bytes(r["weights"])):
        mean += np.frombuffer(r["weights"], "f4").astype("f8") * (r["rows"] / total)
    return Model(mean.astype("f4"), sum(r["bias"] * r["rows"] for r in shards) / total)


def scores(found: Words, model: Model) -> np.ndarray:
    slot, row = features(found)
    size = found.high - found.low
    n = np.bincount(row, minlength=size)
    dot = np.bincount(row, model.weights[slot], minlength=size) / np.sqrt(np.maximum(n, 1)) + model.bias
    return 1.0 / (1.0 + np.exp(-np.clip(dot, -30, 30)))


def score(docs: DataFrame, model: Model, *, keep: list[str], text_col: str = "text", name: str = "score") -> DataFrame:
    """The columns of `keep` and the score, 0 to 1, higher for better texts; a null or empty text has the bias alone."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + f", `{name}` double"

    def run(batches):
        for batch in batches:
            own = [scores(found, model) for found in words(batch.column(len(keep)), MARKED)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(np.concatenate(own) if own else [], pa.float64())], [*keep, name])

    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text_col).alias(free_name(docs, "_text"))).mapInArrow(run, schema)


def held_out(id_col: str):
    """Rows that no model is fitted on."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2


def fit_labelled(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled documents that are not held out. A document with several labels counts once for each."""
    marks = labels.where(~held_out("doc_id")).select(F.col("doc_id").alias("_label_of"), F.col("quality").alias("label"))
    return fit(docs.select("doc_id", "text").join(marks, F.col("doc_id") == F.col("_label_of")))


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """All documents with score and predicted (1 from `threshold` on); a null doc_id is not held out."""
    scored = score(docs, fit_labelled(docs, labels), keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
