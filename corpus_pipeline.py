"""From raw documents to packed training sequences: quality, near duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and gets what the stage before it kept, written as Parquet and read again. All
but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard, packing, pii, quality
from tidemark.llm.cluster import by_ids, free_name, prepare
from tidemark.llm.queries import VOCABULARY, table
from tidemark.session import materialize, scratch_dir


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, scored by a model fitted on the labelled ones."""
    model = quality.fit_labelled(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs, "score")
    return quality.score(docs, model, keep=docs.columns, name=name).where(F.col(name) >= quality.THRESHOLD).select(docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    Documents without words stay, and so do rows without an id. Rows that share an id are told apart by their sets of
    shingles: one of a group's first id and set stays.
    """
    prepare(spark)
    near = jaccard.near_duplicates(docs, names=True).where("doc_id is not null")
    stays = F.col("set_name").isNull() | (F.col("leads") & (F.col("doc_id") == F.col("component_id")))
    near = materialize(near.select("doc_id", "set_name", stays.alias("stays")), "near-duplicates")
    by_id = near.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("stays").alias("any"))
    kept = by_ids(docs, by_id.where("not any").select("doc_id"), "doc_id", "left_anti")
    repeated = materialize(by_id.where("any and n > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept.select(docs.columns)
    number = free_name(docs, "row")
    rows = materialize(by_ids(kept, repeated, "doc_id", "left_semi").withColumn(number, F.monotonically_increasing_id()), "repeated-rows")
    names = jaccard.set_names(rows, id_col=number).withColumnRenamed("doc_id", number).join(rows.select(number, F.col("doc_id").alias("id")), number)
    wordless = names.where("set_name is null").select(number)
    firsts = names.groupBy("id", "set_name").agg(F.min(number).alias(number)).join(near.where("stays").select(F.col("doc_id").alias("id"), "set_name").distinct(), ["id", "set_name"])
    chosen = materialize(wordless.unionByName(firsts.select(number)), "repeated-kept")
    return by_ids(kept, repeated, "doc_id", "left_anti").select(docs.columns).unionByName(by_ids(rows, chosen, number, "left_semi").select(docs.columns))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Rows that share an id are each judged by their own text."""
    benchmark = table(spark, sf_dir, "benchmark")
    found = decontaminate.decontaminate(docs, benchmark)
    by_id = materialize(found.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.expr("n_hit > 0")).alias("hits")), "contaminated")
    kept = by_ids(docs, by_id.where("n = hits").select("doc_id"), "doc_id", "left_anti")
    mixed = by_id.where("hits > 0 and hits < n").select("doc_id")
    if mixed.isEmpty():
        return kept.select(docs.columns)
    number = free_name(docs, "row")
    rows = materialize(by_ids(kept, mixed, "doc_id", "left_semi").withColumn(number, F.monotonically_increasing_id()), "mixed-rows")
    hit = materialize(decontaminate.decontaminate(rows, benchmark, id_col=number).where("n_hit > 0").select(F.col("doc_id").alias(number)), "mixed-hits")
    return by_ids(kept, mixed, "doc_id", "left_anti").select(docs.columns).unionByName(by_ids(rows, hit, number, "left_anti").select(docs.columns))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    prepare(spark)
    return pii.redact(docs).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in the training sequences."""
    prepare(spark)
    return packing.pack_documents(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", keep_clean),
    ("PII", hide_personal_data),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_dir(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: tokens and a fitted classifier are beyond SQL: tests hold the stages against brute force
ORACLE_SQL = None
