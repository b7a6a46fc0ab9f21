"""The registered query of k-d sharding; its cuts are beyond SQL, tests hold them against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import sharding
from tidemark.llm.cluster import read_table

SHARDS = 40


def op13_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes, by a k-d tree over source, language, characters and id."""
    found = sharding.kd_shards(read_table(spark, sf_dir, "documents"), shards=SHARDS)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op13_kd_shards": op13_kd_shards}
