"""Numbered outputs of micro-batches below a folder."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


def finished(spark: SparkSession, prefix: str) -> list[int]:
    """Numbers n of the completely written outputs `<prefix>=n`; others lack the writer's
    marker. One listing by the file system that holds them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{prefix}=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(int(re.search(r"=(-?\d+)/_SUCCESS$", str(f.getPath())).group(1)) for f in found)
