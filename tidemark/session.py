"""Session settings the jobs rely on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUNTIME_SETTINGS = {
    # positions and times are compared as stored, so one zone for all of them
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even where that costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; cluster sizing is left to the caller."""
    for key, value in _RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as `spark.checkpoint.dir` names it.

    Only a local session may go without the setting; it then gets a fresh folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder, never handed out twice."""
    return f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tidemark/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove all that this application has put below the shared folder.

    Results are read lazily from there: call it when they have been written elsewhere.
    """
    delete_folder(spark, _own_folder(spark))


def delete_folder(spark: SparkSession, path: str) -> bool:
    """Whether there was anything to delete."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def folder_exists(spark: SparkSession, path: str) -> bool:
    """Asked of whatever file system holds the path."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def partition_values(spark: SparkSession, path: str, column: str) -> list[str]:
    """The values that a table stored by `column` has folders for."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder) if f.isDirectory()]
    return [name.removeprefix(f"{column}=") for name in names if name.startswith(f"{column}=")]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, written from here by way of whatever file system holds the path."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = file.getFileSystem(spark._jsc.hadoopConfiguration()).create(file, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    source = file.getFileSystem(spark._jsc.hadoopConfiguration()).open(file)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write once to the shared folder and read back.

    Unlike a cached plan this survives lost executors, and unlike `checkpoint()` the
    input is computed once and the size of the result is known to the optimizer.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
