"""Gets a session ready for the operators that run Python in tasks."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import configure

#: ids that are held in every task at most (8 MB); more are joined by a shuffle
BROADCAST_IDS = 1_000_000

_sent: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings, and the package's sources sent to the executors, once for each application.

    Spark hands the sources out itself, so executors need neither the driver's folders nor an installed package.
    """
    context = spark.sparkContext
    if context.applicationId not in _sent:
        package = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="tidemark-sources-")) / "tidemark-sources.zip"
        with zipfile.ZipFile(target, "w") as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent))
        context.addPyFile(str(target))
        _sent.add(context.applicationId)
    return configure(spark)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def by_ids(rows: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """A left_semi or left_anti join on an integer key, null ids included, with the ids counted to choose how.

    A few ids are sent to every task, so that the rows, which hold whole texts, stay where they are.
    """
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    chosen = ids.select(F.col(key).alias("_key"))
    return rows.join(F.broadcast(chosen) if few else chosen, rows[key].eqNullSafe(chosen["_key"]), how)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores added until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
