"""Row images of tables of different columns: decoded by each table's schema, folded for all tables at once.

A change event carries the row before and after it as JSON text. What its key is, and what its columns are, comes from
the table's layout (schema and key columns). Keys are read with their types and written in one form, so a key is one
whatever its text looked like in the log. All tables share one aggregate by (table, key); only then does each table
decode its own rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import restore

Layout = tuple[T.StructType, list[str]]

# fixed values: how moments are written, with microseconds; text that is no row is an error
_WRITE = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}
_READ = {"mode": "FAILFAST"}


def encode(row: Column) -> Column:
    """A struct as the text that `before` and `after` hold."""
    return F.to_json(row, _WRITE)


def decode(text: Column, schema: T.StructType) -> Column:
    """The row of a text: columns that the schema lacks are left out, those that the text lacks are null."""
    return F.from_json(text, _nullable(schema), _READ)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])


def _key_schema(layout: Layout) -> T.StructType:
    schema, keys = layout
    return T.StructType([T.StructField(k, schema[k].dataType) for k in keys])


def row_key(layouts: Mapping[str, Layout], text: Column) -> Column:
    """The key of an event's row as text, by its `tbl`; null for other tables.

    Tables whose keys have the same names and types share a branch.
    """
    by_key: dict[str, tuple[T.StructType, list[str]]] = {}
    for name, layout in layouts.items():
        kind = _key_schema(layout)
        by_key.setdefault(kind.json(), (kind, []))[1].append(name)
    out = F.lit(None).cast("string")
    for kind, names in by_key.values():
        out = F.when(F.col("tbl").isin(names), encode(decode(text, kind))).otherwise(out)
    return out


def latest_rows(events: DataFrame, layouts: Mapping[str, Layout]) -> DataFrame:
    """(tbl, row_key, row, live): the last image of every key of all tables, `row` as text.

    An update that changes the key deletes the old one and writes the new one, in this order. Events of tables without a
    layout are left out.
    """
    known = events.filter(F.col("tbl").isin(list(layouts)))
    keyed = known.withColumn("_old", row_key(layouts, F.col("before"))).withColumn("_new", row_key(layouts, F.col("after")))
    gone = F.struct(F.col("_old").alias("row_key"), F.lit(None).cast("string").alias("row"), F.lit(0).alias("step"))
    here = F.struct(F.col("_new").alias("row_key"), F.col("after").alias("row"), F.lit(1).alias("step"))
    moved = (F.col("op") == "U") & F.col("_old").isNotNull() & (F.col("_old") != F.col("_new"))
    parts = F.when(F.col("op") == "D", F.array(gone)).when(moved, F.array(gone, here)).otherwise(F.array(here))
    steps = keyed.select("tbl", "log_no", "log_pos", "sub", F.explode(parts).alias("p")).select("tbl", "log_no", "log_pos", "sub", "p.*")
    at = F.struct("log_no", "log_pos", "sub", "step")
    last = steps.groupBy("tbl", "row_key").agg(F.max_by(F.struct("row"), at).alias("_last"))
    return last.select("tbl", "row_key", F.col("_last.row").alias("row"), F.col("_last.row").isNotNull().alias("live"))


def table_image(stored: DataFrame, name: str, layout: Layout) -> DataFrame:
    """One table's rows of the images, in its own columns; of deleted rows the key columns alone."""
    schema, keys = layout
    own = stored.filter(F.col("tbl") == name).select(decode(F.col("row_key"), _key_schema(layout)).alias("_key"), decode(F.col("row"), schema).alias("_row"), "live")
    return own.select(*(F.col(f"_key.{k}").alias(k) for k in keys), *(F.col(f"_row.{f.name}").alias(f.name) for f in schema.fields if f.name not in keys), "live")


def lay_over(layouts: Mapping[str, Layout], tables: Mapping[str, DataFrame], events: DataFrame) -> dict[str, DataFrame]:
    """Every table with its events laid over it, in its own columns."""
    stored, counts = restore.image_by_table(latest_rows(events, layouts))
    out = {}
    for name, base in tables.items():
        schema, keys = layouts[name]
        payload = [f.name for f in schema.fields if f.name not in keys]
        merged = restore.merge(base, table_image(stored, name, layouts[name]), keys, payload, counted=counts.get(name, 0))
        out[name] = merged.select(*schema.fieldNames())
    return out
