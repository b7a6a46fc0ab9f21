"""Rebuilding a table: the latest image per key of a log range, merged onto a snapshot."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ordered import plan_bytes
from tidemark.operators.select import keep_names_on_restore
from tidemark.session import materialize, scratch_dir

# changed keys up to this estimate, or this count, are worth sending to every executor
BROADCAST_BYTES = 32 * 1024 * 1024
BROADCAST_KEYS = 2_000_000
# above this estimate it pays to look for the shortest position number first
PACK_BYTES = 1024**3

_FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


Key = str | Sequence[str]


def key_columns(key: Key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def latest_image(changes: DataFrame, key: Key, payload: Sequence[str], *, partial: bool = False) -> DataFrame:
    """The last event of each key, deletes included: key, payload, `live`. A key is one column or several.

    An aggregate rather than `row_number`: each task sends one row per key, so a key with
    most of the events costs no more than any other. Fixed-width columns are kept one by
    one by a numeric position, which the aggregate updates in place and hashes; others
    travel as one struct, for which Spark sorts within each task.

    partial: events carry only the changed columns, absent ones are null; then each
    column takes its last present value since the key's last delete or insert.
    """
    keys = key_columns(key)
    if partial:
        return _partial_image(changes, keys, payload)
    at = position_number(changes)
    # the op code as a number keeps the aggregate's state fixed-width
    op = F.ascii("op").alias("_op")
    if all(isinstance(changes.schema[c].dataType, _FIXED_WIDTH) for c in payload):
        rows = changes.groupBy(*keys).agg(*(F.max_by(c, at).alias(c) for c in payload), F.max_by(op, at).alias("_op"))
    else:
        rows = changes.groupBy(*keys).agg(F.max_by(F.struct(*payload, op), at).alias("_last")).select(*keys, "_last.*")
    return rows.withColumn("live", F.col("_op") != F.ascii(F.lit("D"))).drop("_op")


def position_number(changes: DataFrame) -> Column:
    """(log_no, log_pos, sub) as one exact number that sorts the same way.

    A large input is first asked for its highest values, one read of three narrow columns:
    if their bits fit a long together, aggregates run about twice as fast as by decimals.
    """
    names = ("log_no", "log_pos", "sub")
    if plan_bytes(changes) > PACK_BYTES:
        highest = changes.agg(*(F.max(n) for n in names), *(F.min(n) for n in names)).first()
        tops, lows = highest[:3], highest[3:]
        if None not in tops and min(lows) >= 0:
            bits = [int(top).bit_length() for top in tops]
            if sum(bits) <= 63:
                no, pos, sub = (F.col(n).cast("long") for n in names)
                return F.shiftleft(no, bits[1] + bits[2]) + F.shiftleft(pos, bits[2]) + sub
    # 31, 63 and 31 bits hold any values of the three types, and 125 bits fit 38 digits
    no, pos, sub = (F.col(n).cast(f"decimal({digits},0)") for n, digits in zip(names, (10, 19, 10)))
    high = (no * F.lit(Decimal(2**63)) + pos).cast("decimal(29,0)")
    return (high * F.lit(Decimal(2**31)) + sub).cast("decimal(38,0)")


def _partial_image(changes: DataFrame, keys: list[str], payload: Sequence[str]) -> DataFrame:
    """Values older than a row's rebirth must not show through: each is kept with its
    position and compared with the position of the key's last insert or delete."""
    at = F.struct("log_no", "log_pos", "sub")
    reset = F.max(F.when(F.col("op").isin("I", "D"), at)).alias("_reset")
    last_op = F.max_by("op", at).alias("_op")
    latest = [F.max(F.when(F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c).alias("v")))).alias(f"_{c}") for c in payload]
    rows = changes.groupBy(*keys).agg(last_op, reset, *latest)
    values = [
        F.when(F.col("_reset").isNull() | (F.col(f"_{c}.at") >= F.col("_reset")), F.col(f"_{c}.v")).alias(c) for c in payload
    ]
    # without a reset the row goes on from the snapshot, whose values fill what is absent
    return rows.select(*keys, *values, (F.col("_op") != "D").alias("live"), F.col("_reset").isNull().alias("continues"))


def image_by_table(image: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """An image of several tables (`tbl`), written once with a folder for each, and the rows of each table.

    One count for all; as many entries as there are tables.
    """
    spark = image.sparkSession
    path = scratch_dir(spark, "images")
    image.hint("rebalance", "tbl").write.partitionBy("tbl").parquet(path)
    # an image without rows has no folders to tell the schema by
    schema = T.StructType([f for f in image.schema.fields if f.name != "tbl"] + [image.schema["tbl"]])
    stored = spark.read.schema(schema).parquet(path)
    return stored, {r["tbl"]: r["n"] for r in stored.groupBy("tbl").agg(F.count("*").alias("n")).collect()}


def merge(base: DataFrame, image: DataFrame, key: Key, payload: Sequence[str], strategy: str | None = None, *, counted: int | None = None) -> DataFrame:
    """The snapshot with an image laid over it: changed rows replaced, deleted ones gone.

    Unchanged base rows come by an anti join, then the live rows of the image, one for each key
    whatever the base holds. "patch" broadcasts the changed keys, and the base is then never
    shuffled; "rebuild" shuffles both, where there are too many keys for that. The result is the
    same. By default the number of changed keys decides, and "patch" is only done where they are few
    enough. An estimate cannot tell how few keys a long log comes down to, so an image is written out
    first and then counted; one that is stored already comes with its rows `counted`.

    Partial images need the base row: they are joined to it, and `key` must be unique in the base.
    """
    keys = key_columns(key)
    columns = [*keys, *payload]
    if "continues" in image.columns:
        if strategy == "patch":
            raise ValueError("partial images need the base row: use the rebuild strategy")
        return _merge_partial(base, image, keys, payload)
    if strategy not in (None, "patch", "rebuild"):
        raise ValueError(f"unknown strategy: {strategy}")
    if counted is None:
        image = materialize(image, "image")
    changed, few = image.select(*keys), False
    if strategy != "rebuild":
        few = (image.count() if counted is None else counted) <= BROADCAST_KEYS and plan_bytes(changed) <= BROADCAST_BYTES
    kept = base.select(columns).join(F.broadcast(changed) if few else changed, keys, "left_anti")
    return kept.unionByName(image.filter("live").select(columns))


def _merge_partial(base: DataFrame, image: DataFrame, keys: list[str], payload: Sequence[str]) -> DataFrame:
    old = base.select(*keys, *payload, F.lit(True).alias("_old")).alias("b")
    new = image.select(*image.columns, F.lit(True).alias("_new")).alias("i")
    joined = old.join(new, keys, "full_outer").filter(F.col("_new").isNull() | F.col("live"))
    values = []
    for c in payload:
        value = F.when(F.col("i.continues"), F.coalesce(F.col(f"i.{c}"), F.col(f"b.{c}"))).otherwise(F.col(f"i.{c}"))
        values.append(F.when(F.col("_new").isNull(), F.col(f"b.{c}")).otherwise(value).alias(c))
    return joined.select(*keys, *values)


def rename_database(rows: DataFrame, source: str, target: str, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Rows of `source` under the name `target`; table lists go by the source's names."""
    chosen = keep_names_on_restore(rows.filter(F.col("db") == source), "tbl", include, exclude)
    return chosen.withColumn("db", F.lit(target))


def latest_events(events: DataFrame, key: Key, payload: Sequence[str]) -> DataFrame:
    """The last event of each key with its position, deletes included, for folding later."""
    kept = [*payload, "op", "log_no", "log_pos", "sub"]
    last = F.max_by(F.struct(*kept), F.struct("log_no", "log_pos", "sub")).alias("_last")
    keys = key_columns(key)
    return events.groupBy(*keys).agg(last).select(*keys, "_last.*")
