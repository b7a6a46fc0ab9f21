"""Comparing tables and arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ordered import plan_bytes
from tidemark.session import materialize

# above this estimate rows are compared by digest first, and only changed ones travel whole
DIGEST_BYTES = 10 * 1024**3


def arrays_equal(a: Column, b: Column) -> Column:
    """Equal as multisets: order does not matter, counts do."""
    return F.array_sort(a).eqNullSafe(F.array_sort(b))


def comparable(value: Column, kind: T.DataType, unordered: bool = False) -> Column:
    """`value` in a form that can be compared, sorted and hashed without losing anything.

    Hashes pass over nulls and know no maps, and maps can't be compared: so each inner value
    goes with a flag for null, each array with its size, and a map is its sorted entries. With
    `unordered` an array is a multiset; arrays inside keep their order.
    """
    if isinstance(kind, T.ArrayType):
        items = F.transform(value, lambda x: _held(x, kind.elementType))
        return F.when(value.isNotNull(), F.struct(F.size(value).alias("n"), (F.array_sort(items) if unordered else items).alias("items")))
    if isinstance(kind, T.MapType):
        entries = F.transform(
            F.map_entries(value), lambda e: F.struct(comparable(e["key"], kind.keyType).alias("key"), _held(e["value"], kind.valueType).alias("value"))
        )
        return F.when(value.isNotNull(), F.struct(F.size(value).alias("n"), F.array_sort(entries).alias("items")))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(_held(value[f.name], f.dataType).alias(f"f{i}") for i, f in enumerate(kind.fields))))
    return value


def _held(value: Column, kind: T.DataType, unordered: bool = False) -> Column:
    return F.struct(value.isNull().alias("none"), comparable(value, kind, unordered).alias("value"))


def _row_digest(values: Sequence[tuple[Column, T.DataType, bool]]) -> tuple[Column, Column]:
    """Two 64-bit hashes of (value, type, unordered) triples, nulls at any depth included."""
    parts = [_held(*v) for v in values]
    return F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)


def multiset_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows the two tables do not hold equally often, with `surplus` (left minus right).

    One aggregate over both, combined before the exchange; empty if the tables are equal.
    """
    columns = left.columns
    both = left.withColumn("_n", F.lit(1)).unionByName(right.select(columns).withColumn("_n", F.lit(-1)))
    return both.groupBy(*columns).agg(F.sum("_n").alias("surplus")).filter(F.col("surplus") != 0)


def leaf_fields(schema: T.StructType, prefix: str = "") -> list[tuple[str, T.DataType]]:
    """Dotted names of the columns below nested structs."""
    leaves: list[tuple[str, T.DataType]] = []
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            leaves += leaf_fields(f.dataType, f"{prefix}{f.name}.")
        else:
            leaves.append((f"{prefix}{f.name}", f.dataType))
    return leaves


def table_diff(old: DataFrame, new: DataFrame, key: str | Sequence[str], include_removed: bool = False, strategy: str | None = None) -> DataFrame:
    """New values of changed fields: key, `change`, `field`, `new_value` as text.

    Nested structs are compared field by field (`b.c`), arrays as multisets. Fields only
    in `new` count as added to every row; fields only in `old` give nothing. Rows only in
    `new` give all their fields; rows only in `old` give nothing unless asked for, and
    then one row without a field. `key`, one column or several, is unique on both sides.
    Maps are compared by their entries.

    "direct" joins whole rows. "digest" first joins 128-bit row digests and carries whole
    rows for differing keys only, which pays off where tables are large and alike.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if strategy is None:
        strategy = "digest" if plan_bytes(old) + plan_bytes(new) > DIGEST_BYTES else "direct"
    if strategy == "digest":
        differing = materialize(_differing_keys(old, new, keys), "diff-keys")
        old, new = old.join(differing, keys, "left_semi"), new.join(differing, keys, "left_semi")
    elif strategy != "direct":
        raise ValueError(f"unknown strategy: {strategy}")

    before = {name for name, _ in leaf_fields(old.schema)}
    a = old.select(*keys, F.struct(*old.columns).alias("_a"))
    b = new.select(*keys, F.struct(*new.columns).alias("_b"))
    joined = a.join(b, keys, "full_outer")
    added, removed = F.col("_a").isNull(), F.col("_b").isNull()
    entries = []
    for name, kind in leaf_fields(new.schema):
        if name in keys:
            continue
        value = F.col(f"_b.{name}")
        if name not in before:
            same = value.isNull()
        elif isinstance(kind, (T.ArrayType, T.MapType)):
            same = comparable(F.col(f"_a.{name}"), kind, True).eqNullSafe(comparable(value, kind, True))
        else:
            same = F.col(f"_a.{name}").eqNullSafe(value)
        text = F.to_json(value) if isinstance(kind, (T.ArrayType, T.MapType)) else value.cast("string")
        entries.append(F.when(~removed & (added | ~same), F.struct(F.lit(name).alias("field"), text.alias("new_value"))))
    found = F.filter(F.array(*entries), lambda e: e.isNotNull())
    change = F.when(added, "added").when(removed, "removed").otherwise("changed")
    rows = joined.select(*keys, change.alias("change"), found.alias("_found"))
    result = rows.filter(F.size("_found") > 0).select(*keys, "change", F.inline("_found"))
    if include_removed:
        gone = rows.filter(F.col("change") == "removed")
        nothing = F.lit(None).cast("string")
        result = result.unionByName(gone.select(*keys, "change", nothing.alias("field"), nothing.alias("new_value")))
    return result


def _differing_keys(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose rows differ in a field of `new`: fields only in `old` give nothing, so they are not hashed."""
    kinds = dict(leaf_fields(new.schema))

    def digest(df: DataFrame, name: str) -> DataFrame:
        there = dict(leaf_fields(df.schema))
        values = [(F.col(leaf) if leaf in there else F.lit(None).cast(kind), kind, True) for leaf, kind in kinds.items()]
        return df.select(*keys, F.struct(*_row_digest(values)).alias(name))

    joined = digest(old, "_a").join(digest(new, "_b"), keys, "full_outer")
    return joined.filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys)


def verify_tables(restored: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: row counts of both sides and whether they hold the same rows.

    Order-free sums of row hashes, added up in one aggregate without any exchange of rows.
    """
    kinds = {f.name: f.dataType for f in expected.schema.fields}

    def side(df: DataFrame, sign: int) -> DataFrame:
        h, g = _row_digest([(F.col(c), kinds[c], False) for c in sorted(kinds)])
        return df.select(F.lit(sign).alias("s"), h.alias("h"), g.alias("g"))

    both = side(restored, 1).unionAll(side(expected, -1))
    signed = [F.sum(F.col("s") * F.col(c).cast("decimal(20,0)")) for c in ("h", "g")]
    totals = both.agg(
        F.count_if(F.col("s") == 1).alias("restored_rows"),
        F.count_if(F.col("s") == -1).alias("expected_rows"),
        *(F.coalesce(total, F.lit(0)).alias(name) for total, name in zip(signed, ("_h", "_g"))),
    )
    equal = (F.col("restored_rows") == F.col("expected_rows")) & (F.col("_h") == 0) & (F.col("_g") == 0)
    return totals.select("restored_rows", "expected_rows", equal.alias("equal"))
