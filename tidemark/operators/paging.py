"""Sorted lists, pages and the typed sort."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ordered import add_slices

MAX_PAGE_SIZE = 100
# a top-k of more rows than this is first brought nearer
TOP_ROWS = 10_000
PAGE_SLICES = 200
# pivots of a step, and rows that they are chosen from
PIVOTS, PIVOT_SAMPLE = 100, 4_000
_SLICEABLE = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


def page_bounds(page: Any, page_size: Any, default_size: int = 10) -> tuple[int, int]:
    """Page at least 1, size from 1 to 100; what is no number falls to the default."""
    def number(value: Any, default: int) -> int:
        try:
            return int(value) or default
        except (TypeError, ValueError):
            return default

    return max(1, number(page, 1)), min(MAX_PAGE_SIZE, max(1, number(page_size, default_size)))


def page(rows: DataFrame, order: Sequence[tuple[str, bool]], page: Any = 1, page_size: Any = 10) -> DataFrame:
    """One page in (column, descending) order, the total beside each row; past the end it
    is empty.

    A page is a top-k: each task keeps offset + size rows, nothing is sorted whole. Far
    from the start the rows before the page are first passed over by counts.
    """
    number, size = page_bounds(page, page_size)
    total = rows.agg(F.count(F.lit(1)).alias("total")).scalar()
    near, offset = _skip_ahead(rows, order, (number - 1) * size, size)
    chosen = near.orderBy(*_sort_keys(order)).offset(offset).limit(size)
    return chosen.withColumn("total", total)


def _sort_keys(order: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.desc(name) if descending else F.asc(name) for name, descending in order]


def _skip_ahead(rows: DataFrame, order: Sequence[tuple[str, bool]], offset: int, size: int) -> tuple[DataFrame, int]:
    """The part of `rows` that holds the page, and the page's offset in it.

    Rows are cut into slices of their order, of which only the counts are collected; the
    slices before the page are left out, and this repeats until a top-k suffices. Slices of
    numbers and times come from quantiles, of other types from pivots.
    """
    (lead, lead_desc), (tie, tie_desc) = order[0], order[min(1, len(order) - 1)]
    if not all(isinstance(rows.schema[c].dataType, _SLICEABLE) for c in (lead, tie)):
        return _skip_by_pivots(rows, order, offset, size)
    while offset + size > TOP_ROWS:
        sliced = add_slices(rows, lead, tie, PAGE_SLICES)
        counts = {(r["_slice"], r["_sub"]): r["n"] for r in sliced.groupBy("_slice", "_sub").agg(F.count(F.lit(1)).alias("n")).collect()}
        kept, before, seen = [], 0, 0
        for part in sorted(counts, key=lambda p: (-p[0] if lead_desc else p[0], -p[1] if tie_desc else p[1])):
            if seen + counts[part] <= offset:
                before = seen + counts[part]
            elif seen < offset + size:
                kept.append(part)
            seen += counts[part]
        if not before or not kept:
            # past the end, or all rows in one place: nothing can be left out
            return (rows, offset) if kept else (rows.limit(0), 0)
        wanted = F.lit(False)
        for slice_no, sub in kept:
            wanted |= (F.col("_slice") == slice_no) & (F.col("_sub") == sub)
        rows, offset = sliced.filter(wanted).drop("_slice", "_sub"), offset - before
    return rows, offset


def _skip_by_pivots(rows: DataFrame, order: Sequence[tuple[str, bool]], offset: int, size: int) -> tuple[DataFrame, int]:
    """`_skip_ahead` for columns of any type that can be ordered: multi-pivot selection.

    Pivots are every so many-th of a random sample of the order columns, which each task keeps a
    bounded part of. They only decide how fast it goes: rows are counted between pivots, whatever
    these are, and those between the two around the page are kept. Rows that are equal in all order
    columns can't be parted.
    """
    names, types = [name for name, _ in order], [rows.schema[name].dataType for name, _ in order]

    def follows(pivot: Column) -> Column:
        """Whether a row is the pivot or comes after it; null sorts as the least value."""
        out = F.lit(True)
        for i, (name, descending) in reversed(list(enumerate(order))):
            bound, own = F.struct(pivot[f"c{i}"].alias("x")), F.struct(F.col(name).alias("x"))
            out = ((own < bound) if descending else (own > bound)) | (own.eqNullSafe(bound) & out)
        return out

    def literal(pivot: tuple) -> Column:
        return F.struct(*(F.lit(value).cast(kind).alias(f"c{i}") for i, (value, kind) in enumerate(zip(pivot, types, strict=True))))

    def place(pivots: list[Column]) -> Column:
        """How many pivots a row follows: first by every so many-th, then within those that are left."""
        step = max(1, math.isqrt(len(pivots)))
        heads = F.size(F.filter(F.array(*pivots[::step]), follows))
        blocks = F.array(*(F.array(*pivots[i : i + step]) for i in range(0, len(pivots), step)))
        return F.when(heads == 0, 0).otherwise((heads - 1) * step + F.size(F.filter(F.get(blocks, heads - 1), follows)))

    while offset + size > TOP_ROWS:
        sample = [tuple(r) for r in rows.select(*names).orderBy(F.rand()).limit(PIVOT_SAMPLE).orderBy(*_sort_keys(order)).collect()]
        if not sample:
            return rows, 0
        pivots = [literal(p) for p in dict.fromkeys(sample[:: max(1, len(sample) // PIVOTS)])]
        counts = {r["place"]: r["n"] for r in rows.groupBy(place(pivots).alias("place")).agg(F.count(F.lit(1)).alias("n")).collect()}
        kept, before, seen = [], 0, 0
        for part in sorted(counts):
            if seen + counts[part] <= offset:
                before = seen + counts[part]
            elif seen < offset + size:
                kept.append(part)
            seen += counts[part]
        if not kept:
            return rows.limit(0), 0
        if sum(counts[part] for part in kept) == seen:
            return rows, offset
        if kept[0] > 0:
            rows = rows.filter(follows(pivots[kept[0] - 1]))
        if kept[-1] < len(pivots):
            rows = rows.filter(~follows(pivots[kept[-1]]))
        offset -= before
    return rows, offset


def page_after(rows: DataFrame, order: Sequence[tuple[str, bool]], last: Sequence[Any], page_size: Any = 10) -> DataFrame:
    """The rows that follow `last` in (column, descending) order; the columns are unique together."""
    _, size = page_bounds(1, page_size)
    beyond, equal = F.lit(False), F.lit(True)
    for (name, descending), value in zip(order, last):
        bound = F.lit(value).cast(rows.schema[name].dataType)
        beyond |= equal & ((F.col(name) < bound) if descending else (F.col(name) > bound))
        equal &= F.col(name) == bound
    # the leading column alone bounds the scan, so this part reaches the reader
    (first, descending), bound = order[0], F.lit(last[0]).cast(rows.schema[order[0][0]].dataType)
    near = F.col(first) <= bound if descending else F.col(first) >= bound
    return rows.filter(near).filter(beyond).orderBy(*_sort_keys(order)).limit(size)


# fixed values: what counts as a number in a text, and prefixes of other bases
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
BASES = {"0x": (16, "[0-9a-f]"), "0o": (8, "[0-7]"), "0b": (2, "[01]")}


def number_key(text: Column) -> Column:
    """The text as a number, blank as 0, null if it is none; no cast's own suffixes count."""
    trimmed = F.trim(text)
    number = F.when(trimmed == "", F.lit(0.0)).when(trimmed.rlike(NUMBER), trimmed.try_cast("double"))
    for prefix, (base, digit) in BASES.items():
        rest = F.substring(F.lower(trimmed), 3, 64)
        number = number.when(F.lower(trimmed).rlike(f"^{prefix}{digit}{{1,62}}$"), F.conv(rest, base, 10).cast("double"))
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def text_key(text: Column) -> Column:
    """Lower case, with each run of digits written so that text order is number order."""
    def part(p: Column) -> Column:
        digits = F.coalesce(F.nullif(F.ltrim(p, F.lit("0")), F.lit("")), F.lit("0"))
        return F.when(p.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(F.lower(p))

    parts = F.regexp_extract_all(text, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.when(number_key(text).isNull(), F.array_join(F.transform(parts, part), ""))


def typed_sort(rows: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Native types by value. Text: numbers first by value, then the rest, blind to case
    and accents, digits inside compared as numbers. An unknown column leaves all as is.

    The rule this stands for compares pairs and is not transitive on mixed text; this is
    the total order that agrees with it on all-number and on no-number columns.
    """
    if column not in rows.columns:
        return rows
    direction = F.desc if descending else F.asc
    if dict(rows.dtypes)[column] != "string":
        return rows.orderBy(direction(column))
    # as columns, since a sort would compute an expression anew for every comparison
    keyed = rows.withColumns({"__number": number_key(F.col(column)), "__words": F.collate(text_key(F.col(column)), "UNICODE_CI_AI")})
    keys = [direction(F.col("__number").isNull()), direction("__number"), direction("__words")]
    return keyed.orderBy(*keys).drop("__number", "__words")
