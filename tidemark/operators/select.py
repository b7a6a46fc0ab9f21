"""Choosing objects: include and exclude lists, engines, phases, list arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class EmptySelection(ValueError):
    """A selection that leaves nothing to work on."""


def keep_names(df: DataFrame, column: str, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Snapshot rule: the include list first (exact, case matters), then the exclude list.

    The lists are options typed by a user; as literals they reach the scan as pushed filters.
    """
    if include:
        df = df.filter(F.col(column).isin(list(include)))
    if exclude:
        df = df.filter(~F.col(column).isin(list(exclude)))
    return df


def keep_names_on_restore(df: DataFrame, column: str, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Restore rule: an include list wins, the exclude list counts only without one."""
    return keep_names(df, column, include, () if include else exclude)


def select_names(names: Sequence[str], include: Sequence[str] = (), exclude: Sequence[str] = ()) -> list[str]:
    """The snapshot rule over a list of names, in its order; nothing left is an error."""
    wanted, unwanted = set(include), set(exclude)
    chosen = [n for n in names if (not wanted or n in wanted) and n not in unwanted]
    if not chosen:
        raise EmptySelection("no object is left after the include and exclude lists")
    return chosen


def drop_engines(objects: DataFrame, engines: Sequence[str]) -> DataFrame:
    """Skip base tables of the listed storage engines; views have no engine to test."""
    if not engines:
        return objects
    return objects.filter((F.col("table_type") != "BASE TABLE") | ~F.col("engine").isin(list(engines)))


# this engine has no consistent view, so its tables are copied by themselves
UNVERSIONED_ENGINE = "MyISAM"


def with_phase(objects: DataFrame) -> DataFrame:
    """Phase 1 runs under one consistent view, phase 2 holds what cannot take part."""
    alone = (F.col("engine") == UNVERSIONED_ENGINE) & (F.col("table_type") == "BASE TABLE")
    return objects.withColumn("phase", F.when(alone, 2).otherwise(1))


def list_intersect(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Rows of `left` named in `right`; order column and duplicates of `left` stay."""
    return left.join(right.select(column).distinct(), column, "left_semi")


def list_minus(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Rows of `left` not named in `right`; order column and duplicates of `left` stay."""
    return left.join(right.select(column).distinct(), column, "left_anti")
