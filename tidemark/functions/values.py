"""Coercion and formatting of single values, as column expressions."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: texts that count as true
TRUE_WORDS = ("true", "1", "yes", "y", "on")


def strip(text: Column) -> Column:
    """Without outer white space of any kind; `trim` alone removes blanks only."""
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))


def to_int(text: Column, default: int = 0) -> Column:
    return F.coalesce(strip(text).try_cast("long"), F.lit(default).cast("long"))


def to_bool(text: Column) -> Column:
    """Text by the list of words; anything else, null included, is false."""
    return F.coalesce(F.lower(strip(text)).isin(*TRUE_WORDS), F.lit(False))


def number_to_bool(number: Column) -> Column:
    return F.coalesce(number != 0, F.lit(False))


def format_bytes(size: Column) -> Column:
    """B below 1024, KB below 1024^2, MB above, two decimals; `-` for null."""
    kb, mb = 1024, 1024 * 1024
    return (
        F.when(size.isNull(), "-")
        .when(size < kb, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < mb, F.format_string("%.2f KB", size / kb))
        .otherwise(F.format_string("%.2f MB", size / mb))
    )


def format_time(text: Column, zone: str, pattern: str = "yyyy-MM-dd") -> Column:
    """A UTC time in `zone`, given as a text or as milliseconds since 1970, a number or its
    digits; what is no time comes back as it is, null as empty. Up to eight digits are a date."""
    text = text.cast("string")
    millis = F.when(text.rlike("^-?[0-9]{9,15}$"), text.cast("long"))
    utc = F.coalesce(F.timestamp_millis(millis), F.try_to_timestamp(text))
    return F.coalesce(F.date_format(F.from_utc_timestamp(utc, zone), pattern), text, F.lit(""))


def format_datetime(text: Column, zone: str) -> Column:
    return format_time(text, zone, "yyyy-MM-dd HH:mm:ss")


def nested_value(json: Column, path: str) -> Column:
    """The value at a dotted path, null where any step is missing.

    A step of digits is an array index or an object key, whichever the data has.
    """
    if not isinstance(path, str) or not path:
        raise ValueError("give the path as dotted text")
    steps = [[f"[{key}]", f"['{key}']"] if key.isdigit() else [f"['{key}']"] for key in path.split(".")]
    return F.coalesce(*(F.get_json_object(json, "$" + "".join(choice)) for choice in product(*steps)))


def split_list(text: Column) -> Column:
    """Names of a comma list, trimmed, empty ones left out; null gives an empty list."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), strip)
    return F.filter(parts, lambda x: x != "")


def content_hash(text: Column, length: int | None = None) -> Column:
    digest = F.md5(text)
    return F.substring(digest, 1, length) if length else digest
