"""Facts read from directory names and log text, as column expressions and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.values import strip

# fixed values: what the tools print
OUTPUT_DIR_LABEL = "输出目录:"
SHORT_DIR_LABEL = "目录:"
DONE_TEXT = "备份完成。"


def dir_time(name: Column) -> Column:
    """The time in a name ending `_YYYYMMDD_HHMMSS`; null if there is none."""
    digits = F.regexp_extract(strip(name), r"_([0-9]{8}_[0-9]{6})$", 1)
    return F.try_to_timestamp(digits, F.lit("yyyyMMdd_HHmmss")).cast("timestamp_ntz")


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def output_dir(text: Column) -> Column:
    """The output directory a log text names: the full label anywhere, else the short
    label at the start of a line; null if neither is there."""
    full = _found(text, rf"{OUTPUT_DIR_LABEL}\s*(\S+)")
    short = _found(text, rf"(?m)^\s*{SHORT_DIR_LABEL}\s*(\S+)")
    return F.coalesce(full, short)


def output_dirs(lines: DataFrame, session: str, line_no: str, line: str) -> DataFrame:
    """`output_dir` for logs kept as one row per line, whole logs in any number of tasks."""
    full = _found(F.col(line), rf"{OUTPUT_DIR_LABEL}\s*(\S+)")
    short = _found(F.col(line), rf"^\s*{SHORT_DIR_LABEL}\s*(\S+)")
    first = {
        name: F.min(F.when(value.isNotNull(), F.struct(F.col(line_no).alias("at"), value.alias("dir"))))
        for name, value in (("_full", full), ("_short", short))
    }
    found = lines.groupBy(session).agg(*(v.alias(k) for k, v in first.items()))
    return found.select(session, F.coalesce("_full.dir", "_short.dir").alias("output_dir"))


def mask_secrets(text: Column) -> Column:
    return F.regexp_replace(text, r"--password=\S*", "--password=***")


def completed_sessions(files: DataFrame, lines: DataFrame, session: str, path: str, line: str) -> DataFrame:
    """Runs that count as complete whatever their exit code: the data folder has a
    metadata file, finished or partial, and the log says it is done."""
    named = F.bool_or(F.col(path).isin("data/metadata", "data/metadata.partial"))
    with_metadata = files.groupBy(session).agg(named.alias("_ok")).filter("_ok").select(session)
    said = F.bool_or(F.contains(F.col(line), F.lit(DONE_TEXT)))
    with_text = lines.groupBy(session).agg(said.alias("_ok")).filter("_ok").select(session)
    return with_metadata.join(with_text, session)


def unreplayable_files(lines: DataFrame, file: str, line: str) -> DataFrame:
    """Log exports made for reading only: comment lines but no event to replay."""
    return (
        lines.groupBy(file)
        .agg(F.bool_or(F.startswith(F.col(line), F.lit("### "))).alias("_comment"), F.bool_or(F.startswith(F.col(line), F.lit("BINLOG '"))).alias("_event"))
        .filter("_comment AND NOT _event").select(file)
    )
