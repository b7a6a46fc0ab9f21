"""Five-field cron texts: expansion, next runs, validation.

Everything is computed within a job's own row by array functions: no calendar table, no
join and no shuffle, whatever the number of jobs. The expressions are SQL text, which
Spark parses at once, where the same built from Column calls takes seconds to assemble.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.values import strip

# fixed values: field name, lowest and highest value, in the order of the text
FIELDS = (("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 0, 6))
# runs are searched for this long from the next full minute on
SEARCH_DAYS = 2 * 365
# most schedules run this soon; only the others are tested against the whole calendar
NEAR_DAYS = 40

# the forms of a part: a value or *, with an optional step; a range, with an optional step
_SINGLE, _RANGE = "^([*]|[0-9]+)(/[0-9]+)?$", "^[0-9]+-[0-9]+(/[0-9]+)?$"


def _number(text: str) -> str:
    """Digits as a number, null for no digits; too many for a long are out of range anyway."""
    return f"if({text} = '', NULL, coalesce(try_cast({text} AS BIGINT), 2147483648L))"


def _values(field: str, low: int, high: int) -> str:
    """The sorted values a field stands for; empty if it stands for none.

    Each part first becomes first value, last value and step, then the values between.
    A step of 0 leaves a single value alone and makes a range empty; any text of another
    form counts as the whole number it begins with.
    """
    head, step = "split_part(p, '/', 1)", _number("split_part(p, '/', 2)")
    start = f"if(startswith(p, '*'), {low}L, {_number(head)})"
    lead = _number("regexp_extract(p, '^[+]?([0-9]+)', 1)")
    bounds = f"""CASE
      WHEN p RLIKE '{_SINGLE}' THEN if({step} > 0, named_struct('a', {start}, 'b', {high}L, 's', {step}),
                                       named_struct('a', {start}, 'b', {start}, 's', 1L))
      WHEN p RLIKE '{_RANGE}' THEN named_struct(
        'a', greatest({low}L, {_number(f"split_part({head}, '-', 1)")}),
        'b', if({step} = 0, -1L, least({high}L, {_number(f"split_part({head}, '-', 2)")})), 's', coalesce(nullif({step}, 0L), 1L))
      ELSE named_struct('a', {lead}, 'b', {lead}, 's', 1L) END"""
    listed = f"""array_sort(array_distinct(flatten(transform(
      transform(filter(split({field}, ','), p -> p <> ''), p -> {bounds}),
      r -> if(r.a BETWEEN {low} AND {high} AND r.a <= r.b, sequence(r.a, greatest(r.a, r.b), r.s), CAST(array() AS ARRAY<BIGINT>))))))"""
    return f"if({field} = '*', sequence({low}L, {high}L), {listed})"


def _let(name: str, value: str, body: str) -> str:
    """`body` over `value` computed once per row. Spark would otherwise put the whole
    expression where it is used, which inside a lambda means once per array element."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _fields(schedule: str) -> str:
    """A struct of the five value lists, null unless the text has five fields."""
    lists = ", ".join(f"'{name}', {_values(f'x[{i}]', low, high)}" for i, (name, low, high) in enumerate(FIELDS))
    return _let("x", rf"split(btrim({schedule}, ' \t\n\r'), '\\s+')", f"if(size(x) = 5, named_struct({lists}), NULL)")


def cron_parts(text: Column) -> Column:
    return F.split(strip(text), r"\s+")


def expand(jobs: DataFrame, schedule: str = "schedule") -> DataFrame:
    """Add one array column per field; all null unless the text has five fields."""
    jobs = jobs.withColumn("_fields", F.expr(_fields(schedule)))
    return jobs.withColumns({name: F.col(f"_fields.{name}") for name, _, _ in FIELDS}).drop("_fields")


def _search_start(now: datetime) -> datetime:
    return now.replace(second=0, microsecond=0) + timedelta(minutes=1)


def with_next_runs(jobs: DataFrame, now: datetime, count: int, schedule: str = "schedule") -> DataFrame:
    """Add `runs`: up to `count` times after `now`, null for a text that cannot be read.

    All five fields must match: a day has to fit both its day of month and its weekday,
    and 7 is no weekday. Only matching days are opened into hours and minutes.
    """
    start = _search_start(now)
    end = start + timedelta(days=SEARCH_DAYS)

    def days(last: datetime) -> str:
        # the first day may already be over, hence one more than the runs wanted
        return f"""slice(filter(sequence(DATE '{start:%Y-%m-%d}', DATE '{last:%Y-%m-%d}'), d ->
          array_contains(f.weekday, CAST(dayofweek(d) - 1 AS BIGINT)) AND array_contains(f.day, CAST(day(d) AS BIGINT))
          AND array_contains(f.month, CAST(month(d) AS BIGINT))), 1, {count + 1})"""

    near = min(end, start + timedelta(days=max(NEAR_DAYS, count)))
    chosen = _let("n", days(near), f"if(size(n) > {count}, n, {days(end)})")
    minutes = "flatten(transform(f.hour, h -> transform(f.minute, m -> CAST(h * 60 + m AS INT))))"
    moments = f"""slice(filter(
      transform(p.minutes, m -> CAST(d AS TIMESTAMP_NTZ) + make_dt_interval(0, 0, m)),
      t -> t >= TIMESTAMP_NTZ '{start}' AND t < TIMESTAMP_NTZ '{end}'), 1, {count})"""
    runs = f"slice(flatten(transform(p.days, d -> {moments})), 1, {count})"
    planned = _let("p", f"named_struct('days', {chosen}, 'minutes', {minutes})", runs)
    readable = f"if(size(f.minute) > 0 AND size(f.hour) > 0, {planned}, NULL)"
    return jobs.withColumn("runs", F.expr(_let("f", _fields(schedule), f"if(f IS NULL, NULL, {readable})")))


def next_runs(jobs: DataFrame, now: datetime, count: int = 5, schedule: str = "schedule") -> DataFrame:
    """One row per run: the job's columns, `run_no` from 1 and `run_at`."""
    rows = with_next_runs(jobs, now, count, schedule)
    return rows.select(*jobs.columns, F.posexplode("runs").alias("_i", "run_at")).select(
        *jobs.columns, (F.col("_i") + 1).alias("run_no"), "run_at"
    )


def validate(jobs: DataFrame, now: datetime, schedule: str = "schedule") -> DataFrame:
    """Add `cron_error`: empty, not_five_fields, unreadable, never_runs, or null if valid."""
    text = strip(F.coalesce(F.col(schedule), F.lit("")))
    rows = with_next_runs(jobs, now, 1, schedule)
    error = (
        F.when(text == "", "empty").when(F.size(cron_parts(text)) != 5, "not_five_fields")
        .when(F.col("runs").isNull(), "unreadable").when(F.size("runs") == 0, "never_runs")
    )
    return rows.withColumn("cron_error", error).drop("runs")


def normalize(text: Column) -> Column:
    """`0/n` as `*/n` in each field; texts without five fields only lose outer blanks."""
    trimmed = strip(F.coalesce(text, F.lit("")))
    parts = F.split(trimmed, r"\s+")
    fixed = F.array_join(F.transform(parts, lambda p: F.regexp_replace(p, r"^0/([0-9]+)$", "*/$1")), " ")
    return F.when(F.size(parts) == 5, fixed).otherwise(trimmed)
