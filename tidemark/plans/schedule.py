"""Schedules: cron texts, coming runs, and what each run does."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.functions import cron
from tidemark.operators import catalog
from tidemark.plans.registry import query

NOW = datetime(2026, 3, 10, 14, 7, 31)

# The oracle tests every value of a field against every part of its text.
_MATCHED = """
texts AS (SELECT DISTINCT schedule FROM {source}),
fields AS (
  SELECT schedule, f.no, f.lo, f.hi, string_split(schedule, ' ')[f.no] AS field
  FROM texts, (VALUES (1, 0, 59), (2, 0, 23), (3, 1, 31), (4, 1, 12), (5, 0, 6)) f(no, lo, hi)
  WHERE len(string_split(schedule, ' ')) = 5),
parts AS (SELECT schedule, no, lo, hi, field, unnest(string_split(field, ',')) AS part FROM fields),
cut AS (
  SELECT *, split_part(part, '/', 1) AS head, TRY_CAST(nullif(split_part(part, '/', 2), '') AS BIGINT) AS step,
    CASE WHEN contains(part, '-') THEN TRY_CAST(split_part(split_part(part, '/', 1), '-', 1) AS BIGINT)
         WHEN starts_with(part, '*') THEN lo ELSE TRY_CAST(split_part(part, '/', 1) AS BIGINT) END AS a,
    TRY_CAST(nullif(split_part(split_part(part, '/', 1), '-', 2), '') AS BIGINT) AS b FROM parts),
hits AS (
  SELECT DISTINCT schedule, no, v FROM cut, LATERAL (SELECT unnest(range(lo, hi + 1)) AS v) vals
  WHERE field = '*' OR (a IS NOT NULL AND CASE WHEN b IS NOT NULL THEN v BETWEEN a AND b AND (v - greatest(a, lo)) % coalesce(step, 1) = 0
    WHEN step IS NULL THEN v = a ELSE v >= a AND (v - a) % step = 0 END))"""

_RUNS = _MATCHED + """,
days AS (SELECT CAST(d AS DATE) AS d FROM range(TIMESTAMP '2026-03-10', TIMESTAMP '2028-03-10', INTERVAL 1 DAY) r(d)),
good_days AS (
  SELECT s.schedule, d, row_number() OVER (PARTITION BY s.schedule ORDER BY d) AS k FROM texts s, days
  WHERE EXISTS (SELECT 1 FROM hits h WHERE h.schedule = s.schedule AND no = 3 AND v = day(d))
    AND EXISTS (SELECT 1 FROM hits h WHERE h.schedule = s.schedule AND no = 4 AND v = month(d))
    AND EXISTS (SELECT 1 FROM hits h WHERE h.schedule = s.schedule AND no = 5 AND v = dayofweek(d))),
moments AS (
  SELECT g.schedule, CAST(g.d AS TIMESTAMP) + to_hours(CAST(h.v AS INTEGER)) + to_minutes(CAST(m.v AS INTEGER)) AS run_at
  FROM good_days g JOIN hits h ON h.schedule = g.schedule AND h.no = 2 JOIN hits m ON m.schedule = g.schedule AND m.no = 1 WHERE g.k <= 12),
numbered AS (
  SELECT schedule, run_at, CAST(row_number() OVER (PARTITION BY schedule ORDER BY run_at) AS INTEGER) AS run_no
  FROM moments WHERE run_at >= TIMESTAMP '2026-03-10 14:08:00')"""


@query("cron_fields", uses="jobs", sql=f"""
WITH {_MATCHED.format(source="jobs")}
SELECT j.id, {", ".join(
    f"(SELECT string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) FROM hits h WHERE h.schedule = j.schedule AND no = {i + 1}) AS {name}"
    for i, (name, _, _) in enumerate(cron.FIELDS))} FROM jobs j""")
def cron_fields(t):
    names = [name for name, _, _ in cron.FIELDS]
    return cron.expand(t.jobs).select("id", *(F.array_join(F.col(n).cast("array<string>"), ",").alias(n) for n in names))


@query("cron_next_runs", uses="jobs", sql=f"""
WITH {_RUNS.format(source="jobs")} SELECT j.*, n.run_no, n.run_at FROM jobs j JOIN numbered n ON n.schedule = j.schedule WHERE n.run_no <= 5""")
def cron_next_runs(t):
    return cron.next_runs(t.jobs, NOW, 5)


def _written(t):
    """Schedules as users write them, a part of them wrong."""
    key = F.substring("id", 4, 9).cast("long")
    written = (
        F.when(key % 7 == 1, F.lit("  ")).when(key % 7 == 2, F.lit("0 1 * *")).when(key % 7 == 3, F.lit("61 * * * *"))
        .when(key % 7 == 4, F.lit("0 0 31 2 *")).otherwise(F.col("schedule"))
    )
    return t.jobs.select("id", written.alias("schedule"))


@query("cron_validate", uses="jobs", sql="""
SELECT id, CASE CAST(substr(id, 4) AS BIGINT) % 7 WHEN 1 THEN '  ' WHEN 2 THEN '0 1 * *' WHEN 3 THEN '61 * * * *' WHEN 4 THEN '0 0 31 2 *' ELSE schedule END AS schedule,
  CASE CAST(substr(id, 4) AS BIGINT) % 7 WHEN 1 THEN 'empty' WHEN 2 THEN 'not_five_fields' WHEN 3 THEN 'unreadable' WHEN 4 THEN 'never_runs' END AS cron_error
FROM jobs""")
def cron_validate(t):
    return cron.validate(_written(t), NOW)


@query("cron_normalize", uses="jobs", sql="""
SELECT id, CASE WHEN starts_with(schedule, '0/30 ') THEN concat('*/30 ', substr(schedule, 6)) ELSE schedule END AS schedule FROM jobs""")
def cron_normalize(t):
    return t.jobs.select("id", cron.normalize(F.concat(F.lit(" "), F.col("schedule"))).alias("schedule"))


@query("smart_mode", uses="jobs sessions", sql=f"""
WITH {_RUNS.format(source="jobs")},
first AS (SELECT job_id, account_id, min(backup_time) AS at FROM sessions WHERE backup_type = 'full' AND status = 'success' GROUP BY ALL)
SELECT j.id, j.account_id, n.run_no, n.run_at,
  CASE WHEN dayofweek(n.run_at) = 1 OR f.at IS NULL OR f.at >= n.run_at THEN 'full' ELSE 'increment' END AS mode
FROM jobs j JOIN numbered n ON n.schedule = j.schedule LEFT JOIN first f ON f.job_id = j.id AND f.account_id = j.account_id
WHERE n.run_no <= 10""")
def smart_mode(t):
    runs = cron.next_runs(t.jobs, NOW, 10).select("id", "account_id", "run_no", "run_at")
    return catalog.smart_mode(runs, t.sessions)
