import datetime as dt
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.functions import cron

NOW = dt.datetime(2026, 2, 27, 23, 58, 10)


def jobs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, schedule string")


def runs(spark, text, count=3, now=NOW):
    return cron.with_next_runs(jobs(spark, text), now, count).first()["runs"]


@pytest.mark.parametrize("field,expected", [
    ("*", list(range(60))), ("5", [5]), ("*/20", [0, 20, 40]), ("50/4", [50, 54, 58]), ("3-6", [3, 4, 5, 6]), ("0-10/5", [0, 5, 10]),
    ("1,1,3", [1, 3]), ("60", []), ("55-70", [55, 56, 57, 58, 59]), ("6-3", []), ("*,7", [0, 7]), ("5/0", [5]), ("1-4/0", []),
    ("7x", [7]), ("x", []), ("-3", []), ("+4", [4]), ("2-", [2]), (",,8", [8]), ("9999999999999999999999", []),
    ("3/9999999999999999999999", [3]), ("0-9999999999999999999999/30", [0, 30]),
])
def test_fields(spark, field, expected):
    assert cron.expand(jobs(spark, f"{field} * * * *")).first()["minute"] == expected


def test_runs_begin_with_the_next_full_minute(spark):
    assert runs(spark, "* * * * *", 2) == [dt.datetime(2026, 2, 27, 23, 59), dt.datetime(2026, 2, 28)]
    assert runs(spark, "58 23 * * *", 1) == [dt.datetime(2026, 2, 28, 23, 58)]


def test_known_schedules(spark):
    assert runs(spark, "0 1 * * *", 2) == [dt.datetime(2026, 2, 28, 1), dt.datetime(2026, 3, 1, 1)]
    assert runs(spark, "*/5 * * * *", 2) == [dt.datetime(2026, 2, 28, 0, 0), dt.datetime(2026, 2, 28, 0, 5)]
    # the 29th of February lies within two years, the 30th never comes
    assert runs(spark, "0 0 29 2 *", 2) is not None and runs(spark, "0 0 30 2 *", 2) == []
    assert runs(spark, "0 0 29 2 *", 2, dt.datetime(2026, 3, 1)) == [dt.datetime(2028, 2, 29)]


def test_day_and_weekday_must_both_fit(spark):
    got = runs(spark, "0 0 1 * 1", 2)
    assert all(t.day == 1 and t.weekday() == 0 for t in got)
    assert runs(spark, "0 0 * * 7", 1) == [] and runs(spark, "0 0 * * 0", 1)[0].weekday() == 6


def test_many_runs_beyond_the_near_days(spark):
    got = runs(spark, "0 12 * * *", 100)
    assert len(got) == 100 and got[-1] - got[0] == dt.timedelta(days=99)


def test_unreadable_texts(spark):
    texts = ["", " ", "* * * *", "61 * * * *", "* 24 * * *", "0 0 31 2 *", "0 0 32 * *", " 0  1 * * * ", "0\t1 * * *"]
    got = [r["cron_error"] for r in cron.validate(jobs(spark, *texts), NOW).orderBy("n").collect()]
    assert got == ["empty", "empty", "not_five_fields", "unreadable", "unreadable", "never_runs", "never_runs", None, None]
    assert cron.next_runs(jobs(spark, *texts), NOW, 1).count() == 2


@pytest.mark.parametrize("text,expected", [
    ("0/30 * * * *", "*/30 * * * *"), (" 0/5  0/2 * * 0/1 ", "*/5 */2 * * */1"), ("10/5 * * * *", "10/5 * * * *"),
    ("0/30 * * *", "0/30 * * *"), ("", ""), (None, ""),
])
def test_normalize(spark, text, expected):
    assert jobs(spark, text).select(cron.normalize(cron.F.col("schedule"))).first()[0] == expected


def by_the_minute(text, now, count, days):
    """The definition itself, minute by minute."""
    def values(field, low, high):
        out = set()
        for part in field.split(","):
            m = re.fullmatch(r"(\*|\d+)(-\d+)?(/\d+)?", part)
            a = low if m[1] == "*" else int(m[1])
            b = int(m[2][1:]) if m[2] else (high if m[3] or (m[1] == "*" and field == "*") else a)
            step = int(m[3][1:]) if m[3] else 1
            out |= {v for v in range(low, high + 1) if a <= v <= b and (v - a) % step == 0}
        return out

    sets = [values(f, lo, hi) for f, (_, lo, hi) in zip(text.split(), cron.FIELDS)]
    t = now.replace(second=0, microsecond=0)
    found = []
    for _ in range(days * 1440):
        t += dt.timedelta(minutes=1)
        if all(v in s for v, s in zip((t.minute, t.hour, t.day, t.month, (t.weekday() + 1) % 7), sets)):
            found.append(t)
            if len(found) == count:
                break
    return found


def fields(low, high):
    part = st.one_of(
        st.integers(low, high).map(str), st.integers(1, high).map(lambda n: f"*/{n}"),
        st.tuples(st.integers(low, high), st.integers(low, high)).map(lambda p: f"{min(p)}-{max(p)}"),
    )
    return st.one_of(st.just("*"), st.lists(part, min_size=1, max_size=2).map(",".join))


schedules = st.tuples(*(fields(low, high) for _, low, high in cron.FIELDS))


@settings(max_examples=6, deadline=None)
@given(st.lists(schedules.map(" ".join), min_size=5, max_size=8))
def test_against_the_minute_walk(spark, texts):
    got = cron.with_next_runs(jobs(spark, *texts), NOW, 3).orderBy("n").collect()
    for row in got:
        expected = by_the_minute(row["schedule"], NOW, 3, 60)
        near = [t for t in row["runs"] if t <= NOW + dt.timedelta(days=59)]
        assert near == [t for t in expected if t <= NOW + dt.timedelta(days=59)], row["schedule"]
