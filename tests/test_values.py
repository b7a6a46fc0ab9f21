import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text, values


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(build(F.col("v"))).first()[0]


@pytest.mark.parametrize("name,expected", [
    ("mall_20260329_111833", dt.datetime(2026, 3, 29, 11, 18, 33)), (" mall_x_20260329_111833\n", dt.datetime(2026, 3, 29, 11, 18, 33)),
    ("mall_20260329_111833_x", None), ("mall_20261329_111833", None), ("mall20260329_111833", None), ("", None), (None, None),
])
def test_dir_time(spark, name, expected):
    assert one(spark, name, text.dir_time) == expected


@pytest.mark.parametrize("log,expected", [
    ("a\n  目录: /short\n[t] 输出目录: /full x\n", "/full"), ("a\n  目录: /short b\n", "/short"), ("x 目录: /inline\n", None), ("", None), (None, None),
    ("输出目录:/a\n输出目录:/b", "/a"),
])
def test_output_dir(spark, log, expected):
    assert one(spark, log, text.output_dir) == expected


def test_masking_covers_every_secret(spark):
    line = "a --password=s3cret#! --x --password= b\n--password=z"
    assert one(spark, line, text.mask_secrets) == "a --password=*** --x --password=*** b\n--password=***"


@pytest.mark.parametrize("size,label", [
    (None, "-"), (0, "0 B"), (1023, "1023 B"), (1024, "1.00 KB"), (1536, "1.50 KB"), (132224, "129.13 KB"), (1024**2 - 1, "1024.00 KB"),
    (1024**2, "1.00 MB"), (5 * 1024**3, "5120.00 MB"),
])
def test_format_bytes(spark, size, label):
    assert one(spark, size, values.format_bytes, "long") == label


@pytest.mark.parametrize("value,number", [("12", 12), (" -7\n", -7), ("1.5", 0), ("", 0), (None, 0), ("x", 0), ("1e3", 0)])
def test_to_int(spark, value, number):
    assert one(spark, value, values.to_int) == number


@pytest.mark.parametrize("value,flag", [("TRUE", True), (" yes\t", True), ("Y", True), ("on", True), ("1", True), ("2", False), ("off", False), ("", False), (None, False)])
def test_to_bool(spark, value, flag):
    assert one(spark, value, values.to_bool) is flag
    assert one(spark, 2, values.number_to_bool, "int") is True


@pytest.mark.parametrize("value,expected", [
    ("2026-03-29 20:30:00", "2026-03-30"), ("nonsense", "nonsense"), ("", ""), (None, ""), ("2026-02-30", "2026-02-30"),
])
def test_format_time(spark, value, expected):
    assert one(spark, value, lambda c: values.format_time(c, "Asia/Shanghai")) == expected


DOCUMENT = '{"user": {"profile": {"name": "A"}, "none": null}, "b": 2, "list": [{"name": "x"}, {"name": "y"}], "7": {"0": "k"}}'


@pytest.mark.parametrize("path,expected", [
    ("user.profile.name", "A"), ("user.profile.gender", None), ("user.nonexistent.field", None), ("user.none.deep", None), ("b", "2"), ("list.1.name", "y"),
    ("list.9.name", None), ("7.0", "k"),
])
def test_nested_value(spark, path, expected):
    assert one(spark, DOCUMENT, lambda c: values.nested_value(c, path)) == expected


@pytest.mark.parametrize("path", ["", None])
def test_an_empty_path_is_an_error(path):
    with pytest.raises(ValueError):
        values.nested_value(F.lit("{}"), path)


@pytest.mark.parametrize("value,names", [("a,b", ["a", "b"]), (" a ,,b,", ["a", "b"]), ("", []), (None, [])])
def test_split_list(spark, value, names):
    assert one(spark, value, values.split_list) == names


def test_content_hash(spark):
    assert one(spark, "hello", values.content_hash) == "5d41402abc4b2a76b9719d911017c592"
    assert one(spark, "hello", lambda c: values.content_hash(c, 6)) == "5d4140"


def test_export_files_without_events(spark):
    lines = [("a", "### UPDATE"), ("a", "BINLOG 'x"), ("b", "### UPDATE"), ("b", " BINLOG 'x"), ("c", "SET x;"), ("d", "a ### b")]
    rows = spark.createDataFrame(lines, "file string, line string")
    assert [r["file"] for r in text.unreplayable_files(rows, "file", "line").collect()] == ["b"]


def test_a_run_is_complete_with_metadata_and_the_done_line(spark):
    files = spark.createDataFrame([(1, "data/metadata"), (2, "data/metadata.partial"), (3, "metadata"), (4, "data/metadata")], "s int, p string")
    lines = spark.createDataFrame([(1, "x 备份完成。"), (2, "备份完成。"), (3, "备份完成。"), (4, "备份完成")], "s int, l string")
    assert sorted(r["s"] for r in text.completed_sessions(files, lines, "s", "p", "l").collect()) == [1, 2]


@pytest.mark.parametrize(("value", "expected"), [("1704067200000", "2024-01-01 08:00:00"), ("-86400000000", "1967-04-07 08:00:00"), ("12d", "12d"), (None, ""), ("2024-01-01 00:00:00", "2024-01-01 08:00:00")])
def test_epoch_milliseconds(spark, value, expected):
    assert one(spark, value, lambda c: values.format_datetime(c, "Asia/Shanghai")) == expected
    if value and value.lstrip("-").isdigit():
        assert one(spark, value, lambda c: values.format_datetime(c.cast("long"), "Asia/Shanghai")) == expected
