"""Values, names and log text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text, values
from tidemark.plans.registry import query


@query("dir_time", sql="""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate + to_seconds(o_orderkey % 86400) END AS backup_time FROM orders""")
def dir_time(t):
    moment = F.expr("o_orderdate + make_dt_interval(0, 0, 0, o_orderkey % 86400)")
    stamp = F.date_format(moment, "yyyyMMdd_HHmmss")
    # every fifth name carries no time, in one of two ways
    name = F.when(F.col("o_orderkey") % 10 == 0, F.lit("mall_19990101")).when(
        F.col("o_orderkey") % 10 == 5, F.concat(F.lit("mall_"), stamp, F.lit("_x"))
    ).otherwise(F.concat(F.lit("mall_test_"), stamp, F.lit(" ")))
    return t.orders.select("o_orderkey", text.dir_time(name).alias("backup_time"))


@query("log_output_dir", uses="log_lines", sql="""
WITH f AS (SELECT session_no, min(line_no) AS n FROM log_lines WHERE line LIKE '%输出目录:%' GROUP BY ALL),
s AS (SELECT session_no, min(line_no) AS n FROM log_lines WHERE line LIKE '  目录:%' GROUP BY ALL)
SELECT DISTINCT l.session_no, coalesce(
  (SELECT trim(split_part(a.line, '输出目录:', 2)) FROM log_lines a JOIN f ON f.session_no = a.session_no AND f.n = a.line_no WHERE a.session_no = l.session_no),
  (SELECT trim(split_part(a.line, '目录:', 2)) FROM log_lines a JOIN s ON s.session_no = a.session_no AND s.n = a.line_no WHERE a.session_no = l.session_no)) AS output_dir
FROM log_lines l""")
def log_output_dir(t):
    return text.output_dirs(t.log_lines, "session_no", "line_no", "line")


@query("mask_secrets", uses="log_lines", sql="""
SELECT session_no, line_no, CASE WHEN contains(line, '--password=')
  THEN concat(split_part(line, '--password=', 1), '--password=*** --threads=4') ELSE line END AS line FROM log_lines""")
def mask_secrets(t):
    return t.log_lines.withColumn("line", text.mask_secrets(F.col("line")))


@query("format_bytes", sql="""
WITH sizes AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN o_orderkey % 1024
  WHEN 2 THEN CAST(floor(o_totalprice) AS BIGINT) ELSE CAST(floor(o_totalprice) AS BIGINT) * 100 END AS size FROM orders)
SELECT o_orderkey, CASE WHEN size IS NULL THEN '-' WHEN size < 1024 THEN concat(CAST(size AS VARCHAR), ' B')
  WHEN size < 1048576 THEN concat(CAST((size*200+1024)//2048//100 AS VARCHAR), '.', lpad(CAST((size*200+1024)//2048%100 AS VARCHAR), 2, '0'), ' KB')
  ELSE concat(CAST((size*200+1048576)//2097152//100 AS VARCHAR), '.', lpad(CAST((size*200+1048576)//2097152%100 AS VARCHAR), 2, '0'), ' MB') END AS label
FROM sizes""")
def format_bytes(t):
    price = F.floor("o_totalprice").cast("long")
    kind = F.col("o_orderkey") % 4
    size = F.when(kind == 1, F.col("o_orderkey") % 1024).when(kind == 2, price).when(kind == 3, price * 100)
    return t.orders.select("o_orderkey", values.format_bytes(size).alias("label"))


@query("coerce_values", sql="""
WITH raw AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN ' Yes ' WHEN 1 THEN concat(' ', CAST(o_orderkey AS VARCHAR), ' ') WHEN 2 THEN 'off'
  WHEN 3 THEN NULL WHEN 4 THEN concat(CAST(o_orderkey AS VARCHAR), '.5') ELSE '1' END AS value FROM orders)
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 1 THEN o_orderkey WHEN 5 THEN 1 ELSE -1 END AS as_int,
  coalesce(lower(trim(value)) IN ('true', '1', 'yes', 'y', 'on'), false) AS as_bool, o_orderkey % 6 <> 0 AS number_as_bool FROM raw""")
def coerce_values(t):
    key = F.col("o_orderkey")
    kind, number = key % 6, key.cast("string")
    value = (
        F.when(kind == 0, F.lit(" Yes ")).when(kind == 1, F.concat(F.lit(" "), number, F.lit(" "))).when(kind == 2, F.lit("off"))
        .when(kind == 4, F.concat(number, F.lit(".5"))).when(kind == 5, F.lit("1"))
    )
    return t.orders.select(
        "o_orderkey", values.to_int(value, -1).alias("as_int"), values.to_bool(value).alias("as_bool"),
        values.number_to_bool(kind).alias("number_as_bool"),
    )


@query("format_tz", sql="""
SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'not a time' ELSE strftime(date_trunc('second', ts) + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') END AS moment,
  CASE WHEN event_id % 10 = 0 THEN 'not a time' ELSE strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') END AS day FROM events""")
def format_tz(t):
    written = F.when(F.col("event_id") % 10 == 0, F.lit("not a time")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return t.events.select(
        "event_id", values.format_datetime(written, "Asia/Shanghai").alias("moment"), values.format_time(written, "Asia/Shanghai").alias("day")
    )


@query("nested_value", sql="""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE regexp_extract(props, '([0-9]+)', 1) END AS deep,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS second_name, CAST(NULL AS VARCHAR) AS missing FROM events""")
def nested_value(t):
    # every third record has nothing below `user`
    document = F.when(F.col("event_id") % 3 == 0, F.lit('{"user": null}')).otherwise(
        F.concat(F.lit('{"user": {"profile": '), "props", F.lit(', "list": [{"name": "a"}, {"name": "'), "event_type", F.lit('"}]}}'))
    )
    return t.events.select(
        "event_id", values.nested_value(document, "user.profile.k").alias("deep"),
        values.nested_value(document, "user.list.1.name").alias("second_name"),
        values.nested_value(document, "user.nonexistent.field").alias("missing"),
    )


@query("split_list", sql="""
SELECT p_partkey, CAST(2 + p_partkey % 2 AS INTEGER) AS n_names,
  concat(p_name, '|', p_brand, CASE WHEN p_partkey % 2 = 1 THEN concat('|', p_type) ELSE '' END) AS names FROM part""")
def split_list(t):
    written = F.concat_ws(",", F.col("p_name"), F.concat(F.lit(" "), "p_brand", F.lit(" ")), F.when(F.col("p_partkey") % 2 == 1, F.col("p_type")).otherwise(F.lit("")))
    names = values.split_list(written)
    return t.part.select("p_partkey", F.size(names).alias("n_names"), F.array_join(names, "|").alias("names"))


@query("json_bigint", sql="""
SELECT o_orderkey, concat('9', repeat(lpad(CAST(o_orderkey AS VARCHAR), 10, '1'), 6)) AS id, CAST(o_orderkey AS BIGINT) AS age FROM orders""")
def json_bigint(t):
    """Ids far beyond 64 bits, written as JSON numbers, keep every digit as text."""
    digits = F.concat(F.lit("9"), F.repeat(F.lpad(F.col("o_orderkey").cast("string"), 10, "1"), 6))
    document = F.concat(F.lit('{"id": '), digits, F.lit(', "age": '), F.col("o_orderkey").cast("string"), F.lit("}"))
    record = F.from_json(document, "id string, age long")
    return t.orders.select("o_orderkey", record["id"].alias("id"), record["age"].alias("age"))


@query("content_hash", sql="SELECT doc_id, md5(text) AS digest, substr(md5(text), 1, 8) AS short_digest FROM documents")
def content_hash(t):
    body = F.col("text")
    return t.documents.select("doc_id", values.content_hash(body).alias("digest"), values.content_hash(body, 8).alias("short_digest"))
