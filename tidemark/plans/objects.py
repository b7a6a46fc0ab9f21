"""Object lists, dump sessions, snapshots and the session store."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import catalog, select
from tidemark.plans.registry import query
from tidemark.session import scratch_dir
from tidemark.sources import dumps, snapshots, store

GIVEN = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

_INCLUDE = [f"t{i}" for i in range(0, 400, 3)] + ["unknown"]
_EXCLUDE = [f"t{i}" for i in range(0, 400, 2)]


def _sql_list(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


@query("filter_objects", uses="objects", sql=f"""
SELECT * FROM objects WHERE name IN {_sql_list(_INCLUDE)} AND name NOT IN {_sql_list(_EXCLUDE)}""")
def filter_objects(t):
    return select.keep_names(t.objects, "name", _INCLUDE, _EXCLUDE)


@query("filter_objects_restore", uses="objects", sql=f"SELECT * FROM objects WHERE name IN {_sql_list(_INCLUDE)}")
def filter_objects_restore(t):
    return select.keep_names_on_restore(t.objects, "name", _INCLUDE, _EXCLUDE)


@query("filter_engines", uses="objects", sql="SELECT * FROM objects WHERE table_type <> 'BASE TABLE' OR engine <> 'MyISAM'")
def filter_engines(t):
    return select.drop_engines(t.objects, ["MyISAM", "MEMORY"])


@query("phase_split", uses="objects", sql="""
SELECT *, CASE WHEN engine = 'MyISAM' AND table_type = 'BASE TABLE' THEN 2 ELSE 1 END AS phase FROM objects""")
def phase_split(t):
    return select.with_phase(t.objects)


@query("list_intersect", sql="""
SELECT o_orderkey AS ord, o_orderpriority AS priority, o_custkey AS name FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""")
def list_intersect(t):
    left = t.orders.select(F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("name"))
    right = t.customer.filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("name"))
    return select.list_intersect(left, right, "name").orderBy("ord")


@query("list_minus", sql="""
SELECT o_orderkey AS ord, o_orderpriority AS priority, o_custkey AS name FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""")
def list_minus(t):
    left = t.orders.select(F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("name"))
    right = t.customer.filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("name"))
    return select.list_minus(left, right, "name").orderBy("ord")


@query("discover_tables", uses="dump_files", sql="""
SELECT DISTINCT substr(regexp_replace(regexp_replace(file_name, '-schema[.]sql[.]zst$', ''), '[.][0-9]+[.]sql[.]zst$', ''), 6) AS name
FROM dump_files WHERE file_name LIKE 'mall.%'""")
def discover_tables(t):
    return dumps.discover_tables(t.dump_files, "file_name", "mall")


@query("infer_objects", uses="dump_files", sql="""
SELECT DISTINCT session_no, split_part(file_name, '.', 1) AS schema, regexp_replace(split_part(file_name, '.', 2), '-schema$', '') AS name,
       regexp_replace(split_part(file_name, '.', 2), '-schema$', '') AS real_table_name, CAST(0 AS BIGINT) AS rows, 'table' AS kind
FROM dump_files""")
def infer_objects(t):
    return dumps.infer_objects(t.dump_files, "session_no", "file_name").orderBy("session_no", "schema", "name")


@query("session_size", uses="dump_files", sql="SELECT session_no, CAST(sum(size_bytes) AS BIGINT) AS size_bytes FROM dump_files GROUP BY ALL")
def session_size(t):
    return dumps.session_sizes(t.dump_files, "session_no")


@query("layout_pick", uses="run_files", sql="""
SELECT session_no, CASE min(CASE rel_path WHEN 'data/metadata' THEN 1 WHEN 'data/metadata.partial' THEN 2 WHEN 'metadata' THEN 3 ELSE 4 END)
  WHEN 1 THEN 'data/metadata' WHEN 2 THEN 'data/metadata.partial' WHEN 3 THEN 'metadata' ELSE 'metadata.partial' END AS metadata_file
FROM run_files WHERE rel_path LIKE '%metadata%' GROUP BY session_no""")
def layout_pick(t):
    return dumps.pick_layout(t.run_files, "session_no", "rel_path")


def _metadata_text(t):
    """Metadata files as a dump tool writes them, 500 tables of `part` per session."""
    key = F.col("p_partkey")
    head = F.concat(F.lit("[`mall`.`t"), key.cast("string"), F.lit("`]"))
    rows = (
        F.when(key % 13 == 0, F.lit("rows = many")).when(key % 11 == 0, F.lit("# rows = 7"))
        .otherwise(F.concat(F.lit("rows="), (key * 3).cast("string")))
    )
    real = F.when(key % 4 == 0, F.concat(F.lit("real_table_name = "), F.col("p_brand"))).otherwise(F.lit("; no other name"))
    view = F.when(F.col("p_size") % 10 == 0, F.lit("is_view = 1")).otherwise(F.lit("is_view=0"))
    section = F.concat_ws("\n", head, rows, real, view)
    # a section of the database and one that belongs to no table
    extra = F.concat_ws("\n", F.lit("[`mall`]"), F.lit("rows = 5"), F.lit("[config]"), F.lit("rows = 6"))
    source = F.concat_ws(
        "\n", F.when(key % 1000 == 0, F.lit("[source]")).otherwise(F.lit("[SOURCE]")),
        F.concat(F.lit('# SOURCE_LOG_FILE = "binlog.'), F.lpad(key.cast("string"), 6, "0"), F.lit('"')),
        F.when(key % 2500 != 500, F.concat(F.lit("source_log_pos = "), (key * 100).cast("string"))).otherwise(F.lit("# none")),
    )
    part = t.part.withColumn("session_no", F.floor(key / 500).cast("int"))
    sections = part.select("session_no", section.alias("value"))
    # once per session, beside its first table
    fixed = part.filter(key % 500 == 0).select("session_no", F.explode(F.array(extra, source)).alias("value"))
    path = scratch_dir(t.spark, "metadata")
    sections.unionByName(fixed).write.partitionBy("session_no").text(path)
    return dumps.read_sections(t.spark, path).withColumn(
        "session_no", F.regexp_extract("file", "session_no=([0-9]+)", 1).cast("int")
    )


_META_OBJECTS = """
meta AS (
  SELECT CAST(floor(p_partkey / 500) AS INTEGER) AS session_no, 'mall' AS schema, concat('t', CAST(p_partkey AS VARCHAR)) AS name,
    CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE concat('t', CAST(p_partkey AS VARCHAR)) END AS real_table_name,
    CASE WHEN p_partkey % 13 = 0 OR p_partkey % 11 = 0 THEN 0 ELSE p_partkey * 3 END AS rows,
    CASE WHEN p_size % 10 = 0 THEN 'view' ELSE 'table' END AS kind FROM part)"""


def _meta_objects(t):
    return dumps.metadata_objects(_metadata_text(t)).drop("file")


@query("metadata_objects", sql=f"WITH {_META_OBJECTS} SELECT * FROM meta")
def metadata_objects(t):
    return _meta_objects(t)


@query("metadata_source_pos", sql="""
WITH firsts AS (SELECT p_partkey AS k, p_partkey % 2500 <> 500 AND p_partkey > 0 AS ok FROM part WHERE p_partkey % 500 = 0)
SELECT CAST(floor(k / 500) AS INTEGER) AS session_no, CASE WHEN ok THEN concat('binlog.', lpad(CAST(k AS VARCHAR), 6, '0')) END AS log_file,
  CASE WHEN ok THEN k * 100 END AS log_pos, CASE WHEN ok THEN NULL ELSE 'no_source_position' END AS error
FROM firsts""")
def metadata_source_pos(t):
    # a session's text is spread over several files here, as its writers were
    sections = _metadata_text(t).withColumn("file", F.concat(F.lit("s"), F.col("session_no")))
    found = dumps.source_positions(sections)
    return found.select(F.substring("file", 2, 9).cast("int").alias("session_no"), "log_file", "log_pos", "error")


@query("objects_fallback", uses="dump_files", sql=f"""
WITH {_META_OBJECTS}, known AS (SELECT * FROM meta WHERE session_no % 2 = 0)
SELECT *, 'metadata' AS items_source FROM known
UNION ALL SELECT DISTINCT session_no, split_part(file_name, '.', 1), regexp_replace(split_part(file_name, '.', 2), '-schema$', ''),
  regexp_replace(split_part(file_name, '.', 2), '-schema$', ''), 0, 'table', 'filenames'
FROM dump_files WHERE session_no NOT IN (SELECT session_no FROM known)""")
def objects_fallback(t):
    known = _meta_objects(t).filter("session_no % 2 = 0")
    return dumps.objects_or_inferred(known, t.dump_files, "session_no", "file_name")


@query("object_counts", sql=f"""
WITH {_META_OBJECTS}
SELECT session_no, count(*) FILTER (WHERE kind = 'table') AS table_count, count(*) FILTER (WHERE kind = 'view') AS view_count, count(*) AS total
FROM meta GROUP BY session_no""")
def object_counts(t):
    return catalog.object_counts(_meta_objects(t), ["session_no"])


@query("completed_sessions", uses="run_files log_lines", sql="""
SELECT DISTINCT f.session_no FROM run_files f WHERE rel_path IN ('data/metadata', 'data/metadata.partial')
  AND EXISTS (SELECT 1 FROM log_lines l WHERE l.session_no = f.session_no AND contains(l.line, '备份完成。'))""")
def completed_sessions(t):
    return text.completed_sessions(t.run_files, t.log_lines, "session_no", "rel_path", "line")


@query("replayable_check", uses="export_lines", sql="""
SELECT file_name FROM export_lines GROUP BY file_name
HAVING bool_or(starts_with(line, '### ')) AND NOT bool_or(starts_with(line, 'BINLOG '''))""")
def replayable_check(t):
    return text.unreplayable_files(t.export_lines, "file_name", "line")


# ---- snapshots

def _snapshot(t, names, **options) -> str:
    root = scratch_dir(t.spark, "snapshot")
    snapshots.write_snapshot(t.spark, {n: getattr(t, n) for n in names}, root, **options)
    return root


@query("snapshot_roundtrip", sql="SELECT * FROM orders")
def snapshot_roundtrip(t):
    root = _snapshot(t, ["orders", "customer", "nation"], exclude=["nation"], codec="zstd")
    return snapshots.read_table(t.spark, root, "orders")


@query("snapshot_manifest", sql=" UNION ALL ".join(
    f"SELECT '{n}' AS name, {2 if n == 'events' else 1} AS phase, count(*) AS rows, 'zstd' AS codec FROM {n}" for n in GIVEN))
def snapshot_manifest(t):
    root = _snapshot(t, GIVEN, engines={"events": "MyISAM"})
    return snapshots.read_manifest(t.spark, root).select("name", "phase", "rows", "codec")


@query("shard_counts", sql=" UNION ALL ".join(
    f"SELECT '{n}' AS name, count(*) AS rows, true AS within_limit FROM {n}" for n in ("orders", "lineitem")))
def shard_counts(t):
    limit = 10_000
    root = _snapshot(t, ["orders", "lineitem"], shard_rows=limit, shard_keys={"orders": "o_orderkey"})
    shards = [snapshots.shard_rows(t.spark, root, n).withColumn("name", F.lit(n)) for n in ("orders", "lineitem")]
    both = reduce(lambda a, b: a.unionByName(b), shards)
    return both.groupBy("name").agg(F.sum("rows").alias("rows"), (F.max("rows") <= limit).alias("within_limit"))


@query("restore_modes", sql=" UNION ALL ".join(
    f"SELECT '{mode}' AS mode, '{outcome}' AS outcome, count(*) AS rows FROM orders"
    for mode, outcome in (("NONE", "loaded"), ("FAIL", "refused"), ("TRUNCATE", "loaded"), ("DELETE", "loaded"), ("DROP", "loaded"))))
def restore_modes(t):
    """The same snapshot restored by each drop mode in turn into one database."""
    root = _snapshot(t, ["orders"])
    path = scratch_dir(t.spark, "restored")
    target = "tidemark_" + path.rsplit("-", 1)[1]
    results = []
    for mode in ("NONE", "FAIL", "TRUNCATE", "DELETE", "DROP"):
        try:
            snapshots.restore_full(t.spark, root, target, drop_mode=mode, location=path)
            outcome = "loaded"
        except Exception as error:
            if "TABLE_OR_VIEW_ALREADY_EXISTS" not in str(error):
                raise
            outcome = "refused"
        results.append((mode, outcome, t.spark.table(f"{target}.orders").count()))
    t.spark.sql(f"DROP DATABASE {target} CASCADE")
    return t.spark.createDataFrame(results, "mode string, outcome string, rows long")


@query("shard_exact", sql="""
WITH numbered AS (SELECT o_custkey, (row_number() OVER (ORDER BY o_custkey) - 1) // 1000 AS shard FROM (
  SELECT CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_custkey END AS o_custkey FROM orders) x)
SELECT shard, count(*) AS rows, min(o_custkey) AS low, max(o_custkey) AS high, CAST(1 AS BIGINT) AS files FROM numbered GROUP BY shard""")
def shard_exact(t):
    """Shards of exactly 1000 rows in order of a key that a third of the rows share."""
    rows = t.orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(7).cast("long")).otherwise(F.col("o_custkey")))
    shards = snapshots.write_exact_shards(rows, scratch_dir(t.spark, "shards"), "o_custkey", 1000)
    marked = shards.withColumn("file", F.col("_metadata.file_path"))
    return marked.groupBy(F.col("shard").cast("long").alias("shard")).agg(
        F.count("*").alias("rows"), F.min("o_custkey").alias("low"), F.max("o_custkey").alias("high"), F.count_distinct("file").alias("files"))


# ---- session store

def _messy(t):
    """Session records as an old store holds them: blanks, missing fields, bad numbers."""
    key = F.col("o_orderkey")
    text_key = key.cast("string")
    record = F.struct(
        F.when(key % 4 != 0, F.concat(F.lit(" acct"), (key % 3).cast("string"))).alias("account_id"),
        F.when(key % 5 != 0, text_key).otherwise(F.lit("  ")).alias("backup_file_id"),
        F.when(key % 3 == 0, F.lit(" Increment ")).when(key % 3 == 1, F.lit("")).alias("backup_type"),
        F.concat(F.lit("binlog."), F.lpad((key % 100).cast("string"), 6, "0")).alias("binlog_end_file"),
        F.when(key % 7 == 0, F.lit("x1")).otherwise(F.concat(text_key, F.lit(" "))).alias("binlog_end_pos"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("backupTime"),
        F.when(key % 6 != 0, key).alias("size"),
        F.lower("o_orderstatus").alias("status"),
    )
    path = scratch_dir(t.spark, "store")
    # every 50th line is no record at all
    t.orders.select(F.when(key % 50 == 7, F.lit("42")).otherwise(F.to_json(record)).alias("value")).write.text(path)
    return store.read_store(t.spark, path)


@query("normalize_sessions", sql="""
SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'owner' ELSE concat('acct', CAST(o_orderkey % 3 AS VARCHAR)) END AS account_id,
  o_orderkey % 5 = 0 AS id_made, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey AS VARCHAR) END AS id,
  CASE WHEN o_orderkey % 3 = 0 THEN 'increment' ELSE 'full' END AS backup_type, '' AS job_id,
  CAST(o_orderkey % 100 AS INTEGER) AS end_no, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_orderkey END AS binlog_end_pos,
  o_orderdate AS backup_time, CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE o_orderkey END AS size, lower(o_orderstatus) AS status
FROM orders WHERE o_orderkey % 50 <> 7""")
def normalize_sessions(t):
    rows = store.normalize_sessions(_messy(t), default_account="owner")
    made = F.length("backup_file_id") == 32
    return rows.select(
        "account_id", made.alias("id_made"), F.when(~made, F.col("backup_file_id")).alias("id"), "backup_type", "job_id",
        "end_no", "binlog_end_pos", "backup_time", "size", "status",
    )


#: keys of a file, so that files grow in number and not in size; a record has less than 100 bytes
KEYS_PER_FILE = 50_000


@query("normalize_array", sql="""
SELECT concat('job', CAST(o_orderkey AS VARCHAR)) AS job_id, o_orderkey AS size, CASE WHEN o_orderkey % 4 = 0 THEN 1000 WHEN o_orderkey % 4 = 1 THEN 1 ELSE 0 END AS binlog_end_pos
FROM orders WHERE o_orderkey % 50 <> 7""")
def normalize_array(t):
    """A store that is a JSON list over several lines, in files, with elements that are no records and numbers of all kinds."""
    key = F.col("o_orderkey")
    # numbers are cut, true counts as 1, and a text with a fraction is no whole number
    end = F.when(key % 4 == 0, "1e3").when(key % 4 == 1, "true").when(key % 4 == 2, '"12.5"').otherwise("null")
    record = F.concat(F.lit('{"job_id": "job'), key.cast("string"), F.lit('", "size": '), key.cast("string"), F.lit('.75, "binlog_end_pos": '), end, F.lit("}"))
    element = F.when(key % 50 == 7, F.lit('42, null, "text", [{"job_id": "inner"}]')).otherwise(record)
    lists = t.orders.groupBy(F.floor(key / KEYS_PER_FILE).alias("file")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(element), ",\n"), F.lit("]")).alias("value"))
    path = scratch_dir(t.spark, "store")
    lists.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return store.normalize_sessions(store.read_store(t.spark, path)).select("job_id", "size", "binlog_end_pos")


#: keys of a list, some hundred MB: more make more files, each of many splits
KEYS_PER_LIST = 4_000_000


@query("normalize_huge_list", sql="""
SELECT concat('job, "', CAST(o_orderkey AS VARCHAR), '" [') AS job_id, o_orderkey AS size FROM orders WHERE o_orderkey % 50 <> 7""")
def normalize_huge_list(t):
    """Lists over many splits of a file, with brackets, commas and quotes in its strings and elements that are no records."""
    key = F.col("o_orderkey").cast("string")
    record = F.concat(F.lit('{"job_id": "job, \\"'), key, F.lit('\\" [", "size": '), key, F.lit(', "more": {"a": [1, {"b": "]"}], "c": "\\\\"}}'))
    element = F.when(F.col("o_orderkey") % 50 == 7, F.lit('"{\\"job_id\\": 1}", [1, [2, 3]], null')).otherwise(record)
    path = scratch_dir(t.spark, "store")
    part = F.floor(F.col("o_orderkey") / KEYS_PER_LIST).alias("part")
    rows = t.orders.select(part, F.col("o_orderkey").alias("at"), F.concat(F.lit(","), element).alias("value"))
    ends = t.orders.select(part).distinct().select("part", F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("at"), F.lit("[0").alias("value")), F.struct(F.lit((1 << 63) - 1).alias("at"), F.lit("]").alias("value")))).alias("e"))
    lines = rows.unionByName(ends.select("part", "e.*"))
    lines.repartition("part").sortWithinPartitions("part", "at").select("part", "value").write.partitionBy("part").text(path)
    return store.normalize_sessions(store.read_store(t.spark, path)).select("job_id", "size")
