"""Sessions, jobs and instances."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators import catalog as ops
from tidemark.operators import paging
from tidemark.plans.registry import query


@query("scope_sessions", uses="sessions", sql="SELECT * FROM sessions WHERE account_id = 'acct2'")
def scope_sessions(t):
    return ops.scope(t.sessions, " acct2 ")


@query("search_sessions", uses="sessions", sql="""
WITH named AS (
  SELECT *, concat(database, '_', strftime(backup_time, '%Y%m%d'), '_000000') AS "dirName",
         concat('/Backup/', account_id) AS "backupDir" FROM sessions)
SELECT * FROM named WHERE lower(database) LIKE '%t3%' OR lower("dirName") LIKE '%t3%' OR lower("backupDir") LIKE '%t3%'""")
def search_sessions(t):
    rows = t.sessions.withColumns({
        "dirName": F.concat("database", F.lit("_"), F.date_format("backup_time", "yyyyMMdd"), F.lit("_000000")),
        "backupDir": F.concat(F.lit("/Backup/"), "account_id"),
    })
    return ops.search(rows, " T3", ops.SESSION_SEARCH_FIELDS)


@query("search_jobs", uses="jobs", sql="""
SELECT *, linked_full_backup_job_id AS tables FROM jobs
WHERE contains(lower(name), 'ull') OR contains(lower(linked_full_backup_job_id), 'ull')
   OR contains(lower(backup_type), 'ull') OR contains(lower(db_instance_id), 'ull')""")
def search_jobs(t):
    rows = t.jobs.withColumn("tables", F.col("linked_full_backup_job_id"))
    return ops.search(rows, "ULL", ops.JOB_SEARCH_FIELDS)


@query("search_instances", uses="instances", sql="""
SELECT *, concat('10.0.0.', id) AS host, concat('shop_', account_id) AS database FROM instances
WHERE contains(lower(name), 'n_1') OR contains(concat('10.0.0.', id), 'n_1') OR contains(concat('shop_', account_id), 'n_1')""")
def search_instances(t):
    rows = t.instances.withColumns({"host": F.concat(F.lit("10.0.0."), "id"), "database": F.concat(F.lit("shop_"), "account_id")})
    return ops.search(rows, "n_1", ops.INSTANCE_SEARCH_FIELDS)


@query("list_filtered", sql="""
SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS name, CAST(o_orderkey % 3 AS INTEGER) AS status, o_orderdate AS "createTime"
FROM orders WHERE contains(lower(o_orderpriority), 'high') AND contains(CAST(o_orderkey AS VARCHAR), '1')
  AND o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1998-06-30' AND o_orderkey % 3 = 1""")
def list_filtered(t):
    rows = t.orders.select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("name"),
        (F.col("o_orderkey") % 3).cast("int").alias("status"), F.col("o_orderdate").alias("createTime"),
    )
    return ops.list_filtered(
        rows, {"name": "High", "id": "1", "remark": ""}, start=datetime(1995, 1, 1), end=datetime(1998, 6, 30), status="1"
    )


@query("job_instance_left", uses="jobs instances", sql="""
SELECT j.*, coalesce(i.name, '—') AS instance_name FROM jobs j LEFT JOIN instances i ON i.id = j.db_instance_id""")
def job_instance_left(t):
    return ops.job_instance_names(t.jobs, t.instances)


@query("fulls_with_increments", uses="sessions", sql="""
SELECT * FROM sessions f WHERE backup_type = 'full'
  AND EXISTS (SELECT 1 FROM sessions i WHERE i.backup_type = 'increment' AND i.full_backup_file_id = f.backup_file_id)""")
def fulls_with_increments(t):
    return ops.fulls_with_increments(t.sessions)


@query("increments_of_full", uses="sessions", sql="""
SELECT i.* FROM sessions i JOIN sessions f ON f.backup_file_id = i.full_backup_file_id
WHERE i.backup_type = 'increment' AND f.backup_type = 'full' AND f.status = 'success'""")
def increments_of_full(t):
    chosen = ops.fulls(t.sessions).select(F.col("backup_file_id").alias("full_backup_file_id"))
    return ops.increments_of_fulls(t.sessions, chosen)


@query("free_full_jobs", uses="jobs", sql="""
SELECT * FROM jobs f WHERE backup_type = 'full' AND NOT EXISTS (
  SELECT 1 FROM jobs j WHERE j.backup_type = 'incremental' AND j.linked_full_backup_job_id = f.id AND j.id <> 'job1')""")
def free_full_jobs(t):
    return ops.free_full_jobs(t.jobs, editing="job1")


@query("job_link_check", uses="jobs instances", sql="""
SELECT j.*, CASE
  WHEN backup_type = 'incremental' AND linked_full_backup_job_id = '' THEN 'missing_link'
  WHEN NOT EXISTS (SELECT 1 FROM instances i WHERE i.id = j.db_instance_id AND i.account_id = j.account_id) THEN 'instance_missing'
  WHEN backup_type = 'incremental' AND NOT EXISTS (
    SELECT 1 FROM jobs f WHERE f.id = j.linked_full_backup_job_id AND f.backup_type = 'full' AND f.account_id = j.account_id) THEN 'link_invalid'
  WHEN backup_type = 'incremental' AND EXISTS (
    SELECT 1 FROM jobs o WHERE o.id <> j.id AND o.backup_type = 'incremental' AND o.account_id = j.account_id
      AND o.linked_full_backup_job_id = j.linked_full_backup_job_id) THEN 'link_taken' END AS link_error
FROM jobs j""")
def job_link_check(t):
    return ops.check_job_links(t.jobs, t.instances)


@query("job_instance_missing", uses="jobs instances", sql="""
SELECT * FROM jobs j WHERE NOT EXISTS (SELECT 1 FROM instances i WHERE i.id = j.db_instance_id AND i.account_id = j.account_id)""")
def job_instance_missing(t):
    return ops.jobs_without_instance(t.jobs, t.instances)


@query("instances_in_use", uses="jobs instances", sql="""
SELECT * FROM instances i WHERE EXISTS (SELECT 1 FROM jobs j WHERE i.id = j.db_instance_id AND i.account_id = j.account_id)""")
def instances_in_use(t):
    return ops.instances_in_use(t.instances, t.jobs)


@query("orphan_increments", uses="sessions", sql="""
SELECT * FROM sessions i WHERE backup_type = 'increment' AND full_backup_file_id NOT IN (
  SELECT backup_file_id FROM sessions WHERE backup_type = 'full' AND status <> 'failed')""")
def orphan_increments(t):
    return ops.orphan_increments(t.sessions, t.sessions.filter("backup_type = 'full' AND status <> 'failed'"))


@query("delete_cascade", uses="sessions", sql="""
WITH doomed AS (SELECT backup_file_id FROM sessions WHERE backup_type = 'full' AND status = 'failed')
SELECT * FROM sessions WHERE backup_file_id IN (SELECT * FROM doomed) OR full_backup_file_id IN (SELECT * FROM doomed)""")
def delete_cascade(t):
    return ops.delete_cascade(t.sessions, t.sessions.filter("backup_type = 'full' AND status = 'failed'"))


@query("job_baseline", uses="sessions jobs", sql="""
WITH newest AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY account_id, job_id ORDER BY backup_time DESC, seq DESC) AS rn
  FROM sessions WHERE backup_type = 'full' AND status = 'success') x WHERE rn = 1)
SELECT j.*, n.backup_file_id AS full_backup_file_id, n.backup_time AS full_backup_time
FROM jobs j LEFT JOIN newest n ON n.account_id = j.account_id AND n.job_id = j.linked_full_backup_job_id
WHERE j.backup_type = 'incremental'""")
def job_baseline(t):
    return ops.job_baselines(t.jobs, t.sessions)


@query("duplicate_links", uses="jobs", sql="""
SELECT account_id, linked_full_backup_job_id, count(*) AS n_jobs FROM jobs
WHERE backup_type = 'incremental' AND linked_full_backup_job_id <> '' GROUP BY ALL HAVING count(*) > 1""")
def duplicate_links(t):
    return ops.duplicate_links(t.jobs)


@query("keep_newest", uses="sessions", sql="""
SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY account_id, job_id ORDER BY backup_time DESC, seq DESC) AS INTEGER) AS rank
  FROM sessions WHERE backup_type = 'full') x WHERE rank <= 20""")
def keep_newest(t):
    return ops.keep_newest(ops.fulls(t.sessions, include_failed=True), ["account_id", "job_id"])


@query("unique_by_field", sql="""
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) x WHERE rn = 1""")
def unique_by_field(t):
    return ops.unique_by(t.orders, "o_custkey", "o_orderkey")


@query("upsert_sessions", uses="sessions", sql="""
WITH named AS (SELECT backup_file_id, concat(database, '_', CAST(seq % 1000 AS VARCHAR)) AS "dirName", size, seq FROM sessions),
old AS (SELECT * FROM named WHERE seq % 3 <> 0), new AS (SELECT * FROM named WHERE seq % 3 = 0)
SELECT *, 0 AS batch FROM old WHERE "dirName" NOT IN (SELECT "dirName" FROM new)
UNION ALL SELECT *, 1 FROM new n WHERE seq = (SELECT max(seq) FROM new m WHERE m."dirName" = n."dirName")""")
def upsert_sessions(t):
    rows = t.sessions.select(
        "backup_file_id", F.concat("database", F.lit("_"), (F.col("seq") % 1000).cast("string")).alias("dirName"), "size", "seq"
    )
    return ops.upsert(rows.filter("seq % 3 <> 0"), rows.filter("seq % 3 = 0"), "dirName", "seq")


@query("list_sessions", uses="sessions", sql="SELECT * FROM sessions WHERE account_id = 'acct1' ORDER BY backup_time DESC, seq DESC")
def list_sessions(t):
    return ops.newest_first(ops.scope(t.sessions, "acct1"))


@query("page_list", uses="sessions", sql="""
SELECT *, (SELECT count(*) FROM sessions) AS total FROM sessions ORDER BY backup_time DESC, seq DESC LIMIT 100 OFFSET 200""")
def page_list(t):
    return paging.page(t.sessions, [("backup_time", True), ("seq", True)], page=3, page_size=500)


@query("page_deep", uses="sessions", sql="""
SELECT *, (SELECT count(*) FROM sessions) AS total FROM sessions ORDER BY backup_time DESC, seq DESC LIMIT 100 OFFSET 12300""")
def page_deep(t):
    return paging.page(t.sessions, [("backup_time", True), ("seq", True)], page=124, page_size=100)


@query("page_deep_text", uses="sessions", sql="""
SELECT *, count(*) OVER () AS total FROM sessions ORDER BY account_id DESC, job_id, backup_file_id LIMIT 100 OFFSET 12300""")
def page_deep_text(t):
    """A page far down by texts, which have no quantiles: the rows before it are passed over between pivots."""
    return paging.page(t.sessions, [("account_id", True), ("job_id", False), ("backup_file_id", False)], page=124, page_size=100)


@query("page_after", uses="sessions", sql="""
SELECT * FROM sessions WHERE (backup_time, seq) < (
  SELECT (backup_time, seq) FROM sessions ORDER BY backup_time DESC, seq DESC LIMIT 1 OFFSET 99)
ORDER BY backup_time DESC, seq DESC LIMIT 20""")
def page_after(t):
    last = t.sessions.orderBy(F.desc("backup_time"), F.desc("seq")).offset(99).limit(1).first()
    return paging.page_after(t.sessions, [("backup_time", True), ("seq", True)], [last["backup_time"], last["seq"]], 20)


@query("typed_sort", sql="""
WITH mixed AS (
  SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS VARCHAR) ELSE concat(p_name, ' ', CAST(p_size AS VARCHAR)) END AS value FROM part)
SELECT p_partkey, value, TRY_CAST(value AS DOUBLE) AS number_key,
  CASE WHEN TRY_CAST(value AS DOUBLE) IS NULL THEN concat(regexp_extract(value, '^([a-z ]*)', 1),
    lpad(CAST(length(regexp_extract(value, '([0-9]+)$', 1)) AS VARCHAR), 10, '0'), regexp_extract(value, '([0-9]+)$', 1)) END AS text_key
FROM mixed""")
def typed_sort(t):
    value = F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("string")).otherwise(F.concat_ws(" ", "p_name", F.col("p_size").cast("string")))
    rows = t.part.select("p_partkey", value.alias("value"))
    keyed = rows.withColumns({"number_key": paging.number_key(F.col("value")), "text_key": paging.text_key(F.col("value"))})
    return paging.typed_sort(keyed, "value")


_AS_OF = datetime(1998, 8, 2)


@query("retention", uses="sessions jobs", sql=f"""
WITH policy AS (SELECT db_instance_id AS database, max(clean_days) AS clean_days FROM jobs WHERE backup_type = 'full' GROUP BY ALL),
current AS (SELECT * FROM (
  SELECT database, backup_file_id, row_number() OVER (PARTITION BY database ORDER BY backup_time DESC, seq DESC) AS rn
  FROM sessions WHERE backup_type = 'full' AND status = 'success') x WHERE rn = 1)
SELECT s.*, p.clean_days FROM sessions s JOIN policy p ON p.database = s.database JOIN current c ON c.database = s.database
WHERE p.clean_days > 0 AND s.backup_time < TIMESTAMP '{_AS_OF}' - to_days(p.clean_days) AND s.backup_file_id <> c.backup_file_id""")
def retention(t):
    policy = (
        t.jobs.filter("backup_type = 'full'").groupBy(F.col("db_instance_id").alias("database"))
        .agg(F.max("clean_days").alias("clean_days"))
    )
    return ops.retention(t.sessions, policy, _AS_OF)
