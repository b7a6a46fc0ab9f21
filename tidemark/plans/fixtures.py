"""Input tables of the registered queries, derived from the given Parquet tables.

One SQL text per table runs on both engines: `{S}` is the text type, `{name}` a given
table. `floor` always comes before an integer cast, as the engines round differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FIXTURES: dict[str, str] = {
    # change log, 1000 events per log file, (log_no, log_pos) unique
    "changes": """
        SELECT CAST(floor(event_id/1000) AS INT)+1 AS log_no,
               concat('binlog.', lpad(CAST(CAST(floor(event_id/1000) AS INT)+1 AS {S}),6,'0')) AS log_file,
               CAST(4+(event_id%1000)*100 AS BIGINT) AS log_pos, 0 AS sub, ts AS event_ts,
               CASE WHEN user_id%3=0 THEN 'mall' ELSE 'crm' END AS db,
               concat('t', CAST(user_id%4 AS {S})) AS tbl,
               CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op,
               user_id AS pk, value AS val
        FROM {events}""",
    # base image; its keys overlap the keys of the change log
    "snapshot": "SELECT c_custkey AS pk, c_acctbal AS val FROM {customer}",
    # chains of one full and four increments; a gap where o_orderkey % 17 = 0
    "sessions": """
        SELECT CAST(o_orderkey AS {S}) AS backup_file_id,
               CASE WHEN o_orderkey%5=0 THEN 'full' ELSE 'increment' END AS backup_type,
               CASE WHEN o_orderkey%5=0 THEN '' ELSE CAST(o_orderkey-o_orderkey%5 AS {S}) END AS full_backup_file_id,
               concat('acct', CAST(CAST(floor(o_orderkey/5) AS BIGINT)%4 AS {S})) AS account_id,
               concat('job', CAST((CAST(floor(o_orderkey/5) AS BIGINT)%20)*2 AS {S})) AS job_id,
               concat('db', CAST(CAST(floor(o_orderkey/5) AS BIGINT)%7 AS {S})) AS database,
               o_orderdate AS backup_time, o_orderkey AS seq,
               CAST(floor(o_orderkey/100) AS INT)+1 AS start_no,
               CAST(4+(o_orderkey%100)*100 AS BIGINT) AS start_pos,
               CAST(floor((o_orderkey+1)/100) AS INT)+1 AS end_no,
               CAST(4+((o_orderkey+1)%100)*100 - CASE WHEN o_orderkey%17=0 THEN 1 ELSE 0 END AS BIGINT) AS end_pos,
               CAST(floor(o_totalprice) AS BIGINT) AS size,
               CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status
        FROM {orders}""",
    # half full, half incremental; some share a link
    "jobs": """
        SELECT concat('job', CAST(s_suppkey AS {S})) AS id, s_name AS name,
               concat('acct', CAST(CAST(floor(s_suppkey/2) AS BIGINT)%4 AS {S})) AS account_id,
               CASE WHEN s_suppkey%2=0 THEN 'full' ELSE 'incremental' END AS backup_type,
               CASE WHEN s_suppkey%2=0 THEN '' WHEN s_suppkey%10=9 THEN concat('job',CAST(s_suppkey-9 AS {S}))
                    ELSE concat('job',CAST(s_suppkey-1 AS {S})) END AS linked_full_backup_job_id,
               concat('db', CAST(s_nationkey AS {S})) AS db_instance_id, CAST(s_suppkey%8 AS INT) AS clean_days,
               concat(CASE WHEN s_suppkey%3=0 THEN '0/30' ELSE CAST(s_suppkey%60 AS {S}) END, ' ',
                      CASE WHEN s_suppkey%4=0 THEN '*/6' ELSE '1-5' END, ' * * ',
                      CASE WHEN s_suppkey%5=0 THEN '1,3' ELSE '*' END) AS schedule
        FROM {supplier}""",
    # some job references have no instance
    "instances": """
        SELECT concat('db', CAST(n_nationkey AS {S})) AS id, n_name AS name,
               concat('acct', CAST(n_nationkey%4 AS {S})) AS account_id
        FROM {nation} WHERE n_nationkey < 20""",
    "objects": """
        SELECT p_partkey AS ord, concat('t',CAST(p_partkey AS {S})) AS name,
               CASE WHEN p_type LIKE 'ECONOMY%' THEN 'MyISAM' ELSE 'InnoDB' END AS engine,
               CASE WHEN p_size%10=0 THEN 'VIEW' ELSE 'BASE TABLE' END AS table_type
        FROM {part}""",
    # file names of dump sessions; names repeat
    "dump_files": """
        SELECT concat(CASE WHEN p_partkey%2=0 THEN 'mall' ELSE 'mall_test' END, '.', replace(p_name,' ','_'),
                      CASE WHEN p_size%5=0 THEN '-schema' ELSE concat('.',lpad(CAST(p_size AS {S}),5,'0')) END,
                      '.sql.zst') AS file_name,
               CAST(p_partkey%9 AS INT) AS session_no, CAST(floor(p_retailprice*100) AS BIGINT) AS size_bytes
        FROM {part}""",
    # polls of a table's files; the size stands still from event_id % 40 >= 10
    "polls": """
        SELECT concat('t', CAST(CAST(floor(event_id/40) AS BIGINT) AS {S})) AS tbl,
               CAST(event_id%40 AS INT) AS poll_no,
               CAST(CASE WHEN event_id%40<10 THEN event_id%40 ELSE 10 END AS BIGINT) AS size_bytes, ts AS poll_ts
        FROM {events}""",
    # three levels by parent id
    "tree": """
        SELECT concat('r',CAST(r_regionkey AS {S})) AS id, CAST(NULL AS {S}) AS pid, r_name AS name,
               CAST(r_regionkey AS BIGINT) AS ord FROM {region}
        UNION ALL SELECT concat('n',CAST(n_nationkey AS {S})), concat('r',CAST(n_regionkey AS {S})), n_name,
               CAST(n_nationkey AS BIGINT) FROM {nation}
        UNION ALL SELECT concat('s',CAST(s_suppkey AS {S})), concat('n',CAST(s_nationkey AS {S})), s_name,
               CAST(s_suppkey AS BIGINT) FROM {supplier}""",
    # prices as decimals, so both engines print the same text
    "orders_v1": """
        SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice,
               o_orderdate, o_orderpriority FROM {orders}""",
    # changed copy of orders: changed, removed and added rows
    "orders_v2": """
        SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey%7=0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
               CAST(CASE WHEN o_orderkey%11=0 THEN o_totalprice+1 ELSE o_totalprice END AS DECIMAL(18,2)) AS o_totalprice,
               o_orderdate, o_orderpriority
        FROM {orders} WHERE o_orderkey%13<>0
        UNION ALL SELECT o_orderkey+10000000, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)),
               o_orderdate, o_orderpriority
        FROM {orders} WHERE o_orderkey%97=0""",
    # target times to find a baseline for
    "targets": """
        SELECT l_orderkey AS order_id, l_linenumber AS line_no,
               concat('db', CAST(l_orderkey%7 AS {S})) AS database, l_shipdate AS target_time
        FROM {lineitem}""",
    # where each table's own snapshot was taken
    "table_positions": """
        SELECT concat('t', CAST(r_regionkey AS {S})) AS tbl, CAST(r_regionkey+1 AS INT) AS start_no,
               CAST(4+r_regionkey*1000 AS BIGINT) AS start_pos
        FROM {region}""",
    # lines of run logs, 50 lines per run
    "log_lines": """
        SELECT CAST(floor(event_id/50) AS BIGINT) AS session_no, CAST(event_id%50 AS INT) AS line_no,
               CASE WHEN event_id%50=2 AND floor(event_id/50)%3=0
                      THEN concat('[2024-01-01 00:00:00] 输出目录: /backup/mall_', CAST(event_id AS {S}), ' ')
                    WHEN event_id%50 IN (1, 7)
                      THEN concat('  目录: /old/mall_', CAST(event_id AS {S}))
                    WHEN event_id%50=49 AND user_id%4<>0 THEN '[2024-01-01 00:00:09] 备份完成。'
                    ELSE concat('[2024-01-01 00:00:01] tool --user=', event_type, ' --password=p', CAST(user_id AS {S}), '#x --threads=4')
               END AS line
        FROM {events}""",
    # files of run directories
    "run_files": """
        SELECT CAST(floor(event_id/50) AS BIGINT) AS session_no,
               CASE (event_id*7+user_id)%97 WHEN 0 THEN 'data/metadata' WHEN 1 THEN 'data/metadata.partial'
                    WHEN 2 THEN 'metadata' WHEN 3 THEN 'metadata.partial' ELSE concat('data/f', CAST(event_id AS {S})) END AS rel_path,
               CAST(100+event_id%977 AS BIGINT) AS size_bytes
        FROM {events}""",
    # text of exported log files, 20 lines per file
    "export_lines": """
        SELECT concat('binlog.', lpad(CAST(CAST(floor(event_id/20) AS BIGINT) AS {S}),6,'0'), '.sql') AS file_name,
               CASE WHEN event_type='error' THEN '### UPDATE t' WHEN event_type='signup' AND user_id%2=0
                    THEN 'BINLOG ''abc' ELSE concat('SET @@x=', CAST(user_id AS {S}), ';') END AS line
        FROM {events}""",
}

_NAME = re.compile(r"\{(\w+)\}")


def given_tables(name: str) -> list[str]:
    return sorted(set(_NAME.findall(FIXTURES[name])) - {"S"})


def duckdb_cte(name: str) -> str:
    text = FIXTURES[name].replace("{S}", "VARCHAR")
    return f"{name} AS ({_NAME.sub(lambda m: m.group(1), text)})"


class Tables:
    """`t.orders` is a given table, `t.sessions` a derived one."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in FIXTURES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        inputs = {table: getattr(self, table) for table in given_tables(name)}
        return self.spark.sql(FIXTURES[name].replace("{S}", "STRING"), **inputs)
