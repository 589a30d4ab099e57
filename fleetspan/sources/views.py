"""Telemetry views derived from the test tables.

Each text runs unchanged in Spark and in ANSI SQL engines: ``{table}`` names an
input. Every view reads the whole of its table(s). In production the same
column sets come from the landed history (``landing.read_history``).
"""

from __future__ import annotations

from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

AS_OF = datetime(2024, 1, 31)

VIEWS: dict[str, str] = {}

VIEWS["wait_stats_history"] = """
SELECT concat('srv', user_id % 5) AS server_name,
       date_trunc('hour', ts) AS capture_time,
       CASE event_type WHEN 'error' THEN 'LCK_M_X' WHEN 'click' THEN 'PAGEIOLATCH_SH'
            WHEN 'view' THEN 'PAGELATCH_EX' WHEN 'signup' THEN 'ASYNC_NETWORK_IO'
            ELSE 'CXPACKET' END AS wait_type,
       CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS wait_time_ms,
       CAST(sum(CAST(round(value * 10) AS BIGINT)) AS BIGINT) AS signal_wait_ms,
       CAST(count(*) AS BIGINT) AS waiting_tasks
FROM {events} GROUP BY 1, 2, 3
"""

VIEWS["perf_counters"] = """
SELECT concat('srv', user_id % 5) AS server_name, date_trunc('hour', ts) AS capture_time,
       CASE event_type WHEN 'click' THEN 'Batch Requests/sec' WHEN 'view' THEN 'Page Life Expectancy'
            WHEN 'signup' THEN 'SQL Compilations/sec' WHEN 'error' THEN 'Page Splits/sec'
            ELSE 'User Connections' END AS counter_name,
       CAST(sum(CAST(round(value) AS BIGINT)) AS BIGINT) AS counter_value
FROM {events} GROUP BY 1, 2, 3
"""

VIEWS["login_audit"] = """
SELECT event_id AS audit_id, concat('srv', user_id % 5) AS server_name,
       concat('login', user_id % 20) AS login_name,
       concat('host', user_id % 4) AS host_name,
       concat('10.0.0.', user_id % 4) AS ip_address, ts AS login_time,
       CASE event_type WHEN 'error' THEN 'FAILED_LOGIN' WHEN 'signup' THEN 'LOGOUT' ELSE 'LOGIN' END AS event_type,
       CASE event_type WHEN 'error' THEN 0 ELSE 1 END AS is_successful
FROM {events}
"""

# Databases 0-2 start late (their early growth lands on the first day they report),
# so short histories occur.
VIEWS["database_size_history"] = """
SELECT server_name, database_name, capture_time,
       CAST(db_no * 3000 + sum(mb) OVER (PARTITION BY server_name, database_name ORDER BY capture_time
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total_mb,
       CAST(db_no * 1500 + sum(used) OVER (PARTITION BY server_name, database_name ORDER BY capture_time
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS used_mb
FROM (SELECT concat('srv', user_id % 5) AS server_name, concat('db', user_id % 20) AS database_name, user_id % 20 AS db_no,
             greatest(CASE WHEN ts < TIMESTAMP '2024-01-02 00:00:00' THEN TIMESTAMP '2024-01-01 00:00:00'
                           ELSE date_trunc('day', ts) + INTERVAL '1' DAY END,
                      CASE WHEN user_id % 20 = 0 THEN TIMESTAMP '2024-01-27 00:00:00'
                           WHEN user_id % 20 IN (1, 2) THEN TIMESTAMP '2024-01-15 00:00:00'
                           ELSE TIMESTAMP '2024-01-01 00:00:00' END) AS capture_time,
             sum(CAST(round(value) AS BIGINT)) AS mb, sum(CAST(round(value / 2) AS BIGINT)) AS used
      FROM {events} GROUP BY 1, 2, 3, 4) d
"""

VIEWS["backup_history"] = """
SELECT o_orderkey AS backup_id, concat('srv', o_custkey % 3) AS server_name,
       concat('db', o_custkey % 12) AS database_name,
       CASE o_orderstatus WHEN 'F' THEN 'D' WHEN 'P' THEN 'I' ELSE 'L' END AS backup_type,
       TIMESTAMP '2024-01-01 00:00:00' + (o_orderkey % 720 - (o_custkey % 12) * 4) * INTERVAL '1' HOUR AS backup_start,
       TIMESTAMP '2024-01-01 00:00:00' + (o_orderkey % 720 - (o_custkey % 12) * 4) * INTERVAL '1' HOUR
           + (o_orderkey % 55) * INTERVAL '1' MINUTE AS backup_finish,
       CAST(floor(o_totalprice / 1000) AS BIGINT) AS backup_size_mb,
       CASE WHEN o_orderkey % 17 = 0 THEN 'Failed' ELSE 'Success' END AS status
FROM {orders}
"""

VIEWS["query_stats_snapshot"] = """
SELECT concat('srv', l_suppkey % 3) AS server_name, concat('db', l_suppkey % 12) AS database_name,
       TIMESTAMP '2024-01-30 20:00:00' + (l_linenumber % 4) * INTERVAL '1' HOUR AS capture_time, l_partkey AS query_hash,
       concat('SELECT c', l_partkey % 5, ' FROM t', l_partkey % 50) AS query_text,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS exec_count,
       CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS total_elapsed_ms,
       CAST(sum(CAST(floor(l_extendedprice * l_discount * 100) AS BIGINT)) AS BIGINT) AS logical_reads
FROM {lineitem} GROUP BY 1, 2, 3, 4, 5
"""

# Three servers, each with two captures an hour apart; session ids repeat across servers and captures.
VIEWS["session_requests"] = """
SELECT concat('srv', c_custkey % 3) AS server_name,
       TIMESTAMP '2024-01-31 00:00:00' - (CAST(floor(c_custkey / 3) AS BIGINT) % 2) * INTERVAL '1' HOUR AS capture_time,
       CAST(floor(c_custkey / 6) AS BIGINT) + 51 AS session_id,
       CASE WHEN CAST(floor(c_custkey / 6) AS BIGINT) % 4 = 0 THEN 0
            ELSE 51 + CAST(floor(c_custkey / 18) AS BIGINT) END AS blocking_session_id,
       concat('login', c_custkey % 20) AS login_name,
       concat('app', c_custkey % 7) AS program_name,
       concat('host', c_custkey % 9) AS host_name,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'running' WHEN 'FURNITURE' THEN 'idle'
            WHEN 'MACHINERY' THEN 'idle in transaction' ELSE 'suspended' END AS status,
       CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE concat('WAIT', c_nationkey % 6) END AS wait_type,
       CAST(floor(abs(c_acctbal)) AS BIGINT) AS wait_time_ms,
       TIMESTAMP '2024-01-31 00:00:00' - (c_custkey % 900) * INTERVAL '1' SECOND AS query_start,
       concat('SELECT c', c_custkey % 5, ' FROM t', c_custkey % 50) AS query_text
FROM {customer}
"""

# A table holds up to 40 indexes, so the number of tables grows with the data. Table names repeat
# across servers, databases and schemas, index ids and names across tables.
VIEWS["index_columns"] = """
SELECT concat('srv', CAST(floor(l_orderkey / 40) AS BIGINT) % 3) AS server_name,
       concat('db', CAST(floor(l_orderkey / 120) AS BIGINT) % 4) AS database_name,
       concat('schema', CAST(floor(l_orderkey / 480) AS BIGINT) % 2) AS schema_name,
       concat('t', CAST(floor(l_orderkey / 960) AS BIGINT)) AS table_name, l_orderkey % 40 + 1 AS index_id,
       CAST(l_linenumber AS BIGINT) AS key_ordinal, concat('c', min(l_partkey % 5)) AS column_name
FROM {lineitem} GROUP BY 1, 2, 3, 4, 5, 6
"""

VIEWS["index_catalog"] = """
SELECT concat('srv', CAST(floor(l_orderkey / 40) AS BIGINT) % 3) AS server_name,
       concat('db', CAST(floor(l_orderkey / 120) AS BIGINT) % 4) AS database_name,
       concat('schema', CAST(floor(l_orderkey / 480) AS BIGINT) % 2) AS schema_name,
       concat('t', CAST(floor(l_orderkey / 960) AS BIGINT)) AS table_name,
       l_orderkey % 40 + 1 AS index_id, concat('ix', l_orderkey % 40 + 1) AS index_name,
       CASE WHEN l_orderkey % 70 = 0 THEN 1 ELSE 0 END AS is_unique,
       CASE WHEN l_orderkey % 110 = 0 THEN 1 ELSE 0 END AS is_primary_key,
       CAST(sum(CAST(l_quantity AS BIGINT)) * 4 AS BIGINT) AS used_pages,
       CAST(greatest(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) - 25 ELSE 0 END), 0) AS BIGINT) AS user_seeks,
       CAST(sum(CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS user_scans,
       CAST(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS user_lookups,
       CAST(count(*) AS BIGINT) AS user_updates,
       CAST(l_orderkey % 61 AS BIGINT) AS frag_pct,
       TIMESTAMP '2024-01-31 00:00:00' - (l_orderkey % 90) * INTERVAL '1' DAY AS last_used
FROM {lineitem} GROUP BY l_orderkey
"""

VIEWS["table_stats"] = """
SELECT concat('srv', p_partkey % 3) AS server_name, concat('db', CAST(floor(p_partkey / 3) AS BIGINT) % 4) AS database_name,
       concat('schema', p_partkey % 4) AS schema_name, concat('t', p_partkey) AS table_name,
       CAST(floor(p_retailprice * p_size) AS BIGINT) AS n_live,
       CAST(floor(p_retailprice * (p_partkey % 13)) AS BIGINT) * CASE WHEN p_partkey % 7 = 0 THEN 10 ELSE 1 END AS n_dead,
       CAST(p_size * 8192 AS BIGINT) * 50 AS table_bytes,
       CAST(p_size * 8192 AS BIGINT) * (p_partkey % 30) AS index_bytes,
       CAST(p_partkey % 97 AS BIGINT) * 100 AS blks_hit, CAST(p_partkey % 11 AS BIGINT) * 10 AS blks_read,
       CAST(p_partkey % 23 AS BIGINT) * 40 AS chained_rows,
       TIMESTAMP '2024-01-31 00:00:00' - (p_partkey % 100) * INTERVAL '1' HOUR AS last_autovacuum
FROM {part}
"""

VIEWS["file_space"] = """
SELECT concat('srv', CAST(floor(s_suppkey / 4) AS BIGINT) % 3) AS server_name, concat('db', s_suppkey % 12) AS database_name,
       concat('ts', CAST(floor(s_suppkey / 12) AS BIGINT)) AS tablespace_name, concat('file', s_suppkey) AS file_name, CASE WHEN s_suppkey % 4 = 0 THEN 'LOG' ELSE 'ROWS' END AS file_type,
       CAST(1024 + (s_suppkey * 37) % 4096 AS BIGINT) AS size_mb,
       CAST(floor(((1024 + (s_suppkey * 37) % 4096) * (s_suppkey % 100)) / 100) AS BIGINT) AS used_mb,
       CAST(CASE WHEN s_suppkey % 10 = 0 THEN -1 ELSE 8192 END AS BIGINT) AS max_size_mb
FROM {supplier}
"""

VIEWS["database_catalog"] = """
SELECT concat('srv', CAST(floor(s_suppkey / 4) AS BIGINT) % 3) AS server_name, concat('db', s_suppkey % 12) AS database_name,
       CASE s_suppkey % 12 WHEN 7 THEN 'RESTORING' WHEN 10 THEN 'OFFLINE' ELSE 'ONLINE' END AS state_desc,
       CASE s_suppkey % 3 WHEN 0 THEN 'FULL' WHEN 1 THEN 'SIMPLE' ELSE 'BULK_LOGGED' END AS recovery_model,
       CASE WHEN s_suppkey % 12 = 5 THEN 1 ELSE 0 END AS is_read_only,
       CAST(count(*) AS BIGINT) AS file_count
FROM {supplier} GROUP BY 1, 2, 3, 4, 5
"""

VIEWS["replica_lag"] = """
SELECT concat('srv', user_id % 5) AS server_name, concat('ag', user_id % 3) AS ag_name, concat('replica', user_id % 9) AS replica_name,
       concat('db', user_id % 12) AS database_name,
       CASE WHEN user_id % 9 < 3 THEN 'PRIMARY' ELSE 'SECONDARY' END AS replica_role, ts AS capture_time,
       CAST(round(value * 10) AS BIGINT) AS redo_queue_mb, CAST(round(value) AS BIGINT) AS send_queue_mb,
       1000000000000 + event_id * 1000000 AS sent_lsn,
       1000000000000 + event_id * 1000000 - CAST(round(value * 10000000) AS BIGINT) AS replay_lsn,
       CASE event_type WHEN 'error' THEN 'NotHealthy' ELSE 'Healthy' END AS sync_health,
       CASE WHEN user_id % 50 = 0 THEN 'Offline' ELSE 'Online' END AS operational_state,
       CASE WHEN user_id % 40 = 1 THEN 'Recovering' ELSE 'Online' END AS recovery_health,
       ts - CAST(floor(value) AS BIGINT) * INTERVAL '1' MINUTE AS last_commit_time
FROM {events}
"""

VIEWS["job_history"] = """
SELECT concat('srv', o_custkey % 3) AS server_name, concat('job', o_custkey % 40) AS job_name,
       TIMESTAMP '2024-01-01 00:00:00' + (o_orderkey % 720) * INTERVAL '1' HOUR AS run_time,
       CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 1 END AS run_status,
       CAST(o_orderkey % 600 AS BIGINT) AS duration_s, CAST(o_orderkey % 3 AS BIGINT) AS step_id, o_orderkey AS run_id
FROM {orders}
"""

VIEWS["error_log"] = """
SELECT event_id AS log_id, concat('srv', user_id % 5) AS server_name, ts AS log_date,
       concat('spid', user_id) AS process_info,
       CASE event_type
         WHEN 'error' THEN concat('Error: 824, Severity ', 14 + user_id % 12, ', State: 2.')
         WHEN 'purchase' THEN concat('Process ', user_id, ' was chosen as DEADLOCK victim')
         WHEN 'signup' THEN concat('Login failed for user login', user_id % 20)
         WHEN 'click' THEN concat('Warning: could not flush page ', event_id)
         ELSE concat('Recovery completed for database db', user_id % 12) END AS log_text
FROM {events}
"""

VIEWS["index_maintenance_log"] = """
SELECT concat('srv', l_suppkey % 3) AS server_name, concat('db', l_suppkey % 12) AS database_name,
       concat('t', l_orderkey % 50) AS table_name, concat('ix', l_orderkey) AS index_name,
       CASE l_returnflag WHEN 'R' THEN 'REBUILD' ELSE 'REORGANIZE' END AS operation_type,
       TIMESTAMP '2024-01-01 00:00:00' + (l_orderkey % 30) * INTERVAL '1' DAY AS operation_start, CAST(l_quantity AS BIGINT) AS duration_s,
       CAST(CASE WHEN l_partkey % 13 <> 0 THEN l_partkey % 100 END AS BIGINT) AS frag_before,
       CAST(CASE WHEN l_partkey % 19 <> 0 THEN l_partkey % 7 END AS BIGINT) AS frag_after,
       CASE WHEN l_partkey % 19 = 0 THEN 'Failed' ELSE 'Success' END AS status
FROM {lineitem}
"""

# Two snapshots (0 = previous, 1 = current): each leaves out one market segment,
# so some logins appear and some disappear while every customer is in at least one. Ids and names repeat
# across the three servers; role names differ, so that a join without the server shows.
VIEWS["principals"] = """
SELECT 0 AS snap, concat('srv', c_custkey % 3) AS server_name, CAST(floor(c_custkey / 3) AS BIGINT) AS principal_id,
       concat('login', CAST(floor(c_custkey / 3) AS BIGINT)) AS login_name,
       CASE WHEN c_custkey % 2 = 0 THEN 'SQL_LOGIN' ELSE 'WINDOWS_LOGIN' END AS login_type, 0 AS is_disabled
FROM {customer} WHERE c_mktsegment <> 'HOUSEHOLD'
UNION ALL
SELECT 1 AS snap, concat('srv', c_custkey % 3) AS server_name, CAST(floor(c_custkey / 3) AS BIGINT) AS principal_id,
       concat('login', CAST(floor(c_custkey / 3) AS BIGINT)) AS login_name,
       CASE WHEN c_custkey % 2 = 0 THEN 'SQL_LOGIN' ELSE 'WINDOWS_LOGIN' END AS login_type,
       CASE WHEN c_custkey % 23 = 0 THEN 1 ELSE 0 END AS is_disabled
FROM {customer} WHERE c_mktsegment <> 'MACHINERY'
"""

VIEWS["role_members"] = """
SELECT 0 AS snap, concat('srv', c_custkey % 3) AS server_name, concat('db', CAST(floor(c_custkey / 3) AS BIGINT) % 4) AS database_name,
       concat('role', c_nationkey) AS role_name, concat('login', CAST(floor(c_custkey / 3) AS BIGINT)) AS member_name
FROM {customer} WHERE c_acctbal >= 0
UNION ALL
SELECT 1 AS snap, concat('srv', c_custkey % 3) AS server_name, concat('db', CAST(floor(c_custkey / 3) AS BIGINT) % 4) AS database_name,
       concat('role', c_nationkey) AS role_name, concat('login', CAST(floor(c_custkey / 3) AS BIGINT)) AS member_name
FROM {customer} WHERE c_acctbal < 8000
"""

VIEWS["role_catalog"] = """
SELECT concat('srv', c_custkey % 3) AS server_name, 1000000000 + CAST(c_nationkey AS BIGINT) AS role_id,
       concat('role_', c_custkey % 3, '_', c_nationkey) AS role_name
FROM {customer} GROUP BY c_custkey % 3, c_nationkey
"""

VIEWS["role_links"] = """
SELECT concat('srv', c_custkey % 3) AS server_name, 1000000000 + CAST(c_nationkey AS BIGINT) AS role_id,
       CAST(floor(c_custkey / 3) AS BIGINT) AS member_id FROM {customer}
"""

VIEWS["permission_grants"] = """
SELECT concat('srv', o_custkey % 3) AS server_name, o_orderkey AS grant_id, CAST(floor(o_custkey / 3) AS BIGINT) AS grantee_id,
       CAST(floor(o_custkey / 30) AS BIGINT) AS grantor_id,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'CONTROL SERVER' WHEN '2-HIGH' THEN 'ALTER ANY LOGIN'
            WHEN '3-MEDIUM' THEN 'VIEW SERVER STATE' ELSE 'CONNECT SQL' END AS permission_name,
       CASE o_orderstatus WHEN 'F' THEN 'GRANT' WHEN 'P' THEN 'DENY' ELSE 'GRANT_WITH_GRANT_OPTION' END AS state_desc,
       CASE WHEN o_orderkey % 8 = 0 THEN 105 ELSE 100 END AS class_id
FROM {orders}
"""

VIEWS["column_catalog"] = """
SELECT concat('srv', CAST(floor(p_partkey / 3) AS BIGINT) % 3) AS server_name, concat('db', p_partkey % 3) AS database_name, 'COLUMN' AS object_type,
       concat('schema', p_size % 4) AS schema_name, concat('t', CAST(floor(p_partkey / 90) AS BIGINT)) AS object_name,
       concat('c', CAST(floor(p_partkey / 9) AS BIGINT)) AS column_name, CAST(floor(p_partkey / 9) AS BIGINT) AS column_id,
       CASE p_size % 4 WHEN 0 THEN 'varchar' WHEN 1 THEN 'decimal' WHEN 2 THEN 'int' ELSE 'timestamp' END AS data_type,
       CASE WHEN p_size % 4 = 0 THEN p_size END AS max_length, CASE WHEN p_size % 4 = 1 THEN 18 END AS num_precision,
       CASE WHEN p_size % 4 = 1 THEN 2 END AS num_scale, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END AS is_nullable,
       CASE WHEN p_partkey % 10 = 0 THEN 1 ELSE 0 END AS is_primary_key, CASE WHEN p_partkey % 9 = 0 THEN 1 ELSE 0 END AS is_foreign_key,
       CASE WHEN p_partkey % 20 = 0 THEN 1 ELSE 0 END AS is_identity,
       CASE WHEN p_partkey % 8 = 0 THEN 'getdate()' END AS default_value
FROM {part}
"""

VIEWS["object_catalog"] = """
SELECT concat('srv', CAST(floor(p_partkey / 3) AS BIGINT) % 3) AS server_name, concat('db', p_partkey % 3) AS database_name,
       CASE CAST(floor(p_partkey / 9) AS BIGINT) % 9 WHEN 0 THEN 'SYS' WHEN 1 THEN 'CTXSYS' ELSE concat('owner', p_size % 6) END AS owner,
       CASE CAST(floor(p_partkey / 2) AS BIGINT) % 6 WHEN 0 THEN 'VIEW' WHEN 1 THEN 'PROCEDURE' WHEN 2 THEN 'FUNCTION' WHEN 3 THEN 'PACKAGE BODY'
            WHEN 4 THEN 'SEQUENCE' ELSE 'TRIGGER' END AS object_type,
       concat('obj', CAST(floor(p_partkey / 9) AS BIGINT)) AS object_name, CAST(floor(p_partkey / 9) AS BIGINT) AS object_id,
       CASE WHEN p_size % 5 = 0 THEN 'INVALID' ELSE 'VALID' END AS status,
       TIMESTAMP '2024-01-31 00:00:00' - (p_partkey % 500) * INTERVAL '1' HOUR AS last_ddl_time
FROM {part}
"""

VIEWS["lock_table"] = """
SELECT concat('srv', c_custkey % 3) AS server_name,
       TIMESTAMP '2024-01-31 00:00:00' - (CAST(floor(c_custkey / 3) AS BIGINT) % 2) * INTERVAL '1' HOUR AS capture_time,
       CAST(floor(c_custkey / 6) AS BIGINT) + 51 AS pid, CASE WHEN c_custkey % 5 = 0 THEN 'tuple' ELSE 'relation' END AS locktype,
       CAST(c_nationkey % 8 AS BIGINT) AS database_id,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 4 END AS relation_id,
       CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_custkey % 3 END AS page_id,
       CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 2 END AS tuple_id,
       CASE WHEN c_nationkey % 9 = 0 THEN concat(c_nationkey % 2, '/1') END AS virtualxid,
       CASE WHEN c_nationkey % 7 = 0 THEN CAST(c_nationkey % 2 AS BIGINT) END AS transactionid,
       CASE WHEN c_nationkey % 11 = 0 THEN CAST(c_nationkey AS BIGINT) END AS classid,
       CASE WHEN c_nationkey % 11 = 0 THEN CAST(c_nationkey % 3 AS BIGINT) END AS objid,
       CASE WHEN c_nationkey % 11 = 0 THEN CAST(0 AS BIGINT) END AS objsubid,
       CASE c_mktsegment WHEN 'MACHINERY' THEN 0 ELSE 1 END AS granted,
       CASE c_custkey % 3 WHEN 0 THEN 'ExclusiveLock' ELSE 'AccessShareLock' END AS lock_mode
FROM {customer}
"""

VIEWS["trace_events"] = """
SELECT event_id, concat('srv', user_id % 5) AS server_name, concat('db', user_id % 12) AS database_name, ts AS start_time,
       CAST(user_id % 2 AS BIGINT) AS file_type_code,
       CAST(CASE event_type WHEN 'click' THEN 92 WHEN 'view' THEN 93 ELSE 10 END AS BIGINT) AS event_class,
       CAST(round(value * 100) AS BIGINT) AS changed_pages, CAST(floor(value) AS BIGINT) AS duration_ms
FROM {events}
"""

VIEWS["settings_snapshot"] = """
SELECT concat('srv', user_id % 5) AS server_name, date_trunc('day', ts) AS capture_time,
       CASE event_type WHEN 'click' THEN 'max_connections' WHEN 'view' THEN 'work_mem'
            WHEN 'signup' THEN 'random_page_cost' WHEN 'error' THEN 'wait_timeout' ELSE 'shared_buffers' END AS setting_name,
       CASE event_type
            WHEN 'click' THEN concat(CASE WHEN max(value) > 60 THEN 300 ELSE 100 END, '')
            WHEN 'view' THEN concat(CASE WHEN max(value) > 40 THEN 64 ELSE 4 END, 'MB')
            WHEN 'signup' THEN CASE WHEN max(value) > 30 THEN '1.1' ELSE '4.0' END
            WHEN 'error' THEN concat(CASE WHEN max(value) > 50 THEN 600 ELSE 28800 END, '')
            ELSE CASE WHEN max(value) > 200 THEN '4GB' WHEN max(value) > 20 THEN '128MB' END END AS setting_value
FROM {events} GROUP BY concat('srv', user_id % 5), date_trunc('day', ts), event_type
"""

VIEWS["replication_channel"] = """
SELECT concat('srv', s_suppkey % 3) AS server_name, concat('ch', CAST(floor(s_suppkey / 3) AS BIGINT)) AS channel_name,
       concat('host', s_nationkey) AS source_host,
       CASE WHEN s_suppkey % 13 = 0 THEN 'OFF' ELSE 'ON' END AS io_state,
       CASE WHEN s_suppkey % 17 = 0 THEN 'OFF' ELSE 'ON' END AS sql_state,
       CAST(floor(abs(s_acctbal)) AS BIGINT) AS seconds_behind,
       CASE WHEN s_suppkey % 13 = 0 THEN 'connect timeout' ELSE '' END AS last_error,
       CAST(s_suppkey % 7 AS BIGINT) AS error_count, CAST(s_suppkey * 10 AS BIGINT) AS events_read
FROM {supplier}
"""

VIEWS["raw_logins"] = """
SELECT event_id AS audit_id, concat('srv', user_id % 5) AS server_name,
       CASE WHEN user_id % 20 = 0 THEN 'sa' ELSE concat('login', user_id % 20) END AS login_name,
       CASE WHEN user_id % 4 = 1 THEN NULL ELSE concat('host', user_id % 4) END AS host_name,
       CASE WHEN user_id % 6 = 1 THEN NULL ELSE concat('app', user_id % 6) END AS program_name,
       CASE WHEN user_id % 7 = 1 THEN NULL ELSE concat('10.0.0.', user_id % 7) END AS ip_address,
       ts AS login_time,
       CASE event_type WHEN 'error' THEN 'FAILED_LOGIN' WHEN 'signup' THEN 'LOGOUT' ELSE 'LOGIN' END AS event_type
FROM {events}
"""

VIEWS["connection_log"] = """
SELECT concat(CAST(CAST(ts AS DATE) AS VARCHAR(10)), ' ',
              lpad(CAST(extract(hour FROM ts) AS VARCHAR(2)), 2, '0'), ':',
              lpad(CAST(extract(minute FROM ts) AS VARCHAR(2)), 2, '0'), ':00.000 UTC [', user_id + 100, '] ',
              'login', user_id % 20, '@db', user_id % 12, ' ',
              CASE event_type WHEN 'error' THEN concat('FATAL:  password authentication failed for user "login', user_id % 20, '"')
                   WHEN 'signup' THEN concat('LOG:  disconnection: session time: 0:00:01.000 user=login', user_id % 20,
                                             ' database=db', user_id % 12, ' host=10.0.0.', user_id % 4, ' port=5000')
                   WHEN 'view' THEN 'LOG:  checkpoint starting: time'
                   ELSE concat('LOG:  connection received: host=10.0.0.', user_id % 4, ' port=5000') END) AS line
FROM {events}
"""

VIEWS["missing_index_details"] = """
SELECT concat('srv', p_partkey % 3) AS server_name, CAST(floor(p_partkey / 3) AS BIGINT) AS index_handle, concat('db', p_partkey % 12) AS database_name, concat('schema', p_partkey % 4) AS schema_name,
       concat('t', p_partkey) AS table_name, concat('[c', p_partkey % 5, '], [c', p_partkey % 3 + 5, ']') AS equality_columns,
       CASE WHEN p_size % 2 = 0 THEN concat('[d', p_size % 7, ']') END AS inequality_columns,
       CASE WHEN p_size % 3 = 0 THEN concat('[e', p_size % 5, ']') END AS included_columns
FROM {part}
"""

VIEWS["missing_index_groups"] = """
SELECT concat('srv', p_partkey % 3) AS server_name, CAST(floor(p_partkey / 3) AS BIGINT) AS index_handle,
       CAST(floor(p_partkey / 3) AS BIGINT) + 1000000 AS group_handle FROM {part}
"""

VIEWS["missing_index_stats"] = """
SELECT concat('srv', l_partkey % 3) AS server_name, CAST(floor(l_partkey / 3) AS BIGINT) + 1000000 AS group_handle, CAST(count(*) AS BIGINT) * 4 AS user_seeks,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS avg_user_cost, CAST(l_partkey % 100 AS BIGINT) AS avg_user_impact,
       TIMESTAMP '2024-01-31 00:00:00' - (l_partkey % 10) * INTERVAL '1' DAY AS capture_time
FROM {lineitem} GROUP BY l_partkey
"""

# Tasks belong to every second session: half the sessions have none, the others two.
VIEWS["task_space"] = """
SELECT concat('srv', c_custkey % 3) AS server_name,
       TIMESTAMP '2024-01-31 00:00:00' - (CAST(floor(c_custkey / 3) AS BIGINT) % 2) * INTERVAL '1' HOUR AS capture_time,
       CAST(floor(c_custkey / 12) AS BIGINT) * 2 + 51 AS session_id, CAST(floor(abs(c_acctbal) / 10) AS BIGINT) AS allocated_pages,
       CAST(floor(abs(c_acctbal) / 20) AS BIGINT) AS deallocated_pages
FROM {customer}
"""

VIEWS["redo_log"] = """
SELECT s_suppkey AS group_no, CAST(s_suppkey % 2 + 1 AS BIGINT) AS thread_no, s_suppkey * 11 AS sequence_no,
       CAST(s_suppkey % 5 + 1 AS BIGINT) * 52428800 AS bytes, CAST(s_suppkey % 2 + 1 AS BIGINT) AS members,
       CASE s_suppkey % 4 WHEN 0 THEN 'CURRENT' WHEN 1 THEN 'ACTIVE' ELSE 'INACTIVE' END AS status
FROM {supplier}
"""

VIEWS["undo_tablespaces"] = """
SELECT concat('srv', CAST(floor(s_suppkey / 4) AS BIGINT) % 3) AS server_name,
       concat('ts', CAST(floor(s_suppkey / 12) AS BIGINT)) AS tablespace_name,
       CASE WHEN CAST(floor(s_suppkey / 12) AS BIGINT) % 3 = 0 THEN 'UNDO' ELSE 'PERMANENT' END AS contents,
       CAST(900 AS BIGINT) AS undo_retention, CAST(min(s_suppkey % 50) AS BIGINT) * 60 AS tuned_retention
FROM {supplier} GROUP BY 1, 2, 3
"""


class Telemetry:
    """Lazily built views over one folder of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._views: dict[str, DataFrame] = {}
        self._read: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._read[name]

    @cached_property
    def _tables(self) -> list[str]:
        return ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

    def view(self, name: str) -> DataFrame:
        if name not in self._views:
            text = VIEWS[name]
            inputs = {t: self.table(t) for t in self._tables if "{" + t + "}" in text}
            self._views[name] = zone_free(self.spark.sql(text, **inputs))
        return self._views[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.view(name)
        raise AttributeError(name)


def zone_free(df: DataFrame) -> DataFrame:
    """Store every instant as a zone-free timestamp, as the landed parquet does."""
    zoned = [f.name for f in df.schema if isinstance(f.dataType, TimestampType)]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned}) if zoned else df
