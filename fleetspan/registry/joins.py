"""Join queries (J01-J25) and the set operation on column lists."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from fleetspan.operators import aggregates, joins
from fleetspan.registry import Entry, with_views
from fleetspan.sources.views import AS_OF

NOW = "TIMESTAMP '2024-01-31 00:00:00'"
ORDERS_AS_OF = datetime(2001, 8, 1, 12)

SERVERS = [("srv0", "PROD", 1), ("srv1", "PROD", 1), ("srv2", "UAT", 1), ("srv3", "UAT", 1), ("srv4", "DEV", 1), ("srv5", "DEV", 0)]
SQL_SERVERS = "inventory(server_name, environment, is_active) AS (VALUES " + ", ".join(
    f"('{s}', '{e}', CAST({a} AS BIGINT))" for s, e, a in SERVERS
) + ")"


def inventory(t):
    return t.spark.createDataFrame(SERVERS, "server_name string, environment string, is_active bigint")


def free_extents(t):
    """Free space per file; files that are full have no extent."""
    return t.file_space.where(F.col("size_mb") > F.col("used_mb")).select(
        "server_name", "tablespace_name", (F.col("size_mb") - F.col("used_mb")).alias("free_mb")
    )


def used_segments(t):
    return t.file_space.where(F.col("file_type") == "ROWS").select("server_name", "tablespace_name", "used_mb")


def snapshot(df, n):
    return df.where(F.col("snap") == n).drop("snap")


def wait_events(t):
    return t.wait_stats_history.groupBy("server_name", F.col("wait_type").alias("event")).agg(
        F.sum("waiting_tasks").cast("bigint").alias("total_waits"), F.sum("wait_time_ms").cast("bigint").alias("time_waited")
    )


def wait_names(t):
    return t.wait_stats_history.select("wait_type").distinct().select(
        F.col("wait_type").alias("event"), F.when(F.col("wait_type").like("ASYNC%"), "Idle").otherwise("Work").alias("wait_class")
    )


def columns_parts(t):
    c = t.column_catalog
    types = t.spark.createDataFrame(
        [("varchar", "text"), ("decimal", "number"), ("int", "number"), ("timestamp", "time")], "data_type string, type_family string"
    )
    return (
        c.select(
            "server_name", "database_name", "schema_name", "object_name", "column_name", "column_id", "data_type", "max_length", "num_precision",
            "num_scale", "is_nullable",
        ),
        types,
        c.where("is_primary_key = 1"),
        c.where("is_foreign_key = 1"),
        c.where("is_identity = 1"),
        c.where("default_value IS NOT NULL"),
    )


def stock(t):
    return t.table("lineitem").groupBy(F.col("l_partkey").alias("product_id")).agg(
        F.floor(F.max("l_quantity") / 3).alias("quantity"),
        F.when(F.col("product_id") % 3 != 0, F.floor(F.count("*") / 2)).alias("reorder_point"),
    )


def open_orders(t):
    return t.table("orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_totalprice").alias("total_due"),
        F.col("o_orderdate").alias("order_time"),
        F.when(F.col("o_orderstatus") == "O", "In Process").when(F.col("o_orderstatus") == "P", "Approved").otherwise("Closed").alias("order_status"),
    )


def people_parts(t):
    s = t.table("supplier")
    people = s.select(F.col("s_suppkey").alias("person_id"), F.col("s_name").alias("person_name"))
    vacation = s.where(F.col("s_acctbal") >= 0).select(F.col("s_suppkey").alias("person_id"), F.floor("s_acctbal").alias("vacation_hours"))
    sick = s.where(F.col("s_nationkey") < 12).select(
        F.col("s_suppkey").alias("person_id"), F.col("s_nationkey").cast("bigint").alias("sick_hours")
    )
    activity = (
        t.table("lineitem")
        .select("l_orderkey", F.col("l_suppkey").alias("person_id"))
        .join(t.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("activity_time")), "l_orderkey")
    )
    return people, vacation, sick, activity


TBL = "server_name, database_name, schema_name, table_name"


def same_table(a: str, b: str) -> str:
    return " AND ".join(f"{a}.{c} = {b}.{c}" for c in TBL.split(", "))


def of(alias: str) -> str:
    return ", ".join(f"{alias}.{c}" for c in TBL.split(", "))


SQL_KEYED = f"""sized AS (SELECT {TBL}, index_id, index_name, is_unique, is_primary_key, used_pages * 8 AS size_kb FROM index_catalog),
    keyed AS (SELECT {of('c')}, c.index_id, s.index_name, s.is_unique, s.is_primary_key, s.size_kb,
                     list(c.column_name ORDER BY c.key_ordinal) AS cols
              FROM index_columns c JOIN sized s ON {same_table('c', 's')} AND c.index_id = s.index_id
              GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9)"""
SQL_DUPLICATES = f"""{SQL_KEYED},
    plain AS (SELECT * FROM keyed WHERE is_unique = 0 AND is_primary_key = 0),
    grp AS (SELECT {TBL}, cols, CAST(count(*) AS BIGINT) AS group_size, min(CASE WHEN is_unique = 0 AND is_primary_key = 0 THEN index_id END) AS first_id
            FROM keyed GROUP BY 1, 2, 3, 4, 5),
    exact AS (SELECT {of('k')}, 'EXACT' AS match_kind, f.index_name AS index1_name, k.index_name AS index2_name, f.cols AS cols1, k.cols AS cols2,
                     f.size_kb AS index1_size_kb, k.size_kb AS index2_size_kb, g.group_size, k.is_primary_key, k.is_unique
              FROM keyed k JOIN grp g ON {same_table('k', 'g')} AND k.cols = g.cols
              JOIN keyed f ON {same_table('f', 'g')} AND f.index_id = g.first_id WHERE k.index_id > g.first_id),
    wide AS (SELECT {of('k')}, k.index_id, min(p.index_id) AS wide_id, CAST(count(*) + 1 AS BIGINT) AS group_size FROM keyed k
             JOIN plain p ON {same_table('p', 'k')} AND len(p.cols) > len(k.cols) AND p.cols[1:len(k.cols)] = k.cols GROUP BY 1, 2, 3, 4, 5),
    pre AS (SELECT {of('k')}, 'LEFT PREFIX' AS match_kind, f.index_name AS index1_name, k.index_name AS index2_name, f.cols AS cols1, k.cols AS cols2,
                   f.size_kb AS index1_size_kb, k.size_kb AS index2_size_kb, w.group_size, k.is_primary_key, k.is_unique
            FROM keyed k JOIN wide w ON {same_table('k', 'w')} AND k.index_id = w.index_id
            JOIN keyed f ON {same_table('f', 'w')} AND f.index_id = w.wide_id),
    dup AS (SELECT {TBL}, match_kind, index1_name, index2_name, array_to_string(cols1, ', ') AS index1_columns,
                   array_to_string(cols2, ', ') AS index2_columns,
                   array_to_string(list_distinct(cols2), ', ') AS any_shared, cols1, cols2,
                   index1_size_kb, index2_size_kb, index2_size_kb AS savings_kb, group_size,
                   CASE WHEN is_primary_key = 1 THEN 'Keep Index2 (PK)' WHEN is_unique = 1 THEN 'Keep Index2 (Unique)' ELSE 'DROP Index2' END AS recommendation
            FROM (SELECT * FROM exact UNION ALL SELECT * FROM pre) u WHERE index2_size_kb >= 100)"""

SQL_BACKUP_STATUS = f"""status AS (SELECT server_name, database_name, backup_type, max(backup_start) AS last_start, max(backup_finish) AS last_finish,
        CAST(date_diff('hour', max(backup_finish), {NOW}) AS BIGINT) AS hours,
        CASE WHEN max(backup_finish) IS NULL THEN 'NO BACKUP' WHEN date_diff('hour', max(backup_finish), {NOW}) > 24 THEN 'OVERDUE'
             WHEN date_diff('hour', max(backup_finish), {NOW}) > 12 THEN 'WARNING' ELSE 'OK' END AS backup_status
        FROM backup_history GROUP BY 1, 2, 3)"""

SQL_PAIR = """
        SELECT w.server_name, w.capture_time,
               w.session_id AS blocked_session, w.blocking_session_id AS blocking_session, w.login_name AS blocked_login, w.status AS blocked_status,
               w.program_name AS blocked_program, w.wait_type, w.wait_time_ms, left(w.query_text, 100) AS blocked_query,
               b.login_name AS blocker_login, b.status AS blocker_status, b.program_name AS blocker_program, left(b.query_text, 100) AS blocker_query
        FROM session_requests w {how} JOIN session_requests b
          ON w.blocking_session_id = b.session_id AND w.server_name = b.server_name AND w.capture_time = b.capture_time
        WHERE w.blocking_session_id > 0 AND w.wait_time_ms >= {floor}"""
#: The sessions of each server's newest capture.
SQL_SESSIONS_NOW = """(SELECT s.* FROM session_requests s
        WHERE s.capture_time = (SELECT max(x.capture_time) FROM session_requests x WHERE x.server_name = s.server_name))"""
LOCK_KEY = joins.LOCK_RESOURCE
SQL_SAME_LOCK = " AND ".join(f"o.{c} IS NOT DISTINCT FROM w.{c}" for c in LOCK_KEY)

ENTRIES = {
    "j01_blocking_pairs": Entry(lambda t: joins.blocking_pairs(t.session_requests), with_views(SQL_PAIR.format(how="", floor=0))),
    "j01_blocking_pairs_left": Entry(
        lambda t: joins.blocking_pairs(t.session_requests, min_wait_ms=5000, how="left"),
        with_views(SQL_PAIR.format(how="LEFT", floor=5000)),
    ),
    "j02_lock_waits": Entry(
        lambda t: joins.lock_waits(t.lock_table, t.session_requests, AS_OF),
        with_views(f"""WITH hits AS (
            SELECT {", ".join("w." + c for c in LOCK_KEY)}, w.pid, count(*) AS blockers, min(o.pid) AS lo, max(o.pid) AS hi
            FROM lock_table w JOIN lock_table o ON {SQL_SAME_LOCK} AND o.pid <> w.pid
            WHERE w.granted = 0 GROUP BY ALL)
        SELECT {", ".join("h." + c for c in LOCK_KEY)}, h.pid AS blocked_pid, CAST(h.blockers AS BIGINT) AS blockers,
               CASE WHEN h.lo < h.pid THEN h.lo ELSE h.hi END AS blocking_pid, a.login_name AS blocked_user, a.query_text AS blocked_query,
               a.query_start AS blocked_since, b.login_name AS blocking_user, b.query_text AS blocking_query,
               CAST(date_diff('second', a.query_start, {NOW}) AS BIGINT) AS wait_s
        FROM hits h JOIN session_requests a ON a.session_id = h.pid AND a.server_name = h.server_name AND a.capture_time = h.capture_time
        JOIN session_requests b ON b.session_id = CASE WHEN h.lo < h.pid THEN h.lo ELSE h.hi END
         AND b.server_name = h.server_name AND b.capture_time = h.capture_time"""),
    ),
    "j02_lock_queue": Entry(
        lambda t: joins.lock_queue(t.lock_table),
        with_views(f"""WITH q AS (SELECT {", ".join(LOCK_KEY)}, pid, granted,
            count(*) OVER w AS lock_rows, sum(1 - granted) OVER w AS waiters, min(pid) OVER w AS min_pid, max(pid) OVER w AS max_pid
            FROM lock_table WINDOW w AS (PARTITION BY {", ".join(LOCK_KEY)}))
        SELECT {", ".join(LOCK_KEY)}, pid, granted, CAST(lock_rows AS BIGINT) AS lock_rows,
               CAST(waiters AS BIGINT) AS waiters, min_pid, max_pid FROM q WHERE waiters > 0 AND min_pid <> max_pid"""),
    ),
    "j03_blocking_chains": Entry(
        lambda t: joins.blocking_chains(t.session_requests),
        "WITH RECURSIVE " + with_views("""WITH e AS (SELECT * FROM session_requests WHERE blocking_session_id > 0),
        down(server_name, capture_time, root_blocker, session_id, level) AS (
            SELECT e.server_name, e.capture_time, e.blocking_session_id, e.session_id, CAST(1 AS BIGINT) FROM e
            WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.session_id = e.blocking_session_id AND x.server_name = e.server_name AND x.capture_time = e.capture_time)
            UNION ALL
            SELECT d.server_name, d.capture_time, d.root_blocker, e.session_id, d.level + 1 FROM e JOIN down d
             ON e.blocking_session_id = d.session_id AND e.server_name = d.server_name AND e.capture_time = d.capture_time)
        SELECT d.server_name, d.capture_time, d.root_blocker, d.session_id, s.blocking_session_id AS blocked_by, d.level,
               'CHAIN' AS chain_state, s.login_name, s.status, s.wait_type, s.wait_time_ms, left(s.query_text, 150) AS current_query
        FROM down d JOIN e s ON s.session_id = d.session_id AND s.server_name = d.server_name AND s.capture_time = d.capture_time""")[5:],
    ),
    "j03_blocking_walk": Entry(
        lambda t: joins.blocking_walk(t.session_requests, t.session_requests.where(F.col("wait_time_ms") >= 9000)),
        "WITH RECURSIVE " + with_views("""WITH e AS (SELECT server_name, capture_time, session_id, blocking_session_id AS b, wait_time_ms FROM session_requests WHERE blocking_session_id > 0),
        up(server_name, capture_time, origin, session_id, b, level) AS (
            SELECT server_name, capture_time, session_id, session_id, b, CAST(0 AS BIGINT) FROM e WHERE wait_time_ms >= 9000
            UNION ALL SELECT u.server_name, u.capture_time, u.origin, e.session_id, e.b, u.level + 1 FROM up u JOIN e
             ON e.session_id = u.b AND e.server_name = u.server_name AND e.capture_time = u.capture_time),
        head AS (SELECT server_name, capture_time, origin, arg_max(b, level) AS root_blocker FROM up GROUP BY 1, 2, 3)
        SELECT u.server_name, u.capture_time, h.root_blocker, u.origin, u.session_id, u.b AS blocked_by, u.level
        FROM up u JOIN head h ON h.origin = u.origin AND h.server_name = u.server_name AND h.capture_time = u.capture_time""")[5:],
    ),
    "j03_blocking_paths": Entry(
        lambda t: joins.blocking_paths(t.session_requests),
        with_views("""WITH RECURSIVE e AS (SELECT server_name, capture_time, session_id, blocking_session_id AS b FROM session_requests WHERE blocking_session_id > 0),
        walk(server_name, capture_time, origin, visited, stop) AS (
            SELECT server_name, capture_time, session_id, [session_id], b FROM e
            UNION ALL SELECT w.server_name, w.capture_time, w.origin, list_append(w.visited, w.stop), e.b FROM walk w
            JOIN e ON e.server_name = w.server_name AND e.capture_time = w.capture_time AND e.session_id = w.stop WHERE NOT list_contains(w.visited, w.stop)),
        ends AS (SELECT w.*, list_contains(visited, stop) AS circle FROM walk w
            WHERE list_contains(visited, stop) OR NOT EXISTS (SELECT 1 FROM e WHERE e.server_name = w.server_name AND e.capture_time = w.capture_time AND e.session_id = w.stop)),
        cut AS (SELECT *, CASE WHEN circle THEN list_min(visited[list_position(visited, stop):]) END AS cycle_id FROM ends),
        way AS (SELECT *, CASE WHEN circle THEN visited[:list_position(visited, cycle_id) - 1] ELSE visited END AS steps, CASE WHEN circle THEN cycle_id ELSE stop END AS head FROM cut)
        SELECT way.server_name, way.capture_time, origin AS session_id, e.b AS blocked_by, CASE WHEN NOT circle THEN stop END AS root_blocker, cycle_id,
               circle AND list_contains(visited[list_position(visited, stop):], origin) AS in_cycle, CAST(len(steps) AS BIGINT) AS level,
               array_to_string(list_prepend(head, list_reverse(steps)), ' > ') AS path, repeat('  ', len(steps)) || origin AS chain
        FROM way JOIN e ON e.server_name = way.server_name AND e.capture_time = way.capture_time AND e.session_id = way.origin"""),
    ),
    "j04_session_sql": Entry(
        lambda t: joins.session_sql(
            t.session_requests.withColumn("sql_id", F.col("session_id") - 51),
            t.query_stats_snapshot.groupBy("server_name", F.col("query_hash").alias("sql_id")).agg(F.min("query_text").alias("sql_text")),
        ),
        with_views("""WITH q AS (SELECT server_name, query_hash AS sql_id, left(min(query_text), 100) AS sql_text FROM query_stats_snapshot GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY server_name, capture_time ORDER BY wait_time_ms DESC, session_id) AS wait_rank FROM session_requests)
        SELECT s.server_name, s.capture_time, s.session_id, s.login_name, s.program_name, s.status, s.wait_time_ms, s.session_id - 51 AS sql_id,
               s.wait_rank, q.sql_text
        FROM r s LEFT JOIN q ON q.sql_id = s.session_id - 51 AND q.server_name = s.server_name WHERE s.wait_rank <= 20"""),
    ),
    "j05_space_usage": Entry(
        lambda t: joins.space_usage(t.file_space, free_extents(t)),
        with_views("""WITH j AS (SELECT server_name, tablespace_name, CAST(sum(size_mb) AS BIGINT) AS total_mb,
                   CAST(sum(CASE WHEN size_mb > used_mb THEN size_mb - used_mb ELSE 0 END) AS BIGINT) AS free_mb FROM file_space GROUP BY 1, 2)
        SELECT server_name, tablespace_name, total_mb, total_mb - free_mb AS used_mb, free_mb,
               CAST(round(CAST(CAST(total_mb - free_mb AS DOUBLE) / total_mb * 100 AS DECIMAL(38, 10)), 2) AS DOUBLE) AS used_pct,
               CASE WHEN CAST(total_mb - free_mb AS DOUBLE) / total_mb * 100 >= 90 THEN 'CRITICAL'
                    WHEN CAST(total_mb - free_mb AS DOUBLE) / total_mb * 100 >= 80 THEN 'WARNING' ELSE 'OK' END AS alert_status FROM j"""),
    ),
    "j05_temp_usage": Entry(
        lambda t: joins.temp_usage(t.file_space, t.file_space.where(F.col("used_mb") > 0).select("server_name", "tablespace_name", "used_mb")),
        with_views("""
        SELECT server_name, tablespace_name, CAST(sum(size_mb) AS BIGINT) AS allocated_mb, CAST(sum(used_mb) AS BIGINT) AS used_mb,
               CAST(sum(size_mb) - sum(used_mb) AS BIGINT) AS free_mb,
               CAST(round(CAST(CAST(sum(used_mb) AS DOUBLE) * 100 / sum(size_mb) AS DECIMAL(38, 10)), 2) AS DOUBLE) AS used_pct
        FROM file_space GROUP BY 1, 2"""),
    ),
    "j06_undo_usage": Entry(
        lambda t: joins.undo_usage(t.file_space, t.undo_tablespaces, used_segments(t)),
        with_views("""WITH a AS (SELECT server_name, tablespace_name, CAST(sum(size_mb) AS BIGINT) AS total_mb,
            CAST(sum(CASE WHEN file_type = 'ROWS' THEN used_mb ELSE 0 END) AS BIGINT) AS used_mb FROM file_space GROUP BY 1, 2)
        SELECT a.server_name, a.tablespace_name, a.total_mb, a.used_mb,
               CAST(round(CAST(CAST(a.used_mb AS DOUBLE) * 100 / a.total_mb AS DECIMAL(38, 10)), 2) AS DOUBLE) AS used_pct, t.undo_retention, t.tuned_retention,
               CASE WHEN t.tuned_retention < t.undo_retention THEN 'BELOW TARGET' ELSE 'OK' END AS retention_status
        FROM a JOIN undo_tablespaces t ON a.tablespace_name = t.tablespace_name AND a.server_name = t.server_name WHERE t.contents = 'UNDO'"""),
    ),
    "j07_duplicate_index_columns": Entry(
        lambda t: joins.duplicate_index_columns(t.index_columns, t.index_catalog),
        with_views(f"""WITH m AS (SELECT {of('c')}, c.index_id, c.key_ordinal, c.column_name, s.index_name, s.is_unique, s.is_primary_key, s.used_pages * 8 AS size_kb
            FROM index_columns c JOIN index_catalog s ON {same_table('c', 's')} AND c.index_id = s.index_id),
        g AS (SELECT {TBL}, key_ordinal, column_name, CAST(count(*) AS BIGINT) AS group_size,
                     min(CASE WHEN is_unique = 0 AND is_primary_key = 0 THEN index_id END) AS first_id FROM m GROUP BY 1, 2, 3, 4, 5, 6)
        SELECT {of('m')}, m.key_ordinal, m.column_name, f.index_name AS index1_name, m.index_name AS index2_name,
               f.used_pages * 8 AS index1_size_kb, m.size_kb AS index2_size_kb, g.group_size,
               CASE WHEN m.is_primary_key = 1 THEN 'Keep Index2 (PK)' WHEN m.is_unique = 1 THEN 'Keep Index2 (Unique)' ELSE 'Consider Dropping' END AS recommendation
        FROM m JOIN g ON {same_table('m', 'g')} AND m.key_ordinal = g.key_ordinal AND m.column_name = g.column_name
        JOIN index_catalog f ON {same_table('f', 'g')} AND f.index_id = g.first_id WHERE m.index_id > g.first_id"""),
    ),
    "j08_duplicate_indexes": Entry(
        lambda t: joins.duplicate_indexes(t.index_columns, t.index_catalog).drop("shared_columns"),
        with_views(f"""WITH {SQL_DUPLICATES}
        SELECT {TBL}, match_kind, index1_name, index2_name, index1_columns, index2_columns, index1_size_kb, index2_size_kb, savings_kb,
               group_size, recommendation FROM dup"""),
    ),
    "j08_column_sets": Entry(
        lambda t: joins.column_sets(t.index_columns, t.index_catalog).withColumn("column_set", F.array_join("column_set", ", ")),
        with_views(f"""WITH k AS (SELECT {TBL}, index_id, string_agg(column_name, ', ' ORDER BY key_ordinal) AS key_columns,
            array_to_string(list_sort(list_distinct(list(column_name))), ', ') AS column_set FROM index_columns GROUP BY {TBL}, index_id),
        g AS (SELECT {TBL}, column_set, min(index_id) AS set_id, CAST(count(*) AS BIGINT) AS set_size, CAST(sum(used_pages * 8) AS BIGINT) AS set_kb
              FROM k JOIN index_catalog s USING ({TBL}, index_id) GROUP BY {TBL}, column_set)
        SELECT {of('k')}, k.index_id, s.index_name, s.is_unique, s.is_primary_key, s.used_pages * 8 AS size_kb, k.key_columns, k.column_set, g.set_id, g.set_size, g.set_kb
        FROM k JOIN index_catalog s USING ({TBL}, index_id) JOIN g ON {same_table('k', 'g')} AND k.column_set = g.column_set"""),
    ),
    "j08_overlapping_indexes": Entry(
        lambda t: joins.overlapping_indexes(t.index_columns, t.index_catalog),
        with_views(f"""WITH k AS (SELECT {TBL}, index_id, list_sort(list_distinct(list(column_name))) AS c FROM index_columns GROUP BY {TBL}, index_id),
        g AS (SELECT {TBL}, c, min(index_id) AS index_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(used_pages * 8) AS BIGINT) AS kb
              FROM k JOIN index_catalog s USING ({TBL}, index_id) GROUP BY {TBL}, c),
        p AS (SELECT {of('a')}, a.index_id AS i1, b.index_id AS i2, a.c AS c1, b.c AS c2, a.n AS n1, b.n AS n2, a.kb AS kb1, b.kb AS kb2, list_sort(list_intersect(a.c, b.c)) AS both_
              FROM g a JOIN g b ON {same_table('a', 'b')} AND a.index_id < b.index_id)
        SELECT {of('p')}, x.index_name AS index1_name, y.index_name AS index2_name, array_to_string(c1, ', ') AS columns1, array_to_string(c2, ', ') AS columns2,
               array_to_string(both_, ', ') AS shared_columns,
               CAST(round(CAST(CAST(len(both_) AS DOUBLE) * 100 / (len(c1) + len(c2) - len(both_)) AS DECIMAL(38, 10)), 2) AS DOUBLE) AS overlap_pct,
               n1 AS set1_indexes, n2 AS set2_indexes, kb1 AS set1_kb, kb2 AS set2_kb
        FROM p JOIN index_catalog x ON {same_table('x', 'p')} AND x.index_id = p.i1 JOIN index_catalog y ON {same_table('y', 'p')} AND y.index_id = p.i2
        WHERE len(both_) * 100 >= 50 * (len(c1) + len(c2) - len(both_))"""),
    ),
    "u02_shared_columns": Entry(
        lambda t: joins.duplicate_indexes(t.index_columns, t.index_catalog, min_kb=0).select(
            *joins.TABLE, "match_kind", "index1_name", "index2_name", "shared_columns"
        ),
        with_views(f"""WITH {SQL_DUPLICATES.replace('index2_size_kb >= 100', 'index2_size_kb >= 0')},
        flat AS (SELECT {TBL}, match_kind, index1_name, index2_name, cols2, unnest(cols1) AS c, generate_subscripts(cols1, 1) AS pos FROM dup),
        firsts AS (SELECT {TBL}, match_kind, index1_name, index2_name, c, min(pos) AS pos FROM flat WHERE list_contains(cols2, c) GROUP BY ALL)
        SELECT {TBL}, match_kind, index1_name, index2_name, string_agg(c, ', ' ORDER BY pos) AS shared_columns FROM firsts
        GROUP BY {TBL}, match_kind, index1_name, index2_name"""),
    ),
    "j09_missing_indexes": Entry(
        lambda t: joins.missing_indexes(t.missing_index_details, t.missing_index_groups, t.missing_index_stats),
        with_views("""
        SELECT d.server_name, d.index_handle, d.database_name, d.schema_name, d.table_name,
               d.equality_columns || coalesce(', ' || d.inequality_columns, '') AS index_columns, d.included_columns,
               CAST(round(CAST(CAST(s.avg_user_cost AS DOUBLE) * s.avg_user_impact / 100 AS DECIMAL(38, 10)), 2) AS DOUBLE) AS improvement, s.user_seeks,
               'IX_' || d.table_name || '_' || replace(replace(d.equality_columns, '[', ''), ']', '') AS index_name,
               'CREATE INDEX [IX_' || d.table_name || '_' || d.index_handle || '] ON [' || d.schema_name || '].[' || d.table_name || '] ('
                   || d.equality_columns || coalesce(', ' || d.inequality_columns, '') || ')'
                   || coalesce(' INCLUDE (' || d.included_columns || ')', '') || ';' AS create_statement
        FROM missing_index_stats s JOIN missing_index_groups g ON s.group_handle = g.group_handle AND s.server_name = g.server_name
        JOIN missing_index_details d ON d.index_handle = g.index_handle AND d.server_name = g.server_name WHERE s.avg_user_impact > 10 AND s.user_seeks > 50"""),
    ),
    "j09_missing_indexes_top": Entry(
        lambda t: joins.missing_indexes(t.missing_index_details, t.missing_index_groups, t.missing_index_stats, n=10).select(
            "server_name", "index_handle", "improvement", "user_seeks"
        ),
        with_views("""
        SELECT g.server_name, g.index_handle, CAST(round(CAST(CAST(s.avg_user_cost AS DOUBLE) * s.avg_user_impact / 100 AS DECIMAL(38, 10)), 2) AS DOUBLE) AS improvement, s.user_seeks
        FROM missing_index_stats s JOIN missing_index_groups g ON s.group_handle = g.group_handle AND s.server_name = g.server_name
        JOIN missing_index_details d ON d.index_handle = g.index_handle AND d.server_name = g.server_name WHERE s.avg_user_impact > 10 AND s.user_seeks > 50
        ORDER BY improvement DESC, g.server_name, g.index_handle LIMIT 10"""),
    ),
    "j10_unused_index_script": Entry(
        lambda t: joins.unused_index_script(t.index_catalog, AS_OF),
        with_views(f"""
        SELECT server_name, database_name, schema_name, table_name, index_name, used_pages * 8 AS size_kb, user_seeks + user_scans AS total_reads,
               'USE [' || database_name || ']; DROP INDEX [' || index_name || '] ON [' || schema_name || '].[' || table_name || '];' AS drop_statement
        FROM index_catalog WHERE is_primary_key = 0 AND is_unique = 0 AND user_seeks = 0 AND user_scans = 0
          AND last_used < {NOW} - INTERVAL '30' DAY AND used_pages * 8 >= 1000"""),
    ),
    "j11_server_overview": Entry(
        lambda t: joins.server_overview(
            inventory(t), aggregates.backup_status(t.backup_history, AS_OF), t.perf_counters, t.login_audit, AS_OF
        ),
        with_views(f"""WITH {SQL_SERVERS}, {SQL_BACKUP_STATUS},
        b AS (SELECT server_name, CASE min(CASE backup_status WHEN 'NO BACKUP' THEN 0 WHEN 'OVERDUE' THEN 1 WHEN 'WARNING' THEN 2 ELSE 3 END)
                     WHEN 0 THEN 'NO BACKUP' WHEN 1 THEN 'OVERDUE' WHEN 2 THEN 'WARNING' ELSE 'OK' END AS worst_backup_status,
                     max(hours) AS hours_since_backup FROM status GROUP BY 1),
        c AS (SELECT server_name, max(capture_time) AS last_capture FROM perf_counters GROUP BY 1),
        f AS (SELECT server_name, CAST(count(*) AS BIGINT) AS n FROM login_audit WHERE event_type = 'FAILED_LOGIN' AND login_time > {NOW} - INTERVAL '24' HOUR GROUP BY 1)
        SELECT i.server_name, i.environment, i.is_active, b.worst_backup_status, b.hours_since_backup, c.last_capture, coalesce(f.n, 0) AS failed_logins_24h
        FROM inventory i LEFT JOIN b ON i.server_name = b.server_name LEFT JOIN c ON i.server_name = c.server_name LEFT JOIN f ON i.server_name = f.server_name"""),
    ),
    "j11_server_summary": Entry(
        lambda t: joins.server_summary(inventory(t), t.session_requests, t.login_audit, t.database_size_history, t.replica_lag, AS_OF),
        with_views(f"""WITH {SQL_SERVERS},
        c AS (SELECT server_name, count(*) AS n FROM {SQL_SESSIONS_NOW} q GROUP BY 1),
        f AS (SELECT server_name, count(*) AS n FROM login_audit WHERE event_type = 'FAILED_LOGIN' AND login_time >= {NOW} - INTERVAL '24' HOUR GROUP BY 1),
        d AS (SELECT server_name, max(mb) AS n FROM (SELECT server_name, database_name, arg_max(total_mb, capture_time) AS mb FROM database_size_history GROUP BY 1, 2) x GROUP BY 1),
        l AS (SELECT server_name, max(sent_lsn - replay_lsn) AS n FROM replica_lag r
              WHERE capture_time = (SELECT max(capture_time) FROM replica_lag x WHERE x.server_name = r.server_name AND x.ag_name = r.ag_name AND x.replica_name = r.replica_name)
              GROUP BY 1)
        SELECT i.server_name, environment, is_active, CAST(coalesce(c.n, 0) AS BIGINT) AS current_connections, CAST(coalesce(f.n, 0) AS BIGINT) AS failed_logins_24h,
               CAST(coalesce(d.n, 0) AS BIGINT) AS largest_db_mb, CAST(trunc(coalesce(l.n, 0) / 1048576) AS BIGINT) AS max_replication_lag_mb
        FROM inventory i LEFT JOIN c ON c.server_name = i.server_name LEFT JOIN f ON f.server_name = i.server_name
        LEFT JOIN d ON d.server_name = i.server_name LEFT JOIN l ON l.server_name = i.server_name"""),
    ),
    "j13_new_principals": Entry(
        lambda t: joins.new_principals(snapshot(t.principals, 1), snapshot(t.principals, 0), ["server_name", "login_name"]),
        with_views("""
        SELECT c.server_name, c.principal_id, c.login_name, c.login_type, c.is_disabled, 'CREATED' AS action_type FROM principals c WHERE c.snap = 1
          AND NOT EXISTS (SELECT 1 FROM principals p WHERE p.snap = 0 AND p.server_name = c.server_name AND p.login_name = c.login_name)"""),
    ),
    "j13_new_role_members": Entry(
        lambda t: joins.new_principals(
            snapshot(t.role_members, 1), snapshot(t.role_members, 0), ["server_name", "database_name", "role_name", "member_name"], "ADDED"
        ),
        with_views("""
        SELECT server_name, database_name, role_name, member_name, 'ADDED' AS action_type FROM role_members c WHERE c.snap = 1
          AND NOT EXISTS (SELECT 1 FROM role_members p WHERE p.snap = 0 AND p.server_name = c.server_name AND p.database_name = c.database_name
                          AND p.role_name = c.role_name AND p.member_name = c.member_name)"""),
    ),
    "j14_dropped_principals": Entry(
        lambda t: joins.dropped_principals(snapshot(t.principals, 1), snapshot(t.principals, 0), ["server_name", "login_name"]),
        with_views("""
        SELECT server_name, login_name, 'DROPPED' AS action_type FROM principals p WHERE snap = 0
          AND NOT EXISTS (SELECT 1 FROM principals c WHERE c.snap = 1 AND c.server_name = p.server_name AND c.login_name = p.login_name)"""),
    ),
    "j14_removed_role_members": Entry(
        lambda t: joins.dropped_principals(
            snapshot(t.role_members, 1), snapshot(t.role_members, 0), ["server_name", "database_name", "role_name", "member_name"], "REMOVED"
        ),
        with_views("""
        SELECT server_name, database_name, role_name, member_name, 'REMOVED' AS action_type FROM role_members p WHERE p.snap = 0
          AND NOT EXISTS (SELECT 1 FROM role_members c WHERE c.snap = 1 AND p.server_name = c.server_name AND p.database_name = c.database_name
                          AND p.role_name = c.role_name AND p.member_name = c.member_name)"""),
    ),
    "j15_compare_servers": Entry(
        lambda t: joins.compare_servers(snapshot(t.principals, 0), snapshot(t.principals, 1), ["server_name", "login_name", "login_type"]),
        with_views("""WITH a AS (SELECT * FROM principals WHERE snap = 0), b AS (SELECT * FROM principals WHERE snap = 1)
        SELECT server_name, login_name, login_type, 'SOURCE ONLY' AS side FROM a
        WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.server_name = a.server_name AND b.login_name = a.login_name AND b.login_type = a.login_type)
        UNION ALL
        SELECT server_name, login_name, login_type, 'TARGET ONLY' AS side FROM b
        WHERE NOT EXISTS (SELECT 1 FROM a WHERE b.server_name = a.server_name AND b.login_name = a.login_name AND b.login_type = a.login_type)"""),
    ),
    "j16_role_members": Entry(
        lambda t: joins.role_members(t.role_links, t.role_catalog, snapshot(t.principals, 1)),
        with_views("""
        SELECT r.server_name, r.role_name, p.login_name AS member_name, CASE WHEN p.login_type = 'SQL_LOGIN' THEN 'User' ELSE 'Group' END AS member_type,
               'EXEC sp_addsrvrolemember ''' || p.login_name || ''', ''' || r.role_name || ''';' AS assignment_statement
        FROM role_links l JOIN role_catalog r ON l.role_id = r.role_id AND l.server_name = r.server_name
        JOIN principals p ON p.principal_id = l.member_id AND p.server_name = l.server_name AND p.snap = 1"""),
    ),
    "j17_permissions": Entry(
        lambda t: joins.permissions(t.permission_grants, snapshot(t.principals, 1)),
        with_views("""
        SELECT g.server_name, g.grant_id, a.login_name AS grantee_name, b.login_name AS grantor_name, g.permission_name, g.state_desc, 'SERVER' AS object_type
        FROM permission_grants g JOIN principals a ON a.principal_id = g.grantee_id AND a.server_name = g.server_name AND a.snap = 1
        JOIN principals b ON b.principal_id = g.grantor_id AND b.server_name = g.server_name AND b.snap = 1 WHERE g.class_id = 100"""),
    ),
    "j18_failover_pairs": Entry(
        lambda t: joins.failover_pairs(t.replica_lag),
        with_views("""WITH now AS (SELECT * FROM replica_lag r WHERE capture_time = (SELECT max(capture_time) FROM replica_lag x
            WHERE x.ag_name = r.ag_name AND x.replica_name = r.replica_name)),
        p AS (SELECT ag_name, min(replica_name) AS new_primary FROM now WHERE replica_role = 'PRIMARY' GROUP BY 1)
        SELECT p.ag_name, min(n.replica_name) AS old_primary, p.new_primary FROM p JOIN now n ON n.ag_name = p.ag_name
        WHERE n.replica_role = 'SECONDARY' AND n.replica_name <> p.new_primary GROUP BY 1, 3"""),
    ),
    "j19_replication_channels": Entry(
        lambda t: joins.replication_channels(
            t.replication_channel.select("server_name", "channel_name", "source_host"),
            t.replication_channel.select("server_name", "channel_name", "io_state", "last_error", "events_read"),
            t.replication_channel.select("server_name", "channel_name", "sql_state", "seconds_behind", "error_count"),
        ),
        with_views("""SELECT server_name, channel_name, source_host, io_state, last_error, events_read, sql_state, seconds_behind, error_count FROM replication_channel"""),
    ),
    "j20_events_vs_names": Entry(
        lambda t: joins.events_vs_names(wait_events(t), wait_names(t)),
        with_views("""WITH e AS (SELECT server_name, wait_type AS event, CAST(sum(waiting_tasks) AS BIGINT) AS total_waits, CAST(sum(wait_time_ms) AS BIGINT) AS time_waited
            FROM wait_stats_history GROUP BY 1, 2)
        SELECT server_name, event, 'Work' AS wait_class, total_waits, time_waited,
               CAST(round(CAST(CAST(time_waited AS DOUBLE) / total_waits * 10 AS DECIMAL(38, 10)), 2) AS DOUBLE) AS avg_wait_cs, CAST(round(CAST(CAST(time_waited AS DOUBLE) / total_waits / 100 AS DECIMAL(38, 10)), 2) AS DOUBLE) AS avg_wait_ms
        FROM e WHERE total_waits > 100 AND event NOT LIKE 'ASYNC%' ORDER BY time_waited DESC, server_name, event LIMIT 20"""),
    ),
    "j21_column_dictionary": Entry(
        lambda t: joins.column_dictionary(*columns_parts(t)),
        with_views("""
        SELECT server_name, database_name, schema_name, object_name, column_name, column_id,
               CASE WHEN max_length IS NOT NULL THEN data_type || '(' || max_length || ')'
                    WHEN num_precision IS NOT NULL THEN data_type || '(' || num_precision || ',' || num_scale || ')' ELSE data_type END AS type_text,
               CASE data_type WHEN 'varchar' THEN 'text' WHEN 'timestamp' THEN 'time' ELSE 'number' END AS type_family,
               is_nullable, is_primary_key, is_foreign_key, is_identity, default_value FROM column_catalog"""),
    ),
    "j22_low_stock": Entry(
        lambda t: joins.low_stock(stock(t), t.table("part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"))),
        """WITH s AS (SELECT l_partkey AS product_id, CAST(floor(max(l_quantity) / 3) AS BIGINT) AS quantity,
               coalesce(CASE WHEN l_partkey % 3 <> 0 THEN CAST(floor(count(*) / 2) AS BIGINT) END, 10) AS reorder_point FROM lineitem GROUP BY 1)
        SELECT s.product_id, p.p_name AS product_name, s.quantity AS current_stock, s.reorder_point, greatest(s.reorder_point - s.quantity, 0) AS shortage
        FROM s JOIN part p ON p.p_partkey = s.product_id WHERE s.quantity < s.reorder_point""",
    ),
    "j23_orders_to_process": Entry(
        lambda t: joins.orders_to_process(
            open_orders(t), t.table("customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name")), n=25
        ),
        """SELECT o_orderkey AS order_id, c_name AS customer_name, o_totalprice AS total_due, o_orderdate AS order_time,
               CASE WHEN o_orderstatus = 'O' THEN 'Completed' ELSE 'Status Updated' END AS status_change
        FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus IN ('O', 'P') ORDER BY o_orderdate DESC, o_orderkey LIMIT 25""",
    ),
    "j24_employee_activity": Entry(
        lambda t: joins.employee_activity(*people_parts(t), ORDERS_AS_OF),
        """WITH a AS (SELECT l_suppkey, max(o_orderdate) AS last_activity FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
        SELECT s_suppkey AS person_id, s_name AS person_name, CAST(CASE WHEN s_acctbal >= 0 THEN floor(s_acctbal) ELSE 0 END AS BIGINT) AS vacation_hours,
               CAST(CASE WHEN s_nationkey < 12 THEN s_nationkey ELSE 0 END AS BIGINT) AS sick_hours, a.last_activity,
               CASE WHEN a.last_activity > TIMESTAMP '2001-07-31 12:00:00' THEN 'Active' ELSE 'Inactive' END AS activity_status
        FROM supplier LEFT JOIN a ON a.l_suppkey = s_suppkey""",
    ),
    "j25_tempdb_by_session": Entry(
        lambda t: joins.tempdb_by_session(t.session_requests, t.task_space),
        with_views("""
        SELECT s.server_name, s.capture_time, s.session_id, s.login_name, s.host_name, s.query_text, t.allocated_pages, t.deallocated_pages
        FROM session_requests s LEFT JOIN (SELECT server_name, capture_time, session_id, CAST(sum(allocated_pages) AS BIGINT) AS allocated_pages,
                 CAST(sum(deallocated_pages) AS BIGINT) AS deallocated_pages FROM task_space GROUP BY 1, 2, 3) t
          ON t.session_id = s.session_id AND t.server_name = s.server_name AND t.capture_time = s.capture_time"""),
    ),
}
