"""Thresholds, labels, name lists and patterns the verdicts depend on."""

# --- wait categories: (LIKE pattern or exact names, label), first match wins ---
WAIT_CATEGORIES_DIAGNOSTIC = [
    ("PAGEIOLATCH%", "I/O"),
    ("LCK_M%", "LOCKS"),
    ("PAGELATCH%", "LATCH"),
    ("ASYNC%", "NETWORK"),
    ("SOS%", "MEMORY"),
    ("CXPACKET", "PARALLELISM"),
]
WAIT_CATEGORIES_DIAGNOSTIC_DEFAULT = "OTHER"

WAIT_CATEGORIES_HISTORY = [
    ("PAGEIOLATCH%", "I/O"),
    ("LCK_M%", "Lock"),
    ("PAGELATCH%", "Latch"),
    ("ASYNC%", "Network"),
    ("CXPACKET", "Parallelism"),
    (["SOS_SCHEDULER_YIELD", "THREADPOOL"], "CPU"),
]
WAIT_CATEGORIES_HISTORY_DEFAULT = "Other"

WAIT_CATEGORIES_CONTENTION = [
    ("PAGELATCH%", "LATCH"),
    ("PAGEIO%", "IO"),
    (["SOS_SCHEDULER_YIELD", "THREADPOOL"], "CPU"),
]
WAIT_CATEGORIES_CONTENTION_DEFAULT = "OTHER"

# LWLock comes before Lock, otherwise it could never match.
WAIT_CATEGORIES_EVENTS = [
    ("%LWLock%", "LWLock"),
    ("%Lock%", "Lock"),
    ("%Buffer%", "Buffer"),
    ("%WAL%", "WAL"),
    ("%IO%", "IO"),
    (["Activity"], "Idle"),
]
WAIT_CATEGORIES_EVENTS_DEFAULT = "Other"

# --- names left out of wait reports ---
BENIGN_WAITS = [
    "SLEEP_TASK", "BROKER_TASK_STOP", "BROKER_TO_FLUSH", "SQLTRACE_BUFFER_FLUSH",
    "CLR_AUTO_EVENT", "LAZYWRITER_SLEEP", "XE_DISPATCHER_WAIT", "REQUEST_FOR_DEADLOCK_SEARCH",
]
BENIGN_WAITS_HEALTH_CHECK = [
    "CLR_SEMAPHORE", "LAZY_WRITER", "RESOURCE_QUEUE", "SLEEP_TASK", "SLEEP_SYSTEMTASK",
    "SQLTRACE_INCREMENTAL_FLUSH", "SQLTRACE_WAIT_ENTRIES", "WAITFOR", "BROKER_TASK_STOP",
    "BROKER_TO_FLUSH", "BROKER_TRANSMITTER", "CHECKPOINT_QUEUE", "FT_IFTS_SCHEDULER_IDLE_WAIT",
    "FT_IFTSHC_MUTEX", "LOGMGR_QUEUE", "ONDEMAND_TASK_QUEUE",
]
SYSTEM_SCHEMAS = ["information_schema", "performance_schema", "mysql", "sys", "pg_catalog"]
SERVICE_LOGINS = ["sa", "NT AUTHORITY\\SYSTEM", "NT SERVICE\\SQLSERVERAGENT", "NT SERVICE\\SQLTELEMETRY"]
SYSTEM_OWNERS_OBJECTS = ["SYS", "SYSTEM", "CTXSYS", "ORDSYS"]
SYSTEM_OWNERS_HEALTH = ["SYS", "SYSTEM", "OUTLN"]

# --- named waits of the contention capture ---
CONTENTION_WAITS = [
    "PAGELATCH_EX", "PAGELATCH_SH", "PAGELATCH_UP", "PAGELATCH_DT", "PAGELATCH_KP", "PAGELATCH_KW",
    "PAGELATCH_KR", "PAGEIOLATCH_EX", "PAGEIOLATCH_SH", "PAGEIOLATCH_UP", "PAGEIOLATCH_DT",
    "IO_COMPLETION", "ASYNC_IO_COMPLETION", "SOS_SCHEDULER_YIELD", "THREADPOOL",
]

# --- named counters that enter the baseline ---
BASELINE_COUNTERS = [
    "Batch Requests/sec", "Page Life Expectancy", "SQL Compilations/sec",
    "SQL Recompilations/sec", "Page Splits/sec", "Lazy Writes/sec",
]

# --- object types whose validity is checked ---
CHECKED_OBJECT_TYPES = [
    "PACKAGE", "PACKAGE BODY", "PROCEDURE", "FUNCTION", "TRIGGER", "VIEW", "SYNONYM", "MATERIALIZED VIEW",
]

# --- error log ---
LOG_RELEVANT = [
    "%error%", "%failed%", "%deadlock%", "%corrupt%", "%failover%", "%suspect%", "%cannot%", "%could not%",
]
LOG_TYPES = [
    (["%deadlock%"], "Deadlock"),
    (["%error%"], "ERROR"),
    (["%warning%", "%warn%"], "WARNING"),
]
LOG_TYPE_DEFAULT = "INFO"
# (pattern, severity): 20 to 24 all count as 20.
LOG_SEVERITIES = [
    ("(?i)severity 17", 17),
    ("(?i)severity 18", 18),
    ("(?i)severity 19", 19),
    ("(?i)severity 2[0-4]", 20),
    ("(?i)severity 25", 25),
]
LOG_SEVERITY_ERROR = 16
LOG_SEVERITY_DEFAULT = 10
ERROR_PRIORITY = [(">=", 20, "CRITICAL"), (">=", 17, "HIGH"), (">=", 10, "MEDIUM")]
ERROR_PRIORITY_DEFAULT = "LOW"

# --- code tables ---
FILE_TYPES = {0: "Row Data", 1: "Log"}
TRACE_EVENTS = {92: "Autogrowth", 93: "Shrink"}
JOB_STATUS = {0: "Failed", 1: "Succeeded", 2: "Retry", 3: "Canceled", 4: "In Progress"}
BACKUP_TYPES = {"D": "full", "I": "differential", "L": "log"}

# --- threshold ladders per (operator, platform): (comparison, threshold, label) ---
SPACE_BAND = {
    "inclusive": [(">=", 90, "CRITICAL"), (">=", 80, "WARNING")],
    "strict": [(">", 90, "CRITICAL"), (">", 80, "WARNING")],
}
FRAGMENTATION = [(">=", 30, "REBUILD"), (">=", 5, "REORGANIZE")]
INDEX_USAGE = {
    "detail": [("==", 0, "UNUSED - CONSIDER DROP"), ("<", 100, "LOW USAGE")],
    "warehouse": [("==", 0, "UNUSED - DROP CANDIDATE"), ("<", 100, "LOW USAGE")],
    "health": [("==", 0, "UNUSED"), ("<", 10, "LOW USAGE")],
    "maintenance": [("==", 0, "DROP CANDIDATE"), ("<", 10, "LOW USAGE")],
}
INDEX_USAGE_DEFAULT = {"detail": "ACTIVE", "warehouse": "ACTIVE", "health": "ACTIVE", "maintenance": "OK"}
ROW_CHAINING = [(">", 10, "REBUILD NEEDED"), (">", 5, "MONITOR")]
FILE_RISK = [("<", 10, "CRITICAL"), ("<", 20, "WARNING")]
REPLICATION_LAG_BYTES = [(">", 1073741824, "CRITICAL"), (">", 104857600, "WARNING")]
CONTENTION_SEVERITY = [(">", 100, "HIGH"), (">", 10, "MEDIUM")]
CONTENTION_ADVICE = [
    (">", 100, "CRITICAL - Investigate immediately"),
    (">", 10, "WARNING - Monitor closely"),
]
RECOMMENDATION_PRIORITY = [(">=", 50, "HIGH"), (">=", 25, "MEDIUM")]
BACKUP_BAND = {
    "history": [(">", 24, "OVERDUE"), (">", 12, "WARNING")],
    "health": [(">", 24, "OVERDUE")],
    "weekly": [(">", 48, "OVERDUE"), (">", 24, "WARNING")],
}
EXHAUSTION_BAND = [("<=", 7, "CRITICAL"), ("<=", 30, "WARNING"), ("<=", 60, "MONITOR")]
GROWTH_CONFIDENCE = [(">=", 30, "HIGH"), (">=", 14, "MEDIUM")]
GROWTH_BAND = [(">", 1024, "CRITICAL"), (">", 512, "WARNING"), (">", 100, "MONITOR")]
CONNECTION_BAND = [(">", 90, "CRITICAL"), (">", 75, "WARNING")]
VARIANCE_SEVERITY = [(">", 50, "CRITICAL"), (">", 25, "WARNING")]

# --- alert definitions: name, type, threshold, message ---
ALERTS = [
    ("Long Running Query", "QUERY", 300, "Query running longer than {0} seconds"),
    ("Blocking Chain", "BLOCKING", 5, "Blocking chain of {0} sessions detected"),
    ("Failed Logins", "SECURITY", 5, "{0} failed login attempts in last hour"),
    ("Database Full Backup Overdue", "BACKUP", 24, "{0} hours since last full backup"),
    ("Log Backup Overdue", "BACKUP", 2, "{0} hours since last log backup"),
    ("High Wait Time", "PERFORMANCE", 1000, "Wait type {0} exceeds {1}ms"),
    ("Error Log Error", "ERRORLOG", 1, "Errors found in SQL error log"),
    ("Disk Space Low", "DISK", 90, "Disk {0} is {1}% full"),
    ("TempDB Contention", "PERFORMANCE", 100, "TempDB PFS/GAM contention detected"),
    ("Job Failed", "JOB", 1, "Job {0} failed"),
]

# --- recommended settings ---
RECOMMENDED_SETTINGS = [
    ("shared_buffers", "4GB"),
    ("work_mem", "64MB"),
    ("maintenance_work_mem", "1GB"),
    ("effective_cache_size", "12GB"),
    ("temp_buffers", "16MB"),
    ("max_wal_size", "1GB"),
    ("min_wal_size", "80MB"),
    ("checkpoint_completion_target", "0.9"),
    ("random_page_cost", "1.1"),
    ("effective_io_concurrency", "200"),
    ("max_connections", "300"),
    ("max_connect_errors", "100000"),
    ("wait_timeout", "600"),
    ("interactive_timeout", "600"),
    ("tmp_table_size", "256M"),
    ("max_heap_table_size", "256M"),
    ("long_query_time", "2"),
    ("innodb_io_capacity", "2000"),
    ("innodb_io_capacity_max", "4000"),
    ("innodb_read_io_threads", "8"),
    ("innodb_write_io_threads", "8"),
    ("table_open_cache", "4000"),
    ("table_definition_cache", "2000"),
]

# --- status variables read by the storage-engine report ---
STATUS_VARIABLES = [
    "Innodb_buffer_pool_pages_total", "Innodb_buffer_pool_pages_free", "Innodb_buffer_pool_pages_dirty",
    "Innodb_buffer_pool_read_requests", "Innodb_buffer_pool_reads", "Innodb_row_lock_waits",
    "Innodb_row_lock_time", "Innodb_deadlocks", "Innodb_log_waits", "Threads_connected",
    "Threads_running", "Aborted_connects", "Connections",
]
