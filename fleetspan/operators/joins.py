"""Operators whose core is a join. Small sides are left to the size-checked broadcast threshold."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetspan.functions.expr import at, before, first_match, ordered_names, ratio, seconds_between, total, truncated_div, type_text
from fleetspan.operators.grouping import join_groups, latest_snapshot
from fleetspan.operators.rows import status_band
from fleetspan.session import ensure_checkpoint_dir


SNAPSHOT = ["server_name", "capture_time"]


def blocking_pairs(sessions: DataFrame, min_wait_ms: int = 0, how: str = "inner", text_len: int = 100) -> DataFrame:
    """Blocked sessions with their blocker. ``left`` keeps rows whose blocker is gone.

    A session id means something only on its server at one capture, so every blocked row meets at
    most one blocker row; a blocker that holds up a large share of the sessions is split by the
    adaptive skew join.
    """
    w = sessions.where((F.col("blocking_session_id") > 0) & (F.col("wait_time_ms") >= min_wait_ms)).select(
        *SNAPSHOT,
        F.col("session_id").alias("blocked_session"),
        F.col("blocking_session_id").alias("blocking_session"),
        F.col("login_name").alias("blocked_login"),
        F.col("status").alias("blocked_status"),
        F.col("program_name").alias("blocked_program"),
        "wait_type",
        "wait_time_ms",
        F.substring("query_text", 1, text_len).alias("blocked_query"),
    )
    b = sessions.select(
        *SNAPSHOT,
        F.col("session_id").alias("blocking_session"),
        F.col("login_name").alias("blocker_login"),
        F.col("status").alias("blocker_status"),
        F.col("program_name").alias("blocker_program"),
        F.substring("query_text", 1, text_len).alias("blocker_query"),
    )
    return w.join(b, [*SNAPSHOT, "blocking_session"], how)


LOCK_RESOURCE = [
    *SNAPSHOT, "locktype", "database_id", "relation_id", "page_id", "tuple_id", "virtualxid", "transactionid", "classid", "objid", "objsubid",
]


def _per_resource(locks: DataFrame, resource: list[str]) -> DataFrame:
    """One row per lock resource; its key columns carry an ``r_`` prefix for the join back."""
    return locks.groupBy(*[F.col(c).alias(f"r_{c}") for c in resource]).agg(
        F.count("*").alias("lock_rows"),
        F.count(F.when(F.col("granted") == 0, 1)).alias("waiters"),
        F.min("pid").alias("min_pid"),
        F.max("pid").alias("max_pid"),
    )


def _same_resource(resource: list[str]):
    """Null-safe equality of every key column (planned as a hash join, not a nested loop)."""
    condition = F.lit(True)
    for c in resource:
        condition = condition & F.col(c).eqNullSafe(F.col(f"r_{c}"))
    return condition


def lock_queue(locks: DataFrame, resource: list[str] = LOCK_RESOURCE) -> DataFrame:
    """Every lock on a contended resource, with the size of the queue it stands in.

    Two locks meet exactly when they carry the same (null-safe) resource columns, so
    this listing holds all waiter/holder pairs in one row per lock instead of one per pair.
    """
    contended = _per_resource(locks, resource).where((F.col("waiters") > 0) & (F.col("min_pid") != F.col("max_pid")))
    return locks.join(contended, _same_resource(resource)).select(
        *resource, "pid", "granted", "lock_rows", "waiters", "min_pid", "max_pid"
    )


def lock_waits(locks: DataFrame, sessions: DataFrame, as_of: datetime, resource: list[str] = LOCK_RESOURCE) -> DataFrame:
    """Each waiting lock request with the number of other requests on its resource and one of them.

    The sample blocker is the lowest other process id, or the highest one where the waiter is the lowest.
    """
    own = locks.groupBy(*resource, "pid").agg(F.count("*").alias("own_rows"), F.min("granted").alias("granted_min"))
    waiting = own.where(F.col("granted_min") == 0)
    matched = (
        waiting.join(_per_resource(locks, resource), _same_resource(resource))
        .where(F.col("min_pid") != F.col("max_pid"))
        .select(
            *resource,
            F.col("pid").alias("blocked_pid"),
            (F.col("lock_rows") - F.col("own_rows")).alias("blockers"),
            F.when(F.col("min_pid") != F.col("pid"), F.col("min_pid")).otherwise(F.col("max_pid")).alias("blocking_pid"),
        )
    )
    blocked = sessions.select(
        *SNAPSHOT,
        F.col("session_id").alias("blocked_pid"),
        F.col("login_name").alias("blocked_user"),
        F.col("query_text").alias("blocked_query"),
        F.col("query_start").alias("blocked_since"),
    )
    blocking = sessions.select(
        *SNAPSHOT,
        F.col("session_id").alias("blocking_pid"),
        F.col("login_name").alias("blocking_user"),
        F.col("query_text").alias("blocking_query"),
    )
    return (
        matched.join(blocked, [*SNAPSHOT, "blocked_pid"])
        .join(blocking, [*SNAPSHOT, "blocking_pid"])
        .withColumn("wait_s", seconds_between(F.col("blocked_since"), at(as_of)))
    )


def _resolve_roots(edges: DataFrame) -> DataFrame:
    """(server, capture, session_id, root, hops, low, resolved) for edges (..., session_id, blocker) by pointer doubling.

    ``low`` is the smallest blocked session of the way covered, the start included.

    A round joins every unresolved pointer with the pointer of its target, which
    doubles the distance covered: a chain of n sessions takes log2(n) rounds. Only the rows that
    moved are written again. Rows still unresolved once the distance exceeds the number of edges
    lead into a cycle.
    """
    known = edges.select(*SNAPSHOT, F.col("session_id").alias("blocker"), F.lit(True).alias("target_blocked"))
    pointers = (
        edges.join(known, [*SNAPSHOT, "blocker"], "left")
        .select(
            *SNAPSHOT,
            "session_id",
            F.col("blocker").alias("root"),
            F.lit(1).cast("bigint").alias("hops"),
            F.col("session_id").alias("low"),
            F.col("target_blocked").isNull().alias("resolved"),
        )
        .checkpoint()
    )
    limit = pointers.count()
    done, open_ = pointers.where("resolved"), pointers.where(~F.col("resolved"))
    reach = 1
    while reach <= limit and not open_.isEmpty():
        nxt = done.unionByName(open_).select(
            *SNAPSHOT,
            F.col("session_id").alias("root"),
            F.col("root").alias("next_root"),
            F.col("hops").alias("next_hops"),
            F.col("low").alias("next_low"),
            F.col("resolved").alias("next_resolved"),
        )
        moved = (
            open_.join(nxt, [*SNAPSHOT, "root"])
            .select(
                *SNAPSHOT,
                "session_id",
                F.col("next_root").alias("root"),
                (F.col("hops") + F.col("next_hops")).alias("hops"),
                F.least("low", "next_low").alias("low"),
                F.col("next_resolved").alias("resolved"),
            )
            .checkpoint()
        )
        done, open_ = done.unionByName(moved.where("resolved")), moved.where(~F.col("resolved"))
        reach *= 2
    return done.unionByName(open_)


def _edges(sessions: DataFrame) -> DataFrame:
    return sessions.where(F.col("blocking_session_id") > 0).select(
        *SNAPSHOT, "session_id", F.col("blocking_session_id").alias("blocker")
    )


def blocking_chains(sessions: DataFrame) -> DataFrame:
    """One row per blocked session: head of its chain and hops to it.

    Sessions that block each other in a circle have no head: ``chain_state`` is CYCLE.
    """
    ensure_checkpoint_dir(sessions.sparkSession)
    roots = _resolve_roots(_edges(sessions))
    info = sessions.select(
        *SNAPSHOT, "session_id", F.col("blocking_session_id").alias("blocked_by"), "login_name", "status", "wait_type", "wait_time_ms",
        F.substring("query_text", 1, 150).alias("current_query"),
    )
    return roots.join(info, [*SNAPSHOT, "session_id"]).select(
        *SNAPSHOT,
        F.when(F.col("resolved"), F.col("root")).alias("root_blocker"),
        "session_id",
        "blocked_by",
        F.when(F.col("resolved"), F.col("hops")).alias("level"),
        F.when(F.col("resolved"), "CHAIN").otherwise("CYCLE").alias("chain_state"),
        "login_name",
        "status",
        "wait_type",
        "wait_time_ms",
        "current_query",
    )


def blocking_walk(sessions: DataFrame, origins: DataFrame) -> DataFrame:
    """For each chosen session, every blocked session on the way to the head, level by level.

    ``origins``: server_name, capture_time, session_id of the sessions to explain. Level 0 is the
    session itself. The walk is extended by jumps of 1, 2, 4, ... hops until it finds nothing new; a
    walk that runs into a circle lists each session of it once and has no head.
    """
    ensure_checkpoint_dir(sessions.sparkSession)
    edges = _edges(sessions).checkpoint()
    at_start = [*SNAPSHOT, "origin"]
    walk = (
        edges.join(origins.select(*SNAPSHOT, "session_id").distinct(), [*SNAPSHOT, "session_id"], "left_semi")
        .select(*SNAPSHOT, F.col("session_id").alias("origin"), "session_id", F.lit(0).cast("bigint").alias("level"))
        .checkpoint()
    )
    still_blocked = edges.select(*SNAPSHOT, F.col("session_id").alias("blocker"))
    jumps = edges.join(still_blocked, [*SNAPSHOT, "blocker"], "left_semi").select(*SNAPSHOT, "session_id", F.col("blocker").alias("target"))
    distance, found = 1, walk.count()
    while found:
        further = walk.join(jumps, [*SNAPSHOT, "session_id"]).select(
            *at_start, F.col("target").alias("session_id"), (F.col("level") + distance).alias("level")
        )
        walk = walk.unionByName(further).groupBy(*at_start, "session_id").agg(F.min("level").alias("level")).checkpoint()
        before_, found = found, walk.count()
        if found == before_:
            break
        nxt = jumps.select(*SNAPSHOT, F.col("session_id").alias("target"), F.col("target").alias("next_target"))
        jumps = jumps.join(nxt, [*SNAPSHOT, "target"]).select(*SNAPSHOT, "session_id", F.col("next_target").alias("target")).checkpoint()
        distance *= 2
    steps = walk.join(edges.withColumnRenamed("blocker", "blocked_by"), [*SNAPSHOT, "session_id"])
    heads = steps.join(still_blocked.withColumnRenamed("blocker", "blocked_by"), [*SNAPSHOT, "blocked_by"], "left_anti").select(
        *at_start, F.col("blocked_by").alias("root_blocker")
    )
    return steps.join(heads, at_start, "left").select(*SNAPSHOT, "root_blocker", "origin", "session_id", "blocked_by", "level")


def _with_paths(edges: DataFrame) -> DataFrame:
    """``edges`` of a forest with path: the sessions from the one before the head down to session_id, and the head.

    Path segments are composed by doubling, so a chain of n sessions takes log2(n) joins. All paths
    together are as long as the sum of all levels, which is the size of the result.
    """
    blocked = edges.select(*SNAPSHOT, F.col("session_id").alias("blocker"), F.lit(True).alias("further"))
    ways = edges.join(blocked, [*SNAPSHOT, "blocker"], "left").select(
        *SNAPSHOT, "session_id", F.col("blocker").alias("head"), F.array("session_id").alias("path"), F.col("further").isNull().alias("resolved")
    ).checkpoint()
    done, open_ = ways.where("resolved"), ways.where("NOT resolved")
    while not open_.isEmpty():
        nxt = done.unionByName(open_).select(
            *SNAPSHOT, F.col("session_id").alias("head"), F.col("head").alias("next_head"), F.col("path").alias("above"), F.col("resolved").alias("next_resolved")
        )
        moved = open_.join(nxt, [*SNAPSHOT, "head"]).select(
            *SNAPSHOT, "session_id", F.col("next_head").alias("head"), F.concat("above", "path").alias("path"), F.col("next_resolved").alias("resolved")
        ).checkpoint()
        done, open_ = done.unionByName(moved.where("resolved")), moved.where("NOT resolved")
    return done


def blocking_paths(sessions: DataFrame) -> DataFrame:
    """One row per blocked session with the way from the head of its chain, and the circle it hangs on if there is no head.

    ``path`` reads from the head to the session, ``chain`` is the indented session number of a listing. A circle
    has no head: it is named by its smallest member (``cycle_id``), which the listing starts with, at level
    0, so that every deadlock is one group; ``in_cycle`` tells its members from those that wait for them.
    """
    ensure_checkpoint_dir(sessions.sparkSession)
    edges = _edges(sessions).checkpoint()
    roots = _resolve_roots(edges)
    # After as many hops as there are edges, an unresolved pointer stands on its circle, and every member is pointed at.
    circling = roots.where("NOT resolved").checkpoint()
    members = circling.select(*SNAPSHOT, F.col("root").alias("session_id")).distinct()
    named = circling.join(members, [*SNAPSHOT, "session_id"], "left_semi").select(
        *SNAPSHOT, F.col("session_id").alias("root"), F.col("low").alias("cycle_id")
    )
    cycles = circling.join(named, [*SNAPSHOT, "root"]).select(*SNAPSHOT, "session_id", "cycle_id").join(
        members.withColumn("in_cycle", F.lit(True)), [*SNAPSHOT, "session_id"], "left"
    ).checkpoint()
    # Without the edge out of its smallest member a circle is a chain that starts there.
    first = cycles.where("session_id = cycle_id").select(*SNAPSHOT, "session_id")
    forest = edges.join(first, [*SNAPSHOT, "session_id"], "left_anti")
    ways = _with_paths(forest).unionByName(
        first.select(*SNAPSHOT, "session_id", F.col("session_id").alias("head"), F.array().cast("array<bigint>").alias("path"), F.lit(True).alias("resolved"))
    )
    out = edges.withColumnRenamed("blocker", "blocked_by").join(ways.drop("resolved"), [*SNAPSHOT, "session_id"]).join(cycles, [*SNAPSHOT, "session_id"], "left")
    level = F.size("path").cast("bigint")
    return out.select(
        *SNAPSHOT,
        "session_id",
        "blocked_by",
        F.when(F.col("cycle_id").isNull(), F.col("head")).alias("root_blocker"),
        "cycle_id",
        F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"),
        level.alias("level"),
        F.array_join(F.concat(F.array("head"), "path").cast("array<string>"), " > ").alias("path"),
        F.concat(F.repeat(F.lit("  "), level.cast("int")), F.col("session_id").cast("string")).alias("chain"),
    )


def session_sql(sessions: DataFrame, statements: DataFrame, n: int = 20, text_len: int = 100) -> DataFrame:
    """Per server and capture the ``n`` longest-waiting sessions with their statement text.

    The top rows are taken before the join: the statement id is unique on its server, so the join cannot change them.
    """
    order = W.partitionBy(*SNAPSHOT).orderBy(F.desc("wait_time_ms"), "session_id")
    top = sessions.withColumn("wait_rank", F.row_number().over(order)).where(F.col("wait_rank") <= n)
    texts = statements.select("server_name", "sql_id", F.substring("sql_text", 1, text_len).alias("sql_text"))
    return top.select(*SNAPSHOT, "session_id", "login_name", "program_name", "status", "wait_time_ms", "sql_id", "wait_rank").join(
        texts, ["server_name", "sql_id"], "left"
    )


TABLESPACE = ["server_name", "tablespace_name"]


def space_usage(files: DataFrame, free: DataFrame, platform: str = "inclusive") -> DataFrame:
    """Allocated, used and free MB per server and tablespace with a verdict; both sides are summed before the join."""
    allocated = files.groupBy(*TABLESPACE).agg(total(F.col("size_mb")).alias("total_mb"))
    spare = free.groupBy(*TABLESPACE).agg(total(F.col("free_mb")).alias("free_mb"))
    joined = allocated.join(spare, TABLESPACE, "left").withColumn(
        "free_mb", F.coalesce("free_mb", F.lit(0).cast("bigint"))
    )
    used = F.col("total_mb") - F.col("free_mb")
    raw = used.cast("double") / F.nullif(F.col("total_mb"), F.lit(0)) * 100
    return joined.select(
        *TABLESPACE,
        "total_mb",
        used.alias("used_mb"),
        "free_mb",
        F.round(raw, 2).alias("used_pct"),
        status_band(raw, platform).alias("alert_status"),
    )


def temp_usage(temp_files: DataFrame, used_segments: DataFrame) -> DataFrame:
    """Allocated against used temporary space; no segment means nothing used."""
    allocated = temp_files.groupBy(*TABLESPACE).agg(total(F.col("size_mb")).alias("allocated_mb"))
    taken = used_segments.groupBy(*TABLESPACE).agg(total(F.col("used_mb")).alias("used_mb"))
    used = F.coalesce("used_mb", F.lit(0).cast("bigint"))
    return allocated.join(taken, TABLESPACE, "left").select(
        *TABLESPACE,
        "allocated_mb",
        used.alias("used_mb"),
        (F.col("allocated_mb") - used).alias("free_mb"),
        ratio(used, F.col("allocated_mb"), 100).alias("used_pct"),
    )


def undo_usage(files: DataFrame, tablespaces: DataFrame, used_segments: DataFrame) -> DataFrame:
    """Undo space used and whether retention stays below its target."""
    sized = files.groupBy(*TABLESPACE).agg(total(F.col("size_mb")).alias("total_mb"))
    taken = used_segments.groupBy(*TABLESPACE).agg(total(F.col("used_mb")).alias("used_mb"))
    used = F.coalesce("used_mb", F.lit(0).cast("bigint"))
    return (
        sized.join(tablespaces.where(F.col("contents") == "UNDO"), TABLESPACE)
        .join(taken, TABLESPACE, "left")
        .select(
            *TABLESPACE,
            "total_mb",
            used.alias("used_mb"),
            ratio(used, F.col("total_mb"), 100).alias("used_pct"),
            "undo_retention",
            "tuned_retention",
            F.when(F.col("tuned_retention") < F.col("undo_retention"), "BELOW TARGET").otherwise("OK").alias("retention_status"),
        )
    )


TABLE = ["server_name", "database_name", "schema_name", "table_name"]


def _verdict(drop_label: str):
    return first_match(
        [(F.col("is_primary_key") == 1, "Keep Index2 (PK)"), (F.col("is_unique") == 1, "Keep Index2 (Unique)")], drop_label
    )


def _sized(indexes: DataFrame) -> DataFrame:
    return indexes.select(
        *TABLE, "index_id", "index_name", "is_unique", "is_primary_key", (F.col("used_pages") * 8).alias("size_kb")
    )


def _redundant(members: DataFrame, group: list[str], drop_label: str) -> DataFrame:
    """Pair each member of a group with the group's first non-key index.

    A group of n alike indexes has n(n-1)/2 pairs but only n-1 redundant members:
    one row each, naming the index that stays and the size of the group. The aggregate holds numbers
    only; the name of the index that stays is joined afterwards.
    """
    plain = (F.col("is_primary_key") == 0) & (F.col("is_unique") == 0)
    first = members.groupBy(*group).agg(F.min(F.when(plain, F.col("index_id"))).alias("first_id"), F.count("*").alias("group_size"))
    first = first.where(F.col("first_id").isNotNull() & (F.col("group_size") > 1))
    found = join_groups(members, first, group).where(F.col("index_id") > F.col("first_id"))
    return found.withColumns({"recommendation": _verdict(drop_label)}).withColumnsRenamed(
        {"index_name": "index2_name", "size_kb": "index2_size_kb"}
    )


def _named(found: DataFrame, sized: DataFrame) -> DataFrame:
    """Name and size of the index that stays (``first_id``)."""
    stays = sized.select(
        *TABLE, F.col("index_id").alias("first_id"), F.col("index_name").alias("index1_name"), F.col("size_kb").alias("index1_size_kb")
    )
    return found.join(stays, [*TABLE, "first_id"])


def duplicate_index_columns(index_columns: DataFrame, indexes: DataFrame) -> DataFrame:
    """Indexes that share a column at the same position with an earlier index of the table."""
    sized = _sized(indexes)
    members = index_columns.join(sized, [*TABLE, "index_id"])
    found = _named(_redundant(members, [*TABLE, "key_ordinal", "column_name"], "Consider Dropping"), sized)
    return found.select(
        *TABLE, "key_ordinal", "column_name", "index1_name", "index2_name", "index1_size_kb", "index2_size_kb",
        "group_size", "recommendation",
    )


def shared_columns(first, second):
    """Names both lists hold, in the order of the first, as text."""
    return F.array_join(F.array_intersect(first, second), ", ")


def key_lists(index_columns: DataFrame, indexes: DataFrame) -> DataFrame:
    """Each index with its ordered key columns (a handful per index, so the list is bounded)."""
    lists = index_columns.groupBy(*TABLE, "index_id").agg(
        ordered_names(F.col("key_ordinal"), F.col("column_name")).alias("key_columns")
    )
    return lists.join(_sized(indexes), [*TABLE, "index_id"])


def duplicate_indexes(index_columns: DataFrame, indexes: DataFrame, min_kb: int = 100) -> DataFrame:
    """Redundant indexes: the same key list as an earlier index, or a left prefix of a wider one.

    Every index contributes each prefix of its key list once. One aggregate per
    (table, list) then knows the first index with exactly that list and the first
    wider index starting with it, and one join back finds both kinds of redundancy:
    a row per redundant index and kind, never a row per pair. The aggregate holds numbers only;
    names and lists of the indexes that stay are joined afterwards.
    """
    keyed = key_lists(index_columns, indexes)
    plain = (F.col("is_primary_key") == 0) & (F.col("is_unique") == 0)
    prefixes = F.transform(F.sequence(F.lit(1), F.size("key_columns")), lambda n: F.slice("key_columns", F.lit(1), n))
    whole = F.size("prefix") == F.size("key_columns")
    groups = (
        keyed.select("*", F.explode(prefixes).alias("prefix"))
        .groupBy(*TABLE, "prefix")
        .agg(
            F.min(F.when(whole & plain, F.col("index_id"))).alias("exact_id"),
            F.count(F.when(whole, 1)).alias("alike"),
            F.min(F.when(~whole & plain, F.col("index_id"))).alias("wide_id"),
            F.count(F.when(~whole & plain, 1)).alias("covering"),
        )
        .where((F.col("alike") > 1) | ((F.col("alike") > 0) & (F.col("covering") > 0)))
        .withColumnRenamed("prefix", "key_columns")
    )

    def match(kind: str, first_id: str, size, hit):
        return F.when(hit, F.struct(F.lit(kind).alias("match_kind"), F.col(first_id).alias("first_id"), size.alias("group_size")))

    found = F.array_compact(
        F.array(
            match("EXACT", "exact_id", F.col("alike"), F.col("index_id") > F.col("exact_id")),
            match("LEFT PREFIX", "wide_id", F.col("covering") + 1, F.col("wide_id").isNotNull()),
        )
    )
    redundant = join_groups(keyed.where(F.col("size_kb") >= min_kb), groups, [*TABLE, "key_columns"]).select(
        *TABLE,
        F.col("index_name").alias("index2_name"),
        F.col("size_kb").alias("index2_size_kb"),
        "key_columns",
        _verdict("DROP Index2").alias("recommendation"),
        F.inline(found),
    )
    stays = keyed.select(
        *TABLE, F.col("index_id").alias("first_id"), F.col("index_name").alias("index1_name"),
        F.col("size_kb").alias("index1_size_kb"), F.col("key_columns").alias("index1_list"),
    )
    return redundant.join(stays, [*TABLE, "first_id"]).select(
        *TABLE,
        "match_kind",
        "index1_name",
        "index2_name",
        F.array_join("index1_list", ", ").alias("index1_columns"),
        F.array_join("key_columns", ", ").alias("index2_columns"),
        shared_columns(F.col("index1_list"), F.col("key_columns")).alias("shared_columns"),
        "index1_size_kb",
        "index2_size_kb",
        F.col("index2_size_kb").alias("savings_kb"),
        "group_size",
        "recommendation",
    )


def column_sets(index_columns: DataFrame, indexes: DataFrame) -> DataFrame:
    """Each index with its columns as a set, the first index of the table that has the same set, and how many have it."""
    keyed = key_lists(index_columns, indexes).withColumn("column_set", F.array_sort(F.array_distinct("key_columns")))
    group = [*TABLE, "column_set"]
    classes = keyed.groupBy(*group).agg(F.min("index_id").alias("set_id"), F.count("*").alias("set_size"), total(F.col("size_kb")).alias("set_kb"))
    return join_groups(keyed, classes, group).select(
        *TABLE, "index_id", "index_name", "is_unique", "is_primary_key", "size_kb", F.array_join("key_columns", ", ").alias("key_columns"), "column_set",
        "set_id", "set_size", "set_kb",
    )


def overlapping_indexes(index_columns: DataFrame, indexes: DataFrame, percent: int = 50) -> DataFrame:
    """Pairs of different column sets of a table that share at least ``percent`` of the columns of both together.

    Indexes with the same columns in any order are one set, represented by the first (``column_sets`` lists the
    members), so copies make no pairs. A pair that shares enough has a common column among the rarest
    |set| - ceil(percent * |set|) + 1 of either set, so sets meet on those only: a column that every
    index has brings nobody together unless it is all they have. Sizes too far apart are ruled out before the columns
    are compared.
    """
    ensure_checkpoint_dir(index_columns.sparkSession)
    sets = column_sets(index_columns, indexes).where("index_id = set_id").select(*TABLE, "set_id", "index_name", "column_set", "set_size", "set_kb").checkpoint()
    tokens = sets.select(*TABLE, "set_id", "column_set").distinct().select(*TABLE, "set_id", F.explode("column_set").alias("column_name"))
    column = [*TABLE, "column_name"]
    ranked = join_groups(tokens, tokens.groupBy(*column).agg(F.count("*").alias("used")), column)
    # The columns of one index are few, so the list is bounded.
    listed = ranked.groupBy(*TABLE, "set_id").agg(F.array_sort(F.collect_list(F.struct("used", "column_name"))).alias("rare_first"))
    length = F.size("rare_first")
    kept = length - F.ceil(length * percent / 100).cast("int") + 1
    rare = listed.select(*TABLE, "set_id", F.slice("rare_first", F.lit(1), kept)["column_name"].alias("rare"))
    # Each side of a pair brings all that the result and the tests below need, so pairs are not joined again.
    rare = sets.join(rare, [*TABLE, "set_id"]).checkpoint()
    side = lambda n: rare.select(
        *TABLE, F.explode("rare").alias("column_name"), F.col("set_id").alias(f"set{n}_id"), F.col("column_set").alias(f"set{n}"), F.col("rare").alias(f"rare{n}"),
        F.col("index_name").alias(f"index{n}_name"), F.col("set_size").alias(f"set{n}_indexes"), F.col("set_kb").alias(f"set{n}_kb"),
    )
    small, large = F.least(F.size("set1"), F.size("set2")), F.greatest(F.size("set1"), F.size("set2"))
    shared = F.array_intersect("set1", "set2")
    both = F.size("set1") + F.size("set2") - F.size(shared)
    # A pair meets on each rare column it shares; it counts on the first of them by name.
    first = F.col("column_name") == F.array_min(F.array_intersect("rare1", "rare2"))
    pairs = side(1).join(side(2), column).where(
        (F.col("set1_id") < F.col("set2_id")) & (small * 100 >= large * percent) & first & (F.size(shared) * 100 >= both * percent)
    )
    return pairs.select(
        *TABLE,
        "index1_name",
        "index2_name",
        F.array_join("set1", ", ").alias("columns1"),
        F.array_join("set2", ", ").alias("columns2"),
        F.array_join(shared, ", ").alias("shared_columns"),
        ratio(F.size(shared), both, 100).alias("overlap_pct"),
        "set1_indexes",
        "set2_indexes",
        "set1_kb",
        "set2_kb",
    )


def missing_indexes(
    details: DataFrame, groups: DataFrame, stats: DataFrame, min_impact: int = 10, min_seeks: int = 50, n: int | None = None
) -> DataFrame:
    """Index candidates with expected improvement, name and statement, best first when cut to n. Handles count within a server."""
    bare = lambda c: F.regexp_replace(c, r"[\[\]]", "")
    extra = F.coalesce(F.concat(F.lit(", "), F.col("inequality_columns")), F.lit(""))
    include = F.coalesce(F.concat(F.lit(" INCLUDE ("), F.col("included_columns"), F.lit(")")), F.lit(""))
    useful = stats.where((F.col("avg_user_impact") > min_impact) & (F.col("user_seeks") > min_seeks))
    found = (
        useful.join(groups, ["server_name", "group_handle"])
        .join(details, ["server_name", "index_handle"])
        .select(
            "server_name",
            "index_handle",
            "database_name",
            "schema_name",
            "table_name",
            F.concat(F.col("equality_columns"), extra).alias("index_columns"),
            "included_columns",
            F.round(F.col("avg_user_cost").cast("double") * F.col("avg_user_impact") / 100, 2).alias("improvement"),
            "user_seeks",
            F.concat(F.lit("IX_"), F.col("table_name"), F.lit("_"), bare(F.col("equality_columns"))).alias("index_name"),
            F.concat(
                F.lit("CREATE INDEX [IX_"), F.col("table_name"), F.lit("_"), F.col("index_handle").cast("string"), F.lit("] ON ["),
                F.col("schema_name"), F.lit("].["), F.col("table_name"), F.lit("] ("), F.col("equality_columns"), extra, F.lit(")"),
                include, F.lit(";"),
            ).alias("create_statement"),
        )
    )
    return found if n is None else found.orderBy(F.desc("improvement"), "server_name", "index_handle").limit(n)


def unused_index_script(indexes: DataFrame, as_of: datetime, days: int = 30, min_kb: int = 1000) -> DataFrame:
    """Non-key indexes nobody read and last used before the cutoff, with a drop statement."""
    size_kb = F.col("used_pages") * 8
    return indexes.where(
        (F.col("is_primary_key") == 0)
        & (F.col("is_unique") == 0)
        & F.col("index_name").isNotNull()
        & (F.col("user_seeks") == 0)
        & (F.col("user_scans") == 0)
        & (F.col("last_used") < before(as_of, days=days))
        & (size_kb >= min_kb)
    ).select(
        *TABLE,
        "index_name",
        size_kb.alias("size_kb"),
        (F.col("user_seeks") + F.col("user_scans")).alias("total_reads"),
        F.concat(
            F.lit("USE ["), F.col("database_name"), F.lit("]; DROP INDEX ["), F.col("index_name"), F.lit("] ON ["),
            F.col("schema_name"), F.lit("].["), F.col("table_name"), F.lit("];"),
        ).alias("drop_statement"),
    )


def _worst(label, order: list[str]):
    """Most severe label of a group, by rank instead of alphabet."""
    rank = F.lit(len(order))
    for i, name in reversed(list(enumerate(order))):
        rank = F.when(label == name, i).otherwise(rank)
    return F.min_by(label, rank)


def server_overview(
    inventory: DataFrame, backup_status: DataFrame, counters: DataFrame, audit: DataFrame, as_of: datetime
) -> DataFrame:
    """One row per server; every input is reduced to one row per server before it is joined."""
    backups = backup_status.groupBy("server_name").agg(
        _worst(F.col("backup_status"), ["NO BACKUP", "OVERDUE", "WARNING", "OK"]).alias("worst_backup_status"),
        F.max("hours_since_backup").alias("hours_since_backup"),
    )
    captures = counters.groupBy("server_name").agg(F.max("capture_time").alias("last_capture"))
    failures = (
        audit.where((F.col("event_type") == "FAILED_LOGIN") & (F.col("login_time") > before(as_of, hours=24)))
        .groupBy("server_name")
        .agg(F.count("*").alias("failed_logins_24h"))
    )
    return (
        inventory.join(backups, "server_name", "left")
        .join(captures, "server_name", "left")
        .join(failures, "server_name", "left")
        .withColumn("failed_logins_24h", F.coalesce("failed_logins_24h", F.lit(0).cast("bigint")))
    )


def server_summary(
    inventory: DataFrame, sessions: DataFrame, audit: DataFrame, sizes: DataFrame, replicas: DataFrame, as_of: datetime
) -> DataFrame:
    """Variant with each server's own figures: connections at its newest capture, failed logins of the day, largest
    database at its newest size, and the largest lag among the newest rows of its replicas; missing values are 0."""
    connections = latest_snapshot(sessions, ["server_name"]).groupBy("server_name").agg(F.count("*").alias("current_connections"))
    failures = (
        audit.where((F.col("event_type") == "FAILED_LOGIN") & (F.col("login_time") >= before(as_of, hours=24)))
        .groupBy("server_name")
        .agg(F.count("*").alias("failed_logins_24h"))
    )
    largest = latest_snapshot(sizes, ["server_name", "database_name"]).groupBy("server_name").agg(F.max("total_mb").alias("largest_db_mb"))
    lag = F.max(F.col("sent_lsn") - F.col("replay_lsn"))
    lags = latest_snapshot(replicas, ["server_name", "ag_name", "replica_name"]).groupBy("server_name").agg(
        truncated_div(lag, F.lit(1024 * 1024)).alias("max_replication_lag_mb")
    )
    out = inventory
    for part, name in (
        (connections, "current_connections"), (failures, "failed_logins_24h"), (largest, "largest_db_mb"), (lags, "max_replication_lag_mb"),
    ):
        out = out.join(part, "server_name", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))
    return out


def new_principals(current: DataFrame, known: DataFrame, keys: list[str], action: str = "CREATED") -> DataFrame:
    """Rows of the current snapshot the known one lacks."""
    return current.join(known.select(*keys), keys, "left_anti").withColumn("action_type", F.lit(action))


def dropped_principals(current: DataFrame, known: DataFrame, keys: list[str], action: str = "DROPPED") -> DataFrame:
    """Keys of the known snapshot the current one lacks."""
    return known.join(current.select(*keys), keys, "left_anti").select(*keys).withColumn("action_type", F.lit(action))


def compare_servers(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Rows found on one side only, labelled with the side. One shuffle serves both directions."""
    sided = source.select(*keys, F.lit("SOURCE ONLY").alias("side")).unionByName(
        target.select(*keys, F.lit("TARGET ONLY").alias("side"))
    )
    both = sided.groupBy(*keys).agg(F.min("side").alias("side"), F.max("side").alias("other"))
    return both.where(F.col("side") == F.col("other")).drop("other")


def role_members(links: DataFrame, roles: DataFrame, principals: DataFrame) -> DataFrame:
    """Role and member names of each server through its bridge table, with the assignment statement."""
    members = principals.select(
        "server_name",
        F.col("principal_id").alias("member_id"),
        F.col("login_name").alias("member_name"),
        F.when(F.col("login_type") == "SQL_LOGIN", "User").otherwise("Group").alias("member_type"),
    )
    return (
        links.join(roles, ["server_name", "role_id"])
        .join(members, ["server_name", "member_id"])
        .select(
            "server_name",
            "role_name",
            "member_name",
            "member_type",
            F.concat(
                F.lit("EXEC sp_addsrvrolemember '"), F.col("member_name"), F.lit("', '"), F.col("role_name"), F.lit("';")
            ).alias("assignment_statement"),
        )
    )


def permissions(grants: DataFrame, principals: DataFrame, class_id: int = 100) -> DataFrame:
    """Server-level permissions with the names of both sides; ids count within a server."""
    grantee = principals.select("server_name", F.col("principal_id").alias("grantee_id"), F.col("login_name").alias("grantee_name"))
    grantor = principals.select("server_name", F.col("principal_id").alias("grantor_id"), F.col("login_name").alias("grantor_name"))
    return (
        grants.where(F.col("class_id") == class_id)
        .join(grantee, ["server_name", "grantee_id"])
        .join(grantor, ["server_name", "grantor_id"])
        .select("server_name", "grant_id", "grantee_name", "grantor_name", "permission_name", "state_desc", F.lit("SERVER").alias("object_type"))
    )


def failover_pairs(replicas: DataFrame) -> DataFrame:
    """Current primary and one secondary per group (the first by name); groups lacking either are left out.

    Only the newest state of each replica counts; a replica is never paired with itself.
    """
    role = F.col("replica_role")
    now = latest_snapshot(replicas, ["ag_name", "replica_name"])
    primaries = now.where(role == "PRIMARY").groupBy("ag_name").agg(F.min("replica_name").alias("new_primary"))
    return (
        now.where(role == "SECONDARY")
        .join(primaries, "ag_name")
        .where(F.col("replica_name") != F.col("new_primary"))
        .groupBy("ag_name", "new_primary")
        .agg(F.min("replica_name").alias("old_primary"))
        .select("ag_name", "old_primary", "new_primary")
    )


def replication_channels(config: DataFrame, connection: DataFrame, applier: DataFrame) -> DataFrame:
    """Channel state, lag and error counts from the three status tables; a channel's name counts on its server."""
    channel = ["server_name", "channel_name"]
    return config.join(connection, channel).join(applier, channel)


def events_vs_names(events: DataFrame, names: DataFrame, min_waits: int = 100, n: int = 20) -> DataFrame:
    """Non-idle wait events with more than 100 waits, longest total first."""
    avg = F.col("time_waited").cast("double") / F.nullif(F.col("total_waits"), F.lit(0))
    return (
        events.where(F.col("total_waits") > min_waits)
        .join(names.where(F.col("wait_class") != "Idle"), "event")
        .select(
            "server_name",
            "event",
            "wait_class",
            "total_waits",
            "time_waited",
            F.round(avg * 10, 2).alias("avg_wait_cs"),
            F.round(avg / 100, 2).alias("avg_wait_ms"),
        )
        .orderBy(F.desc("time_waited"), "server_name", "event")
        .limit(n)
    )


def column_dictionary(
    columns: DataFrame, types: DataFrame, primary_keys: DataFrame, foreign_keys: DataFrame, identities: DataFrame, defaults: DataFrame
) -> DataFrame:
    """Column rows with type text, key flags and default."""
    key = ["server_name", "database_name", "column_id"]
    flag = lambda df, name: df.select(*key).distinct().withColumn(name, F.lit(1))
    on = lambda name: F.coalesce(F.col(name), F.lit(0)).alias(name)
    return (
        columns.join(types, "data_type")
        .join(flag(primary_keys, "is_primary_key"), key, "left")
        .join(flag(foreign_keys, "is_foreign_key"), key, "left")
        .join(flag(identities, "is_identity"), key, "left")
        .join(defaults.select(*key, "default_value"), key, "left")
        .select(
            "server_name",
            "database_name",
            "schema_name",
            "object_name",
            "column_name",
            "column_id",
            type_text(F.col("data_type"), F.col("max_length"), F.col("num_precision"), F.col("num_scale")).alias("type_text"),
            "type_family",
            "is_nullable",
            on("is_primary_key"),
            on("is_foreign_key"),
            on("is_identity"),
            "default_value",
        )
    )


def low_stock(inventory: DataFrame, products: DataFrame, default_reorder: int = 10) -> DataFrame:
    """Items below their reorder point and how many are missing."""
    point = F.coalesce(F.col("reorder_point"), F.lit(default_reorder).cast("bigint"))
    return (
        inventory.where(F.col("quantity") < point)
        .join(products, "product_id")
        .select(
            "product_id",
            "product_name",
            F.col("quantity").alias("current_stock"),
            point.alias("reorder_point"),
            F.greatest(point - F.col("quantity"), F.lit(0)).alias("shortage"),
        )
    )


def orders_to_process(orders: DataFrame, customers: DataFrame, n: int = 5) -> DataFrame:
    """Newest open orders with the customer's name and the status they move to.

    The join is N:1 on a key every order has, so the newest orders are picked first.
    """
    open_orders = orders.where(F.col("order_status").isin("In Process", "Approved"))
    known = open_orders.join(customers.select("customer_id"), "customer_id", "left_semi")
    newest = known.orderBy(F.desc("order_time"), "order_id").limit(n)
    return newest.join(customers, "customer_id").select(
        "order_id",
        "customer_name",
        "total_due",
        "order_time",
        F.when(F.col("order_status") == "In Process", "Completed").otherwise("Status Updated").alias("status_change"),
    )


def employee_activity(people: DataFrame, vacation: DataFrame, sick: DataFrame, activity: DataFrame, as_of: datetime) -> DataFrame:
    """People with leave balances (0 when unknown) and their last activity; Active within 24 hours."""
    last = activity.groupBy("person_id").agg(F.max("activity_time").alias("last_activity"))
    zero = F.lit(0).cast("bigint")
    return (
        people.join(vacation, "person_id", "left")
        .join(sick, "person_id", "left")
        .join(last, "person_id", "left")
        .select(
            "person_id",
            "person_name",
            F.coalesce("vacation_hours", zero).alias("vacation_hours"),
            F.coalesce("sick_hours", zero).alias("sick_hours"),
            "last_activity",
            F.when(F.col("last_activity") > before(as_of, hours=24), "Active").otherwise("Inactive").alias("activity_status"),
        )
    )


def tempdb_by_session(sessions: DataFrame, task_space: DataFrame) -> DataFrame:
    """Temporary-space allocations per user session; sessions without any keep NULL."""
    key = [*SNAPSHOT, "session_id"]
    spent = task_space.groupBy(*key).agg(
        total(F.col("allocated_pages")).alias("allocated_pages"), total(F.col("deallocated_pages")).alias("deallocated_pages")
    )
    return sessions.select(*key, "login_name", "host_name", "query_text").join(spent, key, "left")
