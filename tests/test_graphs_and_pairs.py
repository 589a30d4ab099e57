"""Blocking chains, lock queues and redundant indexes against brute force, including cycles and hot groups."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fleetspan.operators import joins

NOW = datetime(2024, 1, 31)


def sessions(spark, edges, server="srv0"):
    return spark.createDataFrame([(s, b) for s, b in edges], "session_id long, blocking_session_id long").selectExpr(
        "*", f"'{server}' server_name", "timestamp_ntz'2024-01-31 00:00:00' capture_time", "'login' login_name", "'app' program_name", "'running' status", "cast(null as string) wait_type", "5L wait_time_ms",
        "'select 1' query_text", "timestamp_ntz'2024-01-30 23:00:00' query_start",
    )


def walk(edges, start):
    """(path of blocked sessions, root or None for a cycle)."""
    parent = {s: b for s, b in edges if b > 0}
    path, seen, node = [], set(), start
    while node in parent:
        if node in seen:
            return path, None
        seen.add(node)
        path.append(node)
        node = parent[node]
    return path, node


def check_chains(spark, edges):
    out = {r.session_id: r for r in joins.blocking_chains(sessions(spark, edges)).collect()}
    blocked = [s for s, b in edges if b > 0]
    assert set(out) == set(blocked)
    for s in blocked:
        path, root = walk(edges, s)
        row = out[s]
        if root is None:
            assert (row.chain_state, row.root_blocker, row.level) == ("CYCLE", None, None)
        else:
            assert (row.chain_state, row.root_blocker, row.level) == ("CHAIN", root, len(path))


def test_chain_of_many_sessions(spark):
    check_chains(spark, [(1, 0)] + [(i, i - 1) for i in range(2, 71)])


def test_cycles_and_missing_blockers(spark):
    check_chains(spark, [(1, 2), (2, 3), (3, 1), (4, 1), (5, 4), (6, 99), (7, 6), (8, 8), (9, 0)])


def test_random_forests(spark):
    rng = random.Random(3)
    edges = [(i, 0 if rng.random() < 0.2 else rng.randint(1, 60)) for i in range(1, 61)]
    check_chains(spark, edges)


def test_walk_lists_every_step_and_a_circle_once(spark):
    edges = [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4), (6, 2), (7, 8), (8, 7), (9, 7)]
    people = sessions(spark, edges)
    chosen = {2, 5, 7, 9}
    origins = people.where(people.session_id.isin(chosen))
    got = {(r.origin, r.level, r.session_id, r.root_blocker) for r in joins.blocking_walk(people, origins).collect()}
    want = set()
    for s in chosen:
        path, root = walk(edges, s)
        want |= {(s, level, node, root) for level, node in enumerate(path)}
    assert got == want


def brute_paths(edges):
    """Per blocked session: (blocked_by, root, cycle_id, in_cycle, level, path) by walking."""
    by = {s: b for s, b in edges if b > 0}
    out = {}
    for s in by:
        way, at = [], s
        while at in by and at not in way:
            way.append(at)
            at = by[at]
        if at in way:
            circle = way[way.index(at) :]
            first = min(circle)
            steps = way[: way.index(first)]
            out[s] = (by[s], None, first, s in circle, len(steps), " > ".join(map(str, [first, *reversed(steps)])))
        else:
            out[s] = (by[s], at, None, False, len(way), " > ".join(map(str, [at, *reversed(way)])))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_paths_and_named_circles_match_walks(spark, seed):
    rng = random.Random(seed)
    edges = [(i, rng.choice([0, rng.randint(1, 60), max(1, i - 1)])) for i in range(1, 61)]
    edges += [(100, 101), (101, 102), (102, 100), (103, 102), (104, 103), (110, 110), (111, 110), (120, 999)]
    edges += [(200 + i, 199 + i if i else 0) for i in range(40)]  # a long chain
    edges += [(300 + i, 300 + (i + 1) % 17) for i in range(17)] + [(330, 316)]  # a long circle with one waiting for it
    people = sessions(spark, edges).unionByName(sessions(spark, [(1, 2), (2, 0)], "srv1"))
    out = joins.blocking_paths(people).collect()
    got = {r.session_id: (r.blocked_by, r.root_blocker, r.cycle_id, r.in_cycle, r.level, r.path) for r in out if r.server_name == "srv0"}
    assert got == brute_paths(edges)
    assert [(r.session_id, r.path, r.chain) for r in out if r.server_name == "srv1"] == [(1, "2 > 1", "  1")]
    deep = next(r for r in out if r.session_id == 239 and r.server_name == "srv0")
    assert deep.chain == "  " * 39 + "239"
    circles = {r.cycle_id: sum(x.cycle_id == r.cycle_id and x.in_cycle for x in out) for r in out if r.cycle_id}
    assert circles[100] == 3 and circles[110] == 1 and circles[300] == 17
    assert joins.blocking_paths(sessions(spark, [(1, 0)])).count() == 0


def test_equal_servers_do_not_mix(spark):
    edges = [(1, 0), (2, 1), (3, 2), (4, 2), (5, 9), (6, 7), (7, 6), (8, 3)]
    one = sessions(spark, edges)
    three = one.unionByName(sessions(spark, edges, "srv1")).unionByName(sessions(spark, edges, "srv2"))
    rows = lambda df: sorted(tuple(r[c] for c in ("session_id", "root_blocker", "level", "chain_state")) for r in df.collect())
    chains = joins.blocking_chains(three)
    alone = rows(joins.blocking_chains(one))
    assert chains.count() == 3 * len(alone)
    for server in ("srv0", "srv1", "srv2"):
        assert rows(chains.where(chains.server_name == server)) == alone
    assert joins.blocking_pairs(three).count() == 3 * joins.blocking_pairs(one).count()


def test_no_blocking_at_all(spark):
    quiet = sessions(spark, [(1, 0), (2, 0)])
    assert joins.blocking_chains(quiet).count() == 0
    assert joins.blocking_walk(quiet, quiet).count() == 0


def test_lock_waits_and_queue_match_pairs(spark):
    rng = random.Random(11)
    resources = [("relation", 1, None, None), ("relation", 1, 7, None), ("tuple", None, 7, 3), ("relation", 2, 7, None)]
    locks = []
    for _ in range(80):
        r = resources[0] if rng.random() < 0.4 else rng.choice(resources)  # one resource is hot
        locks.append((*r, rng.randint(1, 25), rng.randint(0, 1)))
    locks.append(("alone", 1, 1, 1, 99, 0))
    df = spark.createDataFrame(locks, "locktype string, database_id long, relation_id long, page_id long, pid long, granted int").selectExpr(
        "*", "'srv0' server_name", "timestamp_ntz'2024-01-31 00:00:00' capture_time", "cast(null as string) virtualxid",
        *[f"cast(null as bigint) {c}" for c in ("tuple_id", "transactionid", "classid", "objid", "objsubid")],
    )
    people = sessions(spark, [(i, 0) for i in range(1, 100)])

    pairs = {}
    for *res, pid, granted in locks:
        if granted == 0:
            others = [o for o in locks if list(o[:4]) == res and o[4] != pid]
            if others:
                pairs[(*res, pid)] = (len(others), {o[4] for o in others})
    out = {(r.locktype, r.database_id, r.relation_id, r.page_id, r.blocked_pid): r for r in joins.lock_waits(df, people, NOW).collect()}
    assert set(out) == set(pairs)
    for key, (n, pids) in pairs.items():
        assert out[key].blockers == n and out[key].blocking_pid in pids

    queue = joins.lock_queue(df).collect()
    rebuilt = {}
    for w in queue:
        if w.granted == 0:
            same = [o for o in queue if (o.locktype, o.database_id, o.relation_id, o.page_id) == (w.locktype, w.database_id, w.relation_id, w.page_id)]
            others = {o.pid for o in same if o.pid != w.pid}
            if others:
                rebuilt[(w.locktype, w.database_id, w.relation_id, w.page_id, w.pid)] = others
    assert rebuilt == {k: pids for k, (_, pids) in pairs.items()}


def _indexes(spark, defs):
    cols = [(t, i, n, c) for t, i, _, _, names in defs for n, c in enumerate(names, 1)]
    catalog = [(t, i, f"ix{i}", u, p, 20 + i) for t, i, u, p, _ in defs]
    place = ["*", "'srv0' server_name", "'db1' database_name", "'dbo' schema_name"]
    return (
        spark.createDataFrame(cols, "table_name string, index_id long, key_ordinal long, column_name string").selectExpr(*place),
        spark.createDataFrame(
            catalog, "table_name string, index_id long, index_name string, is_unique int, is_primary_key int, used_pages long"
        ).selectExpr(*place),
    )


def test_duplicate_indexes_against_pairs(spark):
    rng = random.Random(5)
    defs = []
    for i in range(1, 90):
        table = "hot" if i % 3 == 0 else f"t{i % 4}"
        names = [rng.choice("ab") for _ in range(rng.randint(1, 3))]
        defs.append((table, i, int(rng.random() < 0.1), int(rng.random() < 0.05), names))
    cols, catalog = _indexes(spark, defs)
    out = joins.duplicate_indexes(cols, catalog, min_kb=0).collect()
    exact = {r.index2_name for r in out if r.match_kind == "EXACT"}
    prefix = {r.index2_name for r in out if r.match_kind == "LEFT PREFIX"}
    plain = [d for d in defs if not d[2] and not d[3]]
    want_exact = {f"ix{b[1]}" for b in defs for a in plain if a[0] == b[0] and a[1] < b[1] and a[4] == b[4]}
    want_prefix = {f"ix{b[1]}" for b in defs for a in plain if a[0] == b[0] and len(a[4]) > len(b[4]) and a[4][: len(b[4])] == b[4]}
    assert exact == want_exact and prefix == want_prefix
    assert len(out) == len(exact) + len(prefix)  # one row per redundant index and kind
    by_id = {f"ix{d[1]}": d for d in defs}
    for r in out:
        d = by_id[r.index2_name]
        want = "Keep Index2 (PK)" if d[3] else "Keep Index2 (Unique)" if d[2] else "DROP Index2"
        assert r.recommendation == want


@pytest.mark.parametrize("percent", [30, 50, 67, 100])
def test_overlapping_sets_against_all_pairs(spark, percent):
    rng = random.Random(percent)
    defs = []
    for i in range(1, 120):
        table = "hot" if i % 2 else f"t{i % 5}"
        names = [c for c in rng.sample("abcdefg", rng.randint(1, 4))]
        if table == "hot" and "a" not in names:
            names.append("a")  # a column of every index of the table
        defs.append((table, i, 0, 0, names))
    cols, catalog = _indexes(spark, defs)
    first = {}
    for t, i, _, _, names in defs:
        first.setdefault((t, frozenset(names)), i)
    sets = sorted((t, i, s) for (t, s), i in first.items())
    want = {
        (t, f"ix{i}", f"ix{j}", ", ".join(sorted(a & b)))
        for t, i, a in sets for u, j, b in sets
        if t == u and i < j and a & b and 100 * len(a & b) >= percent * len(a | b)
    }
    out = joins.overlapping_indexes(cols, catalog, percent).collect()
    got = {(r.table_name, r.index1_name, r.index2_name, r.shared_columns) for r in out}
    assert got == want and len(out) == len(want)
    members = joins.column_sets(cols, catalog).collect()
    assert len(members) == len(defs)
    for r in members:
        same = [d for d in defs if d[0] == r.table_name and set(d[4]) == set(r.column_set)]
        assert (r.set_id, r.set_size) == (min(d[1] for d in same), len(same)) and r.index_id in {d[1] for d in same}


def test_a_column_of_every_index_brings_no_one_together(spark):
    """Rare columns come first: sets that share nothing but the common one never meet, and the hot group is no pair list."""
    defs = [("t", i, 0, 0, ["id", f"c{i}", f"d{i}"]) for i in range(1, 400)] + [("t", 500, 0, 0, ["c7", "id", "d7", "x"])]
    cols, catalog = _indexes(spark, defs)
    assert [(r.index1_name, r.index2_name, r.overlap_pct) for r in joins.overlapping_indexes(cols, catalog, 50).collect()] == [("ix7", "ix500", 75.0)]


def test_pairs_of_overlapping_sets_are_joined_once(spark):
    """The column sets are made once, and pairs are one join: not one more for each name, size and list of either side."""
    cols, catalog = _indexes(spark, [("t", i, 0, 0, ["id", f"c{i % 9}", f"d{i % 7}"]) for i in range(1, 40)])
    plan = joins.overlapping_indexes(cols, catalog)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1 and "Aggregate" not in plan


def test_overlapping_sets_of_a_repeated_catalog_row(spark):
    cols, catalog = _indexes(spark, [("t", 1, 0, 0, ["a", "b"]), ("t", 2, 0, 0, ["a", "b", "c"])])
    again = catalog.unionByName(catalog.where("index_id = 2").withColumn("index_name", F.lit("other")))
    got = sorted((r.index1_name, r.index2_name, r.overlap_pct) for r in joins.overlapping_indexes(cols, again).collect())
    assert got == [("ix1", "ix2", 66.67), ("ix1", "other", 66.67)]


def test_duplicate_columns_against_pairs(spark):
    defs = [("t", 1, 0, 0, ["a", "b"]), ("t", 2, 0, 0, ["a", "c"]), ("t", 3, 1, 0, ["a", "b"]), ("t", 4, 0, 0, ["b"]), ("u", 5, 0, 0, ["a"])]
    cols, catalog = _indexes(spark, defs)
    got = {(r.key_ordinal, r.index1_name, r.index2_name, r.recommendation) for r in joins.duplicate_index_columns(cols, catalog).collect()}
    assert got == {
        (1, "ix1", "ix2", "Consider Dropping"), (1, "ix1", "ix3", "Keep Index2 (Unique)"), (2, "ix1", "ix3", "Keep Index2 (Unique)"),
    }


def test_same_table_name_in_two_databases_is_no_duplicate(spark):
    cols, catalog = _indexes(spark, [("t", 1, 0, 0, ["a"]), ("t", 2, 0, 0, ["a", "b"])])
    second = lambda df, n: df.where(f"index_id = {n}").withColumn("database_name", F.lit(f"db{n}"))
    cols = second(cols, 1).unionByName(second(cols, 2))
    catalog = second(catalog, 1).unionByName(second(catalog, 2))
    assert joins.duplicate_indexes(cols, catalog, min_kb=0).count() == 0
    assert joins.duplicate_index_columns(cols, catalog).count() == 0


def test_failover_pairs_take_the_newest_state(spark):
    rows = [
        ("ag", "r1", "PRIMARY", 1), ("ag", "r2", "SECONDARY", 1), ("ag", "r1", "SECONDARY", 2), ("ag", "r2", "PRIMARY", 2),
        ("solo", "r1", "PRIMARY", 1), ("solo", "r1", "SECONDARY", 0),
    ]
    df = spark.createDataFrame(rows, "ag_name string, replica_name string, replica_role string, h int").selectExpr(
        "*", "timestamp_ntz'2024-01-31 00:00:00' + make_interval(0, 0, 0, 0, h) capture_time"
    )
    assert [tuple(r) for r in joins.failover_pairs(df).collect()] == [("ag", "r1", "r2")]


def test_membership_differences_rebuild_the_snapshot(spark):
    old = spark.createDataFrame([(f"l{i}",) for i in range(0, 30)], "login_name string")
    new = spark.createDataFrame([(f"l{i}",) for i in range(12, 45)], "login_name string")
    added = {r.login_name for r in joins.new_principals(new, old, ["login_name"]).collect()}
    gone = {r.login_name for r in joins.dropped_principals(new, old, ["login_name"]).collect()}
    before = {r.login_name for r in old.collect()}
    assert (before - gone) | added == {r.login_name for r in new.collect()}
    sides = {(r.login_name, r.side) for r in joins.compare_servers(old, new, ["login_name"]).collect()}
    assert sides == {(x, "SOURCE ONLY") for x in gone} | {(x, "TARGET ONLY") for x in added}
