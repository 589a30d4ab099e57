"""Near-dedup and mixing against brute force, the pipeline, and the registered queries against their SQL."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetspan.llm import minhash, mixing
from fleetspan.llm.queries import QUERIES, prepare
from tests.compare import compare, duck
from tests.llm.helpers import dirty, documents, prose, rows_of

SF_DIR = "/root/testdata/sf0.001"


# -- near duplicates ----------------------------------------------------------------------------


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute_components(rows, width, percent):
    nodes = sorted({i for i, _ in rows if i is not None})
    parent = {i: i for i in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t, width)) for i, t in rows if i is not None]
    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            common = len(s & t)
            if common and 100 * common >= percent * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in nodes}


def near_copies(seed, groups=12, size=9):
    rng = random.Random(seed)
    rows, n = [], 0
    for g in range(groups):
        base = prose(seed * 100 + g, rng.randint(4, 120)).split()
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 14))):
                copy[rng.randrange(len(copy))] = f"new{rng.randint(0, 99)}"
            rows.append((n, " ".join(copy)))
            n += 1
    return rows


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_components_match_all_pairs(spark, width, percent):
    rows = near_copies(3) + [(500 + i, t) for i, t in dirty("A b\tC d e f") if i is not None] + [(900, "one"), (901, "ONE"), (902, "one two"), (None, "one")]
    got = minhash.near_duplicates(documents(spark, rows), width, percent)
    want = brute_components(rows, width, percent)
    assert {(r.doc_id, r.component_id) for r in got.collect() if r.doc_id is not None} == set(want.items())
    assert got.count() == len(rows)
    assert rows_of(got.where("doc_id IS NULL"), "component_id", "kept") == [(None, True)]
    sizes = {(r.doc_id, r.n_shingles) for r in got.collect()}
    assert sizes == {(i, len(shingles(t, width))) for i, t in rows}
    assert len(set(want.values())) < len(want)


def test_chain_through_a_dense_group(spark):
    """Copies that drift: neighbours are linked, the ends are far from each other and from any one centre."""
    rng = random.Random(9)
    words = prose(77, 150).split()
    rows = []
    for i in range(60):
        rows.append((i, " ".join(words)))
        words[rng.randrange(len(words))] = f"d{i}"
        words[rng.randrange(len(words))] = f"e{i}"
    rng.shuffle(rows)
    got = minhash.near_duplicates(documents(spark, rows), 3, 85)
    assert {(r.doc_id, r.component_id) for r in got.collect()} == set(brute_components(rows, 3, 85).items())


def test_few_centres_per_round_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CENTRES", (1,))
    monkeypatch.setattr(minhash, "PORTION", 3)
    monkeypatch.setattr(minhash, "SIGNED_PORTION", 4)
    rows = near_copies(5, groups=3, size=14)
    got = minhash.near_duplicates(documents(spark, rows), 3, 85, bands=12, rows=2)
    assert {(r.doc_id, r.component_id) for r in got.collect()} == set(brute_components(rows, 3, 85).items())


def test_bytes_that_agree_by_chance_lose_no_link(spark, monkeypatch):
    words = prose(5, 200).split()
    texts = {1: prose(6, 200), 2: " ".join(words), 3: " ".join([*words[:-1], "zz"])}  # 2 and 3 are a link, 1 is their centre
    signed = [(1, 198, "a", [11, 50], bytearray(b"\7\7\7\7")), (2, 198, "b", [12, 50], bytearray(b"\1\1\2\2")), (3, 198, "c", [13, 50], bytearray(b"\1\1\2\2"))]
    schema = "doc_id long, n_shingles long, set_key string, keys array<long>, marks binary"
    monkeypatch.setattr(minhash, "sign", lambda *_: spark.createDataFrame(signed, schema))  # band 0: same bytes, other keys
    got = minhash.near_duplicates(documents(spark, list(texts.items())), 3, 85, bands=2, rows=2)
    assert rows_of(got, "doc_id", "component_id") == [(1, 1), (2, 2), (3, 2)]


def test_a_member_goes_to_a_block_once(spark):
    """However many buckets a member shares with the centres of a block, it is one row there, and each pair counts once."""
    near, n = np.arange(20, dtype=np.uint8).tobytes(), 60
    keys = [[1, 2, 3, 4, 5]] * 2 * n  # all in the same five buckets
    signatures = spark.createDataFrame([(i, 100, near, keys[i]) for i in range(2 * n)], "doc_id long, n_shingles long, marks binary, keys array<long>")
    homes = spark.createDataFrame([(i, 7) for i in range(n)] * 3 + [(1000 + i, 1000 + i) for i in range(900)], "id long, home long")
    blocks = minhash.in_blocks_by_home(homes, 900 + n)
    assert blocks.count() == blocks.select("id").distinct().count() == 900 + n
    ours = blocks.where(f"id < {n}")
    assert ours.select("block").distinct().count() == 1  # and not one per block of all centres
    goes = spark.createDataFrame([(i, i) for i in range(2 * n)], "doc_id long, component long").join(ours.select("block").distinct())
    for now, pairs in (([1, 2, 3, 4, 5], n * (2 * n - 1)), ([2], 0)):  # those that share bucket 1 first meet there
        rows = minhash.alike(goes, ours.withColumn("now", F.lit(now).cast("array<long>")), signatures, 2 * n, 85).collect()
        assert len(rows) == len({(r.block, r.id) for r in rows}) == (2 * n if pairs else 0)
        assert sum(len(r.centres) for r in rows) == pairs and all(r.id not in r.centres for r in rows)


def test_first_of_each_group(spark):
    rows = near_copies(2, groups=4, size=4) + [(700, None), (701, ""), (None, "x y z"), (702, "b b b"), (702, "a a a"), (702, "a a a")]
    docs = documents(spark, rows)
    kept = minhash.first_of_each_group(docs, 5, 80)
    assert kept.columns == docs.columns
    roots = brute_components(rows, 5, 80)
    assert rows_of(kept, "doc_id") == sorted([(i,) for i, c in roots.items() if i == c], key=lambda t: t[0]) + [(None,)]
    assert kept.where("doc_id = 702").first().text == "a a a"
    assert minhash.first_of_each_group(documents(spark, []), 5, 80).count() == 0


def test_signature_of_small_sets_is_full():
    for n in (1, 2, 7):
        sig = minhash.signature(np.arange(1, n + 1, dtype=np.uint64), 240)
        assert len(sig) == 240 and (sig != 0).all()


# -- mixing -------------------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    left, target, free = float(sum(sizes.values())), {}, list(names)
    while free:
        unit = left / sum(weight[s] for s in free)
        over = [s for s in free if unit * weight[s] > 3 * sizes[s]]
        if not over:
            return target | {s: unit * weight[s] for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


def mixed_rows():
    rng = random.Random(4)
    rows = [(i, prose(i, rng.randint(0, 300)), rng.choice(["a", "a", "a", "b", "Z", None])) for i in range(300)]
    rows += [(1000, "one two", "tiny"), (1001, None, "a"), (1002, "", "empty"), (1003, " \t", "a"), (1001, None, "a"), (None, "x y z", "b"), (7, "again", "a")]
    return rows + [(2000 + i, prose(i, 400), "é") for i in range(3)]


def test_mixture_matches_its_targets(spark):
    rows = mixed_rows()
    docs = documents(spark, rows)
    got = mixing.mixture(docs, block_words=16).collect()
    size = lambda t: len((t or "").split())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((i is None, i or 0, size(t)) for i, t, _ in rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    targets = brute_targets(sizes)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    by = {}
    for r in got:
        by.setdefault((r.source_size, round(r.target, 6)), []).append(r.taken)
    for s, target in targets.items():
        taken = sum(by[sizes[s], round(target, 6)])
        assert abs(taken - target) <= 32, (s, taken, target)
    assert abs(sum(targets.values()) - sum(sizes.values())) < 1e-6
    again = mixing.mixture(docs.repartition(7), block_words=16).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    other = mixing.mixture(docs, block_words=16, seed=1).collect()
    assert sorted(map(key, got)) != sorted(map(key, other))


def test_every_pass_is_a_permutation(spark):
    plan = mixing.make_plan(["a", "b", None], [1000, 100, 10], block_words=10)
    rows = mixing.slots(spark, plan, seed=3).groupBy("source_no", "pass_no", "block").count().collect()
    assert all(r["count"] == 1 for r in rows)
    for no, (blocks, quota) in enumerate(zip(plan.blocks, plan.quotas, strict=True)):
        mine = [r for r in rows if r.source_no == no]
        assert len(mine) == quota and all(0 <= r.block < blocks for r in mine)
        for p in range(quota // blocks):
            assert sorted(r.block for r in mine if r.pass_no == p) == list(range(blocks))
    for n in (1, 2, 3, 17, 256, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 5).tolist()) == list(range(n))


def test_spans_cover_every_word_once(spark):
    docs = documents(spark, mixed_rows())
    _, spans, plan = mixing.mix(docs, block_words=16)
    per_block = spans.groupBy("source_no", "block").agg(F.sum("n_words").alias("n")).collect()
    assert all(r.n <= 16 for r in per_block)
    assert sum(r.n for r in per_block) == int(plan.sizes.sum())


def test_nothing_to_mix(spark):
    assert mixing.mixture(documents(spark, [])).count() == 0
    assert rows_of(mixing.mixture(documents(spark, [(1, None), (2, "")])), "doc_id", "taken") == [(1, 0), (2, 0)]


# -- queries and pipeline -----------------------------------------------------------------------


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_query_matches_sql(spark, name):
    result = compare(spark, duck(SF_DIR), SF_DIR, QUERIES[name])
    assert result["problem"] is None, result["problem"]
    assert result["rows"] > 0


def test_queries_return_their_columns(spark):
    columns = {
        "op4_source_mixing": ["doc_id", "size", "source_size", "target", "taken"],
        "op6_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op7_document_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        "op8_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        "op9_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    }
    n = spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    for name, wanted in columns.items():
        df = QUERIES[name].run(spark, SF_DIR)
        assert set(wanted) <= set(df.columns) and df.count() == n


def test_pipeline_stages_keep_clean_documents(spark, tmp_path):
    prepare(spark)
    passage = " ".join(f"bench{i}" for i in range(20))
    rows = [(i, prose(i, 40), f"src{i % 3}") for i in range(200)]
    rows += [(300, rows[5][1], "src0"), (301, prose(5, 40).replace(" ", "\n", 1), "src1"), (302, f"{prose(901, 20)} {passage}", "src1")]
    rows += [(303, prose(902, 20) + " password=abcdef0123456789", None), (304, None, "src0"), (305, "", "src2")]
    bad = [(400 + i, prose(2000 + i, 30) + " trash worthless moronic", "src0") for i in range(60)]
    folder = str(tmp_path)
    docs = documents(spark, rows + bad, extra=False)
    docs.write.parquet(f"{folder}/documents.parquet")
    marks = [(i, 1, 0) for i in range(200)] + [(400 + i, 0, 1) for i in range(50)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, folder)
        out.write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
        seen[name] = {r.doc_id for r in now.collect()}
        if name != "mixing":
            assert now.columns == docs.columns
    everyone = {r[0] for r in rows}
    assert seen["toxicity"] == everyone
    assert seen["near_dedup"] == everyone - {300, 301}
    assert seen["decontamination"] == seen["near_dedup"] - {302}
    assert seen["secrets"] == seen["decontamination"] == seen["mixing"]
    secrets = spark.read.parquet(f"{folder}/secrets")
    assert secrets.where("doc_id = 303").first().text.endswith("[assign]")
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == seen["mixing"]
