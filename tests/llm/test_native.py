"""License scan, decontamination and URL filter on small inputs, against brute force."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from fleetspan.llm import decontamination, licenses, urls
from tests.llm.helpers import dirty, documents, prose, rows_of


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute_hits(text, items, width=10):
    w, hit, found = words(text), set(), set()
    for item, body in items:
        b = words(body)
        n = min(width, len(b))
        grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def items_table(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "'x' AS words", "1 AS span", "2 AS hash")


@pytest.mark.parametrize("limit", [1 << 20, 0])  # broadcast, and joined by shuffle
def test_contamination_matches_brute_force(spark, limit):
    rng = random.Random(4)
    items = [(i, prose(i, rng.choice([2, 9, 10, 11, 30]), 60)) for i in range(12)] + [(50, "Short one"), (51, None), (52, "."), (7, prose(99, 12))]
    docs = []
    for i in range(60):
        body = prose(1000 + i, 40, 60)
        if i % 3 == 0:
            body += " ÉTÉ, " + rng.choice(items)[1].upper() if rng.random() < 0.5 and items[i % 12][1] else " " + (items[i % 12][1] or "")
        docs.append((i, body + (" short ONE" if i % 5 == 0 else "")))
    docs += [(100, None), (101, ""), (102, "..."), (3, "a"), (3, docs[3][1]), (3, docs[3][1]), (None, docs[0][1])]
    table = items_table(spark, items)
    got = decontamination.find_hits(documents(spark, docs), table, broadcast_bytes=limit)
    have = sorted((str(r.doc_id), r.n_words, len(r.hit_words), r.hit_items) for r in got.collect())
    want = sorted((str(i), *brute_hits(t, [(k, b or "") for k, b in items])) for i, t in set(docs))
    assert have == [(i, n, h, list(f)) for i, n, h, f in want]
    counts = decontamination.contamination(documents(spark, docs), table, broadcast_bytes=limit)
    assert counts.where("contaminated <> (n_hit > 0)").count() == 0
    assert any(w[2] for w in want) and any(not w[2] for w in want)


def test_contaminated_documents_and_spans_go(spark):
    passage = " ".join(f"w{i}" for i in range(14))
    items = items_table(spark, [(1, passage)])
    docs = documents(spark, [(1, f"Keep this, {passage}! And that."), (2, "clean text"), (3, None), (None, passage.upper()), (4, "clean text")])
    kept = decontamination.clean_documents(docs, items)
    assert kept.columns == docs.columns
    assert rows_of(kept, "doc_id") == [(2,), (3,), (4,)]
    texts = {r.doc_id: r.text for r in decontamination.remove_spans(docs, items).collect()}
    assert texts == {1: "Keep this, And that.", 2: "clean text", 3: None, None: "", 4: "clean text"}


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_contamination_of_a_very_long_text(spark, limit):
    """Windows on both sides of every piece boundary, in time that grows with the length."""
    words = [f"w{i % 9973}x{i % 13}" for i in range(300_000)]
    item = "one two three four five six seven eight nine ten eleven"
    spots = [0, 250, 256 - 11, 256 - 5, 1024, 120_000, len(words) - 11]
    for at in spots:
        words[at : at + 11] = item.split()
    covered = sorted({p for at in spots for p in range(at, at + 11) if words[at : at + 11] == item.split()} | {p for p in range(256 - 11, 256 + 6)})
    table = spark.createDataFrame([("a", item), ("b", "nine ten eleven"), ("c", words[200_000])], "item_id string, text string")
    start = time.perf_counter()
    got = {r.doc_id: r for r in decontamination.find_hits(documents(spark, [(1, " ".join(words)), (2, None), (3, "one two")]), table, broadcast_bytes=limit).collect()}
    assert time.perf_counter() - start < 90
    text = words
    want = set()
    for span, needles in ((10, [item.split()[i : i + 10] for i in range(2)]), (3, [["nine", "ten", "eleven"]]), (1, [[words[200_000]]])):
        heads = {n[0] for n in needles}
        want |= {p for i, w in enumerate(text) if w in heads and text[i : i + span] in needles for p in range(i, i + span)}
    assert got[1].hit_words == sorted(want) and set(covered) & want
    assert got[1].n_words == 300_000 and got[1].hit_items == ["a", "b", "c"]
    assert (got[2].n_words, got[2].hit_words, got[3].n_words, got[3].hit_words) == (0, [], 2, [])


def test_license_in_a_very_long_text(spark):
    words = [f"w{i % 9973}x{i % 13}" for i in range(300_000)]
    notice = licenses.TEMPLATES[0][1].split()
    words[290_001 : 290_001 + len(notice)] = notice
    start = time.perf_counter()
    got = licenses.scan_licenses(documents(spark, [(1, " ".join(words)), (2, "short")]), licenses.default_templates(spark)).collect()
    assert time.perf_counter() - start < 90
    assert [(r.doc_id, r.license_id, r.containment) for r in got] == [(1, licenses.TEMPLATES[0][0], 1.0)]
    assert 290_001 - 2 * len(notice) < got[0].first_word <= 290_001


def test_empty_tables(spark):
    none, some = documents(spark, []), documents(spark, dirty("a b c"))
    items = items_table(spark, [])
    assert decontamination.contamination(none, items_table(spark, [(1, "a")])).count() == 0
    assert decontamination.contamination(some, items).where("contaminated").count() == 0
    assert licenses.scan_licenses(none, licenses.default_templates(spark)).count() == 0
    assert licenses.scan_licenses(some, licenses.default_templates(spark).limit(0)).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert urls.filter_urls(pages, urls.default_rules(spark)).count() == 0


def brute_licenses(docs):
    out = {}
    for doc_id, text in docs:
        w = words(text)
        for name, body in licenses.TEMPLATES:
            t = words(body)
            n = len(t)
            theirs = {tuple(t[i : i + 5]) for i in range(n - 4)}
            for start in range(0, max(len(w), 1), n):
                ours = w[start : start + 2 * n]
                share = len(theirs & {tuple(ours[i : i + 5]) for i in range(len(ours) - 4)}) / len(theirs)
                if share >= 0.8:
                    best = out.get((doc_id, name))
                    out[doc_id, name] = (max(share, best[0]), min(start, best[1])) if best else (share, start)
    return out


def test_license_scan_matches_exact_containment(spark):
    rng = random.Random(8)
    docs = []
    for i in range(120):
        body = prose(i, rng.randint(0, 60)).split()
        notice = rng.choice(licenses.TEMPLATES)[1]
        if i % 4:
            cut = notice.split()
            if i % 8 == 1 and len(cut) > 12:
                cut[len(cut) // 2] = "changed"  # five shingles lost: still contained for the long ones
            at = rng.randint(0, len(body))
            body[at:at] = cut
        docs.append((i, " ".join(body)))
    docs += dirty("Released under the MIT License.")
    found = licenses.scan_licenses(documents(spark, docs), licenses.default_templates(spark))
    have = {(r.doc_id, r.license_id): (r.containment, r.first_word) for r in found.collect()}
    assert have == brute_licenses(docs)
    assert (None, "MIT") in have and (1, "MIT") in have


def test_short_license_templates_are_refused(spark):
    with pytest.raises(ValueError):
        licenses.scan_licenses(documents(spark, []), spark.createDataFrame([("x", "All rights reserved")], "license_id string, text string"))


def page(i, url, html=""):
    return (i, url, html)


def link(target):
    return f'<html><head><LINK rel="canonical" href="{target}"></head>'


def test_rules_and_verdicts(spark):
    pages = [
        page(1, "http://a.ORG/x"), page(2, "https://www.Example.org/es/1?q#f"), page(3, "http://example.org/en/12"), page(4, "http://notexample.org/es/"),
        page(5, "http://x.com/de/"), page(6, "http://x.com/fr/1"), page(7, "http://x.com"), page(8, None), page(9, "no-scheme.org/x"),
        page(10, "ftp://h?x=/y"), page(11, "http://org#a://b/c"), page(1, "http://a.ORG/x"), page(None, "http://com/de/2"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'x' AS rule", "'y' AS host", "'z' AS key", "'n' AS node")
    got = rows_of(urls.filter_urls(df, urls.default_rules(spark)), "page_id", "host", "path", "rule", "verdict")
    assert got == sorted(
        [
            (1, "a.org", "/x", "org/", "allow"), (1, "a.org", "/x", "org/", "allow"), (2, "www.example.org", "/es/1", "example.org/es/", "block"),
            (3, "example.org", "/en/12", "example.org/en/1", "block"), (4, "notexample.org", "/es/", "org/", "allow"),
            (5, "x.com", "/de/", "com/de/", "block"), (6, "x.com", "/fr/1", "com/fr/", "allow"), (7, "x.com", "", None, "allow"),
            (8, "", "", None, "allow"), (9, "", "", None, "allow"), (10, "h", "", None, "allow"), (11, "org", "", None, "allow"),
            (None, "com", "/de/2", "com/de/", "block"),
        ],
        key=lambda t: tuple((v is None, v) for v in t),
    )


def test_block_reaches_aliases_unless_allowed(spark):
    pages = [
        page(1, "http://a.net/1", link("http://b.net/2")), page(2, "http://b.net/2", '<meta http-equiv="refresh" content="0; url=http://x.com/de/9">'),
        page(3, "https://a.net/1#frag"), page(4, "http://c.com/fr/3", link("http://a.net/1")), page(5, "http://d.net/5", link("/6")),
        page(6, "http://d.net/6"), page(7, "http://e.net/dir/7", link("8")), page(8, "http://e.net/dir/8", link("//x.com/de/1")), page(9, "http://f.net/", link("")),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    extra = spark.createDataFrame([("http://g.net/1", "http://d.net/5"), (None, "http://x.com/de/1")], "from_url string, to_url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.filter_urls(df, urls.default_rules(spark), extra).collect()}
    assert got == {
        1: (None, "block"), 2: (None, "block"), 3: (None, "block"), 4: ("com/fr/", "allow"), 5: (None, "allow"), 6: (None, "allow"),
        7: (None, "block"), 8: (None, "block"), 9: (None, "allow"),
    }


def test_components_against_union_find(spark):
    from fleetspan.llm.components import connected_components

    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(500, 560)] + [(1000, i) for i in range(1001, 1200)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*edges, (7, None)], "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert connected_components(df.where(F.lit(False))).count() == 0


def test_native_plans_hold_no_python(spark):
    docs, items = documents(spark, [(1, "a b c d e f g")]), items_table(spark, [(1, "a b c d e f")])
    plans = [
        decontamination.contamination(docs, items), licenses.scan_licenses(docs, licenses.default_templates(spark)),
    ]
    for df in plans:
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
