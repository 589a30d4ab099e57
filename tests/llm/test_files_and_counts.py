"""Token files, importance resampling and collocations against brute force."""

import glob
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetspan.llm import collocations, resampling, token_files
from fleetspan.llm.queries import QUERIES, prepare
from tests.llm.helpers import DOCS, dirty, documents, prose, rows_of

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
BYTE_FILE = public_tokenizers.path("byte_bpe_50k.json")


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


# -- token files --------------------------------------------------------------------------------

ODD = st.text(st.sampled_from("ab'sS1é́ \u001c\u0085 Σς😀<|>. \t\n\r\x0b\x0c") | st.characters(codec="utf-8"), max_size=30)


@pytest.fixture(scope="module")
def encoder():
    return token_files.Encoder(WORD_FILE, 1)


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD | st.sampled_from(["<|endoftext|>", "a<|startoftext|>b <|endoftext|>", "it's I'LL"]), max_size=5))
def test_chunks_encode_as_whole_texts(encoder, texts):
    want = [library_ids(t) + [1] for t in texts]
    runs = list(encoder.encode([t.encode() for t in texts]))
    ids = np.concatenate([r[0] for r in runs]).tolist() if runs else []
    assert ids == [i for w in want for i in w]
    ends, at = [], 0
    for found, here in runs:
        ends += (here + at).tolist()
        at += len(found)
    assert ends == np.cumsum([len(w) for w in want]).tolist()


_library = []


def library_ids(text, path=WORD_FILE):
    if not _library:
        _library.append(library(path))
    return _library[0].encode(text, add_special_tokens=False).ids


def test_long_text_and_small_cache(monkeypatch):
    monkeypatch.setattr(token_files, "PIECE_BYTES", 50)
    monkeypatch.setattr(token_files, "CACHE_CHUNKS", 20)
    texts = [prose(1, 3000), "", "x" * 5000, prose(2, 10)]
    runs = list(token_files.Encoder(WORD_FILE, 1).encode([t.encode() for t in texts]))
    assert len(runs) > 100
    assert np.concatenate([r[0] for r in runs]).tolist() == [i for t in texts for i in [*library_ids(t), 1]]


def brute_documents(rows, path=WORD_FILE):
    """(doc_id, start, n_tokens, crc), texts of one id in any order."""
    tokenizer = library(path)
    out, at = {}, 0
    for doc_id in sorted({i for i, _ in rows}, key=lambda i: (i is None, i)):
        found = []
        for text in [t for i, t in rows if i == doc_id]:
            ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
            found.append((len(ids), zlib.crc32(ids.tobytes())))
        out[doc_id] = (at, sorted(found))
        at += sum(n for n, _ in found)
    return out


def grouped(rows):
    got = {}
    for doc_id, start, n, crc in rows:
        got.setdefault(doc_id, []).append((start, n, crc))
    for found in got.values():  # without gaps, in any order
        found.sort()
        assert all(b[0] == a[0] + a[1] for a, b in zip(found, found[1:], strict=False))
    return {i: (f[0][0], sorted((n, c) for _, n, c in f)) for i, f in got.items()}


@pytest.mark.parametrize("path,length,batch_rows,shard_bytes", [(WORD_FILE, 16, 2, 200), (WORD_FILE, 2048, 4, 1 << 20), (BYTE_FILE, 7, 3, 500)])
def test_files_hold_what_the_library_gives(spark, tmp_path, path, length, batch_rows, shard_bytes):
    rows = dirty("A b  c\nd") + [(i, prose(i, 40)) for i in range(10, 30)] + [(7, f"same id {i}") for i in range(40)] + [(8, prose(3, 2000))]
    folder = (tmp_path / "files").as_uri()
    manifest = token_files.write_token_files(documents(spark, rows), path, folder, 1, length, batch_rows, shard_bytes)
    back = token_files.read_documents(manifest)
    assert back.dtypes == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]
    got = [tuple(r) for r in back.collect()]
    assert len(got) == len(rows)
    assert grouped(got) == brute_documents(rows, path)
    stored = manifest.collect()
    assert (len(stored) > 1) == (shard_bytes < 1000)
    assert sum(r.n_documents for r in stored) == len(rows)
    assert token_files.read_manifest(spark, folder).count() == len(stored)


def test_random_access_copies_nothing(spark, tmp_path):
    rows = [(i, prose(i, 60)) for i in range(30)]
    manifest = token_files.write_token_files(documents(spark, rows), WORD_FILE, tmp_path.as_uri(), length=32, batch_rows=4, shard_bytes=1 << 30)
    (stored,) = manifest.collect()
    want = [i for r in rows for i in [*library_ids(r[1]), 1]]
    file = token_files.SequenceFile(stored.sequences)
    assert len(file) == -(-len(want) // 32) and stored.n_tokens == len(want)
    before = pa.total_allocated_bytes()
    last = None
    for i in reversed(range(len(file))):
        ids, real, ends = file.sequence(i)
        assert not ids.flags.owndata and ids.dtype == np.uint16 and len(ids) == len(real) == len(ends) == 32
        part = want[32 * i : 32 * i + 32]
        assert ids.tolist() == part + [0] * (32 - len(part))
        assert real.to_pylist() == [k < len(part) for k in range(32)]
        last = last or ends.to_pylist()
    assert pa.total_allocated_bytes() - before < 4096  # buffers are in the mapped file
    assert last[len(want) - 1 - 32 * (len(file) - 1)] is True
    assert glob.glob(f"{tmp_path}/*.sequences.arrow")


def test_files_of_empty_table_and_broken_pair(spark, tmp_path):
    empty = spark.createDataFrame([], DOCS)
    manifest = token_files.write_token_files(empty, WORD_FILE, (tmp_path / "none").as_uri())
    assert manifest.count() == 0 and token_files.read_documents(manifest).count() == 0
    one = token_files.write_token_files(documents(spark, [(1, "a b"), (2, "c")]), WORD_FILE, (tmp_path / "a").as_uri(), shard_bytes=1 << 30)
    other = token_files.write_token_files(documents(spark, [(1, "a"), (2, "c d e")]), WORD_FILE, (tmp_path / "b").as_uri(), shard_bytes=1 << 30)
    crossed = one.drop("documents").crossJoin(other.select("documents"))
    with pytest.raises(Exception, match="does not fit"):
        token_files.read_documents(crossed).collect()


def test_invalid_bytes_are_replaced():
    (run,) = list(token_files.Encoder(WORD_FILE, 1).encode([b"ab \xff\xfe c"]))
    assert run[0].tolist() == [*library_ids("ab �� c"), 1]


# -- resampling ---------------------------------------------------------------------------------


def brute_features(text, longest):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def brute_resample(rows, target, longest, buckets, least_words, percent, seed):
    found = [(i, *brute_features(t, longest)) for i, t in rows]
    source, aim = Counter(), Counter()
    for _, _, features in found:
        source.update(f % buckets for f in features)
    for text in target:
        aim.update(f % buckets for f in brute_features(text, longest)[1])
    s, t = sum(source.values()), sum(aim.values())
    gain = [math.floor(1000 * math.log((aim[b] + 1.0) * (t * 0.0 + s + buckets) / ((source[b] + 1.0) * (t + buckets)))) for b in range(buckets)]
    out = []
    for i, n, features in found:
        weight = sum(gain[f % buckets] for f in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[1]))
    drawn = len(able) * percent // 100
    done = [(*[r[k] for k in (0, 2, 3, 4)], place if place <= drawn else None) for place, r in enumerate(able, 1)]
    return done + [(r[0], r[2], r[3], r[4], None) for r in out if r[1] < least_words]


@pytest.mark.parametrize("longest,percent,small", [(1, 10, False), (1, 50, True), (3, 30, True)])
def test_resampling_matches_brute_force(spark, monkeypatch, longest, percent, small):
    if small:  # many runs, segments and pieces of a text
        for name, value in (("RUN_ROWS", 7), ("SEGMENT_ROWS", 5), ("SAMPLES", 64), ("PIECE_BYTES", 40)):
            monkeypatch.setattr(resampling, name, value)
    rows = dirty("Émile was HERE 42 times; a-b_c") + [(i, prose(i, 15 + i % 30)) for i in range(10, 120)] + [(7, prose(5, 30))] * 60 + [(8, prose(1, 3000))]
    target = [prose(11, 500), None, "", "Émile 42"]
    texts = spark.createDataFrame([(t, 1) for t in target], "text string, n int")
    got = resampling.resample(documents(spark, rows), texts, longest, 50, 20, percent, 2024)
    assert got.dtypes == [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")]
    names = ("doc_id", "n_features", "weight", "score", "rank")
    want = sorted(brute_resample(rows, target, longest, 50, 20, percent, 2024), key=lambda t: tuple((v is None, v) for v in t))
    assert rows_of(got, *names) == want
    assert [r[4] for r in want if r[0] == 7 and r[4]] or percent == 10


def test_resampling_of_empty_tables(spark):
    none, text = spark.createDataFrame([], DOCS), spark.createDataFrame([], "text string")
    assert resampling.resample(none, text).count() == 0
    few = documents(spark, [(1, "too few words"), (2, None)])
    assert rows_of(resampling.resample(few, text), "doc_id", "rank") == [(1, None), (2, None)]


def test_equal_rows_are_parted(spark, monkeypatch):
    """A third of the rows agree in everything: no segment may hold them all."""
    monkeypatch.setattr(resampling, "RUN_ROWS", 100)
    rng = random.Random(4)
    data = [(7, 30, 30, 5, 9)] * 1000 + [(i, 30, 30, 5, rng.randint(-20, 20)) for i in range(2000)]
    rows = spark.createDataFrame(data, "doc_id long, n_words long, n_features long, weight long, score long").repartition(7)
    cuts = resampling.splitters(rows, 3000, 16)
    sizes = [r["count"] for r in resampling.with_segments(rows, cuts).groupBy("segment").count().collect()]
    assert len(sizes) == 16 and sum(sizes) == 3000 and max(sizes) < 3 * 3000 / 16


# -- collocations -------------------------------------------------------------------------------


def brute_collocations(rows, longest, least, covered, top):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts.update((lang, *words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    often = {p: a for p, a in counts.items() if a >= least and len(p) > 2}
    inside = {}
    for (lang, *words), a in often.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                part = (lang, *words[i : i + k])
                inside[part] = max(inside.get(part, 0), a)
    best = {}
    for (lang, *words), a in often.items():
        if 100 * inside.get((lang, *words), 0) >= covered * a:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[(lang, *words[:k])], counts[(lang, *words[k:])]
            cuts.append((1000 * a * totals[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        best.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return sorted(
        (lang, rank, p.decode(), -a, left, right, totals[lang], -score)
        for lang, found in best.items()
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)
    )


def phrase_rows(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "of", "NEW", "york", "city", "é", "😀", "a\x1cb", "x-1", "(", "\\", "Of"]
    set_ = ["new york city hall", "new york city", "of the", "é 😀 é 😀"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(set_) if rng.random() < 0.4 else rng.choice(words) for _ in range(rng.randint(0, 30))]
        text = "".join(p + rng.choice([" ", " ", "\t ", ". ", ",", "\n", "\x0b"]) for p in parts)
        rows.append((rng.choice(["en", "en", "de", None, "und", ""]), text))
    return [*rows, ("en", None), ("en", ""), ("xx", None), ("de", " .\n,; ")]


@pytest.mark.parametrize("longest,least,covered,top,small", [(5, 5, 100, 2000, False), (5, 3, 80, 4, True), (3, 8, 100, 10, True), (2, 5, 100, 50, False)])
def test_collocations_match_brute_force(spark, monkeypatch, longest, least, covered, top, small):
    if small:  # pieces of a few words, words numbered anew, a bitmap where most bits are set
        for name, value in (("PIECE_BYTES", 30), ("KNOWN_WORDS", 6), ("MOST_BITS", 64)):
            monkeypatch.setattr(collocations, name, value)
    rows = phrase_rows(longest + least)
    full = [(i if i % 3 else None, t, lang, "s", 0) for i, (lang, t) in enumerate(rows)]
    docs = spark.createDataFrame(full, DOCS).selectExpr("*", "'x' AS prefix", "'x' AS next", "1 AS n", "2 AS a", "'y' AS phrase", "3 AS length")
    got = collocations.collocations(docs, longest, least, covered, top)
    want = brute_collocations(rows, longest, least, covered, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == want
    assert want and {r[0] for r in want} >= {"en", "und"}


def test_collocations_of_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations.collocations(documents(spark, [(1, None), (2, "a b a b")])).count() == 0


def test_scores_beyond_64_bits(spark, monkeypatch):
    big = 6_000_000_000
    counts = [("en", "a", "", "", 1, big), ("en", "b", "", "", 1, big + 1), ("en", "a b", "a", "b", 2, big - 1)]
    counts = spark.createDataFrame(counts, "lang string, phrase string, prefix string, suffix string, length int, a long")
    totals = spark.createDataFrame([("en", 10**13)], "lang string, n long")
    monkeypatch.setattr(collocations, "frequent_phrases", lambda *_: (counts, totals))
    (row,) = collocations.collocations(counts).collect()
    assert row.score == 1000 * (big - 1) * 10**13 // (big * (big + 1))


# -- registered queries -------------------------------------------------------------------------


def test_token_files_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = [tuple(r) for r in QUERIES["op11_token_files"].run(spark, sf_dir).collect()]
    rows = [(r.doc_id, r.text) for r in prepare(spark).read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert grouped(got) == brute_documents(rows)
