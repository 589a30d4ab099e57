"""Secret scans: fixed patterns, and values in credential contexts judged by their guess cost.

The cost of a value is the least, over all its segmentations, of the summed costs (log10 of
guesses) of its segments: a known word by its rank, a date, a repeat of a shorter unit, a walk over
the keyboard or the alphabet, or brute force. A value that would take too many guesses to be a
placeholder is a secret. Words are known from a short fixed list of what is guessed first, and from
the texts themselves: the words that most of them hold, counted by Spark and ranked.

A repeat or walk is not begun inside a longer one of the same kind where beginning earlier cannot be
dearer, so long runs of one pattern cost a pass and not a pass per character.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import log10

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspan.llm.common import ascii_lower

# The base patterns, the shortest match (of group 2 for assign), in order of kinds.
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

# Wider contexts, whose values are judged by cost: a name that holds a keyword, a separator, a value.
ASSIGNED = re.compile(
    r"""(?<![A-Za-z0-9_.-])([A-Za-z0-9_.-]++)["'`]?[ \t]*+[:=]>?[ \t]*+(?:\r?\n[ \t]++)?(?:(?i:bearer|basic)[ \t]++)?(["'`]?)"""
)
URL_LOGIN = re.compile(r"://[^\s/:@]*+:([^\s/@]{6,}+)@")  # scheme://user:value@host
KEYWORD = re.compile(  # long ones anywhere in a name, but not in words like secretary; short ones as a part of it (dbPass, DB_PASS)
    r"""(?i:password|passwd|passphrase|pwd|credential|(?:api|access|private)[_.-]?key|secret(?!ar|ion|ive|ly)|token(?!i[sz]))"""
    r"""|(?:(?<![A-Za-z])(?i:pass|passcode)|(?<=[a-z])Pass(?:[Cc]ode)?|(?<=[a-z])PASS)(?:(?![A-Za-z])|(?<=[a-z])(?=[A-Z]))"""
    r"""|(?<![A-Za-z])(?i:authorization)(?![A-Za-z])"""
    r"""|(?:(?<![A-Za-z])(?i:o?auth)|(?<=[a-z])(?:O?Auth|AUTH))(?!(?i:or|en))"""
)
VALUE = re.compile(r"""[^\s"'`,;<>\[\](){}]{6,}""")
QUOTED = {q: re.compile(rf"[^{q}\n]{{6,}}+(?={q})") for q in "\"'`"}  # up to the closing mark on the line
CONTEXT_HINTS = (b"pass", b"pwd", b"secret", b"token", b"key", b"auth", b"credential", b"://")
LEAST_COST = 8.0  # log10 of guesses

# Words by how early they are guessed, and rows of keys.
WORDS = (
    "password 123456 qwerty letmein admin welcome monkey dragon master login princess football shadow sunshine iloveyou "
    "trustno1 baseball superman michael hello freedom whatever secret pass test guest root user default changeme example "
    "summer winter spring autumn love money computer internet server access token key private public data value null none "
    "true false your here insert enter placeholder sample demo temp abc"
).split()
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz", "qwertzuiop", "azertyuiop")
RANKS = {w: i + 1 for i, w in enumerate(WORDS)}
LONGEST_WORD = 24
LONGEST_UNIT = 64  # of a repeat
MOST_WORDS = 50_000  # ranked words: what bounds the list that tasks get
LEAST_TEXTS = 20  # texts that must hold a word for it to be known
_NEXT = {a + b for row in KEY_ROWS for a, b in zip(row, row[1:], strict=False)}
_NEXT |= {p[::-1] for p in _NEXT}
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?\d\d")
JOIN_COST = 0.3


def _brute(c: str) -> float:
    return 1.0 if c.isdigit() else log10(26) if c.isascii() and c.islower() else log10(62)


def guess_cost(value: str, ranks: dict[str, int] = RANKS, enough: float = float("inf")) -> float:
    """log10 of the guesses for the cheapest segmentation of the whole value; 0 for the empty one.

    Costs from ``enough`` on are not told apart: the result is then ``enough`` or more.
    """
    low, n = value.lower(), len(value)
    if len(low) != n:
        low = value
    best = [0.0] + [float("inf")] * n
    longest = min(LONGEST_UNIT, n // 2)
    since = [0] * (longest + 1)  # by unit: where the stretch that repeats with this period begins
    walk = 0  # where the walk that passes here begins

    def reach(j: int, cost: float) -> None:
        if cost < best[j]:
            best[j] = cost

    for i in range(n):
        for u in range(1, longest + 1):
            if i and (i - 1 + u >= n or low[i - 1] != low[i - 1 + u]):
                since[u] = i
        if low[i - 1 : i + 1] not in _NEXT:
            walk = i
        if best[i] >= enough:
            continue
        here = best[i] + (JOIN_COST if i else 0.0)
        reach(i + 1, best[i] + _brute(value[i]))
        for j in range(i + 2, min(n, i + LONGEST_WORD) + 1):
            rank = ranks.get(low[i:j])
            if rank:
                shape = 0.0 if value[i:j] == low[i:j] else log10(2) if value[i:j].istitle() or value[i:j].isupper() else (j - i) * log10(2)
                reach(j, here + log10(rank) + shape)
        found = _DATE.match(value, i)
        if found:
            for j in {found.end(), i + 4}:
                if j <= found.end():
                    reach(j, here + (log10(120) if j - i <= 4 else log10(365 * 120)))
        units, first, shorter = 0.0, low[i], []
        for u in range(1, min(longest, (n - i) // 2) + 1):
            units += _brute(value[i + u - 1])
            if low[i + u] != first or low[i : i + u] != low[i + u : i + 2 * u]:
                continue
            if any(u % v == 0 and low[i : i + u] == low[i : i + v] * (u // v) for v in shorter):
                continue  # as a repeat of the shorter unit it takes fewer guesses
            shorter.append(u)
            back = (i - since[u]) // u  # so many units earlier the same repeat could begin
            if not back or best[i - back * u] + log10((back + 2) / 2) > best[i]:
                unit, j = low[i : i + u], i + u
                while low.startswith(unit, j):
                    j += u
                    reach(j, here + units + log10((j - i) // u))
            if low[i : i + 2 * longest - u] == low[i + u : i + 2 * longest]:
                break  # every other unit that repeats here is made of this one
        if i == walk or best[walk] + log10((i - walk + 3) / 3) > best[i]:
            j = i + 1
            while j < n and low[j - 1 : j + 1] in _NEXT:
                j += 1
                if j - i >= 3:
                    reach(j, here + log10(40) + log10(2 * (j - i)))
    return best[n]


def known_words(docs: DataFrame, most: int = MOST_WORDS, least_texts: int = LEAST_TEXTS) -> dict[str, int]:
    """Ranks of the fixed words, and after them of the ``most`` words that most texts hold.

    Words are runs of a to z of 3 to ``LONGEST_WORD`` letters, A-Z lower-cased; one that fewer than ``least_texts``
    texts hold is not known. Counting covers all texts; only the ranked list comes to the driver.
    """
    words = F.array_distinct(F.split(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), "[^a-z]+"))
    counts = docs.select(F.explode(words).alias("word")).where(F.length("word").between(3, LONGEST_WORD)).groupBy("word").agg(F.count("*").alias("n"))
    ranked = counts.where(F.col("n") >= least_texts).orderBy(F.desc("n"), "word").limit(most).collect()
    ranks = dict(RANKS)
    for r in ranked:
        ranks.setdefault(r["word"], len(ranks) + 1)
    return ranks


def base_spans(text: str, raw: bytes, low: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind number); ``raw`` and ``low`` are the text's bytes, only to skip what cannot match."""
    spans = []
    if any(k in low for k in KEYWORDS):
        spans += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if b"AKIA" in raw:
        spans += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    if b"x" * HEX_LEAST in raw.translate(_HEX_CLASS):
        spans += [(m.start(), m.end(), 2) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_LEAST]
    return spans


_HEX_CLASS = bytes(ord("x") if chr(b) in "0123456789abcdef" else ord("-") for b in range(256))


def find_secrets(text: str, least_cost: float = LEAST_COST, ranks: dict[str, int] = RANKS) -> list[tuple[int, int, int]]:
    """All spans, sorted by start, then kind; guessed ones unless one base span holds the whole value."""
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    spans = base_spans(text, raw, low)
    if any(h in low for h in CONTEXT_HINTS):
        taken = [(a, b) for a, b, _ in spans]
        done = 0
        for a, b in sorted(_contexts(text)):
            if a >= done and not any(x <= a and b <= y for x, y in taken) and guess_cost(text[a:b], ranks, least_cost) >= least_cost:
                spans.append((a, b, 3))
                done = b
    return sorted(spans, key=lambda s: (s[0], s[2], s[1]))


def _contexts(text: str) -> Iterator[tuple[int, int]]:
    """Where the values stand that a credential's name, or a login in a url, leads to."""
    for m in ASSIGNED.finditer(text):
        if KEYWORD.search(m[1]):
            value = (QUOTED[m[2]].match(text, m.end()) if m[2] else None) or VALUE.match(text, m.end())
            if value:
                yield value.span()
    for m in URL_LOGIN.finditer(text):
        yield m.span(1)


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan_secrets(docs: DataFrame, least_cost: float = LEAST_COST, ranks: dict[str, int] | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans count code points, ends exclusive. Null and empty texts have none. Rows with repeated or
    null ids are rows like any other. Only doc_id and text are read. ``ranks``: see ``known_words``, which
    is the default.
    """
    ranks = known_words(docs) if ranks is None else ranks
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, written = ([], [], []), [], []
            for text in batch.column(1):
                spans = find_secrets(text.as_py() or "", least_cost, ranks)
                base = [s for s in spans if s[2] < 3]
                for kind in range(3):
                    counts[kind].append(sum(s[2] == kind for s in base))
                digests.append(hashlib.sha256(_written(base).encode()).hexdigest())
                written.append(_written(spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(written, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def redacted(text: str, least_cost: float = LEAST_COST, ranks: dict[str, int] = RANKS) -> str:
    """The text with every secret replaced by its kind in brackets; overlapping spans become one."""
    out, done = [], 0
    for start, end, kind in find_secrets(text, least_cost, ranks):
        if start >= done:
            out += [text[done:start], f"[{KINDS[kind]}]"]
        done = max(done, end)
    return "".join(out) + text[done:]


def redact_documents(docs: DataFrame, least_cost: float = LEAST_COST, ranks: dict[str, int] | None = None) -> DataFrame:
    """``docs`` with secrets redacted in text; n_chars, where there is such a column, counted anew for changed texts.

    All rows and columns stay, null texts stay null. ``ranks``: see ``known_words``, which is the default.
    """
    ranks = known_words(docs) if ranks is None else ranks
    at = docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [None if t is None else redacted(t, least_cost, ranks) for t in old]
            columns = list(batch.columns)
            columns[at] = pa.array(new, columns[at].type)
            if count is not None:
                sizes = columns[count].to_pylist()
                columns[count] = pa.array([n if o == t else len(t) for o, t, n in zip(old, new, sizes, strict=True)], columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
