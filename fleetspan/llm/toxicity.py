"""Toxicity: misspelled terms by Levenshtein automata over a lexicon trie, scored in their context.

The lexicon is learned: words, and stems of longer words (written with a star), that stand in far more documents labelled toxic than others, beyond
chance over the whole vocabulary, and after many different words (a word that always follows the
same one comes from copies of one passage). The terms form a trie; the automaton of all words
within the allowed edit distance of some term is the trie crossed with edit states, and is made
deterministic step by step as words run through it. Every hit is weighed by its surroundings:
quotation marks and words of reporting lower it, direct address raises it. A word near a term that also
stands in documents labelled clean is no misspelling and does not count. A logistic model turns a
document's hit features into a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspan.llm.common import alnum_words, small_enough
from fleetspan.session import ensure_checkpoint_dir

FIT_ROWS = 20_000  # labelled rows, by hash of their id, that the lexicon and the model are fitted on
LEAST_DOCS = 3  # toxic documents that must hold a term
LEAST_LIFT = 5.0  # times as frequent in toxic documents as in others
LEAST_PLACES = 5  # words after which a term must have been seen, so that a copied passage makes no terms
MOST_TERMS = 2_000  # the size of a lexicon, the most telling terms first
STEMS = (4, 5, 6, 7)  # letters of the stems that are tried
WINDOW = 8  # words on either side of a hit
FOLDS, HELD_OUT = 5, 0

# Marks and words that set a passage apart as reported, and words of address.
QUOTES = "\"“”„«»‹›"
REPORTING = frozenset(
    "said says say called calls calling quote quoted quotes quoting wrote writes term word words insult insults phrase "
    "reported alleged sagte sagt nannte wort dit disait mot cita dijo dice palabra".split()
)
ADDRESS = frozenset("you your youre yourself u ur du dich dir dein deine ihr tu te toi vous votre usted ustedes tú".split())

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FEATURES = ("any", "total", "peak", "density", "reported")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of the id as text modulo FOLDS is HELD_OUT."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def edits_allowed(term: str) -> int:
    if term.endswith("*"):
        return 0 if len(term) < 6 else 1
    return 0 if len(term) < 4 else 1 if len(term) < 8 else 2


class LexiconAutomaton:
    """Accepts all words within the allowed distance of a term, and says which term and distance."""

    def __init__(self, terms: dict[str, float], ordinary: frozenset[str] = frozenset()):
        self.ordinary = ordinary
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.stem: dict[int, str] = {}
        self.room: list[int] = [0]  # the largest distance allowed below a node
        for word in terms:
            node = 0
            for c in word.removesuffix("*"):
                self.room[node] = max(self.room[node], edits_allowed(word))
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.room.append(0)
                node = self.children[node][c]
            self.room[node] = max(self.room[node], edits_allowed(word))
            if word.endswith("*"):
                self.stem[node] = word
            else:
                self.term[node] = word
        self.start = self._closed({0: 0})
        self.steps: dict[tuple, dict[str, tuple]] = {}

    def _closed(self, states: dict[int, int]) -> tuple:
        """Add skipped term letters: node -> least edits, kept as a sorted tuple."""
        todo = list(states.items())
        while todo:
            node, edits = todo.pop()
            if states[node] < edits:
                continue
            for child in self.children[node].values():
                if edits + 1 <= self.room[child] and states.get(child, 99) > edits + 1:
                    states[child] = edits + 1
                    todo.append((child, edits + 1))
        return tuple(sorted(states.items()))

    def _step(self, states: tuple, c: str) -> tuple:
        out: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if edits <= self.room[node] and out.get(node, 99) > edits:
                out[node] = edits

        for node, edits in states:
            reach(node, edits + 1)  # a letter too many
            for letter, child in self.children[node].items():
                reach(child, edits + (letter != c))
        return self._closed(out)

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term or stem and its distance; of equally near ones terms first, then the first in order.

        A stem is met by a word longer than the stem, or than the misspelled stem.
        """
        states, best = self.start, None
        for c in word:
            if self.stem:
                near = [(e, True, self.stem[n]) for n, e in states if n in self.stem and e <= edits_allowed(self.stem[n])]
                best = min([*near, best] if best else near, default=None)
            known = self.steps.setdefault(states, {})
            after = known.get(c)
            if after is None:
                after = known[c] = self._step(states, c)
            states = after
            if not states:
                break
        near = [(e, False, self.term[n]) for n, e in states if self.term[n] is not None and e <= edits_allowed(self.term[n])]
        best = min([*near, best] if best else near, default=None)
        if best is None or best[0] and word in self.ordinary:
            return None
        return best[2], best[0]


def document_features(text: str | None, terms: dict[str, float], automaton: LexiconAutomaton, cache: dict) -> tuple[float, ...]:
    """The values of ``FEATURES`` for a whole text."""
    low = (text or "").translate(_UPPER)
    words = _WORD.findall(low)
    if not words:
        return (0.0,) * len(FEATURES)
    for word in set(words):
        if word not in cache:
            if len(cache) > 300_000:
                cache.clear()
            cache[word] = automaton.match(word)
    hits = [(i, cache[w]) for i, w in enumerate(words) if cache.get(w)] if any(map(cache.get, set(words))) else []
    if not hits:
        return (0.0,) * len(FEATURES)
    spans, places = [m.span() for m in _WORD.finditer(low)], []
    total = reported = 0.0
    for i, (term, edits) in hits:
        near = words[max(0, i - WINDOW) : i + WINDOW + 1]
        quoted = _in_quotes(low, *spans[i]) or any(w in REPORTING for w in words[max(0, i - WINDOW) : i])
        weight = terms[term] * (1.0 if edits == 0 else 0.7 if edits == 1 else 0.5)
        weight *= 0.25 if quoted else 1.5 if any(w in ADDRESS for w in near) else 1.0
        total += weight
        reported += quoted
        places.append((i, weight))
    peak, inside, first = 0.0, 0.0, 0
    for at, weight in places:  # the heaviest run of 4 * WINDOW words
        inside += weight
        while places[first][0] <= at - 4 * WINDOW:
            inside -= places[first][1]
            first += 1
        peak = max(peak, inside)
    return (1.0, log1p(total), log1p(peak), log1p(100 * total / len(words)), reported / len(hits))


def _in_quotes(text: str, start: int, end: int) -> bool:
    """Whether the nearest quotation marks on both sides, within 120 characters and the line, enclose the word."""
    left = text[max(0, start - 120) : start].rpartition("\n")[2]
    right = text[end : end + 120].partition("\n")[0]
    opened = sum(left.count(q) for q in QUOTES)
    return opened % 2 == 1 and any(q in right for q in QUOTES)


@dataclass(frozen=True)
class Model:
    terms: dict[str, float]
    ordinary: frozenset[str]  # words near a term that clean documents hold
    weights: np.ndarray  # of FEATURES, and the constant last

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(features @ self.weights[:-1] + self.weights[-1], -30, 30)))


def learn_terms(texts: DataFrame) -> dict[str, float]:
    """Terms and weights from ``texts`` (text, toxic 0/1), each different text counted once.

    A word's documents are tested against the same share in toxic and other documents (G statistic;
    the limit rises with the vocabulary, so that chance alone yields no term).
    """
    ensure_checkpoint_dir(texts.sparkSession)
    once = texts.groupBy(F.xxhash64("text").alias("k")).agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))
    kept = texts.join(once.select("doc_id"), "doc_id", "left_semi").select("doc_id", "toxic", alnum_words(F.col("text")).alias("words"))
    size = once.agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).first()
    bad, good = int(size["bad"] or 0), size["n"] - int(size["bad"] or 0)
    if not bad or not good:
        return {}
    counts = kept.select("toxic", F.explode(F.array_distinct(_entries(F.col("words")))).alias("word")).groupBy("word").agg(
        F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")
    ).where(F.col("a") >= LEAST_DOCS).checkpoint()
    vocabulary = max(2, counts.count())
    a, b = F.col("a"), F.col("b")
    share = (a + b) / F.lit(bad + good)

    def part(seen: Column, size: int) -> Column:
        return F.when(seen > 0, seen * F.log(seen / (share * size))).otherwise(0.0) + F.when(
            seen < size, (size - seen) * F.log((size - seen) / ((1 - share) * size))
        ).otherwise(0.0)

    lift = (a / bad) / ((b + 0.5) / good)
    told = counts.withColumn("g", 2 * (part(a, bad) + part(b, good))).where((lift >= LEAST_LIFT) & (F.col("g") >= 2 * log(vocabulary) + 14))
    told = told.select("word", "a", "b", "g").checkpoint()
    before = kept.where("toxic = 1").select(
        F.explode(F.transform("words", lambda w, i: F.struct(F.array(w).alias("one"), F.when(i > 0, F.get("words", i - 1)).alias("prev")))).alias("x")
    ).select(F.explode(_entries(F.col("x.one"))).alias("word"), "x.prev")
    before = before.join(F.broadcast(told) if small_enough(told, F.length("word")) else told, "word").select("word", "a", "b", "g", "prev").distinct()
    varied = before.groupBy("word", "a", "b", "g").agg(F.count("prev").alias("places")).where(F.col("places") >= F.least(F.lit(LEAST_PLACES), a))
    order = [F.desc("g"), F.col("word").endswith("*"), F.desc(F.length("word")), "word"]
    rows = varied.orderBy(*order).limit(MOST_TERMS).collect()  # the lexicon
    terms: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: (-r["g"], r["word"].endswith("*"), -len(r["word"]), r["word"])):
        bare = r["word"].removesuffix("*")
        # Words stay beside a stem, as their misspellings are only near the whole word.
        if bare == r["word"] or not any(t.startswith(bare) or t.endswith("*") and bare.startswith(t[:-1]) for t in terms):
            terms[r["word"]] = log((r["a"] / bad) / ((r["b"] + 0.5) / good))
    return terms


def _entries(words: Column) -> Column:
    """The words and, with a star, the stems of those that are longer."""
    stems = [F.transform(F.filter(words, lambda w: F.length(w) > k), lambda w: F.concat(F.substring(w, 1, k), F.lit("*"))) for k in STEMS]
    return F.concat(words, *stems)


def ordinary_words(texts: DataFrame, terms: dict[str, float]) -> frozenset[str]:
    """The words of ``texts`` that are near a term without being one; few, as only near misses are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = LexiconAutomaton(terms)
        for batch in batches:
            found = set()
            for text in batch.column(0):
                found.update(_WORD.findall((text.as_py() or "").translate(_UPPER)))
            near = [w for w in found if (automaton.match(w) or ("", 0))[1]]
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.string())], names=["word"])

    return frozenset(r["word"] for r in texts.select("text").mapInArrow(run, "word string").distinct().collect())


def features_of(docs: DataFrame, terms: dict[str, float], ordinary: frozenset[str], keep: list[str]) -> DataFrame:
    """``keep`` columns and ``features`` (array of doubles) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, cache = LexiconAutomaton(terms, ordinary), {}
        for batch in batches:
            found = [list(document_features(t.as_py(), terms, automaton, cache)) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, pa.list_(pa.float64()))], names=[*keep, "features"])

    wanted = docs.select(*keep, "text")
    schema = ", ".join(f"{n} {t}" for n, t in wanted.dtypes[: len(keep)])
    return wanted.mapInArrow(run, f"{schema}, features array<double>")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Weights and constant by Newton steps with a small ridge."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on the labelled rows outside the held-out fold, ``fit_rows`` of smallest id hash at most.

    The bound makes the ids and the features of the fitting rows small enough for the driver and for
    a broadcast, whatever the table. Several labels of an id: toxic if any is. Rows without id or
    label are not used. No usable label, or only one kind: an empty lexicon and the share of toxic
    rows, or 0, as the score.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).where(~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    ensure_checkpoint_dir(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").checkpoint()
    terms = learn_terms(rows)
    if not terms:
        share = rows.agg(F.avg("toxic").alias("share")).first()["share"] or 0.0
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model({}, frozenset(), np.array([0.0] * len(FEATURES) + [log(share / (1 - share))]))
    ordinary = ordinary_words(rows.where("toxic = 0"), terms)
    fitted = features_of(rows, terms, ordinary, ["toxic"]).collect()  # at most fit_rows
    x = np.array([r["features"] for r in fitted])
    y = np.array([r["toxic"] for r in fitted], float)
    return Model(terms, ordinary, fit_logistic(x, y))


def score_toxicity(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id), score and predicted of every row; null and empty texts score as texts without hits."""
    keep = keep or ["doc_id"]
    weights = model.weights
    found = features_of(docs, model.terms, model.ordinary, keep)
    line = F.aggregate(
        F.arrays_zip(F.col("features"), F.array(*[F.lit(float(w)) for w in weights[:-1]]).alias("w")),
        F.lit(float(weights[-1])),
        lambda total, x: total + x["features"] * x["w"],
    )
    score = 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), line))))
    return found.select(*keep, score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted. See ``learn`` and ``score_toxicity``.

    Rows with repeated ids are scored each by its own text; a null doc_id is not held out and never
    learned from. Empty tables give no rows. Only doc_id, text and doc_id, toxic are read.
    """
    scored = score_toxicity(docs, learn(docs, labels, fit_rows))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def acceptable(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` not predicted toxic, all columns as they were."""
    model = learn(docs, labels, fit_rows)
    terms, ordinary, weights = model.terms, model.ordinary, model.weights
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, cache = LexiconAutomaton(terms, ordinary), {}
        for batch in batches:
            found = np.array([document_features(t.as_py(), terms, automaton, cache) for t in batch.column(at)]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(found @ weights[:-1] + weights[-1] < 0))

    return docs.mapInArrow(run, docs.schema)
