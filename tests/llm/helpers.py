"""Inputs that every operator has to bear."""

from __future__ import annotations

import random

# Columns an operator may use inside, given as extra columns of the input.
CLASHING = ["words", "n", "n_words", "key", "component", "kept", "size", "offset", "score", "portion", "role", "slice", "hash", "marks"]

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra=True):
    """``rows``: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    return df.selectExpr("*", *[f"'x' AS {c}" for c in CLASHING]) if extra else df


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(vocabulary)]
    return " ".join(rng.choice(words) for _ in range(n))


def dirty(text):
    """One text in all the odd company: null, empty, white, repeated rows, a repeated id, no id."""
    return [(1, text), (2, None), (3, ""), (4, " \t\n"), (5, text), (5, text), (6, "other"), (6, text), (None, text), (None, None)]


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda t: tuple((v is None, v) for v in t))
