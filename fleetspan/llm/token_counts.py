"""Token counts by prefix dynamic programming over a byte-pair vocabulary with word ends.

A text is normalised and split into pieces by the tokenizer's own rules. Pieces are tokenized
independently, so the counts at all piece ends are a running sum. Inside a piece the dynamic
program keeps, for every prefix, the last token of its encoding: a token t that ends at i is the
last one exactly if the last token before it, p, and t are what the merges make of p + t, and then
the count at i is the count before t plus one. Any truncation or budget question is answered from
these counts: a cut between pieces by the sum, a cut inside a piece by its table.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2048
CACHE_PIECES = 500_000  # pieces whose count a task remembers; beyond, it starts over

# Texts of these characters only (ASCII, Latin letters, common punctuation) split alike with the standard
# library's expressions, chunk by chunk between white space; all others go through the tokenizer's own rules.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡§«»¿À-ÖØ-öø-įıĲ-ňŊ-ž‐-‧‰€]*")
_PIECES = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ž]+|[0-9]|[^\sa-z0-9ß-öø-ž]+")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself if printable, else the next from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in own}
    for i, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + i)
    return letters


class PrefixTokenizer:
    """Counts for a tokenizer file whose model is BPE with an end-of-word suffix over byte letters."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab = model["vocab"]
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.tails = self._tails()
        self.letters = byte_letters()
        self.library = Tokenizer.from_file(path)
        # White space is in no piece, so it need not be normalised.
        self.normalize = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str
        specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, specials)) + ")")
        self.special_hints = tuple(specials)
        self.fits: dict[tuple[str, str], bool] = {}
        self.counts: dict[str, int] = {}
        self.chunks: dict[str, int] = {}

    def _tails(self) -> tuple[dict, dict]:
        """Two tries of the tokens read backwards, inside words and at their ends; "" marks a token."""
        inside, closing = {}, {}
        for token in self.vocab:
            ends = token.endswith(self.end) and len(token) > len(self.end)
            node = closing if ends else inside
            for c in reversed(token[: -len(self.end)] if ends else token):
                node = node.setdefault(c, {})
            node[""] = token
        return inside, closing

    # -- inside a piece ---------------------------------------------------------------------

    def merged(self, symbols: list[str]) -> list[str]:
        """What the merges make of a list of symbols."""
        while len(symbols) > 1:
            ranks = [self.rank.get(p, 1 << 30) for p in zip(symbols, symbols[1:], strict=False)]
            low = min(ranks)
            if low == 1 << 30:
                break
            out, i = [], 0
            while i < len(symbols):
                if i < len(ranks) and ranks[i] == low:
                    out.append(symbols[i] + symbols[i + 1])
                    i += 2
                    # the same pair may start again only after both symbols
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def symbols(self, token: str) -> list[str]:
        if token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def follows(self, before: str, token: str) -> bool:
        """Whether ``before`` and ``token``, next to each other, stay two tokens; "" is the start."""
        key = (before, token)
        known = self.fits.get(key)
        if known is None:
            known = self.merged([*self.symbols(before), *self.symbols(token)]) == ([before, token] if before else [token])
            self.fits[key] = known
        return known

    def _last(self, word: str, end: int, last: list[str], node: dict) -> tuple[str, int]:
        """The token that ends the encoding of ``word[:end]``, and where it begins."""
        fits, found = self.fits, []
        for j in range(end - 1, -1, -1):
            node = node.get(word[j])
            if node is None:
                break
            token = node.get("")
            if token is not None:
                known = fits.get((last[j], token))
                if known:
                    return token, j
                if known is None:
                    found.append((j, token))
        for j, token in reversed(found):
            if self.follows(last[j], token):
                return token, j
        raise ValueError(f"no encoding of {word[:end]!r}")

    def open_prefixes(self, word: str) -> tuple[list[str], list[int]]:
        """For every prefix of the byte letters, not ending the word: last token and count."""
        last, count, inside = [""], [0], self.tails[0]
        for i in range(1, len(word)):
            token, j = self._last(word, i, last, inside)
            last.append(token)
            count.append(count[j] + 1)
        return last, count

    def closed(self, word: str, end: int, last: list[str], count: list[int]) -> int:
        """Tokens of ``word[:end]`` as a whole word."""
        return count[self._last(word, end, last, self.tails[1])[1]] + 1

    def spelled(self, piece: str) -> str:
        return "".join(map(self.letters.__getitem__, piece.encode("utf-8")))

    def count_piece(self, piece: str) -> int:
        known = self.counts.get(piece)
        if known is None:
            word = self.spelled(piece)
            known = self.closed(word, len(word), *self.open_prefixes(word))
            if len(self.counts) >= CACHE_PIECES:
                self.counts.clear()
                self.fits.clear()
            self.counts[piece] = known
        return known

    def piece_table(self, piece: str) -> list[int]:
        """Tokens of the piece cut after 0, 1, ... code points."""
        word = self.spelled(piece)
        last, count = self.open_prefixes(word)
        out, at = [0], 0
        for c in piece:
            at += len(c.encode("utf-8"))
            out.append(self.closed(word, at, last, count))
        return out

    def count_chunk(self, chunk: str) -> int:
        """Tokens of a plain chunk without white space."""
        total = sum(map(self.count_piece, _PIECES.findall(chunk)))
        if len(self.chunks) >= CACHE_PIECES:
            self.chunks.clear()
        self.chunks[chunk] = total
        return total

    # -- over a text --------------------------------------------------------------------------

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """Normalised stretches between special strings, and the special strings (True)."""
        parts = self.special.split(text) if any(s in text for s in self.special_hints) else [text]
        for i, part in enumerate(parts):
            if part:
                yield (part, True) if i % 2 else (part.lower() if _PLAIN.fullmatch(part) else self.normalize(part), False)

    def piece_spans(self, segment: str) -> Iterator[tuple[int, int]]:
        if _PLAIN.fullmatch(segment):
            return (m.span() for m in _PIECES.finditer(segment))
        return (span for _, span in self.library.pre_tokenizer.pre_tokenize_str(segment))

    def count(self, text: str) -> int:
        total, chunks = 0, self.chunks
        for segment, special in self.segments(text):
            if special:
                total += 1
            elif _PLAIN.fullmatch(segment):
                for chunk in segment.split():
                    known = chunks.get(chunk)
                    total += self.count_chunk(chunk) if known is None else known
            else:
                total += sum(self.count_piece(segment[a:b]) for a, b in self.piece_spans(segment))
        return total

    def fit(self, text: str, budget: int) -> int:
        """The most code points of the normalised text whose tokens stay within ``budget``."""
        return PrefixCounts(self, text, budget).fit(budget)

    def prefix_counts(self, text: str) -> PrefixCounts:
        return PrefixCounts(self, text)


class PrefixCounts:
    """Exact counts at every prefix of a normalised text; with ``budget``, no further than that needs."""

    def __init__(self, tokenizer: PrefixTokenizer, text: str, budget: int | None = None):
        self.tokenizer = tokenizer
        self.starts, self.ends, self.upto, self.whole = [], [], [0], []
        parts, base = [], 0
        for segment, special in tokenizer.segments(text):
            for a, b in [(0, len(segment))] if special else tokenizer.piece_spans(segment):
                self.starts.append(base + a)
                self.ends.append(base + b)
                self.whole.append(special)
                self.upto.append(self.upto[-1] + (1 if special else tokenizer.count_piece(segment[a:b])))
                if budget is not None and self.upto[-1] > budget:
                    break
            parts.append(segment)
            base += len(segment)
        self.text = "".join(parts)
        self.total = self.upto[-1]

    def _inside(self, i: int) -> list[int]:
        piece = self.text[self.starts[i] : self.ends[i]]
        if self.whole[i]:  # a special string cut short is ordinary text
            return [self.tokenizer.count(piece[:k]) for k in range(len(piece))] + [1]
        return self.tokenizer.piece_table(piece)

    def at(self, chars: int) -> int:
        """Tokens of the first ``chars`` code points."""
        i = bisect_right(self.ends, chars)
        if i == len(self.ends) or chars <= self.starts[i]:
            return self.upto[i]
        return self.upto[i] + self._inside(i)[chars - self.starts[i]]

    def fit(self, budget: int) -> int:
        """The most code points whose tokens stay within ``budget``."""
        i = bisect_right(self.upto, budget) - 1
        if i >= len(self.ends):
            return len(self.text)
        inside = self._inside(i)
        return max((self.starts[i] + k for k in range(len(inside)) if self.upto[i] + inside[k] <= budget), default=self.starts[i])


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit, fit_chars.

    n_tokens is what the library of the file counts for the whole text, without tokens of its own
    at begin or end; its special strings inside a text are one token each. fit_chars: how many
    code points of the normalised text fit ``limit`` tokens, null unless over_limit. Null
    texts are empty. Rows with repeated or null ids are rows like any other. Only doc_id and text
    are read; every worker opens ``tokenizer_path``.
    """
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = PrefixTokenizer(tokenizer_path)
        for batch in batches:
            sizes, counts, fits = [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                sizes.append(len(text.encode("utf-8")))
                counts.append(tokenizer.count(text))
                fits.append(tokenizer.fit(text, limit) if counts[-1] > limit else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts]), pa.array(fits, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
