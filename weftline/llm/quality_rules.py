"""Operator 6, quality rules by repetition coverage.

Every whole text is split into words (runs of anything but ASCII white space). Word numbers of the text are combined
into rolling hashes of n-grams in numpy; the characters inside n-grams that occur twice or more, and inside repeated
lines, are measured as shares of all characters. The published repetition limits of Rae et al. (2021) decide.

Nulls and empty texts have no words and fail the base rules; ties and repeated rows are judged row by row, each alike;
an empty table gives an empty result; other columns of the input pass through, but columns that the result itself
names are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, unused

# The largest allowed share of characters in repeated n-grams by n, in the most frequent n-gram by n,
# and in repeated lines; the base rules' symbols and limits.
REPEATED_NGRAM = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
TOP_NGRAM = {2: 0.20, 3: 0.18, 4: 0.16}
REPEATED_LINE_CHARS = 0.20
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: An odd multiplier for the rolling hash, and one that spreads word numbers over 64 bits.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, top_share double, repeat_share double, dup_line_share double, failed_rule string"
)
_WHITE = " \t\n\x0b\x0c\r"


def _rolling(codes: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of every window of n word codes, modulo 2**64."""
    out = np.zeros(len(codes) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = out * _BASE + codes[i : len(codes) - n + 1 + i]
    return out


def _repeated(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whether each window occurs twice or more, and is not the first; the windows' groups and the groups' counts."""
    _, first, inverse, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    dup = counts[inverse] > 1
    later = dup.copy()
    later[first] = False
    return dup, later, inverse, counts


def _covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Words that lie in a marked window of n words."""
    edge = np.zeros(total + 1, dtype=np.int64)
    at = np.flatnonzero(starts)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: str | None) -> tuple:
    """All counts and the verdict for one text, in the order of SCHEMA."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    total = len(words)
    chars = len(text) - sum(map(text.count, _WHITE))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    dup_lines = dup_line_chars = 0
    for line in text.split("\n"):
        if line.strip(_WHITE):
            if line in seen:
                dup_lines += 1
                dup_line_chars += len(line) - sum(map(line.count, _WHITE))
            else:
                seen.add(line)
    repeat_words, top, repeat, failed = 0, 0.0, 0.0, None
    if total >= 2:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.uint64, count=total)
        if len(number) < total:  # else nothing repeats
            codes = (ids + np.uint64(1)) * _SPREAD
            codes ^= codes >> np.uint64(29)
            length = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in words), dtype=np.int64, count=total)
            for n, limit in REPEATED_NGRAM.items():
                if total < n:
                    break
                dup, later, _, _ = _repeated(_rolling(codes, n))
                if not dup.any():
                    break  # longer windows cannot repeat either
                if n == 5:
                    repeat_words = int(_covered(dup, n, total).sum())
                share = float(length[_covered(later, n, total)].sum()) / chars
                repeat = max(repeat, share)
                if share > limit and not failed:
                    failed = f"repeated_{n}gram"
            before = np.concatenate(([0], np.cumsum(length)))
            for n, limit in TOP_NGRAM.items():
                if total < n:
                    break
                dup, _, inverse, counts = _repeated(_rolling(codes, n))
                if not dup.any():
                    break
                # of the most frequent windows, the one with most characters
                size = before[n:] - before[: total - n + 1]
                most = counts.max()
                share = float(size[counts[inverse] == most].max() * most) / chars
                top = max(top, share)
                if share > limit and not failed:
                    failed = f"top_{n}gram"
    line_share = dup_line_chars / chars if chars else 0.0
    if line_share > REPEATED_LINE_CHARS and not failed:
        failed = "repeated_lines"
    base = total < MIN_WORDS or 100 * repeat_words > MAX_REPEAT_PERCENT * total
    return total, chars, symbols, dup_lines, repeat_words, base, not base and failed is None, top, repeat, line_share, failed


def _measure(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for texts in parts:
        yield pd.DataFrame([measure(t) for t in texts], columns=names)


def quality_measures(text: Column) -> Column:
    """The struct of counts, shares and verdict of a text column."""
    return F.pandas_udf(_measure, SCHEMA)(text)


def with_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns of SCHEMA; columns of those names in docs are replaced."""
    own = {x.split()[0] for x in SCHEMA.split(", ")}
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in own]
    small_batches(docs.sparkSession)
    (made,) = unused(docs, "quality")
    judged = docs.select(*rest, quality_measures(F.col(f"`{text}`")).alias(made))
    return judged.select(*rest, f"{made}.*")


def filter_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that are kept, with their own columns only."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    small_batches(docs.sparkSession)
    (made,) = unused(docs, "quality")
    return docs.select(*columns, quality_measures(F.col(f"`{text}`")).alias(made)).where(f"{made}.kept").select(*columns)
