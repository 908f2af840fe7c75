"""Quality rules: repetition coverage by rolling hashes, after the published repetition filters for web text.

For several n-gram lengths a polynomial hash of each window of words is rolled in numpy from the hash of the window
one word shorter. The characters of words that lie in a window found twice or more, counted once however many windows
cover them, give the share of the text inside duplicated n-grams; lines are measured alike. A text is rejected when a
share is above its limit. All work is within a document, so nothing is shuffled.

The counts of the base are exact: windows of three words are compared by word numbers, not by hashes.

Defined cases: a null or empty text has no words and fails the base; a text of one very long line has no duplicated
lines; repeated rows each get a verdict; extra columns pass through ``measure``, but for ones named like an output.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm import common


@dataclass(frozen=True)
class Limits:
    """Largest shares of characters allowed inside duplicated n-grams, by n, and of duplicated lines."""

    ngrams: tuple[tuple[int, float], ...] = ((5, 0.15), (6, 0.14), (7, 0.13), (8, 0.12), (9, 0.11), (10, 0.10))
    top_ngrams: tuple[tuple[int, float], ...] = ((2, 0.20), (3, 0.18), (4, 0.16))
    line_share: float = 0.30
    line_characters: float = 0.20
    least_words: int = 50
    most_repeat_percent: int = 50


_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
DOUBLES = ("dup_line_share", "dup_line_chars", "top_ngram_excess", "dup_ngram_excess", "dup_ngram_chars")


def _covered(duplicated: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which words lie in a duplicated window of n words."""
    edge = np.zeros(words + 1, np.int64)
    at = np.flatnonzero(duplicated)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return edge[:-1].cumsum() > 0


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window the number of equal windows; the distinct windows' counts; a place of each distinct one."""
    _, first, back, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    return count[back], count, first


def rolling(numbers: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(n, hashes of all windows of n words) for n from 1 on, each from the one before."""
    with np.errstate(over="ignore"):
        mixed = (numbers.astype(np.uint64) + np.uint64(1)) * _PRIME
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX
        h = mixed
        for n in range(1, longest + 1):
            if n > 1:
                h = h[:-1] * _PRIME + mixed[n - 1 :]
            yield n, h


def measure_text(text: bytes | None, limits: Limits = Limits()) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, shares of ``DOUBLES``)."""
    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if text else np.zeros(256, np.int64)
        return 0, 0, int(counts[_SYMBOLS].sum()), 0, 0, True, False, 0.0, 0.0, 0.0, 0.0, 0.0
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    total = int(len(text) - counts[0x80:0xC0].sum() - counts[32] - counts[9:14].sum())
    symbols = int(counts[_SYMBOLS].sum())
    seen: set[bytes] = set()
    lines = repeated = repeated_chars = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                repeated += 1
                repeated_chars += len("".join(line.decode("utf-8", "replace").split(" ")))
            else:
                seen.add(line)
    numbering: dict[bytes, int] = {}
    numbers = np.fromiter((numbering.setdefault(w, len(numbering)) for w in words), np.int64, n)
    sizes = np.fromiter((len(w.decode("utf-8", "replace")) for w in numbering), np.int64, len(numbering))[numbers]
    vocabulary = len(numbering)
    repeat_words, repeats3 = 0, None
    if n >= 3:
        if vocabulary < 2_000_000:
            keys = (numbers[:-2] * vocabulary + numbers[1:-1]) * vocabulary + numbers[2:]
        else:  # exact in any case: number the pairs first
            _, pair = np.unique(numbers[:-1] * vocabulary + numbers[1:], return_inverse=True)
            _, keys = np.unique(np.stack([pair[:-1], numbers[2:]]), axis=1, return_inverse=True)
        repeats3 = _repeats(keys.ravel())
        repeat_words = int(_covered(repeats3[0] > 1, 3, n).sum())
    base_failed = n < limits.least_words or 100 * repeat_words > limits.most_repeat_percent * n

    top_excess = ngram_excess = ngram_chars = 0.0
    top, dup = dict(limits.top_ngrams), dict(limits.ngrams)
    cumulated = np.concatenate([[0], sizes.cumsum()])
    any_three = repeat_words > 0
    for k, h in rolling(numbers, min(max([*top, *dup]), n)):
        if (k not in top and k not in dup) or (k >= 3 and not any_three):
            continue  # a longer window repeats only if each three words of it do
        each, count, first = _repeats(h)
        if k in top and (most := int(count.max())) > 1:
            tied = first[count == most]
            share = most * int((cumulated[tied + k] - cumulated[tied]).max()) / total
            top_excess = max(top_excess, share / top[k])
        if k in dup:
            share = float(sizes[_covered(each > 1, k, n)].sum() / total)
            ngram_chars = max(ngram_chars, share)
            ngram_excess = max(ngram_excess, share / dup[k])
    line_share, line_chars = repeated / lines, min(1.0, repeated_chars / total)
    kept = not (
        base_failed
        or line_share > limits.line_share
        or line_chars > limits.line_characters
        or top_excess > 1
        or ngram_excess > 1
    )
    return n, total, symbols, repeated, repeat_words, base_failed, kept, line_share, line_chars, top_excess, ngram_excess, ngram_chars


def measure(documents: DataFrame, limits: Limits = Limits(), chunk_bytes: int = 8_000_000) -> DataFrame:
    """``documents`` with the base's counts, the verdicts base_failed and kept, and the shares measured."""
    added = [*LONGS, "base_failed", "kept", *DOUBLES]
    base = documents.drop(*added)
    kinds = [*[T.LongType()] * 5, T.BooleanType(), T.BooleanType(), *[T.DoubleType()] * 5]
    arrow = [*[pa.int64()] * 5, pa.bool_(), pa.bool_(), *[pa.float64()] * 5]
    schema = T.StructType([*base.schema.fields, *(T.StructField(n, k) for n, k in zip(added, kinds))])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in common.chunks(batches, "text", chunk_bytes):
            columns = zip(*(measure_text(t, limits) for t in texts))
            arrays = [pa.array(c, kind) for c, kind in zip(columns, arrow)]
            yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*part.schema.names, *added])

    return base.mapInArrow(measured, schema)


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return measure(documents.select("doc_id", "text")).drop("text")
