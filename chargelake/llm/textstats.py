"""Counts that describe a text as a whole; used by the quality operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .util import arrow_map

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_exclaim", "n_lines"]


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1].astype(np.int64)
    windows, counts = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)[1:]
    twice = counts[windows] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= twice
    return int(covered.sum())


def counts_of(text: str) -> tuple[int, ...]:
    words = text.encode().split()  # bytes split at space and \x09-\x0D only
    lines = [s for s in text.split("\n") if s.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        sum(len(w) for w in text.split() if w.isupper()),
        sum(map(text.count, "0123456789")),
        text.count("!"),
        len(lines),
    )


def text_statistics(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with the columns COUNTS (long); null text counts as empty.  No shuffle.

    The text itself is only kept with ``keep_text``.
    """
    kept = [c for c in docs.columns if keep_text or c != text]
    schema = docs.select(*kept).schema
    for c in COUNTS:
        schema = schema.add(c, "long")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [counts_of(s or "") for s in batch.column(text).to_pylist()]
            found = np.array(rows, dtype=np.int64).reshape(len(rows), len(COUNTS))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), *(pa.array(found[:, i]) for i in range(len(COUNTS)))], [*kept, *COUNTS]
            )

    return arrow_map(docs, counted, schema)
