"""Token counts with the whole-token shortcut."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import PRE_TOKEN, LibraryClasses, chunks_of, encoding_of, prove_single_tokens
from .util import arrow_map, with_columns_last


class ChunkCounts(dict):
    """chunk -> number of tokens.  Emptied when it holds ``limit`` characters; chunks over ``longest`` aren't kept."""

    def __init__(self, path: str, singles: set[str], limit: int = 8_000_000, longest: int = 64):
        super().__init__()
        self.merge, self.singles, self.limit, self.longest, self.held = encoding_of(path)._encode_single_piece, singles, limit, longest, 0

    def __missing__(self, chunk: str) -> int:
        """Pre-tokens that are proved single count 1; only the others are merged."""
        n = sum(1 if p in self.singles else len(self.merge(p.encode())) for p in PRE_TOKEN.findall(chunk))
        if len(chunk) <= self.longest:
            if self.held >= self.limit:
                self.clear()
                self.held = 0
            self[chunk] = n
            self.held += len(chunk)
        return n

    def text(self, text: str) -> int:
        return sum(map(self.__getitem__, chunks_of(text)))


def count_tokens(
    docs: DataFrame, tokenizer_path: str, text: str = "text", limit: int = 1024, keep: list[str] | None = None
) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit``; no shuffle, one row for each row.

    The counts are those of the tokenizers library's ``Tokenizer.from_file(tokenizer_path)`` without begin
    and end tokens; strings of special tokens inside a text count as that token, as there.
    The set of proved vocabulary strings is made once on the driver and broadcast: its size is bounded by
    the vocabulary.  Null text: empty, 0 tokens.  Very long texts are counted whole.  Repeated rows, ties and null ids: each row has its own count.
    Empty table: no rows.  Columns named like the results are renamed ``in_<name>``.

    tokenizer_path: must be readable at this path on every executor.
    keep: the other columns to return (all).
    """
    added = ["n_bytes", "n_tokens", "over_limit"]
    docs = with_columns_last(docs.select(*dict.fromkeys([*(docs.columns if keep is None else keep), text])), added)
    kept = [c for c in docs.columns if c != text or keep is None or text in keep]
    singles = docs.sparkSession.sparkContext.broadcast(prove_single_tokens(tokenizer_path))
    out = docs.select(*kept).schema.add("n_bytes", "long").add("n_tokens", "long")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, chunks = LibraryClasses(tokenizer_path), ChunkCounts(tokenizer_path, singles.value)

        def tokens(s: str) -> int:
            if classes.doubtful(s):
                return len(classes.ids(s))
            parts = classes.split.split(s)  # the odd ones are special tokens
            return len(parts) // 2 + sum(map(chunks.text, parts[::2]))

        for batch in batches:
            texts = [s or "" for s in batch.column(text).to_pylist()]
            columns = [batch.column(c) for c in kept]
            columns.append(pa.array([len(s.encode()) for s in texts], pa.int64()))
            columns.append(pa.array(map(tokens, texts), pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, [*kept, "n_bytes", "n_tokens"])

    return arrow_map(docs, counted, out).withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
