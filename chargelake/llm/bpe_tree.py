"""Byte-level BPE encoding and decoding as a reduction tree over parts of a text."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from hashlib import sha256
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bytebpe import PRE_TOKEN, encoding_of, tiktoken_split
from .util import arrow_map, with_columns_last

#: Characters of a leaf of the encoding tree, ids of a leaf of the decoding tree.
LEAF, DECODE_LEAF = 128, 128
#: Pre-tokens of more characters are joined token by token.
LONG = 64


class Part:
    """``text[start:end]`` encoded by itself: where its pre-tokens start, and the ids of each."""

    __slots__ = ("start", "end", "starts", "ids")

    def __init__(self, start: int, end: int, starts: list[int], ids: list[list[int]]):
        self.start, self.end, self.starts, self.ids = start, end, starts, ids


class Pieces(dict):
    """pre-token -> its ids; emptied when it holds ``limit`` characters."""

    def __init__(self, path: str, limit: int = 4_000_000):
        super().__init__()
        self.encode, self.limit, self.held = encoding_of(path)._encode_single_piece, limit, 0

    def __missing__(self, piece: str) -> list[int]:
        ids = self.encode(piece.encode())
        if len(piece) <= LONG:
            if self.held > self.limit:
                self.clear()
                self.held = 0
            self[piece] = ids
            self.held += len(piece)
        return ids


class TreeEncoder:
    """Encodes texts as a reduction tree: halves recursively, then neighbours joined in pairs."""

    def __init__(self, path: str, leaf: int = LEAF):
        self.leaf, self.pieces, self.table, self.path = leaf, Pieces(path), token_table(path), path
        self.self_encoded: bool | None = None
        self.split = PRE_TOKEN

    def part(self, text: str, start: int, end: int) -> Part:
        if end - start <= self.leaf:
            found = self.split.findall(text, start, end)  # every character is in one match
            return Part(start, end, list(accumulate(map(len, found[:-1]), initial=start)) if found else [], list(map(self.pieces.__getitem__, found)))
        middle = (start + end) // 2
        return self.join(text, self.part(text, start, middle), self.part(text, middle, end))

    def join(self, text: str, left: Part, right: Part) -> Part:
        """Encode the boundary anew in a window that grows, pre-token by pre-token, until nothing outside can change.

        The pattern has no look-behind, so where a pre-token starts the rest of the split depends on the text from there
        only.  All pre-tokens of the left part but its last end before its end, with the character that ended them
        in sight: they stay, unless they begin an apostrophe's three characters that reach over the boundary.  The window
        begins at the last one, or at the first in the last two characters.  It ends where a pre-token of the joined text
        ends at a place where one of the right part starts: from there on both splits are the same.
        """
        starts, ids, known, n = left.starts, left.ids, right.starts, 0
        at = tail = starts.pop()
        last = ids.pop()
        while starts and starts[-1] >= left.end - 2:
            at = starts.pop()
            ids.pop()
        for m in self.split.finditer(text, at, right.end):
            end = m.end()
            while n < len(known) and known[n] < end:
                n += 1
            if end - tail > LONG and m.start() == tail and n == 1 and end == (known[1] if len(known) > 1 else right.end):  # both sides, whole
                piece = self.joined(m.group(), last, right.ids[0])
            else:
                piece = self.pieces[m.group()]
            starts.append(m.start())
            ids.append(piece)
            if end >= right.start and (end == right.end or n < len(known) and known[n] == end):
                break
        starts.extend(known[n:])
        ids.extend(right.ids[n:])
        return Part(left.start, right.end, starts, ids)

    def joined(self, piece: str, left: list[int], right: list[int]) -> list[int]:
        """Ids of a long pre-token from those of its two sides.

        Where every token encodes to itself, ids are the encoding of their bytes if each two neighbours are
        that of theirs.  So the tokens about the boundary are encoded anew, 4, 8, 16, ... on either side, until the pair at
        each end of that window is stable; in each side all pairs are stable already.
        """
        if self.self_encoded is None:
            single = self.pieces.encode
            self.self_encoded = all(single(t) == [i] for i, t in enumerate(self.table) if t)
        if not self.self_encoded:
            return self.pieces.encode(piece.encode())
        width = 4
        while True:
            a, b = max(len(left) - width, 0), min(width, len(right))
            window = self.pieces.encode(b"".join(map(self.table.__getitem__, chain(left[a:], right[:b]))))
            if (a == 0 or self.stable(left[a - 1], window[0])) and (b == len(right) or self.stable(window[-1], right[b])):
                return [*left[:a], *window, *right[b:]]
            width *= 2

    def stable(self, first: int, second: int) -> bool:
        return self.pieces.encode(self.table[first] + self.table[second]) == [first, second]

    def ids(self, text: str) -> list[int]:
        """Texts with characters that tiktoken's engine classes differently are split by its classes."""
        self.split = PRE_TOKEN
        if not text.isascii():
            unlike, pattern = tiktoken_split()
            if not unlike.isdisjoint(text):
                self.split = pattern
        return list(chain.from_iterable(self.part(text, 0, len(text)).ids))


def decode_tree(ids: list[int], token_bytes: list[bytes], leaf: int = DECODE_LEAF) -> bytes:
    """Bytes of ids: concatenation up the same kind of tree (bytes, as a cut may lie inside a character)."""
    if len(ids) <= leaf:
        return b"".join(map(token_bytes.__getitem__, ids))
    half = len(ids) // 2
    return decode_tree(ids[:half], token_bytes, leaf) + decode_tree(ids[half:], token_bytes, leaf)


def token_table(path: str) -> list[bytes]:
    encoding = encoding_of(path)
    table = [b""] * (encoding.max_token_value + 1)
    for token, rank in encoding._mergeable_ranks.items():
        table[rank] = token
    return table


def encode_bpe(docs: DataFrame, ranks_path: str, text: str = "text", leaf: int = LEAF) -> DataFrame:
    """``docs`` with ``token_ids`` array<int>: what the tiktoken library's ``encode_ordinary`` gives.

    One row for each row, no shuffle.  Null or empty text: an empty array.  Very long texts: encoded whole, a level of the
    tree more for each doubling.  Repeated rows, ties and null ids: each row is encoded.  Empty table: no rows.  An input column
    ``token_ids`` is renamed ``in_token_ids``.
    """
    docs = with_columns_last(docs, ["token_ids"])
    names = docs.columns

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = TreeEncoder(ranks_path, leaf)
        for batch in batches:
            ids = pa.array([np.array(tree.ids(s or ""), np.int32) for s in batch.column(text).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*names, "token_ids"])

    return arrow_map(docs, encoded, T.StructType([*docs.schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType()))]))


def decode_bpe(tokens: DataFrame, ranks_path: str, ids: str = "token_ids", leaf: int = DECODE_LEAF) -> DataFrame:
    """``tokens`` with ``decoded`` binary.  Null or empty ids: empty.  An id outside the vocabulary raises.

    Repeated rows and ties: each row is decoded.  Empty table: no rows.  An input column ``decoded`` is renamed.
    """
    tokens = with_columns_last(tokens, ["decoded"])
    names = tokens.columns

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_table(ranks_path)
        for batch in batches:
            out = pa.array([decode_tree(x or [], table, leaf) for x in batch.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*names, "decoded"])

    return arrow_map(tokens, decoded, T.StructType([*tokens.schema.fields, T.StructField("decoded", T.BinaryType())]))


def digest_bpe(docs: DataFrame, ranks_path: str, doc_id: str = "doc_id", text: str = "text", leaf: int = LEAF) -> DataFrame:
    """Encode, decode again and return digests only: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    The same trees as ``encode_bpe`` and ``decode_bpe``, without carrying the arrays through the plan.  Null or empty text: no
    ids, the digests of nothing.  Very long texts whole.  Null ids, ties and repeated rows: one row for each row.  Empty
    table: no rows.  Other columns are dropped.
    """
    schema = docs.select(doc_id).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, table = TreeEncoder(ranks_path, leaf), token_table(ranks_path)
        decimal = [str(i) for i in range(len(table))]
        for batch in batches:
            counts, first, second = array("q"), [], []
            for s in batch.column(text).to_pylist():
                ids = tree.ids(s or "")
                counts.append(len(ids))
                first.append(sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                second.append(sha256(decode_tree(ids, table)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(doc_id), pa.array(counts, pa.int64()), pa.array(first), pa.array(second)],
                [doc_id, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return arrow_map(docs.select(doc_id, text), digested, schema)
