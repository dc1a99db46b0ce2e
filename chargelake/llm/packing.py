"""Order-preserving packing of documents into sequences, by dynamic programming over cut positions."""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytebpe import LibraryClasses, encoding_of
from .util import Scratch, arrow_map

#: What a cut costs, in padding tokens: between documents, between sentences, elsewhere.
DOCUMENT, SENTENCE, INSIDE = 0.0, 4.0, 32.0


def cut_positions(doc_ends: np.ndarray, sentence_ends: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """All places where a window may end, and what each cut costs.

    Where no boundary lies within ``step`` tokens, places every ``step`` tokens are added, so a
    document without sentences can be cut as well.
    """
    places = np.union1d(doc_ends, sentence_ends)
    before = np.concatenate([[0], places[:-1]])
    more = np.maximum((places - before - 1) // step, 0)
    ends = np.cumsum(more)
    nth = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - more, more) + 1
    extra = np.repeat(before, more) + nth * step
    every = np.concatenate([places, extra])
    cost = np.concatenate([np.where(np.isin(places, doc_ends), DOCUMENT, SENTENCE), np.full(len(extra), INSIDE)])
    order = np.argsort(every, kind="stable")
    return every[order], cost[order]


def best_windows(places: np.ndarray, cost: np.ndarray, capacity: int, per_window: float, open_end: bool = False) -> np.ndarray:
    """Ends of the windows that minimise padding plus cut costs.

    best[j] = cost[j] + per_window + min over i of best[i] + padding(places[j] - places[i]), windows of at
    most ``capacity`` tokens.  Padding is capacity minus length, so the minimum is that of
    best[i] + places[i] over a sliding range of i: a monotone queue gives it in constant time.  A window whose
    length is a power of two isn't padded: those few transitions come from a sorted search.  open_end: the last window's
    padding counts nothing, as it will be filled with what follows.
    """
    n = len(places)
    at = np.concatenate([[0], places])
    exact: dict[int, list[int]] = {}
    size = 1
    while size < capacity:
        i = np.searchsorted(at, at - size)
        for j in np.flatnonzero((at[np.minimum(i, n)] == at - size) & (at >= size)):
            exact.setdefault(int(j), []).append(int(i[j]))
        size *= 2
    position, price = at.tolist(), [0.0, *cost.tolist()]
    best, came = [0.0] * (n + 1), [0] * (n + 1)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])  # (best + position, index), both rising
    for j in range(1, n + 1):
        p = position[j]
        while position[queue[0][1]] < p - capacity:
            queue.popleft()
        value, i = queue[0]
        value += capacity - p
        for k in exact.get(j, ()):
            if best[k] < value:
                value, i = best[k], k
        if open_end and j == n:
            value, i = min((best[k], k) for k in range(bisect_left(position, p - capacity), n))
        best[j], came[j] = value + price[j] + per_window, i
        key = best[j] + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    ends, j = [], n
    while j:
        ends.append(position[j])
        j = came[j]
    return np.array(ends[::-1], dtype=np.int64)


class Encoder:
    """Ids of whole texts as the tokenizers library gives them, and where sentences end among them."""

    def __init__(self, path: str):
        self.encoding, self.classes = encoding_of(path), LibraryClasses(path)
        size = self.encoding.max_token_value + 1 + len(self.classes.specials)
        self.closes, self.line, self.opens = np.zeros(size, bool), np.zeros(size, bool), np.zeros(size, bool)
        for token, i in self.encoding._mergeable_ranks.items():
            self.closes[i], self.line[i], self.opens[i] = token[-1:] in b".!?", token[-1:] == b"\n", token[:1].isspace()

    def ids(self, text: str) -> np.ndarray:
        if self.classes.doubtful(text):
            return np.array(self.classes.ids(text), dtype=np.uint32)
        if not any(s in text for s in self.classes.specials):
            return self.encoding.encode_to_numpy(text, disallowed_special=())
        parts = self.classes.split.split(text)  # the odd ones are special tokens
        special = self.classes.tokenizer.token_to_id
        return np.concatenate(
            [np.array([special(p)]) if n % 2 else self.encoding.encode_to_numpy(p, disallowed_special=()) for n, p in enumerate(parts)]
        )

    def sentence_ends(self, ids: np.ndarray) -> np.ndarray:
        """Positions after a closing mark that white space follows, or after a line end."""
        ends = self.line[ids]
        ends[:-1] |= self.closes[ids[:-1]] & self.opens[ids[1:]]
        return np.flatnonzero(ends) + 1


class Block:
    """Pieces of documents in order, until they hold a given number of ids."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        self.clear()

    def clear(self) -> None:
        self.rows: list[tuple] = []  # document, where the piece starts in it, tokens of the whole document
        self.ids: list[np.ndarray] = []
        self.size = 0

    def add(self, row: tuple, ids: np.ndarray) -> None:
        self.rows.append(row)
        self.ids.append(ids)
        self.size += len(ids)

    def packed(self, capacity: int, step: int, per_window: float, open_end: bool) -> tuple[np.ndarray, list[tuple]]:
        """All ids, and the pieces in order: row, begin and end among the ids, start in its document, window, offset in it."""
        ids, row_ends = np.concatenate(self.ids), np.cumsum([len(x) for x in self.ids])
        places, cost = cut_positions(row_ends, self.encoder.sentence_ends(ids), step)
        windows = best_windows(places, cost, capacity, per_window, open_end)
        ends = np.union1d(row_ends, windows)
        starts = np.concatenate([[0], ends[:-1]])
        row = np.searchsorted(row_ends, starts, side="right")
        window = np.searchsorted(windows, starts, side="right")
        row_start, window_start = np.concatenate([[0], row_ends]), np.concatenate([[0], windows])
        first = np.array([r[1] for r in self.rows], dtype=np.int64)
        columns = (row, starts, ends, first[row] + starts - row_start[row], window, starts - window_start[window])
        return ids, list(zip(*(c.tolist() for c in columns), strict=True))


class Packer:
    """Packs rows in their order, ``block_tokens`` or more at a time; the short last window of a block begins the next one."""

    def __init__(self, encoder: Encoder, sequence: int, capacity: int, block_tokens: int, step: int, per_window: float, merged_later: bool):
        self.block, self.sequence, self.block_tokens, self.merged_later = Block(encoder), sequence, block_tokens, merged_later
        self.capacity, self.options = capacity, (capacity, step, per_window)

    def add(self, row: tuple, ids: np.ndarray) -> list[tuple]:
        self.block.add(row, ids)
        return self.closed(False) if self.block.size >= self.block_tokens else []

    def closed(self, last: bool) -> list[tuple]:
        """Pieces as ``document, start, document tokens, ids, sequence, offset, open``.

        open: in a last window that isn't full; at the end of the rows those are left for ``merge``.
        """
        if not self.block.rows:
            return []
        ids, pieces = self.block.packed(*self.options, self.merged_later or not last)
        rows = self.block.rows
        final = pieces[-1][4]
        room = self.capacity - (pieces[-1][5] + pieces[-1][2] - pieces[-1][1])
        out, carried = [], []
        for row, begin, end, start, window, offset in pieces:
            document, _, tokens = rows[row]
            if window == final and room and not last:
                carried.append(((document, start, tokens), ids[begin:end]))
            else:
                out.append((document, start, tokens, ids[begin:end], self.sequence + window, offset, window == final and room > 0))
        self.sequence += final + 1
        self.block.clear()
        for piece in carried:
            self.block.add(*piece)
        return out


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = 2048,
    end_id: int = 1,
    block_tokens: int = 1 << 20,
    step: int = 128,
    per_window: float = 32.0,
    tails: int = 256,
    with_ids: bool = False,
) -> DataFrame:
    """One row for each piece of a document: where it lies in its document and in its sequence.

    A document is its ids (tokenizers library, no added special tokens) and ``end_id``.  Each task packs its
    rows in their order, ``block_tokens`` or more at a time, so memory is bounded; the last window of a block begins the
    next block.  The last window of each task, at most ``capacity`` tokens, is packed again together with those of the
    ``tails`` tasks next to it, by the same dynamic program, so that one sequence of so many tasks may be short and not one of each.
    Only those tails are shuffled.  Sequence ids are the task's number times 2^33 plus a running number, of
    the merged tails -1 - (the group of tasks times 2^33 plus a running number).  Every id lies in exactly one piece.

    Null or empty text: the one id ``end_id``.  Null ids, ties and repeated rows: each row is a document of its own
    (pieces of repeated rows are told apart by sequence_id and offset).  Very long texts are cut.  Empty table: no rows.
    Other columns are dropped.  with_ids adds ``ids`` array<long>, the piece's ids, for writing training files.
    """
    docs = docs.select(doc_id, text)
    fields = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    schema = docs.select(doc_id).schema
    for f in fields.split(", "):
        schema = schema.add(*f.split(" "))
    full = T.StructType([*schema.fields, T.StructField("ids", T.BinaryType()), T.StructField("tail_", T.IntegerType())])
    names = full.names

    def as_batch(pieces: list[tuple], id_type: pa.DataType, task: int | None) -> pa.RecordBatch:
        """The ids go along where they are asked for, and in tails."""
        raw = [p[3].astype("<u4").tobytes() for p in pieces]
        tail = [p[6] and task is not None for p in pieces]
        columns = [
            pa.array([p[0] for p in pieces], id_type), pa.array([p[1] for p in pieces], pa.int64()), pa.array([len(p[3]) for p in pieces], pa.int64()),
            pa.array(map(zlib.crc32, raw), pa.int64()), pa.array([p[2] for p in pieces], pa.int64()),
            pa.array([p[4] for p in pieces], pa.int64()), pa.array([p[5] for p in pieces], pa.int64()),
            pa.array([r if with_ids or t else None for r, t in zip(raw, tail, strict=True)], pa.binary()), pa.array([task if t else None for t in tail], pa.int32()),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        task, id_type = context.partitionId() if context else 0, None
        packer = Packer(encoder := Encoder(tokenizer_path), task << 33, capacity, block_tokens, step, per_window, True)
        for batch in batches:
            id_type, out = batch.column(doc_id).type, []
            for row, s in zip(batch.column(doc_id).to_pylist(), batch.column(text).to_pylist(), strict=True):
                ids = np.append(encoder.ids(s or ""), end_id).astype(np.uint32)
                out += packer.add((row, 0, len(ids)), ids)
            if out:
                yield as_batch(out, id_type, task)
        if packer.block.rows:
            yield as_batch(packer.closed(True), id_type, task)

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        """The tails of neighbouring tasks, in the order of their tasks, as one stream."""
        table = table.sort_by([("tail_", "ascending"), ("offset", "ascending")])
        packer = Packer(Encoder(tokenizer_path), key[0].as_py() << 33, capacity, block_tokens, step, per_window, False)
        out = []
        for row, start, tokens, raw in zip(*(table[c].to_pylist() for c in (doc_id, "start", "doc_tokens", "ids")), strict=True):
            out += packer.add((row, start, tokens), np.frombuffer(raw, "<u4").astype(np.uint32))
        out += packer.closed(True)
        out = [(*p[:4], -1 - p[4], *p[5:]) for p in out]
        return pa.Table.from_batches([as_batch(out, table[doc_id].type, None)])

    pieces = Scratch(docs.sparkSession).save(arrow_map(docs, packed, full))
    tail = pieces.filter("tail_ is not null").withColumn("group_", F.floor(F.col("tail_") / tails))
    tail = tail.groupBy("group_").applyInArrow(merged, full)
    out = pieces.filter("tail_ is null").unionByName(tail).drop("tail_")
    return out.withColumn("ids", ids_of(F.col("ids"))) if with_ids else out.drop("ids")


def ids_of(raw: Column) -> Column:
    """Little-endian unsigned 32-bit numbers as an array of long."""
    digits = F.hex(raw)
    byte = lambda i, k: F.conv(F.substring(digits, i * 8 + 2 * k + 1, 2), 16, 10).cast("long")
    number = lambda i: sum((byte(i, k) * F.lit(256**k) for k in range(1, 4)), byte(i, 0))
    count = (F.length(raw) / 4).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), number)).otherwise(F.array().cast("array<bigint>"))
