"""Katz backoff language model over words: Good-Turing discounts, exactly normalised backoff weights.

Texts are cut into *batches* of about a million tokens.  A batch asks for what it needs of a count table
by sending its distinct keys, sorted, to the key ranges (*buckets*) of that table; each bucket adds up the
counts of all batches and answers each batch in the order of its own keys.  So every distinct key
travels once per batch and not once per occurrence, frequent words are summed before the shuffle, and no task holds
more than one batch or one bucket.  An n-gram can be in another batch only if its first and its last words are, so from
order 3 on a batch sends only those n-grams of which both are; the counts of the others it knows itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import Scratch, bounded_batches, doc_crc_mod

#: Counts above this aren't discounted.
GOOD_TURING_TO = 5
#: Added to a history's total, so that some mass is left for unseen words even where nothing is discounted.
HISTORY_EXTRA = 0.5

BATCH = "batch_id long, doc_ids array<long>, held_out array<boolean>, lengths array<int>, n_train long, words binary, tokens binary"
REQUEST = "bucket int, batch_id long, n long, keys binary, counts binary, here array<long>"
REPLY = "bucket int, batch_id long, reply binary, totals array<long>"
PARTIAL = "kind string, bucket int, batch_id long, n long, keys binary, x binary, y binary, docs binary"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def packed(values: np.ndarray) -> bytes:
    """The array's bytes by place (all first bytes, all second ones, ...), compressed."""
    values = np.ascontiguousarray(values)
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes())


def unpacked(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(dtype).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


def word_key(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


#: The end of a text, which is the history of the next text's first word as well; no word is empty.
END = b""


def gram_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A 64-bit key for each history's key and word's key."""
    x = first * np.uint64(0x9E3779B97F4A7C15) + second
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def as_batch(rows: list, schema: str) -> pa.RecordBatch:
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = [pa.array(x, ARROW[kind]) for x, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)]
    return pa.RecordBatch.from_arrays(columns, [name for name, _ in fields])


def token_batches(docs: DataFrame, batch_tokens: int) -> DataFrame:
    """The tokens of all texts as numbers into each batch's own word list."""

    def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 33
        ids, held, lengths, tokens, words = [], [], [], [], {END: 0}

        def closed() -> pa.RecordBatch:
            nonlocal number, ids, held, lengths, tokens, words
            flat = np.array(tokens, dtype=np.int32)
            known = np.array([word_key(w) for w in words], dtype=np.uint64)
            order = np.argsort(known, kind="stable")  # the word list in the order of its keys
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            train = int(np.array(lengths)[~np.array(held, dtype=bool)].sum())
            row = [[number], [ids], [held], [lengths], [train], [packed_keys(known[order])], [packed(place[flat])]]
            number += 1
            ids, held, lengths, tokens, words = [], [], [], [], {END: 0}
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.int64(), pa.binary(), pa.binary()]
            names = ["batch_id", "doc_ids", "held_out", "lengths", "n_train", "words", "tokens"]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], names)

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "text", "held_out"))
            for i, s, h in zip(*columns, strict=True):
                found = (s or "").encode().lower().split()  # of bytes: A-Z, and space and \x09-\x0D
                ids.append(i)
                held.append(h)
                lengths.append(len(found) + 1)
                number_of = words.setdefault
                tokens += [number_of(w, len(words)) for w in found]
                tokens.append(0)
                if len(tokens) >= batch_tokens:
                    yield closed()
        if ids:
            yield closed()

    return docs.mapInArrow(batched, BATCH)


class Grams:
    """The distinct n-grams of one order in a batch, sorted by key.

    ``keys``: of each; ``of``: the n-gram that ends at each token, -1 where the text has begun too lately for one; ``history``
    and ``lower``: its first and its last words as numbers into the n-grams of the order below.
    """

    def __init__(self, keys: np.ndarray, of: np.ndarray, history: np.ndarray | None = None, lower: np.ndarray | None = None):
        self.keys, self.of, self.history, self.lower = keys, of, history, lower

    def over(self, tokens: np.ndarray) -> np.ndarray:
        """How often each ends at one of the chosen ``tokens`` (a mask)."""
        return np.bincount(self.of[tokens & (self.of >= 0)], minlength=len(self.keys))


class TokenBatch:
    """A batch with the n-grams of orders 1 to ``order``, and what the buckets have answered about them.

    The first word's history is the end of a text, alone; from then on histories grow by a word until they are complete.
    """

    def __init__(self, row: dict, order: int):
        self.words, tokens = unpacked_keys(row["words"]), unpacked(row["tokens"], np.int32)
        self.lengths = np.array(row["lengths"], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.train = np.repeat(~np.array(row["held_out"], dtype=bool), self.lengths)
        place = np.arange(len(tokens), dtype=np.int32) - np.repeat(self.starts.astype(np.int32), self.lengths)
        end = int(np.searchsorted(self.words, np.uint64(word_key(END))))
        self.grams = [Grams(self.words, tokens)]
        for k in range(2, order + 1):
            below = self.grams[-1]
            before = np.empty_like(tokens)
            before[1:] = below.of[:-1]
            if k == 2:
                before[self.starts] = end
            at = np.flatnonzero(place >= k - 2)
            distinct, number = np.unique(before[at].astype(np.int64) * len(self.words) + tokens[at], return_inverse=True)
            history = (distinct // len(self.words)).astype(np.int32)
            keys = gram_keys(below.keys[history], self.words[distinct % len(self.words)])
            by_key = np.argsort(keys, kind="stable")
            rank = np.empty(len(by_key), np.int32)
            rank[by_key] = np.arange(len(by_key), dtype=np.int32)
            of, lower = np.full(len(tokens), -1, np.int32), np.empty(len(keys), np.int32)
            of[at] = rank[number.ravel()]
            lower[of[at]] = below.of[at]
            self.grams.append(Grams(keys[by_key], of, history[by_key], lower))
        self.known: list[Known] = []
        for g, replies in zip(self.grams, (row.get(f"reply_{k}") for k in range(1, order + 1)), strict=True):
            if replies is not None:
                self.known.append(Known(g.over(self.train), self.asked(len(self.known) + 1), np.concatenate([unpacked(x, np.int64) for x in replies])))

    def asked(self, k: int) -> np.ndarray:
        """Which n-grams of order ``k`` other batches may have too: those of whose first and last words that is known."""
        g = self.grams[k - 1]
        if k <= 2:
            return np.ones(len(g.keys), bool)
        shared = self.known[k - 2].shared
        return shared[g.history] & shared[g.lower]


class Known:
    """Of each n-gram: its count in training, whether other batches have it and whether a held-out text has it, and whether it is
    this batch that answers for it.  What no bucket was asked occurs in this batch alone."""

    def __init__(self, own: np.ndarray, asked: np.ndarray, reply: np.ndarray):
        self.count, self.shared, self.wanted, self.owned = own.copy(), np.zeros(len(own), bool), np.zeros(len(own), bool), np.ones(len(own), bool)
        self.count[asked], self.shared[asked], self.wanted[asked], self.owned[asked] = reply >> 3, reply & 4 > 0, reply & 2 > 0, reply & 1 > 0


def bucket_cuts(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """Bucket number (the top bits) and range of the sorted keys in it."""
    buckets = (keys >> np.uint64(64 - bits)).astype(np.int64)
    numbers, first = np.unique(buckets, return_index=True)
    return zip(numbers.tolist(), first.tolist(), [*first[1:].tolist(), len(keys)][: len(first)], strict=True)


def totals_in(counts: np.ndarray) -> list[int]:
    """Tokens, distinct n-grams and counts of counts 1 ... GOOD_TURING_TO + 1."""
    return [int(counts.sum()), int((counts > 0).sum()), *(int((counts == r).sum()) for r in range(1, GOOD_TURING_TO + 2))]


def count_requests(batches: DataFrame, k: int, bits: int) -> DataFrame:
    """The distinct n-grams of order ``k`` that other batches may have, with ``2 * count + whether a held-out text has it``.

    The totals of all others are in the batch's first row.
    """

    def asked(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in batch.to_pylist():
                b = TokenBatch(row | {f"reply_{k}": None}, k)
                grams, sent = b.grams[k - 1], b.asked(k)
                own = grams.over(b.train)
                keys, counts, here = grams.keys[sent], (2 * own + (grams.over(~b.train) > 0))[sent], totals_in(own[~sent])
                out = [[n, row["batch_id"], hi - lo, packed_keys(keys[lo:hi]), packed(counts[lo:hi]), None] for n, lo, hi in bucket_cuts(keys, bits)]
                if not out:
                    out = [[row["batch_id"] % (1 << bits), row["batch_id"], 0, packed_keys(keys), packed(counts), None]]
                out[0][-1] = here
                yield as_batch(out, REQUEST)

    return batches.mapInArrow(asked, REQUEST)


def counted(requests: DataFrame) -> DataFrame:
    """Replies ``8 * count + 4 * shared + 2 * wanted + owned``: the count over all batches, and what ``Known`` says.

    totals: as in ``totals_in``, in one row of each bucket.
    """

    def added(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("batch_id")
        keys = np.concatenate([unpacked_keys(x) for x in group["keys"]])
        counts = np.concatenate([unpacked(x, np.int64) for x in group["counts"]])
        distinct, first, of, batches = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        of, total, held = of.ravel(), np.zeros(len(distinct), np.int64), np.zeros(len(distinct), bool)
        np.add.at(total, of, counts >> 1)
        held[of[counts & 1 > 0]] = True
        reply = (8 * total + 4 * (batches > 1) + 2 * held)[of]
        reply[first] += 1
        cuts = np.cumsum(group["n"].to_numpy())[:-1]
        totals = np.sum([totals_in(total), *(x for x in group["here"] if x is not None)], axis=0).tolist()
        return pd.DataFrame(
            {"bucket": group["bucket"], "batch_id": group["batch_id"], "reply": [packed(x) for x in np.split(reply, cuts)], "totals": [totals] + [None] * (len(group) - 1)}
        )

    return requests.groupBy("bucket").applyInPandas(added, REPLY)


def totals_of(replies: DataFrame) -> list[int]:
    width = GOOD_TURING_TO + 3
    row = replies.filter("totals is not null").agg(*(F.coalesce(F.sum(F.col("totals")[i]), F.lit(0)) for i in range(width))).first()
    return [int(x) for x in row]


def discounts(counts_of_counts: list[int]) -> np.ndarray:
    """d[r] for r = 0 ... GOOD_TURING_TO: Katz's discounts; where they aren't between 0 and 1, r - D of r."""
    n, k = [0, *counts_of_counts], GOOD_TURING_TO
    d = np.ones(k + 1)
    tail = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    absolute = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    for r in range(1, k + 1):
        ratio = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else 0.0
        value = (ratio - tail) / (1 - tail) if tail < 1 else 0.0
        d[r] = value if 0 < value < 1 else (r - absolute) / r
    return d


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts * np.where(counts < len(d), d[np.minimum(counts, len(d) - 1)], 1.0)


def backoff_weight(used: np.ndarray, used_lower: np.ndarray, total: np.ndarray, of_lower: np.ndarray) -> np.ndarray:
    """What a history leaves to words unseen after it, over what they have in the order below.

    The discounted counts of the words seen after it, in its own order and in the order below, and the totals that these are parts of.
    """
    return (1 - used / total) / np.maximum(1 - used_lower / of_lower, 1e-12)


def with_replies(batches: DataFrame, **replies: DataFrame) -> DataFrame:
    """Each batch with the answers of all buckets, in their order."""
    for name, table in replies.items():
        gathered = table.groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("bucket", "reply"))).getField("reply").alias(name))
        batches = batches.join(gathered, "batch_id", "left")
    return batches


def score_katz(docs: DataFrame, modulus: int = 7, held: int = 2, order: int = 3, batch_tokens: int = 1 << 19) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): counts, the add-one unigram score, the model's score.

    The model learns from documents with crc32(doc_id as text) mod ``modulus`` other than ``held``.  Tokens:
    words between space and \\x09-\\x0D, A-Z in lower case, then one end.  With c counts in training and
    d Good-Turing discounts of each order: P(w) = d c(w) / N, what is left over for unknown words; P(w | h) = d c(h w) / (c(h) + e),
    or where h w is unseen, a(h) P(w | h') with h' the history without its first word and
    a(h) = (1 - sum of seen P(. | h)) / (1 - sum of their P(. | h')); for an unseen history P(w | h').  The history of the first
    word is the end of text, that of the second both; from then on it is the last ``order`` - 1 words.  e is HISTORY_EXTRA.

    Words are told apart by 64-bit hashes.  The number of buckets follows the number of tokens.
    Null or empty text: the end token alone.  Null id: crc32 of the empty text.  Repeated rows and ties: every row
    counts and is scored.  A very long text: a batch of its own, whole.  Empty table: no rows.  Without training documents all
    words are unknown.  Other columns are dropped.
    """
    spark = docs.sparkSession
    bounded_batches(spark)  # a batch of tokens is larger than that, so a worker is given one at a time
    scratch = Scratch(spark)
    batches = scratch.save(token_batches(docs.select("doc_id", "text", (doc_crc_mod("doc_id", modulus) == held).alias("held_out")), batch_tokens), "batches")
    tokens = batches.agg(F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()[0]
    bits = max(6, math.ceil(math.log2(max(tokens, 1) / (1 << 20))))
    replies: dict[str, DataFrame] = {}
    for k in range(1, order + 1):
        # only from order 3 on does it pay to leave out what no other batch can have
        asking = with_replies(batches, **replies) if k > 2 else batches
        replies[f"reply_{k}"] = scratch.save(counted(count_requests(asking, k, bits)), f"reply_{k}")
    totals = [totals_of(x) for x in replies.values()]
    n_train, n_words, *word_counts = totals[0]
    d = [discounts(x[2:]) for x in totals]
    # what the discounts leave for unknown words; exact, as only the counts up to GOOD_TURING_TO are discounted
    unknown = sum((1 - d[0][r]) * r * word_counts[r - 1] for r in range(1, GOOD_TURING_TO + 1)) / n_train if n_train else 1.0
    unknown = unknown or 1.0 / (n_train + n_words + 1)

    def partial(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in batch.to_pylist():
                b = TokenBatch(row, order)
                c = b.known[0].count
                kept, of_lower = discounted(c, d[0]), np.full(len(c), float(max(n_train, 1)))
                log_p = np.log10(np.where(c > 0, kept / of_lower, unknown))
                none = np.zeros(0)
                logs, doc_at, asks, gives = log_p[b.grams[0].of], [none.astype(int)], [(none.astype(np.uint64), none, none)], [(none.astype(np.uint64), none, none)]
                for k in range(1, order):
                    grams, known, below = b.grams[k], b.known[k], b.known[k - 1]
                    h, seen, total = grams.history, known.count > 0, below.count + HISTORY_EXTRA
                    lower, kept = kept[grams.lower], discounted(known.count, d[k])
                    own = known.owned & seen  # what this batch answers for
                    used = np.bincount(h[own], weights=kept[own], minlength=len(total))
                    used_lower = np.bincount(h[own], weights=lower[own], minlength=len(total))
                    # all that follows a history which is in no other batch is in this one; weights of others come from the buckets
                    backed = ~seen & (below.count[h] > 0)
                    here = backed & ~below.shared[h]
                    weight = backoff_weight(used, used_lower, total, of_lower)
                    log_p = np.where(seen, np.log10(np.where(seen, kept, 1) / total[h]), log_p[grams.lower])
                    log_p[here] += np.log10(weight[h[here]])
                    there = np.flatnonzero(grams.of >= 0)
                    logs[there] = log_p[grams.of[there]]
                    at = there[(backed & below.shared[h])[grams.of[there]]]
                    doc_at.append(np.searchsorted(b.starts, at, side="right") - 1)
                    asked = h[grams.of[at]]
                    asks.append((b.grams[k - 1].keys[asked], total[asked], of_lower[asked]))
                    g = np.flatnonzero((used > 0) & below.shared & below.wanted)
                    gives.append((b.grams[k - 1].keys[g], used[g], used_lower[g]))
                    of_lower = total[grams.lower]
                score = np.add.reduceat(logs, b.starts)
                base = np.add.reduceat(np.log10((c + 1) / (n_train + n_words + 1))[b.grams[0].of], b.starts)
                n_known = np.add.reduceat((c > 0)[b.grams[0].of].astype(np.int64), b.starts)
                out: list[tuple] = []
                for kind, keys_of in (("give", gives), ("ask", asks)):
                    keys, x, y = (np.concatenate(c) for c in zip(*keys_of, strict=True))
                    keys, first, at = np.unique(keys, return_index=True, return_inverse=True)
                    x, y = x[first], y[first]
                    for n, lo, hi in bucket_cuts(keys, bits):
                        out.append((kind, n, row["batch_id"], hi - lo, packed_keys(keys[lo:hi]), packed(x[lo:hi]), packed(y[lo:hi]), None))
                ids = row["doc_ids"]
                table = pa.table({
                    "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(row["held_out"], pa.bool_()), "n_tokens": b.lengths,
                    "n_known": n_known, "base_score": base, "score": score,
                })
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema) as writer:
                    writer.write_table(table)
                # what a token waits for: its text, and the number of the weight among those asked for
                out.append(("docs", -1, row["batch_id"], len(ids), None, packed(np.concatenate(doc_at)), packed(at.ravel()), sink.getvalue().to_pybytes()))
                yield as_batch(out, PARTIAL)

    # in two halves, as the first one's shuffle files are gone before the second one's are written
    half = lambda table, i: table.filter(F.pmod(F.xxhash64("batch_id"), F.lit(2)) == i)
    halves = [with_replies(half(batches, i), **{name: half(x, i) for name, x in replies.items()}) for i in (0, 1)]
    parts = reduce(DataFrame.unionAll, [scratch.save(x.mapInArrow(partial, PARTIAL)) for x in halves])
    scratch.clean("batches", *replies)

    def weighed(group: pd.DataFrame) -> pd.DataFrame:
        """Backoff weights of the histories in a bucket, for the batches that ask."""
        group = group.sort_values(["batch_id", "kind"])
        give, ask = group[group["kind"] == "give"], group[group["kind"] == "ask"]
        if not len(ask):
            return pd.DataFrame({"bucket": [], "batch_id": [], "reply": [], "totals": []}, dtype=object)
        empty = np.zeros(0, np.uint64)
        keys, of = np.unique(np.concatenate([empty, *(unpacked_keys(x) for x in give["keys"])]), return_inverse=True)
        # a last place, of a history from which nothing is taken, for keys that no batch gives
        add = lambda c: np.bincount(of.ravel(), weights=np.concatenate([empty.astype(float), *(unpacked(x, np.float64) for x in give[c])]), minlength=len(keys) + 1)
        used, used_lower, replies = add("x"), add("y"), []
        for wanted, total, of_lower in zip(ask["keys"], ask["x"], ask["y"], strict=True):
            wanted = unpacked_keys(wanted)
            at = np.searchsorted(keys, wanted)
            at[np.append(keys, np.uint64(0))[at] != wanted] = len(keys)
            replies.append(packed(backoff_weight(used[at], used_lower[at], unpacked(total, np.float64), unpacked(of_lower, np.float64))))
        return pd.DataFrame({"bucket": ask["bucket"], "batch_id": ask["batch_id"], "reply": replies, "totals": None})

    weights = parts.filter("kind <> 'docs'").groupBy("bucket").applyInPandas(weighed, REPLY)

    def finished(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in batch.to_pylist():
                table = pa.ipc.open_stream(row["docs"]).read_all()
                score = table["score"].to_numpy().copy()
                doc, at = unpacked(row["x"], np.int64), unpacked(row["y"], np.int64)
                if len(doc):
                    alpha = np.concatenate([unpacked(x, np.float64) for x in row["weights"]])
                    score += np.bincount(doc, weights=np.log10(alpha[at]), minlength=len(score))
                t = table.combine_chunks().to_batches()[0]
                names = [f.split(" ")[0] for f in RESULT.split(", ")]
                train = pa.array(np.full(len(score), n_train, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [t["doc_id"], t["held_out"], t["n_tokens"], t["n_known"], train, t["base_score"], pa.array(score)], names
                )

    per_batch = parts.filter("kind = 'docs'").select("batch_id", "docs", "x", "y")
    return with_replies(per_batch, weights=weights).mapInArrow(finished, RESULT)
