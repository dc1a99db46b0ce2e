"""Documents drawn towards a target distribution: hashed n-gram features, importance weights, and the largest perturbed scores."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import Scratch, arrow_map

#: What separates words: every ASCII character but digits and lower-case letters; texts are put in lower case before.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
#: Words of which the features are made at a time.
PIECE = 1_000_000


def features(texts: pa.Array, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``document, bucket, words`` of every feature: all words and all two words in a row, repeats included.  words is 1 or 2.

    Kernels lower and split the texts and encode the words; a pair is two neighbouring codes.  The crc32 of each distinct
    word, and of each distinct pair (carried on from its first word and a space), is taken once and dealt out.
    """
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), BETWEEN)
    flat, document = pc.list_flatten(lists), pc.list_parent_indices(lists)
    there = pc.greater(pc.binary_length(flat), 0)
    flat, document = flat.filter(there), document.filter(there).to_numpy().astype(np.int64)
    for lo in range(0, len(flat), PIECE):
        part = pc.dictionary_encode(flat.slice(lo, PIECE + 1))  # one word more: the pair across the cut
        code, doc = part.indices.to_numpy().astype(np.int64), document[lo : lo + PIECE + 1]
        words = part.dictionary.cast(pa.binary()).to_pylist()
        crc = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
        own = min(PIECE, len(code))
        yield doc[:own], (crc % buckets)[code[:own]], np.ones(own, np.int64)
        both = np.flatnonzero(doc[1:] == doc[:-1])
        pairs = pc.dictionary_encode(pa.array(code[both] * len(words) + code[both + 1]))
        first, second = np.divmod(pairs.dictionary.to_numpy().astype(np.int64), max(len(words), 1))
        begun = [zlib.crc32(b" ", c) for c in crc.tolist()]
        found = map(zlib.crc32, map(words.__getitem__, second.tolist()), map(begun.__getitem__, first.tolist()))
        of_pair = np.fromiter(found, np.int64, len(first)) % buckets
        yield doc[:-1][both], of_pair[pairs.indices.to_numpy()], np.full(len(both), 2, np.int64)


def bucket_counts(texts: DataFrame, buckets: int, text: str = "text") -> DataFrame:
    """``bucket, n``: features of all texts in each bucket; at most ``buckets`` rows, added up before and after one shuffle."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, bucket, _ in features(batch.column(0), buckets):
                total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], ["bucket", "n"])

    return arrow_map(texts.select(text), counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """By bucket floor(1000 ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))); two small tables of ``buckets`` rows reach the driver."""
    found = []
    for counts in (target, corpus):
        n = np.zeros(buckets)
        for row in counts.collect():
            n[row["bucket"]] = row["n"]
        found.append(n)
    t, s = found
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``docs`` without its text, with n_words, n_features and weight, the floored mean gain of the features."""
    rest = [c for c in docs.columns if c != "text"]
    schema = docs.select(*rest).schema
    for c in ("n_words", "n_features", "weight"):
        schema = schema.add(c, "long")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for doc, bucket, words in features(batch.column("text"), len(gain)):
                if not len(doc):
                    continue
                # features come by document: each run of one document is one segment to reduce
                starts = np.flatnonzero(np.diff(doc, prepend=-1))
                at, size = doc[starts], np.diff(starts, append=len(doc))
                np.add.at(total, at, np.add.reduceat(gain.take(bucket), starts))
                np.add.at(n_features, at, size)
                if words[0] == 1:
                    np.add.at(n_words, at, size)
            weight = total // np.maximum(n_features, 1)
            yield pa.RecordBatch.from_arrays([*map(batch.column, rest), *map(pa.array, (n_words, n_features, weight))], [*rest, "n_words", "n_features", "weight"])

    return arrow_map(docs, scored, schema)


def ranked(df: DataFrame, order: list[F.Column], scratch: Scratch) -> DataFrame:
    """``df``, a table that is written, with rank, from 1 in the order of ``order`` over all rows: ranges of the order are numbered side by side.

    The order ends with a column that differs among equal rows, so even a third of all rows that are alike are many ranges.
    The ranges' starts are sums over as many rows as there are shuffle partitions.
    """
    dealt = scratch.save(df.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()))
    before = F.sum("n_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1))
    starts = dealt.groupBy("range_").agg(F.count("*").alias("n_")).select("range_", F.coalesce(before, F.lit(0)).alias("start_"))
    inside = F.row_number().over(Window.partitionBy("range_").orderBy(*order))
    return dealt.withColumn("rank", inside).join(F.broadcast(starts), "range_").withColumn("rank", F.col("rank") + F.col("start_")).drop("range_", "start_")


def importance_resampling(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS, target_text: str = "text") -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document; those drawn have a rank.

    Words are runs of ASCII letters and digits (in lower case) and of characters outside ASCII; features are the words and
    two words in a row, counted as often as they occur, in ``buckets`` buckets of their crc32.  A bucket's gain is the log
    of its share in the target texts over its share in the documents; weight is the mean gain of a document's features.  score
    adds a Gumbel number made from sha256(seed:doc_id), so the largest scores are a sample without replacement in
    proportion to exp(weight / 1000).  Of the N documents with ``least_words`` words or more the floor(percent N / 100) with the largest
    scores are drawn, ties to the smaller doc_id.

    The counts cover all documents and all target texts; a table of ``buckets`` gains goes to the tasks.

    Null and empty texts: no features, weight 0, never drawn.  A null id is hashed as empty and comes first among ties.  Repeated rows
    are rows of their own, in any order among each other.  Very long texts: whole, a million words at a time.  Empty table: no rows;
    empty target: its shares are equal.  Further columns, whatever their names, are dropped.
    """
    scratch = Scratch(docs.sparkSession)
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets, target_text), buckets)
    rows = weighed(docs.select("doc_id", "text"), gain)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    rows = scratch.save(rows.withColumns({"score": F.col("weight") + noise, "tie_": F.rand(seed)}))
    able = rows.filter(F.col("n_words") >= least_words)
    placed = ranked(able, [F.desc("score"), F.asc("doc_id"), F.asc("tie_")], scratch)
    size = able.agg(F.count("*").alias("size_"))  # one row
    placed = placed.crossJoin(F.broadcast(size)).withColumn("rank", F.when(F.col("rank") <= F.floor(F.lit(percent) * F.col("size_") / 100), F.col("rank")).cast("long"))
    rest = rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return placed.select(*columns).unionByName(rest.select(*columns))
